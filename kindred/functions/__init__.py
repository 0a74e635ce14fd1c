"""Column expressions: normalisation, string similarity, dates, vectors, hash keys."""
