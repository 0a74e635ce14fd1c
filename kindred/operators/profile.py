"""Profiles of tables and fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blocking import tasks

#: Words for streets, long and short.
_STREETS = tuple(w for pair in ("road rd", "lane ln", "drive dr", "court ct", "place pl", "street st", "avenue ave", "boulevard blvd", "way") for w in pair.split())
#: What the values of a semantic type look like.
PATTERNS = {
    "email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$",
    "date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}.*)?$|^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}$",
    "phone": r"^[+(]?[0-9][0-9\s().-]{6,}$",
    "numeric": r"^-?[0-9]+([.][0-9]+)?$",
    "org": r"(?i)\b(inc|incorporated|llc|ltd|corp|corporation|co|company|gmbh|plc|sa|ag|nv)\b",
    "street": rf"(?i)\b({'|'.join(_STREETS)})\b",
    "digit": "[0-9]",
    "alpha": r"^[A-Za-z]+( [A-Za-z]+)*$",
}


def unpivot(docs: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value): every column as text. One scan, whatever the number of columns."""
    return docs.select(F.inline(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns))))


def data_quality(docs: DataFrame, columns: list[str]) -> DataFrame:
    """(field, total, nulls, null_percent, distinct_values, completeness) of each field."""
    n = F.count("*")
    return unpivot(docs, columns).groupBy("field").agg(n.alias("total"), (n - F.count("value")).alias("nulls"), F.round(100 * (n - F.count("value")) / n, 2).alias("null_percent"), F.countDistinct("value").alias("distinct_values"), F.round(F.count("value") / n, 4).alias("completeness"))


def completeness(docs: DataFrame, columns: list[str]) -> DataFrame:
    return data_quality(docs, columns).agg(F.round(F.avg("completeness"), 4).alias("overall_completeness"))


def field_profile(docs: DataFrame, columns: list[str], top: int = 5) -> DataFrame:
    """(field, null_rate, distinct_count, heavy_hitters, entropy, avg_tokens, avg_chars).

    Distinct and heavy values are taken in lower case without outer blanks; entropy is that of the heavy hitters' own
    shares, relative to its greatest value.
    """
    v = unpivot(docs, columns).withColumn("shown", F.lower(F.trim("value")))
    base = v.groupBy("field").agg(F.count("*").alias("rows"), F.count("value").alias("filled"), F.round(F.avg(F.size(F.filter(F.split(F.trim("value"), r"\s+"), lambda w: w != ""))), 4).alias("avg_tokens"), F.round(F.avg(F.length("value")), 4).alias("avg_chars"))
    counted = v.filter("shown is not null").groupBy("field", "shown").agg(F.count("*").alias("n"))
    distinct = counted.groupBy("field").agg(F.count("*").alias("distinct_count"))
    w = Window.partitionBy("field").orderBy(F.desc("n"), "shown")
    heavy = counted.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= top).join(base.select("field", "filled"), "field").withColumn("p", F.col("n") / F.col("filled"))
    summed = heavy.groupBy("field").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "shown"))), lambda x: x["shown"]).alias("heavy_hitters"), (-F.sum(F.col("p") * F.log2("p"))).alias("h"), F.count("*").alias("k"))
    entropy = F.when(F.col("k") > 1, F.round(F.col("h") / F.log2(F.col("k").cast("double")), 4)).otherwise(0.0)
    out = base.join(distinct, "field", "left").join(summed, "field", "left")
    return out.select("field", F.round(1 - F.col("filled") / F.col("rows"), 4).alias("null_rate"), F.coalesce("distinct_count", F.lit(0)).alias("distinct_count"), F.coalesce("heavy_hitters", F.expr("cast(array() as array<string>)")).alias("heavy_hitters"), F.coalesce(entropy, F.lit(0.0)).alias("entropy"), F.coalesce("avg_tokens", F.lit(0.0)).alias("avg_tokens"), F.coalesce("avg_chars", F.lit(0.0)).alias("avg_chars"))


def pairwise_signals(docs: DataFrame, first: str, second: str) -> DataFrame:
    """One row: duplicate rate and hub risk of the two fields' joint values."""
    n = docs.groupBy(F.concat_ws("|", *(F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))) for c in (first, second))).alias("s")).agg(F.count("*").alias("n"))
    rows = F.sum("n")
    return n.agg(F.round(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0)) / rows, 4).alias("duplicate_rate"), F.round(F.max("n") / rows, 4).alias("hub_risk"))


def type_shares(docs: DataFrame, columns: list[str]) -> DataFrame:
    """(field, n, cardinality, avg_tokens, avg_length, f_<pattern>...) over values that are not blank.

    A value's copies are counted first and looked at once. Rows are dealt by field and value to parts of each field's
    range of hashes, so a task holds the distinct values of its part alone; what goes on from there are sums.
    """
    v = unpivot(docs, columns).select("field", F.trim("value").alias("v")).filter("v != ''")
    many = tasks(docs.sparkSession)
    counted = v.repartition(many, "field", "v").groupBy("field", "v").agg(F.count("*").alias("n"))
    n = F.col("n")
    total = lambda x, name: F.sum(n * x).alias(name)
    sums = [total(F.col("v").rlike(p).cast("int"), f"f_{k}") for k, p in PATTERNS.items()]
    found = counted.groupBy("field").agg(F.sum("n").alias("n"), F.count("*").alias("kinds"), total(F.size(F.split("v", r"\s+")), "tokens"), total(F.length("v"), "chars"), *sums)
    mean = lambda x, name: F.round(F.col(x) / n, 4).alias(name)
    return found.select("field", "n", mean("kinds", "cardinality"), mean("tokens", "avg_tokens"), mean("chars", "avg_length"), *(mean(f"f_{k}", f"f_{k}") for k in PATTERNS))


def semantic_type(shares: DataFrame) -> DataFrame:
    """shares with semantic_type: the first rule that fits, the most specific first."""
    c = F.col
    rules: list[tuple[Column, str]] = [
        (c("f_email") >= 0.8, "email"),
        (c("f_date") >= 0.8, "date"),
        (c("f_phone") >= 0.8, "phone"),
        (c("f_numeric") >= 0.9, "numeric"),
        (c("f_org") >= 0.3, "org_name"),
        ((c("f_street") >= 0.3) | ((c("f_digit") >= 0.5) & (c("avg_tokens") >= 3)), "address"),
        (c("avg_tokens").between(2, 3) & (c("f_alpha") >= 0.7), "person_name"),
        ((c("cardinality") >= 0.95) & (c("avg_tokens") <= 1), "id"),
        ((c("avg_tokens") >= 5) | (c("avg_length") >= 60), "free_text"),
    ]
    out: Column = F.lit("short_string")
    for test, name in reversed(rules):
        out = F.when(test, name).otherwise(out)
    return shares.withColumn("semantic_type", out)


#: algorithm, transformers, agreement, m, u and weight by semantic type.
COMPARATORS = {
    "email": ("jaro_winkler", ("lower", "strip"), 0.95, 0.95, 0.005, 1.0),
    "id": ("levenshtein", ("upper", "strip"), 1.0, 0.97, 0.001, 1.0),
    "phone": ("levenshtein", ("digits_only",), 1.0, 0.92, 0.01, 0.9),
    "person_name": ("jaro_winkler", ("strip", "collapse_whitespace"), 0.88, 0.9, 0.03, 0.8),
    "org_name": ("jaro_winkler", ("company_suffix", "collapse_whitespace"), 0.85, 0.88, 0.05, 0.8),
    "address": ("jaro_winkler", ("street_suffix", "collapse_whitespace"), 0.85, 0.88, 0.06, 0.7),
    "free_text": ("jaccard", ("lower", "remove_punctuation"), 0.6, 0.8, 0.1, 0.5),
    "short_string": ("jaro_winkler", ("strip",), 0.85, 0.85, 0.08, 0.5),
    "date": ("levenshtein", ("strip",), 1.0, 0.9, 0.02, 0.4),
    "numeric": ("levenshtein", ("strip",), 1.0, 0.85, 0.05, 0.3),
}


def comparison_config(types: dict[str, str]) -> list[dict]:
    """Fields by their semantic types: what a weighted comparison of them should look like."""
    return [{"name": f, "semantic_type": t, **dict(zip(("algorithm", "transformers", "threshold", "m", "u", "weight"), COMPARATORS[t], strict=True))} for f, t in types.items()]


def term_frequencies(docs: DataFrame, fields: list[str], top: int = 100) -> DataFrame:
    """(field, value, n, frequency): each field's most frequent values in upper case without outer blanks."""
    v = unpivot(docs, fields).select("field", F.upper(F.trim("value")).alias("value")).filter("value != ''")
    counted = v.groupBy("field", "value").agg(F.count("*").alias("n"))
    totals = counted.groupBy("field").agg(F.sum("n").alias("total"))
    w = Window.partitionBy("field").orderBy(F.desc("n"), "value")
    # One row a field.
    return counted.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= top).join(F.broadcast(totals), "field").select("field", "value", "n", F.round(F.col("n") / F.col("total"), 6).alias("frequency"))


def sample(docs: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    """Any n rows, or n random ones."""
    return docs.limit(n) if seed is None else docs.orderBy(F.rand(seed)).limit(n)


def summary(docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(field, type, rows, filled): a table's inferred schema and counts."""
    names = columns or docs.columns
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    counts = unpivot(docs.select(*(F.col(c).isNotNull().cast("int").alias(c) for c in names)), names)
    return counts.groupBy("field").agg(F.count("*").alias("rows"), F.sum(F.col("value").cast("long")).alias("filled")).withColumn("type", reduce(lambda x, c: F.when(F.col("field") == c, kinds[c]).otherwise(x), names, F.lit(None).cast("string")))


def catalogue(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, rows) of tables."""
    return reduce(DataFrame.unionByName, (df.agg(F.lit(name).alias("name"), F.count("*").alias("rows")).select("name", "rows") for name, df in tables.items()))


def session_catalogue(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())
