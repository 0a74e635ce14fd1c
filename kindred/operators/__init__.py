"""Operators on DataFrames: filter, block, score, gate, cluster, fuse, profile, evaluate."""
