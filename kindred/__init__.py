"""Record linkage on Spark DataFrames: block, score, cluster, fuse, evaluate."""
