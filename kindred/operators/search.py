"""Full-text blocking: an inverted index as a table, BM25 as a sum over it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocking import chunks, tasks
from .filters import apply_filters
from .tables import keep

K1, B = 1.2, 0.75


def postings(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(key, token, tf, size) over lower-case runs of letters, digits and underscores."""
    tokens = docs.select(F.col(key).alias("k"), F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9_]+"), lambda w: w != "").alias("w"))
    return tokens.select("k", F.size("w").alias("size"), F.explode("w").alias("token")).groupBy("k", "token", "size").agg(F.count("*").alias("tf"))


def bm25_scores(index: DataFrame, queries: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
    """(query_key, doc_key, bm25) for queries (query_key, token), each distinct token once, against postings.

    idf = ln(1 + (N - df + 0.5) / (df + 0.5)); k1 = 1.2, b = 0.75.
    """
    sizes = (corpus or index).select("k", "size").distinct().agg(F.count("*").alias("docs"), F.avg("size").alias("mean_size"))
    frequency = index.groupBy("token").agg(F.count("*").alias("df"))
    # One row of totals.
    weighed = frequency.join(F.broadcast(sizes)).select("token", "mean_size", F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    scored = index.join(weighed, "token").select("token", F.col("k").alias("doc_key"), (F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("mean_size")))).alias("part"))
    return queries.join(scored, "token").groupBy("query_key", "doc_key").agg(F.sum("part").alias("bm25"))


def bm25_top(index: DataFrame, queries: DataFrame, limit: int = 20) -> DataFrame:
    """(query_key, doc_key, bm25): the limit best of each query (query_key, token), scores to four places, of equals the
    least keys. Queries of the same tokens have the same answer, which is found once."""
    asked = queries.groupBy("query_key").agg(F.sort_array(F.collect_set("token")).alias("tokens"))
    kinds = asked.select("tokens").distinct()
    scored = bm25_scores(index, kinds.select(F.col("tokens").alias("query_key"), F.explode("tokens").alias("token"))).withColumn("bm25", F.round("bm25", 4))
    w = Window.partitionBy("query_key").orderBy(F.desc("bm25"), "doc_key")
    best = scored.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= limit).select(F.col("query_key").alias("tokens"), "doc_key", "bm25")
    return asked.join(best, "tokens").select("query_key", "doc_key", "bm25")


def pair_scores(pairs: DataFrame, queries: DataFrame, index: DataFrame) -> DataFrame:
    """(doc1_key, doc2_key, bm25) of given pairs: doc1 asks with its distinct tokens (k, token), doc2 is in the postings."""
    wanted = pairs.join(queries.select(F.col("k").alias("doc1_key"), "token").distinct(), "doc1_key").join(index.select(F.col("k").alias("doc2_key"), "token", "tf", "size"), ["doc2_key", "token"])
    frequency = index.groupBy("token").agg(F.count("*").alias("df"))
    # One row of totals.
    totals = index.select("k", "size").distinct().agg(F.count("*").alias("docs"), F.avg("size").alias("mean_size"))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("mean_size")))
    return wanted.join(frequency, "token").join(F.broadcast(totals)).groupBy("doc1_key", "doc2_key").agg(F.round(F.sum(part), 4).alias("bm25"))


def _classes(docs: DataFrame, text: str, key: str, block: str | None, values: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Classes (c, g, phrase, n, values) of rows of equal block, tokens and values, kept, and their members (c, k)."""
    tokens = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9_]+"), lambda w: w != "")
    blocked = F.col(block).cast("string") if block else F.lit(None).cast("string")
    rows = docs.select(F.col(key).alias("k"), blocked.alias("g"), F.array_join(tokens, " ").alias("phrase"), *(c.alias(v) for v, c in values.items()))
    # Numbers of rows that are written do not change.
    numbered = rows.groupBy("g", "phrase", *values).agg(F.count("*").alias("n")).withColumn("c", F.monotonically_increasing_id())
    classes = keep(numbered, "classes")
    same = reduce(lambda x, y: x & y, (F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("g", "phrase", *values)))
    return classes, rows.alias("a").join(classes.alias("b"), same).select(F.col("b.c").alias("c"), F.col("a.k").alias("k"))


def _phrase_scores(classes: DataFrame, threshold: float) -> DataFrame:
    """(c1, c2, bm25) of classes of equal g of which c2's phrase has all of c1's within it; a class is within itself.

    A phrase's rarest token is the join's key, with the block: whatever contains the phrase contains that token, and few do.
    """
    words = classes.filter("phrase != ''").select("c", "g", "n", F.split("phrase", " ").alias("w"))
    index = words.select("c", "g", "n", F.size("w").alias("size"), F.explode("w").alias("token")).groupBy("c", "g", "n", "size", "token").agg(F.count("*").alias("tf"))
    frequency = index.groupBy("token").agg(F.sum("n").alias("df"))
    # One row of totals.
    totals = words.agg(F.sum("n").alias("docs"), (F.sum(F.col("n") * F.size("w")) / F.sum("n")).alias("mean_size"))
    weighed = keep(index.join(frequency, "token"), "index")
    rarest = weighed.groupBy("c", "g", "size").agg(F.min_by("token", F.struct("df", "token")).alias("token"))
    left = rarest.select(F.col("c").alias("c1"), F.col("size").alias("n1"), "g", "token").alias("x")
    right = weighed.select(F.col("c").alias("c2"), F.col("size").alias("n2"), "g", "token").alias("y")
    met = left.join(right, (F.col("x.token") == F.col("y.token")) & F.col("x.g").eqNullSafe(F.col("y.g")) & (F.col("n1") <= F.col("n2"))).select("c1", "c2")
    shown = classes.select("c", F.concat(F.lit(" "), "phrase", F.lit(" ")).alias("p"))
    pairs = met.join(shown.withColumnsRenamed({"c": "c1", "p": "p1"}), "c1").join(shown.withColumnsRenamed({"c": "c2", "p": "p2"}), "c2").filter(F.contains("p2", F.col("p1"))).select("c1", "c2")
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("mean_size")))
    asked = pairs.join(weighed.select(F.col("c").alias("c1"), "token"), "c1")
    found = asked.join(weighed.select(F.col("c").alias("c2"), "token", "tf", "size", "df"), ["c2", "token"]).join(F.broadcast(totals))
    return found.groupBy("c1", "c2").agg(F.round(F.sum(part), 4).alias("bm25")).filter(F.col("bm25") > threshold)


def _later(members: DataFrame, scored: DataFrame, by: str, limit: int) -> DataFrame:
    """(doc1_key, doc2_key, columns of scored): of (c1, c2, by, ...) each member of c1 with the members of greater key of
    its c2s, the limit of greatest by and, of equals, of least keys.

    Members are numbered within (c1, by), a level, and gathered by the thousand in order. A row counts how many of a level
    come before it and takes the next from there, so what is shuffled are rows times levels, not pairs.
    """
    line_ = max(LINE, limit)
    rest = [c for c in scored.columns if c not in ("c1", "c2")]
    level = Window.partitionBy("c1", by)
    there = scored.join(members.select(F.col("c").alias("c2"), "k"), "c2").select("c1", "k", by, F.struct(F.col("k").alias("doc2_key"), *rest).alias("x"))
    # A document is in one class, so once in a level.
    wanted = scored.select("c1", by).distinct().join(members.select(F.col("c").alias("c1"), "k"), "c1")
    lined = there.select("c1", by, "k", F.lit(1).alias("t"), F.lit(0).alias("s")).unionByName(wanted.select("c1", by, "k", F.lit(0).alias("t"), F.lit(1).alias("s")))
    once = lined.groupBy("c1", by, "k").agg(F.sum("t").alias("t"), F.sum("s").alias("s"))
    seen = once.withColumn("done", F.sum("t").over(level.orderBy("k").rowsBetween(Window.unboundedPreceding, 0))).withColumn("left", F.sum("t").over(level) - F.col("done"))
    better = Window.partitionBy("c1", "k").orderBy(F.desc(by)).rowsBetween(Window.unboundedPreceding, -1)
    open_ = seen.filter("s > 0 and left > 0").withColumn("before", F.coalesce(F.sum("left").over(better), F.lit(0))).filter(F.col("before") < limit)
    asked = open_.select("c1", by, F.col("k").alias("doc1_key"), "done", F.least(F.col("left"), limit - F.col("before")).cast("int").alias("take"), F.floor(F.col("done") / line_).alias("line"))
    placed = there.withColumn("at", F.row_number().over(level.orderBy("k")).cast("long") - 1)
    # The first of a line end the one before, too, for those that take across its end.
    overlap = F.when((F.col("at") >= line_) & (F.col("at") % line_ < limit), F.array(F.floor(F.col("at") / line_), F.floor(F.col("at") / line_) - 1)).otherwise(F.array(F.floor(F.col("at") / line_)))
    lines = placed.select("c1", by, "at", "x", F.explode(overlap).alias("line")).groupBy("c1", by, "line").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("xs"))
    next_ = F.slice("xs", (F.col("done") - F.col("line") * line_ + 1).cast("int"), F.col("take"))
    return asked.join(lines, ["c1", by, "line"]).select("doc1_key", F.explode(next_).alias("y")).select("doc1_key", "y.x.*")


#: Places of a level that are gathered in one array.
LINE = 1000


def _all_later(members: DataFrame, scored: DataFrame) -> DataFrame:
    """(doc1_key, doc2_key, columns of scored): all pairs of members, the greater key in c2."""
    rest = [c for c in scored.columns if c not in ("c1", "c2")]
    counted = members.join(members.groupBy("c").agg(F.count("*").alias("n")), "c")
    many = chunks(counted, ["c"], "k", "n").select("c", "chunk", "rows")
    cells = scored.join(many.withColumnsRenamed({"c": "c1", "chunk": "i", "rows": "a"}), "c1").join(many.withColumnsRenamed({"c": "c2", "chunk": "j", "rows": "b"}), "c2")
    dealt = cells.repartition(tasks(members.sparkSession), "c1", "c2", "i", "j")
    both = dealt.withColumn("doc1_key", F.explode("a")).drop("a").withColumn("doc2_key", F.explode("b"))
    return both.filter("doc1_key < doc2_key").select("doc1_key", "doc2_key", *rest)


def phrase_pairs(docs: DataFrame, text: str, key: str, threshold: float = 2.0, limit: int | None = 20, block: str | None = None, filters: dict[str, dict] | None = None) -> DataFrame:
    """(doc1_key, doc2_key, bm25): doc2's text contains all of doc1's as a phrase, doc1's key is the lesser one.

    Documents of equal block and tokens are one class: classes are compared and scored, documents take their best from
    the classes' members. Filters hold for both sides; a least length is exclusive here.
    """
    classes, members = _classes(apply_filters(docs, filters or {}, strict_length=True), text, key, block, {})
    scored = _phrase_scores(classes, threshold)
    return _all_later(members, scored) if limit is None else _later(members, keep(scored, "scored"), "bm25", limit)


def hybrid_pairs(docs: DataFrame, fields: dict[str, float], key: str, levenshtein_threshold: float = 0.85, bm25_threshold: float = 2.0, bm25_weight: float = 0.2, limit: int = 20, block: str | None = None, filters: dict[str, dict] | None = None) -> DataFrame:
    """Phrase pairs on the first field whose weighted edit similarity over all fields is high enough, best first."""
    from ..functions.text import levenshtein_similarity

    first = next(iter(fields))
    shown = {f"v{i}": F.upper(F.trim(F.coalesce(F.col(f).cast("string"), F.lit("")))) for i, f in enumerate(fields)}
    classes, members = _classes(apply_filters(docs, filters or {}, strict_length=True), first, key, block, shown)
    total = sum(fields.values())
    score = F.lit(0.0)
    for v, w in zip(shown, fields.values(), strict=True):
        score = score + levenshtein_similarity(F.col(f"a_{v}"), F.col(f"b_{v}"), 0.0) * (w / total)
    a, b = (classes.select(F.col("c").alias(c), *(F.col(v).alias(f"{side}_{v}") for v in shown)) for side, c in (("a", "c1"), ("b", "c2")))
    scored = _phrase_scores(classes, bm25_threshold).join(a, "c1").join(b, "c2").select("c1", "c2", "bm25", F.round(score, 4).alias("levenshtein_score")).filter(F.col("levenshtein_score") >= levenshtein_threshold)
    combined = F.round(F.col("bm25") * bm25_weight + F.col("levenshtein_score") * (1 - bm25_weight), 4)
    return _later(members, keep(scored.withColumn("combined_score", combined), "scored"), "combined_score", limit)
