"""URL filters: explicit rules first, then a tree of path templates per host.

A path's segments that look variable (numbers, long or mixed with digits) become wildcards; then, host by host and
level by level, a node whose children are many and seldom repeated has them generalised into one wildcard. The
templates of one host form its tree.

The pages that rules decide are the labels. Going down a host's tree from its root, a branch whose share of blocked
pages does not differ significantly from what its parent would lead one to expect is merged with its parent; any other
takes its own share, smoothed by its parent's. A branch without a labelled page has the share of the deepest node above
it that has one, and a host without any the prior: no host is judged by the pages of others. A template of share CUT or
more is rejected.

Defined cases: a null url, or one without "://", has empty host and path, which is a template like any other; a url's
length has no bound, but only DEPTH segments of its path tell templates apart; with no page decided by a rule every
share is the prior and everything is allowed; repeated rows are judged alike; the rule of most characters wins, the
first listed among equals; columns but the id and the url are not read, so none can clash; an empty table gives none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import keep

DEPTH = 4
#: A node's children become a wildcard if they are more than this many and are met less than FEW times on average.
MANY, FEW = 20, 3.0
SMOOTHING = 4.0
PRIOR = 0.25
#: Standard deviations by which a branch must differ from its parent to stand by itself.
APART = 2.0
CUT = 0.5


@dataclass(frozen=True)
class Rule:
    """verdict for a host with its subdomains and paths that start with path."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def parsed(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    pattern = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, pattern, 1), upper, lower), F.regexp_extract(text, pattern, 2)


def ruled(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Name and verdict of the rule that holds, null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(reversed(rules), key=lambda r: len(r.name)):  # the last that fits wins
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def segments(path: Column, depth: int = DEPTH) -> Column:
    """The path's first segments with those that look variable as wildcards; what goes deeper is one wildcard."""
    raw = F.filter(F.split(path, "/"), lambda s: s != "")
    variable = lambda s: s.rlike(r"[0-9]") | (F.length(s) > 24)
    shown = F.transform(raw, lambda s: F.when(variable(s), F.lit("*")).otherwise(s))
    return F.when(F.size(shown) <= depth, shown).otherwise(F.concat(F.slice(shown, 1, depth), F.array(F.lit("**"))))


def templates(counted: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(host, raw, template, labelled, blocked) from (host, raw, n, labelled, blocked), one row a host and raw template.

    Each level needs what the one before it generalised, so each is kept: a plan reads its predecessor twice.
    """
    rows = keep(counted.withColumn("template", F.col("raw")), "level0")
    for level in range(1, depth + 1):
        before, child = F.slice("template", 1, level - 1), F.try_element_at("template", F.lit(level))
        at = rows.withColumn("parent", before).withColumn("child", child)
        children = at.filter("child is not null and child != '*' and child != '**'").groupBy("host", "parent", "child").agg(F.sum("n").alias("n"))
        wide = children.groupBy("host", "parent").agg(F.count("*").alias("many"), F.sum("n").alias("n")).filter((F.col("many") > MANY) & (F.col("n") < F.col("many") * FEW)).select("host", "parent", F.lit(True).alias("wide"))
        joined = at.join(wide, ["host", "parent"], "left")
        general = F.concat(F.col("parent"), F.array(F.lit("*")), F.slice("template", level + 1, depth + 1))
        template = F.when(F.col("wide") & F.col("child").isNotNull() & (F.col("child") != "**"), general).otherwise(F.col("template"))
        rows = keep(joined.select("host", "raw", "n", "labelled", "blocked", template.alias("template")), f"level{level}")
    return rows.drop("n")


def _share(line: str) -> Column:
    """Share of blocked pages at the end of a line of nodes, from the root down."""

    def step(share: Column, node: Column) -> Column:
        n, bad = node["labelled"].cast("double"), node["blocked"].cast("double")
        merged = F.abs(bad - n * share) <= APART * F.sqrt(n * share * (1 - share))
        return F.when((n == 0) | merged, share).otherwise((bad + SMOOTHING * share) / (n + SMOOTHING))

    return F.aggregate(line, F.lit(PRIOR), step)


def shares(rows: DataFrame) -> DataFrame:
    """(host, template, share) for the templates of rows (host, template, labelled, blocked)."""
    leaves = rows.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    lines = leaves.withColumn("k", F.explode(F.sequence(F.lit(0), F.size("template")))).withColumn("node", F.slice("template", F.lit(1), F.col("k")))
    nodes = lines.groupBy("host", "node").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    met = lines.select("host", "template", "k", "node").join(nodes, ["host", "node"])
    # A line has a node a level, so no list grows with the table.
    line = met.groupBy("host", "template").agg(F.sort_array(F.collect_list(F.struct("k", "labelled", "blocked"))).alias("line"))
    return line.select("host", "template", _share("line").alias("share"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_column: str = "page_id", url_column: str = "url", depth: int = DEPTH) -> DataFrame:
    """(id, host, path, rule, verdict, template, share) of every page.

    Pages are counted by template before anything is joined, so a host with a third of all is no heavier than its templates.
    """
    host, path = parsed(F.col(url_column))
    split = pages.select(F.col(id_column).alias("id"), host.alias("host"), path.alias("path"))
    name, verdict = ruled(F.col("host"), F.col("path"), rules)
    known = keep(split.select("id", "host", "path", name.alias("rule"), verdict.alias("said"), segments(F.col("path"), depth).alias("raw")), "urls")
    counted = known.groupBy("host", "raw").agg(F.count("*").alias("n"), F.count("said").alias("labelled"), F.count_if(F.col("said") == "block").alias("blocked"))
    found = templates(counted, depth)
    judged = found.select("host", "raw", "template").join(shares(found), ["host", "template"])
    joined = known.join(judged, ["host", "raw"])
    own = F.when(F.col("share") >= CUT, "block").otherwise("allow")
    return joined.select(F.col("id").alias(id_column), "host", "path", "rule", F.coalesce("said", own).alias("verdict"), F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), F.round("share", 6).alias("share"))
