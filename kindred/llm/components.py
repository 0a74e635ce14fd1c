"""Connected components of a table of links, always by rounds of joins, however few the links are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import components as graph


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): root is the least node that can be reached; nodes without a link to a lesser one are absent.

    Links with a null end are ignored; repeated ones count once.
    """
    rows = links.select(F.col(a).alias("src"), F.col(b).alias("dst"))
    return graph.components(rows, local_links=0).filter("node != root")
