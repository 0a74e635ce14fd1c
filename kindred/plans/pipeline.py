"""The linkage pipeline: block, score, gate, edges, clusters, golden records; and its staged form."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import blocking, clusters, components, edges, filters, fusion, gates, scoring
from ..operators.tables import keep


@dataclass
class Config:
    """What a run does. fields are (name, weight, algorithm, transformers)."""

    blocking_fields: list[str]
    fields: list[tuple]
    key: str = "_key"
    threshold: float = 0.75
    most_block: int = 100
    filters: dict[str, dict] = field(default_factory=dict)
    computed: dict[str, str] = field(default_factory=dict)
    least_cluster: int = 2
    golden_fields: list[str] = field(default_factory=list)
    golden_strategy: str = "field_voting"

    def validate(self) -> list[str]:
        """What is wrong, nothing if all is well."""
        wrong = []
        if not self.blocking_fields:
            wrong.append("no blocking fields")
        if not self.fields:
            wrong.append("no fields to compare")
        if not 0 <= self.threshold <= 1:
            wrong.append("threshold is not between 0 and 1")
        if self.most_block < 2:
            wrong.append("blocks must have room for two")
        if self.golden_strategy not in fusion.STRATEGIES:
            wrong.append(f"unknown strategy {self.golden_strategy}")
        for name in [*self.blocking_fields, *(f[0] for f in self.fields if f)]:
            try:
                filters.check_name(name)
            except ValueError as e:
                wrong.append(str(e))
        return wrong

    @classmethod
    def from_text(cls, text: str) -> Config:
        """From JSON, or YAML where its reader is installed."""
        try:
            data = json.loads(text)
        except ValueError:
            import yaml

            data = yaml.safe_load(text)
        out = cls(**data)
        if wrong := out.validate():
            raise ValueError("; ".join(wrong))
        return out

    def compared(self) -> list[scoring.Field]:
        return [scoring.Field(f[0], *(tuple(x) if isinstance(x, list) else x for x in f[1:])) for f in self.fields]


@dataclass
class Result:
    """Lazy tables of a run, but edges and members, which are kept."""

    candidates: DataFrame
    edges: DataFrame
    members: DataFrame
    quality: DataFrame
    golden: DataFrame | None

    def metrics(self) -> dict[str, int]:
        """Counts; each is a job, run when asked for."""
        return {"edges": self.edges.count(), "clusters": self.members.select("cluster_id").distinct().count(), "members": self.members.count()}


def run(docs: DataFrame, config: Config, timestamp: str | None = None) -> Result:
    """One pass over docs."""
    if wrong := config.validate():
        raise ValueError("; ".join(wrong))
    strategy = blocking.Exact(config.blocking_fields, config.key, config.filters, config.most_block, computed_fields=config.computed)
    pairs = strategy.generate(docs)
    scored = scoring.score_pairs(pairs.select("doc1_key", "doc2_key"), docs, config.compared(), config.threshold, config.key)
    made = keep(edges.make_edges(scored, "exact", timestamp), "edges")
    members = keep(components.clusters(components.components(made), config.least_cluster), "members")
    keyed = docs.withColumn(config.key, F.col(config.key).cast("string"))
    golden = fusion.golden_records(members, keyed, config.golden_fields, config.key, config.golden_strategy) if config.golden_fields else None
    return Result(pairs, made, members, clusters.quality(members, made), golden)


@dataclass
class Stage:
    """One stage of a staged run: its blocking, its comparison, its gates."""

    name: str
    blocking_fields: list[str]
    fields: list[scoring.Field]
    threshold: float
    gates: gates.Gates | None = None
    gate_columns: list[str] = field(default_factory=list)
    most_block: int = 100


def run_staged(docs: DataFrame, stages: list[Stage], key: str = "_key", timestamp: str = "") -> tuple[DataFrame, DataFrame]:
    """(edges, members): each stage works on the documents that no earlier stage gave an edge; clusters come once, from all."""
    all_edges: DataFrame | None = None
    for stage in stages:
        left = docs if all_edges is None else filters.unresolved(docs.withColumn("_text_key", F.col(key).cast("string")), all_edges, "_text_key").drop("_text_key")
        pairs = blocking.Exact(stage.blocking_fields, key, most=stage.most_block).generate(left).select("doc1_key", "doc2_key")
        scored = scoring.score_pairs(pairs, left, stage.fields, stage.threshold, key)
        if stage.gates is not None:
            scored = gates.apply_gates(scored, stage.gates, gates.token_table(left, stage.gate_columns, key)).drop("rejected_by")
        made = keep(edges.make_edges(scored, stage.name, timestamp), stage.name)
        all_edges = made if all_edges is None else all_edges.unionByName(made)
    if all_edges is None:
        raise ValueError("no stages")
    return all_edges, components.clusters(components.components(all_edges))


def status(docs: DataFrame, made: DataFrame, members: DataFrame) -> DataFrame:
    """One row: documents, edges, clusters."""
    one = docs.agg(F.count("*").alias("documents"))
    return one.join(F.broadcast(made.agg(F.count("*").alias("edges")))).join(F.broadcast(members.agg(F.countDistinct("cluster_id").alias("clusters"))))


def encode_records(docs: DataFrame, columns: list[str], key: str, dimensions: int = 64) -> DataFrame:
    """(key, text, vector): records as text and hashed word counts, unit length: a stand-in for a text encoder."""
    from ..functions.text import gate_tokens, serialise

    text = docs.select(key, serialise(columns).alias("text"))
    words = text.select(key, "text", F.explode_outer(gate_tokens(F.col("text"))).alias("w"))
    placed = words.withColumn("k", F.pmod(F.xxhash64("w"), F.lit(dimensions))).withColumn("x", F.when(F.col("w").isNull(), 0.0).when(F.pmod(F.xxhash64("w", F.lit(1)), F.lit(2)) == 0, -1.0).otherwise(1.0))
    parts = [F.sum(F.when(F.col("k") == i, F.col("x")).otherwise(0.0)) for i in range(dimensions)]
    summed = placed.groupBy(key, "text").agg(F.array(*parts).alias("v"))
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return summed.select(key, "text", F.transform("v", lambda x: F.when(size > 0, x / size).otherwise(0.0)).alias("vector"))
