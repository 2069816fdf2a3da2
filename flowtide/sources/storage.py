"""Sinks and saved statistics: Parquet tables per split, JSON reports, fitted models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

STATS_SCHEMA = "kind string, feature string, center double, scale double"


def write_windows(windows: DataFrame, path: str) -> None:
    """Windows as Parquet, one folder per split, so that reading a split prunes the rest."""
    windows.write.mode("overwrite").partitionBy("split").parquet(path)


MANIFEST_SCHEMA = "part string, split string, rows bigint, digest decimal(38,0)"


def table_digest(table: DataFrame, part: str) -> DataFrame:
    """``part, split, rows, digest``: the sum of a hash of each row, whatever the order of rows and columns."""
    columns = [F.col(f"`{c}`") for c in sorted(c for c in table.columns if c != "split")]
    return table.groupBy(F.col("split").cast("string").alias("split")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("digest")
    ).select(F.lit(part).alias("part"), "split", "rows", "digest")


def write_graphs(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as Parquet, one folder per split, and then a manifest of both.

    The manifest counts what was to be written, so tables should be written ones; a folder without it is an unfinished write.
    """
    parts = {"nodes": nodes, "edges": edges}
    for name, table in parts.items():
        table.write.mode("overwrite").partitionBy("split").parquet(f"{path}/{name}")
    manifest = table_digest(nodes, "nodes").unionByName(table_digest(edges, "edges"))
    manifest.write.mode("overwrite").parquet(f"{path}/manifest")


def read_graphs(spark: SparkSession, path: str, split: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a written graph, of one split or all, after comparing rows and digests with the manifest."""
    here = F.lit(True) if split is None else F.col("split") == split
    wanted = {(r.part, r.split): (r.rows, r.digest) for r in spark.read.schema(MANIFEST_SCHEMA).parquet(f"{path}/manifest").where(here).collect()}
    tables = {name: read_split(spark, f"{path}/{name}", split) for name in ("nodes", "edges")}
    # One row per table and split.
    found = {(r.part, r.split): (r.rows, r.digest) for name, table in tables.items() for r in table_digest(table, name).collect()}
    broken = sorted(k for k in wanted.keys() | found.keys() if wanted.get(k) != found.get(k))
    if broken:
        raise ValueError(f"graph differs from its manifest in {broken}")
    return tables["nodes"], tables["edges"]


def read_split(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    table = spark.read.parquet(path)
    return table if split is None else table.where(F.col("split") == split)


def write_json_report(report: DataFrame, path: str) -> None:
    """A report table (nested structs and maps allowed) as JSON lines."""
    report.write.mode("overwrite").json(path)


def as_json(report: DataFrame, keys: list[str]) -> DataFrame:
    """Key columns and the remaining columns as one JSON document per row."""
    rest = [c for c in report.columns if c not in keys]
    return report.select(*keys, F.to_json(F.struct(*rest)).alias("report"))


def save_fitted(stats: DataFrame, path: str) -> None:
    """Medians and scalers as one long table ``kind, feature, center, scale``."""
    stats.select("kind", "feature", "center", "scale").write.mode("overwrite").parquet(path)


def load_fitted(spark: SparkSession, path: str) -> DataFrame:
    """Read saved statistics; a path that does not exist raises."""
    return spark.read.schema(STATS_SCHEMA).parquet(path)


COEFFICIENT_SCHEMA = "model string, row int, position int, value double"


def save_coefficients(table: DataFrame, path: str) -> None:
    """A ``forecast.coefficient_table`` as Parquet."""
    table.select("model", "row", "position", "value").write.mode("overwrite").parquet(path)


def load_coefficients(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COEFFICIENT_SCHEMA).parquet(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
