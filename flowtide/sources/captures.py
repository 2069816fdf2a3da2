"""Flow captures as CSV: raw scans, header clean-up, typed flow table."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

import pyarrow as pa

from flowtide.functions.labels import sanitize_label
from flowtide.functions.values import fix_12h_clock, has_text, parse_timestamp, strip, to_number, to_whole
from flowtide.plans.materialise import materialise, scratch_path
from flowtide.schema import CSV_FIELDS, FLOW_SCHEMA


# Columns that every capture must name in its header.
KEY_COLUMNS = ("Flow ID", "Source IP", "Timestamp")
# More than any file: each file is a task of its own, read from its start.
WHOLE_FILE = str(1 << 50)
FILE_FIELDS = ("source_file", "file_path", "file_size")


def _file_name() -> Column:
    """The plain name of a row's file; Spark's metadata gives it percent-encoded, a plus sign as it is."""
    return F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))


def read_raw_untyped(
    spark: SparkSession, path: str | list[str], check_headers: bool = True, base: str | None = None
) -> DataFrame:
    """Every cell as text, no null tokens, one scan for a file, a list or a folder.

    Broken UTF-8 becomes U+FFFD, surplus cells are dropped and short rows padded.  Adds
    ``source_file`` (the file name, unless the folder is partitioned by it),
    ``file_path`` and ``file_size``.

    ``check_headers`` compares the header of every file with the columns a query reads and
    fails on a file with another layout instead of shifting its columns.  The second of two
    equal headers never passes that check; turn it off to read such a column.  ``base`` is the folder
    from which partition folders count, for a list of files.
    """
    reader = spark.read.option("basePath", base) if base else spark.read
    raw = (
        reader.option("header", True)
        .option("mode", "PERMISSIVE")
        .option("enforceSchema", not check_headers)
        .option("encoding", "UTF-8")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("pathGlobFilter", "*.csv")
        .csv(path)
    )
    cells = [F.col(f"`{c}`") for c in raw.columns if c != "source_file"]
    source = F.col("source_file") if "source_file" in raw.columns else _file_name()
    return raw.select(*cells, source.alias("source_file"), F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_size").alias("file_size"))


def duplicate_headers(columns: list[str]) -> list[str]:
    """Names that occur more than once, given columns as Spark read them.

    Spark marks each repeat by appending its position, so a name is a duplicate when
    stripping that number from a column at that position gives a name seen twice.
    """
    bases = [re.sub(rf"{i}$", "", c).strip() if c.endswith(str(i)) else c.strip() for i, c in enumerate(columns)]
    repeated = []
    for i, base in enumerate(bases):
        if base in bases[:i] and base not in repeated:
            repeated.append(base)
    return repeated


def normalize_headers(raw: DataFrame) -> DataFrame:
    """Trim header blanks; the first of a repeated header gets the plain name.

    Headers repeat exactly (Spark then appends their position) or only once they are trimmed.
    """
    repeated = duplicate_headers(raw.columns)
    names, seen = [], set()
    for i, column in enumerate(raw.columns):
        name = column.strip()
        if name.endswith(str(i)) and name[: -len(str(i))].strip() in repeated:
            base = name[: -len(str(i))].strip()
            name = base
        if name in seen:
            name = f"{name}_{i}"
        seen.add(name)
        names.append(name)
    return raw.toDF(*names)


def valid_row(flow_id: Column, src_ip: Column, timestamp: Column) -> Column:
    """A row counts as a flow when its id, source and timestamp all hold text."""
    return has_text(flow_id) & has_text(src_ip) & has_text(timestamp)


def valid_rows(raw: DataFrame) -> DataFrame:
    return raw.where(valid_row(F.col("Flow ID"), F.col("Source IP"), F.col("Timestamp")))


def flow_projection(raw: DataFrame) -> DataFrame:
    """Project a capture with clean headers to the typed flow record.

    Extra columns named in ``raw`` but not in the record (such as a tie key) are dropped,
    so the CSV scan reads only the columns it needs.
    """
    missing = [header for _, header, _ in CSV_FIELDS if header not in raw.columns]
    if missing:
        raise KeyError(f"capture lacks columns {missing}")
    out = []
    for name, header, default in CSV_FIELDS:
        cell = F.col(f"`{header}`")
        kind = FLOW_SCHEMA[name].dataType.simpleString()
        if name == "timestamp":
            value = fix_12h_clock(parse_timestamp(cell))
        elif name == "label":
            value = sanitize_label(cell)
        elif kind == "string":
            value = strip(cell)
        elif kind == "double":
            value = to_number(cell)
        else:
            value = to_whole(cell, kind)
        out.append((F.coalesce(value, F.lit(default).cast(kind)) if default is not None else value).alias(name))
    return raw.select(*out, F.col("source_file"))


def read_flow_csv(spark: SparkSession, path: str) -> DataFrame:
    """Capture file(s) -> typed flows without padding rows."""
    return flow_projection(valid_rows(normalize_headers(read_raw_untyped(spark, path))))


def list_captures(spark: SparkSession, path: str) -> DataFrame:
    """``source_file, file_path, file_size`` of every ``*.csv``, those without a row included; contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", False).load(path)
    source = F.col("source_file") if "source_file" in found.columns else _file_name()
    return found.select(source.alias("source_file"), F.col("_metadata.file_path").alias("file_path"), F.col("length").alias("file_size"))


def header_table(spark: SparkSession, path: str) -> DataFrame:
    """One row per ``*.csv``: ``source_file, file_path, file_size, header, raw_columns_count, duplicate_columns``.

    Each file is one task that reads until its first line with text and stops there, so files are listed but not
    scanned.  A file without a byte is no capture, as Spark does not list it.  A name is a duplicate when an earlier one
    is equal after trimming.  The table is written: later steps read it, not the files.
    """

    def first_line(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, line in enumerate(batch.column("header").to_pylist()):
                if line.strip():
                    yield batch.slice(i, 1)
                    return

    # Settings of a session of its own, which shares everything but settings with the caller's.
    one_by_one = spark.newSession()
    for setting in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        one_by_one.conf.set(setting, WHOLE_FILE)
    lines = one_by_one.read.option("pathGlobFilter", "*.csv").text(path)
    found = lines.select(F.regexp_replace("value", "^\ufeff|\r$", "").alias("header"), F.col("_metadata.file_path").alias("file_path"))
    written = scratch_path(spark, "header_lines")
    found.mapInArrow(first_line, "header string, file_path string").write.parquet(written)
    headers = spark.read.schema("header string, file_path string").parquet(written)
    names = F.transform(F.split("header", ","), lambda c: strip(c))
    repeated = F.array_distinct(F.filter("names", lambda c, i: F.array_contains(F.slice("names", F.lit(1), i), c)))
    listed = list_captures(spark, path).join(headers, "file_path", "left").withColumn("names", names)
    return materialise(
        listed.select(
            *FILE_FIELDS, "header", F.coalesce(F.size("names"), F.lit(0)).alias("raw_columns_count"),
            F.coalesce(repeated, F.array().cast("array<string>")).alias("duplicate_columns"),
        ),
        "headers",
    )


def header_layouts(headers: DataFrame) -> list[tuple[str, list[str]]]:
    """The distinct header lines of ``header_table``, each with its files.

    A capture that is not empty and whose header lacks a key column fails.  Layouts are few, and their files are
    a part of the listing that Spark's reader holds as well.
    """
    complete = F.lit(True)
    for name in KEY_COLUMNS:
        complete = complete & F.coalesce(F.contains("header", F.lit(name)), F.lit(False))
    lost = [r.file_path for r in headers.where((F.col("file_size") > 0) & ~complete).select("file_path").limit(5).collect()]
    if lost:
        raise ValueError(f"captures without a header: {lost}")
    by_header = headers.where(complete).groupBy("header").agg(F.collect_list("file_path").alias("files"))
    return sorted((r["header"], sorted(r["files"])) for r in by_header.collect())


def _by_layout(spark: SparkSession, path: str, headers: DataFrame | None) -> list[DataFrame]:
    """The captures under clean headers, one table per header line."""
    layouts = header_layouts(headers or header_table(spark, path))
    if len(layouts) < 2:
        return [normalize_headers(read_raw_untyped(spark, path))]
    return [normalize_headers(read_raw_untyped(spark, [unquote(f) for f in files], base=path)) for _, files in layouts]


def read_raw_dir(spark: SparkSession, path: str, columns: Sequence[str], headers: DataFrame | None = None) -> DataFrame:
    """The named columns of all ``*.csv`` of a folder as text, found by name whatever the order of a capture's columns.

    A column that a capture lacks is null.  ``headers`` takes a ``header_table`` that is written already.
    """
    def pick(raw: DataFrame) -> DataFrame:
        cells = [(F.col(f"`{c}`") if c in raw.columns else F.lit(None).cast("string")).alias(c) for c in columns]
        return raw.select(*cells, *FILE_FIELDS)

    return reduce(DataFrame.unionByName, map(pick, _by_layout(spark, path, headers)))


def read_flow_dir(spark: SparkSession, path: str, headers: DataFrame | None = None) -> DataFrame:
    """All ``*.csv`` of a folder, each row tagged with its capture.

    Columns are found by name: captures that share a header are one scan, and scans of
    different headers are stacked.
    """
    return reduce(DataFrame.unionByName, [flow_projection(valid_rows(raw)) for raw in _by_layout(spark, path, headers)])


def read_flows(spark: SparkSession, path: str, reader=read_flow_csv) -> DataFrame:
    """Run any ``(spark, path) -> DataFrame`` reader and check it yields flow records."""
    flows = reader(spark, path)
    got = {f.name: f.dataType for f in flows.schema}
    wrong = [f.name for f in FLOW_SCHEMA if got.get(f.name) != f.dataType]
    if wrong:
        raise TypeError(f"reader does not yield flow records, fields {wrong}")
    return flows.select(*FLOW_SCHEMA.names)


def empty_flows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], FLOW_SCHEMA)
