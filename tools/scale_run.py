"""Skewed multi-million-flow run: python tools/scale_run.py <out dir> [copies]

Copies of the sf0.1 events become flows of which a third share one capture and one
window, and a third of those one source.  Prints seconds per stage.
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import functions as F  # noqa: E402

from flowtide import fixtures as fx  # noqa: E402
from flowtide.operators import cleaning, encode, graphs, profile, sampling, scaling, windows  # noqa: E402
from flowtide.plans.materialise import materialise  # noqa: E402
from flowtide.schema import EDGE_FEATURES, FLOW_SCHEMA, NODE_FEATURES, NUMERIC_FIELDS, WINDOW_KEY  # noqa: E402
from flowtide.session import local_session  # noqa: E402
from flowtide.sources import captures  # noqa: E402


def main() -> None:
    out, copies = sys.argv[1], int(sys.argv[2]) if len(sys.argv) > 2 else 30
    spark = local_session("scale", memory="16g")
    sf = "/root/testdata/sf0.1"

    def step(name, run):
        started = time.perf_counter()
        result = run()
        print(f"{name:28s} {time.perf_counter() - started:7.2f}s", flush=True)
        return result

    def noop(df):
        df.write.format("noop").mode("overwrite").save()

    def more(df):
        return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))

    if not Path(f"{out}/flows").exists():
        hot = F.pmod(F.xxhash64("flow_id", "copy"), F.lit(3)) == 0
        spread = lambda c: F.concat(c, F.lit("."), F.pmod(F.xxhash64("flow_id", "copy", c), F.lit(200)).cast("string"))
        start = F.to_timestamp(F.lit("2024-01-01 00:10:00"))
        flows = more(fx.flows(spark, sf)).select(
            *[c for c in FLOW_SCHEMA.names if c not in ("source_file", "timestamp", "src_ip", "dst_ip")],
            F.when(hot, "capture_0").otherwise(F.col("source_file")).alias("source_file"),
            F.when(hot, start).otherwise(F.col("timestamp")).alias("timestamp"),
            F.when(hot & (F.col("flow_id") % 3 == 0), "10.9.9.9").otherwise(spread(F.col("src_ip"))).alias("src_ip"),
            spread(F.col("dst_ip")).alias("dst_ip"),
            (F.col("flow_id") * 1000 + F.col("copy")).alias("flow_id"),
        )
        flows.repartition(16).write.parquet(f"{out}/flows")
        raw = more(fx.raw_flows(spark, sf)).drop("event_id", "copy")
        raw.repartition(16).write.partitionBy("source_file").option("header", True).option("emptyValue", "").csv(f"{out}/captures")
    flows = spark.read.parquet(f"{out}/flows")
    print("flows", flows.count())

    raw = captures.normalize_headers(captures.read_raw_untyped(spark, f"{out}/captures"))
    step("profile, all audits", lambda: noop(profile.profile_report(raw)))
    step("csv -> typed flows", lambda: noop(captures.flow_projection(captures.valid_rows(raw))))
    step("train slice + medians", lambda: noop(cleaning.fit_medians(cleaning.train_flow_slice(flows, ["flow_id"]))))
    step("medians by percentile", lambda: noop(flows.agg(*[F.median(c) for c in NUMERIC_FIELDS])))
    pairs = step("pair totals", lambda: materialise(graphs.pair_totals(windows.window_index(flows, fx.WINDOW_SECONDS)), "pairs"))
    print("pairs", pairs.count(), "largest window", pairs.groupBy(*WINDOW_KEY).count().agg(F.max("count")).first()[0])
    step("windows", lambda: noop(windows.build_windows(pairs, fx.WINDOW_SECONDS)))
    nodes = step("nodes", lambda: materialise(graphs.node_features(pairs), "nodes"))
    edges = graphs.edge_features(pairs)
    step("robust scaler, edges", lambda: noop(scaling.fit_robust_scaler(edges, EDGE_FEATURES, "edge")))
    plain = step("sample, one task a window", lambda: materialise(sampling.priority_edge_sample(edges, 5_000), "s1"))
    wide = step("sample, hot windows spread", lambda: materialise(sampling.priority_edge_sample(edges, 5_000, hot_rows=100_000), "s2"))
    print("same sample", plain.count() == wide.count() and plain.select(*graphs.EDGE_KEY).exceptAll(wide.select(*graphs.EDGE_KEY)).isEmpty())
    step("encode all edges", lambda: noop(encode.encode_windows(nodes, edges)))
    step("encode, hot sources salted", lambda: noop(encode.encode_windows(nodes, edges, hot=encode.hot_sources(edges, 5_000))))
    print("features", len(NODE_FEATURES))


if __name__ == "__main__":
    main()
