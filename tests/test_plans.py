"""Helpers for large groups give the plain answer, on every path."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowtide.plans.blocks import keep_home, overlapping_blocks
from flowtide.plans.lookup import HotKeys, hot_keys, join_by_key, join_lookup
from flowtide.plans.materialise import materialise, materialise_with, shared_dir
from flowtide.plans.quantiles import exact_quantiles
from flowtide.plans.ranking import numbered


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows in one group, half of those equal under the order."""
    g = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("g"), (F.col("id") % 40).cast("string")))
    v = F.when((F.col("id") % 6) == 0, F.lit(7)).otherwise(F.pmod(F.xxhash64("id"), F.lit(1000)))
    return materialise(spark.range(6000).select("id", g.alias("g"), v.cast("bigint").alias("v")))


def sorted_rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("ties", [False, True])
def test_numbered_hot_equals_window(skewed, ties):
    order = [F.col("v")] if ties else [F.desc("v"), F.col("id")]
    plain = numbered(skewed, ["g"], order, "pos")
    hot = numbered(skewed, ["g"], order, "pos", hot_rows=300)
    if ties:  # equal rows may swap, positions and values may not
        assert sorted_rows(plain, "g", "v", "pos") == sorted_rows(hot, "g", "v", "pos")
        assert sorted_rows(hot, "id") == sorted_rows(skewed, "id")
    else:
        assert sorted_rows(plain, "g", "id", "pos") == sorted_rows(hot, "g", "id", "pos")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_join_lookup_salted_equals_broadcast(spark, skewed, how):
    groups = skewed.select("g").distinct().where(F.col("g") != "g7")
    table = materialise(groups if how.startswith("left_") else groups.withColumn("w", F.length("g")))
    small = join_lookup(skewed, table, ["g"], ["id"], how)
    large = join_lookup(skewed, table, ["g"], ["id"], how, max_bytes=0, salts=5)
    assert "BroadcastHashJoin" in small._jdf.queryExecution().toString()
    assert sorted_rows(small, *sorted(small.columns)) == sorted_rows(large, *sorted(large.columns))


def test_join_by_key_salts_hot_keys(skewed):
    right = skewed.groupBy("g").agg(F.max("v").alias("top"))
    counts = skewed.groupBy("g").count()
    hot = hot_keys(counts, ["g"], 500, "count")
    assert hot.count == 1
    plain = join_by_key(skewed, right, ["g"], ["id"], HotKeys(hot.table, 0))
    salted = join_by_key(skewed, right, ["g"], ["id"], hot, salts=4)
    assert sorted_rows(plain, "id", "top") == sorted_rows(salted, "id", "top")


@pytest.mark.parametrize("small_bucket", [1_000_000, 1])
def test_exact_quantiles_match_numpy(spark, small_bucket):
    rng = np.random.default_rng(3)
    columns = {
        "normal": rng.normal(size=2000),
        "tied": rng.integers(0, 3, 2000).astype(float),
        "tail": np.exp(rng.normal(size=2000) * 5) * rng.choice([-1.0, 1.0], 2000),
        "one": np.full(2000, 4.25),
    }
    rows = list(zip(*[c.tolist() for c in columns.values()], strict=True))
    df = spark.createDataFrame([(*r, None) for r in rows] + [(None, None, None, None, None)], "normal double, tied double, tail double, one double, none double")
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(r.feature, r.prob): r.value for r in exact_quantiles(df, df.columns, probs, small_bucket).collect()}
    assert len(got) == 20
    for name, values in columns.items():
        for p in probs:
            assert got[name, p] == pytest.approx(np.quantile(values, p), rel=1e-12)


def test_blocks_equal_one_window(spark):
    df = spark.range(100).select(F.lit("s").alias("g"), F.col("id").alias("i"), (F.col("id") * 3 % 17).alias("v"))
    rows, frame = overlapping_blocks(df, ["g"], "i", before=4, after=2, block_rows=7)
    out = keep_home(
        rows.withColumn("past", F.collect_list("v").over(frame.rowsBetween(-4, 0))).withColumn("ahead", F.lead("v", 2).over(frame))
    ).collect()
    values = [i * 3 % 17 for i in range(100)]
    assert len(out) == 100
    for r in out:
        assert r.past == values[max(0, r.i - 4) : r.i + 1]
        assert r.ahead == (values[r.i + 2] if r.i + 2 < 100 else None)
    with pytest.raises(ValueError):
        overlapping_blocks(df, ["g"], "i", before=7, block_rows=7)


def test_materialise_observes_and_uses_the_session_folder(spark):
    table, facts = materialise_with(spark.range(10), "t", top=F.max("id"))
    assert facts == {"top": 9} and table.count() == 10
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert shared_dir(spark) == configured
