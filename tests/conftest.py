import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from flowtide import fixtures as fx  # noqa: E402
from flowtide.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 8, "6g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from flowtide.queries import Tables

    return Tables.of(spark, SF)


@pytest.fixture(scope="session")
def flows(spark):
    return fx.flows(spark, SF).cache()


def flow_row(**fields):
    """A flow record with quiet defaults."""
    from datetime import datetime

    base = dict(
        src_ip="a", dst_ip="b", src_port=1, dst_port=80, protocol=6, timestamp=datetime(2017, 7, 3, 9, 0),
        flow_duration=0.0, fwd_pkts=0.0, bwd_pkts=0.0, fwd_bytes=0.0, bwd_bytes=0.0, flow_bytes_s=None, flow_pkts_s=None,
        flow_iat_mean=0.0, flow_iat_std=0.0, pkt_len_mean=0.0, pkt_len_std=0.0, init_win_fwd=0.0, init_win_bwd=0.0,
        syn_count=0.0, rst_count=0.0, ack_count=0.0, fin_count=0.0, psh_count=0.0, label="BENIGN", source_file="f.csv",
    )
    return {**base, **fields}


def make_flows(spark, rows):
    from flowtide.schema import FLOW_SCHEMA

    return spark.createDataFrame([tuple(flow_row(**r)[n] for n in FLOW_SCHEMA.names) for r in rows], FLOW_SCHEMA)
