"""Registered queries against their SQL twins. A cross-section by default; ORACLE=all runs every one."""

import os

import pytest

import __spark_entry__ as entry
from compare_oracle import canonical, compare, connect

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")
SAMPLE = ("reduce_trades", "attach_trades", "assign_segments", "asof_ffill", "ewma_zscore", "compute_features", "mask_assemble", "forward_returns_eval_h4",
          "acf", "longest_run", "data_quality_report", "bootstrap_from_index", "select_subset", "score_cell", "break_even_cost", "paired_delta_ir", "pbo_cscv",
          "pairwise_corr", "sample_windows", "block_time_permute", "codebook_usage", "channel_info", "truncation_sweep", "token_causality_probe",
          "dataset_hash", "reduce_shards", "stream_bars", "stream_live_features")
ORACLE = entry.oracle_sql()
NAMES = list(ORACLE) if os.environ.get("ORACLE") == "all" else SAMPLE

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cur = duck.execute(ORACLE[name])
    want = canonical([d[0] for d in cur.description], cur.fetchall())
    assert compare(canonical(df.columns, [tuple(r) for r in df.collect()]), want) == ""


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
