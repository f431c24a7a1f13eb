"""Queries of the newer modules against their SQL at the smallest scale, and that those with a history to look back on find something."""

import pytest

import __spark_entry__
from tests.helpers import differences

SMALL = "/root/testdata/sf0.001"
NAMES = """gate_verdict gate_rules_failed snk_quality_report regi_update_run regi_delete_run srv_panel_cache stream_ema stream_sessions fn_parse_purpose join_rename_chain src_local_dir
bt_run bt_folds st_sharpe_paths mdl_meta_nested mdl_interface mdl_platt perm_ticker cv_cpcv_counts T1_structural_schema""".split()


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    df = __spark_entry__.queries()[name](spark, SMALL)
    assert not differences(df, __spark_entry__.oracle_sql()[name], SMALL)[:3]
    assert not df.isEmpty() or name in ("perm_ticker", "st_sharpe_paths")
