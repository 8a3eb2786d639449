"""Registered queries against their SQL at the smallest scale."""

import pytest
from parity import compare

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = (
    "m2_classify a1_centroid a9_outcome_tally a12_roc_sweep a16_few_shot w4_gap_reset_smoothing w5_streaks w6_noise_floor "
    "w8_merge_intervals w13_loudest_share w15_drop_recent j3_named_detections j9_vocabulary_match p11_resolve_names s9_label_list "
    "s11_detection_log u4_top_up t1_sliding_windows t4_smooth_stream t7_route t9_update_bank_stream x5_activity"
).split()


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    assert compare(spark, SF, name, entry.queries(), entry.oracle_sql()) == ""


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
