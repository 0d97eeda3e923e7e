"""Registered queries make the sequences and the labelled windows once."""

import os
import re

import pytest

from readwindows.checks import queries
from helpers import plan_of

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def test_filters_do_not_repeat_the_sequence(spark):
    filters = [line for line in plan_of(queries._windows(spark, SF_DIR)).splitlines() if re.match(r"Condition\s*:", line)]
    assert filters and not any("regexp_replace" in line for line in filters)


@pytest.mark.parametrize("name", ["r2_balanced_sample", "x3_leakage"])
def test_windows_are_staged_before_they_are_read_again(spark, name):
    assert "ArrowEvalPython" not in plan_of(queries.QUERIES[name](spark, SF_DIR))


@pytest.mark.parametrize("name", ["r3_stratified_split", "s7_x1_prepare_from_csv"])
def test_prepare_reads_staged_windows(spark, monkeypatch, name):
    plans, prepare = [], queries.prepare
    monkeypatch.setattr(queries, "prepare", lambda labelled, *args, **kw: (plans.append(plan_of(labelled)), prepare(labelled, *args, **kw))[1])
    queries.QUERIES[name](spark, SF_DIR)
    assert len(plans) == 1 and "ArrowEvalPython" not in plans[0] and "Scan csv" not in plans[0] and "Scan parquet" in plans[0]


def test_split_of_all_reads_is_of_staged_windows(spark, monkeypatch):
    plans, split = [], queries.dataset.split
    monkeypatch.setattr(queries.dataset, "split", lambda df, **kw: (plans.append(plan_of(df)), split(df, **kw))[1])
    queries._language_windows(spark, SF_DIR)
    assert len(plans) == 1 and "ArrowEvalPython" not in plans[0]


@pytest.mark.parametrize("name", ["m3_tuning", "p7_feature_projection", "m4_training_history", "s9_split_samples"])
def test_training_splits_are_made_of_training_columns(spark, monkeypatch, name):
    seen, prepare = [], queries.prepare
    monkeypatch.setattr(queries, "prepare", lambda labelled, *args, **kw: (seen.append(labelled.columns), prepare(labelled, *args, **kw))[1])
    queries.QUERIES[name](spark, SF_DIR)
    assert seen == [["source_file", "read_ordinal", "window_index", "query_subseq", "labels"]]


@pytest.mark.parametrize("name", ["x3_leakage", "m1_m2_scored_validation"])
def test_splits_are_made_of_training_columns(spark, monkeypatch, name):
    seen, split = [], queries.dataset.split
    monkeypatch.setattr(queries.dataset, "split", lambda df, **kw: (seen.append(df.columns), split(df, **kw))[1])
    queries.QUERIES[name](spark, SF_DIR)
    assert seen == [["source_file", "read_ordinal", "window_index", "query_subseq", "labels"]]
