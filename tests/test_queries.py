"""Every query of the engine against its SQL, or, where it has none, for its columns and rows."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__
from marginalia import queries as engine

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def _row(values):
    return tuple(None if isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v for v in values)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _no_products_and_no_python(df, name):
    plan = _plan(df)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and ("Python" in plan) == name.startswith("python_")


@pytest.mark.parametrize("name", sorted(engine.oracle_sql()))
def test_query_equals_sql(name, spark, duck):
    ref = duck.execute(engine.oracle_sql()[name])
    columns = [x[0] for x in ref.description]
    want = Counter(_row(r) for r in ref.fetchall())
    df = engine.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    out = df.select(*(f"`{c}`" for c in columns))
    _no_products_and_no_python(out, name)
    assert Counter(_row(r) for r in out.collect()) == want and want


@pytest.mark.parametrize("name", sorted(set(engine.queries()) - set(engine.oracle_sql())))
def test_query_has_rows(name, spark):
    df = engine.queries()[name](spark, SF)
    _no_products_and_no_python(df, name)
    assert len(df.collect()) == 200


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 200
    assert set(engine.queries()) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.fixture(scope="module")
def split(spark, tmp_path_factory):
    """documents in as many files as there are cores, which no query deals out anew."""
    folder = str(tmp_path_factory.mktemp("split"))
    spark.read.parquet(f"{SF}/documents.parquet").repartition(8).write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.mark.parametrize("name", ["score_density", "report_flat", "signals_all", "json_reports", "markdown_reports", "seg_sentence"])
def test_documents_are_read_in_their_own_rows(name, spark, split):
    plan = _plan(engine.queries()[name](spark, split))
    assert "Exchange" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_detectors_run_once(spark, split):
    """A word of the catalogue stands as often in the plan of signals as in that of scores."""
    once = _plan(engine.queries()["score_density"](spark, split)).count("delving")
    for name in ("signals_all", "report_flat", "ranked_flags", "band_rates", "rule_table", "detector_accounting", "score_card_ladder", "evidence_cube", "reference_sweep", "inject_contains"):
        assert 0 < _plan(engine.queries()[name](spark, split)).count("delving") <= once


def test_only_rows_of_texts_that_sql_cannot_say(spark):
    assert set(engine.queries()) - set(engine.oracle_sql()) == {"markdown_reports", "html_reports", "json_reports", "reader_reports"}
