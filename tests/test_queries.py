"""The catalogue's queries against their SQL, and the plans of those that should stay narrow."""

import io
from contextlib import redirect_stdout

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from paraweft.plans import catalogue

TABLES = ["documents", "embeddings", "conversations", "events"]
FEW = ["sentence_split", "detect_text_type", "boundary_vote", "length_repair", "markdown_parse", "markdown_chunks", "lexical_similarity", "event_sessions", "zh_split", "zh_segment", "consistency_score", "method_ranking"]


def table_of(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    frame = frame.map(lambda v: "none" if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v) else repr(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v))
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", FEW)
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = catalogue.QUERIES[name](spark, sf).toPandas()
    pd.testing.assert_frame_equal(table_of(got), table_of(con.execute(catalogue.ORACLE_SQL[name]).df()))


def test_names_match():
    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES) <= set(__spark_entry__.queries())


def plan_of(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", ["segment_enhanced", "sentence_split", "detect_text_type", "structure_boundaries"])
def test_one_pass_over_the_documents(spark, sf, name):
    plan = plan_of(catalogue.QUERIES[name](spark, sf))
    assert "Exchange" not in plan and "Python" not in plan and plan.count("Scan parquet") <= 2
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns[0] == "doc_id"
