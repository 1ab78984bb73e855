"""Registered queries with DuckDB SQL, on the smallest tables; and what all eleven return."""

import os
from glob import glob

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from palimpsest.llm.queries import ORACLES, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


def rows(df):
    plain = lambda x: None if x is pd.NA or x is None or x != x else int(x) if isinstance(x, float) else x
    return sorted((tuple(plain(x) for x in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", list(ORACLES))
def test_same_rows(spark, name):
    c = duckdb.connect()
    for f in glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f).removesuffix('.parquet')} AS SELECT * FROM '{f}'")
    got, want = QUERIES[name](spark, DATA).toPandas(), c.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


COLUMNS = {
    "op3_quality_gam": "doc_id bigint held_out boolean score double predicted int",
    "op5_language_filters": "doc_id bigint held_out boolean lang_pred string score double",
    "op7_byte_bpe": "doc_id bigint n_tokens bigint ids_sha256 string decoded_sha256 string",
    "op9_toxic_segments": "doc_id bigint held_out boolean score double predicted int n_passages int",
    "op10_gif_media": "doc_id bigint n_bytes bigint payload_bytes bigint payload_sha256 string tail_crc32 bigint media_bytes bigint media_sha256 string feature string",
}


@pytest.mark.parametrize("name", list(COLUMNS))
def test_columns_and_one_row_a_document(spark, name):
    got = QUERIES[name](spark, DATA)
    assert " ".join(f"{a} {b}" for a, b in got.dtypes) == COLUMNS[name]
    assert got.count() == spark.read.parquet(f"{DATA}/documents.parquet").count()


def test_ten_operators_and_the_pipeline():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5
