"""The registered queries of this folder: names, SQL twins and results on the smallest tables."""

import os
import re
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

import __spark_entry__ as driver
import compare
from ledgerloom.llm import queries

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


def test_all_operators_and_the_pipeline_are_registered():
    names = {int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES}
    assert names == set(range(1, 14)) and len(queries.QUERIES) == 13
    assert "pipeline" in driver.queries() and queries.QUERIES.keys() <= driver.queries().keys()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    assert compare.difference(spark, compare.connect(FOLDER), FOLDER, name, queries.ORACLE_SQL[name]) is None


COLUMNS = {
    "op1_": "query_id bigint, rank int, vec_id bigint, score double",
    "op2_": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op4_": "doc_id bigint, fingerprint string, component_id bigint",
    "op5_": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
    "n_repeat_words bigint, base_failed boolean, kept boolean",
    "op6_": "doc_id bigint, held_out boolean, score double, predicted int",
    "op8_": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op10_": "doc_id bigint, held_out boolean, score double, predicted int",
    "op11_": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    "op12_": "doc_id bigint, n_features bigint, weight bigint, score bigint, rank bigint",
    "op13_": "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
    "audit string, repaired_sha256 string",
}


@pytest.mark.parametrize("start", sorted(COLUMNS))
def test_results_have_the_agreed_columns(spark, start):
    (query,) = [q for name, q in queries.QUERIES.items() if name.startswith(start)]
    found = query(spark, FOLDER)
    types = dict(found.dtypes)
    for column in COLUMNS[start].split(", "):
        name, kind = column.split(" ")
        assert types[name] == kind
    if start in ("op11_", "op13_"):
        assert found.count() == spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id").distinct().count() + (start == "op11_")
    elif start != "op1_":
        assert found.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
