"""The registered queries over whole driver tables, with their SQL twins, or brute force where SQL has none."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as driver
from climspark.llm.oracle import ORACLE
from climspark.llm.queries import QUERIES
from tests.llm import cases
from tests.llm.test_packing import brute_pieces, check_sequences
from tests.llm.test_simhash import expected

DATA = Path("/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="driver tables are absent")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "conversations"):
        con.sql(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql_twin(spark, duck, name):
    got = QUERIES[name](spark, str(DATA))
    twin = duck.sql(ORACLE[name])
    assert sorted(got.columns) == sorted(twin.columns)
    assert cases.ordered(got.select(*twin.columns).collect()) == cases.ordered(twin.fetchall())


def test_simhash_over_the_whole_table(spark, duck):
    rows = duck.sql("select doc_id, text from documents").fetchall()
    got = QUERIES["op6_simhash"](spark, str(DATA)).collect()
    assert cases.ordered(got) == cases.ordered(expected(rows))


def test_packing_over_the_whole_table(spark, duck):
    from tokenizers import Tokenizer

    from climspark.llm import packing

    rows = duck.sql("select doc_id, text from documents").fetchall()
    got = QUERIES["op5_packing"](spark, str(DATA)).collect()
    assert cases.ordered(r[:5] for r in got) == brute_pieces(Tokenizer.from_file(packing.tokenizer_path()), rows)
    assert check_sequences(got) <= -(-sum(r.length for r in got) // 2048) + 1


def test_language_held_out_accuracy(spark, duck):
    langs = dict(duck.sql("select doc_id, lang from documents where lang is not null").fetchall())
    got = [r for r in QUERIES["op8_language"](spark, str(DATA)).collect() if r.held_out and r.doc_id in langs]
    assert sum(langs[r.doc_id] == r.lang_pred for r in got) >= 0.97 * len(got)


def test_all_are_registered():
    names = driver.queries()
    assert set(QUERIES) | {"pipeline"} <= set(names) and set(ORACLE) <= set(driver.oracle_sql())
    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1


def test_curve_packing_over_the_whole_table(spark, duck):
    from tokenizers import Tokenizer

    from climspark.llm.packing import tokenizer_path
    from tests.llm.test_curve import check

    rows = duck.sql("select doc_id, text from documents").fetchall()
    got = QUERIES["op12_curve_packing"](spark, str(DATA)).collect()
    sequences = check(Tokenizer.from_file(tokenizer_path()), rows, got)
    assert sum(sum(n for _, n in parts) < 4096 for parts in sequences.values()) <= 12
