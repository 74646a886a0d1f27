"""Every query that has SQL gives the SQL's rows at the smallest scale."""

import re

import duckdb
import pytest

from tarkash.functions.transliterate import Transliterator
from tarkash.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows, columns):
    def one(x):
        return round(x, 9) if isinstance(x, float) else str(x)

    return sorted((tuple(one(r[c]) for c in columns) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_rows(spark, duck, name):
    got = catalogue.queries()[name](spark, SF)
    wanted = duck.sql(catalogue.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(wanted.columns)
    rows = [dict(zip(wanted.columns, r, strict=True)) for r in wanted.fetchall()]
    assert plain([r.asDict() for r in got.collect()], columns) == plain(rows, columns)


def test_only_script_rules_have_no_sql():
    assert set(catalogue.queries()) - set(catalogue.oracle_sql()) == {"q26_transliterate", "q44_full_menus"}


def test_transliterated_words(spark):
    plain_rules, words = Transliterator(), set()
    for r in catalogue.queries()["q26_transliterate"](spark, SF).collect():
        words.add(r.word)
        assert r.native == plain_rules(r.word) and r.forms == " ".join(plain_rules.forms(r.word))
    names = [r.p_name.lower() for r in spark.read.parquet(f"{SF}/part.parquet").collect()]
    assert words == {w for n in names for w in re.findall("[a-z]+", n)}
