"""Every query with an oracle against DuckDB, on the smallest tables; and the library's layering."""

import math
import re
from pathlib import Path

import pytest

import __spark_entry__ as entry
from pagestrata.plans.catalog import QUERIES
from pagestrata.plans.oracles import ORACLES

DATA = Path("/root/testdata/sf0.001")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
ROOT = Path(__file__).resolve().parent.parent


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


@pytest.fixture(scope="module")
def duck():
    import duckdb

    if not DATA.exists():
        pytest.skip("no test data here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_oracle(spark, duck, name):
    df = entry.queries()[name](spark, str(DATA))
    ran = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in ran.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    want = sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in ran.fetchall()), key=repr)
    assert got == want


def test_entry(spark):
    if not DATA.exists():
        pytest.skip("no test data here")
    assert entry.entry(spark).count() > 0


def test_every_query_of_the_catalogue_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_nothing_imports_the_training_data_operators():
    files = [p for p in (ROOT / "pagestrata").rglob("*.py") if "llm" not in p.relative_to(ROOT).parts]
    assert len(files) > 15
    assert not [p for p in files if re.search(r"pagestrata\.llm|from \.llm|import llm", p.read_text())]
