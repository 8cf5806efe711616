"""Every query against its SQL on the small tables, and the plans that matter."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tokenledger.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as from '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((plain(tuple(r)) for r in df.select(*columns).collect()), key=repr)
    if name not in catalog.ORACLES:
        assert got
        return
    names = ", ".join(f'"{c}"' for c in columns)
    assert got == sorted((plain(r) for r in duck.sql(f"select {names} from ({catalog.ORACLES[name]})").fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    text = plan(catalog.QUERIES["q_isin_filter"](spark, FOLDER))
    assert "PushedFilters" in text and "l_comment" not in text
    assert "LeftAnti" in plan(catalog.QUERIES["q_exact_decontam"](spark, FOLDER))
    assert "Python" not in plan(catalog.QUERIES["q_model_dataset_summary"](spark, FOLDER))
    assert "Python" not in plan(catalog.QUERIES["q_label_matrix"](spark, FOLDER))


def test_whole_texts(spark, duck):
    from tokenledger.operators import providers

    texts = dict(duck.sql("select doc_id, text from documents").fetchall())
    got = {r["id"]: r["value"] for r in catalog.QUERIES["q_provider_stub"](spark, FOLDER).collect()}
    assert max(map(len, texts.values())) > 200
    assert got == {i: providers.stub_generate([t])[0].rsplit("{", 1)[1].rstrip("}") for i, t in texts.items()}
    rows = catalog.QUERIES["q_think_text"](spark, FOLDER).collect()
    assert len(rows) == duck.sql("select count(*) from conversations where text is not null").fetchall()[0][0]
    assert max(len(r["think"]) for r in rows) > 40


def test_whole_trajectories(spark, duck):
    rows = catalog.QUERIES["q_traj_whole"](spark, FOLDER).collect()
    assert sum(len(r["values"]) for r in rows) == duck.sql("select count(*) from events").fetchall()[0][0]
    assert max(len(r["values"]) for r in rows) > 8


def test_whole_budget_grid(spark, duck):
    from tokenledger.functions import vectors

    n = catalog.QUERIES["q_budget_cross_prompt"](spark, FOLDER).count()
    documents = duck.sql("select count(*) from documents").fetchall()[0][0]
    assert n == documents * len(vectors.BUDGETS) and documents > 100
