"""Every registered query against its check SQL on the smallest tables."""

import math
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")

from modwarden.plans import ORACLES, QUERIES  # noqa: E402

DATA = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    if not Path(DATA).exists():
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = table(df.columns, df.collect())
    if name in ORACLES:
        cur = duck.execute(ORACLES[name])
        columns = [c[0] for c in cur.description]
        assert got == table(columns, cur.fetchall())
    else:
        assert got[1]


def test_texts_without_a_window(spark, tmp_path):
    """Null, empty and blank texts, a copy of one window in all six, and separators that end no sentence."""
    long = "Words of a text that goes on. " * 40
    texts = [None, "", " ", "\n\t \r\n", "a", " one. ", long, "  " + long * 9, "ab " * 999, "x" * 200 + ".\x85" + "y" * 400, "x" * 200 + "!\x1c" + "y" * 400]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("max_window_score", "max_window_score_whole", "window_text", "window_text_full_coverage"):
        df, cur = QUERIES[name](spark, str(tmp_path)), con.execute(ORACLES[name])
        assert table(df.columns, df.collect()) == table([c[0] for c in cur.description], cur.fetchall()), name
    # The windows of a text are cut once.
    plan = QUERIES["max_window_score"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
