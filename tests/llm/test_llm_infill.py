"""Fill-in-middle against plain cutting, and the skip list against plain sums."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from modwarden.llm import infill

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string"


def brute(i, text):
    text = text or ""
    units = TOKEN.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(s in text for s in infill.SENTINELS) or h3 % 100 >= 50:
        return i, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < 80 else "psm"
    return i, n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def some_rows():
    rnd = random.Random(1)
    pieces = ["a", "é", "漢", "😀", " ", "\n", " ", "<", "P>", " <", "\x0b", "\x1c"]
    odd = [(None, None), (1, ""), (2, "  "), (3, "a<P>b"), (4, "x " * 40_000), (4, "x " * 40_000), (5, "\n\n")]
    return odd + [(i, "".join(rnd.choice(pieces) for _ in range(rnd.randrange(200)))) for i in range(10, 1500)]


def test_equal_to_plain_cutting(spark):
    rows = some_rows()
    found = infill.transform(spark.createDataFrame(rows, SCHEMA))
    got = found.select("doc_id", "infill.*", "text", infill.restored(F.col("infill.output"), F.col("infill.form")).alias("again")).collect()
    cut = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got]
    assert sorted(map(str, cut)) == sorted(str(brute(*r)) for r in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert all(r.again == (r.text or "") for r in got)


def test_empty_table_and_other_columns(spark):
    df = spark.createDataFrame([(1, "a b c", "x", 2)], "doc_id long, text string, output string, n int")
    assert infill.transform(df).columns == ["doc_id", "text", "output", "n", "infill"]
    assert infill.transform(df.limit(0)).count() == 0


def test_other_sentinels(spark):
    df = spark.createDataFrame([(i, "one two. (three|four) five") for i in range(40)], SCHEMA)
    marks = ("(p)", "|s|", ".m.")
    rows = infill.transform(df, plain_from=100, sentinels=marks).select("text", "infill.*", infill.restored(F.col("infill.output"), F.col("infill.form"), marks).alias("again")).collect()
    assert {r.form for r in rows} == {"psm", "spm"} and all(r.again == r.text and all(m in r.output for m in marks) for r in rows)


@pytest.mark.parametrize("seed", range(3))
def test_lanes_reach_every_rank(seed):
    rng = np.random.default_rng(seed)
    sizes = np.append(rng.integers(0, 400, 30), [0, 1, 5000])
    first = np.append(0, np.cumsum(sizes))
    points = rng.integers(1, 9, first[-1])
    lanes = infill.Lanes(points, first)
    assert len(lanes.lanes) > 2
    for share in (0, 0.3, 0.77, 1):
        rank = (sizes * share).astype(np.int64)
        want = [points[a : a + r].sum() for a, r in zip(first[:-1], rank, strict=True)]
        assert lanes.points_before(rank).tolist() == want
    with pytest.raises(ValueError):
        lanes.points_before(sizes + 1)


def test_upper_lanes_add_up():
    points = np.arange(1, 2001)
    lanes = infill.Lanes(points, np.array([0, 1200, 1200, 2000])).lanes
    for (units, wide, _, first), (_, _, down, above) in zip(lanes[:-1], lanes[1:], strict=True):
        assert units.sum() == 2000 and wide.sum() == points.sum()
        assert down[above].tolist() == first.tolist()
