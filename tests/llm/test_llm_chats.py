"""Snapshot collapse and rendering against brute force; no Python in the plan."""

import random

from modwarden.llm import chats


def brute(rows, block):
    by = {}
    key = lambda v: (v is not None, v if v is not None else 0)
    for cid, turn, role, text in rows:
        if cid is not None:
            by.setdefault(cid, []).append((turn, role, text))
    convs = {}
    for cid, ts in by.items():
        ts.sort(key=lambda t: (key(t[0]), (t[1] is not None, t[1] or ""), (t[2] is not None, t[2] or "")))
        convs[cid] = tuple((r, t) for _, r, t in ts)
    kept = {}
    for cid in sorted(convs):
        c = convs[cid]
        if not any(len(o) > len(c) and o[: len(c)] == c for o in convs.values()):
            kept.setdefault(c, []).append(cid)
    out = []
    for c, ids in kept.items():
        for s in range(0, len(c), block):
            text = "".join(f"<|{r if r is not None else 'unknown'}|>\n{t or ''}\n<|end|>\n" for r, t in c[s : s + block])
            out.append((ids[0], s // block, len(c), len(ids), text))
    return sorted(out)


def sample(seed):
    r = random.Random(seed)
    rows, cid = [], 0
    for _ in range(25):
        turns = [(r.choice(["user", "assistant", None]), r.choice(["hi", "yes", None, "", "no"])) for _ in range(r.randint(1, 9))]
        for k in {len(turns), r.randint(1, len(turns)), r.randint(1, len(turns))}:
            rows += [(cid, i, *t) for i, t in enumerate(turns[:k])]
            cid += 1
    rows += [(900, i, "user", f"m{i}") for i in range(40)] + [(901, i, "user", f"m{i}") for i in range(30)]
    rows += [(902, None, "user", "first"), (902, 3, "user", "x"), (902, 3, "user", "x"), (902, 3, "assistant", "x"), (None, 1, "user", "lost")]
    rows += [(903, 10**12, "user", "far"), (904, -5, None, None), (905, 0, "", "")]
    r.shuffle(rows)
    return rows


def test_equal_to_brute_force(spark):
    for seed in (1, 2):
        rows = sample(seed)
        df = spark.createDataFrame([(*x, 1) for x in rows], "conv_id long, turn long, role string, text string, pos int")
        got = chats.format_chats(df, block=4).collect()
        assert sorted((r.conv_id, r.segment, r.n_turns, r.copies, r.rendered) for r in got) == brute(rows, 4)


def test_empty(spark):
    assert chats.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_native_plan(spark):
    df = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    plan = chats.format_chats(df)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))
