"""The bounded wait of a text for its media, as keyed state with timers.

A text at T publishes at T + wait without its media, or with it as soon as it comes; media after that still upgrades, and
media before any text belongs to none. The units of a bucket keep their events in a state list whose entries end after a
time to live, and one timer at the first end of a wait that is open, so a wait is over by itself when no event follows. A
step writes only the outcomes that its events change: each event once, and once more for each later step that brings
something before it.
Whatever the cut of the events into micro-batches and their order, the newest row of each event is the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from modwarden.profiles import MediaPolicy

OUT = "unit_key string, event_ms long, is_text boolean, nth int, at_ms long, outcome string, revision long, seen_ms long"
WITHOUT, WITH, LATE, WAITING = "published-without-media", "published-with-media", "late-upgrade", "waiting"
_NAMES = np.array([None, WITHOUT, WITH, LATE, WAITING], object)
KEEP_MS = 60 * 24 * 3600 * 1000
BUCKETS = 1024
_ENTRY = 10_000


@contextmanager
def keyed_state(spark: SparkSession, live: bool = False) -> Iterator[None]:
    """Session settings that a stream with timers starts under; a stream keeps them when the block ends.

    ``live`` streams run batches without data, which timers need. A stream that drains what is there runs none.
    """
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.noDataMicroBatches.enabled": str(live).lower(),
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def wait_outcomes(unit: np.ndarray, ts: np.ndarray, is_text: np.ndarray, wait_ms: int, over_ms: np.ndarray) -> np.ndarray:
    """A code into the names of outcomes for each event; those of a unit lie together, in time order, texts first at one time.

    ``over_ms`` is, by unit number, a time up to which waits are known to be over, whatever events have come.
    """
    out, n = np.zeros(len(ts), np.int64), len(ts)
    text = np.flatnonzero(is_text)
    if not len(text):
        return out
    of = np.cumsum(is_text) - 1
    due = ts[text] + wait_ms
    media = np.flatnonzero(~is_text & (of >= 0))
    media = media[unit[text[of[media]]] == unit[media]]
    own = of[media]
    first = np.append(True, own[1:] != own[:-1]) if len(media) else np.zeros(0, bool)
    out[media] = np.where(first & (ts[media] <= due[own]), 2, 3)
    following = np.minimum(text + 1, n - 1)
    is_last = (text == n - 1) | (unit[following] != unit[text])
    follows = ~is_last & ~is_text[following]
    after = np.where(is_last, np.maximum(over_ms[unit[text]], ts[text]), ts[following])
    # A text that the next one follows in time has no outcome of its own.
    out[text] = np.where(is_last & (after <= due), 4, np.where(after > due, 1, 0))
    # Media in time speaks for its text.
    out[text[follows & (after <= due)]] = 0
    return out


class BoundedWait(StatefulProcessor):
    """State of the units of one key: their events, the time up to which waits are over, one timer for the open waits.

    A frame without ``unit_key`` holds the events of one unit, which is the key.
    """

    def __init__(self, wait_ms: int, keep_ms: int):
        self.wait_ms, self.keep_ms = wait_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Entries are only added, so each ends by its own time to live. Numbers travel as bytes, not one by one.
        self.events = handle.getListState("events", "names array<string>, unit binary, ts binary, is_text binary", ttlDurationMs=self.keep_ms)
        self.over = handle.getListState("over", "names array<string>, over_ms binary", ttlDurationMs=self.keep_ms)
        self.timer = handle.getValueState("timer", "fires_at bigint, names array<string>, text_ms binary, ends_at binary")

    def _held(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        name, ts, is_text = [np.zeros(0, object)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        for e in self.events.get():
            name.append(np.array(e[0], object)[np.frombuffer(e[1], np.int32)])
            ts.append(np.frombuffer(e[2], np.int64))
            is_text.append(np.frombuffer(e[3], bool))
        return np.concatenate(name), np.concatenate(ts), np.concatenate(is_text)

    def _over(self) -> dict[str | None, int]:
        over: dict[str | None, int] = {}
        for names, raw in self.over.get():
            for name, ms in zip(names, np.frombuffer(raw, np.int64).tolist(), strict=True):
                over[name] = max(ms, over.get(name, -1))
        return over

    def _open(self) -> tuple[int | None, dict[str | None, tuple[int, int]]]:
        """When the timer fires, and the text and the end of each open wait."""
        if not self.timer.exists():
            return None, {}
        fires_at, names, *raw = self.timer.get()
        return fires_at, dict(zip(names, zip(*(np.frombuffer(x, np.int64).tolist() for x in raw), strict=True), strict=True))

    def _step(self, now: int, held: tuple, come: tuple, touched: set, over: dict, over_now: dict, waits: tuple) -> pd.DataFrame:
        """Rows of the events of touched units whose outcome is another than before, and a timer for the waits that are open then."""
        name, ts, is_text = (np.concatenate(x) for x in zip(held, come, strict=True))
        seen_ms = int(ts.max(initial=0))
        new = np.arange(len(ts)) >= len(held[1])
        unit, names = pd.factorize(name, use_na_sentinel=False)
        names = [None if pd.isna(x) else x for x in names]
        mine = np.array([x in touched for x in names], bool)[unit] if len(unit) else np.zeros(0, bool)
        unit, ts, is_text, new = unit[mine], ts[mine], is_text[mine], new[mine]
        # Among equal events those that were here come first, so they keep their numbers.
        order = np.lexsort((new, ~is_text, ts, unit))
        unit, ts, is_text, new = unit[order], ts[order], is_text[order], new[order]
        was, now_over = (np.array([x.get(u, -1) for u in names], np.int64) for x in (over, over_now))
        before = np.zeros(len(ts), np.int64)
        before[~new] = wait_outcomes(unit[~new], ts[~new], is_text[~new], self.wait_ms, was)
        code = wait_outcomes(unit, ts, is_text, self.wait_ms, now_over)
        start = np.append(True, (unit[1:] != unit[:-1]) | (ts[1:] != ts[:-1]) | (is_text[1:] != is_text[:-1]))
        nth = np.arange(len(ts)) - np.flatnonzero(start)[np.cumsum(start) - 1] if len(ts) else np.zeros(0, np.int64)
        rows = np.flatnonzero(code != before)
        waiting = np.flatnonzero(code == 4)
        self._set_timer(now, {names[u]: t for u, t in zip(unit[waiting].tolist(), ts[waiting].tolist(), strict=True)}, touched, over_now, *waits)
        at = np.where(is_text, ts + self.wait_ms, ts)
        # Columns of objects: frames of one key after another join to one Arrow batch only so.
        return pd.DataFrame({
            "unit_key": np.array(names, object)[unit[rows]], "event_ms": ts[rows], "is_text": is_text[rows], "nth": nth[rows].astype(np.int32), "at_ms": at[rows],
            "outcome": _NAMES[code[rows]], "revision": np.full(len(rows), now), "seen_ms": np.full(len(rows), seen_ms),
        }).astype({"unit_key": object, "outcome": object})

    def _set_timer(self, now: int, texts: dict, touched: set, over: dict, fires_at: int | None, waits: dict) -> None:
        """``texts`` has the text of each touched unit that waits; a wait for the same text keeps its end."""
        then = {u: w for u, w in waits.items() if u not in touched}
        for u, text_ms in texts.items():
            kept = waits.get(u)
            then[u] = kept if kept and kept[0] == text_ms else (text_ms, now + max(1, text_ms + self.wait_ms - max(over.get(u, -1), text_ms)) + 1)
        first = min((end for _, end in then.values()), default=None)
        if fires_at is not None and first != fires_at:
            self.handle.deleteTimer(fires_at)
        if first is not None and first != fires_at:
            self.handle.registerTimer(first)
        if then and (then != waits or first != fires_at):
            text_ms, ends_at = (np.array(x, np.int64).tobytes() for x in zip(*then.values(), strict=True))
            self.timer.update((first, list(then), text_ms, ends_at))
        elif not then and fires_at is not None:
            self.timer.clear()

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held, come = self._held(), []
        for part in rows:
            name = part["unit_key"].to_numpy(object) if "unit_key" in part else np.full(len(part), key[0], object)
            come.append((name, part["ts_ms"].to_numpy(np.int64), (part["kind"] == "text").to_numpy(bool)))
        name, ts, is_text = (np.concatenate(x) for x in zip(*come, strict=True))
        unit, names = pd.factorize(name, use_na_sentinel=False)
        names = [None if pd.isna(x) else x for x in names]
        for a in range(0, len(ts), _ENTRY):
            some, of = np.unique(unit[a : a + _ENTRY], return_inverse=True)
            self.events.appendValue(([names[u] for u in some.tolist()], of.astype(np.int32).tobytes(), ts[a : a + _ENTRY].tobytes(), is_text[a : a + _ENTRY].tobytes()))
        over = self._over()
        yield self._step(timerValues.getCurrentProcessingTimeInMs(), held, (name, ts, is_text), set(names), over, over, self._open())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        fires_at, waits = self._open()
        if fires_at is None or fires_at != expiredTimerInfo.getExpiryTimeInMs():
            return
        done = {u: text_ms + self.wait_ms + 1 for u, (text_ms, end) in waits.items() if end <= fires_at}
        over = self._over()
        self.over.appendValue((list(done), np.array(list(done.values()), np.int64).tobytes()))
        none = np.zeros(0, object), np.zeros(0, np.int64), np.zeros(0, bool)
        over_now = {**over, **{u: max(ms, over.get(u, -1)) for u, ms in done.items()}}
        yield self._step(timerValues.getCurrentProcessingTimeInMs(), self._held(), none, set(done), over, over_now, (fires_at, waits))

    def close(self) -> None:
        pass


def stream_late_media(events: DataFrame, policy: MediaPolicy = MediaPolicy(), keep_ms: int = KEEP_MS, buckets: int | None = BUCKETS) -> DataFrame:
    """``events`` has unit_key, kind (text | media) and ts_ms; start it inside :func:`keyed_state`, read it by :func:`settled_media`.

    The wait runs in event time as far as events tell it, and else in processing time. An event is forgotten ``keep_ms``
    after it came; media that comes later still belongs to no text. No watermark drops events.

    The units of one of ``buckets`` hash buckets take a step together, so a micro-batch costs at most that many calls to
    the state; a step reads the events of its bucket. With None each unit is its own bucket, for small batches over a
    large state. The number stays with a stream's checkpoint.
    """
    rows = events.select(F.col("unit_key").cast("string").alias("unit_key"), "kind", "ts_ms")
    by = "unit_key"
    if buckets:
        rows, by = rows.withColumn("bucket", F.pmod(F.xxhash64("unit_key"), F.lit(buckets))), "bucket"
    return rows.groupBy(by).transformWithStateInPandas(BoundedWait(policy.ocr_wait_ms, keep_ms), OUT, "append", "processingTime")


def settled_media(updates: DataFrame) -> DataFrame:
    """``(unit_key, at_ms, outcome)`` so far: the newest row of each event, waits over once the stream is past them."""
    now = updates.agg(F.max("seen_ms").alias("now_ms"))
    newest = updates.groupBy("unit_key", "event_ms", "is_text", "nth").agg(F.max_by(F.struct("at_ms", "outcome"), "revision").alias("r"))
    rows = newest.select("unit_key", "r.at_ms", "r.outcome").filter("outcome is not null")
    due = F.when(F.col("outcome") != WAITING, F.col("outcome")).when(F.col("at_ms") < now.scalar(), WITHOUT)
    return rows.withColumn("outcome", due).filter("outcome is not null")
