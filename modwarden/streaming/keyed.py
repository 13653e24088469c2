"""Keyed state that takes the rows of a key in order, however many come at once.

The rows of one key in one micro-batch arrive in chunks. Up to a bound they are sorted in memory; beyond it they go to a
state list of the key, on disk, and come back range by range of the order, so a hot key costs passes, not memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from modwarden.profiles import MediaPolicy

IN_MEMORY, ENTRY, SAMPLED = 200_000, 20_000, 64
SPILL = "rows binary"


def _packed(part: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(part, preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(raw: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(raw).read_all().to_pandas()


def in_order(chunks: Iterator[pd.DataFrame], order: str, spill: Any, most: int = IN_MEMORY) -> Iterator[pd.DataFrame]:
    """The rows of all chunks by ``order``, in frames of about ``most`` rows; ``spill`` is a state list that is empty again then.

    Rows of one place in the order come in any sequence.
    """
    held: list[pd.DataFrame] = []
    n, samples = 0, []

    def put() -> None:
        whole = pd.concat(held).sort_values(order, kind="stable")
        for a in range(0, len(whole), ENTRY):
            part = whole[a : a + ENTRY]
            spill.appendValue((_packed(part),))
            samples.append(part[order].to_numpy()[:: max(1, len(part) // SAMPLED)])
        held.clear()

    for chunk in chunks:
        held.append(chunk)
        n += len(chunk)
        if n > most:
            put()
            n = 0
    if not samples:
        if held:
            yield pd.concat(held).sort_values(order, kind="stable")
        return
    if held:
        put()
    # Each sample stands for so many rows at most.
    places = np.sort(np.concatenate(samples))
    step = max(1, most * SAMPLED // ENTRY // 2)
    cuts = places[step::step]
    hot = set(cuts[1:][cuts[1:] == cuts[:-1]].tolist())
    low = None
    for high in [*np.unique(cuts).tolist(), None]:
        found = []
        for (raw,) in spill.get():
            part = _unpacked(raw)
            at = part[order]
            inside = pd.Series(True, at.index) if low is None else at > low
            if high is not None:
                inside &= (at < high) if high in hot else (at <= high)
            if inside.any():
                found.append(part[inside])
        if found:
            yield pd.concat(found).sort_values(order, kind="stable")
        if high in hot:
            # More rows of one place than memory should hold: entry by entry.
            for (raw,) in spill.get():
                part = _unpacked(raw)
                if (part[order] == high).any():
                    yield part[part[order] == high]
        low = high
    spill.clear()


class InOrder(StatefulProcessor):
    """One row of state per key, carried over its rows in order. Subclasses say what a sorted frame does."""

    order, state = "seq", ""

    def __init__(self, most: int = IN_MEMORY):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", self.state)
        self.spill = handle.getListState("spill", SPILL)

    def start(self) -> tuple:
        raise NotImplementedError

    def step(self, key: Any, rows: pd.DataFrame, held: tuple) -> tuple[pd.DataFrame, tuple]:
        raise NotImplementedError

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = tuple(self.held.get()) if self.held.exists() else self.start()
        for part in in_order(rows, self.order, self.spill, self.most):
            out, held = self.step(key, part, held)
            yield out
        self.held.update(held)

    def close(self) -> None:
        pass


MEDIA_OUT = "unit_key string, seq long, kind string, outcome string, attempt int, action string"
_ACTIONS = np.array(["clean", "flag", "block"], object)


def media_identity(fp: Column, settings_policy: Column, generation: Column | None = None) -> Column:
    """What a media result must match to count: the image set, the settings it was made under, the unit's generation."""
    return F.concat_ws("|", fp, settings_policy, *([generation.cast("string")] if generation is not None else []))


class MediaLifecycle(InOrder):
    """Which media results of a unit count, which are stale, what is retried.

    Input rows: ``seq, kind (request | image | ocr | image-failed | ocr-failed), fp, action``, where ``fp`` is the
    :func:`media_identity`, so a result under other settings is as stale as one of other images. A request names the
    unit's latest image set; results of another set are stale. Failures are retried within their allowance, which starts
    again with a new image set. A verdict only rises. A null ``fp`` is the empty one.
    """

    state = "fp string, image_attempts int, ocr_attempts int, action int"

    def __init__(self, policy: MediaPolicy = MediaPolicy(), most: int = IN_MEMORY):
        super().__init__(most)
        self.policy = policy

    def start(self) -> tuple:
        return None, 0, 0, 0

    def step(self, key: Any, rows: pd.DataFrame, held: tuple) -> tuple[pd.DataFrame, tuple]:
        fp, image_n, ocr_n, action = held
        kind = rows["kind"].to_numpy(object)
        is_request = kind == "request"
        # Image sets as numbers; the one that counts before a row is that of the request before it.
        sets = rows["fp"].fillna("").to_numpy(object)
        codes, _ = pd.factorize(np.append(np.array([fp], object), sets), use_na_sentinel=False)
        own = codes[1:]
        at = np.maximum.accumulate(np.where(is_request, np.arange(1, len(rows) + 1), 0))
        before = codes[np.append(0, at[:-1])]
        named = np.append(fp is not None, (at > 0)[:-1] | (fp is not None))
        same = (own == before) & named
        accepted, stale = is_request & ~same, ~is_request & ~same
        generation = np.cumsum(accepted)
        attempt = np.zeros(len(rows), np.int64)
        left = []
        for name, had in (("image-failed", image_n), ("ocr-failed", ocr_n)):
            failed = (kind == name) & ~stale
            count = np.cumsum(failed)
            at_start = np.append(0, count[accepted])[generation]
            count = count - at_start + np.where(generation == 0, had, 0)
            attempt[failed] = count[failed]
            left.append(int(count[-1]))
        counts = np.isin(kind, ("image", "ocr")) & ~stale
        rank = rows["action"].map({"clean": 0, "flag": 1, "block": 2}).fillna(0).to_numpy(np.int64)
        reached = np.maximum.accumulate(np.maximum(np.where(counts, rank, 0), action))
        earlier = np.append(action, reached[:-1])
        allowed = np.where(kind == "image-failed", self.policy.image_retries, self.policy.ocr_retries)
        outcome = np.where(counts & (rank > earlier), "upgrade", "kept").astype(object)
        outcome[attempt > 0] = np.where(attempt <= allowed, "retry", "given-up")[attempt > 0]
        outcome[stale] = "stale"
        outcome[is_request] = np.where(accepted, "accepted", "duplicate")[is_request]
        out = pd.DataFrame({
            "unit_key": np.full(len(rows), key[0], object), "seq": rows["seq"].to_numpy(), "kind": kind, "outcome": outcome,
            "attempt": attempt.astype(np.int32), "action": _ACTIONS[reached],
        })
        last = sets[at[-1] - 1] if at[-1] else fp
        return out.astype({c: object for c in ("unit_key", "kind", "outcome", "action")}), (last, *left, int(reached[-1]))


def stream_media_lifecycle(events: DataFrame, policy: MediaPolicy = MediaPolicy()) -> DataFrame:
    """Stale rejection and bounded retries; ``events`` has unit_key, seq, kind, fp, action. Start it inside ``keyed_state``."""
    rows = events.select("unit_key", "seq", "kind", "fp", "action")
    return rows.groupBy("unit_key").transformWithStateInPandas(MediaLifecycle(policy), MEDIA_OUT, "append", "none")


SLOT_OUT = "slot string, seq long, unit_key string, outcome string"


class RecycledSlots(InOrder):
    """The key that a slot shows, so content that moved in starts with no verdict."""

    state = "current string, shown boolean"

    def start(self) -> tuple:
        return None, False

    def step(self, key: Any, rows: pd.DataFrame, held: tuple) -> tuple[pd.DataFrame, tuple]:
        current, shown = held
        units = rows["unit_key"].to_numpy(object)
        before = np.append(np.array([current], object), units[:-1])
        # A slot that shows no key counts as first again.
        outcome = np.where(pd.isna(before), "first", np.where(before == units, "same", "recycled")).astype(object)
        out = pd.DataFrame({"slot": np.full(len(rows), key[0], object), "seq": rows["seq"].to_numpy(), "unit_key": units, "outcome": outcome})
        last = units[-1]
        return out.astype({c: object for c in ("slot", "unit_key", "outcome")}), (None if pd.isna(last) else last, True)


def stream_recycled_units(events: DataFrame, processor: Callable[[], InOrder] = RecycledSlots) -> DataFrame:
    """``events`` has slot, seq, unit_key. Start it inside ``keyed_state``."""
    return events.select("slot", "seq", "unit_key").groupBy("slot").transformWithStateInPandas(processor(), SLOT_OUT, "append", "none")
