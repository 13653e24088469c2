"""Fill-in-middle transformation over indexable skip lists.

A text is cut into units (a word with the spaces before it; spaces at the end are a unit of their own). Two ranks of
units, drawn from the document's id, cut it into prefix, middle and suffix, which change places around sentinels. The
units lie in the bottom lane of an indexable skip list; an express lane links every unit of a greater height to the next,
and a link carries how many units and how many code points it passes. From the top lane down, a link is taken as long as
its units do not pass the rank, so a cut costs a logarithmic number of steps and arrives with its code points summed up.

Defined results: a null text is empty, and an empty text is plain with no units; texts that contain a sentinel are
plain; a null id draws like an empty one; equal rows get equal results; all columns pass through, and the result is
one struct column, so names cannot clash unless the caller names it like a column of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modwarden.llm import arrays as ar

SENTINELS = ("<P>", "<S>", "<M>")
PLAIN_FROM, SPM_BELOW, SEED = 50, 80, 42
RESULT = "struct<n: bigint, form: string, prefix_chars: bigint, middle_chars: bigint, output: string>"
# A unit stands in lane k with a chance of FANOUT**-k.
FANOUT, _BITS = 8, 3
_SLICE = 4 << 20


class Lanes:
    """One indexable skip list per text, lane by lane in flat arrays.

    ``points[i]`` is the width in code points of unit ``i``, and text ``t`` has the units ``first[t]:first[t + 1]``.
    """

    def __init__(self, points: np.ndarray, first: np.ndarray):
        row, place = ar.spread(np.diff(first))
        # Heights come from a hash of the place, so equal texts have equal lists; the head stands in every lane.
        height = np.zeros(len(points), np.int64)
        left = ar.mix(place.astype(np.uint64) + np.uint64(1))
        more = place > 0
        while more.any():
            more &= (left & np.uint64(FANOUT - 1)) == 0
            height += more
            left >>= np.uint64(_BITS)
        height[place == 0] = 64
        self.lanes = []
        units, down = np.ones(len(points), np.int64), None
        while True:
            self.lanes.append((units, points, down, first))
            stands = height >= len(self.lanes)
            if not len(units) or np.diff(first).max() <= FANOUT or stands.all():
                break
            at = np.flatnonzero(stands)
            # A link passes what the links below it pass up to the next unit of this lane.
            units, points = np.add.reduceat(units, at), np.add.reduceat(points, at)
            down = np.append(at, len(stands))
            first, height = np.searchsorted(at, first), height[at]

    def points_before(self, rank: np.ndarray) -> np.ndarray:
        """Code points of the first ``rank[t]`` units of each text ``t``."""
        passed, chars = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        at = self.lanes[-1][3][:-1].copy()
        for units, points, down, first in reversed(self.lanes):
            end = first[1:]
            going = np.flatnonzero(at < end)
            while len(going):
                link = at[going]
                fits = passed[going] + units[link] <= rank[going]
                going, link = going[fits], link[fits]
                passed[going] += units[link]
                chars[going] += points[link]
                at[going] += 1
                going = going[at[going] < end[going]]
            if down is not None:
                at = down[at]
        if not np.array_equal(passed, rank):
            raise ValueError("a rank lies beyond its text")
        return chars


def units_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of each unit, and the first unit of each text (plus the total), of texts in UTF-8."""
    _, ends, first = ar.words(data, offsets)
    begin, stop, words = offsets[:-1], offsets[1:], np.diff(first)
    last = np.where(words > 0, ends[np.maximum(first[1:] - 1, 0)] if len(ends) else 0, begin)
    tail = last < stop
    firsts = np.append(0, np.cumsum(words + tail))
    starts = np.empty(firsts[-1], np.int64)
    row, place = ar.spread(words)
    # A unit starts where the one before it ends.
    starts[firsts[:-1][row] + place] = np.where(place > 0, np.append(0, ends)[first[:-1][row] + place], begin[row])
    starts[firsts[1:][tail] - 1] = last[tail]
    leads = (data & 0xC0) != 0x80
    return (np.add.reduceat(leads, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)), firsts


def arrange(form: str, prefix: str, middle: str, suffix: str, sentinels: Sequence[str] = SENTINELS) -> str:
    p, s, m = sentinels
    return f"{p}{prefix}{s}{suffix}{m}{middle}" if form == "psm" else f"{s}{suffix}{p}{prefix}{m}{middle}"


def _transformed(text: pa.Array, draws: list[np.ndarray], plain_from: int, spm_below: int, sentinels: Sequence[str]) -> pa.StructArray:
    text = pc.fill_null(text, "")
    data, offsets = ar.utf8(text)
    points, first = units_of(data, offsets)
    n = np.diff(first)
    h1, h2, h3, h4 = draws
    marked = pc.match_substring_regex(text, "|".join(map(re.escape, sentinels))).to_numpy(zero_copy_only=False)
    plain = (n == 0) | marked | (h3 % 100 >= plain_from)
    a, b = h1 % (n + 1), h2 % (n + 1)
    lanes = Lanes(points, first)
    cut, end = lanes.points_before(np.minimum(a, b)), lanes.points_before(np.maximum(a, b))
    form = np.where(plain, "plain", np.where(h4 % 100 < spm_below, "spm", "psm"))
    out = []
    for t, f, i, j in zip(text, form.tolist(), cut.tolist(), end.tolist(), strict=True):
        whole = t.as_py()
        out.append(whole if f == "plain" else arrange(f, whole[:i], whole[i:j], whole[j:], sentinels))
    cols = [pa.array(n), pa.array(form, pa.string()), pa.array(cut, mask=plain), pa.array(end - cut, mask=plain), pa.array(out, pa.string())]
    return pa.StructArray.from_arrays(cols, ["n", "form", "prefix_chars", "middle_chars", "output"])


def _draws(seed: int, id_col: str) -> list[Column]:
    """Four numbers of 32 bits from the digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]


def transform(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", into: str = "infill", plain_from: int = PLAIN_FROM,
    spm_below: int = SPM_BELOW, seed: int = SEED, sentinels: Sequence[str] = SENTINELS,
) -> DataFrame:
    """The rows with a struct ``into``: units, form (plain, psm, spm), code points of prefix and middle, output.

    Of 100 texts about ``plain_from`` are cut, and of 100 of those about ``spm_below`` have the suffix first. Only
    text and draws go to Python; the other columns stay where they are.
    """

    @F.arrow_udf(RESULT)
    def cut(cols: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for text, *draws in cols:
            if not len(text):
                continue
            whole = pa.RecordBatch.from_arrays([text, *draws], ["t", "0", "1", "2", "3"])
            parts = [
                _transformed(x.column("t"), [x.column(str(k)).to_numpy() for k in range(4)], plain_from, spm_below, sentinels)
                for x in ar.slices([whole], "t", _SLICE)
            ]
            yield pa.concat_arrays(parts)

    return docs.withColumn(into, cut(F.col(text_col).cast("string"), *_draws(seed, id_col)))


def restored(output: Column, form: Column, sentinels: Sequence[str] = SENTINELS) -> Column:
    """The text that an output was made from. A cut text holds no sentinel, so an output splits at its own three only."""
    parts = F.split(output, "|".join(map(re.escape, sentinels)), -1)
    return (
        F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
        .when(form == "spm", F.concat(parts[2], parts[3], parts[1]))
        .otherwise(output)
    )
