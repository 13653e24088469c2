"""Phrase collocations from count streams in prefix and suffix order.

Every word occurrence gives one window: the word and the words that follow it in its piece, up to the longest phrase.
Windows are counted in chunks of text, dealt into slices of their order and sorted there. A slice is read as a stream,
in which the windows of one prefix lie together; sums over runs of equal prefixes give the counts of phrases of all
lengths at once. The counts that matter are then walked twice in lockstep, shorter phrases before the longer ones that
they begin: in prefix order for the counts of left parts and of extensions to the right, in suffix order (words
reversed) for right parts and extensions to the left. Both walks hold one phrase per length and look nothing up.

A slice is a range of keys. Ranges are cut at keys of a bounded sample of windows, which decides how even they are,
never what is found: a run that touches the end of its slice is always passed on and summed with its rest, and a phrase
that begins a cut key is shown to the slices of its extensions as well. So a hot word or pair is cut like any other.

Defined results: A-Z count as a-z; null texts are empty; a null language is ``und``; repeated rows count again; empty
tables give no rows; extra columns are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modwarden.llm import arrays as ar
from modwarden.operators.ranking import top_n_per_group
from modwarden.session import materialize

MAX_WORDS, MIN_COUNT, INSIDE_PERCENT, TOP, SCALE = 3, 10, 50, 2000, 1_000_000
# Text per chunk of counting, windows per slice of a stream, and sampled keys per cut. Cuts are sent to all tasks, so
# there are so many slices at most; in a larger input slices are longer, and their sorts spill.
CHUNK, SLICE_ROWS, PER_CUT, MOST_SLICES = 2 << 20, 1 << 20, 32, 8_192
SAMPLED_TEXTS = 2_000
_BLANKS, _BREAKS = b"\x20\x09", b".,;:!?\x0a\x0b\x0c\x0d"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
WINDOWS = "slice int, lang string, w string, c bigint"


def _marks(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_IS_BREAK, _IS_GAP = _marks(_BREAKS), _marks(_BREAKS + _BLANKS)


def counted_windows(lang: pa.Array, text: pa.Array, width: int) -> list[tuple[str, pa.Array, np.ndarray]]:
    """Per language the distinct windows, as words that each end in a space, and how often they occur."""
    data, offsets = ar.utf8(text)
    data = _LOWER[data]
    gap = _IS_GAP[data]
    starts, ends, first = ar.words(data, offsets, space=gap)
    if not len(starts):
        return []
    bounds = np.append(0, np.cumsum(ends - starts))
    spelled = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(data[~gap]))
    coded = spelled.dictionary_encode()
    ids, none = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
    # A word that ends its piece: a break before the next word, or the end of the text.
    breaks = np.append(0, np.cumsum(_IS_BREAK[data]))
    stops = np.append(breaks[starts[1:]] != breaks[ends[:-1]], True)
    stops[first[1:][np.diff(first) > 0] - 1] = True
    langs = pc.fill_null(lang, "und").dictionary_encode()
    of = np.repeat(langs.indices.to_numpy(), np.diff(first))
    key, cut = of * (none + 1) + ids, stops
    for k in range(1, width):
        follow = np.append(ids[k:], np.full(min(k, len(ids)), none))
        _, key = np.unique(key, return_inverse=True)
        key = key * (none + 1) + np.where(cut, none, follow)
        cut = cut | np.append(stops[k:], np.ones(min(k, len(ids)), bool))
    _, at, counts = np.unique(key, return_index=True, return_counts=True)
    words = pa.concat_arrays([pc.binary_join_element_wise(coded.dictionary, pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())), pa.array([""], pa.large_string())])
    parts, over = [], np.zeros(len(at), bool)
    for k in range(width):
        here = np.minimum(at + k, len(ids) - 1)
        parts.append(words.take(pa.array(np.where(over, none, ids[here]))))
        over = over | stops[here]
    windows = pc.binary_join_element_wise(*parts, pa.scalar("", pa.large_string()))
    out = []
    for i, name in enumerate(langs.dictionary.to_pylist()):
        mine = np.flatnonzero(of[at] == i)
        if len(mine):
            out.append((name, windows.take(pa.array(mine)), counts[mine]))
    return out


def _windows(width: int, cuts: list[tuple[bytes, bytes]]) -> Callable:
    """Window counts of chunks of text, each with the number of its slice."""

    def told(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(held).combine_chunks()
        for lang, windows, counts in counted_windows(whole.column("lang").combine_chunks(), whole.column("t").combine_chunks(), width):
            code = lang.encode()
            low, high = bisect_right(cuts, (code,)), bisect_right(cuts, (code + b"\0",))
            place = np.full(len(counts), low, np.int32)
            if high > low:
                # Cuts inside this language: order the windows once, and find the cuts among them.
                order = pc.sort_indices(windows).to_numpy()
                windows, counts = windows.take(pa.array(order)), counts[order]
                edges = [_first_at_least(windows, key) for name, key in cuts[low:high]]
                place = (low + np.searchsorted(edges, np.arange(len(counts)), side="right")).astype(np.int32)
            for a in range(0, len(counts), 50_000):
                n = min(50_000, len(counts) - a)
                cols = [pa.array(place[a : a + n]), pa.array([lang] * n, pa.string()), windows.slice(a, n).cast(pa.string()), pa.array(counts[a : a + n])]
                yield pa.RecordBatch.from_arrays(cols, ["slice", "lang", "w", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        # Pieces of half a chunk, so that what is held is a chunk at most, or one longer text.
        for piece in ar.slices(batches, "t", CHUNK // 2):
            more = pc.sum(pc.binary_length(piece.column("t"))).as_py() or 0
            if held and size + more > CHUNK:
                yield from told(held)
                held, size = [], 0
            held.append(piece)
            size += more
        if held:
            yield from told(held)

    return run


def _first_at_least(ordered: pa.Array, key: bytes) -> int:
    low, high = 0, len(ordered)
    while low < high:
        mid = (low + high) // 2
        if ordered[mid].as_py().encode() < key:
            low = mid + 1
        else:
            high = mid
    return low


def _heads(w: pa.Array, most: int) -> tuple[np.ndarray, list[pa.Array]]:
    """Number of words of each window, and for each length its first words (the whole window if it has fewer)."""
    data, offsets = ar.utf8(w)
    spaces = np.flatnonzero(data == 32)
    first = np.searchsorted(spaces, offsets)
    words = np.diff(first)
    heads = []
    for m in range(1, most):
        last = spaces[np.minimum(first[:-1] + m, first[1:]) - 1] + 1
        size = last - offsets[:-1]
        inside = np.arange(len(data)) < np.repeat(last, np.diff(offsets))
        heads.append(pa.LargeStringArray.from_buffers(len(w), pa.py_buffer(np.append(0, np.cumsum(size))), pa.py_buffer(data[inside])))
    return words, [*heads, w.cast(pa.large_string())]


def _run_sums(width: int, least: int) -> Callable:
    """Counts of the phrases of every length of sorted windows, and the number of all words with an empty phrase.

    Runs inside a slice are whole; the first and the last may go on in the slices beside it and pass whatever they sum to.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The open run of each length: slice, language, phrase, sum, and whether it is the first of its slice.
        open_: list[tuple | None] = [None] * (width + 1)

        def step(m: int, part, lang, phrase, c, shown) -> Iterator[tuple]:
            """Closes all runs but the last; ``shown`` says which rows have a phrase of this length."""
            new = np.ones(len(c), bool)
            same = (part[1:] == part[:-1]) & pc.equal(lang[1:], lang[:-1]).to_numpy(zero_copy_only=False)
            if phrase is not None:
                same &= pc.equal(phrase[1:], phrase[:-1]).to_numpy(zero_copy_only=False)
            new[1:] = ~same
            at = np.flatnonzero(new)
            sums = np.add.reduceat(c, at)
            slices = part[at]
            begins = np.append(True, slices[1:] != slices[:-1])
            if (was := open_[m]) is not None:
                head = "" if phrase is None else phrase[0].as_py()
                if was[:3] == (slices[0], lang[0].as_py(), head):
                    sums[0] += was[3]
                    begins[0] = was[4]
                else:
                    if was[5] and (was[3] >= least or was[4] or was[0] != slices[0]):
                        yield was[1], m, was[2], was[3]
                    begins[0] = was[0] != slices[0]
            ends = np.append(slices[1:] != slices[:-1], False)
            keep = np.flatnonzero(shown[at][:-1] & ((sums >= least) | begins | ends)[:-1])
            if len(keep):
                rows = pa.array(at[keep])
                spelled = [""] * len(keep) if phrase is None else phrase.take(rows).to_pylist()
                yield from zip(lang.take(rows).to_pylist(), [m] * len(keep), spelled, sums[keep].tolist(), strict=True)
            z = at[-1]
            open_[m] = (slices[-1], lang[int(z)].as_py(), "" if phrase is None else phrase[int(z)].as_py(), int(sums[-1]), bool(begins[-1]), bool(shown[z]))

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            cols = [list(x) for x in zip(*rows, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], ["lang", "m", "phrase", "f"])

        for batch in batches:
            if not batch.num_rows:
                continue
            part, lang, c = batch.column("slice").to_numpy(), batch.column("lang"), batch.column("c").to_numpy()
            words, heads = _heads(batch.column("w"), width)
            rows = list(step(0, part, lang, None, c, np.ones(len(c), bool)))
            for m, phrase in enumerate(heads, 1):
                rows += step(m, part, lang, phrase, c, words >= m)
            if rows:
                yield packed(rows)
        rest = [(was[1], m, was[2], was[3]) for m, was in enumerate(open_) if was is not None and was[5]]
        if rest:
            yield packed(rest)

    return run


def _cuts(keys: DataFrame, slices: int) -> list[tuple[bytes, bytes]]:
    """Keys ``(lang, w)`` that cut a random sample of at most ``PER_CUT`` keys a slice into even parts."""
    if slices < 2:
        return []
    sample = keys.select("lang", "w").orderBy(F.xxhash64("lang", "w"), "lang", "w").limit(slices * PER_CUT).collect()
    ordered = sorted((r.lang.encode(), r.w.encode()) for r in sample)
    return sorted({ordered[i * len(ordered) // slices] for i in range(1, slices)}) if ordered else []


def phrase_counts(texts: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``(lang, m, phrase, f)``: phrases of up to ``max_words`` words with ``min_count`` occurrences or more.

    ``texts`` has ``lang`` and ``t``. Words end in a space each; ``m`` is their number. The row of no words counts them all.
    """
    rows, size = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    slices = min(MOST_SLICES, max(1, -(-size // (6 * slice_rows))))
    cuts = []
    if slices > 1:
        # The cuts come from some of the texts, which is all that they decide: how even the slices are.
        some = texts.filter(F.pmod(F.xxhash64("t"), F.lit(max(1, rows // SAMPLED_TEXTS))) == 0).distinct()
        cuts = _cuts(some.mapInArrow(_windows(max_words, []), WINDOWS), slices)
    windows = texts.mapInArrow(_windows(max_words, cuts), WINDOWS)
    stream = windows.repartitionById(len(cuts) + 1, F.col("slice")).sortWithinPartitions("slice", "lang", "w")
    found = stream.mapInArrow(_run_sums(max_words, min_count), "lang string, m int, phrase string, f bigint")
    return found.groupBy("lang", "m", "phrase").agg(F.sum("f").alias("f")).filter((F.col("f") >= min_count) | (F.col("m") == 0))


def _walk(max_words: int) -> Callable:
    """Lockstep over the streams of all lengths: each phrase meets the counts of its beginnings and shows them its own."""

    names = ["lang", "w", "m", "f", *(f"part{k}" for k in range(1, max_words)), "longer"]
    types = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * (max_words + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Per length the phrase that is open: [phrase, count, greatest count of a phrase one word longer, shown from elsewhere].
        stack: list[list] = []
        part, language, out = None, None, []

        def close(down_to: int) -> None:
            while len(stack) > down_to:
                phrase, f, longer, elsewhere = stack.pop()
                m = len(stack) + 1
                if m > 1 and not (elsewhere and longer is None):
                    before = [x[1] for x in stack] + [None] * (max_words - m)
                    out.append((language, phrase, m, f, *before, longer))

        def packed() -> pa.RecordBatch:
            cols = zip(*out, strict=True)
            batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types, strict=True)], names)
            out.clear()
            return batch

        for batch in batches:
            for s, lang, w, m, f, elsewhere in zip(*(batch.column(c).to_pylist() for c in ("slice", "lang", "w", "m", "f", "elsewhere")), strict=True):
                if (s, lang) != (part, language):
                    close(0)
                    part, language = s, lang
                close(m - 1)
                if len(stack) != m - 1 or (stack and not w.startswith(stack[-1][0])):
                    raise ValueError(f"the beginning of {w!r} is missing from its stream")
                if stack:
                    stack[-1][2] = max(f, stack[-1][2] or 0)
                stack.append([w, f, None, elsewhere])
            if len(out) >= 20_000:
                yield packed()
        close(0)
        if out:
            yield packed()

    return run


def _lockstep(counts: DataFrame, max_words: int, slice_rows: int, rows: int) -> DataFrame:
    """For each phrase ``w`` of two words or more: counts of its beginnings, and the greatest count among phrases one
    word longer that it begins (``longer``, one row per slice that holds such)."""
    cuts = _cuts(counts, min(MOST_SLICES, max(1, -(-rows // slice_rows))))
    spark = counts.sparkSession
    # The beginnings of a key that cuts two slices are shown to the slice that starts with it.
    shown = [(lang.decode(), " ".join(w.decode().split(" ")[:k]) + " ", at) for at, (lang, w) in enumerate(cuts, 1) for k in range(1, w.count(b" "))]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(batch.column("lang").to_pylist(), batch.column("w").to_pylist(), strict=True)
            place = pa.array([bisect_right(cuts, (a.encode(), b.encode())) for a, b in keys], pa.int32())
            yield pa.RecordBatch.from_arrays([place, *batch.columns], ["slice", *batch.schema.names])

    stream = counts.mapInArrow(placed, "slice int, lang string, w string, m int, f bigint").withColumn("elsewhere", F.lit(False))
    if shown:
        # As many rows as there are cuts, times the words of a phrase.
        extra = spark.createDataFrame(shown, "lang string, w string, slice int")
        stream = stream.unionByName(counts.join(F.broadcast(extra), ["lang", "w"]).withColumn("elsewhere", F.lit(True)))
    kept = "lang string, w string, m int, f bigint, " + "".join(f"part{k} bigint, " for k in range(1, max_words)) + "longer bigint"
    return stream.repartitionById(len(cuts) + 1, F.col("slice")).sortWithinPartitions("slice", "lang", "w").mapInArrow(_walk(max_words), kept)


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = MAX_WORDS, min_count: int = MIN_COUNT,
    inside_percent: int = INSIDE_PERCENT, top: int = TOP, slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the ``top`` phrases of each language by their lowest-scoring cut.

    A phrase of count ``a`` cut into parts of counts ``l`` and ``r`` scores ``floor(1000000 * a * a / (l * r))``; it is
    dropped if a longer phrase that holds it has ``inside_percent`` of its count or more.
    """
    if max_words < 2 or min_count < 1:
        raise ValueError("phrases have two words at least, and occur")
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("t"))
    counts = materialize(phrase_counts(texts, max_words, min_count, slice_rows), "phrase-counts")
    rows = counts.count()
    ordered = counts.filter("m > 0").select("lang", F.col("phrase").alias("w"), "m", "f")
    # Reversed words, each with its space again.
    turned = F.concat(F.array_join(F.reverse(F.split(F.rtrim(F.col("w")), " ")), " "), F.lit(" "))
    left = _lockstep(ordered, max_words, slice_rows, rows)
    right = _lockstep(ordered.withColumn("w", turned), max_words, slice_rows, rows).withColumn("w", turned)
    parts = range(1, max_words)
    both = left.select("lang", "w", "m", "f", *(F.col(f"part{k}").alias(f"left{k}") for k in parts), *(F.lit(None).cast("bigint").alias(f"right{k}") for k in parts), "longer")
    both = both.unionByName(right.select("lang", "w", "m", "f", *(F.lit(None).cast("bigint").alias(f"left{k}") for k in parts), *(F.col(f"part{k}").alias(f"right{k}") for k in parts), "longer"))
    seen = both.groupBy("lang", "w", "m").agg(F.max("f").alias("a"), *(F.max(f"{s}{k}").alias(f"{s}{k}") for s in ("left", "right") for k in parts), F.max("longer").alias("longer"))
    kept = seen.filter(~(F.col("longer") * 100 >= F.col("a") * inside_percent) | F.col("longer").isNull())

    def cut(words: int, k: int):
        wide = "cast({} as decimal(38,0))"
        score = F.expr(f"(cast({SCALE} as decimal(7,0)) * {wide.format('a')} * {wide.format('a')}) div (cast(left{k} as decimal(19,0)) * cast(right{words - k} as decimal(19,0)))")
        return F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(f"left{k}").alias("l"), F.col(f"right{words - k}").alias("r"))

    best = F.coalesce(*(F.when(F.col("m") == words, F.array_min(F.array(*(cut(words, k) for k in range(1, words))))) for words in range(2, max_words + 1)))
    scored = kept.withColumn("_c", best).select("lang", F.rtrim("w").alias("phrase"), "a", "_c.l", "_c.r", "_c.score")
    first = top_n_per_group(scored, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], top, "phrase")
    totals = counts.filter("m = 0").select("lang", F.col("f").alias("n"))
    return first.join(totals, "lang").select("lang", F.col("rank"), "phrase", "a", "l", "r", "n", "score")
