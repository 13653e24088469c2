"""Substring deduplication: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

Each task hashes every window of its documents, keeps of windows that are equal inside the task only those of
the smallest document, and sends sorted hashes as compressed blocks to the bucket of their hash. A bucket finds
each hash's smallest document; all other occurrences are repeats and go, as blocks again, to the group of their
document. Repeats of a document merge into maximal removal intervals, which are joined to the text once.

Words are runs of bytes other than space and 0x09-0x0D. Defined results: a null text has no words; a text
shorter than the window loses nothing; a null id ranks after every other id; rows with one id never remove
each other's words; extra columns pass through untouched (names that start with ``_sd_`` are reserved).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from modwarden.llm import arrays as ar

WINDOW = 50
FLUSH = 1_500_000
SLICE = 2 << 20
_LAST = 2**63 - 1
_SENT = pa.schema([("bucket", pa.int64()), ("payload", pa.binary())])
_FOUND = pa.schema([("id", pa.int64()), ("tag", pa.int64()), ("starts", pa.list_(pa.int32()))])


def _pack(*parts: np.ndarray) -> bytes:
    head = np.array([len(parts), *(v for p in parts for v in (len(p), p.dtype.itemsize))], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(ar.planes(p) for p in parts))


def _unpack(raw: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    count = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes = np.frombuffer(raw, np.int64, 2 * count, 8).reshape(-1, 2).tolist()
    at, out = 8 + 16 * count, []
    for n, width in sizes:
        out.append(ar.from_planes(raw[at : at + n * width], f"u{width}", n))
        at += n * width
    return out


def _documents(code: np.ndarray, ids: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The documents that occur, as steps of sorted ids and tags, and each window's number among them."""
    used, number = np.unique(code, return_inverse=True)
    return np.diff(ids[used], prepend=0).view(np.uint64), tags[used].astype(np.uint64), number.astype(np.uint32)


def _least(h: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Of windows sorted by (hash, id): which belong to the smallest id of their hash."""
    first = np.append(True, h[1:] != h[:-1])[: len(h)]
    return ids == ids[np.flatnonzero(first)[np.cumsum(first) - 1]]


def _repeats(code, starts, ids, tags, groups: int):
    """Repeated windows, sorted by document, as a block per document group."""
    of = (ar.mix(ids.view(np.uint64)) % np.uint64(groups)).astype(np.int64)[code]
    order = np.lexsort((starts, code, of))
    of, code, starts = of[order], code[order], starts[order]
    edges = np.append(np.flatnonzero(np.append(True, of[1:] != of[:-1])[: len(of)]), len(of)).tolist()
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        steps, tag, number = _documents(code[lo:hi], ids, tags)
        yield -1 - int(of[lo]), _pack(steps, tag, number, starts[lo:hi].astype(np.uint32))


def _sent(rows):
    held = []
    for row in rows:
        held.append(row)
        if len(held) == 256:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), _SENT, strict=True)], schema=_SENT)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), _SENT, strict=True)], schema=_SENT)


def windows_of(text: pa.Array, window: int, byte_hash: ar.Rolling, word_hash: ar.Rolling):
    """(hash, row number, start) of every window of every text."""
    data, offsets = ar.utf8(text)
    starts, ends, first = ar.words(data, offsets)
    hashed = ar.word_hashes(data, starts, ends, byte_hash)
    row, start = ar.spread(np.maximum(0, np.diff(first) - window + 1))
    at = first[:-1][row] + start
    return ar.mix(word_hash.spans(hashed, at, at + window)), row, start


def _sender(window: int, buckets: int):
    def flush(held, docs):
        ids, tags = (np.concatenate(x) for x in zip(*docs, strict=True))
        by = np.lexsort((tags, ids))
        rank = np.empty(len(by), np.int32)
        rank[by] = np.arange(len(by))
        ids, tags = ids[by], tags[by]
        h, code, starts = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        code = rank[code]
        order = np.lexsort((code, h))
        h, code, starts = h[order], code[order], starts[order]
        mine = _least(h, ids[code])
        if not mine.all():
            yield from _repeats(code[~mine], starts[~mine], ids, tags, buckets)
            h, code, starts = h[mine], code[mine], starts[mine]
        edges = [*np.searchsorted(h, np.array([b * 2**64 // buckets for b in range(buckets)], np.uint64)).tolist(), len(h)]
        for b, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if hi > lo:
                steps, tag, number = _documents(code[lo:hi], ids, tags)
                yield b, _pack(np.diff(h[lo:hi], prepend=np.uint64(0)), steps, tag, number, starts[lo:hi].astype(np.uint32))

    def rows(batches):
        byte_hash, word_hash = ar.Rolling(), ar.Rolling(0xD6E8FEB86659FD93)
        held, docs, n, n_docs = [], [], 0, 0
        for batch in ar.slices(batches, "_sd_text", SLICE):
            h, row, start = windows_of(batch.column("_sd_text"), window, byte_hash, word_hash)
            if not len(h):
                continue
            docs.append(tuple(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("_sd_id", "_sd_tag")))
            held.append((h, (row + n_docs).astype(np.int32), start.astype(np.int32)))
            n, n_docs = n + len(h), n_docs + batch.num_rows
            if n >= FLUSH:
                yield from flush(held, docs)
                held, docs, n, n_docs = [], [], 0, 0
        if held:
            yield from flush(held, docs)

    return lambda batches: _sent(rows(batches))


def _bucket(buckets: int):
    """All windows of one hash range; those that do not belong to their hash's smallest document go on."""

    def run(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() < 0:
            return table.select(["bucket", "payload"])
        hs, codes, starts, ids, tags = [], [], [], [], []
        base = 0
        for p in table.column("payload"):
            step, id_steps, tag, number, start = _unpack(p.as_py())
            hs.append(np.cumsum(step))
            codes.append(number + np.uint32(base))
            starts.append(start)
            ids.append(np.cumsum(id_steps.view(np.int64)))
            tags.append(tag)
            base += len(tag)
        h, code, start = np.concatenate(hs), np.concatenate(codes), np.concatenate(starts)
        ids, tags = np.concatenate(ids), np.concatenate(tags)
        order = np.argsort(h)
        h = h[order]
        same = np.zeros(len(h), bool)
        same[1:] = h[1:] == h[:-1]
        same[:-1] |= same[1:].copy()
        order, h = order[same], h[same]
        code, start = code[order], start[order]
        order = np.lexsort((ids[code], h))
        h, code, start = h[order], code[order], start[order]
        mine = _least(h, ids[code])
        # Documents of several blocks get one number, in id order.
        by = np.lexsort((tags, ids))
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        out = list(_sent(_repeats(rank[code[~mine]], start[~mine], ids[by], tags[by], buckets)))
        return pa.Table.from_batches(out, _SENT)

    return run


def _per_document(table: pa.Table) -> pa.Table:
    """All repeats of one group of documents: a row per document."""
    ids, tags, starts = [], [], []
    for p in table.column("payload"):
        id_steps, tag, number, start = _unpack(p.as_py())
        ids.append(np.cumsum(id_steps.view(np.int64))[number])
        tags.append(tag[number])
        starts.append(start)
    ids, tags, starts = np.concatenate(ids), np.concatenate(tags).astype(np.int64), np.concatenate(starts).astype(np.int32)
    order = np.lexsort((starts, tags, ids))
    ids, tags, starts = ids[order], tags[order], starts[order]
    first = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1]))[: len(ids)])
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(ids)).astype(np.int32)), pa.array(starts))
    return pa.Table.from_arrays([pa.array(ids[first]), pa.array(tags[first]), lists], schema=_FOUND)


def _keys(id_col: str, text_col: str):
    tag = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LAST)).alias("_sd_id"), tag.alias("_sd_tag")


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, buckets: int | None = None) -> DataFrame:
    """``(id, tag, starts)``: per document, the first words of its windows that also start under a smaller id.

    ``tag``, a hash of 64 bits, tells apart different texts with one id. ``buckets`` is the number of hash ranges and of document
    groups (the shuffle partitions if unset); a task holds the windows of one, so size it for a few million.
    """
    buckets = buckets or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.col(text_col).cast("string").alias("_sd_text")
    sent = docs.select(*_keys(id_col, text_col), text).mapInArrow(_sender(window, buckets), "bucket bigint, payload binary")
    found = sent.groupBy("bucket").applyInArrow(_bucket(buckets), "bucket bigint, payload binary")
    return found.groupBy("bucket").applyInArrow(_per_document, "id bigint, tag bigint, starts array<int>")


def intervals(starts: np.ndarray, window: int) -> np.ndarray:
    """Maximal word intervals ``[from, to)`` covered by windows with the given starts, in order."""
    starts = np.unique(starts)
    new = np.ones(len(starts), bool)
    new[1:] = np.diff(starts) > window
    head = np.flatnonzero(new)
    return np.stack([starts[head], np.append(starts[head[1:] - 1], starts[-1:]) + window], 1) if len(starts) else np.zeros((0, 2), np.int64)


def _remover(window: int, text_col: str, schema: pa.Schema):
    def remove(batches):
        for batch in ar.slices(batches, text_col, SLICE):
            starts = batch.column("_sd_starts")
            n_words, n_removed, kept, spans = [], [], [], []
            for i, text in enumerate(batch.column(text_col).to_pylist()):
                ws, s = (text or "").encode().split(), starts[i]
                gone = intervals(s.values.to_numpy().astype(np.int64), window).tolist() if s.is_valid else []
                n_words.append(len(ws))
                n_removed.append(sum(b - a for a, b in gone))
                for a, b in reversed(gone):
                    del ws[a:b]
                kept.append(b" ".join(ws).decode())
                spans.append([{"first": a, "last": b} for a, b in gone])
            cols = {"n_words": n_words, "n_removed": n_removed, "kept_text": kept, "removed": spans}
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[f.name], f.type) if f.name in cols else batch.column(f.name).cast(f.type) for f in schema], schema=schema
            )

    return remove


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, buckets: int | None = None) -> DataFrame:
    """The documents with ``n_words``, ``n_removed``, ``kept_text`` and the ``removed`` word intervals ``[first, last)``.

    Columns of the input that bear one of these names are replaced.
    """
    found = repeated_windows(docs, id_col, text_col, window, buckets).select(F.col("id").alias("_sd_of"), F.col("tag").alias("_sd_oftag"), F.col("starts").alias("_sd_starts"))
    kept = docs.drop("n_words", "n_removed", "kept_text", "removed").withColumn(text_col, F.col(text_col).cast("string"))
    joined = kept.select("*", *_keys(id_col, text_col)).join(found, (F.col("_sd_id") == F.col("_sd_of")) & (F.col("_sd_tag") == F.col("_sd_oftag")), "left")
    joined = joined.select(*kept.columns, "_sd_starts")
    added = "n_words bigint, n_removed bigint, kept_text string, removed array<struct<first:int,last:int>>"
    out = StructType([*kept.schema.fields, *_parse_datatype_string(added).fields])
    return joined.mapInArrow(_remover(window, text_col, to_arrow_schema(out)), out)
