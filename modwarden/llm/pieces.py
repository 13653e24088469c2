"""SentencePiece encoding and decoding for merge-type vocabularies.

Text is cut into units that no piece can span: a run of spaces and the word after it. Within a unit, adjacent
symbol pairs wait in an agenda ordered by score, then position; the best is merged until none is left, and
symbols without a piece fall back to bytes. The agenda runs over all new units of an Arrow batch at once, a row
each; a long unit has a heap of its own. Units met before are looked up. In every batch the library encodes and
decodes each new unit too, and a difference raises.

Defined results: a null text counts as empty; the end id alone is its encoding. Extra columns pass through.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructType, _parse_datatype_string

from modwarden.llm import arrays as ar

SPACE = "▁"
KEPT_UNITS = 200_000
LONG_UNIT = 48
_UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_NONE = np.iinfo(np.int32).max
_BYTE = 6  # the type of byte pieces in a model file


class Vocabulary:
    """Merge table of a model: which two pieces make which, and how early."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.trainer_spec.model_type != pb.TrainerSpec.BPE or model.normalizer_spec.precompiled_charsmap or not model.normalizer_spec.add_dummy_prefix or model.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("a merge-type vocabulary with an identity normaliser is needed")
        plain = {p.piece: (i, p.score) for i, p in enumerate(model.pieces) if p.type in (1, 4)}
        if any(SPACE in p.lstrip(SPACE) for p in plain):
            raise ValueError("a piece spans two words")
        self.end, self.unknown = self.library.eos_id(), self.library.unk_id()
        self.bytes_ = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == _BYTE}
        self.piece = [p.piece for p in model.pieces]
        self.is_byte = {i: b for b, i in self.bytes_.items()}
        self.last_byte = max(self.is_byte, default=-1)
        # Symbols: ids of pieces; every other character gets a number above them, for the units of one batch.
        self.ids = {p: i for p, (i, _) in plain.items()}
        order = {s: r for r, s in enumerate(sorted({s for _, s in plain.values()}, reverse=True))}
        merges = {}
        for p, (i, score) in plain.items():
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    merges[a << 32 | b] = (order[score], i)
        self.keys = np.array(sorted(merges), np.int64)
        self.rank = np.array([merges[k][0] for k in self.keys.tolist()] + [_NONE], np.int32)
        self.made = np.array([merges[k][1] for k in self.keys.tolist()] + [-1], np.int32)
        self.merges = merges

    def look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Row of the merge table for each pair, or the last row."""
        want = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, want)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == want, at, len(self.keys))

    def heap_merge(self, unit: str) -> list[int | str]:
        """One unit by an agenda of its own: pairs by rank and place; stale entries are skipped."""
        sym: list = [self.ids.get(c, c) for c in unit]
        before, after = list(range(-1, len(sym) - 1)), [*range(1, len(sym)), -1]
        alive, agenda = [True] * len(sym), []

        def offer(i, j):
            if i >= 0 and j >= 0 and isinstance(sym[i], int) and isinstance(sym[j], int):
                found = self.merges.get(sym[i] << 32 | sym[j])
                if found:
                    heapq.heappush(agenda, (found[0], i, j, sym[i], sym[j], found[1]))

        for i in range(len(sym) - 1):
            offer(i, i + 1)
        while agenda:
            _, i, j, a, b, made = heapq.heappop(agenda)
            if not (alive[i] and alive[j]) or after[i] != j or sym[i] != a or sym[j] != b:
                continue
            sym[i], alive[j], after[i] = made, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [s for s, on in zip(sym, alive, strict=True) if on]

    def merge_all(self, units: list[str]) -> list[list[int]]:
        """Ids of many units, by an agenda over all short units of one length: per round, every unit's best pair is merged."""
        out: list = [None] * len(units)
        by_length: dict[int, list[int]] = {}
        for i, u in enumerate(units):
            if len(u) > LONG_UNIT:
                out[i] = self.to_ids(self.heap_merge(u))
            else:
                by_length.setdefault(len(u), []).append(i)
        for length, members in by_length.items():
            if length == 0:
                for i in members:
                    out[i] = []
                continue
            points = np.frombuffer("".join([units[i] for i in members]).encode("utf-32-le", "surrogatepass"), np.uint32)
            seen, inverse = np.unique(points, return_inverse=True)
            # A character without a piece keeps its own number, above all pieces, and never merges.
            own = np.array([self.ids.get(chr(c), len(self.piece) + k) for k, c in enumerate(seen.tolist())], np.int64)
            sym = own[inverse].reshape(len(members), length)
            who = np.array(members)
            pair = self.look(sym[:, :-1], sym[:, 1:])

            def finish(rows, held, names=None, seen=seen):
                for i, s in zip(rows.tolist(), held.tolist(), strict=True):
                    out[i] = s
                for r in np.flatnonzero((held >= len(self.piece)).any(1)).tolist():
                    i = int(rows[r])
                    out[i] = self.to_ids([x if x < len(self.piece) else chr(seen[x - len(self.piece)]) for x in out[i]])

            while True:
                rank = self.rank[pair]
                best = rank.argmin(1) if rank.shape[1] else np.zeros(len(sym), int)
                rows = np.arange(len(sym))
                on = rank[rows, best] != _NONE if rank.shape[1] else np.zeros(len(sym), bool)
                if not on.all():
                    finish(who[~on], sym[~on])
                    sym, pair, who, best = sym[on], pair[on], who[on], best[on]
                    rows = np.arange(len(sym))
                if not len(sym):
                    break
                made = self.made[pair[rows, best]]
                # Drop the right symbol of the merged pair, and the pair entry of that place.
                keep = np.ones(sym.shape, bool)
                keep[rows, best + 1] = False
                sym[rows, best] = made
                sym = sym[keep].reshape(len(sym), -1)
                keep = np.ones(pair.shape, bool)
                keep[rows, best] = False
                pair = pair[keep].reshape(len(sym), -1)
                left = np.flatnonzero(best > 0)
                pair[left, best[left] - 1] = self.look(sym[left, best[left] - 1], sym[left, best[left]])
                right = np.flatnonzero(best < pair.shape[1])
                pair[right, best[right]] = self.look(sym[right, best[right]], sym[right, best[right] + 1])
        return out

    def to_ids(self, symbols: list[int | str]) -> list[int]:
        ids: list[int] = []
        for s in symbols:
            if isinstance(s, int):
                ids.append(s)
            elif self.bytes_:
                ids.extend(self.bytes_[b] for b in s.encode("utf-8", "replace"))
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
        return ids

    def to_text(self, ids: list[int]) -> str:
        """Pieces joined, bytes decoded; the space sign stays."""
        if not ids or min(ids) > self.last_byte:
            return "".join(map(self.piece.__getitem__, ids))
        raw = b"".join(bytes((self.is_byte[i],)) if i in self.is_byte else self.piece[i].encode() for i in ids)
        return raw.decode("utf-8", "replace")

    def encode_units(self, units: list[str]) -> tuple[list[list[int]], list[str]]:
        """Ids and text of each unit, held against the library's ids of the same unit and its text of all ids in a row."""
        got = self.merge_all(units)
        texts = [self.to_text(ids) for ids in got]
        # The library puts a space sign before its input, but not before an empty one: a lone sign is one piece.
        led = [i for i, u in enumerate(units) if len(u) > 1]
        for i, ids in zip(led, self.library.encode([units[i][1:] for i in led], num_threads=1) if led else [], strict=True):
            if ids != got[i]:
                raise ValueError(f"unit {units[i]!r}: {got[i]} differs from the library's {ids}")
        if units and "".join(texts)[1:].replace(SPACE, " ") != self.library.decode(list(chain.from_iterable(got))):
            raise ValueError("the library decodes these ids to another text")
        return got, texts


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def units_of(text: str) -> list[str]:
    """Units of the normalised text: a space sign before each word; runs of them stay with the word after."""
    if not text:
        return []
    if SPACE in text or "  " in text or text[0] == " " or text[-1] == " ":
        return _UNIT.findall(SPACE + text.replace(" ", SPACE))
    return [SPACE + w for w in text.split(" ")]


class Encoder:
    """Encodes texts unit by unit and keeps the ids of units that came lately, in two generations of bounded size."""

    def __init__(self, path: str, kept: int = KEPT_UNITS):
        self.vocab, self.kept = vocabulary(path), kept
        self.digits = list(map(str, range(len(self.vocab.piece))))
        self.young: dict[str, str] = {}
        self.old: dict[str, str] = {}
        # Units that are decoded to another text than their own.
        self.other: dict[str, str] = {}

    def run(self, texts: list[str]) -> list[tuple[str, str]]:
        """(decimal ids joined by one space, end id last; decoded text) of each text."""
        cut = [units_of(t) for t in texts]
        missing = set().union(*cut).difference(self.young) if cut else set()
        known = missing.intersection(self.old)
        self.young.update(zip(known, map(self.old.__getitem__, known), strict=True))
        new = list(missing.difference(known))
        for u, ids, text in zip(new, *self.vocab.encode_units(new), strict=True):
            self.young[u] = " ".join(map(self.digits.__getitem__, ids))
            if text != u:
                self.other[u] = text
        end = str(self.vocab.end)
        out = []
        for us in cut:
            shown = us if self.other.keys().isdisjoint(us) else [self.other.get(u, u) for u in us]
            out.append((" ".join([*map(self.young.__getitem__, us), end]), "".join(shown).replace(SPACE, " ")[1:]))
        if len(self.young) > self.kept:
            # Texts of the generation that leaves are found again with their units.
            self.old, self.young = self.young, {}
            self.other = {u: t for u, t in self.other.items() if u in self.old}
        return out


def encode(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """The rows with ``n_tokens``, ``ids`` (decimal, joined by one space, end id last) and ``decoded``.

    Null texts count as empty; equal texts and repeated rows get equal results. Columns of the input that bear one of
    these names are replaced; a text column that is no string is read as one, in a column ``_sp_text`` that must be free.
    """
    kept = docs.drop("n_tokens", "ids", "decoded")
    out = StructType([*kept.schema.fields, *_parse_datatype_string("n_tokens bigint, ids string, decoded string").fields])
    schema = to_arrow_schema(out)
    read, rows = text_col, kept
    if not isinstance(kept.schema[text_col].dataType, StringType):
        read, rows = "_sp_text", kept.withColumn("_sp_text", F.col(text_col).cast("string"))

    def run(batches):
        # A task's units go with it: a worker that kept them would take their memory into later stages.
        code = Encoder(path)
        for batch in ar.slices(batches, read):
            found = code.run(pc.fill_null(batch.column(read), "").to_pylist())
            ids = [x[0] for x in found]
            cols = {"n_tokens": [x.count(" ") + 1 for x in ids], "ids": ids, "decoded": [x[1] for x in found]}
            yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else batch.column(f.name).cast(f.type) for f in schema], schema=schema)

    return rows.mapInArrow(run, out)
