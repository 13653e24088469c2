"""Failure-link automaton over the bytes of a set of terms, run over many texts at once.

The trie lies in two arrays: a state is a slot, its child by byte ``c`` is the slot ``base[state] + c`` if that slot's
``check`` names the state. Matching steps through pieces of all texts of a batch together, so a step is a handful of
array operations whatever the number of terms. UTF-8 keeps characters apart, so matches of bytes are matches of text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE, BATCH = 256, 2 << 20
_WINDOW = 512


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text column; null counts as empty."""
    col = pc.fill_null(col, "").cast(pa.large_string())
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    bounds = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def cuts(size: np.ndarray, limit: int = BATCH) -> Iterator[tuple[int, int]]:
    """Ranges of rows of these sizes that come to ``limit`` at most, or hold one row."""
    total, at = np.cumsum(size), 0
    while at < len(total):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + limit, "right")))
        yield at, end
        at = end


def text_bytes(col: pa.Array) -> np.ndarray:
    """Bytes of each text; null counts as empty."""
    return pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)


class Automaton:
    """All occurrences of ``terms`` (distinct, not empty); a match names a term by its place in that sequence."""

    def __init__(self, terms: Sequence[str]):
        coded = [t.encode() for t in terms]
        order = sorted(range(len(coded)), key=coded.__getitem__)
        lengths = np.array([len(coded[i]) for i in order], np.int64)
        data = np.frombuffer(b"".join(coded[i] for i in order), np.uint8)
        begin = np.cumsum(lengths) - lengths
        self.lengths = np.zeros(len(coded), np.int64)
        self.lengths[order] = lengths
        self.longest = int(lengths.max(initial=0))
        levels, last, count = self._trie(data, begin, lengths)
        slot = self._place(levels, count)
        self.own = np.full(len(self.base), -1, np.int32)
        self.own[slot[last]] = order
        self._link(levels, slot)

    @staticmethod
    def _trie(data, begin, lengths):
        """Edges (parent, byte, child) level by level, the last state of each term, the number of states; root is 0."""
        at, levels, count, live = np.zeros(len(lengths), np.int64), [], 1, np.arange(len(lengths))
        depth = 0
        while len(live):
            live = live[lengths[live] > depth]
            if not len(live):
                break
            parent, byte = at[live], data[begin[live] + depth]
            # Sorted terms keep those with one beginning together.
            new = np.append(True, (parent[1:] != parent[:-1]) | (byte[1:] != byte[:-1]))
            child = count + np.cumsum(new) - 1
            levels.append((parent[new], byte[new].astype(np.int64), child[new]))
            at[live] = child
            count += int(new.sum())
            depth += 1
        return levels, at, count

    def _place(self, levels, count) -> np.ndarray:
        """Slots for all states. States with several children look for a base that fits; single children fill the gaps."""
        slot = np.zeros(count, np.int64)
        base_of = np.zeros(count, np.int64)
        if not levels:
            self.base, self.check = np.zeros(257, np.int32), np.full(257, -1, np.int32)
            return slot
        parent, byte, child = (np.concatenate(x) for x in zip(*levels, strict=True))
        used = np.zeros(2 * count + 2 * _WINDOW + 512, bool)
        # The root is slot 0, and no child may come to lie there.
        used[0] = True
        first = np.flatnonzero(np.append(True, parent[1:] != parent[:-1]))
        size = np.diff(np.append(first, len(parent)))
        # Each number of children goes on looking where it last found room.
        low: dict[int, int] = {}
        for i, n in zip(first[size > 1].tolist(), size[size > 1].tolist(), strict=True):
            bytes_ = byte[i : i + n]
            start = low.get(n, 1)
            while True:
                if start + _WINDOW + 512 > len(used):
                    used = np.append(used, np.zeros(len(used), bool))
                bases = np.flatnonzero(~used[start : start + _WINDOW]) + (start - bytes_[0])
                bases = bases[bases >= 0]
                for c in bytes_[1:]:
                    bases = bases[~used[bases + c]]
                if len(bases):
                    break
                start += _WINDOW
            low[n] = start
            b = int(bases[0])
            base_of[parent[i]] = b
            used[b + bytes_] = True
            slot[child[i : i + n]] = b + bytes_
        single = first[size == 1]
        free = np.flatnonzero(~used[256:])[: len(single)] + 256
        if len(free) < len(single):
            free = np.append(free, np.arange(len(used), len(used) + len(single) - len(free)))
        slot[child[single]] = free
        base_of[parent[single]] = free - byte[single]
        room = int(max(slot.max(), base_of.max())) + 257
        self.base, self.check = np.zeros(room, np.int32), np.full(room, -1, np.int32)
        self.base[slot] = base_of
        self.check[slot[child]] = slot[parent]
        return slot

    def _link(self, levels, slot) -> None:
        """``fail``: the longest proper ending that is a state; ``link``: the nearest of those that ends a term."""
        self.fail, self.link = np.zeros(len(self.base), np.int32), np.zeros(len(self.base), np.int32)
        for depth, (parent, byte, child) in enumerate(levels):
            states = slot[child]
            if depth:
                self.fail[states] = self._step(self.fail[slot[parent]].astype(np.int64), byte)
            fail = self.fail[states]
            self.link[states] = np.where(self.own[fail] >= 0, fail, self.link[fail])
        self.tells = (self.own >= 0) | (self.link > 0)

    def _step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Next states; where no child fits, the failure links are followed down to the root."""
        after = self.base[state] + byte
        open_ = np.flatnonzero(self.check[after] != state)
        while len(open_):
            now = state[open_]
            rooted = now == 0
            after[open_[rooted]] = 0
            open_ = open_[~rooted]
            shorter = self.fail[now[~rooted]]
            state[open_] = shorter
            tried = self.base[shorter] + byte[open_]
            after[open_] = tried
            open_ = open_[self.check[tried] != shorter]
        return after

    def find(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, first byte within all data, and term of every occurrence in rows ``offsets[i]:offsets[i+1]``."""
        size = np.diff(offsets)
        stride = max(PIECE, 2 * self.longest)
        pieces = -(-size // stride)
        row = np.repeat(np.arange(len(size)), pieces)
        place = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = offsets[:-1][row] + place * stride
        # A piece reads on for a term that begins in it; it tells only of those.
        length = np.minimum(stride + self.longest - 1, offsets[1:][row] - begin)
        order = np.argsort(-length, kind="stable")
        row, begin, length = row[order], begin[order], length[order]
        longer = np.searchsorted(-length, -np.arange(int(length.max(initial=0))), side="left")
        state, found = np.zeros(len(row), np.int64), []
        for t, n in enumerate(longer.tolist()):
            state = self._step(state[:n], data[begin[:n] + t]).astype(np.int64)
            told = np.flatnonzero(self.tells[state])
            if len(told):
                found.append((told, np.full(len(told), t), state[told]))
        if not found:
            none = np.zeros(0, np.int64)
            return none, none, none
        piece, t, state = (np.concatenate(x) for x in zip(*found, strict=True))
        out = []
        while len(piece):
            term = self.own[state]
            real = term >= 0
            out.append((piece[real], t[real], term[real]))
            state = self.link[state]
            more = state > 0
            piece, t, state = piece[more], t[more], state[more]
        piece, t, term = (np.concatenate(x) for x in zip(*out, strict=True))
        into = t + 1 - self.lengths[term]
        mine = into < stride
        return row[piece[mine]], (begin[piece] + into)[mine], term[mine].astype(np.int64)
