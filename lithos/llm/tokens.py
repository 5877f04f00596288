"""Token ids of whole texts with the tokenizers library.

Byte-pair merges never cross the pieces that a tokenizer's pre-tokenizer cuts.
So texts are cut at places where every pre-tokenizer here cuts too, the library
encodes each distinct unit once, many to a call with an added token between
them, and a text's ids are its units' ids joined. Cutting, lookup and joining
are numpy passes over a whole batch. Texts with rarer forms of white space,
where a blank may belong to the piece before it, go to the library whole.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

import numpy as np
import pyarrow as pa

from .batches import FIRST, LONG, loads, padded, span_hashes, text_bytes

U64 = np.uint64
#: Units, and their bytes, that one Python worker remembers before it starts afresh.
UNITS, UNIT_BYTES = 1 << 20, 1 << 25

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in ".,;:!?"]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def resolve(path_or_name: str) -> str:
    """A file of its own, or the name of a public tokenizer's file."""
    if os.sep in path_or_name:
        return path_or_name
    import public_tokenizers

    return public_tokenizers.path(path_or_name)


class _Table:
    """64-bit keys to row numbers by open addressing, a batch at a time."""

    def __init__(self, bits: int):
        self.mask = U64((1 << bits) - 1)
        self.keys, self.rows = np.zeros(1 << bits, U64), np.zeros(1 << bits, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row numbers, -1 where a key is not there."""
        out = np.full(len(keys), -1, np.int32)
        open_, slot = np.arange(len(keys)), keys & self.mask
        while len(open_):
            have = self.keys[slot]
            hit = have == keys[open_]
            out[open_[hit]] = self.rows[slot[hit]]
            on = ~hit & (have != 0)
            open_, slot = open_[on], (slot[on] + U64(1)) & self.mask
        return out

    def put(self, keys: np.ndarray, rows: np.ndarray) -> None:
        """Adds distinct keys that are not there yet."""
        slot = keys & self.mask
        while len(keys):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[free]
            mine = self.keys[slot] == keys
            self.rows[slot[mine]] = rows[mine]
            keys, rows, slot = keys[~mine], rows[~mine], (slot[~mine] + U64(1)) & self.mask


class Encoder:
    """Ids of texts. Control strings inside a text are ordinary text.

    blank_leads: the tokenizer keeps a blank at the front of the piece after it
    (byte-level); otherwise it drops white space and folds case.
    """

    _made: dict[tuple[str, bool], Encoder] = {}

    @classmethod
    def of(cls, path: str, blank_leads: bool) -> Encoder:
        """One per worker process."""
        if (path, blank_leads) not in cls._made:
            cls._made[path, blank_leads] = cls(path, blank_leads)
        return cls._made[path, blank_leads]

    @classmethod
    def release(cls) -> None:
        """Frees what this worker remembers, for tasks of other kinds."""
        if cls._made:
            cls._made.clear()
            pa.default_memory_pool().release_unused()

    def __init__(self, path: str, blank_leads: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.blank_leads = blank_leads
        self.model = Tokenizer.from_file(resolve(path))
        added = {t.content: i for i, t in self.model.get_added_tokens_decoder().items() if t.special}
        self.mark, self.mark_id = max(added.items(), key=lambda x: x[1])
        self.marks = list(added)
        self.dtype = np.dtype("<u2") if self.model.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self._forget()

    def _forget(self) -> None:
        self.table = _Table(21)
        self.n, self.used = 0, 0
        self.start, self.ids = np.zeros(1 << 16, np.int64), np.zeros(1 << 18, self.dtype)
        # the bytes of every unit, by row; units that the table cannot hold are known by their bytes alone
        self.at, self.size, self.bytes, self.filled = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 19, np.uint8), 0
        self.odd: dict[bytes, int] = {}

    def whole(self, texts: Sequence[str]) -> list[np.ndarray]:
        """Straight from the library, a call for the whole text."""
        self.model.encode_special_tokens = True
        try:
            return [np.array(e.ids, self.dtype) for e in self.model.encode_batch_fast(list(texts), add_special_tokens=False)]
        finally:
            self.model.encode_special_tokens = False

    def _units(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of units, and which texts must go whole."""
        n = len(data)
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        blank, letter, sign = _BLANK[data], _LETTER[data], _SIGN[data]
        two = np.flatnonzero(data == 0xC3)
        two = two[two + 1 < n]
        two = two[(data[two + 1] != 0x97) & (data[two + 1] != 0xB7)]
        letter[two] = letter[two + 1] = True
        cut = edge.copy()
        inner = (letter[:-1] & sign[1:]) | (sign[:-1] & letter[1:])
        whole = np.zeros(len(off) - 1, bool)
        if self.blank_leads:
            inner |= blank[1:] | (data[:-1] == 0x0A)
            cut[1:n] |= inner
            # a blank or line end alone between two other characters, else whole
            odd = blank & (data != 0x20) & (data != 0x0A)
            near = blank.copy()
            near[1:] &= blank[:-1] | edge[1:n]
            near[:-1] |= blank[:-1] & (blank[1:] | edge[1:n])
            near[-1] |= blank[-1]
            odd |= near
            lead = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))  # white space beyond ASCII starts so
            if len(lead):
                a, b = data[np.minimum(lead + 1, n - 1)], data[np.minimum(lead + 2, n - 1)]
                d = data[lead]
                odd[lead[((d == 0xC2) & ((a == 0xA0) | (a == 0x85))) | ((d == 0xE2) & ((a == 0x80) | (a == 0x81)) & (b >= 0x80)) | ((d == 0xE3) & (a == 0x80) & (b == 0x80)) | ((d == 0xE1) & (a == 0x9A) & (b == 0x80))]] = True
            at = np.flatnonzero(odd)
            whole[np.searchsorted(off, at, "right") - 1] = True
            starts = np.flatnonzero(cut[:n])
            return starts, np.r_[starts[1:], n], whole
        cut[1:n] |= inner | (blank[:-1] != blank[1:])
        starts = np.flatnonzero(cut[:n])
        ends = np.r_[starts[1:], n]
        keep = ~blank[starts]
        return starts[keep], ends[keep], whole

    def _same(self, rows: np.ndarray, starts: np.ndarray, size: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Whether the spans have the very bytes of the units in those rows; spans of at most ``LONG`` bytes."""
        here, known = loads(data), loads(self.bytes)
        at, t = self.at[rows], 8
        out = (here[starts] ^ known[at]) & FIRST[np.minimum(size, 8)] == 0
        out &= self.size[rows] == size
        more = np.flatnonzero(out & (size > 8))
        while len(more):
            out[more] = (here[starts[more] + t] ^ known[at[more] + t]) & FIRST[np.minimum(size[more] - t, 8)] == 0
            t += 8
            more = more[out[more] & (size[more] > t)]
        return out

    def _learn(self, starts: np.ndarray, ends: np.ndarray, data: np.ndarray, folded: np.ndarray) -> np.ndarray:
        """Encodes distinct units and returns their rows."""
        raw = data.tobytes()
        units = [raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        alone = [i for i, u in enumerate(units) if "<" in u and any(m in u for m in self.marks)]
        got: dict[int, np.ndarray] = dict(zip(alone, self.whole([units[i] for i in alone]), strict=True)) if alone else {}
        for i in alone:
            units[i] = ""
        flat, sizes = [], []
        for at in range(0, len(units), 512):
            part = units[at : at + 512]
            ids = np.array(self.model.encode_batch_fast([self.mark.join(part)], add_special_tokens=False)[0].ids, np.uint32)
            cut = np.flatnonzero(ids == self.mark_id)
            if len(cut) != len(part) - 1:
                raise ValueError("an added token's string was not recognised")
            flat.append(ids[ids != self.mark_id])
            sizes.append(np.diff(np.r_[-1, cut, len(ids)]) - 1)
        ids, size = np.concatenate(flat).astype(self.dtype), np.concatenate(sizes)
        for i in sorted(got):
            ids = np.insert(ids, int(size[:i].sum()), got[i])
            size[i] = len(got[i])
        k, span = len(starts), ends - starts
        while self.n + k + 1 > len(self.start):
            self.start, self.at, self.size = (np.r_[x, np.zeros_like(x)] for x in (self.start, self.at, self.size))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.r_[self.ids, np.zeros_like(self.ids)]
        total = int(span.sum())
        while self.filled + total + 8 > len(self.bytes):
            self.bytes = np.r_[self.bytes, np.zeros_like(self.bytes)]
        before = np.r_[0, np.cumsum(span)]
        self.bytes[self.filled : self.filled + total] = folded[np.repeat(starts - before[:-1], span) + np.arange(total)]
        self.at[self.n : self.n + k], self.size[self.n : self.n + k] = self.filled + before[:-1], span
        self.ids[self.used : self.used + len(ids)] = ids
        self.start[self.n : self.n + k + 1] = self.used + np.r_[0, np.cumsum(size)]
        rows = np.arange(self.n, self.n + k, dtype=np.int32)
        self.n += k
        self.used += len(ids)
        self.filled += total
        return rows

    def _rows(self, starts: np.ndarray, ends: np.ndarray, data: np.ndarray) -> np.ndarray:
        """The row of every unit, by its bytes: a hit in the table counts only if all bytes agree."""
        folded = padded(data, not self.blank_leads)
        size = ends - starts
        keys = span_hashes(folded, starts, size) | U64(1)
        rows = self.table.find(keys)
        short = size <= LONG
        new = np.flatnonzero(short & (rows < 0))
        if len(new):
            fresh, first = np.unique(keys[new], return_index=True)
            at = new[first]
            self.table.put(fresh, self._learn(starts[at], ends[at], data, folded))
            rows[new] = self.table.find(keys[new])
        if short.all():
            good = self._same(rows, starts, size, folded)
        else:
            good = short.copy()
            good[short] = self._same(rows[short], starts[short], size[short], folded)
        fresh_, place = {}, []
        rest = np.flatnonzero(~good)
        for i in rest.tolist():
            b = folded[starts[i] : ends[i]].tobytes()
            place.append(b)
            if b not in self.odd:
                fresh_.setdefault(b, i)
        if fresh_:
            at = np.array(list(fresh_.values()))
            self.odd.update(zip(fresh_, self._learn(starts[at], ends[at], data, folded).tolist(), strict=True))
        rows[rest] = [self.odd[b] for b in place]
        return rows

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, one after the other, and each text's offsets among them; null texts are empty."""
        data, off = text_bytes(texts)
        n = len(data)
        if not n:
            return np.zeros(0, self.dtype), np.zeros(len(off), np.int64)
        starts, ends, whole = self._units(data, off)
        of = np.searchsorted(off, starts, "right") - 1
        if whole.any():
            keep = ~whole[of]
            starts, ends, of = starts[keep], ends[keep], of[keep]
        if self.n > UNITS or self.filled > UNIT_BYTES:
            self._forget()
        rows = self._rows(starts, ends, data)
        size = self.start[rows + 1] - self.start[rows]
        before = np.r_[0, np.cumsum(size)]
        ids = self.ids[np.repeat(self.start[rows] - before[:-1], size) + np.arange(before[-1])]
        out = before[np.searchsorted(of, np.arange(len(off)))]
        if whole.any():
            places = np.flatnonzero(whole)
            own = self.whole([(texts[int(i)].as_py() or "") for i in places])
            sizes = np.diff(out)
            ids = np.insert(ids, np.repeat(out[places], [len(x) for x in own]), np.concatenate(own))
            sizes[places] = [len(x) for x in own]
            out = np.r_[0, np.cumsum(sizes)]
        return ids, out

    def encode(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        ids, off = self.encode_array(pa.array(texts, pa.string()))
        return [ids[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
