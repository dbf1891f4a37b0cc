"""Byte-pair encoding of whole texts with the `tokenizers` library, by cached units.

A unit is a run of white space with the word after it. Both public vocabularies
cut text at such places whatever stands around, so a text's ids are its units'
ids one after another. A block of texts is split into units, and the units into
a word and the punctuation behind it, in whole arrays; each part is looked up by
a 96-bit hash in a table of at most `CACHE_PARTS` parts that the worker process
keeps, and the library encodes the parts that the table lacks, many at once.
When the table is full, only the parts that were met again stay.

Defined results: null and empty texts have no ids; strings that look like
special tokens are ordinary text; a text of any length is handled in blocks.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

from gavel.llm.words import BLOCK_BYTES, LOWER, hash_sums, mix, range_hash, text_bytes, word_bounds

#: Parts whose ids a worker keeps; a part takes some 45 bytes.
CACHE_PARTS = 1_500_000
_SLOT_BITS = 22
_SIZE_BITS = 6  # longer parts are not kept
_POOL = 1 << 26
#: Parts given to the library in one text.
_TOGETHER = 200
_UNITS = re.compile(r"\s*\S+|\s+")
_ODD = re.compile("[\x1c-\x1f]")
# White space that is not of ASCII, and what only some libraries take for white space.
_ODD_SPACE = re.compile("[" + "".join(map(chr, [*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])) + "]")
#: Bytes that those characters begin with.
_HINT = np.zeros(256, bool)
_HINT[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True
#: Punctuation that is a part of its own behind a letter, in any number.
_BEHIND = np.zeros(256, bool)
_BEHIND[list(b".,!?;:$*%&#|-()\"")] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_TAIL_BYTES = 8
# Kinds of parts: a word at the start of a text or line, a word after one space, white space with what follows, and what has no space before it.
_START, _SPACED, _WHOLE, _TAIL = range(4)


class _Table:
    """ids of parts by their hashes: open addressing in arrays."""

    def __init__(self) -> None:
        self.keys = np.zeros(1 << _SLOT_BITS, np.uint64)
        self.values = np.zeros(1 << _SLOT_BITS, np.uint64)
        self.again = np.zeros(1 << _SLOT_BITS, bool)
        self.pool = np.zeros(1 << 20, np.uint16)
        self.n = self.used = 0

    @staticmethod
    def _slots(key: np.ndarray) -> np.ndarray:
        return (key >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where it isn't kept."""
        slot = self._slots(key)
        held = self.keys[slot]
        found = held == key
        out = np.where(found, slot, -1)
        todo = np.flatnonzero(~found & (held != 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << _SLOT_BITS) - 1)
            held = self.keys[slot[todo]]
            found = held == key[todo]
            out[todo[found]] = slot[todo[found]]
            todo = todo[~found & (held != 0)]
        return out

    def store(self, ids: np.ndarray) -> int:
        """Put ids behind those in the pool; their place."""
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.uint16)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return self.used - len(ids)

    def add(self, key: np.ndarray, value: np.ndarray) -> None:
        """Keep distinct new keys."""
        slot, todo = self._slots(key), np.arange(len(key))
        while len(todo):
            free = self.keys[slot[todo]] == 0
            self.keys[slot[todo[free]]] = key[todo[free]]
            placed = self.keys[slot[todo]] == key[todo]
            self.values[slot[todo[placed]]] = value[todo[placed]]
            todo = todo[~placed]
            slot[todo] = (slot[todo] + 1) & ((1 << _SLOT_BITS) - 1)
        self.n += len(key)

    def make_room(self, parts: int) -> None:
        if self.n + parts <= CACHE_PARTS and self.used < _POOL // 2:
            return
        kept = np.flatnonzero(self.again)
        kept = kept if len(kept) <= CACHE_PARTS // 2 else kept[:0]
        key, value = self.keys[kept], self.values[kept]
        at, size = _place(value)
        ids = self.pool[_spread(at, size)]
        self.keys[:], self.again[:], self.n, self.used = 0, False, 0, 0
        self.store(ids)
        self.add(key, _value(value >> np.uint64(32), np.cumsum(size) - size, size))


def _value(check: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    return (check.astype(np.uint64) << np.uint64(32)) | (at.astype(np.uint64) << np.uint64(_SIZE_BITS)) | size.astype(np.uint64)


def _place(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = (value & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return low >> _SIZE_BITS, low & ((1 << _SIZE_BITS) - 1)


def _spread(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """at, at + 1 .. at + size - 1 of each row, one after another."""
    ends = np.cumsum(size)
    return np.repeat(at - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


class Encoder:
    """ids of texts as unsigned 16-bit numbers; both vocabularies have fewer than 65,536 ids."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True
        if self.plain.get_vocab_size() > 1 << 16:
            raise ValueError("vocabulary has ids of over 16 bits")
        # Vocabularies that drop white space need no account of it, and are of lower case.
        self.spaced = not np.array_equal(self._whole([" b"])[0], self._whole(["b"])[0])
        # What parts units within one text: one id that no unit without these characters has.
        self.mark = "\n" if self.spaced else " \x02 "
        mark = self._whole([self.mark])[0]
        if len(mark) != 1:
            raise ValueError("this vocabulary has no single id for the mark between units")
        self.end = mark[0]
        self.table = _Table()

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint16) for e in self.plain.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, texts: list[str]) -> list[np.ndarray]:
        """ids of texts without the mark, many of them in one text."""
        out: list[np.ndarray] = []
        for at in range(0, len(texts), 20 * _TOGETHER):
            part = texts[at : at + 20 * _TOGETHER]
            flat: list[int] = []
            for e in self.plain.encode_batch_fast([self.mark.join(part[i : i + _TOGETHER]) for i in range(0, len(part), _TOGETHER)], add_special_tokens=False):
                flat += e.ids
                flat.append(int(self.end))
            ids = np.array(flat, np.uint16)
            ends = np.flatnonzero(ids == self.end)
            starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
            out += [ids[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        return out

    def _ask(self, texts: list[str], kind: np.ndarray) -> list[np.ndarray]:
        """The library's ids of parts."""
        out: list[np.ndarray] = [np.zeros(0, np.uint16)] * len(texts)
        bar = self.mark.strip(" ")
        alone = [i for i, k in enumerate(kind.tolist()) if k in (_WHOLE, _TAIL) or bar in texts[i]]
        done = set(alone)
        several = {k: [i for i in np.flatnonzero(kind == k).tolist() if i not in done] for k in (_START, _SPACED)}
        for k, rows in several.items():
            before = " " if k == _SPACED else ""
            for i, ids in zip(rows, self._together([before + texts[i] for i in rows]), strict=True):
                out[i] = ids
        for i, ids in zip(alone, self._whole([(" " if kind[i] == _SPACED else "") + texts[i] for i in alone]), strict=True):
            out[i] = ids
        return out

    def _ids(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of the parts data[begin:end], one after another, and the number of each."""
        wide, narrow = hash_sums(data if self.spaced else LOWER[data])
        key, check = range_hash(wide, narrow, begin, end)
        key = mix(key + kind.astype(np.uint64))
        key[key == 0] = 1
        slot = self.table.find(key)
        value = self.table.values[slot]
        known = (slot >= 0) & ((value >> np.uint64(32)) == check)
        self.table.again[slot[known]] = True
        at, size = _place(value)
        lost = np.flatnonzero(~known)
        if len(lost):
            pair, index, back = np.unique(np.stack([key[lost], check[lost].astype(np.uint64)], 1), axis=0, return_index=True, return_inverse=True)
            rows = lost[index]
            raw = data.tobytes()
            got = self._ask([raw[a:b].decode() for a, b in zip(begin[rows].tolist(), end[rows].tolist(), strict=True)], kind[rows])
            sizes = np.array([len(x) for x in got], np.int64)
            before = self.table.used
            places = self.table.store(np.concatenate(got)) + np.cumsum(sizes) - sizes
            at[lost], size[lost] = places[back.ravel()], sizes[back.ravel()]
            out = self.table.pool[_spread(at, size)]
            keep = (sizes < 1 << _SIZE_BITS) & (slot[rows] < 0)
            keep &= np.append(True, pair[1:, 0] != pair[:-1, 0])
            if before < _POOL - int(sizes.sum()):
                self.table.add(pair[keep, 0], _value(pair[keep, 1], places[keep], sizes[keep]))
            self.table.make_room(len(raw) // 4)
            return out, size
        return self.table.pool[_spread(at, size)], size

    def _parts(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """begin, end and kind of the parts of texts, and each text's first part with a closing total."""
        begin, end, first = word_bounds(data, off)
        doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
        kind = np.zeros(len(begin), np.int8)
        line = np.zeros(len(begin), bool)
        if self.spaced:
            last = np.append(0, end[:-1])
            head = first[:-1][np.diff(first) > 0]
            last[head] = off[doc[head]]
            gap = begin - last
            sep = data[begin - 1]
            line = (gap == 1) & (sep == 0x0A)
            kind = np.where((gap == 0) | line, _START, np.where((gap == 1) & (sep == 0x20), _SPACED, _WHOLE)).astype(np.int8)
            begin = np.where(kind == _WHOLE, last, begin)
        stop = end.copy()
        at = np.flatnonzero(_BEHIND[data[end - 1]] & (kind != _WHOLE)) if len(end) else np.zeros(0, np.int64)
        for _ in range(_TAIL_BYTES):
            at = at[_BEHIND[data[stop[at] - 1]] & (stop[at] > begin[at])]
            stop[at] -= 1
        cut = np.flatnonzero(stop < end)
        final = data[stop[cut] - 1]
        lead = data[np.maximum(stop[cut] - 2, 0)]
        two = (final >= 0x80) & (final < 0xC0) & (lead >= 0xC3) & (lead <= 0xC8) & (stop[cut] - 2 >= begin[cut])
        two &= ~((lead == 0xC3) & ((final == 0x97) | (final == 0xB7))) & ~((lead == 0xC4) & (final == 0xB0))
        whole = cut[~((stop[cut] > begin[cut]) & (_LETTER[final] | two))]
        stop[whole] = end[whole]
        tail = stop < end
        # White space after the last word of a text.
        rest = np.zeros(0, np.int64)
        if self.spaced:
            close = off[:-1].copy()
            some = np.flatnonzero(np.diff(first) > 0)
            close[some] = end[first[1:][some] - 1]
            rest = np.flatnonzero(close < off[1:])
        place = np.arange(len(begin)) + np.cumsum(line) + np.cumsum(tail) - tail + np.searchsorted(rest, doc)
        n = len(begin) + int(line.sum()) + int(tail.sum()) + len(rest)
        b, e, k = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, _TAIL, np.int8)
        b[place], e[place], k[place] = begin, stop, kind
        b[place[line] - 1], e[place[line] - 1] = begin[line] - 1, begin[line]
        b[place[tail] + 1], e[place[tail] + 1] = stop[tail], end[tail]
        start = np.append(place - line, n)
        firsts = start[first]
        if len(rest):
            # Before the rest of a text stand its own parts and those of the texts before.
            count = np.bincount(doc, 1 + line + tail, len(off) - 1).astype(np.int64) if len(doc) else np.zeros(len(off) - 1, np.int64)
            count[rest] += 1
            firsts = np.concatenate([[0], np.cumsum(count)])
            at = firsts[1:][rest] - 1
            b[at], e[at], k[at] = close[rest], off[1:][rest], _WHOLE
        return b, e, k, firsts

    def _block(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, off = text_bytes(text)
        odd: list[int] = []
        if self.spaced and len(data):
            hint = np.flatnonzero(_HINT[data])
            rows = np.unique(np.searchsorted(off, hint, "right") - 1)
            odd = [i for i in rows.tolist() if _ODD_SPACE.search(data[off[i] : off[i + 1]].tobytes().decode())]
        if not odd:
            b, e, k, firsts = self._parts(data, off)
            ids, size = self._ids(data, b, e, k)
            return ids, np.concatenate([[0], np.cumsum(size)])[firsts]
        # White space beyond ASCII parts units, too; these texts are split one by one.
        out, counts = [], []
        held = set(odd)
        for i in range(len(off) - 1):
            own = data[off[i] : off[i + 1]]
            if i not in held:
                b, e, k, _ = self._parts(own, np.array([0, len(own)]))
                ids = self._ids(own, b, e, k)[0]
            elif _ODD.search(s := own.tobytes().decode()):
                ids = self._whole([s])[0]
            else:
                ends = np.cumsum([len(u.encode()) for u in _UNITS.findall(s)])
                ids = self._ids(own, np.append(0, ends[:-1]), ends, np.full(len(ends), _WHOLE, np.int8))[0]
            out.append(ids)
            counts.append(len(ids))
        return np.concatenate(out), np.concatenate([[0], np.cumsum(counts)])

    def encode(self, text: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """ids of a block of texts, one after another, and each text's first with a closing total; end: an id behind each text."""
        if len(text) == 1 and text[0].is_valid and len(text[0].as_buffer()) > 2 * BLOCK_BYTES:
            ids = np.concatenate([self._block(pa.array([piece]))[0] for piece in _pieces(text[0].as_buffer().to_pybytes())])
            first = np.array([0, len(ids)])
        else:
            ids, first = self._block(text)
        if end is not None:
            ids, first = np.insert(ids, first[1:], np.uint16(end)), first + np.arange(len(first))
        return ids, first


def _pieces(raw: bytes) -> list[str]:
    """A long text cut where a letter or figure is followed by one space, into pieces of about a block."""
    out, at = [], 0
    cut = re.compile(rb"[0-9A-Za-z](?= [!-~])")
    while len(raw) - at > BLOCK_BYTES:
        found = cut.search(raw, at + BLOCK_BYTES)
        if not found:
            break
        out.append(raw[at : found.end()].decode())
        at = found.end()
    return [*out, raw[at:].decode()]


_LOADED: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]

