"""Token ids of whole texts by the tokenizers library, each distinct word encoded once a worker.

The byte-level pre-tokenizer always starts a new piece at a single space between two characters that are no
white space. So a text is cut there, and its ids are the ids of its space-led words laid end to end. A worker
keeps the bytes and ids of the words it has met under a 64-bit hash, in flat arrays of at most MEMO_WORDS words,
MEMO_BYTES bytes and MEMO_IDS ids, then starts anew. Every word found by its hash is compared with the kept bytes;
one that differs is encoded by itself, so a clash of hashes changes nothing. Runs of white space, and any space
beside a character that may be Unicode white space, stay inside one word.
"""

from __future__ import annotations

import os

import numpy as np

from .words import U, span_hashes

MEMO_WORDS = 2_400_000
MEMO_BYTES = 48_000_000
MEMO_IDS = 16_000_000
AT_ONCE = 8192
_loaded: dict[str, WordEncoder] = {}

#: ASCII white space and separators; leading bytes of three-byte characters some of which are white space.
_ASCII_SPACE = [9, 10, 11, 12, 13, 28, 29, 30, 31, 32]
_WIDE_LEADS = [0xE1, 0xE2, 0xE3]
_SPACE = np.zeros(256, bool)
_SPACE[_ASCII_SPACE] = True
_WIDE = np.zeros(256, bool)
_WIDE[_WIDE_LEADS] = True


def word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where a text or one of its space-led words begins."""
    at = np.flatnonzero(data == 32)
    at = at[(at > 0) & (at < len(data) - 1)]
    after, before = data[at + 1], data[at - 1]
    twice = np.minimum(at + 2, len(data) - 1)
    c2 = (after == 0xC2) & ((data[twice] == 0x85) | (data[twice] == 0xA0))
    c2 |= (data[np.maximum(at - 2, 0)] == 0xC2) & ((before == 0x85) | (before == 0xA0))
    wide = _WIDE[after] | _WIDE[data[np.maximum(at - 3, 0)]]
    at = at[~(_SPACE[after] | _SPACE[before] | c2 | wide)]
    begins = np.zeros(len(data), bool)
    begins[at] = True
    begins[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
    return np.flatnonzero(begins)


class WordEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # a text cannot forge control ids
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(1 << 16, U)  # 0 marks a free slot
        self.word = np.zeros(1 << 16, np.int32)  # the number of the slot's word
        self.ids, self.id_at = np.zeros(1 << 18, f"<u{self.width}"), np.zeros(1 << 16, np.uint32)  # word k: ids[id_at[k]:id_at[k + 1]]
        self.bytes, self.byte_at = np.zeros(1 << 18, np.uint8), np.zeros(1 << 16, np.uint32)
        self.words = 0

    def _full(self) -> bool:
        return self.words > MEMO_WORDS or self.id_at[self.words] > MEMO_IDS or self.byte_at[self.words] > MEMO_BYTES

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The word under each key, or -1."""
        mask = U(len(self.keys) - 1)
        slot = (keys & mask).astype(np.int64)
        out = np.full(len(keys), -1, np.int32)
        open_ = np.arange(len(keys))
        while len(open_):
            held = self.keys[slot]
            hit = held == keys[open_]
            out[open_[hit]] = self.word[slot[hit]]
            go = ~hit & (held != 0)
            open_, slot = open_[go], (slot[go] + 1) & int(mask)
        return out

    def _insert(self, keys: np.ndarray, word: np.ndarray) -> None:
        mask = len(self.keys) - 1
        slot = (keys & U(mask)).astype(np.int64)
        while len(keys):
            free = self.keys[slot] == 0
            first = np.zeros(len(keys), bool)
            _, where = np.unique(slot[free], return_index=True)
            first[np.flatnonzero(free)[where]] = True
            self.keys[slot[first]] = keys[first]
            self.word[slot[first]] = word[first]
            keys, word, slot = keys[~first], word[~first], slot[~first]
            slot = np.where(self.keys[slot] != 0, (slot + 1) & mask, slot)

    def _coded(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids) of the byte ranges, by the library."""
        raw, size, ids = data.tobytes(), np.zeros(len(start), np.int64), [np.zeros(0, self.ids.dtype)]
        for lo in range(0, len(start), AT_ONCE):  # the library's answers are large objects
            words = [raw[a:b].decode("utf-8", "replace") for a, b in zip(start[lo : lo + AT_ONCE].tolist(), end[lo : lo + AT_ONCE].tolist(), strict=True)]
            coded = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            size[lo : lo + len(coded)] = [len(row) for row in coded]
            ids.append(np.fromiter((i for row in coded for i in row), self.ids.dtype))
        return np.concatenate(ids), size

    def _learn(self, data: np.ndarray, keys: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        ids, size = self._coded(data, start, end)
        n, more = self.words, len(keys)
        raw = data[_spread(start, end - start)]
        self.ids = _put(self.ids, int(self.id_at[n]), ids)
        self.bytes = _put(self.bytes, int(self.byte_at[n]), raw)
        self.id_at = _put(self.id_at, n + 1, self.id_at[n] + np.cumsum(size))
        self.byte_at = _put(self.byte_at, n + 1, self.byte_at[n] + np.cumsum(end - start))
        if 5 * (n + more) > 3 * len(self.keys):
            held = np.flatnonzero(self.keys)
            old = self.keys[held], self.word[held]
            slots = len(self.keys)
            while 5 * (n + more) > 3 * slots:
                slots *= 2
            self.keys, self.word = np.zeros(slots, U), np.zeros(slots, np.int32)
            self._insert(*old)
        self._insert(keys, np.arange(n, n + more, dtype=np.int32))
        self.words += more

    def _strangers(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Which of the byte ranges, which lie end to end, are not the bytes of the words found for them."""
        size, at = end - start, self.byte_at[word].astype(np.int64)
        out = self.byte_at[word + 1] - at != size
        if out.any():
            return out | np.array([not o and not np.array_equal(data[a:b], self.bytes[p : p + b - a]) for a, b, p, o in zip(start, end, at, out, strict=True)])
        differs = self.bytes[_spread(at, size)] != data
        return np.logical_or.reduceat(differs, start) if differs.any() else out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): text i of the chunk has ``ids[bounds[i]:bounds[i+1]]``."""
        start = word_starts(data, offsets)
        end = np.append(start[1:], len(data)) if len(start) else start
        keys = span_hashes(data, start, end)
        keys[keys == 0] = U(1)
        if self._full():
            self._clear()
        word = self._find(keys)
        if (word < 0).any():
            lost = np.flatnonzero(word < 0)
            fresh, where = np.unique(keys[lost], return_index=True)
            self._learn(data, fresh, start[lost[where]], end[lost[where]])
            word[lost] = self._find(keys[lost])
        place = self.id_at[word].astype(np.int64)
        size, ids = self.id_at[word + 1] - place, self.ids
        strange = np.flatnonzero(self._strangers(data, start, end, word))
        if len(strange):
            own, size[strange] = self._coded(data, start[strange], end[strange])
            place[strange] = len(ids) + np.cumsum(size[strange]) - size[strange]
            ids = np.concatenate([ids, own])
        upto = np.concatenate([[0], np.cumsum(size)])
        return ids[_spread(place, size)], upto[np.searchsorted(start, offsets)]


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each size, end to end."""
    upto = np.cumsum(size)
    return np.repeat(first - (upto - size), size) + np.arange(upto[-1] if len(upto) else 0)


def _put(held: np.ndarray, at: int, more: np.ndarray) -> np.ndarray:
    """``held`` with ``more`` from ``at`` on, grown by doubling."""
    while at + len(more) > len(held):
        held = np.concatenate([held, np.zeros_like(held)])
    held[at : at + len(more)] = more
    return held


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _loaded:
        _loaded[path] = WordEncoder(path)
    return _loaded[path]


def forget() -> None:
    """Drop this worker's encoders and the words they know."""
    _loaded.clear()


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The same texts with ``end_id`` after each."""
    n = len(bounds) - 1
    out = np.full(len(ids) + n, end_id, ids.dtype)
    keep = np.ones(len(out), bool)
    new = bounds + np.arange(n + 1)
    keep[new[1:] - 1] = False
    out[keep] = ids
    return out, new
