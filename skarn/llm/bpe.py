"""Token ids of many texts at once for a lower-casing byte-pair vocabulary with word ends.

The tokenizer splits normalised text into words of letters, single digits and runs of
other characters, drops white space, and merges bytes inside each word. Here the words of
a batch are found and hashed by passes over its bytes; a table keeps the ids of the words
seen; new words are merged all together, one merge of every word a round. Texts with
characters beyond ASCII and the Latin-1 letters, with apostrophes or with special tokens
take the tokenizer itself, word by word.
"""

from __future__ import annotations

import json
import string

import numpy as np

from .words import fresh_key, hashes

_NONE = np.int32(1 << 30)
SPACE, LETTER, DIGIT, OTHER = 0, 1, 2, 3
#: Longest word that is merged in rounds; longer ones take the tokenizer.
LONGEST = 40
#: log2 of the slots of a worker's word table, which is emptied at half load.
SLOTS = 21


def _classes() -> tuple[np.ndarray, np.ndarray]:
    kind = np.full(256, OTHER, np.uint8)
    kind[[0x20, *range(9, 14)]] = SPACE
    kind[[*range(65, 91), *range(97, 123)]] = LETTER
    kind[48:58] = DIGIT
    kind[128:] = LETTER
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    return kind, low


_KIND, _LOW = _classes()


def _byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


class Ids:
    """ids(texts) gives each text's token ids as little-endian 32-bit bytes."""

    _own: dict[str, "Ids"] = {}

    @classmethod
    def of(cls, path: str) -> "Ids":
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.key = fresh_key()  # of this worker's table of words
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        chars = _byte_chars()
        self.inner = np.array([vocab[c] for c in chars], np.int32)
        self.last = np.array([vocab[c + end] for c in chars], np.int32)
        pairs = [(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.cores: dict[str, bytes] = {}
        self._empty()

    def _empty(self) -> None:
        self.slot = np.zeros(1 << SLOTS, np.uint64)
        self.at = np.zeros(1 << SLOTS, np.int32)
        self.first = [np.zeros(1, np.int64)]
        self.starts = np.zeros(1, np.int64)
        self.pool = np.zeros(0, np.uint32)

    # merging

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.int64) << 32) | b
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[i] == key) & (a >= 0) & (b >= 0), self.ranks[i], _NONE)

    def merge(self, data: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, ids of each word) of lower-cased words of at most LONGEST bytes."""
        n, width = len(first), int(size.max())
        cols = np.arange(width)
        inside = cols < size[:, None]
        raw = data[np.minimum(first[:, None] + cols, len(data) - 1)]
        tokens = np.where(inside, self.inner[raw], np.int32(-1))
        tokens[np.arange(n), size - 1] = self.last[raw[np.arange(n), size - 1]]
        ids = np.full((n, width), -1, np.int32)
        where = np.arange(n)
        ranks = np.full((n, width), _NONE, np.int32)
        if width > 1:
            ok = cols[:-1] < (size - 1)[:, None]
            ranks[:, :-1][ok] = self._rank(tokens[:, :-1][ok], tokens[:, 1:][ok])
        while len(where):
            pos = ranks.argmin(1)
            row = np.arange(len(where))
            best = ranks[row, pos]
            done = best == _NONE
            if done.any():
                ids[where[done]] = tokens[done]
                more = ~done
                tokens, ranks, where, pos, best = tokens[more], ranks[more], where[more], pos[more], best[more]
                row = np.arange(len(where))
                if not len(where):
                    break
            tokens[row, pos] = self.made[best]
            tail = cols[:-1] > pos[:, None]
            np.copyto(tokens[:, :-1], tokens[:, 1:].copy(), where=tail)
            np.copyto(ranks[:, :-1], ranks[:, 1:].copy(), where=cols[:-1] >= pos[:, None])
            tokens[:, -1] = -1
            ranks[:, -1] = _NONE
            right = np.where(pos + 1 < width, tokens[row, np.minimum(pos + 1, width - 1)], -1)
            ranks[row, pos] = self._rank(tokens[row, pos], right)
            has = pos > 0
            ranks[row[has], pos[has] - 1] = self._rank(tokens[row[has], pos[has] - 1], tokens[row[has], pos[has]])
        return ids[ids >= 0].astype(np.uint32), (ids >= 0).sum(1)

    # the table of words

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Word numbers, 0 where a hash is new."""
        mask = np.uint64((1 << SLOTS) - 1)
        out = np.zeros(len(h), np.int32)
        todo, place = np.arange(len(h)), (h & mask).astype(np.int64)
        while len(todo):
            here = self.slot[place]
            same = here == h[todo]
            out[todo[same]] = self.at[place[same]]
            go = ~same & (here != 0)
            todo, place = todo[go], (place[go] + 1) & int(mask)
        return out

    def _insert(self, h: np.ndarray, numbers: np.ndarray) -> None:
        mask = (1 << SLOTS) - 1
        todo, place = np.arange(len(h)), (h & np.uint64(mask)).astype(np.int64)
        while len(todo):
            free = self.slot[place] == 0
            # of several that want one slot the first in line takes it
            _, one = np.unique(place, return_index=True)
            win = np.zeros(len(todo), bool)
            win[one] = True
            win &= free
            self.slot[place[win]] = h[todo[win]]
            self.at[place[win]] = numbers[todo[win]]
            todo, place = todo[~win], place[~win]
            taken = self.slot[place] != 0
            place = np.where(taken, (place + 1) & mask, place)

    def _fast(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, ids of each row) of rows that hold plain characters only."""
        n = len(data)
        low = _LOW[data]
        lead = np.flatnonzero(data == 0xC3) + 1
        up = lead[(data[lead] >= 0x80) & (data[lead] <= 0x9E)]
        low[up] += 0x20
        kind = _KIND[data]
        edge = np.empty(n + 1, bool)
        edge[0] = edge[n] = True
        np.not_equal(kind[1:], kind[:-1], out=edge[1:n])
        edge[:n] |= kind == DIGIT
        edge[offsets] = True
        at = np.flatnonzero(edge)
        first, end = at[:-1], at[1:]
        use = kind[first] != SPACE
        first, end = first[use], end[use]
        size = end - first
        h = hashes(low, first, end, self.key) | np.uint64(1)
        number = self._find(h)
        new = np.flatnonzero(number == 0)
        if len(new):
            fresh, one = np.unique(h[new], return_index=True)
            if len(self.starts) + len(fresh) > 1 << (SLOTS - 1):
                self._empty()
                new = np.arange(len(h))
                fresh, one = np.unique(h, return_index=True)
            one = new[one]
            ids, counts = self._words(low, first[one], size[one])
            begin = len(self.starts)
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(counts)])
            self.pool = np.concatenate([self.pool, ids])
            self._insert(fresh, np.arange(begin, begin + len(fresh), dtype=np.int32))
            number[new] = self._find(h[new])
        lo = self.starts[number - 1]
        counts = self.starts[number] - lo
        ends = np.cumsum(counts)
        ids = self.pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(lo - ends + counts, counts)]
        total = np.concatenate([[0], ends])
        return ids, np.diff(total[np.searchsorted(first, offsets)])

    def _words(self, low: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = np.zeros(len(first), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        width = np.minimum((size + 7) // 8, LONGEST // 8 + 1)
        for w in np.unique(width):
            rows = np.flatnonzero(width == w)
            if w <= LONGEST // 8:
                ids, own = self.merge(low, first[rows], size[rows])
            else:
                texts = [bytes(low[first[r] : first[r] + size[r]]).decode() for r in rows]
                found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
                ids, own = np.array([x for y in found for x in y], np.uint32), np.array([len(y) for y in found])
            counts[rows] = own
            parts.append((rows, ids))
        begin = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), np.uint32)
        for rows, ids in parts:
            own = counts[rows]
            out[np.arange(len(ids)) + np.repeat(begin[rows] - np.cumsum(own) + own, own)] = ids
        return out, counts

    # texts with other characters

    @staticmethod
    def _split(word: str) -> tuple[str, ...]:
        """A word as its core and the ASCII punctuation around it, where they are sure to be apart."""
        core = word.strip(string.punctuation)
        if "'" in word or "<" in word or not core or not (word.isascii() or max(word) < "ɐ") or not all(c.isalnum() and c not in "ªº²³¹¼½¾µ" for c in (core[0], core[-1])):
            return (word,)
        at = word.index(core)
        return tuple(x for x in (word[:at], core.lower(), word[at + len(core) :]) if x)

    def _slow(self, texts: list[str]) -> list[bytes]:
        split = [t.replace("\n", " ").split(" ") for t in texts]
        by = {w: self._split(w) for w in set().union(*split) if w}
        need = {p for x in by.values() for p in x}
        if len(self.cores) + len(need) > 200_000:
            self.cores.clear()
        new = [p for p in need if p not in self.cores]
        for p, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self.cores[p] = np.array(e.ids, "<u4").tobytes()
        words = {w: b"".join([self.cores[p] for p in x]) for w, x in by.items()} | {"": b""}
        return [b"".join([words[w] for w in x]) for x in split]

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """For rows of UTF-8 bytes."""
        rows = len(offsets) - 1
        odd = (data >= 0xC4) | (data == 0xC2) | (data == 0x27)
        after = np.flatnonzero(data[:-1] == 0xC3) + 1 if len(data) else np.zeros(0, np.int64)
        odd[after[(data[after] == 0x97) | (data[after] == 0xB7)]] = True
        after = np.flatnonzero(data[:-1] == 0x3C) + 1 if len(data) else after
        odd[after[data[after] == 0x7C]] = True
        seen = np.concatenate([[0], np.cumsum(odd)])[offsets]
        slow = np.diff(seen) > 0
        out: list[bytes] = [b""] * rows
        if slow.any():
            pick = np.flatnonzero(slow)
            for r, x in zip(pick, self._slow([bytes(data[offsets[r] : offsets[r + 1]]).decode("utf-8", "replace") for r in pick]), strict=True):
                out[r] = x
        pick = np.flatnonzero(~slow)
        if len(pick) == rows:
            part, at = data, offsets
        else:
            part = data[np.repeat(~slow, np.diff(offsets))]
            at = np.concatenate([[0], np.cumsum(np.diff(offsets)[pick])])
        if len(part):
            ids, counts = self._fast(part, at)
            raw, end = ids.astype("<u4").tobytes(), np.concatenate([[0], np.cumsum(counts)]) * 4
            for i, r in enumerate(pick):
                out[r] = raw[end[i] : end[i + 1]]
        return out
