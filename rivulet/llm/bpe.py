"""Byte-level BPE inside a task: split texts into words, encode each distinct word once.

Texts are handled in slices of a few MB. A slice is split by array operations on its code
points, the words are told apart by two 64-bit hashes, and only words that the task has not
met before are encoded: all of them together, one merge of lowest rank per word and step.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from functools import lru_cache

import numpy as np

from rivulet.llm.common import slices

SLICE_BYTES = 1 << 20
LONG_WORD = 64          # longer words are merged one by one with a heap
CACHE_WORDS = 1_000_000  # a task forgets its words beyond this and encodes them anew
NONE = np.uint32(0xFFFFFFFF)
SPACE, LETTER, NUMBER, OTHER = range(4)
# Unicode White_Space (fixed values)
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F,
         0x205F, 0x3000]


def read_ranks(content: bytes) -> list[bytes]:
    """Pieces by rank from the content of a ``.tiktoken`` rank file."""
    pairs = [line.split() for line in content.splitlines() if line.strip()]
    pieces = [b""] * len(pairs)
    for piece, rank in pairs:
        pieces[int(rank)] = base64.b64decode(piece)
    return pieces


def read_vocab(content: bytes) -> tuple[list[bytes], dict[str, int]]:
    """Pieces by rank, and the special tokens, from the content of a byte-level BPE ``.json``
    file. Its pieces are written in the usual printable stand-ins for bytes."""
    import json
    model = json.loads(content)
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(printable)]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
    special = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
    pieces = [b""] * (1 + max(model["model"]["vocab"].values()))
    for text, i in model["model"]["vocab"].items():
        if text not in special:
            pieces[i] = bytes(byte[c] for c in text)
    return pieces, special


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point: white space, letter, number or other."""
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = LETTER
        elif kind == "N":
            table[c] = NUMBER
    table[WHITE] = SPACE
    return table


def word_starts(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """True where a word starts. ``cp``: code points of texts one after another; ``first``:
    True at the first code point of each text. A word is a run of letters, numbers or other
    characters with one space before it if there is one; an apostrophe with s, t, m, d, re,
    ve or ll after it; or what white space is left."""
    n = len(cp)
    kind = _classes()[cp]
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    after = np.flatnonzero(start & ~first & (kind != SPACE))
    after = after[kind[after - 1] == SPACE]
    start[after - 1] = True
    start[after[cp[after - 1] == 32]] = False
    # Words that open with an apostrophe right before a letter.
    mark = np.flatnonzero((cp == 39) & start)
    mark = mark[mark + 1 < n]
    mark = mark[(kind[mark + 1] == LETTER) & ~first[mark + 1]]
    one = cp[mark + 1]
    two = cp[np.minimum(mark + 2, n - 1)]
    has2 = (mark + 2 < n) & ~first[np.minimum(mark + 2, n - 1)]
    short = np.isin(one, [ord(c) for c in "stmd"])
    pair = has2 & (((np.isin(one, [ord("r"), ord("v")])) & (two == ord("e")))
                   | ((one == ord("l")) & (two == ord("l"))))
    for at, length in ((mark[short], 2), (mark[pair], 3)):
        start[at + 1] = False
        end = at + length
        end = end[end < n]
        start[end[kind[end] == LETTER]] = True
    return start


class Encoder:
    """Encodes texts with one vocabulary; keeps the words it has met."""

    def __init__(self, pieces: list[bytes]):
        rank = {p: i for i, p in enumerate(pieces) if p}
        self.byte = np.array([rank[bytes([b])] for b in range(256)], dtype=np.uint32)
        left, right, made = [], [], []
        for p, i in rank.items():
            for cut in range(1, len(p)):
                a, b = rank.get(p[:cut]), rank.get(p[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    made.append(i)
        key = np.array(left, dtype=np.uint64) << np.uint64(32) | np.array(right, dtype=np.uint64)
        order = np.argsort(key)
        self.keys, self.made = key[order], np.array(made, dtype=np.uint32)[order]
        self.pair = dict(zip(self.keys.tolist(), self.made.tolist()))
        rng = np.random.default_rng(7)
        self.mix = rng.integers(1, 1 << 63, (2, 1 << 16), dtype=np.uint64) | np.uint64(1)
        self.odd = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
        self.powers = None
        self.forget()

    def forget(self) -> None:
        self.h1 = np.zeros(0, dtype=np.uint64)
        self.h2, self.at = self.h1, np.zeros(0, dtype=np.int64)
        self.size = np.zeros(0, dtype=np.int32)
        self.flat, self.used = np.zeros(1 << 16, dtype=np.uint32), 0

    # -- merging -------------------------------------------------------------------------
    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge; NONE where the pair does not merge."""
        key = a.astype(np.uint64) << np.uint64(32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], NONE)

    def _fold(self, ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Merge the rows of ``ids`` (words of one length) to the end. Gives (rows, ids)."""
        rows, done = np.arange(len(ids)), []
        ranks = (self._ranks(ids[:, :-1], ids[:, 1:]) if ids.shape[1] > 1
                 else np.zeros((len(ids), 0), dtype=np.uint32))
        while len(rows):
            if ids.shape[1] == 1:
                done.append((rows, ids))
                break
            best = ranks.argmin(axis=1)
            rank = ranks[np.arange(len(rows)), best]
            go = rank != NONE
            if not go.all():
                done.append((rows[~go], ids[~go]))
                rows, ids, ranks, best, rank = rows[go], ids[go], ranks[go], best[go], rank[go]
                if not len(rows):
                    break
            m, n = ids.shape
            row = np.arange(m)
            keep = np.arange(n) != (best + 1)[:, None]
            ids = ids[keep].reshape(m, n - 1)
            ids[row, best] = rank
            ranks = ranks[np.arange(n - 1) != best[:, None]].reshape(m, n - 2)
            if n > 2:
                has = best > 0
                r, c = row[has], best[has]
                ranks[r, c - 1] = self._ranks(ids[r, c - 1], ids[r, c])
                has = best < n - 2
                r, c = row[has], best[has]
                ranks[r, c] = self._ranks(ids[r, c], ids[r, c + 1])
        return done

    def _fold_long(self, word: np.ndarray) -> np.ndarray:
        """The same for one long word, with a heap over its pairs."""
        ids = self.byte[word].tolist()
        n = len(ids)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        get = self.pair.get
        heap = []
        for i in range(n - 1):
            r = get(ids[i] << 32 | ids[i + 1])
            if r is not None:
                heap.append((r, i, ids[i], ids[i + 1]))
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
                r = get(ids[i] << 32 | ids[nxt[i]])
                if r is not None:
                    heapq.heappush(heap, (r, i, ids[i], ids[nxt[i]]))
            p = prv[i]
            if p >= 0:
                r = get(ids[p] << 32 | ids[i])
                if r is not None:
                    heapq.heappush(heap, (r, p, ids[p], ids[i]))
        return np.array([i for i in ids if i >= 0], dtype=np.uint32)

    # -- words ---------------------------------------------------------------------------
    def _hashes(self, cp: np.ndarray, s: np.ndarray, e: np.ndarray) -> list[np.ndarray]:
        """Two polynomial hashes of each code point range, by differences of running sums."""
        if self.powers is None or len(self.powers[0][0]) < len(cp) + 1:
            self.powers = []
            for odd in self.odd:
                inverse = pow(odd, -1, 1 << 64)
                self.powers.append([np.multiply.accumulate(np.concatenate(
                    ([np.uint64(1)], np.full(len(cp), x, dtype=np.uint64)))) for x in (odd, inverse)])
        out, wide = [], cp.max() > 0xFFFF
        for (up, down), mix in zip(self.powers, self.mix):
            run = np.zeros(len(cp) + 1, dtype=np.uint64)
            value = mix[cp & 0xFFFF]
            if wide:
                value += (cp >> 16).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            value *= up[:len(cp)]
            np.cumsum(value, out=run[1:])
            h = (run[e] - run[s]) * down[s]
            out.append(h ^ (h >> np.uint64(31)))
        return out

    def _learn(self, h1, h2, raw, begin, length) -> None:
        """Encode new words, given as byte ranges of ``raw``, and remember them."""
        if len(self.h1) + len(h1) > CACHE_WORDS:
            self.forget()
        sizes = np.zeros(len(h1), dtype=np.int32)
        parts = []
        for n in np.unique(length):
            which = np.flatnonzero(length == n)
            if n > LONG_WORD:
                for w in which:
                    ids = self._fold_long(raw[begin[w]:begin[w] + n])
                    parts.append((np.array([w]), ids[None, :]))
                continue
            ids = self.byte[raw[begin[which][:, None] + np.arange(n)]]
            parts += [(which[rows], ids) for rows, ids in self._fold(ids)]
        at = np.zeros(len(h1), dtype=np.int64)
        used = self.used
        need = used + sum(ids.size for _, ids in parts)
        if need > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(need, dtype=np.uint32)])
        for which, ids in parts:
            sizes[which] = ids.shape[1]
            at[which] = used + np.arange(len(which)) * ids.shape[1]
            self.flat[used:used + ids.size] = ids.ravel()
            used += ids.size
        self.used = used
        place = np.searchsorted(self.h1, h1)  # the new words come in order of their first hash
        self.h1, self.h2 = np.insert(self.h1, place, h1), np.insert(self.h2, place, h2)
        self.at, self.size = np.insert(self.at, place, at), np.insert(self.size, place, sizes)

    def _find(self, h1, h2) -> np.ndarray:
        """Place of each word among those met; -1 where it is new."""
        if not len(self.h1):
            return np.full(len(h1), -1)
        at = np.minimum(np.searchsorted(self.h1, h1), len(self.h1) - 1)
        same = (self.h1[at] == h1) & (self.h2[at] == h2)
        for i in np.flatnonzero(~same & (self.h1[at] == h1)):  # words that share the first hash
            j = at[i]
            while j < len(self.h1) and self.h1[j] == h1[i]:
                if self.h2[j] == h2[i]:
                    at[i], same[i] = j, True
                    break
                j += 1
        return np.where(same, at, -1)

    def _slice(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        joined = b"".join(texts)
        try:
            plain = joined.decode("utf-8")
        except UnicodeDecodeError:  # what is not UTF-8 is read as U+FFFD
            texts = [t.decode("utf-8", "replace").encode("utf-8") for t in texts]
            joined = b"".join(texts)
            plain = joined.decode("utf-8")
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        if not joined:
            return np.zeros(0, dtype=np.uint32), np.zeros(len(texts), dtype=np.int64)
        raw = np.frombuffer(joined, dtype=np.uint8)
        cp = np.frombuffer(plain.encode("utf-32-le"), dtype=np.uint32)
        where = np.flatnonzero((raw & 0xC0) != 0x80)  # first byte of each code point
        begins = np.cumsum(sizes) - sizes
        first = np.zeros(len(cp), dtype=bool)
        first[np.searchsorted(where, begins[sizes > 0])] = True
        s = np.flatnonzero(word_starts(cp, first))
        e = np.append(s[1:], len(cp))
        h1, h2 = self._hashes(cp, s, e)
        # Distinct words of the slice: sort by the first hash, part where either differs.
        order = np.argsort(h1)
        a, b = h1[order], h2[order]
        if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():
            order = np.lexsort((h2, h1))
            a, b = h1[order], h2[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        kind = np.empty(len(order), dtype=np.int64)
        kind[order] = np.cumsum(new) - 1
        u1, u2, example = a[new], b[new], order[new]
        place = self._find(u1, u2)
        fresh = np.flatnonzero(place < 0)
        if len(fresh):
            edge = np.append(where, len(raw))
            w = example[fresh]
            self._learn(u1[fresh], u2[fresh], raw, edge[s[w]], edge[e[w]] - edge[s[w]])
            place = self._find(u1, u2)
            if (place < 0).any():  # the words met were forgotten on the way
                w = example[place < 0]
                self._learn(u1[place < 0], u2[place < 0], raw, edge[s[w]], edge[e[w]] - edge[s[w]])
                place = self._find(u1, u2)
        count = self.size[place][kind].astype(np.int64)
        stop = np.cumsum(count)
        ids = self.flat[np.repeat(self.at[place][kind] - (stop - count), count)
                        + np.arange(stop[-1])]
        # Words, and so ids, of each text.
        edge = np.append(where[s], len(raw))
        word_at = np.searchsorted(edge, np.append(begins, len(raw)))
        total = np.append(0, stop)
        return ids, np.diff(total[word_at])

    def encode(self, texts: list[bytes]):
        """Yield the ids of each text, in order."""
        for a, b in slices(texts, SLICE_BYTES):
            ids, sizes = self._slice(texts[a:b])
            at = 0
            for n in sizes.tolist():
                yield ids[at:at + n]
                at += n


_encoders: dict[str, Encoder] = {}


def encoder(pieces: list[bytes], key: str) -> Encoder:
    """The process's encoder for a vocabulary; ``key`` tells vocabularies apart."""
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(pieces)
    return _encoders[key]
