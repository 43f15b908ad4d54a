"""Near-duplicate passages across documents, by compact windows.

A passage is a run of at least ``min_words`` words; two passages are near duplicates if the
Jaccard similarity of their five-word shingles is 0.8 or more. Under one hash function all
runs of shingles around place c, from l or later to r or earlier, share the min-hash at c: they
are one compact window (l, c, r), a node of the Cartesian tree over the hashes. Only nodes as
wide as a passage matter, and those are the places that are least in some stretch of that
width, so they are picked by sliding minima and joined into the tree by a stack.

1. The windows of two hash functions are intersected (an interval join within the document):
   what is left shares both min-hashes, and its key is their pair. BANDS such pairs of hash
   functions are used. A passage pair of similarity 0.8 shares a given key with probability
   0.64, and none of five with less than 0.01, for each of its sub-passages.
2. Keys that only one document holds go no further (the exchange of ``suffixes``: a chunk of
   documents sends each key once).
3. Overlapping windows with shared keys make up a document's candidate passages. A key's rows
   carry a byte for each shingle around its place. In order of document id, a row is compared
   with the key's leaders so far by these alone, and is a leader itself unless nearly the same
   as one: passages that share a key and little else go no further, before any text moves, and
   copies meet their leader only. What is alike is compared in full; rows that are not linked
   to their leader at the key's place are compared with all that are alike to that leader.
4. A comparison finds the best matching stretch of both passages and verifies it: length,
   and exact Jaccard similarity of its shingles. It goes on with what is left of both.
   Passages of equal shingles are compared with another one once for all of them.
"""

from __future__ import annotations

import contextlib
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.common import binary_text, free_memory, materialize, slices, text_bytes
from rivulet.llm.components import connected_components
from rivulet.llm.suffixes import NO_ID, _member, _shared_anchors, packed_hashes
from rivulet.session import delete_path

SHINGLE = 5
BANDS = 5
CHUNK = 8 << 20
SLICE = 256 << 10
HELD = 1_000_000
UNPACKED = 1 << 20   # bytes of packed keys that become rows at once
KEY_PARTS = 2        # parts of the keys that are shuffled one after the other
PAIRS = 500_000      # pairs of passages that are compared at once
MET = 10_000         # rows with surroundings that meet at once
UNMET = 500_000      # rows alike to leaders whose pairs are made at once
BATCH = 512          # rows with whole passages that go to Python at once
REACH = 22   # shingles to either side of a key's place that tell its surroundings
FEW = 6      # shingles that one side has in common if a passage there is similar
_KEY = np.dtype([("key", "<i8"), ("c1", "<i4"), ("c2", "<i4"), ("near", "u1", 2 * REACH + 1)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, dtype=bool)
_GAP[[32, *range(9, 14)]] = True
_RNG = np.random.default_rng(23)
_MIX = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TURN = _RNG.integers(1, 1 << 62, 2 * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = 0x9E3779B97F4A7C15
_BACK = pow(_ODD, -1, 1 << 64)


def _powers(odd: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate(
        ([np.uint64(1)], np.full(n, odd, dtype=np.uint64))))


class Shingled:
    """Shingle hashes of several texts: those of text i are hash[begin[i]:begin[i + 1]]."""

    up = down = np.zeros(0, dtype=np.uint64)

    def __init__(self, texts: list[bytes]):
        joined = b"\n".join(texts) + b"\n"
        raw = _LOWER[np.frombuffer(joined, dtype=np.uint8)]
        gap = _GAP[raw]
        edge = np.flatnonzero(np.diff(gap, prepend=True))
        s, e = edge[0::2], edge[1::2]
        if len(Shingled.up) <= len(raw):
            Shingled.up, Shingled.down = _powers(_ODD, len(raw)), _powers(_BACK, len(raw))
        run = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(_MIX[raw] * Shingled.up[:len(raw)], out=run[1:])
        word = (run[e] - run[s]) * Shingled.down[s]
        word ^= word >> np.uint64(31)
        word *= np.uint64(0xD6E8FEB86659FD93)
        ends = np.cumsum([len(t) + 1 for t in texts])
        words = np.searchsorted(s, ends)             # words before the end of each text
        first = np.concatenate(([0], words[:-1]))
        count = np.maximum(words - first - SHINGLE + 1, 0)
        self.words = words - first
        h = np.zeros(max(0, len(word) - SHINGLE + 1), dtype=np.uint64)
        for j in range(SHINGLE):
            h = (h + word[j:j + len(h)]) * np.uint64(0xC2B2AE3D27D4EB4F)
            h ^= h >> np.uint64(29)
        self.begin = np.concatenate(([0], np.cumsum(count)))
        at = np.repeat(first - self.begin[:-1], count) + np.arange(self.begin[-1])
        self.hash = h[at]

    @functools.cached_property
    def byte(self) -> np.ndarray:
        """One byte (1 to 255) for each shingle."""
        return ((self.hash >> np.uint64(33)) % np.uint64(255)).astype(np.uint8) + np.uint8(1)


def compact_windows(f: np.ndarray, begin: np.ndarray, width: int):
    """(l, c, r) of the Cartesian tree nodes at least ``width`` wide of each text's hashes
    ``f[begin[i]:begin[i + 1]]``; inclusive places, in order of c."""
    n = len(f)
    if n < width:
        return (np.zeros(0, dtype=np.int64),) * 3
    sizes = np.diff(begin)
    valid = np.zeros(n + 1, dtype=np.int32)
    wide = sizes >= width
    np.add.at(valid, begin[:-1][wide], 1)
    np.add.at(valid, begin[1:][wide] - width + 1, -1)
    valid = np.cumsum(valid)[:n - width + 1] > 0
    low, span = f, 1
    while span < width:
        step = min(span, width - span)
        low = np.minimum(low[:-step], low[step:])
        span += step
    top = np.zeros(n, dtype=np.uint64)
    top[:len(valid)] = np.where(valid, low, np.uint64(0))
    span = 1
    while span < width:
        step = min(span, width - span)
        top[step:] = np.maximum(top[step:], top[:-step])
        span += step
    c = np.flatnonzero((top == f) & (top > 0))
    doc = np.searchsorted(begin, c, side="right") - 1
    # Values with a least one before each text and at the end; places of those are its bounds.
    at = np.arange(len(c)) + np.cumsum(np.diff(doc, prepend=-1) > 0)
    bounds = np.ones(at[-1] + 2 if len(at) else 1, dtype=bool)
    bounds[at] = False
    value = np.zeros(len(bounds), dtype=np.uint64)
    value[at] = f[c]
    place = np.zeros(len(bounds), dtype=np.int64)
    place[at] = c
    last, after = _less(value, at)
    left = np.where(bounds[last], begin[doc], place[last] + 1)
    right = np.where(bounds[after], begin[doc + 1], place[after]) - 1
    keep = right - left + 1 >= width
    return left[keep], c[keep], right[keep]


def _less(value: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the places ``at`` that of the last value before that is not greater and of
    the next value after that is less. Both ends of ``value`` are least."""
    last, after = np.arange(len(value)) - 1, np.arange(len(value)) + 1
    # What lies between a place and its pointer is greater (not less), so pointers can be
    # followed while what they point to is, too.
    todo = at[value[last[at]] > value[at]]
    while len(todo):
        last[todo] = last[last[todo]]
        todo = todo[value[last[todo]] > value[todo]]
    todo = at[value[after[at]] >= value[at]]
    while len(todo):
        after[todo] = after[after[todo]]
        todo = todo[value[after[todo]] >= value[todo]]
    return last[at], after[at]


def _joint(one, two, f1, f2, width: int):
    """Windows shared by two hash functions: (l, first c, last c, r, key). An interval join:
    windows of either kind that hold a common run of ``width`` shingles around both places."""
    l1, c1, r1 = one
    l2, c2, r2 = two
    if not len(c1) or not len(c2):
        return None
    # Windows of one kind are nested or apart. Those that hold a given place and lie to the right
    # of it are found from the next window on by going from each to the one that ends it, which
    # holds it; to the left likewise.
    found = []
    for step, at in ((1, np.searchsorted(c2, c1)), (-1, np.searchsorted(c2, c1) - 1)):
        ends = r2 + 1 if step > 0 else l2 - 1
        then = np.searchsorted(c2, ends)
        there = np.minimum(then, len(c2) - 1)
        then = np.where(c2[there] == ends, there, -1)
        i = np.arange(len(c1))
        at[at == len(c2)] = -1
        while len(i):
            keep = (at >= 0) & ((c2[at] <= r1[i]) if step > 0 else (c2[at] >= l1[i]))
            i, at = i[keep], at[keep]
            holds = (l2[at] <= c1[i]) & (c1[i] <= r2[at])
            found.append((i[holds], at[holds]))
            at = then[at]
    i, j = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(i * len(c2) + j, kind="stable")    # few sorted runs
    i, j = i[order], j[order]
    l, r = np.maximum(l1[i], l2[j]), np.minimum(r1[i], r2[j])
    keep = r - l + 1 >= width
    i, j, l, r = i[keep], j[keep], l[keep], r[keep]
    key = f1[c1[i]] * np.uint64(_ODD) + f2[c2[j]]
    key ^= key >> np.uint64(32)
    return l, np.minimum(c1[i], c2[j]), np.maximum(c1[i], c2[j]), r, key * np.uint64(_BACK)


def _windows(s: Shingled, width: int):
    """Joint windows of all bands."""
    parts = []
    for band in range(BANDS):
        f = []
        for turn in _TURN[2 * band:2 * band + 2]:
            h = s.hash * turn
            h ^= h >> np.uint64(32)
            f.append(np.maximum(h * turn, np.uint64(1)))
        got = _joint(compact_windows(f[0], s.begin, width), compact_windows(f[1], s.begin, width),
                     f[0], f[1], width)
        if got is not None:
            parts.append(got)
    if not parts:
        return None
    return [np.concatenate(x) for x in zip(*parts)]


def _send_keys(width: int, buckets: int):
    """Task of step 2: ``packed_hashes`` of the keys, each key once a chunk and send."""
    small = np.min_scalar_type(buckets)

    def run(batches):
        held, size, docs = [], 0, 0
        for pdf in batches:
            chunks, texts = pdf["chunk"].to_numpy().astype(small), pdf["t"].tolist()
            for lo, hi in slices(texts, SLICE):
                s = Shingled(texts[lo:hi])
                w = _windows(s, width)
                if w is None or not len(w[0]):
                    continue
                doc = np.searchsorted(s.begin, w[1], side="right") - 1
                held.append((chunks[lo:hi][doc], docs + doc, w[4]))
                docs += hi - lo
                size += len(doc)
                if size >= HELD:
                    yield packed_hashes(held, buckets)
                    held, size = [], 0
        if held:
            yield packed_hashes(held, buckets)
        del held
        free_memory()
    return run


def _surroundings(s: Shingled, d: np.ndarray, c: np.ndarray, reach: int = REACH) -> np.ndarray:
    """The bytes of the shingles up to ``reach`` places before and after the places ``c`` of
    texts ``d``, 0 outside the text."""
    first, end = s.begin[d][:, None], s.begin[d + 1][:, None]
    at = c[:, None] + np.arange(-reach, reach + 1)
    return np.where((at >= first) & (at < end), s.byte[np.clip(at, first, end - 1)], np.uint8(0))


def _alike(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of surroundings ``a`` and ``b`` (one pair a row): whether a passage through the key's
    place can be similar in both, and whether they are so alike that whatever is similar to the
    one is alike to the other. ``a`` may be one row for all.

    A passage of the least length reaches REACH places to one side at least. There it has few
    shingles that the other lacks, so FEW in common is a bound that no similar pair is below;
    loosely similar ones have the key's own shingles in common and little else."""
    if len(a) == len(b):
        differ = np.flatnonzero((a != b).any(axis=1))
        if len(differ) < len(b):    # equal ones have all in common that is there
            held = b > 0
            near = ((held[:, :REACH + 1].sum(axis=1) >= FEW)
                    | (held[:, REACH:].sum(axis=1) >= FEW))
            same = near.copy()
            if len(differ):
                near[differ], same[differ] = _alike(a[differ], b[differ])
            return near, same
    near, same = False, True
    for side in (slice(0, REACH + 1), slice(REACH, 2 * REACH + 1)):
        x, y = b[:, side], a[:, side]
        common = ((x[:, :, None] == y[:, None, :]).any(axis=2) & (x > 0)).sum(axis=1)
        near = near | (common >= FEW)
        same = same & (common >= (x > 0).sum(axis=1) - FEW)
    return near, near & same


def _gathered(batches):
    """Batches of at least MET rows, but for the last."""
    some, size = [], 0
    for batch in batches:
        some.append(batch)
        size += len(batch)
        if size >= MET:
            yield pa.Table.from_batches(some).combine_chunks()
            some, size = [], 0
    if size:
        yield pa.Table.from_batches(some).combine_chunks()


def _leaders(batches):
    """Rows sorted by (key, doc, pid) -> pairs (key, a, b, ...) of a key's leaders with the rows
    that are alike to them. A key's first row leads; each row meets the leaders so far and leads
    from then on unless it is nearly the same as one of them. Copies thus meet their leader
    only, rows that have no more than the key in common meet nobody."""
    names = ("key", "pid", "doc", "c1", "c2", "long")
    held = None  # leaders of the last key
    for batch in _gathered(batches):
        col = {c: batch.column(c).to_numpy() for c in names}
        near = np.frombuffer(b"".join(batch.column("near").to_pylist()), np.uint8).reshape(
            -1, 2 * REACH + 1)
        old = 0
        if held is not None and held[0]["key"][0] == col["key"][0]:
            old = len(held[1])
            col = {c: np.concatenate((held[0][c], col[c])) for c in names}
            near = np.concatenate((held[1], near))
        n = len(near)
        first = np.ones(n, dtype=bool)
        first[1:] = col["key"][1:] != col["key"][:-1]
        group = np.cumsum(first) - 1
        left = np.arange(n)     # rows that still have to meet leaders
        leads, out = [], []
        while len(left):
            g = group[left]
            head = np.ones(len(left), dtype=bool)
            head[1:] = g[1:] != g[:-1]
            leader = left[head][np.cumsum(head) - 1]
            leads.append(left[head])
            rest = ~head
            a, b = leader[rest], left[rest]
            keep = np.ones(len(b), dtype=bool)
            for lo in range(0, len(b), 4096):
                x, y = a[lo:lo + 4096], b[lo:lo + 4096]
                alike, same = _alike(near[x], near[y])
                new = y >= old  # leaders of an earlier batch have met
                keep[lo:lo + 4096] = ~(same & new)
                alike = alike & new
                out.append((x[alike], y[alike]))
            left = b[keep]
        if out:
            a, b = (np.concatenate(x) for x in zip(*out))
            yield pa.RecordBatch.from_arrays(
                [pa.array(col["key"][b]), pa.array(col["pid"][a]), pa.array(col["doc"][a]),
                 pa.array(col["pid"][b]), pa.array(col["doc"][b]), pa.array(col["c1"][b]),
                 pa.array(col["c2"][b]), pa.array(col["long"][a]), pa.array(col["long"][b])],
                names=["key", "a", "doc_a", "b", "doc_b", "c1", "c2", "long_a", "long_b"])
        lead = np.sort(np.concatenate(leads))
        lead = lead[group[lead] == group[-1]]
        held = {c: col[c][lead] for c in names}, near[lead]


def _candidates(width: int):
    """A chunk: candidate passages with their shared keys, each with the two places of its
    window in the document."""
    schema = pa.schema([("pid", pa.int64()), ("doc", pa.int64()), ("start", pa.int64()),
                        ("body", pa.binary()), ("keys", pa.binary())])

    def run(key, left, right):
        ids = [NO_ID if i is None else i for i in left.column("__id").to_pylist()]
        texts = left.column("__t").to_pylist()
        bodies = right.column("body").to_pylist()
        if not ids or not bodies:
            return schema.empty_table()
        shared = np.unique(np.concatenate([np.frombuffer(b, np.uint64) for b in bodies]))
        order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        found, count = [], 0    # a slice's passages go to Spark as a batch
        texts = [texts[i] for i in order]
        for lo, hi in slices(texts, SLICE):
            s = Shingled(texts[lo:hi])
            w = _windows(s, width)
            if w is None:
                continue
            l, c1, c2, r, h = w
            keep = _member(shared, h)
            l, c1, c2, r, h = l[keep], c1[keep], c2[keep], r[keep], h[keep]
            if not len(h):
                continue
            # Runs of interest lie around the two places; overlapping ones are one passage.
            l, r = np.maximum(l, c2 - 2 * width), np.minimum(r, c1 + 2 * width)
            doc = np.searchsorted(s.begin, c1, side="right") - 1
            by = np.lexsort((l, doc))
            l, r, h, doc, c1, c2 = l[by], r[by], h[by], doc[by], c1[by], c2[by]
            reach = np.maximum.accumulate(r)
            new = np.ones(len(l), dtype=bool)
            new[1:] = l[1:] > reach[:-1]
            group = np.cumsum(new) - 1
            begin = l[new]
            end = np.maximum.reduceat(r, np.flatnonzero(new))
            whose = doc[new]
            # Each passage's keys once, in order of key and places.
            h = h.view(np.int64)
            by = np.lexsort((c2, c1, h, group))
            own = np.stack((h[by], c1[by], c2[by]), 1)
            group = group[by]
            again = np.zeros(len(own), dtype=bool)
            again[1:] = (group[1:] == group[:-1]) & (own[1:] == own[:-1]).all(axis=1)
            own, group = own[~again], group[~again]
            own, group = _once(s, whose, group, own, width)
            rows = np.zeros(len(own), dtype=_KEY)
            rows["key"] = own[:, 0]
            for x in range(0, len(own), MET):
                mine = slice(x, x + MET)
                rows["near"][mine] = _surroundings(s, whose[group[mine]], own[mine, 1])
            first = s.begin[whose[group]]
            rows["c1"], rows["c2"] = own[:, 1] - first, own[:, 2] - first
            edges = np.searchsorted(group, np.arange(len(begin) + 1))
            out = []
            for g in range(len(begin)):
                d = int(whose[g])
                out.append((key[0].as_py() << 40 | count, ids[order[lo + d]],
                            int(begin[g] - s.begin[d]), s.hash[begin[g]:end[g] + 1].tobytes(),
                            rows[edges[g]:edges[g + 1]].tobytes()))
                count += 1
            found.append(pa.table([pa.array(x, t.type) for x, t in zip(zip(*out), schema)],
                                  schema=schema))
            del s, w, out
        free_memory()
        return pa.concat_tables(found) if found else schema.empty_table()
    return run


def _once(s: Shingled, whose: np.ndarray, group: np.ndarray, keys: np.ndarray, width: int):
    """Of the (key, c1, c2) of passages, sorted by passage (``group``, of text ``whose``), those
    of equal key and equal text as far as a passage of ``width`` around the first place reaches
    once, at their first place: repeated lines hold the same passages each time."""
    again = np.zeros(len(keys), dtype=bool)
    again[1:] = (keys[1:, 0] == keys[:-1, 0]) & (group[1:] == group[:-1])
    if not again.any():
        return keys, group
    again[:-1] |= again[1:]
    at = np.flatnonzero(again)
    # A passage of many repeats alone can be large, so few rows at once, but all of a passage.
    edges = np.flatnonzero(np.diff(group[at], prepend=-1))
    lo = 0
    while lo < len(at):
        hi = np.searchsorted(edges, lo + MET)
        hi = int(edges[hi]) if hi < len(edges) else len(at)
        part = at[lo:hi]
        around = np.stack((group[part], keys[part, 0], keys[part, 2] - keys[part, 1]), 1)
        text = _surroundings(s, whose[group[part]], keys[part, 1], width - 1)
        rows = np.hstack((around.view(np.uint8), text))
        first = np.unique(rows.view(f"V{rows.shape[1]}").ravel(), return_index=True)[1]
        again[part[first]] = False
        lo = hi
    return keys[~again], group[~again]


def keys_of(batch, bodies: list[bytes], part: int = 0, parts: int = 1):
    """The rows (key, pid, doc, c1, c2, near, long) of passages' packed keys; of ``parts`` parts
    of the keys the one of number ``part``."""
    rows = np.frombuffer(b"".join(bodies), _KEY)
    n = [len(b) // _KEY.itemsize for b in bodies]
    at = np.repeat(np.arange(len(n)), n)
    if parts > 1:
        mine = rows["key"] % parts == part
        rows, at = rows[mine], at[mine]
    width = 2 * REACH + 1
    edges = np.arange(0, len(rows) * width + 1, width, dtype=np.int32)
    near = pa.Array.from_buffers(pa.binary(), len(rows), [
        None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(rows["near"]))])
    return pa.RecordBatch.from_arrays(
        [pa.array(np.ascontiguousarray(rows["key"])),
         pa.array(batch.column(0).to_numpy()[at]), pa.array(batch.column(1).to_numpy()[at]),
         pa.array(np.ascontiguousarray(rows["c1"])),
         pa.array(np.ascontiguousarray(rows["c2"])), near,
         pa.array(batch.column(2).to_numpy()[at])],
        names=["key", "pid", "doc", "c1", "c2", "near", "long"])


def _best_run(match: np.ndarray, odds: float) -> tuple[int, int]:
    """Run of the highest sum, +1 for a match and -odds for a miss: [begin, end)."""
    total = np.zeros(len(match) + 1)
    np.add.accumulate(np.where(match, 1.0, -odds), out=total[1:])
    low = np.minimum.accumulate(total)
    end = int((total - low).argmax())
    begin = int(total[:end + 1].argmin())
    return begin, end


def _held(x: np.ndarray, starts: np.ndarray, width: int, codes: np.ndarray) -> np.ndarray:
    """Which of the codes each run ``x[start:start + width]`` holds (0 or 1)."""
    lo = starts[0]
    hit = x[lo:starts[-1] + width, None] == codes
    total = np.concatenate((np.zeros((1, len(codes)), dtype=np.int32),
                            np.cumsum(hit, axis=0, dtype=np.int32)))
    return (total[starts - lo + width] > total[starts - lo]).astype(np.float32)


def _starts(match: np.ndarray, width: int, need: float) -> np.ndarray:
    """Starts of the runs of ``width`` places with at least ``need`` matches."""
    total = np.concatenate(([0], np.cumsum(match)))
    return np.flatnonzero(total[width:] - total[:-width] >= need)


def _distinct(x: np.ndarray, width: int) -> np.ndarray:
    """How many different shingles each run of ``width`` places holds."""
    order = np.argsort(x, kind="stable")
    again = x[order[1:]] == x[order[:-1]]
    this, last = order[1:][again], order[:-1][again]
    close = this - last < width     # a run from this - width + 1 to last holds both
    n = len(x) - width + 1
    twice = (np.bincount(np.maximum(this[close] - width + 1, 0), minlength=n + 1)[:n + 1]
             - np.bincount(np.minimum(last[close] + 1, n), minlength=n + 1))
    return width - np.cumsum(twice[:n])


def _codes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Both passages with small numbers for their shingles, and how many numbers there are."""
    values, code = np.unique(np.concatenate((a, b)), return_inverse=True)
    return code[:len(a)], code[len(a):], len(values)


def _marked(x: np.ndarray, n: int) -> np.ndarray:
    """Which of the ``n`` numbers ``x`` holds."""
    out = np.zeros(n, dtype=bool)
    out[x] = True
    return out


def _best_windows(a, b, n: int, in_b: np.ndarray, similarity: float, width: int, distinct):
    """As ``verify``, over all pairs of runs of exactly ``width`` shingles: the most similar of
    the first stretch of ``a`` that has one."""
    need = width * 2 * similarity / (1 + similarity) - 1
    starts = _starts(in_b, width, need)
    # With as many shingles as places in either run, a fitting one has one more.
    if (not len(starts) or len(b) < width
            or all(distinct) and not len(_starts(in_b, width, need + 1 - 1e-6))):
        return None
    of_a, of_b = (np.full(len(x), width) if d else _distinct(x, width)
                  for x, d in zip((a, b), distinct))
    at = 0
    while at < len(starts):
        end = int(np.searchsorted(starts, starts[at] + width))
        xs = starts[at:end]
        at = end
        shared = _marked(a[xs[0]:xs[-1] + width], n) & _marked(b, n)
        codes = np.flatnonzero(shared)
        ys = _starts(shared[b], width, need)
        best = None
        for lo in range(0, len(ys), 1024):
            part = ys[lo:lo + 1024]
            both = _held(a, xs, width, codes) @ _held(b, part, width, codes).T
            p, q = of_a[xs], of_b[part]
            jaccard = both / (p[:, None] + q - both)
            i, j = np.unravel_index(jaccard.argmax(), jaccard.shape)
            # Divided anew: the matrix is in single precision.
            value = int(both[i, j]) / int(p[i] + q[j] - both[i, j])
            if value >= similarity and (best is None or value > best[0]):
                best = value, int(xs[i]), int(xs[i]) + width, int(part[j]), int(part[j]) + width
        if best:
            return best
    return None


def verify(a: np.ndarray, b: np.ndarray, similarity: float, width: int):
    """``_verify`` of two passages' shingles."""
    return _verify(*_codes(a, b), similarity, width)


def _dense(match: np.ndarray, similarity: float, width: int) -> bool:
    """Whether some run of ``width`` places or more has that share of matches."""
    total = np.zeros(len(match) + 1)
    np.add.accumulate(match - similarity, out=total[1:])
    return bool((total[width:] - np.minimum.accumulate(total[:-width])).max() > -1e-6)


def _verify(a: np.ndarray, b: np.ndarray, n: int, similarity: float, width: int, in_b=None,
            distinct=None):
    """(similarity, begin a, end a, begin b, end b) of well matching runs of two passages'
    shingles, or None if no tried run is long and similar enough.

    A run is the one of highest sum when a match counts 1 and a miss costs some odds: cheap
    misses bridge a changed word, dear ones (up to none at all) cut off what matches loosely.
    Such a run neither starts nor ends on a miss, so it can be shorter than a passage that is
    similar enough. If none of them fits, all runs of ``width`` shingles are tried. ``in_b`` tells
    which of ``a`` are in ``b``, ``distinct`` of both whether all shingles differ, if known."""
    if in_b is None:
        in_b = _marked(b, n)[a]
        distinct = _marked(a, n).sum() == len(a), _marked(b, n).sum() == len(b)
    if in_b.sum() < width * 2 * similarity / (1 + similarity) - 1:  # too few in common
        return None
    base = similarity / (1 - similarity)
    # All runs lie between the first match and the last.
    reach = len(in_b) - int(in_b[::-1].argmax()) - int(in_b.argmax())
    for odds in () if reach < width else (base, base / 2, 2 * base, 8 * base, len(a), base / 4):
        x1, x2 = _best_run(in_b, odds)
        if x2 - x1 >= width:
            y1, y2 = _best_run(_marked(a[x1:x2], n)[b], odds)
            x1, x2 = _best_run(_marked(b[y1:y2], n)[a], odds)
            if min(x2 - x1, y2 - y1) >= width:
                p, q = _marked(a[x1:x2], n), _marked(b[y1:y2], n)
                jaccard = int((p & q).sum()) / int((p | q).sum())
                if jaccard >= similarity:
                    return jaccard, x1, x2, y1, y2
        # Where no shingle comes twice, a fitting run lacks (1 - similarity) of its places at most.
        if odds == base and (len(b) < width or distinct[0] and not _dense(in_b, similarity, width)
                             or distinct[1] and not _dense(_marked(a, n)[b], similarity, width)):
            return None
    return _best_windows(a, b, n, in_b, similarity, width, distinct)


def verify_all(a: np.ndarray, b: np.ndarray, similarity: float, width: int) -> list[tuple]:
    """Results of ``verify`` until nothing fits what is left: first stretches of ``a`` against
    the whole of ``b``, then those of ``b`` that no result holds against the whole of ``a``."""
    if len(a) >= width and np.array_equal(a, b):
        return [(1.0, 0, len(a), 0, len(a))]    # as the search would find
    return _all_runs(*_codes(a, b), similarity, width)


def _all_runs(a: np.ndarray, b: np.ndarray, n: int, similarity: float, width: int) -> list[tuple]:
    need = width * 2 * similarity / (1 + similarity)

    def search(x, y, todo):
        found = []
        own, other = _marked(x, n), _marked(y, n)
        distinct = own.sum() == len(x), other.sum() == len(y)
        in_y = other[x]
        total = np.concatenate(([0], np.cumsum(in_y)))
        while todo:
            lo, hi = todo.pop()
            got = None
            if hi - lo >= width and total[hi] - total[lo] >= need - 1:
                piece = x[lo:hi]
                whole = distinct[0] or hi - lo < len(x) and _marked(piece, n).sum() == hi - lo
                got = _verify(piece, y, n, similarity, width, in_y[lo:hi], (whole, distinct[1]))
            if got is None:
                continue
            j, x1, x2, y1, y2 = got
            found.append((j, lo + x1, lo + x2, y1, y2))
            # What matches goes. A run may hold some misses at either end, so neighbours keep
            # as many places of it.
            hit = lo + x1 + np.flatnonzero(_marked(y[y1:y2], n)[x[lo + x1:lo + x2]])
            first, last = int(hit[0]), int(hit[-1])
            slack = min(int(width - need) + 1, (last - first) // 2)
            todo += [(lo, min(hi, first + slack)), (max(lo, last + 1 - slack), hi)]
        return found

    found = search(a, b, [(0, len(a))])
    if not found:
        return found
    slack = int(width - need) + 1
    left, at = [], 0
    for y1, y2 in sorted(r[3:5] for r in found):
        if y1 > at:
            left.append((max(0, at - slack), min(len(b), y1 + slack)))
        at = max(at, y2)
    left.append((max(0, at - slack), len(b)))
    return found + [(j, x1, x2, y1, y2) for j, y1, y2, x1, x2 in search(b, a, left)]


def verify_each(many: list[np.ndarray], b: np.ndarray, similarity: float,
                width: int) -> list[list[tuple]]:
    """``verify_all`` of each of ``many`` with ``b``. Their shingles are looked up in ``b`` all at
    once. Those with too few in common have no result; one common stretch in both and nothing
    else in common is the result. All others are searched."""
    out = [[] for _ in many]
    if not len(b):
        return out
    need = width * 2 * similarity / (1 + similarity)
    values, code = np.unique(b, return_inverse=True)
    size = np.array([len(a) for a in many])
    begin = np.concatenate(([0], np.cumsum(size)))
    flat = np.concatenate(many)
    there = np.zeros(1 << 16, dtype=bool)
    there[values & np.uint64(0xFFFF)] = True
    at = np.flatnonzero(there[flat & np.uint64(0xFFFF)])   # few that are not in b
    place = np.minimum(np.searchsorted(values, flat[at]), len(values) - 1)
    hit = values[place] == flat[at]
    at, place = at[hit], place[hit]
    edge = np.searchsorted(at, begin)
    common = np.diff(edge)
    todo = np.flatnonzero((size >= width) & (common >= need - 1))
    if not len(todo):
        return out
    # Places in common that don't follow each other begin a stretch.
    starts = np.ones(len(at) + 1, dtype=np.int64)
    starts[1:-1] = np.diff(at) > 1
    starts[edge] = 1
    starts = np.concatenate(([0], np.cumsum(starts[:-1])))
    one = (starts[edge[1:]] - starts[edge[:-1]] == 1) & (common >= width)
    sure = int(width - need) + 1 < need - 1     # what is left around a stretch gives nothing
    step = max(1, (1 << 22) // len(b))
    for lo in range(0, len(todo), step):
        part = todo[lo:lo + step]
        mine = [place[edge[i]:edge[i + 1]] for i in part]
        marks = np.zeros((len(part), len(values)), dtype=bool)
        marks[np.repeat(np.arange(len(part)), common[part]), np.concatenate(mine)] = True
        in_a = marks[:, code]
        first = in_a.argmax(axis=1)
        count = in_a.sum(axis=1)
        single = one[part] & (count >= width) & (
            in_a[:, 0] + (in_a[:, 1:] & ~in_a[:, :-1]).sum(axis=1) == 1)
        for k, i in enumerate(part.tolist()):
            a = many[i]
            if len(a) == len(b) == common[i] and np.array_equal(a, b):
                out[i] = [(1.0, 0, len(a), 0, len(a))]
            elif sure and single[k]:
                x1, y1 = int(at[edge[i]] - begin[i]), int(first[k])
                out[i] = [(1.0, x1, x1 + int(common[i]), y1, y1 + int(count[k]))]
            else:
                mask = np.ones(len(a), dtype=bool)
                where = at[edge[i]:edge[i + 1]] - begin[i]
                mask[where] = False
                own = np.empty(len(a), dtype=np.int64)
                own[where] = mine[k]
                others, own[mask] = np.unique(a[mask], return_inverse=True)
                own[mask] += len(values)
                out[i] = _all_runs(own, code, len(values) + len(others), similarity, width)
    return out


def _unmet(key, lead, row, doc, far, most: int = 1 << 20):
    """Pairs (a, b) of rows of different documents of one (key, leader), at least one of which is
    ``far``, a < b, each once, without those of a leader and its row. All rows of the keys, in
    order of key."""
    heads = np.flatnonzero(np.diff(key, prepend=~key[:1]))
    some = np.repeat(np.logical_or.reduceat(far, heads), np.diff(np.append(heads, len(key))))
    key, lead, row, doc, far = key[some], lead[some], row[some], doc[some], far[some]
    if not len(key):
        return lead, row
    pids, code = np.unique(np.concatenate((lead, row)), return_inverse=True)
    lead, row = code[:len(key)], code[len(key):]
    n = np.int64(len(pids))
    pair = lambda x, y: np.minimum(x, y) * n + np.maximum(x, y)
    met = np.unique(pair(lead, row))
    by = np.lexsort((row, lead, key))
    key, lead, row, doc, far = key[by], lead[by], row[by], doc[by], far[by]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (lead[1:] != lead[:-1])
    again = np.zeros(len(key), dtype=bool)
    again[1:] = ~new[1:] & (row[1:] == row[:-1])
    # Each row once, far if one of its places is.
    runs = np.flatnonzero(~again)
    far = np.logical_or.reduceat(far, runs)
    key, lead, row, doc = key[runs], lead[runs], row[runs], doc[runs]
    group = np.cumsum(new[runs]) - 1
    first = np.flatnonzero(new[runs])
    size = np.diff(np.append(first, len(row)))
    whose = np.flatnonzero(np.concatenate(([True], key[first][1:] != key[first][:-1])))
    far_in = np.add.reduceat(far.astype(np.int64), first)
    found = []

    def keep(x, y):
        apart = doc[x] != doc[y]
        got = np.unique(pair(row[x[apart]], row[y[apart]]))
        found.append(got[~_member(met, got)])

    def all_of(i):
        """The rows ``i`` with all rows of their groups, some at a time."""
        total = np.cumsum(size[group[i]])
        lo = 0
        while lo < len(i):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most)))
            n_of = size[group[i[lo:hi]]]
            x = np.repeat(i[lo:hi], n_of)
            y = np.arange(len(x)) - np.repeat(np.cumsum(n_of) - n_of, n_of) + first[group[x]]
            keep(x, y)
            lo = hi

    # A key of many leaders names a pair many times: a product of matrices names it once.
    ends = np.append(whose[1:], len(first))
    work = np.add.reduceat(far_in * size, whose)
    dense = np.zeros(len(whose), dtype=bool)
    for k in np.flatnonzero(work > most // 8):
        lo, hi = first[whose[k]], first[ends[k]] if ends[k] < len(first) else len(row)
        own, col = np.unique(row[lo:hi], return_inverse=True)
        heads = ends[k] - whose[k]
        if heads < 4 or heads * len(own) > 4 * most:
            continue
        dense[k] = True
        there = np.zeros((heads, len(own)), dtype=np.float32)
        there[group[lo:hi] - whose[k], col] = 1
        lost = np.zeros_like(there)
        lost[group[lo:hi] - whose[k], col] = far[lo:hi]
        spot = np.empty(len(own), dtype=np.int64)
        spot[col] = np.arange(lo, hi)
        step = max(1, most // len(own))
        for at in range(0, len(own), step):
            x, y = np.nonzero(lost[:, at:at + step].T @ there)
            keep(spot[x + at], spot[y])
    by_key = np.repeat(dense, ends - whose)
    all_of(np.flatnonzero(far & ~by_key[group]))
    got = np.unique(np.concatenate(found))
    return pids[got // n], pids[got % n]


def _keys_together(batches, rows: int):
    """Tables of ``rows`` rows and more that hold all rows of their keys, of sorted batches."""
    some, size = [], 0
    for batch in batches:
        some.append(batch)
        size += len(batch)
        if size < rows:
            continue
        key = batch.column("key").to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        if cut or len(some) > 1 and some[0].column("key")[0].as_py() != key[-1]:
            table = pa.Table.from_batches(some)
            if not cut:     # the last key began before this batch
                whole = table.column("key").to_numpy()
                cut = int(np.searchsorted(whole, key[-1])) - (len(whole) - len(key))
            cut += len(table) - len(key)
            yield table.slice(0, cut)
            some = table.slice(cut).to_batches()
            size = len(table) - cut
    if size:
        yield pa.Table.from_batches(some)


def _meet(batches):
    """Rows (key, lead, row, doc, far) sorted by key -> the pairs of ``_unmet``."""
    for table in _keys_together(batches, UNMET):
        col = [table.column(c).to_numpy() for c in ("key", "lead", "row", "doc", "far")]
        a, b = _unmet(*col)
        for lo in range(0, len(a), MET):
            yield pa.RecordBatch.from_arrays(
                [pa.array(a[lo:lo + MET]), pa.array(b[lo:lo + MET])], names=["a", "b"])
    free_memory()


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_FOUND = "kind_a long, kind_b long, similarity double, x1 long, x2 long, y1 long, y2 long"


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """Within the block, few rows go to Python at once: some hold whole passages."""
    old = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(BATCH))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, old)


def near_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  min_words: int = 50, similarity: float = 0.8,
                  chunk_bytes: int = CHUNK) -> DataFrame:
    """Verified links between passages of different documents: ``doc_a``, ``doc_b``,
    ``similarity`` and the word ranges ``start_a`` .. ``end_b`` (ends exclusive).

    Words are what ASCII white space parts, A-Z lower-cased. Each passage is compared with the
    leaders that it is alike to around a common key, and, where it is not linked to one there,
    with all others alike to that leader; every stretch that two compared passages have in
    common is a link. Passages linked to the same leader are not compared with each other. Null and empty texts, and texts of
    fewer than ``min_words`` words, have no passages. Rows with a null id take no part; rows
    that share an id are one document and are not linked to each other. An empty table gives
    no links. Texts of any length are handled whole.
    """
    width = min_words - SHINGLE + 1
    if width < 2 or not 0 < similarity < 1:
        raise ValueError("min_words must be 6 or more, similarity between 0 and 1")
    rows = docs.where(F.col(id_col).isNotNull())
    parts = max(1, -(-text_bytes(rows, text_col) // chunk_bytes))
    src = rows.select(F.col(id_col).cast("long").alias("__id"), binary_text(text_col).alias("__t"),
                      F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(parts)).alias("__chunk"))
    keys = src.select(F.col("__chunk").alias("chunk"), F.col("__t").alias("t")).mapInPandas(
        _send_keys(width, parts), "bucket long, chunk long, hashes binary, twice binary")
    # Texts go to Python a few at a time, too: batches of them are held twice on their way.
    with small_batches(docs.sparkSession):
        shared, folder = materialize(keys.groupBy("bucket").applyInPandas(
            _shared_anchors, "chunk long, body binary"), "passages-shared", with_path=True)
    passages, found = materialize(
        src.groupBy("__chunk").cogroup(shared.groupBy("chunk")).applyInArrow(
            _candidates(width), "pid long, doc long, start long, body binary, keys binary"),
        "passages-found", with_path=True)
    delete_path(docs.sparkSession, folder)

    def unpack(part):
        def run(batches):
            for batch in batches:
                bodies = batch.column(3).to_pylist()
                for lo, hi in slices(bodies, UNPACKED):
                    yield keys_of(batch.slice(lo, hi - lo), bodies[lo:hi], part, KEY_PARTS)
        return run

    # Leaders and the rows alike to them. The keys are shuffled a part at a time: sorted ones
    # take more disk than all the rest. No link comes of a body shorter than a passage (the
    # places of its keys are too far apart); its rows take part as leaders only.
    bodies = passages.select("pid", "doc", F.when(
        F.octet_length("body") >= 8 * width, 1).otherwise(0).alias("long"), "keys")
    stars = []
    for part in range(KEY_PARTS):
        keyed = bodies.mapInArrow(unpack(part), "key long, pid long, doc long, c1 int, c2 int, "
                                  "near binary, long int")
        with small_batches(docs.sparkSession):
            stars.append(materialize(
                keyed.repartition("key").sortWithinPartitions("key", "doc", "pid").mapInArrow(
                    _leaders, "key long, a long, doc_a long, b long, doc_b long, c1 int, c2 int, "
                    "long_a int, long_b int"), "passages-stars"))
    stars = functools.reduce(DataFrame.unionByName, stars)
    # Passages of equal shingles are of one kind, named by its least passage: what two of them
    # have in common is found once for their kinds.
    marked = passages.select("pid", "doc", "start", F.sha2("body", 256).alias("digest"))
    kinds = marked.groupBy("digest").agg(F.min("pid").alias("kind"))
    ids = materialize(marked.join(kinds, "digest").select("pid", "doc", "start", "kind"),
                      "passages-kinds")
    bodies = materialize(passages.select(F.col("pid").alias("kind"), "body").join(
        ids.select("kind").distinct(), "kind", "left_semi"), "passages-bodies")
    delete_path(docs.sparkSession, found)

    def check(batches):
        for batch in batches:
            kind_a, kind_b = (batch.column(c).to_numpy() for c in ("kind_a", "kind_b"))
            one, two = batch.column("body_a"), batch.column("body_b")
            order = np.argsort(kind_b, kind="stable")
            out = []
            for rows in np.split(order, np.flatnonzero(np.diff(kind_b[order])) + 1):
                many = [np.frombuffer(one[i].as_buffer(), np.uint64) for i in rows.tolist()]
                b = np.frombuffer(two[int(rows[0])].as_buffer(), np.uint64)
                for i, got in zip(rows.tolist(), verify_each(many, b, similarity, width)):
                    out += [(i, *x) for x in got]
            i, *rest = (np.array(x, dtype=t) for x, t in zip(
                zip(*out) if out else [()] * 6, ("i8", "f8", "i8", "i8", "i8", "i8")))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (kind_a[i], kind_b[i], *rest)],
                names=[c.split()[0] for c in _FOUND.split(", ")])
        free_memory()

    def verified(pairs: DataFrame, name: str, before=None):
        """Links of the pairs; the pairs of kinds that were compared and what they gave, with
        those of ``before``, which are not compared again."""
        a = ids.select(*(F.col(c).alias(f"{c}_a") for c in ids.columns)).withColumnRenamed("pid_a", "a")
        b = ids.select(*(F.col(c).alias(f"{c}_b") for c in ids.columns)).withColumnRenamed("pid_b", "b")
        pairs = materialize(pairs.join(a, "a").join(b, "b"), name)
        todo = pairs.select("kind_a", "kind_b").distinct()
        if before:
            todo = todo.join(before[0], ["kind_a", "kind_b"], "left_anti")
        todo = materialize(todo, name)
        one = bodies.select(F.col("kind").alias("kind_a"), F.col("body").alias("body_a"))
        two = bodies.select(F.col("kind").alias("kind_b"), F.col("body").alias("body_b"))
        # Each pair carries a body through a shuffle, so PAIRS of them at a time; those of one
        # body together, which is looked up in once for a batch of them.
        parts = max(1, -(-todo.count() // PAIRS))
        done = [before[1]] if before else []
        for part in range(parts):
            some = todo.where(F.pmod(F.xxhash64("kind_b"), F.lit(parts)) == part)
            with small_batches(docs.sparkSession):
                done.append(materialize(some.join(one, "kind_a").join(two, "kind_b").mapInArrow(
                    check, _FOUND), name))
        done = functools.reduce(DataFrame.unionByName, done)
        links = materialize(pairs.join(done, ["kind_a", "kind_b"]).select(
            "a", "b", "doc_a", "doc_b", "similarity", (F.col("start_a") + F.col("x1")).alias("start_a"),
            (F.col("start_a") + F.col("x2") + SHINGLE - 1).alias("end_a"),
            (F.col("start_b") + F.col("y1")).alias("start_b"),
            (F.col("start_b") + F.col("y2") + SHINGLE - 1).alias("end_b")), name)
        return links, (todo, done)

    def pairs(df: DataFrame) -> DataFrame:
        return df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    todo = materialize(pairs(stars.where("doc_a <> doc_b and long_a + long_b = 2")), "passages-pairs")
    first, known = verified(todo, "passages-first")
    # A row that is not linked to its leader by a stretch that holds the key's place (or lies in
    # the leader's own document) meets all others that are alike to that leader.
    sides = first.select("a", "b", "start_b", "end_b").unionByName(
        first.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("start_a").alias("start_b"),
                     F.col("end_a").alias("end_b"))).select(
        F.col("a").alias("sa"), F.col("b").alias("sb"), "start_b", "end_b")
    astray = materialize(
        stars.where("long_b = 1").join(sides, (F.col("a") == F.col("sa")) & (F.col("b") == F.col("sb"))
                   & (F.col("start_b") <= F.col("c1")) & (F.col("c2") <= F.col("end_b") - SHINGLE),
                   "left_anti")
        .select("key", F.col("a").alias("lead"), F.col("b").alias("row"), F.col("doc_b").alias("doc"),
                F.lit(True).alias("far")).distinct(), "passages-astray")
    others = stars.where("long_b = 1").select(
        "key", F.col("a").alias("lead"), F.col("b").alias("row"), F.col("doc_b").alias("doc"),
        F.lit(False).alias("far"))
    rest = astray.unionByName(others).repartition("key").sortWithinPartitions("key").mapInArrow(
        _meet, "a long, b long").distinct()
    rest = materialize(rest.join(todo, ["a", "b"], "left_anti"), "passages-rest")
    return first.unionByName(verified(rest, "passages-second", known)[0]).drop("a", "b")


def passage_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   min_words: int = 50, similarity: float = 0.8) -> DataFrame:
    """One row per id: ``class_id`` (smallest id reachable over links, itself included),
    ``n_links`` (documents at the other end of a link of ``near_passages``), ``partner``
    (smallest id at the other end of a link) and ``spans`` (word ranges of its linked passages,
    merged, as start and end). An id without links is its own class.

    Null and empty texts have no passages and are their own class; rows without an id get no
    row; rows that share an id are one document. Ties: classes and partners are smallest ids.
    Texts of any length are read whole. An empty table gives an empty result; other columns are
    not read, whatever their names."""
    links = materialize(near_passages(docs, id_col, text_col, min_words, similarity),
                        "passages-links")
    sides = links.select(F.col("doc_a").alias("d"), F.col("doc_b").alias("o"),
                         F.struct(F.col("start_a").alias("start"), F.col("end_a").alias("end"))
                         .alias("s")).unionByName(
        links.select(F.col("doc_b").alias("d"), F.col("doc_a").alias("o"),
                     F.struct(F.col("start_b").alias("start"), F.col("end_b").alias("end"))
                     .alias("s")))
    # Distinct spans combine map-side: a head of many links has few of them.
    spans = sides.groupBy("d").agg(F.array_sort(F.collect_set("s")).alias("s"))
    merged = spans.select("d", F.aggregate(
        "s", F.array().cast("array<struct<start:bigint,end:bigint>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["end"] >= x["start"]),
            F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(
                F.get(acc, F.size(acc) - 1)["start"].alias("start"),
                F.greatest(F.get(acc, F.size(acc) - 1)["end"], x["end"]).alias("end")))))
        .otherwise(F.concat(acc, F.array(x)))).alias("spans"))
    partners = sides.groupBy("d").agg(F.count_distinct("o").alias("n_links"),
                                      F.min("o").alias("partner"))
    labels = connected_components(links.select(
        F.least("doc_a", "doc_b").alias("a"), F.greatest("doc_a", "doc_b").alias("b")).distinct())
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    ids = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("__d")).distinct()
    return (ids.join(labels, ids["__d"] == labels["node"], "left")
            .join(merged.withColumnRenamed("d", "__m"), F.col("__d") == F.col("__m"), "left")
            .join(partners.withColumnRenamed("d", "__p"), F.col("__d") == F.col("__p"), "left")
            .select(F.col("__d").alias(id_col), F.coalesce("component", "__d").alias("class_id"),
                    F.coalesce("n_links", F.lit(0)).alias("n_links"), "partner",
                    F.coalesce("spans", none).alias("spans")))
