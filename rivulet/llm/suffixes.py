"""Repeated byte strings across documents, by a distributed sparse suffix array.

A string of ``min_len`` bytes that two documents share is found at one of its suffixes: those
that start at an anchor, the gram of GRAM bytes with the least hash in some window of
``min_len`` bytes. Each window holds its anchor at a place that its own bytes decide, so equal
windows meet at equal anchors, and one suffix in about fourteen is enough.

1. Anchor hashes of all documents are dealt out by hash; an anchor that only one document
   holds cannot start a repeat and goes no further.
2. What is left is cut into the stretches of text that belong to one anchor. Splitters sampled
   from the anchors' leading bytes deal the stretches into ranges of leading bytes; equal
   leading bytes always lie in the same range. Each range sorts its windows by multikey
   quicksort, eight bytes a step and only among those still equal, and gives each window the
   smallest document id that holds it. Splitters fall between different leading strings, and a
   neighbouring range whose leading bytes are equal to the splitter's is the same range, so no
   comparison across a boundary is left over.
3. The answers go back to the documents, which cut out what is covered.

Documents are handled in chunks (by a hash of the id) of CHUNK bytes. A chunk sends a stretch
once however many of its documents hold it, so a passage in a third of all documents costs one
row a chunk; no group of copies is ever gathered or paired.
"""

from __future__ import annotations

import bisect
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import binary_text, free_memory, materialize, slices, text_bytes
from rivulet.session import delete_path

GRAM = 24               # bytes of an anchor
CHUNK = 8 << 20         # bytes of text of a chunk, and of text a range answers for
SLICE = 256 << 10       # bytes handled at once by array operations: what a core's cache holds
HELD = 1_000_000        # anchors that a task holds before it sends them
LEAD = 8192             # anchors for each leading string that is sampled
SAMPLE = 20_000         # leading strings that the splitters are taken from, at most
NO_ID = np.iinfo(np.int64).max  # stands for a null id: larger than any other
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def _words(raw: np.ndarray) -> np.ndarray:
    """Big-endian number of the eight bytes from each place on (zeros beyond the end)."""
    w = np.zeros(len(raw) + 8, dtype=np.uint64)
    w[:len(raw)] = raw
    for step in (1, 2, 4):
        shifted = w << np.uint64(8 * step)
        shifted[:-step] |= w[step:]
        w = shifted
    return w[:len(raw)]


class Anchored:
    """Anchors of the windows of several texts."""

    def __init__(self, texts: list[bytes], min_len: int):
        self.min_len = min_len
        self.text = b"".join(texts)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        n = len(self.text)
        reach = min_len - GRAM + 1     # grams of a window
        if n < min_len:
            self.at = self.windows = np.zeros(0, dtype=np.int64)
            self.hash = np.zeros(0, dtype=np.uint64)
            return
        raw = np.frombuffer(self.text, dtype=np.uint8)
        w = _words(raw)
        grams = n - GRAM + 1
        h = w[:grams] * np.uint64(0x9E3779B97F4A7C15)
        h += w[8:8 + grams] * np.uint64(0xC2B2AE3D27D4EB4F)
        h += w[16:16 + grams] * np.uint64(0x165667B19E3779F9)
        del w
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        np.minimum(h, _TOP - np.uint64(1), out=h)
        # Windows that lie within one text.
        valid = np.zeros(n - min_len + 1, dtype=bool)
        for b, e in zip(self.begins.tolist(), self.ends.tolist()):
            if e - b >= min_len:
                valid[b:e - min_len + 1] = True
        low, span = h, 1
        while span < reach:
            step = min(span, reach - span)
            low = np.minimum(low[:-step], low[step:])
            span += step
        # A gram is an anchor if some valid window that holds it has it as its least.
        top = np.zeros(grams, dtype=np.uint64)
        top[:len(valid)] = np.where(valid, low, np.uint64(0))
        span = 1
        while span < reach:
            step = min(span, reach - span)
            top[step:] = np.maximum(top[step:], top[:-step])
            span += step
        self.at = np.flatnonzero(top == h)
        self.hash = h[self.at]
        self.windows = np.flatnonzero(valid)
        self._low = low

    def anchor_of(self, windows: np.ndarray) -> np.ndarray:
        """Index (into ``at``) of the first anchor of each window that has its least hash."""
        i = np.searchsorted(self.at, windows)
        low = self._low[windows]
        while (far := np.flatnonzero(self.hash[i] != low)).size:
            i[far] += 1
        return i


def _member(sorted_set: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(x), dtype=bool)
    return sorted_set[np.minimum(np.searchsorted(sorted_set, x), len(sorted_set) - 1)] == x


def _stretches(a: Anchored, shared: np.ndarray):
    """(begin, windows, anchor place) of the runs of windows with one, shared, anchor."""
    if not len(a.at):
        return ()
    good = _member(shared, a.hash)
    if not good.any():
        return ()
    # Only windows near a shared anchor can have it.
    reach = a.min_len - GRAM + 1
    near = np.zeros(len(a.text) + 1, dtype=np.int32)
    np.add.at(near, np.maximum(a.at[good] - reach + 1, 0), 1)
    np.add.at(near, a.at[good] + 1, -1)
    windows = a.windows[np.cumsum(near)[a.windows] > 0]
    anchor = a.anchor_of(windows)
    keep = good[anchor]
    windows, anchor = windows[keep], anchor[keep]
    if not len(windows):
        return ()
    new = np.ones(len(windows), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (windows[1:] != windows[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(windows)))
    return zip(windows[first].tolist(), count.tolist(), a.at[anchor[first]].tolist())


def _chunk(ids: list, texts: list[bytes], shared: np.ndarray, min_len: int):
    """All stretches of a chunk's texts. Gives (content -> [number, smallest id, anchor's
    place in it]) and per text its (begin, number) list. The order of ``texts`` decides the
    numbers: callers sort it."""
    known: dict[bytes, list] = {}
    found: list[list] = [[] for _ in texts]
    for lo, hi in slices(texts, SLICE):
        a = Anchored(texts[lo:hi], min_len)
        begins = a.begins.tolist()
        for begin, count, at in _stretches(a, shared):
            content = a.text[begin:begin + count - 1 + min_len]
            doc = bisect.bisect_right(begins, begin) - 1
            while a.ends[doc] <= begin:  # empty texts share their place with the next
                doc += 1
            entry = known.get(content)
            owner = ids[lo + doc]
            if entry is None:
                known[content] = entry = [len(known), owner, at - begin]
            elif owner < entry[1]:
                entry[1] = owner
            found[lo + doc].append((begin - begins[doc], entry[0]))
    return known, found


def packed_hashes(held: list, buckets: int) -> pd.DataFrame:
    """(bucket, chunk, hashes, twice) rows of ``held`` (chunk, document, hash) arrays, each hash
    once a chunk; ``twice`` marks those of several documents."""
    chunk, doc, h = (np.concatenate(x) for x in zip(*held))
    bucket = (h % np.uint64(buckets)).astype(np.min_scalar_type(buckets))
    # By hash, then twice in stable order by small numbers: by bucket, chunk and hash.
    order = np.argsort(h)
    order = order[np.argsort(chunk[order], kind="stable")]
    order = order[np.argsort(bucket[order], kind="stable")]
    bucket, chunk, doc, h = bucket[order], chunk[order], doc[order], h[order]
    del order
    part = np.ones(len(h), dtype=bool)
    part[1:] = (bucket[1:] != bucket[:-1]) | (chunk[1:] != chunk[:-1])
    new = part.copy()
    new[1:] |= h[1:] != h[:-1]
    other = np.zeros(len(h), dtype=bool)
    other[1:] = ~new[1:] & (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    twice = np.logical_or.reduceat(other, first)
    bucket, chunk, h, part = bucket[first], chunk[first], h[first], part[first]
    edges = np.append(np.flatnonzero(part), len(h))
    spans = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
    return pd.DataFrame({"bucket": bucket[edges[:-1]].astype(np.int64),
                         "chunk": chunk[edges[:-1]].astype(np.int64),
                         "hashes": [h[x:y].tobytes() for x, y in spans],
                         "twice": [np.packbits(twice[x:y]).tobytes() for x, y in spans]})


def _send_anchors(min_len: int, buckets: int):
    """Task of step 1: ``packed_hashes`` of the anchors, each hash once a chunk and send. Rows
    of bucket -1 hold sampled leads."""
    small = np.min_scalar_type(buckets)

    def run(batches):
        held, size, docs, leads = [], 0, 0, []
        for pdf in batches:
            chunks = pdf["chunk"].to_numpy().astype(small)
            order = np.argsort(chunks, kind="stable")
            texts, chunks = pdf["t"].to_numpy()[order].tolist(), chunks[order]
            for lo, hi in slices(texts, SLICE):
                a = Anchored(texts[lo:hi], min_len)
                if not len(a.at):
                    continue
                doc = np.searchsorted(a.ends, a.at, side="right")
                held.append((chunks[lo:hi][doc], docs + doc, a.hash))
                docs += hi - lo
                size += len(a.at)
                leads += [(int(a.hash[i]) * 0x9E3779B97F4A7C15 % (1 << 63),
                           a.text[a.at[i]:a.at[i] + GRAM])
                          for i in range(0, len(a.at), LEAD)]
                if size >= HELD:
                    yield packed_hashes(held, buckets)
                    held, size = [], 0
        if held:
            yield packed_hashes(held, buckets)
            held = []
        if leads:
            leads = sorted(leads)[:SAMPLE // 16]
            yield pd.DataFrame({"bucket": -1, "chunk": [k for k, _ in leads],
                                "hashes": [v for _, v in leads], "twice": b""})
        free_memory()
    return run


def _shared_anchors(pdf: pd.DataFrame) -> pd.DataFrame:
    """Step 1, a bucket: hashes of more than one document, for each chunk that holds them."""
    sizes = np.array([len(x) // 8 for x in pdf["hashes"]])
    h = np.frombuffer(b"".join(pdf["hashes"]), dtype=np.uint64)
    twice = np.concatenate([np.unpackbits(np.frombuffer(t, np.uint8), count=n)
                            for t, n in zip(pdf["twice"], sizes.tolist())]).astype(bool)
    chunk, sent = np.repeat(pdf["chunk"].to_numpy(), sizes), np.sort(h)
    more = np.unique(np.concatenate([sent[1:][sent[1:] == sent[:-1]], h[twice]]))
    keep = _member(more, h)
    h, chunk = h[keep], chunk[keep]
    order = np.lexsort((h, chunk))
    h, chunk = h[order], chunk[order]
    edges = np.concatenate(([0], np.flatnonzero(chunk[1:] != chunk[:-1]) + 1, [len(h)]))
    if not len(h):
        edges = np.zeros(1, dtype=np.int64)
    return pd.DataFrame({"chunk": chunk[edges[:-1]],
                         "body": [np.unique(h[x:y]).tobytes()
                                  for x, y in zip(edges[:-1], edges[1:])]})


def _load(left: pa.Table, right: pa.Table):
    """A chunk: row order (by id, then text), ids, texts, shared hashes."""
    ids = [NO_ID if i is None else i for i in left.column("__id").to_pylist()]
    texts = left.column("__t").to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
    kinds = right.column("kind").to_pylist()
    bodies = right.column("body").to_pylist()
    shared = [np.frombuffer(b, np.uint64) for k, b in zip(kinds, bodies) if k == 0]
    shared = np.unique(np.concatenate(shared)) if shared else np.zeros(0, np.uint64)
    answers = [b for k, b in zip(kinds, bodies) if k == 1]
    return order, [ids[i] for i in order], [texts[i] for i in order], shared, answers


def _send_stretches(min_len: int, splitters: list[bytes]):
    """Step 2, a chunk: its stretches by range of leading bytes, packed and compressed."""
    schema = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("body", pa.binary())])

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        free_memory()  # the last chunk's
        order, ids, texts, shared, _ = _load(left, right)
        if not texts or not len(shared):
            return schema.empty_table()
        known, _ = _chunk(ids, texts, shared, min_len)
        by: dict[int, list] = {}
        for content, (number, owner, at) in known.items():
            to = bisect.bisect_right(splitters, content[at:at + GRAM])
            by.setdefault(to, []).append((number, owner, content))
        out = []
        for to, rows in by.items():
            rows.sort(key=lambda r: r[2])
            numbers, owners, contents = zip(*rows)
            out.append(zlib.compress(
                struct.pack("<q", len(rows)) + np.array(numbers, "<i4").tobytes()
                + np.array(owners, "<i8").tobytes()
                + np.array([len(c) for c in contents], "<i4").tobytes() + b"".join(contents), 1))
        chunk, to = key[0].as_py(), list(by)
        del known, by
        free_memory()
        return pa.table([to, [chunk] * len(to), out], schema=schema)
    return run


def equal_windows(raw: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Group number of each window (``length`` bytes of ``raw`` from ``starts``): equal numbers
    for equal bytes. Multikey quicksort by words of eight bytes: a step sorts only windows
    that are equal so far and not alone."""
    words = _words(np.concatenate([raw, np.zeros(8, np.uint8)]))
    offsets = [*range(0, length - 7, 8)]
    if offsets[-1] + 8 < length:
        offsets.append(length - 8)
    group = np.zeros(len(starts), dtype=np.int64)
    active = np.arange(len(starts))
    for turn, offset in enumerate(offsets):
        w = words[starts[active] + offset]
        order = np.argsort(w) if not turn else np.lexsort((w, group[active]))
        rows, w = active[order], w[order]
        old = group[rows]
        new = np.ones(len(rows), dtype=bool)
        new[1:] = (w[1:] != w[:-1]) | (old[1:] != old[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(rows)))
        # A group is named by the place of its first row, which no other group can have.
        group[rows] = np.repeat(rows[first], size)
        active = rows[np.repeat(size > 1, size)]
        if not len(active):
            break
    return group


def _answer(min_len: int):
    """Step 2, a range: for each chunk, the stretches with a smaller owner elsewhere, as
    (number, runs), runs of (first window, smallest id)."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        known: dict[bytes, int] = {}
        least: list[int] = []
        sent = []
        for chunk, body in zip(pdf["chunk"].tolist(), pdf["body"]):
            body = zlib.decompress(body)
            n = struct.unpack_from("<q", body)[0]
            numbers = np.frombuffer(body, "<i4", n, 8)
            owners = np.frombuffer(body, "<i8", n, 8 + 4 * n).tolist()
            ends = np.cumsum(np.frombuffer(body, "<i4", n, 8 + 12 * n)) + 8 + 16 * n
            at, mine = 8 + 16 * n, []
            for owner, end in zip(owners, ends.tolist()):
                content = body[at:end]
                at = end
                i = known.setdefault(content, len(least))
                if i == len(least):
                    least.append(owner)
                elif owner < least[i]:
                    least[i] = owner
                mine.append(i)
            sent.append((chunk, numbers, owners, mine))
        contents = list(known)
        raw = np.frombuffer(b"".join(contents), dtype=np.uint8)
        sizes = np.array([len(c) for c in contents], dtype=np.int64)
        begins, counts = np.cumsum(sizes) - sizes, sizes - min_len + 1
        stops = np.cumsum(counts)
        first = stops - counts
        starts = np.repeat(begins - first, counts) + np.arange(stops[-1])
        owner = np.repeat(np.array(least, dtype=np.int64), counts)
        group = equal_windows(raw, starts, min_len)
        best = np.full(len(starts), NO_ID)
        np.minimum.at(best, group, owner)
        best = best[group]
        # Runs of windows with one answer.
        new = np.ones(len(best), dtype=bool)
        new[1:] = best[1:] != best[:-1]
        new[first] = True
        run_at = np.flatnonzero(new)
        run_first = np.searchsorted(run_at, first).tolist() + [len(run_at)]
        run_id = best[run_at].tolist()
        run_window = (run_at - np.repeat(first, counts)[run_at]).tolist()
        out = []
        for chunk, numbers, owners, mine in sent:
            which, runs, windows, values = [], [], [], []
            for number, local, i in zip(numbers.tolist(), owners, mine):
                lo, hi = run_first[i], run_first[i + 1]
                if hi - lo == 1 and run_id[lo] == local:
                    continue  # the chunk's own smallest id is the answer
                which.append(number)
                runs.append(hi - lo)
                windows += run_window[lo:hi]
                values += run_id[lo:hi]
            if which:
                out.append((chunk, struct.pack("<qq", len(which), len(windows))
                            + np.array(values, "<i8").tobytes() + np.array(which, "<i4").tobytes()
                            + np.array(runs, "<i4").tobytes() + np.array(windows, "<i4").tobytes()))
        return pd.DataFrame(out, columns=["chunk", "body"])
    return run


def _cut(min_len: int, carry: list[str], whole_chars: bool):
    """Step 3, a chunk: what is left of each text, and the removed spans."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        free_memory()  # the last chunk's
        order, ids, texts, shared, answers = _load(left, right)
        known, found = _chunk(ids, texts, shared, min_len) if len(shared) else ({}, [()] * len(texts))
        # Answers by number: one id, or runs of (first window, id).
        reply: list = [None] * len(known)
        length = [0] * len(known)
        for content, (number, owner, _) in known.items():
            reply[number], length[number] = owner, len(content)
        for body in answers:
            n, m = struct.unpack_from("<qq", body)
            values = np.frombuffer(body, "<i8", m, 16).tolist()
            at = 16 + 8 * m
            which = np.frombuffer(body, "<i4", n, at).tolist()
            runs = np.frombuffer(body, "<i4", n, at + 4 * n).tolist()
            windows = np.frombuffer(body, "<i4", m, at + 8 * n).tolist()
            pos = 0
            for number, k in zip(which, runs):
                reply[number] = (values[pos] if k == 1
                                 else list(zip(windows[pos:pos + k], values[pos:pos + k])))
                pos += k
        kept, starts, ends = [], [], []
        for doc, text, places in zip(ids, texts, found):
            spans: list[list[int]] = []
            for begin, number in places:
                r, size = reply[number], length[number]
                if isinstance(r, int):
                    if r < doc:
                        _extend(spans, begin, begin + size)
                    continue
                last = size - min_len + 1
                for (w, least), nxt in zip(r, [x for x, _ in r[1:]] + [last]):
                    if least < doc:
                        _extend(spans, begin + w, begin + nxt - 1 + min_len)
            if whole_chars:
                spans = [_whole(text, s, e) for s, e in spans]
                spans = [(s, e) for s, e in spans if s < e]
            pieces, at = [], 0
            for s, e in spans:
                pieces.append(text[at:s])
                at = e
            pieces.append(text[at:])
            kept.append(b"".join(pieces))
            starts.append([s for s, _ in spans])
            ends.append([e for _, e in spans])
        rows = left.take(pa.array(order, type=pa.int64()))
        del known, found, reply
        free_memory()
        return pa.table([rows.column(c) for c in carry]
                        + [pa.array([len(t) for t in texts], pa.int64()), pa.array(kept, pa.binary()),
                           pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))],
                        names=[*carry, "n_bytes", "kept", "span_starts", "span_ends"])
    return run


def _extend(spans: list[list[int]], begin: int, end: int) -> None:
    """Add a span; spans come by rising begin, touching ones become one."""
    if spans and begin <= spans[-1][1]:
        spans[-1][1] = max(spans[-1][1], end)
    else:
        spans.append([begin, end])


def _whole(text: bytes, begin: int, end: int) -> tuple[int, int]:
    """The whole UTF-8 characters of a span."""
    while begin < end and text[begin] & 0xC0 == 0x80:
        begin += 1
    while begin < end < len(text) and text[end] & 0xC0 == 0x80:
        end -= 1
    return begin, end


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   min_len: int = 50, carry: list[str] | None = None,
                   whole_chars: bool = False, chunk_bytes: int = CHUNK) -> DataFrame:
    """One row per input row: the ``carry`` columns (the id by default), ``n_bytes``, ``kept``
    (binary: the text without its removed bytes), ``span_starts`` and ``span_ends`` (maximal
    removed runs, as byte offsets).

    A byte is removed if a string of ``min_len`` bytes over it also starts in a document with
    a smaller id (the id as a long); strings are judged on the input and never cross documents.
    Null texts are empty. A null id counts as larger than all others, and rows that share an
    id are one document: they do not remove each other's text. Texts of any length are handled
    whole. An empty table gives an empty result. ``min_len`` must be at least 32. With
    ``whole_chars`` a span gives up the parts of UTF-8 characters at its two ends, so that what
    is kept stays valid UTF-8.
    """
    if min_len < GRAM + 8:
        raise ValueError(f"min_len must be at least {GRAM + 8}")
    carry = carry or [id_col]
    if {"n_bytes", "kept", "span_starts", "span_ends", "__id", "__t", "__chunk"} & set(carry):
        raise ValueError("a carried column has the name of a result column")
    parts = max(1, -(-text_bytes(docs, text_col) // chunk_bytes))
    key = F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(parts))
    src = docs.select(*carry, F.col(id_col).cast("long").alias("__id"),
                      binary_text(text_col).alias("__t"), key.alias("__chunk"))
    anchors = src.select(F.col("__chunk").alias("chunk"), F.col("__t").alias("t")).mapInPandas(
        _send_anchors(min_len, parts), "bucket long, chunk long, hashes binary, twice binary")
    sent, folder = materialize(anchors, "suffix-anchors", with_path=True)
    leads = [bytes(r[0]) for r in sent.where("bucket < 0").orderBy("chunk", "hashes")
             .select("hashes", "chunk").limit(SAMPLE).select("hashes").collect()]
    leads = sorted(leads)
    splitters = sorted({leads[i * len(leads) // parts] for i in range(1, parts)}) if leads else []
    shared = materialize(sent.where("bucket >= 0").groupBy("bucket").applyInPandas(
        _shared_anchors, "chunk long, body binary"), "suffix-shared").select(
        "chunk", F.lit(0).alias("kind"), "body")
    delete_path(docs.sparkSession, folder)  # nothing reads the unshared anchors any more
    stretches = src.select("__id", "__t", "__chunk").groupBy("__chunk").cogroup(
        shared.groupBy("chunk")).applyInArrow(
        _send_stretches(min_len, splitters), "bucket long, chunk long, body binary")
    answers = materialize(stretches.groupBy("bucket").applyInPandas(
        _answer(min_len), "chunk long, body binary"), "suffix-answers").select(
        "chunk", F.lit(1).alias("kind"), "body")
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return src.groupBy("__chunk").cogroup(shared.unionByName(answers).groupBy("chunk")).applyInArrow(
        _cut(min_len, carry, whole_chars),
        f"{kinds}, n_bytes long, kept binary, span_starts array<long>, span_ends array<long>")
