"""SimHash near-duplicates by anchor-point covering.

A 64-bit fingerprint is cut into two blocks of 32 bits. Fingerprints that differ in at most d
bits differ in at most d // 2 bits of one block, so a point halfway between them is within
r = ceil(d // 2 / 2) bits of both there. Anchors of a block are the words of a covering code:
the perfect binary Golay code (covering radius 3) on 23 bits, with the other 9 bits taken as
they are. Each fingerprint is copied to the anchor of every point within r bits, that is to
each anchor within covering radius plus r that can hold such a halfway point (14 a block for
d = 4), and compared bit for bit with the others there. No pair within the distance is missed.
The copies number a fixed multiple of the distinct fingerprints at every size.
"""

from __future__ import annotations

import itertools
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import binary_text, drop_rows, materialize, row_key
from rivulet.llm.components import connected_components

GOLAY = 0b101011100011  # generator polynomial of the binary Golay code (fixed value)


def fingerprint(text: bytes, shingle: int) -> int:
    """SimHash of a text's word shingles, repeats included, as an unsigned 64-bit number."""
    import xxhash
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        ends = list(itertools.accumulate((len(w) + 1 for w in words)))
        starts = [0, *ends]
        hash64 = xxhash.xxh64_intdigest
        hashes = [hash64(joined[s:e - 1], 42) for s, e in zip(starts, ends[shingle - 1:])]
    h = np.array(hashes, dtype="<u8")
    bits = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 14):  # bounded memory for very long texts
        part = h[at:at + (1 << 14)].view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = 4) -> DataFrame:
    """(id_col, fp): one row per input row, the fingerprint as a signed 64-bit long."""
    def run(batches):
        for pdf in batches:
            fp = np.array([fingerprint(t, shingle) for t in pdf["t"]], dtype=np.uint64)
            yield pd.DataFrame({id_col: pdf[id_col], "fp": fp.view(np.int64)})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, binary_text(text_col).alias("t")).mapInPandas(
        run, f"`{id_col}` {kind}, fp long")


@lru_cache(maxsize=1)
def _golay() -> tuple[list[np.ndarray], np.ndarray]:
    """Syndromes of the three bytes of a 23-bit word, and the error that each syndrome tells."""
    def remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GOLAY << (bit - 11)
        return word

    parts = [np.array([remainder(b << at) for b in range(1 << min(8, 23 - at))], dtype=np.uint32)
             for at in (0, 8, 16)]
    error = np.zeros(1 << 11, dtype=np.uint32)
    for weight in range(4):
        for where in itertools.combinations(range(23), weight):
            e = sum(1 << b for b in where)
            error[remainder(e)] = e
    return parts, error


def _home(word: np.ndarray) -> np.ndarray:
    """Number of the code word nearest to each 23-bit word: its twelve high bits tell it."""
    parts, error = _golay()
    syndrome = (parts[0][word & np.uint32(0xFF)] ^ parts[1][word >> np.uint32(8) & np.uint32(0xFF)]
                ^ parts[2][word >> np.uint32(16)])
    return (word ^ error[syndrome]) >> np.uint32(11)


def anchors(fp: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) pairs, without repeats: the anchors of all points within ``reach`` bits
    of each fingerprint's two blocks."""
    flips = [sum(1 << b for b in where) for weight in range(reach + 1)
             for where in itertools.combinations(range(32), weight)]
    flips = np.array(flips, dtype=np.uint32)
    keys = []
    for block in range(2):
        points = (fp >> np.uint64(32 * block)).astype(np.uint32)[:, None] ^ flips
        home = _home(points & np.uint32(0x7FFFFF)).astype(np.int64)
        home |= (points >> np.uint32(23)).astype(np.int64) << 12 | block << 21
        keys.append(home)
    keys = np.sort(np.hstack(keys), axis=1)
    new = np.ones(keys.shape, dtype=bool)
    new[:, 1:] = keys[:, 1:] != keys[:, :-1]
    row = np.broadcast_to(np.arange(len(fp))[:, None], keys.shape)
    return row[new], keys[new]


def _links(anchor: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs, sorted by anchor, that hold the links of each anchor group together: each
    pair within the distance is either given or already joined by given ones."""
    n = len(anchor)
    end = np.searchsorted(anchor, anchor, side="right")
    label = np.arange(n)

    def root(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    left, right = [], []
    i = np.arange(n)
    step = 0
    while len(i):
        step += 1
        i = i[i + step < end[i]]
        near = i[np.bitwise_count(fp[i] ^ fp[i + step]) <= max_bits]
        near = near[label[near] != label[near + step]]
        for a in near.tolist():
            x, y = root(a), root(a + step)
            if x != y:
                label[max(x, y)] = min(x, y)
                left.append(a)
                right.append(a + step)
    return np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)


def near_links(nodes: DataFrame, max_bits: int) -> DataFrame:
    """(a, b) with a < b: links between the ``rep`` of distinct fingerprints (``fp``, ``rep``).
    Within an anchor a spanning set is given instead of every pair, so that a dense group of
    n fingerprints sends fewer than n rows; links to all reachable fingerprints are kept."""
    reach = -(-(max_bits // 2) // 2)

    def place(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 2000):
                part = pdf.iloc[at:at + 2000]
                row, key = anchors(part["fp"].to_numpy().view(np.uint64), reach)
                yield pd.DataFrame({"anchor": key, "fp": part["fp"].to_numpy()[row],
                                    "rep": part["rep"].to_numpy()[row]})

    def compare(batches):
        rest = None
        for pdf in itertools.chain(batches, [None]):
            if pdf is not None:
                rest = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if rest is None or not len(rest):
                continue
            key = rest["anchor"].to_numpy()
            cut = len(key) if pdf is None else int(np.searchsorted(key, key[-1]))
            if not cut:
                continue
            fp, rep = rest["fp"].to_numpy().view(np.uint64)[:cut], rest["rep"].to_numpy()[:cut]
            left, right = _links(key[:cut], fp, max_bits)
            rest = rest.iloc[cut:].reset_index(drop=True)
            if len(left):
                yield pd.DataFrame({"a": np.minimum(rep[left], rep[right]),
                                    "b": np.maximum(rep[left], rep[right])})

    placed = nodes.select("fp", "rep").mapInPandas(place, "anchor long, fp long, rep long")
    return (placed.repartition("anchor").sortWithinPartitions("anchor")
            .mapInPandas(compare, "a long, b long").distinct())


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """One row per input row: ``id_col`` (long), ``fingerprint`` (16 hex digits),
    ``component_id`` (smallest id reachable over links, itself included).

    Null and empty texts have fingerprint zero and link like any other. Rows with a null id
    get the component of their fingerprint, null if no row of it has an id. Repeated rows
    share a fingerprint and so a component. Empty tables give an empty result.
    """
    if not 0 <= max_bits <= 10:
        raise ValueError("max_bits must lie between 0 and 10")
    src = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("__t"))
    fps = materialize(fingerprints(src, id_col, "__t", shingle), "simhash-fp")
    nodes = materialize(fps.groupBy("fp").agg(F.min(id_col).alias("rep")), "simhash-nodes")
    links = near_links(nodes.where(F.col("rep").isNotNull()), max_bits)
    labels = connected_components(links)
    classes = (nodes.join(labels, nodes["rep"] == labels["node"], "left")
               .select("fp", F.coalesce("component", "rep").alias("component_id")))
    return (fps.join(classes, "fp")
            .select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                    "component_id"))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """One row of each component, all columns: the one with the smallest id, a row without id
    only where no row has one. Rows are judged by id and text; rows without id link like any
    other."""
    if not 0 <= max_bits <= 10:
        raise ValueError("max_bits must lie between 0 and 10")
    key = row_key(id_col, F.md5(binary_text(text_col)))
    src = docs.select(key.alias("__key"), F.col(text_col).alias("__t"))
    fps = fingerprints(src, "__key", "__t", shingle)
    rows = materialize(fps.groupBy("fp", "__key").agg(F.count(F.lit(1)).alias("n")), "simhash-fp")
    number = F.expr("try_cast(substring(substring_index(__key, ':', 1), 2) as bigint)")
    rows = rows.withColumn("id", number).withColumn("least", F.struct(
        F.col("id").isNull().alias("none"), "id", "__key"))
    nodes = materialize(rows.groupBy("fp").agg(F.min("least").alias("least")), "simhash-nodes")
    labels = connected_components(near_links(nodes.select("fp", F.col("fp").alias("rep")), max_bits))
    classes = (nodes.join(labels, nodes["fp"] == labels["node"], "left")
               .select("fp", "least", F.coalesce("component", "fp").alias("class")))
    best = classes.groupBy("class").agg(F.min("least").alias("best"))
    kept = classes.join(best, "class").select("fp", F.col("best.__key").alias("__best"))
    fate = materialize(
        rows.join(kept, "fp").select("__key", (F.col("__key") == F.col("__best")).alias("kept"), "n")
        .where("not kept or n > 1").select("__key", "kept"), "simhash-fate")
    return drop_rows(docs, key, fate)
