"""Ranked lexical search over a document FP-tree, by depth-first branch and bound.

One pass over the texts keeps each document's length and its term vector restricted to the
items' terms. Tasks then take their vectors in chunks of bounded size. A chunk's vectors,
their terms in falling document frequency, are sorted, so that documents which share frequent
terms share a path of the tree; a node stands for one run of the sorted documents. A node
knows, for each term below it, the largest tf, and the least m. From those comes a bound on
the score of every document below; an item visits the nodes with the best bounds first and
leaves a subtree when its bound is below the item's k-th best score so far. Scores of the
documents in a visited leaf are exact. Each task returns at most k rows per item, however many
documents it read.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rivulet.llm.common import binary_text, materialize, text_bytes

BLOCK_BYTES = 8 << 20      # item text whose terms a task holds at a time
CHUNK_DOCS = 16_384        # documents of one tree at most,
CHUNK_PAIRS = 1_000_000    # and (document, term) pairs of one tree, one document apart
LEAF = 32                  # documents that a node need not be split for
DEPTH = 48                 # levels of branching; what is deeper stays in one leaf
# Term bytes as they are, A-Z as a-z, everything else a blank.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32
              for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a UTF-8 text."""
    return text.translate(_FOLD).split()


def share(tf, m):
    """What one term adds to a score for each unit of its weight (64-bit, rounded down)."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Tree:
    """FP-tree of a chunk. ``ranks``/``tf`` hold the documents' vectors one after the other
    (``sizes`` entries each), ranks ascending; rank 0 is the most frequent term.

    Nodes are numbered from the root; ``first``/``last`` delimit a node's children, ``lo``/
    ``hi`` its run of documents (leaves only are scored). Terms of a document stand in sorted
    order of documents in ``doc_rank``/``doc_share`` from ``doc_at``."""

    def __init__(self, sizes, ranks, tf, m, vocabulary: int):
        n = len(sizes)
        at = np.concatenate(([0], np.cumsum(sizes)))
        keys = [r.tobytes() for r in np.split(ranks.astype(">u4"), at[1:-1])] if n else []
        self.order = np.array(sorted(range(n), key=keys.__getitem__), dtype=np.int64)
        sizes = sizes[self.order]
        self.doc_at = np.concatenate(([0], np.cumsum(sizes)))
        take = np.repeat(at[self.order] - self.doc_at[:-1], sizes) + np.arange(self.doc_at[-1])
        self.doc_rank, tf, self.m = ranks[take], tf[take], m[self.order]
        owner = np.repeat(np.arange(n), sizes)
        self.doc_share = share(tf, self.m[owner])
        self._split(n, sizes)
        self._maxima(owner, tf, vocabulary)

    def _common(self, a: int, b: int, depth: int) -> int:
        """Length of the prefix that documents ``a`` and ``b`` share, ``depth`` at least."""
        x = self.doc_rank[self.doc_at[a]:self.doc_at[a + 1]]
        y = self.doc_rank[self.doc_at[b]:self.doc_at[b + 1]]
        n = min(len(x), len(y))
        other = np.flatnonzero(x[depth:n] != y[depth:n])
        return depth + int(other[0]) if len(other) else n

    def _split(self, n: int, sizes) -> None:
        lo, hi, first, last, levels = [0], [n], [], [], [[0]]
        todo = [0]  # nodes of this level, with the prefix that their documents share
        prefix = [0]
        while todo:
            below, deeper = [], []
            for node, depth in zip(todo, prefix):
                a, b = lo[node], hi[node]
                first.append(len(lo))
                if b - a > LEAF and len(levels) <= DEPTH:
                    depth = self._common(a, b - 1, depth)
                    more = sizes[a:b] > depth
                    term = np.where(more, self.doc_rank[np.minimum(
                        self.doc_at[a:b] + depth, len(self.doc_rank) - 1)].astype(np.int64), -1)
                    cuts = np.concatenate(([0], np.flatnonzero(np.diff(term)) + 1, [b - a]))
                    if len(cuts) > 2:
                        start = 0
                        for end, after in zip(cuts[1:], [*cuts[2:], None]):
                            # Small neighbours share a leaf.
                            if after is None or after - start > LEAF:
                                lo.append(a + int(start))
                                hi.append(a + int(end))
                                below.append(len(lo) - 1)
                                deeper.append(depth)
                                start = end
                last.append(len(lo))
            todo, prefix = below, deeper
            if below:
                levels.append(below)
        self.lo, self.hi = np.array(lo), np.array(hi)
        self.first, self.last, self.levels = first, last, levels

    def _maxima(self, owner, tf, vocabulary: int) -> None:
        """Per term the nodes above it, with ``share`` at the subtree's largest tf and least m."""
        if not len(owner):
            self.node_at = np.zeros(vocabulary + 1, dtype=np.int64)
            self.node = self.node_share = np.zeros(0, dtype=np.int64)
            return
        by = np.argsort(self.doc_rank.astype(np.int64) * len(self.m) + owner)
        rank, doc, top = self.doc_rank[by], owner[by], tf[by]
        ranks, nodes, tops = [], [], []
        for level in self.levels:
            of = np.full(len(self.m), -1)
            for node in level:
                of[self.lo[node]:self.hi[node]] = node
            inside = of[doc]
            keep = inside >= 0
            r, v = rank[keep], inside[keep]
            if not len(r):
                continue
            new = np.concatenate(([0], np.flatnonzero((np.diff(r) != 0) | (np.diff(v) != 0)) + 1))
            ranks.append(r[new])
            nodes.append(v[new])
            tops.append(np.maximum.reduceat(top[keep], new))
        ranks = np.concatenate(ranks)
        by = np.argsort(ranks, kind="stable")
        self.node = np.concatenate(nodes)[by]
        least = np.array([self.m[a:b].min() for a, b in zip(self.lo, self.hi)])
        self.node_share = share(np.concatenate(tops)[by], least[self.node])
        self.node_at = np.concatenate(([0], np.cumsum(np.bincount(ranks, minlength=vocabulary))))

    def bounds(self, weights: list[tuple[int, int]]) -> np.ndarray:
        """Per node no less than the score of any document below it."""
        out = np.zeros(len(self.lo), dtype=np.int64)
        for rank, w in weights:
            a, b = self.node_at[rank], self.node_at[rank + 1]
            out[self.node[a:b]] += w * self.node_share[a:b]
        return out

    def search(self, weights: list[tuple[int, int]], dense: np.ndarray, best: list, k: int,
               ids: list) -> list:
        """``best`` (up to k of (-score, order key, id)) after this chunk's documents.
        ``dense`` is a zeroed array over all ranks."""
        for rank, w in weights:
            dense[rank] = w
        bound = self.bounds(weights)
        floor = -best[-1][0] if len(best) == k else 1
        stack = [0]
        while stack:
            node = stack.pop()
            if bound[node] < floor:
                continue
            if self.first[node] < self.last[node]:
                children = np.arange(self.first[node], self.last[node])
                children = children[bound[children] >= floor]
                stack.extend(children[np.argsort(bound[children], kind="stable")].tolist())
                continue
            lo, hi = int(self.lo[node]), int(self.hi[node])
            a, b = self.doc_at[lo], self.doc_at[hi]
            sums = np.concatenate(([0], np.cumsum(dense[self.doc_rank[a:b]] * self.doc_share[a:b])))
            score = sums[self.doc_at[lo + 1:hi + 1] - a] - sums[self.doc_at[lo:hi] - a]
            good = np.flatnonzero(score >= floor)
            if len(good):
                best = sorted(best + [(-int(score[i]), *_key(ids[self.order[lo + i]]))
                                      for i in good.tolist()])[:k]
                floor = -best[-1][0] if len(best) == k else 1
        for rank, _ in weights:
            dense[rank] = 0
        return best


def _key(value) -> tuple:
    """Order of ids as SQL sorts them: null first."""
    return (value is not None, 0 if value is None else value)


def _vectors(docs: DataFrame, vocabulary, id_col: str, text_col: str) -> DataFrame:
    """Written table (id, n, term, tf) of all documents that hold a term."""
    src = docs.select(F.col(id_col).alias("id"), binary_text(text_col).alias("t"))
    kind = src.schema["id"].dataType.simpleString()

    def run(batches):
        number = vocabulary.value
        for batch in batches:
            keep, n, sizes, terms, tfs = [], [], [0], [], []
            for i, text in enumerate(batch.column(1)):
                words = terms_of(text.as_py())
                if words:
                    keep.append(i)
                    n.append(len(words))
                    count = Counter(filter(None, map(number.get, words)))
                    terms.extend(count)
                    tfs.extend(count.values())
                    sizes.append(len(terms))
            sizes = pa.array(sizes, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep, pa.int64())), pa.array(n, pa.int64()),
                 pa.ListArray.from_arrays(sizes, pa.array(terms, pa.int32())),
                 pa.ListArray.from_arrays(sizes, pa.array(tfs, pa.int32()))],
                names=["id", "n", "term", "tf"])

    return materialize(src.mapInArrow(run, f"id {kind}, n long, term array<int>, tf array<int>"),
                       "lexical-vectors")


def _block(docs: DataFrame, items: list, k: int, id_col: str, text_col: str) -> DataFrame:
    """(item, id, score): per task the k best documents of each of ``items`` (number, terms)."""
    sc = docs.sparkSession.sparkContext
    known = {t: i + 1 for i, t in enumerate(sorted({t for _, ts in items for t in ts}))}
    vectors = _vectors(docs, sc.broadcast(known), id_col, text_col)
    n_docs, n_terms = vectors.agg(F.count(F.lit(1)), F.sum("n")).first()
    n_terms = n_terms or 0

    def count(batches):
        df = np.zeros(len(known) + 1, dtype=np.int64)
        for batch in batches:
            df += np.bincount(batch.column(0).flatten().to_numpy(), minlength=len(df))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(df[at])],
                                         names=["term", "df"])

    df = np.zeros(len(known) + 1, dtype=np.int64)
    for r in (vectors.select("term").mapInArrow(count, "term int, df long")
              .groupBy("term").agg(F.sum("df").alias("df")).collect()):  # one row per known term
        df[r["term"]] = r["df"]
    # Rank of a term: how many known terms are more frequent.
    rank = np.empty(len(df), dtype=np.int64)
    rank[np.lexsort((np.arange(len(df)), -df))] = np.arange(len(df))

    def weight(t: bytes) -> int:
        return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df[known[t]]) + 1)))

    asked = [(number, [(int(rank[known[t]]), c * weight(t)) for t, c in Counter(ts).items()])
             for number, ts in items]
    shared = sc.broadcast((rank, asked))

    def search(batches):
        rank, asked = shared.value
        best = {number: [] for number, _ in asked}
        dense = np.zeros(len(rank), dtype=np.int64)

        def close(part):
            ids = [x for p in part for x in p[0].to_pylist()]
            n, sizes, terms, tf = (np.concatenate([p[i] for p in part]) for i in range(1, 5))
            ranks = rank[terms]
            by = np.argsort(np.repeat(np.arange(len(sizes)), sizes) * len(rank) + ranks)
            m = 75 + (25 * n * n_docs) // n_terms
            tree = Tree(sizes, ranks[by], tf[by].astype(np.int64), m, len(rank))
            for number, weights in asked:
                best[number] = tree.search(weights, dense, best[number], k, ids)

        part, docs_in, pairs_in = [], 0, 0
        for batch in batches:
            for one in _cut(batch):
                if part and (docs_in + len(one[0]) > CHUNK_DOCS
                             or pairs_in + len(one[3]) > CHUNK_PAIRS):
                    close(part)
                    part, docs_in, pairs_in = [], 0, 0
                part.append(one)
                docs_in += len(one[0])
                pairs_in += len(one[3])
        if part:
            close(part)
        rows = [(number, e[2] if e[1] else None, -e[0]) for number, es in best.items() for e in es]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], id_type),
             pa.array([r[2] for r in rows], pa.int64())], names=["item", "id", "score"])

    from pyspark.sql.pandas.types import to_arrow_type
    id_type = to_arrow_type(vectors.schema["id"].dataType)
    kind = vectors.schema["id"].dataType.simpleString()
    return vectors.mapInArrow(search, f"item long, id {kind}, score long")


def _cut(batch):
    """(ids, n, sizes, terms, tfs) of parts of a batch that a chunk can hold."""
    sizes = np.diff(batch.column(2).offsets.to_numpy())
    start = pairs = 0
    for i in range(len(sizes) + 1):
        full = i < len(sizes) and i > start and (i - start == CHUNK_DOCS
                                                 or pairs + sizes[i] > CHUNK_PAIRS)
        if (i == len(sizes) and i > start) or full:
            cut = batch.slice(start, i - start)
            yield (cut.column(0), cut.column(1).to_numpy(), sizes[start:i],
                   cut.column(2).flatten().to_numpy(), cut.column(3).flatten().to_numpy())
            start, pairs = i, 0
        if i < len(sizes):
            pairs += sizes[i]


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id",
           item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Each item's ``k`` best documents with a score above 0: ``item_col``, ``rank`` (from 1),
    ``id_col``, ``score``; equal scores by ascending id, null ids first.

    Terms are the maximal matches of ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+``, A-Z
    lower-cased. With N documents that hold a term, L terms in all of them, n terms in one, df
    documents holding a term and tf its count in one: a term weighs
    w = floor(1000 ln((2N+2)/(2df+1))), a document's m is 75 + (25 n N) div L, and a score sums
    w * ((10^9 tf) div (1000 tf + 12 m)) over the item's terms, repeats included.

    Null and empty texts hold no term: such documents are not counted or found, such items get
    no row. Texts are read whole, however long. Every row of ``docs`` is a document and every
    row of ``items`` an item of its own, repeated rows and null ids included (a repeated item
    gets its rows again); empty tables give an empty result; other columns are not read. Items
    are taken in blocks of some 8 MB of text, each against all documents.
    """
    spark = docs.sparkSession
    rows = materialize(items.select(F.monotonically_increasing_id().alias("item"),
                                    F.col(item_col).alias(item_col + "_"),
                                    binary_text(text_col).alias("t")), "lexical-items")
    blocks = -(-text_bytes(items, text_col) // BLOCK_BYTES) or 1
    parts = []
    for i in range(blocks):
        block = rows.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == i)
        asked = [(r["item"], terms_of(bytes(r["t"])))
                 for r in block.select("item", "t").toLocalIterator()]  # a block's texts
        parts.append(_block(docs, asked, k, id_col, text_col))
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_first())
    top = (reduce(DataFrame.unionByName, parts)
           .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))
    return (top.join(rows.select("item", item_col + "_"), "item")
            .select(F.col(item_col + "_").alias(item_col), "rank", F.col("id").alias(id_col),
                    "score"))
