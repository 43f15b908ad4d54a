"""Language-model scores of whole texts: a log-bilinear model and a unigram base.

Words are counted over all training documents. The most frequent ones are classes of their
own; the others fall into classes by their ending, within which a word has its smoothed share.
A log-bilinear model (Mnih and Hinton, 2007) over classes predicts each token from the two
before it: the context vectors, each through a matrix of its place, are added and multiplied
with every class's vector. It is trained in numpy with noise-contrastive estimation (Mnih and
Teh, 2012): each chunk of documents trains on all its training tokens, from the same start, and
the parameters are averaged by tokens. Scores are normalised: because the model is bilinear, the
normalisers of all contexts are one matrix product.

Documents are handled in chunks by a hash of id and text. A chunk sends each of its words once with
its count, words are summed by a hash of the word, and each chunk gets back the totals of its
own words. Nothing that grows with the corpus is held in one task or on the driver.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import binary_text, fold, materialize, text_bytes

CHUNK = 8 << 20     # bytes of text of a chunk, and of text for one range of words
VOCABULARY = 400    # words that are classes of their own
ENDINGS = 63        # classes of the other words
DIMS = 16
NOISE = 10          # noise tokens a token counts against
SAMPLE = 64         # noise tokens drawn for a batch
BATCH = 8192        # distinct (context, token) events of a batch
RATE = 0.15
SMOOTH = 0.1
SUMS = 64           # groups in which the chunks' parameters are added up


def words_of(text: bytes) -> list[bytes]:
    """Words of a text, A-Z lower-cased, parted by ASCII white space."""
    return text.lower().split()


def ending(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % ENDINGS


# -- counting ----------------------------------------------------------------------------
def _count(buckets: int):
    """A chunk: its words with their training counts, by a hash of the word."""
    schema = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("words", pa.binary()),
                        ("counts", pa.binary())])

    def run(key, rows):
        counts: Counter = Counter()
        others: set = set()
        for text, held in zip(rows.column("__t").to_pylist(), rows.column("__held").to_pylist()):
            if held:
                others.update(words_of(text))
            else:
                counts.update(words_of(text))
        by: dict[int, list[bytes]] = {}
        for w in sorted(others.union(counts)):
            by.setdefault(zlib.crc32(w) % buckets, []).append(w)
        chunk = key[0].as_py()
        return pa.table([list(by), [chunk] * len(by), [b" ".join(ws) for ws in by.values()],
                         [np.array([counts[w] for w in ws], "<i8").tobytes() for ws in by.values()]],
                        schema=schema)
    return run


def _total(pdf: pd.DataFrame) -> pd.DataFrame:
    """A range of words: totals back to each chunk (kind 0), its most frequent words (kind 1),
    and tokens and distinct training words by ending (kind 2)."""
    total: dict[bytes, int] = {}
    sent = []
    for chunk, words, counts in zip(pdf["chunk"].tolist(), pdf["words"], pdf["counts"]):
        words = words.split(b" ")
        for w, n in zip(words, np.frombuffer(counts, "<i8").tolist()):
            total[w] = total.get(w, 0) + n
        sent.append((chunk, words))
    out = [(0, chunk, b" ".join(words), np.array([total[w] for w in words], "<i8").tobytes(), 0, 0)
           for chunk, words in sent]
    top = sorted((w for w in total if total[w]), key=lambda w: (-total[w], w))[:VOCABULARY]
    out += [(1, 0, w, b"", total[w], 0) for w in top]
    tokens, distinct = Counter(), Counter()
    for w, n in total.items():
        if n:
            k = ending(w)
            tokens[k] += n
            distinct[k] += 1
    out += [(2, k, b"", b"", tokens[k], distinct[k]) for k in tokens]
    return pd.DataFrame(out, columns=["kind", "chunk", "words", "counts", "n", "v"])


# -- the model ---------------------------------------------------------------------------
@dataclass
class Classes:
    """Classes of tokens: 0 .. len(words)-1 words, then the end, then the endings; the last
    number stands for what is before a text. Counts are of training tokens."""
    words: dict
    tokens: np.ndarray     # by class
    distinct: np.ndarray   # by ending: words that are no class of their own
    total: int             # training tokens
    vocabulary: int        # distinct training tokens

    @property
    def end(self) -> int:
        return len(self.words)

    @property
    def start(self) -> int:
        return len(self.words) + 1 + ENDINGS

    def of(self, word: bytes) -> int:
        at = self.words.get(word)
        return len(self.words) + 1 + ending(word) if at is None else at


def _start(classes: Classes) -> dict:
    """Parameters before training: the unigram distribution."""
    rng = np.random.default_rng(11)
    m = classes.start
    noise = (classes.tokens + SMOOTH) / (classes.tokens + SMOOTH).sum()
    return {"r": rng.normal(0, 0.3, (m + 1, DIMS)), "q": rng.normal(0, 0.1, (m, DIMS)),
            "b": np.log(noise), "c1": np.eye(DIMS), "c2": np.eye(DIMS) * 0.5}


def _scatter(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(at, rows[:, d], n) for d in range(rows.shape[1])], axis=1)


def train(events: np.ndarray, counts: np.ndarray, classes: Classes, seed: int) -> dict:
    """One pass of noise-contrastive estimation over events (before, last, token) with their
    counts, by AdaGrad."""
    p, m = _start(classes), classes.start
    noise = np.exp(p["b"])
    rng = np.random.default_rng(seed)
    memory = {k: np.full(v.shape, 1e-2) for k, v in p.items()}
    order = rng.permutation(len(events))
    shift = np.log(NOISE * noise)
    for at in range(0, len(order), BATCH):
        pick = order[at:at + BATCH]
        c2, c1, w = events[pick].T
        weight = counts[pick] / counts[pick].sum()
        z = rng.choice(m, SAMPLE, p=noise)
        x1, x2 = p["r"][c1], p["r"][c2]
        h = x1 @ p["c1"] + x2 @ p["c2"]
        good = (h * p["q"][w]).sum(axis=1) + p["b"][w] - shift[w]
        bad = h @ p["q"][z].T + p["b"][z] - shift[z]
        g = -weight / (1 + np.exp(np.clip(good, -30, 30)))
        n = weight[:, None] * (NOISE / SAMPLE) / (1 + np.exp(-np.clip(bad, -30, 30)))
        dh = g[:, None] * p["q"][w] + n @ p["q"][z]
        dq = _scatter(w, g[:, None] * h, m)
        np.add.at(dq, z, n.T @ h)
        db = np.bincount(w, g, m)
        np.add.at(db, z, n.sum(axis=0))
        dr = _scatter(c1, dh @ p["c1"].T, m + 1) + _scatter(c2, dh @ p["c2"].T, m + 1)
        for k, d in (("r", dr), ("q", dq), ("b", db), ("c1", x1.T @ dh), ("c2", x2.T @ dh)):
            d *= BATCH / 64
            memory[k] += d * d
            p[k] -= RATE * d / np.sqrt(memory[k])
    return p


def _pack(p: dict) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in ("r", "q", "b", "c1", "c2")])


def _unpack(flat: np.ndarray, classes: Classes) -> dict:
    out, at = {}, 0
    for k, v in _start(classes).items():
        out[k] = flat[at:at + v.size].reshape(v.shape)
        at += v.size
    return out


def tables(p: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log probabilities in parts: of token w after (c2, c1) it is
    one[c1, w] + two[c2, w] - norm[c2, c1]."""
    one = p["r"] @ p["c1"] @ p["q"].T + p["b"]
    two = p["r"] @ p["c2"] @ p["q"].T
    top1, top2 = one.max(axis=1, keepdims=True), two.max(axis=1, keepdims=True)
    norm = np.log(np.exp(two - top2) @ np.exp(one - top1).T) + top2 + top1.T
    return one, two, norm


def _contexts(ids: np.ndarray, first: np.ndarray, start: int):
    """The classes before each token: (before, last)."""
    last = np.empty_like(ids)
    last[1:] = ids[:-1]
    last[first] = start
    before = np.empty_like(ids)
    before[2:] = ids[:-2]
    before[first] = start
    second = first + 1
    before[second[second < len(ids)]] = start
    return before, last


def _learn(classes):
    """A chunk: parameters trained on its training texts, with their tokens. Events are counted
    and sorted before training, so the order of the rows does not matter."""
    schema = pa.schema([("chunk", pa.int64()), ("n", pa.int64()), ("sums", pa.binary())])

    def run(key, rows):
        c, m = classes.value, classes.value.start + 1
        seen, known = [], {}
        keys = np.zeros(0, np.int64)
        counts = np.zeros(0, np.int64)

        def merge():
            nonlocal keys, counts, seen
            keys, place = np.unique(np.concatenate([keys, *(k for k, _ in seen)]), return_inverse=True)
            counts = np.bincount(place, np.concatenate([counts, *(n for _, n in seen)])).astype(np.int64)
            seen = []

        column = rows.column("__t")
        for at in range(0, len(column), 500):
            ids, sizes = [], []
            for t in column.slice(at, 500).to_pylist():
                words = words_of(t)
                for w in words:
                    i = known.get(w)
                    if i is None:
                        i = c.of(w)
                        if len(known) < 400_000:  # a memo, not a limit
                            known[w] = i
                    ids.append(i)
                ids.append(c.end)
                sizes.append(len(words) + 1)
            ids = np.array(ids, dtype=np.int64)
            first = np.cumsum(sizes) - np.array(sizes)
            before, last = _contexts(ids, first, c.start)
            seen.append(np.unique((before * m + last) * m + ids, return_counts=True))
            if sum(len(k) for k, _ in seen) > 1_500_000:
                merge()
        if not seen and not len(keys):
            return schema.empty_table()
        if seen:
            merge()
        events = np.stack([keys // (m * m), keys // m % m, keys % m], axis=1)
        chunk = key[0].as_py()
        flat = _pack(train(events, counts, c, chunk)) * counts.sum()
        return pa.table([[chunk], [int(counts.sum())], [flat.tobytes()]], schema=schema)
    return run


def _add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Sums of the chunks' parameters, always added up in the same order."""
    flat = sum(np.frombuffer(s) for s in pdf.sort_values("chunk")["sums"])
    return pd.DataFrame({"part": [key[0]], "n": [int(pdf["n"].sum())], "sums": [flat.tobytes()]})


# -- scoring -----------------------------------------------------------------------------
def _score(shared, id_col: str):
    """A chunk: scores of its texts from the totals of its words."""
    def run(rows: pa.Table, replies: pa.Table) -> pa.Table:
        c, (one, two, norm), ends = shared.value
        words, totals = [], []
        for ws, ns in zip(replies.column("words").to_pylist(), replies.column("counts").to_pylist()):
            words += ws.split(b" ")
            totals.append(np.frombuffer(ns, "<i8"))
        count = np.concatenate([*totals, [ends]]).astype(np.float64)  # the end comes last
        at = {w: i for i, w in enumerate(words)}
        kinds = np.array([c.of(w) for w in words] + [c.end], dtype=np.int64)
        base = np.log10((count + SMOOTH) / (c.total + SMOOTH * (c.vocabulary + 1)))
        rare = kinds > c.end
        inside = np.zeros(len(count))
        group = kinds[rare] - c.end - 1
        inside[rare] = np.log((count[rare] + SMOOTH) / (
            c.tokens[kinds[rare]] + SMOOTH * (c.distinct[group] + 1)))
        out = []
        texts = rows.column("__t").to_pylist()
        for lo in range(0, len(texts), 500):
            ids, sizes = [], []
            for t in texts[lo:lo + 500]:
                ws = words_of(t)
                ids += [at[w] for w in ws]
                ids.append(len(words))
                sizes.append(len(ws) + 1)
            ids, sizes = np.array(ids, dtype=np.int64), np.array(sizes)
            first = np.cumsum(sizes) - sizes
            k = kinds[ids]
            before, last = _contexts(k, first, c.start)
            lp = one[last, k] + two[before, k] - norm[before, last] + inside[ids]
            out.append((sizes, np.add.reduceat((count[ids] > 0).astype(np.int64), first),
                        np.add.reduceat(base[ids], first),
                        np.add.reduceat(lp, first) / np.log(10)))
        sizes, known, base_score, score = (np.concatenate(x) if out else np.zeros(0)
                                           for x in (zip(*out) if out else [()] * 4))
        n = len(texts)
        return pa.table([rows.column(id_col), rows.column("__held"),
                         pa.array(sizes.astype(np.int64)), pa.array(known.astype(np.int64)),
                         pa.array([c.total] * n, pa.int64()), pa.array(base_score, pa.float64()),
                         pa.array(score, pa.float64())],
                        names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens",
                               "base_score", "score"])
    return run


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              folds: int = 10, chunk_bytes: int = CHUNK) -> DataFrame:
    """One row per input row: ``id_col``, ``held_out`` (crc32 of the id modulo ``folds`` is 0),
    ``n_tokens`` (words and one end), ``n_known`` (seen in training), ``train_tokens``,
    ``base_score`` and ``score``: log10 probabilities of the text by smoothed unigrams and by
    the log-bilinear model.

    Null and empty texts are one end token. Repeated rows count and are scored each; a null id
    counts as the empty text in the fold. Without training rows every count is zero and the
    model stays at its start. An empty table gives no rows. Long texts are read whole. Rows are
    dealt out by id and text, so rows without an id don't meet in one task, and scores depend
    neither on the files a table lies in nor on the order of its rows; the number of chunks
    follows from the bytes of its texts.
    """
    spark = docs.sparkSession
    parts = max(1, -(-text_bytes(docs, text_col) // chunk_bytes))
    src = docs.select(id_col, (fold(id_col, folds) == 0).alias("__held"),
                      binary_text(text_col).alias("__t"),
                      F.pmod(F.xxhash64(F.col(id_col), binary_text(text_col)), F.lit(parts))
                      .alias("__chunk"))
    counted = src.select("__held", "__t", "__chunk").groupBy("__chunk").applyInArrow(
        _count(parts), "bucket long, chunk long, words binary, counts binary")
    totals = materialize(counted.groupBy("bucket").applyInPandas(
        _total, "kind int, chunk long, words binary, counts binary, n long, v long"), "lm-totals")

    # Bounded reads: VOCABULARY words, ENDINGS sums, one count.
    top = [(bytes(r["words"]), r["n"]) for r in totals.where("kind = 1").select("words", "n")
           .orderBy(F.desc("n"), "words").limit(VOCABULARY).collect()]
    tokens, distinct = np.zeros(ENDINGS, np.int64), np.zeros(ENDINGS, np.int64)
    for r in (totals.where("kind = 2").groupBy("chunk")
              .agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()):
        tokens[r["chunk"]], distinct[r["chunk"]] = r["n"], r["v"]
    ends = docs.where(fold(id_col, folds) != 0).count()
    total, vocabulary = int(tokens.sum()) + ends, int(distinct.sum()) + (ends > 0)
    for w, n in top:
        tokens[ending(w)] -= n
        distinct[ending(w)] -= 1
    classes = Classes({w: i for i, (w, _) in enumerate(top)},
                      np.array([n for _, n in top] + [ends] + tokens.tolist(), dtype=np.float64),
                      distinct, total, vocabulary)

    carried = spark.sparkContext.broadcast(classes)  # some hundred words
    learned = src.where(~F.col("__held")).select("__chunk", "__t").groupBy("__chunk").applyInArrow(
        _learn(carried), "chunk long, n long, sums binary")
    added = materialize(learned.groupBy((F.col("chunk") % SUMS).alias("part")).applyInPandas(
        _add, "part long, n long, sums binary"), "lm-parameters").toPandas()  # SUMS rows at most
    added = added.sort_values("part")
    params = _start(classes)
    if len(added):
        flat = sum(np.frombuffer(s) for s in added["sums"]) / added["n"].sum()
        params = _unpack(flat, classes)
    shared = spark.sparkContext.broadcast((classes, tables(params), ends))  # fixed size
    kind = docs.schema[id_col].dataType.simpleString()
    return src.groupBy("__chunk").cogroup(
        totals.where("kind = 0").select("chunk", "words", "counts").groupBy("chunk")).applyInArrow(
        _score(shared, id_col),
        f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
        "base_score double, score double")
