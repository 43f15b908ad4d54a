"""Toxicity by weak supervision.

Voters are words and word openings of a lexicon mined from labelled texts, and patterns of
writing. Each voter says toxic, clean or nothing on a text. A generative label model, fitted
by expectation maximisation, estimates what each voter's votes are worth under either class,
and the correlation of voters beyond it; correlated voters share their weight. Its posteriors
are the labels on which a linear classifier over counts of lexicon hits and patterns is
trained. Scores are made from texts alone.

The mined lexicon, the votes and the classifier use a bounded sample of labelled rows
(``MAX_TRAIN``, taken in the order of a hash of the id): that many short rows reach the driver
at most, whatever the size of the corpus. Scoring reads every whole text.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import binary_text, fold, materialize

MAX_TRAIN = 20_000     # labelled rows that fit the models
MAX_TERMS = 400        # lexicon entries, from 50 times as many candidates: size of the model
MIN_CONTEXTS = 4       # different neighbours that a lexicon entry must be seen with
MIN_SHARE = 0.9        # of its rows that must be toxic
MIN_LIFT = 20          # times as likely in a toxic row as in a clean one
OPENINGS = (4, 5, 6)   # bytes of a word that may be a lexicon entry of their own
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_SHOUT = re.compile(rb"[A-Z]{4,}")


def terms_of(text: bytes) -> Counter:
    """Counts of a text's words (A-Z lower-cased) and of their openings, marked ``*``."""
    words = Counter(_WORD.findall(text.lower()))
    out: Counter = Counter()
    for w, n in words.items():
        out[w] += n
        for k in OPENINGS:
            if len(w) > k:
                out[w[:k] + b"*"] += n
    return out


def contexts_of(text: bytes) -> dict[bytes, set[int]]:
    """The neighbours that each term of a text stands between, as hashes. Copies of a text
    bring no new ones, so what only a much copied text says is no lexicon entry."""
    words = [b"", *_WORD.findall(text.lower()), b""]
    out: dict[bytes, set[int]] = {}
    for before, w, after in zip(words, words[1:], words[2:]):
        at = zlib.crc32(before + b" " + after)
        for term in [w, *(w[:k] + b"*" for k in OPENINGS if len(w) > k)]:
            out.setdefault(term, set()).add(at)
    return out


def style(text: bytes) -> list[float]:
    """Patterns of writing: shares of exclamation marks and of shouted words."""
    n = max(1, len(text))
    return [100.0 * text.count(b"!") / n, 100.0 * len(_SHOUT.findall(text)) / n]


def _choose(terms: list[bytes], rows: np.ndarray) -> list[bytes]:
    """Of a word and its openings one entry: the longest that has most of the rows of the
    shortest, else the opening, which then stands for many words."""
    count = dict(zip(terms, rows.tolist()))
    kept: list[bytes] = []
    for t in sorted(terms, key=lambda t: (t.endswith(b"*"), -len(t), t)):
        if t.endswith(b"*"):
            inside = [w for w in kept if w.startswith(t[:-1])]
            if any(count[w] >= 0.8 * count[t] for w in inside):
                continue
            kept = [w for w in kept if w not in inside]
        kept.append(t)
    return sorted(kept, key=lambda t: (-count[t], t))[:MAX_TERMS]


@dataclass
class Model:
    """What scoring needs; a few kilobytes."""
    words: dict = field(default_factory=dict)     # term -> column
    weights: np.ndarray = field(default_factory=lambda: np.zeros(5))
    bias: float = -4.0

    def features(self, text: bytes) -> np.ndarray:
        """Any lexicon hit, distinct hits, hits a hundred words (square root), the patterns."""
        words = _WORD.findall(text.lower())
        kinds, hits = set(), 0
        find = self.words
        for w in words:
            if w in find:
                kinds.add(find[w])
                hits += 1
                continue
            for k in OPENINGS:
                if len(w) > k and (at := find.get(w[:k] + b"*")) is not None:
                    kinds.add(at)
                    hits += 1
                    break
        return np.array([min(len(kinds), 1), min(len(kinds), 8), np.sqrt(100.0 * hits / max(1, len(words))),
                         *style(text)])

    def score(self, text: bytes) -> float:
        z = float(self.features(text) @ self.weights) + self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def label_model(votes: np.ndarray, prior: float, start: np.ndarray | None = None,
                rounds: int = 50):
    """Posterior P(toxic) of rows from votes (-1 clean, 0 nothing, 1 toxic), the voters' vote
    probabilities by class, and their correlation given the class. ``prior`` is the share of
    toxic rows to start from; ``start`` may give each voter's probability of a
    toxic vote in (clean, toxic) rows to start from.

    A voter that says nothing gives no evidence. Voters that vote on a row and go together
    beyond what the class explains count as fewer: a vote is divided by the sum of its squared
    correlations with the votes on its row, so a lone vote weighs one, k equal votes 1/k each."""
    n, m = votes.shape
    share = np.ones((n, m))
    table = np.empty((2, 3, m))                       # class, vote + 1, voter
    table[1] = np.array([0.1, 0.4, 0.5])[:, None]     # a start that knows which way votes point
    table[0] = np.array([0.5, 0.4, 0.1])[:, None]
    if start is not None:
        table[:, 2, :start.shape[1]] = start
    seen = np.stack([votes == v for v in (-1, 0, 1)]).astype(float)   # vote, row, voter
    corr = np.eye(m)
    post = np.full(n, prior)
    for turn in range(rounds):
        weight = np.log(table[1]) - np.log(table[0])
        odds = ((seen[0] * weight[0] + seen[2] * weight[2]) * share).sum(axis=1)
        odds += np.log(prior / (1 - prior))
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        done = turn > 3 and np.abs(new - post).max() < 1e-6
        post = new
        if done:
            break
        for c, w in ((0, 1 - post), (1, post)):
            table[c] = (np.einsum("vij,i->vj", seen, w) + 0.5) / (w.sum() + 1.5)
        if turn == 2:  # correlation of what is left after the class
            mean = sum(np.outer(w, np.array([-1, 0, 1]) @ table[c])
                       for c, w in ((0, 1 - post), (1, post)))
            left = votes - mean
            scale = np.sqrt((left ** 2).mean(axis=0)) + 1e-9
            corr = (left / scale).T @ (left / scale) / n
            says = (votes != 0).astype(float)
            share = 1 / np.maximum(says @ corr ** 2, 1.0)
        prior = float(np.clip(post.mean(), 0.001, 0.999))
    return post, table, corr


def linear_fit(x: np.ndarray, p: np.ndarray, ridge: float = 1e-4, steps: int = 60):
    """Logistic regression on soft labels by Newton steps; (weights, bias)."""
    scale = np.abs(x).max(axis=0) + 1e-9
    a = np.hstack([x / scale, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    penalty = ridge * len(x) / 100 * np.diag([1.0] * x.shape[1] + [1e-3])
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (q - p) + penalty @ w
        hess = (a * (q * (1 - q) + 1e-9)[:, None]).T @ a + penalty
        step = np.linalg.solve(hess, grad)
        w -= step / max(1.0, np.abs(step).max() / 5)
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1] / scale, float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", max_train: int = MAX_TRAIN) -> Model:
    """Model from labelled rows; ``labels`` holds (id_col, label_col). Rows without a label
    or id take no part; an id with several labels counts once, as toxic if any says so. With
    no toxic or no clean row every score is that of a text without hits."""
    known = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
             .groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("__y"))
             .orderBy(F.xxhash64(id_col), id_col).limit(max_train))  # the bound of the sample
    src = docs.select(id_col, binary_text(text_col).alias("__t"))
    rows = materialize(src.join(F.broadcast(known), id_col).select("__t", "__y"), "toxicity-train")
    toxic, clean = (rows.where(f"__y {c} 0").count() for c in (">", "="))
    if not toxic or not clean:
        return Model()

    def count(batches):
        """(term, neighbours, first): first is 1 once for each row and term."""
        for pdf in batches:
            for at in range(0, len(pdf), 200):
                out = [(term, c, int(i == 0)) for t in pdf["__t"].iloc[at:at + 200]
                       for term, found in contexts_of(t).items() for i, c in enumerate(found)]
                yield pd.DataFrame(out, columns=["term", "at", "first"])

    # Terms of toxic rows first: they bound what has to be counted in the others.
    often = (rows.where("__y > 0").mapInPandas(count, "term binary, at long, first int")
             .groupBy("term").agg(F.sum("first").alias("toxic"),
                                  F.count_distinct("at").alias("contexts"))
             .where(F.col("contexts") >= MIN_CONTEXTS)
             .orderBy(F.desc("contexts"), "term").limit(50 * MAX_TERMS).toPandas())
    wanted = {bytes(t): i for i, t in enumerate(often["term"])}

    def count_clean(batches):
        n = np.zeros(len(wanted), dtype=np.int64)
        for pdf in batches:
            for t in pdf["__t"]:
                for term in terms_of(t):
                    if term in wanted:
                        n[wanted[term]] += 1
        at = np.flatnonzero(n)
        yield pd.DataFrame({"i": at, "n": n[at]})

    in_clean = np.zeros(len(wanted))
    for i, n in (rows.where("__y = 0").mapInPandas(count_clean, "i long, n long")
                 .groupBy("i").agg(F.sum("n").alias("n")).toPandas().itertuples(index=False)):
        in_clean[i] = n
    in_toxic = often["toxic"].to_numpy(dtype=float)
    good = np.flatnonzero((in_toxic >= MIN_SHARE * (in_toxic + in_clean)) & (in_toxic > 1)
                          & (in_toxic / toxic >= MIN_LIFT * (in_clean + 0.5) / clean))
    terms = _choose([bytes(often["term"][i]) for i in good], in_toxic[good])
    at = [wanted[t] for t in terms]
    start = np.stack([(in_clean[at] + 0.5) / (clean + 1), (in_toxic[at] + 0.5) / (toxic + 1)])
    model = Model({t: i for i, t in enumerate(terms)})
    names = sorted(model.words, key=model.words.get)

    def votes(batches):
        for pdf in batches:
            out = []
            for t in pdf["__t"]:
                found = terms_of(t)
                hits = [i for i, term in enumerate(names) if term in found]
                out.append((hits, model.features(t).tolist(), style(t)))
            yield pd.DataFrame(out, columns=["hits", "x", "s"])

    got = rows.mapInPandas(votes, "hits array<int>, x array<double>, s array<double>").toPandas()
    x = np.array(got["x"].tolist())
    s = np.array(got["s"].tolist())
    m = len(names)
    votes_of = np.zeros((len(got), m + 3), dtype=np.int8)
    for row, hits in enumerate(got["hits"]):
        votes_of[row, list(hits)] = 1
        votes_of[row, m] = -1 if not len(hits) else (1 if len(hits) > 1 else 0)
    for k in range(2):  # patterns: much of it says toxic, none of it clean
        high = np.quantile(s[:, k], 0.95)
        votes_of[:, m + 1 + k] = np.where((s[:, k] > high) & (s[:, k] > 0), 1, 0)
    post, _, _ = label_model(votes_of, float(np.clip(toxic / (toxic + clean), 0.01, 0.5)), start)
    model.weights, model.bias = linear_fit(x, post)
    return model


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """Score (0 to 1) of a text; null counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few kilobytes

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        m = shared.value
        return pd.Series([m.score(t) for t in texts], dtype="float64")

    return score(binary_text(text_col))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
             text_col: str = "text", folds: int = 5) -> DataFrame:
    """One row per input row: ``id_col``, ``held_out`` (crc32 of the id modulo ``folds`` is 0),
    ``score``, ``predicted`` (1 if score >= 0.5). Labels of held-out rows are never read. Empty
    and null texts get the score of a text without hits; repeated rows the same score each.
    Texts are read whole, however long, and ties in the lexicon go to the term that sorts first.
    Rows without an id are scored, and never learned from. Other columns are not read, whatever
    their names. An empty table gives no rows, an empty label table the same low score for every
    row. The lexicon holds at most ``MAX_TERMS`` entries, a bound of the model like
    ``MAX_TRAIN``: of more candidates those in most toxic rows are kept."""
    train = labels.where(fold(id_col, folds) != 0)
    model = fit(docs, train, id_col, text_col)
    return docs.select(id_col, (fold(id_col, folds) == 0).alias("held_out"),
                       scored(docs, model, text_col).alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
               text_col: str = "text", folds: int = 5) -> DataFrame:
    """The rows of ``docs`` that score below 0.5, all columns. Nulls, long texts, ties, repeated
    rows and empty tables as in ``toxicity``; every row is judged by its own text."""
    model = fit(docs, labels.where(fold(id_col, folds) != 0), id_col, text_col)
    return docs.where(scored(docs, model, text_col) < 0.5)
