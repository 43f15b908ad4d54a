"""Resampling, lexical search and decontamination against brute force on small tables, and
their queries against DuckDB SQL."""
import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
# Extra columns are named like ones of the operators.
SCHEMA = ("doc_id long, text string, id string, item string, doc int, n_words string, term int, "
          "score string, rank int")
EXTRA = ("x", "y", 1, None, 2, "z", 3)
SF = "/root/testdata/sf0.001"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def make(seed=5):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["é", "中文", "naïve", "x9"]
    weights = [1 / (i + 1) for i in range(len(vocab))]

    def text(n):
        return "".join(w.upper() if rng.random() < .1 else w + rng.choice([" ", "  ", ", ", "\n"])
                       for w in (x + " " for x in rng.choices(vocab, weights, k=n)))

    items = [(i, text(rng.randint(8, 24))) for i in range(12)]
    items += [(50, None), (51, ""), (52, "w1"), (53, "absent words only"), (None, items[0][1]),
              (3, items[3][1]), (54, "w0 " * 30), (55, "w5 w6 w7")]
    docs = [(i, text(rng.randint(0, 120))) for i in range(90)]
    for i in range(90, 130):  # passages of items in documents, whole and in part, some twice
        own = words(items[i % 12][1])
        part = own[rng.randint(0, 3):] if i % 2 else own
        docs.append((i, text(20) + " " + " ".join(part) + "; " + text(9)
                     + (" ".join(part) if i % 5 == 0 else "")))
    docs += [(200 + i, docs[100][1]) for i in range(45)]  # ties, more than a leaf of them
    docs += [(300, None), (301, ""), (302, " ,.\n"), (303, "w0 " * 40), (304, "w1"), (5, docs[5][1]),
             (None, docs[95][1]), (None, docs[95][1]), (None, "w3 w4"), (305, "w0 w1 " * 20000)]
    return docs, items


@pytest.fixture(scope="module")
def data():
    return make()


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.createDataFrame([(*d, *EXTRA) for d in data[0]], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def items(spark, data):
    return spark.createDataFrame([(*i, "d", 1) for i in data[1]],
                                 "item_id long, text string, doc_id string, k int").cache()


@pytest.fixture(scope="module")
def empty(spark):
    return (spark.createDataFrame([], "doc_id long, text string"),
            spark.createDataFrame([], "item_id long, text string"))


# ---- decontamination

def windows(item, size):
    w = words(item)
    n = min(size, len(w))
    return [(j, w[j:j + n]) for j in range(len(w) - n + 1)] if w else []


def brute_contamination(data, size):
    out = Counter()
    wins = {}
    for item_id, text in data[1]:
        for _, w in windows(text, size):
            wins.setdefault(tuple(w), set()).add("" if item_id is None else str(item_id))
    lens = {len(w) for w in wins}
    for doc_id, text in data[0]:
        w, hit, named = words(text), set(), set()
        for n in lens:
            for p in range(len(w) - n + 1):
                got = wins.get(tuple(w[p:p + n]))
                if got:
                    hit.update(range(p, p + n))
                    named |= got
        sha = hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()
        out[(doc_id, len(w), len(hit), len(named), sha, bool(hit))] += 1
    return out


@pytest.mark.parametrize("size", [10, 4])
def test_contamination(docs, items, data, size):
    from rivulet.llm.decontam import contamination
    got = Counter(map(tuple, contamination(docs, items, window=size).collect()))
    assert got == brute_contamination(data, size)
    assert 30 < sum(n for r, n in got.items() if r[-1]) < sum(got.values())


def test_contamination_in_blocks(docs, items, data, monkeypatch):
    from rivulet.llm import decontam
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 900)
    got = Counter(map(tuple, decontam.contamination(docs, items).collect()))
    assert got == brute_contamination(data, 10)


def test_contamination_of_empty_tables(docs, items, empty, data):
    from rivulet.llm.decontam import contamination, matches
    assert contamination(empty[0], items).collect() == []
    got = contamination(docs, empty[1]).collect()
    assert len(got) == len(data[0]) and not any(r["contaminated"] for r in got)
    assert matches(empty[0], empty[1]).collect() == []


def brute_matches(data, size, slop):
    """Anchored at the rarest word of a window: every word at most ``slop`` from its place."""
    df = Counter(w for _, t in data[0] for w in words(t))
    out = Counter()
    for doc_id, text in data[0]:
        places = {}
        for p, w in enumerate(words(text)):
            places.setdefault(w, set()).add(p)
        for item_id, item in data[1]:
            for j, win in windows(item, size):
                rare = min(range(len(win)), key=lambda k: (df[win[k]], k))
                for p in places.get(win[rare], ()):
                    start = p - rare
                    off = [min((abs(e) for e in range(-slop, slop + 1)
                                if start + k + e in places.get(w, ())), default=None)
                           for k, w in enumerate(win)]
                    if None not in off:
                        out[(doc_id, item_id, start, j, len(win),
                             "near" if max(off) else "exact")] += 1
    return out


@pytest.mark.parametrize("slop", [0, 2])
def test_matches_exact_and_near(spark, slop):
    from rivulet.llm.decontam import matches
    data = make(seed=9)
    data = ([d for d in data[0] if d[0] not in (303, 305)], data[1])
    d = spark.createDataFrame(data[0], "doc_id long, text string")
    i = spark.createDataFrame(data[1], "item_id long, text string")
    got = Counter(map(tuple, matches(d, i, window=5, slop=slop).collect()))
    assert got == brute_matches(data, 5, slop)
    assert ("near" in {r[-1] for r in got}) == bool(slop)


# ---- lexical search

def brute_search(data, k):
    docs = [(i, Counter(words(t)), len(words(t))) for i, t in data[0] if words(t)]
    n_docs, n_terms = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = Counter()
    for item_id, text in data[1]:
        scores = []
        for doc_id, c, n in docs:
            m = 75 + 25 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
                    for t in words(text) if c[t])
            if s > 0:
                scores.append((-s, doc_id is not None, doc_id or 0, doc_id))
        for r, e in enumerate(sorted(scores, key=lambda e: e[:3])[:k], 1):
            out[(item_id, r, e[3], -e[0])] += 1
    return out


@pytest.mark.parametrize("chunk", [16_384, 40])
def test_search(docs, items, data, chunk, monkeypatch):
    from rivulet.llm import lexical
    monkeypatch.setattr(lexical, "CHUNK_DOCS", chunk)
    got = Counter(map(tuple, lexical.search(docs, items).collect()))
    assert got == brute_search(data, 20)


def test_search_in_blocks_and_string_ids(spark, items, data, monkeypatch):
    from rivulet.llm import lexical
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 700)
    named = [(None if i is None else f"d{i:04}", t) for i, t in data[0]]
    d = spark.createDataFrame(named, "doc_id string, text string")
    got = Counter((r[0], r[1], r[2] and int(r[2][1:]), r[3])
                  for r in lexical.search(d, items, k=7).collect())
    assert got == brute_search(data, 7)


def test_search_of_empty_tables(docs, items, empty):
    from rivulet.llm.lexical import search
    assert search(empty[0], items).collect() == []
    assert search(docs, empty[1]).collect() == []


def test_tree_bounds_hold_and_prune():
    from rivulet.llm.lexical import LEAF, Tree
    rng = np.random.default_rng(3)
    vocab, n = 80, 3000
    p = 1 / (np.arange(vocab) + 1.5)
    vectors = [np.flatnonzero(rng.random(vocab) < p) for _ in range(n)]
    sizes = np.array([len(v) for v in vectors])
    ranks = np.concatenate(vectors)
    tf, m = rng.integers(1, 9, len(ranks)), rng.integers(80, 400, n)
    tree = Tree(sizes, ranks, tf, m, vocab)
    assert sorted(tree.order.tolist()) == list(range(n)) and len(tree.levels) > 3
    leaves = [i for i in range(len(tree.lo)) if tree.first[i] == tree.last[i]]
    assert sum(int(tree.hi[i] - tree.lo[i]) for i in leaves) == n
    at = np.concatenate(([0], np.cumsum(sizes)))
    weights = [(int(r), int(w)) for r, w in zip(rng.choice(vocab, 9, False), rng.integers(1, 5000, 9))]
    dense = np.zeros(vocab, dtype=np.int64)
    for r, w in weights:
        dense[r] = w
    score = np.array([int((dense[ranks[a:b]] * (10**9 * tf[a:b] // (1000 * tf[a:b] + 12 * m[i]))).sum())
                      for i, (a, b) in enumerate(zip(at[:-1], at[1:]))])
    bound = tree.bounds(weights)
    for node in range(len(tree.lo)):
        assert bound[node] >= score[tree.order[tree.lo[node]:tree.hi[node]]].max()
    dense[:] = 0
    best = tree.search(weights, dense, [], 5, list(range(n)))
    assert [(-e[0], e[2]) for e in best] == sorted(
        ((int(s), i) for i, s in enumerate(score)), key=lambda e: (-e[0], e[1]))[:5]
    assert not dense.any()
    floor = -best[-1][0]
    assert sum(bound[i] >= floor for i in leaves) < len(leaves)  # some are never visited
    assert LEAF < n


# ---- resampling

def brute_resample(data, percent, min_words, buckets, runs):
    def features(text):
        w = words(text)
        return [" ".join(w[i:i + n]) for n in range(1, runs + 1) for i in range(len(w) - n + 1)]

    def hashed(rows):
        return [[zlib.crc32(f.encode()) % buckets for f in features(t)] for _, t in rows]

    mine, theirs = hashed(data[0]), hashed(data[1])
    s, t = (Counter(b for x in h for b in x) for h in (mine, theirs))
    s_all, t_all = sum(s.values()), sum(t.values())
    rows = []
    for (doc_id, text), h in zip(data[0], mine):
        g = sum(math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets)
                                           / ((s[b] + 1) * (t_all + buckets)))) for b in h)
        weight = g // len(h) if h else 0
        x = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((x + .5) / 4294967296)))
        rows.append((doc_id, len(h), weight, score, len(words(text)) >= min_words))
    long_enough = sorted((r for r in rows if r[4]), key=lambda r: (
        -r[3], r[0] is not None, r[0] or 0, r[2], r[1]))
    drawn = percent * len(long_enough) // 100
    out = Counter((*r[:4], i if i <= drawn else None) for i, r in enumerate(long_enough, 1))
    return out + Counter((*r[:4], None) for r in rows if not r[4])


@pytest.mark.parametrize("percent,min_words,buckets,runs", [(25, 20, 10_000, 2), (90, 0, 97, 1),
                                                            (40, 5, 200_000, 3)])
def test_resample(docs, items, data, percent, min_words, buckets, runs):
    from rivulet.llm.resampling import resample
    got = Counter(map(tuple, resample(docs, items, percent=percent, min_words=min_words,
                                      buckets=buckets, max_run=runs).collect()))
    assert got == brute_resample(data, percent, min_words, buckets, runs)


def test_resample_of_empty_tables(docs, items, empty, data):
    from rivulet.llm.resampling import resample
    assert resample(empty[0], items).collect() == []
    got = Counter(map(tuple, resample(docs, empty[1]).collect()))
    assert got == brute_resample((data[0], []), 25, 20, 10_000, 2)


def test_pieces_and_offsets(monkeypatch):
    from rivulet.llm import resampling
    split = resampling.splitter()
    text = "ab 12,cd  é中 x\n" * 40 + "y" * 300 + " z"
    spans = resampling.spans(text, split)
    assert spans == [m.span() for m in WORD.finditer(text)]
    monkeypatch.setattr(resampling, "PIECE", 16)
    assert resampling.spans(text, split) == spans
    for a, b in resampling.run_spans(spans, 2)[-3:]:
        assert 0 < len(WORD.findall(text[a:b])) <= 2
    w = words(text)
    want = Counter(zlib.crc32(" ".join(w[i:i + n]).encode())
                   for n in (1, 2, 3) for i in range(len(w) - n + 1))
    count, hashes = resampling.run_hashes(text.encode(), split, 3)
    assert count == len(w) and Counter(hashes) == want


@pytest.mark.skipif(not os.path.exists(SF), reason="driver tables not present")
@pytest.mark.parametrize("name", ["op11_resampling", "op12_lexical", "op13_decontamination"])
def test_queries_equal_their_sql(spark, name):
    from rivulet.llm.queries import ORACLES, QUERIES
    from rivulet.plans.verify import digest, duck
    cur = duck(SF).execute(ORACLES[name])
    columns = [c[0] for c in cur.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert digest(df.columns, [tuple(r) for r in df.collect()]) == digest(columns, cur.fetchall())
