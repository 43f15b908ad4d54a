"""Text operators against brute force on small tables: copies, near copies, repeats, tokens."""
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, kept string, fp long, ids string, chunk int"


def make_rows(seed=1):
    """Copies, near copies, shared passages, nulls, empties, ties and a very long text."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdéfgñ") for _ in range(rng.randint(1, 7))) for _ in range(900)]
    passage = " ".join(rng.choice(words) for _ in range(70))
    rows = []
    for i in range(60):
        w = [rng.choice(words) for _ in range(rng.randint(60, 160))]
        if i % 3 == 0:
            at = rng.randrange(len(w))
            w[at:at] = passage.split()
        rows.append((i, " ".join(w).capitalize() + ".\n"))
    rows += [(100 + i, rows[i][1].upper() if i % 2 else rows[i][1]) for i in range(8)]
    for i in range(8, 16):
        w = rows[i][1].split(" ")
        w[len(w) // 2] = "changed"
        rows.append((200 + i, " ".join(w)))
    rows += [(300, None), (301, None), (302, ""), (303, "   \n"), (304, "one"), (305, "One"),
             (306, "two three"), (None, rows[3][1]), (None, None), (5, rows[5][1]),
             (307, "ab " * 5000), (308, "z" * 6000), (309, "x <|endoftext|> y it's '  \U0001f389")]
    return [(i, t, None if i is None or i % 2 else "en", "k", 7, None, 1) for i, t in rows]


@pytest.fixture(scope="module")
def rows():
    return make_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def norm(t):
    return (t or "").translate(LOWER)


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_groups(docs, rows, keep):
    from rivulet.llm.exact_dedup import exact_groups
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(norm(t), []).append(i)
    want = Counter()
    for i, t, *_ in rows:
        ids = [x for x in groups[norm(t)] if x is not None]
        best = (min if keep == "min" else max)(ids) if ids else None
        want[(i, best, len(groups[norm(t)]), i == best,
              hashlib.sha256(norm(t).encode()).hexdigest())] += 1
    assert Counter(map(tuple, exact_groups(docs, keep=keep).collect())) == want


def test_drop_exact_keeps_columns_and_clean_rows(docs, rows):
    from rivulet.llm.exact_dedup import drop_exact
    out = drop_exact(docs)
    assert out.columns == docs.columns
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[norm(t)] = min(least.get(norm(t), i), i)
    got = Counter(r["doc_id"] for r in out.collect() if r["doc_id"] is not None)
    assert set(got) == set(least.values())


def simhash(text, k):
    import xxhash
    w = norm(text).encode().split()
    sh = [b" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    bits = Counter()
    for s in sh:
        h = xxhash.xxh64_intdigest(s, 42)
        bits.update(b for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(sh))


def components(items, linked):
    """Brute-force classes: items (key, id); smallest id of each class by key."""
    par = {k: k for k, _ in items}

    def root(k):
        while par[k] != k:
            k = par[k]
        return k
    for a, b in linked:
        par[root(a)] = root(b)
    best = {}
    for k, i in items:
        if i is not None:
            best[root(k)] = min(best.get(root(k), i), i)
    return {k: best.get(root(k)) for k, _ in items}


@pytest.mark.parametrize("bits", [0, 3, 4, 7])
def test_simhash_groups(docs, rows, bits):
    from rivulet.llm.simhash import simhash_groups
    fps = {t: simhash(t, 4) for _, t, *_ in rows}
    of = {f: min([i for i, t, *_ in rows if fps[t] == f and i is not None], default=None)
          for f in fps.values()}
    nodes = [f for f in of if of[f] is not None]
    comp = components([(f, of[f]) for f in of],
                      [(a, b) for a in nodes for b in nodes if (a ^ b).bit_count() <= bits])
    want = Counter((i, f"{fps[t]:016x}", comp[fps[t]]) for i, t, *_ in rows)
    assert Counter(map(tuple, simhash_groups(docs, max_bits=bits).collect())) == want


@pytest.mark.parametrize("bits", [1, 2, 4])
def test_anchors_meet(bits):
    """Fingerprints within the distance share an anchor; random ones rarely do."""
    from rivulet.llm.simhash import anchors
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, bits, replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    reach = -(-(bits // 2) // 2)
    (ra, ka), (rb, kb) = anchors(a, reach), anchors(b, reach)
    for i in range(len(a)):
        assert set(ka[ra == i]) & set(kb[rb == i])
    assert len(ka) / len(a) < 40


def test_components_of_a_long_chain(spark):
    from rivulet.llm.components import connected_components
    chain = [(i, i + 1) for i in range(0, 300)] + [(1000 + i, 1500) for i in range(40)]
    got = dict(map(tuple, connected_components(
        spark.createDataFrame(chain, "a long, b long")).collect()))
    assert set(got.values()) == {0, 1000} and len(got) == 342
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_repeats(rows, n):
    """(id, text) -> removed flags; rows that share an id are one document."""
    starts = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        key = (1 << 63) - 1 if i is None else i
        for p in range(len(b) - n + 1):
            s = b[p:p + n]
            starts[s] = min(starts.get(s, key), key)
    out = []
    for i, t, *_ in rows:
        b = (t or "").encode()
        key = (1 << 63) - 1 if i is None else i
        cover = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if starts[b[p:p + n]] < key:
                cover[p:p + n] = b"\1" * n
        spans, kept = [], bytes(c for c, m in zip(b, cover) if not m)
        for p, m in enumerate(cover):
            if m and (not p or not cover[p - 1]):
                spans.append([p, p])
            if m:
                spans[-1][1] = p + 1
        out.append((i, len(b), kept, tuple(s for s, _ in spans), tuple(e for _, e in spans)))
    return Counter(out)


@pytest.mark.parametrize("n, chunk", [(50, 1 << 23), (50, 3000), (33, 5000)])
def test_remove_repeats(docs, rows, n, chunk):
    from rivulet.llm.suffixes import remove_repeats
    got = Counter((r["doc_id"], r["n_bytes"], bytes(r["kept"]), tuple(r["span_starts"]),
                   tuple(r["span_ends"]))
                  for r in remove_repeats(docs, min_len=n, chunk_bytes=chunk).collect())
    assert got == brute_repeats(rows, n)


def test_remove_repeats_whole_characters(spark):
    from rivulet.llm.suffixes import remove_repeats
    same = "é" * 40
    d = spark.createDataFrame([(1, "aé" + same, 5), (2, "bè" + same, 6)], "doc_id long, text string, x int")
    out = {r["doc_id"]: r for r in remove_repeats(d, carry=["x", "doc_id"], whole_chars=True).collect()}
    assert bytes(out[2]["kept"]).decode() == "bè" and out[2]["x"] == 6
    with pytest.raises(ValueError):
        remove_repeats(d.withColumnRenamed("x", "kept"), carry=["kept"])


def test_remove_repeats_random_bytes(spark):
    """Few letters, so that strings repeat within and across documents in many ways."""
    from rivulet.llm.suffixes import remove_repeats
    rng = random.Random(5)
    block = ["".join(rng.choice("ab") for _ in range(rng.randint(20, 90))) for _ in range(6)]
    rows = [(i, "".join(rng.choice(block) for _ in range(rng.randint(1, 6)))) for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_bytes"], bytes(r["kept"]), tuple(r["span_starts"]),
                   tuple(r["span_ends"])) for r in remove_repeats(d, min_len=40, chunk_bytes=900).collect())
    assert got == brute_repeats(rows, 40)


def test_equal_windows():
    from rivulet.llm.suffixes import equal_windows
    rng = np.random.default_rng(2)
    raw = rng.integers(0, 2, 400).astype(np.uint8)
    for n in (9, 13, 16):
        starts = np.arange(len(raw) - n + 1)
        group = equal_windows(raw, starts, n)
        by = {}
        for s, g in zip(starts, group):
            by.setdefault(raw[s:s + n].tobytes(), set()).add(int(g))
        assert all(len(v) == 1 for v in by.values()) and len(set(group)) == len(by)


def vocabulary(name):
    return pytest.importorskip("public_tokenizers").path(name)


def test_bpe_equals_tiktoken(docs, rows):
    import base64

    import public_tokenizers as P
    import tiktoken

    from rivulet.llm.bpe_codec import decode, digests, encode
    path = vocabulary("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter((i, tuple(enc.encode_ordinary(t or ""))) for i, t, *_ in rows)
    ids = encode(docs, path)
    assert Counter((r[0], tuple(r[1])) for r in ids.collect()) == want
    back = Counter((r["doc_id"], bytes(r["decoded"])) for r in decode(ids, path).collect())
    assert back == Counter((i, (t or "").encode()) for i, t, *_ in rows)
    for r in digests(docs, path).where("doc_id = 309").collect():
        t = next(t for i, t, *_ in rows if i == 309)
        assert r["ids_sha256"] == hashlib.sha256(
            " ".join(map(str, enc.encode_ordinary(t))).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_bpe_property():
    import base64

    import public_tokenizers as P
    import tiktoken
    from hypothesis import given, settings
    from hypothesis import strategies as st

    from rivulet.llm.bpe import Encoder, read_ranks
    content = open(vocabulary("byte_bpe_50k.tiktoken"), "rb").read()
    ours = Encoder(read_ranks(content))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.text(st.sampled_from("ab' \n\tstrevlmdLLé½٣日 \U0001f389.!"), max_size=80),
                    max_size=6))
    def check(texts):
        got = [x.tolist() for x in ours.encode([t.encode() for t in texts])]
        assert got == [enc.encode_ordinary(t) for t in texts]
    check()


def test_bpe_words_by_sql(spark):
    """The fold as SQL higher-order functions gives the same ids."""
    import base64

    import public_tokenizers as P
    import tiktoken

    from rivulet.llm.bpe_codec import encode_words
    path = vocabulary("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    words = ["", "a", " the", "worthless", " reedonhestnd", "été", "aaaaaaaa", "\U0001f389"]
    out = encode_words(spark.createDataFrame([(w,) for w in words] + [(None,)], "word string"), path)
    got = {r["word"]: list(r["ids"]) for r in out.collect()}
    assert got == {w: enc.encode_ordinary(w) for w in words} | {None: []}


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    from rivulet.llm.packing import pack
    path = vocabulary("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    out = pack(docs, path, size=256, open_windows=4).collect()
    by_doc, by_seq = {}, {}
    for r in out:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    want = Counter()
    for i, t, *_ in rows:
        ids = np.array(lib.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4")
        for s in range(0, len(ids), 256):
            part = ids[s:s + 256]
            want[(i, s, len(part), zlib.crc32(part.tobytes()), len(ids))] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"])
                   for r in out) == want
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256
    used = sum(r["length"] for r in out)
    assert used / (256 * len(by_seq)) > 0.9


def test_best_fit_emits_the_fullest():
    from rivulet.llm.packing import BestFit
    fit = BestFit(10, 2)
    assert fit.put(6) == (0, 0, []) and fit.put(7) == (1, 0, [])
    assert fit.put(3) == (1, 7, [(1, 10)])          # the best fit, and full
    assert fit.put(5) == (2, 0, [])
    assert fit.put(8) == (3, 0, [(0, 6)])           # none fits: the fullest goes


def test_empty_tables(spark, empty):
    from rivulet.llm.bpe_codec import digests
    from rivulet.llm.exact_dedup import drop_exact, exact_groups
    from rivulet.llm.packing import pack
    from rivulet.llm.simhash import drop_near, simhash_groups
    from rivulet.llm.suffixes import remove_repeats
    for df in (exact_groups(empty), drop_exact(empty), simhash_groups(empty), drop_near(empty),
               remove_repeats(empty), digests(empty, vocabulary("byte_bpe_50k.tiktoken")),
               pack(empty, vocabulary("byte_bpe_50k.json"))):
        assert df.count() == 0


def _peak_mb(run) -> float:
    import tracemalloc
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def _noise(n, size, letters, seed):
    import pandas as pd
    rng = np.random.default_rng(seed)
    texts = [letters[rng.integers(0, len(letters), size)].tobytes() for _ in range(n)]
    return pd.DataFrame({"chunk": np.arange(n) % 4, "t": texts})


def test_packed_hashes():
    from rivulet.llm.suffixes import packed_hashes
    rng = np.random.default_rng(5)
    held = [(rng.integers(0, 7, n).astype(np.uint8), rng.integers(0, 90, n),
             rng.integers(0, 300, n).astype(np.uint64)) for n in (900, 1, 2000)]
    want = {}
    for part in held:
        for chunk, doc, h in zip(*(x.tolist() for x in part)):
            want.setdefault((h % 7, chunk), {}).setdefault(h, set()).add(doc)
    got = packed_hashes(held, 7)
    assert [*zip(got["bucket"], got["chunk"])] == sorted(want)
    for bucket, chunk, hashes, twice in got.itertuples(index=False):
        docs = want[bucket, chunk]
        h = np.frombuffer(hashes, np.uint64).tolist()
        assert h == sorted(docs)
        bits = np.unpackbits(np.frombuffer(twice, np.uint8), count=len(h)).tolist()
        assert bits == [len(docs[x]) > 1 for x in h]


def test_anchor_task_holds_little_memory():
    from rivulet.llm.suffixes import _send_anchors
    pdf = _noise(6000, 2000, np.frombuffer(b"abcdefghijklmnop", np.uint8), 1)
    run = _send_anchors(50, 4)
    assert _peak_mb(lambda: sum(len(x) for x in run(iter([pdf])))) < 90


def test_array_operations_of_chunks_fit_the_cache():
    from rivulet.llm.suffixes import _chunk
    texts = _noise(3000, 2000, np.frombuffer(b"abcdefghijklmnop", np.uint8), 2)["t"].tolist()
    none = np.zeros(0, np.uint64)
    assert _peak_mb(lambda: _chunk(list(range(len(texts))), texts, none, 50)) < 40


def test_key_task_holds_little_memory():
    from rivulet.llm.passages import _send_keys
    pdf = _noise(300, 4000, np.frombuffer(b"abcdefg  ", np.uint8), 3)
    run = _send_keys(46, 4)
    assert _peak_mb(lambda: sum(len(x) for x in run(iter([pdf])))) < 25
