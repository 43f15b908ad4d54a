"""The corpus pipeline stage by stage against brute force, and the registry of queries."""
import random
import zlib

import numpy as np
import pytest

from test_llm_text import LOWER, brute_repeats, components, simhash, vocabulary

LANG = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdéfgh") for _ in range(rng.randint(2, 6))) for _ in range(500)]
    shared = " ".join(rng.choice(words) for _ in range(55))
    rows, labels = [], []
    for i in range(260):
        w = [rng.choice(words) for _ in range(rng.randint(30, 90))]
        if i % 6 == 0:
            w[10:10] = shared.split()
        if i % 4 == 1:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(["vilest", "grubby", "oaf"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 1)))
    rows += [(1000 + i, rows[i][1].upper() if i % 3 else rows[i][1]) for i in range(0, 60, 2)]
    for i in range(60, 90, 2):
        w = rows[i][1].split()
        w[-1] = "other"
        rows.append((2000 + i, " ".join(w)))
    rows += [(3000, None), (3001, ""), (3002, "Z" * 3000)]
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], LANG).write.parquet(
        f"{d}/documents.parquet")
    spark.createDataFrame([(i, y, 1) for i, y in labels], "doc_id long, toxic int, quality int").write.parquet(
        f"{d}/labels.parquet")
    return str(d)


def test_stages_against_brute_force(spark, sf_dir):
    import corpus_pipeline as cp

    from rivulet.llm.common import materialize
    from rivulet.llm.suffixes import _whole
    assert [n for n, _ in cp.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "substring_dedup", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cols, now = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in cp.STAGES[:-1]:
        out = materialize(stage(spark, docs, sf_dir), f"test-{name}")
        assert out.columns == cols and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        got = {r["doc_id"]: r["text"] for r in out.collect()}
        assert out.count() == len(got)
        if name == "toxicity":
            toxic = {i for i, t in now.items() if set((t or "").lower().split()) & {"vilest", "grubby", "oaf"}}
            assert set(got) == set(now) - toxic
        elif name == "exact_dedup":
            least = {}
            for i, t in now.items():
                k = (t or "").translate(LOWER)
                least[k] = min(least.get(k, i), i)
            assert set(got) == set(least.values())
        elif name == "near_dedup":
            fp = {i: simhash(t, 4) for i, t in now.items()}
            comp = components([(i, i) for i in fp], [(a, b) for a in fp for b in fp
                                                     if a < b and (fp[a] ^ fp[b]).bit_count() <= 4])
            assert set(got) == set(comp.values()) and len(got) < len(now)
        else:
            cut = 0
            for (i, n, _, starts, ends) in brute_repeats(list(now.items()), 50):
                text, at, kept = (now[i] or "").encode(), 0, b""
                for s, e in (_whole(text, s, e) for s, e in zip(starts, ends)):
                    kept += text[at:s]
                    at = e
                assert got[i].encode() == kept + text[at:]
                cut += n - len(got[i].encode())
            assert set(got) == set(now) and cut > 0
            assert all(r["n_chars"] == len(r["text"]) for r in out.collect())
        if name not in ("toxicity", "substring_dedup"):
            assert all(got[i] == now[i] for i in got)
        docs, now = out, got
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    pieces = cp.STAGES[-1][1](spark, docs, sf_dir).collect()
    for i, t in now.items():
        ids = np.array(lib.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4")
        at = 0
        for r in sorted((r for r in pieces if r["doc_id"] == i), key=lambda r: r["start"]):
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at:at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)


def test_run_equals_the_stages(spark, sf_dir):
    import corpus_pipeline as cp
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, sf_dir)
    key = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    assert (sorted(tuple(r[k] for k in key) for r in cp.run(spark, sf_dir).collect())
            == sorted(tuple(r[k] for k in key) for r in docs.collect()))


def test_rows_that_share_an_id_or_have_none(spark):
    """Stages judge rows, not ids, and take columns that are called like their own."""
    import corpus_pipeline as cp
    rng = random.Random(2)
    a, b, c, d, e, f = (" ".join(f"{rng.randrange(1 << 40):x}" for _ in range(60)) for _ in range(6))
    near = a.rsplit(" ", 1)[0] + " other"
    assert (simhash(a, 4) ^ simhash(near, 4)).bit_count() <= 4
    cols = ["doc_id", "text", "n_bytes", "kept", "span_starts", "__key", "n_chars"]
    rows = [(1, a), (None, a.upper()), (None, b), (None, c), (None, c), (7, a), (7, d),
            (9, e), (9, e.upper()), (9, f)]
    table = lambda rows: spark.createDataFrame(
        [(i, t, 5, True, [1], "x", len(t)) for i, t in rows],
        "doc_id long, text string, n_bytes int, kept boolean, span_starts array<int>, "
        "__key string, n_chars long")
    want = [(1, a), (7, d), (9, f), (None, b), (None, c)]
    out = cp.exact_dedup(spark, table(rows), "")
    got = sorted((str(r["doc_id"]), r["text"].lower()) for r in out.collect())
    assert out.columns == cols and got == sorted((str(i), t) for i, t in [*want, (9, e)])
    extra = [(None, near), (7, near), (8, d)]
    out = cp.near_dedup(spark, table(rows + extra), "")
    got = sorted((str(r["doc_id"]), r["text"].lower()) for r in out.collect())
    assert out.columns == cols and got == sorted((str(i), t) for i, t in [*want, (9, e)])
    out = cp.substring_dedup(spark, table([(1, a), (2, b + a)]), "")
    assert out.columns == cols
    assert sorted(tuple(r) for r in out.collect()) == [
        (1, a, 5, True, [1], "x", len(a)), (2, b, 5, True, [1], "x", len(b))]


def test_every_operator_is_registered():
    import __spark_entry__ as e
    names = set(e.queries())
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op4_topk", "op8_exact_dedup"])
def test_queries_equal_their_sql(spark, name):
    import os

    from rivulet.llm.queries import ORACLES, QUERIES
    from rivulet.plans.verify import digest, duck
    if not os.path.exists(SF):
        pytest.skip("driver tables not present")
    df = QUERIES[name](spark, SF)
    cur = duck(SF).execute(ORACLES[name])
    assert digest(df.columns, [tuple(r) for r in df.collect()]) == digest(
        [c[0] for c in cur.description], cur.fetchall())
