"""Registered queries of the training-data operators: whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rivulet.llm.common import table


def op8_exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    from rivulet.llm.exact_dedup import exact_groups
    return exact_groups(table(spark, d, "documents"), keep="max")


def op2_simhash(spark: SparkSession, d: str) -> DataFrame:
    from rivulet.llm.simhash import simhash_groups
    return simhash_groups(table(spark, d, "documents"), shingle=4, max_bits=4)


def op5_bpe(spark: SparkSession, d: str) -> DataFrame:
    from public_tokenizers import path

    from rivulet.llm.bpe_codec import digests
    return digests(table(spark, d, "documents"), path("byte_bpe_50k.tiktoken"))


def op10_packing(spark: SparkSession, d: str) -> DataFrame:
    from public_tokenizers import path

    from rivulet.llm.packing import pack
    return pack(table(spark, d, "documents"), path("byte_bpe_50k.json"), size=2048, end_id=1)


def op1_toxicity(spark: SparkSession, d: str) -> DataFrame:
    from rivulet.llm.toxicity import toxicity
    return toxicity(table(spark, d, "documents"), table(spark, d, "labels"))


def op3_suffix_dedup(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import functions as F

    from rivulet.llm.suffixes import remove_repeats
    out = remove_repeats(table(spark, d, "documents"), min_len=50)
    return out.select("doc_id", "n_bytes",
                      (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
                      F.size("span_starts").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


def pipeline(spark: SparkSession, d: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, d)


def op9_licenses(spark: SparkSession, d: str) -> DataFrame:
    from rivulet.llm.licenses import scan, summary
    return summary(scan(table(spark, d, "documents")))


def op4_topk(spark: SparkSession, d: str) -> DataFrame:
    from rivulet.llm.topk import top_k
    return top_k(table(spark, d, "embeddings"), k=5, query_modulo=50, scale=256)


def op7_lm(spark: SparkSession, d: str) -> DataFrame:
    from rivulet.llm.lm import lm_scores
    return lm_scores(table(spark, d, "documents"), folds=10)


def op6_passages(spark: SparkSession, d: str) -> DataFrame:
    from rivulet.llm.passages import passage_groups
    return passage_groups(table(spark, d, "documents"), min_words=50, similarity=0.8)


def op11_resampling(spark: SparkSession, d: str) -> DataFrame:
    from rivulet.llm.resampling import resample
    return resample(table(spark, d, "documents"), table(spark, d, "benchmark"), percent=25,
                    min_words=20, buckets=10_000, max_run=2, seed=7)


def op12_lexical(spark: SparkSession, d: str) -> DataFrame:
    from rivulet.llm.lexical import search
    return search(table(spark, d, "documents"), table(spark, d, "benchmark"), k=20)


def op13_decontamination(spark: SparkSession, d: str) -> DataFrame:
    from rivulet.llm.decontam import contamination
    return contamination(table(spark, d, "documents"), table(spark, d, "benchmark"), window=10)


QUERIES = {
    "op11_resampling": op11_resampling,
    "op12_lexical": op12_lexical,
    "op13_decontamination": op13_decontamination,
    "op6_passages": op6_passages,
    "op7_lm": op7_lm,
    "op4_topk": op4_topk,
    "op9_licenses": op9_licenses,
    "pipeline": pipeline,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op1_toxicity": op1_toxicity,
    "op5_bpe": op5_bpe,
    "op10_packing": op10_packing,
    "op2_simhash": op2_simhash,
    "op8_exact_dedup": op8_exact_dedup,
}

# Pieces of the SQL below: lower-case A-Z only, and the words of a text.
_LOWER = ("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
          "'abcdefghijklmnopqrstuvwxyz')")
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES = {
    # The checksum goes through the hex digits of a feature's bytes, low digit first, with a
    # table of 16 entries made by the polynomial's rule.
    "op11_resampling": f"""
WITH RECURSIVE poly(n, c, k) AS (
  SELECT n, n::BIGINT, 0 FROM range(16) t(n)
  UNION ALL
  SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1
  FROM poly WHERE k < 4),
crc AS (SELECT list(c ORDER BY n) AS t FROM poly WHERE k = 4),
texts AS (
  SELECT row_number() OVER () AS r, doc_id, false AS wanted, {_WORDS} AS w FROM documents
  UNION ALL
  SELECT row_number() OVER (), NULL, true, {_WORDS} FROM benchmark),
runs AS (
  SELECT wanted, r, unnest(list_concat(w, list_transform(range(1, len(w)),
                           lambda i: w[i] || ' ' || w[i + 1]))) AS feature FROM texts),
counted AS (SELECT wanted, r, feature, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (
  SELECT feature, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
           range(0, length(h)), lambda i: (instr('0123456789ABCDEF',
             h[CASE WHEN i % 2 = 0 THEN i + 2 ELSE i END]) - 1)::BIGINT)),
           lambda c, x: xor(c >> 4, t[(xor(c, x) & 15) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT feature, hex(encode(feature)) AS h
        FROM (SELECT DISTINCT feature FROM counted)), crc),
placed AS (SELECT wanted, r, bucket, sum(n)::BIGINT AS n
           FROM counted JOIN hashed USING (feature) GROUP BY ALL),
hist AS (SELECT b AS bucket, coalesce(sum(n) FILTER (NOT wanted), 0)::BIGINT AS s,
                coalesce(sum(n) FILTER (wanted), 0)::BIGINT AS t
         FROM range(10000) x(b) LEFT JOIN placed ON bucket = b GROUP BY b),
gain AS (SELECT bucket, floor(1000 * ln(((t + 1) * (sum(s) OVER () + 10000))::DOUBLE
           / ((s + 1) * (sum(t) OVER () + 10000))::DOUBLE))::BIGINT AS g FROM hist),
total AS (SELECT r, sum(n)::BIGINT AS n, sum(n * g)::BIGINT AS g
          FROM placed JOIN gain USING (bucket) WHERE NOT wanted GROUP BY r),
scored AS (
  SELECT doc_id, len(w) AS words, coalesce(n, 0) AS n_features,
         coalesce((total.g - ((total.g % n) + n) % n) // n, 0) AS weight,
         ('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT AS h
  FROM texts LEFT JOIN total USING (r) WHERE NOT wanted),
final AS (
  SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM scored),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) AS place,
         count(*) FILTER (words >= 20) OVER () * 25 // 100 AS drawn FROM final)
SELECT doc_id, n_features, weight, score,
       CASE WHEN words >= 20 AND place <= drawn THEN place END AS rank FROM ordered""",
    "op12_lexical": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
sized AS (SELECT r, doc_id, len(w)::BIGINT AS n FROM d WHERE len(w) > 0),
stat AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM sized),
tf AS (SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY ALL),
df AS (SELECT t, count(*)::BIGINT AS df FROM tf GROUP BY t),
q AS (SELECT item_id, t, count(*)::BIGINT AS c
      FROM (SELECT item_id, unnest({_WORDS}) AS t FROM benchmark) GROUP BY ALL),
weighted AS (SELECT item_id, t, c * floor(1000 * ln((2 * nn + 2)::DOUBLE
               / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM q JOIN df USING (t), stat),
scored AS (
  SELECT item_id, doc_id, r, sum(w * ((1000000000 * tf)
           // (1000 * tf + 12 * (100 - 25 + (25 * n * nn) // ll))))::BIGINT AS score
  FROM weighted JOIN tf USING (t) JOIN sized USING (r), stat GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
           FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 20""",
    "op13_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, w, least(10, len(w)) AS len FROM (SELECT item_id, {_WORDS} AS w
      FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, len, array_to_string(w[j:j + len - 1], ' ') AS g
        FROM (SELECT *, unnest(range(1, len(w) - len + 2)) AS j FROM i)),
grams AS (SELECT r, p, len, array_to_string(w[p:p + len - 1], ' ') AS g
          FROM (SELECT r, w, len, unnest(range(1, len(w) - len + 2)) AS p
                FROM d, (SELECT DISTINCT len FROM win))),
occ AS (SELECT r, p, len, item_id FROM grams JOIN win USING (len, g)),
hit AS (SELECT r, count(DISTINCT q) AS n_hit
        FROM (SELECT r, unnest(range(p, p + len)) AS q FROM occ) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
          FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM occ) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN named USING (r)""",
    "op4_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
           FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
      FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op8_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                               'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
WINDOW g AS (PARTITION BY t)""",
}
