"""Target-distribution importance resampling over hashed word runs.

A Regex Split (the ``tokenizers`` library's pre-tokenizer, nothing is trained) gives the words
of an ASCII-lowered text with their offsets. Windows of consecutive offset pairs are the runs;
a run's CRC-32 continues that of the run one word shorter, so no run is put together as text.
One pass stores every document's buckets. Their histogram and the target's give each bucket's
gain; a document's weight is the floored mean of its buckets' gains. With a Gumbel term drawn
from the id's hash, the best scores are a sample without replacement in proportion to the
weights. Ranks come from one distributed sort: a row's place in its partition plus the sizes
of the partitions before it.
"""

from __future__ import annotations

import math
import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import binary_text, materialize

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PIECE = 1 << 16  # characters split at a time; a cut falls between words
_GAP = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
_ROWS = 1 << 33  # rows of a partition that monotonically_increasing_id can number


def splitter():
    """The untrained pre-tokenizer: words with their character offsets."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split
    return Split(Regex(WORD), behavior="removed", invert=True)


def _pieces(text: str):
    """(start, piece) of about PIECE characters; words stay whole."""
    start = 0
    while len(text) - start > PIECE:
        gap = _GAP.search(text, start + PIECE)
        if not gap:
            break
        yield start, text[start:gap.start()]
        start = gap.start()
    yield start, text[start:]


def spans(text: str, split) -> list[tuple[int, int]]:
    """(start, end) of every word of a lowered text."""
    return [(at + a, at + b) for at, piece in _pieces(text)
            for _, (a, b) in split.pre_tokenize_str(piece)]


def run_spans(words: list[tuple[int, int]], max_run: int) -> list[tuple[int, int]]:
    """(start, end) of every run of 1 to ``max_run`` consecutive words, shorter runs first."""
    return [(a, b) for n in range(1, max_run + 1)
            for (a, _), (_, b) in zip(words, words[n - 1:])]


def run_hashes(text: bytes, split, max_run: int) -> tuple[int, list[int]]:
    """Number of words of an ASCII-lowered UTF-8 text, and the CRC-32 of every run of 1 to
    ``max_run`` words joined by one blank, in no particular order."""
    count, hashes, tail = 0, [], []
    for _, piece in _pieces(text.decode("utf-8", "replace")):
        raw = piece.encode() if not piece.isascii() else None
        got = split.pre_tokenize_str(piece)
        if raw is None:  # offsets are bytes
            raw = piece.encode()
            words = [raw[a:b] for _, (a, b) in got]
        else:
            words = [w.encode() for w, _ in got]
        count += len(words)
        words, old = tail + words, len(tail)
        run = list(map(crc32, words))
        hashes += run[old:]
        joined = [b" " + w for w in words] if max_run > 1 else []
        for n in range(1, max_run):
            run = list(map(crc32, joined[n:], run))
            hashes += run[max(0, old - n):]
        tail = words[len(words) - max_run + 1:] if max_run > 1 else []
    return count, hashes


def _features(docs: DataFrame, id_col: str, text_col: str, buckets: int, max_run: int,
              name: str) -> DataFrame:
    """Written table (id, n_words, f): ``f`` holds a document's buckets, one after another."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32
    src = docs.select(F.col(id_col).alias("id"), binary_text(text_col).alias("t"))
    id_kind = src.schema["id"].dataType.simpleString()

    def run(batches):
        split = splitter()
        for batch in batches:
            n, out = [], []
            for text in batch.column(1):
                count, hashes = run_hashes(text.as_py().lower(), split, max_run)
                n.append(count)
                out.append((np.array(hashes, dtype=np.uint32) % buckets).astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(out, pa.binary())],
                names=["id", "n_words", "f"])

    return materialize(src.mapInArrow(run, f"id {id_kind}, n_words long, f binary"), name)


def _arrow_buckets(column, buckets: int):
    """All buckets of a binary column, and where each row's end."""
    kind = np.dtype(np.uint16 if buckets <= 1 << 16 else np.uint32)
    values = column.to_pylist()
    ends = np.cumsum([len(v) // kind.itemsize for v in values])
    return np.frombuffer(b"".join(values), dtype=kind), ends


def histogram(features: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs: tasks count for themselves, Spark adds up."""
    def count(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            total += np.bincount(_arrow_buckets(batch.column(0), buckets)[0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])],
                                         names=["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for r in (features.select("f").mapInArrow(count, "bucket int, n long")
              .groupBy("bucket").agg(F.sum("n").alias("n")).collect()):  # one row per bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of how much likelier a bucket is in the target, smoothed."""
    size, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(((t + 1) * (s_all + size))
                                                / ((s + 1) * (t_all + size))))
                     for s, t in zip(source.tolist(), target.tolist())], dtype=np.int64)


def _weights(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """(id, n_words, n_features, weight)."""
    buckets = len(gain)

    def run(batches):
        for batch in batches:
            f, ends = _arrow_buckets(batch.column(2), buckets)
            total = np.concatenate(([0], np.cumsum(gain[f])))
            n = np.diff(np.concatenate(([0], ends))).astype(np.int64)
            sums = np.diff(total[np.concatenate(([0], ends)).astype(np.int64)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n),
                 pa.array(np.where(n > 0, sums // np.maximum(n, 1), 0))],
                names=["id", "n_words", "n_features", "weight"])

    kind = features.schema["id"].dataType.simpleString()
    return features.select("id", "n_words", "f").mapInArrow(
        run, f"id {kind}, n_words long, n_features long, weight long")


def _ranked(rows: DataFrame, order: list) -> DataFrame:
    """``rows`` with ``place``, their number from 1 in ``order``. One sort over all partitions;
    only the partitions' sizes come to the driver."""
    placed = materialize(rows.orderBy(*order).withColumn(
        "__at", F.monotonically_increasing_id()), "resampling-order")
    part = F.floor(F.col("__at") / F.lit(_ROWS)).cast("long")
    before, offsets = 0, []
    for r in placed.groupBy(part.alias("part")).count().orderBy("part").collect():
        offsets.append((r["part"], before))
        before += r["count"]
    offsets = rows.sparkSession.createDataFrame(offsets, "part long, before long")
    return (placed.withColumn("part", part).join(F.broadcast(offsets), "part")
            .withColumn("place", F.col("before") + F.col("__at") % F.lit(_ROWS) + 1)
            .drop("part", "before", "__at"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20,
             buckets: int = 10_000, max_run: int = 2, seed: int = 7, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, ``n_features``, ``weight``, ``score``, ``rank``.

    Words are what ``WORD`` matches in the whole text, A-Z lower-cased; features are the runs
    of 1 to ``max_run`` consecutive words joined by one blank, repeats counted, in the bucket
    crc32 mod ``buckets``. With S features in all ``docs``, s in a bucket, and T and t in the
    texts of ``target``, a bucket's gain is floor(1000 ln((t+1)(S+buckets)/((s+1)(T+buckets)))).
    ``weight`` is the floored mean gain of a document's features, 0 without any; ``score`` adds
    floor(-1000 ln(-ln((h+0.5)/2^32))), h being the first 8 hex digits of sha256("seed:id").
    Of the N documents with ``min_words`` words or more the floor(percent N/100) highest scores
    are drawn, equal scores by ascending id, and ranked from 1; other rows have a null rank.

    Null and empty texts have no words. Long texts are split in pieces between words and
    counted whole. A null id hashes as the empty text and sorts first; rows that repeat an id
    are ranked one after the other. Empty tables give an empty result or, as the target,
    gains of the corpus alone. Other columns are not read.
    """
    features = _features(docs, id_col, text_col, buckets, max_run, "resampling-features")
    wanted = _features(target, text_col, text_col, buckets, max_run, "resampling-target")
    gain = gains(histogram(features, buckets), histogram(wanted, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(
        F.col("id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    # ``row`` deals out rows that are alike in everything else.
    scored = materialize(_weights(features, gain).select(
        "id", "n_words", "n_features", "weight", (F.col("weight") + gumbel).alias("score"),
        F.monotonically_increasing_id().alias("row")), "resampling-scores")
    long_enough = scored.where(F.col("n_words") >= min_words)
    drawn = long_enough.count() * percent // 100
    order = [F.desc("score"), F.col("id").asc_nulls_first(), "weight", "n_features",
             F.xxhash64("row")]
    ranked = _ranked(long_enough, order).withColumn(
        "rank", F.when(F.col("place") <= drawn, F.col("place"))).drop("place")
    rest = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select(
        F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
