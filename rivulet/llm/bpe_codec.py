"""Byte-level BPE encoding and decoding of whole texts.

``encode_words`` is the method as SQL: higher-order functions fold the merge of lowest rank
over an array of byte pieces, with the ranks as a literal table in the expression. Lambdas are
interpreted, and ids found for distinct words must still be brought back to every place in
every text, which is a join as large as the corpus (the README has figures). So ``encode``
folds the same merges over the distinct words that a task meets, as array operations
(``bpe.Encoder``), and needs no shuffle at all.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm.bpe import encoder, read_ranks
from rivulet.llm.common import binary_text, slices

BUCKETS = 1 << 14
OUT_BYTES = 4 << 20


def load_pieces(vocabulary: str) -> list[bytes]:
    with open(vocabulary, "rb") as f:
        return read_ranks(f.read())


def _carry(docs: DataFrame, pieces: list[bytes]):
    return docs.sparkSession.sparkContext.broadcast(pieces)  # one entry per vocabulary piece


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
           with_decoded: bool = False) -> DataFrame:
    """(id_col, ids array<int>), one row per input row, in no other order than the input's;
    ``with_decoded`` adds what ``decode`` gives for the ids, without a second Python worker.

    ``vocabulary``: path of a ``.tiktoken`` rank file, read on the driver. No special tokens:
    their spelling in a text is ordinary text. Null and empty texts give an empty array; bytes
    that are not UTF-8 are read as U+FFFD. Words of any length are merged whole. Null ids,
    repeated rows and empty tables pass through.
    """
    pieces = _carry(docs, load_pieces(vocabulary))
    src = docs.select(id_col, binary_text(text_col).alias("t"))
    kind = src.schema[id_col].dataType.simpleString()

    def run(batches):
        enc = encoder(pieces.value, vocabulary)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts, OUT_BYTES):
                ids = list(enc.encode(texts[a:b]))
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
                cols = [batch.column(0).slice(a, b - a),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
                if with_decoded:
                    cols.append(_join(cols[1], pieces.value))
                yield pa.RecordBatch.from_arrays(cols, names=[id_col, "ids", "decoded"][:len(cols)])

    return src.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>"
                          + ", decoded binary" * with_decoded)


def _join(ids: pa.ListArray, piece: list[bytes]) -> pa.Array:
    """The pieces of each row's ids, one after another; a null row stays null."""
    flat = ids.values.to_numpy(zero_copy_only=False)
    ends, known = ids.offsets.to_numpy(), ids.is_valid().to_pylist()
    return pa.array([b"".join([piece[i] for i in flat[a:b].tolist()]) if ok else None
                     for a, b, ok in zip(ends[:-1].tolist(), ends[1:].tolist(), known)],
                    type=pa.binary())


def decode(encoded: DataFrame, vocabulary: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``: the binary pieces of the ids, one after another. Null ids
    give null, an empty array an empty value."""
    pieces = _carry(encoded, load_pieces(vocabulary))

    @F.arrow_udf("binary")
    def join(ids: pa.Array) -> pa.Array:
        return _join(ids, pieces.value)

    return encoded.withColumn("decoded", join(F.col(ids_col)))


def digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """Per row: ``n_tokens``, ``ids_sha256`` (of decimal ids joined by a space) and
    ``decoded_sha256``, all from the operator's ids."""
    ids = encode(docs, vocabulary, id_col, text_col, with_decoded=True)
    return ids.select(id_col, F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
                      .alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


def _rank_table(pieces: list[bytes]) -> Column:
    """Ranks as a literal: an array of short buckets, by a hash of the piece, so that a look-up
    reads one bucket (a map literal would be searched from its start)."""
    import xxhash
    table: list[list[dict]] = [[] for _ in range(BUCKETS)]
    for rank, piece in enumerate(pieces):
        if piece:
            text = piece.hex().upper()
            table[xxhash.xxh64_intdigest(text, 42) % BUCKETS].append({"p": text, "r": rank})
    return F.from_json(F.lit(json.dumps(table)), "array<array<struct<p:string,r:int>>>")


def encode_words(words: DataFrame, vocabulary: str, word_col: str = "word") -> DataFrame:
    """``words`` with ``ids``: the distinct words' ids, by SQL higher-order functions alone.
    Null and empty words give an empty array. Pieces are held as upper-case hex."""
    table = _rank_table(load_pieces(vocabulary))

    def rank(p: Column) -> Column:
        # The hash is unsigned in the table: bring Spark's signed one to the same residue.
        slot = F.pmod(F.xxhash64(p), F.lit(BUCKETS)).cast("int")
        return F.get(F.filter(F.get(table, slot), lambda e: e["p"] == p), F.lit(0))["r"]

    def step(acc: Column, _: Column) -> Column:
        ranks = F.transform(F.sequence(F.lit(0), F.size(acc) - 2),
                            lambda j: rank(F.concat(F.get(acc, j), F.get(acc, j + 1))))
        at = F.array_position(ranks, F.array_min(ranks)).cast("int")
        merged = F.concat(F.slice(acc, 1, at - 1),
                          F.array(F.concat(F.get(acc, at - 1), F.get(acc, at))),
                          F.slice(acc, at + 2, F.greatest(F.size(acc) - at - 1, F.lit(0))))
        return F.when((F.size(acc) < 2) | (F.coalesce(at, F.lit(0)) < 1), acc).otherwise(merged)

    text = F.coalesce(F.hex(F.col(word_col).cast("binary")), F.lit(""))
    n = F.octet_length(text) / 2
    start = F.when(n > 0, F.transform(F.sequence(F.lit(0), n.cast("int") - 1),
                                      lambda i: F.substring(text, i * 2 + 1, F.lit(2)))
                   ).otherwise(F.array().cast("array<string>"))
    rounds = F.when(n > 1, F.sequence(F.lit(1), n.cast("int") - 1)).otherwise(
        F.array().cast("array<int>"))
    folded = F.aggregate(rounds, start, step)
    return words.withColumn("ids", F.transform(folded, rank))
