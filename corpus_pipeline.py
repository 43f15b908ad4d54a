"""Clean a document table and pack it for training.

STAGES lists the stages in order; each takes (spark, docs, sf_dir) and returns a DataFrame.
All but the last return the columns of ``documents``. ``run`` writes each stage's result as
Parquet in the shared work folder and reads it back as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.common import materialize, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 stay. Labels of held-out documents are not read."""
    from rivulet.llm.toxicity import drop_toxic
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the document with the smallest id stays."""
    from rivulet.llm.exact_dedup import drop_exact
    return drop_exact(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints (4-word shingles) are joined by links of 4 bits or
    fewer the one with the smallest id stays."""
    from rivulet.llm.simhash import drop_near
    return drop_near(docs, shingle=4, max_bits=4)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Text that repeats 50 bytes or more of a document with a smaller id goes; whole
    characters only. ``n_chars`` counts what stays. A document may end up empty; it stays."""
    from rivulet.llm.suffixes import remove_repeats
    # Numbered names, as a column of the documents may be called like one of the result.
    number = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    carry = [number[c] for c in docs.columns if c != "text"]
    out = remove_repeats(docs.toDF(*number.values()), number["doc_id"], number["text"],
                         min_len=50, carry=carry, whole_chars=True)
    text = F.col("kept").cast("string")
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length(text).cast(docs.schema["n_chars"].dataType)
    return out.select(*(new.get(c, F.col(number[c])).alias(c) for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 ids, each document ended by id 1."""
    from public_tokenizers import path

    from rivulet.llm.packing import pack
    return pack(docs, path("byte_bpe_50k.json"), size=2048, end_id=1)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup),
          ("substring_dedup", substring_dedup), ("packing", packing)]

ORACLE_SQL = None  # XXH64 with a seed, byte suffixes and the tokenizer are beyond DuckDB SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
