"""Benchmark passages in training documents by a positional inverted index. DataFrame
operations only.

The training side is read once: its postings (document, position, term) are stored for every
term that the benchmark uses. Counted per term, they tell the rarest terms of each benchmark
window. The list of a window's rarest term, every position less the term's place in the item,
says where the item would have to begin; it is intersected with the list of the second rarest,
and only beginnings on both lists look up the rest of the window in the postings. The
benchmark is taken in blocks of bounded size, so what is broadcast (a block's terms, windows
and words) never grows with the corpus.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import materialize, text_bytes
from rivulet.llm.licenses import words_of

BLOCK_BYTES = 8 << 20  # benchmark text whose terms and windows are broadcast at a time
_ALIGNED = ["doc", "item", "begin"]


def _postings(docs: DataFrame, terms: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Written table (doc, id, n_words, pos, term): one row per place of a term of ``terms``.
    A document's first row is always there and alone carries ``n_words``; ``doc`` numbers the
    rows of ``docs``, so that null and repeated ids stay apart."""
    tokens = (docs.select(F.monotonically_increasing_id().alias("doc"),
                          F.col(id_col).alias("id"), words_of(text_col).alias("w"))
              .select("doc", "id", F.size("w").cast("long").alias("n"),
                      F.posexplode_outer("w").alias("pos", "word")))
    known = terms.select(F.col("term").alias("word"), "term")
    first = F.coalesce(F.col("pos") == 0, F.lit(True))
    return materialize(
        tokens.join(F.broadcast(known), "word", "left").where(first | F.col("term").isNotNull())
        .select("doc", "id", F.when(first, F.col("n")).alias("n_words"), "pos", "term"),
        "decontam-postings")


def _windows(places: DataFrame, window: int) -> DataFrame:
    """Windows (item, at, len, a, b) of which every term occurs in the corpus, with the places
    in the item of the rarest and the second rarest term (``b`` = ``a`` if it is the only one)."""
    last = F.greatest(F.col("n_item") - window, F.lit(0))
    at = F.explode(F.sequence(F.greatest(F.col("k") - window + 1, F.lit(0)),
                              F.least(F.col("k"), last)))
    rare = F.array_sort(F.collect_list(F.struct("df", "k")))
    return (places.select("item", "k", "df", "n_item", at.alias("at"))
            .groupBy("item", "at")
            .agg(rare.alias("r"), F.least(F.lit(window), F.max("n_item")).alias("len"))
            .where(F.col("r")[0]["df"] > 0)
            .select("item", "at", "len", F.col("r")[0]["k"].alias("a"),
                    F.coalesce(F.get("r", F.lit(1))["k"], F.col("r")[0]["k"]).alias("b")))


def _block(postings: DataFrame, places: DataFrame, window: int, slop: int) -> DataFrame:
    """Matches (doc, item, begin, at, len, exact) of one block of items. ``places`` holds
    (item, n_item, k, term, df)."""
    wins = materialize(_windows(places, window), "decontam-windows")
    shift = F.explode(F.array(*(F.lit(e) for e in range(-slop, slop + 1)))).alias("e")
    slots = (wins.select("item", F.col("a").alias("k"), F.lit(0).alias("e"))
             .unionByName(wins.select("item", F.col("b").alias("k"), shift))
             .distinct().join(F.broadcast(places.select("item", "k", "term")), ["item", "k"]))
    # Offset-adjusted lists of the two rarest terms of every window.
    lists = postings.where("term is not null").join(F.broadcast(slots), "term").select(
        "doc", "item", (F.col("pos") - F.col("k") - F.col("e")).alias("begin"), "k", "e")
    both = (lists.groupBy(*_ALIGNED)
            .agg(F.collect_set(F.when(F.col("e") == 0, F.col("k"))).alias("anchors"),
                 F.collect_set("k").alias("seen"))
            .join(F.broadcast(wins), "item")
            .where(F.array_contains("anchors", F.col("a")) & F.array_contains("seen", F.col("b"))))
    begins = materialize(
        both.select(*_ALIGNED, "at", "len", "a",
                    F.explode(F.sequence(F.col("at"), F.col("at") + F.col("len") - 1)).alias("k"))
        .groupBy(*_ALIGNED, "k").agg(F.collect_set(F.struct("at", "len")).alias("wins")),
        "decontam-begins")
    # The other terms of those windows, each at its place.
    asked = (begins.join(F.broadcast(places.select("item", "k", "term")), ["item", "k"])
             .select(*_ALIGNED, "k", "wins", "term", shift)
             .withColumn("pos", F.col("begin") + F.col("k") + F.col("e")))
    touched = postings.where("term is not null").join(begins.select("doc").distinct(), "doc",
                                                      "left_semi")
    there = (asked.join(touched.select("doc", "pos", "term"), ["doc", "pos", "term"])
             .groupBy(*_ALIGNED, "k", "wins").agg(F.min(F.abs("e")).alias("off")))
    return (there.select(*_ALIGNED, "off", F.explode("wins").alias("win"))
            .groupBy(*_ALIGNED, F.col("win.at").alias("at"), F.col("win.len").alias("len"))
            .agg(F.count(F.lit(1)).alias("n"), F.max("off").alias("far"))
            .where(F.col("n") == F.col("len"))
            .select(*_ALIGNED, "at", "len", (F.col("far") == 0).alias("exact")))


def _search(docs: DataFrame, items: DataFrame, window: int, slop: int, id_col: str,
            item_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The documents (doc, id, n_words) and the matches (doc, item_id, begin, at, len, exact)."""
    words = materialize(items.select(F.monotonically_increasing_id().alias("item"),
                                     F.col(item_col).alias("item_id"),
                                     words_of(text_col).alias("w")), "decontam-items")
    blocks = -(-text_bytes(items, text_col) // BLOCK_BYTES) or 1
    documents, found = None, []
    for i in range(blocks):
        part = words.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == i)
        places = part.select("item", "item_id", F.size("w").alias("n_item"),
                             F.posexplode("w").alias("k", "term"))
        postings = _postings(docs, places.select("term").distinct(), id_col, text_col)
        df = postings.where("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        known = materialize(places.join(F.broadcast(df), "term", "left").select(
            "item", "item_id", "n_item", "k", "term",
            F.coalesce("df", F.lit(0)).alias("df")), "decontam-terms")
        if documents is None:
            documents = postings.where("n_words is not null").select("doc", "id", "n_words")
        found.append(_block(postings, known.drop("item_id"), window, slop)
                     .join(F.broadcast(part.select("item", "item_id")), "item").drop("item"))
    return documents, materialize(reduce(DataFrame.unionByName, found), "decontam-matches")


def matches(docs: DataFrame, items: DataFrame, window: int = 10, slop: int = 0,
            id_col: str = "doc_id", item_col: str = "item_id",
            text_col: str = "text") -> DataFrame:
    """One row per place of a benchmark window in a document: ``id_col``, ``item_col``,
    ``first_word`` (of the document), ``item_word`` (of the item), ``n_words``, ``kind``.

    A window is ``window`` consecutive words of an item, or the whole item if it is shorter.
    ``exact``: its words stand consecutively. ``near`` (only with ``slop`` > 0): its rarest
    word stands somewhere and every other word at most ``slop`` words from its place beside
    it. Words are what ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` matches after lower-casing A-Z.
    Null and empty texts have no words and no windows. Whole texts are read, however long;
    every row of ``docs`` and ``items`` counts as its own, so repeated rows and null ids match
    like any other; empty tables give an empty result; other columns are not read.
    """
    documents, found = _search(docs, items, window, slop, id_col, item_col, text_col)
    return (documents.join(found, "doc")
            .select(F.col("id").alias(id_col), F.col("item_id").alias(item_col),
                    (F.col("begin") + F.col("at")).cast("long").alias("first_word"),
                    F.col("at").cast("long").alias("item_word"),
                    F.col("len").cast("long").alias("n_words"),
                    F.when(F.col("exact"), F.lit("exact")).otherwise(F.lit("near")).alias("kind")))


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id",
                  item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, ``n_words``, ``n_hit`` (words inside any occurrence
    of a window), ``n_items`` and ``items_sha256`` (ids of the items with occurring windows,
    each once, sorted as strings, comma-joined; a null id is the empty string),
    ``contaminated``. Nulls, empty and long texts, repeated rows and empty tables as in
    ``matches``; without any item no document is hit."""
    documents, found = _search(docs, items, window, 0, id_col, item_col, text_col)
    begin = F.col("begin") + F.col("at")
    hit = (found.select("doc", F.explode(F.sequence(begin, begin + F.col("len") - 1)).alias("p"))
           .distinct().groupBy("doc").agg(F.count(F.lit(1)).alias("n_hit")))
    ids = F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit("")))
    named = found.groupBy("doc").agg(F.array_sort(ids).alias("ids"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return (documents.join(hit.join(named, "doc"), "doc", "left")
            .select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"),
                    F.size(ids).cast("long").alias("n_items"),
                    F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
                    (n_hit > 0).alias("contaminated")))
