"""Licence notices by a positional rare-token index. DataFrame operations only.

Templates are word sequences of licence notices with mandatory key phrases. One pass counts in
how many documents each template word stands. The index keeps, for every mandatory phrase, the
word of highest inverse document frequency and its position in the template. A document's
places of those rare words, less the position in the template, say where the template would
start; starts on which all phrases of a template agree are verified word by word on the
phrases. The score is the share of the template's inverse-document-frequency weight that
stands at its place. All of it happens within the document's row: no join and no shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import ascii_lower

# Phrases asked for, with their labels.
BASE = [
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
]
# Opening words of well-known licence notices: label, words, mandatory phrases (fixed values).
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license", "2 0"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this "
            "software and associated documentation files", ["permission is hereby granted",
                                                            "associated documentation files"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are "
            "permitted provided that the following conditions are met",
     ["redistribution and use", "source and binary forms"]),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3",
     ["gnu general public license", "version 3"]),
    ("lgpl", "under the terms of the gnu lesser general public license",
     ["lesser general public license"]),
    ("agpl", "under the terms of the gnu affero general public license",
     ["affero general public license"]),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0",
     ["mozilla public license"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-nd", "licensed under cc by nd 4 0", ["cc by nd"]),
    ("cc0", "cc0 1 0 universal public domain dedication", ["public domain dedication"]),
    # Standard notices and names as they are written out.
    ("apache-2.0", "apache license 2 0", ["apache license 2 0"]),
    ("bsd", "bsd 2 clause license", ["bsd 2 clause"]),
    ("bsd", "bsd 3 clause license", ["bsd 3 clause"]),
    ("lgpl", "under the terms of the gnu library general public license",
     ["library general public license"]),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license",
     ["creative commons attribution 4 0"]),
    ("cc-by", "licensed under a creative commons attribution 3 0 unported license",
     ["creative commons attribution 3 0"]),
    *((label, f"licensed under a creative commons attribution {words}",
       [f"creative commons attribution {words}"])
      for label, words in [("cc-by-nc", "noncommercial"), ("cc-by-nc", "non commercial"),
                           ("cc-by-sa", "sharealike"), ("cc-by-sa", "share alike"),
                           ("cc-by-nd", "noderivatives"), ("cc-by-nd", "noderivs"),
                           ("cc-by-nd", "no derivatives")]),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2",
     ["gnu general public license", "version 2"]),
    *((f"gpl-{n}.0", f"under the terms of the gnu general public license {words} {n}".replace("v ", "v"),
       ["gnu general public license", f"{words} {n}".replace("v ", "v")])
      for n in (2, 3)
      for words in ("v", "as published by the free software foundation version",
                    "as published by the free software foundation either version")),
]
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_GAP_CHARS = "".join(chr(c) for c in range(128) if not chr(c).isalnum() or chr(c).isupper())


def words_of(text_col: str = "text") -> Column:
    """Words of a text, A-Z lower-cased; null and empty texts have none."""
    text = F.btrim(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(_GAP_CHARS))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, _GAP))


def _templates(base, templates) -> list[dict]:
    out = []
    for label, text, phrases, asked in ([(a, b, [b], True) for a, b in base]
                                        + [(a, b, c, False) for a, b, c in templates]):
        words, keys = text.split(), []
        for phrase in phrases:
            p = phrase.split()
            at = next(i for i in range(len(words)) if words[i:i + len(p)] == p)
            keys.append(range(at, at + len(p)))
        out.append({"label": label, "words": words, "keys": keys, "asked": asked})
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         base=BASE, templates=TEMPLATES) -> DataFrame:
    """One row per input row: ``id_col``, ``n_words``, and ``found``, an array of (label, asked,
    start word, score) sorted by start, one entry per verified place of a template; ``asked``
    marks the ``base`` phrases, which must stand whole.

    Words are what ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` matches after lower-casing A-Z. Null
    and empty texts have no words and no places. Long texts are read whole. Repeated rows and
    null ids are scanned like any other; an empty table gives no rows.
    """
    kinds = _templates(base, templates)
    vocabulary = sorted({w for t in kinds for w in t["words"]})
    rows = docs.select(id_col, words_of(text_col).alias("__w"))
    total = 0
    df = dict.fromkeys(vocabulary, 0)
    seen = F.array_append(F.array_intersect("__w", F.array(*map(F.lit, vocabulary))), F.lit(""))
    for r in (rows.select(F.explode(seen).alias("word")).groupBy("word").count()
              .collect()):  # one row per template word, and "" for all documents
        if r["word"]:
            df[r["word"]] = r["count"]
        else:
            total = r["count"]
    idf = {w: math.log((total + 1) / (n + 1)) + 1e-3 for w, n in df.items()}

    index = []  # rare words of the mandatory phrases
    for t in kinds:
        t["rare"] = []
        for key in t["keys"]:
            at = max(key, key=lambda q: (idf[t["words"][q]], -q))
            if t["words"][at] not in index:
                index.append(t["words"][at])
            t["rare"].append((index.index(t["words"][at]) + 1, at))
    literal = F.array(*map(F.lit, index))
    places = F.filter(F.transform("__w", lambda w, i: F.struct(
        F.array_position(literal, w).cast("int").alias("w"), i.alias("i"))), lambda h: h["w"] > 0)

    def found(t: dict) -> Column:
        def starts(word: int, at: int) -> Column:
            return F.transform(F.filter("__p", lambda h: h["w"] == word), lambda h: h["i"] - at)

        agree = F.array_distinct(starts(*t["rare"][0]))
        for rare in t["rare"][1:]:
            agree = F.array_intersect(agree, starts(*rare))

        def holds(s: Column) -> Column:
            test = F.lit(True)
            for q in sorted({q for key in t["keys"] for q in key}):
                test &= F.coalesce(F.get("__w", s + q) == t["words"][q], F.lit(False))
            return test

        weight = sum(idf[w] for w in t["words"])

        def score(s: Column) -> Column:
            got = F.lit(0.0)
            for q, w in enumerate(t["words"]):
                got += F.when(F.get("__w", s + q) == w, idf[w]).otherwise(0.0)
            return F.least(F.lit(1.0), got / weight)

        return F.transform(F.filter(agree, holds), lambda s: F.struct(
            s.alias("start"), F.lit(t["label"]).alias("label"), F.lit(t["asked"]).alias("asked"),
            score(s).alias("score")))

    none = F.array().cast("array<struct<start:int,label:string,asked:boolean,score:double>>")
    with_places = rows.withColumn("__p", F.when(F.arrays_overlap("__w", literal), places).otherwise(
        F.array().cast("array<struct<w:int,i:int>>")))
    return with_places.select(
        id_col, F.size("__w").cast("long").alias("n_words"),
        F.when(F.size("__p") > 0, F.array_sort(F.concat(*[found(t) for t in kinds])))
        .otherwise(none).alias("found"))


def summary(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, first and last start of the base phrases, labels, and the best score."""
    asked = F.filter("found", lambda e: e["asked"])

    def labels(entries: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(
            F.transform(entries, lambda e: e["label"]))), ",")

    def start(pick) -> Column:
        return pick(F.transform(asked, lambda e: e["start"])).cast("long")

    return scanned.select(
        id_col, "n_words", F.size(asked).cast("long").alias("n_base"),
        start(F.array_min).alias("first_word"), start(F.array_max).alias("last_word"),
        labels(asked).alias("base_labels"), labels(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda e: e["score"])), F.lit(0.0))
        .alias("score"))
