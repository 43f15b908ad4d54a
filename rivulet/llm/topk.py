"""Exact top-k inner products by a pivot-distance index.

Vectors are keyed by their nearest pivot p and their distance to it and laid out in that order;
consecutive ones form blocks, each an annulus lo <= |v - p| <= hi around its pivot, with the
largest length |v| of its vectors. Pivots grow with the square root of the table and are chosen
far apart. Three bounds hold for the score <q, v> of a vector of an annulus:

- |q| |v|, by length alone;
- <q, p> + |q| hi, as v is no further than hi from p;
- (|q|^2 + |v|^2 - gap^2) / 2, where gap is what parts |q - p| from [lo, hi]: by the triangle
  inequality q and v are no closer than that.

Queries first visit the annuli at their own distance around the pivots of highest product, and
so get a k-th best score. That score turns the bounds into one range of distances per query and
pivot, mostly empty where the data form clusters. Only pivots whose range is not empty are looked
at further, and the range is looked up in the pivot's sorted annuli, which are kept in pages: a
query expands over them as far as the bounds reach and no (query, annulus) is listed beyond that.
An annulus is compared with its visiting queries in blocks, as one matrix product each over the
vectors whose distance lies in a range of theirs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rivulet.llm.common import materialize

PIVOTS = 1024      # at most; half the square root of the table's size below that
SPREAD = 4         # sampled vectors for each pivot, in the order of a hash of the id
BLOCK = 512        # vectors of an annulus
PAGE = 10          # annuli of a page, as a power of two
NEAR = 2           # pivots that a query visits first
SHARE = 16_384     # queries that are compared with one copy of an annulus
SLACK = 1e-6       # of a bound, for rounding
_BLOCKS = ("block long, pivot int, lo double, hi double, longest double, ids binary, "
           "dists binary, data binary")


def _whole(rows, scale: int) -> np.ndarray:
    return np.floor(np.array(rows.tolist(), dtype=np.float64) * scale)


def far_apart(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` different rows of ``sample``: the first, then always the one that is
    furthest from those taken."""
    taken = [0]
    near = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(taken) < n and near.max() > 0:
        taken.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[taken[-1]]) ** 2).sum(axis=1))
    return sample[taken]


def _blocks(batches):
    """Task: cut the rows of each pivot, in order of distance, into annuli."""
    task, n = TaskContext.get().partitionId(), 0
    for pdf in batches:
        rows = []
        for pivot, part in pdf.groupby("pivot", sort=True):
            for at in range(0, len(part), BLOCK):
                cut = part.iloc[at:at + BLOCK]
                dist = cut["dist"].to_numpy("<f8")
                rows.append((task << 40 | n, pivot, dist[0], dist[-1], cut["length"].max(),
                             cut["id"].to_numpy("<i8").tobytes(), dist.tobytes(),
                             b"".join(cut["data"])))
                n += 1
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _BLOCKS.split(", ")])


def _compare(k: int, dim: int):
    """One annulus and (a share of) the queries that visit it: each query's k best there."""
    def run(pdf: pd.DataFrame, annulus: pd.DataFrame) -> pd.DataFrame:
        all_ids = np.frombuffer(annulus["ids"].iat[0], "<i8")
        dists = np.frombuffer(annulus["dists"].iat[0], "<f8")
        whole = np.frombuffer(annulus["data"].iat[0], "<f8").reshape(-1, dim)
        out = [pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")]
        pdf = pdf.sort_values(["start", "query_id"])
        for at in range(0, len(pdf), 1024):  # queries in blocks
            part = pdf.iloc[at:at + 1024]
            reached = slice(int(np.searchsorted(dists, part["start"].min())),
                            int(np.searchsorted(dists, part["stop"].max(), side="right")))
            ids, data = all_ids[reached], whole[reached]
            if not len(ids):
                continue
            q = np.frombuffer(b"".join(part["q"]), "<f8").reshape(-1, dim)
            scores = q @ data.T  # whole numbers, exact in doubles
            qid = part["query_id"].to_numpy()
            scores[qid[:, None] == ids] = -np.inf
            floor = part["floor"].to_numpy(dtype=np.float64)
            m = min(k, len(ids))
            edge = np.partition(scores, len(ids) - m, axis=1)[:, len(ids) - m]
            row, col = np.nonzero((scores >= np.maximum(edge, floor)[:, None])
                                  & np.isfinite(scores))
            order = np.lexsort((ids[col], -scores[row, col], row))
            row, col = row[order], col[order]
            first = np.searchsorted(row, row)
            keep = np.arange(len(row)) - first < k
            row, col = row[keep], col[keep]
            out.append(pd.DataFrame({"query_id": qid[row], "vec_id": ids[col],
                                     "score": scores[row, col].astype(np.int64)}))
        return pd.concat(out, ignore_index=True)
    return run


_RAYS = ("query_id long, pivot int, dq double, qp double, q2 double, floor double, start double, "
         "stop double")


def _rays(centre: np.ndarray, reach: np.ndarray, slack: float, seek: bool):
    """Task: queries with the pivots that they look at and their range of distances there.
    ``reach`` holds a pivot's least and largest distance and its largest length. ``seek`` gives
    the first visits: the NEAR pivots of highest product, at the query's own distance."""
    c2 = (centre ** 2).sum(axis=1)
    lo, hi, longest = reach

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 1024):
                part = pdf.iloc[at:at + 1024]
                q = np.frombuffer(b"".join(part["q"]), "<f8").reshape(len(part), -1)
                qp = q @ centre.T
                q2 = (q ** 2).sum(axis=1)[:, None]
                dq = np.sqrt(np.maximum(0.0, q2 + c2 - 2 * qp))
                floor = part["floor"].to_numpy(dtype=np.float64)[:, None]
                if seek:
                    best = np.argsort(-qp, axis=1, kind="stable")[:, :NEAR]
                    row, col = np.repeat(np.arange(len(part)), best.shape[1]), best.ravel()
                    start = np.clip(dq, lo, hi)
                    stop = start
                else:
                    width = np.sqrt(np.maximum(0.0, q2 + longest ** 2 - 2 * floor + 2 * slack))
                    length = np.sqrt(q2)
                    ball = np.where(length > 0, (floor - slack - qp) / np.maximum(length, 1e-300),
                                    -np.inf)
                    start, stop = np.maximum(dq - width, ball) - slack, dq + width + slack
                    row, col = np.nonzero((start <= hi) & (stop >= lo) & (lo <= hi)
                                          & (length * longest + slack >= floor))
                yield pd.DataFrame({
                    "query_id": part["query_id"].to_numpy()[row], "pivot": col.astype(np.int32),
                    "dq": dq[row, col], "qp": qp[row, col], "q2": q2[row, 0],
                    "floor": floor[row, 0], "start": start[row, col], "stop": stop[row, col]})
    return run


def _reached(rays: DataFrame, pages: DataFrame, slack: float) -> DataFrame:
    """(query_id, block, floor, start, stop) of the annuli that the rays reach."""
    rays = rays.withColumnRenamed("pivot", "p")
    both = rays.join(pages, (F.col("p") == F.col("pivot")) & (F.col("stop") >= F.col("lo"))
                     & (F.col("start") <= F.col("hi")))

    def reached(b):
        gap = F.greatest(F.col("dq") - b["hi"], b["lo"] - F.col("dq"), F.lit(0.0))
        length = F.sqrt("q2")
        bound = F.least(length * b["longest"], F.col("qp") + length * b["hi"],
                        (F.col("q2") + b["longest"] * b["longest"] - gap * gap) / 2)
        return ((b["hi"] >= F.col("start")) & (b["lo"] <= F.col("stop"))
                & (bound + F.lit(slack) >= F.col("floor")))

    return both.select("query_id", "floor", "start", "stop", F.explode(
        F.filter("annuli", reached)["block"]).alias("block"))


def _best(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
          query_modulo: int = 50, scale: int = 256, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``query_modulo``
    the ``k`` rows, itself left out, of highest inner product of floor(scale * x); all rows if
    there are fewer, ties to the smaller id.

    Vectors that are null or empty, hold null or non-finite components, or have a null id take
    no part; nor do vectors of another length than the table's most frequent one. Rows that
    repeat an id and vector count once; of differing vectors under one id each row counts, and
    none of them is a candidate for a query of that id. An empty table, or one without
    queries, gives no rows. A query id with several vectors is answered over all of them.
    Scores are exact while they stay below 2^53.
    """
    number = F.col(id_col).cast("long")
    usable = (vectors.where(number.isNotNull() & F.col(vec_col).isNotNull()).where(
        F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x)
                 & (F.abs(x.cast("double")) < float("inf"))) & (F.size(vec_col) > 0)))
    usable = usable.select(number.alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    sizes = usable.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    spark = vectors.sparkSession
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = sizes["n"]
    usable = usable.where(F.size("v") == dim)
    wanted = max(1, min(pivots, math.isqrt(sizes["count"]) // 2))
    sample = usable.orderBy(F.xxhash64("id"), "id", "v").limit(SPREAD * wanted).toPandas()  # bounded
    centre = far_apart(_whole(sample["v"], scale), wanted)

    def key(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            v = _whole(pdf["v"], scale)
            near = ((centre ** 2).sum(axis=1) - 2 * v @ centre.T).argmin(axis=1)
            data = v.astype("<f8")
            yield pd.DataFrame({"id": pdf["id"], "pivot": near.astype(np.int32),
                                "dist": np.linalg.norm(v - centre[near], axis=1),
                                "length": np.linalg.norm(v, axis=1),
                                "data": [r.tobytes() for r in data]})

    keyed = usable.mapInPandas(key, "id long, pivot int, dist double, length double, data binary")
    keyed = materialize(keyed.dropDuplicates(["id", "data"]), "topk-keyed")
    blocks = materialize(
        keyed.repartitionByRange("pivot", "dist", "id").sortWithinPartitions("pivot", "dist", "id")
        .mapInPandas(_blocks, _BLOCKS), "topk-blocks")
    queries = keyed.where(F.col("id") % query_modulo == 0).select(
        F.col("id").alias("query_id"), F.col("data").alias("q"))
    # A pivot's annuli in order of distance, up to 2^PAGE of them a row.
    pages = blocks.groupBy("pivot", F.shiftright("block", PAGE).alias("page")).agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.array_sort(F.collect_list(F.struct("lo", "hi", "longest", "block"))).alias("annuli"))
    reach = np.array([[np.inf], [-np.inf], [0.0]]) * np.ones(len(centre))
    for r in blocks.groupBy("pivot").agg(F.min("lo"), F.max("hi"), F.max("longest")).collect():
        reach[:, r[0]] = r[1:]   # a row for each pivot
    slack = SLACK * (1 + reach[2].max() ** 2)
    result = "query_id long, vec_id long, score long"

    # Queries that visit one annulus come in shares of a bounded size, each with its own copy.
    shares = max(1, -(-queries.count() // SHARE))
    salted = blocks.select("block", "ids", "dists", "data", F.explode(
        F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"))

    def visit(who: DataFrame) -> DataFrame:
        share = F.pmod(F.xxhash64("query_id"), F.lit(shares)).cast("int")
        asked = who.join(queries, "query_id").withColumn("share", share)
        needed = salted.join(who.select("block", share.alias("share")).distinct(),
                             ["block", "share"], "left_semi").select(
            F.col("block").alias("b"), F.col("share").alias("s"), "ids", "dists", "data")
        return asked.groupBy("block", "share").cogroup(
            needed.groupBy("b", "s")).applyInPandas(_compare(k, dim), result)

    anything = F.lit(float("-inf"))
    first = materialize(_reached(
        queries.withColumn("floor", anything).mapInPandas(_rays(centre, reach, slack, True), _RAYS),
        pages, slack).select("query_id", "block").distinct(), "topk-first")
    seeds = materialize(_best(visit(first.withColumns(
        {"floor": anything, "start": anything, "stop": F.lit(float("inf"))})), k)
        .drop("rank"), "topk-seeds")
    floors = seeds.groupBy("query_id").agg(
        F.when(F.count(F.lit(1)) >= k, F.min("score").cast("double")).alias("floor"))
    ready = queries.join(floors, "query_id", "left").withColumn(
        "floor", F.coalesce("floor", anything))
    rays = ready.mapInPandas(_rays(centre, reach, slack, False), _RAYS)
    # A query id with several vectors may reach an annulus more than once.
    further = _reached(rays, pages, slack).groupBy("query_id", "block").agg(
        F.min("floor").alias("floor"), F.min("start").alias("start"), F.max("stop").alias("stop"))
    further = further.join(first, ["query_id", "block"], "left_anti")
    found = visit(further).unionByName(seeds)
    return _best(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id",
                                  "score")
