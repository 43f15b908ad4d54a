"""Connected components over a table of links, by alternating large-star and small-star steps
(Kiveris et al., "Connected Components in MapReduce and Beyond", 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: each node links its larger neighbours to the least of its neighbourhood.
    Small: each node links itself and its smaller neighbours to that least node."""
    a, b = F.col("a"), F.col("b")  # a < b
    near = (edges.select(a.alias("u"), b.alias("v")).unionByName(
        edges.select(b.alias("u"), a.alias("v"))) if large
        else edges.select(b.alias("u"), a.alias("v")))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select(
        "u", F.least("u", "m").alias("m"))
    out = near.join(least, "u")
    if large:
        out = out.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        out = out.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(
            least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return out.where("a < b").distinct()


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``links`` (``a``, ``b`` longs, a < b): component is
    the smallest node reachable. Each round is a written table; the driver sees only its row
    count and checksum. The rounds needed grow with the logarithm of the size; if more than
    ``max_rounds`` were needed it raises rather than give a partial result."""
    def state(df):
        r = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    edges = materialize(links.select("a", "b"), "components")
    now = state(edges)
    for _ in range(max_rounds):
        if not now[0]:
            break
        edges = materialize(_star(_star(edges, True), False), "components")
        before, now = now, state(edges)
        if now == before:
            break
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    roots = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(roots)
