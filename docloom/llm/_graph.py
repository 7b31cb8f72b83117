"""Connected components by alternating large and small stars; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ._scratch import Scratch

#: keys to which a hub's edges are dealt
SALTS = 8


def components(edges: DataFrame, scratch: Scratch, name: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges(a, b); component is the smallest node reachable.

    A round costs two aggregations and two joins; a hub's edges are dealt to SALTS keys.
    Rounds end when a round changes nothing; the count grows with the logarithm of the diameter.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:
            both = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        dealt = both.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
        joined = dealt.join(least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["u", "salt"])
        out = joined.filter("v > u" if large else "v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        if not large:
            out = out.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.filter("a <> b").distinct()

    def cut(e: DataFrame, i: int) -> tuple[DataFrame, tuple]:
        """The edges, written, and a digest of them."""
        e = scratch.cut(e, f"{name}-{i}")
        return e, tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e, before = cut(edges.select("a", "b").filter("a <> b").distinct(), 0)
    for i in range(1, max_rounds + 1 if before[0] else 0):
        e, now = cut(star(star(e, True), False), i)
        scratch.drop(f"{name}-{i - 1}")
        if now == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
