"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from groundswell.llm.common import settled, split_join, words

#: Rows of one source and size are dealt out by a hash to so many parts, and each of these to 16 by another digit of it;
#: rows of a part share a window, and so do the counts of a size's parts.
PARTS = 64
#: Sources that may be broadcast: some 100 bytes each.
BROADCAST_SOURCES = 100_000


def _unit(value: Column, name: str) -> Column:
    """A number in [0, 1) that depends on a string alone."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{name}:"), value).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def targets(sizes: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, cap: float = 3.0) -> DataFrame:
    """source, source_size, target for the rows (source, source_size).

    Sources in order of code points, null last, weigh ``weights`` in turn and share ``share`` of all sizes. A target
    stops at ``cap`` times its source's size and the excess is shared again by weight until none is above. In order
    of size per weight, the capped sources come first: one is capped if its part of what is left, by its weight among
    those left, is over its cap. The table of sources has a row a source, so windows over it are small; a source
    of size 0 gets 0.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("limit", F.lit(cap) * F.col("source_size"))
    ranked = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    whole = Window.partitionBy()
    rows = rows.withColumn("left", F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(ranked.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    rows = rows.withColumn("weight_left", F.sum("weight").over(ranked.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.withColumn("capped", F.col("left") * F.col("weight") / F.col("weight_left") > F.col("limit"))
    free = F.min(F.when(~F.col("capped"), F.struct((-F.col("weight_left")).alias("first"), F.col("left"), F.col("weight_left")))).over(whole)
    return rows.select("source", "source_size", F.when(F.col("capped"), F.col("limit")).otherwise(free["left"] * F.col("weight") / free["weight_left"]).alias("target"))


def mix_sources(docs: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, cap: float = 3.0, seed: str = "mix", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row; ``carry`` names columns to pass on.

    Size is the number of words. Every document of a source expects target / source_size copies. Along the source's
    documents in order of size (then of a hash of doc_id), the expected copies are summed, one offset a source,
    drawn from ``seed``, is added, and a document is emitted once for each integer its sum crosses: ``copies`` differs
    from the expectation by less than one, and the order by size holds a source's words within about one long
    document of its target. ``taken`` is copies times size. Reruns agree.

    Sums need only ranks, found in three steps (sizes of a source, parts of a size, rows of a part), so that no
    task holds a source. Null text: size 0. Null source: a source of its own, last. Rows that repeat a doc_id rank
    next to each other, in order of a hash of their texts; rows without one are ordered and dealt out by that hash.
    Only rows that agree in doc_id and text are in any order among themselves. A source without words, and so without a target, is not taken. An empty table: no rows.
    """
    known = {"doc_id", "source"}
    extra = [c for c in carry if c not in known]
    rows = settled(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.size(words(F.col("text"))).cast("long").alias("size"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_t"), *extra))
    # Nulls as keys: joins below compare (is null, value).
    key = F.coalesce(F.col("source"), F.lit("")).alias("_s")
    rows = rows.select("*", key, F.col("source").isNull().alias("_n"), F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.col("_t").cast("string")))).cast("binary")).alias("_h"))
    rows = rows.withColumn("_part", F.struct((F.conv(F.substring("_h", 1, 4), 16, 10).cast("int") % PARTS).cast("int").alias("of_64"), F.substring("_h", 1, 1).alias("of_16")))
    parts = settled(rows.groupBy("_s", "_n", "size", "_part").agg(F.count(F.lit(1)).alias("n")))
    by_size = parts.groupBy("_s", "_n", "size").agg(F.sum("n").alias("n"))
    earlier = lambda keys, by: F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by_size = by_size.withColumn("before_size", earlier(["_s", "_n"], "size")).drop("n")
    first = parts.withColumn("before_part", earlier(["_s", "_n", "size"], "_part")).join(by_size, ["_s", "_n", "size"]).select("_s", "_n", "size", "_part", (F.col("before_size") + F.col("before_part")).alias("before"))
    sizes = parts.groupBy("_s", "_n").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goal = targets(sizes.select(F.when(~F.col("_n"), F.col("_s")).alias("source"), "source_size"), weights=weights, share=share, cap=cap)
    goal = goal.select(F.coalesce("source", F.lit("")).alias("_s"), F.col("source").isNull().alias("_n"), "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goal = goal.withColumn("rate", rate).withColumn("offset", _unit(F.concat(F.col("_n").cast("string"), F.lit(":"), F.col("_s")), f"{seed}:offset"))
    within = F.row_number().over(Window.partitionBy("_s", "_n", "size", "_part").orderBy("_h", "doc_id", "_t")) - 1
    ranked = rows.withColumn("_within", within).join(first, ["_s", "_n", "size", "_part"]).withColumn("rank", F.col("before") + F.col("_within"))
    goal = settled(goal)
    few = goal.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    out = ranked.join(F.broadcast(goal), ["_s", "_n"]) if few else split_join(ranked, goal, ["_s", "_n"])
    at = lambda k: F.floor(F.col("rate") * k + F.col("offset"))
    copies = (at(F.col("rank") + 1) - at(F.col("rank"))).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), *extra)
