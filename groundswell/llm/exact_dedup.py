"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundswell.llm.common import settled, split_join, text_or_empty

#: Keys of surviving (length, prefix) groups that may be broadcast: 24 bytes each, so 12 MB at most.
BROADCAST_KEYS = 500_000


def exact_dedup(docs: DataFrame, *, prefix_chars: int = 256, carry: Mapping[str, Column] | None = None, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, keep_id, group_size, kept, and the columns of ``carry``.

    Rows are grouped by text length; only lengths that occur twice go on to a hash of the first
    ``prefix_chars`` characters, and only (length, prefix) pairs that occur twice to a SHA-256 of the whole
    text. Of equal texts the row with the largest doc_id stays. Texts are never shuffled: each stage moves keys.

    Null texts count as empty and equal each other. A null doc_id never stays where another row of its group has
    a doc_id; a group of nulls alone keeps its rows. Rows that repeat a doc_id and its text count one by one in
    group_size and share their ``kept``. An empty table gives an empty result. Other columns are not looked at.
    ``carry`` maps names (without a leading underscore) to expressions over ``docs``.

    A group with a third of all rows is counted before any shuffle, and the last join can be split by key.
    """
    text = text_or_empty("text")
    carry = dict(carry or {})
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("_text"), F.octet_length(text).alias("n_bytes"), *[c.alias(n) for n, c in carry.items()])
    prefix = F.xxhash64(F.substring("_text", 1, prefix_chars))
    # One partial aggregate serves the first two levels: counts for (length, prefix), and their sums for lengths.
    pairs = rows.groupBy("n_bytes", prefix.alias("_prefix")).agg(F.count(F.lit(1)).alias("n"))
    lengths = pairs.groupBy("n_bytes").agg(F.sum("n").alias("of_length")).where("of_length > 1")
    alive = settled(pairs.where("n > 1").join(lengths, "n_bytes", "left_semi").select("n_bytes", "_prefix", F.lit(True).alias("_alive")))
    keyed = rows.withColumn("_prefix", prefix)
    few = alive.limit(broadcast_keys + 1).count() <= broadcast_keys
    full = F.unhex(F.sha2("_text", 256))
    if few:  # only survivors' whole texts are hashed
        keyed = keyed.join(F.broadcast(alive), ["n_bytes", "_prefix"], "left").withColumn("_full", F.when(F.col("_alive"), full))
    else:  # beyond the bound the keys stay put: hashing in the scan is cheaper than moving texts to them
        keyed = keyed.withColumn("_full", full)
    # A row that can't have a copy gets a key of its own: eight bytes, so never equal to a digest.
    alone = F.unhex(F.lpad(F.hex(F.xxhash64("doc_id", "_prefix")), 16, "0"))
    keyed = keyed.select("doc_id", "n_bytes", F.coalesce("_full", alone).alias("_key"), F.col("_full").isNotNull().alias("_candidate"), *carry)
    groups = keyed.where("_candidate").groupBy("_key").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    out = split_join(keyed, groups, ["_key"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", "n_bytes", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), *carry)
