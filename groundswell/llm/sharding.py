"""Shards by a hierarchical weighted hash tree."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from groundswell.llm.common import text_or_empty


@dataclass(frozen=True)
class Tree:
    """regions[r][k][i] is the weight of the i-th shard in rack k of region r; shards are numbered in that order."""

    regions: tuple[tuple[tuple[float, ...], ...], ...]

    @classmethod
    def of(cls, shards: int, *, founded: int | None = None, per_rack: int = 4, racks: int = 3) -> Tree:
        """The tree of ``shards`` shards, founded with ``founded`` of them (all, if not said), which fill regions of
        ``racks`` racks; each later shard founds a region of its own, so that growing by one changes no weight in
        an older subtree, and keys move only into the new shard."""
        first = shards if founded is None else founded
        if not 1 <= first <= shards:
            raise ValueError("a tree is founded with a shard at least, and grows")
        rack_list = [(1.0,) * len(range(i, min(first, i + per_rack))) for i in range(0, first, per_rack)]
        regions = [tuple(rack_list[i : i + racks]) for i in range(0, len(rack_list), racks)]
        return cls((*regions, *((((1.0,),),) * (shards - first))))

    @property
    def shards(self) -> int:
        return sum(len(rack) for region in self.regions for rack in region)


def _draw(key: Column, level: str, node: Column, weight: Column) -> Column:
    """An exponential draw of rate ``weight``, negated: among siblings the largest wins, in proportion to weight."""
    digest = F.md5(F.concat_ws(":", key, F.lit(level), node.cast("string")).cast("binary"))
    unit = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))
    return F.log(unit) / weight


def _choose(key: Column, level: str, nodes: Column, weights: Column) -> Column:
    """Of an array of node numbers, the one with the largest draw."""
    pairs = F.transform(F.arrays_zip(nodes.alias("node"), weights.alias("weight")), lambda p: F.struct(_draw(key, level, p["node"], p["weight"]).alias("draw"), p["node"].alias("node")))
    return F.array_max(pairs)["node"]


def _literal(rows: list[list[float]], kind: str) -> Column:
    return F.lit(F.array(*[F.array(*[F.lit(x).cast(kind) for x in row]) for row in rows]))


def place(key: Column, tree: Tree) -> Column:
    """The shard of a key: a weighted hash draw among regions, then among that region's racks, then that rack's
    shards. A draw depends on the key, the node and its weight alone, so a changed weight moves keys only into
    or out of the subtrees on the changed path."""
    region_ids, region_weights, rack_ids, rack_weights, shard_ids, shard_weights = [], [], [], [], [], []
    shard = 0
    for r, region in enumerate(tree.regions):
        region_ids.append(r)
        region_weights.append(sum(map(sum, region)))
        rack_ids.append([])
        rack_weights.append([])
        for rack in region:
            rack_ids[-1].append(len(shard_ids))
            rack_weights[-1].append(sum(rack))
            shard_ids.append(list(range(shard, shard + len(rack))))
            shard_weights.append(list(rack))
            shard += len(rack)
    region = _choose(key, "region", _literal([region_ids], "int")[0], _literal([region_weights], "double")[0])
    rack = _choose(key, "rack", _literal(rack_ids, "int")[region], _literal(rack_weights, "double")[region])
    return _choose(key, "shard", _literal(shard_ids, "int")[rack], _literal(shard_weights, "double")[rack])


def shard_documents(docs: DataFrame, *, shards: int = 24, founded: int | None = None, buckets: int = 1024) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 8), text_crc32, law 'key', shard, slot, grown_shard for every row.

    ``shard`` is the row's place in a tree of ``shards`` shards, founded with ``founded`` of them (all, if not said), and
    ``grown_shard`` in the same tree grown by one: it differs from ``shard`` only where it is the new one, for any
    number of shards. ``slot`` numbers a shard's rows from 0 without gaps, in order of (bucket, doc_id, text_crc32,
    size), where the bucket is a hash of doc_id and text: rows that share an id, or have none, are spread over all
    buckets unless their texts are equal, too. The numbering reads counts of (shard, bucket) first, at most
    ``shards * buckets`` rows whatever the input.

    A null text counts as empty. Null doc_ids share one shard, as the key alone decides. Repeated rows get slots of
    their own, in any order among themselves. An empty table gives an empty result. Other columns are not read.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    text = text_or_empty("text")
    digest = F.md5(F.concat_ws(":", key, F.md5(text.cast("binary")), F.lit("bucket")).cast("binary"))
    bucket = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % buckets).cast("int")
    first = shards if founded is None else founded
    placed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        place(key, Tree.of(shards, founded=first)).alias("shard"),
        place(key, Tree.of(shards + 1, founded=first)).alias("grown_shard"),
        bucket.alias("bucket"),
    )
    counts = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("shard", "bucket", F.coalesce(before, F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")) - 1
    # At most shards * buckets rows of 20 bytes: half a megabyte as called here.
    out = placed.withColumn("within", within).join(F.broadcast(offsets), ["shard", "bucket"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("within")).cast("long").alias("slot"), "grown_shard", "bucket")
