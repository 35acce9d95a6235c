"""Near-duplicates: banded MinHash, odd sketches, and exact similarity of the candidates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundswell.llm.common import documents, lower_ascii, map_arrow, mix, settled, split_join, text_blocks, window_hashes, word_bounds, word_hashes

#: Bits of an odd sketch, and parts of a set (by its hashes' top bits) whose MinHash samples are folded into it.
BITS, PARTS = 1024, 4
#: Sets below this size are compared without a look at sketches: parts of few shingles say little.
SMALL = 128
#: Documents whose sets may be fetched by a broadcast of their ids: 16 bytes each.
BROADCAST_IDS = 1_000_000


def _shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and where each text's begin."""
    data = lower_ascii(data)
    starts, ends, firsts = word_bounds(data, offsets)
    each = word_hashes(data, starts, ends)
    counts = np.diff(firsts)
    left = np.repeat(firsts[1:], counts) - np.arange(len(each))
    grams = window_hashes(each, words)
    place = np.flatnonzero(left[: len(grams)] >= words)
    value, text = grams[place], np.searchsorted(firsts, place, "right") - 1
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):  # the whole sequence is the one shingle
        few = [mix(np.array([np.bitwise_xor.reduce(mix(each[firsts[i] : firsts[i + 1]] + np.arange(counts[i], dtype=np.uint64)))]) ^ np.uint64(counts[i])) for i in short]
        value, text = np.concatenate([value, *few]), np.concatenate([text, short])
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    value, text = value[fresh], text[fresh]
    return value, np.searchsorted(text, np.arange(len(offsets)))


def _signatures(words: int, bands: int, rows: int):
    """n_shingles, set_a, set_b (128 bits of the set), bands, sketch of each text."""
    rng = np.random.default_rng(7)
    samples = bands * rows
    flips = rng.integers(0, 1 << 63, samples, dtype=np.uint64)
    factors = rng.integers(0, 1 << 62, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    salts = mix(rng.integers(0, 1 << 63, samples, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, offsets in text_blocks(batch.column("text"), 1 << 19):
                value, cut = _shingles(data, offsets, words)
                n, sizes = end - at, np.diff(cut)
                full = np.flatnonzero(sizes)
                lists = np.zeros((len(full), bands), np.uint64)
                odd = np.zeros((len(full), BITS), np.uint8)
                set_a, set_b = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                if len(full):
                    begin = cut[:-1][full]
                    set_a[full] = np.add.reduceat(mix(value ^ np.uint64(0x1234567)), begin)
                    set_b[full] = np.bitwise_xor.reduceat(mix(value ^ np.uint64(0x89ABCDE)), begin)
                    # Hashes are sorted in each text, so those of a part lie together.
                    part = np.repeat(np.arange(len(full)), sizes[full]) * PARTS + (value >> np.uint64(62)).astype(np.int64)
                    at_part = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
                    own = part[at_part]
                    row = own // PARTS
                    of_row = np.searchsorted(row, np.arange(len(full)))
                    flat = []
                    for k in range(samples):
                        least = np.minimum.reduceat((value ^ flips[k]) * factors[k], at_part)
                        flat.append(row * BITS + (mix(least ^ salts[k] ^ own.astype(np.uint64) % np.uint64(PARTS)) >> np.uint64(40)).astype(np.int64) % BITS)
                        band = k // rows
                        lists[:, band] = mix(lists[:, band] + mix(np.minimum.reduceat(least, of_row) ^ salts[k]) + np.uint64(band + 1))
                    odd = (np.bincount(np.concatenate(flat), minlength=len(full) * BITS) & 1).astype(np.uint8).reshape(len(full), BITS)
                sketch = np.zeros((n, BITS // 64), np.uint64)
                sketch[full] = np.packbits(odd, axis=1).view(np.uint64)
                ends = np.zeros(n + 1, np.int32)
                ends[1:][full] = bands
                keys = pa.ListArray.from_arrays(pa.array(np.cumsum(ends, dtype=np.int32)), pa.array(lists.ravel().view(np.int64)))
                bits = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (BITS // 64)), pa.array(sketch.ravel().view(np.int64)))
                columns = [batch.column("doc_id").slice(at, n), batch.column("text_key").slice(at, n), pa.array(sizes, pa.int64()), pa.array(set_a.view(np.int64)), pa.array(set_b.view(np.int64)), keys, bits]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "n_shingles", "set_a", "set_b", "bands", "sketch"])

    return run


def _sets(words: int):
    """Each text's shingle hashes, sorted, as an array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, offsets in text_blocks(batch.column("text"), 1 << 19):
                value, cut = _shingles(data, offsets, words)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, end - at), pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(value.view(np.int64)))], names=["id", "shingles"])

    return run


def most_flipped(samples: int, similarity: float, sigmas: float = 5.5) -> int:
    """The most bits in which odd sketches of sets of at least ``similarity`` differ, but for chances beyond ``sigmas``.

    Of ``samples`` MinHash samples, about (1 - similarity) differ, each flips two bits, and some bits flip back."""

    def share(differ: float) -> float:
        return (1 - (1 - 2 / BITS) ** (2 * differ)) / 2

    differ, spread = samples * (1 - similarity), math.sqrt(samples * similarity * (1 - similarity))
    mean = share(differ)
    return math.ceil(BITS * mean + sigmas * math.hypot(BITS * (share(differ + spread) - mean), math.sqrt(BITS * mean * (1 - mean))))


def components(edges: DataFrame, *, rounds: int = 40) -> DataFrame:
    """(id, component) for the ends of ``edges`` (a, b): the least id that can be reached.

    Each round every id takes the least label among its own and its neighbours', then its label's label, so that
    long chains shorten at least by half. Least labels are pre-aggregated, and hot ids split by the join."""
    both = settled(edges.select(F.col("a").alias("id"), F.col("b").alias("to")).unionAll(edges.select(F.col("b").alias("id"), F.col("a").alias("to"))).distinct())
    labels = settled(both.groupBy("id").agg(F.min("to").alias("least")).select("id", F.least("id", "least").alias("component")))
    for _ in range(rounds):
        near = split_join(both.withColumnRenamed("id", "_id").withColumnRenamed("to", "id"), labels, ["id"]).groupBy(F.col("_id").alias("id")).agg(F.min("component").alias("near"))
        moved = split_join(labels, near, ["id"], "left").select("id", "component", F.least("component", "near").alias("next"))
        jump = labels.select(F.col("id").alias("next"), F.col("component").alias("far"))
        labels = settled(split_join(moved, jump, ["next"], "left").select("id", F.least("next", "far").alias("component"), (F.least("next", "far") < F.col("component")).alias("changed")))
        again = labels.where("changed").limit(1).count()
        labels = labels.select("id", "component")
        if not again:
            return labels
    raise RuntimeError(f"components didn't settle in {rounds} rounds")


def _flipped(a: Column, b: Column) -> Column:
    """In how many bits two sketches differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)


def near_dedup(docs: DataFrame, *, words: int = 5, percent: int = 80, bands: int = 30, rows: int = 5) -> DataFrame:
    """doc_id, text_key, n_shingles, class_id, component_id, kept for every row.

    A text's set holds the hashes (64 bits) of its distinct shingles of ``words`` words, A-Z lower-cased; with fewer
    words, the whole sequence; without words it is empty and linked with nothing. Two texts are linked if
    100 * intersection >= percent * union, counted on the full sets. ``component_id`` is the least doc_id that links
    reach and ``kept`` marks the document with that id; ``class_id`` is the least doc_id with the same set.

    Equal sets are one class, compared once. Classes that share one of ``bands`` bands of ``rows`` MinHash samples are
    candidates: a pair at 0.8 is missed with a chance of (1 - 0.8 ** 5) ** 30, seven in a million. Within a bucket
    each class is first compared with the one that shares most buckets with others (as many pairs as rows, also for
    thousands of copies). Only
    classes in buckets that these links leave with different components are looked at again: those of different
    components that share one of their rarest shingles, which linked sets can't but do (see ``_across``), are compared
    too, if their odd sketches (parity bitmaps of the samples, taken in each of PARTS parts of a set) differ in few
    enough bits. So each candidate pair is either compared, excluded by its rarest shingles or its sketches, or already
    connected, and no bucket's pairs are gone through.

    Null text: empty. Rows with a null doc_id come out with null class and component, unlinked and kept. Rows that
    repeat a doc_id with its text share class and component, and are kept or dropped together; of different texts
    under one doc_id, links join that doc_id. Empty table: no rows. Other columns are not read.
    """
    base = documents(docs)
    found = settled(map_arrow(base, _signatures(words, bands, rows), "doc_id long, text_key long, n_shingles long, set_a long, set_b long, bands array<long>, sketch array<long>"))
    able = found.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    sets = settled(able.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n")))
    many = sets.where("n > 1").select("set_a", "set_b", "class_id")
    named = split_join(found.select("doc_id", "text_key", "n_shingles", "set_a", "set_b"), many, ["set_a", "set_b"], "left")
    own = F.when((F.col("n_shingles") > 0) & F.col("class_id").isNotNull() & F.col("doc_id").isNotNull(), F.col("class_id")).otherwise(F.col("doc_id"))
    # Wide rows stay where they are: those that aren't the first of their class are few, or are met by a join.
    again = settled(split_join(able.select("doc_id", "text_key", "set_a", "set_b"), many, ["set_a", "set_b"]).where("doc_id <> class_id").select(F.col("doc_id").alias("id"), "text_key"))
    wide = able.select(F.col("doc_id").alias("id"), "text_key", "n_shingles", "bands", "sketch")
    profile = _but(wide, again, ["id", "text_key"], "left_anti").drop("text_key")
    banded = profile.select("id", "n_shingles", F.posexplode("bands").alias("band", "bucket"))
    shared_by = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    crowded = split_join(banded, shared_by, ["bucket"])
    # The class that meets most others is the likeliest to be linked with all of a bucket: copies differ less from
    # what they were made of than from each other.
    met = settled(crowded.groupBy("id").agg(F.sum("n").alias("met")))
    crowded = settled(split_join(crowded.drop("n"), met, ["id"]))
    center = crowded.groupBy("bucket").agg(F.max(F.struct("met", (-F.col("id")).alias("least"), "n_shingles")).alias("top")).select("bucket", (-F.col("top.least")).alias("center"), F.col("top.n_shingles").alias("n_center"))
    low, high = F.least("n_shingles", "n_center"), F.greatest("n_shingles", "n_center")
    pairs = split_join(crowded.drop("met"), center, ["bucket"]).where((F.col("id") != F.col("center")) & (low * 100 >= high * percent))
    pairs = pairs.select(F.least("center", "id").alias("a"), F.greatest("center", "id").alias("b")).distinct()
    most = most_flipped(bands * rows * PARTS, percent / 100)
    links = _linked(base, profile, pairs, words, percent, most)
    labels = components(links)
    # Buckets that still hold several components: what the centers didn't connect.
    placed = split_join(crowded.drop("met"), labels, ["id"], "left").select("bucket", "band", "id", F.coalesce("component", "id").alias("component"))
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi AND n > 2").select("bucket")
    rest = split_join(placed, mixed, ["bucket"])
    crossing = settled(rest.groupBy("id").agg(F.min("component").alias("component")))
    if crossing.limit(1).count():
        starts = settled(split_join(_prefixes(_fetched(base, crossing.select("id"), words), percent), crossing, ["id"]))
        more = _linked(base, profile, _across(starts, percent), words, percent, most)
        labels = components(links.unionAll(more))
    out = split_join(named.withColumn("class_id", own), labels.withColumnRenamed("id", "class_id"), ["class_id"], "left")
    return out.select("doc_id", "text_key", "n_shingles", "class_id", F.coalesce("component", "class_id").alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(id, n, shingle, place, short): those of each set's rarest shingles, rarest first, that a linked set may begin with.

    Rarity is counted over these sets. Shingles of one set alone take the first places, but no rows, as nothing meets
    them. ``short`` marks the fewer places that do where the other set is at least as large."""
    sets = settled(sets.withColumn("_of", F.xxhash64("shingles")).dropDuplicates(["id", "_of"]))
    each = sets.select("id", "_of", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    shared = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    met = split_join(each, shared, ["shingle"]).groupBy("id", "_of", "n").agg(F.sort_array(F.collect_list(F.struct("held", "shingle"))).alias("_met"))
    placed = met.select("id", "n", F.size("_met").alias("_k"), F.posexplode("_met").alias("_i", "_s"))
    placed = placed.select("id", "n", F.col("_s.shingle").alias("shingle"), (F.col("n") - F.col("_k") + F.col("_i") + 1).alias("place"))
    last = lambda top, low: F.col("n") - F.ceil(F.col("n") * F.lit(top) / F.lit(low)) + 1
    return placed.where(F.col("place") <= last(percent, 100)).withColumn("short", F.col("place") <= last(2 * percent, 100 + percent))


def _across(starts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of ids in different components that may be linked, from their sets' first shingles.

    Linked sets x and y, x no larger, share at least percent * (x + y) / (100 + percent) shingles. So of the shingles in
    one order, the first they share is among the first of either (the ends in ``_prefixes``), and leaves enough after
    it in both. Any pair that fails this isn't linked. A shingle that many sets hold is among the first of few."""
    x, y = (starts.select("shingle", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "component", "n", "place", "short")]) for s in "xy")
    n_x, n_y = F.col("n_x"), F.col("n_y")
    sized = (n_x * 100 >= n_y * percent) & ((n_x < n_y) | (n_x == n_y) & (F.col("id_x") < F.col("id_y")))
    left = F.least(n_x - F.col("place_x"), n_y - F.col("place_y")) + 1
    met = split_join(x.where("short_x"), y, ["shingle"]).where((F.col("component_x") != F.col("component_y")) & sized & (left * (100 + percent) >= (n_x + n_y) * percent))
    return met.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct()


def _likely(n_a: Column, n_b: Column, percent: int, most: int) -> Column:
    """Whether sizes and sketches (sketch_a, sketch_b) leave it open that two sets are linked."""
    low, high = F.least(n_a, n_b), F.greatest(n_a, n_b)
    return (low * 100 >= high * percent) & ((high < SMALL) | (_flipped(F.col("sketch_a"), F.col("sketch_b")) <= most))


def _alike(a: str, b: str, percent: int) -> Column:
    """Whether two sets are linked: 100 * both >= percent * (a + b - both)."""
    both = F.size(F.array_intersect(a, b)).cast("long")
    return both * (100 + percent) >= (F.size(a) + F.size(b)) * percent


def _but(rows: DataFrame, ids: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A semi or anti join with settled ids: broadcast within the bound, else by a join that can be split."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids), keys, how) if few else split_join(rows, ids, keys, how)


def _fetched(base: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(id, shingles) of the given ids, from their whole texts."""
    texts = _but(base.select(F.col("doc_id").alias("id"), "text"), ids, ["id"], "left_semi")
    return map_arrow(texts, _sets(words), "id long, shingles array<long>")


def _linked(base: DataFrame, profile: DataFrame, pairs: DataFrame, words: int, percent: int, most: int) -> DataFrame:
    """Those of the pairs (a, b) of ids that are linked by their full sets."""
    pairs = settled(pairs)
    named = lambda: settled(pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct())
    known = _but(profile.drop("bands"), named(), ["id"], "left_semi")
    for side in "ab":
        of = known.select(F.col("id").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}"))
        pairs = split_join(pairs, of, [side])
    pairs = settled(pairs.where(_likely(F.col("n_a"), F.col("n_b"), percent, most)).select("a", "b"))
    sets = _fetched(base, named(), words)
    with_a = split_join(pairs, sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a")), ["a"])
    with_b = split_join(with_a, sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b")), ["b"])
    return settled(with_b.where(_alike("set_a", "set_b", percent)).select("a", "b").distinct())
