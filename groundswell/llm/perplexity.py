"""Quality by perplexity under an interpolated modified Kneser-Ney model of the bytes of trusted text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundswell.llm.common import map_arrow, settled, split_join, text_blocks, word_bounds

#: Rows of the model (24 bytes) in a shard: one shard at a time is sent to the workers that meet it with texts.
SHARD_ROWS = 4_000_000
#: Trusted documents' ids that may be broadcast.
BROADCAST_IDS = 1_000_000
#: Distinct grams that a worker counts before it hands them on.
REMEMBERED = 2_000_000
#: One in so many trusted documents is kept out of the model and gives the thresholds.
FOLDS = 10
#: Stands before each text: a white-space byte, which never occurs inside a cleaned text.
_BEGIN = 10
#: A key is a gram's bytes as an integer, and above them its length.
_TAG = 56


def _key(gram: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    return gram | (np.int64(size) << np.int64(_TAG) if isinstance(size, int) else size << np.int64(_TAG))


def _sequences(column: pa.Array, order: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, key of the longest gram of up to ``order`` bytes that ends at each byte, text of each byte, bytes of each text) of blocks.

    A text is its words, each followed by one space, after a mark that no gram reaches over."""
    for at, end, data, offsets in text_blocks(column, 1 << 21):
        starts, ends, firsts = word_bounds(data, offsets)
        sizes, words = ends - starts, np.diff(firsts)
        text = np.repeat(np.arange(end - at), words)
        begun = np.cumsum(words > 0)  # marks up to each text
        out_at = np.cumsum(sizes + 1) - (sizes + 1) + begun[text]
        n_bytes = np.bincount(text, sizes + 1, end - at).astype(np.int64)
        total = int(n_bytes.sum()) + int(begun[-1] if len(begun) else 0)
        line = np.full(total, 32, np.int64)
        of_byte = np.repeat(np.arange(len(starts)), sizes)
        within = np.arange(len(of_byte)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        line[out_at[of_byte] + within] = data[starts[of_byte] + within]
        full = np.flatnonzero(words)
        marks = (np.cumsum(n_bytes[full] + 1) - (n_bytes[full] + 1)).astype(np.int64)
        line[marks] = _BEGIN
        place = np.arange(total) - np.repeat(marks, n_bytes[full] + 1)
        gram = line.copy()
        for k in range(1, order):
            gram[k:] += np.where(place[k:] >= k, line[:-k] << np.int64(8 * k), 0)
        seen = place > 0
        yield at, end, _key(gram[seen], np.minimum(place[seen] + 1, order)), np.repeat(full, n_bytes[full]), n_bytes


def _counted(order: int):
    """(key, n) of the longest grams that end at each byte, counted until a worker holds too many."""

    def rows(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(keys), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(keys[lo : lo + (1 << 17)]), pa.array(counts[lo : lo + (1 << 17)])], names=["key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for _, _, key, _, _ in _sequences(batch.column("text"), order):
                found, n = np.unique(key, return_counts=True)
                merged, index = np.unique(np.concatenate([keys, found]), return_inverse=True)
                counts = np.bincount(index, np.concatenate([counts, n]), len(merged)).astype(np.int64)
                keys = merged
                if len(keys) > REMEMBERED:
                    yield from rows(keys, counts)
                    keys, counts = keys[:0], counts[:0]
        yield from rows(keys, counts)

    return run


def _discount(counted: DataFrame) -> Column:
    """What modified Kneser-Ney takes off a count ``n``: three discounts from the counts of counts."""
    of = {r["n"]: r["count"] for r in counted.where("n <= 4").groupBy("n").count().collect()}
    n1, n2, n3, n4 = (max(1, of.get(i, 0)) for i in range(1, 5))
    y = n1 / (n1 + 2 * n2)
    discounts = [min(max(i - (i + 1) * y * b / a, 0.05), i - 0.05) for i, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1)]
    return F.when(F.col("n") == 1, discounts[0]).when(F.col("n") == 2, discounts[1]).otherwise(discounts[2])


def _bytes(gram: Column | str, n: int) -> Column:
    """The last ``n`` bytes of a gram."""
    return (F.col(gram) if isinstance(gram, str) else gram).bitwiseAND(F.lit((1 << (8 * n)) - 1))


def _keyed(gram: Column, size: int) -> Column:
    return gram.bitwiseOR(F.lit(size << _TAG)).alias("key")


def model(texts: DataFrame, *, order: int = 6) -> DataFrame:
    """(key, p, gain, weight) of the grams of up to ``order`` bytes in ``texts`` (text), by sharded counts and joins.

    Interpolated modified Kneser-Ney over the uniform distribution of bytes: grams of the highest order and those
    at the start of a text have their counts, others the number of bytes they follow; each order has three discounts
    from its counts of counts. ``weight`` is the log of a context's back-off weight and ``gain`` the log of a gram's
    probability less that of its context's weight and that of the gram without its first byte. A gram that is known
    has known ends and contexts, so the log probability of a byte is that of the uniform distribution, and for each
    order the weight of its context and its gain, nothing where they are unknown. Sums over grams thus may be taken
    shard by shard, in any order.
    """
    raw = settled(map_arrow(texts.select("text"), _counted(order), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
    # The tables of grams are small beside the texts: few tasks, and each gram in one of them.
    parts = max(1, -(-raw.count() // 250_000))
    of = lambda k: raw.where(F.shiftright("key", _TAG) == k).select(_bytes("key", k).alias("gram"), "n")
    counts = {order: of(order)}
    for k in range(order - 1, 0, -1):
        after = counts[k + 1].groupBy(_bytes("gram", k).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        counts[k] = settled(of(k).unionByName(after).coalesce(parts))
    nothing = F.lit(None).cast("double")
    out, lower = None, None
    for k in range(1, order + 1):
        rows = counts[k].withColumn("cut", _discount(counts[k])).withColumn("context", F.shiftright("gram", 8) if k > 1 else F.lit(0).cast("long"))
        sums = settled(rows.groupBy("context").agg(F.sum("n").cast("double").alias("total"), F.sum("cut").alias("freed")).coalesce(parts))
        rows = split_join(rows, sums, ["context"])
        if lower is None:
            rows = rows.withColumn("below", F.lit(1 / 256))
        else:
            rows = split_join(rows.withColumn("suffix", _bytes("gram", k - 1)), lower, ["suffix"])
        p = (F.col("n") - F.col("cut") + F.col("freed") * F.col("below")) / F.col("total")
        rows = settled(rows.select("gram", p.alias("p"), (F.log(p) - F.log(F.col("freed") / F.col("total")) - F.log("below")).alias("gain")).coalesce(parts))
        weights = sums.select(_keyed(F.col("context"), k - 1), nothing.alias("p"), nothing.alias("gain"), F.log(F.col("freed") / F.col("total")).alias("weight"))
        part = rows.select(_keyed(F.col("gram"), k), "p", "gain", nothing.alias("weight")).unionByName(weights)
        out, lower = part if out is None else out.unionByName(part), rows.select(F.col("gram").alias("suffix"), F.col("p").alias("below"))
    return settled(out.groupBy("key").agg(*[F.max(c).alias(c) for c in ("p", "gain", "weight")]).coalesce(parts))


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The values of the wanted keys, 0 where there is none."""
    if not len(keys):
        return np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0.0)


def _log_p(key: np.ndarray, order: int, keys: np.ndarray, gain: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """What a shard of the model adds to the log probability of the last byte of each gram."""
    size, gram = key >> np.int64(_TAG), key & np.int64((1 << _TAG) - 1)
    out = np.zeros(len(key))
    for k in range(1, order + 1):
        has = np.flatnonzero(size >= k)
        own = gram[has] & np.int64((1 << (8 * k)) - 1)
        out[has] += _found(keys, gain, _key(own, k)) + _found(keys, weight, _key(own >> np.int64(8), k - 1))
    return out


def scores(docs: DataFrame, rows: DataFrame, order: int, *, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, lang, fold, n_bytes, log_p) of every row of ``docs`` (doc_id, lang, fold, text, text_key).

    The model is dealt into as many shards as keep each within ``shard_rows``; each shard is sent to the workers and
    met with all texts where they lie, and the sums that it adds to a text meet in a small row. Texts aren't moved."""
    shards = max(1, -(-rows.count() // shard_rows))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    fields = "doc_id long, lang string, fold int, text_key long"
    parts = None
    for shard in range(shards):
        t = dealt.where(F.col("shard") == shard).select("key", "gain", "weight").toArrow()
        keys = t["key"].to_numpy()
        by = np.argsort(keys, kind="stable")
        columns = [t[c].cast(pa.float64()).fill_null(0.0).to_numpy()[by] for c in ("gain", "weight")]
        shared = docs.sparkSession.sparkContext.broadcast((keys[by], *columns))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            table = shared.value
            for batch in batches:
                for at, end, key, text, n_bytes in _sequences(batch.column("text"), order):
                    found, index = np.unique(key, return_inverse=True)
                    sums = np.bincount(text, _log_p(found, order, *table)[index], end - at)
                    own = [batch.column(c).slice(at, end - at) for c in ("doc_id", "lang", "fold", "text_key")]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(n_bytes), pa.array(sums)], names=["doc_id", "lang", "fold", "text_key", "n_bytes", "log_p"])

        part = map_arrow(docs.select("doc_id", "lang", "fold", "text_key", "text"), run, f"{fields}, n_bytes long, log_p double")
        parts = part if parts is None else parts.unionAll(part)
    met = parts.groupBy("doc_id", "lang", "fold", "text_key", "n_bytes").agg(F.sum("log_p").alias("log_p"), (F.count(F.lit(1)) / shards).cast("int").alias("copies"))
    each = met.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return each.select("doc_id", "lang", "fold", "n_bytes", (F.col("log_p") / F.col("copies") - F.col("n_bytes") * F.lit(float(np.log(256)))).alias("log_p"))


def perplexity_filter(docs: DataFrame, trusted: DataFrame, *, order: int = 6, quantile: float = 0.99, slack: float = 1.1, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity, threshold, kept for every row.

    A model of runs of ``order`` bytes (7 at most), across words, is trained on the texts of the documents whose doc_id
    is in ``trusted`` (doc_id), but for one in FOLDS (by a hash of doc_id), which give the thresholds: a document's
    perplexity is that of a byte of its words and the spaces after them, over its whole text, and it is kept if it is
    at most ``slack`` times the ``quantile`` (to one part in 10,000) of its language's trusted documents that the model
    hasn't seen; of all such documents where the language has none, and of the trusted ones where there are none at all.

    Null or empty texts have no perplexity and aren't kept. Null languages are a language. Null doc_ids are never
    trusted; repeated rows are scored one by one and count one by one. No trusted text: a uniform model, all kept
    that have text. An empty table: no rows. Other columns are not read.
    """
    if not 2 <= order <= 7:
        raise ValueError("grams of 2 to 7 bytes fit a key")
    ids = trusted.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    ids = ids.withColumn("fold", F.when(F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)) == 0, 2).otherwise(1))
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    base = base.join(F.broadcast(ids), "doc_id", "left") if few else split_join(base, ids, ["doc_id"], "left")
    base = base.select("doc_id", "lang", F.coalesce("fold", F.lit(0)).cast("int").alias("fold"), "text", F.xxhash64("text").alias("text_key"))
    rows = model(base.where("fold = 1"), order=order)
    scored = settled(scores(base, rows, order, shard_rows=shard_rows).withColumn("perplexity", F.when(F.col("n_bytes") > 0, F.exp(-F.col("log_p") / F.col("n_bytes")))).drop("log_p"))
    limit = F.percentile_approx("perplexity", quantile, 10_000)
    whole = {r["fold"]: r["p"] for r in scored.where("fold > 0 AND perplexity IS NOT NULL").groupBy("fold").agg(limit.alias("p")).collect()}
    whole = whole.get(2, whole.get(1))
    limits = scored.where("fold = 2 AND perplexity IS NOT NULL").groupBy("lang").agg((F.lit(slack) * limit).alias("own"))
    limits = settled(limits.withColumn("_l", F.coalesce("lang", F.lit(""))).withColumn("_n", F.col("lang").isNull()).drop("lang"))
    out = scored.withColumn("_l", F.coalesce("lang", F.lit(""))).withColumn("_n", F.col("lang").isNull())
    out = out.join(F.broadcast(limits), ["_l", "_n"], "left") if limits.limit(100_001).count() <= 100_000 else split_join(out, limits, ["_l", "_n"], "left")
    threshold = F.coalesce("own", F.lit(float("inf") if whole is None else slack * whole))
    return out.select("doc_id", "lang", "n_bytes", "perplexity", threshold.alias("threshold"), F.coalesce(F.col("perplexity") <= threshold, F.lit(False)).alias("kept"))
