"""Repeated passages by level-wise doubling of word windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundswell.llm.common import documents, map_arrow, settled, split_join, text_blocks, window_hashes, word_bounds, word_hashes

_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def ladder(length: int, levels: int) -> tuple[int, ...]:
    """Window lengths, each half (rounded up) of the next, ending in ``length``."""
    out = [length]
    for _ in range(levels - 1):
        out.insert(0, -(-out[0] // 2))
    return tuple(out)


def _slide(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over x[i : i + width] for each i that has them, by doubling the width covered."""
    have = 1
    while have * 2 <= width:
        x = pick(x[: len(x) - have], x[have:])
        have *= 2
    return pick(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def _sampled(each: np.ndarray, left: np.ndarray, short: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash at each short window, least hash among those inside each window of ``length``, which short ones are such a least).

    ``left``: words from each word to its text's end. Every window of ``length`` holds a sampled short window, and
    equal windows hold it at the same place: sampling depends on the words alone, so no repeat is lost."""
    hashes = np.where(left[: max(0, len(each) - short + 1)] >= short, window_hashes(each, short), _NONE)
    wide = length - short + 1
    if len(hashes) < wide:
        return hashes, np.zeros(0, np.uint64), np.zeros(len(hashes), bool)
    least = _slide(hashes, wide, np.minimum)
    least = np.where(left[: len(least)] >= length, least, _NONE)
    around = np.concatenate([np.zeros(wide - 1, np.uint64), np.where(least == _NONE, np.uint64(0), least), np.zeros(wide - 1, np.uint64)])
    chosen = (_slide(around, wide, np.maximum) == hashes) & (hashes != _NONE) if len(hashes) else np.zeros(0, bool)
    return hashes, least, chosen


def _blocks(batch: pa.RecordBatch):
    """(first row, end row, bytes, offsets, word starts, word ends, first words, word hashes, words left in the text)."""
    for at, end, data, offsets in text_blocks(batch.column("text")):
        starts, ends, firsts = word_bounds(data, offsets)
        counts = np.diff(firsts)
        left = np.repeat(firsts[1:], counts) - np.arange(len(starts))
        yield at, end, data, offsets, starts, ends, firsts, word_hashes(data, starts, ends), left


def _lists(values: np.ndarray, firsts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(firsts.astype(np.int32)), pa.array(values.view(np.int64)))


def _per_text(where: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """For word places ``where`` (ascending), the index in it at which each text begins."""
    return np.searchsorted(where, firsts)


def _anchors(short: int, length: int, whole: bool):
    """Rows of sampled short windows: distinct hashes a text, those it samples twice; with ``whole`` also n_words and digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, offsets, starts, ends, firsts, each, left in _blocks(batch):
                hashes, least, chosen = _sampled(each, left, short, length)
                if not whole:  # a later level: only inside windows whose samples at the level before are repeated
                    chosen = _alive(batch, at, end, each, left, length, len(hashes), chosen, hashes, short)
                place = np.flatnonzero(chosen)
                value = hashes[place]
                text = np.searchsorted(firsts, place, "right") - 1
                order = np.lexsort((value, text))
                value, text = value[order], text[order]
                fresh = np.ones(len(value), bool)
                fresh[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
                second = ~fresh
                second[1:] &= fresh[:-1]
                rows = np.arange(end - at + 1)
                one = _lists(value[fresh], np.searchsorted(text[fresh], rows))
                two = _lists(value[second], np.searchsorted(text[second], rows))
                names = ["doc_id", "text_key", "check"] if whole else ["row"]
                columns = [batch.column(c).slice(at, end - at) for c in names]
                if whole:
                    raw = data.tobytes()
                    digests = [hashlib.sha256(b" ".join(raw[offsets[i] : offsets[i + 1]].split())).digest() for i in range(end - at)]
                    columns += [pa.array(np.diff(firsts), pa.int64()), pa.array(digests, pa.binary())]
                    names += ["n_words", "digest"]
                yield pa.RecordBatch.from_arrays([*columns, one, two], names=[*names, "anchors", "twice"])

    return run


def _known(batch: pa.RecordBatch, at: int, end: int) -> np.ndarray:
    """Sorted repeated hashes that came with rows at to end. They are repeated in the whole corpus, so one set serves a block."""
    lists = batch.column("repeated").slice(at, end - at)
    return np.unique(np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.int64).view(np.uint64))


def _member(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(x), bool)
    k = np.searchsorted(known, x)
    return known[np.minimum(k, len(known) - 1)] == x


def _alive(batch, at, end, each, left, length, n, chosen, hashes, short):
    before = int(batch.column("short")[0].as_py())
    _, least, _ = _sampled(each, left, before, length)
    ok = _member(least, _known(batch, at, end)) & (least != _NONE)
    _, mine, _ = _sampled(each, left, short, length)
    wide = length - short + 1
    mine = np.where(ok, mine, np.uint64(0))
    around = np.concatenate([np.zeros(wide - 1, np.uint64), np.where(mine == _NONE, np.uint64(0), mine), np.zeros(wide - 1, np.uint64)])
    return chosen & (_slide(around, wide, np.maximum) == hashes) if n else chosen


def _windows(short: int, length: int):
    """A row for each window of ``length`` whose sampled short window is repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, _, starts, ends, firsts, each, left in _blocks(batch):
                _, least, _ = _sampled(each, left, short, length)
                place = np.flatnonzero(_member(least, _known(batch, at, end)) & (least != _NONE))
                if not len(place):
                    continue
                text = np.searchsorted(firsts, place, "right") - 1
                take = pa.array(text + at)
                high = window_hashes(each, length)[place]
                other = word_hashes(data, starts, ends, salt=1)
                check = (window_hashes(other, length)[place] >> np.uint64(32)).astype(np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(high.view(np.int64)), pa.array(check.view(np.int32)), batch.column("row").take(take), batch.column("single").take(take), pa.array((place - firsts[text]).astype(np.int32))],
                    names=["h", "c", "row", "single", "place"],
                )

    return run


def _cut(length: int):
    """Removes the words that the listed windows cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                removed, digests = [], []
                for text, places in zip(part.column("text"), part.column("places"), strict=True):
                    found = text.as_py().encode().split()
                    edge = np.zeros(len(found) + 1, np.int64)
                    at = np.asarray(places.values.to_numpy(zero_copy_only=False))
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + length, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    removed.append(int(gone.sum()))
                    digests.append(hashlib.sha256(b" ".join([found[i] for i in np.flatnonzero(~gone)])).digest())
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(removed, pa.int64()), pa.array(digests, pa.binary())], names=["row", "n_removed", "kept_digest"])

    return run


def _of_row(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """Texts with the columns of their rows: equal doc_ids, null or not, and 96 bits of the text."""
    rows = rows.withColumnsRenamed({"doc_id": "_doc", "text_key": "_key", "check": "_check"})
    same = texts["doc_id"].eqNullSafe(rows["_doc"]) & (texts["text_key"] == rows["_key"]) & (texts["check"] == rows["_check"])
    return texts.join(rows, same).drop("_doc", "_key", "_check")


def substring_dedup(docs: DataFrame, *, length: int = 35, levels: int = 3) -> DataFrame:
    """doc_id, n_words, n_removed, copies, kept_sha256 (binary digest of the kept words joined by spaces) for every row.

    A word goes if a window of ``length`` words around it starts anywhere else too, in this text or another; windows
    are judged on the input. Level-wise doubling: at each length of :func:`ladder` only windows that hold repeats
    at the length before are looked at, and those found repeated are extended to twice the length, until none
    survives or ``length`` is reached. Below ``length``, only sampled windows are compared (the least hash among those
    inside each full window), which every repeat shares, so that with nine words at first a fourteenth of the places is shuffled. Windows are equal
    if 96 bits of hash agree.

    Rows with equal texts are compared once, by the first of them: all their windows are repeats. Hot windows are
    counted before they are shuffled and found again by a join that can be split. A text's places meet in one row,
    so memory grows with the longest text (some 100 bytes a byte of it).

    Rows are numbered once, so that hot shuffles carry one number a row; texts are found again by doc_id and 96 bits of
    the text, so that any number of texts may share a doc_id or have none.

    Null text: no words. Null doc_id: a row like any other. Repeated rows are copies of each other. Empty table: no
    rows. Other columns are not read.
    """
    if length < 2 or levels < 2:
        raise ValueError("doubling needs two lengths")
    lengths = ladder(length, levels)
    base = documents(docs).withColumn("check", F.crc32(F.encode("text", "UTF-8")))
    first = map_arrow(base, _anchors(lengths[0], length, True), "doc_id long, text_key long, check long, n_words long, digest binary, anchors array<long>, twice array<long>")
    stored = settled(first.withColumn("row", F.monotonically_increasing_id()))
    # Equal texts: 64 bits of the text and 256 of its words.
    classes = settled(stored.groupBy("text_key", "digest").agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("copies")).where("copies > 1"))
    rows = split_join(stored, classes, ["text_key", "digest"], "left").withColumn("single", F.col("copies").isNull())
    mine = rows.where(F.col("single") | (F.col("row") == F.col("rep"))).where(F.size("anchors") > 0)
    names = mine.select("row", "doc_id", "text_key", "check", "single")

    def repeated(anchors: DataFrame) -> DataFrame:
        """row, repeated and the row's names: each text's anchors that are sampled elsewhere too."""
        seen = anchors.select(F.explode("anchors").alias("g")).unionAll(anchors.select(F.explode("twice").alias("g")))
        often = seen.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("g")
        found = split_join(anchors.select("row", F.explode("anchors").alias("g")), often, ["g"])
        return found.groupBy("row").agg(F.collect_list("g").alias("repeated")).join(names, "row")

    alive = settled(repeated(mine))
    for short, wider in zip(lengths[:-1], lengths[1:-1], strict=False):
        texts = _of_row(base, alive.withColumn("short", F.lit(short)))
        found = map_arrow(texts.select("row", "text", "repeated", "short"), _anchors(wider, length, False), "row long, anchors array<long>, twice array<long>")
        alive = settled(repeated(found.where(F.size("anchors") > 0)))
    texts = _of_row(base, alive).select("row", "text", "single", "repeated")
    windows = map_arrow(texts, _windows(lengths[-2], length), "h long, c int, row long, single boolean, place int")
    often = windows.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "c")
    places = split_join(windows.where("single").select("h", "c", "row", "place"), often, ["h", "c"]).groupBy("row").agg(F.collect_list("place").alias("places"))
    cut = map_arrow(_of_row(base, places.join(names, "row")).select("row", "text", "places"), _cut(length), "row long, n_removed long, kept_digest binary")
    out = rows.select("row", "doc_id", "n_words", "digest", "copies").join(cut, "row", "left")
    gone = F.col("copies").isNotNull() & (F.col("n_words") >= length)
    return out.select(
        "doc_id",
        "n_words",
        F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("copies"),
        F.when(gone, F.lit(hashlib.sha256(b"").digest())).otherwise(F.coalesce("kept_digest", "digest")).alias("kept_sha256"),
    )
