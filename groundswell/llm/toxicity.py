"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundswell.llm.common import lower_ascii, map_arrow, mix, prefix_bytes, settled, text_blocks, word_bounds, word_hashes

#: Bytes of a word's beginning that are features, beside the whole word: compounds share their first part.
PREFIXES = (4, 5, 6, 7, 8, 9, 10, 12)
#: A feature counts apart if it occurs at least so often in a text: insults come in numbers, like beginnings by chance.
OFTEN = (1, 2, 4)
#: Places of the bitmap that is looked at before the table of features.
_PLACES = 1 << 20
#: The classifier is fitted on at most this many confirmed toxic texts and unlabelled texts, drawn by a hash of doc_id.
POSITIVES, UNLABELLED = 3000, 9000
#: Standard errors by which a feature has to be more frequent in toxic texts.
LEAST_Z = 3.0
#: The least share of the unlabelled texts with a feature that the class prior and the toxic texts with it account for.
LEAST_PURITY = 0.5


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit feature, text) of the words of a block: each whole word and its beginnings. Words are runs of letters
    (A-Z as a-z) and of bytes beyond ASCII; two features meet with a chance of 2**-64, so none is taken for another."""
    data = lower_ascii(data)
    data = np.where(((data >= 97) & (data <= 122)) | (data >= 128), data, np.uint8(32))
    starts, ends, firsts = word_bounds(data, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))
    found, of = [word_hashes(data, starts, ends, salt=2)], [text]
    sizes = ends - starts
    for n in PREFIXES:
        long = np.flatnonzero(sizes >= n)
        low, high = prefix_bytes(data, starts[long], n)
        found.append(mix(mix(low + np.uint64(n)) + mix(high ^ np.uint64(n << 32))))
        of.append(text[long])
    return np.concatenate(found), np.concatenate(of)


def _times(feature: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each (feature, text) once and how often it occurs, in order of text."""
    order = np.lexsort((feature, text))
    feature, text = feature[order], text[order]
    first = np.flatnonzero(np.append(True, (feature[1:] != feature[:-1]) | (text[1:] != text[:-1]))[: len(feature)])
    return feature[first], text[first], np.diff(np.append(first, len(feature)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic and unlabelled texts of a block each feature occurs as often as each of OFTEN."""
    for batch in batches:
        positive = np.asarray(batch.column("positive").to_numpy(zero_copy_only=False), bool)
        for at, end, data, offsets in text_blocks(batch.column("text"), 1 << 21):
            feature, text, times = _times(*_features(data, offsets))
            of = positive[at:end][text]
            for least in OFTEN:
                ok = times >= least
                found, index = np.unique(feature[ok], return_inverse=True)
                p = np.bincount(index, of[ok], len(found)).astype(np.int32)
                n = np.bincount(index, minlength=len(found)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(np.full(len(found), least, np.int32)), pa.array(p), pa.array(n - p)], names=["feature", "times", "p", "u"])


def _places(chosen: np.ndarray):
    """positive, and which of the chosen features (by place) each text has, as packed int32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = _Lookup(chosen)
        for batch in batches:
            for at, end, data, offsets in text_blocks(batch.column("text"), 1 << 19):
                place, text = look.hits(*_features(data, offsets))
                cut = np.searchsorted(text, np.arange(end - at + 1))
                rows = [place[a:b].astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("positive").slice(at, end - at), pa.array(rows, pa.binary())], names=["positive", "places"])

    return run


class _Lookup:
    """Places of (feature, times) in the table ``chosen``; a bitmap turns most others away."""

    def __init__(self, chosen: np.ndarray) -> None:
        self.known, index = np.unique(chosen["feature"], return_inverse=True)
        self._place = {least: np.full(len(self.known), -1, np.int64) for least in OFTEN}
        for least in OFTEN:
            ok = np.flatnonzero(chosen["times"] == least)
            self._place[least][index[ok]] = ok
        self._maybe = np.zeros(_PLACES, bool)
        self._maybe[(self.known & np.uint64(_PLACES - 1)).astype(np.int64)] = True

    def hits(self, feature: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, text) of the chosen features that the texts have, in order of text."""
        near = np.flatnonzero(self._maybe[(feature & np.uint64(_PLACES - 1)).astype(np.int64)])
        feature, text = feature[near], text[near]
        if not len(feature):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.known, feature), len(self.known) - 1)
        ok = self.known[at] == feature
        both, times = np.unique(text[ok] * len(self.known) + at[ok], return_counts=True)
        at, text = both % len(self.known), both // len(self.known)
        place = np.stack([np.where(times >= least, self._place[least][at], -1) for least in OFTEN], 1).ravel()
        text = np.repeat(text, len(OFTEN))
        return place[place >= 0], text[place >= 0]


@dataclass(frozen=True)
class Model:
    """A linear classifier over the ``chosen`` (feature, times): whether a text has a feature so often."""

    chosen: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, column: pa.Array, look: _Lookup) -> np.ndarray:
        """The probability of toxicity of each text; a text without features gets the bias alone."""
        out = np.empty(len(column))
        for at, end, data, offsets in text_blocks(column, 1 << 19):
            place, text = look.hits(*_features(data, offsets))
            total = np.bincount(text, self.weights[place], end - at) + self.bias
            out[at:end] = 1 / (1 + np.exp(-np.clip(total, -500, 500)))
        return out


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], chosen: np.ndarray, prior: float, *, rounds: int = 300, rate: float = 0.05, decay: float = 1e-4) -> Model:
    """A logistic classifier of least non-negative positive-unlabelled risk, on presences of the ``chosen`` features.

    Each text comes as the places in ``chosen`` that it has. The risk is
    ``prior * E_p[l(+)] + max(0, E_u[l(-)] - prior * E_p[l(-)])`` with the logistic loss l: unlabelled texts stand for
    both classes, the toxic part among them is taken out with the class prior, and where the rest turns negative
    (over-fitting) its gradient is turned round. Without positives or unlabelled texts: the prior alone.
    """
    prior = min(max(prior, 1e-4), 1 - 1e-4)
    bias = float(np.log(prior / (1 - prior)))
    n_p, n_u = len(positive), len(unlabelled)
    if not n_p or not n_u:
        return Model(chosen[:0], np.zeros(0), bias)

    def matrix(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([*texts, np.zeros(0, np.int32)]).astype(np.int64), np.repeat(np.arange(len(texts)), [len(t) for t in texts])

    (cp, rp), (cu, ru) = matrix(positive), matrix(unlabelled)
    w, b = np.zeros(len(chosen)), bias
    first, second, steps = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1), 0
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500)))
    for _ in range(rounds):
        gp, gu = np.bincount(rp, w[cp], n_p) + b, np.bincount(ru, w[cu], n_u) + b
        rest = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        # derivatives of the losses with respect to the scores
        dp = prior * (sigmoid(gp) - 1) / n_p
        negative_p, negative_u = -prior * sigmoid(gp) / n_p, sigmoid(gu) / n_u
        if rest >= 0:
            dp, du = dp + negative_p, negative_u
        else:
            dp, du = -negative_p, -negative_u
        grad = np.append(np.bincount(cp, dp[rp], len(w)) + np.bincount(cu, du[ru], len(w)) + decay * w, dp.sum() + du.sum())
        steps += 1
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        move = rate * (first / (1 - 0.9**steps)) / (np.sqrt(second / (1 - 0.999**steps)) + 1e-8)
        w, b = w - move[:-1], b - float(move[-1])
    return Model(chosen, w, b)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of doc_id as text, modulo 4, is 2. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, *, positives: int = POSITIVES, unlabelled: int = UNLABELLED, keep: int = 4000) -> Model:
    """A model from ``labels`` (doc_id, toxic) and texts of ``docs``, on bounded samples drawn by a hash of doc_id.

    Positives are rows labelled 1 that aren't held out; the unlabelled sample is drawn from all documents that
    aren't held out, without a look at labels. Of rows that share a doc_id the least text counts, once: at most
    ``positives`` and ``unlabelled`` texts are read, however often ids repeat. Features are the ``keep`` whose presence
    in toxic texts exceeds that in unlabelled ones by most standard errors (over LEAST_Z), of those that are pure: by
    Bayes' rule, prior * p / u of the texts with the feature are toxic. They are counted where the texts lie; the driver
    gets those alone. The class prior is the share of 1 among the labels learnt from.
    """
    order = lambda c: F.md5(F.concat(F.lit("sample:"), F.col(c).cast("string")).cast("binary"))
    known = labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    share = known.agg(F.sum("toxic"), F.count(F.lit(1))).first()
    prior = (share[0] or 0) / share[1] if share[1] else 0.05
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    some = known.where("toxic = 1").select("doc_id").distinct().orderBy(order("doc_id")).limit(positives).withColumn("positive", F.lit(True))
    rest = texts.select("doc_id").distinct().orderBy(order("doc_id")).limit(unlabelled).withColumn("positive", F.lit(False))
    picked = settled(some.unionByName(rest))  # at most positives + unlabelled rows of a few bytes, so it may be broadcast
    ids = picked.groupBy("doc_id").agg(F.collect_list("positive").alias("as"))
    rows = settled(texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "as").agg(F.min("text").alias("text")).select(F.explode("as").alias("positive"), "text"))
    sizes = {r["positive"]: r["count"] for r in rows.groupBy("positive").count().collect()}
    n_p, n_u = (F.lit(float(max(1, sizes.get(side, 0)))) for side in (True, False))
    counts = map_arrow(rows, _counted, "feature long, times int, p int, u int").groupBy("feature", "times").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).where("p >= 3")
    p, u = F.col("p") / n_p, F.col("u") / n_u
    z = (p - u) / F.sqrt(p * (1 - p) / n_p + u * (1 - u) / n_u + 1 / (n_p * n_p) + 1 / (n_u * n_u))
    pure = F.lit(prior) * p / (u + 1 / n_u) >= LEAST_PURITY
    best = counts.where(pure).select("feature", "times", z.alias("z")).where(F.col("z") > LEAST_Z).orderBy(F.desc("z"), "feature", "times").limit(keep)
    chosen = np.array(sorted((r["feature"], r["times"]) for r in best.collect()), [("feature", np.int64), ("times", np.int32)])
    chosen = chosen.astype([("feature", np.uint64), ("times", np.int32)])
    found = map_arrow(rows, _places(chosen), "positive boolean, places binary").collect()
    split = {side: [np.frombuffer(r["places"], np.int32) for r in found if r["positive"] is side] for side in (True, False)}
    return fit_nnpu(split[True], split[False], chosen, prior)


def score(docs: DataFrame, model: Model, *, threshold: float = 0.3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of ``docs``, score (0 to 1, of the whole text alone) and predicted (1 from ``threshold``).

    Rows are scored where they are read: no shuffle. Null and empty texts get the score of no features. Repeated rows
    give repeated results; an empty table gives an empty one."""
    fields = ", ".join(f"`{docs.schema[c].name}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most ``keep`` features of fit_nnpu
    names = [*keep, "score", "predicted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        look = _Lookup(own.chosen)
        for batch in batches:
            found = own.scores(batch.column(batch.num_columns - 1), look)
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found), pa.array((found >= threshold).astype(np.int32))], names=names)

    return map_arrow(docs.select(*keep, docs["text"].alias("_text")), run, f"{fields}, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Train on ``labels`` and score every document; see :func:`train` and :func:`score`."""
    return score(docs, train(docs, labels), threshold=threshold, keep=keep)
