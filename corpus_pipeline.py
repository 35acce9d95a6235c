"""A training corpus from raw documents: five stages, each on all that the one before kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundswell.llm.bpe import encode_documents
from groundswell.llm.common import checkpoint_dir, read, settled, split_join
from groundswell.llm.exact_dedup import exact_dedup
from groundswell.llm.mixing import mix_sources
from groundswell.llm.near_dedup import near_dedup
from groundswell.llm.queries import vocabulary
from groundswell.llm.toxicity import score, train

#: The columns of documents, which every stage but the last returns.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Decisions that may be sent to where the texts lie instead of texts to them: 16 bytes each.
BROADCAST_ROWS = 1_000_000


def _text_key() -> F.Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _keyed(docs: DataFrame) -> DataFrame:
    """Null doc_ids and repeated ones are told apart by a hash of the text; see the stages for what becomes of them."""
    return docs.withColumn("_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).withColumn("_key", _text_key())


def _few(rows: DataFrame) -> bool:
    return rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows (_id, _key) of ``gone``."""
    rows = _keyed(docs)
    left = rows.join(F.broadcast(gone), ["_id", "_key"], "left_anti") if _few(gone) else split_join(rows, gone, ["_id", "_key"], "left_anti")
    return left.select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier doesn't predict toxic. Rows without text stay."""
    docs = docs.select(*COLUMNS)
    model = train(docs, read(spark, sf_dir, "labels"))
    return score(docs, model, keep=COLUMNS).where("predicted = 0").select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id. Of rows that agree in doc_id (or have none) and text, one stays:
    the one with the least other columns."""
    docs = docs.select(*COLUMNS)
    found = exact_dedup(docs, carry={"text_key": _text_key()}).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("_id"), F.col("text_key").alias("_key"), "kept")
    seen = found.groupBy("_id", "_key").agg(F.bool_or("kept").alias("kept"), F.count(F.lit(1)).alias("n")).where("NOT kept OR n > 1")
    seen = settled(seen)
    left = _without(docs, seen.select("_id", "_key"))
    again = _keyed(docs).join(F.broadcast(seen.where("kept")), ["_id", "_key"]) if _few(seen) else split_join(_keyed(docs), seen.where("kept"), ["_id", "_key"])
    rest = [F.col(c) for c in ("lang", "source", "n_chars")]
    one = again.groupBy("_id", "_key", "doc_id", "text").agg(F.min(F.struct(*rest)).alias("rest"))
    return left.unionByName(one.select("doc_id", "text", "rest.*"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at 0.8, the one with the least doc_id; null doc_ids stay."""
    docs = docs.select(*COLUMNS)
    found = near_dedup(docs)
    gone = found.where("NOT kept").select(F.col("doc_id").cast("string").alias("_id"), F.col("text_key").alias("_key"))
    return _without(docs, gone.distinct())


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: up to three times, or not at all."""
    rows = _keyed(docs.select(*COLUMNS))
    named = rows.select("doc_id", "text", "source", F.col("_id").alias("row_id"), F.col("_key").alias("row_key"))
    taken = mix_sources(named, carry=("row_id", "row_key")).select(F.col("row_id").alias("_id"), F.col("row_key").alias("_key"), "copies").where("copies > 0")
    taken = taken.groupBy("_id", "_key").agg(F.max("copies").alias("copies"))
    out = split_join(rows, taken, ["_id", "_key"])
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of whole texts, and digests of the ids and of the text decoded from them."""
    return encode_documents(docs.select(*COLUMNS), vocabulary(), keep=("doc_id", "lang", "source"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix),
    ("tokens", tokenize),
]

#: Stages that learn, sample by hash or encode tokens aren't expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def _removed(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared checkpoint folder and read again by the next.

    What a stage read is removed once its result is written; the last stage's input stays, as its result is made lazily."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}")
        if k:
            _removed(spark, f"{folder}/{k - 1}")
    return docs
