"""The corpus pipeline: documents in, packed token sequences out.

Five stages, each an operator of ``cardpulse.llm`` applied to everything that its predecessor kept. A stage takes (spark, docs, sf_dir)
and returns a DataFrame that is written as Parquet and read back as the next one's docs. All but the last return the columns of
``documents``; rows with a null id are documents like any other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardpulse.llm.contamination import contamination
from cardpulse.llm.neardup import near_duplicates
from cardpulse.llm.packing import pack
from cardpulse.llm.pii import find_pii, redacted
from cardpulse.llm.quality import fit_quality, quality_filter
from cardpulse.llm.registry import HIT_SHARE, PHRASE_WORDS, SEQUENCE_TOKENS, tokenizer_path
from cardpulse.llm.store import Workspace, bound_batches, durable, without

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near duplicates: five-word shingles, a similarity of 0.8 or more.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (a score of at least one half). It learns from at most quality.SAMPLE labelled rows. Null and
    empty texts have a score of their own and stay or go together; null and repeated ids and long texts make no difference to a row's
    verdict; without labels every document stays. An empty table stays empty."""
    bound_batches(spark)  # the caller runs the result
    documents, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    return quality_filter(docs.select(*COLUMNS), fit_quality(documents, labels))


def numbered(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with a ``uid`` of each row, checkpointed so that every reader sees the same: ids may be null or repeat."""
    return durable(spark, docs.select(*COLUMNS).withColumn("uid", F.monotonically_increasing_id()))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that with the smallest id (nulls last, then any one), of each class of near duplicates. Rows are judged one by one, also those
    that share an id or have none; rows without words are no duplicates and all stay. Long texts are compared whole. An empty table stays
    empty."""
    rows = numbered(spark, docs)
    classes = near_duplicates(rows, NEAR_WORDS, NEAR_PERCENT, id_col="uid").select(F.col("doc_id").alias("uid"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")
    best = classes.join(rows.select("uid", "doc_id"), "uid").groupBy("component_id").agg(F.min(order).alias("first")).select(F.col("first.uid").alias("uid"))
    return without(rows, classes.join(best, "uid", "left_anti"), "uid").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than a twentieth stand in windows of benchmark items. Rows are judged one by one, also those that share an
    id or have none; a row without words stays. Long texts are searched whole. An empty table stays empty, and without items all stay."""
    rows = numbered(spark, docs)
    found = contamination(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), PHRASE_WORDS, HIT_SHARE, slop=0, id_col="uid")
    return without(rows, found.where("contaminated").select(F.col("doc_id").alias("uid")), "uid").select(*COLUMNS)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by the name of its kind; n_chars follows. A null text becomes the empty text; ids and other
    columns stay as they are; long texts are read whole. An empty table stays empty."""
    clean = find_pii(docs, keep=("lang", "source")).withColumn("text", redacted("text", "found"))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their ids. A null or empty text is the end token alone; rows that share an id, or have none, are documents
    of their own; a long text is cut over sequences. An empty table gives no pieces."""
    return pack(docs, tokenizer_path(), SEQUENCE_TOKENS, ids_too=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("pii", pii),
    ("mixture_packing", packing),
]

#: A trained classifier, a similarity join and a tokenizer: not for SQL. Tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents`` of ``sf_dir``, each written and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Workspace(spark, "pipeline") as ws:
        for _, stage in STAGES[:-1]:
            before, docs = docs, ws.table(stage(spark, docs, sf_dir))
            ws.drop(before)
        return durable(spark, STAGES[-1][1](spark, docs, sf_dir))
