"""A corpus pipeline: quality rules, near-dedup, decontamination, redaction, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a DataFrame; all but
the last return the columns of their docs. Rows of documents with a null doc_id go in the first stage, as later stages
name documents by id. Texts of any length are read whole, columns beside doc_id, text and n_chars are passed through
whatever their names, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estuary.llm import decontaminate, packing, pii, quality, similar, simhash
from estuary.session import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the trees go, null and empty texts among them.

    Rows that repeat an id stay or go together: all go if one of them fails.
    """
    rejected = quality.judge(docs, table(spark, sf_dir, "labels")).where("not kept").select("doc_id").distinct()
    return docs.where("doc_id is not null").join(rejected, "doc_id", "left_anti").select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest id; of repeated rows with its id, one.

    Groups are those of op8_simhash_near_dedup, joined by links between texts whose five-word shingles have a
    similarity of 0.8, which is checked exactly. Null and empty texts form one group.
    """
    kept = simhash.near_duplicates(docs, similarity=similar.SIMILARITY).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat a benchmark item go, with all rows of their id. Null and empty texts repeat none."""
    leaked = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(leaked, "doc_id", "left_anti").select(docs.columns)


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced; n_chars follows. Null texts stay null, all rows stay."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of power-of-two lengths, one row each; a null or empty text is one piece, repeated rows one each."""
    return packing.packed_digest(packing.bucketed(docs))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("redaction", redaction),
    ("packing", pack),
]

#: Trained trees, fingerprints and token ids have no SQL; tests/llm hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
