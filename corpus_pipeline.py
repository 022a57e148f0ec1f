"""A corpus pipeline of five stages over `documents`: quality rules, line dedup, near duplicates, mixing, BPE.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before it kept, and makes its decisions: rejected
documents go, dropped lines are gone from the text, one document of each group of near duplicates stays, the mix repeats
and cuts documents to its weights. All stages but the last return the columns of documents; n_chars follows the text.

In every stage other columns of its input go, null texts count as empty, empty tables give empty results with the same
columns, and rows that repeat are each judged; what nulls in other columns and ties mean is said by the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import bpe, jaccard, lines, mixing, rules
from lumenframe.llm.common import cut, text_job

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A public tokenizer, found where a task runs.
TOKENIZER = "byte_bpe_50k.json"


def _columns(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects; empty ones have too few words. Only the text counts; ids, languages and sources may be
    null or repeat."""
    text_job(spark)
    docs = docs.select(*COLUMNS)
    return rules.cascade(docs, rules.plan(docs)).filter("rejected_by IS NULL").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines whose key a document with a smaller doc_id holds. Rows that repeat a doc_id are one
    document there, but each loses lines of its own text only; rows without one stay whole. A document that loses all lines stays with an empty text; the mix then takes
    nothing of it."""
    return _columns(lines.dedup_lines(docs.select(*COLUMNS)).withColumn("text", F.col("kept")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document that gives its group the name stays; of rows that repeat its doc_id, all of its group stay. A row goes by
    its own text only, whatever other rows have its doc_id. Rows without a doc_id and empty texts, which link with nothing,
    stay."""
    groups = jaccard.near_duplicates(docs.select("doc_id", "text"), text_hash=True)
    gone = groups.filter("component_id < doc_id").select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).distinct()
    docs = docs.select(*COLUMNS)
    return docs.join(gone, (F.col("doc_id") == F.col("_doc")) & (jaccard.text_hash(F.col("text")) == F.col("_hash")), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each pass over a document and one for what the last pass takes of it; null is a source of its own. Order
    within a source is a seeded hash of the whole row, so ties are rows that are equal throughout."""
    return _columns(mixing.mixed_rows(docs.select(*COLUMNS)))


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each row of the mix, nulls in the other columns kept: doc_id, lang, source, n_tokens, ids (little-endian unsigned 32-bit integers), decoded_sha256 (of the ids read back)."""
    text_job(spark)
    done = bpe.encode(docs.select("doc_id", "lang", "source", "text"), TOKENIZER, decoded="decoded")
    return done.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("mix_sources", mix_sources), ("bpe_tokens", bpe_tokens)]

#: SQL expresses neither the near-duplicate components nor BPE; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = cut(docs) if k + 1 < len(STAGES) else docs  # each stage reads its input more than once
    return docs
