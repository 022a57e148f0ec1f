"""Every operator on odd rows, on an empty table, and on repeated rows."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumenframe.llm import bpe, chat, classifier, html, jaccard, lines, mixing, ogg, rules
from tests.llm.helpers import odd_rows

PATH = public_tokenizers.path("byte_bpe_50k.json")
MODEL = classifier.train(["good text here", "bad %%% ###"], [1, 0], epochs=1)
OPERATORS = {
    "html": lambda d: html.extract(d, "text"),
    "ogg": lambda d: ogg.unpack(ogg.pack(d)),
    "mixing": mixing.mix,
    "classifier": lambda d: classifier.score(d, MODEL),
    "lines": lines.dedup_lines,
    "rules": lambda d: rules.cascade(d, rules.plan(d), counts=True),
    "bpe": lambda d: bpe.decode(bpe.encode(d, PATH, long_chars=500, leaf_chars=200), PATH),
    "jaccard": jaccard.near_duplicates,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows_stay_one_each(spark, name):
    df = odd_rows(spark)
    assert len(OPERATORS[name](df).collect()) == df.count()


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, name):
    assert OPERATORS[name](odd_rows(spark).limit(0)).collect() == []


def test_chat_edges(spark):
    d = odd_rows(spark).select(F.col("doc_id").alias("conv_id"), F.lit(None).cast("long").alias("turn"), F.col("source").alias("role"), chat.text_part(F.col("text")).alias("content"))
    assert chat.format_chats(d).count() == d.select("conv_id").distinct().count()
    assert chat.format_chats(d.limit(0)).collect() == []
    assert chat.format_chats(d.withColumn("content", F.lit(None).cast(f"array<{chat.PART}>"))).filter("attachment_tokens <> 0").count() == 0


def test_pipeline_edges(spark):
    docs = odd_rows(spark)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        docs = docs.checkpoint()
        if name != "bpe_tokens":
            assert docs.columns == corpus_pipeline.COLUMNS
    docs = odd_rows(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "").checkpoint()
    assert docs.collect() == []
