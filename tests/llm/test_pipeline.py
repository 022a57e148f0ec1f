"""The pipeline against a plain version of its stages, on small tables."""

import hashlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from lumenframe.llm import rules
from tests.llm.helpers import DATA, words
from tests.llm.test_jaccard import brute as components
from tests.llm.test_lines import brute as deduped
from tests.llm.test_mixing import plain_targets


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "mix_sources", "bpe_tokens"]
    kept, results = docs, []
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, DATA).checkpoint()
        results.append(kept.collect())
    ids = [i for i, r in rows.items() if rules.first_reject(rules.Counts(r.text), list(rules.RULES)) is None]
    assert sorted(r.doc_id for r in results[0]) == sorted(ids) and len(ids) < len(rows)
    texts = {int(i): t for i, t in deduped([(i, rows[i].text) for i in ids])}
    assert {r.doc_id: r.text for r in results[1]} == texts and all(r.n_chars == len(r.text) for r in results[1])
    groups = [eval(x) for x in components(list(texts.items()))]  # noqa: S307  (id, shingles, component)
    assert sorted(r.doc_id for r in results[2]) == sorted(i for i, _, c in groups if c == i)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in results[2]:
        sizes[r.source] += len(words(r.text))
    for r in results[3]:
        taken[r.source] += len(words(r.text))
        assert set(words(r.text)) <= set(words(texts[r.doc_id]))
    for s, t in plain_targets(sizes).items():
        assert abs(taken[s] - t) <= 40
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((r.doc_id, hashlib.sha256(np.array(t.encode(r.text, add_special_tokens=False).ids, dtype="<u4").tobytes()).hexdigest()) for r in results[3])
    assert sorted((r.doc_id, hashlib.sha256(bytes(r.ids)).hexdigest()) for r in results[4]) == want
    whole = sorted((r.doc_id, r.decoded_sha256, r.n_tokens) for r in corpus_pipeline.run(spark, DATA).collect())
    assert whole == sorted((r.doc_id, r.decoded_sha256, r.n_tokens) for r in results[4])


def test_rows_of_one_doc_id_go_by_their_own_text(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, "en", "a", 0), (5, text, "en", "a", 0), (5, " ".join(f"v{i}" for i in range(40)), "en", "a", 0), (5, text + " more", "en", "a", 0), (None, text, None, None, None), (6, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicates(spark, docs, DATA)
    assert got.columns == corpus_pipeline.COLUMNS
    assert sorted((str(r.doc_id), (r.text or "")[:3]) for r in got.collect()) == [("1", "w0 "), ("5", "v0 "), ("6", ""), ("None", "w0 ")]
    rows = [(1, "shared line here", "en", "a", 0), (5, "x\nshared line here", "en", "a", 0), (5, "y\nonly in this row line", "en", "a", 0)]
    got = corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, docs.schema), DATA)
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [(1, "shared line here"), (5, "x"), (5, "y\nonly in this row line")]
