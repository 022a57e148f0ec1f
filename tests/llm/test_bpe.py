import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lumenframe.llm import bpe
from lumenframe.llm.queries import op9_bpe_tree
from tests.llm.helpers import DATA, TEXTS, odd_rows

PATH = public_tokenizers.path("byte_bpe_50k.json")
RUNS = ["a" * 3000, "the" * 900, "xyzzy" * 500, " " * 2000, "\n\n  " * 400, "it's we'll " * 150, "?'s!'ll" * 200, "1234567890" * 150, "日本語テキスト" * 150, "é" * 900, "😀👍🏽" * 200, "=-" * 900 + "z" * 20, "<|endoftext|>" * 20 + "x" * 300]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def tree(t, text, leaf):
    out = []
    for s in t.segments(text):
        out += [t.special[s]] if s in t.special else t.concatenate(t.encode_all(bpe.halves(s, leaf))).tolist()
    return out


@pytest.mark.parametrize("leaf", [3, 17, 200])
def test_joins_equal_the_library(library, leaf):
    t, r = bpe.Bpe(PATH), random.Random(leaf)
    mixed = ["".join(r.choice("abc  '’\n\t\r1.?é日 slred") for _ in range(r.randint(1, 300))) for _ in range(300)]
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(r.randint(1, 700))) for _ in range(60)]
    for text in [*RUNS, *mixed, *words, *(x for x in TEXTS if x)]:
        text = text[: 4000 if leaf > 3 else 800]
        ids = tree(t, text, leaf)
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert t.decode(np.array(ids, dtype="<u4")) == library.decode(ids, skip_special_tokens=False)


def test_leaves_are_joined_in_spark(spark, library):
    df = odd_rows(spark)
    got = bpe.decode(bpe.encode(df.select("doc_id", "source", "text"), PATH, long_chars=300, leaf_chars=100), PATH).collect()
    want = sorted((str(r.doc_id), hashlib.sha256(np.array(library.encode(r.text or "", add_special_tokens=False).ids, dtype="<u4").tobytes()).hexdigest()) for r in df.collect())
    assert sorted((str(r.doc_id), hashlib.sha256(bytes(r.ids)).hexdigest()) for r in got) == want
    once = bpe.encode(df.select("doc_id", "source", "text"), PATH, long_chars=300, leaf_chars=100, decoded="decoded").select(*[c for c in ("doc_id", "source", "ids", "decoded")])
    assert sorted(map(str, once.collect())) == sorted(str(r) for r in bpe.decode(once.drop("decoded"), PATH).collect())


def test_query(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in op9_bpe_tree(spark, DATA).collect():
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_other_vocabularies_are_refused(tmp_path):
    with pytest.raises(ValueError):
        bpe.Bpe("word_bpe_49k.json")


def test_copies_of_long_rows_stay_copies(spark):
    text = "copy and copy again, " * 300
    rows = [(1, text)] * 40 + [(2, text), (2, text + "x"), (None, text)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = bpe.encode(df, "byte_bpe_50k.json", long_chars=1000, leaf_chars=400, decoded="back").collect()
    assert sorted((str(r.doc_id), r.back) for r in got) == sorted((str(i), t) for i, t in rows)
    assert len({bytes(r.ids) for r in got}) == 2
