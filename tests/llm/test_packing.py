"""Packing: every token of every document once, in gapless sequences, few of them; the search against what it promises."""

import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from lumenframe.llm import packing, queries
from lumenframe.llm.common import Stage
from tests.llm.helpers import odd_rows
from tests.twins import DATA

NAME = "byte_bpe_50k.json"


def wanted(rows):
    """The pieces of (doc_id, text) by the library."""
    t = Tokenizer.from_file(path(NAME))
    t.no_truncation()
    t.no_padding()
    out = []
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        out += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    return out


def check(got, rows, slack):
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == Counter(wanted(rows))
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r["length"] for r in got)
    assert len(sequences) <= -(-total // 1024) + slack
    return len(sequences)


def test_whole_table(spark):
    table = pq.read_table(f"{DATA}/documents.parquet")
    check(queries.QUERIES["op13_swap_packing"](spark, DATA).collect(), list(zip(table["doc_id"].to_pylist(), table["text"].to_pylist())), 3)


def test_odd_rows(spark):
    df = odd_rows(spark)
    got = packing.pack_documents(df.repartition(3), NAME).collect()
    check(got, [(r["doc_id"], r["text"]) for r in df.collect()], 2)


def test_empty(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), NAME).collect() == []


def test_exact_lengths(spark):
    """Documents of just 1023, 1024, 1025 and 2048 tokens with their end id."""
    rows = [(i, " the" * n) for i, n in enumerate([1022, 1023, 1024, 2047, 2048])]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), NAME).collect()
    check(got, rows, 1)
    assert sorted((r["doc_id"], r["piece"], r["length"]) for r in got) == [(0, 0, 1023), (1, 0, 1024), (2, 0, 1), (2, 1, 1024), (3, 0, 1024), (3, 1, 1024), (4, 0, 1), (4, 1, 1024), (4, 2, 1024)]


@pytest.mark.parametrize("group", [40, 7, 10_000])
def test_many_groups(spark, group):
    """Groups much smaller than the table, and a third of all pieces of one length."""
    rng = random.Random(group)
    lengths = [rng.randint(1, 1024) for _ in range(300)] + [300] * 150
    stage = Stage(spark)
    try:
        items = spark.createDataFrame(list(enumerate(lengths)), "pid long, length long")
        got = packing.place(items, stage, group=group).collect()
    finally:
        stage.drop()
    assert sorted(r["pid"] for r in got) == list(range(450))
    fill = Counter()
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill[r["sequence_id"]]
        fill[r["sequence_id"]] += lengths[r["pid"]]
    assert max(fill.values()) <= 1024
    assert len(fill) <= len(packing.best_fit(lengths, 1024)) * (1.1 if group < 100 else 1)


def squares(lengths, bins):
    return sum(sum(lengths[i] for i in b) ** 2 for b in bins)


def better(lengths, bins, capacity):
    """Whether any move, one for one, two for one or one for two raises the sum of squares; by trying all."""
    under = [b for b in bins if sum(lengths[i] for i in b) < capacity]
    for a, b in itertools.permutations(under, 2):
        fa, fb = (sum(lengths[i] for i in x) for x in (a, b))
        for give, take in ((0, 1), (1, 1), (1, 2), (2, 1)):
            for out in itertools.combinations(a, give):
                for back in itertools.combinations(b, take):
                    gain = sum(lengths[i] for i in back) - sum(lengths[i] for i in out)
                    if max(fa + gain, fb - gain) <= capacity and (fa + gain) ** 2 + (fb - gain) ** 2 > fa**2 + fb**2:
                        return True
    return False


def test_search_ends_where_no_exchange_helps():
    rng = random.Random(8)
    for capacity, n, top in [(20, 12, 12), (30, 14, 20), (50, 16, 20), (24, 10, 24), (40, 30, 6)] * 12:
        lengths = [rng.randint(1, top) for _ in range(n)]
        start = [[i] for i in range(n)] if rng.random() < 0.5 else packing.best_fit(lengths, capacity)
        bins = packing.pack(lengths, capacity, start)
        assert sorted(i for b in bins for i in b) == list(range(n))
        assert all(sum(lengths[i] for i in b) <= capacity for b in bins)
        assert squares(lengths, bins) >= squares(lengths, start) and len(bins) <= len(start)
        assert not better(lengths, bins, capacity)


def test_best_fit_and_gain():
    assert [len(b) for b in packing.best_fit([6, 4, 5, 5], 10)] == [2, 2]
    lengths = random.Random(9).choices(range(250, 600), k=2000)
    first = packing.best_fit(lengths, 1024)
    assert len(packing.pack(lengths, 1024)) < 0.98 * len(first)  # swaps empty sequences that best fit leaves
