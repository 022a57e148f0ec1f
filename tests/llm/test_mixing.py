from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lumenframe.llm import mixing
from lumenframe.llm.queries import op3_mix_sources
from tests.llm.helpers import DATA, words


def plain_targets(sizes):
    """source -> words; shares by weight, what exceeds three times the size shared again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    out, open_, left = {}, set(order), float(sum(sizes.values()))
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] >= 3 * sizes[s]}
        if not full:
            return out | {s: share * weight[s] for s in open_}
        for s in full:
            out[s] = 3.0 * sizes[s]
            left -= 3.0 * sizes[s]
        open_ -= full
    return out


def check(rows, source_of, slack):
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        s = source_of[r.doc_id]
        sizes[s] += r["size"]
        taken[s] += r.taken
        target[s] = r.target
        assert 0 <= r.taken <= 3 * r["size"]
    want = plain_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= slack
    assert {r.source_size for r in rows} == set(sizes.values())


def test_query(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    rows = op3_mix_sources(spark, DATA).collect()
    assert {r.doc_id: r["size"] for r in rows} == {d.doc_id: len(words(d.text)) for d in docs}
    check(rows, {d.doc_id: d.source for d in docs}, 40)
    assert sorted(rows) == sorted(op3_mix_sources(spark, DATA).collect())


def test_small_and_hot_sources(spark):
    texts = {"a": 3, "b": 900, None: 40, "": 7, "Z": 1}
    docs = [(i, "w " * 10, s) for i, s in enumerate(s for s, n in texts.items() for _ in range(n))]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    check(mixing.mix(df).collect(), {i: s for i, _, s in docs}, 40)


@pytest.mark.parametrize("sizes", [{"a": 5000, "b": 3000, None: 170}, {"a": 7}, {"a": 100, "b": 100, "c": 100, "d": 100}, {f"s{i}": 10 + i * i for i in range(40)}])
def test_quotas_are_sainte_lague(spark, sizes):
    """For every number of first shards, the blocks are those of the highest quotients, ties to the first source."""
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    table = mixing.cut(mixing.targets(df))
    rows, shards = table.collect(), 7
    got = defaultdict(dict)
    for r in mixing.shard_quotas(table, shards, 16).collect():
        got[r.shard][r["rank"]] = r.blocks
    seats = int(sum(r.target for r in rows) / 16 + 0.5)
    bids = sorted(((r.target / (2 * k - 1), r["rank"]) for r in rows for k in range(1, seats + 2)), key=lambda x: (-x[0], x[1]))
    have = defaultdict(int)
    for j in range(1, shards + 1):
        want = defaultdict(int)
        for _, rank in bids[: seats * j // shards]:
            want[rank] += 1
        for r in rows:
            have[r["rank"]] += got[j][r["rank"]]
            assert have[r["rank"]] == want[r["rank"]] and got[j][r["rank"]] >= 0
    assert sum(have.values()) == seats


def test_rows_that_repeat_an_id_have_an_order(spark):
    """Unlike texts under one doc_id or none: other partitions and another order of rows take the same of each."""
    docs = [(None if i % 3 == 0 else i % 40, "w%d " % i * (i % 50 + 1), "ab"[i % 7 == 0]) for i in range(300)]
    kind = "doc_id long, text string, source string"

    def taken(rows, parts):
        df = spark.createDataFrame(rows, kind).withColumn("word", F.split("text", " ")[0]).repartition(parts)
        return sorted((r.word, r["size"], r.taken) for r in mixing.mix(df).collect())

    assert taken(docs, 2) == taken(docs[::-1], 5) == taken(sorted(docs, key=str), 3)


def test_mixed_rows_hold_what_mix_takes(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    taken = {r.doc_id: r.taken for r in mixing.mix(df).collect() if r.taken}
    got = defaultdict(int)
    for r in mixing.mixed_rows(df).collect():
        got[r.doc_id] += len(words(r.text))
    assert dict(got) == taken


def test_taken_words_by_a_plain_mix(spark):
    """Word by word: sources' words in the seeded order, blocks of 16, seats by the permutation, quotas by quotients."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "source", "text").checkpoint()
    place = {r.doc_id: r.p for r in docs.select("doc_id", F.xxhash64(F.lit(17), "doc_id", "source", "text").alias("p")).collect()}
    shift = {r.source: r.h for r in docs.select("source").distinct().select("source", F.xxhash64("source", F.lit(17)).alias("h")).collect()}
    rows = docs.collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += len(words(r.text))
    target = plain_targets(sizes)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    seats = int(sum(target.values()) / 16 + 0.5)
    quota = defaultdict(int)
    for _, k in sorted(((target[s] / (2 * k - 1), -i) for i, s in enumerate(order) for k in range(1, int(target[s] / 16) + 9)), reverse=True)[:seats]:
        quota[order[-k]] += 1
    taken = defaultdict(int)
    for s in order:
        blocks = max(1, -(-sizes[s] // 16))
        step = next(p for p in mixing.STEPS if blocks % p) % blocks
        passes = min(quota[s] * 16 // sizes[s], 3) if sizes[s] else 0
        rest = 0 if passes >= 3 else min(blocks, int((quota[s] * 16 - passes * sizes[s]) / 16 + 0.5))
        at = 0
        for r in sorted((r for r in rows if r.source == s), key=lambda r: (place[r.doc_id] % 64, place[r.doc_id])):
            for _ in words(r.text):
                taken[r.doc_id] += passes + ((at // 16 * step + shift[s]) % blocks < rest)
                at += 1
    assert {r.doc_id: r.taken for r in op3_mix_sources(spark, DATA).collect() if r.taken} == {i: n for i, n in taken.items() if n}
