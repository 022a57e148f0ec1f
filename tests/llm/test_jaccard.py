import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from lumenframe.llm import jaccard
from lumenframe.llm.queries import op10_token_groups
from tests.llm.helpers import DATA, LOWER, odd_rows, words


def brute(docs):
    sets = []
    for i, t in docs:
        w = words((t or "").translate(LOWER))
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    holds = defaultdict(list)
    for a, (_, s) in enumerate(sets):
        both = Counter(b for h in s for b in holds[h])
        for b, n in both.items():
            if 100 * n >= 80 * (len(s) + len(sets[b][1]) - n):
                up[find(a)] = find(b)
        for h in s:
            holds[h].append(a)
    least = {}
    for a, (i, _) in enumerate(sets):
        r = find(a)
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return sorted(str((i, len(s), least.get(find(a)))) for a, (i, s) in enumerate(sets))


def found(df):
    return sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in df.collect())


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert found(op10_token_groups(spark, DATA)) == brute(docs)


def test_odd_rows(spark):
    df = odd_rows(spark)
    assert found(jaccard.near_duplicates(df)) == brute([(r.doc_id, r.text) for r in df.collect()])


@pytest.mark.parametrize("limit", [0, 200_000])
def test_families_passages_and_chains(spark, monkeypatch, limit):
    """Near copies of one text, a passage in unlike texts, chains of small edits; with and without broadcasts."""
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", limit)
    monkeypatch.setattr("lumenframe.llm.common.BROADCAST_ROWS", limit)
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    docs = []
    for _ in range(3):
        base = [word() for _ in range(r.randint(60, 200))]
        for _ in range(70):
            text = list(base)
            for _ in range(r.randint(0, 5)):
                text[r.randrange(len(text))] = word()
            docs.append(" ".join(text))
    passage = [word() for _ in range(60)]
    docs += [" ".join([word() for _ in range(r.randint(5, 90))] + passage) for _ in range(120)]
    chain = [word() for _ in range(120)]
    for i in range(12):
        chain = chain[:]
        chain[i * 9] = word()
        docs.append(" ".join(chain))
    docs += docs[:40] + [d.upper() for d in docs[:5]]
    r.shuffle(docs)
    rows = list(enumerate(docs))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert found(jaccard.near_duplicates(df)) == brute(rows)


def test_threshold_is_reached_exactly(spark):
    a = [f"w{i}" for i in range(13)]  # 9 shingles, all of which the other shares: 9 / 11 and 8 / 10
    rows = [(1, " ".join(a)), (2, " ".join(a + ["x", "y"])), (3, " ".join(a[:12])), (4, " ".join(a[:12] + ["z", "q"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(jaccard.near_duplicates(df)) == brute(rows)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 90), (90, 95), (7, 7)]
    got = {r.node: r.root for r in jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {100: 90, 95: 90}


@pytest.mark.parametrize("wide", [3, jaccard.WIDE])
def test_large_groups_that_share_a_passage_and_do_not_link(spark, wide):
    """Two families of near copies around one passage, outliers of both, and frequent tokens in blocks."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    passage, docs = [word() for _ in range(70)], []
    for n in (130, 150):
        base = passage + [word() for _ in range(n - 70)]
        for k in range(90):
            text = list(base)
            for _ in range(k // 16):
                text[r.randrange(len(text))] = word()
            docs.append(" ".join(text))
    docs += [" ".join(r.sample(passage, 20)) for _ in range(20)] + [" ".join(passage + [word()]) for _ in range(20)]
    rows = list(enumerate(docs))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert found(jaccard.near_duplicates(df, wide=wide)) == brute(rows)


def two_families(members, seed=3):
    """Two families around one common text; each member has three of ten short blocks, the first family's with an even sum of
    places, the second's with an odd one, so that families share at most two."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    common, blocks, docs = [word() for _ in range(312)], [[word() for _ in range(9)] for _ in range(10)], []
    for family in (0, 1):
        own = [word() for _ in range(28)]
        for _ in range(members):
            while sum(three := sorted(r.sample(range(10), 3))) % 2 != family:
                pass
            docs.append(" ".join(common + own + [w for k in three for w in blocks[k]]))
    return list(enumerate(docs))


def test_opened_pairs_grow_with_the_members(spark, monkeypatch):
    """Three times the members open about three times the pairs, not nine times."""
    plain, counts = jaccard.opened, []

    def counted(*args):
        out = plain(*args)
        counts.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "opened", counted)
    for n in (60, 180):
        rows = two_families(n)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        assert found(jaccard.near_duplicates(df)) == brute(rows)
    assert len(counts) == 2 and counts[1] <= 3.5 * counts[0] + 100, counts


@pytest.mark.parametrize("block", [3, 2_000])
def test_blocks_of_askers_and_members(spark, monkeypatch, block):
    """Who meets whom does not depend on the blocks; pairs are those that reach the bound."""
    monkeypatch.setattr(jaccard, "ASKERS", block)
    r = random.Random(4)
    side = lambda first: [(first + i, g, r.randint(20, 30), r.randint(10, 20), r.sample(range(40), r.randint(0, 12)) or None) for g in (1, 2) for i in range(g * 20, g * 20 + 15)]
    a, b = side(0), side(1000)
    got = jaccard._met(spark.createDataFrame(a, "a long, group long, na long, ia long, t array<long>"), spark.createDataFrame(b, "b long, group long, nb long, ib long, t array<long>"), 80)
    fits = lambda n, m, o: 100 * n >= 80 * m and 100 * m >= 80 * n and o * 180 >= 80 * (n + m)
    want = {(x[0], y[0], x[1]) for x in a for y in b if x[1] == y[1] and fits(x[2], y[2], min(x[3], y[3]) + len(set(x[4] or []) & set(y[4] or [])))}
    assert {tuple(p) for p in got.collect()} == want and want


def test_pairs_are_held_in_bounded_pieces():
    """A batch of 50,000 rows whose 25 tokens have 2,000 groups each has 50 million pairs; they come out piece by piece."""
    n = 50_000
    pdf = pd.DataFrame({"token": np.repeat(np.arange(25), 2000), "group": np.arange(n), "low": 40, "high": 40, "room": 40})
    rows, over = jaccard._wide(pdf, 2000)
    assert over is None and len(rows) == n
    sizes = [x.shape[1] for x, _ in zip(jaccard._pairs(rows, 80), range(200))]
    assert max(sizes) <= n and len(sizes) == 200
    assert len(jaccard._wide(pdf, 1999)[1]) == 25
