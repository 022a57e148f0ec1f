import os
import random
import string

import pytest
from pyspark.sql import functions as F

from lumenframe.llm import lines
from lumenframe.llm.queries import ORACLES, op6_line_runs
from tests.llm.helpers import DATA, LOWER, odd_rows
from tests.twins import database, same


def brute(docs):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    owner = {}
    for i, t in docs:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= 10:
                owner[key(x)] = min(i, owner.get(key(x), i))
    return sorted((str(i), "\n".join(x for x in (t or "").split("\n") if i is None or owner.get(key(x), i) >= i)) for i, t in docs)


@pytest.mark.parametrize(("batches", "fanout"), [(1, 4), (5, 2), (7, 3)])
def test_against_brute_force(spark, batches, fanout):
    r = random.Random(batches)
    pool = ["".join(r.choice(string.ascii_letters + "É ") for _ in range(r.randint(7, 14))) for _ in range(60)]
    docs = [(i * 3 - 50, "\n".join(r.choice([x, x.upper(), f" {x}\t"]) for x in r.choices(pool, k=r.randint(0, 6)))) for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = lines.dedup_lines(df, batches=batches, fanout=fanout)
    assert sorted((str(x.doc_id), x.kept) for x in got.collect()) == brute(docs)


def test_odd_rows(spark):
    df = odd_rows(spark)
    got = lines.dedup_lines(df, batches=3).collect()
    assert sorted((str(x.doc_id), x.kept) for x in got) == brute([(x.doc_id, x.text) for x in df.collect()])
    assert all(x.n_lines == (x.text or "").count("\n") + 1 for x in got)


def test_runs_are_levelled(spark, tmp_path):
    runs = lines.LineRuns(spark, str(tmp_path), fanout=2)
    for i in range(5):
        keys = spark.range(i, i + 3).select(F.col("id").alias("h1"), F.col("id").alias("h2"), F.lit(i).cast("long").alias("first"), F.lit(i).cast("long").alias("last"))
        runs.add(keys).collect()
        runs.compact()
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    whole = [r.h1 for level in runs.levels for t in level for r in spark.table(t).filter("new").collect()]
    assert sorted(whole) == list(range(7))
    runs.drop()


def test_query(spark):
    assert same(op6_line_runs(spark, DATA), ORACLES["op6_line_runs"], database()) > 100


def test_unlike_texts_of_one_doc_id(spark):
    """A line that only one of a doc_id's rows has stays, at whatever place it stands."""
    docs = [(1, "shared line here\nalso in one"), (5, "x\nshared line here"), (5, "y\nonly in this row line"), (5, "x\nshared line here"), (7, "only in this row line\nz")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((r.doc_id, r.kept, r.n_dropped) for r in lines.dedup_lines(df).collect())
    assert got == [(1, "shared line here\nalso in one", 0), (5, "x", 1), (5, "x", 1), (5, "y\nonly in this row line", 0), (7, "z", 1)]


def test_nothing_outside_the_shared_folder(spark, monkeypatch):
    """While the runs stand, they lie below the checkpoint folder, none in the warehouse; afterwards they are gone."""
    warehouse, shared = (spark.conf.get(k).removeprefix("file:") for k in ("spark.sql.warehouse.dir", "spark.checkpoint.dir"))
    holds = lambda top: [d for d, _, _ in os.walk(top) if "lumenframe_lines" in d]
    seen, plain = [], lines.LineRuns.compact

    def compact(self):
        seen.append((len(holds(warehouse)), len(holds(shared))))
        plain(self)

    monkeypatch.setattr(lines.LineRuns, "compact", compact)
    lines.dedup_lines(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")).count()
    assert seen and all(w == 0 and s > 0 for w, s in seen)
    assert not holds(warehouse) and not holds(shared)
