"""Whitening against a dense eigenvalue routine, and the solver on its own."""

import math

import numpy as np
import pyarrow.parquet as pq
import pytest

from lumenframe.llm import davidson, queries, whitening
from tests.twins import DATA


def dense(rows, wanted=4):
    rows = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    longest = max((len(v) for _, v in rows), default=0)
    rows = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if len(v) == longest and longest]
    fit = sorted({tuple(v) for _, v in rows})
    n = len(fit)
    if n < 2:
        return n, {}, None
    sums = [sum(c) for c in zip(*fit)]
    x = np.array(fit, float) - np.array([s / n for s in sums])
    e, u = np.linalg.eigh(x.T @ x / n)
    e, u = e[::-1][:wanted], u[:, ::-1][:, :wanted]
    keep = e > 1e-10 * e[0]
    e, u = e[keep], u[:, keep]
    out = {}
    for i, v in rows:
        z = (np.array(v, float) - np.array([s / n for s in sums])) @ u / np.sqrt(e)
        out.setdefault(i, []).append((sum((n * a - s) ** 2 for a, s in zip(v, sums)), z))
    return n, out, e / np.trace(x.T @ x / n)


def check(got, rows, near=1e-9):
    n, want, share = dense(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r["vec_id"], []).append(r)
    assert set(by_id) == set(want)
    k = 0 if share is None else len(share)
    assert len(got) == k * sum(map(len, want.values()))
    sign = np.zeros(k)
    for i, own in by_id.items():
        for _, z in want[i]:
            for j in range(k):
                found = sorted((r for r in own if r["component"] == j + 1), key=lambda r: abs(abs(r["whitened"]) - abs(z[j])))
                r = found[0]
                assert (r["n"], r["deviation"]) == (n, want[i][0][0] if len(own) == k else r["deviation"])
                assert abs(r["explained"] / share[j] - 1) < 1e-9 and r["identity_error"] < 1e-9
                if len(own) == k and abs(z[j]) > 1e-3:
                    sign[j] = sign[j] or np.sign(r["whitened"] * z[j])
                    assert abs(r["whitened"] - sign[j] * z[j]) < near * max(1, abs(z[j]))


def test_whole_table(spark):
    table = pq.read_table(f"{DATA}/embeddings.parquet")
    rows = list(zip(table["vec_id"].to_pylist(), table["embedding"].to_pylist()))
    check(queries.QUERIES["op12_jacobi_davidson"](spark, DATA).collect(), rows)


@pytest.mark.parametrize("direct", [whitening.DIRECT_BYTES, 0])
def test_odd_rows(spark, monkeypatch, direct):
    monkeypatch.setattr(whitening, "DIRECT_BYTES", direct)
    rng = np.random.default_rng(3)
    rows = [(i, (rng.standard_normal(9) * np.array([9, 5, 4, 3, 1, 1, 1, 1, 1]) - 3).tolist()) for i in range(150)]
    rows += [(i + 1000, rows[0][1]) for i in range(300)] + [rows[1]]  # a hot vector, and a whole row twice
    odd = [(500, None), (501, [None] * 9), (502, [1.0] * 8 + [float("nan")]), (503, [1.0] * 8 + [float("inf")]), (504, [1.0] * 5), (505, []), (506, [-0.0] * 9)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows + odd], "vec_id long, embedding array<float>, component string, n int").repartition(5)
    cast = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows + odd]
    check(whitening.whiten(df).collect(), cast)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])], [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (None, [4.0, 0.0])]])
def test_small(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = whitening.whiten(df).collect()
    check(got, rows)
    assert len(got) == (3 if len(rows) == 3 else 0)


def test_beyond_longs(spark):
    df = spark.createDataFrame([(1, [1e9, 1.0]), (2, [-1e9, 2.0]), (3, [3e9, 5.0])], "vec_id long, embedding array<float>")
    got = whitening.whiten(df).collect()
    assert {r["vec_id"]: r["deviation"] for r in got} == {1: (3 * 256 - 8 * 256) ** 2, 2: None, 3: None}  # exact, or beyond a long


@pytest.mark.parametrize("values", [np.r_[1.0, 1 - 1e-6, 1 - 2e-6, 1 - 3e-6, 1 - 4e-6, np.linspace(0.99, 0, 115)], np.r_[[5.0] * 3, 4, np.linspace(2, 0, 60)], np.ones(12), np.r_[7.0, np.zeros(40)], np.arange(3.0), np.linspace(1, -3, 30)])
def test_solver(values):
    d = len(values)
    q = np.linalg.qr(np.random.default_rng(1).standard_normal((d, d)))[0]
    a = q @ np.diag(values) @ q.T
    e, x, r = davidson.leading(lambda b: a @ b, d, 4)
    k = min(4, d)
    assert np.allclose(e, np.sort(values)[::-1][:k], rtol=0, atol=1e-13 * max(1, abs(values).max()))
    assert np.allclose(x.T @ x, np.eye(k), atol=1e-13)
    assert np.linalg.norm(a @ x - x * e, axis=0).max() < 1e-12 * abs(values).max()


def test_minres():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((30, 30))
    a, rhs, shifts = a + a.T, rng.standard_normal((30, 3)), np.array([0.1, -2.0, 3.0])
    x = davidson.minres(lambda b: a @ b, rhs, lambda z: z, shifts, 60, 1e-12)
    assert np.allclose(a @ x - x * shifts, rhs, atol=1e-6)
