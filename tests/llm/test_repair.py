"""Repair against all spans and all splits, against a reader from left to right in SQL, and odd rows."""

import hashlib
import itertools
import random
import zlib

import pytest

from lumenframe.llm import queries, repair
from tests.twins import DATA, database, same


def textbook(rows):
    """CYK over every span and split with the grammar R -> S P | P, P -> P P | U A; unit insertions; the least (cost, audit)."""
    n, chart = len(rows), {}
    least = lambda xs: min(xs, default=None)
    for span in range(n + 1):
        for i in range(n - span + 1):
            j = i + span
            part = lambda name, a, b: chart.get((name, a, b))
            split = lambda x, y: [(p[0] + q[0], p[1] + q[1]) for k in range(i, j + 1) if (p := part(x, i, k)) and (q := part(y, k, j))]  # noqa: E731, B023
            chart["D", i, j] = (0, "") if not span else (3 * span, "D" * span)
            for _ in range(6):  # until nothing gets less: a span may be made of itself and an empty one
                for name in "SUA":
                    found = split("D", name) + split(name, "D")
                    if span == 1:
                        letter, fault = rows[i]
                        late = int(fault == "truncated")
                        if fault in ("", "truncated"):
                            found += [(late, "K")] * (letter == name.lower()) + [(2 + late, "R")] * (name in "UA")
                    if not span and name in "UA":
                        found.append((2, "I"))
                    chart[name, i, j] = least([*found, *([chart[name, i, j]] if chart.get((name, i, j)) else [])])
                chart["P", i, j] = least([*split("U", "A"), *split("P", "P"), *([chart["P", i, j]] if chart.get(("P", i, j)) else [])])
                chart["R", i, j] = least([*split("S", "P"), *([chart["P", i, j]] if chart["P", i, j] else [])])
    whole = [chart["R", 0, n], chart["S", 0, n] and None, (3 * n, "D" * n)]
    return min(x for x in whole if x)


def plain(rows):
    """The least audit by trying every string of roles, for a few rows."""
    best = None
    for m in range(2 * len(rows) + 3):
        for head in ("", "s"):
            want = head + "ua" * m
            if len(want) > 2 * len(rows) + 2 or (head and not m):
                continue
            found = {(0, 0): (0, "")}
            for i, j in itertools.product(range(len(rows) + 1), range(len(want) + 1)):
                opts = [found[i, j]] if (i, j) in found else []
                if j and want[j - 1] != "s" and (i, j - 1) in found:
                    opts.append((found[i, j - 1][0] + 2, found[i, j - 1][1] + "I"))
                if i and (i - 1, j) in found:
                    opts.append((found[i - 1, j][0] + 3, found[i - 1, j][1] + "D"))
                if i and j and (i - 1, j - 1) in found and rows[i - 1][1] in ("", "truncated"):
                    c, a = found[i - 1, j - 1]
                    late = int(rows[i - 1][1] == "truncated")
                    opts += [(c + late, a + "K")] * (rows[i - 1][0] == want[j - 1]) + [(c + 2 + late, a + "R")] * (want[j - 1] != "s")
                if opts:
                    found[i, j] = min(opts)
            if (end := found.get((len(rows), len(want)))) and (best is None or end < best):
                best = end
    return best


def parsed(rows):
    whole = repair.chart([repair.Span.of(repair.symbol(*x)) for x in rows]) if rows else repair.Span(repair.EMPTY, [0] * 4, "", "")
    return min(whole.cell[s] for s in repair.FINAL if s in whole.cell)


def test_all_spans_and_splits():
    rng = random.Random(5)
    for n in [0, 1, 1, 1, 2, 2, 2, *range(3, 9)] * 8:
        rows = [(rng.choice("suaax"), rng.choice(["", "", "", "blank", "duplicate", "truncated"])) for _ in range(n)]
        assert parsed(rows) == plain(rows), rows
        if n < 7:
            assert parsed(rows) == textbook(rows), rows


def test_splits_agree():
    rng = random.Random(6)
    rows = [repair.Span.of(repair.symbol(rng.choice("suax"), rng.choice(repair.FAULTS))) for _ in range(41)]
    left = rows[0]
    for x in rows[1:]:
        left = left + x
    whole = repair.chart(rows)
    assert (left.cell, left.counts) == (whole.cell, whole.counts)
    assert repair.Span.loads(whole.dumps()).cell == whole.cell


def brute(rows):
    """The contract row by row, in Python."""
    key = lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else text.translate(dict.fromkeys(map(ord, ".!?"))) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    for conv, own in out.items():
        own.sort(key=key)
        seen, known = set(), []
        for _, role, text in own:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"
            seen.add((role, text))
            known.append((role[:1] if role[:1] in ("s", "u", "a") else "x", fault))
        cost, audit = parsed(known)
        said, i, stay = [], 0, sum(e != "D" for e in audit)
        for e in audit:
            to = "user" if (len(said) - stay % 2) % 2 == 0 else "assistant"
            if e == "I":
                said.append(f"{to}:")
                continue
            if e != "D":
                said.append(f"{to if e == 'R' else own[i][1]}:{own[i][2]}")
            i += 1
        turns = [t for t, _, _ in own if t is not None]
        faults = [f for _, f in known]
        illegal = sum(a[1][:1] + b[1][:1] not in repair.LEGAL for a, b in zip(own, own[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def odd(rng):
    roles, texts = ["user", "assistant", "system", None, "", "tool", "User"], ["Yes.", "No", "", None, " \n", "a\nb! ", "é…", "x" * 50_000 + "?", "Yes."]
    rows = [(rng.choice([1, 2, 3, None]), rng.choice([0, 1, 2, 3, 9, None]), rng.choice(roles), rng.choice(texts)) for _ in range(120)]
    rows += [(4, i, "user" if i % 2 == 0 else "assistant", f"t{i % 700}.") for i in range(1500)]  # a long one: several levels
    rows += [(c, t, "user", "Hello.") for c in range(10, 60) for t in (0, 1)]
    return rows + rows[:30]


@pytest.mark.parametrize("block", [256, 4])
def test_odd_rows(spark, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    rows = odd(random.Random(7))
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "conv_id long, turn long, role string, text string, pos string, cost int").repartition(3)
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.report(queries.damaged(df), df).collect()}
    assert got == brute(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.report(df).collect() == []


def test_extreme_turns(spark):
    df = spark.createDataFrame([(1, -(2**63), "user", "a."), (1, 2**63 - 1, "assistant", "b.")], "conv_id long, turn long, role string, text string")
    row = repair.report(df).first()
    assert (row["gaps"], row["audit"]) == (None, "KK")


def test_edits(spark):
    from lumenframe.llm.common import Stage

    df = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "There."), (1, 2, "assistant", " ")], "conv_id long, turn long, role string, text string")
    stage = Stage(spark)
    try:
        found, edits = repair.repair(df, stage)
        assert found.first()["audit"] == "KRD"
        assert sorted((r["pos"], r["out"], r["role"]) for r in edits.filter("out IS NOT NULL").collect()) == [(0, 0, "user"), (1, 1, "assistant")]
    finally:
        stage.drop()


def test_query_equals_sql(spark):
    assert same(queries.QUERIES["op11_interval_repair"](spark, DATA), queries.ORACLES["op11_interval_repair"], database()) > 0
