"""Conversation repair by weighted CYK interval parsing.

A conversation in order is (s?(ua)+)? by its roles' first letters: one system row at most, then user and assistant in turn.
Rows may be kept (0), given the role user or assistant (2), deleted (3) or inserted without text (2); a truncated row that
stays costs 1 more; blank rows and duplicates must go. The cheapest edits win, and of those the least by letters.

The grammar, in Chomsky normal form, has a nonterminal T[p,q] for what takes the reader from state p to state q (start, after
a system, a user, an assistant row): T[p,q] -> T[p,r] T[r,q] for every r, and T[p,q] -> row for each edit of a row. A cell is
a span of rows; it holds for each T[p,q] the least (cost, audit), audit being the edits' initials. Insertions are unit
derivations of the empty span, so each row's cell is closed under them on both sides. Two audits of one span and cost never
begin one another (an audit tells its cost), so the least of a whole is made of the least of its parts; and as there is a
rule for every r, a span's cell is the same whatever its split. The chart therefore holds spans of 1, 2, 4, ... rows only,
combined bottom-up by length: n - 1 combinations for n rows in place of n^3 / 6. The tests hold it against all spans and
splits.

Spark deals spans out, not conversations: rows are put in order by a range sort over all of them (a conversation may span
many partitions), BLOCK rows make a string of symbols, equal strings are parsed once in a batch, and BLOCK spans make the
next level's. Only the digest of a repaired conversation, which hashes its text in order, needs one task, which streams.

Null roles and texts count as one space (so blank or unknown); rows go by turn, nulls first, ties by role and text, rows that
repeat stay as often as they are; a null conv_id is a conversation of its own. Empty tables give empty results. Other
columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stage, cut, partitions

BLOCK = 256
KEEP, REROLE, DELETE, INSERT = ("K", 0), ("R", 2), ("D", 3), ("I", 2)
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
#: Where a row of that role may stand: role's letter -> (state before, state after).
STEPS = {"s": [(START, SYSTEM)], "u": [(START, USER), (SYSTEM, USER), (ASSISTANT, USER)], "a": [(USER, ASSISTANT)], "x": []}
FINAL = [(START, START), (START, ASSISTANT)]
FAULTS = ("", "blank", "duplicate", "truncated")
LEGAL = {"su", "ua", "au"}
Cell = dict[tuple[int, int], tuple[int, str]]


def _least(found: Iterator[tuple[tuple[int, int], tuple[int, str]]]) -> Cell:
    out: Cell = {}
    for span, value in found:
        if span not in out or value < out[span]:
            out[span] = value
    return out


def combine(a: Cell, b: Cell) -> Cell:
    """T[p,q] -> T[p,r] T[r,q]."""
    return _least(((p, q), (c + d, x + y)) for (p, r), (c, x) in a.items() for (r2, q), (d, y) in b.items() if r == r2)


def _insertions() -> Cell:
    """The cell of an empty span: nothing, or rows without text."""
    one = _least([*(((p, p), (0, "")) for p in STATES), *((s, (INSERT[1], INSERT[0])) for role in "ua" for s in STEPS[role])])
    while (more := combine(one, one)) != one:
        one = more
    return one


EMPTY = _insertions()


def symbol(initial: str, fault: str) -> str:
    """One letter for all that the parser knows of a row."""
    return chr(ord("A") + 4 * "suax".index(initial) + FAULTS.index(fault))


@lru_cache(maxsize=None)
def leaf(row: str) -> Cell:
    """The cell of one row, insertions around it included."""
    initial, fault = "suax"[(ord(row) - 65) // 4], FAULTS[(ord(row) - 65) % 4]
    found = [((p, p), (DELETE[1], DELETE[0])) for p in STATES]
    if fault in ("", "truncated"):
        more = int(fault == "truncated")
        found += [(s, (KEEP[1] + more, KEEP[0])) for s in STEPS[initial]]
        found += [(s, (REROLE[1] + more, REROLE[0])) for role in "ua" for s in STEPS[role]]
    return combine(combine(EMPTY, _least(found)), EMPTY)


class Span:
    """A run of rows: its cell, its faults, its ends."""

    def __init__(self, cell: Cell, counts: list[int], first: str, last: str):
        self.cell, self.counts, self.first, self.last = cell, counts, first, last  # counts: blank, duplicate, truncated, illegal

    @classmethod
    def of(cls, row: str) -> Span:
        initial, fault = "suax"[(ord(row) - 65) // 4], (ord(row) - 65) % 4
        return cls(leaf(row), [*(int(fault == i) for i in (1, 2, 3)), 0], initial, initial)

    def __add__(self, other: Span) -> Span:
        counts = [x + y for x, y in zip(self.counts, other.counts)]
        counts[3] += self.last + other.first not in LEGAL
        return Span(combine(self.cell, other.cell), counts, self.first, other.last)

    def dumps(self) -> str:
        return json.dumps([[[*k, *v] for k, v in self.cell.items()], self.counts, self.first, self.last])

    @classmethod
    def loads(cls, text: str) -> Span:
        cell, *rest = json.loads(text)
        return cls({(p, q): (c, x) for p, q, c, x in cell}, *rest)


def chart(spans: list[Span]) -> Span:
    """Neighbours two by two, level by level of length."""
    while len(spans) > 1:
        spans = [spans[i] + spans[i + 1] if i + 1 < len(spans) else spans[i] for i in range(0, len(spans), 2)]
    return spans[0]


def _parsed(rows: pd.Series) -> pd.Series:
    done = {x: chart([Span.of(c) for c in x]).dumps() for x in rows.unique()}
    return rows.map(done)


def _joined(spans: pd.Series) -> pd.Series:
    return spans.map(lambda own: chart([Span.loads(x) for x in own]).dumps())


def _verdict(spans: pd.Series) -> pd.DataFrame:
    out = []
    for x in map(Span.loads, spans):
        out.append((*min(x.cell[s] for s in FINAL if s in x.cell), *x.counts))
    return pd.DataFrame(out, columns=["cost", "audit", "blank", "duplicate", "truncated", "illegal"])


def _join(a: DataFrame, b: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """On conv_id, null being a value, and keys without nulls."""
    b = b.withColumnsRenamed({k: f"_{k}" for k in ("conv_id", *keys)})
    on = F.col("conv_id").eqNullSafe(F.col("_conv_id"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"_{k}"))
    return a.join(b, on, how).drop("_conv_id", *(f"_{k}" for k in keys))


def _ordered(rows: DataFrame, stage: Stage) -> tuple[DataFrame, DataFrame]:
    """(id, role, text) of all rows, and (id, conv_id, pos, row) with the place in the conversation and the symbol."""
    n = partitions(rows.sparkSession)
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    rows = rows.repartitionByRange(n, "conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv_id", "turn", "role", "text")
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*$", 1)  # empty if blank
    flag = F.when(last == "", 1).when(last.isin(".", "!", "?"), 0).otherwise(3)
    seen = [F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(1), "text", "role").alias("h2")]
    stored = stage.put(rows.select(F.monotonically_increasing_id().alias("id"), "conv_id", "role", "text", flag.alias("flag"), *seen), "rows")
    keys = stored.select("id", "conv_id", F.shiftright("id", 33).alias("part"), F.substring("role", 1, 1).alias("initial"), "flag", "h1", "h2")
    # a piece is what one partition holds of a conversation; pieces follow each other by partition
    pieces = keys.groupBy("conv_id", "part").agg(F.min("id").alias("low"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.withColumn("shift", before - F.col("low")).select("conv_id", "part", "shift")
    placed = _join(keys, pieces, "part").select("id", "conv_id", (F.col("id") + F.col("shift")).alias("pos"), "initial", "flag", "h1", "h2")
    twice = placed.groupBy("conv_id", "h1", "h2").agg(F.min("pos").alias("earliest"), F.count("*").alias("times")).filter("times > 1").drop("times")
    placed = _join(placed, twice, "h1", "h2", how="left").select("id", "conv_id", "pos", "initial", "flag", "earliest")
    fault = F.when(F.col("flag") == 1, 1).when(F.col("earliest") < F.col("pos"), 2).otherwise(F.col("flag"))
    kind = F.coalesce(F.nullif(F.instr(F.lit("sua"), F.col("initial")), F.lit(0)), F.lit(4))
    kind = F.when(F.col("initial") == "", 4).otherwise(kind)
    placed = placed.select("id", "conv_id", "pos", F.char(F.lit(65) + 4 * (kind - 1) + fault).alias("row"))
    return stored.select("id", "role", "text"), stage.put(placed, "placed")


def _parse(placed: DataFrame) -> DataFrame:
    """conv_id, cost, audit, blank, duplicate, truncated, illegal."""
    parsed, joined = F.pandas_udf(_parsed, "string"), F.pandas_udf(_joined, "string")
    verdict = F.pandas_udf(_verdict, "cost long, audit string, blank long, duplicate long, truncated long, illegal long")
    most = placed.agg(F.max("pos")).first()[0] or 0
    at, own = F.expr(f"pos div {BLOCK}"), F.sort_array(F.collect_list(F.struct("pos", "row")))
    spans = placed.groupBy("conv_id", at.alias("block")).agg(F.array_join(F.transform(own, lambda x: x["row"]), "").alias("rows"))
    spans = spans.select("conv_id", "block", parsed("rows").alias("span"))
    while most >= BLOCK:
        most //= BLOCK
        own = F.sort_array(F.collect_list(F.struct("block", "span")))
        spans = spans.groupBy("conv_id", F.expr(f"block div {BLOCK}").alias("block")).agg(F.transform(own, lambda x: x["span"]).alias("spans"))
        spans = spans.select("conv_id", "block", joined("spans").alias("span"))
    return spans.select("conv_id", verdict("span").alias("v")).select("conv_id", "v.*")


def _letters(batches: Iterator[pa.RecordBatch], most: int = 100_000) -> Iterator[pa.RecordBatch]:
    """A row for each edit: pos of its row (null: inserted), out (its place in the repaired conversation, null: deleted),
    action, and the role by its place."""
    for batch in batches:
        convs = batch.column(0)
        for i, audit in enumerate(batch.column(1).to_pylist()):
            a = np.frombuffer(audit.encode(), dtype="S1")
            stays, own = a != b"D", a != b"I"
            pos, out = np.cumsum(own) - 1, np.cumsum(stays) - 1
            odd = int(stays.sum()) % 2  # a system row stands first
            for at in range(0, len(a), most):
                part = slice(at, at + most)
                role = np.where(out[part] < odd, "system", np.where((out[part] - odd) % 2 == 0, "user", "assistant"))
                cols = [convs.take(pa.array(np.full(len(role), i))), pa.array(pos[part], mask=~own[part]), pa.array(out[part], mask=~stays[part]), pa.array(a[part].astype("U1")), pa.array(role)]
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(cols, (convs.type, pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["conv_id", "pos", "out", "action", "said"])


def repair(rows: DataFrame, stage: Stage) -> tuple[DataFrame, DataFrame]:
    """Of rows (conv_id, turn, role, text): conversations (conv_id, cost, audit, blank, duplicate, truncated, illegal) and
    their edits (conv_id, pos, out, action, role, text): deleted rows have no out, inserted ones no pos. Both lie in the
    caller's stage."""
    stored, placed = _ordered(rows, stage)
    found = stage.put(_parse(placed), "found")
    kind = dict(rows.dtypes)["conv_id"]
    edits = found.select("conv_id", "audit").mapInArrow(_letters, f"conv_id {kind}, pos long, out long, action string, said string")
    own = edits.filter("action <> 'I'")
    own = _join(own, placed.drop("row"), "pos").select("conv_id", "pos", "out", "action", "said", "id").join(stored, "id")
    own = own.withColumn("role", F.when(F.col("action") == "R", F.col("said")).otherwise(F.col("role"))).select("conv_id", "pos", "out", "action", "role", "text")
    new = edits.filter("action = 'I'").select("conv_id", "pos", "out", "action", F.col("said").alias("role"), F.lit("").alias("text"))
    return found, own.union(new)


def digests(edits: DataFrame) -> DataFrame:
    """conv_id, sha256 of the `role:text` of its rows in order, joined by newlines. One task reads a conversation, row by row."""
    said = edits.filter("out IS NOT NULL").select("conv_id", "out", F.concat("role", F.lit(":"), "text").alias("said"))
    said = said.repartition(partitions(edits.sparkSession), "conv_id").sortWithinPartitions("conv_id", "out").select("conv_id", "said")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, now = None, None
        schema = None
        for batch in batches:
            schema, ids, shas = batch.schema, [], []
            for conv, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if state is None or conv != now:
                    if state is not None:
                        ids.append(now)
                        shas.append(state.hexdigest())
                    state, now = hashlib.sha256(text.encode()), conv
                else:
                    state.update(b"\n" + text.encode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, schema.field(0).type), pa.array(shas, pa.string())], names=["conv_id", "sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], schema.field(0).type), pa.array([state.hexdigest()], pa.string())], names=["conv_id", "sha256"])

    return said.mapInArrow(run, f"conv_id {dict(edits.dtypes)['conv_id']}, sha256 string")


def report(rows: DataFrame, convs: DataFrame | None = None) -> DataFrame:
    """A row for each conversation of convs (conv_id; those of rows by default): its gaps, faults, cost, audit and the digest
    of its repaired text; zeros and the empty text's for one without rows. A gap beyond a long is null."""
    stage = Stage(rows.sparkSession)
    try:
        found, edits = repair(rows, stage)
        turns = rows.groupBy("conv_id").agg(F.max("turn").alias("high"), F.min("turn").alias("low"), F.count_distinct("turn").alias("n"))
        wide = F.col("high").cast("decimal(20,0)") - F.col("low").cast("decimal(20,0)") + 1 - F.col("n")
        turns = turns.select("conv_id", F.coalesce(wide, F.lit(0)).try_cast("long").alias("gaps"))
        sha = digests(edits)
        all_ = (rows if convs is None else convs).select("conv_id").distinct()
        for part in (turns, found, sha):
            all_ = _join(all_, part, how="left")
        zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
        gaps = F.when(F.col("cost").isNull(), F.lit(0).cast("long")).otherwise(F.col("gaps")).alias("gaps")
        out = all_.select("conv_id", gaps, *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
        return cut(out)
    finally:
        stage.drop()
