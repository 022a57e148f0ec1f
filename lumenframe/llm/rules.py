"""Quality rules as a short-circuit cascade.

Each rule rejects a document by counts of its text. `plan` measures every rule's cost and rejections on a sample of at
most about `SAMPLE_ROWS` documents and orders the rules by rejections per second, so that cheap rules which reject much
run first; `cascade` then stops at a document's first rejection. The order never changes a verdict, only the work.

Counts are over the whole text. Words are runs of anything but the six ASCII white space characters. Null or empty texts
have no words and are rejected by too_few_words. Capitals are more than half of a text's letters, of any script. Empty
tables give empty results. Repeated rows are judged each by itself; other columns pass through, but for the names that a
function adds. Which rule is named in rejected_by follows the order, and so the measured costs; whether one is does not.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, WORD, slim

SAMPLE_ROWS = 500
WINDOW = 5
_WORD = re.compile(WORD)
_ASCII = re.compile(r"[\x00-\x7f]+")
_SPACES, _SYMBOLS = SPACES.encode(), b"#*$%&|<>"
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))


class Counts:
    """Counts of one text, each made when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def raw(self) -> bytes:
        return self.text.encode("utf-8", "surrogatepass")

    def of(self, chars: bytes) -> int:
        return len(self.raw) - len(self.raw.translate(None, chars))

    @cached_property
    def words(self) -> list[str]:
        return _WORD.findall(self.text)

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - self.of(_SPACES)

    @cached_property
    def n_symbols(self) -> int:
        return self.of(_SYMBOLS)

    @cached_property
    def letters(self) -> tuple[int, int]:
        """Upper-case letters and all letters, of any script."""
        upper = self.of(_UPPER)
        n = upper + self.of(_LOWER)
        if not self.text.isascii():
            for c, k in Counter(_ASCII.sub("", self.text)).items():
                upper, n = upper + k * (c.isupper() and c.isalpha()), n + k * c.isalpha()
        return upper, n

    @cached_property
    def n_lines(self) -> int:
        return len(self._lines)

    @cached_property
    def _lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(SPACES)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self._lines) - len(set(self._lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words covered by windows of WINDOW words that occur twice or more."""
        if self.n_words <= WINDOW:
            return 0
        seen: dict[str, int] = {}
        ids = np.array([seen.setdefault(w, len(seen)) for w in self.words], dtype=np.int64)
        n, base, code = len(ids) - WINDOW + 1, len(seen) + 1, ids
        code, top = ids[:n], base
        for k in range(1, WINDOW):
            if top > (1 << 62) // base:  # number the pairs anew before they could overflow
                code = np.unique(code, return_inverse=True)[1]
                top = int(code.max()) + 1
            code, top = code * base + ids[k : n + k], top * base
        order = np.argsort(code, kind="stable")
        same = code[order][1:] == code[order][:-1]
        if not same.any():
            return 0
        hit = np.zeros(n, dtype=bool)
        hit[order[1:][same]] = hit[order[:-1][same]] = True
        edge = np.zeros(len(ids) + 1, dtype=np.int64)
        np.add.at(edge, np.flatnonzero(hit), 1)
        np.add.at(edge, np.flatnonzero(hit) + WINDOW, -1)
        return int((np.cumsum(edge)[:-1] > 0).sum())


#: Rules by name: true means that the document goes. The first two are the base rules. repeated_lines rejects above one
#: half: of the labelled documents that it would reject from three tenths on and no other rule does, 41 of 45 are good
#: ones (three short lines of which two are equal).
BASE = ("too_few_words", "repeated_windows")
RULES: dict[str, Callable[[Counts], bool]] = {
    "too_few_words": lambda c: c.n_words < 10,
    "repeated_windows": lambda c: 100 * c.n_repeat_words > 20 * c.n_words,
    "symbols": lambda c: 10 * c.n_symbols > c.n_words,
    "capitals": lambda c: 2 * c.letters[0] > c.letters[1],
    "repeated_lines": lambda c: 2 * c.n_dup_lines > c.n_lines,
    "word_length": lambda c: not 2 * c.n_words <= c.word_chars <= 15 * c.n_words,
}


def plan(df: DataFrame, text: str = "text", rules: dict[str, Callable[[Counts], bool]] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """The rules' names by rejections per second on a sample. Each rule is timed alone, on fresh counts."""
    n = df.count()
    if not n:
        return list(rules)
    some = df.select(F.col(text).cast("string").alias("text")).sample(min(1.0, sample_rows / n), seed=5).limit(2 * sample_rows)

    @slim
    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name, rule in rules.items():
                began, gone = time.perf_counter(), 0
                for t in pdf["text"]:
                    gone += bool(rule(Counts(t)))
                out.append((name, time.perf_counter() - began, gone))
            yield pd.DataFrame(out, columns=["rule", "seconds", "gone"])

    rows = some.mapInPandas(measure, "rule string, seconds double, gone long").groupBy("rule").agg((F.sum("gone") / F.sum("seconds")).alias("gain")).collect()
    gain = {r["rule"]: r["gain"] or 0.0 for r in rows}
    return sorted(rules, key=lambda name: -gain.get(name, 0.0))


def first_reject(counts: Counts, order: list[str], rules: dict[str, Callable[[Counts], bool]] = RULES) -> str | None:
    return next((name for name in order if rules[name](counts)), None)


def cascade(df: DataFrame, order: list[str], text: str = "text", counts: bool = False) -> DataFrame:
    """df with rejected_by (the first rule in the order that rejects; null: kept). With counts, also the counts and
    base_failed, for every row."""
    added = [T.StructField("rejected_by", T.StringType())]
    if counts:
        added += [T.StructField(x, T.LongType()) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [T.StructField("base_failed", T.BooleanType())]
    names = [x.name for x in added]
    keep = df.drop(*names)

    @slim
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for t in pdf[text]:
                c = Counts(t)
                row = [first_reject(c, order)]
                if counts:
                    row += [c.n_words, c.word_chars, c.n_symbols, c.n_dup_lines, c.n_repeat_words, any(RULES[x](c) for x in BASE)]
                out.append(row)
            yield pd.concat([pdf, pd.DataFrame(out, columns=names, index=pdf.index)], axis=1)

    return keep.mapInPandas(run, T.StructType([*keep.schema.fields, *added]))
