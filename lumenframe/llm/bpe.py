"""BPE encoding and decoding by tree concatenation.

Texts above `long_chars` are cut in halves, and the halves again, down to leaves of at most `leaf_chars`; Spark deals the
leaves out over all tasks and encodes them side by side. `join` then concatenates neighbours bottom-up: it encodes a
window around the join anew and doubles it until both sides agree exactly.

Why that is exact. (1) Where white space follows something else, the pre-tokenizer's pattern always splits, whatever
stands around; so a window between two such places can be exchanged for its own encoding. (2) Inside a run of letters, of
digits or of signs there are no such places; but a sequence of tokens is the encoding of its text if every two neighbours
are that of theirs, so a window of the run whose first and last token are the old ones fits. Failing both, the window
grows until it is the whole of both sides. Special tokens in a text are split off first, as the tokenizer does.

Null or empty texts have no tokens. Long rows that repeat are counted first, task by task, and encoded once; they come back
as often as they were. Empty tables give empty results. Other columns pass through, but for the name ids and names of the
leaves' columns (_text, _segment, _leaf, _piece, _ids, _copies); they must be groupable (no maps).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import partitions, slices, slim

LONG_CHARS, LEAF_CHARS, WINDOW = 16384, 8192, 16
#: Fixed value: the pattern of byte-level pre-tokenizers.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same without its look-ahead, which is most of its cost; it matters only where white space follows white space.
QUICK = PATTERN.replace(r"\s+(?!\S)|", "")
#: Fixed value: what \s means in these patterns.
_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_GAP = regex.compile(f"[{_WHITE}]{{2}}")
#: The last white space before something else, after other white space: here the pattern always splits.
_LAST = regex.compile(f"(?<=[{_WHITE}])(?=[{_WHITE}][^{_WHITE}])")
_SPACE = regex.compile(rb"[\t\n\x0b\x0c\r ]")
_RUN = regex.compile(r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+")


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones are themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    def __init__(self, path: str):
        """path: a vocabulary file; a bare name is one of the public tokenizers, found where this process runs."""
        with open(path if "/" in path else public_tokenizers.path(path), encoding="utf-8") as f:
            spec = json.load(f)
        kind = spec["pre_tokenizer"]["type"], spec["model"]["type"], spec["normalizer"], spec["pre_tokenizer"].get("add_prefix_space")
        if kind != ("ByteLevel", "BPE", None, False) or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: only plain byte-level BPE vocabularies are supported")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        by_char = _byte_of()
        self.pieces = [b""] * (1 + max([*spec["model"]["vocab"].values(), *self.special.values()]))
        for token, i in spec["model"]["vocab"].items():
            self.pieces[i] = bytes(map(by_char.__getitem__, token))
        for token, i in self.special.items():
            self.pieces[i] = token.encode()
        merges = [x.split(" ") if isinstance(x, str) else x for x in spec["model"]["merges"]]
        made = [spec["model"]["vocab"][a + b] for a, b in merges]
        if made != sorted(made):
            raise ValueError(f"{path}: ids that don't follow the order of the merges are not supported")
        ranks = {x: i for i, x in enumerate(self.pieces) if x and i not in self.special.values()}
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.quick = tiktoken.Encoding("quick", pat_str=QUICK, mergeable_ranks=ranks, special_tokens={})
        self.raw = tiktoken.Encoding("run", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def segments(self, text: str) -> list[str]:
        """Ordinary texts and special tokens in turn, empty ones left out."""
        return [x for x in (self.split.split(text) if self.split else [text]) if x]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Of ordinary texts."""
        one = lambda x: self.quick.encode_to_numpy(x, disallowed_special=())
        return [np.concatenate([one(y) for y in _LAST.split(x)]) if _GAP.search(x) else one(x) for x in texts]

    def bytes_of(self, ids) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))

    def join(self, a: np.ndarray, b: np.ndarray, w: int = WINDOW) -> np.ndarray:
        """The encoding of the text whose halves have the encodings a and b."""
        while len(a) and len(b):
            left, right = a[-w:], b[:w]
            x, y = self.bytes_of(left), self.bytes_of(right)
            start = 0 if w >= len(a) else next(_breaks(x), None)
            stop = len(y) if w >= len(b) else max(_breaks(y), default=None)
            if start is not None and stop is not None:
                middle = self.encode_all([(x[start:] + y[:stop]).decode("utf-8")])[0]
                return np.concatenate([a[: len(a) - len(left)], left[: self._at(left, start)], middle, right[self._at(right, stop) :], b[len(right) :]])
            if (inside := self._in_run(left, right)) is not None:
                return np.concatenate([a[: len(a) - len(left)], inside, b[len(right) :]])
            w *= 2
        return a if len(a) else b

    def _at(self, ids: np.ndarray, offset: int) -> int:
        """Tokens before a byte offset, where a token begins."""
        ends = np.cumsum([0, *(len(self.pieces[i]) for i in ids.tolist())])
        k = int(np.searchsorted(ends, offset))
        if ends[k] != offset:
            raise AssertionError("a split inside a token")
        return k

    def _in_run(self, left: np.ndarray, right: np.ndarray) -> np.ndarray | None:
        """left + right encoded anew if both lie within one run and the ends of a window inside it agree."""
        starts = lambda ids, k: k >= len(ids) or not 0x80 <= self.pieces[ids[k]][0] < 0xC0
        whole = self.bytes_of(left) + self.bytes_of(right)
        head = next((i for i in range(4) if i < len(whole) and not 0x80 <= whole[i] < 0xC0), 0)
        if not _RUN.fullmatch(whole[head:].decode("utf-8", "ignore")):
            return None
        i = next((k for k in range(len(left) // 2, len(left)) if starts(left, k)), None)
        j = next((k for k in range(len(right) // 2, 0, -1) if starts(right, k)), None)
        if i is None or j is None or i < 4:
            return None
        ids = np.array(self.raw.encode_ordinary(self.bytes_of(np.concatenate([left[i:], right[:j]])).decode("utf-8")), dtype="<u4")
        if len(ids) < 2 or ids[0] != left[i] or ids[-1] != right[j - 1]:
            return None
        return np.concatenate([left[:i], ids, right[j:]])

    def concatenate(self, leaves: list[np.ndarray]) -> np.ndarray:
        """Neighbours two by two, level by level, as they were halved."""
        while len(leaves) > 1:
            leaves = [self.join(*leaves[i : i + 2]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
        return leaves[0] if leaves else np.array([], dtype="<u4")

    def decode(self, ids: np.ndarray) -> str:
        return self.fast.decode(ids.tolist(), errors="replace")


def _breaks(x: bytes) -> Iterator[int]:
    """Where an ASCII white space follows a whole character that is not white space."""
    for m in _SPACE.finditer(x):
        p = m.start()
        before = x[max(0, p - 4) : p]
        while before and 0x80 <= before[0] < 0xC0:
            before = before[1:]
        try:
            last = before.decode("utf-8")[-1:]
        except UnicodeDecodeError:
            continue
        if last and not last.isspace():
            yield p


@lru_cache(maxsize=2)
def bpe(path: str) -> Bpe:
    return Bpe(path)


def halves(text: str, leaf_chars: int) -> list[str]:
    """A power of two of pieces of about equal length, none above leaf_chars."""
    n = 1
    while -(-len(text) // n) > leaf_chars:
        n *= 2
    cuts = [len(text) * i // n for i in range(n + 1)]
    return [text[i:j] for i, j in zip(cuts, cuts[1:])]


def encode(df: DataFrame, path: str, text: str = "text", long_chars: int = LONG_CHARS, leaf_chars: int = LEAF_CHARS, decoded: str | None = None, finish: tuple[Callable, list] | None = None) -> DataFrame:
    """df with the text column replaced by ids (little-endian unsigned 32-bit integers) and, in the column named by
    decoded, the text that these ids decode to; or by what a function makes of a frame's ids (in their place, row by row) and
    the fields of that. So one Python worker a task does both."""
    df = df.drop("ids", *([decoded] if decoded else []), "_text", "_segment", "_leaf", "_piece", "_ids", "_copies")
    rest = df.drop(text)
    fields = rest.schema.fields
    ids_fields = [T.StructField("ids", T.BinaryType())] + ([T.StructField(decoded, T.StringType())] if decoded else [])
    out = T.StructType([*fields, *(finish[1] if finish else ids_fields)])
    cols = rest.columns

    def back(pdf: pd.DataFrame) -> pd.DataFrame:
        if finish:
            return finish[0](pdf)
        return pdf.assign(**{decoded: [bpe(path).decode(np.frombuffer(x, dtype="<u4")) for x in pdf["ids"]]}) if decoded else pdf

    @slim
    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = bpe(path)
        for pdf in slices(batches):
            parts = [t.segments(x or "") for x in pdf[text]]
            done = iter(t.encode_all([s for p in parts for s in p if s not in t.special]))
            ids = [b"".join(np.array([t.special[s]], dtype="<u4").tobytes() if s in t.special else next(done).tobytes() for s in p) for p in parts]
            yield back(pdf[cols].assign(ids=ids))

    @slim
    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = bpe(path)
        for pdf in batches:
            for k in range(len(pdf)):
                row = pdf.iloc[k : k + 1]
                rows = [(s, i, x) for s, seg in enumerate(t.segments(row[text].iloc[0])) for i, x in enumerate([seg] if seg in t.special else halves(seg, leaf_chars))]
                many = row[[*cols, "_text", "_copies"]].loc[row.index.repeat(len(rows))].reset_index(drop=True)
                yield many.assign(**dict(zip(("_segment", "_leaf", "_piece"), map(list, zip(*rows)))))

    @slim
    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = bpe(path)
        for pdf in slices(batches):
            ids = [np.array([t.special[x]], dtype="<u4") if x in t.special else None for x in pdf["_piece"]]
            done = iter(t.encode_all([x for x in pdf["_piece"] if x not in t.special]))
            yield pdf.drop(columns="_piece").assign(_ids=[(next(done) if x is None else x).tobytes() for x in ids])

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        t = bpe(path)
        pdf = pdf.sort_values(["_segment", "_leaf"])
        ids = b"".join(t.concatenate([np.frombuffer(x, dtype="<u4") for x in g["_ids"]]).tobytes() for _, g in pdf.groupby("_segment", sort=True))
        return back(pdf[[*cols, "_copies"]].iloc[:1].assign(ids=[ids]))

    size = F.coalesce(F.char_length(text), F.lit(0))
    short = df.filter(size <= long_chars).mapInPandas(whole, out)
    count = T.StructField("_copies", T.LongType())
    keys = [*fields, T.StructField("_text", T.LongType()), count, T.StructField("_segment", T.LongType()), T.StructField("_leaf", T.LongType())]
    long_ = df.filter(size > long_chars).withColumn("_text", F.xxhash64(text)).groupBy(*cols, "_text").agg(F.first(text).alias(text), F.count("*").alias("_copies"))
    long_ = long_.mapInPandas(leaves, T.StructType([*keys, T.StructField("_piece", T.StringType())]))
    long_ = long_.repartition(partitions(df.sparkSession), "_text", "_leaf").mapInPandas(encoded, T.StructType([*keys, T.StructField("_ids", T.BinaryType())]))
    long_ = long_.groupBy(*cols, "_text").applyInPandas(joined, T.StructType([*fields, count, *out.fields[len(fields) :]]))
    long_ = long_.withColumn("_copies", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).drop("_copies")
    return short.unionByName(long_)


def decode(df: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """df with the decoded text of its ids; nulls give the empty text."""
    rest = df.drop(into)

    @slim
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = bpe(path)
        for pdf in slices(batches):
            yield pdf.assign(**{into: [t.decode(np.frombuffer(x or b"", dtype="<u4")) for x in pdf[ids]]})

    return rest.mapInPandas(run, T.StructType([*rest.schema.fields, T.StructField(into, T.StringType())]))
