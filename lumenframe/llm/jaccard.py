"""N-gram Jaccard join over a token-group matrix.

Tokens are 64-bit hashes of five-word shingles; a document's set holds each once. Equal sets form one class. Links are
exact: the method only saves comparisons.

1. Order: tokens by hash, but the most frequent ones (at most HOT_TOKENS) last, rarest first. Two sets that link share
   SHARED tokens (or all common ones, if these are fewer) among their first n - ceil(t n) + SHARED in this order, t being
   the threshold.
2. Groups: each class is compared with the most typical class (its pivot) that has one of its keys, which are its first
   frequent tokens and its first rare one; those that link form a group. A thousand near copies of one text so become one
   group, linked by a thousand comparisons. A class that links with no pivot is a group of its own.
3. Matrix: a row for each first token and group, with the smallest and the largest set size and the largest possible
   overlap from that token on. Two groups are candidates by SHARED tokens whose bounds allow a link. Tokens with more
   than WIDE groups that the counts had missed join the frequent ones, and the matrix is made anew, once; those that have as
   many then are paired in blocks, each block pair in its own place.
4. Pivots first: a candidate pair of groups whose pivots link, or which other such links connect, is one component, and no
   more of its members' pairs matter.
5. Unions: for the rest, each group's token union is a table of (group, token). Groups whose unions meet in too few tokens
   go. A class's overlap with any member of the other group is at most its overlap with that union; only groups that could
   reach the needed overlap are opened to it, and of their members those that share enough tokens beside the pivot's:
   askers and members meet in blocks, where members are found by these tokens.
6. Pairs go by their token counts in 64 slices of the hash space, whose minima bound the overlap, or by counts in as many
   slices as half their size; those that are left are compared in full.
7. Components of the links by large-star and small-star rounds.

Broadcasts: at most HOT_TOKENS tokens; group labels and class lists only within BROADCAST_ROWS, else joins do it.

Texts without words have the empty set and link with nothing; texts with fewer than five words have one token. Null
doc_id: the row keeps a null component_id unless its class or links have an id. Repeated rows form a class. Empty tables
give empty results; other columns of the input are left out. Classes are told apart by 64-bit digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Stage, arrow_batches, cut, partitions, slim, small

WORDS, THRESHOLD = 5, 80  # words a shingle, per cent
HOT_TOKENS, HOT_FROM, KEYS, COARSE, SHARED = 500_000, 10, 4, 64, 4
WIDE = 2_000  # groups of a token from which it is put last, or paired in blocks
HELD = 500_000  # pairs that a task holds before it passes them on
ASKERS, TOKENS = 2_000, 500_000  # classes, and their tokens, of a side that meets another side in one place
COUNTED = 1_000_000  # tokens that a task counts at a time
ROWS = 50_000  # rows of a few numbers each that are worth a partition
BATCH = 50_000, 4  # rows and MB that a task hands to Python at a time: sets take kilobytes, up to megabytes, matrix rows 50 bytes
_CHUNK = 1 << 17
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_RNG = np.random.default_rng(20)
_BYTES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEPS = _RNG.integers(1, 1 << 62, WORDS + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _P), np.full(n, np.uint64(pow(int(_P), -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _word_hashes(raw: bytes) -> np.ndarray:
    """A hash for each word of lower-cased UTF-8, in order: differences of prefix sums, shifted back to position 0."""
    out = []
    while raw:
        if len(raw) <= _CHUNK:
            part, raw = raw, b""
        else:
            at = _CHUNK
            while at < len(raw) and raw[at] != 32 and not 9 <= raw[at] <= 13:
                at += 1
            part, raw = raw[:at], raw[at:]
        b = np.frombuffer(part, dtype=np.uint8)
        up, down = _powers(max(_CHUNK, 1 << (len(b) - 1).bit_length()) + 1)
        space = np.ones(len(b) + 2, dtype=bool)
        space[1:-1] = (b == 32) | ((b >= 9) & (b <= 13))
        edge = np.flatnonzero(space[1:] != space[:-1])
        start, stop = edge[::2], edge[1::2]
        total = np.zeros(len(b) + 1, dtype=np.uint64)
        np.cumsum(_BYTES[b] * up[: len(b)], out=total[1:])
        out.append(_mix((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64)))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """The sorted token set of a text."""
    w = _word_hashes((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    if not len(w):
        return w
    k = min(WORDS, len(w))
    h = np.full(len(w) - k + 1, np.uint64(k), dtype=np.uint64)
    for i in range(k):
        h = _mix(h) * _STEPS[k] + w[i : len(w) - k + 1 + i] * _STEPS[i]
    return np.unique(_mix(h))


def _packed(s: np.ndarray) -> bytes:
    """A sorted set as differences, first all their lowest bytes, then the next: the top bytes are zeros, which compress."""
    return np.diff(s, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _set(x: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(x, dtype=np.uint8).reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def _counts(s: np.ndarray, slices: int) -> bytes:
    """How many tokens each of 2 ** k slices of the hash space has, at most 255: there it may have more."""
    shift = np.uint64(64 - slices.bit_length() + 1)
    return np.minimum(np.bincount((s >> shift).astype(np.int64), minlength=slices), 255).astype(np.uint8).tobytes()


def _fine(n: int) -> int:
    """Slices for a set of n tokens: one for about two tokens."""
    return min(1 << 16, max(COARSE, 1 << (n // 2).bit_length()))


def _most(x: bytes, y: bytes) -> int:
    """No overlap is above: the sum over slices of the smaller count, the finer counts added up to the coarser's slices.
    Where both counts are full, nothing is known, and every overlap is possible."""
    a, b = np.frombuffer(x, dtype=np.uint8).astype(np.int64), np.frombuffer(y, dtype=np.uint8).astype(np.int64)
    if (a == 255).any() or (b == 255).any():
        return 1 << 60
    k = min(len(a), len(b))
    return int(np.minimum(a.reshape(k, -1).sum(axis=1), b.reshape(k, -1).sum(axis=1)).sum())


def need(n: int, m: int, threshold: int = THRESHOLD) -> int:
    """The least overlap of two sets of n and m tokens that link: o >= t (n + m) / (100 + t)."""
    return -(-threshold * (n + m) // (100 + threshold))


def prefix(n: int, threshold: int = THRESHOLD) -> int:
    """How many first tokens hold SHARED common ones, or all common ones, with any set that links."""
    return min(n, n - -(-threshold * n // 100) + SHARED)


def text_hash(text: Column) -> Column:
    """Tells rows of one doc_id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def token_sets(df: DataFrame) -> DataFrame:
    """doc_id, text_hash, n, class, coarse, slices, tokens; of equal sets within a task only the first carries counts and tokens."""

    @slim
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for pdf in batches:
            out = []
            for i, h, t in zip(pdf["doc_id"], pdf["text_hash"], pdf["text"]):
                s = shingles(t)
                raw = s.tobytes()
                c = int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True) if len(s) else None
                first = c is not None and c not in seen
                seen.add(c)
                out.append((i, h, len(s), c, *((_counts(s, COARSE), _counts(s, _fine(len(s))), _packed(s)) if first else (None, None, None))))
            yield pd.DataFrame(out, columns=["doc_id", "text_hash", "n", "class", "coarse", "slices", "tokens"]).astype({"doc_id": "Int64", "class": "Int64"})

    return df.select(F.col("doc_id").cast("long"), text_hash(F.col("text")).alias("text_hash"), "text").mapInPandas(run, "doc_id long, text_hash long, n long, class long, coarse binary, slices binary, tokens binary")


def hot_tokens(sets: DataFrame, most: int = HOT_TOKENS) -> np.ndarray:
    """The tokens of the most sets, by rising frequency. Each task counts its own, COUNTED at a time, and passes on those
    it saw twice; `qualifying` reports what this misses."""

    def counts(parts: list[np.ndarray]) -> pd.DataFrame:
        token, n = np.unique(np.concatenate(parts), return_counts=True)
        return pd.DataFrame({"token": token[n > 1].view(np.int64), "n": n[n > 1]})

    @slim
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, held = [], 0
        for pdf in batches:
            for x in pdf["tokens"]:
                parts.append(_set(x))
                held += len(parts[-1])
                if held >= COUNTED:
                    yield counts(parts)
                    parts, held = [], 0
        if parts:
            yield counts(parts)

    seen = sets.filter("tokens IS NOT NULL").select("tokens").mapInPandas(run, "token long, n long")
    rows = seen.groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= HOT_FROM).orderBy(F.desc("n"), "token").limit(most).toPandas()
    return rows["token"].to_numpy(np.int64)[::-1].view(np.uint64).copy()


class _Order:
    """Cold tokens by hash, then the hot ones by frequency."""

    def __init__(self, hot: np.ndarray):
        self.sorted = np.sort(hot)
        self.rank = np.argsort(hot, kind="stable")  # the frequency rank of the i-th smallest hot token

    def __call__(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.sorted):
            return s, s[:0]
        at = np.minimum(np.searchsorted(self.sorted, s), len(self.sorted) - 1)
        is_hot = self.sorted[at] == s
        hot = s[is_hot]
        return s[~is_hot], hot[np.argsort(self.rank[at[is_hot]], kind="stable")]


def _anew(df: DataFrame, key: str) -> DataFrame:
    """df with its key computed anew, so that a join has to lay it out again: only then can Spark split the other side's
    rows of a hot key, as a group of near copies or a common passage has."""
    return df.withColumn(key, F.col(key) + 0)


def _few(df: DataFrame, rows: int) -> DataFrame:
    """df in as many partitions as its counted rows are worth: small tables don't make thousands of small files."""
    return df.coalesce(1 + rows // ROWS)


def _counted(df: DataFrame) -> tuple[DataFrame, int]:
    """df cut, in as many partitions as its rows are worth, and their number."""
    df = cut(df)
    n = df.count()
    return _few(df, n), n


def _size_fits(a, b, threshold: int):
    """Columns: sets of a and b tokens may link."""
    return (a * 100 >= b * threshold) & (b * 100 >= a * threshold)


def _of_classes(sets: DataFrame, ids: DataFrame, most: int, *what: str) -> DataFrame:
    """class and the columns named, of the classes in ids (no more than `most`): one row each, where tasks have one each."""
    ids, n = _counted(_few(ids.toDF("class").distinct(), most))
    rows = sets.filter("tokens IS NOT NULL").select("class", *what).join(small(ids, n), "class", "left_semi")
    return _anew(cut(rows.groupBy("class").agg(*(F.first(c).alias(c) for c in what))), "class")


def verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) of classes that link; pairs are cut. Slice counts first, whole sets for what they leave."""

    def own(of: DataFrame, n: int, *what: str) -> DataFrame:
        return _of_classes(sets, of.select("a").union(of.select("b")), 2 * n, *what)

    @slim
    def bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = []
            for n, m, *x in zip(*(pdf[c] for c in ("na", "nb", "ca", "cb", "sa", "sb"))):  # most pairs go by the short counts
                keep.append(all(_most(x[k], x[k + 1]) * (100 + threshold) >= threshold * (n + m) for k in (0, 2)))
            yield pdf.loc[keep, ["a", "b"]]

    @slim
    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = []
            for x, y in zip(pdf["ta"], pdf["tb"]):
                x, y = _set(x), _set(y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= threshold * (len(x) + len(y) - both))
            yield pdf.loc[keep, ["a", "b"]]

    def with_(left: DataFrame, side: str, table: DataFrame) -> DataFrame:
        return left.join(table.select(F.col("class").alias(side), *(F.col(c).alias(f"{c[0]}{side}") for c in table.columns[1:])), side)

    n_pairs = pairs.count()
    pairs = _few(pairs, n_pairs)
    counts = own(pairs, n_pairs, "n", "coarse", "slices")
    rows = with_(with_(pairs, "a", counts), "b", counts).filter(_size_fits(F.col("na"), F.col("nb"), threshold))
    left, n_left = _counted(rows.select("a", "b", "na", "nb", "ca", "cb", "sa", "sb").mapInPandas(bound, "a long, b long"))
    whole = own(left, n_left, "tokens")
    return cut(with_(with_(left, "a", whole), "b", whole).select("a", "b", "ta", "tb").mapInPandas(exact, "a long, b long"))


def star_pairs(sets: DataFrame, hot, threshold: int) -> DataFrame:
    """(a, b): a class and the most typical class that shares one of its keys: its first KEYS frequent tokens by hash, and
    its first rare one."""

    @slim
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        order = _Order(hot.value)
        for pdf in batches:
            out = []
            for c, x in zip(pdf["class"], pdf["tokens"]):
                cold, warm = order(_set(x))
                out += [(int(k), c, len(cold), len(warm)) for k in np.concatenate([cold[:1], np.sort(warm)[:KEYS]]).view(np.int64)]
            yield pd.DataFrame(out, columns=["key", "a", "cold", "hot"])

    rows = cut(sets.filter("tokens IS NOT NULL").select("class", "tokens").mapInPandas(run, "key long, a long, cold long, hot long"))
    typical = F.struct((F.col("hot") / (F.col("hot") + F.col("cold"))).alias("share"), F.col("hot").alias("hot"), F.col("cold").alias("cold"), F.col("a").alias("b"))
    keys = rows.groupBy("key").agg(F.max(typical).alias("p"), F.count("*").alias("c")).filter("c > 1")
    most_rows = rows.count()
    pivots = cut(_few(keys.select(F.col("key").alias("_key"), F.col("p.b").alias("b"), F.col("p.hot").alias("hot_b"), F.col("p.cold").alias("cold_b")), most_rows // 2))
    n, m = F.col("hot") + F.col("cold"), F.col("hot_b") + F.col("cold_b")
    most = F.least("hot", "hot_b") + F.least("cold", "cold_b")  # of the overlap
    pairs = rows.join(_anew(pivots, "_key"), F.col("key") == F.col("_key")).filter((F.col("a") != F.col("b")) & (most * (100 + threshold) >= (n + m) * threshold))
    return cut(_few(pairs.select("a", "b").distinct(), most_rows))


def matrix(sets: DataFrame, labels: DataFrame | None, n_labels: int, hot, threshold: int) -> DataFrame:
    """token, group, low, high (set sizes), room (largest possible overlap from the token on), for first tokens only;
    each task adds up its own rows of a token and group."""
    rows = sets.filter("tokens IS NOT NULL").select("class", "tokens", F.col("class").alias("group"))
    known = None
    if labels is not None and n_labels <= BROADCAST_ROWS:
        pdf = labels.orderBy("class").toPandas()
        known = sets.sparkSession.sparkContext.broadcast((pdf["class"].to_numpy(np.int64), pdf["group"].to_numpy(np.int64)))
    elif labels is not None:
        rows = rows.drop("group").join(labels, "class", "left").select("class", "tokens", F.coalesce("group", "class").alias("group"))

    @slim
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        order = _Order(hot.value)
        for pdf in batches:
            if not len(pdf):
                continue
            own = pdf["class"].to_numpy(np.int64)
            group = pdf["group"].to_numpy(np.int64)
            if known is not None and len(known.value[0]):
                at = np.minimum(np.searchsorted(known.value[0], own), len(known.value[0]) - 1)
                group = np.where(known.value[0][at] == own, known.value[1][at], group)
            tokens, sizes, rooms, groups = [], [], [], []
            for g, x in zip(group, pdf["tokens"]):
                cold, warm = order(_set(x))
                n = len(cold) + len(warm)
                p = prefix(n, threshold)
                first = cold[:p] if p <= len(cold) else np.concatenate([cold, warm[: p - len(cold)]])
                tokens.append(first)
                sizes.append(np.full(p, n))
                rooms.append(n - np.arange(p))
                groups.append(np.full(p, g))
            out = pd.DataFrame({"token": np.concatenate(tokens).view(np.int64), "group": np.concatenate(groups), "low": np.concatenate(sizes), "high": np.concatenate(sizes), "room": np.concatenate(rooms)})
            if len(np.unique(group)) < len(group):
                out = out.groupby(["token", "group"], as_index=False, sort=False).agg(low=("low", "min"), high=("high", "max"), room=("room", "max"))
            yield out

    return rows.mapInPandas(run, "token long, group long, low int, high int, room int")


def _fits(low, high, room, i: np.ndarray, j: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the row pairs (i, j) of one token: which allow a link, and the overlap that a link needs."""
    fits = (high[i] * 100 >= low[j] * threshold) & (high[j] * 100 >= low[i] * threshold)
    least = -(-threshold * (low[i] + low[j]) // (100 + threshold))
    return fits & (np.minimum(room[i], room[j]) >= least - (SHARED - 1)), least  # holds at the first SHARED tokens of every link


def _frame(found: list[np.ndarray]) -> pd.DataFrame:
    """Each pair of groups once, with the tokens it shares and the fewest that it needs."""
    g, h, least = np.concatenate(found, axis=1)
    pdf = pd.DataFrame({"g": g, "h": h, "least": least, "n": 1})
    return pdf.groupby(["g", "h"], as_index=False, sort=False).agg(least=("least", "min"), n=("n", "sum"))


def _wide(pdf: pd.DataFrame, wide: int) -> tuple[pd.DataFrame, pd.DataFrame | None]:
    """Of rows sorted by token: one row a token and group, of tokens with several groups; and in place of the rows of each
    token with more than `wide` groups a row (token, null, 0, groups)."""
    token, over = pdf["token"].to_numpy(), None
    same = np.zeros(len(token) + 1, dtype=bool)
    same[1:-1] = token[1:] == token[:-1]
    pdf = pdf[same[1:] | same[:-1]].groupby(["token", "group"], as_index=False, sort=True).agg(low=("low", "min"), high=("high", "max"), room=("room", "max"))
    token, count = np.unique(pdf["token"].to_numpy(np.int64), return_counts=True)
    if (count > wide).any():
        over = pd.DataFrame({"g": token[count > wide], "h": pd.array([None] * int((count > wide).sum()), dtype="Int64"), "least": 0, "n": count[count > wide]})
        pdf = pdf[np.repeat(count <= wide, count)]
    return pdf, over


def _pairs(pdf: pd.DataFrame, threshold: int) -> Iterator[np.ndarray]:
    """(g, h, least) for each token and pair of its groups, in arrays of at most as many columns as pdf has rows."""
    token, group, low, high, room = (pdf[c].to_numpy(np.int64) for c in ("token", "group", "low", "high", "room"))
    ends = np.searchsorted(token, token, side="right")
    for step in range(1, int((ends - np.arange(len(token))).max(initial=1))):
        i = np.flatnonzero(np.arange(len(token)) + step < ends)
        fits, least = _fits(low, high, room, i, i + step, threshold)
        i, least = i[fits], least[fits]
        if len(i):
            yield np.stack([np.minimum(group[i], group[i + step]), np.maximum(group[i], group[i + step]), np.minimum(least, SHARED)])


def qualifying(rows: DataFrame, threshold: int, wide: int) -> DataFrame:
    """g, h, least, n: pairs of groups, g < h, with the tokens whose bounds allow a link, a row from each task; and a row
    (token, null, 0, groups) for each token with more than `wide` groups, whose pairs are not here."""

    def whole_tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []
        for pdf in batches:  # rows are sorted by token: what follows the last token's first row waits for the next batch
            if not len(pdf):
                continue
            token = pdf["token"].to_numpy()
            if rest and rest[-1]["token"].iloc[-1] == token[0] == token[-1]:
                rest.append(pdf)
                continue
            at = int(np.searchsorted(token, token[-1]))
            yield pd.concat([*rest, pdf.iloc[:at]])
            rest = [pdf.iloc[at:]]
        if rest:
            yield pd.concat(rest)

    @slim
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: list[np.ndarray] = []
        held = 0
        for pdf in whole_tokens(batches):
            pdf, over = _wide(pdf, wide)
            if over is not None:
                yield over
            for pairs in _pairs(pdf, threshold):
                found.append(pairs)
                held += pairs.shape[1]
                if held > HELD:  # what a task holds is counted in pairs, not in rows
                    yield _frame(found)
                    found, held = [], 0
        if found:
            yield _frame(found)

    dealt = rows.repartition(partitions(rows.sparkSession), "token").sortWithinPartitions("token")
    return cut(dealt.mapInPandas(run, "g long, h long, least long, n long"))


def block_pairs(rows: DataFrame, tokens: DataFrame, n_tokens: int, threshold: int, wide: int) -> DataFrame:
    """g, h, least, n of the tokens(token, blocks): a token's groups are dealt into blocks by hash, and every two blocks
    meet in a place of their own, so that no task has all rows of a token."""
    rows = rows.join(small(tokens, n_tokens), "token").groupBy("token", "blocks", "group").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("room").alias("room"))
    own = F.pmod(F.xxhash64("group"), F.col("blocks"))
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("token", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "group", "low", "high", "room")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        same = pdf["i"].iloc[0] == pdf["j"].iloc[0]
        group, low, high, room, side = (pdf[c].to_numpy(np.int64) for c in ("group", "low", "high", "room", "own"))
        found = [np.empty((3, 0), dtype=np.int64)]
        left = np.arange(len(group)) if same else np.flatnonzero(side == pdf["i"].iloc[0])
        right = left if same else np.flatnonzero(side == pdf["j"].iloc[0])
        for at in left:
            j = right[right > at] if same else right
            fits, least = _fits(low, high, room, np.full(len(j), at), j, threshold)
            found.append(np.stack([np.minimum(group[at], group[j[fits]]), np.maximum(group[at], group[j[fits]]), np.minimum(least[fits], SHARED)]))
        return _frame(found)

    return rows.groupBy("token", "i", "j").applyInPandas(run, "g long, h long, least long, n long")


def candidates(sets: DataFrame, labels: DataFrame | None, n_labels: int, hot: np.ndarray, threshold: int, wide: int) -> DataFrame:
    """Pairs (g, h) of groups, g < h, whose matrix rows allow a link."""
    spark = sets.sparkSession
    for turn in range(2):  # wide tokens that the second matrix still has are paired in blocks
        rows = matrix(sets, labels, n_labels, spark.sparkContext.broadcast(hot), threshold)
        found = qualifying(rows, threshold, wide)
        over = found.filter("h IS NULL").select(F.col("g").alias("token"), "n")
        new = over.orderBy(F.desc("n"), "token").limit(HOT_TOKENS).toPandas()
        known = np.isin(new["token"].to_numpy(np.int64), hot.view(np.int64))
        more = new["token"].to_numpy(np.int64)[~known][: max(0, HOT_TOKENS - len(hot))]
        if turn or not len(more):
            break
        hot = np.concatenate([hot, more[::-1].view(np.uint64)])  # last of all: they are in more groups than is known of any other
    pairs = found.filter("h IS NOT NULL")
    if len(new):
        tokens = over.groupBy("token").agg(F.sum("n").alias("n")).select("token", F.ceil(F.col("n") / wide).cast("long").alias("blocks"))
        pairs = pairs.union(block_pairs(rows, tokens, len(new), threshold, wide))
    return _counted(pairs.groupBy("g", "h").agg(F.min("least").alias("least"), F.sum("n").alias("n")).filter("n >= least").select("g", "h"))[0]


def not_connected(groups: DataFrame, edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (g, h) of groups that the links `edges` of classes leave apart."""
    own = lambda c: labels.select(F.col("class").alias(c), F.col("group").alias(f"_{c}"))
    up = edges.join(own("a"), "a", "left").join(own("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    roots = components(up)
    side = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"_{c}"))
    return groups.join(side("g"), "g", "left").join(side("h"), "h", "left").filter(F.coalesce("_g", "g") != F.coalesce("_h", "h")).select("g", "h")


def _met(askers: DataFrame, holders: DataFrame, threshold: int) -> DataFrame:
    """(a, b, group) of askers (a, group, na, ia, t) and members (b, group, nb, ib, t) of a group where the smaller overlap with the
    pivot and the tokens t that both have reach a link's overlap. Each side is dealt into blocks, and every two blocks meet in
    a place of their own; there a member is looked up by its tokens, and only pairs that reach it come out."""
    each = lambda df, c: df.groupBy("group").agg(F.ceil(F.greatest(F.count("*") / ASKERS, F.sum(F.coalesce(F.size("t"), F.lit(0))) / TOKENS)).cast("long").alias(c))
    blocks = each(askers, "p").join(each(holders, "q"), "group")
    count = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    left = askers.join(_anew(blocks, "group"), "group").select("group", dealt("a", "p").alias("i"), count("q").alias("j"), F.lit(True).alias("asks"), F.col("a").alias("class"), F.col("na").alias("n"), F.col("ia").alias("inside"), "t")
    right = holders.join(_anew(blocks, "group"), "group").select("group", count("p").alias("i"), dealt("b", "q").alias("j"), F.lit(False).alias("asks"), F.col("b").alias("class"), F.col("nb").alias("n"), F.col("ib").alias("inside"), "t")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        empty = np.empty(0, np.int64)
        lists = [empty if x is None else np.asarray(x, np.int64) for x in pdf["t"]]
        asks = pdf["asks"].to_numpy(bool)
        (qa, qb), cls, n, inside = (np.flatnonzero(asks), np.flatnonzero(~asks)), *(pdf[c].to_numpy(np.int64) for c in ("class", "n", "inside"))
        held = np.concatenate([empty, *(lists[k] for k in qb)])
        owner = np.repeat(np.arange(len(qb)), [len(lists[k]) for k in qb])
        order = np.argsort(held, kind="stable")
        held, owner, nb, ib, out = held[order], owner[order], n[qb], inside[qb], []
        for k in qa:
            low, high = np.searchsorted(held, lists[k]), np.searchsorted(held, lists[k], side="right")
            some = np.concatenate([empty, *(owner[x:y] for x, y in zip(low, high) if y > x)])
            shared = np.minimum(inside[k], ib) + np.bincount(some, minlength=len(qb))
            fits = (n[k] * 100 >= nb * threshold) & (nb * 100 >= n[k] * threshold) & (shared * (100 + threshold) >= (n[k] + nb) * threshold)
            if fits.any():
                out.append(np.stack([np.full(int(fits.sum()), cls[k]), cls[qb[fits]]]))
        a, b = np.concatenate(out, axis=1) if out else (empty, empty)
        return pd.DataFrame({"a": a, "b": b, "group": np.full(len(a), key[0])})

    return left.unionByName(right).groupBy("group", "i", "j").applyInPandas(run, "a long, b long, group long")


def opened(groups: DataFrame, sets: DataFrame, labels: DataFrame, pivots: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) of classes of the pairs (g, h) of groups that could link. Two groups of several members go if their token
    unions share too few tokens for any of them. Then a class asks the other group: its overlap with the group's token
    union must reach a link's. The union of a group of one is its set, which is compared in full later.
    A member b is opened to a only if min(|a & pivot|, |b & pivot|) and the tokens beside the pivot that both have reach a
    link's overlap."""
    reach = lambda most, n, m: most * (100 + threshold) >= (n + m) * threshold
    wanted = groups.select(F.col("g").alias("group")).union(groups.select(F.col("h").alias("group"))).distinct()
    n_groups = groups.count()
    ids, n_ids = _counted(labels.join(wanted, "group", "left_semi").join(pivots, "group"))
    alone = wanted.join(pivots.select("group"), "group", "left_anti")
    held = _of_classes(sets, ids.select("class").union(alone), n_ids + 2 * n_groups, "n", "tokens")
    sizes = held.select("class", "n")

    @slim
    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = [_set(x).view(np.int64) for x in pdf["tokens"]]
            if parts:
                yield pdf[["class", "group", "pivot"]].loc[pdf.index.repeat(list(map(len, parts)))].assign(token=np.concatenate(parts))

    kind = "class long, group long, pivot long, token long"
    own = cut(ids.join(held, "class").select("class", "group", "pivot", "tokens").mapInPandas(tokens, kind))
    union = cut(own.groupBy("group", "token").agg(F.count("*").alias("holders"), F.max((F.col("class") == F.col("pivot")).cast("int")).alias("in_pivot")))
    of_union = lambda df: df.join(_anew(union, "token"), ["group", "token"])
    own = of_union(own)
    members = _few(own.groupBy("class", "group").agg(F.sum("in_pivot").alias("inside")).join(sizes, "class").select(F.col("class").alias("b"), "group", F.col("n").alias("nb"), F.col("inside").alias("ib")), n_ids)
    members = cut(members)
    ranges = members.groupBy("group").agg(F.min("nb").alias("low"), F.max("nb").alias("high"))
    # groups whose unions meet in too few tokens: the smaller union looks its tokens up in the larger one
    of = ranges.join(union.groupBy("group").agg(F.count("*").alias("w")), "group").select("group", "low", "w")
    side = lambda c: of.select(F.col("group").alias(c), F.col("low").alias(f"low_{c}"), F.col("w").alias(f"w_{c}"))
    pairs = groups.join(_anew(side("g"), "g"), "g").join(_anew(side("h"), "h"), "h")
    pairs = cut(_few(pairs, n_groups).withColumn("small", F.when(F.col("w_g") <= F.col("w_h"), F.col("g")).otherwise(F.col("h"))).withColumn("large", F.when(F.col("w_g") <= F.col("w_h"), F.col("h")).otherwise(F.col("g"))))
    meet = pairs.select("g", "h", "small", "large").join(_anew(union.select(F.col("group").alias("small"), "token"), "small"), "small").join(_anew(union.select(F.col("group").alias("large"), "token"), "token"), ["large", "token"])
    meet = pairs.join(meet.groupBy("g", "h").agg(F.count("*").alias("meet")), ["g", "h"], "left")
    at_least = lambda x, y: F.greatest(F.col(x), F.ceil(F.col(y) * threshold / 100))  # noqa: E731  the smallest members that may link
    far = meet.filter(~reach(F.coalesce("meet", F.lit(0)), at_least("low_g", "low_h"), at_least("low_h", "low_g"))).select("g", "h")
    groups = cut(_few(groups.join(_anew(far, "g"), ["g", "h"], "left_anti"), n_groups))

    both = groups.select(F.col("g").alias("own"), F.col("h").alias("other")).union(groups.select(F.col("h").alias("own"), F.col("g").alias("other")))
    asks = both.join(pivots.select(F.col("group").alias("other")), "other", "left_semi")  # of groups of two and more only
    asks = asks.join(_anew(ids.select(F.col("group").alias("own"), F.col("class").alias("_q")), "own"), "own", "left").select("own", "other", F.coalesce("_q", "own").alias("q"))
    asks, n_asks = _counted(asks)
    asked = asks.select(F.col("q").alias("class"), F.col("other").alias("group")).distinct().join(held, "class").withColumn("pivot", F.lit(0).cast("long"))
    asked = cut(of_union(asked.select("class", "group", "pivot", "tokens").mapInPandas(tokens, kind)).select(F.col("class").alias("a"), "group", "token", "holders", "in_pivot"))
    a = asked.groupBy("a", "group").agg(F.count("*").alias("most"), F.sum("in_pivot").alias("ia"))
    a = a.join(ranges, "group").join(sizes.select(F.col("class").alias("a"), F.col("n").alias("na")), "a")
    least = F.greatest(F.col("low"), F.ceil(F.col("na") * threshold / 100))  # the smallest size of a member that may link
    a = cut(_few(a, n_asks).filter((F.col("na") * threshold <= F.col("high") * 100) & reach(F.col("most"), F.col("na"), least)).select("a", "group", "na", "ia"))

    beside = asked.filter("in_pivot = 0").select("a", "group", "token").join(_anew(a.select("a", "group"), "a"), ["a", "group"])
    askers = a.join(beside.groupBy("a", "group").agg(F.collect_list("token").alias("t")), ["a", "group"], "left")
    wanted_tokens = beside.select("group", "token").distinct()
    theirs = own.filter("in_pivot = 0").select(F.col("class").alias("b"), "group", "token").join(_anew(wanted_tokens, "token"), ["group", "token"])
    holders = members.join(_anew(a.select("group").distinct(), "group"), "group").join(theirs.groupBy("b", "group").agg(F.collect_list("token").alias("t")), ["b", "group"], "left")
    found, _ = _counted(_met(askers, holders, threshold))

    several = pivots.select(F.col("group").alias("own"), F.lit(True).alias("_several"))
    way = asks.select("own", "other", F.col("q").alias("a")).join(several, "own", "left").filter("_several IS NULL OR own < other")
    pairs = found.join(way.withColumnRenamed("other", "group"), ["a", "group"])
    back = a.select(F.col("a").alias("b"), F.col("group").alias("own"), F.lit(True).alias("_back"))  # members that opened the asking group
    return pairs.join(back, ["b", "own"], "left").filter("_several IS NULL OR _back").select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for every node of edges(a, b)."""
    high, low = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    edges, n = _counted(edges.filter("a <> b").select(high, low).distinct())
    state = None  # no round makes more edges than there are
    while True:
        edges = _few(edges, n)
        # large star: every larger neighbour moves to the smallest neighbour
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(_few(_anew(least, "a"), n), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = cut(_few(large, n))
        # small star: smaller neighbours and the node itself move to the smallest one
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small_ = large.join(_few(_anew(least, "a"), n), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(_few(least.select("a", F.col("m").alias("b")), n))
        edges = cut(_few(small_.filter("a <> b").distinct(), n))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now


def near_duplicates(df: DataFrame, threshold: int = THRESHOLD, wide: int = WIDE, text_hash: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links), n_links (links of the class found by
    comparison, without those that steps 2 and 4 made superfluous), for every row of df(doc_id, text); on demand text_hash, which
    with doc_id names the row."""
    stage = Stage(df.sparkSession)
    try:
        with arrow_batches(df.sparkSession, *BATCH):
            out = _near_duplicates(df, threshold, wide, stage)
            return out if text_hash else out.drop("text_hash")
    finally:
        stage.drop()


def _near_duplicates(df: DataFrame, threshold: int, wide: int, stage: Stage) -> DataFrame:
    sets = stage.put(token_sets(df), "sets")
    hot = hot_tokens(sets)
    stars = verified(star_pairs(sets, df.sparkSession.sparkContext.broadcast(hot), threshold), sets, threshold)
    n_stars, labels, n_labels = stars.count(), None, 0
    stars = _few(stars, n_stars)
    if n_stars:
        roots = components(stars)
        labels, n_labels = _counted(roots.select(F.col("node").alias("class"), F.col("root").alias("group")).union(roots.select("root", "root").distinct()))
    groups, edges = candidates(sets, labels, n_labels, hot, threshold, wide), stars
    if labels is None:
        edges = edges.union(verified(groups.toDF("a", "b"), sets, threshold))
    else:
        # a group's pivot: the class that most of its members were compared with
        pivots = stars.groupBy("b").agg(F.count("*").alias("c")).join(labels.withColumnRenamed("class", "b"), "b")
        pivots, _ = _counted(pivots.groupBy("group").agg(F.max_by("b", F.struct("c", "b")).alias("pivot")))
        side = lambda c: pivots.select(F.col("group").alias(c), F.col("pivot").alias(f"_{c}"))
        first = groups.join(side("g"), "g", "left").join(side("h"), "h", "left").select(F.coalesce("_g", "g").alias("a"), F.coalesce("_h", "h").alias("b"))
        edges, _ = _counted(edges.union(verified(cut(_few(first, groups.count())), sets, threshold)))
        # two groups of one class each were compared in full
        apart = not_connected(groups, edges, labels).join(pivots.select(F.col("group").alias("g"), F.lit(1).alias("_g")), "g", "left").join(pivots.select(F.col("group").alias("h"), F.lit(1).alias("_h")), "h", "left")
        apart, n_apart = _counted(apart.filter("_g = 1 OR _h = 1").select("g", "h"))
        if n_apart:
            edges, _ = _counted(edges.union(verified(cut(opened(apart, sets, labels, pivots, threshold)), sets, threshold)))
    roots = components(edges)
    degree = edges.union(edges.select("b", "a")).distinct().groupBy("a").agg(F.count("*").alias("n_links"))
    ids = sets.filter("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("least"))
    ids = cut(ids.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class")))
    least = ids.groupBy("root").agg(F.min("least").alias("component_id"))
    named = ids.join(_anew(least, "root"), "root").join(degree.withColumnRenamed("a", "class"), "class", "left")
    named = stage.put(named.select("class", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links")), "named")
    out = sets.select("doc_id", "text_hash", "n", "class").join(named, "class", "left")
    return cut(out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")))
