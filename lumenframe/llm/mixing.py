"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Targets: the sources, in code point order with null last, weigh 1, 2, 3, 1, ... and share the words of the whole
table; no target exceeds `repeats` times its source's words, and the excess is shared again by weight.

Quotas: the mix has round(words / block_words) blocks, dealt to `shards` shards whose sizes differ by one at most. For the
first 1, 2, ... shards together, Sainte-Lague gives each block to the source with the highest quotient v / (2k - 1), v being
its target and k its next block, ties to the first source; what a shard adds to the shards before it is its quota. Only the
quotients near the cut-off are ranked: a divisor that gives too many blocks and one that gives too few are known by formula.

Selection: a source's documents, in a seeded order, form one stream of words that is cut into blocks. The mix takes the
whole stream as often as the quota allows and then the blocks whose seeded seat is below the rest of the quota; the seat is
an affine permutation of the block numbers, so a row alone knows whether a block is taken. The seats of a source go to the
shards by their quotas, in order.

Empty tables give empty results. Null or empty texts have size 0 and nothing is taken of them. Null sources are a source
of their own. Repeated rows count each; rows that differ, be it only in the text, have an order of their own, whatever
their doc_id, so reruns agree. A source whose target is below half a block may get none. Other columns of the input pass
through, but for the names in RESERVED and those of working columns, _place, _bin, _before, _start, _some, _pass and _seat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, partitions, small

RESERVED = ("size", "source_size", "target", "taken", "rank", "weight", "blocks", "quota", "passes", "rest", "step", "shift", "first", "shard", "upto")
#: Primes that step through the blocks of a source; no block count below 2**60 is divisible by all three.
STEPS = (8388593, 8388587, 8388571)
RACK = 1024  # bins


def sizes(df: DataFrame, text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def ranked(df: DataFrame, key: str) -> DataFrame:
    """df with `rank`, 0, 1, ... by key, null last: range partitions, numbered within, shifted by the counts before."""
    part = cut(df.repartitionByRange(partitions(df.sparkSession), F.col(key).asc_nulls_last()).withColumn("_p", F.spark_partition_id()))
    before = part.groupBy("_p").agg(F.count("*").alias("_n"))
    before = before.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_b"))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(F.col(key).asc_nulls_last())) - 1
    return part.withColumn("_i", inside).join(F.broadcast(before), "_p").withColumn("rank", F.col("_i") + F.col("_b")).drop("_p", "_i", "_b")


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeats: int = 3) -> DataFrame:
    """sources(source, source_size) with rank, weight and target. Each round of sharing is one sum over the sources."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    table = cut(ranked(sources, "source").withColumn("weight", weight))
    total = table.agg(F.sum("source_size")).first()[0] or 0
    most, share = F.col("source_size") * repeats, 0.0
    while total:
        capped = most <= F.lit(share) * F.col("weight")
        used, open_weight = table.agg(F.sum(F.when(capped, most).otherwise(0)), F.sum(F.when(capped, 0).otherwise(F.col("weight")))).first()
        now = (total - used) / open_weight if open_weight else share
        if now <= share:
            break
        share = now
    return table.withColumn("target", F.least(most.cast("double"), F.lit(share) * F.col("weight")))


def shard_quotas(table: DataFrame, shards: int, block_words: int) -> DataFrame:
    """rank, shard (1, 2, ...), blocks: how many of a source's blocks go to a shard, for every source and shard."""
    total, n = table.agg(F.sum("target"), F.count("*")).first()
    seats = int((total or 0.0) / block_words + 0.5)
    each = table.select("rank", "target", F.explode(F.sequence(F.lit(1), F.lit(shards))).alias("shard")).withColumn("house", F.floor(F.col("shard") * F.lit(float(seats)) / shards))
    # with a divisor of total / (house -+ n / 2) the rounded quotas add up to the house at most, or at least
    by = lambda house: F.floor(F.col("target") / F.lit(total or 1.0) * house + 0.5).cast("long")
    sure = F.when(F.col("house") > n / 2, by(F.col("house") - n / 2)).otherwise(0)
    each = each.withColumn("sure", F.greatest(sure - 1, F.lit(0))).withColumn("most", by(F.col("house") + n / 2) + 1)
    w = Window.partitionBy("shard").orderBy(F.desc("quotient"), "rank")
    open_ = F.col("house") - F.col("given")
    given = each.groupBy("shard").agg(F.sum("sure").alias("given"))
    bids = each.withColumn("k", F.explode(F.sequence(F.col("sure") + 1, F.col("most")))).withColumn("quotient", F.col("target") / (2 * F.col("k") - 1))
    won = bids.withColumn("place", F.row_number().over(w)).join(given, "shard").filter(F.col("place") <= open_).groupBy("rank", "shard").agg(F.count("*").alias("won"))
    upto = each.join(won, ["rank", "shard"], "left").withColumn("upto", F.col("sure") + F.coalesce("won", F.lit(0)))
    before = F.lag("upto", 1, 0).over(Window.partitionBy("rank").orderBy("shard"))
    return upto.withColumn("blocks", F.col("upto") - before).select("rank", "shard", "blocks")


def placed(df: DataFrame, block_words: int, seed: int, repeats: int, weights: tuple[int, ...], shards: int, texts: bool = False) -> tuple[DataFrame, DataFrame]:
    """The rows (texts: with their text, which is then read twice rather than kept) with size, source_size, target, first
    (place of the first word in the source's stream), passes (whole passes of the source), rest (blocks beyond them),
    blocks (of the source), step and shift (of the permutation); and rank, upto: the blocks of each source's shards."""
    df = df.drop(*RESERVED)
    whole_row = F.xxhash64(F.lit(seed), *(c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind))
    sized = df.withColumn("size", sizes(df)).withColumn("_place", whole_row)
    sized = sized if texts else cut(sized.drop("text"))
    sources = cut(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows")))
    n_sources, n_rows = sources.agg(F.count("*"), F.sum("_rows")).first()
    table, b = cut(targets(sources.drop("_rows"), weights, repeats)), block_words
    each = F.sort_array(F.collect_list(F.struct("shard", "blocks")))
    quotas = cut(shard_quotas(table, shards, b).groupBy("rank").agg(F.sum("blocks").alias("quota"), F.transform(each, lambda x: x["blocks"]).alias("upto")))
    table = table.join(quotas.select("rank", "quota"), "rank")
    blocks = F.ceil(F.col("source_size") / b).cast("long")
    step = F.coalesce(*(F.when(F.col("blocks") % p != 0, F.lit(p)) for p in STEPS))
    words = F.col("quota") * b
    table = (
        table.withColumn("blocks", F.greatest(blocks, F.lit(1)))
        .withColumn("passes", F.when(F.col("source_size") > 0, F.least(F.floor(words / F.col("source_size")), F.lit(repeats))).otherwise(0).cast("long"))
        .withColumn("rest", F.when(F.col("passes") >= repeats, 0).otherwise(F.least("blocks", F.floor((words - F.col("passes") * F.col("source_size")) / b + 0.5))).cast("long"))
        .withColumn("step", step.cast("long"))
        .withColumn("shift", F.pmod(F.xxhash64("source", F.lit(seed)), F.col("blocks")))
    )
    # A source may hold a third of all rows: its stream is ordered in many seeded bins, which are then laid end to end.
    bins = max(64, -(-(n_rows or 0) // 4096))
    rows = (
        sized.join(small(table.withColumnRenamed("source", "_source"), n_sources), sized["source"].eqNullSafe(F.col("_source")))
        .drop("_source")
        .withColumn("_bin", F.pmod(F.col("_place"), F.lit(bins)))
    )
    inside = Window.partitionBy("rank", "_bin").orderBy("_place", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    # the bins' starts in two levels, so that no task has all bins of a source
    before = lambda total, w: F.sum(total).over(w) - F.col(total)
    ends = rows.groupBy("rank", "_bin").agg(F.sum("size").alias("_words")).withColumn("_rack", F.floor(F.col("_bin") / RACK))
    racks = ends.groupBy("rank", "_rack").agg(F.sum("_words").alias("_all")).withColumn("_base", before("_all", Window.partitionBy("rank").orderBy("_rack")))
    ends = ends.withColumn("_in", before("_words", Window.partitionBy("rank", "_rack").orderBy("_bin"))).join(racks, ["rank", "_rack"])
    ends = ends.select("rank", "_bin", (F.col("_base") + F.col("_in")).alias("_start"))
    rows = rows.join(ends, ["rank", "_bin"]).withColumn("first", F.col("_start") + F.col("_before")).drop("_place", "_bin", "_before", "_start")
    return rows, small(quotas.select("rank", "upto"), n_sources * (1 + shards // 4))


def _seat(block: Column) -> Column:
    return F.pmod(block * (F.col("step") % F.col("blocks")) + F.col("shift"), F.col("blocks"))


def _taken_of_rest(block_words: int) -> Column:
    """Words of a document in the blocks that the last pass takes."""
    last, b = F.col("first") + F.col("size"), block_words
    part = lambda i: F.when(_seat(i) < F.col("rest"), F.least(last, (i + 1) * b) - F.greatest(F.col("first"), i * b)).otherwise(0)
    some = F.aggregate(F.sequence(F.floor(F.col("first") / b), F.floor((last - 1) / b)), F.lit(0).cast("long"), lambda acc, i: acc + part(i))
    return F.when((F.col("size") == 0) | (F.col("rest") == 0), 0).when(F.col("rest") == F.col("blocks"), F.col("size")).otherwise(some)


def mix(df: DataFrame, block_words: int = 16, seed: int = 17, weights: tuple[int, ...] = (1, 2, 3), repeats: int = 3, shards: int = 64) -> DataFrame:
    """doc_id and the other columns but text, with size, source_size, target and taken."""
    rows, _ = placed(df, block_words, seed, repeats, weights, shards)
    return rows.withColumn("taken", F.col("passes") * F.col("size") + _taken_of_rest(block_words)).drop("rank", "weight", "blocks", "quota", "passes", "rest", "step", "shift", "first")


def mixed_rows(df: DataFrame, block_words: int = 16, seed: int = 17, weights: tuple[int, ...] = (1, 2, 3), repeats: int = 3, shards: int = 64) -> DataFrame:
    """The mix itself: df's columns and `shard`, one row for each pass over a document and, for the last pass, one with
    the words of the blocks that it takes, joined by single spaces. Rows with nothing taken go. A document's words of one
    pass stay together: the seat of its first block decides their shard, so shards keep to their quotas but for the blocks
    that a document has beyond its first."""
    b = block_words
    rows, quotas = placed(df, b, seed, repeats, weights, shards, texts=True)
    at = lambda i: F.floor((F.col("first") + i) / b)  # noqa: E731  the block of a document's word
    seat = F.col("_pass") * F.col("blocks") + _seat(F.floor(F.col("first") / b))
    # shards are filled by their quotas, in order
    filled = F.aggregate("upto", F.struct(F.lit(0).cast("long").alias("n"), F.lit(1).alias("shard")), lambda acc, q: F.struct((acc["n"] + q).alias("n"), (acc["shard"] + (acc["n"] + q <= F.col("_seat")).cast("int")).alias("shard")))
    shard = F.least(F.lit(shards), filled["shard"]).cast("int")
    takes = rows.filter("size > 0").withColumn("_some", _taken_of_rest(b)).withColumn("_pass", F.explode(F.sequence(F.lit(0), F.col("passes"))))
    takes = takes.filter((F.col("_pass") < F.col("passes")) | (F.col("_some") > 0)).withColumn("_seat", seat).join(quotas, "rank").withColumn("shard", shard)
    words = F.regexp_extract_all(F.col("text"), F.lit(f"({WORD})"), 1)
    some = F.array_join(F.filter(words, lambda w, i: _seat(at(i)) < F.col("rest")), " ")
    text = F.when((F.col("_pass") < F.col("passes")) | (F.col("_some") == F.col("size")), F.col("text")).otherwise(some)
    return takes.withColumn("text", text).select(*(c for c in df.columns if c not in RESERVED), "shard")
