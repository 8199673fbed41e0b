"""Mixing sources to target weights by balanced sampling with the cube method."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import WORD
from millrace.operators.ranking import row_numbers
from millrace.session import written

BLOCK = 4096
EDGE = 1e-9
CEILING = 3


def source_targets(units: DataFrame, cycle: int = 3, ceiling: int = CEILING) -> DataFrame:
    """(source_no, source, documents, source_size, target) from (source, size, repeats).

    Sources in code point order, null last, weigh 1 to ``cycle``, repeating. All sizes are shared by
    weight; a target above ``ceiling`` times its source's size stops there and the rest is shared
    again until none is above. Rounds go on over the table of sources; the driver sees their sums only.
    """
    totals = units.groupBy("source").agg(
        F.count("*").alias("documents"), F.sum(F.col("size") * F.col("repeats")).alias("source_size")
    )
    totals = totals.withColumn("_last", F.col("source").isNull())
    ranked = row_numbers(totals, [], ["_last", "source"], "source_no").drop("_last")
    ranked = written(ranked.withColumn("_weight", (F.col("source_no") - 1) % cycle + 1), "sources")
    most, level, capped = ceiling * F.col("source_size"), 0.0, -1
    while True:
        over = most < F.col("_weight") * F.lit(level)
        row = ranked.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(over, most)).alias("stopped"),
            F.sum(F.when(~over, F.col("_weight"))).alias("free"),
            F.count(F.when(over, 1)).alias("capped"),
        ).first()
        if row["capped"] == capped or not row["free"]:
            break
        capped = row["capped"]
        level = (row["all"] - (row["stopped"] or 0)) / row["free"]
    target = F.least(most.cast("double"), F.col("_weight") * F.lit(level))
    return ranked.withColumn("target", target).drop("_weight")


def flight(sizes: list[float], chances: list[float], draw: np.random.Generator) -> list[float]:
    """Move inclusion chances to 0 or 1, keeping the sums of chances and of chance times size.

    Three open units at a time have one direction that changes neither sum: the cross product of
    (sizes) and (ones). A random step along it, either way with the odds that keep every chance right
    on average, settles one unit at least. Two units of one size still trade. At most two stay open.
    """
    chances = list(chances)
    waiting = iter([i for i, p in enumerate(chances) if EDGE < p < 1 - EDGE])
    active: list[int] = []
    while True:
        while len(active) < 3 and (unit := next(waiting, None)) is not None:
            active.append(unit)
        if len(active) == 3:
            a, b, c = (sizes[i] for i in active)
            way = (b - c, c - a, a - b)
            if a == b == c:
                way = (1.0, -1.0, 0.0)
        elif len(active) == 2 and sizes[active[0]] == sizes[active[1]]:
            way = (1.0, -1.0)
        else:
            return chances
        ahead = min((1 - chances[i]) / u if u > 0 else -chances[i] / u for i, u in zip(active, way, strict=True) if u)
        back = min(chances[i] / u if u > 0 else (chances[i] - 1) / u for i, u in zip(active, way, strict=True) if u)
        step = ahead if draw.random() * (ahead + back) < back else -back
        for i, u in zip(active, way, strict=True):
            moved = chances[i] + step * u
            chances[i] = 0.0 if moved < EDGE else 1.0 if moved > 1 - EDGE else moved
        active = [i for i in active if 0 < chances[i] < 1]


def landed(sizes: list[float], chances: list[float]) -> list[float]:
    """Settle what is open (two units at most): of all roundings the one whose size is nearest, then the count's.

    One settled unit changes sides where that brings the size nearer still: all units given here are
    those with a fractional chance at first, so none is taken more often than allowed.
    """
    open_ = [i for i, p in enumerate(chances) if 0 < p < 1]
    want, count = sum(sizes[i] * chances[i] for i in open_), sum(chances[i] for i in open_)

    def cost(mask: int) -> tuple[float, float, int]:
        taken = [i for k, i in enumerate(open_) if mask >> k & 1]
        return abs(sum(sizes[i] for i in taken) - want), abs(len(taken) - count), mask

    best = min(range(1 << len(open_)), key=cost)
    rounded = np.array(chances)
    for k, i in enumerate(open_):
        rounded[i] = float(best >> k & 1)
    over = sum(sizes[i] * rounded[i] for i in open_) - want
    change = np.array(sizes) * (1 - 2 * rounded)
    swap = int(np.argmin(np.abs(over + change))) if len(change) else 0
    if len(change) and abs(over + change[swap]) < abs(over):
        rounded[swap] = 1 - rounded[swap]
    return list(rounded)


def decide(docs: DataFrame, ident: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """How often each document goes into the mix.

    Returns ``ident``, ``text_key`` (64-bit hash of the text), ``source``, size, repeats (rows that agree
    in all of these), source_size, target, copies, more: each of these rows goes in ``copies`` times, and
    ``more`` of them once more.

    A source takes every document ``floor(target / size)`` times, and once more with the fractional
    chance; the cube method picks who, in blocks of about ``BLOCK`` documents of one source. Of r equal
    rows with chance p the whole part of r * p is certain, and one row stands for the rest of it, so it is
    rows that are balanced, whatever they repeat. Each block leaves two open documents at most; these meet
    in larger blocks, and the last two of a source are rounded. So the words of a source differ from its
    target by less than two documents.

    Null text is empty, and empty texts have size 0. A null source is a source. A source without words
    has target 0. Draws depend on ids and texts only, so reruns agree. An empty table gives no rows.
    """
    sized = docs.select(
        F.col(ident).alias("ident"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key"),
        F.col(source).alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    units = written(sized.groupBy("ident", "text_key", "source", "size").agg(F.count("*").alias("repeats")), "units")
    targets = written(source_targets(units), "targets")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    blocks = F.ceil(F.col("documents") / BLOCK)
    joined = units.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    certain = F.col("repeats") * (share - F.floor(share))
    open_ = joined.select(
        "ident", "text_key", "source_no", "size", "repeats",
        F.floor(share).alias("copies"),
        F.floor(certain).alias("sure"),
        (certain - F.floor(certain)).alias("chance"),
        blocks.alias("blocks"),
        F.pmod(F.xxhash64("ident", "text_key", F.lit(7)), blocks).alias("block"),
    )
    schema = open_.schema

    def fly(level: int):
        def settle(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(["text_key", "ident", "size"], kind="stable", ignore_index=True)
            draw = np.random.default_rng([int(key[0]), int(key[1]), level])
            group = group.iloc[draw.permutation(len(group))].reset_index(drop=True)
            sizes = group["size"].to_numpy(float)
            chances = np.array(flight(list(sizes), list(group["chance"]), draw))
            if int(group["blocks"].iloc[0]) <= 1:
                loose = np.flatnonzero(group["chance"] > EDGE)
                chances[loose] = landed(list(sizes[loose]), list(chances[loose]))
            group["chance"] = chances
            return group

        return settle

    settled, level = None, 0
    while True:
        flown = written(open_.groupBy("source_no", "block").applyInPandas(fly(level), schema), "flight")
        done = flown.where("chance = 0 OR chance = 1 OR blocks <= 1")
        settled = done if settled is None else settled.unionByName(done)
        rest = flown.where("chance > 0 AND chance < 1 AND blocks > 1")
        if rest.isEmpty():
            break
        open_ = rest.withColumn("block", F.floor(F.col("block") / 1024)).withColumn("blocks", F.ceil(F.col("blocks") / 1024))
        level += 1
    more = (F.col("sure") + F.round("chance")).cast("long")
    # All of them once more is one copy more of each.
    every = more >= F.col("repeats")
    decided = settled.select(
        "ident", "text_key", "source_no", "size", "repeats",
        (F.col("copies") + F.when(every, 1).otherwise(0)).cast("long").alias("copies"),
        F.when(every, 0).otherwise(more).cast("long").alias("more"),
    )
    return decided.join(targets, "source_no").select(
        F.col("ident").alias(ident), "text_key", F.col("source").alias(source), "size", "repeats", "source_size", "target", "copies", "more"
    )


def mixed(docs: DataFrame, ident: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as ``decide`` says, with their own columns only, whatever these are called.

    Where only some of several equal rows go in once more, the rows are numbered, ties by nothing: they are equal in all
    that counts here. Such a group may be large, so it is numbered in ranges.
    """
    names = docs.columns
    own = docs.select(
        F.col(f"`{ident}`").alias("i"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("k"), F.col(f"`{source}`").alias("s"),
        F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"),
    )
    choice = decide(docs, ident, text, source).select(
        F.col(ident).alias("ci"), F.col("text_key").alias("ck"), F.col(source).alias("cs"), "copies", "more"
    )
    same = F.col("k").eqNullSafe(F.col("ck")) & F.col("i").eqNullSafe(F.col("ci")) & F.col("s").eqNullSafe(F.col("cs"))
    joined = own.join(choice.where("copies > 0 OR more > 0"), same).select("i", "k", "s", "row", "copies", "more")
    alike = joined.where("more = 0").select("row", "copies")
    some = joined.where("more > 0").withColumn("place", F.xxhash64(F.to_json("row")))
    numbered = row_numbers(some, ["k", "i", "s"], ["place"], "number")
    split = numbered.select("row", (F.col("copies") + F.when(F.col("number") <= F.col("more"), 1).otherwise(0)).alias("copies"))
    each = alike.unionByName(split).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies").cast("long"))))
    return each.select("row.*")
