"""Mixing sources to target weights by subset-sum budget fitting.

A source's budget is its target in words. Whole copies of the source fill it as often as they fit; what is left is filled
by documents chosen once. The choice is made by length: documents are counted by exact length, every length gives its
even share, and a bounded-knapsack dynamic programme over the lengths fits what is then missing, to the word where the
lengths allow it. Which documents of a length are taken is a matter of a seeded hash. What is planned per source is its
table of lengths; documents themselves are only counted and ranked, in classes small enough for one task each.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkweave.llm.store import written

#: Rows of one (source, length) class ranked in one task; larger classes are cut by hash and ranked piece by piece.
CLASS_ROWS = 4096
MOST_COPIES = 3
#: A table of (source, length) classes of this many rows at most is sent to every executor; a longer one is shuffled.
BROADCAST_ROWS = 500_000


def word_count(text: Column) -> Column:
    """Runs of characters other than space and U+0009 to U+000D; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int]) -> DataFrame:
    """(source, source_size, target) for the (source, source_size) rows, one per source.

    Sources by code point, null last, take the weights in turn and share all words by weight. A target stops at
    ``MOST_COPIES`` times its source's size, and the excess is shared anew among the others by weight until none is
    above: sources are capped in the order of cap over weight, and the first that need not be capped gives the level.
    The table holds one row per source, so it is small beside the documents; it is ranked in one task.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = (F.row_number().over(order) - 1) % len(weights)
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int")).cast("long"))
    cap = F.col("source_size") * MOST_COPIES
    by_need = Window.orderBy(cap / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before, everything = by_need.rowsBetween(Window.unboundedPreceding, -1), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    capped_before = F.coalesce(F.sum(cap).over(before), F.lit(0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = (F.sum("source_size").over(everything) - capped_before) / weight_left
    # a source is capped if the level at its turn exceeds its cap; the first that is not has the level of all that follow,
    # and as levels fall from there on, it is the greatest of those that fit
    fits = weighed.withColumn("level", level).withColumn("fits", F.col("level") * F.col("weight") <= cap)
    final = F.max(F.when(F.col("fits"), F.col("level"))).over(everything)
    target = F.least(cap.cast("double"), F.coalesce(final, F.lit(0.0)) * F.col("weight"))
    return fits.withColumn("target", target).select("source", "source_size", "target")


def fit(counts: dict[int, int], budget: int) -> dict[int, int]:
    """How many documents of each length to take, so that their words come as near to the budget as can be from below.

    Each length gives its even share of the budget, and whole documents fill what the shares leave. What is then missing,
    less than a document, is fitted by a bounded-knapsack dynamic programme in which some lengths, the shortest, may
    give a few documents more or fewer. As long as a sum is missed, more lengths are loosened by more documents. Of all
    ways to reach a sum one differs by no more than twice the longest length in documents (longer differences hold a
    part that sums to nothing), so the search ends there at the latest, and what it has found is the best.
    """
    counts = {length: n for length, n in counts.items() if length > 0 and n > 0}
    total = sum(length * n for length, n in counts.items())
    if budget <= 0 or total <= 0:
        return {}
    if budget >= total:
        return dict(counts)
    taken = {length: n * budget // total for length, n in counts.items()}
    missing = budget - sum(length * n for length, n in taken.items())
    # the largest remainders first; equal ones, as all lengths of one document have, in an order that favours no length
    for length in sorted(counts, key=lambda x: (-(counts[x] * budget % total), x * 2654435761 % 2**32, x)):
        if taken[length] < counts[length] and length <= missing:
            taken[length] += 1
            missing -= length
    for length in sorted(counts, reverse=True):
        more = min(counts[length] - taken[length], missing // length)
        taken[length] += more
        missing -= more * length
    least = budget % math.gcd(*counts)  # sums are multiples of what all lengths share
    lengths, loose, room = sorted(counts), 6, 2
    while missing > least:
        chosen = lengths[:loose]
        taken, missing = _loosened(counts, taken, missing, chosen, room)
        if loose >= len(lengths) and (room > 2 * lengths[-1] or all(room >= counts[x] for x in lengths)):
            break
        loose, room = 2 * loose, 4 * room
    return {length: n for length, n in taken.items() if n}


def _loosened(counts: dict[int, int], taken: dict[int, int], missing: int, chosen: list[int], room: int) -> tuple[dict[int, int], int]:
    """The best that the chosen lengths can do if each gives up to ``room`` documents more or fewer than it does."""
    back = {length: min(taken[length], room) for length in chosen}
    start = missing + sum(length * n for length, n in back.items())
    # sums that can be reached are bits of a number; a length's copies are offered in powers of two and a remainder
    reach, mask = 1, (1 << (start + 1)) - 1
    steps: list[tuple[int, int, int]] = []
    for length in reversed(chosen):
        left, block = min(back[length] + min(counts[length] - taken[length], room), start // length), 1
        while left > 0 and not (reach >> start) & 1:
            n = min(block, left)
            steps.append((length, n, reach))
            reach |= (reach << (length * n)) & mask
            left -= n
            block *= 2
    at = reach.bit_length() - 1
    missed, found = start - at, {**taken, **{length: taken[length] - n for length, n in back.items()}}
    for length, n, before in reversed(steps):
        if not (before >> at) & 1:
            at -= length * n
            found[length] += n
    return found, missed


def _plan(rows: pd.DataFrame) -> pd.DataFrame:
    """For each length of one source: whole copies of every document, and how many documents are taken once more."""
    size, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
    budget = round(target)
    copies = min(MOST_COPIES, budget // size) if size else 0
    once = fit(dict(zip(rows["size"].tolist(), rows["documents"].tolist(), strict=True)), budget - copies * size if copies < MOST_COPIES else 0)
    return rows[["number", "size"]].assign(copies=copies, once=[once.get(s, 0) for s in rows["size"].tolist()])


def mix(
    documents: DataFrame,
    *,
    weights: Sequence[int] = (5, 2, 1),
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = 7,
) -> DataFrame:
    """The rows and columns of ``documents`` with ``mix_size``, ``mix_source_size``, ``mix_target`` and ``mix_taken``.

    ``mix_size`` is the words of the text, ``mix_target`` the words that the source shall give, ``mix_taken`` the words
    that the mix takes from this document, repeats counted: 0 to 3 times its size. A source's taken words come to its
    target as nearly as whole documents can, and never beyond it by more than rounding.

    A null text has no words; a null source is a source of its own, the last. Rows without words are never taken. The
    draw is a hash of id and text, so reruns agree; rows repeated in both share a draw and are chosen together or not
    at all. All other columns are handed through, whatever their names (unless they begin with ``mix_``). An empty
    table stays empty.
    """
    names = documents.columns
    text = F.col(f"`{text_col}`").cast("string")
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), F.xxhash64(text)), 1)
    mixed = documents.withColumns(
        {"mix_source": F.col(f"`{source_col}`").cast("string"), "mix_size": word_count(text), "mix_draw": draw}
    )
    drawn = mixed.select(F.col("mix_source").alias("source"), F.col("mix_size").alias("size"), F.col("mix_draw").alias("draw"))
    drawn = written(drawn, "draws")
    lengths = written(drawn.groupBy("source", "size").agg(F.count("*").alias("documents")), "lengths")
    sizes = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("documents")).alias("source_size"))
    # sources by number, so that a null one groups and joins like any other
    shares = written(targets(sizes, weights).withColumn("number", F.monotonically_increasing_id()), "targets")
    planned = lengths.join(shares, lengths["source"].eqNullSafe(shares["source"])).drop(lengths["source"])
    plan = planned.groupBy("number").applyInPandas(lambda pdf: _plan(pdf), "number long, size long, copies long, once long")
    pieces = F.ceil(F.col("documents") / CLASS_ROWS).cast("long")
    classes = written(planned.join(plan, ["number", "size"]).withColumn("pieces", pieces), "length-classes")
    limits = classes.join(_limits(drawn, classes), ["number", "size"], "left").select(
        F.col("source").alias("mix_class_source"), F.col("size").alias("mix_class_size"),
        F.col("copies").alias("mix_copies"), F.col("limit").alias("mix_limit"),
        F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"),
    )
    limits = written(limits, "draw-limits")
    limits = F.broadcast(limits) if limits.count() <= BROADCAST_ROWS else limits
    found = mixed.join(limits, F.col("mix_source").eqNullSafe(F.col("mix_class_source")) & (F.col("mix_size") == F.col("mix_class_size")))
    times = F.col("mix_copies") + F.when(F.col("mix_draw") <= F.col("mix_limit"), 1).otherwise(0)
    return found.select(
        *[F.col(f"`{c}`") for c in names], "mix_size", "mix_source_size", "mix_target", (F.col("mix_size") * times).alias("mix_taken")
    )


def _limits(drawn: DataFrame, classes: DataFrame) -> DataFrame:
    """(number, size, limit): the greatest draw of each class up to which no more documents lie than are wanted."""
    wanted = classes.where("once > 0").select(F.col("source").alias("s"), F.col("size").alias("z"), "number", "once", "pieces")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    rows = drawn.join(wanted, drawn["source"].eqNullSafe(F.col("s")) & (drawn["size"] == F.col("z")))
    # pieces are ranges of the draw, so a class of any number of rows is counted before it and ranked within one
    piece = F.expr(f"least(draw div ({2**63 - 1} div pieces), pieces - 1)")
    rows = rows.select("number", "size", "once", "draw", piece.alias("piece"))
    held = rows.groupBy("number", "size", "once", "piece").agg(F.count("*").alias("held"))
    before = Window.partitionBy("number", "size").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("before", F.coalesce(F.sum("held").over(before), F.lit(0)))
    last = held.where("before < once").groupBy("number", "size").agg(F.max(F.struct("piece", "before")).alias("last"))
    last = last.select("number", "size", F.col("last.piece").alias("piece"), F.col("last.before").alias("before"))
    ranked = rows.join(last, ["number", "size", "piece"]).withColumn(
        "place", F.col("before") + F.count("*").over(Window.partitionBy("number", "size", "piece").orderBy("draw"))
    )
    within = ranked.where("place <= once").groupBy("number", "size").agg(F.max("draw").alias("limit"))
    # if the last piece gives none, the pieces before it are what is taken
    bound = last.select("number", "size", "piece").join(classes.select("number", "size", "pieces"), ["number", "size"])
    start = bound.select("number", "size", F.expr(f"piece * ({2**63 - 1} div pieces) - 1").alias("start"))
    return start.join(within, ["number", "size"], "left").select("number", "size", F.coalesce("limit", "start").alias("limit"))
