"""Approximate nearest neighbours by inner product: balanced posting lists.

Vectors are brought to one length by one more component, so that the largest inner product is the least distance. A
bounded sample is halved again and again into clusters of about one size; where there are more vectors, each cluster is
halved further on a sample of its own, by the tasks, so that centres grow with the rows and lists keep their length. The
centres form a graph of near centres, which is what a task holds in memory and walks from the nearest of its entries;
as long as they are few, one matrix product sees them all for less than the walk costs, and finds no fewer. Every vector
goes to the list of its nearest centre, and a boundary vector to others nearly as near as well, unless these lie closer
to one another than to it. A query reads the lists whose centres are at most ``REACH`` times as far as the nearest one.
Neighbouring lists are read together, in groups of a task's size, from which a query takes its nearest once; a list that
holds a third of all vectors, and the queries that read a group, are cut into blocks, which are many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkweave.llm.store import written

SAMPLE_ROWS = 20_000
LIST_ROWS = 256
#: Centres that the driver fits, and centres in all, which every task holds: 65,536 of 64 numbers are 34 MB.
FIRST_CENTRES, MOST_CENTRES = 2048, 1 << 16
#: Sample rows of a cluster for each centre that it is cut into.
SAMPLE_EACH = 32
#: Up to so many centres are looked at one and all; more are walked to by the graph.
FULL_LOOK = 4096
NEAR = 24
REPLICAS = 6
#: A vector is replicated to centres at most this much farther than its nearest; a query reads lists this much farther.
BOUNDARY, REACH = 1.1, 1.25
#: At least so many lists are read; so many centres are kept in view on a walk, and so many entered from at a step.
LEAST_LISTS, VIEW, STEP = 4, 192, 4
#: Vectors of a group of lists, or of a piece of a longer list, and queries that meet them in one task.
VECTOR_BLOCK, QUERY_BLOCK = 8192, 2048


@dataclass(frozen=True)
class Centres:
    """Cluster centres (of augmented vectors), each with its near centres, and the entries from which a search starts."""

    points: np.ndarray
    near: np.ndarray
    entries: np.ndarray
    radius: float

    def augmented(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.radius**2 - (vectors**2).sum(axis=1), 0.0))
        return np.concatenate([vectors, rest[:, None]], axis=1)

    def nearest(self, vectors: np.ndarray, view: int) -> tuple[np.ndarray, np.ndarray]:
        """For each augmented vector the ``view`` nearest centres found, nearest first, and their distances (inf: none)."""
        if len(self.points) > FULL_LOOK:
            ids, far = self._walked(vectors, min(view, VIEW))
        else:
            far = (vectors**2).sum(axis=1)[:, None] + (self.points**2).sum(axis=1)[None, :] - 2 * vectors @ self.points.T
            view = min(view, far.shape[1])
            ids = np.argpartition(far, view - 1, axis=1)[:, :view] if view < far.shape[1] else np.broadcast_to(np.arange(view), far.shape)
            far = np.take_along_axis(far, ids, axis=1)
        order = np.argsort(far, axis=1, kind="stable")
        return np.take_along_axis(ids, order, axis=1), np.sqrt(np.maximum(np.take_along_axis(far, order, axis=1), 0.0))

    def _walked(self, vectors: np.ndarray, view: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centres by walking the graph: of each vector a view of bounded length, however many centres there are."""
        square, own = (self.points**2).sum(axis=1), (vectors**2).sum(axis=1)

        def gaps(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
            out = np.empty(centres.shape)
            for at in range(0, len(rows), 128):  # few at a time: each takes its centres' points along
                r, c = rows[at : at + 128], centres[at : at + 128]
                out[at : at + 128] = own[r][:, None] + square[c] - 2 * np.einsum("id,ijd->ij", vectors[r], self.points[c])
            return out

        n = len(vectors)
        first = own[:, None] + square[self.entries] - 2 * vectors @ self.points[self.entries].T
        ids, far, seen = (np.full((n, view), x) for x in (-1, np.inf, True))
        width = min(view, len(self.entries))
        best = np.argsort(first, axis=1, kind="stable")[:, :width]
        ids[:, :width], far[:, :width], seen[:, :width] = self.entries[best], np.take_along_axis(first, best, axis=1), False
        live = np.arange(n)
        while len(live):
            order = np.argsort(np.where(seen[live], np.inf, far[live]), axis=1, kind="stable")[:, :STEP]
            fresh = ~np.take_along_axis(seen[live], order, axis=1)
            live, order, fresh = live[fresh[:, 0]], order[fresh[:, 0]], fresh[fresh[:, 0]]
            if not len(live):
                break
            from_ = np.where(fresh, np.take_along_axis(ids[live], order, axis=1), ids[live[:, None], order[:, :1]])
            seen[live[:, None], order] = True
            around = self.near[from_].reshape(len(live), -1)
            both_ids = np.concatenate([ids[live], around], axis=1)
            both_far = np.concatenate([far[live], gaps(live, around)], axis=1)
            both_seen = np.concatenate([seen[live], np.zeros(around.shape, bool)], axis=1)
            by_id = np.argsort(both_ids, axis=1, kind="stable")  # what is in view comes before the same centre met again
            sorted_ids = np.take_along_axis(both_ids, by_id, axis=1)
            again = np.zeros(sorted_ids.shape, bool)
            again[:, 1:] = sorted_ids[:, 1:] == sorted_ids[:, :-1]
            np.put_along_axis(both_far, by_id, np.where(again, np.inf, np.take_along_axis(both_far, by_id, axis=1)), axis=1)
            keep = np.argpartition(both_far, view - 1, axis=1)[:, :view]
            far[live] = np.take_along_axis(both_far, keep, axis=1)
            ids[live] = np.where(np.isfinite(far[live]), np.take_along_axis(both_ids, keep, axis=1), -1)
            seen[live] = np.take_along_axis(both_seen, keep, axis=1) | ~np.isfinite(far[live])
        return ids, far


def halved(points: np.ndarray, centres: int) -> np.ndarray:
    """Centres of clusters of about equal size: a cluster is halved by two means until there are enough."""
    if not len(points):
        return np.zeros((1, points.shape[1]))
    rng = np.random.default_rng(5)
    groups, most = [np.arange(len(points))], max(1, -(-len(points) // centres))
    done = []
    while groups:
        group = groups.pop()
        if len(group) <= most:
            done.append(group)
            continue
        own = points[group]
        a, b = own[rng.choice(len(own), 2, replace=False)]
        for _ in range(8):
            lean = ((own - b) ** 2).sum(axis=1) - ((own - a) ** 2).sum(axis=1)
            half = np.zeros(len(own), bool)
            # both sides get a third at least, so that lists stay balanced
            low, high = np.quantile(lean, [1 / 3, 2 / 3])
            half = lean > np.clip(0.0, low, high)
            if not 0 < half.sum() < len(own):
                half = np.arange(len(own)) % 2 == 0
            a, b = own[half].mean(axis=0), own[~half].mean(axis=0)
        groups += [group[half], group[~half]]
    return np.stack([points[g].mean(axis=0) for g in done])


def near_centres(points: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The nearest centres of some of the centres, themselves among them."""
    width = min(NEAR, len(points))
    square, out = (points**2).sum(axis=1), []
    for at in range(0, len(rows), 256):
        gap = square[None, :] - 2 * points[rows[at : at + 256]] @ points.T
        found = np.argpartition(gap, width - 1, axis=1)[:, :width]
        out.append(np.take_along_axis(found, np.argsort(np.take_along_axis(gap, found, axis=1), axis=1, kind="stable"), axis=1))
    return np.concatenate(out) if out else np.zeros((0, width), int)


def linked(points: np.ndarray, near: np.ndarray, radius: float) -> Centres:
    """The graph of centres, with entries spread over them, so that every region is reached."""
    entries, gap = [0], ((points - points[0]) ** 2).sum(axis=1)
    while len(entries) < min(64, len(points)):
        entries.append(int(gap.argmax()))
        gap = np.minimum(gap, ((points - points[entries[-1]]) ** 2).sum(axis=1))
    return Centres(points, near, np.unique(entries), radius)


def fit(sample: np.ndarray, centres: int, radius: float) -> Centres:
    """Centres and their graph from one sample."""
    points = halved(Centres(np.zeros((0, 0)), np.zeros((0, 0), int), np.zeros(0, int), radius).augmented(sample), centres)
    return linked(points, near_centres(points, np.arange(len(points))), radius)


# --- on Spark -----------------------------------------------------------------------------------------------


def _usable(vectors: DataFrame, queries: Column, id_col: str, vector_col: str) -> DataFrame:
    """(row, id, asked, v) of the vectors that can be compared: one dimension, finite, not zero, with an id."""
    v = F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double"))
    rows = vectors.select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(queries, F.lit(False)).alias("asked"), v.alias("v")
    )
    rows = rows.where("id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")
    rows = written(rows.where("exists(v, x -> x <> 0)"), "vectors")
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (sizes["n"] if sizes else 0))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _pieces(batches, rows: int = 1024):
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)


def _centres(rows: DataFrame, size: int, radius: float) -> Centres:
    """Centres in proportion to the rows: a first fit on the driver, and where that is too few, one of each of its clusters."""
    wanted = int(np.clip(size // LIST_ROWS, 1, MOST_CENTRES))
    sample = rows.orderBy(F.xxhash64("id"), "id", "row").limit(SAMPLE_ROWS).select("v").toArrow()
    first = fit(_matrix(sample["v"]), min(wanted, FIRST_CENTRES), radius)
    if wanted <= FIRST_CENTRES:
        return first
    each = -(-wanted // len(first.points))
    share = min(1.0, 2 * SAMPLE_EACH * each * len(first.points) / size)
    drawn = rows.where(F.pmod(F.xxhash64("row"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1))

    def near(batches):
        for batch in _pieces(batches):
            place = first.nearest(first.augmented(_matrix(batch.column(1))), 1)[0][:, 0]
            yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int64)), *batch.columns], names=["list", "row", "v"])

    def cut(key: tuple, table: pa.Table) -> pa.Table:
        # a hot cluster has more sample rows than it needs: those with the first numbers
        own = table.sort_by("row").slice(0, 4 * SAMPLE_EACH * each)
        points = halved(first.augmented(_matrix(own["v"])), min(each, own.num_rows))
        columns = [pa.array([key[0].as_py()] * len(points)), pa.array(range(len(points)), pa.int32()), pa.array(points.tolist(), pa.list_(pa.float64()))]
        return pa.table(columns, names=["list", "place", "point"])

    placed = drawn.select("row", "v").mapInArrow(near, "list long, row long, v array<double>").groupBy("list").applyInArrow(cut, "list long, place int, point array<double>")
    # neighbours keep numbers next to one another; MOST_CENTRES at most, or so
    points = np.array([r["point"] for r in sorted(placed.collect(), key=lambda r: (r["list"], r["place"]))])

    def link(batches):
        for batch in _pieces(batches):
            found = near_centres(points, batch.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.tolist(), pa.list_(pa.int64()))], names=["id", "near"])

    links = rows.sparkSession.range(len(points)).mapInArrow(link, "id long, near array<long>").collect()
    return linked(points, np.array([r["near"] for r in sorted(links)]), radius)


def _placed(rows: DataFrame, centres: Centres) -> DataFrame:
    """(list, row, id, v): a row for each list that a vector belongs to."""

    def place(batches):
        for batch in _pieces(batches):
            found, far = centres.nearest(centres.augmented(_matrix(batch.column(2))), REPLICAS)
            chosen = far <= far[:, :1] * BOUNDARY
            chosen[:, 0] = True
            for j in range(1, found.shape[1]):
                for i in range(j):  # a centre closer to a chosen one than to the vector adds nothing new
                    gap = np.sqrt(((centres.points[found[:, j]] - centres.points[found[:, i]]) ** 2).sum(axis=1))
                    chosen[:, j] &= ~(chosen[:, i] & (gap < far[:, j]))
            row, column = np.nonzero(chosen)
            taken = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(found[row, column].astype(np.int64)), *(c.take(taken) for c in batch.columns)], names=["list", "row", "id", "v"])

    return rows.select("row", "id", "v").mapInArrow(place, "list long, row long, id long, v array<double>")


def _grouped(held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each list, and the blocks of its group: neighbouring lists up to a block together, longer ones alone."""
    group, blocks, number, total = np.zeros(len(held), np.int64), np.ones(len(held), np.int64), 0, 0
    for i, n in enumerate(held.tolist()):
        if total and total + n > VECTOR_BLOCK:
            number, total = number + 1, 0
        group[i], total = number, total + n
        if n > VECTOR_BLOCK:
            blocks[i] = -(-n // VECTOR_BLOCK)
            number, total = number + 1, 0
    return group, blocks


def _reads(queries: DataFrame, centres: Centres, held: np.ndarray, group: np.ndarray, k: int) -> DataFrame:
    """(group, lists, row, id, v): the lists of a group that a query reads: all in reach, and so many that ``k`` others
    are in them."""

    def place(batches):
        for batch in _pieces(batches):
            plain = _matrix(batch.column(2))
            # the added component of a query is none, so that only inner products order the vectors
            found, far = centres.nearest(np.concatenate([plain, np.zeros((len(plain), 1))], axis=1), len(centres.points))
            chosen = far <= far[:, :1] * REACH
            chosen[:, :LEAST_LISTS] = True
            chosen |= np.cumsum(held[found], axis=1) - held[found] < REPLICAS * (k + 1)  # a vector lies in REPLICAS lists at most
            row, column = np.nonzero(chosen & np.isfinite(far))
            lists = found[row, column]
            order = np.lexsort((lists, group[lists], row))
            row, lists = row[order], lists[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (group[lists][1:] != group[lists][:-1])
            begins = np.flatnonzero(new)
            taken, cuts = pa.array(row[begins]), pa.array(np.append(begins, len(row)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(group[lists[begins]]), pa.ListArray.from_arrays(cuts, pa.array(lists.astype(np.int64))), *(c.take(taken) for c in batch.columns)],
                names=["group", "lists", "row", "id", "v"],
            )

    return queries.select("row", "id", "v").mapInArrow(place, "group long, lists array<long>, row long, id long, v array<double>")


_FOUND = "query long, query_id long, row long, id long, score double"
_NEAREST = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("row", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])


def _nearest(vectors: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """The k best for each query of a block's vectors in the lists that it reads, scored in double precision from left
    to right. A vector that lies in several of these lists is seen once."""
    if not vectors.num_rows or not queries.num_rows:
        return _NEAREST.empty_table()
    rows, ids, points = vectors["row"].to_numpy(), vectors["id"].to_numpy(), _matrix(vectors["v"])
    numbers, names, asked = queries["row"].to_numpy(), queries["id"].to_numpy(), _matrix(queries["v"])
    lists, of = np.unique(vectors["list"].to_numpy(), return_inverse=True)
    wanted = queries["lists"].combine_chunks()
    which, place = np.repeat(np.arange(len(names)), wanted.value_lengths().to_numpy()), np.searchsorted(lists, wanted.flatten().to_numpy())
    there = place < len(lists)
    there[there] = lists[place[there]] == wanted.flatten().to_numpy()[there]
    reads = np.zeros((len(names), len(lists)), bool)
    reads[which[there], place[there]] = True
    out = []
    for begin in range(0, len(names), 256):
        rough = np.where(reads[begin : begin + 256][:, of], asked[begin : begin + 256] @ points.T, -np.inf)
        most = REPLICAS * (k + 1)  # a query finds itself as well, and a vector in several lists; and all that rounding could swap
        if len(ids) > most:
            bound = np.partition(rough, len(ids) - most, axis=1)[:, len(ids) - most]
            bound = np.where(np.isfinite(bound), bound - 1e-9 * np.maximum(1, np.abs(bound)), np.finfo(float).min)
            row, column = np.nonzero(rough >= bound[:, None])
        else:
            row, column = np.nonzero(np.isfinite(rough))
        other = numbers[begin + row] != rows[column]
        row, column = row[other], column[other]
        score = np.add.accumulate(asked[begin + row] * points[column], axis=1)[:, -1]
        order = np.lexsort((rows[column], ids[column], -score, row))
        row, column, score = row[order], column[order], score[order]
        once = np.ones(len(row), bool)
        once[1:] = (row[1:] != row[:-1]) | (rows[column][1:] != rows[column][:-1])
        row, column, score = row[once], column[once], score[once]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        best = place < k
        at = begin + row[best]
        out.append((numbers[at], names[at], rows[column[best]], ids[column[best]], score[best]))
    return pa.Table.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], schema=_NEAREST)


def search(
    vectors: DataFrame, queries: Column, *, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", exact: bool = False
) -> DataFrame:
    """(query_id, rank, id, score): for each row where ``queries`` holds its ``k`` nearest others found, by inner product.

    The score is the inner product in double precision; ties go to the smaller id. The index is fitted on samples of
    bounded size and holds every vector. ``exact`` compares all queries with all vectors instead, in blocks, which costs
    their product: it misses nothing. A query finds fewer than ``k`` only if there are no more.

    Every row is a vector of its own: rows that share an id are candidates of one another, and queries each. Vectors
    that are null or zero, or hold a null or a number that is not finite, take no part, nor does a row without an id or
    of another dimension than most rows. Other columns are left out, apart from those that ``queries`` reads; an empty
    table gives an empty result.
    """
    rows = _usable(vectors, queries, id_col, vector_col)
    size, radius = rows.agg(F.count("*"), F.sqrt(F.max(F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x)))).first()
    if not size:
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), "id", F.lit(0.0).alias("score"))
    asked = rows.where("asked")
    spark = rows.sparkSession
    if exact:
        lists = rows.select(F.lit(0).cast("long").alias("list"), *[F.col(c).alias(c) for c in ("row", "id", "v")])
        reads = asked.select(F.lit(0).cast("long").alias("group"), F.lit([0]).cast("array<long>").alias("lists"), *[F.col(c).alias(c) for c in ("row", "id", "v")])
        group, blocks = np.zeros(1, np.int64), np.array([-(-size // VECTOR_BLOCK)])
    else:
        centres = _centres(rows, size, radius)
        lists = written(_placed(rows, centres), "posting-lists")
        held = np.zeros(len(centres.points), np.int64)
        for r in lists.groupBy("list").count().collect():  # a row per centre
            held[r["list"]] = r["count"]
        group, blocks = _grouped(held)
        reads = written(_reads(asked, centres, held, group, k), "list-reads")

    # all have a row per centre at most
    turns = reads.groupBy("group").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("turns"))
    pieces = spark.createDataFrame(sorted(set(zip(group.tolist(), blocks.tolist(), strict=True))), "group long, blocks int")
    cuts = turns.join(F.broadcast(pieces), "group")
    named = spark.createDataFrame(list(enumerate(group.tolist())), "list long, group long")
    one = lists.join(F.broadcast(named), "list").join(F.broadcast(cuts), "group").select(
        "group", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int").alias("block"), F.explode(F.expr("sequence(0, turns - 1)")).alias("turn"), "list", "row", "id", "v"
    )
    two = reads.join(F.broadcast(cuts), "group").select(
        "group", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), F.pmod(F.xxhash64("row"), F.col("turns")).cast("int").alias("turn"), "lists", "row", "id", "v"
    )
    keys = ("group", "block", "turn")
    found = one.groupBy(*keys).cogroup(two.groupBy(*keys)).applyInArrow(lambda a, b: _nearest(a, b, k), _FOUND)
    # a replicated vector is found more than once, with one score
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id", "row")
    ranked = found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "score")
