"""Language identification by nearest centroid over TF-IDF byte n-grams.

A text's vector counts the hashed two- and three-byte sequences of its letters (words apart by one space, A-Z in lower
case), weighted by TF-IDF and brought to unit length. Each language has several centroids, found by spherical k-means on
a bounded sample, so that a language of several kinds of text is not one blurred point. A text gets the language of the
centroid with the greatest cosine; one that is farther from it than nearly all the texts that the centroid was made of is
marked as rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkweave.llm.bytehash import Texts, slices
from inkweave.llm.store import written

UNKNOWN = "und"
DIMENSIONS = 4096
#: Texts that are counted together: so many bytes, and so many texts, as each has DIMENSIONS numbers.
_PIECE_BYTES, _PIECE_ROWS = 256 << 10, 128
#: Ranges that ids' hashes are counted in, to find those with the least hash without ranking all.
_RANGES = 4096
#: Ids to learn from up to which they are sent to every executor, so that no text is shuffled to find them.
BROADCAST_ROWS = 200_000
_LETTER = np.full(256, 32, np.uint32)
_LETTER[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LETTER[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LETTER[128:] = np.arange(128, 256)


def counts(texts: Texts) -> np.ndarray:
    """(text, dimension) counts of hashed two- and three-byte sequences within each text."""
    n, data = len(texts), _LETTER[texts.data]
    owner = np.repeat(np.arange(n), np.diff(texts.offsets))
    total = np.zeros(n * DIMENSIONS)
    for width in (2, 3):
        if len(data) < width:
            continue
        value = data[: len(data) - width + 1].copy()
        for k in range(1, width):
            value = value * np.uint32(257) + data[k : len(data) - width + 1 + k]
        value = ((value + np.uint32(width)) * np.uint32(2654435761)) >> np.uint32(20)
        whole = (owner[: len(value)] == owner[width - 1 :]) & ~((data[: len(value)] == 32) & (data[1 : len(value) + 1] == 32))
        total += np.bincount(owner[: len(value)][whole] * DIMENSIONS + value[whole], minlength=len(total))
    return total.reshape(n, DIMENSIONS)


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.sqrt((rows**2).sum(axis=-1, keepdims=True)), 1e-12)


@dataclass(frozen=True)
class Centroids:
    """Unit centroids with their languages, the inverse document frequencies, and each centroid's least cosine."""

    languages: list[str]
    points: np.ndarray
    idf: np.ndarray
    floor: np.ndarray

    def vectors(self, counted: np.ndarray) -> np.ndarray:
        return unit(np.log1p(counted) * self.idf)

    def nearest(self, counted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cosine = self.vectors(counted) @ self.points.T
        best = cosine.argmax(axis=1)
        return best, np.clip(cosine[np.arange(len(best)), best], 0.0, 1.0)


def cluster(vectors: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts from the first vector and the ones farthest from those chosen."""
    chosen = [0]
    near = vectors @ vectors[0]
    while len(chosen) < min(k, len(vectors)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, vectors @ vectors[chosen[-1]])
    points = vectors[chosen]
    for _ in range(rounds):
        best = (vectors @ points.T).argmax(axis=1)
        sums = np.zeros_like(points)
        np.add.at(sums, best, vectors)
        points = np.where(sums.any(axis=1, keepdims=True), unit(sums), points)
    return points


def train(
    documents: DataFrame,
    learn: Column,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    max_per_language: int = 600,
    centroids: int = 4,
    floor_quantile: float = 0.005,
) -> Centroids:
    """Centroids of the languages of the rows where ``learn`` holds.

    Learns from ``max_per_language`` rows of each language at most, those with the least hash of their id; rows with a
    null id, text or language, or an empty text, do not count. No rows give no centroids: all texts are then unknown.
    A language's texts are clustered in one task; the driver holds the centroids alone.
    """
    usable = documents.where(learn).select(
        F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")
    )
    usable = usable.where("id is not null and lang is not null and text rlike '\\\\p{L}'")
    picked = written(_least(usable.select("id", "lang"), max_per_language), "learned-ids")
    picked = F.broadcast(picked) if picked.count() <= BROADCAST_ROWS else picked
    chosen = written(usable.join(picked, ["id", "lang"], "left_semi"), "learned-texts")

    def counted(batches):
        for batch in batches:
            for table in slices(batch, "text", _PIECE_BYTES, _PIECE_ROWS):
                rows = counts(Texts.of(table["text"])).astype(np.float32)
                yield pa.RecordBatch.from_arrays(
                    [table["id"].combine_chunks(), table["lang"].combine_chunks(), pa.array([r.tobytes() for r in rows], pa.binary())],
                    names=["id", "lang", "counts"],
                )

    def frequencies(batches):
        total, n = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            for table in slices(batch, "text", _PIECE_BYTES, _PIECE_ROWS):
                rows = counts(Texts.of(table["text"]))
                total, n = total + (rows > 0).sum(axis=0), n + len(rows)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tolist()], pa.list_(pa.int64()))], names=["n", "held"])

    # one row of each task; the texts stay where they are
    parts = chosen.mapInArrow(frequencies, "n long, held array<bigint>").collect()
    n = sum(r["n"] for r in parts)
    if not n:
        return Centroids([], np.zeros((0, DIMENSIONS)), np.ones(DIMENSIONS), np.zeros(0))
    idf = np.log((1 + n) / (1 + np.sum([r["held"] for r in parts], axis=0))) + 1

    def learned(key: tuple, table: pa.Table) -> pa.Table:
        """One language's centroids, from its ``max_per_language`` rows."""
        order = np.argsort(table["id"].to_numpy(), kind="stable")
        rows = np.frombuffer(b"".join(table["counts"].to_pylist()), np.float32).reshape(-1, DIMENSIONS)[order]
        own = unit(np.log1p(rows) * idf)
        points = cluster(own, centroids)
        cosine = own @ points.T
        best = cosine.argmax(axis=1)
        members = [cosine[best == j, j] for j in range(len(points))]
        floor = [float(np.quantile(m, floor_quantile)) if len(m) else 1.0 for m in members]
        columns = [pa.array([key[0].as_py()] * len(points), pa.string()), pa.array(range(len(points)), pa.int32()), pa.array(points.tolist(), pa.list_(pa.float64())), pa.array(floor, pa.float64())]
        return pa.table(columns, names=["lang", "place", "point", "floor"])

    grouped = chosen.mapInArrow(counted, "id long, lang string, counts binary").groupBy("lang")
    found = grouped.applyInArrow(learned, "lang string, place int, point array<double>, floor double").collect()
    found.sort(key=lambda r: (r["lang"], r["place"]))
    return Centroids([r["lang"] for r in found], np.array([r["point"] for r in found]), idf, np.array([r["floor"] for r in found]))


def _least(ids: DataFrame, most: int) -> DataFrame:
    """(id, lang): of each language the ``most`` rows with the least hash of their id.

    Ids are counted by ranges of their hash first, with a map-side combine, so that only the few that lie in a language's
    first ranges are ranked, however many rows and partitions there are.
    """
    hashed = ids.withColumn("hash", F.xxhash64("id"))
    ranged = hashed.withColumn("range", F.shiftright("hash", 64 - _RANGES.bit_length() + 1))
    held = ranged.groupBy("lang", "range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("lang").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    needed = held.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("before") < most)
    last = needed.groupBy("lang").agg(F.max("range").alias("last"))
    near = ranged.join(F.broadcast(last), "lang").where("range <= last")  # a row per language, as the model has
    first = Window.partitionBy("lang").orderBy("hash", "id")
    ranked = near.withColumn("place", F.row_number().over(first)).where(F.col("place") <= most)
    return ranked.select("id", "lang").distinct()


def identify(documents: DataFrame, model: Centroids, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every input row's ``id``, ``lang_pred``, ``score`` (cosine, 0 to 1) and ``rejected``.

    ``lang_pred`` is the nearest centroid's language, or ``und`` with a score of 0 if the text is null or has no
    letter, or nothing was learned. ``rejected`` says that the text is farther from the centroid than nearly all the
    texts behind it, or ``und``; what becomes of such rows is the caller's decision. The text alone decides, so
    repeated rows agree. Other columns are left out; an empty table gives an empty result.
    """
    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))

    def identified(batches):
        for batch in batches:
            for table in slices(batch, "text", _PIECE_BYTES, _PIECE_ROWS):
                known = table["letters"].to_numpy() & bool(model.languages)
                names, score, rejected = [UNKNOWN] * table.num_rows, np.zeros(table.num_rows), np.ones(table.num_rows, bool)
                if known.any():
                    best, cosine = model.nearest(counts(Texts.of(table["text"])))
                    names = [model.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)]
                    score = np.where(known, cosine, 0.0)
                    rejected = ~known | (cosine < model.floor[best])
                yield pa.RecordBatch.from_arrays(
                    [table["id"].combine_chunks(), pa.array(names, pa.string()), pa.array(score), pa.array(rejected)],
                    names=["id", "lang_pred", "score", "rejected"],
                )

    return rows.mapInArrow(identified, "id long, lang_pred string, score double, rejected boolean")
