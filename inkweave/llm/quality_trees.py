"""A quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are vector operations over a byte buffer. Trees are grown on the binned statistics of a
bounded sample of labelled documents and kept as flat arrays, one row of nodes per tree in heap order; scoring walks
all trees of all documents of a batch at once, one array step per level. Scoring reads each text once, in one stage
without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkweave.llm.bytehash import RollingHash, Texts, slices, words

_ROLLING = RollingHash(131)
_PIECE_BYTES = 512 << 10

# byte classes: letters by case, digits, white space, and the marks that junk is rich in
_CLASSES = ("lower", "upper", "digit", "space", "newline", "stop", "loud", "bar", "sign", "other", "beyond")
_CLASS = np.full(256, _CLASSES.index("other"), np.uint8)
for _name, _bytes in {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "space": b" \t\r\x0b\x0c",
    "newline": b"\n",
    "stop": b".,;:",
    "loud": b"!?",
    "bar": b"|<>{}[]\\/",
    "sign": b"#$%&*@^~=_+",
}.items():
    _CLASS[list(_bytes)] = _CLASSES.index(_name)
_CLASS[128:] = _CLASSES.index("beyond")
_NEWLINE = np.zeros(256, bool)
_NEWLINE[[0x0A, 0x0D]] = True

STATISTICS = (
    *(f"share_{c}" for c in _CLASSES),
    "log_bytes",
    "log_words",
    "word_bytes",
    "distinct_words",
    "repeated_next",
    "short_words",
    "line_words",
    "distinct_lines",
    "words_ending_in_marks",
    "words_starting_upper",
)


def _per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


def _distinct(hashes: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return np.bincount(owner[new], minlength=texts).astype(np.float64)


def statistics(texts: Texts) -> np.ndarray:
    """One row of STATISTICS per text; all are defined for empty texts too."""
    n, sizes = len(texts), np.diff(texts.offsets)
    owner = np.repeat(np.arange(n), sizes)
    kinds = _CLASS[texts.data]
    width = len(_CLASSES)
    counts = np.bincount(owner * width + kinds, minlength=n * width).reshape(n, width)
    size = np.maximum(sizes, 1)
    found = words(texts)
    total = np.diff(found.first)
    some = np.maximum(total, 1)
    length = found.ends - found.starts
    hashes = _ROLLING.spans(texts.data, found.starts, found.ends)
    again = np.zeros(len(found), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (found.owner[1:] == found.owner[:-1])
    lines = words(texts, _NEWLINE)
    line_hashes = _ROLLING.spans(texts.data, lines.starts, lines.ends)
    n_lines = np.maximum(np.diff(lines.first), 1)
    last, start = kinds[found.ends - 1], kinds[found.starts]
    marks = np.isin(last, [_CLASSES.index(c) for c in ("loud", "bar", "sign")])
    columns = [
        *(counts[:, i] / size for i in range(width)),
        np.log1p(sizes),
        np.log1p(total),
        _per_text(length, found.first) / some,
        _distinct(hashes, found.owner, n) / some,
        _per_text(again, found.first) / some,
        _per_text(length <= 3, found.first) / some,
        total / n_lines,
        _distinct(line_hashes, lines.owner, n) / n_lines,
        _per_text(marks, found.first) / some,
        _per_text(start == _CLASSES.index("upper"), found.first) / some,
    ]
    return np.stack(columns, axis=1)


# --- trees --------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Trees:
    """Flat trees: node k of a tree has the children 2k + 1 and 2k + 2; the last level holds the leaves' values."""

    edges: np.ndarray  # (statistic, cut points)
    feature: np.ndarray  # (tree, inner node)
    cut: np.ndarray  # (tree, inner node): go right if the bin lies above
    value: np.ndarray  # (tree, leaf)
    base: float

    def bins(self, rows: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, rows[:, i], side="left") for i, e in enumerate(self.edges)], axis=1)

    def score(self, rows: np.ndarray) -> np.ndarray:
        binned = self.bins(rows)
        total = np.full(len(rows), self.base)
        if len(self.feature):
            tree = np.arange(len(self.feature))[None, :]
            row = np.arange(len(rows))[:, None]
            node = np.zeros((len(rows), len(self.feature)), np.int64)
            for _ in range(int(np.log2(self.value.shape[1]))):
                node = 2 * node + 1 + (binned[row, self.feature[tree, node]] > self.cut[tree, node])
            total += self.value[tree, node - self.feature.shape[1]].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def grow(rows: np.ndarray, labels: np.ndarray, *, trees: int, depth: int, rate: float, bins: int, least: float) -> Trees:
    """Gradient boosting on the log loss, level by level, splits found in histograms of gradients."""
    share = float(np.clip(labels.mean() if len(labels) else 1.0, 1e-6, 1 - 1e-6))
    base = float(np.log(share / (1 - share)))
    quantiles = np.linspace(0, 1, bins + 1)[1:-1]
    width = rows.shape[1]
    edges = np.quantile(rows, quantiles, axis=0).T if len(rows) else np.zeros((width, bins - 1))
    inner, leaves = 2**depth - 1, 2**depth
    model = Trees(edges, np.zeros((0, inner), np.int64), np.zeros((0, inner), np.int64), np.zeros((0, leaves)), base)
    if not 0 < labels.sum() < len(labels):
        return model
    binned = model.bins(rows)
    flat = binned + np.arange(width)[None, :] * bins  # a histogram cell per statistic and bin
    feature, cut, value = (np.zeros((trees, k), t) for k, t in ((inner, np.int64), (inner, np.int64), (leaves, float)))
    margin = np.full(len(rows), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        slope, bend = p - labels, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(len(rows), np.int64)  # within the level
        for level in range(depth):
            nodes, cells = 2**level, width * bins
            at = (node[:, None] * cells + flat).ravel()
            sums = [
                np.bincount(at, np.repeat(w, width), nodes * cells).reshape(nodes, width, bins).cumsum(axis=2) for w in (slope, bend)
            ]
            g, h = sums[0][:, :, :-1], sums[1][:, :, :-1]
            all_g, all_h = sums[0][:, :, -1:], sums[1][:, :, -1:]
            gain = g**2 / (h + 1) + (all_g - g) ** 2 / (all_h - h + 1) - all_g**2 / (all_h + 1)
            gain = np.where((h >= least) & (all_h - h >= least), gain, 0).reshape(nodes, -1)
            best = gain.argmax(axis=1)
            splits = gain[np.arange(nodes), best] > 1e-9
            f, c = best // (bins - 1), np.where(splits, best % (bins - 1), bins)  # no split: all go left
            feature[t, nodes - 1 : 2 * nodes - 1], cut[t, nodes - 1 : 2 * nodes - 1] = f, c
            node = 2 * node + (binned[np.arange(len(rows)), f[node]] > c[node])
        value[t] = -rate * np.bincount(node, slope, leaves) / (np.bincount(node, bend, leaves) + 1)
        margin += value[t][node]
    return Trees(edges, feature, cut, value, base)


# --- on Spark -----------------------------------------------------------------------------------------------


def _measured(batches):
    for batch in batches:
        for table in slices(batch, "text", _PIECE_BYTES):
            rows = statistics(Texts.of(table["text"]))
            numbers = pa.ListArray.from_arrays(
                pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel())
            )
            yield pa.RecordBatch.from_arrays([table["id"].combine_chunks(), table["label"].combine_chunks(), numbers], names=["id", "label", "numbers"])


def train(
    documents: DataFrame,
    labels: DataFrame,
    learn: Column,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_rows: int = 20_000,
    trees: int = 60,
    depth: int = 4,
    rate: float = 0.15,
    bins: int = 48,
    least: float = 2.0,
) -> Trees:
    """Trees for the labels of the rows of ``labels`` where ``learn`` holds.

    Learns from ``max_rows`` labelled documents at most, those with the least hash of their id; only these are read
    for their texts and only their statistics reach the driver. A document labelled more than once counts with its
    mean label, rounded; a null label or id does not count, nor does a label without a document. Labels of one kind
    give that share as every score, and no labels at all a score of 1: nothing is held against any document.
    """
    known = (
        labels.where(learn)
        .select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("label"))
        .dropna()
        .groupBy("id")
        .agg(F.round(F.avg("label")).cast("int").alias("label"))
    )
    sample = known.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    texts = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    chosen = texts.join(F.broadcast(sample), "id").select("id", "label", "text")  # max_rows rows of two numbers
    found = chosen.mapInArrow(_measured, "id long, label int, numbers array<double>").toArrow()
    order = np.lexsort((found["label"].to_numpy(), found["id"].to_numpy()))
    numbers = found["numbers"].combine_chunks().flatten().to_numpy().reshape(-1, len(STATISTICS))[order]
    return grow(
        numbers, found["label"].to_numpy()[order].astype(float), trees=trees, depth=depth, rate=rate, bins=bins, least=least
    )


def score(documents: DataFrame, model: Trees, *, id_col: str = "doc_id", text_col: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """Every input row's ``id`` and ``score`` (0 to 1), and the columns ``also`` unchanged.

    A null text is scored as an empty one. Repeated rows score alike, and the text alone decides. The result holds
    no other columns, so clashing names do not matter; an empty table gives an empty result.
    """
    others = [c for c in also if c != text_col]
    kept = [F.col(f"`{c}`").alias(f"also_{i}") for i, c in enumerate(others)]
    rows = documents.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), *kept)
    back = [c for c in rows.columns if c != "text" or text_col in also]  # the text returns only if it is asked for

    def scored(batches):
        for batch in batches:
            parts = [statistics(Texts.of(t["text"])) for t in slices(batch, "text", _PIECE_BYTES)]
            if parts:
                values = model.score(np.concatenate(parts))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in back), pa.array(values)], names=[*back, "score"])

    out = rows.mapInArrow(scored, rows.select(*back).schema.add("score", "double"))
    named = {text_col: "text"} | {c: f"also_{i}" for i, c in enumerate(others)}
    return out.select("id", *[F.col(named[c]).alias(c) for c in also], "score")
