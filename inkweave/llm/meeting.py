"""Which keys do two documents share, and which document is the first to hold a key: exchanges of packed key arrays.

Documents are worked on in batches (documents whose ids fall into one hash class). A batch sends its distinct keys,
sorted and packed, to hash ranges (buckets); a bucket meets the keys of all batches and answers each batch. A key is
sent at most once per batch however often it occurs, so a frequent key makes no large group, and the numbers of
batches and buckets follow the size of the input, so no task's share grows with it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_BYTES = 2 << 20
BUCKET_BYTES = 4 << 20
#: Stands for a document without an id: after all ids, and no repeat of another document without one.
NO_ID = np.iinfo(np.int64).max

#: Bits of a short key beyond those of the input's size: one key in hundreds then answers to another by chance.
SPARE_BITS = 7


@dataclass(frozen=True)
class Plan:
    """How keys are sent: to how many buckets, and in how many bits; both follow the bytes of text."""

    buckets: int
    bits: int

    def short(self, hashes: np.ndarray) -> np.ndarray:
        """Short keys of hashes: equal hashes have equal keys, and an answer only selects what is looked at exactly."""
        return hashes >> np.uint64(64 - self.bits)

    def bucket_of(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) // np.uint64(-(-(1 << self.bits) // self.buckets))).astype(np.int64)

    def cuts(self, ascending: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The buckets that ascending keys touch, and where each begins (one more cut at the end)."""
        bucket = self.bucket_of(ascending)
        begins = np.flatnonzero(np.diff(bucket, prepend=-1))
        return bucket[begins], np.append(begins, len(ascending))


def planned(size: int, least: int, bytes_per_bucket: int = BUCKET_BYTES) -> Plan:
    return Plan(max(least, -(-size // bytes_per_bucket)), min(56, max(32, size.bit_length() + SPARE_BITS)))


SENT = "bucket long, batch long, keys binary"
FOUND = "batch long, bucket long, keys binary"


def batched(documents: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Plan]:
    """(id, text, batch) rows, and how their keys are sent; the number of batches follows the bytes of text too."""
    spark = documents.sparkSession
    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batches = max(least, -(-size // BATCH_BYTES))
    # rows without an id are no one another's repeats, so they may lie in different batches
    spread = F.xxhash64(F.coalesce("id", F.xxhash64("text")))
    return rows.withColumn("batch", F.pmod(spread, F.lit(batches))), planned(size, least)


def run_starts(ascending: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    new = np.ones(len(ascending), bool)
    new[1:] = ascending[1:] != ascending[:-1]
    return np.flatnonzero(new)


def ids_of(table: pa.Table) -> np.ndarray:
    return table["id"].combine_chunks().fill_null(NO_ID).to_numpy(zero_copy_only=False)


def pack(sorted_values: np.ndarray) -> bytes:
    """Ascending numbers as differences, byte plane by byte plane: the high planes are zeros, which compress away."""
    steps = np.diff(sorted_values, prepend=np.uint64(0)).astype("<u8")
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).reshape(-1).view("<u8"), dtype=np.uint64)


def send_keys(batch: int, hashes: np.ndarray, owner: np.ndarray, indexed: np.ndarray | bool, plan: Plan) -> pa.Table:
    """One row per bucket: distinct short keys with two marks, is it indexed here and do several documents hold it."""
    rows = {"bucket": [], "batch": [], "keys": []}
    if len(hashes):
        keys, index = plan.short(hashes), np.broadcast_to(np.asarray(indexed, np.uint64), len(hashes))
        width = int(owner.max()).bit_length()
        if plan.bits + width + 1 <= 64:  # one sort of packed numbers
            packed = (keys << np.uint64(width + 1)) | (owner.astype(np.uint64) << np.uint64(1)) | index
            packed.sort()
            keys, owner, index = packed >> np.uint64(width + 1), packed >> np.uint64(1), packed & np.uint64(1)
        else:
            order = np.lexsort((owner, keys))
            keys, owner, index = keys[order], owner[order], index[order]
        begins = run_starts(keys)
        ends = np.append(begins[1:], len(keys)) - 1
        several = (owner[begins] != owner[ends]).astype(np.uint64)
        distinct = keys[begins]
        marked = (distinct << np.uint64(2)) | (several << np.uint64(1)) | np.bitwise_or.reduceat(index, begins)
        which, cuts = plan.cuts(distinct)
        for number, begin, end in zip(which.tolist(), cuts, cuts[1:], strict=False):
            rows["bucket"].append(number)
            rows["batch"].append(batch)
            rows["keys"].append(pack(marked[begin:end]))
    return pa.table(rows, pa.schema([("bucket", pa.int64()), ("batch", pa.int64()), ("keys", pa.binary())]))


def _meet(table: pa.Table) -> pa.Table:
    """Answers each batch with those of its keys that are indexed in one document and held by another."""
    bucket = table["bucket"][0].as_py()
    batches = table["batch"].to_pylist()
    parts = [unpack(x) for x in table["keys"].to_pylist()]
    whose = np.repeat(np.arange(len(parts), dtype=np.uint32), [len(x) for x in parts])
    marked = np.concatenate(parts)
    order = np.argsort(marked >> np.uint64(2), kind="stable")
    keys = (marked >> np.uint64(2))[order]
    begins = run_starts(keys)
    counts = np.diff(np.append(begins, len(keys)))
    # A batch sends a key once, so two entries are two batches, and these hold different documents.
    marks = np.bitwise_or.reduceat(marked[order], begins)
    hit = (marks & np.uint64(1) != 0) & ((counts > 1) | (marks & np.uint64(2) != 0))
    chosen = np.zeros(len(keys), bool)
    chosen[order] = np.repeat(hit, counts)
    found, owner = (marked >> np.uint64(2))[chosen], whose[chosen]
    ends = np.searchsorted(owner, np.arange(len(parts) + 1))
    rows = [(batches[i], bucket, pack(found[a:b])) for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False)) if b > a]
    names = ("batch", "bucket", "keys")
    return pa.table(
        {n: [r[i] for r in rows] for i, n in enumerate(names)},
        pa.schema([("batch", pa.int64()), ("bucket", pa.int64()), ("keys", pa.binary())]),
    )


def shared_keys(sent: DataFrame) -> DataFrame:
    """(batch, bucket, keys): the keys of each batch that another document shares."""
    return sent.groupBy("bucket").applyInArrow(lambda table: _meet(table), FOUND)


def found_keys(table: pa.Table) -> np.ndarray:
    """All answered keys of a batch, ascending."""
    order = np.argsort(table["bucket"].to_numpy())
    blobs = table["keys"].to_pylist()
    return np.concatenate([unpack(blobs[i]) for i in order]) if len(blobs) else np.zeros(0, np.uint64)


def contained(values: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    if not len(ascending):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(ascending, values), len(ascending) - 1)
    return ascending[at] == values


# --- the first document of a key ---------------------------------------------------------------------------

CLAIMED = "bucket long, batch long, high binary, low binary, least binary, most binary"
FIRST = "batch long, high binary, low binary, least binary"
_CLAIMS = pa.schema([("bucket", pa.int64()), ("batch", pa.int64()), *((n, pa.binary()) for n in ("high", "low", "least", "most"))])
_FIRSTS = pa.schema([("batch", pa.int64()), *((n, pa.binary()) for n in ("high", "low", "least"))])


# Keys of 96 bits: the high 64 and the low 32 of a second hash, of digests of words. Two keys of a hundred billion are
# equal by chance once in millions of runs.
_HALVES = (("high", "<u8"), ("low", "<u4"))


def distinct_pairs(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by both halves of the hashes, where runs of equal ones begin, and the run of each entry."""
    order = np.lexsort((low, high))
    a, b = high[order], low[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    run = np.empty(len(a), np.int64)
    run[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), run


def claim(batch: int, high: np.ndarray, low: np.ndarray, ids: np.ndarray, plan: Plan) -> pa.Table:
    """A batch's distinct keys with the least id of a document holding it, and the distance to the greatest."""
    rows = {n: [] for n in _CLAIMS.names}
    if len(high):
        order, begins, _ = distinct_pairs(high, low)
        least, most = np.minimum.reduceat(ids[order], begins), np.maximum.reduceat(ids[order], begins)
        first = order[begins]
        which, cuts = plan.cuts(plan.short(high[first]))
        for number, a, b in zip(which.tolist(), cuts, cuts[1:], strict=False):
            values = (number, batch, high[first[a:b]], low[first[a:b]], least[a:b], (most - least)[a:b])
            for name, value in zip(_CLAIMS.names, values, strict=True):
                rows[name].append(value.tobytes() if isinstance(value, np.ndarray) else value)
    return pa.table(rows, _CLAIMS)


def _first(table: pa.Table) -> pa.Table:
    """Answers each batch with those of its keys that a document before the batch's last holder holds."""
    batches = table["batch"].to_pylist()
    kinds = (*_HALVES, ("least", "<i8"), ("most", "<i8"))
    columns = {n: [np.frombuffer(x, t) for x in table[n].to_pylist()] for n, t in kinds}
    lengths = [len(x) for x in columns["high"]]
    high, low, least, most = (np.concatenate(columns[n]) for n, _ in kinds)
    order, begins, run = distinct_pairs(high, low)
    first = np.minimum.reduceat(least[order], begins)[run]
    rows, end = {n: [] for n in _FIRSTS.names}, 0
    for batch, length in zip(batches, lengths, strict=True):
        begin, end = end, end + length
        at = np.flatnonzero(first[begin:end] < (least + most)[begin:end]) + begin
        if len(at):
            for name, value in zip(_FIRSTS.names, (batch, high[at].tobytes(), low[at].tobytes(), first[at].tobytes()), strict=True):
                rows[name].append(value)
    return pa.table(rows, _FIRSTS)


def first_holders(claimed: DataFrame) -> DataFrame:
    """(batch, high, low, least): the keys of each batch that a document before the batch's last holder holds."""
    return claimed.groupBy("bucket").applyInArrow(lambda table: _first(table), FIRST)


def least_ids(answers: pa.Table, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each key, the least id of a document that holds it as answered, or NO_ID where nothing was answered."""
    least = np.full(len(high), NO_ID, np.int64)
    if answers.num_rows and len(high):
        known = [np.concatenate([np.frombuffer(x, t) for x in answers[n].to_pylist()]) for n, t in (*_HALVES, ("least", "<i8"))]
        order = np.argsort(known[0])
        known = [x[order] for x in known]
        likely = np.flatnonzero(contained(high, known[0]))
        # keys are known once each; a run of equal high halves is walked by the low ones
        order, begins, run = distinct_pairs(np.concatenate([known[0], high[likely]]), np.concatenate([known[1], low[likely]]))
        value = np.full(len(begins), NO_ID, np.int64)
        value[run[: len(known[0])]] = known[2]
        least[likely] = value[run[len(known[0]) :]]
    return least


def by_batch(rows: DataFrame, work: Callable[..., pa.Table], schema: str, answers: DataFrame | None = None, **settings) -> DataFrame:
    """Runs ``work`` on each batch's documents, together with the answers to the batch if there are any."""
    grouped = rows.groupBy("batch")
    if answers is None:
        return grouped.applyInArrow(lambda table: work(table, **settings), schema)
    both = grouped.cogroup(answers.groupBy("batch"))
    return both.applyInArrow(lambda table, answered: work(table, answered, **settings), schema)
