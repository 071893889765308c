"""URL filters by a cascade of Bloom filters: exact answers for every key of a corpus, without a join.

A rule is an action, a host and a path. A url asks for the keys it could match: its host and the hosts above it, each
with the beginnings of its path, for both actions. The first filter holds the listed keys. The keys of the corpus that
pass it and are not listed are its false positives: the second filter holds these, the third the listed keys that pass
the second, and so on until none is left. A key that a filter of odd level turns away is not listed, one that a filter
of even level turns away is; so every key of the corpus is answered exactly, with a few bits for each listed key.

The first filter is all that the corpus meets in full, in one narrow pass; what it lets through by mistake is a small
part of the distinct keys, and each level has a small part of the one before. Filters are cut into shards by a hash of
the key, each built by its own task. Shards go to the executors in groups of at most ``BROADCAST_BYTES``; a longer list
takes a pass over the urls for each group, and no url or host is ever a key of a shuffle when urls are judged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkweave.llm.store import written

#: How many keys of others a level lets through: the first is met by the whole corpus, the rest by what is left of it.
FIRST_RATE, RATE = 1 / 256, 1 / 16
#: Listed keys a shard, and bytes of filters that are sent to an executor at once.
SHARD_KEYS = 1 << 20
BROADCAST_BYTES = 32 << 20
#: Levels shrink by RATE; so many are never needed unless the hashes are broken.
MOST_LEVELS = 64
ACTIONS = ("allow", "block")


# --- urls and keys ------------------------------------------------------------------------------------------------

_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty for null and where there is none."""
    begin = F.instr(url, "://")
    return F.coalesce(F.when(begin > 0, url.substr(begin + 3, F.length(url))), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _CAPITALS, _SMALL)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _key(action: Column, host: Column, path: Column) -> Column:
    """32 bytes for a key; the host's length keeps hosts and paths apart."""
    return F.unhex(F.sha2(F.concat_ws(" ", action, F.length(host).cast("string"), F.concat(host, path)), 256))


def _asked(host: Column, path: Column, shape: dict[int, list[int]]) -> Column:
    """The rules that could fit a url, as (rule, action, key), the longest first and of equally long ones the longer host
    first, then block; ``shape`` has the path lengths of the rules for each number of labels of their hosts."""
    labels = F.split(host, r"\.", -1)
    lengths = F.create_map(*[F.lit(x) for n, cuts in shape.items() for x in (n, cuts)])
    above = F.transform(
        F.filter(F.lit(list(shape)), lambda n: n <= F.size(labels)),
        lambda n: F.struct(F.array_join(F.slice(labels, F.size(labels) - n + 1, n), ".").alias("host"), n.alias("n")),
    )
    fits = lambda h, n: F.struct(
        (F.length(h["host"]) + n).alias("size"), F.length(h["host"]).alias("own"), h["host"].alias("host"), F.substring(path, F.lit(1), n).alias("path")
    )
    found = F.flatten(F.transform(above, lambda h: F.transform(F.filter(lengths[h["n"]], lambda n: n <= F.length(path)), lambda n: fits(h, n))))
    both = lambda c: F.array(*[
        F.struct(F.concat(c["host"], c["path"]).alias("rule"), F.lit(a).alias("action"), _key(F.lit(a), c["host"], c["path"]).alias("key"))
        for a in reversed(ACTIONS)
    ])
    return F.flatten(F.transform(F.reverse(F.array_sort(found)), both))


# --- filters ------------------------------------------------------------------------------------------------------


def _places(words: np.ndarray, level: int, bits: int, times: int) -> Iterator[np.ndarray]:
    """The bits of keys (rows of four 64-bit words of a digest) in a filter of a level; each level has hashes of its own."""

    def spread(x):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    own = np.uint64(level * 0x9E3779B97F4A7C15 % 2**64)
    one, two = spread(words[:, 1] ^ spread(words[:, 2] + own)), spread(words[:, 3] + own) | np.uint64(1)
    for i in range(times):
        yield ((one + np.uint64(i) * two) % np.uint64(bits)).astype(np.int64)


def _words(keys: pa.Array) -> np.ndarray:
    """Digests of 32 bytes as rows of four words."""
    keys = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
    return np.frombuffer(b"".join(keys.to_pylist()), "<u8").reshape(-1, 4)


def _times(rate: float) -> int:
    return max(1, round(-np.log2(rate)))


_LEVEL = "level int, shard int, bits long, times int, filter binary"


def _level(keys: DataFrame, level: int, shards: int) -> DataFrame:
    """A filter for each shard of the distinct keys; a shard's keys are a bounded, even part of all."""
    rate = FIRST_RATE if level == 1 else RATE
    times = _times(rate)

    def build(key: tuple, group: pa.Table) -> pa.Table:
        words = _words(group["key"])
        bits = max(64, int(np.ceil(len(words) * times / np.log(2))))
        filled = np.zeros(bits, bool)
        for at in _places(words, level, bits, times):
            filled[at] = True
        row = ([level], [key[0].as_py()], [bits], [times], [np.packbits(filled).tobytes()])
        return pa.table([pa.array(c, t) for c, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["level", "shard", "bits", "times", "filter"])

    return keys.select("key", _shard(F.col("key"), shards).alias("shard")).groupBy("shard").applyInArrow(build, _LEVEL)


def _shard(key: Column, shards: int) -> Column:
    """By the first word of the digest, which no filter uses."""
    return F.pmod(F.conv(F.hex(F.substring(key, 1, 7)), 16, 10).cast("long"), F.lit(shards)).cast("int")


@dataclass(frozen=True)
class Part:
    """Some whole shards of all levels, small enough to be sent to every executor."""

    shards: int
    filters: dict[tuple[int, int], tuple[int, int, bytes]]
    held: tuple[int, ...]

    def shard_of(self, words: np.ndarray) -> np.ndarray:
        return ((words[:, 0].byteswap() >> np.uint64(8)) % np.uint64(self.shards)).astype(np.int64)  # as _shard

    def passes(self, words: np.ndarray, shard: np.ndarray, level: int) -> np.ndarray:
        """Which keys a level lets through; a shard without a filter of that level lets none through."""
        out = np.zeros(len(words), bool)
        for s in np.unique(shard).tolist():
            if (level, s) in self.filters:
                bits, times, data = self.filters[level, s]
                rows, filled = np.flatnonzero(shard == s), np.frombuffer(data, np.uint8)
                out[rows] = True
                for at in _places(words[rows], level, bits, times):
                    out[rows] &= (filled[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
        return out

    def listed(self, words: np.ndarray) -> np.ndarray:
        """Which keys are listed; for keys of the corpus that the cascade was built for, and of the shards held."""
        shard = self.shard_of(words)
        out, rows, level = np.zeros(len(words), bool), np.flatnonzero(np.isin(shard, self.held)), 0
        while len(rows):
            level += 1
            through = self.passes(words[rows], shard[rows], level)
            out[rows[~through]] = level % 2 == 0
            rows = rows[through]
        return out


@dataclass(frozen=True)
class Cascade:
    """The filters (a table with a row per level and shard), the number of shards, and the shape of the listed rules."""

    filters: DataFrame | None
    shards: int
    shape: dict[int, list[int]]

    def parts(self, level: int | None = None) -> Iterator[Part]:
        """The filters (of one level, or all) in groups of whole shards of BROADCAST_BYTES at most (or one shard)."""
        table = self.filters if level is None else self.filters.where(F.col("level") == level)
        sizes = table.groupBy("shard").agg(F.sum(F.length("filter")).alias("size")).orderBy("shard").collect()
        group, held = [], 0
        for r in [*sizes, None]:
            if group and (r is None or held + r["size"] > BROADCAST_BYTES):
                rows = table.where(F.col("shard").between(group[0], group[-1])).collect()
                yield Part(self.shards, {(x["level"], x["shard"]): (x["bits"], x["times"], bytes(x["filter"])) for x in rows}, tuple(group))
                group, held = [], 0
            if r is not None:
                group, held = [*group, r["shard"]], held + r["size"]


def _through(keys: DataFrame, cascade: Cascade, level: int) -> DataFrame:
    """The distinct keys that a level lets through; ``keys`` has a list of keys in each row."""

    def pick(part: Part):
        def run(batches):
            for batch in batches:
                flat = batch.column(0).flatten().unique()
                words = _words(flat)
                shard = part.shard_of(words)
                yield pa.RecordBatch.from_arrays([flat.filter(pa.array(part.passes(words, shard, level)))], names=["key"])

        return run

    found = [keys.mapInArrow(pick(part), "key binary") for part in cascade.parts(level)]
    return reduce(DataFrame.union, found).distinct()


def build(rules: DataFrame, urls: Column, corpus: DataFrame) -> Cascade:
    """The cascade of the rules (host, path, action) for all urls of a corpus; it is exact for these urls.

    A rule's host is compared in lower case (A-Z); a null path is an empty one. Rules without a host or with an action
    other than allow and block take no part, repeated rules count once. No rules give a cascade that lists nothing.
    """
    named = rules.select(
        F.translate(F.col("host"), _CAPITALS, _SMALL).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "action"
    ).where(F.col("host").isNotNull() & F.col("action").isin(*ACTIONS))
    listed = written(named.distinct().select("*", _key(F.col("action"), F.col("host"), F.col("path")).alias("key")), "listed")
    shape: dict[int, list[int]] = {}
    # as many rows as there are lengths of paths and depths of hosts
    for r in listed.groupBy(F.size(F.split("host", r"\.", -1)).alias("n"), F.length("path").alias("cut")).count().orderBy("n", "cut").collect():
        shape.setdefault(r["n"], []).append(r["cut"])
    if not shape:
        return Cascade(None, 1, {})
    shards = -(-listed.count() // SHARD_KEYS)
    asked = corpus.select(F.transform(_asked(host_of(urls), path_of(urls), shape), lambda c: c["key"]).alias("keys"))

    # the keys that the next level holds, and those that it will meet
    held, met = listed.select("key"), None
    cascade = Cascade(None, shards, shape)
    for level in range(1, MOST_LEVELS):
        one = written(_level(held, level, shards), f"filter-{level}")
        cascade = Cascade(one if cascade.filters is None else cascade.filters.unionByName(one), shards, shape)
        if met is None:  # listed keys pass as well, and are told apart by an exact look at the few that pass
            passed = _through(asked, cascade, level).join(held, "key", "left_anti")
        else:
            passed = _through(met.select(F.array("key")), cascade, level)
        passed = written(passed, f"passed-{level}")
        if passed.isEmpty():
            return cascade
        held, met = passed, held
    raise RuntimeError(f"{MOST_LEVELS} levels of filters do not tell the keys apart")


def judge(corpus: DataFrame, cascade: Cascade, *, url_col: str = "url", also: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """A row per row of the corpus: the columns ``also``, host, path, rule and verdict.

    The rule is the longest that fits (host and path as one string; null if none does), the verdict its action; a url
    that no rule fits is allowed, as the cascade lists none of its keys. A rule fits its host and those below it where
    the path begins with the rule's. Of equally long rules the one with the longer host holds, then block. A url that is
    null or has no ``://`` has an empty host and path. Repeated rows are judged each, other columns are left out; an
    empty corpus gives an empty result. The corpus must be the one that the cascade was built for, or a part of it.
    """
    url = F.col(f"`{url_col}`")
    own = [f"in_{i}" for i in range(len(also))]
    rows = corpus.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(also, own, strict=True)], host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumns({"place": F.lit(None).cast("int"), "rule": F.lit(None).cast("string"), "action": F.lit(None).cast("string")})
    kept = rows.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)

    def look(part: Part):
        def run(batches):
            for batch in batches:
                lists, flat = batch.column(len(kept)), batch.column(len(kept)).flatten()
                listed = part.listed(_words(flat.field("key")))
                sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
                begins = np.cumsum(sizes) - sizes
                row = np.repeat(np.arange(len(sizes)), sizes)
                at = np.flatnonzero(listed)
                hit, first = np.unique(row[at], return_index=True)  # the candidates are in order: the first one holds
                at = at[first]
                place = np.full(len(sizes), np.iinfo(np.int32).max, np.int64)
                place[hit] = at - begins[hit]
                before = batch.column(len(own) + 2).fill_null(np.iinfo(np.int32).max).to_numpy()
                better = place < before
                source = np.full(len(sizes), -1)
                source[hit] = at
                take = pa.array(source, mask=~better)
                new = [pa.array(place.astype(np.int32), mask=~better), flat.field("rule").take(take), flat.field("action").take(take)]
                old = [batch.column(len(own) + 2 + i) for i in range(3)]
                mask = pa.array(better)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i) for i in range(len(own) + 2)), *(pc.if_else(mask, n, o) for n, o in zip(new, old, strict=True))], names=kept
                )

        return run

    parts = cascade.parts() if cascade.filters is not None else iter(())
    for number, part in enumerate(parts):  # one group of shards in memory at a time
        rows = written(rows, "judged") if number else rows
        rows = rows.select(*kept, _asked(F.col("host"), F.col("path"), cascade.shape).alias("asked")).mapInArrow(look(part), schema)
    return rows.select(
        *[F.col(o).alias(c) for c, o in zip(also, own, strict=True)], "host", "path", "rule", F.coalesce("action", F.lit("allow")).alias("verdict")
    )
