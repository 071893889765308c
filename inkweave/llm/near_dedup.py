"""MinHash near-dedup by a multi-index Hamming join.

A document's distinct word shingles give a signature of ``VALUES`` least hashes of 16 bits. Two signatures' distance is
the number of places in which they differ. Cut into ``CHUNKS`` chunks, any pair at a distance of up to ``DISTANCE``
has, by the pigeonhole principle, a chunk with one error at most; so every chunk is looked up once for each place
that may be wrong, with that place left out. That finds *all* pairs up to the distance: at a similarity of 0.8 a pair
lies beyond it once in some 100,000 times, and more similar pairs far more rarely.

Documents of one shingle set are one class from the start, and only classes meet. Look-up keys that one class alone
has are left out in a packed exchange (meeting.py). What is left is linked in two steps, neither of which makes a row per
pair: first each class of a key with the two most likely hubs of the key, confirmed on full shingle sets; then, of keys
whose classes are still in several components, all classes that share a hub meet in blocks of bounded size, where those
of different components are compared on full sets, and a block gives only the links that join components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweave.llm import meeting
from inkweave.llm.bytehash import RollingHash, Texts, mix, slices, word_digests, words
from inkweave.llm.components import components
from inkweave.llm.store import written

VALUES = 128
DISTANCE = 45
CHUNKS = (DISTANCE + 1) // 2
#: Shingles of the classes that meet in one task; more of them meet as pairs of such blocks.
BLOCK_SHINGLES = 1 << 19
_PIECE_BYTES = 512 << 10

_ROLLING = RollingHash(53)
_DRAWS = np.random.default_rng(97)
_XOR = _DRAWS.integers(0, 2**32, VALUES, dtype=np.uint32)
_TIMES = _DRAWS.integers(0, 2**31, VALUES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_BOUNDS = [round(i * VALUES / CHUNKS) for i in range(CHUNKS + 1)]

_SIGNED = "id long, n long, high long, low long, signature binary"
_SIGNED_ARROW = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("high", pa.int64()), ("low", pa.int64()), ("signature", pa.binary())])


def near_duplicates(
    documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80
) -> DataFrame:
    """One row per input row: ``id``, ``n_shingles``, ``component_id``, ``kept``.

    A document's set holds its distinct shingles of ``shingle`` words (runs of bytes other than space and U+0009 to
    U+000D, A-Z in lower case); with fewer words, its whole sequence is the one shingle. Two documents are linked if
    100 * intersection >= percent * union, told on full sets. ``component_id`` is the least id that links lead to,
    the document's own included, and ``kept`` is true for that document.

    A null text and a text without words have an empty set and no link: they are kept. Rows with one id are one
    document to the links; all of them carry the same component, and each is marked kept if its id is the component's.
    A row without an id has no component (null) and is kept, and is not compared. Further columns are left out, so
    their names do not matter; an empty table gives an empty result.
    """
    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = written(rows.mapInArrow(lambda batches: _signed(batches, shingle), _SIGNED), "signatures")
    classes = (
        signed.where("id is not null and n > 0")
        .groupBy("high", "low")
        .agg(F.min("id").alias("class"), F.first("n").alias("n"), F.first("signature").alias("signature"))
    )
    classes = written(classes, "classes")
    links = _links(classes, rows, shingle, percent)
    found = components(links)
    joined = classes.join(found, classes["class"] == found["node"], "left")
    resolved = joined.select("high", "low", F.coalesce("component", "class").alias("component_id"))
    marked = signed.drop("signature").join(resolved, ["high", "low"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    component = F.when(F.col("id").isNotNull(), component)
    return marked.select(
        "id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )


# --- shingles and signatures --------------------------------------------------------------------------------


def shingle_sets(texts: Texts, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text as 64 bits made of their words' digests, ascending, one text after the other,
    and where each text's begin."""
    lowered = texts.lower()
    found = words(lowered)
    values = word_digests(lowered, found)[:, 0]
    counts = np.diff(found.first)
    whole = np.flatnonzero((counts > 0) & (counts < shingle))
    hashes, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(values):
        hashes = _ROLLING.windows(values, shingle)
        inside = found.owner[: len(hashes)] == found.owner[shingle - 1 :] if len(hashes) else np.zeros(0, bool)
        short = _ROLLING.between(_ROLLING.prefix(values), found.first[whole], found.first[whole + 1]) + np.uint64(1)
        hashes = np.concatenate([hashes[inside], short])
        owner = np.concatenate([found.owner[: len(inside)][inside], whole])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(len(texts) + 1))


def _signed(batches, shingle: int):
    for batch in batches:
        for table in slices(batch, "text", _PIECE_BYTES):
            texts = Texts.of(table["text"])
            hashes, first = shingle_sets(texts, shingle)
            n = np.diff(first)
            some = np.flatnonzero(n)
            high, low = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            signature = np.zeros((len(n), VALUES), np.uint16)
            if len(some):
                begins = first[some]
                # a set's two hashes are sums of its shingles' mixed hashes, which no order changes
                high[some] = np.add.reduceat(mix(hashes), begins)
                low[some] = np.add.reduceat(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), begins)
                half = (hashes >> np.uint64(32)).astype(np.uint32)
                for k in range(VALUES):
                    least = np.minimum.reduceat((half ^ _XOR[k]) * _TIMES[k], begins)
                    signature[some, k] = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)
            raw = signature.tobytes()
            width = 2 * VALUES
            yield pa.RecordBatch.from_arrays(
                [
                    table["id"].combine_chunks(),
                    pa.array(n),
                    pa.array(high.view(np.int64)),
                    pa.array(low.view(np.int64)),
                    pa.array([raw[i * width : i * width + width] for i in range(len(n))], pa.binary()),
                ],
                schema=_SIGNED_ARROW,
            )


# --- the multi-index join -----------------------------------------------------------------------------------


def lookup_keys(signatures: np.ndarray) -> np.ndarray:
    """For each signature, a key per chunk and per place left out: equal for two iff that chunk differs there at most."""
    places = signatures.astype(np.uint64)
    out = []
    for chunk, (begin, end) in enumerate(zip(_BOUNDS, _BOUNDS[1:], strict=False)):
        terms = np.stack([mix(places[:, i] + np.uint64((i + 1) << 20)) for i in range(begin, end)])
        total = terms.sum(axis=0, dtype=np.uint64)
        out += [mix(total - terms[i] + np.uint64((chunk * 64 + i + 1) << 40)) for i in range(end - begin)]
    return np.stack(out, axis=1)


def _class_keys(table: pa.Table) -> np.ndarray:
    raw = b"".join(table["signature"].to_pylist())
    return lookup_keys(np.frombuffer(raw, np.uint16).reshape(-1, VALUES))


def _send_lookups(table: pa.Table, plan: meeting.Plan) -> pa.Table:
    keys = _class_keys(table)
    owner = np.repeat(np.arange(len(keys)), keys.shape[1])
    return meeting.send_keys(table["batch"][0].as_py(), keys.ravel(), owner, True, plan)


_SHARED = "key long, class long, n long, shared int"
_SHARED_ARROW = pa.schema([("key", pa.int64()), ("class", pa.int64()), ("n", pa.int64()), ("shared", pa.int32())])


def _shared_lookups(table: pa.Table, answers: pa.Table, plan: meeting.Plan) -> pa.Table:
    if not table.num_rows or not answers.num_rows:
        return _SHARED_ARROW.empty_table()
    keys = _class_keys(table)
    hit = meeting.contained(plan.short(keys.ravel()), meeting.found_keys(answers)).reshape(keys.shape)
    row, _ = np.nonzero(hit)
    shared = hit.sum(axis=1).astype(np.int32)
    return pa.Table.from_arrays(
        [
            pa.array(keys[hit].view(np.int64)),
            table["class"].combine_chunks().take(pa.array(row)),
            table["n"].combine_chunks().take(pa.array(row)),
            pa.array(shared[row]),
        ],
        schema=_SHARED_ARROW,
    )


def _links(classes: DataFrame, rows: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Confirmed links between classes: enough of them for the components."""
    spark = classes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    batches = max(parts, -(-classes.count() // 4096))
    grouped = classes.select("class", "n", "signature", F.pmod(F.xxhash64("class"), F.lit(batches)).alias("batch"))
    plan = meeting.Plan(batches, min(56, max(32, (batches * 4096 * VALUES).bit_length() + meeting.SPARE_BITS)))
    sent = meeting.by_batch(grouped, _send_lookups, meeting.SENT, plan=plan)
    shared = written(meeting.by_batch(grouped, _shared_lookups, _SHARED, meeting.shared_keys(sent), plan=plan), "lookups")

    # the hubs of a key: its least class, and the one that shares most keys, as an unchanged original does
    hubs = shared.groupBy("key").agg(
        F.min(F.struct("class", "n")).alias("least"),
        F.max(F.struct("shared", (-F.col("class")).alias("minus"), "n")).alias("most"),
        F.count("*").alias("members"),
    )
    hubs = hubs.where("members > 1").select(
        "key", "members", F.col("least.class").alias("hub_a"), F.col("least.n").alias("n_a"),
        (-F.col("most.minus")).alias("hub_b"), F.col("most.n").alias("n_b"),
    )
    spokes = shared.join(hubs, "key")
    ends = [F.struct(F.col(f"hub_{x}").alias("hub"), F.col(f"n_{x}").alias("m")) for x in "ab"]
    likely = spokes.select("class", "n", F.inline(F.array(*ends))).where(_can_match("n", "m", percent))
    pairs = likely.where("class != hub").select(F.least("class", "hub").alias("a"), F.greatest("class", "hub").alias("b")).distinct()
    pairs = written(pairs, "pairs")
    sets = _sets_of(spokes.select(F.col("class").alias("id")).distinct(), rows, shingle)
    first = written(_confirmed(pairs, sets, percent), "hub-links")
    found = components(first)

    # what is left: keys of three classes or more that lie in several components
    open_keys = (
        shared.join(hubs.where("members > 2").select("key", F.col("hub_b").alias("hub")), "key")
        .join(found.withColumnRenamed("node", "class"), "class", "left")
        .withColumn("component", F.coalesce("component", "class"))
    )
    several = open_keys.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y")
    # classes of one key have one hub, so they meet if they meet by hubs, and far less often than by keys
    left = written(open_keys.join(several.select("key"), "key").select("hub", "class", "n", "component").distinct(), "open-classes")
    sizes = left.groupBy("hub").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    dealt = (
        left.join(sizes, "hub")
        .withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")))
        .join(sets, "class")
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .select("hub", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "class", "component", "shingles")
    )
    late = dealt.groupBy("hub", "x", "y").applyInArrow(lambda table: _late_links(table, percent), "a long, b long")
    return first.unionByName(written(late, "late-links"))


def _can_match(n: str, m: str, percent: int):
    """Two sets of these sizes can be that similar."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _late_links(table: pa.Table, percent: int) -> pa.Table:
    """Links between classes of different components, of two blocks (or within one), until these are one component."""
    ids, component, own = (table[c].to_numpy() for c in ("class", "component", "own"))
    lists = table["shingles"].combine_chunks()
    first = lists.offsets.to_numpy().astype(np.int64)
    codes = np.unique(lists.values.to_numpy(), return_inverse=True)[1]
    sizes = np.diff(first)
    group = np.unique(component, return_inverse=True)[1]  # components as they are joined here
    two = table["x"][0].as_py() != table["y"][0].as_py()
    side = np.flatnonzero(own == own[0]) if two else np.arange(len(ids))
    held = np.zeros(int(codes.max()) + 1 if len(codes) else 1, bool)
    a, b = [], []
    for i in side.tolist():
        can = (group != group[i]) & (np.minimum(sizes, sizes[i]) * 100 >= np.maximum(sizes, sizes[i]) * percent)
        at = np.flatnonzero(can & ((own != own[i]) if two else (np.arange(len(ids)) > i)))
        if not len(at):
            continue
        mine = codes[first[i] : first[i + 1]]
        held[mine] = True
        counts = sizes[at]
        begins = np.cumsum(counts) - counts
        places = np.repeat(first[at] - begins, counts) + np.arange(counts.sum())
        both = np.add.reduceat(held[codes[places]].astype(np.int64), begins)
        held[mine] = False
        for j in at[both * 100 >= (sizes[i] + counts - both) * percent].tolist():
            if group[j] != group[i]:
                group[group == group[j]] = group[i]
                a.append(min(ids[i], ids[j]))
                b.append(max(ids[i], ids[j]))
    return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_PAIRS)


def _sets(batches, shingle: int):
    for batch in batches:
        for table in slices(batch, "text", _PIECE_BYTES):
            hashes, first = shingle_sets(Texts.of(table["text"]), shingle)
            sets = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([table["id"].combine_chunks(), sets], names=["class", "shingles"])


def _sets_of(ids: DataFrame, rows: DataFrame, shingle: int) -> DataFrame:
    """The full shingle sets of these documents, written once; repeated rows count once."""
    chosen = rows.join(ids, "id", "left_semi").dropDuplicates(["id", "text"])
    return written(chosen.mapInArrow(lambda batches: _sets(batches, shingle), "class long, shingles array<long>"), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full shingle sets are similar enough."""
    one = sets.select(F.col("class").alias("a"), F.col("shingles").alias("of_a"))
    two = sets.select(F.col("class").alias("b"), F.col("shingles").alias("of_b"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    counted = pairs.join(one, "a").join(two, "b").select("a", "b", both.alias("both"), (F.size("of_a") + F.size("of_b")).alias("sizes"))
    return counted.where(F.col("both") * 100 >= (F.col("sizes") - F.col("both")) * percent).select("a", "b")
