"""Suffix-array dedup over bytes: a distributed merge sort of suffixes that knows common prefixes.

A repeat of ``length`` bytes holds an anchor, the place of the least hash among its ``CORE``-byte substrings; equal
strings have equal anchors. So instead of a suffix per byte the sort takes one per anchor, with the context in which
windows choose that anchor: the suffix from the anchor on, a terminator, and the bytes before it, backwards. Anchors
whose core no other document has are left out first (meeting.py). A batch of documents sorts its suffixes and sends
them front-coded (length of the prefix shared with the one before, and the rest) to ranges of core hashes; each range
merges the runs with a loser tree whose matches are decided by stored common-prefix lengths and never read a known
prefix again. Equal suffixes come out side by side, and those of one core too, which tells for each window of each
suffix the first document that holds it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from inkweave.llm import meeting
from inkweave.llm.bytehash import RollingHash, Texts, mix

_ROLLING = RollingHash(37)
_END = b"\xff"  # no byte of UTF-8
_PLACE_BITS = 32
_PIECE_BYTES = 128 << 10
#: Suffixes whose windows are read from the merged order together; a core is never cut.
_CLOSE = 4096

_RUNS = pa.schema([("bucket", pa.int64()), ("batch", pa.int64()), *((n, pa.binary()) for n in ("shared", "sizes", "rest", "least", "most"))])
_RUNS_SQL = "bucket long, batch long, shared binary, sizes binary, rest binary, least binary, most binary"
_TOLD = pa.schema([("batch", pa.int64()), ("bucket", pa.int64()), *((n, pa.binary()) for n in ("item", "begin", "end", "least"))])
_TOLD_SQL = "batch long, bucket long, item binary, begin binary, end binary, least binary"
_CUT = pa.schema(
    [
        ("id", pa.int64()),
        ("kept", pa.binary()),
        ("n_bytes", pa.int64()),
        ("n_removed", pa.int64()),
        ("span_starts", pa.list_(pa.int64())),
        ("span_ends", pa.list_(pa.int64())),
    ]
)
_CUT_SQL = "id long, kept binary, n_bytes long, n_removed long, span_starts array<long>, span_ends array<long>"


def remove_repeated_bytes(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """Documents without the bytes of strings that start in a document with a smaller id too.

    Texts are UTF-8 bytes; a byte goes if one of the ``length``-byte strings covering it also starts in a document
    with a smaller id. Strings never cross documents and are judged on the input. Returns one row per input row:
    ``id``, ``kept`` (binary, as a cut may fall inside a character), ``n_bytes``, ``n_removed``, and the removed
    spans as ``span_starts`` and ``span_ends`` (byte offsets, maximal runs, in order).

    A null text counts as empty; texts shorter than ``length`` lose nothing. Rows with one id are one another's
    equals: neither loses bytes to the other. A row without an id comes after all others. Further columns are left
    out, so their names do not matter; an empty table gives an empty result.
    """
    if length < 4:
        raise ValueError("a string takes four bytes at least")
    core = (length + 1) // 2 - 1
    rows, plan = meeting.batched(documents, id_col, text_col)
    shape = {"core": core, "length": length}
    sent = meeting.by_batch(rows, _send_cores, meeting.SENT, plan=plan, **shape)
    shared = meeting.shared_keys(sent)
    runs = meeting.by_batch(rows, _send_runs, _RUNS_SQL, shared, plan=plan, **shape)
    told = runs.groupBy("bucket").applyInArrow(lambda table: _merge_runs(table, core, length), _TOLD_SQL)
    answers = meeting.by_batch(rows, _cut, _CUT_SQL, _with_cores(shared, told), plan=plan, **shape)
    return answers


def _with_cores(shared: DataFrame, told: DataFrame) -> DataFrame:
    """Both answers to a batch in one frame: which cores are shared, and what the merge told of their suffixes."""
    return shared.unionByName(told, allowMissingColumns=True)


# --- anchors ------------------------------------------------------------------------------------------------


class Anchors:
    """For each run of windows choosing one anchor: first and last window start, the anchor, its core's hash, its text."""

    def __init__(self, texts: Texts, core: int, length: int):
        found = []
        for first, piece in texts.pieces(_PIECE_BYTES):
            base = texts.offsets[first]
            begin, last, at, key = _anchors_of(piece, core, length)
            found.append((begin + base, last + base, at + base, key))
        none = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)]
        self.begin, self.last, self.at, self.key = map(np.concatenate, zip(*(found or none), strict=True))
        self.owner = texts.owner(self.begin)


def _anchors_of(texts: Texts, core: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, n = texts.data, len(texts.data)
    span = length - core + 1  # cores of a window
    windows = n - length + 1
    if windows <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    grams = _ROLLING.prefix(_ROLLING.values[data])
    hashes = mix((grams[core:] - grams[:-core]) * _ROLLING.powers(n + 1)[1][: n - core + 1])
    place = np.uint64((1 << _PLACE_BITS) - 1)
    least = (hashes & ~place) | np.arange(len(hashes), dtype=np.uint64)
    reach = 1
    while reach * 2 <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    least = np.minimum(least[:windows], least[span - reach : span - reach + windows])
    chosen = (least & place).astype(np.int64)
    room = np.diff(texts.offsets) - length + 1
    full = room > 0
    edges = np.zeros(n + 1, np.int8)
    np.add.at(edges, texts.offsets[:-1][full], 1)
    np.add.at(edges, texts.offsets[:-1][full] + room[full], -1)
    inside = np.cumsum(edges, dtype=np.int8)[:windows] > 0
    new = np.ones(windows, bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | ~inside[:-1]
    stop = np.ones(windows, bool)
    stop[:-1] = new[1:] | ~inside[1:]
    begin, last = np.flatnonzero(new & inside), np.flatnonzero(stop & inside)
    at = chosen[begin]
    # least hashes are small ones: mixed anew, so that the ranges of keys hold equally many
    return begin, last, at, mix(hashes[at])


def _send_cores(table: pa.Table, core: int, length: int, plan: meeting.Plan) -> pa.Table:
    anchors = Anchors(Texts.of(table["text"]), core, length)
    ids = np.unique(meeting.ids_of(table), return_inverse=True)[1]
    return meeting.send_keys(table["batch"][0].as_py(), anchors.key, ids[anchors.owner], True, plan)


# --- runs of sorted suffixes --------------------------------------------------------------------------------


def _suffixes(texts: Texts, anchors: Anchors, keys: np.ndarray, length: int, plan: meeting.Plan):
    """The shared anchors by bucket: their numbers, their suffixes, and the distinct suffixes in order."""
    chosen = np.flatnonzero(meeting.contained(plan.short(anchors.key), keys))
    bucket = plan.bucket_of(plan.short(anchors.key[chosen]))
    chosen = chosen[np.argsort(bucket, kind="stable")]
    bucket = np.sort(bucket)
    raw = texts.data.tobytes()
    begin, at, end = anchors.begin[chosen].tolist(), anchors.at[chosen].tolist(), (anchors.last[chosen] + length).tolist()
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist() + [len(chosen)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        texts_of = [raw[at[i] : end[i]] + _END + raw[begin[i] : at[i]][::-1] + _END for i in range(a, b)]
        yield int(bucket[a]), chosen[a:b], texts_of, sorted(set(texts_of))


def _send_runs(table: pa.Table, answers: pa.Table, core: int, length: int, plan: meeting.Plan) -> pa.Table:
    rows = {n: [] for n in _RUNS.names}
    if table.num_rows and answers.num_rows:
        texts = Texts.of(table["text"])
        anchors = Anchors(texts, core, length)
        ids = meeting.ids_of(table)
        batch = table["batch"][0].as_py()
        for bucket, numbers, suffixes, distinct in _suffixes(texts, anchors, meeting.found_keys(answers), length, plan):
            place = {s: i for i, s in enumerate(distinct)}
            item = np.fromiter((place[s] for s in suffixes), np.int64, len(suffixes))
            owners = ids[anchors.owner[numbers]]
            least, most = np.full(len(distinct), meeting.NO_ID), np.full(len(distinct), np.iinfo(np.int64).min)
            np.minimum.at(least, item, owners)
            np.maximum.at(most, item, owners)
            shared, sizes, rest = front_code(distinct)
            for name, value in zip(_RUNS.names, (bucket, batch, shared, sizes, rest, least.tobytes(), most.tobytes()), strict=True):
                rows[name].append(value)
    return pa.table(rows, _RUNS)


def front_code(ascending: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """Lengths of the prefix each string shares with the one before, whole lengths, and the bytes that remain."""
    sizes = np.fromiter(map(len, ascending), np.int64, len(ascending))
    padded = np.array(ascending).view(np.uint8).reshape(len(ascending), -1)
    shared = np.zeros(len(ascending), np.int64)
    if len(ascending) > 1:
        differ = padded[1:] != padded[:-1]
        shared[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), padded.shape[1])
        shared[1:] = np.minimum(shared[1:], np.minimum(sizes[1:], sizes[:-1]))
    rest = b"".join([s[k:] for s, k in zip(ascending, shared.tolist(), strict=True)])
    return shared.astype("<u4").tobytes(), sizes.astype("<u4").tobytes(), rest


def decoded(shared: bytes, sizes: bytes, rest: bytes) -> Iterator[tuple[bytes, int]]:
    """The strings of a front-coded run with their shared lengths, one after the other."""
    last, at = b"", 0
    for known, size in zip(np.frombuffer(shared, "<u4").tolist(), np.frombuffer(sizes, "<u4").tolist(), strict=True):
        last = last[:known] + rest[at : at + size - known]
        at += size - known
        yield last, known


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two strings whose first ``known`` bytes are equal."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    differ = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (differ.bit_length() + 7) // 8


def merge(runs: list[Iterator[tuple[bytes, int]]]) -> Iterator[tuple[bytes, int, int]]:
    """Merges ascending runs of (string, prefix shared with the run's last one) by a loser tree.

    Yields (string, prefix shared with the string yielded before, run). Each waiting string carries the length of the
    prefix that it shares with the last winner it is known to follow. Of two strings the one sharing more comes
    first; only if they share equally much are bytes read, and only those behind the known prefix.
    """
    size = 1
    while size < len(runs):
        size *= 2
    live = [next(r, None) for r in runs] + [None] * (size - len(runs))
    entry: list[tuple[bytes, int, int] | None] = [None if x is None else (x[0], 0, i) for i, x in enumerate(live)]

    def match(a, b):
        """The earlier entry, and the later one with the prefix it shares with the earlier."""
        if a is None:
            return b, a
        if b is None:
            return a, b
        if a[1] != b[1]:
            return (a, b) if a[1] > b[1] else (b, a)
        s, t, known = a[0], b[0], a[1]
        shares = common_prefix(s, t, known)
        if s[shares:] < t[shares:] or (len(s) == shares == len(t) and a[2] < b[2]):
            return a, (t, shares, b[2])
        return b, (s, shares, a[2])

    losers: list[tuple[bytes, int, int] | None] = [None] * size
    level = entry
    offset = size
    while len(level) > 1:
        offset //= 2
        above = []
        for i in range(0, len(level), 2):
            winner, loser = match(level[i], level[i + 1])
            losers[offset + i // 2] = loser
            above.append(winner)
        level = above
    winner = level[0]
    while winner is not None:
        yield winner
        run = winner[2]
        following = next(runs[run], None)
        current = None if following is None else (following[0], following[1], run)
        node = (size + run) // 2
        while node:
            waiting = losers[node]
            if waiting is not None:
                if current is None or waiting[1] > current[1]:
                    losers[node], current = current, waiting
                elif waiting[1] == current[1]:
                    current, losers[node] = match(current, waiting)
            node //= 2
        winner = current


def _merge_runs(table: pa.Table, core: int, length: int) -> pa.Table:
    """Tells each batch which windows of its suffixes start in an earlier document."""
    bucket = table["bucket"][0].as_py()
    batches = table["batch"].to_pylist()
    runs = [decoded(*x) for x in zip(table["shared"].to_pylist(), table["sizes"].to_pylist(), table["rest"].to_pylist(), strict=True)]
    least = [np.frombuffer(x, "<i8") for x in table["least"].to_pylist()]
    most = [np.frombuffer(x, "<i8") for x in table["most"].to_pylist()]
    told: list[list[tuple]] = [[] for _ in runs]
    position = [0] * len(runs)
    # of whole cores: distinct suffixes, prefixes shared with the one before, and the members (suffix, run, item)
    suffixes: list[bytes] = []
    shared: list[int] = []
    members: list[tuple[int, int, int]] = []

    def close() -> None:
        of, run, item = np.array(members, np.int64).T
        ids = np.full(len(suffixes), meeting.NO_ID)
        lows, highs = (np.array([x[r][i] for r, i in zip(run.tolist(), item.tolist(), strict=True)]) for x in (least, most))
        np.minimum.at(ids, of, lows)
        owner, begin, end, first = _first_windows(suffixes, np.array(shared), ids, length)
        # every member is told the segments of its suffix that an earlier document than its last one holds
        low, high = np.searchsorted(owner, of), np.searchsorted(owner, of, side="right")
        which = np.repeat(np.arange(len(of)), high - low)
        segment = np.arange(len(which)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)
        early = first[segment] < highs[which]
        which, segment = which[early], segment[early]
        for r in np.unique(run[which]).tolist():
            own = run[which] == r
            told[r].append((item[which[own]], begin[segment[own]], end[segment[own]], first[segment[own]]))

    for suffix, shares, run in merge(runs):
        item = position[run]
        position[run] = item + 1
        if suffixes and shares == len(suffix) == len(suffixes[-1]):
            members.append((len(suffixes) - 1, run, item))
            continue
        if len(suffixes) >= _CLOSE and shares < core:
            close()
            suffixes, shared, members = [], [], []
        members.append((len(suffixes), run, item))
        suffixes.append(suffix)
        shared.append(shares)
    if suffixes:
        close()
    rows = {n: [] for n in _TOLD.names}
    for batch, parts in zip(batches, told, strict=True):
        if parts:
            blobs = (np.concatenate(x).astype(t) for x, t in zip(zip(*parts, strict=True), ("<u4", "<u4", "<u4", "<i8"), strict=True))
            for name, value in zip(_TOLD.names, (batch, bucket, *(b.tobytes() for b in blobs)), strict=True):
                rows[name].append(value)
    return pa.table(rows, _TOLD)


def _first_windows(suffixes: list[bytes], shared: np.ndarray, ids: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows (suffix, first, last + 1, least id that holds them all), ascending by suffix and place.

    Read from common prefixes alone. A window with ``left`` bytes before the core has ``length - left`` from it on: in
    the merged order equal ones lie in one run of suffixes whose neighbours share so much, and in the order of what
    lies before the core, backwards, in one run that shares ``left`` bytes. So two numbers of runs name a window, and
    the least id of each pair is its first holder.
    """
    n = len(suffixes)
    ahead = np.fromiter((s.index(_END) for s in suffixes), np.int64, n)
    behind = np.fromiter(map(len, suffixes), np.int64, n) - ahead - 2
    shared = np.minimum(shared, ahead)
    back = np.array([s[k + 1 : -1] for s, k in zip(suffixes, ahead.tolist(), strict=True)])
    order = np.lexsort((behind, back))  # numpy takes zero bytes at the end for none: the length tells them apart
    width = back.dtype.itemsize
    if width:
        spelled = back[order].view(np.uint8).reshape(n, width)
        differ = spelled[1:] != spelled[:-1]
        same = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    else:
        same = np.zeros(max(n - 1, 0), np.int64)
    same = np.concatenate([[0], np.minimum(same, np.minimum(behind[order][1:], behind[order][:-1]))]) if n > 1 else np.zeros(n, np.int64)
    lefts = np.arange(int(min(behind.max(initial=0), length)), -1, -1)
    held = np.full((n, len(lefts)), meeting.NO_ID)
    valid = np.zeros((n, len(lefts)), bool)
    run = np.empty(n, np.int64)
    for j, left in enumerate(lefts.tolist()):
        at = np.flatnonzero((behind >= left) & (ahead >= length - left))
        if not len(at):
            continue
        run[order] = np.cumsum(same < left) if left else 0
        named = np.cumsum(shared < length - left)[at] * (n + 1) + run[at]
        by_name = np.argsort(named, kind="stable")
        begins = meeting.run_starts(named[by_name])
        first = np.minimum.reduceat(ids[at[by_name]], begins)
        held[at[by_name], j] = np.repeat(first, np.diff(np.append(begins, len(at))))
        valid[at, j] = True
    owner, column = np.nonzero(valid)  # by suffix, and by place within it, as the bytes on the left grow fewer
    least, begin = held[owner, column], behind[owner] - lefts[column]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (least[1:] != least[:-1]) | (begin[1:] != begin[:-1] + 1)
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(owner)) - 1
    return owner[starts], begin[starts], begin[ends] + 1 if len(starts) else begin[starts], least[starts]


# --- the cut ------------------------------------------------------------------------------------------------


def _cut(table: pa.Table, answers: pa.Table, core: int, length: int, plan: meeting.Plan) -> pa.Table:
    if not table.num_rows:
        return _CUT.empty_table()
    texts = Texts.of(table["text"])
    cover = np.zeros(len(texts.data) + 1, np.int64)
    told = answers.filter(answers["item"].is_valid()) if answers.num_rows else answers
    if told.num_rows:
        shared = answers.filter(answers["keys"].is_valid())
        ids, anchors = meeting.ids_of(table), Anchors(texts, core, length)
        by_bucket = {row["bucket"]: row for row in told.to_pylist()}
        for bucket, numbers, suffixes, distinct in _suffixes(texts, anchors, meeting.found_keys(shared), length, plan):
            row = by_bucket.get(bucket)
            if row is None:
                continue
            place = {s: i for i, s in enumerate(distinct)}
            item = np.fromiter((place[s] for s in suffixes), np.int64, len(suffixes))
            items, begins, ends = (np.frombuffer(row[n], "<u4").astype(np.int64) for n in ("item", "begin", "end"))
            firsts = np.frombuffer(row["least"], "<i8")
            order = np.argsort(items, kind="stable")
            items, begins, ends, firsts = items[order], begins[order], ends[order], firsts[order]
            low, high = np.searchsorted(items, item), np.searchsorted(items, item, side="right")
            which = np.repeat(np.arange(len(item)), high - low)
            segment = np.arange(len(which)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)
            gone = firsts[segment] < ids[anchors.owner[numbers[which]]]
            which, segment = which[gone], segment[gone]
            start = anchors.begin[numbers[which]]
            np.add.at(cover, start + begins[segment], 1)
            np.add.at(cover, start + ends[segment] - 1 + length, -1)
    gone = np.cumsum(cover[:-1]) > 0
    return _pieces(table, texts, gone)


def _pieces(table: pa.Table, texts: Texts, gone: np.ndarray) -> pa.Table:
    sizes = np.diff(texts.offsets)
    edge = np.zeros(len(gone) + 1, bool)
    edge[texts.offsets] = True
    before, after = np.zeros(len(gone), bool), np.zeros(len(gone), bool)
    before[1:], after[:-1] = gone[:-1], gone[1:]
    starts = np.flatnonzero(gone & (~before | edge[:-1]))
    ends = np.flatnonzero(gone & (~after | edge[1:])) + 1
    counts = np.concatenate([[0], np.cumsum(gone)])
    removed = counts[texts.offsets[1:]] - counts[texts.offsets[:-1]]
    kept = texts.data[~gone]
    kept_at = np.concatenate([[0], np.cumsum(sizes - removed)])
    span_at = pa.array(np.searchsorted(starts, texts.offsets).astype(np.int32))
    base = texts.offsets[texts.owner(starts)] if len(starts) else starts
    raw = kept.tobytes()
    blobs = [raw[a:b] for a, b in zip(kept_at.tolist(), kept_at[1:].tolist(), strict=False)]
    columns = [
        table["id"].combine_chunks(),
        pa.array(blobs, pa.binary()),
        pa.array(sizes),
        pa.array(removed),
        pa.ListArray.from_arrays(span_at, pa.array(starts - base, pa.int64())),
        pa.ListArray.from_arrays(span_at, pa.array(ends - base, pa.int64())),
    ]
    return pa.Table.from_arrays(columns, schema=_CUT)
