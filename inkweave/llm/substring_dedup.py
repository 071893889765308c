"""Substring dedup over words: fixed-block anchors.

Every document's non-overlapping blocks of words are indexed, and every rolling window of the same length probes
them. Any repeat of ``window`` words holds a whole block of the document that it repeats, if a block has
``(window + 1) // 2`` words, so no repeat is missed. A hit is extended over all windows that hold its block: these are
judged one by one, by 96 bits made of digests of their words, and the union of the repeated ones is the maximal exact
repeat. Blocks and windows meet in packed exchanges (meeting.py), never as pairs of documents, so a passage that a
million documents share costs one entry per batch; that is why windows are judged by their digests, and a hit is not
followed word by word into each of the documents that share it.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from inkweave.llm import meeting
from inkweave.llm.bytehash import RollingHash, Texts, word_digests, words

_ONE, _TWO = RollingHash(11), RollingHash(23)
_CUT = "id long, kept_text string, n_words long, n_removed long"
_CUT_ARROW = pa.schema([("id", pa.int64()), ("kept_text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64())])


def remove_repeats(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """Documents without the words that a document with a smaller id has already said.

    Words are runs of bytes other than space and U+0009 to U+000D, compared as they are. A word goes if one of the
    ``window``-word windows covering it starts in a document with a smaller id too; windows are judged on the input.
    Returns one row per input row: ``id``, ``kept_text`` (kept words joined by one space), ``n_words``, ``n_removed``.

    A null or empty text, or one of fewer words than the window, keeps all it has (``kept_text`` is then never null).
    Rows with one id are one another's equals: neither loses words to the other. A row without an id comes after
    all others. Further columns are left out, so their names do not matter; an empty table gives an empty result.
    """
    if window < 2:
        raise ValueError("a window takes two words at least")
    rows, plan = meeting.batched(documents, id_col, text_col)
    block = (window + 1) // 2
    sent = meeting.by_batch(rows, _blocks, meeting.SENT, block=block, plan=plan)
    hits = meeting.shared_keys(sent)
    claimed = meeting.by_batch(rows, _claims, meeting.CLAIMED, hits, block=block, window=window, plan=plan)
    first = meeting.first_holders(claimed)
    return meeting.by_batch(rows, _cut, _CUT, first, window=window)


def _hashed(texts: Texts, *lengths: int):
    """Words, and for each length both hashes of the windows of so many words, and which of them lie in one text."""
    found = words(texts)
    digests = word_digests(texts, found)
    out = []
    for length in lengths:
        high, low = _ONE.windows(digests[:, 0], length), _TWO.windows(digests[:, 1], length)
        inside = found.owner[: len(high)] == found.owner[length - 1 :] if len(high) else np.zeros(0, bool)
        out.append((high, (low >> np.uint64(32)).astype(np.uint32), inside))
    return found, *out


def _blocks(table: pa.Table, block: int, plan: meeting.Plan) -> pa.Table:
    found, (hashes, _, inside) = _hashed(Texts.of(table["text"]), block)
    at = np.flatnonzero(inside)
    owner = found.owner[at]
    aligned = (at - found.first[owner]) % block == 0
    ids = np.unique(meeting.ids_of(table), return_inverse=True)[1]
    return meeting.send_keys(table["batch"][0].as_py(), hashes[at], ids[owner], aligned, plan)


def _claims(table: pa.Table, hits: pa.Table, block: int, window: int, plan: meeting.Plan) -> pa.Table:
    if not table.num_rows or not hits.num_rows:
        return meeting.claim(0, np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64), plan)
    found, (blocks, _, whole), (high, low, inside) = _hashed(Texts.of(table["text"]), block, window)
    hit = whole & meeting.contained(plan.short(blocks), meeting.found_keys(hits))
    # a window is looked at if one of its blocks is hit
    before = np.concatenate([[0], np.cumsum(hit)])
    n, span = len(high), window - block + 1
    near = inside & (before[span : span + n] > before[:n])
    ids = meeting.ids_of(table)[found.owner[:n]]
    return meeting.claim(table["batch"][0].as_py(), high[near], low[near], ids[near], plan)


def _cut(table: pa.Table, answers: pa.Table, window: int) -> pa.Table:
    if not table.num_rows:
        return _CUT_ARROW.empty_table()
    texts = Texts.of(table["text"])
    found, (high, low, inside) = _hashed(texts, window)
    n = len(high)
    least = meeting.least_ids(answers, high, low)
    repeated = inside & (least < meeting.ids_of(table)[found.owner[:n]])
    edges = np.zeros(len(found) + 1, np.int64)
    edges[:n] += repeated
    edges[window : window + n] -= repeated
    keep = np.cumsum(edges[:-1]) == 0
    sizes = np.diff(found.first)
    before = np.concatenate([[0], np.cumsum(keep)])
    kept = before[found.first[1:]] - before[found.first[:-1]]
    out = []
    for i in range(len(texts)):
        said = texts.bytes_of(i).split()
        if kept[i] < sizes[i]:
            said = compress(said, keep[found.first[i] : found.first[i + 1]].tolist())
        out.append(b" ".join(said))
    columns = [table["id"].combine_chunks(), pa.array(out, pa.binary()).cast(pa.string()), pa.array(sizes), pa.array(sizes - kept)]
    return pa.Table.from_arrays(columns, schema=_CUT_ARROW)
