"""Repeated words and bytes against brute force, the exchange of keys, and the front-coded merge."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from inkweave.llm import meeting, suffix_dedup
from inkweave.llm.bytehash import Texts, words
from inkweave.llm.substring_dedup import remove_repeats
from inkweave.llm.suffix_dedup import remove_repeated_bytes

LAST = 2**63 - 1


def repeated(units, length, rows):
    """The units of each row that a window starting in a row with a smaller id covers."""
    first = {}
    for (i, _), u in zip(rows, units, strict=True):
        for j in range(len(u) - length + 1):
            w = tuple(u[j : j + length])
            first[w] = min(first.get(w, LAST), LAST if i is None else i)
    out = []
    for (i, _), u in zip(rows, units, strict=True):
        gone = [False] * len(u)
        for j in range(len(u) - length + 1):
            if first[tuple(u[j : j + length])] < (LAST if i is None else i):
                gone[j : j + length] = [True] * length
        out.append(gone)
    return out


def expected_words(rows, window):
    units = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    gone = repeated(units, window, rows)
    return sorted(
        (str(i), len(u), sum(g), " ".join(w for w, x in zip(u, g, strict=True) if not x)) for (i, _), u, g in zip(rows, units, gone, strict=True)
    )


@pytest.mark.parametrize("window", [13, 4])
def test_words(docs_of, odd_rows, window):
    found = remove_repeats(docs_of(odd_rows), window=window).collect()
    assert sorted((str(r.id), r.n_words, r.n_removed, r.kept_text) for r in found) == expected_words(odd_rows, window)


def test_bytes(docs_of, odd_rows):
    rows = [(i, t if t is None else t[:12_000]) for i, t in odd_rows]
    units = [(t or "").encode() for _, t in rows]
    gone = repeated(units, 50, rows)
    expected = sorted(
        (str(i), len(u), sum(g), len(re.findall("1+", "".join("01"[x] for x in g))), hashlib.sha256(bytes(c for c, x in zip(u, g, strict=True) if not x)).hexdigest())
        for (i, _), u, g in zip(rows, units, gone, strict=True)
    )
    found = remove_repeated_bytes(docs_of(rows)).collect()
    assert sorted((str(r.id), r.n_bytes, r.n_removed, len(r.span_starts), hashlib.sha256(r.kept).hexdigest()) for r in found) == expected
    for r in found:
        assert sum(r.span_ends) - sum(r.span_starts) == r.n_removed


@pytest.mark.parametrize("length, alphabet", [(10, "a\x00"), (6, "ab"), (50, "a\x00b"), (9, "aé\x00")])
@pytest.mark.parametrize("close", [1, 4096])
def test_bytes_of_few_letters(docs_of, monkeypatch, length, alphabet, close):
    """Many equal cores in different surroundings, zero bytes among them; cores are read one by one, and many at a time."""
    monkeypatch.setattr(suffix_dedup, "_CLOSE", close)
    rng = random.Random(length)
    shared = ["".join(rng.choice(alphabet) for _ in range(3 * length)) for _ in range(4)]
    rows = [(rng.randint(0, 30) or None, "".join(rng.choice([rng.choice(alphabet), rng.choice(alphabet), s[rng.randint(0, length) :]]) for s in rng.choices(shared, k=8))) for _ in range(60)]
    units = [t.encode() for _, t in rows]
    expected = sorted((str(i), sum(g), bytes(c for c, x in zip(u, g, strict=True) if not x)) for (i, _), u, g in zip(rows, units, repeated(units, length, rows), strict=True))
    found = remove_repeated_bytes(docs_of(rows), length=length).collect()
    assert sorted((str(r.id), r.n_removed, bytes(r.kept)) for r in found) == expected


def test_empty_tables(docs_of):
    empty = docs_of([])
    assert remove_repeats(empty).collect() == []
    assert remove_repeated_bytes(empty).collect() == []


def test_given_table(table):
    rows = [(r.doc_id, r.text) for r in table("documents").collect()]
    found = remove_repeats(table("documents")).collect()
    assert sorted((str(r.id), r.n_words, r.n_removed, r.kept_text) for r in found) == expected_words(rows, 13)


def test_merge_of_front_coded_runs():
    rng = random.Random(1)
    strings = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 9))).encode() + b"\xff" for _ in range(400)]
    runs = [sorted(set(strings[i::5])) for i in range(5)] + [[]]
    coded = [suffix_dedup.decoded(*suffix_dedup.front_code(r)) for r in runs if r]
    merged = list(suffix_dedup.merge([iter(c) for c in coded]))
    assert [m[0] for m in merged] == sorted(s for r in runs for s in r)
    for (a, _, _), (b, shares, _) in zip(merged, merged[1:], strict=False):
        assert shares == suffix_dedup.common_prefix(a, b, 0)


def test_shared_keys_and_first_holders():
    plan = meeting.Plan(4, 34)
    hashes = np.arange(1, 9, dtype=np.uint64) << np.uint64(59)
    one = meeting.send_keys(0, hashes[[0, 1, 2, 2]], np.array([0, 0, 0, 1]), np.array([True, False, False, True]), plan)
    two = meeting.send_keys(1, hashes[[0, 1, 5]], np.array([0, 0, 0]), np.array([False, False, True]), plan)
    sent = pa.concat_tables([one, two])
    answers = [meeting._meet(sent.filter(pa.array(sent["bucket"].to_numpy() == b))) for b in set(sent["bucket"].to_pylist())]
    found = pa.concat_tables(answers)
    of = lambda b: meeting.found_keys(found.filter(pa.array(found["batch"].to_numpy() == b))).tolist()
    # key 0 is indexed in one and held by the other; key 1 is indexed nowhere; key 2 by two documents of one batch
    assert of(0) == plan.short(hashes[[0, 2]]).tolist() and of(1) == plan.short(hashes[[0]]).tolist()
    wide = meeting.Plan(4, 60)
    assert meeting.send_keys(0, hashes[[0, 0]], np.array([0, 9]), True, wide).num_rows == 1


def test_anchors_fill_all_ranges_of_keys_alike():
    rng = random.Random(5)
    text = bytes(rng.choice(b"abcdefghijklmnop ") for _ in range(200_000)).decode()
    anchors = suffix_dedup.Anchors(Texts.of(pa.array([text])), 24, 50)
    plan = meeting.planned(len(text), 16)
    held = np.bincount(plan.bucket_of(plan.short(anchors.key)), minlength=plan.buckets)
    assert held.max() < 1.3 * held.mean() and held.min() > 0.7 * held.mean()


def test_words_never_cross_texts():
    texts = Texts.of(pa.array(["a b", None, "", "c", " d\x0be "]))
    found = words(texts)
    assert [texts.data[a:b].tobytes() for a, b in zip(found.starts, found.ends, strict=True)] == [b"a", b"b", b"c", b"d", b"e"]
    assert found.owner.tolist() == [0, 0, 3, 4, 4] and found.first.tolist() == [0, 2, 2, 2, 3, 5]


def alike():
    """Two different words of 1,024 bytes that every polynomial hash modulo 2^64 takes for one."""
    signs = [bin(i).count("1") % 2 for i in range(1024)]
    return "".join("ab"[x] for x in signs), "".join("ba"[x] for x in signs)


def test_words_that_polynomial_hashes_confuse(docs_of):
    one, other = alike()
    start = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{start} {one}"), (2, f"{start} {other}"), (3, f"{start} {one}")]
    cut = {r.id: r.n_removed for r in remove_repeats(docs_of(rows), window=13).collect()}
    assert cut == {1: 0, 2: 0, 3: 13}


def test_hashes_of_words_hold_all_of_their_bytes():
    from inkweave.llm.bytehash import word_digests

    rng = random.Random(4)
    said = ["".join(rng.choice("ab\x00é") for _ in range(rng.randint(1, 24))) for _ in range(3000)]
    said += [w[:-1] + x for w in said[:300] for x in "ab\x00"] + ["\x00" * n for n in range(1, 30)] + ["a" * n for n in range(1, 40)]
    rows = [" ".join(said[:1500]), None, "", "  \t" + "\n".join(said[1500:]), said[0], "a", " "]
    texts = Texts.of(pa.array(rows))
    found = words(texts)
    spelled = [texts.data[a:b].tobytes() for a, b in zip(found.starts, found.ends, strict=True)]
    hashes = word_digests(texts, found)
    for column in range(2):
        known = {}
        assert all(known.setdefault(w, h) == h for w, h in zip(spelled, hashes[:, column].tolist(), strict=True))
        assert len(set(known.values())) == len(set(spelled)) > 1000
    assert word_digests(Texts.of(pa.array([None], pa.string())), words(Texts.of(pa.array([None], pa.string())))).shape == (0, 2)
