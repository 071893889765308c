"""The registered queries without SQL, on the smallest data folder: columns, classes and digests against brute force."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from inkweave.llm.catalog import FURTHER, ORACLE, QUERIES

from conftest import FOLDER  # isort: skip

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FIRST_COLUMNS = {
    "op2_source_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op3_suffix_array_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op4_pii_pseudonyms": ["doc_id", "text"],
    "op5_minhash_near_dedup": ["doc_id", "n_shingles", "component_id", "kept"],
    "op6_quality_trees": ["doc_id", "held_out", "score", "predicted"],
    "op7_posting_list_ann": ["query_id", "rank", "vec_id", "score"],
    "op10_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op11_embedding_whitening": ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
}


@pytest.fixture(scope="module")
def texts(table):
    return {r.doc_id: r for r in table("documents").collect()}


def rows(spark, name):
    return {r.doc_id: r for r in QUERIES[name](spark, FOLDER).collect()}


def crc(value):
    return zlib.crc32(str(value).encode())


def test_columns(spark):
    assert set(FIRST_COLUMNS) == set(QUERIES) - set(ORACLE)
    for name, columns in FIRST_COLUMNS.items():
        assert set(columns) <= set(QUERIES[name](spark, FOLDER).columns), name


def test_op2(spark, texts):
    found = rows(spark, "op2_source_mixing")
    sizes = {i: len(WORD.findall(r.text or "")) for i, r in texts.items()}
    assert {i: r["size"] for i, r in found.items()} == sizes
    for name in {r.source for r in texts.values()}:
        own = [i for i, r in texts.items() if r.source == name]
        total = sum(sizes[i] for i in own)
        assert {found[i]["source_size"] for i in own} == {total} and len({found[i]["target"] for i in own}) == 1
        assert abs(sum(found[i]["taken"] for i in own) - found[own[0]]["target"]) <= 1 + max(sizes[i] for i in own)
        assert all(found[i]["taken"] <= 3 * sizes[i] for i in own)
    assert abs(sum(sizes.values()) - sum({r.source: found[i]["target"] for i, r in texts.items()}.values())) < 1


def test_op3(spark, texts):
    first: dict[bytes, int] = {}
    raw = {i: (r.text or "").encode() for i, r in sorted(texts.items())}
    for i, data in raw.items():
        for j in range(len(data) - 49):
            first.setdefault(data[j : j + 50], i)
    found = rows(spark, "op3_suffix_array_dedup")
    assert set(found) == set(raw)
    for i, data in raw.items():
        gone = np.zeros(len(data) + 1, int)
        for j in range(len(data) - 49):
            if first[data[j : j + 50]] < i:
                gone[j] += 1
                gone[min(j + 50, len(data))] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        kept = bytes(np.frombuffer(data, np.uint8)[~gone]) if data else b""
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(gone) else 0
        r = found[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())


def test_op4(spark, texts):
    found = rows(spark, "op4_pii_pseudonyms")
    assert set(found) == set(texts)
    for i, r in found.items():
        assert (r.text == texts[i].text) == (r.n_found == 0) and (r.kinds == "") == (r.n_found == 0)
        assert r.text_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
    assert sum(r.n_found > 0 for r in found.values()) > 3


def test_op5(spark, texts):
    from test_near_dedup import all_pairs, shingles

    component = all_pairs([(i, r.text) for i, r in texts.items()], 2)
    found = rows(spark, "op5_minhash_near_dedup")
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in found.items()} == {
        i: (len(shingles(r.text, 2)), component[i], component[i] == i) for i, r in texts.items()
    }


def test_op6(spark, texts, table):
    found = rows(spark, "op6_quality_trees")
    assert {i: r.held_out for i, r in found.items()} == {i: crc(i) % 4 == 2 for i in texts}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found.values())
    labels = {r.doc_id: r.quality for r in table("labels").collect() if crc(r.doc_id) % 4 == 2}
    assert np.mean([found[i].predicted == q for i, q in labels.items()]) > 0.9


def test_op7(spark, table):
    vectors = {r.vec_id: np.array(r.embedding, float) for r in table("embeddings").collect()}
    ids, points = np.array(list(vectors)), np.stack(list(vectors.values()))
    found = {}
    for r in QUERIES["op7_posting_list_ann"](spark, FOLDER).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(found) == {i for i in vectors if i % 20 == 0}
    hits = 0
    for q, own in found.items():
        score = points @ vectors[q]
        best = [i for i in ids[np.lexsort((ids, -score))] if i != q][:20]
        assert [r for r, _, _ in sorted(own)] == list(range(1, 21))
        assert np.allclose([s for _, _, s in sorted(own)], [vectors[q] @ vectors[i] for _, i, _ in sorted(own)], atol=1e-12)
        hits += len(set(best) & {i for _, i, _ in own})
    assert hits >= 0.95 * 20 * len(found)


def test_op8_near_matches(spark, texts, table):
    from test_text_operators import near

    items = [(r.item_id, r.text) for r in table("benchmark").collect()]
    found = {r.doc_id: (r.n_near, r.n_places) for r in FURTHER["op8_near_matches"](spark, FOLDER).collect()}
    wanted: dict[str, set] = {}
    for doc, item, first, second in near([(i, r.text) for i, r in texts.items()], items, 8):
        wanted.setdefault(doc, set()).add((item, first, second))
    assert found == {
        i: (len({item for item, _, _ in wanted.get(str(i), ())}), len({(a, b) for _, a, b in wanted.get(str(i), ())})) for i in texts
    }


def test_op10(spark, texts):
    found = rows(spark, "op10_language_id")
    assert {i: r.held_out for i, r in found.items()} == {i: crc(i) % 3 == 1 for i in texts}
    known = {r.lang for r in texts.values() if r.lang} | {"und"}
    assert all(r.lang_pred in known and 0 <= r.score <= 1 for r in found.values())
    held = [i for i, r in texts.items() if crc(i) % 3 == 1 and r.lang]
    assert np.mean([found[i].lang_pred == texts[i].lang for i in held]) > 0.9


def test_op11(spark, table):
    x = np.floor(1024 * np.stack([np.array(r.embedding, float) for r in table("embeddings").orderBy("vec_id").collect()])).astype(int) + 100_000
    n, sums = len(x), x.sum(axis=0)
    found = QUERIES["op11_embedding_whitening"](spark, FOLDER).orderBy("vec_id", "component").collect()
    assert len(found) == 8 * n and {r.n for r in found} == {n} and len({r.identity_error for r in found}) == 1 and found[0].identity_error <= 1e-4
    assert [r.deviation for r in found[::8]] == [int(d) for d in ((n * x - sums) ** 2).sum(axis=1)]
    centred = x - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:8], vectors[:, ::-1][:, :8]
    made = np.array([r.whitened for r in found]).reshape(n, 8)
    wanted = centred @ vectors / np.sqrt(values)
    assert np.abs(made - wanted * np.sign((made * wanted).sum(axis=0))).max() < 1e-8
    assert np.allclose([r.explained for r in found[:8]], values / np.trace(centred.T @ centred / n), rtol=1e-9)


def test_columns_of_the_trie_and_the_verdicts(spark):
    trie = {"conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"}
    assert trie <= set(QUERIES["op12_conversation_trie"](spark, FOLDER).columns)
    assert QUERIES["op13_url_cascade"](spark, FOLDER).columns == ["page_id", "host", "path", "rule", "verdict"]
