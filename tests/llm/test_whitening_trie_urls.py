"""Whitening against exact integers, the conversation trie and the url cascade against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkweave.llm import conversation_trie, url_cascade, whitening

# --- whitening ------------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>, n long, deviation string, whitened string, v string, in_0 string"


def whitened(spark, rows, **more):
    frame = spark.createDataFrame([(i, v, 1, "x", "x", "x", "x") for i, v in rows], VECTORS).repartition(3)
    return whitening.whiten(frame, **more).collect()


def exact_fit(points):
    """x, n, sums and the covariance by plain integers."""
    x = [[int(np.floor(1024 * c)) + 100_000 for c in p] for p in points]
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    z = [[n * r[j] - sums[j] for j in range(d)] for r in x]
    cov = np.array([[sum(r[i] * r[j] for r in z) / n**3 for j in range(d)] for i in range(d)])
    return z, n, cov


def check_whitening(found, rows, most=8):
    z, n, cov = exact_fit([v for _, v in rows])
    by = defaultdict(list)
    for r in found:
        by[r.vec_id].append(r)
    assert sorted((r.vec_id for r in found), key=repr) == sorted((i for i, _ in rows), key=repr)
    values = np.linalg.eigvalsh(cov)[::-1]
    width = len(found[0].whitened)
    assert width == min(most, int((values[: most] > 1e-9 * values[0]).sum()))
    matrix, order = [], []
    for (i, _), line in zip(rows, z, strict=True):
        r = next(r for r in by[i] if r.deviation == (s if (s := sum(c * c for c in line)) < 2**63 else None))
        by[i].remove(r)
        assert r.n == n and np.allclose(r.explained, values[:width] / np.trace(cov), rtol=1e-9)
        matrix.append(r.whitened)
        order.append([c / n for c in line])
    w, centred = np.array(matrix), np.array(order)
    assert np.abs(w.T @ w / n - np.eye(width)).max() < 1e-9 and found[0].identity_error < 1e-9
    # w = y P / sqrt(e): the components come back from the covariance of y and w
    parts = centred.T @ w / n / np.sqrt(values[:width])
    assert np.abs(cov @ parts - parts * values[:width]).max() < 1e-9 * values[0]
    assert np.abs(parts.T @ parts - np.eye(width)).max() < 1e-9


def test_whitening_of_plain_rows(spark, monkeypatch):
    monkeypatch.setattr(whitening, "PRODUCT_ROWS", 32)
    monkeypatch.setattr(whitening, "FLUSH", 2)
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=12) * np.linspace(0.1, 2, 12)).tolist()) for i in range(300)]
    check_whitening(whitened(spark, rows), rows)
    check_whitening(whitened(spark, rows, components=3), rows, 3)


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(4)
    good = [(i, rng.normal(size=5).tolist()) for i in range(40)] + [(None, [1.0, 2.0, 3.0, 4.0, -5.0]), (7, [9.0, 0.0, 0.0, 0.0, 0.0])]
    odd = [(50, None), (51, []), (52, [1.0, None, 1.0, 1.0, 1.0]), (53, [float("nan")] * 5), (54, [float("-inf")] * 5), (55, [1.0, 2.0]), (56, [1e300] * 5)]
    check_whitening(whitened(spark, good + odd + good[:1]), good + good[:1])
    assert whitened(spark, []) == [] and whitened(spark, odd[:5]) == []
    for same in ([(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 3):
        found = whitened(spark, same)
        assert [(r.n, r.deviation, r.whitened, r.identity_error) for r in found] == [(len(same), 0, [], 0.0)] * len(same)


def test_whitening_of_large_numbers(spark):
    """Entries beyond one limb, and deviations beyond a long."""
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) * 1e9, rng.uniform(-1, 1) * 1e6, rng.uniform(-1, 1) * 1e9]) for i in range(60)]
    check_whitening(whitened(spark, rows), rows)
    assert any(r.deviation is None for r in whitened(spark, rows))


@pytest.mark.parametrize(
    "values",
    [np.logspace(0, 6, 40), np.ones(40), 5 + np.arange(40) * 1e-9, np.r_[5 + np.arange(20) * 1e-12, 1 + np.arange(20) * 1e-13], np.r_[np.zeros(37), 1, 2, 2], np.r_[np.ones(39), 1 + 1e-10]],
)
def test_eigenvectors_of_clustered_values(values):
    high = np.longdouble
    q = np.linalg.qr(np.random.default_rng(1).normal(size=(40, 40)))[0].astype(high)
    for _ in range(3):
        q = q + q @ (np.eye(40) - q.T @ q) / 2
    a = (q * values.astype(high)) @ q.T
    found, x = whitening.eigenvectors(a)
    assert np.abs(found - np.sort(values)[::-1]).max() < 1e-16 * values.max()
    assert np.abs(a @ x - x * found).max() < 1e-16 * values.max() and np.abs(x.T @ x - np.eye(40)).max() < 1e-16
    assert whitening.eigenvectors(np.zeros((3, 3)))[0].tolist() == [0, 0, 0]


# --- conversation trie ------------------------------------------------------------------------------------------------

SAID = "conv_id long, turn long, role string, text string, digest string, depth string, place string, chars string"


def brute_trie(rows, rebuild=True):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((-1 << 70 if t is None else t, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), (role, text)))
    said = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, turns in said.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuild else 0
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        paths[c] = tuple(said.get(base, [])[:h] + turns[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    out, leaves, saved = [], {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[p] for p in children[path]) or 1
        saved[path] = sum(saved[p] for p in children[path]) + ((len(members[path]) - 1) * len(path[-1][1]) if path else 0)
        ids = ",".join(map(str, sorted(ends[path])))
        out.append((
            min(members[path]), len(path), min(members[path[:-1]]) if path else None, len(members[path]), len(children[path]),
            leaves[path], saved[path], hashlib.sha256(ids.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def found_trie(spark, rows, rebuild=True):
    frame = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SAID).repartition(3)
    numbered = conversation_trie.turns(frame)
    ids = numbered.where("place = 1")
    if rebuild:
        conv = F.col("conv_id")
        numbered = conversation_trie.graft(numbered, conv - conv % 100, F.crc32(conv.cast("string")) % 6, most=5)
    nodes = conversation_trie.trie(numbered, ids)
    return sorted((tuple(r) for r in nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=repr)


def odd_conversations():
    rng = random.Random(8)
    rows = []
    for c in [*range(-130, 130, 7), *range(4000, 4060), 0, 100, 2**62]:
        for t in range(rng.randint(0, 8)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "é😀", "", None, "long " * 50])))
    rows += [(900, None, "user", "first"), (900, None, "user", "first"), (900, 0, "user", "x"), (900, 0, "user", "y"), (None, 0, "user", "no id")]
    return rows + rows[:5]


@pytest.mark.parametrize("shard_turns, top_nodes", [(1 << 14, 200_000), (8, 200_000), (4, 10)])
@pytest.mark.parametrize("rebuild", [True, False])
def test_trie_against_brute_force(spark, monkeypatch, shard_turns, top_nodes, rebuild):
    monkeypatch.setattr(conversation_trie, "SHARD_TURNS", shard_turns)
    monkeypatch.setattr(conversation_trie, "TOP_NODES", top_nodes)
    rows = odd_conversations()
    assert found_trie(spark, rows, rebuild) == brute_trie(rows, rebuild)


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    assert found_trie(spark, []) == [] and found_trie(spark, [(None, 0, "user", "x")]) == []
    # 107: crc32 takes more turns than it has, and 100 is absent: a member of the root alone
    assert zlib.crc32(b"107") % 6 >= 1
    rows = [(107, 0, "user", "x"), (205, 0, "user", "y")]
    assert found_trie(spark, rows) == brute_trie(rows)


def test_trie_of_copies_and_of_a_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "SHARD_TURNS", 512)
    monkeypatch.setattr(conversation_trie, "ID_BITS", 5)
    rows = [(c, t, "user", f"same {t}") for c in range(300) for t in range(3)] + [(1000, t, "user", f"same {t}") for t in range(3000)]
    rows += [(2000 + c, t, "user", ("same 0", f"own {c}")[t]) for c in range(300) for t in range(2)]
    assert found_trie(spark, rows, rebuild=False) == brute_trie_of_long(rows)


def brute_trie_of_long(rows):
    """As brute_trie, for few branches: prefixes are named by running digests."""
    own = defaultdict(list)
    for c, t, role, text in rows:
        own[c].append((t, text))
    nodes = {}
    for c, turns in own.items():
        name, above = "root", None
        for d, text in enumerate([None, *(x for _, x in sorted(turns))]):
            if d:
                above, name = name, hashlib.sha256(f"{name}/{text}".encode()).hexdigest()
            node = nodes.setdefault(name, {"members": [], "ends": [], "depth": d, "above": above, "chars": len(text or ""), "children": 0, "leaves": 0, "saved": 0})
            node["members"].append(c)
            if d == len(turns):
                node["ends"].append(c)
    ordered = sorted(nodes.values(), key=lambda x: -x["depth"])
    for x in ordered:
        x["leaves"] = x["leaves"] or 1
        x["saved"] += (len(x["members"]) - 1) * x["chars"]
        if x["above"]:
            up = nodes[x["above"]]
            up["children"] += 1
            up["leaves"] += x["leaves"]
            up["saved"] += x["saved"]
    return sorted(
        (
            (
                min(x["members"]), x["depth"], min(nodes[x["above"]]["members"]) if x["above"] else None, len(x["members"]), x["children"], x["leaves"],
                x["saved"], hashlib.sha256(",".join(map(str, sorted(x["ends"]))).encode()).hexdigest(),
            )
            for x in ordered
        ),
        key=repr,
    )


def test_slots_are_minimal_perfect_and_verified():
    rng = np.random.default_rng(7)
    words = rng.integers(0, 2**63, (5000, 4), dtype=np.uint64)
    slots = conversation_trie.Slots(words)
    assert sorted(slots.slot.tolist()) == list(range(5000)) and (slots.held[slots.slot] == words).all()
    assert (slots.find(words) == slots.slot).all()
    near = words.copy()
    near[:, 0] ^= np.uint64(1)
    assert (slots.find(near) == -1).all()
    with pytest.raises(ValueError):
        conversation_trie.Slots(words[[0, 0]])


# --- url cascade --------------------------------------------------------------------------------------------------------

ODD_URLS = [
    None, "", "no scheme", "http://", "http:///en/x", "HTTP://WWW.Example.COM/en/x?y#z", "http://example.com", "http://example.com?en/", "http://a.example.com/en",
    "x://y://com/", "http://com./", "http://.com/", "http://notexample.com/en/", "http://example.com:80/en/", "http://ÄÖ.com/É/en/😀/", "http://a b.net/es/\n?q", "://net/fr/",
]


def brute_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [
        (len(h) + len(p), len(h), a, h + p)
        for h, p, a in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


def judged(spark, urls, rules):
    pages = spark.createDataFrame([(i, u, "x", "x", "x") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string, place string").repartition(3)
    table = spark.createDataFrame(rules, "host string, path string, action string, key string")
    cascade = url_cascade.build(table, F.col("url"), pages)
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_cascade.judge(pages, cascade).collect()}, cascade


@pytest.mark.parametrize("rate, shard_keys, most", [(1 / 256, 1 << 20, 32 << 20), (0.5, 50, 64)])
def test_cascade_against_brute_force(spark, monkeypatch, rate, shard_keys, most):
    """Also with filters that let half of all keys through, many shards, and a pass for each few of them."""
    monkeypatch.setattr(url_cascade, "FIRST_RATE", rate)
    monkeypatch.setattr(url_cascade, "RATE", max(rate, 1 / 16))
    monkeypatch.setattr(url_cascade, "SHARD_KEYS", shard_keys)
    monkeypatch.setattr(url_cascade, "BROADCAST_BYTES", most)
    rng = random.Random(6)
    label = lambda: rng.choice(["a", "b", "c", "example", "www"])
    host = lambda n: ".".join([*(label() for _ in range(rng.randint(0, n))), rng.choice(["com", "net"])])
    path = lambda n: "".join(f"/{rng.choice(['en', 'es', 'x', ''])}" for _ in range(rng.randint(0, n)))
    rules = list({(host(2), path(2), rng.choice(["allow", "block"])) for _ in range(150)}) + [("com", "/", "allow"), ("net", "/es", "block"), ("com", "/", "block")]
    urls = ODD_URLS + [f"http://{host(4)}{path(4)}{rng.choice(['', '?q=/en/', '#top'])}" for _ in range(600)] + ["http://a.com/en"] * 50
    odd = [(None, "/", "block"), ("com", "/x", "watch"), ("com", "/x", None)]
    found, cascade = judged(spark, urls, [(*r, "x") for r in [*rules, *odd, *rules[:9], ("B.Com", None, "block")]])
    assert found == {i: brute_verdict(u, [*rules, ("b.com", "", "block")]) for i, u in enumerate(urls)}
    if rate == 0.5:
        assert cascade.shards > 2 and cascade.filters.agg(F.max("level")).first()[0] > 2 and len(list(cascade.parts())) > 1


def test_cascade_of_nothing(spark):
    found, _ = judged(spark, ODD_URLS, [])
    assert found == {i: brute_verdict(u, []) for i, u in enumerate(ODD_URLS)}
    assert judged(spark, [], [("com", "/", "block", "x")])[0] == {} and judged(spark, [], [])[0] == {}


def test_cascade_answers_every_key_without_an_exact_look(spark, monkeypatch):
    """The filters alone tell listed keys from all others of the corpus."""
    monkeypatch.setattr(url_cascade, "FIRST_RATE", 0.5)
    monkeypatch.setattr(url_cascade, "RATE", 0.5)
    urls = [f"http://h{i}.net/" for i in range(3000)]
    listed = {f"h{i}.net" for i in range(0, 3000, 3)}
    found, _ = judged(spark, urls, [(h, "/", "block", "x") for h in listed])
    assert all((v == "block") == (h in listed) for h, _, _, v in found.values())
