"""Vector search recall, chat trees read back, the registered queries with SQL, and the pipeline."""

import re

import numpy as np
import pytest
from compare import connect, differences
from pyspark.sql import functions as F

import corpus_pipeline
from inkweave.llm import chat_tree, posting_ann
from inkweave.llm.catalog import ORACLE, QUERIES

from conftest import FOLDER  # isort: skip

VECTORS = "vec_id long, embedding array<double>, id string, v string, list int, score string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", "x", 1, "x") for i, v in rows], VECTORS).repartition(3)


def check_search(found, rows, k, least):
    ids = np.array([i for i, _ in rows])
    points = np.array([v for _, v in rows], float)
    hits = total = 0
    by = {}
    for r in found:
        by.setdefault(r.query_id, []).append(r)
    for q in ids[ids % 20 == 0]:
        score = (points[ids == q][0] * points).sum(axis=1)
        best = sorted(((-s, i) for s, i in zip(score, ids, strict=True) if i != q))[:k]
        own = sorted(by.pop(q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, len(best) + 1))
        assert [(-r.score, r.id) for r in own] == sorted((-r.score, r.id) for r in own)
        assert np.allclose([r.score for r in own], [score[ids == r.id][0] for r in own])
        hits += len({r.id for r in own} & {i for _, i in best})
        total += len(best)
    assert not by and hits >= least * total


def test_search_of_unequal_lengths(spark, monkeypatch):
    monkeypatch.setattr(posting_ann, "VECTOR_BLOCK", 64)
    monkeypatch.setattr(posting_ann, "QUERY_BLOCK", 8)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + rng.normal(size=16) * 0.4).tolist()) for i in range(4000)]
    rows += [(4000 + i, [1.0] * 16) for i in range(600)]
    check_search(posting_ann.search(vectors(spark, rows), F.col("vec_id") % 20 == 0, k=20).collect(), rows, 20, 0.9)


@pytest.mark.parametrize("exact", [False, True])
def test_search_of_odd_rows(spark, exact):
    good = [(i, [float(i), 1.0]) for i in range(0, 50, 5)]
    odd = [(100, None), (120, [0.0, 0.0]), (140, [1.0, None]), (160, [float("nan"), 1.0]), (180, [float("inf"), 1.0]), (200, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    found = posting_ann.search(vectors(spark, good + odd), F.col("vec_id") % 20 == 0, k=20, exact=exact).collect()
    check_search(found, good, 20, 1.0)
    assert posting_ann.search(vectors(spark, odd[:5]), F.col("vec_id") % 20 == 0, exact=exact).collect() == []
    assert posting_ann.search(vectors(spark, []), F.col("vec_id") % 20 == 0, exact=exact).collect() == []


@pytest.mark.parametrize("exact", [False, True])
def test_rows_that_share_an_id_are_candidates(spark, exact):
    """Of repeated rows and ids every row but the query's own is found, and every query row finds."""
    rng = np.random.default_rng(6)
    rows = [(i // 2, rng.normal(size=3).tolist()) for i in range(90)] + [(20, [9.0, 9.0, 9.0])] * 3
    found = posting_ann.search(vectors(spark, rows), F.col("vec_id") % 20 == 0, k=5, exact=exact).collect()
    wanted = []
    for n, (q, v) in enumerate(rows):
        if q % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for m, (i, w) in enumerate(rows) if m != n)[:5]
            wanted += [(q, rank + 1, i, round(-s, 9)) for rank, (s, i) in enumerate(scores)]
    assert sorted((r.query_id, r["rank"], r.id, round(r.score, 9)) for r in found) == sorted(wanted)


def test_exact_search_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(posting_ann, "VECTOR_BLOCK", 64)
    monkeypatch.setattr(posting_ann, "QUERY_BLOCK", 8)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(700)]
    check_search(posting_ann.search(vectors(spark, rows), F.col("vec_id") % 20 == 0, k=20, exact=True).collect(), rows, 20, 1.0)


def test_centres_grow_with_the_rows(spark, monkeypatch):
    """Beyond the first centres clusters are cut by the tasks, and the graph is walked; recall stays."""
    for name, value in (("LIST_ROWS", 8), ("FIRST_CENTRES", 20), ("SAMPLE_ROWS", 400), ("FULL_LOOK", 64)):
        monkeypatch.setattr(posting_ann, name, value)
    rng = np.random.default_rng(7)
    middles = rng.normal(size=(40, 12))
    rows = [(i, (middles[i % 40] + rng.normal(size=12) * 0.3).tolist()) for i in range(4000)]
    frame = posting_ann._usable(vectors(spark, rows), F.col("vec_id") % 20 == 0, "vec_id", "embedding")
    centres = posting_ann._centres(frame, 4000, float(max(np.linalg.norm(v) for _, v in rows)))
    assert 250 <= len(centres.points) <= 900 and centres.near.shape == (len(centres.points), posting_ann.NEAR)
    assert set(range(len(centres.points))) >= set(centres.near.ravel().tolist())
    check_search(posting_ann.search(vectors(spark, rows), F.col("vec_id") % 20 == 0, k=20).collect(), rows, 20, 0.9)


def test_walk_finds_the_nearest_centres(monkeypatch):
    monkeypatch.setattr(posting_ann, "FULL_LOOK", 0)
    rng = np.random.default_rng(9)
    sample = rng.normal(size=(6000, 8))
    centres = posting_ann.fit(sample, 1500, float(np.sqrt((sample**2).sum(axis=1).max())))
    asked = centres.augmented(rng.normal(size=(100, 8)) * 0.5)
    found, far = centres.nearest(asked, 32)
    true = ((asked[:, None] - centres.points[None]) ** 2).sum(axis=2)
    best = np.argsort(true, axis=1)[:, :32]
    assert np.mean([len(set(a) & set(b)) for a, b in zip(found.tolist(), best.tolist(), strict=True)]) > 0.95 * 32
    assert np.allclose(far[:, 0] ** 2, np.take_along_axis(true, found[:, :1], axis=1)[:, 0])
    assert all(len(set(f)) == len(f) for f in found.tolist()) and (np.diff(far, axis=1) >= 0).all()


def test_a_look_at_all_centres():
    rng = np.random.default_rng(9)
    centres = posting_ann.fit(rng.normal(size=(4000, 8)), 200, 5.0)
    asked = centres.augmented(rng.normal(size=(100, 8)) * 0.5)
    true = np.sqrt(((asked[:, None] - centres.points[None]) ** 2).sum(axis=2))
    for view in (6, len(centres.points)):
        found, far = centres.nearest(asked, view)
        assert np.allclose(far, np.sort(true, axis=1)[:, :view]) and np.allclose(np.take_along_axis(true, found, axis=1), far)


# --- chat -----------------------------------------------------------------------------------------------------

ODD_TEXTS = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<\\\\|x", "a\nb\n", "", "é😀\x00 <", "|>", "\r\n\\n"]


@pytest.mark.parametrize("tokenizer", [None, "/opt/tokenizers/byte_bpe_50k.json"])
@pytest.mark.parametrize("pack_chars", [300, 1 << 20])
def test_chat_round_trip(spark, tokenizer, pack_chars):
    rows = []
    for c in range(12):
        for t in range(c % 4 + 1):
            same = "shared start" if t == 0 and c < 8 else ODD_TEXTS[(c + t) % 8]
            rows.append((c, t, ("user", "assistant")[t % 2], same))
    rows += [(100, r[1], r[2], r[3]) for r in rows if r[0] == 7] + [(200, 0, "assi\nst|<|ant\\", None), (200, None, None, "first"), (None, 0, "assistant", "no id"), (300, 0, "assistant", "t" * 50_000), (300, 0, "assistant", "t")]
    said = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, key string, pack string").repartition(3)
    found = chat_tree.conversations(said)
    packs = chat_tree.pack(found, tokenizer=tokenizer, pack_chars=pack_chars)
    read = {r["conv_id"]: r for r in found.select("conv_id", "key").join(chat_tree.read_back(packs, tokenizer=tokenizer), "key").collect()}
    assert set(read) == {r[0] for r in rows}
    for c in read:
        own = sorted(((-1 if t is None else t, r or "", x or "") for i, t, r, x in rows if i == c))
        assert [(t["role"], t["text"]) for t in read[c]["turns"]] == [(r, x) for _, r, x in own]
        assert read[c]["loss_text"] == "".join(x for _, r, x in own if r == "assistant")
        assert len(re.findall(r"<\|im_start\|>", read[c]["formatted"])) == len(own)
    for p in packs.collect():
        for node, above in zip(p.nodes, p.ancestors, strict=True):
            lengths = [s.end - s.begin for s in above]
            assert p.positions[node.begin : node.end] == list(range(sum(lengths), sum(lengths) + node.end - node.begin))
            assert (above[-1].begin, above[-1].end) == (p.nodes[node.parent].begin, p.nodes[node.parent].end) if above else node.parent == -1
    if pack_chars > 300:
        written = sum(len(p.tokens) for p in packs.collect())
        alone = sum(len(chat_tree.coder(tokenizer).encode([r["formatted"]])[0]) for r in read.values())
        assert written < alone
    assert chat_tree.read_back(chat_tree.pack(chat_tree.conversations(said.limit(0)))).collect() == []


@pytest.mark.parametrize("depth", [1, 3])
def test_hot_first_turns_are_written_once_per_pack(spark, depth):
    """However many conversations begin with the same turns, these are written about once per pack_chars of other text."""
    start = [(t, "system", f"start {t} " + "s" * 500) for t in range(depth)]
    rows = [(c, *t) for c in range(400) for t in [*start, (depth, "user", f"question {c} " + "q" * 80)]]
    found = chat_tree.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3))
    packs = chat_tree.pack(found, pack_chars=5_000).collect()
    firsts = sum(n.parent == -1 for p in packs for n in p.nodes)
    other = sum(len(r[3]) + 32 for r in rows if r[1] == depth)
    assert sum(len(p.leaves) for p in packs) == 400 and max(len(p.tokens) for p in packs) < 5_000 + 600 * (depth + 1)
    # cuts, the borders of 8 tasks, and a little for what a cut leaves free
    assert firsts <= 1.1 * other / 5_000 + 8 + 1
    assert sum(len(p.nodes) for p in packs) == 400 + depth * firsts


def test_deep_conversations_have_few_intervals():
    """A chain of turns, alone and with a branch at each turn: intervals are few, and every path reads back."""
    depth = 2_000
    chain = [(("user", "assistant")[t % 2], ("<", "\\|x", f"t{t}")[t // 2 % 3]) for t in range(depth)]
    branches = [[*chain[:t], ("user", f"aside {t}")] for t in range(0, depth, 40)]
    for paths, least in (([chain], 2), ([*branches, chain], 15)):
        members = [(f"{i:064x}", path) for i, path in enumerate(paths)]
        row = chat_tree._tree(members, None).to_pylist()[0]
        assert max(map(len, row["ancestors"])) <= least
        read = {r["key"]: r for batch in chat_tree._read_pack(row, chat_tree.coder(None)) for r in batch.to_pylist()}
        for key, path in members:
            assert [(t["role"], t["text"]) for t in read[key]["turns"]] == path
            assert read[key]["loss_text"] == "".join(x for r, x in path if r == "assistant")
        for node, above in zip(row["nodes"], row["ancestors"], strict=True):
            spans, parent = [], node["parent"]
            while parent >= 0:
                spans.insert(0, (row["nodes"][parent]["begin"], row["nodes"][parent]["end"]))
                parent = row["nodes"][parent]["parent"]
            if node["parent"] % 97 == 0:
                assert [i for a, b in spans for i in range(a, b)] == [i for s in above for i in range(s["begin"], s["end"])]


# --- queries and the pipeline ---------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_against_sql(name, spark):
    assert differences(QUERIES[name](spark, FOLDER), connect(FOLDER), ORACLE[name]) == []


def test_one_query_per_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontaminate", "pseudonymise", "mix_sources"]
    before = {r.doc_id: r for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    good = corpus_pipeline.quality(spark, docs, FOLDER)
    kept = {r.doc_id for r in good.collect()}
    assert good.columns == docs.columns and np.mean([(i in kept) == bool(q) for i, q in labels.items()]) > 0.97
    for stage in (corpus_pipeline.near_duplicates, corpus_pipeline.decontaminate, corpus_pipeline.pseudonymise):
        assert stage(spark, docs.limit(0), FOLDER).collect() == []
    last = corpus_pipeline.run(spark, FOLDER).collect()
    assert last and {r.doc_id for r in last} <= kept and all(r.mix_taken > 0 for r in last)
    assert len({r.doc_id for r in last}) == len(last)
    assert {r.source for r in last} <= {r.source for r in before.values()}


def test_pipeline_of_nothing(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("name", ["quality", "mix_sources"])
def test_stages_take_clashing_names(spark, name):
    """Further columns with the names that a stage uses inside are handed through and change nothing."""
    stage, docs = dict(corpus_pipeline.STAGES)[name], spark.read.parquet(f"{FOLDER}/documents.parquet")
    more = ("id", "score", "others", "copies", "limit", "class_source", "class_size", "size", "source_size", "target")
    plain = stage(spark, docs, FOLDER)
    found = stage(spark, docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in more}), FOLDER)
    assert found.columns[: len(docs.columns) + len(more)] == [*docs.columns, *more]
    rows = found.collect()
    assert rows and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in more)
    assert sorted(tuple(r[c] for c in plain.columns) for r in rows) == sorted(map(tuple, plain.collect()))


# --- the stages against brute force -----------------------------------------------------------------------------

CLASHES = ("row", "ROW_", "id", "left_out", "component_id", "found", "mark", "score", "others", "batch", "key", "first", "n", "unnamed")


@pytest.fixture(scope="module")
def odd_docs(spark, odd_rows):
    """Documents with null and repeated ids, nulls, copies, near copies, benchmark texts, and columns of clashing names."""
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").orderBy("item_id").limit(4).collect()]
    words = [f"word{i}" for i in range(60)]
    rows = [*odd_rows, (None, items[0]), (None, items[0]), (70, "see " + items[1] + " there"), (71, items[1]), (71, "clean text of one's own"), (72, items[2].upper())]
    rows += [(80, " ".join(words)), (None, " ".join(words)), (81, " ".join([*words[:59], "other"])), (79, " ".join(words)), (79, " ".join(words))]
    rows += [(90 + i, f"mail a{i}@example.com or 988-555-24{i:02}") for i in range(3)] + [(None, "card 4041894974608795"), (None, None), (None, "")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    full = [(i, t, ("en", None, "de")[k % 3], ("a", None, "b", "c")[k % 4], len(t or ""), *(f"{c}{k}" for c in CLASHES)) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, schema).repartition(4), full


def left(spark, name, docs):
    """The rows that a stage keeps, by the number that their column ``id`` ends with."""
    found = dict(corpus_pipeline.STAGES)[name](spark, docs, FOLDER)
    assert found.columns[: len(docs.columns)] == docs.columns
    return {int(r["id"][2:]): r for r in found.collect()}


def test_near_duplicate_stage(spark, odd_docs):
    from test_near_dedup import all_pairs, shingles

    docs, rows = odd_docs
    component = all_pairs([(k, r[1]) for k, r in enumerate(rows)], 5)
    groups = {}
    for k, r in enumerate(rows):
        groups.setdefault(component[k] if shingles(r[1], 5) else ("alone", k), []).append(k)
    kept = left(spark, "near_duplicates", docs)
    assert len(kept) == len(groups) < len(rows)
    for members in groups.values():
        (own,) = [k for k in members if k in kept]
        ids = [rows[k][0] for k in members if rows[k][0] is not None]
        assert rows[own][0] == min(ids, default=None) and tuple(kept[own]) == rows[own]


def test_decontamination_stage(spark, odd_docs):
    docs, rows = odd_docs
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lowered = lambda t: word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = set()
    for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect():
        w = lowered(r.text)
        windows |= {tuple(w[i : i + 10]) for i in range(max(len(w) - 9, 1))} if w else set()
    lengths = {len(w) for w in windows}
    said = {k: lowered(r[1]) for k, r in enumerate(rows)}
    clean = {k for k, w in said.items() if not any(tuple(w[i : i + n]) in windows for n in lengths for i in range(len(w) - n + 1))}
    kept = left(spark, "decontaminate", docs)
    assert set(kept) == clean and len(clean) < len(rows) - 4
    assert all(tuple(kept[k]) == rows[k] for k in kept)


def test_quality_stage(spark, odd_docs):
    docs, rows = odd_docs
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    model = corpus_pipeline.quality_trees.train(docs, labels, F.lit(True))
    scored = {r["text"]: r["score"] for r in corpus_pipeline.quality_trees.score(docs.select("doc_id", "text"), model, also=("text",)).collect()}
    kept = left(spark, "quality", docs)
    assert set(kept) == {k for k, r in enumerate(rows) if scored[r[1]] >= corpus_pipeline.LEAST_QUALITY}
    assert all(tuple(kept[k]) == rows[k] for k in kept)


def test_pseudonym_stage(spark, odd_docs):
    docs, rows = odd_docs
    kept = left(spark, "pseudonymise", docs)
    assert set(kept) == set(range(len(rows)))
    changed = {k for k in kept if tuple(kept[k]) != rows[k]}
    assert changed == {k for k, r in enumerate(rows) if re.search("@example|^card", r[1] or "")}
    for k in changed:
        assert kept[k]["n_chars"] == len(kept[k]["text"]) and not re.search(r"4041894974608795|988-555-24", kept[k]["text"])
        assert [x for c, x in zip(docs.columns, kept[k], strict=True) if c not in ("text", "n_chars")] == [x for c, x in zip(docs.columns, rows[k], strict=True) if c not in ("text", "n_chars")]


def test_mix_stage(spark, odd_docs):
    from test_text_operators import water_filled

    docs, rows = odd_docs
    sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    of_source = {}
    for r, n in zip(rows, sizes, strict=True):
        of_source[r[3]] = of_source.get(r[3], 0) + n
    target = water_filled(of_source, (5, 2, 1))
    kept = left(spark, "mix_sources", docs)
    taken = dict.fromkeys(of_source, 0)
    for k, r in kept.items():
        assert tuple(r)[: len(rows[k])] == rows[k] and r.mix_taken in (sizes[k], 2 * sizes[k], 3 * sizes[k])
        assert r.mix_target == pytest.approx(target[r.source])
        taken[r.source] += r.mix_taken
    assert all(taken[s] <= target[s] + 1 for s in taken)


def test_contaminated_documents_without_an_id_do_not_get_through(spark, odd_docs, tmp_path):
    """The whole run: no row of a benchmark text is left, whatever its id."""
    docs, rows = odd_docs
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    plain = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs.select(*plain.columns).unionByName(plain).write.parquet(str(tmp_path / "documents.parquet"))
    items = {r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
    last = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert last and not any(item in (r.text or "") for r in last for item in items)
