"""Order, job states, registries, context from chunks, templates and word lists as tables: against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkweave import schemas
from inkweave.functions.text import words
from inkweave.operators import chunking, jobs, ordering, quality, statistics, tasks, template_table, word_lists
from inkweave.operators.jobs import JobLog, job_id
from inkweave.operators.tasks import TaskTemplate
from inkweave.sources.documents import document_registry
from test_operators import documents

# --- order --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("start", [0, 5])
def test_dense_number_against_sorting(spark, start):
    """Ties, nulls, repeated rows, and a value that a third of the rows share."""
    rng = random.Random(start)
    rows = [(rng.choice([None, "a", "b", "é", "zz"]), rng.choice([None, 1, 2, 3]), i // 2) for i in range(600)] + [("hot", 1, i) for i in range(300)]
    frame = spark.createDataFrame(rows, "k string, n int, i int").withColumn("m", F.create_map(F.lit("x"), "k")).repartition(5)
    found = ordering.dense_number(frame, ["k", F.col("n") * 2], "seq", start).collect()
    assert sorted(r["seq"] for r in found) == list(range(start, start + len(rows)))
    placed = [(r["k"], r["n"]) for r in sorted(found, key=lambda r: r["seq"])]
    assert placed == sorted(((k, n) for k, n, _ in rows), key=lambda x: (x[0] is not None, x[0] or "", x[1] is not None, x[1] or 0))
    assert sorted((r["k"], r["n"], r["i"]) for r in found if r["k"] == "hot") == sorted(rows[600:])
    assert ordering.dense_number(frame.limit(0), ["k"]).collect() == []


def test_dense_number_uses_no_window(spark):
    plan = ordering.dense_number(spark.range(1000), ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan


# --- job states ---------------------------------------------------------------------------------------------


def events(spark, rows):
    return spark.createDataFrame(rows, "id string, status string, seq long, at string").withColumn("at", F.col("at").cast("timestamp")).transform(
        lambda f: schemas.conform(f, schemas.JOB_EVENT)
    )


def test_latest_state_of_each_job(spark):
    rows = [
        ("a", "pending", 0, "2024-01-01"), ("a", "processing", 1, "2024-01-02"), ("a", "completed", 2, "2024-01-02"),
        ("b", "failed", 9, None), ("b", "pending", 0, "2024-01-01"), ("c", "cancelled", 3, "2024-01-03"), ("c", "failed", 2, "2024-01-03"),
        ("d", "processing", 0, "2024-01-01"), (None, "pending", 0, "2024-01-01"), ("e", "failed", 0, "2024-01-05"),
    ]
    log = events(spark, rows + rows[:4]).repartition(4)
    found = {r["id"]: r["status"] for r in jobs.latest_jobs(log).collect()}
    assert found == {"a": "completed", "b": "pending", "c": "cancelled", "d": "processing", None: "pending", "e": "failed"}
    counts = {r["status"]: (r["jobs"], r["active"]) for r in statistics.job_statistics(jobs.latest_jobs(log)).collect()}
    assert counts["all"] == (6, 1) and counts["cancelled"] == (1, 0)
    with pytest.raises(Exception, match="outside its domain"):
        jobs.latest_jobs(events(spark, [("a", "done", 0, "2024-01-01")])).collect()


def test_log_of_a_block(spark, tmp_path):
    path = str(tmp_path / "log")
    with JobLog(spark, path, "one") as log:
        log.known["name"] = "N"
    for run, error in (("two", KeyboardInterrupt()), ("three", ValueError("x"))):
        with pytest.raises(type(error)):
            with JobLog(spark, path, run):
                raise error
    now = {r["id"]: r for r in jobs.jobs(spark, path).collect()}
    assert {i: r["status"] for i, r in now.items()} == {job_id("one"): "completed", job_id("two"): "cancelled", job_id("three"): "failed"}
    assert now[job_id("one")]["name"] == "N" and now[job_id("three")]["error_message"] == "x"
    with pytest.raises(ValueError):
        JobLog(spark, None, "x").add("done")


# --- registry -----------------------------------------------------------------------------------------------


def test_registry_looks_the_content_up(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", "c", None]), rng.choice([None, 1, 2, 3]), rng.choice(["x", "y"])) for _ in range(200)] + [("a", 9, "same")] * 100
    frame = spark.createDataFrame(rows, "id string, n int, content string").withColumn("m", F.create_map(F.lit("k"), "content")).repartition(6)
    made = document_registry(frame, order_by="n")
    found = made.collect()
    assert sorted((r["id"] or "") for r in found) == ["", "a", "b", "c"]
    for r in found:
        assert r["n"] == max((n or 0) for i, n, _ in rows if i == r["id"]) and (r["id"], r["n"], r["content"]) in rows
    assert {tuple(r)[:3] for r in found} == {tuple(r)[:3] for r in document_registry(frame.repartition(2), order_by="n").collect()}
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in "".join(line for line in plan.splitlines() if "Aggregate" in line)
    assert "WindowGroupLimit" in made._jdf.queryExecution().executedPlan().toString()


def test_registry_reads_its_documents_once(spark, tmp_path):
    rows = [(k % 7, k % 3 or None, str(k)) for k in range(100)] + [(None, 1, "a"), (None, 2, "b")]
    spark.createDataFrame(rows, "id long, n int, content string").write.parquet(str(tmp_path / "docs"))
    made = document_registry(spark.read.parquet(str(tmp_path / "docs")), order_by="n")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert {r["id"]: r["n"] for r in made.collect()} == {**dict.fromkeys(range(7), 2), None: 2}


# --- chunks -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("size,overlap,context", [(1000, 200, 100), (10, 3, 4), (10, 7, 9), (5, 0, 0), (4, 3, 20)])
@pytest.mark.parametrize("segment", [25, 4096])
def test_context_of_chunks_alone(spark, size, overlap, context, segment):
    rng = random.Random(size)
    texts = ["".join(rng.choice("ab \n\xe9") for _ in range(n)) for n in (0, 1, overlap + 1, size, size + 1, 7 * size, 40 * size)]
    chunks = chunking.chunk_documents(documents(spark, texts), size=size, overlap=overlap, context=context)
    bare = chunks.drop("preceding_context", "following_context").repartition(7)
    found = chunking.neighbour_context(bare, size=size, overlap=overlap, context=context, segment=segment)
    columns = [c for c in chunks.columns if c not in ("embeddings", "topics")]
    assert sorted(map(tuple, found.select(*columns).collect()), key=repr) == sorted(map(tuple, chunks.select(*columns).collect()), key=repr)


def test_context_ends_at_a_missing_chunk(spark):
    chunks = chunking.chunk_documents(documents(spark, ["abcdefghijklmnopqrstuvwxyz"]), size=5, overlap=1, context=6)
    found = {r["chunk_index"]: r for r in chunking.neighbour_context(chunks.where("chunk_index <> 2"), size=5, overlap=1, context=6, segment=2).collect()}
    assert (found[1]["preceding_context"], found[1]["following_context"]) == ("abcd", None)
    assert found[3]["preceding_context"] is None and found[3]["following_context"] == "rstuvw"
    assert chunking.neighbour_context(chunks.limit(0)).collect() == []


def test_a_long_document_spreads_over_the_window(spark):
    chunks = chunking.chunk_documents(documents(spark, ["ab" * 4000]), size=10, overlap=2, context=3)
    found = chunking.neighbour_context(chunks, size=10, overlap=2, context=3, segment=50)
    assert found.count() == chunks.count() == 1000
    assert "document_id#" in found._jdf.queryExecution().executedPlan().toString() and found.where("following_context is null").count() == 1


# --- templates ----------------------------------------------------------------------------------------------


def made_prompts(frame):
    return sorted((r["id"], r["template_id"], r["task_type"], r["prompt"]) for r in frame.collect())


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_templates_of_a_table(spark, block_bytes):
    """As the templates in code, also where they are joined in blocks."""
    given = [
        TaskTemplate(f"t{i}", ("classification", "summarization")[i % 2], "", "{content} {a} {b} {c} {a}", {"a": f"A{i}", "b": "{content}", "d": "x"}) for i in range(12)
    ]
    chunks = chunking.chunk_documents(documents(spark, ["One {a} two.", "", "Three {content}." * 100]))
    table = template_table.template_table(spark, given)
    found = template_table.fan_out_table(chunks, table, block_bytes)
    by_code = tasks.fan_out(chunks, given)
    wanted = sorted(
        (r["id"], r["template_id"], r["task_type"], "{content} {a} {b} {c} {a}".replace("{a}", f"A{r['task_position']}").replace("{b}", "{content}").replace("{content}", r["content"]))
        for r in by_code.collect()
    )
    assert made_prompts(found) == wanted
    assert template_table.fan_out_table(chunks, table.limit(0), block_bytes).collect() == []
    assert template_table.fan_out_table(chunks.limit(0), table, block_bytes).collect() == []


def test_a_table_of_templates_does_not_grow_the_plan(spark):
    chunks = chunking.chunk_documents(documents(spark, ["text"]))
    rows = spark.range(1000).select(F.concat(F.lit("t"), "id").alias("name"), F.lit("classification").alias("task_type"), F.lit("{content}").alias("prompt_template"))
    few, many = (template_table.fan_out_table(chunks, r) for r in (rows.limit(3), rows))
    sizes = [len(f._jdf.queryExecution().optimizedPlan().toString()) for f in (few, many)]
    assert many.count() == 1000 and sizes[1] < 1.2 * sizes[0]
    bad = rows.withColumn("task_type", F.lit("other"))
    with pytest.raises(Exception, match="outside its domain"):
        template_table.fan_out_table(chunks, bad).collect()


# --- word lists and moments ---------------------------------------------------------------------------------


@pytest.mark.parametrize("most", [200_000, 1])
def test_shares_of_a_listed_table(spark, monkeypatch, most):
    monkeypatch.setattr(word_lists, "BROADCAST_WORDS", most)
    texts = [(1, "Bad bad good"), (2, ""), (3, None), (4, "fine words"), (5, "BAD"), (6, "the " * 500 + "bad"), (None, "bad x"), (7, "a"), (7, "bad")]
    rows = spark.createDataFrame(texts, "doc_id int, t string").select("doc_id", words(F.col("t")).alias("tokens")).repartition(4)
    listed = spark.createDataFrame([("bad",), ("BAD",), (None,), ("worse",)], "word string")
    found = {r["doc_id"]: r["score"] for r in word_lists.listed_share(rows, listed, key="doc_id").collect()}
    assert found == {1: 2 / 3, 2: None, 3: None, 4: 0.0, 5: 1.0, 6: 1 / 501, None: 0.5, 7: 0.5}
    none = word_lists.listed_share(rows, listed.limit(0), key="doc_id").collect()
    assert {r["score"] for r in none} == {0.0, None}


def test_moments_by_dataset(spark):
    rng = np.random.default_rng(3)
    rows = [(f"d{i % 3}", "classification", {"bias": float(rng.random()), **({"own": float(i)} if i % 2 else {})}) for i in range(60)] + [("d9", None, {})]
    frame = spark.createDataFrame(rows, "dataset_id string, task_type string, quality_scores map<string,double>").repartition(5)
    found = {r["id"]: r for r in statistics.dataset_summary(frame, metrics=(*schemas.QUALITY_METRICS, "own")).collect()}
    for name in ("d0", "d1", "d2"):
        for metric in ("bias", "own"):
            values = [s[metric] for d, _, s in rows if d == name and metric in s]
            stats = found[name]["quality_stats"][metric]
            assert np.allclose([stats[k] for k in ("count", "mean", "min", "max", "stddev")], [len(values), np.mean(values), min(values), max(values), np.std(values, ddof=1)])
        assert found[name]["task_type_counts"] == {"classification": 20} and set(found[name]["quality_stats"]) == {"bias", "own"}
    assert found["d9"]["quality_stats"] == {} and found["d9"]["task_type_counts"] == {} and found["d9"]["total_examples"] == 1


def test_metrics_of_the_caller(spark):
    """A metric of one's own is scored, judged, and summed up with the others."""
    from inkweave.plans.process import process_documents

    judge = quality.Evaluator(thresholds={"length": 0.5}, extra={"length": lambda _, out: F.least(F.char_length(out) / 40.0, F.lit(1.0))})
    docs = documents(spark, ["Short. One.", "This is a much longer first sentence than the other one has. And more."])
    run = process_documents(docs, ["summarization"], evaluator=judge, materialize=True)
    assert run.totals["documents"] == 2 and run.totals["processed_items"] == 2 and run.totals["made_0"] == 1
    stats = run.dataset().first()
    assert stats["quality_stats"]["length"]["count"] == 1.0 and stats["task_type_counts"] == {"summarization": 1}
    assert [r["reasons"] for r in run.rejected.collect()] == [["length below threshold", "output length out of bounds"]]


def test_materialized_and_lazy_runs_agree(spark):
    from inkweave.plans.process import process_documents

    docs = documents(spark, ["One. Two.", "Three", "", "Four. Five. Six."])
    one, other = (process_documents(docs, ["qa_generation", "summarization", "red_teaming"], run_id="r", materialize=m) for m in (True, False))
    for name in ("results", "examples", "rejected", "items"):
        a, b = getattr(one, name), getattr(other, name)
        assert a.columns == b.columns and sorted(map(repr, a.collect())) == sorted(map(repr, b.collect())), name
    for a, b in ((one.job(), other.job()), (one.dataset(), other.dataset())):
        assert a.drop("created_at").first() == b.drop("created_at").first()
