"""Chunking, joins, assembly, tasks, quality and splits: properties and brute-force checks."""

import random

import pytest
from pyspark.sql import functions as F

from inkweave import schemas
from inkweave.operators import assemble, chunking, joins, quality, splits, statistics, tasks
from inkweave.operators.tasks import TaskTemplate, python_runner
from inkweave.plans.process import NoDocumentsError, process_documents
from inkweave.sources.documents import document_registry, make_documents


def documents(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return make_documents(
        rows,
        content=F.col("t"),
        source=F.concat(F.lit("d/"), F.col("i").cast("string"), F.lit(".txt")),
        title=F.col("i").cast("string"),
        doc_type=F.lit("txt"),
    )


@pytest.mark.parametrize("size,overlap,context", [(1000, 200, 100), (10, 3, 4), (10, 7, 9), (5, 0, 0), (4, 3, 20)])
def test_chunks_match_slices(spark, size, overlap, context):
    rng = random.Random(size)
    lengths = [0, 1, overlap, overlap + 1, size - 1, size, size + 1, 3 * size, 2555 if size == 1000 else 57]
    texts = ["".join(rng.choice("ab \n\xe9\U0001f600") for _ in range(n)) for n in lengths]
    docs = documents(spark, texts)
    rows = chunking.chunk_documents(docs, size=size, overlap=overlap, context=context, carry=("title",)).collect()
    by_doc = {}
    for row in rows:
        by_doc.setdefault(int(row["document_title"]), []).append(row)
    step = size - overlap
    for i, whole in enumerate(texts):
        found = sorted(by_doc.get(i, []), key=lambda r: r["chunk_index"])
        starts = list(range(0, max(len(whole) - overlap - 1, 0) + 1, step)) if whole else []
        assert [r["start_index"] for r in found] == starts
        assert [r["chunk_index"] for r in found] == list(range(len(starts)))
        for r in found:
            start, end = r["start_index"], min(r["start_index"] + size, len(whole))
            assert r["end_index"] == end
            assert r["content"] == whole[start:end]
            assert r["token_count"] == (end - start) // 4
            assert r["preceding_context"] == (whole[max(start - context, 0) : start] or None)
            assert r["following_context"] == (whole[end : end + context] or None)
        if found:
            assert found[-1]["end_index"] == len(whole)
            assert all(r["end_index"] < len(whole) for r in found[:-1])


def test_chunk_arguments(spark):
    with pytest.raises(ValueError):
        chunking.chunk_documents(documents(spark, ["a"]), size=5, overlap=5)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_key_join_equals_join(spark, how):
    left = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, F.lit(None)).otherwise(
            F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))
        ).alias("k")
    )
    right = spark.createDataFrame([("hot", 1), ("hot", 2)] + [(f"k{i}", i) for i in range(40)], "k string, v int")
    salted = joins.hot_key_join(left, right, on=["k"], salt_on="id", how=how)
    plain = left.join(right, "k", how).select("id", "k", "v")
    assert sorted(map(repr, salted.collect())) == sorted(map(repr, plain.collect()))
    salts = {r["k"]: r["_salts"] for r in joins.hot_keys(left.where("k is not null"), ["k"]).collect()}
    assert set(salts) == {"hot"} and 2 <= salts["hot"] <= 8


def test_every_key_above_an_even_share_is_hot(spark):
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3000")
    try:
        rows = spark.range(24_000).select(F.when(F.col("id") % 2 == 0, F.col("id") % 1200).otherwise(F.col("id") + 5000).alias("k"))
        assert joins.hot_keys(rows, ["k"]).count() == 600
        rows = spark.range(24_000).select((F.col("id") % 2000).alias("k"))
        assert joins.hot_keys(rows, ["k"]).count() == 2000, "also beyond any fixed number"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)


def test_assembled_parts_are_one_text(spark):
    parts = [(1, i * 6007, " " if i % 4 == 0 else f"p{i}", i // 5) for i in range(1, 40)]
    parts += [(2, 1, "", 0), (3, 9999, "x", 0), (3, 20_005, "y", 0), (3, 10_000, "\xa0", 0)]
    random.Random(1).shuffle(parts)
    rows = spark.createDataFrame(parts, "d int, n int, t string, s int")
    whole = {r["d"]: r["content"] for r in assemble.assemble_parts(rows, document="d", seq="n", part="t").collect()}
    assert whole == {1: "\n".join(f"p{i}" for i in range(1, 40) if i % 4), 2: "", 3: "x\ny"}
    cut = assemble.assemble_parts(rows, document="d", seq="n", part="t", segment="s").where("d = 1")
    assert "\n".join(r["content"] for r in cut.orderBy("s").collect()) == whole[1]


def test_csv_records_keep_their_header(spark):
    records = [(1, n * 5000, ["x"] if n % 3 == 0 else [str(n), "y"]) for n in range(1, 12)] + [(4, 1, ["no", "header"])]
    rows = spark.createDataFrame(records, "d int, n int, c array<string>")
    heads = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, [])], "d int, c array<string>")
    lines = [f"Row {n * 5000}: a: {n} | b: y" for n in range(1, 12) if n % 3]
    made = assemble.csv_rows_text(rows, heads, document="d", row_num="n", cells="c").collect()
    assert {r["d"]: r["content"] for r in made} == {1: "\n".join(["Headers: a, b", "", *lines]), 2: "Headers: a\n", 3: "", 4: ""}


def test_small_shares_are_not_lost(spark):
    rows = spark.range(200_000).select(F.col("id").cast("string").alias("id"))
    named = splits.split_examples(rows, 0.9992, 0.0004, 0.0004).groupBy("split").count().collect()
    assert {r["split"] for r in named} == {"train", "validation", "test"}
    assert all(30 < r["count"] < 150 for r in named if r["split"] != "train")
    assert {r["split"] for r in splits.split_examples(rows, 1.0, 0.0, 0.0).select("split").distinct().collect()} == {"train"}


def test_python_runner_errors_are_counted(spark):
    def shout(prompt, content):
        if "bad" in content:
            raise ValueError("refused")
        return content.upper() + " and more text"

    docs = documents(spark, ["good one", "bad one", "good two"])
    run = process_documents(docs, ["red_teaming"], runners={"red_teaming": python_runner(shout)}, quality_filter=False)
    job = run.job().first()
    assert (job["total_items"], job["processed_items"], job["failed_items"], job["status"]) == (3, 2, 1, "completed")
    assert [r["error_message"] for r in tasks.task_errors(run.results).collect()] == ["ValueError: refused"]
    assert {r["output_text"] for r in run.examples.collect()} == {"GOOD ONE and more text", "GOOD TWO and more text"}
    assert run.results.inputFiles(), "results of a Python runner are a written table"


def test_runners_report_and_wrong_kinds_fail_their_item(spark):
    def rate(prompt, content):
        return {
            "full": {"output": "a full result", "confidence": 1, "quality_scores": {"diversity": 0.5}, "token_usage": 7, "cost": 0.25},
            "five": 5, "none": None, "map": {"output": 3}, "odd": {"output": "x", "colour": 1}, "nan": {"output": "x", "quality_scores": {"a": float("nan")}},
        }[content]

    texts = ["full", "five", "none", "map", "odd", "nan"]
    run = process_documents(documents(spark, texts), ["red_teaming"], runners={"red_teaming": python_runner(rate)}, quality_filter=False)
    rows = {r["input_text"]: r for r in run.results.collect()}
    assert {t for t, r in rows.items() if r["status"] == "failed"} == set(texts) - {"full"}
    full = rows["full"]
    assert (full["confidence"], full["quality_scores"], full["token_usage"], full["cost"]) == (1.0, {"diversity": 0.5}, 7, 0.25)
    assert all(r["processing_time"] > 0 for r in rows.values())
    assert rows["five"]["error_message"] == "TypeError: a runner returns text or a mapping, not int"


def test_four_python_runners_are_one_scan(spark, tmp_path):
    documents(spark, ["One. Two."] * 3).write.parquet(str(tmp_path / "d"))
    chunks = chunking.chunk_documents(spark.read.parquet(str(tmp_path / "d")), carry=tasks.RUNNER_CARRY)
    kinds = ("summarization", "named_entity_recognition", "red_teaming", "instruction_response")
    runners = {k: python_runner(lambda prompt, content, k=k: f"{k} of {content}") for k in kinds}
    made = tasks.execute_tasks(chunks, tasks.templates_for(kinds), runners)
    assert made._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert {r["task_type"]: r["output"] for r in made.collect()} == {k: f"{k} of One. Two." for k in kinds}


def test_registry_of_null_and_equal_orders(spark):
    rows = [(1, None, "a"), (1, None, "b"), (2, 5, "c"), (2, 5, "d"), (2, None, "e"), (3, 1, "f"), (3, 2, "g")]
    made = [document_registry(spark.createDataFrame(r, "id int, n int, t string"), "n").collect() for r in (rows, rows[::-1])]
    assert sorted(made[0]) == sorted(made[1])
    assert {r["id"]: r["t"] for r in made[0]}[3] == "g" and {r["t"] for r in made[0]} & {"a", "b"} and {r["t"] for r in made[0]} & {"c", "d"}


def test_python_and_expression_tasks_together(spark):
    runner = python_runner(lambda prompt, content: prompt[:5] + "-" + content)
    run = process_documents(
        documents(spark, ["One. Two. Three."]),
        ["qa_generation", "named_entity_recognition"],
        runners={"named_entity_recognition": runner},
        quality_filter=False,
    )
    rows = {r["task_type"]: (r["task_position"], r["output"]) for r in run.results.collect()}
    assert rows["qa_generation"] == (0, 'Q: What follows "One."?\nA: Two.')
    assert rows["named_entity_recognition"] == (1, "List -One. Two. Three.")


def test_gate_on_and_off(spark):
    docs = documents(spark, ["Alpha beta. Gamma delta.", ("a " * 60 + "a. ") * 2, "single"])
    on, off = process_documents(docs), process_documents(docs, quality_filter=False)
    kept, rejected = {r["id"] for r in on.examples.collect()}, {r["id"] for r in on.rejected.collect()}
    everything = off.examples.collect()
    assert kept | rejected == {r["id"] for r in everything} and not kept & rejected
    assert rejected and all(r["reasons"] for r in on.rejected.collect())
    assert all(r["quality_approved"] is None for r in everything)
    assert all(r["quality_approved"] for r in on.examples.collect())
    row = on.dataset().first()
    assert row["total_examples"] == len(kept) and row["description"] == "Dataset generated from 3 document"
    assert sum(row["task_type_counts"].values()) == len(kept)


def test_no_documents(spark):
    with pytest.raises(NoDocumentsError):
        process_documents(spark.createDataFrame([], schemas.DOCUMENT))


def test_prompt_keeps_braces_in_the_content(spark):
    template = TaskTemplate("t", "summarization", "", "In {n}: {content}", {"n": "2"})
    rows = spark.createDataFrame([("{n} {content}",)], "content string")
    prompt = tasks.render_prompt([template], F.col("content"), F.lit(template.id))
    assert rows.select(prompt.alias("p")).first()["p"] == "In 2: {n} {content}"


def test_template_thresholds_and_bounds(spark):
    strict = TaskTemplate("strict", "summarization", "", "{content}", quality_thresholds={"diversity": 0.9}, max_output_length=12)
    judge = quality.Evaluator(templates=[strict], thresholds={"toxicity": 0.1}, toxic_words=["bad"])
    rows = [("1", "a b", "good words"), ("2", "a b", "bad bad bad bad"), ("3", "a b", "tiny")]
    examples = spark.createDataFrame(rows, "id string, input_text string, output_text string").select(
        "*", F.lit(strict.id).alias("template_id"), F.create_map().cast("map<string,double>").alias("quality_scores")
    )
    judged = {r["id"]: (r["passed"], r["reasons"]) for r in judge.evaluate(examples).collect()}
    assert judged["1"] == (True, [])
    assert judged["2"] == (False, ["diversity below threshold", "toxicity above threshold", "output length out of bounds"])
    assert judged["3"] == (False, ["output length out of bounds"])


def test_quality_stats_map(spark):
    rows = spark.createDataFrame([({"bias": 0.0},), ({"bias": 1.0, "diversity": 0.5},)], "quality_scores map<string,double>")
    stats = quality.quality_stats_map(rows).first()["quality_stats"]
    assert stats["bias"]["mean"] == 0.5 and stats["diversity"]["count"] == 1.0
    assert quality.evaluate_dataset(rows).first()["overall_score"] == (1.0 + (0.0 + 0.5) / 2) / 2


def test_splits_partition_the_ids(spark):
    ids = spark.range(5000).select(F.col("id").cast("string").alias("id"))
    made = splits.split_examples(ids)
    counts = {r["split"]: r["count"] for r in made.groupBy("split").count().collect()}
    assert sum(counts.values()) == 5000 and 3800 < counts["train"] < 4200
    assert made.exceptAll(splits.split_examples(ids.repartition(7))).count() == 0
    with pytest.raises(ValueError):
        splits.split_name(F.lit("a"), 0.5, 0.1, 0.1)


def test_registry_keeps_the_last_write(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("b", 2, "q"), ("a", 2, "y")], "id string, n int, t string")
    assert {tuple(r) for r in document_registry(rows, order_by="n").collect()} == {("a", 3, "z"), ("b", 2, "q")}


def test_statistics_json(spark):
    docs = documents(spark, ["One. Two.", "Three."])
    run = process_documents(docs, quality_filter=False)
    report = statistics.statistics_report(docs, run.examples, run.job())
    nested = statistics.statistics_json(report).first()["statistics"]
    assert '"total":2' in nested and '"approved_examples":0' in nested


def test_thresholds_apply_to_missing_scores(spark):
    row = spark.range(1).select(
        quality.threshold_reasons(
            F.create_map(F.lit("bias"), F.lit(0.1)), F.create_map(F.lit("bias"), F.lit(0.1), F.lit("relevance"), F.lit(0.0))
        ).alias("r")
    )
    assert row.first()["r"] == ["no score for relevance"]
