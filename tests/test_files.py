"""Scans, loading, streaming and sinks on real files in temporary folders."""

import json

import pytest
from pyspark.sql import functions as F

from inkweave.plans.process import quick_process
from inkweave.session import shared_folder
from inkweave.sinks import export
from inkweave.sources import routing, web
from inkweave.sources.files import FileLoader, extraction_fallback, scan_directory
from inkweave.sources.load import LoadError, load_documents
from inkweave.sources.web import content_or_fallback
from inkweave.streaming.documents import file_stream, stream_documents, streamed_documents


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "in"
    (root / "sub").mkdir(parents=True)
    (root / "a.txt").write_bytes(b"line one\r\nline two\rend")
    (root / "B.MD").write_text("# Title\n\ntext")
    (root / "sub" / "c.json").write_text('{"b": 1, "a": "x"}')
    (root / "sub" / "t.csv").write_text("a,b\n1,2\n3\n4,5\n")
    (root / "sub" / "p.html").write_text("<p>a</p><p>b</p>")
    (root / "sub" / "bad.txt").write_bytes(b"ok \xff")
    (root / "sub" / "bad.json").write_text("{")
    (root / "sub" / "scan.pdf").write_bytes(b"%PDF")
    (root / "d.url").write_text("x")
    (root / "e.exe").write_text("x")
    return str(root)


def names(frame, column="path"):
    return sorted(r[0].rsplit("/", 1)[1] for r in frame.select(column).collect())


def test_scan_directory(spark, folder):
    assert names(scan_directory(spark, folder)) == [
        "B.MD", "a.txt", "bad.json", "bad.txt", "c.json", "p.html", "scan.pdf", "t.csv"
    ]
    assert names(scan_directory(spark, folder, recursive=False)) == ["B.MD", "a.txt"]
    assert names(scan_directory(spark, folder, recursive=False, exclude_name_contains=["a"])) == ["B.MD"]
    assert names(scan_directory(spark, folder, types=["csv"])) == ["t.csv"]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        scan_directory(spark, folder + "/none")


def test_permissive_load(spark, folder):
    loaded = FileLoader().load(scan_directory(spark, folder))
    texts = {r["title"] + "." + r["doc_type"]: r["content"] for r in loaded.documents.collect()}
    assert texts == {
        "a.txt": "line one\nline two\nend",
        "B.md": "# Title\n\ntext",
        "c.json": "b: 1\na: x",
        "t.csv": "Headers: a, b\n\nRow 1: a: 1 | b: 2\nRow 3: a: 4 | b: 5",
        "p.html": "ab",
    }
    bad = {r["source"].rsplit("/", 1)[1]: (r["stage"], r["error_class"]) for r in loaded.quarantine.collect()}
    assert bad == {
        "bad.txt": ("extract", "malformed_encoding"),
        "bad.json": ("extract", "malformed_json"),
        "scan.pdf": ("route", "parser_missing"),
    }


def test_failfast_load(spark, folder):
    with pytest.raises(Exception, match="malformed_encoding"):
        load_documents(spark, folder + "/sub/bad.txt").collect()
    with pytest.raises(LoadError):
        load_documents(spark, folder + "/none.txt")


def test_metadata_and_encoding(spark, folder):
    row = load_documents(spark, folder + "/a.txt").first()
    assert row["metadata"]["extension"] == ".txt" and row["metadata"]["filename"] == "a.txt"
    assert row["metadata"]["size"] == "22" and int(row["metadata"]["modified_time"]) > 0
    assert (row["size"], row["word_count"], row["extraction_method"]) == (21, 5, "DocumentLoader.txt")
    for encoding in ("iso-8859-1", "cp1252"):
        loaded = FileLoader(encoding=encoding).load(spark.read.format("binaryFile").load(folder + "/sub/bad.txt"))
        assert loaded.documents.first()["content"] == "ok \xff"


def test_parser_for_further_types(spark, folder):
    loader = FileLoader(parsers={"pdf": lambda body: F.concat(F.lit("pages of "), body.cast("string"))})
    assert load_documents(spark, folder + "/sub/scan.pdf", loader=loader).first()["content"] == "pages of %PDF"


def test_load_mixed_sources(spark, folder):
    pages = spark.createDataFrame([("http://h/a-b", "<body>hello</body>"), ("http://h/z", "zz")], "url string, html string")
    docs = load_documents(spark, [folder + "/a.txt", folder + "/sub", "http://h/a-b"], pages=pages)
    assert sorted((r["doc_type"], r["title"]) for r in docs.collect()) == [
        ("csv", "t"), ("html", "p"), ("json", "c"), ("txt", "a"), ("url", "A B")
    ]
    only = load_documents(spark, [folder], doc_types=["md", "csv"])
    assert sorted(r["doc_type"] for r in only.collect()) == ["csv", "md"]
    with pytest.raises(Exception, match="failed to load URL"):
        load_documents(spark, "http://h/none", pages=pages).collect()


def test_stream_equals_batch(spark, folder, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    for _ in range(2):  # the second run finds nothing new
        stream_documents(file_stream(spark, folder), out, checkpoint).awaitTermination()
    batch = FileLoader().load(scan_directory(spark, folder)).documents
    columns = ["id", "title", "content", "doc_type", "size", "word_count"]
    key = lambda frame: sorted(tuple(r)[1:] for r in frame.select(*columns).collect())
    assert key(streamed_documents(spark, out)) == key(batch)
    failed = spark.read.parquet(out).where("state = 'failed'")
    assert names(failed) == ["bad.json", "bad.txt", "scan.pdf"]


def test_extraction_fallback(spark):
    rows = spark.createDataFrame(
        [("x" * 49 + "  ", "fb"), ("x" * 50, "fb"), ("", None), (None, "fb")], "p string, f string"
    )
    chosen, tier = extraction_fallback(F.col("p"), F.col("f"))
    made = [tuple(r) for r in rows.select(chosen, tier).collect()]
    assert made == [("fb", "fallback"), ("x" * 50, "primary"), ("", "fallback"), ("fb", "fallback")]


@pytest.mark.parametrize("most", [100_000, 0])
def test_content_or_fallback_with_repeated_addresses(spark, monkeypatch, most):
    monkeypatch.setattr(web, "BROADCAST_ADDRESSES", most)
    pages = spark.createDataFrame(
        [(1, "u", "<body>p1</body>"), (2, "u", "<body>p2</body>"), (3, "v", "<body>p3</body>"), (4, "w", "<body>p4</body>")],
        "id int, url string, html string",
    )
    scraped = spark.createDataFrame([("u", "text"), ("v", " \xa0")], "url string, content string")
    made = content_or_fallback(pages, scraped, row_id="id").select("id", "content").collect()
    assert {r["id"]: r["content"] for r in made} == {1: "text", 2: "text", 3: "p3", 4: "p4"}


def test_routing_and_reports(spark):
    sources = [(1, "HTTP://h/x"), (2, "a.txt"), (3, "b.pdf"), (4, "gone.txt"), (5, "c.exe"), (6, "d.url"), (7, "http:h")]
    frame = spark.createDataFrame(sources, "row int, source string")
    listing = frame.where("row not in (1, 4, 7)").select("source")
    routed = {r["row"]: r["loader"] for r in routing.route_sources(frame, listing, row_id="row").collect()}
    assert routed == {1: "web", 2: "document", 3: "pdf", 4: None, 5: None, 6: None, 7: "web"}
    valid = {r["row"] for r in routing.validate_sources(frame, listing, row_id="row").where("valid").collect()}
    assert valid == {1, 2, 3, 6}
    lost = routing.load_failures(frame, listing)
    assert sorted(r["source"] for r in lost.collect()) == ["HTTP://h/x", "gone.txt", "http:h"]
    assert tuple(routing.load_report(frame, listing).first()) == (7, 4, 3)


def examples_of(spark):
    text = 'say "hi",\n  two lines \\ and a tab\t'
    rows = [(str(i), text + str(i), f" out {i} ", "summarization", {"bias": 0.5}) for i in range(50)]
    frame = spark.createDataFrame(
        rows, "id string, input_text string, output_text string, task_type string, quality_scores map<string,double>"
    )
    from inkweave import schemas

    return schemas.conform(frame, schemas.EXAMPLE)


@pytest.mark.parametrize("split_data", [True, False])
@pytest.mark.parametrize("export_format", ["jsonl", "csv", "parquet", "huggingface", "openai"])
def test_exports_read_back(spark, tmp_path, export_format, split_data):
    examples = examples_of(spark)
    out, ledger = str(tmp_path / "out"), str(tmp_path / "ledger")
    export.export_dataset(
        examples, out, export_format=export_format, split_data=split_data, dataset_id="d1", ledger_path=ledger
    )
    readers = {
        "jsonl": lambda: export.read_jsonl(spark, out),
        "csv": lambda: export.read_csv(spark, out),
        "parquet": lambda: spark.read.parquet(out),
        "huggingface": lambda: spark.read.parquet(out + "/data"),
        "openai": lambda: spark.read.text(out),
    }
    back = readers[export_format]().collect()
    expected = {(r["input_text"], r["output_text"]) for r in examples.collect()}
    if export_format == "openai":
        turns = [json.loads(r["value"])["messages"] for r in back]
        assert {(t[0]["content"], t[1]["content"]) for t in turns} == expected
        assert {tuple(m["role"] for m in t) for t in turns} == {("user", "assistant")}
    else:
        assert {(r["input_text"], r["output_text"]) for r in back} == expected
    assert len(back) == 50
    if split_data:
        assert {r["split"] for r in back} <= {"train", "validation", "test"}
    if export_format == "huggingface":
        assert (tmp_path / "out" / "README.md").exists() == split_data
    entry = spark.read.parquet(ledger).first()
    assert (entry["dataset_id"], entry["export_format"], entry["exported_rows"]) == ("d1", export_format, 50)
    assert entry["exported_at"] is not None
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        export.export_dataset(examples, out, export_format=export_format, split_data=split_data)


def test_chat_lines_with_system_turn(spark):
    row = spark.range(1).select(export.chat_json(F.lit("be kind"), F.lit(None), F.lit("q"), F.lit("a")).alias("j"))
    assert json.loads(row.first()["j"])["messages"][0] == {"role": "system", "content": "be kind"}


def test_quick_process(spark, folder, tmp_path):
    out = str(tmp_path / "data")
    run = quick_process(spark, folder, out, ["summarization"], ledger_path=str(tmp_path / "ledger"))
    assert export.read_jsonl(spark, out).count() == run.examples.count() > 0


class _Session:
    """Just what the shared folder is looked up from."""

    def __init__(self, master, folder):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = type("Context", (), {"master": master})


def test_shared_folder():
    assert shared_folder(_Session("yarn", "hdfs:///shared/")) == "hdfs:///shared"
    assert shared_folder(_Session("local[2]", None)) == shared_folder(_Session("local[2]", None))
    with pytest.raises(ValueError):
        shared_folder(_Session("yarn", None))


def test_load_keeps_what_was_lost(spark, folder):
    from inkweave.sources.load import load_sources

    loaded = load_sources(spark, [folder, folder, folder + "/a.txt"])
    lost = {r["source"].rsplit("/", 1)[1]: r["error_class"] for r in loaded.quarantine.collect()}
    assert lost == {"bad.txt": "malformed_encoding", "bad.json": "malformed_json", "scan.pdf": "parser_missing"}
    names = [r["source"] for r in loaded.documents.collect()]
    assert len(names) == len(set(names)) == 5 and tuple(loaded.report().first()) == (5, 3)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "12")
    try:
        short = load_sources(spark, folder, doc_types=["csv", "txt"])
        long = {r["source"].rsplit("/", 1)[1] for r in short.quarantine.where("error_class = 'file_too_long'").collect()}
        assert long == {"t.csv", "a.txt"}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_unwanted_types_have_no_parser_in_the_plan(spark, folder):
    plan = load_documents(spark, folder, doc_types=["txt"])._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "from_json" not in plan


def test_addresses_asked_for_twice(spark):
    pages = spark.createDataFrame([("http://h/a", "<p>x</p>"), ("http://h/a", "<p>x</p>"), ("http://h/b", "y")], "url string, html string")
    made = load_documents(spark, ["http://h/a", "http://h/a"], pages=pages).collect()
    assert [r["content"] for r in made] == ["x", "x"]


def test_load_order_follows_the_sources(spark, folder):
    """doc_seq is the place in the order of sources; a directory's files follow each other by path."""
    pages = spark.createDataFrame([("http://h/a", "<p>x</p>"), ("http://h/a", "<p>y</p>"), ("http://h/b", "z")], "url string, html string")
    named = ["http://h/b", folder + "/sub", "http://h/a", folder + "/a.txt", folder, "http://h/b"]
    made = [load_documents(spark, named, pages=pages, ordered=True).orderBy("doc_seq").collect() for _ in range(2)]
    rows = made[0]
    assert [r["doc_seq"] for r in rows] == list(range(8))
    assert [r["source"].rsplit("/", 1)[1] for r in rows] == ["b", "c.json", "p.html", "t.csv", "a", "a.txt", "B.MD", "b"]
    assert [r["content"] for r in rows] == [r["content"] for r in made[1]]
    assert {r["doc_seq"] for r in load_documents(spark, folder).collect()} == {None}


def test_files_are_read_once(spark, folder):
    from inkweave.sources.load import load_sources, registered_documents

    loaded = load_sources(spark, [folder, folder + "/a.txt"], once=True)
    plain = load_sources(spark, [folder, folder + "/a.txt"])
    assert tuple(loaded.report().first()) == tuple(plain.report().first()) == (5, 3)
    for one, other in ((loaded.documents, plain.documents), (loaded.quarantine, plain.quarantine)):
        one, other = (x.drop("created_at", "metadata") for x in (one, other))
        assert sorted(map(repr, one.collect())) == sorted(map(repr, other.collect()))
    plan = loaded.quarantine._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("binaryFile") <= 1  # the listing of files that are too long
    assert {r["id"] for r in registered_documents(loaded).collect()} == {r["id"] for r in loaded.documents.collect()}


def test_stream_registry_survives_a_replay(spark, folder, tmp_path):
    from pathlib import Path

    from inkweave.sources.documents import document_registry
    from inkweave.streaming import registry

    path, checkpoint = str(tmp_path / "registry"), str(tmp_path / "cp")
    run = lambda: registry.stream_registry(file_stream(spark, folder, max_files_per_trigger=2), path, checkpoint).awaitTermination()
    key = lambda frame: sorted(tuple(r) for r in frame.select("id", "title", "content", "word_count").collect())
    run()
    before = key(registry.registered(spark, path))
    assert before == key(document_registry(FileLoader().load(scan_directory(spark, folder)).documents, order_by="created_at"))
    # the last batch is run again, as where the stream failed before it could write that it was done
    commits = sorted(Path(checkpoint, "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    written = spark.read.parquet(path).count()
    commits[-1].unlink()
    Path(checkpoint, "commits", f".{commits[-1].name}.crc").unlink(missing_ok=True)
    run()
    assert key(registry.registered(spark, path)) == before and spark.read.parquet(path).count() == written
    # a file that is written anew is the later document of its id
    changed = FileLoader().load(scan_directory(spark, folder, types=["md"])).documents.withColumn("content", F.lit("later"))
    registry.upsert_batch(changed, 1000, path)
    assert {r["content"] for r in registry.registered(spark, path).where("doc_type = 'md'").collect()} == {"later"}
    assert registry.registered(spark, path).count() == len(before)


def test_stream_registry_makes_documents_in_its_own_plan(spark, folder, tmp_path):
    from pathlib import Path

    from inkweave.streaming import registry

    path, checkpoint = str(tmp_path / "registry"), str(tmp_path / "cp")
    run = lambda: registry.stream_registry(file_stream(spark, folder), path, checkpoint).awaitTermination()
    dated = lambda: sorted((r["id"], r["created_at"]) for r in registry.registered(spark, path).collect())
    run()
    before = dated()
    commits = Path(checkpoint, "commits")
    (commits / "0").unlink()
    (commits / ".0.crc").unlink(missing_ok=True)
    run()
    assert dated() == before and len({at for _, at in before}) == 1


def test_csv_records(spark):
    import csv
    import io

    from inkweave.sources.records import with_csv_records

    csv.field_size_limit(1 << 30)
    bodies = ["a,b\r\n1,\"x, \"\"y\"\"\nz\"\r\n\r\nshort\r\n4,5", "", None, "\n", "one", 'é,"' + "l" * 300_000 + '"\n']
    rows = spark.createDataFrame(list(enumerate(bodies)), "i int, body string").withColumn("row", F.lit("kept")).repartition(3)
    found = sorted((r["i"], r["row_num"], r["cells"]) for r in with_csv_records(rows, "body").collect())
    wanted = [(i, n, cells) for i, b in enumerate(bodies) if b is not None for n, cells in enumerate(csv.reader(io.StringIO(b, newline="")))]
    assert found == wanted


def test_runs_are_recorded(spark, folder, tmp_path):
    """Two runs are two jobs and two datasets; a run that fails has failed, whatever was done before."""
    from inkweave.operators.jobs import job_events, job_id, jobs
    from inkweave.plans.process import NoDocumentsError, process_documents, quick_process

    paths = {k: str(tmp_path / k) for k in ("jobs", "datasets", "quarantine")}
    options = {"jobs_path": paths["jobs"], "datasets_path": paths["datasets"], "quality_filter": False}
    run = quick_process(spark, folder, str(tmp_path / "out"), quarantine_path=paths["quarantine"], doc_types=["txt", "md"], **options)
    assert run.items.inputFiles() and spark.read.parquet(paths["quarantine"]).count() == 1
    with pytest.raises(NoDocumentsError):
        quick_process(spark, folder, str(tmp_path / "none"), doc_types=["html"], exclude_name_contains=("p.html",), **options)
    with pytest.raises(Exception, match="already exists"):
        quick_process(spark, folder, str(tmp_path / "out"), run_id="again", **options)
    again = process_documents(run.documents, **options)
    assert len({run.run_id, again.run_id, "again"}) == 3 and run.dataset_id != again.dataset_id
    now = {r["id"]: r for r in jobs(spark, paths["jobs"]).collect()}
    assert sorted(r["status"] for r in now.values()) == ["completed", "completed", "failed", "failed"]
    assert now[run.job_id]["name"] == "Process 2 documents" and now[run.job_id]["total_items"] == run.items.count() > 0
    assert now[run.job_id]["output_data"]["dataset_id"] == run.dataset_id
    assert now[job_id("again")]["status"] == "failed" and "exists" in now[job_id("again")]["error_message"]
    events = [r["status"] for r in job_events(spark, paths["jobs"]).where(F.col("id") == run.job_id).orderBy("seq").collect()]
    assert events == ["pending", "processing", "completed"]
    datasets = {r["id"]: r for r in spark.read.parquet(paths["datasets"]).collect()}
    assert set(datasets) == {run.dataset_id, again.dataset_id}
    assert [datasets[i]["name"] for i in (run.dataset_id, again.dataset_id)] == ["Generated Dataset 1", "Generated Dataset 2"]
    one = datasets[run.dataset_id]
    assert (one["export_format"], one["export_path"]) == ("jsonl", str(tmp_path / "out")) and one["exported_at"] is not None
    assert one["total_examples"] == sum(one["task_type_counts"].values()) == run.examples.count()
    assert datasets[again.dataset_id]["export_path"] is None


def test_the_example_of_the_readme(spark, folder, tmp_path):
    """The README's first example, with its paths put into a temporary folder."""
    import os
    import re

    readme = open(os.path.join(os.path.dirname(os.path.dirname(__file__)), "README.md")).read()
    code = re.search(r"```python\n(.*?)```", readme, re.S)[1]
    (tmp_path / "one.html").write_text("<p>One. Two.</p>")
    for name, path in (("/data/corpus", folder), ("/data/one.html", str(tmp_path / "one.html")), ("/out/", f"{tmp_path}/out/")):
        code = code.replace(name, path)

    class Client:
        @staticmethod
        def complete(prompt):
            return prompt[:40]

    fetched = spark.createDataFrame([("http://site/a-b", "<p>Page. More.</p>")], "url string, html string")
    names = {"spark": spark, "fetched_pages": fetched, "client": Client}
    exec(code, names)  # noqa: S102
    assert names["run"].examples.count() > 0
    assert export.read_jsonl(spark, f"{tmp_path}/out/set").count() == names["run"].examples.count()


def test_scratch_tables_can_be_dropped(spark, tmp_path):
    from inkweave.session import drop_scratch, written

    kept = str(tmp_path / "kept")
    spark.range(3).write.parquet(kept)
    one, other = written(spark.range(5), "a"), spark.read.parquet(kept)
    assert one.count() == 5 and drop_scratch(spark, one, other) == 1
    assert spark.read.parquet(kept).count() == 3
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist"):
        one.collect()
