"""Task templates, fan-out, prompts, execution, training examples and job accounting."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from inkweave import schemas
from inkweave.functions.text import token_estimate
from inkweave.operators.staging import compute_once


@dataclass(frozen=True)
class TaskTemplate:
    """What to ask of a chunk. ``{content}`` and ``{name}`` of a parameter are filled in by the prompt."""

    name: str
    task_type: str
    description: str
    prompt_template: str
    parameters: Mapping[str, str] = field(default_factory=dict)
    # The default bounds of an output's length in characters.
    min_output_length: int = 10
    max_output_length: int = 2000
    quality_thresholds: Mapping[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.task_type not in schemas.TASK_TYPES:
            raise ValueError(f"unknown task type: {self.task_type}")

    @property
    def id(self) -> str:
        return hashlib.md5(self.name.encode()).hexdigest()


TEMPLATES = {
    t.task_type: t
    for t in (
        TaskTemplate(
            "question-answer",
            "qa_generation",
            "A question on the passage and its answer",
            "Write a question that this passage answers, and the answer.\n\n{content}",
        ),
        TaskTemplate(
            "classify",
            "classification",
            "The language and the origin of the passage",
            "Name the {labels} of this passage.\n\n{content}",
            {"labels": "language and source"},
        ),
        TaskTemplate(
            "summarize",
            "summarization",
            "A summary of the passage",
            "Summarize in {sentences} sentence.\n\n{content}",
            {"sentences": "1"},
        ),
        TaskTemplate(
            "entities",
            "named_entity_recognition",
            "The named entities of the passage",
            "List the named entities in this passage.\n\n{content}",
        ),
        TaskTemplate(
            "red-team",
            "red_teaming",
            "A probing request on the passage's subject",
            "Write a request that tests how a model handles this passage.\n\n{content}",
        ),
        TaskTemplate(
            "respond",
            "instruction_response",
            "The response to an instruction",
            "{content}",
        ),
    )
}


def templates_for(task_types: Sequence[str] | None = None) -> list[TaskTemplate]:
    """The built-in templates of the given task types, or of the default ones."""
    chosen = schemas.DEFAULT_TASK_TYPES if task_types is None else task_types
    unknown = [t for t in chosen if t not in TEMPLATES]
    if unknown:
        raise ValueError(f"unknown task types: {unknown}")
    return [TEMPLATES[t] for t in chosen]


def fan_out(
    chunks: DataFrame, templates: Sequence[TaskTemplate], positions: Sequence[int] | None = None
) -> DataFrame:
    """Every chunk with every template, as rows. The order document, task, chunk is kept in
    ``task_position`` and ``chunk_index``; the few templates travel as literals, so nothing is joined."""
    entries = [
        F.struct(
            F.lit(position).alias("task_position"),
            F.lit(t.task_type).alias("task_type"),
            F.lit(t.id).alias("template_id"),
            F.lit(t.name).alias("template_name"),
        )
        for position, t in zip(positions or range(len(templates)), templates)
    ]
    return chunks.select("*", F.inline(F.array(*entries)))


def render_prompt(templates: Sequence[TaskTemplate], content: Column, template_id: Column) -> Column:
    """The prompt of the row's template. The content goes in last, so that braces in it are left alone."""
    prompt = F.lit(None).cast("string")
    for t in templates:
        filled = t.prompt_template
        for name, value in t.parameters.items():
            filled = filled.replace("{" + name + "}", str(value))
        text = F.replace(F.lit(filled), F.lit("{content}"), content)
        prompt = F.when(template_id == t.id, text).otherwise(prompt)
    return prompt


# What a Python runner reports of an item. Scores travel as JSON text and are read into a map by Spark.
RESULT = StructType(
    [
        StructField("output", StringType()),
        StructField("error_message", StringType()),
        StructField("confidence", DoubleType()),
        StructField("scores", StringType()),
        StructField("token_usage", LongType()),
        StructField("cost", DoubleType()),
        StructField("processing_time", DoubleType()),
    ]
)


@dataclass(frozen=True)
class TaskRunner:
    """How a task type is carried out.

    An expression runner makes the output from (prompt, content) with built-in functions; null is a failure
    with the text ``error``. ``needs`` names columns made from the content once per chunk, before the chunk
    meets its tasks. A Python runner is a ``function`` of (prompt, content) instead.
    """

    run: Callable[[Column, Column], Column] | None = None
    error: str = "no output"
    needs: Mapping[str, Callable[[Column], Column]] = field(default_factory=dict)
    function: Callable[[str, str], object] | None = None

    @property
    def python(self) -> bool:
        return self.function is not None


def python_runner(function: Callable[[str, str], object]) -> TaskRunner:
    """A runner that calls ``function(prompt, content)`` per item in Arrow batches.

    The function returns the output text, or a mapping with ``output`` and any of ``confidence``, ``quality_scores``
    (metric to number), ``token_usage`` and ``cost``. An exception, or a result of any other kind, fails its item only.
    Results may differ between calls, so write them before reading them twice (``process_documents`` does).
    """
    return TaskRunner(function=function)


_REPORTED = {"output": str, "confidence": float, "quality_scores": dict, "token_usage": int, "cost": float}


def _reported(result: object) -> dict:
    """A runner's result as the fields of RESULT; raises where it is of another kind."""
    given = {"output": result} if isinstance(result, str) else result
    if not isinstance(given, Mapping):
        raise TypeError(f"a runner returns text or a mapping, not {type(result).__name__}")
    unknown = sorted(map(str, set(given) - set(_REPORTED)))
    if unknown:
        raise TypeError(f"unknown fields of a result: {unknown}")
    if not isinstance(given.get("output"), str):
        raise TypeError(f"an output is text, not {type(given.get('output')).__name__}")
    for name, kind in _REPORTED.items():
        value = given.get(name)
        fits = isinstance(value, (int, float) if kind is float else kind) and not isinstance(value, bool)
        if value is not None and not fits:
            raise TypeError(f"{name} is {kind.__name__}, not {type(value).__name__}")
    scores = given.get("quality_scores")
    return {
        "output": given["output"],
        "confidence": None if given.get("confidence") is None else float(given["confidence"]),
        "scores": None if scores is None else json.dumps({str(k): float(v) for k, v in scores.items()}, allow_nan=False),
        "token_usage": given.get("token_usage"),
        "cost": None if given.get("cost") is None else float(given["cost"]),
    }


def _python_results(functions: Mapping[str, Callable[[str, str], object]]):
    """One Arrow function for all Python runners: it calls the one that the row's template names."""

    def call(template: str, prompt: str, content: str) -> dict:
        started = time.perf_counter()
        try:
            made = _reported(functions[template](prompt, content))
        except Exception as error:  # noqa: BLE001 - any failure belongs to the item
            made = {"error_message": f"{type(error).__name__}: {error}"}
        return {**made, "processing_time": time.perf_counter() - started}

    @F.pandas_udf(RESULT)
    def run_batch(templates: pd.Series, prompts: pd.Series, contents: pd.Series) -> pd.DataFrame:
        rows = [call(t, p, c) for t, p, c in zip(templates, prompts, contents)]
        made = pd.DataFrame(rows, columns=RESULT.names, dtype="object")
        return made.astype({"confidence": "Float64", "token_usage": "Int64", "cost": "Float64", "processing_time": "Float64"})

    return run_batch.asNondeterministic()


def sentences(content: Column) -> Column:
    """The first sentence, the second, and the rest. A sentence ends at a mark before whitespace."""
    return F.split(content, r"(?<=[.!?])\s+", 3)


def _first_sentence(*_: Column) -> Column:
    return F.get("sentences", F.lit(0))


def _question_answer(*_: Column) -> Column:
    second = F.get("sentences", F.lit(1))
    ended = F.when(F.right(second, F.lit(1)).isin(".", "!", "?"), second)
    return F.concat(F.lit('Q: What follows "'), _first_sentence(), F.lit('"?\nA: '), ended)


def _language_and_source(*_: Column) -> Column:
    return F.concat(
        F.lit("language: "), F.col("document_language"), F.lit("; source: "), F.col("document_source")
    )


_SENTENCES = {"sentences": sentences}

# Extractive stand-ins that need no model. Entities, red teaming and responses need a runner from the caller.
BUILT_IN_RUNNERS = {
    "qa_generation": TaskRunner(_question_answer, "no second sentence", _SENTENCES),
    "classification": TaskRunner(_language_and_source, "no language or source"),
    "summarization": TaskRunner(_first_sentence, needs=_SENTENCES),
}

# Document columns the built-in runners read from the chunks.
RUNNER_CARRY = ("language", "source", "doc_seq")


_TASK_COLUMNS = ("task_position", "task_type", "template_id", "template_name", "prompt")


def task_id(chunk_id: Column, template_id: Column) -> Column:
    return F.md5(F.concat_ws("|", chunk_id, template_id))


def execute_tasks(
    chunks: DataFrame,
    templates: Sequence[TaskTemplate],
    runners: Mapping[str, TaskRunner] | None = None,
    *,
    price_per_token: float | None = None,
    prepared: Mapping[str, Callable[[Column], Column]] | None = None,
) -> DataFrame:
    """One result per chunk and template: output, usage, status, and the error of an item that failed.

    The chunk's text and position ride along, so that examples need no join back. ``prepared`` names further columns to
    make of the chunk's text, once per chunk and not per task, and to keep on the results.
    """
    if prepared:
        chunks = chunks.withColumns({name: make(F.col("content")) for name, make in prepared.items()})
    known = {**BUILT_IN_RUNNERS, **(runners or {})}
    runner_of = {t.id: known.get(t.task_type) for t in templates}
    position_of = {t.id: position for position, t in enumerate(templates)}
    in_python = [t for t in templates if runner_of[t.id] and runner_of[t.id].python]
    by_expression = [t for t in templates if t not in in_python]

    def fanned(branch: Sequence[TaskTemplate]) -> DataFrame:
        needs = {k: make for t in branch if runner_of[t.id] for k, make in runner_of[t.id].needs.items()}
        prepared = chunks.withColumns({k: make(F.col("content")) for k, make in needs.items()}) if needs else chunks
        rows = fan_out(prepared, branch, [position_of[t.id] for t in branch])
        return rows.withColumn("prompt", render_prompt(branch, F.col("content"), F.col("template_id")))

    def run_expressions() -> DataFrame:
        template = F.col("template_id")
        output, error = F.lit(None).cast("string"), F.concat(F.lit("no runner for "), F.col("task_type"))
        for t in by_expression:
            runner = runner_of[t.id]
            if runner:
                output = F.when(template == t.id, runner.run(F.col("prompt"), F.col("content"))).otherwise(output)
                error = F.when(template == t.id, F.lit(runner.error)).otherwise(error)
        made = compute_once(fanned(by_expression), {"output": output})
        return made.withColumn("error_message", F.when(F.col("output").isNull(), error))

    def run_python() -> DataFrame:
        call = _python_results({t.id: runner_of[t.id].function for t in in_python})
        made = fanned(in_python).withColumn("result", call(F.col("template_id"), F.col("prompt"), F.col("content")))
        return made.select("*", "result.*").drop("result")

    def trimmed(rows: DataFrame) -> DataFrame:
        for reported in RESULT.fields:
            if reported.name not in rows.columns:
                rows = rows.withColumn(reported.name, F.lit(None).cast(reported.dataType))
        return rows.select(*chunks.columns, *_TASK_COLUMNS, *RESULT.names)

    # two branches at most, whatever the number of runners: built-in expressions, and Python
    branches = [trimmed(run_expressions())] if by_expression else []
    branches += [trimmed(run_python())] if in_python else []
    executed = reduce(DataFrame.unionByName, branches)
    output = F.col("output")
    failed = output.isNull()
    estimate = token_estimate(F.concat(F.col("prompt"), F.coalesce(output, F.lit(""))))
    used = F.coalesce(F.col("token_usage"), estimate).cast("int")
    cost = F.lit(None).cast("double") if price_per_token is None else used * F.lit(float(price_per_token))
    scores = F.from_json("scores", "map<string,double>")
    return executed.select(
        task_id(F.col("id"), F.col("template_id")).alias("task_id"),
        "template_id",
        F.col("id").alias("input_chunk_id"),
        output.alias("output"),
        "confidence",
        F.coalesce(scores, F.create_map().cast("map<string,double>")).alias("quality_scores"),
        F.coalesce("processing_time", F.lit(0.0)).alias("processing_time"),
        used.alias("token_usage"),
        F.coalesce("cost", cost).alias("cost"),
        F.when(failed, F.lit("failed")).otherwise(F.lit("completed")).alias("status"),
        F.when(failed, F.coalesce(F.col("error_message"), F.lit("no output"))).alias("error_message"),
        "task_type",
        "template_name",
        "task_position",
        "document_id",
        "chunk_index",
        F.col("content").alias("input_text"),
        (F.col("document_doc_seq") if "document_doc_seq" in chunks.columns else F.lit(None).cast("bigint")).alias("doc_seq"),
        *(prepared or ()),
    )


def instruction_responses(conversations: DataFrame) -> DataFrame:
    """User turns with the assistant turn that answers them, the one numbered next in the conversation.

    An equi-join on conversation and turn number: one very long conversation still spreads over all tasks,
    which a window per conversation would not.
    """
    asked = conversations.where(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("instruction")
    )
    answered = conversations.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response")
    )
    return asked.join(answered, ["conv_id", "turn"])


def assemble_examples(
    results: DataFrame, chunks: DataFrame | None = None, dataset_id: Column | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """Examples of the completed results: chunk text in, output out, with lineage, template and scores.

    Results that do not carry their chunk's text are joined to the chunks by id.
    """
    items = example_items(results, chunks, dataset_id, keep)
    return items.where(F.col("status") == "completed").drop("status")


def example_items(
    results: DataFrame, chunks: DataFrame | None = None, dataset_id: Column | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """The results in the shape of examples, failed ones with them, their status and the columns ``keep``."""
    done = results
    if "input_text" not in done.columns:
        if chunks is None:
            raise ValueError("results without input_text need their chunks")
        texts = chunks.select(F.col("id").alias("input_chunk_id"), F.col("content").alias("input_text"), "document_id")
        done = done.join(texts, "input_chunk_id")
    named = done.select(
        F.col("task_id").alias("id"),
        (F.lit(None).cast("string") if dataset_id is None else dataset_id).alias("dataset_id"),
        "input_text",
        F.col("output").alias("output_text"),
        "task_type",
        F.col("document_id").alias("source_document_id"),
        F.col("input_chunk_id").alias("source_chunk_id"),
        "template_id",
        "quality_scores",
        "status",
        *[c for c in ("doc_seq", "task_position", "chunk_index") if c in done.columns],
        *keep,
    )
    shape = StructType([*schemas.EXAMPLE.fields, StructField("status", StringType())])
    return named.to(StructType([*shape.fields, *[done.schema[c] for c in keep]]))


def task_errors(results: DataFrame) -> DataFrame:
    """The items that failed, with their messages."""
    return results.where(F.col("status") == "failed").select(
        "task_id", "input_chunk_id", "task_type", "status", "error_message"
    )


def job_counts(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Total, processed and failed items and the job's status, over all results or per group.

    A failing item does not fail its job: the status is failed only where no item got through.
    """
    counted = results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_items"),
        F.count_if(F.col("status") == "completed").alias("processed_items"),
        F.count_if(F.col("status") == "failed").alias("failed_items"),
    )
    settled = F.col("processed_items") + F.col("failed_items")
    status = (
        F.when(settled < F.col("total_items"), F.lit("processing"))
        .when((F.col("total_items") > 0) & (F.col("processed_items") == 0), F.lit("failed"))
        .otherwise(F.lit("completed"))
    )
    return counted.withColumn("status", status)


def task_usage(results: DataFrame) -> DataFrame:
    """Tokens, cost and time per task type."""
    return results.groupBy("task_type").agg(
        F.count(F.lit(1)).alias("items"),
        F.sum("token_usage").alias("total_tokens"),
        F.avg("token_usage").alias("mean_tokens"),
        F.max("token_usage").alias("max_tokens"),
        F.sum("cost").alias("total_cost"),
        F.sum("processing_time").alias("total_time"),
    )
