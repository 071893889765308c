"""Task templates as a table: fan-out and prompts whose plan does not grow with the number of templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkweave import schemas
from inkweave.operators.tasks import TaskTemplate

#: Templates of so many bytes travel with every task at once; more are cut into blocks of about this size.
BLOCK_BYTES = 1 << 20
#: Ways that the chunks of a block are spread, where templates are joined by blocks.
WAYS = 64


def template_table(spark, templates: list[TaskTemplate]) -> DataFrame:
    """Templates given in code as rows, numbered as they come."""
    rows = [
        (t.id, t.name, t.task_type, t.prompt_template, {k: str(v) for k, v in t.parameters.items()}, t.min_output_length, t.max_output_length, dict(t.quality_thresholds), i)
        for i, t in enumerate(templates)
    ]
    return spark.createDataFrame(rows, schemas.TEMPLATE)


def checked_templates(templates: DataFrame) -> DataFrame:
    """The templates in the shape of the schema: an id is made of the name, bounds have their defaults, and a task type
    outside the domain ends the job."""
    given = set(templates.columns)

    def column(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if name in given else default

    shaped = templates.select(
        column("id", F.md5("name")).alias("id"),
        "name",
        schemas.checked(F.col("task_type"), schemas.TASK_TYPES, "task_type").alias("task_type"),
        "prompt_template",
        column("parameters", F.create_map().cast("map<string,string>")).alias("parameters"),
        column("min_output_length", F.lit(TaskTemplate.min_output_length)).cast("int").alias("min_output_length"),
        column("max_output_length", F.lit(TaskTemplate.max_output_length)).cast("int").alias("max_output_length"),
        column("quality_thresholds", F.create_map().cast("map<string,double>")).alias("quality_thresholds"),
        F.col("task_position").cast("int").alias("task_position") if "task_position" in given else F.lit(None).cast("int").alias("task_position"),
    )
    return schemas.conform(shaped, schemas.TEMPLATE)


def filled_prompt(template: Column, parameters: Column, content: Column) -> Column:
    """The template with its parameters filled in, in order of their names, and the content last, so that braces in it
    are left alone; a parameter without a value leaves its place as it is."""
    entries = F.filter(F.array_sort(F.map_entries(parameters)), lambda e: e["value"].isNotNull())
    filled = F.aggregate(entries, template, lambda text, e: F.replace(text, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))
    return F.replace(filled, F.lit("{content}"), content)


def fan_out_table(chunks: DataFrame, templates: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every chunk with every template of the table, as rows, with ``prompt`` and the template's columns.

    The templates are measured first. As long as they are small they are one array that travels with the plan as a
    value, and the fan-out is no join. Otherwise they are cut into blocks of about ``block_bytes``, each an array, and a
    chunk meets a block by an equi-join on the block's number, spread over several salts; no task ever holds more than
    a block. An empty table gives no rows.
    """
    shaped = checked_templates(templates)
    entry = F.struct(*[F.col(c) for c in shaped.columns]).alias("entry")
    size = F.octet_length("prompt_template") + F.octet_length(F.to_json("parameters")) + F.lit(100)
    total = shaped.agg(F.sum(size)).first()[0] or 0
    blocks = -(-total // block_bytes)
    if blocks <= 1:
        every = shaped.agg(F.collect_list(entry).alias("entries")).scalar()
        rows = chunks.select("*", F.explode(every).alias("_template"))
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(WAYS - 1)))
        cut = shaped.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("_block"), entry).groupBy("_block").agg(F.collect_list("entry").alias("_entries"))
        salted = cut.select("*", salts.alias("_salt"))
        spread = chunks.select("*", F.pmod(F.xxhash64("id"), F.lit(WAYS)).cast("int").alias("_salt"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"))
        rows = spread.join(salted, ["_block", "_salt"]).select(*chunks.columns, F.explode("_entries").alias("_template"))
    t = F.col("_template")
    named = {"template_id": t["id"], "template_name": t["name"], **{c: t[c] for c in ("task_type", "task_position", "min_output_length", "max_output_length", "quality_thresholds")}}
    prompt = filled_prompt(t["prompt_template"], t["parameters"], F.col("content"))
    return rows.withColumns({**named, "prompt": prompt}).drop("_template")
