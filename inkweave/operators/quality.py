"""Scoring examples, the thresholds and bounds they must meet, the gate, and dataset evaluation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkweave.functions import metrics
from inkweave.functions.text import filled_lines, words
from inkweave.operators.staging import compute_once
from inkweave.operators.tasks import TEMPLATES, TaskTemplate
from inkweave.schemas import QUALITY_METRICS

# Metrics where less is better: their threshold is a ceiling, the others' is a floor.
LOWER_IS_BETTER = ("toxicity", "bias")

DEFAULT_THRESHOLDS = {"diversity": 0.2, "coherence": 0.5, "toxicity": 0.3, "bias": 0.3}
DEFAULT_TOXIC_WORDS = ("hate", "idiot", "kill", "moron", "scum", "stupid", "trash", "vermin")
DEFAULT_BIASED_WORDS = ("always", "everybody", "inferior", "never", "nobody", "obviously", "superior")


#: What scoring takes of a chunk's text, for ``execute_tasks`` to make once per chunk.
PREPARED = {"input_words": words}


def score_map(scores: Mapping[str, Column]) -> Column:
    """metric -> score, without the metrics that have none."""
    names = [m for m in QUALITY_METRICS if m in scores] + [m for m in scores if m not in QUALITY_METRICS]
    entries = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[scores[n] for n in names]))
    return F.map_filter(entries, lambda _, score: score.isNotNull())


def threshold_reasons(scores: Column, thresholds: Column) -> Column:
    """What speaks against the scores: one text per threshold that is not met, in order of the metric's name."""

    def reason(entry: Column) -> Column:
        metric, bound = entry["key"], entry["value"]
        score = F.try_element_at(scores, metric)
        lower = metric.isin(*LOWER_IS_BETTER)
        return (
            F.when(score.isNull(), F.concat(F.lit("no score for "), metric))
            .when(lower & (score > bound), F.concat(metric, F.lit(" above threshold")))
            .when(~lower & (score < bound), F.concat(metric, F.lit(" below threshold")))
        )

    found = F.transform(F.map_entries(thresholds), reason)
    return F.array_sort(F.filter(found, lambda r: r.isNotNull()))


def _double_map(values: Mapping[str, float]) -> Column:
    items = [x for name in sorted(values) for x in (F.lit(name), F.lit(float(values[name])))]
    return F.create_map(*items).cast("map<string,double>")


def thresholds_of(templates: Sequence[TaskTemplate], template_id: Column, default: Mapping[str, float]) -> Column:
    """The template's thresholds over the default ones."""
    chosen = _double_map(default)
    for t in templates:
        if t.quality_thresholds:
            chosen = F.when(template_id == t.id, _double_map({**default, **t.quality_thresholds})).otherwise(chosen)
    return chosen


def within_bounds(templates: Sequence[TaskTemplate], template_id: Column, output: Column) -> Column:
    """True where the output's length lies within the template's bounds, both inclusive."""
    length = F.char_length(output)
    fits = F.lit(None).cast("boolean")
    for t in templates:
        bounds = F.coalesce(length.between(t.min_output_length, t.max_output_length), F.lit(False))
        fits = F.when(template_id == t.id, bounds).otherwise(fits)
    return F.coalesce(fits, F.lit(True))


def output_length_gate(results: DataFrame, templates: Sequence[TaskTemplate]) -> DataFrame:
    """The results whose output length their template allows."""
    return results.where(within_bounds(templates, F.col("template_id"), F.col("output")))


@dataclass(frozen=True)
class Evaluator:
    """Scores an example and tells whether it passes, and why not.

    ``extra`` maps names of further metrics to expressions over (input text, output text).
    """

    templates: Sequence[TaskTemplate] = tuple(TEMPLATES.values())
    thresholds: Mapping[str, float] = field(default_factory=lambda: dict(DEFAULT_THRESHOLDS))
    toxic_words: Sequence[str] = DEFAULT_TOXIC_WORDS
    biased_words: Sequence[str] = DEFAULT_BIASED_WORDS
    extra: Mapping[str, object] = field(default_factory=dict)

    def score(self, examples: DataFrame, label: Column | None = None) -> DataFrame:
        """Fill quality_scores; scores an example already carries stand.

        Where the examples have ``input_words`` (see PREPARED), these are taken, and left out of the result.
        """
        given = "input_words" in examples.columns
        tokenized = examples.withColumns(
            {
                # an item without an output has no scores, so its input is left alone
                "_in": F.col("input_words") if given else words(F.when(F.col("output_text").isNotNull(), F.col("input_text"))),
                "_out": words(F.col("output_text")),
                "_lines": filled_lines(F.col("output_text")),
            }
        )
        out = F.col("_out")
        scores = {
            "toxicity": metrics.toxicity(out, self.toxic_words, label),
            "bias": metrics.bias(out, self.biased_words),
            "diversity": metrics.diversity(out),
            "coherence": metrics.coherence(F.col("_lines")),
            "relevance": metrics.relevance(F.col("_in"), out),
            **{name: rule(F.col("input_text"), F.col("output_text")) for name, rule in self.extra.items()},
        }
        carried = F.coalesce(F.col("quality_scores"), F.create_map().cast("map<string,double>"))
        measures = {f"score_{name}": score for name, score in scores.items()}
        measured = compute_once(tokenized, measures)
        fresh = score_map({name: F.col(f"score_{name}") for name in scores})
        fresh = F.map_filter(fresh, lambda metric, _: ~F.map_contains_key(carried, metric))
        merged = F.map_concat(carried, fresh)
        return measured.withColumn("quality_scores", merged).drop("_in", "_out", "_lines", "input_words", *measures)

    def evaluate(self, examples: DataFrame, label: Column | None = None) -> DataFrame:
        """Add quality_scores, passed and reasons."""
        template, output = F.col("template_id"), F.col("output_text")
        bounds = thresholds_of(self.templates, template, self.thresholds)
        length = F.when(
            ~within_bounds(self.templates, template, output), F.array(F.lit("output length out of bounds"))
        ).otherwise(F.array().cast("array<string>"))
        scored = self.score(examples, label)
        judged = scored.withColumn("judgement", F.concat(threshold_reasons(F.col("quality_scores"), bounds), length))
        verdict = {"quality_scores": F.col("quality_scores"), "reasons": F.col("judgement")}
        return compute_once(judged, verdict).drop("judgement").withColumn("passed", F.size("reasons") == 0)


def gate_marks(evaluated: DataFrame, quality_filter: bool = True) -> DataFrame:
    """All examples with ``quality_approved``: the verdict, or null where the gate is off. One pass for kept and rejected."""
    verdict = F.col("passed") if quality_filter else F.lit(None).cast("boolean")
    return evaluated.withColumn("quality_approved", verdict)


def quality_gate(evaluated: DataFrame, quality_filter: bool = True) -> tuple[DataFrame, DataFrame]:
    """The examples let through and the rejected ones, for callers who write the marked examples once and read both.

    Off: all pass, with ``quality_approved`` left null.
    """
    marked = gate_marks(evaluated, quality_filter)
    if not quality_filter:
        return marked, marked.where(F.lit(False))
    return marked.where(F.col("passed")), marked.where(~F.col("passed"))


def example_score(scores: Column) -> Column:
    """Mean of an example's metrics, with toxicity and bias turned round."""
    turned = F.transform(
        F.map_entries(scores),
        lambda e: F.when(e["key"].isin(*LOWER_IS_BETTER), F.lit(1.0) - e["value"]).otherwise(e["value"]),
    )
    total = F.aggregate(turned, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(turned) > 0, total / F.size(turned))


def evaluate_dataset(evaluated: DataFrame, least_score: float = 0.5) -> DataFrame:
    """One row: examples, how many passed, the mean score, whether the dataset passes, and why not.

    A dataset passes if it has examples and their mean score is ``least_score`` or more. ``quality_stats`` of the
    same examples has the detail per metric. Scored rows without a verdict have no number of passed ones.
    """
    passed = F.count_if(F.col("passed")) if "passed" in evaluated.columns else F.max(F.lit(None).cast("bigint"))
    row = evaluated.agg(
        F.count(F.lit(1)).alias("examples"),
        passed.alias("passed_examples"),
        F.avg(example_score(F.col("quality_scores"))).alias("overall_score"),
    )
    reasons = F.array_compact(
        F.array(
            F.when(F.col("examples") == 0, F.lit("no examples")),
            F.when(F.col("overall_score") < least_score, F.lit("overall score below threshold")),
        )
    )
    return row.withColumn("reasons", reasons).withColumn("passed", F.size("reasons") == 0)


def quality_stats(scored: DataFrame) -> DataFrame:
    """Count, mean, min, max and standard deviation per metric."""
    return (
        scored.select(F.explode("quality_scores").alias("metric", "score"))
        .groupBy("metric")
        .agg(
            F.count("score").alias("count"),
            F.avg("score").alias("mean"),
            F.min("score").alias("min"),
            F.max("score").alias("max"),
            F.stddev_samp("score").alias("stddev"),
        )
    )


def moments_map(scores: Column, names: Sequence[str] = QUALITY_METRICS, where: Column | None = None) -> Column:
    """An aggregate: metric -> (statistic -> value) over rows of score maps, without the metrics that no row has.

    All moments are mergeable, so a group of any size is reduced before the shuffle. ``where`` leaves rows out.
    """

    def entry(metric: str) -> Column:
        score = F.try_element_at(scores, F.lit(metric))
        score = score if where is None else F.when(where, score)
        moments = {"count": F.count(score).cast("double"), "mean": F.avg(score), "min": F.min(score), "max": F.max(score), "stddev": F.stddev_samp(score)}
        return F.create_map(*[x for name, value in moments.items() for x in (F.lit(name), value)])

    stats = F.map_from_arrays(F.array(*[F.lit(m) for m in names]), F.array(*[entry(m) for m in names]))
    return F.map_filter(stats, lambda _, moments: moments["count"] > 0)


def quality_stats_map(scored: DataFrame, by: Sequence[str] = (), names: Sequence[str] = QUALITY_METRICS) -> DataFrame:
    """The per-metric statistics as one map of maps, over all rows or per group: one aggregate.

    ``names`` are the metrics looked for; those of an evaluator's ``extra`` are added by the caller.
    """
    return scored.groupBy(*by).agg(moments_map(F.col("quality_scores"), names).alias("quality_stats"))
