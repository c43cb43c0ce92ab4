"""Trials: parsing, routing, counting, and joins with stimulus labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatelab.functions.phonemes import CODINGS, lookup
from gatelab.functions.text import computed, strip
from gatelab.sources.files import LISTENERS

TRIAL = ["pp_id", "gate", "line_no", "gt1", "gt2", "coding", "coding_label", "resp_raw", "resp1", "resp2"]


def coding_label(coding):
    return F.element_at(F.create_map(*[F.lit(x) for kv in CODINGS.items() for x in kv]), coding)


def classify(raw_lines: DataFrame) -> DataFrame:
    """raw_lines with the fields of a trial and a reason, NULL for a good one, in one pass."""
    halves = F.split("line", "\\|\\|", -1)
    left = F.split(F.get("halves", F.lit(0)), ":", -1)
    rows = computed(raw_lines.withColumn("halves", halves).withColumn("left", left))
    shaped = (F.size("halves") == 2) & (F.size("left") == 3)
    rows = rows.select(
        *raw_lines.columns,
        shaped.alias("shaped"),
        lookup(strip(F.get("left", F.lit(0))), "response", "ipa").alias("gt1"),
        lookup(F.get("left", F.lit(1)), "response", "ipa").alias("gt2"),  # the second symbol isn't stripped
        strip(F.get("left", F.lit(2))).alias("coding"),
        strip(F.get("halves", F.lit(1))).alias("resp_raw"),
    )
    rows = computed(rows).withColumn("coding_label", coding_label(F.col("coding")))
    for k in (1, 2):
        rows = rows.withColumn(f"resp{k}", lookup(F.substring("resp_raw", k, 1), "response", "ipa"))
    reason = (
        F.when(~F.col("shaped"), "malformed")
        .when(F.col("gt1").isNull() | F.col("gt2").isNull(), "unknown_symbol")
        .when(F.col("coding_label").isNull(), "unknown_coding")
        .when(F.length("resp_raw") != 2, "bad_length")
        .when(F.col("resp1").isNull() | F.col("resp2").isNull(), "unknown_symbol")
    )
    return computed(rows.withColumn("reason", reason))


def parse_trials(raw_lines: DataFrame, strict: bool = False) -> DataFrame:
    """Good trials.  With strict, a fault other than a wrong number of parts raises an error."""
    rows = classify(raw_lines)
    if strict:
        fatal = F.col("reason").isNotNull() & (F.col("reason") != "malformed")
        rows = rows.where(F.when(fatal, F.raise_error(F.concat(F.col("reason"), F.lit(": "), F.col("line"))).cast("boolean")).otherwise(True))
    return rows.where("reason is null").select(*TRIAL)


def quarantine_trials(raw_lines: DataFrame) -> DataFrame:
    return classify(raw_lines).where("reason is not null").select("pp_id", "gate", "line_no", "line", "reason")


def drop_empty_lines(lines: DataFrame) -> DataFrame:
    return lines.where("line <> ''")


def filter_participants(rows: DataFrame, pp_ids=LISTENERS) -> DataFrame:
    return rows.where(F.col("pp_id").isin(list(pp_ids)))


def in_range(value: int, low: int, high: int, what: str) -> int:
    if not low <= value <= high:
        raise ValueError(f"{what} must be between {low} and {high}, not {value}")
    return value


def select_gate(rows: DataFrame, gate: int) -> DataFrame:
    return rows.where(F.col("gate") == in_range(gate, 1, 6, "gate"))


def select_position(rows: DataFrame, position: int) -> DataFrame:
    return rows.where(F.col("position") == in_range(position, 1, 2, "position"))


def trial_pairs(trials: DataFrame) -> DataFrame:
    return trials.select("pp_id", "gate", "line_no", F.concat_ws(" ", "gt1", "gt2").alias("gt"), F.concat_ws(" ", "resp1", "resp2").alias("response"))


def trial_info(trials: DataFrame) -> DataFrame:
    return trials.select(
        F.col("gt1").alias("gt_phoneme1"), F.col("gt2").alias("gt_phoneme2"), F.col("resp1").alias("response_phoneme_1"), F.col("resp2").alias("response_phoneme_2"), F.col("pp_id").alias("participant"), "gate"
    )


def relabel_keys(confusion: DataFrame) -> DataFrame:
    return confusion.select(
        F.concat(F.lit("pp"), "pp_id").alias("participant"), F.concat(F.lit("gate"), "gate").alias("gate"), F.concat(F.lit("phoneme"), "position").alias("position"), "gt", "hyp", "n"
    )


def trial_counts(raw_lines: DataFrame) -> DataFrame:
    """n_trials (errors included), n_errors (malformed only) per listener and gate, per listener and overall."""
    rows = classify(raw_lines)
    return (
        rows.rollup("pp_id", "gate")
        .agg(
            F.grouping_id().cast("int").alias("level"),
            F.count("*").alias("n_trials"),
            F.count_if(F.coalesce(F.col("reason") == "malformed", F.lit(False))).alias("n_errors"),
            F.count_distinct("pp_id").alias("n_participants"),
        )
        .select("level", "pp_id", "gate", "n_trials", "n_errors", "n_participants")
    )


# --- with labels: label_id, filename, phoneme1, phoneme2, coding ------------------------

KEY = ["phoneme1", "phoneme2", "coding"]


def first_label(labels: DataFrame) -> DataFrame:
    """The first label of each key by filename, and how many the key has.  A grouped minimum, not a window: partial
    aggregation keeps a frequent key from gathering in one task."""
    first = F.min(F.struct("filename", "label_id")).alias("first")
    return labels.groupBy(*KEY).agg(first, F.count("*").cast("int").alias("n_labels")).select(*KEY, "first.label_id", "first.filename", "n_labels")


def _keyed(trials: DataFrame) -> DataFrame:
    return trials.withColumnsRenamed({"gt1": "phoneme1", "gt2": "phoneme2"})


def attach_label(trials: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Trials with label_id of the first matching label and n_labels; NULL and 0 without one.  The key has at most
    38 * 38 * 7 values, so the label side is small whatever the number of labels."""
    if labels is None:
        return trials.withColumn("label_id", F.lit(None).cast("string")).withColumn("n_labels", F.lit(0))
    first = first_label(labels).select(*KEY, "label_id", "n_labels")
    out = _keyed(trials).join(F.broadcast(first), KEY, "left").withColumnsRenamed({"phoneme1": "gt1", "phoneme2": "gt2"})
    return out.select(*trials.columns, "label_id", F.coalesce("n_labels", F.lit(0)).alias("n_labels"))


def ambiguous_labels(trials: DataFrame, labels: DataFrame, show: Callable[[Column], Column] = lambda ids: ids) -> DataFrame:
    """Trials whose key has several labels, with all of them by filename.  The list of a key is made, and given the form of show,
    once: file names don't travel to the trials, and nothing is done for each trial and label."""
    several = labels.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("filename", "label_id"))).alias("all")).where("size(all) > 1")
    several = computed(several.select(*KEY, F.size("all").alias("n_labels"), show(F.transform("all", lambda x: x["label_id"])).alias("label_ids")))
    out = _keyed(trials).join(several, KEY).withColumnsRenamed({"phoneme1": "gt1", "phoneme2": "gt2"})
    return out.select("pp_id", "gate", "line_no", "n_labels", "label_ids")


def unmatched_trials(trials: DataFrame, labels: DataFrame) -> DataFrame:
    keys = labels.select(*KEY).distinct()
    return _keyed(trials).join(F.broadcast(keys), KEY, "left_anti").withColumnsRenamed({"phoneme1": "gt1", "phoneme2": "gt2"}).select(*trials.columns)


#: Lines of one log whose trials stay together in a part of a label's responses.
SLICE = 4096


def label_responses(attached: DataFrame, labels: DataFrame, most: int = 10_000) -> DataFrame:
    """label_id, part, responses: each label's trials in the order of listeners, gates and lines, in parts of about `most`
    (never more than most + SLICE - 1 for line numbers that don't repeat).  Parts ascend; a label without trials has one
    empty part.  Trials are counted by slices of logs first, and the counts say which part a slice belongs to, so a label
    that holds any share of the trials is put together by many tasks."""
    own = attached.where("label_id is not null").withColumn("slice", F.expr(f"line_no div {SLICE}"))
    keys = ["label_id", "pp_id", "gate", "slice"]
    ahead = Window.partitionBy("label_id").orderBy("pp_id", "gate", "slice").rowsBetween(Window.unboundedPreceding, -1)
    part = F.floor(F.coalesce(F.sum("n").over(ahead), F.lit(0)) / most).alias("part")
    parts = own.groupBy(*keys).agg(F.count("*").alias("n")).select(*keys, part)
    one = F.struct("pp_id", "gate", "line_no", "gt1", "gt2", "resp1", "resp2")
    got = own.join(parts, keys).groupBy("label_id", "part").agg(F.array_sort(F.collect_list(one)).alias("responses"))
    empty = F.array().cast(got.schema["responses"].dataType)
    rows = labels.select("label_id").join(got, "label_id", "left")
    return rows.select("label_id", F.coalesce("part", F.lit(0)).alias("part"), F.coalesce("responses", empty).alias("responses"))
