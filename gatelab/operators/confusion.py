"""Confusion counts and matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatelab.functions.phonemes import AXIS
from gatelab.sources.files import GATES


def confusion_counts(trials: DataFrame) -> DataFrame:
    """pp_id, gate, position, gt, hyp, n: one shuffle, after partial counts of at most 38 * 38 cells per panel."""
    both = trials.select("pp_id", "gate", F.stack(F.lit(2), F.lit(1), "gt1", "resp1", F.lit(2), "gt2", "resp2").alias("position", "gt", "hyp"))
    return both.groupBy("pp_id", "gate", "position", "gt", "hyp").agg(F.count("*").alias("n"))


def panels(rows: DataFrame) -> DataFrame:
    """Every gate and position of every listener that has lines."""
    positions = F.explode(F.array(F.lit(1), F.lit(2))).alias("position")
    return rows.select("pp_id", "gate").distinct().select("pp_id", "gate", positions)


def _map(keys: str, values: str, name: str):
    return F.map_from_entries(F.array_sort(F.collect_list(F.struct(keys, values)))).alias(name)


def confusion_by_gate(confusion: DataFrame, raw_lines: DataFrame) -> DataFrame:
    """pp_id, gate, position, cells (gt → hyp → n); a panel without trials has an empty map."""
    rows = confusion.groupBy("pp_id", "gate", "position", "gt").agg(F.map_from_entries(F.collect_list(F.struct("hyp", "n"))).alias("h"))
    rows = rows.groupBy("pp_id", "gate", "position").agg(F.map_from_entries(F.collect_list(F.struct("gt", "h"))).alias("cells"))
    empty = F.from_json(F.lit("{}"), "map<string,map<string,bigint>>")
    return panels(raw_lines).join(rows, ["pp_id", "gate", "position"], "left").select("pp_id", "gate", "position", F.coalesce("cells", empty).alias("cells"))


def confusion_nested(confusion: DataFrame, raw_lines: DataFrame) -> DataFrame:
    """A row per listener: gate<g> → phoneme<p> → gt → hyp → n."""
    rows = confusion_by_gate(confusion, raw_lines)
    rows = rows.groupBy("pp_id", "gate").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("phoneme"), "position"), "cells"))).alias("m"))
    return rows.groupBy("pp_id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("gate"), "gate"), "m"))).alias("gates"))


def long_form(nested: DataFrame) -> DataFrame:
    """confusion_nested as rows again."""
    rows = nested.select("pp_id", F.explode("gates").alias("gate", "m")).select("pp_id", "gate", F.explode("m").alias("position", "m"))
    rows = rows.select("pp_id", "gate", "position", F.explode("m").alias("gt", "m")).select("pp_id", "gate", "position", "gt", F.explode("m").alias("hyp", "n"))
    digit = lambda c: F.right(c, F.lit(1)).cast("int")
    return rows.select("pp_id", digit(F.col("gate")).alias("gate"), digit(F.col("position")).alias("position"), "gt", "hyp", "n")


def _axis(rows: DataFrame, name: str) -> DataFrame:
    """Every row once for each symbol of the axis, with its ordinal."""
    return rows.select("*", F.posexplode(F.array(*map(F.lit, AXIS))).alias(f"{name}_ord", name))


def axis_spine(spark: SparkSession) -> DataFrame:
    """All cells of a matrix, 38 * 38, from literals."""
    return _axis(_axis(spark.range(1), "gt"), "hyp").select("gt", "gt_ord", "hyp", "hyp_ord")


def panel_spine(spark: SparkSession) -> DataFrame:
    """All cells of all gates and positions, from literals."""
    panels = spark.range(1).select(F.explode(F.array(*map(F.lit, GATES))).alias("gate"))
    panels = panels.select("gate", F.explode(F.array(F.lit(1), F.lit(2))).alias("position"))
    return _axis(_axis(panels, "gt"), "hyp")


def matrix_grid(confusion: DataFrame, listener: int | None = None, strict: bool = True) -> DataFrame:
    """Dense counts of all gates and positions, of one listener or of all, in one job.  With strict, a symbol that the axis
    lacks raises an error."""
    if listener is not None:
        confusion = confusion.where(F.col("pp_id") == listener)
    counts = confusion.groupBy("gate", "position", "gt", "hyp").agg(F.sum("n").alias("n"))
    if strict:
        off = ~F.col("gt").isin(AXIS) | ~F.col("hyp").isin(AXIS)
        counts = counts.where(F.when(off, F.raise_error(F.concat(F.lit("not on the axis: "), "gt", F.lit(" "), "hyp")).cast("boolean")).otherwise(True))
    cells = ["gate", "position", "gt", "hyp"]
    rows = panel_spine(confusion.sparkSession).join(counts, cells, "left")
    return rows.select(*cells[:3], "gt_ord", "hyp", "hyp_ord", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def listener_matrices(confusion: DataFrame, published: DataFrame, listener: int | None = None) -> DataFrame:
    """The matrices of a listener, with the published one (from scan_published_matrices) where the listener has no trial for
    a gate and position; without a listener the published ones.  `published` says which a cell is from."""
    theirs = published.select("gate", "position", "gt", "hyp", F.col("n").alias("theirs"))
    if listener is None:
        return published.select("gate", "position", "gt", "gt_ord", "hyp", "hyp_ord", "n", F.lit(True).alias("published"))
    panel = Window.partitionBy("gate", "position")  # 38 * 38 cells
    rows = matrix_grid(confusion, listener).withColumn("published", F.sum("n").over(panel) == 0)
    rows = rows.join(theirs, ["gate", "position", "gt", "hyp"], "left")
    return rows.select("gate", "position", "gt", "gt_ord", "hyp", "hyp_ord", F.when(F.col("published"), F.col("theirs")).otherwise(F.col("n")).alias("n"), "published")


def confusion_matrix(confusion: DataFrame, gate: int, position: int, listener: int | None = None) -> DataFrame:
    return matrix_grid(confusion.where((F.col("gate") == gate) & (F.col("position") == position)), listener).where((F.col("gate") == gate) & (F.col("position") == position))


def normalise_rows(matrix: DataFrame) -> DataFrame:
    """Each cell over the Euclidean norm of its row; NULL in a row of zeros."""
    row = Window.partitionBy("gate", "position", "gt")
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(row).cast("double"))
    return matrix.withColumn("norm", F.try_divide(F.col("n").cast("double"), F.nullif(norm, F.lit(0.0))))


def heatmap_table(matrix: DataFrame, normalise: bool = True) -> DataFrame:
    """Cells with the panel they are drawn in: rows are gates, columns positions."""
    rows = normalise_rows(matrix)
    value = F.col("norm") if normalise else F.col("n").cast("double")
    title = F.concat(F.lit("phoneme "), "position", F.lit(" gate "), "gate")
    return rows.select((F.col("gate") - 1).alias("panel_row"), (F.col("position") - 1).alias("panel_col"), title.alias("title"), "gt_ord", "hyp_ord", "gt", "hyp", value.alias("value")).orderBy("panel_row", "panel_col", "gt_ord", "hyp_ord")
