"""Readers of the study's files.

What can grow is read line by line, so that a large file is split and no row holds a file:
trial logs and gate timestamps.  Such a file may also be a folder of its name that holds
parts in the order of their names, as Spark writes them; the folder may be named key=name.
Label files and matrices are a few lines each by their nature, and a row holds one whole.
Spark lists files in the driver and opens them one by one, so label files of any number come
in bundles: large files whose records are label files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatelab.functions.phonemes import lookup
from gatelab.functions.text import base_name, number, parent, stem

LISTENERS = [1, 2, 3, 4, 5, 6, 7, 8, 10, 11, 12, 13, 15, 16, 17, 19, 20, 21]
GATES = range(1, 7)


def plain_path(path: Column) -> Column:
    """The name of the file: without the scheme of local files, the part of a folder of parts, and keys of folders."""
    path = F.regexp_replace(path, "^file:/+", "/")
    path = F.regexp_replace(path, "/part-[^/]*$", "")
    return F.regexp_replace(path, "(?<=/)[A-Za-z_]+=", "")


def _named(names: list[str]) -> str:
    """A pattern of paths that matches any of the names, as they are or as a folder key=name."""
    return "{" + ",".join(x for n in names for x in (n, f"*={n}")) + "}"


# --- lines ---------------------------------------------------------------------------------


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, place, line: the lines of files, in one scan.  Places of one path ascend with its lines: the part, where the split
    begins in it, and a number that grows within the split."""
    place = F.struct(F.col("_metadata.file_path").alias("part"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("pos"))
    return spark.read.text(paths).select(plain_path(F.col("_metadata.file_path")).alias("path"), place.alias("place"), F.col("value").alias("line"))


def numbered_lines(lines: DataFrame) -> DataFrame:
    """path, line_no (from 1), line from read_lines.  Lines of each split are counted first, a row for each split; a line's
    number is how many stand in the splits before it, and its distance from the first of its own."""
    split = ["path", "place.part", "place.start"]
    ahead = Window.partitionBy("path").orderBy("part", "start").rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy(*split).agg(F.min("place.pos").alias("first"), F.count("*").alias("n"))
    splits = splits.select("path", "part", "start", (F.coalesce(F.sum("n").over(ahead), F.lit(0)) - F.col("first") + 1).alias("shift"))
    rows = lines.select("path", "place.part", "place.start", "place.pos", "line").join(splits, ["path", "part", "start"])
    return rows.select("path", (F.col("pos") + F.col("shift")).alias("line_no"), "line")


def ordered_lines(lines: DataFrame) -> DataFrame:
    """at, line from read_lines: at is a long that ascends with paths, parts and lines, where place would be wide and could be compared
    in sorted aggregates only.  Splits are ranked by themselves, a row for each split."""
    split = ["path", "place.part", "place.start"]
    rank = F.row_number().over(Window.orderBy("path", "part", "start")).cast("long")
    ranks = lines.select(*split).distinct().select("path", "part", "start", rank.alias("rank"))
    rows = lines.select(*split, "place.pos", "line").join(F.broadcast(ranks), ["path", "part", "start"])
    return rows.select(F.shiftleft("rank", 33).bitwiseOR(F.col("pos").bitwiseAND(F.lit((1 << 33) - 1))).alias("at"), "line")


def parse_trial_logs(lines: DataFrame) -> DataFrame:
    """raw_lines(pp_id, gate, line_no, line) from numbered lines of files named pp<NN>_gate<G>; empty lines are dropped, blank
    ones stay."""
    part = lambda k: F.regexp_extract(base_name(F.col("path")), "^pp([0-9]+)_gate([0-9])$", k).try_cast("int")
    return lines.where("line <> ''").select(part(1).alias("pp_id"), part(2).alias("gate"), "line_no", "line").where("pp_id is not null")


def scan_trial_logs(spark: SparkSession, root: str, pp_ids=LISTENERS, gates=GATES, strict: bool = True) -> DataFrame:
    """The logs of listeners and gates.  With strict, a log that isn't there raises an error; else those that are there are read,
    one at least."""
    names = [f"pp{p:02d}_gate{g}" for p in pp_ids for g in gates]
    paths = [f"{root}/{_named([n])}" for n in names] if strict else f"{root}/{_named(names)}"
    return parse_trial_logs(numbered_lines(read_lines(spark, paths)))


def parse_gate_timestamps(lines: DataFrame) -> DataFrame:
    """filename, ts: two-field numeric lines; of equal names the last line counts, by file and place."""
    cells = F.split("line", ",")
    rows = ordered_lines(lines).where(F.size(cells) == 2).select("at", cells[0].alias("filename"), number(cells[1]).alias("ts"))
    return rows.where("ts is not null").groupBy("filename").agg(F.max_by("ts", "at").alias("ts"))


def scan_gate_timestamps(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_gate_timestamps(read_lines(spark, path))


# --- small files, a row each ------------------------------------------------------------------


def read_whole(spark: SparkSession, paths: str | list[str], glob: str | None = None) -> DataFrame:
    """path, value: files as rows; with glob, those of such names below a folder."""
    reader = spark.read.text(paths, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=glob is not None)
    return reader.select(plain_path(F.col("_metadata.file_path")).alias("path"), "value")


#: What stands after each record of a bundle: ASCII's record separator, which no text file holds.
BETWEEN = "\x1e"


def read_bundle(spark: SparkSession, root: str) -> DataFrame:
    """path, value: the files that sinks.write_bundle has put together, in splits."""
    path = F.substring_index("value", "\n", 1)
    return spark.read.text(root, lineSep=BETWEEN).select(path.alias("path"), F.substring("value", F.length(path) + 2, F.length("value")).alias("value"))


def parse_label_files(files: DataFrame, strict: bool = False) -> DataFrame:
    """path, line_no, line, time, code, label, ok: the lines after the first line '#'.  A line is a float, an int and a
    text, divided by spaces.  With strict, a bad line or a file without '#' raises an error; else ok is false (a file
    without '#' is one bad row without a line)."""
    lines = F.split("value", "\r\n|\r|\n")
    at = F.array_position(lines, "#").cast("int")
    rows = files.select("path", F.when(at > 0, F.slice(lines, at + 1, F.greatest(F.size(lines) - at, F.lit(0)))).alias("lines"))
    rows = rows.select("path", F.posexplode_outer("lines").alias("pos", "line")).where("line is null or line <> ''")
    cells = F.filter(F.split("line", " "), lambda x: x != "")
    three = F.when(F.size(cells) == 3, cells)
    out = rows.select(
        "path", (F.col("pos") + 1).cast("long").alias("line_no"), "line", number(three[0]).alias("time"), F.when(three[1].rlike("^[+-]?[0-9]+$"), three[1].try_cast("int")).alias("code"), three[2].alias("label")
    )
    out = out.withColumn("ok", F.coalesce(F.col("time").isNotNull() & F.col("code").isNotNull() & F.col("label").isNotNull(), F.lit(False)))
    if strict:
        out = out.withColumn("ok", F.when(F.col("ok"), True).otherwise(F.raise_error(F.concat(F.lit("bad label line in "), "path")).cast("boolean")))
    return out


def scan_label_files(spark: SparkSession, root: str, strict: bool = False) -> DataFrame:
    """The label files <root>/<type>/<name>.lab."""
    return parse_label_files(read_whole(spark, root, "*.lab"), strict)


def scan_label_bundle(spark: SparkSession, root: str, strict: bool = False) -> DataFrame:
    """The label files of a bundle."""
    return parse_label_files(read_bundle(spark, root), strict)


def parse_confusion_matrices(files: DataFrame) -> DataFrame:
    """position, gate, gt, gt_ord, hyp, hyp_ord, n from files phon<P>_conf_matrix_gate<G>.dat; symbols become IPA."""
    part = lambda k: F.regexp_extract(base_name(F.col("path")), "^phon([0-9])_conf_matrix_gate([0-9])[.]dat$", k).try_cast("int")
    lines = F.filter(F.split("value", "\r\n|\r|\n"), lambda x: F.trim(x) != "")
    cells = lambda x: F.split(F.trim(F.regexp_replace(x, "\\s+", " ")), " ")
    rows = files.select(part(1).alias("position"), part(2).alias("gate"), lines.alias("lines")).where("size(lines) > 0")
    rows = rows.select("position", "gate", cells(F.col("lines")[0]).alias("header"), F.posexplode(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))).alias("gt_ord", "line"))
    rows = rows.select("position", "gate", "gt_ord", cells(F.col("line")).alias("cells"), "header")
    rows = rows.select("position", "gate", "gt_ord", F.col("cells")[0].alias("row"), F.posexplode(F.arrays_zip("header", F.slice("cells", 2, F.greatest(F.size("cells") - 1, F.lit(0))).alias("n"))).alias("hyp_ord", "z"))
    return rows.select(
        "position", "gate", lookup(F.col("row"), "response", "ipa").alias("gt"), "gt_ord", lookup(F.col("z.header"), "response", "ipa").alias("hyp"), "hyp_ord", F.col("z.n").cast("long").alias("n")
    )


def scan_confusion_matrix(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_confusion_matrices(read_whole(spark, path))


def scan_published_matrices(spark: SparkSession, root: str, gates=GATES, positions=(1, 2)) -> DataFrame:
    """The published matrices of gates and positions; one that isn't there raises an error."""
    return scan_confusion_matrix(spark, [f"{root}/phon{p}_conf_matrix_gate{g}.dat" for p in positions for g in gates])


# --- existence alone ---------------------------------------------------------------------------


def parse_audio_paths(paths: DataFrame) -> DataFrame:
    """path, kind (original or gated), phoneme_type, name, gate from original/<type>/<name>.wav and gated/<type>/<name><gate>.wav."""
    kind = F.regexp_extract("path", "(?:^|/)(original|gated)/[^/]+/[^/]+[.]wav$", 1)
    gated = kind == "gated"
    name = stem(F.col("path"))
    rows = paths.select("path", kind.alias("kind"), parent(F.col("path")).alias("phoneme_type"), F.when(gated, F.expr("substring(substring_index(substring_index(path, '/', -1), '.', 1), 1, length(substring_index(substring_index(path, '/', -1), '.', 1)) - 1)")).otherwise(name).alias("name"), F.when(gated, F.right(name, F.lit(1)).try_cast("int")).alias("gate"))
    return rows.where("kind = 'original' or gate between 1 and 6")


def scan_audio_inventory(spark: SparkSession, root: str) -> DataFrame:
    """Which wav files exist; their content isn't read.  Spark lists no files without a byte."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", True).load(root)
    return parse_audio_paths(files.select(plain_path(F.col("path")).alias("path")))
