"""The study's inputs, derived from the driver's tables, as views and as files.

The texts of SQL run in Spark and in DuckDB, or state in DuckDB what Spark derives by
columns: a row of stimuli gives its lines and paths by explode, in one scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelab.functions.phonemes import CONSONANTS, MAPS, VOWELS

SYMBOLS = "".join(VOWELS + CONSONANTS)


def _sym(n: str) -> str:
    return f"substr('{SYMBOLS}', CAST({n} AS INT) + 1, 1)"


#: The file codes of all symbols, in cells of three characters.
FILE_CELLS = "".join(MAPS["disc", "file"][d].ljust(3) for d in SYMBOLS)


def _file(n: str) -> str:
    return f"rtrim(substr('{FILE_CELLS}', CAST({n} AS INT) * 3 + 1, 3))"


def raw_lines_sql(div: str) -> str:
    return f"""
SELECT CAST(u % 21 + 1 AS INT) AS pp_id, CAST((e {div} 7) % 6 + 1 AS INT) AS gate, e AS line_no,
  CASE WHEN v % 101 = 0 THEN ''
       WHEN event_type = 'error' AND v % 5 = 0 THEN concat('noise ', CAST(e AS STRING))
       ELSE concat({_sym('i')}, ':', CASE WHEN v % 97 = 0 THEN 'q' ELSE {_sym('j')} END, ':', substr('0123sw', CAST(c AS INT) + 1, 1), '||',
                   {_sym('ri')}, {_sym('rj')}, CASE WHEN v % 89 = 0 THEN 'x' ELSE '' END) END AS line
FROM (SELECT *, CASE WHEN v % 3 <> 0 THEN i ELSE (i + v) % 38 END AS ri, CASE WHEN v % 4 <> 0 THEN j ELSE (j + v {div} 7) % 38 END AS rj
  FROM (SELECT *, k % 38 AS i, (k {div} 38) % 38 AS j, (k {div} 1444) % 6 AS c
    FROM (SELECT event_id AS e, user_id AS u, event_type, CAST(round(value * 100) AS BIGINT) AS v, (event_id * 13) % 1900 AS k FROM events) a) b) c"""


def stimuli_sql(div: str) -> str:
    return f"""
SELECT pk AS label_id, concat('labels/', phoneme_type, '/', stem, '.sd.lab') AS path, stem, phoneme_type, n_gates
FROM (SELECT pk, n_gates, CASE WHEN k % 38 < 16 THEN 'vowel' ELSE 'consonant' END AS phoneme_type,
    concat({_file('k % 38')}, '_', {_file(f'(k {div} 38) % 38')}, coding, prefix) AS stem
  FROM (SELECT pk, k, n_gates,
      substr('0123sw', CAST((k {div} 1444) % 6 AS INT) + 1, 1) AS coding, CASE WHEN pk % 10 = 8 THEN 'a' WHEN pk % 10 = 9 THEN 'b' ELSE '' END AS prefix
    FROM (SELECT p_partkey AS pk, p_partkey - CASE WHEN p_partkey % 10 = 9 THEN 1 ELSE 0 END AS k,
        CASE WHEN p_size % 10 = 0 THEN 0 WHEN p_size % 10 = 1 THEN 4 ELSE 6 END AS n_gates
      FROM part WHERE p_partkey % 11 <> 3) a) b) c"""


def label_rows_sql(div: str) -> str:
    """label_id, line_no, ms, label: what stands below '#'."""
    base = "SELECT label_id, 50 + label_id % 7 AS b FROM stimuli"
    rows = [
        ("0", "0", "utt", "true"), ("1", "b", "b", "label_id % 31 <> 0"), ("2", "b + 100", "m", "true"), ("3", "b + 110", "m", "label_id % 29 = 0"),
        ("4", "b + 120", "1", "label_id % 3 = 0"), ("5", "b + 130", "2", "label_id % 3 = 1"), ("6", "b + 250", "e", "true"), ("7", "b + 400", "utt", "true"),
    ]
    return "\nUNION ALL ".join(f"SELECT label_id, {n} AS line_no, {ms} AS ms, '{label}' AS label FROM ({base}) t WHERE {when}" for n, ms, label, when in rows)


def timestamp_lines_sql(div: str) -> str:
    """seq, line: the lines of the timestamp file, a header and repeated keys among them."""
    seconds = lambda ms: f"concat(CAST({ms} {div} 1000 AS STRING), '.', lpad(CAST({ms} % 1000 AS STRING), 3, '0'))"
    parts = [f"SELECT CAST(0 AS BIGINT) AS seq, 'filename,seconds' AS line"]
    for g in range(1, 7):
        ms = f"(CASE WHEN label_id % 13 = 0 AND {g} = 1 THEN 0 ELSE {100 * g} + label_id % 50 END)"
        parts.append(f"SELECT label_id * 10 + {g} AS seq, concat(stem, '{g}.wav,', {seconds(ms)}) AS line FROM stimuli WHERE n_gates >= {g}")
    parts.append(f"SELECT label_id * 10 + 9 AS seq, concat(stem, '1.wav,', {seconds('(500 + label_id % 50)')}) AS line FROM stimuli WHERE label_id % 17 = 0 AND n_gates > 0")
    parts.append("SELECT label_id * 10 + 8 AS seq, concat(stem, '1.wav,1,2') AS line FROM stimuli WHERE label_id % 19 = 0")
    return "\nUNION ALL ".join(parts)


def audio_paths_sql() -> str:
    parts = ["SELECT concat('original/', phoneme_type, '/', stem, '.wav') AS path FROM stimuli WHERE label_id % 23 <> 0"]
    parts += [f"SELECT concat('gated/', phoneme_type, '/', stem, '{g}.wav') AS path FROM stimuli WHERE n_gates >= {g}" for g in range(1, 7)]
    return "SELECT DISTINCT path FROM (" + "\nUNION ALL ".join(parts) + ") t"


class Fixtures:
    """Views over the tables of one directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("events", "part")}

    def _sql(self, text: str, **views: DataFrame) -> DataFrame:
        for name, df in views.items():
            df.createOrReplaceTempView(f"gatelab_{name}")
            text = text.replace(f"FROM {name}", f"FROM gatelab_{name}")
        return self.spark.sql(text)

    def all_lines(self) -> DataFrame:
        return self._sql(raw_lines_sql("div"), events=self.tables["events"])

    def raw_lines(self) -> DataFrame:
        return self.all_lines().where("line <> ''")

    def stimuli(self) -> DataFrame:
        return self._sql(stimuli_sql("div"), part=self.tables["part"])

    def label_rows(self) -> DataFrame:
        k, b = F.col("label_id"), F.lit(50) + F.col("label_id") % 7
        rows = [
            (0, F.lit(0), "utt", None), (1, b, "b", k % 31 != 0), (2, b + 100, "m", None), (3, b + 110, "m", k % 29 == 0),
            (4, b + 120, "1", k % 3 == 0), (5, b + 130, "2", k % 3 == 1), (6, b + 250, "e", None), (7, b + 400, "utt", None),
        ]
        cells = [F.struct(F.lit(n).cast("long").alias("line_no"), (ms / F.lit(1000.0)).alias("time"), F.lit(label).alias("label"), (F.lit(True) if when is None else when).alias("there")) for n, ms, label, when in rows]
        out = self.stimuli().select("label_id", F.inline(F.array(*cells)))
        return out.where("there").select("label_id", "line_no", "time", "label")

    def timestamp_lines(self) -> DataFrame:
        """seq, line: a header, a line for each gated file, repeated keys and lines of three fields among them."""
        k, n = F.col("label_id"), F.col("n_gates")
        seconds = lambda ms: F.format_string("%d.%03d", F.floor(ms / 1000), ms % 1000)
        line = lambda g, ms: F.concat("stem", F.lit(f"{g}.wav,"), seconds(ms))
        rows = [(g, line(g, F.when((k % 13 == 0) & (g == 1), F.lit(0)).otherwise(k % 50 + 100 * g)), n >= g) for g in range(1, 7)]
        rows += [(9, line(1, k % 50 + 500), (k % 17 == 0) & (n > 0)), (8, F.concat("stem", F.lit("1.wav,1,2")), k % 19 == 0)]
        cells = F.array(*[F.struct((k * 10 + at).alias("seq"), text.alias("line"), there.alias("there")) for at, text, there in rows])
        lines = self.stimuli().select(F.inline(cells)).where("there").select("seq", "line")
        return self.spark.sql("SELECT CAST(0 AS BIGINT) AS seq, 'filename,seconds' AS line").union(lines)

    def audio_paths(self) -> DataFrame:
        folder = lambda kind: F.concat(F.lit(kind + "/"), "phoneme_type", F.lit("/"), "stem")
        gates = F.transform(F.expr("sequence(1, 6)"), lambda g: F.when(F.col("n_gates") >= g, F.concat(folder("gated"), g.cast("string"), F.lit(".wav"))))
        whole = F.when(F.col("original"), F.concat(folder("original"), F.lit(".wav")))
        # stimuli of one name give the same paths: taken once before they are multiplied
        stimuli = self.stimuli().select("phoneme_type", "stem", "n_gates", (F.col("label_id") % 23 != 0).alias("original")).distinct()
        return stimuli.select(F.explode(F.array_append(gates, whole)).alias("path")).where("path is not null").distinct()


# --- as files, under a folder that all executors share -------------------------------------------


def write_logs(lines: DataFrame, root: str) -> str:
    """Trial logs as folders log=pp<NN>_gate<G> of parts in order; a log of any length is written by as many tasks as it needs."""
    rows = lines.select(F.format_string("pp%02d_gate%d", "pp_id", "gate").alias("log"), "line_no", "line")
    rows = rows.repartitionByRange("log", "line_no").sortWithinPartitions("log", "line_no")
    rows.select("log", "line").write.partitionBy("log").text(root)
    return root


def write_lines(lines: DataFrame, order: str, path: str) -> str:
    """One file of lines, as a folder of parts in order."""
    lines.repartitionByRange(order).sortWithinPartitions(order).select("line").write.text(path)
    return path


def label_files(rows: DataFrame) -> DataFrame:
    """path, value: what label files hold, with spaces, line ends of both kinds, and here and there a broken line."""
    line = F.concat_ws(" ", F.format_string("  %.3f", "time"), F.lit("121"), "label")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", line.alias("line")))), lambda x: x["line"]), "\r\n")
    rows = rows.groupBy("label_id").agg(body.alias("value"))  # eight lines at most
    text = F.concat(F.lit("signal x\ntype 0\n#\n"), "value", F.lit("\n"), F.when(F.col("label_id") % 37 == 0, F.lit("broken line\n")).otherwise(F.lit("\n")))
    return rows.select(F.concat(F.lit("labels/any/"), "label_id", F.lit(".sd.lab")).alias("path"), text.alias("value"))


def matrix_files(grid: DataFrame) -> DataFrame:
    """path, value: a grid as the published files, 12 of 38 rows and columns; the last symbol is spelled '-'."""
    disc = VOWELS + CONSONANTS[:-1] + ["-"]
    rows = grid.groupBy("position", "gate", "gt_ord").agg(F.array_sort(F.collect_list(F.struct("hyp_ord", "n"))).alias("x"))
    line = F.concat_ws("  ", F.get(F.array(*map(F.lit, disc)), F.col("gt_ord")), F.transform("x", lambda c: c["n"].cast("string")))
    rows = rows.groupBy("position", "gate").agg(F.array_sort(F.collect_list(F.struct("gt_ord", line.alias("line")))).alias("rows"))
    body = F.concat(F.lit(" " + " ".join(disc) + "\n"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), F.lit("\n"))
    return rows.select(F.format_string("phon%d_conf_matrix_gate%d.dat", "position", "gate").alias("path"), body.alias("value"))
