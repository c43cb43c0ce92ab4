"""JSON exports, and small files of given names."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelab.sources.files import BETWEEN


def write_confusion_json(nested: DataFrame, path: str, single: bool = False) -> None:
    """A record per listener, {"participant": "pp1", "confusion": {...}}; with single, one object of all listeners in one
    file (18 listeners in the study, so that fits a task)."""
    rows = nested.select(F.concat(F.lit("pp"), "pp_id").alias("participant"), F.col("gates").alias("confusion"))
    if not single:
        rows.write.json(path)
        return
    whole = rows.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("participant", "confusion")))).alias("value"))
    whole.coalesce(1).write.text(path)


#: Fields of a label record that are always there, with the columns they come from; NULL is written as null.
LABEL_FIELDS = {
    "label_name": "label_name", "label_id": "label_id", "diphone": "diphone", "phoneme_1": "phoneme1", "phoneme_2": "phoneme2", "disc_1": "disc1", "disc_2": "disc2",
    "phoneme_type": "phoneme_type", "coding": "coding", "coding_name": "coding_name", "prefix": "prefix", "original_audio_filename": "original", "label_filename": "label_filename",
    "start_time": "start_time", "end_time": "end_time", "duration": "duration", "phoneme_1_start_time": "phoneme1_start_time", "phoneme_1_end_time": "phoneme1_end_time",
    "phoneme_2_start_time": "phoneme2_start_time", "phoneme_2_end_time": "phoneme2_end_time",
}
#: Fields that are left out where they are NULL.
GATE_FIELDS = {f"gate_{g}_{what}": column.format(g) for what, column in (("audio_filename", "gate_{}"), ("timestamp", "gate_{}_timestamp")) for g in range(1, 7)}
#: Fields of a response.
RESPONSE_FIELDS = {"gt_phoneme1": "gt1", "gt_phoneme2": "gt2", "response_phoneme_1": "resp1", "response_phoneme_2": "resp2", "participant": "pp_id", "gate": "gate"}


def _object(fields: dict[str, str], nulls: bool) -> Column:
    return F.to_json(F.struct(*[F.col(c).alias(f) for f, c in fields.items()]), {"ignoreNullFields": str(not nulls).lower()})


def _merged(first: Column, *more: Column) -> Column:
    """JSON objects of different keys as one; the first isn't empty."""
    inner = lambda x: F.substring(x, F.lit(2), F.length(x) - 2)
    return F.concat(F.lit("{"), F.concat_ws(",", inner(first), *[F.nullif(inner(x), F.lit("")) for x in more]), F.lit("}"))


def label_json(info: DataFrame, responses: DataFrame | None = None) -> DataFrame:
    """phoneme1, phoneme2, coding, part, value: the records of labels as JSON.  With responses (parts by label_responses) a label of
    several parts has a record for each; those after the first hold label_name, part and responses alone."""
    record = _merged(_object(LABEL_FIELDS, True), _object(GATE_FIELDS, False))
    order = ["phoneme1", "phoneme2", "coding"]
    if responses is None:
        return info.select(*order, F.lit(0).alias("part"), record.alias("value"))
    dicts = F.transform("responses", lambda r: F.struct(*[r[c].alias(f) for f, c in RESPONSE_FIELDS.items()]))
    rows = responses.select("label_id", "part", dicts.alias("responses")).join(info, "label_id")
    given = F.to_json(F.struct("responses"))
    later = F.to_json(F.struct("label_name", "part"))
    return rows.select(*order, "part", F.when(F.col("part") == 0, _merged(record, given)).otherwise(_merged(later, given)).alias("value"))


def write_label_json(info: DataFrame, path: str, responses: DataFrame | None = None) -> None:
    """A record per label (per part, where responses are many), sorted by phonemes, coding and part."""
    label_json(info, responses).orderBy("phoneme1", "phoneme2", "coding", "part").select("value").write.text(path)


def write_bundle(files: DataFrame, root: str) -> None:
    """files: path, value.  Many small files as a bundle, for files.read_bundle: a folder of a few large files, in which each record
    is a path, a line end and the text as it is.  A record that could not be told apart raises an error."""
    odd = F.col("path").contains("\n") | F.col("path").contains(BETWEEN) | F.col("value").contains(BETWEEN)
    record = F.concat("path", F.lit("\n"), F.coalesce("value", F.lit("")))
    record = F.when(F.coalesce(odd, F.col("path").isNull()), F.raise_error(F.concat(F.lit("can't be bundled: "), F.coalesce("path", F.lit("null")))).cast("string")).otherwise(record)
    files.select(record.alias("value")).write.option("lineSep", BETWEEN).text(root)


def write_files(files: DataFrame, root: str) -> int:
    """files: path (below root), value.  Writes each row as one file of that name from the tasks that hold the rows, and says how
    many; for files that fit a row.  root: a folder that all executors share, with or without a scheme.  A task that runs
    again writes the same files again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        store, top = FileSystem.from_uri(root)
        made: set[str] = set()
        for batch in batches:
            for path, value in zip(*(batch.column(c).to_pylist() for c in ("path", "value"))):
                folder = f"{top}/{path}".rpartition("/")[0]
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                with store.open_output_stream(f"{top}/{path}") as out:
                    out.write(value.encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return files.select("path", "value").mapInArrow(run, "n long").groupBy().sum("n").first()[0] or 0
