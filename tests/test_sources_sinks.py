"""Readers on real files: split, in parts, with faults; responses in parts; records as they stand in the JSON."""

import json
import random

import pytest
from pyspark.sql import functions as F

from gatelab.operators import confusion as C
from gatelab.operators import labels as L
from gatelab.operators import trials as T
from gatelab.plans import fixtures as X
from gatelab.sources import files, sinks


@pytest.fixture
def small_splits(spark):
    """Files are read in splits of 64 bytes, one to a task, and written by as many tasks as there are partitions."""
    keys = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_line_numbers_of_a_split_log(spark, tmp_path, small_splits):
    """Lines of any length, blank, empty and with both line ends, over many splits."""
    rng = random.Random(1)
    lines = [rng.choice(["", "  ", "a:x:2||ax", "noise", "long " * rng.randint(1, 60)]) for _ in range(400)]
    (tmp_path / "pp03_gate5").write_text("".join(line + rng.choice(["\n", "\r\n"]) for line in lines))
    (tmp_path / "pp04_gate5").write_text("only\nlast without end")
    read = files.read_lines(spark, [str(tmp_path / "pp03_gate5"), str(tmp_path / "pp04_gate5")])
    assert read.rdd.getNumPartitions() > 20
    got = files.scan_trial_logs(spark, str(tmp_path), [3, 4], [5])
    want = [(3, 5, k + 1, line) for k, line in enumerate(lines) if line] + [(4, 5, 1, "only"), (4, 5, 2, "last without end")]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.scan_trial_logs(spark, str(tmp_path), [3, 5], [5]).collect()
    assert files.scan_trial_logs(spark, str(tmp_path), [4, 5], [5], strict=False).count() == 2


def test_logs_in_parts(spark, tmp_path, small_splits):
    """A log that Spark wrote by many tasks keeps the order of its lines."""
    rows = [(p, g, k, f"line {k} of {p} {g}") for p, g, n in ((1, 1, 300), (2, 6, 5)) for k in range(n)]
    df = spark.createDataFrame(rows, "pp_id int, gate int, line_no long, line string").repartition(4)
    root = X.write_logs(df.repartition(3), str(tmp_path / "logs"))
    assert len(list((tmp_path / "logs" / "log=pp01_gate1").glob("part-*"))) > 1
    got = files.scan_trial_logs(spark, root, [1, 2], [1, 6], strict=False).collect()
    assert sorted((r.pp_id, r.gate, r.line_no - 1, r.line) for r in got) == rows


def test_last_timestamp_wins_across_splits_and_parts(spark, tmp_path, small_splits):
    lines = ["name,seconds"] + [f"f{k % 7}.wav,{k}.5" for k in range(200)] + ["f1.wav,1,2", "f2.wav,x", "f3.wav, 0 "]
    (tmp_path / "t.csv").write_text("\n".join(lines))
    want = {f"f{k % 7}.wav": k + 0.5 for k in range(200)} | {"f3.wav": 0.0}
    assert {r.filename: r.ts for r in files.scan_gate_timestamps(spark, str(tmp_path / "t.csv")).collect()} == want
    df = spark.createDataFrame(list(enumerate(lines)), "seq long, line string").repartition(5)
    path = X.write_lines(df, "seq", str(tmp_path / "parts.csv"))
    assert {r.filename: r.ts for r in files.scan_gate_timestamps(spark, path).collect()} == want


def test_files_of_given_names(spark, tmp_path):
    rows = [("a/b/x.lab", "1\n#\n0.5 121 b\nbad\n"), ("a/c/y.lab", ""), ("a/b/z.txt", "é")]
    assert sinks.write_files(spark.createDataFrame(rows, "path string, value string").repartition(3), f"file://{tmp_path}") == 3
    assert {str(p.relative_to(tmp_path)): p.read_text() for p in tmp_path.rglob("*") if p.is_file() and p.suffix != ".crc"} == dict(rows)
    got = files.scan_label_files(spark, str(tmp_path / "a")).collect()
    assert [(r.line, r.ok) for r in sorted(got, key=lambda r: r.line_no)] == [("0.5 121 b", True), ("bad", False)]
    assert sinks.write_files(spark.createDataFrame([], "path string, value string"), str(tmp_path)) == 0


def test_published_matrices_fill_in(spark, tmp_path):
    trials = [(5, 1, "aː", "x", "aː", "x"), (5, 1, "aː", "x", "eː", "x"), (6, 2, "b", "p", "b", "p")]
    counts = C.confusion_counts(spark.createDataFrame(trials, "pp_id int, gate int, gt1 string, gt2 string, resp1 string, resp2 string"))
    sinks.write_files(X.matrix_files(C.matrix_grid(counts)), str(tmp_path))
    published = files.scan_published_matrices(spark, str(tmp_path))
    own = C.listener_matrices(counts, published, 5).where("n > 0").collect()
    assert sorted((r.gate, r.position, r.gt, r.hyp, r.n, r.published) for r in own) == [
        (1, 1, "aː", "aː", 1, False), (1, 1, "aː", "eː", 1, False), (1, 2, "x", "x", 2, False), (2, 1, "b", "b", 1, True), (2, 2, "p", "p", 1, True),
    ]
    nobody = C.listener_matrices(counts, published, 77)
    assert nobody.where("published").count() == 12 * 38 * 38 and nobody.agg(F.sum("n")).first()[0] == 6
    assert C.listener_matrices(counts, published).agg(F.sum("n")).first()[0] == 6
    (tmp_path / "phon1_conf_matrix_gate3.dat").unlink()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.scan_published_matrices(spark, str(tmp_path)).collect()


def test_off_axis_symbols_raise(spark):
    counts = spark.createDataFrame([(1, 1, 1, "q", "b", 1)], "pp_id int, gate int, position int, gt string, hyp string, n long")
    with pytest.raises(Exception, match="not on the axis"):
        C.matrix_grid(counts).collect()
    assert C.matrix_grid(counts, strict=False).agg(F.sum("n")).first()[0] == 0


def test_responses_of_a_hot_label_come_in_parts(spark):
    """A label with a third of all trials: bounded parts that together hold each trial once, in order."""
    rows = [(p, g, n * 5000 + k, "a", "b", "a", "b", 7 if (k + n) % 3 else k) for p in (2, 1) for g in (1, 2) for n in range(3) for k in range(0, 300)]
    attached = spark.createDataFrame(rows, "pp_id int, gate int, line_no long, gt1 string, gt2 string, resp1 string, resp2 string, label_id long").repartition(4)
    labels = spark.createDataFrame([(k,) for k in [*range(300), 999]], "label_id long")
    got = T.label_responses(attached, labels, most=250).orderBy("label_id", "part").collect()
    hot = [r for r in got if r.label_id == 7]
    assert len(hot) > 5 and max(len(r.responses) for r in hot) <= 250 + 300
    flat = [(x.pp_id, x.gate, x.line_no) for r in hot for x in r.responses]
    assert flat == sorted(r[:3] for r in rows if r[-1] == 7)
    assert sum(len(r.responses) for r in got) == len(rows)
    assert [(r.part, r.responses) for r in got if r.label_id == 999] == [(0, [])]


LABEL = "label_id long, filename string, name string, phoneme_type string, disc1 string, disc2 string, phoneme1 string, phoneme2 string, coding string, coding_name string, prefix string"


def study(spark):
    """Two labels of one name, one with four gates, one with three, one without files; a timestamp of 0, a missing one and no marks."""
    def row(i, folder, stem, prefix=None):
        return (i, f"/base/labels/{folder}/{stem}.sd.lab", stem, folder, "a", stem[2:], "aː", "x", stem[3], "text", prefix)

    labels = spark.createDataFrame([row(1, "vowel", "a_x2"), row(2, "vowel", "a_x2b", "b"), row(3, "vowel", "a_x1"), row(4, "vowel", "a_x0")], LABEL)
    have = [("a_x2", 6), ("a_x2b", 4), ("a_x1", 3)]
    paths = [f"/base/gated/vowel/{n}{g}.wav" for n, k in have for g in range(1, k + 1)] + ["/base/original/vowel/a_x2.wav", "/base/original/vowel/a_x1.wav"]
    audio = files.parse_audio_paths(spark.createDataFrame([(p,) for p in paths], "path string"))
    stamps = [(f"{n}{g}.wav", 0.0 if g == 1 else g / 10) for n, k in have for g in range(1, k + 1) if g != 3]
    timestamps = spark.createDataFrame(stamps, "filename string, ts double")
    marks = [(i, k, t, m) for i in (1, 2) for k, (t, m) in enumerate([(0.0, "utt"), (0.25, "m"), (1.5, "utt")])]
    timing = L.label_timing(spark.createDataFrame(marks, "label_id long, line_no long, time double, label string"))
    trial = (3, 2, 9, "aː", "x", "eː", "x", 2)
    attached = spark.createDataFrame([trial, (1, 6, 4, *trial[3:])], "pp_id int, gate int, line_no long, gt1 string, gt2 string, resp1 string, resp2 string, label_id long")
    return labels, L.label_info(labels, audio, timestamps, timing, attached, "/base"), attached


def test_record_of_a_label(spark, tmp_path):
    labels, info, attached = study(spark)
    got = {r.label_id: r for r in info.collect()}
    assert [got[i].n_gated for i in (1, 2, 3, 4)] == [6, 4, 3, 0] and [got[i].n_responses for i in (1, 2, 3, 4)] == [0, 2, 0, 0]
    assert got[2].gate_2 == "gated/vowel/a_x2b2.wav" and got[2].original == "" and got[4].gate_1 is None
    assert got[1].gate_1_timestamp is None and got[1].gate_2_timestamp == 0.2 and got[1].gate_3_timestamp is None
    assert [r.label_id for r in L.exported_labels(info).collect()] == [2]  # the later of two files of one name
    sinks.write_label_json(L.exported_labels(info), str(tmp_path / "out"), T.label_responses(attached, labels))
    (record,) = [json.loads(line) for f in (tmp_path / "out").glob("part-*") for line in f.read_text().splitlines()]
    assert record == {
        "label_name": "aː_x_2", "label_id": 2, "diphone": "aː x", "phoneme_1": "aː", "phoneme_2": "x", "disc_1": "a", "disc_2": "x2b", "phoneme_type": "vowel", "coding": "2", "coding_name": "text",
        "prefix": "b", "original_audio_filename": "", "label_filename": "labels/vowel/a_x2b.sd.lab", "start_time": 0.0, "end_time": 1.5, "duration": 1.5, "phoneme_1_start_time": None,
        "phoneme_1_end_time": 0.25, "phoneme_2_start_time": 0.25, "phoneme_2_end_time": None, **{f"gate_{g}_audio_filename": f"gated/vowel/a_x2b{g}.wav" for g in range(1, 5)},
        "gate_2_timestamp": 0.2, "gate_4_timestamp": 0.4,
        "responses": [
            {"gt_phoneme1": "aː", "gt_phoneme2": "x", "response_phoneme_1": "eː", "response_phoneme_2": "x", "participant": 1, "gate": 6},
            {"gt_phoneme1": "aː", "gt_phoneme2": "x", "response_phoneme_1": "eː", "response_phoneme_2": "x", "participant": 3, "gate": 2},
        ],
    }


def test_records_in_parts_and_without_responses(spark, tmp_path):
    labels, info, attached = study(spark)
    sinks.write_label_json(info, str(tmp_path / "parts"), T.label_responses(attached, labels, most=1))
    rows = [json.loads(line) for f in (tmp_path / "parts").glob("part-*") for line in f.read_text().splitlines()]
    later = [r for r in rows if "part" in r]
    assert len(rows) == 5 and [set(r) for r in later] == [{"label_name", "part", "responses"}] and later[0]["part"] == 1
    sinks.write_label_json(info, str(tmp_path / "plain"))
    rows = [json.loads(line) for f in sorted((tmp_path / "plain").glob("part-*")) for line in f.read_text().splitlines()]
    assert [r["coding"] for r in rows] == ["0", "1", "2", "2"] and not any("responses" in r for r in rows)
    assert rows[0]["prefix"] is None and not any(k.startswith("gate_") for k in rows[0])


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_timestamps_are_not_sorted_with_their_places(spark, tmp_path):
    """a sorted aggregate holds all lines of a split, each with the path of its file."""
    (tmp_path / "t.csv").write_text("a.wav,1.5\na.wav,2.5\n")
    found = files.scan_gate_timestamps(spark, str(tmp_path / "t.csv"))
    assert "SortAggregate" not in _plan(found)
    assert [tuple(r) for r in found.collect()] == [("a.wav", 2.5)]


def test_labels_meet_files_before_they_are_multiplied(spark):
    """one row for each label is shuffled and not six."""
    labels = spark.createDataFrame([(1, "vowel", "a"), (2, "vowel", "b")], "label_id long, phoneme_type string, name string")
    audio = spark.createDataFrame([("gated/vowel/a2.wav", "gated", "vowel", "a", 2)], "path string, kind string, phoneme_type string, name string, gate int")
    gated = L.label_gated_audio(labels, audio)
    plan = _plan(gated)
    assert plan.index("Generate inline") < plan.index("Join")
    assert gated.count() == 12 and [tuple(r) for r in gated.where("path is not null").collect()] == [(1, 2, "gated/vowel/a2.wav")]


def test_rows_without_a_file_do_not_share_a_key(spark):
    """NULL keys of an outer join would all go to one task."""
    gated = spark.range(400).selectExpr("id as label_id", "1 as gate", "cast(null as string) as path")
    times = spark.createDataFrame([("a.wav", 1.0)], "filename string, ts double").hint("merge")
    found = L.gate_timestamp_lookup(gated, times)
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled",)}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tasks = found.groupBy(F.spark_partition_id()).count().collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sum(r["count"] for r in tasks) == 400 and len(tasks) > 1
    assert found.where("ts is not null or path is not null").count() == 0


def test_bundles_hold_files_as_they_are(spark, tmp_path, small_splits):
    """label files of any number are a few files for Spark."""
    rows = [(f"labels/vowel/{k}.lab", f"x\r\n#\n{k}.5 121 é\r\nbad {k}\n" if k % 5 else "") for k in range(300)]
    sinks.write_bundle(spark.createDataFrame(rows, "path string, value string").repartition(3), str(tmp_path / "b"))
    assert len(list((tmp_path / "b").glob("part-*"))) == 3
    read = files.read_bundle(spark, str(tmp_path / "b"))
    assert read.rdd.getNumPartitions() > 20
    assert sorted(map(tuple, read.collect())) == sorted(rows)
    got = files.scan_label_bundle(spark, str(tmp_path / "b"))
    assert got.where("ok").count() == 240 and got.where("not ok").count() == 300
    for odd in (("a\nb", ""), ("a", "\x1e"), ("\x1e", "")):
        with pytest.raises(Exception, match="bundled"):
            sinks.write_bundle(spark.createDataFrame([odd], "path string, value string"), str(tmp_path / f"odd{len(odd[0])}{len(odd[1])}"))


def test_label_lines_are_not_a_file_each(spark, tmp_path):
    """the queries write no file for each label."""
    from gatelab.plans import queries

    assert queries.QUERIES["scan_label_files"](spark, "/root/testdata/sf0.001").inputFiles().__len__() < 20


def test_ambiguous_labels_are_listed_once_for_a_key(spark):
    """what is made of the list of a key isn't made again for each trial."""
    trials = spark.createDataFrame([(1, 1, k, "a", "b", "s") for k in range(5)], "pp_id int, gate int, line_no long, gt1 string, gt2 string, coding string")
    labels = spark.createDataFrame([(1, "y", "a", "b", "s"), (2, "x", "a", "b", "s"), (3, "z", "a", "c", "s")], "label_id long, filename string, phoneme1 string, phoneme2 string, coding string")
    found = T.ambiguous_labels(trials, labels, lambda ids: F.array_join(F.transform(ids, lambda x: x.cast("string")), ","))
    plan = _plan(found)
    assert plan.index("Join") < plan.index("array_join")
    assert {(r.n_labels, r.label_ids) for r in found.collect()} == {(2, "2,1")} and found.count() == 5
    assert T.ambiguous_labels(trials, labels).first().label_ids == [2, 1]


def test_exported_labels_are_chosen_by_keys(spark):
    """the labels that have a record, without their records."""
    labels = spark.createDataFrame(
        [(1, "f1", "n1", "vowel", "a", "b", "s"), (2, "f2", "n2", "vowel", "a", "b", "s"), (3, "f3", "n3", "vowel", "a", "b", "s"), (4, "f4", "n1", "vowel", "c", "b", "s")],
        "label_id long, filename string, name string, phoneme_type string, phoneme1 string, phoneme2 string, coding string",
    )
    rows = [(f"gated/vowel/{n}{g}.wav", "gated", "vowel", n, g) for n, k in (("n1", 6), ("n2", 4), ("n3", 3)) for g in range(1, k + 1)] + [("original/vowel/n3.wav", "original", "vowel", "n3", None)]
    audio = spark.createDataFrame(rows + rows, "path string, kind string, phoneme_type string, name string, gate int")
    got = L.labels_to_export(labels, audio)
    assert sorted(r.label_id for r in got.collect()) == [2, 4] and got.columns == labels.columns
