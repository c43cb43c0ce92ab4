"""Parsing rules on written lines, files as they are on disk, and properties over the derived tables."""

import json

import pytest
from pyspark.sql import functions as F

from gatelab.operators import confusion as C
from gatelab.operators import labels as L
from gatelab.operators import trials as T
from gatelab.plans.fixtures import Fixtures
from gatelab.sources import files, sinks
from gatelab.streaming.trials import stream_confusion_counts

SF = "/root/testdata/sf0.001"
RAW = "pp_id int, gate int, line_no long, line string"
CASES = [
    ("a:x:2||ax", None), (" a :x: 2 || ax ", None), ("a: x:2||ax", "unknown_symbol"), ("b:|:0||b|", None), ("|:|:1||||", "malformed"), ("noise", "malformed"),
    ("  ", "malformed"), ("a:q:2||ax", "unknown_symbol"), ("a:x:2b||ax", "unknown_coding"), ("a:x:2||axx", "bad_length"), ("a:_:0||a-", None), ("a:x:2||a?", "unknown_symbol"),
]


@pytest.fixture(scope="module")
def lines(spark):
    return spark.createDataFrame([(1, 1, k, line) for k, (line, _) in enumerate(CASES)], RAW)


def test_trial_rules(lines):
    rows = {r.line_no: r for r in T.parse_trials(lines).collect()}
    bad = {r.line_no: r.reason for r in T.quarantine_trials(lines).collect()}
    assert {k: bad.get(k) for k in range(len(CASES))} == {k: reason for k, (_, reason) in enumerate(CASES)}
    assert (rows[1].gt1, rows[1].gt2, rows[1].coding, rows[1].resp1, rows[1].resp2) == ("aː", "x", "2", "aː", "x")
    assert rows[3].gt2 == rows[3].resp2 == "øː" and rows[10].gt2 == rows[10].resp2 == "dʒ"
    with pytest.raises(Exception, match="bad_length"):
        T.parse_trials(lines.where("line like '%axx'"), strict=True).collect()
    assert T.parse_trials(lines.where("line = 'noise'"), strict=True).count() == 0
    counts = {(r.level, r.pp_id, r.gate): r for r in T.trial_counts(lines).collect()}
    assert counts[0, 1, 1].n_trials == len(CASES) and counts[3, None, None].n_errors == 3


def test_argument_checks(lines):
    for call in (lambda: T.select_gate(lines, 7), lambda: T.select_position(lines, 0), lambda: L.gated_audio_of(lines, 0)):
        with pytest.raises(ValueError):
            call()


def test_label_names(spark):
    names = ["a_x2", "a_x2b", "a_x2a", "ih_sh1", "uh_ss", "gx_ih1", "a_x", "a_ih", "qq_x1", "a_x2zz", "nounderscore"]
    paths = spark.createDataFrame([(k, f"/r/labels/vowel/{n}.sd.lab") for k, n in enumerate(names)], "label_id long, path string")
    got = {r.name: r for r in L.label_keys(paths).collect()}
    parsed = {n: (got[n].phoneme1, got[n].phoneme2, got[n].coding, got[n].prefix) for n in names[:6]}
    assert parsed == {
        "a_x2": ("aː", "x", "2", None), "a_x2b": ("aː", "x", "2", "b"), "a_x2a": ("aː", "x", "2", "aː"), "ih_sh1": ("ɪ", "ʃ", "1", None),
        "uh_ss": ("ʉ", "s", "s", None), "gx_ih1": ("ɣ", "ɪ", "1", None),
    }
    assert all(got[n].bad for n in names[6:]) and not any(got[n].bad for n in names[:6]) and got["a_x2"].phoneme_type == "vowel"
    assert got["a_x"].bad == "no_coding" and L.parse_label_filenames(paths).count() == 6


def test_timing_rules(spark):
    def rows(i, marks):
        return [(i, k, 10.0 * k, m) for k, m in enumerate(marks)]

    cases = [["b", "m", "e"], ["b", "m", "2", "e"], ["b", "m", "2", "1", "e"], ["b", "m", "m", "e"], ["m", "e"]]
    lines = spark.createDataFrame([r for i, c in enumerate(cases) for r in rows(i, c)], "label_id long, line_no long, time double, label string")
    got = {r.label_id: r for r in L.label_times(L.label_timing(lines)).collect()}
    assert [got[k].phoneme2_start_time for k in range(5)] == [10.0, 20.0, 30.0, 20.0, 0.0]
    assert got[3].phoneme1_end_time == 20.0 and got[4].phoneme1_start_time is None and got[2].duration == 40.0


def test_files_on_disk(spark, tmp_path):
    logs = tmp_path / "rawdata"
    logs.mkdir()
    for p in (1, 13):
        (logs / f"pp{p:02d}_gate2").write_text("a:x:2||ax\n\n  \r\nnoise\n")
    got = sorted(files.scan_trial_logs(spark, str(logs), [1, 13], [2]).collect())
    assert [(r.pp_id, r.gate, r.line_no, r.line) for r in got] == [(p, 2, k, x) for p in (1, 13) for k, x in ((1, "a:x:2||ax"), (3, "  "), (4, "noise"))]
    (tmp_path / "t.csv").write_text("filename,seconds\na1.wav,0.5\na1.wav,0.75\nb1.wav,1,2\nc1.wav,1_0\nd1.wav,0\n")
    assert sorted(map(tuple, files.scan_gate_timestamps(spark, str(tmp_path / "t.csv")).collect())) == [("a1.wav", 0.75), ("d1.wav", 0.0)]
    lab = tmp_path / "labels" / "vowel"
    lab.mkdir(parents=True)
    (lab / "a_x2.sd.lab").write_text("signal\n#\n  0.1   121  b\n0.2 121 m\n\n")
    (lab / "a_x3.sd.lab").write_text("no hash line\n")
    rows = files.scan_label_files(spark, str(tmp_path / "labels")).collect()
    assert sorted((r.time, r.code, r.label) for r in rows if r.ok) == [(0.1, 121, "b"), (0.2, 121, "m")] and sum(not r.ok for r in rows) == 1
    with pytest.raises(Exception, match="bad label line"):
        files.scan_label_files(spark, str(tmp_path / "labels"), strict=True).collect()
    (tmp_path / "phon1_conf_matrix_gate3.dat").write_text("  a  -\na 5 1\n-  0 7\n")
    cells = files.scan_confusion_matrix(spark, str(tmp_path / "phon1_conf_matrix_gate3.dat")).collect()
    assert sorted((r.position, r.gate, r.gt, r.hyp, r.n) for r in cells) == [(1, 3, "aː", "aː", 5), (1, 3, "aː", "dʒ", 1), (1, 3, "dʒ", "aː", 0), (1, 3, "dʒ", "dʒ", 7)]
    for f in ("original/vowel/a_x2.wav", "gated/vowel/a_x24.wav", "gated/vowel/a_x27.wav"):
        (tmp_path / "audio" / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "audio" / f).write_bytes(b"x")
    audio = files.scan_audio_inventory(spark, str(tmp_path / "audio")).collect()
    assert sorted((r.kind, r.phoneme_type, r.name, r.gate) for r in audio) == [("gated", "vowel", "a_x2", 4), ("original", "vowel", "a_x2", None)]


def test_properties(spark, tmp_path):
    fx = Fixtures(spark, SF)
    raw = fx.raw_lines().cache()
    trials = T.parse_trials(raw).cache()
    counts = C.confusion_counts(trials).cache()
    n_ok = trials.count()
    assert counts.agg(F.sum("n")).first()[0] == 2 * n_ok
    assert n_ok + T.quarantine_trials(raw).count() == raw.count()
    halves = counts.groupBy("pp_id", "gate").agg(F.sum(F.when(F.col("position") == 1, F.col("n")).otherwise(-F.col("n"))).alias("d"))
    assert halves.where("d <> 0").count() == 0
    grid = C.matrix_grid(counts).cache()
    assert grid.count() == 12 * 38 * 38 and grid.agg(F.sum("n")).first()[0] == 2 * n_ok
    norms = C.normalise_rows(grid).groupBy("gate", "position", "gt").agg(F.sum(F.col("norm") * F.col("norm")).alias("s"))
    assert all(r.s is None or abs(r.s - 1) < 1e-9 for r in norms.collect())
    labels = L.parse_label_filenames(fx.stimuli().select("label_id", "path")).cache()
    attached = T.attach_label(trials, labels).cache()
    assert attached.count() == n_ok and attached.where("n_labels = 0").count() == T.unmatched_trials(trials, labels).count()
    assert T.attach_label(trials).where("label_id is null and n_labels = 0").count() == n_ok
    assert C.matrix_grid(counts, listener=999).agg(F.sum("n")).first()[0] == 0
    nested = C.confusion_nested(counts, raw)
    assert sorted(map(tuple, C.long_form(nested).collect())) == sorted((r.pp_id, r.gate, r.position, r.gt, r.hyp, r.n) for r in counts.collect())
    sinks.write_confusion_json(nested, str(tmp_path / "one"), single=True)
    whole = json.loads(next((tmp_path / "one").glob("part-*.txt")).read_text())
    assert set(whole) == {f"pp{r.pp_id}" for r in raw.select("pp_id").distinct().collect()}


def test_stream(spark, tmp_path):
    raw = Fixtures(spark, SF).raw_lines()
    raw.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(raw.schema).parquet(str(tmp_path / "in"))
    q = stream_confusion_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    want = C.confusion_counts(T.parse_trials(raw))
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, want.collect()))
