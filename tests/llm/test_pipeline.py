"""The corpus pipeline stage by stage, each held against what was planted for it."""

import random

import pytest

import corpus_pipeline
from gatelab.llm import bktree, lattice, phrase_index

RUDE = [f"rude{k}" for k in range(6)]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(21)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9))) for _ in range(500)]
    line = lambda n: " ".join(rng.choices(words, k=n))
    docs, labels = [], []
    for i in range(1000):
        w = [line(rng.randint(12, 30)).split() for _ in range(3)]
        bad = i % 6 == 0
        if bad:
            for _ in range(8):
                w[rng.randrange(3)].append(rng.choice(RUDE))
        docs.append((i, "\n".join(" ".join(x) for x in w)))
        if i % 2 == 0:
            labels.append((i, 1, int(bad)))
    items = [(k, line(25)) for k in range(5)]
    docs += [(2000, docs[1][1]), (2001, docs[1][1] + "\n" + line(20)), (2002, f"{line(15)}\n{items[2][1]}"), (2003, None), (2004, "")]
    rows = [(i, t, "en", "src", len(t or "")) for i, t in docs]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, sf_dir):
    source = docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    made = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir).cache()
        made[name] = docs
        if name != "pieces":
            assert docs.columns == source.columns and docs.dtypes == source.dtypes
    ids = {name: {r.doc_id for r in df.select("doc_id").collect()} for name, df in made.items()}
    assert len([i for i in ids["quality"] if i < 1000 and i % 6 == 0]) <= 2
    assert len([i for i in range(1000) if i % 6 and i not in ids["quality"]]) <= 4 and {2000, 2002, 2003, 2004} <= ids["quality"]
    assert ids["lines"] == ids["quality"]
    text = {r.doc_id: r for r in made["lines"].collect()}
    assert text[2000].text == "" and text[2001].text.count("\n") == 0 and text[2003].text is None and text[2000].n_chars == 0
    groups = {}
    for r in bktree.simhash_components(made["lines"]).collect():
        groups.setdefault(r.component_id, []).append(r.doc_id)
    assert ids["near_copies"] == {min(g) for g in groups.values()} and 2003 not in ids["near_copies"]
    bad = {r.doc_id for r in phrase_index.report(phrase_index.contamination(made["near_copies"], spark.read.parquet(f"{sf_dir}/benchmark.parquet"))).where("contaminated").collect()}
    assert bad == {2002} and ids["decontaminate"] == ids["near_copies"] - bad
    back = {r.doc_id: r.decoded for r in lattice.decode(made["pieces"]).collect()}
    assert back == {r.doc_id: r.text for r in made["decontaminate"].collect()}


def test_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert len(rows) > 300 and all(r.n_pieces == len(r.pieces or []) for r in rows)


def test_nulls_repeated_rows_and_empty_tables(spark):
    sf = "/root/testdata/sf0.001"
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    text = " ".join(f"word{k}" for k in range(40))
    rows = [(None, text, "en", "x", 1), (None, "only here once", None, None, None), (7, None, "en", "x", 0), (8, "", "en", "x", 0), (9, text, "en", "y", 2), (9, text, "en", "y", 2), (10, "long " * 50_000, "en", "z", 3)]
    docs = spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select(*[docs[f.name].cast(f.dataType) for f in schema])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0, name
    ids = lambda df: sorted(str(r.doc_id) for r in df.collect())
    kept = dict(corpus_pipeline.STAGES)
    assert ids(kept["lines"](spark, docs, sf)) == ["10", "7", "8", "9", "9", "None", "None"]
    assert ids(kept["near_copies"](spark, docs, sf)) == ["10", "7", "9", "None"]
    assert ids(kept["decontaminate"](spark, docs, sf)) == ["10", "7", "8", "9", "9", "None", "None"]
    pieces = {str(r.doc_id): r for r in kept["pieces"](spark, docs, sf).collect()}
    assert pieces["7"].pieces is None and pieces["8"].pieces == [] and pieces["10"].n_pieces > 1000


def test_columns_named_like_inner_ones(spark, sf_dir):
    """Columns of any name go through every stage with their values."""
    names = ["__row", "__key", "__text", "row", "doc", "key", "text2", "node", "band", "group", "id"]
    rows = [(i, f"line {i} of a short text\nand {i * 7} more", "en", "s", 30, *[f"{n}{i}" for n in names]) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)).repartition(3)
    for name, stage in corpus_pipeline.STAGES[1:4]:  # quality keeps what fits the labels' words, and these rows have none of them
        kept = stage(spark, docs, sf_dir)
        assert kept.columns == docs.columns and kept.dtypes == docs.dtypes, name
        got = kept.collect()
        assert got and all(r[n] == f"{n}{r.doc_id}" for r in got for n in names), name
    quality = corpus_pipeline.quality(spark, docs, sf_dir)
    assert quality.columns == docs.columns and all(r[n] == f"{n}{r.doc_id}" for r in quality.collect() for n in names)
    out = lattice.encode(docs)
    assert out.columns == [*docs.columns, "pieces"] and all(r[n] == f"{n}{r.doc_id}" for r in out.collect() for n in names)
    assert {r.doc_id: r.decoded for r in lattice.decode(out).collect()} == {r.doc_id: r.text for r in docs.collect()}
