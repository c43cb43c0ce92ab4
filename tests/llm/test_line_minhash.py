"""Fuzzy line dedup (9) against brute force."""

import random

import pytest

from gatelab.llm import line_minhash


def norm(line):
    return line.lower().strip(" \t\r\f\x0b")


def shingles(s):
    return {s} if len(s) < 5 else {s[i : i + 5] for i in range(len(s) - 4)}


def brute(docs, threshold=0.8):
    """The text of each document without the lines that repeat an earlier one, by all pairs."""
    first = {}
    for i, t in sorted((d for d in docs if d[0] is not None), key=lambda d: d[0]):
        for p, line in enumerate((t or "").split("\n") if t is not None else ()):
            if n := norm(line):
                first[n] = min(first.get(n, (i, p)), (i, p))
    keys = list(first)
    sets = [shingles(k) for k in keys]
    root = list(range(len(keys)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(keys)):
        for b in range(a):
            c = len(sets[a] & sets[b])
            if c >= threshold * (len(sets[a]) + len(sets[b]) - c):
                root[find(a)] = find(b)
    keep = {}
    for k, key in enumerate(keys):
        keep[find(k)] = min(keep.get(find(k), first[key]), first[key])
    keep = {key: keep[find(k)] for k, key in enumerate(keys)}
    out = []
    for i, t in docs:
        if i is None or t is None:
            out.append((i, t))
            continue
        out.append((i, "\n".join(x for p, x in enumerate(t.split("\n")) if not norm(x) or keep[norm(x)] == (i, p))))
    return out


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefghijklmnopé", k=rng.randint(2, 9))) for _ in range(400)]
    line = lambda n: " ".join(rng.choices(words, k=n))
    base = [line(rng.choice([6, 12, 25, 40, 60, 90])) for _ in range(25)]

    def variant(s):
        w = s.split()
        for _ in range(max(1, len(w) // 40)):
            w[rng.randrange(len(w))] = rng.choice(words)
        return " ".join(w)

    out = []
    for i in range(80):
        t = [line(rng.randint(1, 50)) for _ in range(rng.randint(0, 4))] + [rng.choice([b, b.upper(), variant(b)]) for b in rng.choices(base, k=3)]
        rng.shuffle(t)
        out.append((i * 2, "\n".join(t)))
    out += [(501, None), (502, ""), (503, "\n\n  \n"), (504, "abc"), (505, "abc\nABC \nabd"), (None, base[0]), (506, "x" * 20000), (507, base[1]), (507, base[1]), (508, base[2] + "\n" + base[2])]
    return out


def test_matches_all_pairs(spark, docs):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, pos string, id int").repartition(4)
    rows = line_minhash.dedup_lines(df)
    assert rows.columns[:4] == df.columns
    got, want = sorted(((r.doc_id, r.text) for r in rows.collect()), key=str), sorted(brute(docs), key=str)
    lost = sum(a != b for a, b in zip(got, want))
    assert [a[0] for a in got] == [b[0] for b in want]
    assert lost <= 0.03 * len(want)  # banding has high recall, not full
    lines = lambda rs: sum(len((t or "").split("\n")) for _, t in rs)
    assert lines(got) >= lines(want)  # verification lets nothing else go
    for r in rows.collect():
        assert r.text is None or r["__n_lines"] - r["__n_removed"] == (len(r.text.split("\n")) if r.text or r["__n_removed"] == 0 else 0) or r.text == ""


def test_broadcast_and_shuffle_agree(spark, docs, monkeypatch):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    one = sorted(((r.doc_id, r.text) for r in line_minhash.dedup_lines(df).collect()), key=str)
    monkeypatch.setattr(line_minhash, "BROADCAST_LINES", 0)
    assert sorted(((r.doc_id, r.text) for r in line_minhash.dedup_lines(df).collect()), key=str) == one


def test_empty(spark):
    assert line_minhash.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def removed(spark, rows, **how):
    return {r.doc_id: r["__n_removed"] for r in line_minhash.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), **how).collect()}


def test_long_words_are_verified_exactly(spark):
    rng = random.Random(4)
    w = ["".join(rng.choices("abcdefghijklmnop0123456789", k=60)) for _ in range(12)]
    v = [x[:30] + "_" + x[31:] if k < 7 else x for k, x in enumerate(w)]
    a, b = shingles(" ".join(w)), shingles(" ".join(v))
    assert len(a & b) / len(a | b) > 0.85 and len(set(w) & set(v)) / len(set(w) | set(v)) < 0.3
    assert removed(spark, [(1, " ".join(w)), (2, " ".join(v))]) == {1: 0, 2: 1}


def similar_pairs(n, edit, count=150):
    """Pairs of lines of n words, of similarity 0.80 to 0.85 by edits of letters or of words."""
    rng = random.Random(f"{n} {edit}")
    words = ["".join(rng.choices("abcdefghilmnoprstu", k=rng.randint(2, 9))) for _ in range(3000)]
    pairs = []
    while len(pairs) < count:
        x = " ".join(rng.choices(words, k=n))
        y = x
        while (j := len(shingles(x) & shingles(y)) / len(shingles(x) | shingles(y))) >= 0.85:
            if edit == "letter":
                k = rng.randrange(len(y))
                y = y[:k] + rng.choice("abcdefghijklmnop") + y[k + 1 :]
            else:
                w = y.split()
                w[rng.randrange(n)] = rng.choice(words)
                y = " ".join(w)
        if j >= 0.8:
            pairs.append((x, y))
    return pairs


@pytest.mark.parametrize("edit", ["letter", "word"])
def test_recall_at_the_threshold(spark, edit):
    found = {}
    for n in (12, 25, 40, 60, 80):
        pairs = similar_pairs(n, edit)
        rows = [(2 * k + j, t) for k, p in enumerate(pairs) for j, t in enumerate(p)]
        signed = line_minhash._signed(line_minhash._lines(spark.createDataFrame(rows, "__doc long, __text string"))).select("doc", "bands").collect()
        bands = {r.doc: set(r.bands) for r in signed}
        found[n] = sum(bool(bands[2 * k] & bands[2 * k + 1]) for k in range(len(pairs))) / len(pairs)
    print(edit, found)
    assert min(found.values()) >= 0.93 and sum(found.values()) / len(found) >= 0.95


@pytest.mark.parametrize("phrase, few, many", [("the same thirty-odd characters now ", 4, 9), ("ha", 30, 300), ("x=y;", 10, 1000)])
def test_repetitive_lines_of_unlike_length_meet(spark, phrase, few, many):
    a, b = (phrase * few).strip(), (phrase * many).strip()
    assert len(shingles(a) & shingles(b)) >= 0.8 * len(shingles(a) | shingles(b))
    assert removed(spark, [(1, a), (2, b)]) == {1: 0, 2: 1}


def test_hot_band_is_compared_whole(spark, monkeypatch):
    """Many lines of one frame, unlike one another but for chains of pairs: all links are found through the rounds."""
    monkeypatch.setattr(line_minhash, "ROUNDS", (1, 2))
    rng = random.Random(9)
    frame = [" ".join("".join(rng.choices("abcdefghilmnoprstu", k=6)) for _ in range(5)) for _ in range(12)]
    lines = []
    for _ in range(60):
        line = [f if rng.random() < 0.8 else " ".join("".join(rng.choices("abcdefghilmnoprstu", k=6)) for _ in range(5)) for f in frame]
        lines.append(" ".join(line))
        line[rng.randrange(12)] = "changed at one place only as it is"
        lines.append(" ".join(line))
    docs = [(k, t) for k, t in enumerate(lines)]
    got, want = removed(spark, docs), {i: (t or "").count("\n") + bool(t) for i, t in brute(docs)}
    assert sum(got.values()) >= 0.95 * sum(1 - n for n in want.values())
    assert all(got[i] <= 1 - want[i] for i in want)


def test_names_ids_and_texts_that_clash(spark):
    rows = [(1, "a line that stands here twice\nown", "x", "y", 5), (1, "other\na line that stands here twice", "x", "y", 5), (2, "A line that stands here twice", "x", "y", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, doc string, gone string, `__n_lines` int")
    got = sorted((r.doc_id, r.text, r.doc, r.gone, r["__n_lines"], r["__n_removed"]) for r in line_minhash.dedup_lines(df).collect())
    assert [g[0] for g in got] == [1, 1, 2] and sum(g[5] for g in got) == 2 and got[2][1] == ""
    assert sorted(g[1].count("stands here") for g in got) == [0, 0, 1] and {"own" in g[1] or "other" in g[1] for g in got[:2]} == {True}


def test_bitmaps_leave_out_no_similar_pair(spark):
    """Pairs of any similarity: what the bitmaps rule out is below the threshold, and most of what is far below is ruled out."""
    rng = random.Random(6)
    rows = []
    for k in range(400):
        x = "".join(rng.choices("abcdefgh é世", k=rng.choice([3, 5, 6, 30, 120, 900])))
        y = list(x)
        for _ in range(rng.randint(0, max(1, len(x) // 8))):
            y[rng.randrange(len(y))] = rng.choice("abcdefghxyz")
        rows += [(2 * k, x), (2 * k + 1, "".join(y) + rng.choice(["", "tail"]))]
    lines = [(i, 0, 0, i, i, t) for i, t in rows]
    signed = line_minhash._signed(spark.createDataFrame(lines, "doc long, th long, pos int, k1 long, k2 long, norm string")).cache()
    x, y = signed.alias("x"), signed.alias("y")
    for threshold in (0.5, 0.8, 0.95):
        pairs = x.join(y, line_minhash.F.expr("x.doc % 2 = 0 and y.doc = x.doc + 1"))
        left = {r.doc for r in pairs.where(line_minhash.may_be_alike("x", "y", line_minhash._BITMAP, threshold)).select("x.doc").collect()}
        like = {i: len(shingles(rows[i][1]) & shingles(rows[i + 1][1])) / len(shingles(rows[i][1]) | shingles(rows[i + 1][1])) for i in range(0, 800, 2)}
        assert {i for i, j in like.items() if j >= threshold} <= left
        far = [i for i, j in like.items() if j < threshold - 0.3 and 20 < len(rows[i][1]) < 500]
        assert sum(i in left for i in far) <= 0.1 * len(far)


def test_lines_of_one_frame_are_not_compared_pair_by_pair(spark, monkeypatch):
    """600 lines that share a frame and are alike at 0.6 to 0.75: bands gather them, bitmaps leave few pairs to verify."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghilmnoprstu", k=6))
    frame = [word() for _ in range(16)]
    docs = [(k, " ".join(word() if rng.random() < 0.1 else f for f in frame)) for k in range(600)]
    verified, whole = [], line_minhash._verified
    monkeypatch.setattr(line_minhash, "_verified", lambda pairs, *a: (verified.append(pairs.count()), whole(pairs, *a))[1])
    removed(spark, docs)
    assert sum(verified) < 10 * len(docs)


def test_no_python_on_the_executors(spark, docs, monkeypatch):
    def refuse(*a, **k):
        raise AssertionError("Python on the executors")

    for name in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(type(spark.range(0)), name, refuse)
    assert sum(removed(spark, [(k, "a line that stands here more than once, twice to be exact") for k in range(3)]).values()) == 2


def test_pairs_a_little_below_the_threshold_are_no_rows(spark, monkeypatch):
    """Lines of one frame, any two alike at some 0.75, under 0.8, which bitmaps can't rule out: rounds compare them and make no rows of pairs."""
    rng = random.Random(3)
    frame = "".join(rng.choices("abcdefghilmnoprstu ", k=280))
    lines, like = [], []
    for _ in range(600):
        new = set(rng.sample(range(1, 55), 4))
        line = "".join(rng.choice("vwxyz") if k % 5 == 2 and k // 5 in new else c for k, c in enumerate(frame))
        now = [len(shingles(line) & shingles(x)) / len(shingles(line) | shingles(x)) for x in lines]
        if max(now, default=0) < 0.8:
            lines.append(line)
            like += now
    verified, whole = [], line_minhash._verified
    monkeypatch.setattr(line_minhash, "_verified", lambda pairs, *a: (verified.append(pairs.count()), whole(pairs, *a))[1])
    assert sum(removed(spark, list(enumerate(lines))).values()) == 0
    assert len(lines) > 20 and sum(like) > 0.7 * len(like)
    assert sum(verified[1:]) < len(lines)


def test_sets_of_very_long_lines_and_of_any_characters(spark, docs, monkeypatch):
    """Arrays and rows of shingles verify alike, and an array holds whole characters."""
    lines = ["", "a", "abcd", "abcde", "\r\tab\u2028cd é世", "😀😀x😀😀😀y😀 z", "ababababab"]
    got = spark.createDataFrame(list(enumerate(lines)), "id int, norm string").select("id", line_minhash._set("norm").alias("s")).collect()
    assert {r.id: set(r.s) for r in got} == {i: shingles(x) for i, x in enumerate(lines)}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    one = sorted(((r.doc_id, r.text) for r in line_minhash.dedup_lines(df).collect()), key=str)
    monkeypatch.setattr(line_minhash, "LONG", 60)
    assert sorted(((r.doc_id, r.text) for r in line_minhash.dedup_lines(df).collect()), key=str) == one


def test_small_bands_meet_in_one_round(spark, docs, monkeypatch):
    rounds, whole = [], line_minhash._cross
    monkeypatch.setattr(line_minhash, "_cross", lambda *a: (rounds.append(a[2:4]), whole(*a))[1])
    line_minhash.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"))
    assert rounds in ([], [(0, None)])


def test_a_pair_of_several_bands_is_one_row(spark, monkeypatch):
    """Pairs that rounds find share many bands: they are rows once."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghilmnoprstu", k=6))
    lines, whole = [], line_minhash._verified
    for _ in range(20):
        base = [word() for _ in range(30)]
        lines += [" ".join(base[:k] + [word()] + base[k + 1 :]) for k in (1, 8, 15, 22)]
    rows = []
    monkeypatch.setattr(line_minhash, "_verified", lambda pairs, *a: (rows.append([(r.a, r.b) for r in pairs.collect()]), whole(pairs, *a))[1])
    assert sum(removed(spark, list(enumerate(lines))).values()) == 60
    assert all(len(r) == len(set(r)) for r in rows)
