"""Quotation linking (1) on written cases and against its SQL."""

import os
import random
import textwrap

import duckdb
import pytest

from gatelab.llm import quotes

MESSAGES = [
    (1, 0, "user", "Hello there\nHow are you?"),
    (1, 1, "assistant", "> How are you?\nFine."),
    (1, 2, "user", "On Monday A wrote:\n> > How are   YOU?\n> Fine.\nGood to hear\n"),
    (1, 3, "assistant", ">How are you?\r\nAgain to the first"),
    (1, 4, "user", "> never said\nno parent"),
    (1, 5, "user", None),
    (2, 0, "system", ""),
    (2, 1, "user", "> Hello there\nother conversation"),
    (2, 2, "user", "> self\nself"),
    (2, 3, None, "He wrote:\nno quote follows"),
    (3, 1, "user", "late"),
    (3, 0, "user", "> late\nquoted before it was said"),
    (4, 0, "user", "a\nb\nc"),
    (4, 1, "user", "d\ne"),
    (4, 2, "user", "> a\n> d\n> e\nmost lines"),
    (4, 2, "user", "> a\n> d\n> e\nmost lines"),
    (4, 3, "user", "> a\n> d\ntie goes to the later"),
    (None, 0, "user", "> a"),
    (4, None, "user", "> a"),
]


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([(*m, 9) for m in MESSAGES], "conv_id long, turn long, role string, text string, depth int")
    return df, quotes.link_quotes(df).collect()


def test_written_cases(found):
    by = {(r.conv_id, r.turn): r for r in found[1]}
    parent = {k: r.parent_turn for k, r in by.items() if r.parent_turn is not None}
    assert parent == {(1, 1): 0, (1, 2): 1, (1, 3): 0, (4, 2): 1, (4, 3): 1}
    assert (by[1, 2].root_turn, by[1, 2].depth, by[1, 2].max_level, by[1, 2].n_quoted, by[1, 2].body) == (0, 2, 2, 2, "Good to hear")
    assert by[1, 3].body == "Again to the first" and by[1, 5].body == "" and by[2, 3].body.startswith("He wrote:")
    assert by[2, 3].formatted.startswith("<||>\n") and by[1, 1].formatted == "<|assistant|>\nFine."
    assert len(found[1]) == len(MESSAGES)
    order = [(r.root_turn, r.turn) for r in found[1] if r.conv_id == 1]
    assert order == sorted(order)
    assert all(r.parent_turn < r.turn for r in found[1] if r.parent_turn is not None)


def test_long_chain(spark):
    rows = [(7, k, "user", (f"> line {k - 1}\n" if k else "") + f"line {k}") for k in range(70)]
    out = quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r.turn, r.depth, r.root_turn) for r in out) == [(k, k, 0) for k in range(70)]


def test_sql_agrees(found, tmp_path):
    df, rows = found
    path = f"{tmp_path}/c.parquet"
    df.drop("depth").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
    got = con.execute(quotes.SQL)
    names = [c[0] for c in got.description]
    want = sorted((tuple(r) for r in got.fetchall()), key=str)
    assert sorted((tuple(r[c] for c in names) for r in rows), key=str) == want


def test_empty(spark):
    assert quotes.link_quotes(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def linked(spark, rows):
    out = quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    return {(r.conv_id, r.turn): r for r in out}


LONG = "The committee will meet on the second Tuesday of every month in the large room. Bring the figures of the last quarter with you! Nobody knows yet who takes the minutes"


def test_passages_link_however_they_are_wrapped(spark):
    wrap = lambda s, n, mark: "\n".join(mark + x for x in textwrap.wrap(s, n))
    rows = [
        (1, 0, "a", "Thanks"),
        (1, 1, "b", "\n".join(textwrap.wrap(LONG, 70)) + "\n\nThanks"),
        (1, 2, "c", wrap(LONG, 33, "> ") + "\n>\n> Thanks\nwhole, wrapped anew"),
        (1, 3, "d", wrap("Bring the figures of the last quarter with you!", 20, ">> ") + "\n> whole, wrapped anew\none sentence"),
        (1, 4, "e", wrap(LONG, 40, "> > > ") + "\nonly deep"),
        (1, 5, "f", "> of the last quarter with\na torn sentence"),
    ]
    by = linked(spark, rows)
    assert {k[1]: r.parent_turn for k, r in by.items()} == {0: None, 1: None, 2: 1, 3: 2, 4: 1, 5: None}
    assert (by[1, 3].root_turn, by[1, 3].depth, by[1, 3].max_level, by[1, 3].body) == (1, 2, 2, "one sentence")


def test_very_long_text(spark):
    body = "\n".join(f"line {k} of a very long message. It goes on" for k in range(20000))
    by = linked(spark, [(1, 0, "a", body), (1, 1, "b", "\n".join("> " + x for x in body.split("\n")) + "\nyes")])
    assert by[1, 1].parent_turn == 0 and by[1, 1].n_quoted == 20000 and by[1, 1].body == "yes"


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the test tables")
def test_mail_made_of_conversations(spark, tmp_path):
    """Each turn answers an earlier one, which it quotes wrapped anew, with that one's own quote a level deeper."""
    con = duckdb.connect()
    turns = con.execute("SELECT DISTINCT ON (conv_id, turn) conv_id, turn, role, text FROM '/root/testdata/sf0.01/conversations.parquet' WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL ORDER BY conv_id, turn, text").fetchall()
    rng, mails, asked = random.Random(3), {}, {}
    for conv, turn, role, text in turns:
        own = f"{' '.join(text.split()).replace('>', ' ')} number {turn} of {conv}"
        earlier = [t for c, t in mails if c == conv]
        quote, answered = [], None
        if earlier and rng.random() < 0.8:
            answered = rng.choice(earlier)
            deep = mails[conv, asked[conv, answered]][1] if asked[conv, answered] is not None else None
            for level, s in ((2, deep), (1, mails[conv, answered][1])):
                quote += [("> " * level) + x for x in textwrap.wrap(s, rng.randint(30, 90), break_on_hyphens=False, break_long_words=False)] if s else []
            quote.insert(0, "Somebody wrote:")
        asked[conv, turn] = answered
        mails[conv, turn] = (role, own, "\n".join([*quote, *textwrap.wrap(own, 76, break_on_hyphens=False, break_long_words=False)]))
    rows = [(c, t, role, text) for (c, t), (role, _, text) in mails.items()]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = quotes.link_quotes(df).collect()
    assert sum(a is not None for a in asked.values()) > 100
    right = sum(r.parent_turn == asked[r.conv_id, r.turn] for r in found)
    assert len(found) == len(rows) and right >= 0.98 * len(rows)
    df.write.parquet(f"{tmp_path}/c.parquet")
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c.parquet/*.parquet'")
    got = con.execute(quotes.SQL)
    names = [c[0] for c in got.description]
    assert sorted((tuple(r[c] for c in names) for r in found), key=str) == sorted((tuple(r) for r in got.fetchall()), key=str)


def test_conversations_as_mail(spark):
    """Each message quotes the two before it, at two levels; linking finds the nearer one and gives the bodies back."""
    rows = [("c", k, "user", f"Message {k} says this. And that,\nin {k} lines.") for k in range(6)] + [("d", 1, "user", "alone"), ("d", 9, "user", None), (None, 1, "user", "x"), ("e", None, "user", "y")]
    mail = quotes.as_mail(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string"))
    got = {(r.conv_id, r.turn): r for r in quotes.link_quotes(mail).collect()}
    assert len(got) == len(rows)
    for k in range(6):
        r = got["c", k]
        assert r.body == rows[k][3] and r.parent_turn == (k - 1 if k else None) and r.depth == k and r.root_turn == 0
        assert r.n_quoted == 2 * min(k, 2) and r.max_level == min(k, 2)
    assert got["d", 1].body == "alone" and got["d", 9].body == "" and got["d", 9].parent_turn is None
