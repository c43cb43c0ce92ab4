"""Chat formatting: quotation linking.

A line that starts with marks `>` (spaces may stand between them) quotes; its level
is the number of marks.  A line like "On ... wrote:" just before a quoted line is its
introduction and goes too.  A passage is a run of lines of one level (own lines have
level zero), ended by a blank line or a change of level.  Its text is normalised (lower
case, runs of white space and line ends as one space, ends trimmed), so wrapping it anew
changes nothing.  What is hashed are its parts: the whole passage, its sentences and its
lines, so that a quote of some sentences links too.  The original of a quoted part is
the first message of the conversation that has the part as its own; it must come before
the quoting message.  A message's parent is the original whose parts have the most
characters at the message's shallowest linked level, ties to the later message, so that
a short phrase that others wrote before outweighs no passage.  Following parents to
the top gives each message's root; messages sorted by conversation, root and turn
stand in reply order, every message after the one it answers and the answers to
different messages apart.

Only built-in column functions are used.  Originals are grouped minima over the
conversations that quote at all, and links are joins on (conversation, hash), so a
conversation or a line of any share of the rows meets no pairs; roots are found by
doubling, in as many rounds as the logarithm of the longest chain of replies.

Null text has no lines and an empty body; parts that are empty when normalised don't link.
Texts of any length are parsed whole; no messages give no rows.  Rows with a
null conversation or turn link to nothing.  Rows of equal conversation and turn are
one message for linking, and each keeps its own body.  Columns named like the
output's are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelab.llm.runtime import drop_scratch, write_scratch

MARKS = "^[ \\t]*(>[ \\t]*)+"
INTRODUCTION = "(?i)(wrote|writes|schrieb|escribió|a écrit)[ ]?:[ \\t]*$"
SENTENCE_END = "([.!?…]) "


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[ \\t\\r\\n\\f\\x0B]+", " "))


def parsed(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, lines: level (0 for own, -1 for introductions) and content of every line."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "\\r\\n?", "\n")
    lines = messages.select("conv_id", "turn", "role", F.split(text, "\n").alias("lines"))
    marks = lines.withColumn("marks", F.transform("lines", lambda x: F.regexp_extract(x, MARKS, 0)))
    introduces = lambda x, i: x.rlike(INTRODUCTION) & (F.get("marks", i + 1) != "")
    own = lambda x, i: F.when(introduces(x, i), -1).otherwise(0)
    level = lambda x, i: F.when(F.get("marks", i) != "", F.length(F.regexp_replace(F.get("marks", i), "[^>]", ""))).otherwise(own(x, i))
    content = lambda x, i: F.substr(x, F.length(F.get("marks", i)) + 1)
    return marks.select("conv_id", "turn", "role", F.transform("lines", lambda x, i: F.struct(level(x, i).alias("level"), content(x, i).alias("content"))).alias("lines"))


def passage_parts(rows: DataFrame, quoted: bool) -> DataFrame:
    """conv_id, turn, level, part: passages, their sentences and lines, normalised, of the quoted or the own passages of parsed rows."""
    blank = lambda x: F.trim(F.translate(x["content"], "\t\f\x0b", "   ")) == ""
    before = lambda i: F.get("lines", i - 1)
    new = lambda x, i: ~blank(x) & ((i == 0) | (before(i)["level"] != x["level"]) | blank(before(i)))
    starts = F.filter(F.transform("lines", lambda x, i: F.when(new(x, i), i + 1)), lambda i: i.isNotNull())
    rows = rows.withColumn("starts", starts)
    end = lambda k: F.coalesce(F.get("starts", k + 1), F.size("lines") + 1)
    passages = F.transform("starts", lambda i, k: F.slice("lines", i, end(k) - i))
    rows = rows.select("conv_id", "turn", F.explode(passages).alias("p")).withColumn("level", F.col("p")[0]["level"]).where("level > 0" if quoted else "level = 0")
    rows = rows.withColumn("lines", F.col("p.content")).withColumn("text", normalised(F.array_join("lines", "\n")))
    sentences = F.split(F.regexp_replace("text", SENTENCE_END, "$1\n"), "\n")
    parts = F.array_distinct(F.concat(F.array("text"), sentences, F.transform("lines", normalised)))
    return rows.select("conv_id", "turn", "level", F.explode(parts).alias("part")).where("part <> ''")


def quote_links(messages: DataFrame) -> DataFrame:
    """conv_id, turn, level, original (turn), n_chars: how many characters the distinct quoted parts of a message that have that original hold."""
    quoting = messages.where(F.col("text").rlike("(^|[\\r\\n])[ \\t]*>"))
    asked = messages.join(quoting.select("conv_id").distinct(), "conv_id", "left_semi")
    key = F.unhex(F.md5("part")).alias("hash")
    originals = passage_parts(parsed(asked), False).groupBy("conv_id", key).agg(F.min("turn").alias("original"))
    quotes = passage_parts(parsed(quoting), True).select("conv_id", "turn", "level", key, F.length("part").alias("n")).distinct()
    return quotes.join(originals, ["conv_id", "hash"]).where("original < turn").groupBy("conv_id", "turn", "level", "original").agg(F.sum("n").alias("n_chars"))


def reply_roots(parents: DataFrame) -> DataFrame:
    """parents: conv_id, turn, parent.  Adds root and depth (replies from the root down)."""
    now = write_scratch(parents.select("conv_id", "turn", "parent", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth")), "roots")
    while True:
        up = now.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("above"), F.col("depth").alias("more"))
        new = now.join(up, ["conv_id", "root"], "left")
        new = write_scratch(
            new.select("conv_id", "turn", "parent", F.coalesce("above", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("above").isNotNull().alias("moved")), "roots"
        )
        moved = new.where("moved").limit(1).count()
        drop_scratch(now)
        now = new
        if not moved:
            return now.drop("moved")


def as_mail(messages: DataFrame) -> DataFrame:
    """The conversations as mail in which each message quotes the two before it, the nearer at one level, the other at two, under
    an introduction; for tables whose messages quote nothing.  A message is looked up by its turn, so no conversation is
    gathered; of several messages of one turn the least text is quoted."""
    before = messages.groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    back = lambda k: before.select("conv_id", (F.col("turn") + k).alias("turn"), F.col("text").alias(f"t{k}"))
    rows = messages.join(back(1), ["conv_id", "turn"], "left").join(back(2), ["conv_id", "turn"], "left")
    quote = lambda c, mark: F.concat(F.lit(mark), F.regexp_replace(c, "\n", "\n" + mark), F.lit("\n"))
    near = F.when(F.col("t1").isNotNull(), F.concat(F.lit("The one before wrote:\n"), quote(F.col("t1"), "> "), F.coalesce(quote(F.col("t2"), "> > "), F.lit("")), F.lit("\n")))
    return rows.select("conv_id", "turn", "role", F.concat(F.coalesce(near, F.lit("")), "text").alias("text"))


def link_quotes(messages: DataFrame) -> DataFrame:
    """messages: conv_id, turn, role, text.  Returns, in reply order, conv_id, root_turn, turn, role, parent_turn,
    depth, n_quoted (lines), max_level, body (text without quotes) and formatted (role header and body)."""
    best = F.max(F.struct((-F.col("level")).alias("l"), F.col("n_chars"), F.col("original")))
    parents = quote_links(messages).groupBy("conv_id", "turn").agg(best.alias("b")).select("conv_id", "turn", F.col("b.original").alias("parent"))
    roots = reply_roots(parents)
    own = F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["content"])
    out = parsed(messages).join(roots, ["conv_id", "turn"], "left").withColumn("quoted", F.filter("lines", lambda x: x["level"] > 0))
    body = F.regexp_replace(F.array_join(own, "\n"), "^\\n+|\\n+$", "")
    return out.select(
        "conv_id",
        F.coalesce("root", "turn").alias("root_turn"),
        "turn",
        "role",
        F.col("parent").alias("parent_turn"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        F.size("quoted").cast("long").alias("n_quoted"),
        F.coalesce(F.array_max(F.transform("quoted", lambda q: q["level"])), F.lit(0)).cast("long").alias("max_level"),
        body.alias("body"),
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), body).alias("formatted"),
    ).orderBy("conv_id", "root_turn", "turn")


#: The same in SQL, by recursion instead of doubling.
SQL = r"""
WITH RECURSIVE m AS (
  SELECT row_number() OVER () AS id, conv_id, turn, role,
         string_split(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(10)) AS lines
  FROM conversations
), l AS (
  SELECT id, conv_id, turn, role, i, lines[i] AS line,
         regexp_matches(lines[i], '^[ \t]*(>[ \t]*)+') AS quoted,
         regexp_matches(lines[i], '(?i)(wrote|writes|schrieb|escribió|a écrit)[ ]?:[ \t]*$')
           AND coalesce(regexp_matches(lines[i + 1], '^[ \t]*(>[ \t]*)+'), false) AS introduces
  FROM m, LATERAL (SELECT unnest(range(1, len(lines) + 1)) AS i)
), levelled AS (
  SELECT id, conv_id, turn, i, CASE WHEN quoted THEN length(regexp_replace(regexp_extract(line, '^[ \t]*(>[ \t]*)+'), '[^>]', '', 'g')) WHEN introduces THEN -1 ELSE 0 END AS level,
         CASE WHEN quoted THEN regexp_replace(line, '^[ \t]*(>[ \t]*)+', '') ELSE line END AS content
  FROM l
), started AS (
  SELECT *, trim(regexp_replace(content, '[ \t\f\x0B]+', ' ', 'g')) = '' AS blank,
         lag(level) OVER w IS DISTINCT FROM level OR lag(trim(regexp_replace(content, '[ \t\f\x0B]+', ' ', 'g')) = '') OVER w AS apart
  FROM levelled WINDOW w AS (PARTITION BY id ORDER BY i)
), numbered AS (
  SELECT *, sum(CASE WHEN apart AND NOT blank THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS p FROM started
), passage AS (
  SELECT id, conv_id, turn, arg_min(level, i) AS level,
         trim(regexp_replace(lower(string_agg(content, chr(10) ORDER BY i)), '[ \t\r\n\f\x0B]+', ' ', 'g')) AS text,
         list(trim(regexp_replace(lower(content), '[ \t\r\n\f\x0B]+', ' ', 'g'))) AS lines
  FROM numbered WHERE p > 0 GROUP BY id, conv_id, turn, p
), part AS (
  SELECT conv_id, turn, level, unnest(list_distinct(list_concat([text], string_split(regexp_replace(text, '([.!?…]) ', '\1' || chr(10), 'g'), chr(10)), lines))) AS part
  FROM passage
), original AS (
  SELECT conv_id, part, min(turn) AS original FROM part WHERE level = 0 AND part <> '' GROUP BY conv_id, part
), link AS (
  SELECT q.conv_id, q.turn, level, original, sum(length(q.part)) AS n
  FROM (SELECT DISTINCT * FROM part WHERE level > 0 AND part <> '') q JOIN original o ON q.conv_id = o.conv_id AND q.part = o.part
  WHERE original < q.turn GROUP BY ALL
), parent AS (
  SELECT conv_id, turn, arg_max(original, (-level, n, original)) AS parent FROM link GROUP BY conv_id, turn
), chain AS (
  SELECT conv_id, turn, parent, parent AS root, CAST(1 AS BIGINT) AS depth FROM parent
  UNION ALL
  SELECT c.conv_id, c.turn, c.parent, p.parent, c.depth + 1 FROM chain c JOIN parent p ON p.conv_id = c.conv_id AND p.turn = c.root
), root AS (
  SELECT conv_id, turn, parent, min(root) AS root, max(depth) AS depth FROM chain GROUP BY conv_id, turn, parent
), whole AS (
  SELECT id, conv_id, turn, role,
         regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT quoted AND NOT introduces), ''), '^\n+|\n+$', '', 'g') AS body,
         count(*) FILTER (quoted) AS n_quoted,
         coalesce(max(length(regexp_replace(regexp_extract(line, '^[ \t]*(>[ \t]*)+'), '[^>]', '', 'g'))), 0) AS max_level
  FROM l GROUP BY id, conv_id, turn, role
)
SELECT w.conv_id, coalesce(r.root, w.turn) AS root_turn, w.turn, w.role, r.parent AS parent_turn,
       coalesce(r.depth, 0) AS depth, w.n_quoted, CAST(w.max_level AS BIGINT) AS max_level, w.body,
       '<|' || coalesce(w.role, '') || '|>' || chr(10) || w.body AS formatted
FROM whole w LEFT JOIN root r ON r.conv_id = w.conv_id AND r.turn = w.turn
"""

#: The same over as_mail(conversations).
MAIL_SQL = SQL.replace("FROM conversations", "FROM mail").replace("WITH RECURSIVE m AS (", """WITH RECURSIVE earlier AS (
  SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY conv_id, turn
), mail AS (
  SELECT c.conv_id, c.turn, c.role, CASE WHEN a.text IS NULL THEN '' ELSE 'The one before wrote:' || chr(10) || '> ' || replace(a.text, chr(10), chr(10) || '> ') || chr(10)
    || coalesce('> > ' || replace(b.text, chr(10), chr(10) || '> > ') || chr(10), '') || chr(10) END || c.text AS text
  FROM conversations c LEFT JOIN earlier a ON a.conv_id = c.conv_id AND a.turn = c.turn - 1 LEFT JOIN earlier b ON b.conv_id = c.conv_id AND b.turn = c.turn - 2
), m AS (""")
