"""Quotation linking, with DataFrame functions only.

A line that begins with ``>`` marks is quoted; its level is their number.
Lines of one level in a row are a passage. A passage is normalised (marks
gone, A-Z in lower case, white space runs to one space) and hashed, and so
are the unquoted parts of every message: its whole body, its paragraphs and
its lines. A quoted passage is joined to the first message with the same hash,
in its own conversation if that is earlier, else in the conversation where the
passage was first written. A message replies to the target of its outermost
linked quote.

Within a conversation the replies make trees. Conversations are put in reply
order, without quotes: each turn, then the turns that reply to it, each with
its own replies, in the order of their turns; turns that reply to none of their
own conversation begin trees of their own. The order is found by list ranking:
a tour goes down into each turn and up again, and in each round every step of
it jumps over as far as it has come, which doubles. Rounds grow with the
logarithm of the longest tour, and conversations that are done leave them. No
conversation is ever gathered, however long it or a reply chain is.

Hashes are reduced to their first message before any join, so a text that a
third of all messages share is one row; what joins such a row is written first,
so that adaptive execution can split the other side. Siblings are put in order
in two levels, at most :data:`TURNS` turns at a time.

Defined results: a null text is empty, with a body of ''; an empty quote
links to nothing; a message without quotes keeps its text; rows of equal
(conv_id, turn) share a position, and their turn replies to the latest turn
that one of them replies to; rows with a null conv_id or turn keep their own
body and quotes but are linked to nothing and have a null position; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basalt.llm.common import ascii_lower, materialise

MARKS = r"^[ \t]*(>[ \t]*)+"
TURNS = 1024


def _normal(col):
    return F.btrim(F.regexp_replace(ascii_lower(col), r"[\x20\x09-\x0D]+", " "))


def _runs(kinds, lines, sep):
    """Structs (kind, text) of the runs of equal neighbours in ``kinds``."""
    index = F.sequence(F.lit(0), F.size(kinds) - 1)
    starts = F.filter(index, lambda i: (i == 0) | (F.get(kinds, i) != F.get(kinds, i - 1)))

    def run(start, j):
        stop = F.coalesce(F.get(starts, j + 1), F.size(kinds))
        return F.struct(F.get(kinds, start).alias("kind"), F.array_join(F.slice(lines, start + 1, stop - start), sep).alias("text"))

    return F.transform(starts, run)


def parse(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, mid, body, parts (normalised unquoted parts), quotes (level, key)."""
    m = messages.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    m = m.withColumn("mid", F.xxhash64("conv_id", "turn", "role", "text")).withColumn("lines", F.split("text", "\n", -1))
    marks = F.transform("lines", lambda x: F.regexp_extract(x, MARKS, 0))
    m = m.withColumn("levels", F.transform(marks, lambda x: F.char_length(x) - F.char_length(F.replace(x, F.lit(">")))))
    m = m.withColumn("bare", F.transform("lines", lambda x: F.regexp_replace(x, MARKS, "")))
    plain = F.filter(F.zip_with("lines", "levels", lambda x, n: F.when(n == 0, x)), lambda x: x.isNotNull())
    blank = F.zip_with("lines", "levels", lambda x, n: F.when(n > 0, -1).when(_normal(x) == "", 0).otherwise(1))
    m = m.withColumn("quotes", _runs(F.col("levels"), F.col("bare"), " ")).withColumn("blank", blank)
    quotes = F.filter(F.transform(F.filter("quotes", lambda q: q["kind"] > 0), lambda q: F.struct(q["kind"].alias("level"), _normal(q["text"]).alias("key"))), lambda q: q["key"] != "")
    paragraphs = F.transform(F.filter(_runs(F.col("blank"), F.col("lines"), " "), lambda p: p["kind"] == 1), lambda p: _normal(p["text"]))
    body = F.array_join(plain, "\n")
    parts = F.array_distinct(F.concat(F.array(_normal(body)), paragraphs, F.transform(plain, _normal)))
    return m.select("conv_id", "turn", "role", "text", "mid", body.alias("body"), F.filter(parts, lambda p: p != "").alias("parts"), quotes.alias("quotes"))


def _hashes(key):
    return F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2")


def link(parsed: DataFrame) -> DataFrame:
    """conv_id, turn, mid, level, to_conv, to_turn: a row for each quote, null targets where there is none."""
    at = parsed.filter("conv_id is not null and turn is not null")
    quotes = at.select("conv_id", "turn", "mid", F.posexplode("quotes").alias("q", "quote"))
    quotes = quotes.select("conv_id", "turn", "mid", "q", F.col("quote.level").alias("level"), *_hashes(F.col("quote.key")))
    quotes = materialise(quotes, "quotes", fewer_files=True)
    asked = materialise(quotes.select("h1", "h2").distinct(), "asked", fewer_files=True)
    written = at.select("conv_id", "turn", F.explode("parts").alias("part")).select("conv_id", "turn", *_hashes(F.col("part")))
    near = written.join(asked, ["h1", "h2"], "left_semi").groupBy("conv_id", "h1", "h2").agg(F.min("turn").alias("near"))
    near = materialise(near, "near", fewer_files=True)
    far = materialise(near.groupBy("h1", "h2").agg(F.min(F.struct("conv_id", F.col("near").alias("turn"))).alias("far")), "far", fewer_files=True)
    q = quotes.join(near, ["conv_id", "h1", "h2"], "left").join(far, ["h1", "h2"], "left")
    own, other = F.col("near") < F.col("turn"), F.col("far.conv_id") != F.col("conv_id")
    return q.select("conv_id", "turn", "mid", "q", "level", F.when(own, F.col("conv_id")).when(other, F.col("far.conv_id")).alias("to_conv"), F.when(own, F.col("near")).when(other, F.col("far.turn")).alias("to_turn"))


def _tour(turns: DataFrame) -> DataFrame:
    """conv_id, step, before, count of the steps of all tours: 2 * turn goes down into a turn and 2 * turn + 1 up again.

    ``turns``: conv_id, turn, parent (null: none). ``before`` is the step before, null at a tour's beginning; ``count`` the turns entered.
    """
    part = F.floor(F.col("turn") / TURNS)
    inside = Window.partitionBy("conv_id", "parent", "part").orderBy("turn")
    sibling = turns.withColumn("part", part).withColumn("left", F.lag("turn").over(inside))
    ends = sibling.groupBy("conv_id", "parent", "part").agg(F.min("turn").alias("first"), F.max("turn").alias("last"))
    ends = ends.withColumn("earlier", F.lag("last").over(Window.partitionBy("conv_id", "parent").orderBy("part")))
    heads = materialise(ends.filter("earlier is not null").select("conv_id", F.col("first").alias("turn"), "earlier"), "heads", fewer_files=True)
    sibling = sibling.join(heads, ["conv_id", "turn"], "left").select("conv_id", "turn", "parent", F.coalesce("left", "earlier").alias("left"))
    last = materialise(ends.filter("parent is not null").groupBy("conv_id", F.col("parent").alias("turn")).agg(F.max("last").alias("child")), "children", fewer_files=True)
    down = sibling.select("conv_id", (F.col("turn") * 2).alias("step"), F.coalesce(F.col("left") * 2 + 1, F.col("parent") * 2).alias("before"), F.lit(1).cast("long").alias("count"))
    up = turns.join(last, ["conv_id", "turn"], "left").select("conv_id", (F.col("turn") * 2 + 1).alias("step"), F.coalesce(F.col("child") * 2 + 1, F.col("turn") * 2).alias("before"), F.lit(0).cast("long").alias("count"))
    return down.union(up)


def reply_order(turns: DataFrame) -> DataFrame:
    """conv_id, turn, position of the turns (conv_id, turn, parent) in reply order; a parent is an earlier turn."""
    rest, done = materialise(_tour(turns), "tour", fewer_files=True), None
    while True:
        going = rest.filter("before is not null")
        to = rest.select("conv_id", F.col("step").alias("before"), F.col("before").alias("further"), F.col("count").alias("more"))
        jumped = going.join(to, ["conv_id", "before"]).select("conv_id", "step", F.col("further").alias("before"), (F.col("count") + F.col("more")).alias("count"))
        rows = materialise(jumped.union(rest.filter("before is null")), "tour", fewer_files=True)
        open_ = materialise(rows.filter("before is not null").select("conv_id").distinct(), "open", fewer_files=True)
        ready = rows.join(open_, "conv_id", "left_anti").filter("step % 2 = 0").select("conv_id", (F.col("step") / 2).cast("long").alias("turn"), F.col("count").alias("position"))
        done = ready if done is None else done.union(ready)
        if open_.isEmpty():
            return done
        rest = materialise(rows.join(open_, "conv_id", "left_semi"), "tour", fewer_files=True)


def conversations(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, position, n_quotes, n_linked, max_level, reply_conv, reply_turn, body."""
    m = materialise(parse(messages), "messages")
    own = F.col("to_conv") == F.col("conv_id")
    best = F.min_by(F.struct("to_conv", "to_turn"), F.struct("level", F.when(own, 0).otherwise(1), -F.col("to_turn"), "to_conv"))
    linked = link(m).filter("to_conv is not null").distinct().groupBy("conv_id", "turn", "mid").agg(F.count(F.lit(1)).alias("n_linked"), best.alias("reply"))
    linked = materialise(linked, "linked", fewer_files=True)
    at = m.filter("conv_id is not null and turn is not null")
    parent = linked.filter("reply.to_conv = conv_id").groupBy("conv_id", "turn").agg(F.max("reply.to_turn").alias("parent"))
    turns = at.select("conv_id", "turn", F.lit(None).cast("long").alias("parent")).union(parent).groupBy("conv_id", "turn").agg(F.max("parent").alias("parent"))
    order = materialise(reply_order(materialise(turns, "turns", fewer_files=True)), "order", fewer_files=True)
    rows = at.join(linked, ["conv_id", "turn", "mid"], "left").join(order, ["conv_id", "turn"], "left")
    rest = m.filter("conv_id is null or turn is null")
    rows = rows.unionByName(rest, allowMissingColumns=True)
    level = F.coalesce(F.array_max(F.transform("quotes", lambda q: q["level"])), F.lit(0))
    return rows.select(
        "conv_id", "turn", "role", "position", F.size("quotes").cast("long").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), level.cast("long").alias("max_level"), F.col("reply.to_conv").alias("reply_conv"), F.col("reply.to_turn").alias("reply_turn"), "body",
    )


def digests(messages: DataFrame) -> DataFrame:
    """:func:`conversations` with the body's SHA-256 in its place."""
    return conversations(messages).select("conv_id", "turn", "position", "n_quotes", "n_linked", "max_level", "reply_conv", "reply_turn", F.sha2("body", 256).alias("body_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: all conversations."""
    return digests(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


_NORMAL = "trim(regexp_replace(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+', ' ', 'g'))"
SQL = f"""
WITH RECURSIVE m AS (
  SELECT row_number() OVER () AS rid, conv_id, turn, role, coalesce(text, '') AS text FROM conversations
), l AS (
  SELECT rid, conv_id, turn, unnest(generate_series(1, len(ls))) AS p, unnest(ls) AS line FROM (SELECT *, string_split(text, chr(10)) AS ls FROM m)
), x AS (
  SELECT *, regexp_extract(line, '^[ \\t]*(>[ \\t]*)+') AS mark FROM l
), y AS (
  SELECT *, length(mark) - length(replace(mark, '>', '')) AS level, substr(line, length(mark) + 1) AS bare FROM x
), z AS (
  SELECT *, CASE WHEN level > 0 THEN -1 WHEN {_NORMAL.format("line")} = '' THEN 0 ELSE 1 END AS kind FROM y
), r AS (
  SELECT *, sum(CASE WHEN a THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY p) AS run, sum(CASE WHEN b THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY p) AS para
  FROM (SELECT *, coalesce(level = lag(level) OVER w, false) AS a, coalesce(kind = lag(kind) OVER w, false) AS b FROM z WINDOW w AS (PARTITION BY rid ORDER BY p))
), quotes AS (
  SELECT * FROM (SELECT rid, conv_id, turn, run, level, {_NORMAL.format("string_agg(bare, ' ' ORDER BY p)")} AS key FROM r WHERE level > 0 GROUP BY ALL) WHERE key <> ''
), bodies AS (
  SELECT rid, conv_id, turn, coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (level = 0), '') AS body FROM r GROUP BY ALL
), parts AS (
  SELECT conv_id, turn, {_NORMAL.format("body")} AS key FROM bodies
  UNION ALL SELECT conv_id, turn, {_NORMAL.format("string_agg(line, ' ' ORDER BY p)")} FROM r WHERE kind = 1 GROUP BY rid, conv_id, turn, para
  UNION ALL SELECT conv_id, turn, {_NORMAL.format("line")} FROM r WHERE level = 0
), near AS (
  SELECT conv_id, key, min(turn) AS near FROM parts WHERE key <> '' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY 1, 2
), far AS (
  SELECT key, conv_id AS far_conv, near AS far_turn FROM near QUALIFY row_number() OVER (PARTITION BY key ORDER BY conv_id, near) = 1
), links AS (
  SELECT q.rid, q.run, q.level, q.conv_id, CASE WHEN near < turn THEN q.conv_id WHEN far_conv <> q.conv_id THEN far_conv END AS to_conv, CASE WHEN near < turn THEN near WHEN far_conv <> q.conv_id THEN far_turn END AS to_turn
  FROM quotes q LEFT JOIN near ON near.conv_id = q.conv_id AND near.key = q.key LEFT JOIN far ON far.key = q.key WHERE q.conv_id IS NOT NULL AND q.turn IS NOT NULL
), best AS (
  SELECT rid, to_conv, to_turn, count(*) OVER (PARTITION BY rid) AS n FROM links WHERE to_conv IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY level, CASE WHEN to_conv = conv_id THEN 0 ELSE 1 END, -to_turn, to_conv) = 1
), q AS (
  SELECT rid, count(*) AS n, max(level) AS level FROM quotes GROUP BY 1
), turns AS (
  SELECT m.conv_id, m.turn, max(CASE WHEN best.to_conv = m.conv_id THEN best.to_turn END) AS parent FROM m LEFT JOIN best USING (rid) WHERE m.conv_id IS NOT NULL AND m.turn IS NOT NULL GROUP BY 1, 2
), tree AS (
  SELECT conv_id, turn, [turn] AS path FROM turns WHERE parent IS NULL
  UNION ALL
  SELECT t.conv_id, t.turn, list_append(tree.path, t.turn) FROM turns t JOIN tree ON tree.conv_id = t.conv_id AND tree.turn = t.parent
), place AS (
  SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY path) AS position FROM tree
)
SELECT m.conv_id, m.turn, place.position,
  CAST(coalesce(q.n, 0) AS BIGINT) AS n_quotes, CAST(coalesce(best.n, 0) AS BIGINT) AS n_linked, CAST(coalesce(q.level, 0) AS BIGINT) AS max_level, best.to_conv AS reply_conv, best.to_turn AS reply_turn, sha256(b.body) AS body_sha256
FROM m JOIN bodies b USING (rid) LEFT JOIN q USING (rid) LEFT JOIN best USING (rid) LEFT JOIN place ON place.conv_id = m.conv_id AND place.turn = m.turn
"""
