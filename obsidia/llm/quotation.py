"""Quotation linking with DataFrame functions only.

A line's quote level is the number of ``>`` that lead it, spaces between them allowed. A passage is a stretch of lines
of one level; quoted passages are normalised (ASCII and other letters lower-cased, white space collapsed) and hashed.
A message's own text offers hashes of the whole, of each stretch between quotes, of each paragraph and of each line. A
quoted passage links to the latest earlier message of its conversation that offers its hash or that has all its lines
(blank ones aside, each as often as it is quoted); the shallowest linked quote, and of several the latest
message, is what a message replies to. Following replies up gives each message's thread and depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsidia.llm._common import discard, written

_PREFIX = r"^(?:[ \t]*>)+"


def _normal(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " ")))


def _lines(text: Column) -> Column:
    """Array of (level, content) of a text's lines."""

    def line(x: Column) -> Column:
        prefix = F.regexp_extract(x, _PREFIX, 0)
        return F.struct(F.length(F.regexp_replace(prefix, "[^>]", "")).alias("level"), F.regexp_replace(x, _PREFIX, "").alias("content"))

    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), line)


def line_hashes(lines: Column) -> Column:
    """Hashes of normalised lines that aren't blank."""
    return F.transform(F.filter(F.transform(lines, _normal), lambda x: x != ""), F.md5)


def parse(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``own`` (the text without quotes) and ``quotes array<struct<level, hash, lines>>`` (non-empty ones, in order).

    ``lines`` are the hashes of a quote's lines; ``stretches`` are the texts between quotes.
    """
    starts = F.filter(F.sequence(F.lit(1), F.size("_lines")), lambda i: (i == 1) | (F.element_at("_lines", i)["level"] != F.element_at("_lines", F.greatest(i - 1, F.lit(1)))["level"]))

    def passage(s: Column, j: Column) -> Column:
        after = F.coalesce(F.try_element_at("_starts", j + 2), F.size("_lines") + 1)
        content = F.transform(F.slice("_lines", s, after - s), lambda x: x["content"])
        return F.struct(F.element_at("_lines", s)["level"].alias("level"), content.alias("content"), _normal(F.array_join(content, "\n")).alias("normal"))

    own = F.array_join(F.transform(F.filter("_lines", lambda x: x["level"] == 0), lambda x: x["content"]), "\n")
    out = df.withColumn("_lines", _lines(F.col(text_col))).withColumn("_starts", starts)
    out = out.withColumn("_passages", F.filter(F.transform("_starts", passage), lambda p: p["normal"] != ""))
    quotes = F.transform(F.filter("_passages", lambda p: p["level"] > 0), lambda p: F.struct(p["level"].alias("level"), F.md5(p["normal"]).alias("hash"), line_hashes(p["content"]).alias("lines")))
    stretches = F.transform(F.filter("_passages", lambda p: p["level"] == 0), lambda p: p["normal"])
    return out.withColumn("own", F.trim(own)).withColumn("quotes", quotes).withColumn("stretches", stretches).drop("_lines", "_starts", "_passages")


def link_quotes(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, turn, role, reply_to, thread, depth, n_quotes, text``, one row per input row.

    ``text`` is without quotes; ``thread`` is the turn that the chain of replies starts from and ``depth`` its length,
    so that ordering by ``conv_id, thread, turn`` puts each message after what it answers. Null texts are empty and
    have no quotes; rows without a conversation or turn reply to nothing; rows that repeat a turn are one message with
    the quotes and texts of all. Other columns are ignored.
    """
    rows = parse(df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")))
    placed = rows.where("conv_id is not null and turn is not null")
    units = F.filter(F.array_distinct(F.concat(F.array("own"), F.split("own", r"\n[ \t\r]*\n"), F.split("own", "\n"), F.col("stretches"))), lambda x: _normal(x) != "")
    offered = placed.select("conv_id", "turn", F.explode(F.transform(units, lambda x: F.md5(_normal(x)))).alias("hash"), F.lit(None).cast("int").alias("level"))
    quoted = written(placed.select("conv_id", "turn", F.explode("quotes").alias("q")).select("conv_id", "turn", "q.hash", "q.level", "q.lines"))
    asked = quoted.select("conv_id", "turn", "hash", "level")
    # offers outside quoted conversations can't be asked for
    offered = offered.join(asked.select("conv_id", "hash").distinct(), ["conv_id", "hash"], "left_semi")
    earlier = Window.partitionBy("conv_id", "hash").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    found = offered.unionByName(asked).withColumn("origin", F.max(F.when(F.col("level").isNull(), F.col("turn"))).over(earlier)).where("level is not null and origin is not null")
    # quotes of several lines by line: each line as often as it is quoted
    parted = quoted.where(F.size("lines") > 1).select("conv_id", "turn", "level", "lines").distinct().withColumn("quote", F.md5(F.array_join("lines", "")))
    wanted = parted.select("conv_id", "turn", "level", "quote", F.size(F.array_distinct("lines")).alias("different"), F.explode("lines").alias("line")).groupBy("conv_id", "turn", "level", "quote", "different", "line").agg(F.count("*").alias("times"))
    had = placed.join(parted.select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", F.col("turn").alias("origin"), F.explode(line_hashes(F.split("own", "\n"))).alias("line")).groupBy("conv_id", "origin", "line").agg(F.count("*").alias("has"))
    whole = wanted.join(had, ["conv_id", "line"]).where("origin < turn and has >= times").groupBy("conv_id", "turn", "level", "quote", "different", "origin").agg(F.count("*").alias("matched")).where("matched = different")
    found = found.select("conv_id", "turn", "level", "origin").unionByName(whole.select("conv_id", "turn", "level", "origin"))
    replies = found.groupBy("conv_id", "turn").agg(F.min(F.struct("level", (-F.col("origin")).alias("late"))).alias("x")).select("conv_id", "turn", (-F.col("x.late")).alias("reply_to"))
    replies = written(replies)
    # pointer doubling: each step follows twice as many replies
    up = written(replies.select("conv_id", "turn", F.col("reply_to").alias("top"), F.lit(1).cast("long").alias("depth")))
    while True:
        above = up.select("conv_id", F.col("turn").alias("top"), F.col("top").alias("further"), F.col("depth").alias("more"))
        step = up.join(above, ["conv_id", "top"], "left")
        after = written(step.select("conv_id", "turn", F.coalesce("further", "top").alias("top"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("further").isNotNull().alias("moved")))
        discard(up)
        up = after
        if not up.where("moved").limit(1).count():
            break
    links = replies.join(up.select("conv_id", "turn", "top", "depth"), ["conv_id", "turn"])
    out = rows.join(links, ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", "role", "reply_to", F.coalesce("top", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), F.size("quotes").cast("long").alias("n_quotes"), F.col("own").alias("text"))


def op3_quotation(spark, sf_dir: str) -> DataFrame:
    """All of ``conversations``."""
    return link_quotes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP3_SQL = r"""
WITH RECURSIVE base AS (
  SELECT row_number() OVER () AS r, conv_id, turn, role, coalesce(text, '') AS t FROM conversations
), lines AS (
  SELECT r, conv_id, turn, i, length(regexp_replace(regexp_extract(x, '^(?:[ \t]*>)+'), '[^>]', '', 'g')) AS level,
         regexp_replace(x, '^(?:[ \t]*>)+', '') AS content
  FROM (SELECT r, conv_id, turn, unnest(string_split(t, chr(10))) AS x, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM base)
), runs AS (
  SELECT *, sum(change) OVER (PARTITION BY r ORDER BY i) AS run
  FROM (SELECT *, CASE WHEN lag(level) OVER (PARTITION BY r ORDER BY i) = level THEN 0 ELSE 1 END AS change FROM lines)
), passages AS (
  SELECT r, conv_id, turn, run, any_value(level) AS level, lower(trim(regexp_replace(string_agg(content, chr(10) ORDER BY i), '[ \t\r\n]+', ' ', 'g'))) AS normal
  FROM runs GROUP BY ALL
), quotes AS (
  SELECT r, conv_id, turn, level, md5(normal) AS hash FROM passages WHERE level > 0 AND normal <> ''
), own AS (
  SELECT base.r, base.conv_id, base.turn, base.role, trim(coalesce(string_agg(content, chr(10) ORDER BY i), '')) AS text
  FROM base LEFT JOIN lines ON base.r = lines.r AND level = 0 GROUP BY ALL
), offered AS (
  SELECT DISTINCT conv_id, turn, md5(lower(trim(regexp_replace(u, '[ \t\r\n]+', ' ', 'g')))) AS hash FROM (
    SELECT conv_id, turn, text AS u FROM own UNION ALL SELECT conv_id, turn, unnest(regexp_split_to_array(text, '\n[ \t\r]*\n')) FROM own
    UNION ALL SELECT conv_id, turn, unnest(string_split(text, chr(10))) FROM own
  ) WHERE trim(regexp_replace(u, '[ \t\r\n]+', ' ', 'g')) <> ''
), found AS (
  SELECT q.conv_id, q.turn, q.level, max(o.turn) AS origin FROM quotes q
  JOIN offered o ON q.conv_id = o.conv_id AND q.hash = o.hash AND o.turn < q.turn GROUP BY q.conv_id, q.turn, q.level, q.hash
), replies AS (
  SELECT conv_id, turn, arg_max(origin, (-level, origin)) AS reply_to FROM found GROUP BY conv_id, turn
), chain AS (
  SELECT conv_id, turn, reply_to AS top, 1 AS depth FROM replies
  UNION ALL SELECT c.conv_id, c.turn, r.reply_to, c.depth + 1 FROM chain c JOIN replies r ON c.conv_id = r.conv_id AND c.top = r.turn
), last AS (
  SELECT conv_id, turn, arg_max(top, depth) AS top, max(depth) AS depth FROM chain GROUP BY conv_id, turn
)
SELECT own.conv_id, own.turn, own.role, replies.reply_to, coalesce(last.top, own.turn) AS thread, CAST(coalesce(last.depth, 0) AS BIGINT) AS depth,
       (SELECT count(*) FROM quotes WHERE quotes.r = own.r) AS n_quotes, own.text
FROM own LEFT JOIN replies ON own.conv_id = replies.conv_id AND own.turn = replies.turn LEFT JOIN last ON own.conv_id = last.conv_id AND own.turn = last.turn
"""
