"""Quotation linking: who answers whom, from quoted lines, and conversations in reply order without quotes.

A line that begins with one or more ``>`` is quoted, once per ``>``.  Its
content, normalised (lower case, white space runs as one space), is a passage;
the original of a passage is the earliest message of the same conversation
that holds it as a line of its own.  A quoted line that no message holds as it
is (the quote was wrapped anew, or is a part of a longer line) is looked up by
its shingles: all runs of ``SHINGLE`` words of the lines of one quote level
that follow each other, joined.  It comes from the message that the most of its
shingles come from (ties: the earliest), if at least half of them are found;
runs of fewer words match as whole lines only.  A message replies to the message that the
most of its once-quoted lines come from (ties: the latest); if none of these
has an original, the next deeper level decides.  Following the replies gives
each message its thread and depth; the conversation's order is by thread (in
the order of their first messages), then turn.

DataFrame functions only.  Passages are found by an equi-join on their hashes;
originals are reduced to one row per passage before it, and a hot passage's
quotes are split over tasks.  Positions are running counts over range
partitions, so one conversation may hold any share of all rows.  Shingles are
made only in conversations with quoted lines that are left.

``SQL`` states the rule of whole lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import running_totals
from ..session import checkpoint
from .common import row_key, split_join

QUOTED = r"^[ \t]*>[> \t]*"
#: A line that announces a quote; it goes with the quote that follows it.
ANNOUNCES = r"(?i)(wrote|writes|said)[ \t]*:[ \t\r]*$"

#: Words of the runs by which quotes are found that are no whole lines.
SHINGLE = 4


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def level(line: Column) -> Column:
    """How many ``>`` a line begins with."""
    mark = F.regexp_extract(line, QUOTED, 0)
    return F.length(mark) - F.length(F.replace(mark, F.lit(">"), F.lit("")))


def content(line: Column) -> Column:
    """A line's normalised content without quote marks."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(line, QUOTED, "")), r"[\s]+", " "))


def passage(line: Column) -> Column:
    """Hash of a line's normalised content without quote marks; null for an empty one."""
    return F.when(content(line) != "", F.sha2(content(line), 256))


def shingles(words: Column) -> Column:
    """(level, place, lines, h) of the runs of SHINGLE words; an empty word, as of an empty line, or another level ends a run."""
    def at(x: Column, i: Column) -> Column:
        run = [x, *[F.get(words, i + n) for n in range(1, SHINGLE)]]
        whole = F.lit(True)
        for y in run:
            whole = whole & F.coalesce((y["level"] == x["level"]) & (y["word"] != ""), F.lit(False))
        return F.when(whole, F.struct(x["level"].alias("level"), i.alias("place"), F.array_distinct(F.array(*[y["line"] for y in run])).alias("lines"),
                                      F.sha2(F.concat_ws(" ", *[y["word"] for y in run]), 256).alias("h")))

    return F.filter(F.transform(words, at), lambda x: x.isNotNull())


def partial_votes(rows: DataFrame, missed: DataFrame) -> DataFrame:
    """(conv_id, turn, k, level, original, n) of the quoted lines of ``missed`` (conv_id, turn, k, line) by their shingles."""
    some = split_join(rows, missed.select("conv_id").distinct(), ["conv_id"], "left_semi").filter(F.col("turn").isNotNull())
    words = F.flatten(F.transform(lines(F.col("raw")), lambda x, i: F.transform(F.split(content(x), " "), lambda w: F.struct(
        level(x).alias("level"), i.alias("line"), w.alias("word")))))
    runs = some.select("conv_id", "turn", "k", words.alias("words")).select("conv_id", "turn", "k", F.inline(shingles(F.col("words"))))
    originals = runs.filter("level = 0").groupBy("conv_id", "h").agg(F.min("turn").alias("original"))
    quoted = runs.filter("level > 0").select("conv_id", "turn", "k", "level", "place", "h", F.explode("lines").alias("line"))
    row = ["conv_id", "turn", "k", "line"]
    quoted = split_join(quoted, missed.select(row).distinct(), row, "left_semi") \
        .groupBy(*row, "level", "place", "h").agg(F.count(F.lit(1)).alias("copies"))
    found = split_join(quoted, originals, ["conv_id", "h"], "left") \
        .withColumn("original", F.when(F.col("original") < F.col("turn"), F.col("original"))) \
        .groupBy(*row, "level", "original").agg(F.count(F.lit(1)).alias("m"), F.max("copies").alias("n"))
    best = found.groupBy(*row, "level").agg(
        F.sum("m").alias("all"), F.sum(F.when(F.col("original").isNotNull(), F.col("m"))).alias("hits"), F.max("n").alias("n"),
        F.max(F.when(F.col("original").isNotNull(), F.struct("m", (-F.col("original")).alias("o"))))["o"].alias("o"))
    return best.filter(F.col("hits") * 2 >= F.col("all")).select("conv_id", "turn", "k", "level", (-F.col("o")).alias("original"), "n")


def unquoted(text: Column) -> Column:
    """The text without quoted lines and the lines that announce them, blank lines at its ends trimmed."""
    all_lines = lines(text)
    kept = F.filter(all_lines, lambda x, i: (level(x) == 0) & ~(
        x.rlike(ANNOUNCES) & F.coalesce(level(F.get(all_lines, i + 1)) > 0, F.lit(False))))
    return F.regexp_replace(F.array_join(kept, "\n"), r"^\s+|\s+$", "")


def link(messages: DataFrame) -> DataFrame:
    """Per row of ``messages`` (conv_id, turn, role, text): the reply structure and the text without quotes.

    Returns conv_id, turn, role, text (unquoted), n_quoted, quote_level (the
    deepest), reply_to (turn or null), thread (turn of its first message),
    depth and position (from 1 within the conversation).  A null text is
    empty.  Rows without conv_id or turn link to nothing; those without
    conv_id are ordered among themselves.  Repeated rows are kept and numbered
    one after the other.
    """
    text = F.col("text").cast("string")
    rows = messages.select("conv_id", "turn", F.col("role").cast("string").alias("role"), text.alias("raw"),
                           row_key("conv_id", "turn", "role", "text").alias("k"))
    cut = rows.select("conv_id", "turn", "k", F.posexplode(lines(F.col("raw"))).alias("i", "line"))
    parts = cut.select("conv_id", "turn", "k", "i", level(F.col("line")).alias("level"), passage(F.col("line")).alias("h")) \
        .filter(F.col("h").isNotNull() & F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    quoted = parts.filter(F.col("level") > 0)
    originals = parts.filter(F.col("level") == 0).groupBy("conv_id", "h").agg(F.min("turn").alias("original"))
    found = checkpoint(split_join(quoted, originals, ["conv_id", "h"], "left").select(
        "conv_id", "turn", "k", F.col("i").alias("line"), "level", F.when(F.col("original") < F.col("turn"), F.col("original")).alias("original")))
    votes = found.filter(F.col("original").isNotNull()).select("conv_id", "turn", "k", "level", "original", F.lit(1).cast("long").alias("n"))
    missed = found.filter(F.col("original").isNull()).select("conv_id", "turn", "k", "line")
    if not missed.isEmpty():
        votes = votes.unionByName(partial_votes(rows, missed))
    votes = votes.groupBy("conv_id", "turn", "k", "level", "original").agg(F.sum("n").alias("n"))
    parents = votes.groupBy("conv_id", "turn", "k").agg(
        F.max(F.struct((-F.col("level")).alias("l"), "n", "original"))["original"].alias("reply_to"))
    parents = checkpoint(parents)
    # one parent per turn: rows that share a turn follow the earliest of theirs
    steps = checkpoint(parents.groupBy("conv_id", "turn").agg(F.min("reply_to").alias("up")).withColumn("depth", F.lit(1)))
    while True:
        further = steps.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("further"), F.col("depth").alias("more"))
        joined = split_join(steps, further, ["conv_id", "up"], "left")
        steps = checkpoint(joined.select("conv_id", "turn", F.coalesce("further", "up").alias("up"),
                                         (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
                                         F.col("further").isNotNull().alias("moved")))
        if steps.filter("moved").isEmpty():
            break
        steps = steps.drop("moved")
    steps = steps.select("conv_id", "turn", F.col("up").alias("thread"), "depth")
    full = split_join(rows, parents.select("conv_id", "turn", "k", "reply_to"), ["conv_id", "turn", "k"], "left")
    full = split_join(full, steps, ["conv_id", "turn"], "left")
    levels = F.transform(lines(F.col("raw")), level)
    full = full.select("conv_id", "turn", "role", unquoted(F.col("raw")).alias("text"),
                       F.size(F.filter(levels, lambda x: x > 0)).alias("n_quoted"), F.array_max(levels).alias("quote_level"),
                       "reply_to", F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).alias("depth"),
                       "k", F.lit(1).alias("__one"))
    return running_totals(full, ["conv_id"], ["thread", "turn", "k"], ["__one"], ["position"]).drop("__one", "k")


def render(linked: DataFrame, conv_ids: DataFrame) -> DataFrame:
    """Transcripts (conv_id, transcript) of the conversations of ``conv_ids``, in reply order.

    For reading single conversations: a transcript is one value, so ask for
    conversations that fit one.
    """
    some = linked.join(conv_ids.select("conv_id").distinct(), "conv_id", "left_semi")
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.coalesce("role", F.lit("")), F.lit(": "), F.col("text"))
    return some.groupBy("conv_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("position", line.alias("line")))), lambda x: x["line"]), "\n").alias("transcript"))


#: DuckDB SQL of the same result; reply chains by recursion.
SQL = r"""
WITH RECURSIVE rows AS (
    SELECT row_number() OVER () AS r, conv_id, turn, role, string_split(coalesce(text, ''), chr(10)) AS ls FROM conversations
), cut AS (
    SELECT r, conv_id, turn, i, ls[i] AS l, length(regexp_extract(ls[i], '^[ \t]*>[> \t]*')) - length(replace(regexp_extract(ls[i], '^[ \t]*>[> \t]*'), '>', '')) AS level
    FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM rows)
), parts AS (
    SELECT *, trim(regexp_replace(lower(regexp_replace(l, '^[ \t]*>[> \t]*', '')), '[\s]+', ' ', 'g'), ' ') AS h FROM cut
), originals AS (
    SELECT conv_id, h, min(turn) AS original FROM parts WHERE level = 0 AND h <> '' AND turn IS NOT NULL GROUP BY conv_id, h
), votes AS (
    SELECT r, level, original, count(*) AS n FROM parts JOIN originals USING (conv_id, h)
    WHERE level > 0 AND original < turn GROUP BY r, level, original
), parents AS (
    SELECT r, original AS reply_to FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY level, n DESC, original DESC) AS best FROM votes) WHERE best = 1
), ups AS (
    SELECT conv_id, turn, min(reply_to) AS up FROM rows JOIN parents USING (r) GROUP BY conv_id, turn
), chain AS (
    SELECT conv_id, turn, up, 1 AS depth FROM ups
    UNION ALL
    SELECT c.conv_id, c.turn, u.up, c.depth + 1 FROM chain c JOIN ups u ON u.conv_id = c.conv_id AND u.turn = c.up
), roots AS (
    SELECT conv_id, turn, min(up) AS thread, max(depth) AS depth FROM chain GROUP BY conv_id, turn
), kept AS (
    SELECT r, coalesce(string_agg(l, chr(10) ORDER BY i), '') AS text FROM (
        SELECT *, lead(level) OVER (PARTITION BY r ORDER BY i) AS next FROM cut)
    WHERE level = 0 AND NOT (regexp_matches(l, '(?i)(wrote|writes|said)[ \t]*:[ \t\r]*$') AND coalesce(next, 0) > 0) GROUP BY r
), levels AS (SELECT r, count(*) FILTER (level > 0) AS n_quoted, max(level) AS quote_level FROM cut GROUP BY r),
out AS (
    SELECT rows.conv_id, rows.turn, role, regexp_replace(coalesce(kept.text, ''), '^\s+|\s+$', '', 'g') AS text, n_quoted::INT AS n_quoted, quote_level::INT AS quote_level,
           reply_to, coalesce(thread, rows.turn) AS thread, coalesce(depth, 0)::INT AS depth
    FROM rows LEFT JOIN kept USING (r) LEFT JOIN levels USING (r) LEFT JOIN parents USING (r)
    LEFT JOIN roots ON roots.conv_id = rows.conv_id AND roots.turn = rows.turn
)
SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY thread, turn)::BIGINT AS position FROM out
"""
