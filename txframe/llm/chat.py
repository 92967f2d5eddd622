"""Chat formatting by quotation linking.

Each message is split into lines, each line's quote level is its number of leading ``>`` marks,
and runs of lines of one level are passages. Every passage is normalised (marks stripped, case
and white space folded) and hashed, as are its lines and its longer sentences, so that a quote of
part of a paragraph, or of one that was wrapped anew, is found too. The original of a passage is
the earliest message of the conversation that holds it in its own words: as its whole text, as a
run of its own lines, as one of them or as one of its sentences. A message replies to the original
of its least deeply quoted passage that has one in an earlier turn; whole passages go before
lines, lines before sentences, and of several originals the latest counts. Replies form threads,
and a conversation is ordered by thread and then turn, so that every message follows the one it
answers, and a conversation without quotes keeps its order; the text keeps no quotes and no lines
that only announce one. ``assembled`` puts ordered messages together into pieces of a conversation.

Only hashes and keys are linked and ordered; texts are shuffled once, to their positions.

Nulls and odd input: a null text is empty; a message with a null conv_id or turn is a thread of
its own; rows that repeat a (conv_id, turn) share the parent and sort by role and a hash of the
text; quotes without an original link nothing but are removed all the same; a text of any length
is parsed whole; an empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import OWN, discard, hot_join, let, prefix_sums, staged

#: Marks at the start of a quoted line, and a line that announces a quote.
MARKS = r"^(?:[ \t]*>)+"
ANNOUNCES = r"(?i)\b(?:wrote|writes|said)\s*:\s*$"
#: Characters from which a sentence says enough to be linked by.
LEAST_SENTENCE = 24
#: Wanted passages that are broadcast; more are joined by a shuffle.
BROADCAST_WANTED = 200_000
#: Messages of a piece of a conversation.
PIECE = 64
#: Doublings of a reply chain; 2**40 messages in one chain are beyond any table.
MOST_DOUBLINGS = 40


def _level(line: Column) -> Column:
    marks = F.regexp_extract(line, MARKS, 0)
    return F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))


def _normal(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def _bare(line: Column) -> Column:
    return F.regexp_replace(line, MARKS, "")


def parsed_lines(text: Column) -> Column:
    """Array of (level, bare, announces) for the lines of a text."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), lambda x: F.struct(_level(x).alias("level"), _bare(x).alias("bare")))
    return let(lines, lambda a: F.transform(a, lambda x, i: F.struct(x["level"].alias("level"), x["bare"].alias("bare"), ((x["level"] == 0) & x["bare"].rlike(ANNOUNCES) & (F.get(a, i + 1)["level"] > 0)).eqNullSafe(True).alias("announces"))))


def _runs(lines: Column) -> Column:
    """Passages: maximal runs of lines of one level, without announcing lines, as (level, text)."""
    kept = F.filter(lines, lambda x: ~x["announces"])
    first = let(kept, lambda a: F.transform(F.filter(F.transform(a, lambda x, i: F.struct(i.alias("i"), ((i == 0) | (x["level"] != F.get(a, i - 1)["level"])).alias("new"), x["level"].alias("level"))), lambda s: s["new"]), lambda s: F.struct(s["i"].alias("i"), s["level"].alias("level"))))
    return let(kept, lambda a: let(first, lambda f: F.transform(f, lambda s, k: F.struct(s["level"].alias("level"), F.array_join(F.transform(F.slice(a, s["i"] + 1, F.coalesce(F.get(f, k + 1)["i"], F.size(a)) - s["i"]), lambda x: x["bare"]), " ").alias("text")))))


def _hashes(passages: Column) -> Column:
    """Digests of normalised passages, without empty ones."""
    return F.transform(F.array_distinct(F.filter(F.transform(passages, _normal), lambda x: x != "")), lambda x: F.md5(x.cast("binary")))


def _sentences(text: Column) -> Column:
    """The sentences of a normalised text that are long enough to link by."""
    return F.filter(F.split(text, r"(?<=[.!?]) "), lambda x: F.length(x) >= LEAST_SENTENCE)


def unquoted(text: Column) -> Column:
    """The own words of a text. One without a mark has no quotes and no lines that announce one."""
    body = F.coalesce(text, F.lit(""))
    own = F.array_join(F.transform(F.filter(parsed_lines(body), lambda x: (x["level"] == 0) & ~x["announces"]), lambda x: x["bare"]), "\n")
    plain = F.when(F.contains(body, F.lit(">")), own).otherwise(F.regexp_replace(body, "\r\n", "\n"))
    return F.regexp_replace(F.regexp_replace(plain, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def n_quotes(text: Column) -> Column:
    """How many passages of a text are quoted."""
    found = F.size(F.filter(_runs(parsed_lines(text)), lambda r: r["level"] > 0))
    return F.when(F.contains(F.coalesce(text, F.lit("")), F.lit(">")), found).otherwise(0).cast("long")


def quoted_passages(rows: DataFrame) -> DataFrame:
    """conv_id, turn, level, kind (0 a run, 1 a line, 2 a sentence) and hash of what messages quote."""
    marked = rows.filter(F.contains("text", F.lit(">"))).select("conv_id", "turn", parsed_lines(F.col("text")).alias("lines"))
    typed = lambda kind: lambda x: F.struct(x["level"].alias("level"), F.lit(kind).alias("kind"), _normal(x["text"]).alias("text"))
    runs = F.transform(F.filter(_runs(F.col("lines")), lambda r: r["level"] > 0), typed(0))
    by_line = F.transform(F.filter("lines", lambda x: x["level"] > 0), lambda x: F.struct(x["level"].alias("level"), F.lit(1).alias("kind"), _normal(x["bare"]).alias("text")))
    parts = F.flatten(F.transform(F.col("runs"), lambda r: F.transform(_sentences(r["text"]), lambda t: F.struct(r["level"].alias("level"), F.lit(2).alias("kind"), t.alias("text")))))
    every = marked.withColumn("runs", runs).select("conv_id", "turn", F.explode(F.array_distinct(F.concat("runs", by_line, parts))).alias("q")).filter("q.text <> ''")
    return every.select("conv_id", "turn", "q.level", "q.kind", F.md5(F.col("q.text").cast("binary")).alias("hash"))


def own_passages(rows: DataFrame) -> DataFrame:
    """conv_id, turn and hash of what messages say in their own words."""
    lines = rows.select("conv_id", "turn", parsed_lines(F.col("text")).alias("lines"))
    own_runs = F.transform(F.filter(_runs(F.col("lines")), lambda r: r["level"] == 0), lambda r: r["text"])
    own_lines = F.transform(F.filter("lines", lambda x: (x["level"] == 0) & ~x["announces"]), lambda x: x["bare"])
    said = F.transform(F.concat(F.array(F.array_join(own_lines, " ")), own_runs, own_lines), _normal)
    whole = lines.withColumn("said", said)
    return whole.select("conv_id", "turn", F.explode(F.array_distinct(F.concat("said", F.flatten(F.transform("said", _sentences))))).alias("text")).filter("text <> ''").select("conv_id", "turn", F.md5(F.col("text").cast("binary")).alias("hash"))


def links(conversations: DataFrame) -> DataFrame:
    """Per replying (conv_id, turn): parent_turn."""
    placed = conversations.filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select("conv_id", "turn", "text")
    quoting = staged(quoted_passages(placed))
    if quoting.isEmpty():
        return quoting.select("conv_id", "turn", F.col("turn").alias("parent_turn"))
    wanted = staged(quoting.select("conv_id", "hash").distinct())
    asked = F.broadcast(wanted) if wanted.count() <= BROADCAST_WANTED else wanted
    originals = own_passages(placed).join(asked, ["conv_id", "hash"], "left_semi").groupBy("conv_id", "hash").agg(F.min("turn").alias("first"))
    met = hot_join(quoting, staged(originals), ["conv_id", "hash"]).filter(F.col("first") < F.col("turn"))
    return met.groupBy("conv_id", "turn").agg((-F.min(F.struct("level", "kind", (-F.col("first")).alias("back")))["back"]).alias("parent_turn"))


def threads(replies: DataFrame) -> DataFrame:
    """Per replying (conv_id, turn): thread, the turn its chain of parents ends in, and depth.

    Every round joins each message with what its farthest known ancestor knows, so the reach
    doubles; a round is a written table.
    """
    reach = staged(replies.select("conv_id", "turn", F.col("parent_turn").alias("thread"), F.lit(1).cast("long").alias("depth")))
    for _ in range(MOST_DOUBLINGS):
        ahead = reach.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("far"), F.col("depth").alias("more"))
        after = staged(hot_join(reach, ahead, ["conv_id", "thread"], "left").select("conv_id", "turn", F.coalesce("far", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("far").isNotNull().alias("moved")))
        discard(reach)
        reach = after
        if after.filter("moved").isEmpty():
            return reach.select("conv_id", "turn", "thread", "depth")
    raise ValueError("a reply chain is too long")


def reply_ordered(conversations: DataFrame) -> DataFrame:
    """Per message: conv_id, turn, role, thread, parent_turn, depth, position in the conversation, n_quotes and text."""
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn(OWN + "h", F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull(), F.coalesce("role", F.lit("")), F.col("role").isNull()))
    keys = rows.select("conv_id", "turn", "role", OWN + "h")
    replies = staged(links(rows))
    if replies.isEmpty():
        placed = keys.select("*", F.lit(None).cast("long").alias("parent_turn"), F.col("turn").alias("thread"), F.lit(0).cast("long").alias("depth"))
    else:
        known = staged(replies.join(threads(replies), ["conv_id", "turn"]))
        placed = hot_join(staged(keys), known, ["conv_id", "turn"], "left").withColumn("thread", F.coalesce("thread", "turn")).withColumn("depth", F.coalesce("depth", F.lit(0).cast("long")))
    ordered = prefix_sums(placed, ["conv_id"], [F.col("thread").asc_nulls_last(), F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last(), F.col(OWN + "h").asc()], {})
    # equal rows share one text, so each distinct message is shuffled once however often it repeats
    texts = rows.dropDuplicates(["conv_id", "turn", OWN + "h"]).select(F.col("conv_id").alias(OWN + "c"), F.col("turn").alias(OWN + "t"), F.col(OWN + "h").alias(OWN + "x"), "text")
    same = F.col("conv_id").eqNullSafe(F.col(OWN + "c")) & F.col("turn").eqNullSafe(F.col(OWN + "t")) & (F.col(OWN + "h") == F.col(OWN + "x"))
    return ordered.join(texts, same).select("conv_id", "turn", "role", "thread", "parent_turn", "depth", F.col("before_rows").alias("position"), n_quotes(F.col("text")).alias("n_quotes"), unquoted(F.col("text")).alias("text"))


def assembled(ordered: DataFrame, piece: int = PIECE) -> DataFrame:
    """Conversations put together from ``reply_ordered``, ``piece`` messages at a time: conv_id, piece, first_position, n_messages, text.

    A message is its role, a colon and its text, and messages are parted by an empty line. Pieces bound
    what one row holds however long a conversation is. A null role is "unknown".
    """
    said = F.struct("position", F.concat(F.coalesce("role", F.lit("unknown")), F.lit(": "), F.col("text")).alias("said"))
    parts = ordered.groupBy("conv_id", F.floor(F.col("position") / piece).cast("long").alias("piece")).agg(F.array_sort(F.collect_list(said)).alias("m"))
    return parts.select("conv_id", "piece", (F.col("piece") * piece).alias("first_position"), F.size("m").cast("long").alias("n_messages"), F.array_join(F.transform("m", lambda x: x["said"]), "\n\n").alias("text"))


def quoting(conversations: DataFrame) -> DataFrame:
    """``conversations`` in which the message of turn t quotes that of turn (t - 1) // 2, on one line that begins with its turn."""
    one_line = F.concat(F.lit("m"), F.col("turn").cast("string"), F.lit(" "), F.btrim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[ \t\n\f\r]+", " ")))
    said = conversations.filter("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", "role", F.btrim(one_line).alias("said"))
    before = said.select("conv_id", F.col("turn").alias("up"), F.col("said").alias("quoted"))
    met = said.withColumn("up", F.when(F.col("turn") > 0, F.expr("(turn - 1) DIV 2"))).join(before, ["conv_id", "up"], "left")
    return met.select("conv_id", "turn", "role", F.when(F.col("quoted").isNull(), F.col("said")).otherwise(F.concat(F.lit("Someone wrote:\n> "), F.col("quoted"), F.lit("\n\n"), F.col("said"))).alias("text"))
