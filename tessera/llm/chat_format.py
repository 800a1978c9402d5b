"""Chat formatting with a grammar that reads back what was written.

A turn is written ``### Role: text</turn>`` and a line feed.  Its text is
written as it is unless it holds a control string or the parser would read
something else; then it is escaped, and the whole is read back and compared.  Escaping puts one more backslash where a control
string, or a control string that already holds backslashes, would stand:

``</turn\\...>``  gets a backslash before ``>``;
``\\...### ``     gets a backslash before it;
``: `` in a role gets a backslash before the blank.

The parser cuts at the end mark, takes the role up to the first ``: `` and drops
one backslash from each such place.  After escaping no control string is left,
and neither can one arise across the end of a text, so one pass makes a turn
identical; one that is not would be an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HEAD, MID, END = "### ", ": ", "</turn>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"</turn(\\*)>", r"</turn$1\\>"), r"(\\*)### ", r"\\$1### ")


def unescape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"</turn(\\*)\\>", r"</turn$1>"), r"\\(\\*)### ", r"$1### ")


def _escape_role(role: Column) -> Column:
    return escape(F.regexp_replace(role, r":(\\*) ", r":$1\\ "))


def _unescape_role(role: Column) -> Column:
    return F.regexp_replace(unescape(role), r":(\\*)\\ ", r":$1 ")


def _written(role: Column, text: Column) -> Column:
    return F.concat(F.lit(HEAD), role, F.lit(MID), text, F.lit(END))


def parse(formatted: Column) -> Column:
    """Array of (role, text) of a formatted conversation."""
    frames = F.slice(F.split(formatted, "</turn>\n", -1), F.lit(1), F.size(F.split(formatted, "</turn>\n", -1)) - 1)
    body = lambda f: F.substring(f, F.lit(len(HEAD) + 1), F.length(f))
    role = lambda f: F.substring_index(body(f), MID, 1)
    return F.transform(
        frames,
        lambda f: F.struct(
            _unescape_role(role(f)).alias("role"),
            unescape(F.substring(body(f), F.length(role(f)) + F.lit(len(MID) + 1), F.length(f))).alias("text"),
        ),
    )


def format_conversations(turns: DataFrame, speaker: str = "assistant") -> DataFrame:
    """(conv_id, n_turns, formatted, turns, round_trip, loss) for each conversation.

    Input columns: conv_id, turn, role, text.  Turns are ordered by turn (null
    first), then role, then text, so ties and repeated rows have one order; all
    are kept.  A null role or text is empty; null conv_ids are one conversation.
    ``turns`` is what the parser reads back from ``formatted``, and round_trip
    tells whether it equals the source.  ``loss`` has the code points (from, to)
    of ``formatted`` that each of the speaker's texts takes, as it is written.
    Other columns are not read.  Only DataFrame functions are used.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    source = F.array(F.struct(F.col("role").alias("role"), F.col("text").alias("text")))
    marked = F.lit(False)
    for c, mark in (("text", "</turn>"), ("text", HEAD), ("role", "</turn>"), ("role", HEAD), ("role", MID)):
        marked |= F.contains(F.col(c), F.lit(mark))
    plain = ~marked & (parse(_written(F.col("role"), F.col("text"))) == source)
    body = {"_role": F.when(plain, F.col("role")).otherwise(_escape_role(F.col("role"))), "_text": F.when(plain, F.col("text")).otherwise(escape(F.col("text")))}
    rows = rows.withColumns(body).withColumn("written", _written(F.col("_role"), F.col("_text")))
    before = W.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(F.length("written").cast("long")).over(before), F.lit(0)) + F.length("_role") + F.lit(len(HEAD) + len(MID))
    rows = rows.withColumn("from", begin).withColumn("to", F.col("from") + F.length("_text"))
    found = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "from", "to", "written"))).alias("rows"))
    spoken = F.filter("rows", lambda r: r["role"] == speaker)
    out = found.select(
        "conv_id",
        F.size("rows").cast("long").alias("n_turns"),
        F.array_join(F.col("rows.written"), "").alias("formatted"),
        F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("source"),
        F.transform(spoken, lambda r: F.struct(r["from"].alias("from"), r["to"].alias("to"))).alias("loss"),
    )
    out = out.withColumn("turns", parse(F.col("formatted")))
    same = F.when(F.col("turns") == F.col("source"), True).otherwise(F.raise_error(F.lit("a conversation is not read back as it was")).cast("boolean"))
    return out.select("conv_id", "n_turns", "formatted", "turns", same.alias("round_trip"), "loss")


def digest(formatted: DataFrame, speaker: str = "assistant") -> DataFrame:
    """Digests of what was read back; the loss mask covers the speaker's texts."""
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == speaker), lambda t: t["text"]), "")
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return formatted.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "round_trip",
    )
