"""Chat formatting with a grammar that is checked by a round trip.

Grammar: a conversation is its turns in order, and a turn is ``### role:\\n text \\n</turn>\\n``. A text is
free of bare control strings (``###`` and ``</turn>``); one that would hold them has a backslash put before
each. The parser is deterministic: split at ``\\n</turn>\\n``, cut at the first ``:\\n``, take one backslash
off in front of every control string. A control string without a backslash in a text is a conflict, and the text is null.

Each turn is first rendered as it is and parsed again; if the parser does not give back exactly the role and
the text, the conflicting content is escaped and the turn is parsed once more. The whole conversation is
then parsed again and compared with its source turns, and a difference is an error, so the result is always
reversible. All steps are DataFrame functions, without Python on the executors.

A null text or role counts as empty. Turns are ordered by turn, then role, then text (null turn first), so
repeated turns stay, in a fixed order. A null conv_id is a conversation of its own. An empty table gives an
empty result; other columns are ignored. A conversation is one row of the result, so it must fit in memory
of a task; its turns are rendered, checked and measured before they meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONTROL = "###|</turn>"
END = "\n</turn>\n"
ESCAPE = rf"(?<!\\)(\\*)({CONTROL})"
UNESCAPE = rf"(?<!\\)\\(\\*)({CONTROL})"


def escape(text: Column) -> Column:
    """One more backslash before each control string."""
    return F.regexp_replace(text, ESCAPE, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1$2")


def _escape_role(role: Column) -> Column:
    """A role of one line: backslash, newline and colon are spelled out, control strings too."""
    for a, b in (("\\", "\\b"), ("\n", "\\n"), (":", "\\c"), ("#", "\\h")):
        role = F.replace(role, F.lit(a), F.lit(b))
    return role


def _unescape_role(role: Column) -> Column:
    for a, b in (("\\h", "#"), ("\\c", ":"), ("\\n", "\n"), ("\\b", "\\")):
        role = F.replace(role, F.lit(a), F.lit(b))
    return role


def _render(role: Column, body: Column) -> Column:
    return F.concat(F.lit("### "), role, F.lit(":\n"), body, F.lit(END))


def _cut(part: Column) -> Column:
    """Role and text of a turn without its end."""
    at = F.position(F.lit(":\n"), part)
    body = F.substr(part, at + 2)
    bare = F.regexp_like(F.regexp_replace(body, rf"\\+({CONTROL})", " "), F.lit(CONTROL))
    return F.struct(
        _unescape_role(F.substr(part, F.lit(5), at - 5)).alias("role"),
        F.when(~bare, unescape(body)).alias("text"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array<struct<role, text>>."""
    parts = F.split(formatted, END, -1)
    return F.transform(F.slice(parts, 1, F.size(parts) - 1), _cut)


def format_conversations(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, n_turns, formatted, and the spans of ``formatted`` under the loss mask.

    ``loss_spans`` has first (from 0) and end, in code points, of each text of ``loss_roles`` as written.
    """
    source = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    same = lambda c: (F.size(parse(c)) == 1) & (F.element_at(parse(c), 1) == F.struct("role", "text"))
    plain = source.withColumn("plain", _render(F.col("role"), F.col("text")))
    # a plain turn is ambiguous only if it holds a control string, so others need no second parse
    fits = F.when(F.regexp_like(F.concat("role", F.lit("\n"), "text"), F.lit(rf"{CONTROL}|\\|:")), same(F.col("plain"))).otherwise(True)
    turned = plain.withColumn(
        "written", F.when(fits, F.col("plain")).otherwise(_render(_escape_role(F.col("role")), escape(F.col("text"))))
    ).drop("plain")
    length = F.char_length("written")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    end = F.sum(length).over(order.rowsBetween(Window.unboundedPreceding, 0)) - len(END)
    head = F.char_length(F.substring_index("written", ":\n", 1)) + 2
    placed = turned.select(
        "conv_id",
        F.row_number().over(order).alias("n"),
        "role",
        "text",
        "written",
        F.when(F.col("role").isin(*loss_roles), F.struct((end + len(END) - length + head).alias("first"), end.alias("end"))).alias("span"),
    )
    whole = placed.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("n", "role", "text", "written", "span"))).alias("t"),
    )
    formatted = whole.select(
        "conv_id",
        "n_turns",
        F.array_join("t.written", "").alias("formatted"),
        F.filter("t.span", lambda s: s.isNotNull()).alias("loss_spans"),
        F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"),
    )
    back = F.when(parse(F.col("formatted")) == F.col("source"), F.col("formatted"))
    return formatted.select(
        "conv_id",
        "n_turns",
        F.coalesce(back, F.raise_error(F.lit("a conversation does not survive the round trip"))).alias("formatted"),
        "loss_spans",
    )


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from the formatted text and its spans: hashes of the turns and of the text under the loss mask.

    The text is cut in an encoding of four bytes a code point, so that a cut does not walk over what lies before it.
    """
    read = formatted.select("conv_id", "formatted", parse(F.col("formatted")).alias("t"), F.encode("formatted", "UTF-32").alias("wide"), "loss_spans")
    cut = lambda s: unescape(F.decode(F.substr("wide", 4 * s["first"].cast("int") + 1, 4 * (s["end"] - s["first"]).cast("int")), "UTF-32"))
    loss = read.withColumn("loss", F.array_join(F.transform("loss_spans", cut), ""))
    said = F.transform("t", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return loss.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
