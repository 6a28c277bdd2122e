"""Chat formatting whose output reads back to the same turns, in DataFrame expressions only.

Grammar of a formatted conversation: turns, each START role LF text END LF. Texts that would not read back are escaped:
in every run "<", backslashes, "|" one backslash is added, so that no control string is left, and reading takes one
away. Each rendered turn is reparsed and compared with its source: plain if that is identical, else escaped,
which must be. Line ends, "<" and backslashes in roles are escaped likewise.

Null texts and roles count as empty. Turns are ordered by (turn, role, text), nulls first; repeated rows are turns
of their own; a null conv_id is a conversation. Extra columns are ignored. An empty table gives no rows.
A conversation is one output string, so its turns meet in one row whatever its size; everything else is done per turn
before they meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


#: What stands for a backslash, a line end and "<" in a role.
ROLE_ESCAPES = [("\\", "\\0"), ("\n", "\\1"), ("<", "\\2")]


def escape_role(role: Column) -> Column:
    for plain, safe in ROLE_ESCAPES:
        role = F.replace(role, F.lit(plain), F.lit(safe))
    return role


def unescape_role(role: Column) -> Column:
    for plain, safe in reversed(ROLE_ESCAPES):
        role = F.replace(role, F.lit(safe), F.lit(plain))
    return role


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))


def parts(formatted: Column) -> Column:
    """The strings between the starts of turns."""
    return F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 2147483647)


def parse_part(part: Column) -> Column:
    """struct(role, text) of one part; null where it breaks the grammar."""
    role = F.substring_index(part, "\n", 1)
    rest = F.substring(part, F.char_length(role) + 2, F.char_length(part))
    text = F.substring(rest, F.lit(1), F.char_length(rest) - len(END) - 1)
    fits = F.endswith(rest, F.lit(END + "\n")) & ~F.contains(text, F.lit(END))
    return F.when(fits, F.struct(unescape_role(role).alias("role"), unescape(text).alias("text")))


def render_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, out (the rendered turn), skip and take (its code points outside and under the loss mask)."""
    t = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    t = t.withColumn("safe_role", escape_role(F.col("role"))).withColumn("plain", rendered(F.col("safe_role"), F.col("text")))

    def reads_back(out: Column) -> Column:
        got = parts(out)
        turn = parse_part(F.get(got, F.lit(0)))
        return F.coalesce((F.size(got) == 1) & (turn["role"] == F.col("role")) & (turn["text"] == F.col("text")), F.lit(False))

    t = t.withColumn("body", F.when(reads_back(F.col("plain")), F.col("text")).otherwise(escape(F.col("text"))))
    t = t.withColumn("out", rendered(F.col("safe_role"), F.col("body")))
    t = t.withColumn("out", F.when(reads_back(F.col("out")), F.col("out")).otherwise(F.raise_error(F.lit("a turn does not read back"))))
    learnt = F.when(F.col("role") == "assistant", F.char_length("body")).otherwise(0)
    head = F.lit(len(START) + 1) + F.char_length("safe_role")
    return t.select("conv_id", "turn", "role", "text", "out", head.alias("skip"), learnt.alias("take"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, mask: per turn the code points before its learnt text and those of it, which END and a line end follow."""
    one = F.struct("turn", "role", "text", "out", "skip", "take")
    grouped = render_turns(turns).groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("rows"))
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("rows", lambda r: r["out"]), "").alias("formatted"),
        F.transform("rows", lambda r: F.struct(r["skip"].alias("skip"), r["take"].alias("take"))).alias("mask"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (array of role, text) and learnt (array of the texts under the mask), from the output alone."""
    held = formatted.withColumn("parts", parts(F.col("formatted")))
    under = F.zip_with("parts", "mask", lambda p, m: F.when(m["take"] > 0, unescape(F.substring(p, m["skip"] - len(START) + 1, m["take"]))).otherwise(""))
    return held.select("conv_id", "formatted", F.transform("parts", parse_part).alias("turns"), under.alias("learnt"))


def digests(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of every conversation, read back."""
    got = read_back(format_conversations(turns)).withColumn("learnt", F.array_join("learnt", ""))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return got.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length("learnt").cast("long").alias("loss_chars"),
        F.sha2(F.col("learnt"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
