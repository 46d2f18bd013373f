"""Chat formatting with a grammar round trip, in DataFrame functions only.

Grammar of the output::

    conversation := header turn*          header := "<chat>" | "<chat esc>"
    turn         := "[INST]" role "\\n" text "[/INST]"      any role but assistant
                  | "<s>" text "</s>"                       assistant; its text is what the loss sees

The parser is deterministic: cut behind every closing mark, then match each piece as a whole. A conversation
is first rendered as it is and parsed again. If the recovered turns differ from the source, its contents
conflict with the grammar, and it is rendered with escapes: backslashes are doubled, and every control string
(and line break in a role) gets a backslash behind its first character. The header tells the reader which of
the two it reads. The escaped form is parsed too, and the job fails loudly if that were ever not identical.

One row is one conversation: rows are gathered by conv_id, which is as large as the conversation itself.

Defined cases: null text and null role are empty strings; rows of one turn number are ordered by role and
text; rows without a turn number come last; repeated rows are repeated turns; a null conv_id is a conversation of its own; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RAW, ESCAPED = "<chat>", "<chat esc>"
CONTROL = ("[INST]", "[/INST]", "<s>", "</s>")
_BEHIND_CLOSING = r"(?<=\[/INST\]|</s>)"
_PROMPT = r"(?s)^\[INST\]([^\n]*)\n(.*)\[/INST\]$"
_ANSWER = r"(?s)^<s>(.*)</s>$"


def escape(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROL:
        c = F.replace(c, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return c


def escape_role(c: Column) -> Column:
    """As ``escape``; a line break becomes a backslash and the letter n, which no other rule writes in a role."""
    return F.replace(escape(c), F.lit("\n"), F.lit("\\n"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, F.lit(r"(?s)\\(.)"), F.lit("$1"))


def unescape_role(c: Column) -> Column:
    # doubled backslashes first, so a line break's n is told from a backslash before an n
    pieces = F.transform(F.split(c, r"\\\\", -1), lambda p: unescape(F.replace(p, F.lit("\\n"), F.lit("\n"))))
    return F.array_join(pieces, "\\")


def render(turns: Column, escaped: bool) -> Column:
    """The whole conversation as one string; ``turns`` is an array of (role, text)."""
    e, r = (escape, escape_role) if escaped else (lambda c: c, lambda c: c)

    def one(t: Column) -> Column:
        return F.when(t["role"] == "assistant", F.concat(F.lit("<s>"), e(t["text"]), F.lit("</s>"))).otherwise(
            F.concat(F.lit("[INST]"), r(t["role"]), F.lit("\n"), e(t["text"]), F.lit("[/INST]")))

    return F.concat(F.lit(ESCAPED if escaped else RAW), F.array_join(F.transform(turns, one), ""))


def parse(formatted: Column) -> Column:
    """Array of (role, text) read from a formatted conversation; a piece that fits no rule is null."""
    escaped = F.startswith(formatted, F.lit(ESCAPED))
    body = F.when(escaped, F.substr(formatted, F.lit(len(ESCAPED) + 1))).otherwise(F.substr(formatted, F.lit(len(RAW) + 1)))
    pieces = F.filter(F.split(body, _BEHIND_CLOSING), lambda p: p != "")
    plain = lambda f, c: F.when(escaped, f(c)).otherwise(c)

    def one(p: Column) -> Column:
        return F.when(F.rlike(p, F.lit(_ANSWER)), F.struct(F.lit("assistant").alias("role"), plain(unescape, F.regexp_extract(p, _ANSWER, 1)).alias("text"))).when(
            F.rlike(p, F.lit(_PROMPT)), F.struct(plain(unescape_role, F.regexp_extract(p, _PROMPT, 1)).alias("role"),
                                                 plain(unescape, F.regexp_extract(p, _PROMPT, 2)).alias("text")))

    return F.transform(pieces, one)


def gather(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns in order, as an array of (role, text)."""
    rows = conversations.select("conv_id", F.struct(F.col("turn").isNull().alias("late"), F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("_t"))
    turns = F.transform(F.array_sort(F.collect_list("_t")), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return rows.groupBy("conv_id").agg(turns.alias("turns"))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, escaped, and the turns read back from the formatted string."""
    g = gather(conversations)
    raw = g.withColumn("_raw", render(F.col("turns"), False)).withColumn("_read", parse(F.col("_raw")))
    chosen = raw.select("conv_id", "turns", (~F.col("_read").eqNullSafe(F.col("turns"))).alias("escaped"), "_raw").withColumn(
        "formatted", F.when(F.col("escaped"), render(F.col("turns"), True)).otherwise(F.col("_raw")))
    read = chosen.select("conv_id", "formatted", "escaped", "turns", parse(F.col("formatted")).alias("_read"))
    same = F.col("_read").eqNullSafe(F.col("turns"))
    return read.select("conv_id", "formatted", "escaped",
                       F.when(same, F.col("_read")).otherwise(F.raise_error(F.lit("a formatted conversation does not read back"))).alias("turns"))


def digests(formatted: DataFrame) -> DataFrame:
    """Counts and digests of what was read back."""
    t = F.col("turns")
    lossy = F.array_join(F.transform(F.filter(t, lambda x: x["role"] == "assistant"), lambda x: x["text"]), "")
    return formatted.select("conv_id", t.alias("turns"), lossy.alias("_loss"), "escaped", F.char_length("formatted").cast("bigint").alias("formatted_chars")).select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length("_loss").cast("bigint").alias("loss_chars"), F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars", "escaped")
