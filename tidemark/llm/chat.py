"""Chat formatting with a grammar round trip, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The template's control strings (fixed values). Roles other than these three stand between [ROLE] and [/ROLE].
#: user: [INST]text[/INST]   system: [SYS]text[/SYS]   assistant: <s>text</s>   other: [ROLE]role[/ROLE]<s>text</s>
_ANGLE = r"</?s>"
_SQUARE = r"\[/?(?:INST|SYS|ROLE)\]"
CONTROL = f"{_ANGLE}|{_SQUARE}"


def escape(text):
    """Puts one backslash more behind the first sign of each control string, so that no raw one is left."""
    text = F.regexp_replace(text, r"<(\\*/?s>)", r"<\\$1")
    return F.regexp_replace(text, r"\[(\\*/?(?:INST|SYS|ROLE)\])", r"[\\$1")


def unescape(text):
    """Takes one backslash from each escaped control string."""
    text = F.regexp_replace(text, r"<\\(\\*/?s>)", "<$1")
    return F.regexp_replace(text, r"\[\\(\\*/?(?:INST|SYS|ROLE)\])", r"[$1")


def _render_turn(turn):
    role, text = turn["role"], turn["text"]
    wrap = lambda a, x, b: F.concat(F.lit(a), x, F.lit(b))
    return (
        F.when(role == "user", wrap("[INST]", text, "[/INST]"))
        .when(role == "system", wrap("[SYS]", text, "[/SYS]"))
        .when(role == "assistant", wrap("<s>", text, "</s>"))
        .otherwise(F.concat(wrap("[ROLE]", role, "[/ROLE]"), wrap("<s>", text, "</s>")))
    )


def render(turns):
    return F.concat_ws("", F.transform(turns, _render_turn))


def _parts(formatted):
    """The turns of a rendered text as they stand there: every turn ends in a closing mark of a text."""
    return F.filter(F.split(formatted, r"(?<=\[/INST\])|(?<=\[/SYS\])|(?<=</s>)"), lambda x: x != "")


def _turn(x):
    body = lambda a, b: unescape(F.substring(x, F.lit(a + 1), F.length(x) - (a + b)))
    turn = lambda role, text: F.struct(role.alias("role"), text.alias("text"))
    named = F.locate("[/ROLE]<s>", x)
    return (
        F.when(x.startswith("[INST]"), turn(F.lit("user"), body(6, 7)))
        .when(x.startswith("[SYS]"), turn(F.lit("system"), body(5, 6)))
        .when(x.startswith("<s>"), turn(F.lit("assistant"), body(3, 4)))
        .otherwise(
            turn(
                unescape(F.substring(x, F.lit(7), named - 7)),
                unescape(F.substring(x, named + 10, F.length(x) - (named + 13))),
            )
        )
    )


def parse(formatted):
    """Turns from a rendered text: each goes from an opening mark to the mark that closes it.

    Total: text outside the grammar gives other turns than were rendered, never an error.
    """
    return F.transform(_parts(formatted), _turn)


def loss_spans(formatted):
    """(start, end) in code points of formatted: the texts of assistant turns, between their marks, as they stand there."""
    none = F.array().cast("array<struct<start: int, end: int>>")

    def step(held, x):
        end = held["at"] + F.length(x)
        span = F.array(F.struct((held["at"] + 3).alias("start"), (end - 4).alias("end")))
        return F.struct(end.alias("at"), F.when(x.startswith("<s>"), F.concat(held["spans"], span)).otherwise(held["spans"]).alias("spans"))

    return F.aggregate(_parts(formatted), F.struct(F.lit(0).alias("at"), none.alias("spans")), step)["spans"]


def under(formatted, spans):
    """The text under a mask of spans, piece by piece and unescaped."""
    return F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"])))


def format_chats(rows: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, turns (parsed back from formatted), loss_spans, escaped, identical.

    rows: conv_id, turn, role, text, one row a turn; other columns are ignored. Turns stand in order of turn, null
    last, then role and text, so ties and repeated rows keep every row in a fixed order. Null text and null role
    are empty strings; rows with null conv_id form one conversation. Each conversation is rendered as it is and
    parsed again; where the recovered turns differ from the source, the turns that hold control strings, raw or
    escaped, are escaped and it is rendered again; if that still differs (roles that look like control strings),
    every turn and role is. identical says whether the final text gives back the source exactly.

    loss_spans is the loss mask: ranges of code points of formatted that hold assistant texts, in order; under() gives
    the texts themselves. An empty table gives an empty one.

    A conversation is a row of the result and has to fit into one; no other group is gathered.
    """
    order = F.struct(F.col("turn").isNull().alias("last"), F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(order)).alias("_sorted"))
    pair = lambda role, text: F.struct(role.alias("role"), text.alias("text"))
    source = F.transform("_sorted", lambda t: pair(t["role"], t["text"]))
    plain = grouped.select("conv_id", source.alias("_source")).withColumn("_text", render(F.col("_source")))
    escape_all = F.transform("_source", lambda t: pair(F.when(t["role"].isin("user", "system", "assistant"), t["role"]).otherwise(escape(t["role"])), escape(t["text"])))
    first = plain.withColumn("_same", parse(F.col("_text")) == F.col("_source"))
    final = first.select("conv_id", "_source", F.when(F.col("_same"), F.col("_text")).otherwise(render(escape_all)).alias("formatted"), (~F.col("_same")).alias("escaped"))
    back = final.withColumn("turns", parse(F.col("formatted"))).withColumn("loss_spans", loss_spans(F.col("formatted")))
    return back.select("conv_id", "formatted", "turns", "loss_spans", "escaped", (F.col("turns") == F.col("_source")).alias("identical"))
