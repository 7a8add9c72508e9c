"""Chat formatting with relational operations only.

The turns of a conversation are collected as structs, sorted, cut into runs of one role
and written out. A run is::

    <|role|>
    text of its first turn<|next|>text of its second turn<|end|>

Control strings inside roles and texts (``CONTROLS``) get a backslash after their first
character, and backslashes are doubled, so no text can imitate a mark, and
``read_back`` restores every turn exactly. The loss mask is a list of [start, stop)
character spans of the formatted string, one per turn of the learned role.

Nulls and odd input: null texts and roles are empty; rows with a null conversation id
form one conversation; turns are ordered by number, then role, then text, null first, so
ties and repeated rows have one result and repeated rows stay repeated; an empty text is
a turn with an empty span; an empty table gives an empty result; other columns are not
read. A conversation becomes one row, so it has to fit into one: the method collects it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: What a text must not be able to say by itself: marks of this template and of other common ones.
CONTROLS = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
NEXT, END = "<|next|>", "<|end|>\n"
LEARNED = "assistant"


def escaped(text: Column) -> Column:
    """``text`` without any control string; ``unescaped`` is its inverse."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROLS:
        text = F.replace(text, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return text


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_conversations(
    turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learned: str = LEARNED
) -> DataFrame:
    """(``key``, formatted, loss_spans array<struct<start, stop>>), one row per conversation."""
    empty = F.lit("")
    rows = turns.select(
        F.col(key).alias("key"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(role, empty).alias("role"), F.coalesce(text, empty).alias("text")).alias("t"),
    )
    collected = rows.groupBy("key").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    written = F.transform("turns", lambda t: F.struct(escaped(t["role"]).alias("role"), escaped(t["text"]).alias("text")))
    # First places of the runs; the role of the turn before stands beside each turn.
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice(F.transform("turns", lambda t: t["role"]), 1, F.size("turns") - 1))
    fresh = F.transform(F.zip_with("turns", before, lambda t, b: ~t["role"].eqNullSafe(b)), lambda new, i: F.when(new, i))
    starts = F.filter(fresh, lambda i: i.isNotNull())
    return (
        collected.select("key", written.alias("turns"), starts.alias("starts"))
        .select("key", "turns", F.zip_with("starts", F.concat(F.slice("starts", 2, F.size("starts")), F.array(F.size("turns"))), lambda a, b: F.struct(a.alias("a"), b.alias("b"))).alias("runs"))
        .select(
            "key",
            F.transform(
                "runs",
                lambda r: F.struct(
                    F.element_at("turns", r["a"] + 1)["role"].alias("role"),
                    F.transform(F.slice("turns", r["a"] + 1, r["b"] - r["a"]), lambda t: t["text"]).alias("texts"),
                ),
            ).alias("runs"),
        )
        .select(F.col("key").alias(key), _formatted("runs").alias("formatted"), _loss_spans("runs", learned).alias("loss_spans"))
    )


def _head(run: Column) -> Column:
    return F.concat(F.lit("<|"), run["role"], F.lit("|>\n"))


def _formatted(runs: str) -> Column:
    return F.array_join(F.transform(runs, lambda r: F.concat(_head(r), F.array_join(r["texts"], NEXT), F.lit(END))), "")


def _loss_spans(runs: str, learned: str) -> Column:
    """Adds up the lengths of the pieces; the spans of the learned role are kept."""
    span = "array<struct<start:int,stop:int>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(span).alias("spans"))

    def add_run(acc: Column, run: Column) -> Column:
        first = F.struct((acc["at"] + F.length(_head(run))).alias("at"), acc["spans"].alias("spans"))
        wanted = run["role"] == F.lit(learned)

        def add_text(acc: Column, text: Column) -> Column:
            stop = acc["at"] + F.length(text)
            spans = F.when(wanted, F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("start"), stop.alias("stop"))))).otherwise(acc["spans"])
            return F.struct((stop + len(NEXT)).alias("at"), spans.alias("spans"))

        return F.aggregate(
            run["texts"], first, add_text, lambda a: F.struct((a["at"] - len(NEXT) + len(END)).alias("at"), a["spans"].alias("spans"))
        )

    return F.aggregate(runs, start, add_run, lambda a: a["spans"])


def read_back(formatted: str = "formatted") -> Column:
    """array<struct<role, text>> of the turns that a formatted string holds, in order."""
    runs = F.filter(F.split(formatted, r"<\|end\|>\n"), lambda r: r != "")
    body = lambda r: F.substring_index(r, "|>\n", 1)
    turns = F.transform(
        runs,
        lambda r: F.transform(
            F.split(F.substr(r, F.length(body(r)) + F.lit(4)), r"<\|next\|>"),
            lambda t: F.struct(unescaped(F.substr(body(r), F.lit(3))).alias("role"), unescaped(t).alias("text")),
        ),
    )
    return F.flatten(turns)


def loss_texts(formatted: str = "formatted", spans: str = "loss_spans") -> Column:
    """The unescaped texts under the loss mask, in order."""
    return F.transform(spans, lambda s: unescaped(F.substr(F.col(formatted), s["start"] + 1, s["stop"] - s["start"])))
