"""Chat formatting: turn-aligned windows under a token budget, in DataFrame operations."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as Rows, functions as F

from tidemark.llm.mixing import word_count
from tidemark.tables import materialise

#: Control strings whose first character is written as a percent code inside texts.
CONTROLS = ("<|", "</s>", "<s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")
END = "<|end|>\n"
#: Tokens that the marks of a turn count as.
MARKS = 3


@dataclass(frozen=True)
class Window:
    """Parameters: tokens of a window, and the most turns and tokens of earlier turns it repeats."""

    budget: int = 512
    history_turns: int = 2
    history_tokens: int = 128
    target_role: str = "assistant"


def _code(c: str) -> str:
    return f"%{ord(c):02X}"


def escape(text: Column) -> Column:
    """``text`` without control strings; ``unescape`` restores it exactly."""
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(_code(c[0]) + c[1:])), CONTROLS, F.replace(text, F.lit("%"), F.lit("%25")))


def escape_role(role: Column) -> Column:
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(_code(c))), "%|\n<", role)


def unescape(text: Column) -> Column:
    return reduce(lambda t, c: F.replace(t, F.lit(_code(c)), F.lit(c)), "<[|\n%", text)


def _render(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit(END))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def _windows(turns: DataFrame, window: Window) -> DataFrame:
    """``conv_id, window, n_context, shown`` from numbered turns (``conv_id, i, tokens, upto, raw_role``); ``shown`` numbers a window's turns in order.

    ``upto`` is the prefix sum of tokens, so what any run of turns costs is one difference. The turns of a conversation come here without their texts.
    """
    sums = F.transform(F.array_sort(F.collect_list(F.struct("i", "upto"))), lambda t: t["upto"])
    first = F.max(F.when(F.col("i") == 1, F.struct((F.col("raw_role") == "system").cast("int").alias("system"), "tokens"))).alias("first")
    conv = turns.groupBy("conv_id").agg(sums.alias("sums"), first)
    conv = conv.select("conv_id", "sums", F.size("sums").alias("n"), F.col("first.system").alias("system"), (F.col("first.system") * F.col("first.tokens")).alias("fixed"))
    conv = conv.withColumn("room", F.greatest(F.lit(1), window.budget - window.history_tokens - F.col("fixed")))
    before = lambda i: F.coalesce(F.get("sums", i - 2), F.lit(0))  # tokens of the turns ahead of turn i
    state = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).cast("long").alias("base"))
    step = lambda a, i: F.when(
        (F.size(a["starts"]) == 0) | (F.get("sums", i - 1) - a["base"] > F.col("room")), F.struct(F.concat(a["starts"], F.array(i)).alias("starts"), before(i).alias("base"))
    ).otherwise(a)
    own = F.when(F.col("n") > F.col("system"), F.sequence(F.col("system") + 1, F.col("n"))).otherwise(F.array().cast("array<int>"))
    conv = conv.withColumn("starts", F.aggregate(own, state, step, lambda a: a["starts"]))
    conv = conv.withColumn("starts", F.when(F.size("starts") == 0, F.array(F.col("n") + 1)).otherwise(F.col("starts")))

    def build(begin: Column, w: Column) -> Column:
        last = F.coalesce(F.get("starts", w + 1) - 1, F.col("n"))
        low = F.greatest(F.col("system") + 1, begin - window.history_turns)
        back = F.array_min(F.filter(F.sequence(low, begin), lambda i: before(begin) - before(i) <= window.history_tokens))
        repeated = F.when(w == 0, F.lit(0)).otherwise(F.col("system")) + begin - back
        run = F.when(back <= last, F.sequence(back, last)).otherwise(F.array().cast("array<int>"))
        return F.struct(w.alias("window"), repeated.alias("n_context"), F.concat(F.when(F.col("system") == 1, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")), run).alias("shown"))

    return conv.select("conv_id", F.explode(F.transform("starts", build)).alias("w")).select("conv_id", "w.*")


def format_windows(turns: DataFrame, window: Window = Window()) -> DataFrame:
    """``conv_id, window, n_context, n_tokens, formatted, loss`` for every window of every conversation.

    Turns stand in order of turn, role and text (null turns first; null role or text is
    empty, rows that repeat are turns of their own, null ``conv_id`` is one conversation). A first turn of role system is
    kept in every window. Other turns fill windows greedily: from the prefix sums of turn tokens
    a window takes turns while they fit ``budget`` less the system turn and ``history_tokens``; a
    turn larger than that has a window of its own. Before them stand the last turns of earlier
    windows, ``history_turns`` and ``history_tokens`` of them at most. The first ``n_context`` turns of a
    window are repeats. ``loss`` lists the spans (code points, end exclusive) of the
    target role's texts among the others: each such text once over all windows. An empty table gives an empty one; other columns are
    not read. Prefix sums are window sums over rows; only they, not texts, are gathered for each conversation. Texts
    meet their windows by conversation and number of the turn, so no task holds the texts of a long conversation.
    """
    text = F.coalesce("text", F.lit(""))
    role = F.coalesce("role", F.lit(""))
    order = Rows.partitionBy("conv_id").orderBy("turn", "raw_role", "raw")
    slim = turns.select("conv_id", "turn", role.alias("raw_role"), text.alias("raw"))
    slim = slim.withColumns({"i": F.row_number().over(order), "tokens": word_count(F.col("raw")) + MARKS})
    slim = slim.withColumn("upto", F.sum("tokens").over(order.rowsBetween(Rows.unboundedPreceding, 0)))
    numbered = materialise(slim.select("conv_id", "i", "tokens", "upto", "raw_role", "raw"))
    windows = _windows(numbered, window).select(F.col("conv_id").alias("_conv"), "window", "n_context", F.posexplode("shown").alias("place", "_i"))
    met = windows.join(numbered, F.col("_conv").eqNullSafe(F.col("conv_id")) & (F.col("_i") == F.col("i")))
    turn = F.struct("place", escape_role(F.col("raw_role")).alias("role"), escape(F.col("raw")).alias("text"), "tokens", (F.col("raw_role") == window.target_role).alias("target"))
    windows = met.groupBy("conv_id", "window", "n_context").agg(F.array_sort(F.collect_list(turn)).alias("shown"))
    windows = windows.withColumn("sizes", F.transform("shown", lambda t: F.length(_render(t))))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    starts = F.aggregate("sizes", empty, lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["starts"], F.array(a["at"])).alias("starts")), lambda a: a["starts"])
    windows = windows.withColumn("starts", starts)

    def span(t: Column, i: Column) -> Column:
        begin = F.get("starts", i) + F.length(t["role"]) + 5
        return F.struct(begin.alias("start"), (begin + F.length(t["text"])).alias("end"), (t["target"] & (i >= F.col("n_context"))).alias("use"))

    loss = F.transform(F.filter(F.transform("shown", span), lambda s: s["use"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return windows.select(
        "conv_id",
        "window",
        "n_context",
        _sum(F.transform("shown", lambda t: t["tokens"])).alias("n_tokens"),
        F.array_join(F.transform("shown", _render), "").alias("formatted"),
        loss.alias("loss"),
    )


def read_turns(formatted: Column, n_context: Column) -> Column:
    """The turns of a window read back from its text, ``array<struct<role,text>>``, without the repeated ones."""
    pieces = F.split(formatted, r"<\|end\|>\n")
    own = F.slice(pieces, n_context + 1, F.size(pieces) - 1 - n_context)

    def parse(piece: Column) -> Column:
        role = F.substring_index(piece, "|>\n", 1)
        return F.struct(unescape(F.substr(role, F.lit(3))).alias("role"), unescape(F.substr(piece, F.length(role) + 4)).alias("text"))

    return F.transform(own, parse)


def read_loss(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, in order, unescaped."""
    return F.transform(loss, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["end"] - s["start"])))


def digests(windows: DataFrame) -> DataFrame:
    """Per conversation, from its windows' texts alone: counts and digests of what they hold. Null ``conv_id`` is one conversation, no windows give no rows.

    A digest covers a whole conversation, so here, and only here, its texts are joined in one row.
    """
    said = F.array_join(F.transform(F.col("turns"), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = windows.withColumn("turns", read_turns(F.col("formatted"), F.col("n_context"))).select(
        "conv_id",
        F.struct("window", F.size("turns").alias("n"), said.alias("said"), F.array_join(read_loss(F.col("formatted"), F.col("loss")), "").alias("learnt"), F.length("formatted").alias("chars")).alias("w"),
    )
    joined = read.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("w"))
    learnt = F.array_join("w.learnt", "")
    return joined.select(
        "conv_id",
        _sum(F.col("w.n")).alias("n_turns"),
        F.sha2(F.array_join("w.said", ""), 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt, 256).alias("loss_sha256"),
        _sum(F.col("w.chars")).alias("formatted_chars"),
        F.size("w").cast("long").alias("n_windows"),
    )
