"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are context, and
only its text is under the loss mask.  A conversation that ends otherwise, or has no
assistant turn, gives one more example without a target, so that no turn is lost.

A turn is written ``<|im_start|>role<|im_sep|>text<|im_end|>``.  A control string inside
a role or text, of this template or of other common ones, gets a backslash after its
first character, one more than it has; reading takes one away.  So escaped texts never
hold a control string, and reading gives back the very text.

A conversation's turns are gathered once, already formatted; each example is cut from
that one string as it is emitted, so memory is bounded by one conversation and not by its
examples.  A conversation is one text to its digest, so it must fit in one row (2 GB).

Defined cases: null text and null role are empty; turns are ordered by turn, then role,
then text, null turns first; repeated rows are repeated turns; null conv_id is a
conversation of its own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Control strings that texts may hold: the template's and those of other common templates.
CONTROL = (START, SEP, END, "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")
_QUOTE = str.maketrans({c: "\\" + c for c in "|[]()/<>"})
_TAILS = "|".join(x[1:].translate(_QUOTE) for x in sorted(CONTROL, key=len, reverse=True))


def escape(text: Column) -> Column:
    """Texts without control strings; ``unescape`` gives the text back."""
    return F.regexp_replace(text, rf"([<\[])(\\*)(?={_TAILS})", r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)(?={_TAILS})", "$1$2")


def expand(turns: DataFrame, trainable: str = "assistant") -> DataFrame:
    """Examples ``(conv_id, example, text, loss_start, loss_length, last)`` of ``turns(conv_id, turn, role, text)``.

    ``text`` is the formatted example; the mask is ``loss_length`` code points from ``loss_start`` (0-based;
    length -1: nothing is trainable); ``last`` marks the example that holds the whole conversation.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    head, body = F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP)), escape(F.col("text"))
    order = F.struct("turn", "role", "text")
    rows = rows.select("conv_id", F.struct(order.alias("order"), F.length(head).alias("head"), F.length(body).alias("body"), F.concat(head, body, F.lit(END)).alias("line"), (F.col("role") == trainable).alias("aim")).alias("row"))
    talks = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    talks = talks.select("conv_id", F.array_join(F.transform("rows", lambda r: r["line"]), "").alias("all"), F.transform("rows", lambda r: F.struct(r["head"].alias("head"), r["body"].alias("body"), r["aim"].alias("aim"))).alias("sizes"))
    # Where each turn's text starts and ends; one pass with a running length.
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int,end:int>>").alias("aims"))

    def step(state: Column, turn: Column) -> Column:
        start = state["at"] + turn["head"]
        end = start + turn["body"] + len(END)
        aim = F.struct(start.alias("start"), turn["body"].alias("length"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(turn["aim"], F.array_append(state["aims"], aim)).otherwise(state["aims"]).alias("aims"))

    talks = talks.withColumn("state", F.aggregate("sizes", zero, step))
    end, aims = F.col("state.at"), F.col("state.aims")
    rest = F.struct(end.alias("start"), F.lit(-1).alias("length"), end.alias("end"))
    aims = F.when((F.size(aims) == 0) | (F.element_at(aims, -1)["end"] < end), F.array_append(aims, rest)).otherwise(aims)
    cut = talks.select("conv_id", "all", end.alias("end"), F.posexplode(aims).alias("example", "aim"))
    return cut.select("conv_id", F.col("example").cast("long").alias("example"), F.substring("all", F.lit(1), F.col("aim.end")).alias("text"), F.col("aim.start").cast("long").alias("loss_start"), F.col("aim.length").cast("long").alias("loss_length"), (F.col("aim.end") == F.col("end")).alias("last"))


def target(text: Column, start: Column, length: Column) -> Column:
    """The unescaped text under the mask; null if nothing is trainable."""
    return F.when(length >= 0, unescape(F.substring(text, start.cast("int") + 1, length.cast("int"))))


def read_turns(text: Column) -> Column:
    """Turns ``array<struct<role,text>>`` of a formatted example."""
    lines = F.split(F.regexp_replace(text, r"<\|im_end\|>\z", ""), r"<\|im_end\|>")
    part = lambda line, k: unescape(F.split(F.substr(line, F.lit(len(START) + 1)), r"<\|im_sep\|>")[k])
    return F.transform(lines, lambda line: F.struct(part(line, 0).alias("role"), part(line, 1).alias("text")))


def digest(examples: DataFrame) -> DataFrame:
    """What a reader of the examples finds: one row ``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars)`` per conversation."""
    aim = target(F.col("text"), F.col("loss_start"), F.col("loss_length"))
    rows = examples.select("conv_id", F.when(aim.isNotNull(), F.struct("example", aim.alias("target"))).alias("target"), F.length("text").cast("long").alias("chars"), F.when(F.col("last"), F.col("text")).alias("whole"))
    talks = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("target")).alias("targets"), F.sum("chars").alias("formatted_chars"), F.collect_list("whole").alias("whole"))
    talks = talks.withColumn("turns", read_turns(F.element_at("whole", 1))).withColumn("loss", F.array_join(F.transform("targets", lambda t: t["target"]), ""))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return talks.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
