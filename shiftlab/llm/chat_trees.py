"""Chat formatting from reply trees.

Messages know their parent; each root-to-leaf path is one possible
conversation.  Self-joins with doubling strides enumerate the paths from their
leaves in as many rounds as the depth has binary digits; the branches of a
conversation are ranked by score, and each chosen one is formatted as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftlab.llm.store import written

BEGIN, END = "<s>", "</s>\n"
ASSISTANT = "assistant"
#: Characters of control strings, and how a text writes them; undone in the opposite order.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), ("]", "&#93;"))
TURN = r"(?s)^<s>\[([^\]]*)\] (.*)$"


def escaped(text: Column) -> Column:
    """The text without any control string; :func:`unescaped` gives it back."""
    for raw, written_as in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(written_as))
    return text


def unescaped(text: Column) -> Column:
    for raw, written_as in reversed(ESCAPES):
        text = F.replace(text, F.lit(written_as), F.lit(raw))
    return text


def paths(messages: DataFrame) -> DataFrame:
    """(conv, leaf, node, up) for each message ``node`` that is ``up`` steps above ``leaf``.

    ``messages`` has conv, node and parent (null, or a node that the
    conversation doesn't have: a root).  Only leaves that reach a root count, so
    a cycle has no path.  With strides 1, 2, 4, ... the set of ancestors nearer
    than the stride joins the table of jumps of that stride.
    """
    nodes = messages.select("conv", "node", "parent")
    known = nodes.select("conv", F.col("node").alias("parent")).distinct()
    jump = nodes.join(known, ["conv", "parent"]).select("conv", "node", F.col("parent").alias("to")).where("node <> to")
    jump = written(jump, "jumps")
    parents = jump.select("conv", F.col("to").alias("node")).distinct()
    size = nodes.groupBy("conv").agg(F.countDistinct("node").alias("n"))
    longest = size.agg(F.max("n")).first()[0] or 0
    found = (nodes.select("conv", "node").distinct().join(parents, ["conv", "node"], "left_anti")
             .select("conv", F.col("node").alias("leaf"), "node", F.lit(0).alias("up")))
    stride = 1
    while stride < longest:
        step = found.join(jump, ["conv", "node"]).select("conv", "leaf", F.col("to").alias("node"),
                                                         (F.col("up") + stride).alias("up"))
        found = written(found.unionByName(step), "paths")
        ahead = jump.select("conv", F.col("node").alias("to"), F.col("to").alias("far"))
        jump = written(jump.join(ahead, ["conv", "to"]).select("conv", "node", F.col("far").alias("to")), "jumps")
        stride *= 2
    # A path longer than the conversation has gone round a cycle.
    round_ = (found.join(size, "conv").where("up >= n").select("conv", "leaf").distinct()
              .unionByName(found.groupBy("conv", "leaf").agg(F.count("*").alias("c"), F.countDistinct("node").alias("d"))
                           .where("c > d").select("conv", "leaf")))
    return found.join(round_.distinct(), ["conv", "leaf"], "left_anti")


def conversations(messages: DataFrame, *, conv: str = "conv_id", node: str = "node", parent: str = "parent",
                  score: str = "score", role: str = "role", text: str = "text", branches: int = 1) -> DataFrame:
    """(``conv``, branch, leaf, branch_score, n_turns, formatted, loss_spans): the ``branches`` best paths of
    each conversation, formatted.

    A branch's score is the mean score of its messages (null counts 0); ties go
    to the longer path, then to the least leaf.  A turn is
    ``<s>[role] text</s>`` and a line end; control characters inside roles and
    texts are escaped reversibly.  ``loss_spans`` are the (start, end) code
    points of the assistant texts in ``formatted``.  Null roles and texts are
    empty; a message given twice counts once, its least (role, text) first;
    messages without conversation are one conversation, whose ``conv`` is null;
    messages without node are left out; an empty table gives no rows.  Only columns
    named here are read.
    """
    # Conversations go by their text behind a mark, so that those without one meet in joins, too.
    key = F.when(F.col(conv).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(conv).cast("string")))
    m = (messages.select(key.alias("conv"), F.col(node).alias("node"), F.col(parent).alias("parent"),
                         F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("score"),
                         F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
         .where("node IS NOT NULL")
         .groupBy("conv", "node").agg(F.min_by(F.struct("parent", "score", "role", "text"),
                                               F.struct("role", "text", "score", "parent")).alias("m"))
         .select("conv", "node", "m.*"))
    m = written(m, "messages")
    steps = written(paths(m), "paths")
    ranked = (steps.join(m.select("conv", "node", "score"), ["conv", "node"])
              .groupBy("conv", "leaf").agg(F.avg("score").alias("branch_score"), F.count("*").alias("n_turns"))
              .withColumn("branch", F.row_number().over(Window.partitionBy("conv").orderBy(
                  F.desc("branch_score"), F.desc("n_turns"), "leaf")))
              .where(F.col("branch") <= branches))
    turns = steps.join(ranked, ["conv", "leaf"]).join(m.select("conv", "node", "role", "text"), ["conv", "node"])
    one = F.struct((-F.col("up")).alias("place"), F.col("role"),
                   F.concat(F.lit(BEGIN + "["), escaped(F.col("role")), F.lit("] ")).alias("head"),
                   escaped(F.col("text")).alias("body"))
    whole = turns.groupBy("conv", "branch", "leaf", "branch_score", "n_turns").agg(
        F.array_sort(F.collect_list(one)).alias("turns"))
    formatted = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))))
    spans = "array<struct<start:int,end:int>>"

    def place(acc, t):
        start = acc["at"] + F.length(t["head"])
        end = start + F.length(t["body"])
        mine = F.when(t["role"] == ASSISTANT, F.array(F.struct(start.alias("start"), end.alias("end"))))
        return F.struct((end + len(END)).alias("at"),
                        F.concat(acc["out"], F.coalesce(mine, F.array().cast(spans))).alias("out"))

    loss = F.aggregate("turns", F.struct(F.lit(0).alias("at"), F.array().cast(spans).alias("out")), place, lambda a: a["out"])
    named = F.when(F.col("conv") != "", F.substr("conv", F.lit(2)).cast(messages.schema[conv].dataType))
    return whole.select(named.alias(conv), "branch", "leaf", "branch_score", "n_turns",
                        formatted.alias("formatted"), loss.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""
    parts = F.split(formatted, END, -1)
    parts = F.slice(parts, 1, F.size(parts) - 1)
    return F.transform(parts, lambda p: F.struct(
        unescaped(F.regexp_extract(p, TURN, 1)).alias("role"), unescaped(F.regexp_extract(p, TURN, 2)).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped and joined with nothing between."""
    return F.concat_ws("", F.transform(spans, lambda s: unescaped(
        F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))))
