"""Chat formatting of reply trees, in DataFrame operations only (operator 2).

Messages form trees by their parent.  Root-to-leaf paths are enumerated by iterative self-joins that double their
reach: the k-th join links each message with its 2**k-th ancestor and adds up the scores between, so that after
log2(n) joins every leaf knows the score of its whole path; paths of a tree are ranked by that, and only the chosen
leaves then take all their ancestors, each exactly once, in as many joins.  Each chosen path becomes one conversation::

    <|turn|>role
    text<|end|>

Control strings inside roles and texts are escaped reversibly: a backslash after their first sign, one more if
there are some already.  ``loss`` lists the stretches (code points) of assistant texts, markers excluded.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm._spark import Workspace

TURN, END = "<|turn|>", "<|end|>"
#: Strings that must not appear in a text as they are: the template's own and the usual ones of other templates.
CONTROL = (TURN, END, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def _tails(control: tuple[str, ...]) -> list[tuple[str, str]]:
    """(first sign, pattern of the rest of the control strings that begin with it)."""
    return [(c, "|".join(re.escape(x[1:]) for x in control if x[0] == c)) for c in sorted({x[0] for x in control})]


def escaped(text: Column, control: tuple[str, ...] = CONTROL) -> Column:
    for c, rest in _tails(control):
        text = F.regexp_replace(text, rf"{re.escape(c)}(\\*)({rest})", rf"{re.escape(c)}\\$1$2")
    return text


def unescaped(text: Column, control: tuple[str, ...] = CONTROL) -> Column:
    for c, rest in reversed(_tails(control)):
        text = F.regexp_replace(text, rf"{re.escape(c)}\\(\\*)({rest})", rf"{re.escape(c)}$1$2")
    return text


def escaped_role(role: Column) -> Column:
    """A role takes one line: backslash and newline are spelt out before control strings are escaped."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def unescaped_role(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def reply_paths(messages: DataFrame, work: Workspace, best: int | None = 1) -> DataFrame:
    """(tree, leaf, rank, node, depth): the messages of the ``best`` root-to-leaf paths of each tree (all with None).

    ``messages`` has tree, node (unique in its tree), parent (null, or not in the tree: a root) and score (null: 0), no
    null tree or node.  Paths rank by the sum of their scores, then by the smaller leaf.  Replies in a circle raise an
    error, as no path leads to them from a root.
    """
    nodes = messages.select("tree", F.col("node").alias("parent"))
    score = F.coalesce(F.col("score").cast("double"), F.lit(0.0))
    linked = messages.join(nodes.withColumn("above", F.col("parent")), ["tree", "parent"], "left")
    # above: the ancestor ``reach`` messages up (null beyond the root); total and size: what the messages below it add up to
    step = work.write(linked.select("tree", "node", "above", score.alias("total"), F.lit(1).cast("long").alias("size")), "step-0")
    levels, reach, most = [], 1, messages.count()
    while not step.where("above is not null").isEmpty():
        if reach > most:
            raise ValueError("replies go in a circle")
        levels.append((reach, step))
        far = step.select("tree", F.col("node").alias("above"), F.col("above").alias("beyond"), F.col("total").alias("more"), F.col("size").alias("longer"))
        moved = step.where("above is not null").join(far, ["tree", "above"])
        moved = moved.select("tree", "node", F.col("beyond").alias("above"), (F.col("total") + F.col("more")).alias("total"), (F.col("size") + F.col("longer")).alias("size"))
        step = work.write(moved.unionByName(step.where("above is null")), f"step-{len(levels)}")
        reach *= 2
    replied = messages.where("parent is not null").select("tree", F.col("parent").alias("node")).distinct()
    ranked = step.join(replied, ["tree", "node"], "left_anti").withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), "node")))
    if best is not None:
        ranked = ranked.where(F.col("rank") <= best)
    chosen = work.write(ranked.select("tree", F.col("node").alias("leaf"), "rank", "size"), "chosen")
    paths = chosen.select("tree", "leaf", "rank", F.col("leaf").alias("node"), (F.col("size") - 1).alias("depth"))
    for reach, step in reversed(levels):
        up = step.where("above is not null").select("tree", "node", "above")
        more = paths.join(up, ["tree", "node"]).select("tree", "leaf", "rank", F.col("above").alias("node"), (F.col("depth") - reach).alias("depth"))
        paths = work.write(paths.unionByName(more), f"paths-{reach}")
    return paths


def format_paths(messages: DataFrame, paths: DataFrame) -> DataFrame:
    """(tree, leaf, rank, formatted, loss): each path as one conversation; null roles and texts count as empty."""
    said = paths.join(messages.select("tree", "node", "role", "text"), ["tree", "node"])
    role, text = escaped_role(F.coalesce("role", F.lit(""))), escaped(F.coalesce("text", F.lit("")))
    turns = said.select("tree", "leaf", "rank", "depth", (F.col("role") == "assistant").alias("scored"), F.concat(F.lit(TURN), role, F.lit("\n")).alias("head"), text.alias("body"))
    before = Window.partitionBy("tree", "leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("head") + F.length("body") + len(END) + 1
    turns = turns.withColumn("start", F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("head"))
    parts = F.array_sort(F.collect_list(F.struct("depth", "start", "scored", "head", "body")))
    grouped = turns.groupBy("tree", "leaf", "rank").agg(parts.alias("turns"))
    return grouped.select(
        "tree", "leaf", "rank",
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END + "\n"))), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["scored"]), lambda t: F.struct(t["start"].alias("start"), (t["start"] + F.length(t["body"])).alias("end"))).alias("loss"),
    )


def read_turns(formatted: Column) -> Column:
    """The (role, text) turns of a formatted conversation, unescaped."""
    heads = F.filter(F.split(formatted, re.escape(TURN)), lambda _, i: i > 0)

    def turn(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        text = F.substring(part, F.length(role) + 2, F.length(part) - F.length(role) - (len(END) + 2))
        return F.struct(unescaped_role(role).alias("role"), unescaped(text).alias("text"))

    return F.transform(heads, turn)


def read_loss(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    return F.transform(loss, lambda s: unescaped(F.substring(formatted, s["start"] + 1, s["end"] - s["start"])))


def format_conversations(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation of a linear table: id, ``formatted`` and ``loss``.

    A conversation is one row of the result and one sorted group, texts of any length included.

    Each row replies to the one before it in the order of its turn (nulls first, then role, text); repeated rows and
    turns stay.  Rows with a null id are one conversation with null id.  An empty table gives an empty result; other
    columns are not read.
    """
    work = Workspace(rows.sparkSession, "chat")
    key = F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit(""))
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    messages = rows.select(key.alias("tree"), F.col(id_col).alias("own"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    messages = messages.withColumn("node", F.row_number().over(order))
    messages = work.write(messages.select("tree", "own", "node", (F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text"), "messages")
    done = format_paths(messages, reply_paths(messages, work, best=1))
    return done.join(messages.where("node = 1").select("tree", "own"), "tree").select(F.col("own").alias(id_col), "formatted", "loss")


def format_trees(messages: DataFrame, best: int | None = 1) -> DataFrame:
    """(tree_id, leaf_id, rank, formatted, loss) of the ``best`` paths of each reply tree.

    ``messages``: tree_id, message_id, parent_id, role, text, score.  Rows with null tree or message id take no part, of
    rows with the same ids the one with the largest (parent, role, text, score) counts; other columns are not read.
    """
    work = Workspace(messages.sparkSession, "chat")
    rest = F.struct(F.col("parent_id").alias("parent"), "role", "text", F.col("score").cast("double").alias("score"))
    one = messages.where("tree_id is not null and message_id is not null").groupBy(F.col("tree_id").alias("tree"), F.col("message_id").alias("node")).agg(F.max(rest).alias("m"))
    one = work.write(one.select("tree", "node", "m.*"), "messages")
    return format_paths(one, reply_paths(one, work, best)).select(F.col("tree").alias("tree_id"), F.col("leaf").alias("leaf_id"), "rank", "formatted", "loss")
