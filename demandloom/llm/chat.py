"""Reply trees as training conversations.

Messages form trees through (message, parent). Root-to-leaf paths are found by iterative self-joins that double the
reach of every ancestor pointer: after k joins a message knows its ancestors up to 2^k levels away, so a thread of a
thousand turns needs ten joins. Leaves are ranked by the mean score of their path, the best ``top_paths`` of a tree are
chosen, the pointers mark the messages on them, and each chosen path becomes one conversation.

Template of a turn: ``### Role: text </turn>`` and a line end. Inside roles and texts a backslash, ``#`` and ``<`` are
written as ``\\b``, ``\\h`` and ``\\l``, and in roles a colon as ``\\c``, so no content can look like a mark and
everything can be read back. The loss mask lists the code point ranges of the assistant texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from demandloom.llm.shared import stage

LOSS_ROLE = "assistant"
OPEN, COLON, CLOSE = "### ", ": ", " </turn>\n"
_ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))


def escape(text: Column, role: bool = False) -> Column:
    for plain, written in _ESCAPES + ((":", "\\c"),) * role:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for plain, written in ((":", "\\c"), *_ESCAPES[:0:-1], _ESCAPES[0]):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def ancestors(messages: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Pointer tables (tree, message, up), table k leading 2^k levels up, and the messages on or below a cycle.

    Only those have an ancestor further away than their tree has messages.
    """
    largest = messages.groupBy("tree").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 1
    pointers = [stage(messages.where("parent IS NOT NULL").select("tree", "message", F.col("parent").alias("up")))]
    while 2 ** (len(pointers) - 1) < largest and not pointers[-1].isEmpty():
        lower = pointers[-1].withColumnRenamed("up", "middle")
        upper = pointers[-1].withColumnRenamed("message", "middle")
        pointers.append(stage(lower.join(upper, ["tree", "middle"]).select("tree", "message", "up")))
    return pointers[:-1], pointers[-1].select("tree", "message")


def chosen_messages(messages: DataFrame, top_paths: int) -> DataFrame:
    """Rows (tree, leaf, message, depth): the messages of the best paths of each tree, the root at depth 0.

    A message whose parent is missing from its tree is a root. Equal mean scores are decided by the smaller leaf.
    """
    pointers, endless = ancestors(messages)
    total = messages.select("tree", "message", "score", F.lit(0).alias("depth"))
    for level, table in enumerate(pointers):
        # sums over the 2^level messages from here upwards are extended by the sum that starts where they end
        above = total.select("tree", F.col("message").alias("up"), F.col("score").alias("above"), F.col("depth").alias("higher"))
        joined = total.join(table, ["tree", "message"], "left").join(above, ["tree", "up"], "left")
        total = stage(joined.select("tree", "message", (F.col("score") + F.coalesce("above", F.lit(0.0))).alias("score"),
                                    F.when(F.col("higher").isNotNull(), F.col("higher") + 2**level).otherwise(F.col("depth")).alias("depth")))
    inner = messages.where("parent IS NOT NULL").select("tree", F.col("parent").alias("message")).distinct()
    leaves = total.join(inner, ["tree", "message"], "left_anti").join(endless, ["tree", "message"], "left_anti")
    mean = F.col("score") / (F.col("depth") + 1)
    order = Window.partitionBy("tree").orderBy(mean.desc(), "message")
    best = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_paths)
    path = best.select("tree", F.col("message").alias("leaf"), "message", "depth")
    for level, table in reversed(list(enumerate(pointers))):
        higher = path.join(table, ["tree", "message"])
        path = stage(path.unionByName(higher.select("tree", "leaf", F.col("up").alias("message"), (F.col("depth") - 2**level).alias("depth"))))
    return path


def format_paths(messages: DataFrame, top_paths: int = 1) -> DataFrame:
    """One row per chosen path: tree, leaf, formatted, loss (array of start and end, code points, end exclusive).

    ``messages`` has (tree, message, parent, score, role, text), message unique in its tree. Null roles and texts
    count as empty, null scores as 0. Messages on or below a cycle have no root and form no path. An empty table
    gives no rows.
    """
    clean = messages.select("tree", "message", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
                            F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    known = clean.select("tree", F.col("message").alias("parent"), F.lit(True).alias("known"))
    linked = clean.join(known, ["tree", "parent"], "left")
    links = stage(linked.select("tree", "message", F.when(F.col("known"), F.col("parent")).alias("parent"), "score"))
    chosen = chosen_messages(links, top_paths)
    said = chosen.join(clean.select("tree", "message", "role", "text"), ["tree", "message"])
    turn = F.struct("depth", "role", "text")
    paths = said.groupBy("tree", "leaf").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return paths.select("tree", "leaf", *_written(F.col("turns")))


def _written(turns: Column) -> tuple[Column, Column]:
    """The formatted text of ordered turns, and its loss mask."""
    def parts(turn: Column) -> Column:
        head = F.concat(F.lit(OPEN), escape(turn["role"], role=True), F.lit(COLON))
        return F.struct(head.alias("head"), escape(turn["text"]).alias("body"), (turn["role"] == LOSS_ROLE).alias("loss"))

    def add(state: Column, part: Column) -> Column:
        start = state["at"] + F.length(part["head"])
        end = start + F.length(part["body"])
        ranges = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + len(CLOSE)).alias("at"), F.when(part["loss"], F.concat(state["loss"], ranges)).otherwise(state["loss"]).alias("loss"))

    written = F.transform(turns, parts)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("loss"))
    formatted = F.array_join(F.transform(written, lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "")
    return formatted.alias("formatted"), F.aggregate(written, zero, add)["loss"].alias("loss")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation as array of (role, text)."""
    bodies = F.filter(F.split(formatted, " </turn>\n", -1), lambda b: b != "")

    def parse(body: Column) -> Column:
        role = F.substring_index(F.substr(body, F.lit(len(OPEN) + 1)), ":", 1)
        text = F.substr(body, F.length(role) + len(OPEN) + len(COLON) + 1)
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(bodies, parse)


def masked_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between the ranges."""
    return F.array_join(F.transform(loss, lambda r: unescape(F.substr(formatted, r["start"] + 1, r["end"] - r["start"]))), "")


def threads(conversations: DataFrame) -> DataFrame:
    """A table of (conv_id, turn, role, text) as messages: every turn answers the one before it.

    Rows of one conversation are ordered by turn, ties by role and text; repeated rows are turns of their own. A null
    conv_id is a conversation. Score is the length of the text.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = rows.withColumn("message", F.row_number().over(order))
    return numbered.select(F.struct("conv_id").alias("tree"), "message", F.when(F.col("message") > 1, F.col("message") - 1).alias("parent"),
                           F.length("text").cast("double").alias("score"), "role", "text")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """One row per conversation, read back from its formatted text: conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars."""
    formatted = format_paths(stage(threads(conversations)))
    turns, masked = read_turns(F.col("formatted")), masked_text(F.col("formatted"), F.col("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    back = formatted.select(F.col("tree.conv_id").alias("conv_id"), turns.alias("turns"), masked.alias("masked"), F.length("formatted").cast("long").alias("formatted_chars"))
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
                       F.length("masked").cast("long").alias("loss_chars"), F.sha2(F.col("masked").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
