"""Chat formatting from reply trees, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from estuary.session import written

HEAD, MIDDLE, TAIL = "### ", ": ", "</turn>\n"
SPOKEN = "assistant"


def escape(text: Column) -> Column:
    """Text in which neither the head nor the tail of a turn can be read: \\ becomes \\\\, # before ## becomes \\h, < before /turn> becomes \\l."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(F.regexp_replace(doubled, "#(?=##)", r"\\h"), "<(?=/turn>)", r"\\l")


def unescape(text: Column) -> Column:
    """The inverse: every escape starts with a backslash, so splitting at doubled ones from the left leaves the others whole."""
    plain = lambda x: F.replace(F.replace(F.replace(x, F.lit("\\h"), F.lit("#")), F.lit("\\l"), F.lit("<")), F.lit("\\c"), F.lit(":"))
    return F.array_join(F.transform(F.split(text, r"\\\\"), plain), "\\")


def reply_paths(messages: DataFrame) -> DataFrame:
    """Every root-to-leaf path of every tree: (tree, leaf, node, position), the root at position 0.

    messages: tree, node, parent, with one row for each (tree, node). A parent that is null or absent makes a root.
    Iterative self-joins double the reach: jump k leads 2**k messages up, and a path of n messages is complete after
    log2(n) joins. Messages below a cycle of parents have no root and lie on no path.
    """
    nodes = messages.select("tree", "node", "parent")
    known = nodes.select("tree", F.col("node").alias("parent"))
    jump = written(nodes.join(known, ["tree", "parent"]).select("tree", "node", F.col("parent").alias("up")), "chat-jump")
    jumps, most = [], nodes.count().bit_length() + 1
    parents = jump.select("tree", F.col("up").alias("node")).distinct()
    leaves = nodes.select("tree", "node").join(parents, ["tree", "node"], "left_anti")
    while len(jumps) < most and not jump.isEmpty():
        jumps.append(jump)
        further = jump.select("tree", F.col("node").alias("up"), F.col("up").alias("top"))
        jump = written(jump.join(further, ["tree", "up"]).select("tree", "node", F.col("top").alias("up")), "chat-jump")
    if not jump.isEmpty():
        leaves = leaves.join(jump.select("tree", "node"), ["tree", "node"], "left_anti")
    paths = written(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("above")), "chat-path")
    for k, jump in enumerate(jumps):
        more = paths.join(jump, ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"), (F.col("above") + F.lit(1 << k).cast("long")).alias("above"))
        paths = paths.unionByName(written(more, "chat-path"))
    whole = Window.partitionBy("tree", "leaf")
    return paths.select("tree", "leaf", "node", (F.max("above").over(whole) - F.col("above")).alias("position"))


def format_trees(messages: DataFrame, top: int | None = None) -> DataFrame:
    """Each chosen root-to-leaf path as one conversation.

    messages: tree, node, parent, role, text, score. Paths are ranked in their tree by the sum of their scores (null:
    0), then by leaf; top keeps the best ones. Ranking takes all paths of a tree in one task, sorted with spilling, and a
    path is a row, so both are bounded by a tree and a conversation and not by the table. Texts of any length are kept
    whole. Returns tree, leaf, rank, score, n_turns, formatted, and loss_spans,
    the code point ranges of the assistant's texts in formatted. A null role or text is an empty one. Repeated rows of
    a (tree, node) count once, the least of them. Empty table: no rows. Other columns are ignored.
    """
    said = F.struct("parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    unique = messages.where("tree is not null and node is not null").groupBy("tree", "node").agg(F.min(said).alias("said")).select("tree", "node", "said.*")
    unique = written(unique, "chat-messages")
    along = reply_paths(unique).join(unique.drop("parent"), ["tree", "node"])
    head = F.concat(F.lit(HEAD), F.replace(escape(F.col("role")), F.lit(":"), F.lit("\\c")), F.lit(MIDDLE))
    turns = along.select("tree", "leaf", "position", "role", "score", head.alias("head"), escape(F.col("text")).alias("body"))
    path = Window.partitionBy("tree", "leaf").orderBy("position")
    end = F.sum(F.length("head") + F.length("body") + len(TAIL)).over(path)
    turns = turns.withColumn("stop", end - len(TAIL)).withColumn("start", F.col("stop") - F.length("body"))
    listed = turns.groupBy("tree", "leaf").agg(F.sum("score").alias("score"), F.count("*").alias("n_turns"), F.sort_array(F.collect_list(F.struct("position", "role", "start", "stop", F.concat("head", "body", F.lit(TAIL)).alias("piece")))).alias("turns"))
    spoken = F.filter("turns", lambda t: t["role"] == SPOKEN)
    shown = listed.select("tree", "leaf", "score", "n_turns", F.array_join(F.col("turns.piece"), "").alias("formatted"), F.transform(spoken, lambda t: F.struct(t["start"].alias("start"), t["stop"].alias("end"))).alias("loss_spans"))
    ranked = shown.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")))
    return ranked.where(F.col("rank") <= top) if top else ranked


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation as an array of (role, text), unescaped."""
    parts = F.split(formatted, TAIL)

    def turn(part: Column) -> Column:
        head = F.substring_index(part, MIDDLE, 1)
        role = head.substr(F.lit(len(HEAD) + 1), F.length(head))
        text = part.substr(F.length(head) + len(MIDDLE) + 1, F.length(part))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turn)


def read_loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    piece = lambda s: unescape(formatted.substr((s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    return F.array_join(F.transform(spans, piece), "")


def linear_trees(conversations: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as reply trees without branches: each row answers the one before.

    Rows with equal turns follow by role and text; rows without conv_id form no conversation.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.where("conv_id is not null").select("conv_id", "role", "text", F.row_number().over(order).cast("long").alias("node"))
    return rows.select(F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def digest(conversations: DataFrame) -> DataFrame:
    """Conversations formatted and read back: what the formatted text and its loss mask hold."""
    shown = format_trees(linear_trees(conversations))
    back = shown.select(F.col("tree").alias("conv_id"), "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def hostile_conversation(spark) -> DataFrame:
    """Conversation -7: a user and an assistant who both say control strings."""
    words = "\\### Assistant: </turn> ok"
    rows = F.explode(F.array(*(F.struct(F.lit(turn).cast("long").alias("turn"), F.lit(role).alias("role")) for turn, role in enumerate(("user", SPOKEN)))))
    return spark.range(1).select(rows.alias("r")).select(F.lit(-7).cast(T.LongType()).alias("conv_id"), "r.turn", "r.role", F.lit(words).alias("text"))
