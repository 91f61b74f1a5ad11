"""Chat formatting as a prefix tree: shared initial turns are emitted once, depth first.

A turn becomes one segment, ``<|im_start|>role\\ntext<|im_end|>\\n``. In roles and texts every ``<``, backslashes, ``|``
gets one more backslash, so no control string can appear inside; taking it away again is exact. A node is a segment
together with all segments before it; its id is a chained hash, so conversations with equal initial turns meet in the
same nodes wherever they are processed.

Depth-first order comes from one sort: a leaf's key lists the edges it takes at branching nodes, the child with most
conversations first. A node belongs to the first leaf through it, the leaves' own stretches are laid end to end, and a
node's ancestors are a few intervals: each edge to a child that is not the first at least halves the conversations, so
there are at most log2 of their number. Positions count from the conversation's start, not along the sequence.

Conversations are streamed in turn order and never gathered; a long one costs time in its task, not memory. Lengths are
in tokens of ``encode`` (code points by default), spans of the loss mask in code points of the segment.

Defined results: a null role or text is empty; turns come by number (null first), then role and text, so repeated rows
are turns like others; rows with a null conversation id form one conversation; an empty table gives empty tables.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from qaspark.llm.common import flat_map_rows, pick, to_batch
from qaspark.operators.lookups import null_safe_join
from qaspark.operators.ranks import dense_ids
from qaspark.session import materialize

START, END = "<|im_start|>", "<|im_end|>"
SEGMENT = re.compile(rf"{re.escape(START)}(?P<role>.*)\n(?P<text>(?s:.*)){re.escape(END)}\n").fullmatch
PATHS = (
    "conv_id bigint, place bigint, node binary, parent binary, root binary, position bigint, length bigint, "
    "segment string, loss_start int, loss_stop int"
)


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    """A role on one line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def segment(role: str, text: str) -> tuple[str, int, int]:
    """A turn's segment and the span of its text in it."""
    head = f"{START}{escape_role(role)}\n"
    body = escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def read_segment(text: str) -> tuple[str, str]:
    """Role and text of a segment."""
    found = SEGMENT(text)
    return unescape_role(found["role"]), unescape(found["text"])


@dataclass
class ChatTree:
    """``paths``: conversation, place, node. ``nodes``: one row per node, with its place in the sequence of its tree.

    nodes: tree, node, parent, depth, conversations, segment, length, loss_start, loss_stop (null: no loss), start (in
    the tree's sequence), position (in the conversation) and attends, the (start, stop) intervals of its ancestors.
    """

    paths: DataFrame
    nodes: DataFrame


def _chain(encode: Callable[[str], list[int]] | None):
    arrow = to_arrow_schema(StructType.fromDDL(PATHS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(column.to_pylist() for column in batch.columns)))
        out: list[tuple] = []
        for conv_id, turns in groupby(rows, key=lambda row: row[0]):
            parent = root = None
            position = 0
            for place, (_, role, text) in enumerate(turns):
                own, first, last = segment(role, text)
                node = hashlib.blake2b((parent or b"") + own.encode(), digest_size=16).digest()
                root = root or node
                length = len(encode(own)) if encode else len(own)
                loss = (first, last) if role == "assistant" else (None, None)
                out.append((conv_id, place, node, parent, root, position, length, own, *loss))
                position += length
                parent = node
                if len(out) >= 5000:
                    yield to_batch(out, arrow)
                    out = []
        if out:
            yield to_batch(out, arrow)

    return run


def build(conversations: DataFrame, encode: Callable[[str], list[int]] | None = None, conv_col: str = "conv_id",
          turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> ChatTree:
    """The prefix trees of all conversations."""
    turns = pick(conversations, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col).selectExpr(
        "cast(conv_id as bigint) conv_id", "turn", "coalesce(role, '') role", "coalesce(text, '') text")
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")
    steps = materialize(ordered.mapInArrow(_chain(encode), PATHS), "chat-steps")

    nodes = materialize(steps.groupBy("node").agg(
        *(F.max(name).alias(name) for name in ("parent", "root", "position", "length", "segment", "loss_start", "loss_stop")),
        F.max("place").alias("depth"), F.count("*").alias("conversations")), "chat-nodes")

    # Edges out of branching nodes, the child with most conversations first.
    heavy = nodes.filter("parent is not null").groupBy("parent").agg(
        F.count("*").alias("children"), F.max(F.struct("conversations", "node")).alias("most"))
    branches = heavy.filter("children > 1").select(F.col("parent").alias("fork"), F.col("most.node").alias("first_child"))
    # One conversation stands for each leaf of the tree.
    inner = heavy.select(F.col("parent").alias("node"))
    ends = nodes.join(inner, "node", "left_anti").select(F.col("node").alias("leaf"), F.col("root"))
    last = null_safe_join(steps, ends.select(F.col("leaf").alias("node")), ["node"], "left_semi")
    chosen = last.groupBy(F.col("node").alias("leaf")).agg(
        F.min(F.struct(F.col("conv_id").isNotNull().alias("some"), "conv_id")).alias("c"))
    walked = steps.select("conv_id", "place", "node", "parent", "position", "length").alias("s").join(
        chosen.alias("l"), F.col("s.conv_id").eqNullSafe(F.col("l.c.conv_id"))
    ).select("l.leaf", "s.place", "s.node", "s.parent", "s.position", "s.length")
    edges = null_safe_join(walked, branches.withColumnRenamed("fork", "parent"), ["parent"]).select(
        "leaf", "place", F.concat(F.when(F.col("node") == F.col("first_child"), "0").otherwise("1"), F.hex("node")).alias("edge"))
    turns_taken = edges.groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("place", "edge"))).alias("edges"))
    keys = ends.join(turns_taken, "leaf", "left").select("leaf", "root", F.concat_ws(
        "", F.hex("root"), F.transform(F.coalesce("edges", F.array().cast("array<struct<place:bigint,edge:string>>")), lambda e: e["edge"])
    ).alias("key"))

    # The leaves' places in the order of their keys stand for them: a path repeats a number and not a key.
    ranks = dense_ids(keys, "key", "rank").withColumnRenamed("key", "of_key")
    keys = keys.join(ranks, F.col("key") == F.col("of_key")).select("leaf", "root", F.col("rank").alias("key"))
    owned = materialize(null_safe_join(walked, keys, ["leaf"]).select("leaf", "root", "key", "node", "place", "position", "length"), "chat-paths")
    owner = owned.groupBy("node").agg(F.min("key").alias("owner"))
    stretches = null_safe_join(owned, owner, ["node"]).filter("key = owner").groupBy("root", "key").agg(
        F.sum("length").alias("own_length"), F.min("position").alias("own_position"))
    placed = _laid_out(stretches)

    located = materialize(
        owned.groupBy("node").agg(F.max("position").alias("position"), F.max("length").alias("length")).join(owner, "node")
        .join(placed.withColumnRenamed("key", "owner"), "owner")
        .select("node", "owner", "root", (F.col("start") + F.col("position") - F.col("own_position")).alias("start"), "position", "length"),
        "chat-places")
    # A leaf's path as one interval for each owner along it.
    runs = null_safe_join(owned.select("key", "node"), located.select("node", "owner", "start", "length"), ["node"]).groupBy("key", "owner").agg(
        F.min("start").alias("start"), F.max(F.col("start") + F.col("length")).alias("stop"))
    before = runs.filter("key <> owner").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("before"))
    opening = placed.select("key", F.col("start").alias("opening"))
    attended = located.join(opening.withColumnRenamed("key", "owner"), "owner").join(
        before.withColumnRenamed("key", "owner"), "owner", "left")
    interval = "array<struct<start:bigint,stop:bigint>>"
    own = F.when(F.col("start") > F.col("opening"), F.array(F.struct(F.col("opening").alias("start"), F.col("start").alias("stop")))).otherwise(
        F.array().cast(interval))
    attended = attended.select("node", "start", F.concat(F.coalesce("before", F.array().cast(interval)), own).alias("attends"))
    placed_nodes = nodes.withColumnRenamed("root", "tree").join(attended, "node")
    return ChatTree(steps.select("conv_id", "place", "node"), placed_nodes)


def _laid_out(stretches: DataFrame) -> DataFrame:
    """Where each leaf's own stretch starts in its tree: running totals by key, a partition at a time, then the partitions."""
    ranged = stretches.repartitionByRange("key").withColumn("part", F.spark_partition_id())
    inside = materialize(ranged.withColumn("run", F.sum("own_length").over(
        Window.partitionBy("part").orderBy("key").rowsBetween(Window.unboundedPreceding, -1))).fillna(0, ["run"]), "chat-runs")
    totals = inside.groupBy("part").agg(F.sum("own_length").alias("total"))  # one row for each partition
    sums = totals.withColumn("base", F.sum("total").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).fillna(0, ["base"])
    overall = inside.join(F.broadcast(sums.select("part", "base")), "part").withColumn("at", F.col("base") + F.col("run"))
    opening = overall.groupBy("root").agg(F.min("at").alias("opening"))
    return overall.join(opening, "root").select("root", "key", "own_position", (F.col("at") - F.col("opening")).alias("start"))


def formatted(tree: ChatTree) -> DataFrame:
    """conv_id, place and what the conversation's node holds, read from the tree."""
    own = tree.nodes.select("node", "segment", "position", "loss_start", "loss_stop")
    return null_safe_join(tree.paths, own, ["node"]).select("conv_id", "place", "position", "segment", "loss_start", "loss_stop")


DIGESTS = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
)


def _read_back():
    arrow = to_arrow_schema(StructType.fromDDL(DIGESTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(column.to_pylist() for column in batch.columns)))
        out: list[tuple] = []
        for conv_id, turns in groupby(rows, key=lambda row: row[0]):
            all_turns, loss = hashlib.sha256(), hashlib.sha256()
            n = n_loss = size = 0
            for _, _, _, own, first, last in turns:
                role, text = read_segment(own)
                all_turns.update(f"{role}\n{text}\n".encode())
                n += 1
                size += len(own)
                if first is not None:
                    masked = unescape(own[first:last])
                    loss.update(masked.encode())
                    n_loss += len(masked)
            out.append((conv_id, n, all_turns.hexdigest(), n_loss, loss.hexdigest(), size))
            if len(out) >= 20_000:
                yield to_batch(out, arrow)
                out = []
        if out:
            yield to_batch(out, arrow)

    return run


def read_back(tree: ChatTree) -> DataFrame:
    """Digests of every conversation as the tree holds it."""
    rows = formatted(tree).repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return rows.mapInArrow(_read_back(), DIGESTS)


def token_rows(tree: ChatTree, encode: Callable[[str], list[int]] | None = None) -> DataFrame:
    """The sequences: tree, start, position, ids, loss and attends of every node; sort by tree and start to emit."""
    own = tree.nodes.select("tree", "start", "position", "segment", "loss_start", "attends")

    def tokens(of: bytes, start: int, position: int, text: str, loss: int | None, attends: list) -> tuple:
        ids = encode(text) if encode else [ord(c) for c in text]
        return ((of, start, position, ids, loss is not None, attends),)

    return flat_map_rows(
        own, tokens, "tree binary, start bigint, position bigint, ids array<int>, loss boolean, attends array<struct<start:bigint,stop:bigint>>")
