"""Chat formatting as a prefix tree.

Conversations that begin with the same turns share them: every distinct prefix of turns is
one node, whose formatted segment is emitted once. Nodes are laid out depth-first in one
sequence; a node's tokens get the positions they have in their conversation (the
length of its ancestors on), and the intervals of the sequence that hold its ancestors, which
with the node's own earlier tokens are all it may attend to. A token is a code point.

Template: ``<|turn|>`` role ``<|text|>`` text ``<|end|>``. Inside roles and texts a backslash
is doubled and a control string gets one after its first character, so no
control string can come from a text, and dropping single backslashes restores it.

Turns are chained in streams over partitions sorted by conversation and turn, so a long
conversation needs no memory of its length; nodes are aggregated with map-side combining,
so a first turn that a third of all conversations share is one row per task.
Depth-first order needs neither recursion nor whole paths: a node belongs to the least conversation that
passes it, so a conversation owns the end of its path, and a subtree's size is the sum, over the
conversations that pass its root, of the tokens they own from there on. Siblings are ordered by falling subtree size
(then node id): whoever does not stand right behind its parent has at most half of the subtree, so a node's ancestors lie in
at most log2(tokens) intervals. The sizes of the siblings before a node are a prefix sum over range partitions in this order,
first within partitions, then over the partitions' totals. A node's place is its position and these sums of its
ancestors and itself.

Defined results: rows with equal turn number are ordered by role and text; null turns come
first; null texts and roles count as empty; rows with a null conversation id form one
conversation of null id; repeated rows are turns of their own; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, out_batch, ship

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Beginnings of control strings, of this template and of common others.
CONTROL = ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\")
    for c in CONTROL:
        text = text.replace(c, f"{c[0]}\\{c[1:]}")
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


def segment(role: str, text: str) -> str:
    return f"{TURN}{escape(role)}{TEXT}{escape(text)}{END}"


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted stretch."""
    turns = []
    for part in formatted.split(TURN)[1:]:
        role, _, rest = part.partition(TEXT)
        turns.append((unescape(role), unescape(rest[:rest.index(END)])))
    return turns


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(schema)


def _by_conversation(df: DataFrame, *order: str) -> DataFrame:
    return df.repartition("conv").sortWithinPartitions("conv", *order)


def _chain(turns: DataFrame, learn_role: str) -> DataFrame:
    """Per turn: conv, depth, node, parent, position of its first token, segment, tokens, and the
    part of the segment that is under the loss mask."""
    schema = T.StructType([turns.schema["conv"], *T._parse_datatype_string(
        "depth int, node string, parent string, position bigint, segment string, tokens bigint, "
        "loss_start bigint, loss_end bigint").fields])
    arrow = _arrow(schema)

    def run(batches):
        last, depth, node, position = object(), 0, "", 0
        for b in batches:
            cols: list[list] = [[] for _ in schema.fields]
            for conv, role, text in zip(*(b.column(c).to_pylist() for c in (0, 2, 3))):
                if conv != last:
                    last, depth, node, position = conv, 0, "", 0
                role, text = role or "", text or ""
                piece = segment(role, text)
                parent = node
                node = hashlib.blake2b(f"{parent}\0{piece}".encode(), digest_size=16).hexdigest()
                start = len(TURN) + len(escape(role)) + len(TEXT)
                loss = (start, len(piece) - len(END)) if role == learn_role else (0, 0)
                for to, x in zip(cols, (conv, depth, node, parent or None, position, piece, len(piece), *loss)):
                    to.append(x)
                depth += 1
                position += len(piece)
            if cols[0]:
                yield out_batch(arrow, cols)

    return _by_conversation(turns, "turn", "role", "text").mapInArrow(run, schema)


def prefix_tree(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                text_col: str = "text", learn_role: str = "assistant") -> tuple[DataFrame, DataFrame]:
    """``(nodes, paths)``.

    ``nodes``, one row per distinct prefix: ``node``, ``parent``, ``depth``, ``segment`` (formatted
    text, once), ``tokens``, ``start`` (place in the depth-first sequence), ``position`` (position id of the
    first token; the others follow), ``loss_start`` and ``loss_end`` (tokens of the segment under the
    loss mask), ``conversations`` (that pass it), ``attends`` (array of (start, end) intervals of the
    sequence that hold its ancestors). ``paths``: ``conv``, ``depth``, ``node``."""
    ship(conversations.sparkSession)
    turns = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"),
                                 F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    chained = checkpoint(_chain(turns, learn_role))
    paths = chained.select("conv", "depth", "node")
    same = ("parent", "depth", "position", "segment", "tokens", "loss_start", "loss_end")
    nodes = checkpoint(chained.groupBy("node").agg(*(F.first(c).alias(c) for c in same), F.count(F.lit(1)).alias("conversations"),
                                                   F.min(F.struct("conv")).alias("owner")))
    steps = chained.select("conv", "depth", "node", "position", "tokens")
    owned = steps.join(nodes.select("node", "owner"), "node").withColumn("own", F.col("owner.conv").eqNullSafe(F.col("conv")))
    sizes = _owned_from(owned).groupBy("node").agg(F.sum("size").alias("size"))

    # sums over the nodes by parent, the larger subtree first; ``rank`` grows with it (its upper bits: the partition)
    ranked = checkpoint(nodes.select("node", F.coalesce("parent", F.lit("")).alias("parent")).join(sizes, "node")
                        .repartitionByRange("parent", F.desc("size"), "node").sortWithinPartitions("parent", F.desc("size"), "node")
                        .select("*", F.monotonically_increasing_id().alias("rank"))
                        .withColumn("size", F.col("size").cast("decimal(28,0)")).withColumn("part", F.shiftright("rank", 33)))
    totals = ranked.groupBy("part").agg(F.sum("size").alias("total"))           # a row per partition
    totals = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("ahead"))
    within = Window.partitionBy("part").orderBy("rank")
    summed = checkpoint(ranked.withColumn("upto", F.sum("size").over(within)).join(F.broadcast(totals), "part")
                        .select("node", "parent", (F.col("ahead") + F.col("upto") - F.col("size")).alias("before")))
    eldest = summed.groupBy("parent").agg(F.min("before").alias("first"))
    beside = summed.join(eldest, "parent").select("node", (F.col("before") - F.col("first")).cast("long").alias("beside"))
    placed = _places(owned.join(beside, "node"))
    return nodes.drop("owner").join(placed, "node"), paths


def _owned_from(owned: DataFrame) -> DataFrame:
    """``node`` and ``size`` per turn: tokens of the nodes that its conversation owns from this one on."""
    schema = T._parse_datatype_string("node string, size bigint")
    arrow = _arrow(schema)

    def run(batches):
        last, size = object(), 0
        for b in batches:
            out: tuple[list, list] = ([], [])
            for conv, node, tokens, own in zip(*(b.column(c).to_pylist() for c in range(4))):
                if conv != last:
                    last, size = conv, 0
                if own:
                    size += tokens
                if size:                             # else it adds nothing; a node's owner adds its tokens
                    out[0].append(node)
                    out[1].append(size)
            if out[0]:
                yield out_batch(arrow, list(out))

    return (owned.repartition("conv").sortWithinPartitions("conv", F.desc("depth"))
            .select("conv", "node", "tokens", "own").mapInArrow(run, schema))


def _places(steps: DataFrame) -> DataFrame:
    """``node``, ``start`` and ``attends`` of every node, from the turns of the conversations with the
    sizes of the subtrees beside them."""
    schema = T._parse_datatype_string("node string, start bigint, attends array<struct<start:bigint,end:bigint>>")
    arrow = _arrow(schema)

    def run(batches):
        last, ahead, before = object(), 0, []
        for b in batches:
            out: tuple[list, list, list] = ([], [], [])
            for conv, node, position, tokens, beside, own in zip(*(b.column(c).to_pylist() for c in range(6))):
                if conv != last:
                    last, ahead, before = conv, 0, []
                ahead += beside
                start = position + ahead
                if own:
                    out[0].append(node)
                    out[1].append(start)
                    out[2].append([{"start": s, "end": e} for s, e in before])
                if before and before[-1][1] == start:
                    before[-1] = (before[-1][0], start + tokens)
                else:
                    before.append((start, start + tokens))
            if out[0]:
                yield out_batch(arrow, list(out))

    return (_by_conversation(steps, "depth").select("conv", "node", "position", "tokens", "beside", "own")
            .mapInArrow(run, schema))


def read_back(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """What the formatted output says of every conversation: ``conv``, ``n_turns``, ``turns_sha256``
    (of role, newline, text, newline per turn), ``loss_chars`` and ``loss_sha256`` (of the unescaped
    text under the loss mask), ``formatted_chars``.

    Read from the layout: a conversation's segments follow in the order of their places in the sequence. Position ids
    have to go on without gaps, and the places up to the last segment have to be the intervals which that segment attends
    to; a layout that says otherwise raises ``ValueError``."""
    laid = nodes.select("node", "segment", "loss_start", "loss_end", "start", "tokens", "position", "attends")
    joined = paths.select("conv", "node").join(laid, "node")
    schema = T.StructType([paths.schema["conv"], *T._parse_datatype_string(
        "n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint").fields])
    arrow = _arrow(schema)

    def run(batches):
        state, last, rows = None, object(), []
        seen, earlier, attends = [], [], []          # intervals up to the last segment, before it, and what it attends to

        def close():
            if state is not None:
                conv, n, turns, chars, loss, size = state
                if earlier != attends:
                    raise ValueError(f"conversation {conv}: its last turn attends to {attends}, its turns before stand at {earlier}")
                rows.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size))

        for b in batches:
            for conv, piece, lo, hi, start, tokens, position, to in zip(*(b.column(c).to_pylist() for c in range(8))):
                if conv != last:
                    close()
                    last, state, seen = conv, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0], []
                if position != state[5] or tokens != len(piece):
                    raise ValueError(f"conversation {conv}: the turn at place {start} has position {position}, not {state[5]}")
                earlier, attends = list(seen), [(x["start"], x["end"]) for x in to]
                if seen and seen[-1][1] == start:
                    seen[-1] = (seen[-1][0], start + tokens)
                else:
                    seen.append((start, start + tokens))
                for role, text in parse(piece):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                learnt = unescape(piece[lo:hi])
                state[3] += len(learnt)
                state[4].update(learnt.encode())
                state[5] += len(piece)
            if rows:
                yield out_batch(arrow, [list(c) for c in zip(*rows)])
                rows.clear()
        close()
        if rows:
            yield out_batch(arrow, [list(c) for c in zip(*rows)])

    return (_by_conversation(joined, "start").select("conv", "segment", "loss_start", "loss_end", "start", "tokens", "position", "attends")
            .mapInArrow(run, schema))
