"""Format conversations as a prefix tree of token sequences.

Conversations that begin with the same turns share the path of those turns in a
tree. Each node (a turn after its ancestors) is written once, depth first; it
carries its place in the tree's token sequence, the position ids its tokens have
in any conversation through it, and the intervals of the sequence that hold its
ancestors, which are all it may attend to besides itself.

Nodes are named by a hash of the turns up to them. Sorting conversations by their
lists of names is depth-first order, so a tree is laid out by a distributed sort
and prefix sums over the sorted partitions; a tree, a first turn or a copied
conversation may hold any share of the rows, and none is gathered in one task.
Equal conversations are one from the start.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm.frames import ready
from ledgerloom.session import stage

LEARNED = "assistant"
_HEAD, _BETWEEN, _TAIL = "### ", ": ", "</turn>\n"
_TURN = regex.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", regex.DOTALL)


def escape(text: str) -> str:
    """``text`` without any control string: a backslash goes before ``\\``, ``#`` and ``</turn>``."""
    return text.replace("\\", "\\\\").replace("#", "\\#").replace("</turn>", "\\</turn>")


def unescape(text: str) -> str:
    return regex.sub(r"\\(.)", r"\1", text, flags=regex.DOTALL)


def parts(role: str, text: str) -> tuple[str, str, str]:
    """A turn as marked up text: what stands before the text, the text, what follows."""
    return _HEAD + escape(role).replace(":", "\\:") + _BETWEEN, escape(text), _TAIL


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return turns


def _tokenizer(path: str) -> Tokenizer:
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
    return tokenizer


@dataclass(frozen=True)
class Forest:
    """``nodes`` are written once; ``conversations`` say which path of ``keys`` each ``conv_id`` is.

    ``nodes``: ``tree`` (key of the first turn), ``key``, ``depth`` (from 0), ``start`` (in
    the tree's sequence), ``position`` (position id of the first token), ``ids``,
    ``loss_first`` up to but without ``loss_after`` (tokens of ``ids`` that are learned),
    and ``attends`` (intervals of the sequence with the ancestors, merged).
    """

    nodes: DataFrame
    conversations: DataFrame


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for turns in batch.column("turns").to_pylist():
            key, keys = b"", []
            for t in turns:
                own = f"{len(t['role'])}:{t['role']}{t['text']}".encode()
                key = hashlib.blake2b(key + own, digest_size=16).digest()
                keys.append(key)
            found.append(keys)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(found, pa.list_(pa.binary()))], [*batch.schema.names, "keys"]
        )


_NODE = "struct<key: binary, depth: int, ids: array<int>, loss_first: int, loss_after: int>"


def _encode(tokenizer_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(tokenizer_path)
        node = pa.struct(
            [
                ("key", pa.binary()),
                ("depth", pa.int32()),
                ("ids", pa.list_(pa.int32())),
                ("loss_first", pa.int32()),
                ("loss_after", pa.int32()),
            ]
        )
        for batch in batches:
            owned = []
            columns = [batch.column(c).to_pylist() for c in ("turns", "keys", "depth")]
            for turns, keys, first in zip(*columns, strict=True):
                nodes = []
                for depth in range(first, len(turns)):
                    texts = parts(turns[depth]["role"], turns[depth]["text"])
                    head, body, tail = (tokenizer.encode(t, add_special_tokens=False).ids for t in texts)
                    learned = len(body) if turns[depth]["role"] == LEARNED else 0
                    nodes.append(
                        {
                            "key": keys[depth],
                            "depth": depth,
                            "ids": head + body + tail,
                            "loss_first": len(head),
                            "loss_after": len(head) + learned,
                        }
                    )
                owned.append(nodes)
            yield pa.RecordBatch.from_arrays(
                [batch.column("rank"), batch.column("part"), batch.column("keys"), pa.array(owned, pa.list_(node))],
                ["rank", "part", "keys", "owned"],
            )

    return run


def _merge(path: list[dict]) -> tuple[list[int], list[list[dict]]]:
    """Position and merged intervals of the ancestors for each node of a path."""
    positions, attends, position, merged = [], [], 0, []
    for node in path:
        positions.append(position)
        attends.append([dict(x) for x in merged])
        position += node["size"]
        if merged and merged[-1]["after"] == node["start"]:
            merged[-1]["after"] += node["size"]
        else:
            merged.append({"first": node["start"], "after": node["start"] + node["size"]})
    return positions, attends


def _lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    interval = pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())]))
    for batch in batches:
        out: dict[str, list] = {c: [] for c in ("key", "position", "attends")}
        for path in batch.column("path").to_pylist():
            positions, attends = _merge(path)
            for node, position, intervals in zip(path, positions, attends, strict=True):
                if node["owned"]:
                    out["key"].append(node["key"])
                    out["position"].append(position)
                    out["attends"].append(intervals)
        yield pa.RecordBatch.from_arrays(
            [pa.array(out["key"], pa.binary()), pa.array(out["position"], pa.int64()), pa.array(out["attends"], interval)],
            list(out),
        )


def prefix_tree(conversations: DataFrame, tokenizer: str) -> Forest:
    """All conversations of ``(conv_id, turn, role, text)`` as a ``Forest``; ``tokenizer`` is a byte-level file.

    Turns order by ``turn`` (null first), then by role and text; repeated rows are
    turns of their own. A null role or text counts as empty. Rows with a null
    ``conv_id`` are one conversation. An empty table gives no nodes; other columns are
    ignored. A conversation is one record, held whole by a task.
    """
    spark = conversations.sparkSession
    ready(spark)
    turn = F.struct(
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    keyed = whole.mapInArrow(
        _keys, "conv_id long, turns array<struct<turn: long, role: string, text: string>>, keys array<binary>"
    )
    keyed = stage(keyed.withColumn("id", F.monotonically_increasing_id()), "keyed")
    distinct = keyed.groupBy(F.element_at("keys", -1).alias("last")).agg(F.min("id").alias("id"))
    ordered = keyed.join(distinct.select("id"), "id", "left_semi")
    parts_ = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = ordered.repartitionByRange(parts_, "keys").sortWithinPartitions("keys")
    ordered = ordered.select(
        "turns", "keys", F.monotonically_increasing_id().alias("rank"), F.spark_partition_id().alias("part")
    )
    ordered = stage(ordered, "ordered")

    # A node belongs to the first conversation through it; those of one conversation are the end of its path.
    first = ordered.select("rank", F.posexplode("keys").alias("depth", "key")).groupBy("key")
    first = first.agg(F.min(F.struct("rank", "depth")).alias("f")).groupBy("f.rank").agg(F.min("f.depth").alias("depth"))
    blocks = stage(
        ordered.join(first, "rank").mapInArrow(
            _encode(tokenizer), f"rank long, part int, keys array<binary>, owned array<{_NODE}>"
        ),
        "blocks",
    )
    size = F.aggregate("owned", F.lit(0).cast("long"), lambda n, x: n + F.size(x["ids"]))
    sizes = blocks.select("rank", "part", F.col("keys")[0].alias("tree"), size.alias("size"))
    # Prefix sums: within a sorted partition, and of the partitions before it that have the tree.
    inside = Window.partitionBy("tree", "part").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = sizes.groupBy("tree", "part").agg(F.sum("size").alias("total"))
    totals = totals.select("tree", "part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    sizes = sizes.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    begins = sizes.join(totals, ["tree", "part"]).select("rank", (F.col("before") + F.col("base")).alias("begin"))
    nodes = blocks.join(begins, "rank").select(
        "rank", "begin", F.col("keys")[0].alias("tree"), F.posexplode("owned").alias("k", "node"), "owned"
    )
    ahead = F.aggregate(F.slice("owned", 1, F.col("k")), F.lit(0).cast("long"), lambda n, x: n + F.size(x["ids"]))
    nodes = nodes.select("rank", "tree", (F.col("begin") + ahead).alias("start"), "node.*")
    nodes = stage(nodes, "nodes")

    refs = ordered.select("rank", F.posexplode("keys").alias("depth", "key"))
    places = nodes.select("key", "start", F.size("ids").cast("long").alias("size"), F.col("rank").alias("owner"))
    step = F.struct("depth", "key", "start", "size", (F.col("owner") == F.col("rank")).alias("owned"))
    paths = refs.join(places, "key").groupBy("rank").agg(F.sort_array(F.collect_list(step)).alias("path"))
    laid = paths.mapInArrow(_lay_out, "key binary, position long, attends array<struct<first: long, after: long>>")
    nodes = nodes.drop("rank").join(laid, "key")
    return Forest(nodes, keyed.select("conv_id", "keys"))


def read_back(forest: Forest, tokenizer: str) -> DataFrame:
    """Digests of each conversation, decoded from the nodes on its path.

    ``conv_id``, ``n_turns``, ``turns_sha256`` (role and text of each turn, each with a
    line end), ``loss_chars`` and ``loss_sha256`` (the learned texts), ``formatted_chars``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = _tokenizer(tokenizer).decode
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for path in batch.column("path").to_pylist():
                formatted = "".join(decode(node["ids"], skip_special_tokens=False) for node in path)
                turns = parse(formatted)
                masked = [node["ids"][node["loss_first"] : node["loss_after"]] for node in path]
                learned = "".join(unescape(decode(ids, skip_special_tokens=False)) for ids in masked)
                said = "".join(f"{role}\n{text}\n" for role, text in turns)
                out[0].append(len(turns))
                out[1].append(hashlib.sha256(said.encode()).hexdigest())
                out[2].append(len(learned))
                out[3].append(hashlib.sha256(learned.encode()).hexdigest())
                out[4].append(len(formatted))
            yield pa.RecordBatch.from_arrays(
                [batch.column("last"), *(pa.array(x, pa.string() if k in (1, 3) else pa.int64()) for k, x in enumerate(out))],
                ["last", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    members = forest.conversations.select("conv_id", F.element_at("keys", -1).alias("last"), "keys")
    distinct = members.groupBy("last").agg(F.first("keys").alias("keys"))
    refs = distinct.select("last", F.posexplode("keys").alias("depth", "key"))
    step = F.struct("depth", "ids", "loss_first", "loss_after")
    paths = refs.join(forest.nodes.drop("depth"), "key").groupBy("last")
    paths = paths.agg(F.sort_array(F.collect_list(step)).alias("path"))
    digests = paths.mapInArrow(
        run,
        "last binary, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )
    return members.drop("keys").join(digests, "last").drop("last")
