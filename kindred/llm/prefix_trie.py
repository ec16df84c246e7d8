"""The prefix trie of conversations, through z-fast tries.

A conversation is a sequence of turns; a turn's symbol is a digest of its role and text, and the prefix of depth
d is named by chaining digests, so that a prefix is looked up by one 16-byte name.

A z-fast trie keeps the compacted trie: a node stands for the depths from below its parent's extent to its own
extent. A table holds every node under one prefix of its extent, the handle, whose length is the two-fattest
depth of that range: the number in it with the most trailing binary zeros. A sequence finds the node at which it
leaves the trie by fat binary search over its depths: at the two-fattest depth between what is known to match and
what is known not to, the table either names a node on the path or rules the rest out, so the search takes about
as many look-ups as the length has binary digits.

Distinct sequences are dealt to tasks; each task inserts them batch by batch, splitting edges and moving handles,
and at the end, or when its trie has reached ``FLUSH_TURNS`` turns, expands the edges to one row per depth with
what its sequences contribute there. The rows of all tasks are added up per prefix name. A first turn shared by a
third of all conversations is one row per task by then, so nothing is gathered at one prefix.

Contributions add up because every node is owned by exactly one conversation: the smallest that passes through
it. A first pass finds the smallest member of every node; a conversation owns the depths from some depth down to
its end. In the second pass a sequence brings its members, whether its end is childless, and the depth its
ownership begins at. The children of a node are the owned depths right below it, and what is saved at a node is its
members less its owner, times the length of its text, summed upwards inside each task's trie.

The list of members that end at a node is digested as a sorted stream of pieces of at most 2^``PIECE_BITS`` ids each.

Defined results: null roles and texts are empty; rows without a conversation id belong to no conversation and are
left out; turns with equal numbers, null among them, stand in the order of their symbols; repeated rows are turns
of their own; a conversation without turns ends at the root; an empty table has no nodes. Texts are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.session import cut_lineage

FLUSH_TURNS = 1 << 18
PIECE_BITS = 12
NAME_BYTES = 16
OUT_ROWS = 20_000
_NEVER = 1 << 62  # an ownership that does not begin


def two_fattest(above: int, until: int) -> int:
    """The number in (above, until] with the most trailing binary zeros."""
    return until & (-1 << ((above ^ until).bit_length() - 1))


def prefix_names(symbols: list[bytes]) -> list[bytes]:
    """Names of the prefixes of depth 0, 1, ... of a sequence."""
    names = [b""]
    for symbol in symbols:
        names.append(hashlib.sha256(names[-1] + symbol).digest()[:NAME_BYTES])
    return names


class Node:
    """A compacted node: depths above.extent + 1 to extent of the sequence ``names``."""

    __slots__ = ("above", "chars", "ended", "extent", "names", "totals")

    def __init__(self, above: Node | None, extent: int, names: list[bytes], chars: list[int]) -> None:
        self.above, self.extent, self.names, self.chars = above, extent, names, chars
        self.ended: tuple | None = None

    @property
    def top(self) -> int:
        return self.above.extent if self.above else 0


class ZFastTrie:
    """Distinct sequences with what they bring: (members, smallest, owned from, childless, key, digest of ends)."""

    def __init__(self) -> None:
        self.root = Node(None, 0, [b""], [])
        self.nodes = [self.root]
        self.handles: dict[bytes, Node] = {}
        self.first: dict[bytes, Node] = {}  # by the name of a node's first depth
        self.turns = 0

    def locate(self, names: list[bytes]) -> tuple[Node, Node | None]:
        """The deepest node whose extent is a prefix, and the node below it that shares a further turn, if any."""
        node, known, until = self.root, 0, len(names) - 1
        while known < until:
            depth = two_fattest(known, until)
            found = self.handles.get(names[depth])
            if found is None:
                until = depth - 1
            elif found.extent < len(names) and found.names[found.extent] == names[found.extent]:
                node, known = found, found.extent
            else:
                return found.above, found
        return node, self.first.get(names[known + 1]) if known + 1 < len(names) else None

    def _hang(self, node: Node) -> None:
        """Enter ``node`` under its handle and its first depth."""
        self.handles[node.names[two_fattest(node.top, node.extent)]] = node
        self.first[node.names[node.top + 1]] = node

    def _new(self, above: Node, extent: int, names: list[bytes], chars: list[int]) -> Node:
        node = Node(above, extent, names, chars)
        self.nodes.append(node)
        self._hang(node)
        return node

    def insert(self, names: list[bytes], chars: list[int], brings: tuple) -> None:
        above, below = self.locate(names)
        length = len(names) - 1
        if below is not None:
            low, high = above.extent + 1, min(below.extent, length)
            while low < high:  # the last depth they share
                middle = (low + high + 1) // 2
                if below.names[middle] == names[middle]:
                    low = middle
                else:
                    high = middle - 1
            above, split = Node(above, low, below.names, below.chars), below
            self.nodes.append(above)
            split.above = above
            self._hang(above)
            self._hang(split)
        if above.extent < length:
            above = self._new(above, length, names, chars)
        above.ended = brings
        self.turns += length + 1

    def expand(self) -> Iterator[tuple]:
        """One row per depth of every edge, deepest nodes first, see ``NODES``."""
        for node in self.nodes:
            node.totals = [0, _NEVER, _NEVER, 0, 0, 0]  # members, smallest, owned from, childless, children, saved
        for node in sorted(self.nodes, key=lambda n: -n.extent):
            t = node.totals
            ended = key = ends = None
            if node.ended:
                ended, smallest, owned, childless, key, ends = node.ended
                t[0], t[1], t[2], t[3] = t[0] + ended, min(t[1], smallest), min(t[2], owned), t[3] + childless
            members, smallest, owned, childless, children, saved = t
            if not members:
                continue  # the root of a trie without sequences
            for depth in range(node.extent, node.top, -1):
                saved += node.chars[depth - 1] * (members - (owned < depth))
                yield node.names[depth], depth, node.names[depth - 1], smallest, members, ended, key, children, childless, saved, ends
                children = int(owned < depth)  # as seen from the depth above
                ended = key = ends = None
            if node.above is None:
                yield b"", 0, None, smallest, members, ended, key, children, childless, saved, ends
            else:
                up = node.above.totals
                up[0], up[1], up[2], up[3], up[4], up[5] = (
                    up[0] + members, min(up[1], smallest), min(up[2], owned), up[3] + childless, up[4] + children, up[5] + saved,
                )


NODES = (
    "name binary, depth long, above binary, conv_id long, n_convs long, ended long, key string, n_children long, "
    "n_leaves long, saved_tokens long, ends_sha256 string"
)
_ARROW = pa.schema(
    [("name", pa.binary()), ("depth", pa.int64()), ("above", pa.binary()), ("conv_id", pa.int64()), ("n_convs", pa.int64()),
     ("ended", pa.int64()), ("key", pa.string()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()),
     ("ends_sha256", pa.string())]
)


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows_of(trie: ZFastTrie) -> Iterator[pa.RecordBatch]:
        held = []
        for row in trie.expand():
            held.append(row)
            if len(held) == OUT_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _ARROW, strict=True)], schema=_ARROW)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _ARROW, strict=True)], schema=_ARROW)

    trie = ZFastTrie()
    for batch in batches:
        columns = (batch.column(c) for c in ("symbols", "chars", "members", "conv_id", "owned_from", "childless", "key", "ends_sha256"))
        for symbols, chars, members, smallest, owned, childless, key, ends in zip(*columns, strict=True):
            brings = (members.as_py(), smallest.as_py(), _NEVER if owned.as_py() is None else owned.as_py(), childless.as_py(), key.as_py(), ends.as_py())
            trie.insert(prefix_names(symbols.as_py()), chars.as_py(), brings)
            if trie.turns >= FLUSH_TURNS:
                yield from rows_of(trie)
                trie = ZFastTrie()
    yield from rows_of(trie)


def _nodes(sequences: DataFrame) -> DataFrame:
    """The nodes of all tasks' tries over distinct ``sequences``, added up per prefix name."""
    return (
        sequences.mapInArrow(_grow, NODES)
        .groupBy("name")
        .agg(
            F.max("depth").alias("depth"), F.max("above").alias("above"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
            F.sum("ended").alias("ended"), F.max("key").alias("key"), F.sum("n_children").alias("n_children"),
            F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.max("ends_sha256").alias("ends_sha256"),
        )
    )


def _digested_ids(rows: DataFrame) -> DataFrame:
    """Per ``key`` the SHA-256 of its ids, ascending and joined by commas."""
    pieces = rows.groupBy("key", F.shiftright("conv_id", PIECE_BITS).alias("piece")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids")
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = state = None
        for batch in batches:
            out = []
            for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if k == key:
                    state.update(b"," + ids.encode())
                    continue
                if key is not None:
                    out.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], ["key", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], ["key", "ends_sha256"])

    sorted_pieces = pieces.repartition("key").sortWithinPartitions("key", "piece").select("key", "ids")
    return sorted_pieces.mapInArrow(digest, "key string, ends_sha256 string")


def conversation_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, turns) of a table of turns (conv_id, turn, role, text): symbols and lengths in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    symbol = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = rows.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", symbol.alias("symbol"), F.char_length(text).cast("long").alias("chars")).alias("t")
    )
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie over ``conversations`` (conv_id, unique; turns): ``conv_id`` (smallest member), ``depth``,
    ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``."""
    symbols = F.transform("turns", lambda t: t["symbol"])
    rows = cut_lineage(
        conversations.select(
            "conv_id", symbols.alias("symbols"), F.transform("turns", lambda t: t["chars"]).alias("chars"),
            F.sha2(F.array_join(F.transform(symbols, lambda s: F.hex(s)), ""), 256).alias("key"),
        )
    )
    distinct = cut_lineage(
        rows.groupBy("key").agg(
            F.count(F.lit(1)).alias("members"), F.min("conv_id").alias("conv_id"), F.first("symbols").alias("symbols"), F.first("chars").alias("chars")
        )
    )
    none = F.lit(None)
    plain = distinct.select("*", none.cast("long").alias("owned_from"), F.lit(0).alias("childless"), none.cast("string").alias("ends_sha256"))
    members = cut_lineage(_nodes(plain).select("name", "depth", "above", "conv_id", "n_convs", "ended", "key"))

    first = cut_lineage(members.groupBy("conv_id").agg(F.min("depth").alias("first_depth"), F.min_by("above", "depth").alias("above")))
    childless = members.where("ended = n_convs").select("key", F.lit(1).alias("childless"))
    owners = first.select("conv_id", (F.col("first_depth") - 1).alias("owned_from"))
    sequences = (
        distinct.join(owners, "conv_id", "left").join(childless, "key", "left").join(_digested_ids(rows.select("key", "conv_id")), "key")
        .withColumn("childless", F.coalesce("childless", F.lit(0)))
    )
    nodes = cut_lineage(_nodes(sequences))

    # Many owners begin right below the root; they need no join.
    root = members.where("depth = 0").select("conv_id").first()
    top = first.where("first_depth <= 1").select("conv_id", "first_depth", F.when(F.col("first_depth") == 1, F.lit(root and root[0])).alias("from_conv"))
    deeper = first.where("first_depth > 1").join(members.select(F.col("name").alias("above"), F.col("conv_id").alias("from_conv")), "above")
    begins = top.unionByName(deeper.select("conv_id", "first_depth", "from_conv"))
    nothing = hashlib.sha256().hexdigest()
    return nodes.join(begins, "conv_id").select(
        "conv_id", "depth", F.when(F.col("depth") == F.col("first_depth"), F.col("from_conv")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
    )


def branched(rows: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """(conv_id, turns) with beginnings taken over: conversation c begins with the first h turns of conversation
    c - c % ``every``, h being the CRC-32 of its decimal number modulo ``most``, and goes on with its own after h."""
    own = cut_lineage(conversation_turns(rows))
    heads = own.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("head"), F.slice("turns", 1, most - 1).alias("head_turns"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    met = own.join(heads, F.col("conv_id") - F.col("conv_id") % every == F.col("head"), "left")
    taken: Column = F.coalesce(F.slice("head_turns", F.lit(1), h), F.slice("turns", 1, 0))
    return met.select("conv_id", F.concat(taken, F.slice("turns", h + 1, F.size("turns"))).alias("turns"))
