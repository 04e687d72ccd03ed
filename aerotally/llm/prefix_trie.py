"""The prefix trie of conversations, with count-min screening of prefix digests.

A conversation is the sequence of its turns (role, text); a node of the trie is a
distinct sequence of first turns, its members the conversations that start with
it. Every conversation branches off a base conversation: it takes the base's
first turns and goes on with its own (:func:`rebuilt`).

A prefix has a 128-bit digest: the sum, by 32-bit limbs, of a hash of each turn's
SHA-256 and its depth. Digests of all prefixes are running sums, and the digest
of the prefix before is a subtraction.

Screening: a count-min sketch counts all digests. Tasks emit the cells that they
hit, blocks of cells are merged on the executors, and one bit per cell (hit twice
or more) goes to all tasks; its size is bounded by ``MOST_CELLS``. An estimate of
one proves that a prefix is a singleton, so nodes whose own and parent's prefix
are proven are emitted where they are. Only possibly shared prefixes, and the one
row below them, are shuffled for exact grouping. A sketch too small for the data
proves less and changes no result.

Subtrees need no walk: a node is owned by its smallest member, and what a
conversation owns is the end of its path. So a node's sum over its subtree is the
sum, over its members, of what each owns from that depth on: running sums along
conversations and one more grouping by digest.

Member lists are hashed in order: ranges of (node, conv_id) are joined to pieces
of text in parallel, and only the pieces of a node meet in one task, which
streams them through SHA-256 and holds one piece at a time.

Defined results: a null role or text is empty; a null turn comes first; turns
that tie are ordered by the SHA-256 of their content; repeated rows are turns of
their own; rows with a null conv_id take no part; without any conversation there
is no root; texts of any length are read whole; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from aerotally.operators.ranking import running_sums
from aerotally.plans.storage import materialise

WORD = r"[^\x20\x09-\x0D]+"
FAMILY, HEADS = 20, 4
#: The sketch has LINES lines of cells, CELLS_PER_PREFIX of them per prefix and MOST_CELLS at most (16 MB of bits a line).
LINES, CELLS_PER_PREFIX, MOST_CELLS, BLOCK = 4, 8, 1 << 27, 1 << 16
#: Bytes of a piece of a member list.
PIECE = 1 << 20
LIMB = (1 << 32) - 1
NODE = ["depth", "d1", "d2"]


def turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, key, words)``: a turn's content as its SHA-256, and the words of its text."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    content = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.where(F.col("conv_id").isNotNull())
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(F.sha2(content, 256)).alias("key"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))


def heads(conv_id: Column) -> Column:
    """How many first turns a conversation takes from its base."""
    return F.crc32(conv_id.cast("string")) % HEADS


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(conv_id, depth, key, words, length)`` of all rebuilt turns, and ``(conv_id, length)`` of all conversations.

    Conversation c takes the first :func:`heads` turns of c - c % 20, all if
    there are fewer and none if there is no such conversation, and goes on with
    its own turns after as many.
    """
    numbered = materialise(running_sums(turns(conversations), ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("key")], {"at": F.lit(1)}), "trie-turns")
    sizes = materialise(numbered.groupBy("conv_id").agg(F.max("at").alias("n")), "trie-sizes")
    bases = sizes.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    info = sizes.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).join(bases, "base", "left")
    taken = F.least(heads(F.col("conv_id")), F.coalesce("n_base", F.lit(0)))
    info = info.select("conv_id", "base", heads(F.col("conv_id")).alias("h"), taken.alias("taken"), (taken + F.greatest(F.col("n") - heads(F.col("conv_id")), F.lit(0))).alias("length"))
    info = materialise(info, "trie-conversations")
    first = numbered.where((F.col("conv_id") % FAMILY == 0) & (F.col("at") < HEADS)).select(F.col("conv_id").alias("base"), "at", "key", "words")
    borrowed = info.join(first, "base").where("at <= taken").select("conv_id", F.col("at").alias("depth"), "key", "words", "length")
    own = numbered.join(info, "conv_id").where("at > h").select("conv_id", (F.col("at") - F.col("h") + F.col("taken")).alias("depth"), "key", "words", "length")
    return borrowed.unionByName(own), info.select("conv_id", "length")


def prefixes(rows: DataFrame) -> DataFrame:
    """``(conv_id, depth, d1, d2, p1, p2, words, length)``: the digest of each prefix and of the one before it."""
    one, two = F.xxhash64("key", "depth"), F.xxhash64("depth", "key", F.lit(2))
    limbs = {"a": F.shiftrightunsigned(one, 32), "b": one.bitwiseAND(LIMB), "c": F.shiftrightunsigned(two, 32), "d": two.bitwiseAND(LIMB)}
    summed = running_sums(rows, ["conv_id"], [F.col("depth")], limbs)

    def digest(high: str, low: str, minus: bool) -> Column:
        part = lambda k: (F.col(k) - limbs[k] if minus else F.col(k)).bitwiseAND(LIMB)
        return F.shiftleft(part(high), 32).bitwiseOR(part(low))

    found = [digest("a", "b", False).alias("d1"), digest("c", "d", False).alias("d2"), digest("a", "b", True).alias("p1"), digest("c", "d", True).alias("p2")]
    return summed.select("conv_id", "depth", *found, "words", "length")


def _cells(one: np.ndarray, two: np.ndarray, line: int, width: int) -> np.ndarray:
    return (one.view(np.uint64) + np.uint64(line) * (two.view(np.uint64) | np.uint64(1))) & np.uint64(width - 1)


def _longs(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def sketch(rows: DataFrame, width: int) -> np.ndarray:
    """The cells that were hit twice or more, as ``LINES`` lines of ``width`` packed bits."""

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = _longs(batch, "d1"), _longs(batch, "d2")
            for line in range(LINES if len(one) else 0):
                at, n = np.unique(_cells(one, two, line, width), return_counts=True)
                blocks, begin = np.unique(at // BLOCK, return_index=True)
                packed = (at % BLOCK).astype(np.uint32) * np.uint32(2) + (n > 1).astype(np.uint32)
                pieces = [p.tobytes() for p in np.split(packed, begin[1:])]
                yield pa.RecordBatch.from_arrays([pa.array([line] * len(blocks), pa.int32()), pa.array(blocks.astype(np.int64)), pa.array(pieces, pa.binary())], names=["line", "block", "hits"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen = None, None

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int64()), pa.array([np.packbits(seen > 1).tobytes()], pa.binary())], names=["line", "block", "bits"])

        for batch in batches:
            for line, block, hit in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if (line, block) != now:
                    if now:
                        yield packed()
                    now, seen = (line, block), np.zeros(BLOCK, np.uint8)
                at = np.frombuffer(hit.as_buffer(), np.uint32)
                where = at >> 1
                seen[where] = np.minimum(seen[where] + 1 + (at & 1).astype(np.uint8), 2)
        if now:
            yield packed()

    parts = rows.select("d1", "d2").mapInArrow(hits, "line int, block long, hits binary")
    blocks = parts.repartition("line", "block").sortWithinPartitions("line", "block").mapInArrow(merged, "line int, block long, bits binary")
    bits = np.zeros((LINES, width // 8), np.uint8)
    for r in blocks.toLocalIterator():  # LINES * width / 8 bytes in all
        bits[r.line, r.block * BLOCK // 8 : (r.block + 1) * BLOCK // 8] = np.frombuffer(r.bits, np.uint8)
    return bits


def screened(rows: DataFrame, cells_per_prefix: int = CELLS_PER_PREFIX, most_cells: int = MOST_CELLS) -> DataFrame:
    """``rows`` of :func:`prefixes` with ``open`` and ``parent_open``: false where a prefix, or the one before it, is proven a singleton. The root's is always open."""
    width = BLOCK
    wanted = min(most_cells, cells_per_prefix * rows.count())
    while width < wanted:
        width *= 2
    bits = rows.sparkSession.sparkContext.broadcast(sketch(rows, width))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = bits.value

        def estimate(one: np.ndarray, two: np.ndarray) -> np.ndarray:
            found = np.ones(len(one), bool)
            for line in range(LINES):
                at = _cells(one, two, line, width)
                found &= (twice[line, (at >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1 == 1
            return found

        for batch in batches:
            now = estimate(_longs(batch, "d1"), _longs(batch, "d2"))
            before = estimate(_longs(batch, "p1"), _longs(batch, "p2")) | (_longs(batch, "depth") == 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(now), pa.array(before)], names=[*kept, "open", "parent_open"])

    kept = ["conv_id", "depth", "d1", "d2", "words", "length"]
    schema = ", ".join(f"{c} long" for c in kept) + ", open boolean, parent_open boolean"
    return rows.mapInArrow(look, schema)


def member_hashes(ends: DataFrame) -> DataFrame:
    """``(depth, d1, d2, ends_sha256)`` of ``(depth, d1, d2, conv_id)``: the SHA-256 of each node's ids in ascending order, comma-joined."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = np.stack([_longs(batch, c) for c in NODE], 1)
            if not len(node):
                continue
            ids = batch.column("conv_id").to_pylist()
            new = np.r_[True, (node[1:] != node[:-1]).any(1)]
            begin = [*np.flatnonzero(new), len(ids)]
            cut = [k for a, b in zip(begin, begin[1:]) for k in range(a, b, PIECE // 20)]
            texts = [",".join(map(str, ids[a : min(b, begin[np.searchsorted(begin, a, "right")])])) for a, b in zip(cut, [*cut[1:], len(ids)])]
            yield pa.RecordBatch.from_arrays([*(pa.array(node[cut, k]) for k in range(3)), pa.array([ids[a] for a in cut], pa.int64()), pa.array(texts, pa.string())], names=[*NODE, "first", "piece"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def done(found: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([f[0][k] for f in found], pa.int64()) for k in range(3)), pa.array([f[1] for f in found], pa.string())], names=[*NODE, "ends_sha256"])

        for batch in batches:
            found = []
            for node, piece in zip(zip(*(batch.column(c).to_pylist() for c in NODE)), batch.column("piece")):
                if node == now:
                    state.update(b",")
                else:
                    if now:
                        found.append((now, state.hexdigest()))
                    now, state = node, hashlib.sha256()
                state.update(piece.as_buffer())
            yield done(found)
        if now:
            yield done([(now, state.hexdigest())])

    ranged = ends.select(*NODE, "conv_id").repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    cut = ranged.mapInArrow(pieces, "depth long, d1 long, d2 long, first long, piece string")
    return cut.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(fold, "depth long, d1 long, d2 long, ends_sha256 string")


def trie(conversations: DataFrame, cells_per_prefix: int = CELLS_PER_PREFIX, most_cells: int = MOST_CELLS) -> DataFrame:
    """A row per node of the trie of rebuilt conversations.

    ``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256)``; a node is named by its smallest member and its
    depth. ``saved_tokens`` sums, over the subtree, (n_convs - 1) times the words
    of a node's last text; ``ends_sha256`` is over the ids of the members that
    end at the node.
    """
    found, convs = rebuilt(conversations)
    rows = materialise(screened(materialise(prefixes(found), "trie-prefixes"), cells_per_prefix, most_cells), "trie-screened")
    root_id = convs.agg(F.min("conv_id")).first()[0]
    nothing = hashlib.sha256(b"").hexdigest()
    lone_end = F.when(F.col("depth") == F.col("length"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(nothing)
    tails = rows.where("not open and not parent_open").select(
        "conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"), (F.col("depth") < F.col("length")).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), lone_end.alias("ends_sha256"),
    )

    maybe = rows.where("open or parent_open").drop("open", "parent_open")
    shared = maybe.groupBy(*NODE).agg(F.count("*").alias("n"), F.min("conv_id").alias("smallest"), F.max("length").alias("deepest")).where("n > 1")
    joined = maybe.join(materialise(shared, "trie-shared"), NODE, "left")  # written first, so that a large node's rows can be split
    own = F.col("smallest") == F.col("conv_id")
    paths = joined.withColumns({"n": F.coalesce("n", F.lit(1)), "smallest": F.coalesce("smallest", "conv_id"), "deepest": F.coalesce("deepest", "length")})
    paths = materialise(running_sums(paths.withColumn("saves", F.when(own, (F.col("n") - 1) * F.col("words")).otherwise(0)), ["conv_id"], [F.col("depth")], {"saved_to": F.col("saves")}), "trie-paths")

    # what holds along a conversation's path: nodes of others end at depth `others`, below it the nodes are its own
    ends_here = F.col("depth") == F.col("length")
    along = paths.groupBy("conv_id").agg(
        F.sum((~own).cast("long")).alias("others"), F.max(F.when(~own, F.col("smallest"))).alias("owner_above"), F.sum("saves").alias("saves_all"),
        F.coalesce(F.max(F.when(ends_here, (own & (F.col("deepest") == F.col("length"))).cast("long"))), F.lit(1)).alias("leaf"),
    )
    along = materialise(along, "trie-along")
    steps = paths.join(along, "conv_id")
    parent = F.when(F.col("depth") - 1 > F.col("others"), F.col("conv_id")).otherwise(F.coalesce("owner_above", F.lit(root_id).cast("long")))
    goes_on = (F.col("others") <= F.col("depth")) & (F.col("depth") < F.col("length"))
    nodes = steps.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.max(F.when(own, parent)).alias("parent_conv_id"), F.count("*").alias("n_convs"), F.sum(goes_on.cast("long")).alias("n_children"),
        F.sum("leaf").alias("n_leaves"), F.sum(F.col("saves_all") - F.col("saved_to") + F.col("saves")).alias("saved_tokens"), F.max("length").alias("length"),
    )

    under = along.agg(F.sum((F.col("others") == 0).cast("long")).alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum("saves_all").alias("saved_tokens"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("length").alias("length")).where("n_convs > 0").crossJoin(F.broadcast(under))  # one row each
    root = root.select(
        F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("d1"), F.lit(0).cast("long").alias("d2"), "conv_id", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs",
        F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"), "length",
    )
    empty = convs.where("length = 0").select(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("d1"), F.lit(0).cast("long").alias("d2"), "conv_id")
    ends = member_hashes(paths.where("depth = length and n > 1").select(*NODE, "conv_id").unionByName(empty))
    # a lone member that isn't among the hashed ends is its own list
    alone = F.when((F.col("n_convs") == 1) & (F.col("depth") > 0), lone_end).otherwise(nothing)
    whole = nodes.unionByName(root).join(ends, NODE, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", alone))
    return whole.select(tails.columns).unionByName(tails)
