"""SimHash near-duplicate components by meet-in-the-middle ball hashing.

Two 64-bit fingerprints at ``radius`` or fewer differing bits share at least one
point within half the radius of both. So every distinct fingerprint emits all
its variants within half the radius (2,081 for radius 4), the variants are
shuffled, and fingerprints that meet on a variant are linked.

The shuffle carries variants in two halves: Spark explodes the variants of the
leading bits and deals on them; the task that gets a leading part completes the
variants of the trailing bits itself. The same variants meet, at about a
thirtieth of the shuffled rows. All members of a variant are within ``radius``
of each other, so each meeting gives links to its smallest member only (a
group of thousands of copies never becomes all its pairs), and every task hands
on a spanning forest of what it found. Components then come from the
large-star/small-star rounds of :func:`connected_components`.

Defined results: null and empty texts and texts without words have fingerprint
zero and link like any other; texts of any length are hashed whole; repeated rows
stay repeated; of several doc_ids a component has the smallest; a null doc_id
keeps its row and is never a component's id unless the component has no other; an
empty table gives an empty result; extra columns are ignored by
:func:`near_duplicate_components` and kept by :func:`keep_one_per_component`,
unless their names begin with ``_near_``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from aerotally.operators.graph import connected_components
from aerotally.plans.storage import materialise

SEED = 42
WORDS_PER_SHINGLE = 4
RADIUS = 4
#: Variants that one leading part should hold on average, and in one sorted pass.
VARIANTS_PER_BUCKET, VARIANTS_PER_PASS = 1 << 20, 1 << 21
#: Fingerprints that a leading part may get, bits that it grows by where there are more, and its longest.
MOST_PER_BUCKET, MORE_BITS, MOST_BITS = 4_000_000, 12, 48
#: A fingerprint is hot if more than one row in so many has it.
HOT_SHARE = 1000
#: Ids that are broadcast at most, to leave out their documents (some 64 MB).
MOST_GONE = 2_000_000
#: Shingles whose bits are unpacked at once.
_SHINGLES_AT_ONCE = 1 << 16


def _mixed(hashes: np.ndarray, turn: int) -> np.ndarray:
    """A further 64-bit hash of each hash: turn 0 is the hash itself, the others are its SplitMix64 from another start."""
    if not turn:
        return hashes
    z = hashes + np.uint64(turn * 0x9E3779B97F4A7C15 & 2**64 - 1)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprint_set(text: bytes | None, shingle_words: int = WORDS_PER_SHINGLE, tables: int = 1) -> np.ndarray:
    """SimHashes of UTF-8 bytes: majority bits of the hashes of all word shingles, repeats counted; the first is of their XXH64."""
    words = (text or b"").lower().split()  # bytes: lower-cases A-Z and splits at x20, x09-x0D only
    if not words:
        return np.zeros(tables, np.uint64)
    whole = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle_words:  # one shingle: its own majority
        one = np.array([digest(whole, SEED)], np.uint64)
        return np.concatenate([_mixed(one, t) for t in range(tables)])
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-shingle_words].tolist()]
    stops = (ends[shingle_words - 1 :] - 1).tolist()
    ones = np.zeros((tables, 64), np.int64)
    for at in range(0, len(starts), _SHINGLES_AT_ONCE):
        part = zip(starts[at : at + _SHINGLES_AT_ONCE], stops[at : at + _SHINGLES_AT_ONCE])
        hashes = np.array([digest(whole[a:b], SEED) for a, b in part], np.uint64)
        for t in range(tables):
            ones[t] += np.unpackbits(_mixed(hashes, t).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(starts), axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprint(text: bytes | None, shingle_words: int = WORDS_PER_SHINGLE) -> int:
    """The SimHash of UTF-8 bytes."""
    return int(fingerprint_set(text, shingle_words)[0])


def set_key(fps: np.ndarray) -> int:
    """A signed long that names a set of fingerprints: a single one is its own name."""
    if len(fps) == 1:
        return int(fps.astype(np.int64)[0])
    return int(np.uint64(xxhash.xxh3_64_intdigest(fps.tobytes(), SEED)).astype(np.int64))


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle_words: int = WORDS_PER_SHINGLE, tables: int = 1) -> DataFrame:
    """``(doc_id, fp, fps)`` for every row; fps are the fingerprints as signed longs, fp names them all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint_set(t.as_py(), shingle_words, tables) for t in batch.column(1)]
            columns = [batch.column(0), pa.array([set_key(f) for f in found], pa.int64()), pa.array([f.astype(np.int64) for f in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fp", "fps"])

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long, fps array<long>")


def _masks(bits: int, flips: int) -> np.ndarray:
    """All numbers of ``bits`` bits with at most ``flips`` set; 0 first."""
    out = np.zeros(1, np.uint64)
    level = [0]
    for _ in range(flips):
        level = sorted({m | 1 << i for m in level for i in range(bits) if not m >> i & 1})
        out = np.concatenate([out, np.array(level, np.uint64)])
    return out


def _ball(bits: int, flips: int) -> int:
    return sum(math.comb(bits, i) for i in range(flips + 1))


def _bucket_forest(fps: np.ndarray, head: int, head_bits: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among fingerprints that meet on a variant with this leading part, as a spanning forest."""
    tail_bits = 64 - head_bits
    spent = np.bitwise_count((fps >> np.uint64(tail_bits)) ^ np.uint64(head))
    tails = fps & np.uint64((1 << tail_bits) - 1)
    groups = [(np.flatnonzero(spent == j).astype(np.int32), _masks(tail_bits, half - j)) for j in range(half + 1)]
    total = sum(len(rows) * len(masks) for rows, masks in groups)
    passes = max(1, -(-total // VARIANTS_PER_PASS))
    label = np.arange(len(fps))
    for turn in range(passes):
        variants, owners = [], []
        for rows, masks in groups:
            for at in range(0, len(rows), step := max(1, VARIANTS_PER_PASS // len(masks))):
                some = rows[at : at + step]
                v, o = (tails[some][:, None] ^ masks).ravel(), np.repeat(some, len(masks))
                if passes > 1:
                    mine = ((v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(passes) == turn
                    v, o = v[mine], o[mine]
                variants.append(v)
                owners.append(o)
        v, o = np.concatenate(variants), np.concatenate(owners)
        order = np.argsort(v)
        v, o = v[order], o[order]
        del order
        first = np.r_[True, v[1:] != v[:-1]]
        met = ~first | np.r_[~first[1:], False]  # variants of one fingerprint only are of no use
        first, o = first[met], o[met]
        if not len(o):
            continue
        low = np.minimum.reduceat(o, np.flatnonzero(first))[np.cumsum(first) - 1]
        pairs = np.unique(np.stack([low, o], 1)[low != o], axis=0)
        a, b = pairs[:, 0], pairs[:, 1]
        near = np.bitwise_count(fps[a] ^ fps[b]) <= 2 * half  # the verification
        a, b = a[near], b[near]
        while True:
            before = label.copy()
            m = np.minimum(label[a], label[b])
            np.minimum.at(label, label[a], m)
            np.minimum.at(label, label[b], m)
            label = label[label]
            if (before == label).all():
                break
    child = np.flatnonzero(label != np.arange(len(fps)))
    return fps[label[child]], fps[child]


def fingerprint_links(fps: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """Edges ``(src, dst)`` whose closure joins exactly the distinct ``fp`` within ``radius`` bits of each other.

    ``n`` is the number of distinct fingerprints: it sets how many leading bits
    the shuffle deals on, nothing else.
    """
    if radius < 2 or radius % 2:
        raise ValueError("radius must be even and at least 2")
    half = radius // 2
    head_bits = min(24, max(6, math.ceil(math.log2(max(1, n) * _ball(64, half) / VARIANTS_PER_BUCKET + 1))))
    found = None
    todo = fps.select("fp")
    crowded = None
    while True:
        mine = _dealt(todo, head_bits, half)
        if crowded is not None:  # only what the last round left
            mine = mine.withColumn("before", F.expr(f"shiftrightunsigned(head, {MORE_BITS})")).join(crowded.select(F.col("head").alias("before")), "before", "left_semi").select("fp", "head")
        heads = _crowded(todo, head_bits, half) if head_bits < MOST_BITS else None
        crowded = None if heads is None or heads.isEmpty() else heads
        usual = mine if crowded is None else mine.join(crowded, "head", "left_anti")
        some = usual.groupBy("head").applyInPandas(_link_heads(head_bits, half), "src long, dst long").distinct()
        found = some if found is None else found.unionByName(some)
        if crowded is None:
            return found
        todo = materialise(mine.join(crowded, "head", "left_semi").select("fp").distinct(), "simhash-crowded")
        head_bits += MORE_BITS


def _dealt(fps: DataFrame, head_bits: int, half: int) -> DataFrame:
    """``(fp, head)``: every fingerprint with the variants of its leading bits."""
    flips = F.array(*[F.lit(int(m)) for m in _masks(head_bits, half)])
    head = F.expr(f"shiftrightunsigned(fp, {64 - head_bits})")
    return fps.select("fp", head.alias("head"), F.explode(flips).alias("flip")).select("fp", F.col("head").bitwiseXOR(F.col("flip")).alias("head"))


def _crowded(fps: DataFrame, head_bits: int, half: int) -> DataFrame:
    """``(head)``: leading parts that more than ``MOST_PER_BUCKET`` fingerprints have as a variant, from counts of the fingerprints' own."""
    own = fps.groupBy(F.expr(f"shiftrightunsigned(fp, {64 - head_bits})").alias("head")).agg(F.count("*").alias("n"))
    flips = F.array(*[F.lit(int(m)) for m in _masks(head_bits, half)])
    near = own.select("n", "head", F.explode(flips).alias("flip")).select("n", F.col("head").bitwiseXOR(F.col("flip")).alias("head"))
    heads = near.groupBy("head").agg(F.sum("n").alias("n")).where(F.col("n") > MOST_PER_BUCKET).select("head")
    return materialise(heads, "simhash-heads")


def _link_heads(head_bits: int, half: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def links(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = np.sort(rows["fp"].to_numpy(np.int64)).view(np.uint64)
        a, b = _bucket_forest(found, int(key[0]), head_bits, half)
        return pd.DataFrame({"src": a.view(np.int64), "dst": b.view(np.int64)})

    return links


def hex_fingerprint(fp: Column) -> Column:
    """16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicate_components(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle_words: int = WORDS_PER_SHINGLE, radius: int = RADIUS, tables: int = 1) -> DataFrame:
    """``(doc_id, fp, group_fp, component_id)`` per row; component_id is the smallest doc_id reachable over links, group_fp names the component by a fingerprint.

    With several ``tables``, a document has so many independent fingerprints, and
    two documents are linked if they are within ``radius`` in any of them.
    """
    rows = materialise(fingerprints(docs, doc_id=doc_id, text=text, shingle_words=shingle_words, tables=tables), "simhash-fp")
    by_fp = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"), F.first("fps").alias("fps")), "simhash-distinct")
    edges = None
    for t in range(tables):
        nodes = by_fp.select(F.col("fps")[t].alias("own"), F.col("fp").alias("node"))
        if tables == 1:
            some = fingerprint_links(nodes.select(F.col("own").alias("fp")), by_fp.count(), radius)
        else:
            of = materialise(nodes.groupBy("own").agg(F.min("node").alias("first"), F.count("*").alias("n")), "simhash-table")
            links = fingerprint_links(of.select(F.col("own").alias("fp")), of.count(), radius)
            named = links.join(of.select(F.col("own").alias("src"), F.col("first").alias("a")), "src").join(of.select(F.col("own").alias("dst"), F.col("first").alias("b")), "dst").select("a", "b")
            same = nodes.join(of.where("n > 1"), "own").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
            some = materialise(named.unionByName(same).toDF("src", "dst"), "simhash-links")
        edges = some if edges is None else edges.unionByName(some)
    return answered(rows.select("doc_id", "fp"), by_fp.drop("fps"), connected_components(edges))


def answered(rows: DataFrame, by_fp: DataFrame, roots: DataFrame) -> DataFrame:
    """``(doc_id, fp, group_fp, component_id)`` per row of ``(doc_id, fp)``.

    ``by_fp`` has ``(fp, first_doc, copies)`` per distinct fp, ``roots`` the
    ``(node, component)`` of those that have links.
    """
    roots = materialise(roots, "near-roots").withColumnRenamed("node", "fp")
    linked = roots.join(by_fp, "fp").groupBy("component").agg(F.min("first_doc").alias("component_id"))
    of_linked = roots.join(linked, "component").select("fp", "component", "component_id")
    answer = by_fp.join(of_linked, "fp", "left").select("fp", "copies", F.coalesce("component", "fp").alias("group_fp"), F.coalesce("component_id", "first_doc").alias("component_id"))
    answer = materialise(answer, "near-answer")
    total = by_fp.agg(F.sum("copies")).first()[0] or 0
    hot = F.broadcast(answer.where(F.col("copies") * HOT_SHARE > total).select(F.col("fp").alias("hot_fp"), "group_fp", "component_id"))  # HOT_SHARE rows at most
    cold = answer.where(F.col("copies") * HOT_SHARE <= total).select("fp", "group_fp", "component_id")
    warm = rows.join(hot, F.col("fp") == F.col("hot_fp")).select("doc_id", "fp", "group_fp", "component_id")
    rest = rows.join(hot.select("hot_fp"), F.col("fp") == F.col("hot_fp"), "left_anti").join(cold, "fp")
    return warm.unionByName(rest.select("doc_id", "fp", "group_fp", "component_id"))


def keep_one_per_component(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **parameters) -> DataFrame:
    """The rows of ``docs`` whose doc_id names their component: one document of each group.

    Rows that repeat a doc_id are reduced to one of them; rows with a null
    doc_id stay only where their component has no doc_id at all, one of each.
    """
    shingle_words, tables = parameters.get("shingle_words", WORDS_PER_SHINGLE), parameters.get("tables", 1)
    found = near_duplicate_components(docs, doc_id=doc_id, text=text, **parameters)
    return keep_named(docs, found, lambda t: set_key(fingerprint_set(t, shingle_words, tables)), doc_id=doc_id, text=text)


def keep_named(docs: DataFrame, found: DataFrame, mark: Callable[[bytes | None], int], *, doc_id: str, text: str) -> DataFrame:
    """One row of ``docs`` per component of ``found``; ``mark`` gives the ``fp`` of a text."""
    kept = materialise(found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("copies")), "near-kept")
    once = kept.where("copies = 1").select(F.col("doc_id").alias("_near_kept"))
    more = kept.where("copies > 1").select(F.col("doc_id").alias("_near_kept"))
    mine = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.withColumn("_near_key", F.col(f"`{doc_id}`").cast("long"))
    same = F.col("_near_key") == F.col("_near_kept")
    # what goes is far less than what stays: as long as it is so few ids, no text is shuffled
    gone = found.where("doc_id is not null").select(F.col("doc_id").alias("_near_kept")).distinct().join(once, "_near_kept", "left_anti")
    gone = materialise(gone, "near-gone")  # with the ids that several rows have
    if gone.count() <= MOST_GONE:
        unique = keyed.where("_near_key is not null").join(F.broadcast(gone), same, "left_anti")
    else:
        unique = keyed.join(once, same, "left_semi")
    # rows that share a kept id; a join that finds no such id would have shuffled all texts first
    n_more = more.count()
    kept_rows = unique.select(*mine)
    if n_more:
        repeated = keyed.join(F.broadcast(more) if n_more <= MOST_GONE else more, same, "left_semi").dropDuplicates(["_near_key"])
        kept_rows = kept_rows.unionByName(repeated.select(*mine))
    nameless = materialise(found.where("doc_id is null and component_id is null").select(F.col("fp").alias("_near_fp"), F.col("group_fp").alias("_near_group")).distinct(), "near-nameless")
    if nameless.isEmpty():
        return kept_rows
    marks = F.pandas_udf(lambda s: s.map(mark), "long")
    lost = keyed.where("_near_key is null").withColumn("_near_fp", marks(F.col(f"`{text}`").cast("binary")))
    return kept_rows.unionByName(lost.join(nameless, "_near_fp").dropDuplicates(["_near_group"]).select(*mine))
