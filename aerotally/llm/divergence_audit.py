"""How the sources of a language differ in their words, by a pointer sort of word starts.

Terms are runs of ASCII letters and of all that isn't ASCII, A-Z lower-cased. A
language keeps the terms that at least MIN_DOCS of its documents hold. A group
(language, source) and a language as a whole give each kept term the smoothed
share p = 1 + floor(10^9 (count + 1) / (N + V)); the divergence of a term is
floor((p - q)^2 / q), in whole numbers throughout.

Counting works on the Arrow buffers themselves: word starts are pointers into
the UTF-8 bytes of a batch, and slices of pointers are sorted by multikey
quicksort whose character is eight bytes (runs that tie on eight bytes go on
with the next eight). Equal runs are terms; as the sort keeps the order of
documents, steps within a run give the document frequency, and sums by the
document's group give the counts of sources. A task merges its slices by the same
sort and emits (language, bucket of terms) pieces; buckets merge theirs while
they stream in, so a task holds its own distinct terms and not the pieces.

Pairs of sources are compared in the buckets, a matrix of terms and sources at a
time, and added up; of a group's terms a bucket hands on the first RANKS only,
which is exact as the order is total. A language's pairs are the square of its
sources, as the result is.

Defined results: a null text, lang or source is the empty string; repeated rows
are documents of their own; a group without terms, and a language without kept
terms, gives pairs (of value 0 if nothing is kept) and no terms; ties of value go
by the item's UTF-8 bytes; texts of any length are read whole; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from aerotally.plans.storage import materialise

MIN_DOCS, SCALE_STEPS, RANKS = 3, 3, 200
#: Bytes of whole documents whose words are found together, and pointers that are sorted together.
BYTES_AT_ONCE, POINTERS_AT_ONCE = 1 << 23, 1 << 20
#: Counts (a term in a group) that a task gathers before it emits them.
GATHERED = 3_000_000
#: Terms in a row of kept ones, cells of a matrix of terms and sources, and bytes of text in a bucket beyond the first BUCKETS buckets.
TERMS_PER_ROW, CELLS, BYTES_PER_BUCKET, BUCKETS = 50_000, 1 << 20, 1 << 28, 64

_IN_TERM = np.zeros(256, bool)
_IN_TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: Keeps the first n of eight bytes.
_FIRST = np.array([0] + [(0xFFFFFFFFFFFFFFFF << (64 - 8 * n)) & 0xFFFFFFFFFFFFFFFF for n in range(1, 9)], np.uint64)


def _eight(data: np.ndarray, starts: np.ndarray, lens: np.ndarray, level: int) -> np.ndarray:
    """The terms' bytes from 8 * level on as big-endian numbers, zero beyond the end; ``data`` ends with eight bytes more."""
    view = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
    return view[np.minimum(starts + 8 * level, len(data) - 8)].astype(np.uint64) & _FIRST[np.clip(lens - 8 * level, 0, 8)]


def pointer_sort(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stable order of the terms, and where a run of equal ones begins."""
    key = _eight(data, starts, lens, 0)
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.r_[True, key[1:] != key[:-1]][: len(order)]
    at, level = np.arange(len(order)), 0
    while True:
        # go on where a run has several terms that are longer than what was compared
        begins = np.flatnonzero(new[at])
        sizes = np.diff(np.r_[begins, len(at)])
        some = np.repeat(sizes > 1, sizes) & (key & np.uint64(0xFF) > 0)
        at, level = at[some], level + 1
        if not len(at):
            return order, new
        own, run = order[at], np.cumsum(new[at])
        key = _eight(data, starts[own], lens[own], level)
        within = np.lexsort((key, run))
        order[at], key = own[within], key[within]
        new[at[1:]] |= key[1:] != key[:-1]


def term_pointers(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and document of each term of the documents between ``bounds`` in ``data``."""
    inside = _IN_TERM[data]
    before = np.r_[False, inside[:-1]][: len(inside)]
    bounds = bounds - bounds[0]
    edges = bounds[bounds < len(data)]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.r_[inside[1:], False][: len(inside)]
    after[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends - starts, np.searchsorted(bounds, starts, "right") - 1


def _reduced(data: np.ndarray, starts: np.ndarray, lens: np.ndarray, docs: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """One row per (term, document) in the order of terms and, within, of documents; and where a term begins."""
    order, new = pointer_sort(data, starts, lens)
    doc = docs[order]
    step = new | np.r_[True, doc[1:] != doc[:-1]][: len(doc)]
    at = np.flatnonzero(step)
    own = order[at]
    return starts[own], lens[own], docs[own], np.add.reduceat(n[order], at) if len(at) else n[:0], new[at]


class Counts:
    """Distinct terms in order, and counts of (term, group): occurrences and documents."""

    def __init__(self, data: np.ndarray, lens: np.ndarray, term: np.ndarray, group: np.ndarray, n: np.ndarray, docs: np.ndarray):
        self.data, self.lens, self.term, self.group, self.n, self.docs = data, lens, term, group, n, docs

    @staticmethod
    def summed(data: np.ndarray, lens: np.ndarray, term: np.ndarray, group: np.ndarray, n: np.ndarray, docs: np.ndarray) -> Counts:
        width = int(group.max(initial=0)) + 1
        key = term.astype(np.int64) * width + group
        order = np.argsort(key, kind="stable")
        key = key[order]
        at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
        add = lambda v: np.add.reduceat(v[order], at) if len(at) else v[:0]
        return Counts(data, lens, key[at] // width, key[at] % width, add(n), add(docs))

    @staticmethod
    def of(data: np.ndarray, starts: np.ndarray, lens: np.ndarray, docs: np.ndarray, groups: np.ndarray) -> Counts:
        """Counts of the terms at the pointers; ``groups`` has each document's group."""
        rows = [_reduced(data, *(v[at : at + POINTERS_AT_ONCE] for v in (starts, lens, docs)), np.ones(len(starts[at : at + POINTERS_AT_ONCE]), np.int64)) for at in range(0, len(starts), POINTERS_AT_ONCE)]
        if len(rows) > 1:  # a document may lie in several slices
            rows = [_reduced(data, *(np.concatenate(v) for v in list(zip(*rows))[:4]))]
        starts, lens, docs, n, new = rows[0] if rows else (starts, lens, docs, docs, np.zeros(0, bool))
        return Counts.summed(gathered(data, starts[new], lens[new]), lens[new], np.cumsum(new) - 1, groups[docs], n, np.ones(len(n), np.int64))

    @staticmethod
    def merged(parts: list[Counts]) -> Counts:
        if len(parts) == 1:
            return parts[0]
        data = np.concatenate([*(p.data for p in parts), np.zeros(8, np.uint8)])
        lens = np.concatenate([p.lens for p in parts])
        starts = np.cumsum(lens) - lens
        order, new = pointer_sort(data, starts, lens)
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        first = np.cumsum([0, *(len(p.lens) for p in parts)])
        term = np.concatenate([place[p.term + f] for p, f in zip(parts, first)])
        own = order[new]
        return Counts.summed(gathered(data, starts[own], lens[own]), lens[own], term, *(np.concatenate([getattr(p, k) for p in parts]) for k in ("group", "n", "docs")))

    def only(self, terms: np.ndarray, entries: np.ndarray) -> Counts:
        """The marked entries, and the marked terms they belong to."""
        starts = np.cumsum(self.lens) - self.lens
        place = np.cumsum(terms) - 1
        return Counts(gathered(self.data, starts[terms], self.lens[terms]), self.lens[terms], place[self.term[entries]], self.group[entries], self.n[entries], self.docs[entries])

    def hashes(self) -> np.ndarray:
        """64 bits of each term's bytes, alike in every task."""
        data, starts = np.r_[self.data, np.zeros(8, np.uint8)], np.cumsum(self.lens) - self.lens
        h = np.full(len(starts), 0x9E3779B97F4A7C15, np.uint64)
        some, level = np.arange(len(starts)), 0
        while len(some):
            h[some] = (h[some] ^ _eight(data, starts[some], self.lens[some], level)) * np.uint64(0xD6E8FEB86659FD93)
            h[some] ^= h[some] >> np.uint64(32)
            level += 1
            some = some[self.lens[some] > 8 * level]
        return h


def gathered(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The bytes of the terms, one after another."""
    total = int(lens.sum())
    shift = np.repeat(starts - (np.cumsum(lens) - lens), lens)
    return data[np.arange(total) + shift]


PIECE = "lang string, bucket int, sources array<string>, terms binary, lens binary, term binary, source binary, n binary, docs binary"


def _packed(lang: str, bucket: int, c: Counts, sources: list[str]) -> dict:
    used, own = np.unique(c.group, return_inverse=True)
    return {"lang": lang, "bucket": bucket, "sources": [sources[i] for i in used], "terms": c.data.tobytes(), "lens": c.lens.astype(np.int32).tobytes(), "term": c.term.astype(np.int32).tobytes(), "source": own.astype(np.int32).tobytes(), "n": c.n.astype(np.int64).tobytes(), "docs": c.docs.astype(np.int64).tobytes()}


def _unpacked(row: dict, known: dict[str, int]) -> Counts:
    """The piece with its sources numbered by ``known``, which grows."""
    ints = lambda k: np.frombuffer(row[k], np.int32).astype(np.int64)
    place = np.array([known.setdefault(s, len(known)) for s in row["sources"]], np.int64)
    return Counts(np.frombuffer(row["terms"], np.uint8), ints("lens"), ints("term"), place[ints("source")], np.frombuffer(row["n"], np.int64), np.frombuffer(row["docs"], np.int64))


def _arrow(rows: list[dict], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema(list(kinds.items())))


_PIECE = {"lang": pa.string(), "bucket": pa.int32(), "sources": pa.list_(pa.string())} | {k: pa.binary() for k in ("terms", "lens", "term", "source", "n", "docs")}
_KEPT = _PIECE | {"v": pa.int64(), "totals": pa.list_(pa.int64())}


def _text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, and the bounds of its values in them."""
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), bounds


def pieces(docs: DataFrame, buckets: int) -> DataFrame:
    """Counts of (term, source) and their documents, as rows by language and bucket of terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], int] = {}
        parts: list[Counts] = []

        def emitted() -> Iterator[pa.RecordBatch]:
            all_, names = Counts.merged(parts), list(groups)
            bucket = (all_.hashes() % np.uint64(buckets)).astype(np.int64)
            langs = {lang: i for i, lang in enumerate(dict.fromkeys(lang for lang, _ in names))}
            lang_of = np.array([langs[lang] for lang, _ in names])
            key = lang_of[all_.group] * buckets + bucket[all_.term]
            order = np.argsort(key, kind="stable")
            at = np.flatnonzero(np.r_[True, np.diff(key[order]) > 0][: len(order)])
            sources = [s for _, s in names]
            for a, b in zip(at, [*at[1:], len(order)]):
                own = np.sort(order[a:b])
                used, place = np.unique(all_.term[own], return_inverse=True)
                begin = starts_of(all_.lens)
                piece = Counts(gathered(all_.data, begin[used], all_.lens[used]), all_.lens[used], place, all_.group[own], all_.n[own], all_.docs[own])
                which = int(key[own[0]])
                yield _arrow([_packed(names[int(all_.group[own[0]])][0], which % buckets, piece, sources)], _PIECE)
            parts.clear()

        for batch in batches:
            data, bounds = _text_buffers(batch.column(2))
            own = np.array([groups.setdefault(g, len(groups)) for g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())], np.int64)
            first = 0
            while first < len(own):
                last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + BYTES_AT_ONCE, "right")) - 1)
                low = _LOWER[np.r_[data[bounds[first] : bounds[last]], np.zeros(8, np.uint8)]]
                starts, lens, doc = term_pointers(low[:-8], bounds[first : last + 1])
                parts.append(Counts.of(low, starts, lens, doc, own[first:last]))
                first = last
                if sum(len(p.n) for p in parts) > GATHERED:
                    parts[:] = [Counts.merged(parts)]
                    if len(parts[0].n) > GATHERED // 2:
                        yield from emitted()
        if parts:
            yield from emitted()

    return docs.select("lang", "source", "text").mapInArrow(run, PIECE)


def starts_of(lens: np.ndarray) -> np.ndarray:
    return np.cumsum(lens) - lens


def kept_terms(found: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Pieces merged by language and bucket, with only the terms that enough documents of the language hold, and what each source has of them (``totals``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, known = None, [], {}

        def done() -> Iterator[pa.RecordBatch]:
            all_ = Counts.merged(parts)
            enough = np.bincount(all_.term, all_.docs, len(all_.lens)) >= min_docs
            kept = all_.only(enough, enough[all_.term])
            names = list(known)
            for a in range(0, len(kept.lens), TERMS_PER_ROW):
                of = (kept.term >= a) & (kept.term < a + TERMS_PER_ROW)
                terms = np.zeros(len(kept.lens), bool)
                terms[a : a + TERMS_PER_ROW] = True
                row = _packed(now[0], now[1], kept.only(terms, of), names)
                source, n = np.frombuffer(row["source"], np.int32), np.frombuffer(row["n"], np.int64)
                totals = np.zeros(len(row["sources"]), np.int64)
                np.add.at(totals, source, n)
                yield _arrow([row | {"v": int(terms.sum()), "totals": totals.tolist()}], _KEPT)

        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in _PIECE}
                if (row["lang"], row["bucket"]) != now:
                    if parts:
                        yield from done()
                    now, parts, known = (row["lang"], row["bucket"]), [], {}
                parts.append(_unpacked(row, known))
                if len(parts) > 1 and sum(len(p.n) for p in parts) > max(GATHERED, 2 * len(parts[0].n)):
                    parts = [Counts.merged(parts)]
        if parts:
            yield from done()

    return found.repartition("lang", "bucket").sortWithinPartitions("lang", "bucket").mapInArrow(run, PIECE + ", v long, totals array<long>")


def shares(count: np.ndarray, below: np.ndarray | int) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / below), exact as long as below is under 9 * 10^15: long division, three digits at a time."""
    rest, found = count + 1, np.zeros_like(count + below)
    for _ in range(SCALE_STEPS):
        rest = rest * 1000
        found, rest = found * 1000 + rest // below, rest % below
    return found + 1


def compared(rows: DataFrame, ranks: int = RANKS) -> DataFrame:
    """``(lang, source, part, item, value)`` of each row of kept terms: sums for pairs of sources, and its first terms of each source.

    ``rows`` has beside the kept terms ``all_sources``, their N in ``all_n``, and
    the language's ``all_v``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                names, n_all, v = row["all_sources"], np.array(row["all_n"], np.int64), row["all_v"]
                known = {s: k for k, s in enumerate(names)}
                c = _unpacked(row, known)
                lang = row["lang"]
                step = max(1, CELLS // len(names))
                sums = np.zeros((len(names), len(names)), np.int64)
                order = np.searchsorted(c.term, np.arange(0, len(c.lens) + step, step))
                for k, a in enumerate(range(0, len(c.lens), step)):
                    of = slice(order[k], order[k + 1])
                    count = np.zeros((min(step, len(c.lens) - a), len(names)), np.int64)
                    count[c.term[of] - a, c.group[of]] = c.n[of]
                    p = shares(count, n_all + v)
                    for s in range(len(names)):
                        apart = p[:, s : s + 1] - p
                        sums[s] += (apart * apart // p).sum(0)
                for s, name in enumerate(names):
                    others = [k for k in range(len(names)) if k != s]
                    if others:
                        yield _result(lang, [name] * len(others), "pair", [names[k] for k in others], sums[s, others])
                total = np.zeros(len(c.lens), np.int64)
                np.add.at(total, c.term, c.n)
                q = shares(total, int(n_all.sum()) + v)[c.term]
                p = shares(c.n, n_all[c.group] + v)
                value = (p - q) * (p - q) // q
                more = np.flatnonzero(p > q)
                more = more[np.lexsort((c.term[more], -value[more], c.group[more]))]
                begin = np.searchsorted(c.group[more], c.group[more])
                more = more[np.arange(len(more)) - begin < ranks]  # terms are in the order of their bytes
                starts, text = starts_of(c.lens), c.data.tobytes()
                items = [text[starts[t] : starts[t] + c.lens[t]].decode("utf-8", "replace") for t in c.term[more]]
                if items:
                    yield _result(lang, [names[g] for g in c.group[more]], "term", items, value[more])

    return rows.mapInArrow(run, "lang string, source string, part string, item string, value long")


def _result(lang: str, source: list[str], part: str, item: list[str], value: np.ndarray) -> pa.RecordBatch:
    n = len(source)
    return pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(source, pa.string()), pa.array([part] * n, pa.string()), pa.array(item, pa.string()), pa.array(value, pa.int64())], names=["lang", "source", "part", "item", "value"])


def audit(documents: DataFrame, min_docs: int = MIN_DOCS, ranks: int = RANKS) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: for each group its divergence from the other sources of its language, and the terms it has more of than the language."""
    empty = F.lit("")
    docs = documents.select(*[F.coalesce(F.col(c).cast("string"), empty).alias(c) for c in ("lang", "source", "text")])
    groups = materialise(docs.groupBy("lang", "source").agg(F.sum(F.octet_length("text")).alias("bytes")), "audit-groups")
    size = groups.agg(F.sum("bytes")).first()[0] or 0
    buckets = max(BUCKETS, size // BYTES_PER_BUCKET)
    kept = materialise(kept_terms(pieces(docs, buckets), min_docs), "audit-kept")

    own = kept.select("lang", F.explode(F.arrays_zip("sources", "totals")).alias("t")).groupBy("lang", F.col("t.sources").alias("source")).agg(F.sum("t.totals").alias("n"))
    v = kept.groupBy("lang").agg(F.sum("v").alias("all_v"))
    sizes = groups.join(own, ["lang", "source"], "left").fillna(0, ["n"])
    # a language's sources go to each of its buckets: as many numbers as sources, which are as many as a group's pairs
    listed = sizes.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("s")).select("lang", F.col("s.source").alias("all_sources"), F.col("s.n").alias("all_n"))
    listed = listed.join(v, "lang").withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(int(buckets) - 1))))
    found = materialise(compared(kept.drop("totals", "v").join(listed, ["lang", "bucket"]), ranks), "audit-compared")

    pairs = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    sums = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    nth = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    terms = found.where("part = 'term'").select("*", nth).where(F.col("rank") <= ranks)
    return pairs.select("*", nth).unionByName(terms)
