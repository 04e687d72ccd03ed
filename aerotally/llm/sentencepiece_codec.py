"""SentencePiece encoding and decoding on the tokenizers library.

The model protobuf is read field by field (no generated classes), and its parts
are rebuilt: normaliser (precompiled character map, extra-whitespace rule, dummy
prefix, metaspace marker), unigram scores or BPE merges, byte fallback and the
decoder that undoes them. Executors rebuild it once per Python worker from the
model's bytes, which travel with the task (a model is well below a megabyte or
two), and encode Arrow batches with the library's threads.

Parity with the sentencepiece library is verified on a fixed set of awkward
strings when a worker starts, and then on everything it encodes (each distinct
unit, where the model allows that, else each text). The same ids are decoded by
the rebuilt decoder and compared with the normalised text: ``round_trip`` says
whether they agree. A difference of ids raises, it is not counted away.

Defined results: null and empty texts have no ids and decode to an empty text;
repeated rows are encoded each; an empty table gives an empty result; texts of
any length are encoded whole; extra columns are kept by :func:`encode`, unless
they have the names of its results, which replace them.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain, pairwise, repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Units that a worker keeps during a task, and from one task to the next (about 150 bytes each, several times that while the table is changed).
KNOWN_UNITS, KEPT_UNITS = 60_000, 20_000
#: Bytes of text that are held as units at once, unless one text is longer.
SLICE_BYTES = 1 << 20
#: Units that are encoded as one string, and threads of the tokenizers library in a worker.
CHUNK, THREADS = 256, 2
_UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Texts with what tokenizers get wrong most: runs of spaces, controls, markers and special strings as text, bytes without a piece.
PROBES = ("", " ", "  two  spaces ", "a", "\n\n\tx \r\n", "<s> </s> <unk> <0x41>", "▁marker▁", "é ü ß ñ 漢字 かな \U0001f600‍", "aaaaaaaaaaaaaaaaaaaaaaaa", "end ", "12345.67 +1 (555) %%%&&& | ||", "\x00\x01\x7f", "x" * 300)


@dataclass
class Model:
    """What the protobuf holds of use for encoding."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    trim: bool = True
    escape: bool = True
    suffix: bool = False
    unknown: int = 0


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message, in order."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {kind} has no place in a model file")
        yield tag >> 3, value


def parse_model(data: bytes) -> Model:
    """The pieces (text, score, type) and specs of a SentencePiece ModelProto."""
    model = Model()
    for number, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode("utf-8")
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            model.pieces.append((piece, score, kind))
        elif number == 2:  # trainer spec
            spec = dict(_fields(value))
            model.kind, model.byte_fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
            model.suffix = bool(spec.get(24, 0))
        elif number == 3:  # normaliser spec
            spec = dict(_fields(value))
            model.charsmap = spec.get(2, b"")
            model.dummy_prefix, model.trim, model.escape = (bool(spec.get(n, 1)) for n in (3, 4, 5))
    model.unknown = next((i for i, p in enumerate(model.pieces) if p[2] == UNKNOWN), 0)
    if model.kind not in (UNIGRAM, BPE) or model.suffix or not model.escape or any(p[2] == USER_DEFINED for p in model.pieces):
        raise ValueError("only unigram and BPE models with the metaspace as a prefix and no user-defined pieces are rebuilt")
    return model


def merges(model: Model) -> list[tuple[str, str]]:
    """Every way to make a piece of two others, best score first: the order in which the BPE joins them."""
    score = {p: s for p, s, kind in model.pieces if kind == NORMAL}
    found = [(-s, i, p[:cut], p[cut:]) for i, (p, s) in enumerate(score.items()) for cut in range(1, len(p)) if p[:cut] in score and p[cut:] in score]
    return [(a, b) for _, _, a, b in sorted(found)]


def build(data: bytes):
    """A tokenizers.Tokenizer that encodes and decodes as the model file says."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    model = parse_model(data)
    if model.kind == BPE:
        vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        tokenizer = Tokenizer(models.BPE(vocab, merges(model), unk_token=model.pieces[model.unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback))
    else:
        # a private-use prefix keeps control pieces from matching ordinary text
        typed = [(p if kind in (NORMAL, BYTE) else "\ue000" + p, s) for p, s, kind in model.pieces]
        tokenizer = Tokenizer(models.Unigram(typed, model.unknown, model.byte_fallback))
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.trim:  # at the start spaces only, at the end markers too
        steps += [normalizers.Replace(Regex("^ +"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    steps.append(normalizers.Replace(" ", SPACE))
    if model.trim:
        steps.append(normalizers.Replace(Regex(f"{SPACE}+$"), ""))
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(SPACE))
    tokenizer.normalizer = normalizers.Sequence(steps)
    if not any(SPACE in p.lstrip(SPACE) for p, _, kind in model.pieces if kind == NORMAL):
        # no piece reaches over a word's start, so words can be encoded one by one, with a cache of them
        units = [pre_tokenizers.Split(Regex(f"{SPACE}*[^{SPACE}]+|{SPACE}+"), "isolated")]
        if model.kind == UNIGRAM and model.byte_fallback:  # "<0x41>" in a text is no byte piece
            units.append(pre_tokenizers.Split(Regex("<0x"), "merged_with_previous"))
        tokenizer.pre_tokenizer = pre_tokenizers.Sequence(units)
    strip = [decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []
    tokenizer.decoder = decoders.Sequence([decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse(), *strip])
    return tokenizer


class Encoded(NamedTuple):
    """Texts' ids: those of text i are ``ids[offsets[i]:offsets[i + 1]]``; ``same`` is whether they decode to the text."""

    offsets: np.ndarray
    ids: np.ndarray
    same: np.ndarray


class UnitTable:
    """Units and their ids, as arrays that a batch of texts can gather from.

    It holds at most ``most`` units. When more come, those that were used by the
    most batches stay, half as many as it may hold: words that recur are not
    encoded anew, and words that don't cost no memory for long.
    """

    def __init__(self, most: int = KNOWN_UNITS):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.size = np.zeros(0, np.int64)
        self.start = np.zeros(0, np.int64)
        self.whole = np.zeros(0, bool)
        self.uses = np.zeros(0, np.int64)

    def find(self, units: list[str]) -> np.ndarray:
        """Row of each unit, -1 where there is none."""
        return np.fromiter(map(self.row.get, units, repeat(-1)), np.int64, len(units))

    def add(self, units: list[str], ids: np.ndarray, size: np.ndarray, whole: np.ndarray) -> None:
        n = len(self.row)
        self.row.update(zip(units, range(n, n + len(units))))
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])
        self.ids = np.concatenate([self.ids, ids])
        self.size = np.concatenate([self.size, size])
        self.whole = np.concatenate([self.whole, whole])
        self.uses = np.concatenate([self.uses, np.zeros(len(units), np.int64)])

    def shrink(self, most: int) -> None:
        """Keep the ``most`` units of most uses."""
        if len(self.row) <= most:
            return
        stay = np.sort(np.argpartition(-self.uses, most)[:most]) if most else np.zeros(0, np.int64)
        units = list(self.row)
        size, whole, uses, ids = self.size[stay], self.whole[stay], self.uses[stay], self.gather(stay)
        self.clear()
        self.add([units[i] for i in stay.tolist()], ids, size, whole)
        self.uses = uses // 2  # what was frequent long ago fades

    def gather(self, rows: np.ndarray) -> np.ndarray:
        """The ids of these rows, one after another."""
        size = self.size[rows]
        stop = np.cumsum(size)
        at = np.repeat(self.start[rows] - stop + size, size)
        return self.ids[at + np.arange(len(at))]


class Codec:
    """A rebuilt tokenizer beside the library it must equal.

    Where no piece reaches over the start of a word, a normalised text is the
    sequence of its units (a run of metaspaces and what follows), and its ids
    are those of its units. Arrow cuts texts into units and numbers the distinct
    ones; only those that the table lacks reach Python. They are strung together
    again, a few hundred at a time, encoded in batches by the tokenizers library,
    verified against sentencepiece, and decoded again: so verification covers
    every unit of every text.
    """

    def __init__(self, data: bytes):
        import sentencepiece

        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))  # of this worker; read when the library first needs it
        from tokenizers import Tokenizer

        self.tokenizer = build(data)
        self.units = Tokenizer(self.tokenizer.model)  # for units: normalised and cut already
        self.units.decoder = self.tokenizer.decoder
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=data)
        model = parse_model(data)
        self.plain = not model.charsmap and not model.trim
        self.by_unit = model.kind == BPE and self.plain and model.dummy_prefix and self.tokenizer.pre_tokenizer is not None
        self.opens = np.array([p.startswith(SPACE) for p, _, _ in model.pieces], bool)
        self.table = UnitTable()
        self.verify(list(PROBES), [e.ids for e in self.tokenizer.encode_batch(list(PROBES), add_special_tokens=False)])
        found = self.encode(pa.array(PROBES, pa.string()))
        self.verify(list(PROBES), [found.ids[a:b].tolist() for a, b in pairwise(found.offsets)])

    def verify(self, texts: list[str], ids: list[list[int]]) -> None:
        for text, found, want in zip(texts, ids, self.reference.encode(texts, num_threads=1)):
            if found != want:
                at = next((i for i, (a, b) in enumerate(zip(found, want)) if a != b), min(len(found), len(want)))
                raise AssertionError(f"ids differ from sentencepiece at token {at} of a text of {len(text)} characters: {found[at : at + 5]} and {want[at : at + 5]}")

    def _whole(self, texts: list[str]) -> Encoded:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        back = self.tokenizer.decode_batch(ids, skip_special_tokens=False)
        self.verify(texts, ids)
        want = [t.replace(SPACE, " ") for t in texts] if self.plain else self.reference.decode(ids)
        offsets = np.cumsum([0, *map(len, ids)])
        return Encoded(offsets, np.fromiter(chain.from_iterable(ids), np.int32, offsets[-1]), np.array([a == b for a, b in zip(back, want)], bool))

    def _learn(self, units: list[str]) -> None:
        """Encode, verify and decode units that the table lacks, and put them in."""
        plain = [u for u in units if u and SPACE not in u]
        singly = [u for u in units if not u or SPACE in u]
        for at in range(0, len(plain), CHUNK * 64):
            chunks = [plain[i : min(i + CHUNK, at + CHUNK * 64)] for i in range(at, min(at + CHUNK * 64, len(plain)), CHUNK)]
            texts = [" ".join(c) for c in chunks]
            ids = [e.ids for e in self.units.encode_batch_fast([SPACE + t.replace(" ", SPACE) for t in texts], add_special_tokens=False)]
            self.verify(texts, ids)
            good = [a == t for a, t in zip(self.units.decode_batch(ids, skip_special_tokens=False), texts)]
            sure, parts, sizes = [], [], []
            for chunk, found, same in zip(chunks, ids, good):
                flat = np.array(found, np.int32)
                first = np.flatnonzero(self.opens[flat])  # a unit's first piece is its only one with the marker
                if same and len(first) == len(chunk) and first[0] == 0:
                    sure += chunk
                    parts.append(flat)
                    sizes.append(np.diff(np.append(first, len(flat))))
                else:
                    singly += chunk
            if sure:
                self.table.add(sure, np.concatenate(parts), np.concatenate(sizes), np.ones(len(sure), bool))
        if singly:
            ids = [e.ids for e in self.units.encode_batch_fast([SPACE + u for u in singly], add_special_tokens=False)]
            self.verify([u for u in singly if u], [i for u, i in zip(singly, ids) if u])  # as a text, a marker by itself would be an empty one
            back = self.units.decode_batch(ids, skip_special_tokens=False)
            whole = np.array([a == u.replace(SPACE, " ") for a, u in zip(back, singly)], bool)
            size = np.array([len(i) for i in ids], np.int64)
            self.table.add(singly, np.fromiter(chain.from_iterable(ids), np.int32, size.sum()), size, whole)

    def encode(self, texts: pa.StringArray) -> Encoded:
        """Ids of texts that aren't null, and whether they decode to the normalised text."""
        if not self.by_unit:
            return self._whole(texts.to_pylist())
        cut = _cut(texts)
        offsets = cut.offsets.to_numpy()
        numbered = cut.flatten().dictionary_encode()
        units, codes = numbered.dictionary.to_pylist(), numbered.indices.to_numpy()
        table = self.table
        rows = table.find(units)
        lack = np.flatnonzero(rows < 0)
        if len(table.row) + len(lack) > table.most:
            table.shrink(table.most // 2)
            rows = table.find(units)
            lack = np.flatnonzero(rows < 0)
        if len(lack):
            new = [units[i] for i in lack.tolist()]
            self._learn(new)
            rows[lack] = table.find(new)
        table.uses[rows] += 1
        each = rows[codes]
        stops = np.concatenate([[0], np.cumsum(table.size[each])])
        faults = np.concatenate([[0], np.cumsum(~table.whole[each])])
        return Encoded(stops[offsets], table.gather(each), np.diff(faults[offsets]) == 0)

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)


def _cut(texts: pa.StringArray) -> pa.ListArray:
    """The units of each text, without their first metaspaces."""
    odd = pc.or_(pc.or_(pc.match_substring(texts, SPACE), pc.match_substring(texts, "  ")), pc.or_(pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " ")), pc.equal(texts, "")))
    if not pc.any(odd).as_py():
        return pc.split_pattern(texts, " ")
    usual = pc.split_pattern(texts.filter(pc.invert(odd)), " ")
    rest = [_units(t) for t in texts.filter(odd).to_pylist()]
    mask = odd.to_numpy(zero_copy_only=False)
    place = np.empty(len(texts), np.int64)
    place[~mask], place[mask] = np.arange(len(usual)), len(usual) + np.arange(len(rest))
    return pa.concat_arrays([usual, pa.array(rest, usual.type)]).take(pa.array(place))


def _units(text: str) -> list[str]:
    """As :func:`_cut`, of one text."""
    return [u[1:] for u in _UNIT.findall(SPACE + text.replace(" ", SPACE))] if text else []


@lru_cache(maxsize=2)
def _codec(data: bytes) -> Codec:
    return Codec(data)


def encode(rows: DataFrame, *, text: str = "text", model_path: str = DEFAULT_MODEL) -> DataFrame:
    """``rows`` without ``text``, with ``n_tokens``, ``ids`` and ``round_trip`` (whether decoding gives the normalised text)."""
    with open(model_path, "rb") as f:
        data = f.read()  # the driver's copy; executors get the bytes
    rest = [c for c in rows.columns if c not in (text, "n_tokens", "ids", "round_trip")]
    names = [f"_kept_{i}" for i in range(len(rest))]  # mapInArrow takes no names with dots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(data)
        for batch in batches:
            texts = pc.fill_null(batch.column(0), "")
            for at, stop in _slices(texts):
                found = codec.encode(texts.slice(at, stop - at))
                lists = pa.ListArray.from_arrays(pa.array(found.offsets.astype(np.int32)), pa.array(found.ids))
                kept = [batch.column(i + 1).slice(at, stop - at) for i in range(len(rest))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(np.diff(found.offsets).astype(np.int32)), lists, pa.array(found.same)], names=[*names, "n_tokens", "ids", "round_trip"])
        codec.table.shrink(KEPT_UNITS)  # the worker may serve other stages next

    kept = [F.col(f"`{c}`").alias(n) for c, n in zip(rest, names)]
    schema = rows.select(*kept, F.lit(0).alias("n_tokens"), F.array(F.lit(0)).alias("ids"), F.lit(True).alias("round_trip")).schema
    out = rows.select(F.col(f"`{text}`").cast("string").alias("text"), *kept).mapInArrow(run, schema)
    return out.toDF(*rest, "n_tokens", "ids", "round_trip")


def _slices(texts: pa.StringArray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of texts of about a million bytes, so that a batch of very long ones isn't held as tokens at once."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield start, stop
        start = stop


def decode(rows: DataFrame, *, ids: str = "ids", model_path: str = DEFAULT_MODEL) -> DataFrame:
    """``rows`` with ``text`` decoded from ``ids`` (null: empty)."""
    with open(model_path, "rb") as f:
        data = f.read()
    rest = [c for c in rows.columns if c not in (ids, "text")]
    names = [f"_kept_{i}" for i in range(len(rest))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(data)
        for batch in batches:
            texts = codec.decode([x or [] for x in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([*[batch.column(i + 1) for i in range(len(rest))], pa.array(texts, pa.string())], names=[*names, "text"])

    kept = [F.col(f"`{c}`").alias(n) for c, n in zip(rest, names)]
    schema = rows.select(*kept, F.lit("").alias("text")).schema
    return rows.select(F.col(f"`{ids}`").alias("ids"), *kept).mapInArrow(run, schema).toDF(*rest, "text")
