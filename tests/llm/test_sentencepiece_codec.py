import random

import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import decoders
from aerotally.llm import sentencepiece_codec as sc

DATA = open(sc.DEFAULT_MODEL, "rb").read()


def texts(seed=3):
    r = random.Random(seed)
    odd = ["", None, " ", "   ", "\n", "a", "▁", "▁▁a ▁", " lead", "trail ", "a  b   c", "<s>", "</s> <unk><0x0A>", "漢字 カナ", "\U0001f600 x‍", "tab\tnl\n\n end", "\x00", "é" * 50, "The the THE 123 4.5e-6", "ﬁ Å"]
    made = ["".join(r.choice(" \n▁abcdéß漢😀&%.1") for _ in range(r.randint(1, 60))) for _ in range(200)]
    return odd + made + ["long text " * 20000, "x" * 50000]


def ids_of(codec, some):
    found = codec.encode(pa.array(some, pa.string()))
    return [found.ids[a:b].tolist() for a, b in zip(found.offsets, found.offsets[1:])]


def test_parse_model_matches_the_library():
    m = sc.parse_model(DATA)
    ref = sentencepiece.SentencePieceProcessor(model_proto=DATA)
    assert [p for p, _, _ in m.pieces] == [ref.id_to_piece(i) for i in range(ref.get_piece_size())]
    assert [round(s, 4) for _, s, _ in m.pieces] == [round(ref.get_score(i), 4) for i in range(ref.get_piece_size())]
    assert m.kind == sc.BPE and m.byte_fallback and m.dummy_prefix and not m.trim


def test_encode_decode_parity(spark):
    rows = [(i, t, "x", 7) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int").repartition(3)
    ref = sentencepiece.SentencePieceProcessor(model_proto=DATA)
    out = sc.encode(df)
    assert out.columns == ["doc_id", "n_tokens", "ids", "round_trip"]
    got = {r.doc_id: r for r in out.collect()}
    for i, t, _, _ in rows:
        assert list(got[i].ids) == ref.encode(t or ""), repr((t or "")[:50])
        assert got[i].n_tokens == len(got[i].ids) and got[i].round_trip
    back = {r.doc_id: r.text for r in sc.decode(out).collect()}
    assert all(back[i] == ref.decode(ref.encode(t or "")) for i, t, _, _ in rows)


def test_units_make_the_whole():
    c = sc.Codec(DATA)
    for t in texts(9)[:-2]:
        t = t or ""
        assert [e.ids for e in c.tokenizer.encode_batch([t], add_special_tokens=False)][0] == c.reference.encode(t)
        assert ids_of(c, [t]) == [c.reference.encode(t)]


def test_table_forgets_and_learns_again():
    c = sc.Codec(DATA)
    c.table = sc.UnitTable(most=40)
    some = [t or "" for t in texts(4)][:-2]
    for _ in range(2):
        for at in range(0, len(some), 7):
            assert ids_of(c, some[at : at + 7]) == c.reference.encode(some[at : at + 7])
    c.table.shrink(5)
    assert len(c.table.row) == len(c.table.size) == 5
    assert ids_of(c, some) == c.reference.encode(some)


def test_round_trip_is_the_decoder_s():
    c = sc.Codec(DATA)
    c.table.clear()
    c.units.decoder = decoders.Sequence([decoders.Replace(sc.SPACE, " "), decoders.Replace("e", ""), decoders.Fuse(), decoders.Strip(" ", 1, 0)])
    found = c.encode(pa.array(["the end", "sun", ""]))
    assert found.same.tolist() == [False, True, True]


def test_difference_raises():
    c = sc.Codec(DATA)
    with pytest.raises(AssertionError):
        c.verify(["some text"], [[1, 2, 3]])


def _proto(fields):
    def varint(n):
        out = b""
        while True:
            out += bytes([n & 127 | (128 if n > 127 else 0)])
            n >>= 7
            if not n:
                return out

    out = b""
    for number, value in fields:
        if isinstance(value, int):
            out += varint(number << 3) + varint(value)
        elif isinstance(value, float):
            import struct

            out += varint(number << 3 | 5) + struct.pack("<f", value)
        else:
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


def unigram_model():
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    pieces += [(p, -1.0 - i / 7, 1) for i, p in enumerate(["▁", "▁the", "▁a", "he", "t", "h", "e", "a", "b", "ab", "ba", "▁ab", "bab", "th", "er", "r"])]
    body = b"".join(_proto([(1, _proto([(1, p.encode()), (2, s), (3, k)]))]) for p, s, k in pieces)
    return body + _proto([(2, _proto([(3, 1), (35, 1)])), (3, _proto([(3, 1), (4, 1), (5, 1)]))])


def test_unigram_with_trimming_and_byte_fallback():
    data = unigram_model()
    c = sc.Codec(data)
    words = ["the", "there", "abba", "babab", "  ab  the ", "zé", "", " "]
    assert ids_of(c, words) == c.reference.encode(words)


def test_empty_table(spark):
    assert sc.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_worker_holds_few_units_and_little_text_at_once():
    words = pa.array([" ".join(f"w{i}x{j}" for j in range(1000)) for i in range(300)], pa.string())
    codec, ref = sc.Codec(DATA), sentencepiece.SentencePieceProcessor(model_proto=DATA)
    spans = list(sc._slices(words))
    assert [a for a, _ in spans] == [0, *[b for _, b in spans[:-1]]] and spans[-1][1] == len(words)
    for a, b in spans:
        assert words.slice(a, b - a).nbytes < 1_100_000
        assert ids_of(codec, words.slice(a, b - a).to_pylist())[-1] == ref.encode(words[b - 1].as_py())
    assert len(codec.table.row) < 160_000  # of 300,000
