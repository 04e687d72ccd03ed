import random
import unicodedata
from collections import Counter
from zlib import crc32

import numpy as np

from aerotally.llm import language_codes as lc

SCHEMA = "doc_id long, text string, lang string, score string, source string"
SYLLABLES = {"aa": "ka mi to ru ne", "bb": "str umpf ich ß er", "cc": "ção nh em lho ar", "dd": "the ing an th ly"}


def sentence(r, lang, n):
    return " ".join("".join(r.choice(SYLLABLES[lang].split()) for _ in range(r.randint(1, 3))).capitalize() for _ in range(n))


def documents(langs="aa bb cc dd", n=400, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lang = r.choice(langs.split())
        rows.append((i, sentence(r, lang, r.choice([2, 5, 30])), lang if i % 9 else None, "k", "s"))
    return rows


def slow_counts(text):
    kinds = [(2 if c.isalpha() else unicodedata.category(c)[0] == "M") for c in (text or "").lower().replace("ς", "σ")]
    out = [0]
    for c, kind in zip((text or "").lower().replace("ς", "σ"), kinds):
        code = ord(c) if kind else 0
        if code or out[-1]:
            out.append(code)
    if out[-1]:
        out.append(0)
    m, counts = 2**32, np.zeros(lc.N_FEATURES)
    for c in out:
        if c:
            counts[(c * 0x9E3779B1 % m) >> 26] += 1
    for a, b in zip(out, out[1:]):
        counts[64 + (((a * 0x85EBCA6B + b * 0xC2B2AE35) % m) >> 23)] += 1
    for a, b, c in zip(out, out[1:], out[2:]):
        counts[64 + 512 + (((a * 0x27D4EB2F + b * 0x165667B1 + c * 0x9E3779B1) % m) >> 21)] += 1
    return counts if 2 in kinds else None


def test_ngrams_match_a_slow_count_over_slices(monkeypatch):
    r = random.Random(3)
    texts = [None, "", "12 !!", "a", "Ab cd", "ΑΣ ς", "İß", "été", "日本語 の", "  x  ", "́", "".join(r.choice("ab .,É́ß\n") for _ in range(5000))]
    for size in (1, 3, 64, 1 << 20):
        monkeypatch.setattr(lc, "CHARS_AT_ONCE", size)
        for t in texts:
            got, want = lc.ngram_counts(t), slow_counts(t)
            assert (got is None) == (want is None) and (got is None or (got == want).all())


def test_codewords_differ_in_many_bits():
    for n in (2, 3, 4, 5, 6, 17, 60):
        code = lc.codewords(n)
        assert len({tuple(c) for c in code.T} | {tuple(-c) for c in code.T}) == 2 * code.shape[1]
        least = min((a != b).sum() for i, a in enumerate(code) for b in code[:i])
        assert least == lc._least_distance(code) and least >= code.shape[1] / 4
        assert all(abs(c.sum()) < n for c in code.T)
    assert lc.codewords(1).shape == (1, 0)


def test_decoding_matches_a_slow_one_and_corrects_a_wrong_bit():
    r = np.random.default_rng(1)
    model = lc.Model(list("abcd"), lc.codewords(4), r.normal(size=(lc.N_FEATURES + 1, 7)).astype(np.float32))
    x = r.random((30, lc.N_FEATURES)).astype(np.float32)
    best, score, _ = model.decode(x)
    for i in range(30):
        margin = [float(x[i] @ model.weights[:-1, b] + model.weights[-1, b]) for b in range(7)]
        losses = [sum(np.log1p(np.exp(-m * c)) for m, c in zip(margin, word)) for word in model.code]
        assert best[i] == int(np.argmin(losses)) and abs(score[i] - 1 / sum(np.exp((min(losses) - v) / 2) for v in losses)) < 1e-3
    one = lc.Model(list("abcd"), model.code, np.zeros((lc.N_FEATURES + 1, 7), np.float32))
    for own in range(4):
        for flipped in range(7):
            one.weights[-1] = model.code[own] * 2
            one.weights[-1, flipped] *= -1
            best, _, _ = one.decode(x[:1])
            assert best[0] == own
    one.weights[-1] = 0.01
    assert one.decode(x[:1])[2].all()


def test_held_out_documents_get_their_language(spark):
    rows = documents() + [(9001, None, "aa", "k", "s"), (9002, "", "aa", "k", "s"), (9003, "123 $$", "bb", "k", "s"), (None, sentence(random.Random(8), "bb", 20), "bb", "k", "s"), (9004, sentence(random.Random(9), "cc", 300000), None, "k", "s"), (5, *documents()[5][1:])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = lc.identify(df, 200).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(r.held_out == (r.doc_id is not None and crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    assert {by[k].lang_pred for k in (9001, 9002, 9003)} == {"und"} and by[9004].lang_pred == "cc" and by[None].lang_pred == "bb"
    tested = [(r, lang) for r, lang in ((by[i], lang) for i, _, lang, *_ in documents() if lang) if r.held_out]
    assert len(tested) > 80 and sum(r.lang_pred == lang for r, lang in tested) / len(tested) > 0.97
    again = lc.identify(df.repartition(7), 200).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_the_fit_sees_no_held_out_label_source_or_id(spark):
    rows = documents(n=150)
    def held(i):
        return crc32(str(i).encode()) % 3 == 1
    changed = [(i, t, "zz" if held(i) else g, s, "other") for i, t, g, s, _ in rows]
    run = lambda x: Counter((r.doc_id, r.lang_pred, r.score) for r in lc.identify(spark.createDataFrame(x, SCHEMA), 100).collect())
    assert run(rows) == run(changed)


def test_copies_do_not_fill_the_sample_and_few_languages(spark):
    rows = documents("aa bb", 60) + [(10_000 + i, "mi ka mi ka", "aa", "k", "s") for i in range(400)]
    got = {r.doc_id: r.lang_pred for r in lc.identify(spark.createDataFrame(rows, SCHEMA), 40).collect()}
    assert sum(got[i] == lang for i, _, lang, *_ in rows[:60] if lang) >= 50
    one = lc.identify(spark.createDataFrame(documents("cc", 20), SCHEMA)).collect()
    assert {(r.lang_pred, r.score) for r in one} == {("cc", 1.0)}
    none = lc.identify(spark.createDataFrame([(1, "text", None, "k", "s")], SCHEMA)).collect()
    assert [(r.lang_pred, r.score) for r in none] == [("und", 0.0)]
    assert lc.identify(spark.createDataFrame([], SCHEMA)).count() == 0
