import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from aerotally.llm import preference_ranker as pr


def corpus(seed=2, n=400):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["an", "er", "ti", "re", "é", "on", "st"]) for _ in range(r.randint(1, 4)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(r.randint(20, 150))]
        kind = i % 8
        text = ". ".join(" ".join(words[j : j + 9]).capitalize() for j in range(0, len(words), 9))
        if kind == 0:
            text = " ".join(w.upper() + "!!" for w in words)
        elif kind == 1:
            text = " | ".join(words)
        elif kind == 2:
            text = " ".join([words[0]] * len(words))
        docs.append((i, text))
        if i % 3:
            labels.append((i, int(kind > 2)))
    return docs, labels


def test_held_out_accuracy_and_columns(spark):
    docs, labels = corpus()
    docs += [(9001, None), (9002, ""), (9003, "one"), (9003, "one"), (None, "words of a text")]
    df = spark.createDataFrame([(*d, 1, 0.5) for d in docs], "doc_id long, text string, quality int, score double")
    lb = spark.createDataFrame(labels + [(3, None), (None, 1), (5000, 0), (1, 0), (1, 1)], "doc_id long, quality int")
    ranker = pr.train(df, lb)
    got = pr.score(df, ranker).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    truth = {i: int(i % 8 > 2) for i in range(400)}
    tested = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in tested]) > 0.97


W = re.compile(rb"[^\x20\x09-\x0d]+")


def slow_features(text):
    words = W.findall(text)
    if not words:
        return [0.0] * 12 + [1.0]
    s, n = text.decode(), len(words)
    letters = [c for c in s if c.isalpha()]
    windows = [tuple(words[i : i + 3]) for i in range(n - 2)]
    lines = text.split(b"\n")
    lengths = [len(w) for w in words]
    mean = sum(lengths) / n
    return [
        min(3, sum(text.count(bytes([c])) for c in b"#*$%&|<>") / n), min(2, sum(c in "!?" for c in s) / n),
        sum("A" <= c <= "Z" or c in "\xc0\xc9\xdc" for c in s) / len(letters) if letters else 0.0,
        sum(len(w) == 1 and w in b"#*$%&|<>" for w in words) / n, sum(a == b for a, b in zip(words, words[1:])) / n,
        1 - len(set(windows)) / len(windows) if windows else 0.0, 1 - len(set(lines)) / len(lines), sum(c in "0123456789" for c in s) / len(text),
        min(3, mean / 10), min(3, (sum((x - mean) ** 2 for x in lengths) / n) ** 0.5 / 10), min(2, sum(c in ".,;:" for c in s) / n),
        sum(not any(b > 127 or chr(b).isalpha() for b in w) for w in set(words)) / len(set(words)), 0.0,
    ]


def slow_ngrams(text):
    low = text.lower()
    tri, word = [0.0] * pr.TRIGRAMS, [0.0] * pr.WORDS
    for a, b, c in zip(low, low[1:], low[2:]):
        tri[((a * 0x1F123BB5 + b * 0x5B9CA8F7 + c * 0x2545F491) % 2**32 >> 16) % pr.TRIGRAMS] += 1
    for w in W.findall(low):
        h = sum((b + 1) * pow(0x9E3779B97F4A7C15, i % 64 + 1, 2**64) for i, b in enumerate(w)) % 2**64
        word[(h >> 40) % pr.WORDS] += 1
    return [(x / max(sum(some), 1)) ** 0.5 for some in (tri, word) for x in some]


ODD = ["", " ", "a", "ab", "one two", "\n\n", "A B! c? D.. 12 | | x#x", "\xc0\xc9 \xfc \xdc \u6f22\u5b57 x", "q\x0bq\x0cq\rq q q q q", "same line\nsame line\nother", "x" * 300 + " y", " lead and trail "]


def test_features_match_brute_force():
    texts = ODD + [t for _, t in corpus(n=40)[0]]
    for t in texts:
        raw = t.encode()
        assert np.allclose(pr.features(raw), slow_features(raw)), t[:60]
        assert np.allclose(pr.ngrams(raw), slow_ngrams(raw)), t[:60]
    assert (pr.all_features(None) == pr.all_features(b"")).all()


def test_very_long_text():
    raw = b"the river and the sea " * 200_000
    assert np.allclose(pr.ngrams(raw), pr.ngrams(raw[:22_000]), atol=1e-2) and pr.features(raw)[12] == 0


def test_fit_ranks_and_is_the_optimum():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(1, 1, (500, 8)), rng.normal(0, 1, (300, 8))
    w = pr.fit(good, bad, 1e-3)
    assert ((good @ w)[:, None] > (bad @ w)[None]).mean() > 0.95
    wins, loses = pr.pairs(500, 300, 5)
    assert set(wins) == set(range(500)) and set(loses) == set(range(300))
    p = 1 / (1 + np.exp(-(good[wins] - bad[loses]) @ w))
    slope = (good[wins] - bad[loses]).T @ (1 - p) / len(wins) - 1e-3 * w
    assert np.abs(slope).max() < 1e-5


def test_choice_is_by_left_out_folds():
    rng = np.random.default_rng(2)
    good, bad = rng.normal(0, 1, (200, pr.N_FEATURES)), rng.normal(0, 1, (200, pr.N_FEATURES))
    good[:, 3] += 3
    fold = np.arange(200) % pr.FOLDS
    assert pr.choose(good, bad, fold, fold)[0] == pr.N_SURFACE
    good[:, 3] -= 3
    good[:, pr.N_SURFACE + 5] += 3
    assert pr.choose(good, bad, fold, fold)[0] == pr.N_FEATURES


def test_rank_is_train_and_score(spark):
    docs, labels = corpus(seed=7)
    docs += [(9001, None), (9002, ""), (9003, "one"), (9003, "one"), (None, "words of a text")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    lb = spark.createDataFrame(labels, "doc_id long, quality int")
    assert sorted(map(tuple, pr.rank(df, lb).collect()), key=str) == sorted(map(tuple, pr.score(df, pr.train(df, lb)).collect()), key=str)


def test_one_class_or_nothing(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    no = spark.createDataFrame([], "doc_id long, quality int")
    one = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    for lb in (no, one):
        assert [r.score for r in pr.score(df, pr.train(df, lb)).collect()] == [0.5]
    assert pr.score(df.limit(0), pr.train(df.limit(0), no)).count() == 0


def test_cut_is_the_quantile_of_all_labelled_documents(spark):
    docs, labels = corpus(seed=4)
    labels += [(i, 0) for i, q in labels if q and i % 11 == 0]  # labels that disagree
    df, lb = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    ranker = pr.train(df, lb, per_class=40)
    of = {}
    for i, q in labels:
        if zlib.crc32(str(i).encode()) % 5:
            of.setdefault(i, []).append(q)
    share = np.mean([1 - np.mean(q) for q in of.values()])
    z = np.sort([ranker.raw(t.encode()) for i, t in docs if i in of])
    at = int(np.ceil(share * len(z) - 1e-9)) - 1
    assert abs(ranker.threshold - z[at : at + 2].mean()) < 1e-9


def test_nth_is_exact(spark):
    v = [random.Random(1).choice([0.1, 0.25, -3e9, 7e-12, 4.0]) for _ in range(50)] + [k / 7 for k in range(300)]
    df = spark.createDataFrame([(x,) for x in v], "z double")
    assert [pr.nth(df, n) for n in (0, 30, 349)] == [sorted(v)[n] for n in (0, 30, 349)]


def test_slices_cut_no_word_and_no_trigram(monkeypatch):
    r = random.Random(12)
    texts = [b"", b"a", b"ab c", b"word " * 50, b"x" * 300, bytes(r.choice(b"abc \n\xc3\xa9") for _ in range(2000))]
    whole = [pr.ngrams(t) for t in texts]
    for size in (1, 2, 3, 7, 64):
        monkeypatch.setattr(pr, "_BYTES_AT_ONCE", size)
        for t, want in zip(texts, whole):
            assert (pr.ngrams(t) == want).all()
