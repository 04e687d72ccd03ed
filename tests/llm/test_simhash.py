import random

import pytest
import xxhash

from aerotally.llm import simhash


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, now = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [now] if now else []
            now = ""
        else:
            now += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(docs, radius=4):
    fps = [slow_fingerprint(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                root[find(i)] = find(j)
    comps = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            comps[find(i)] = min(comps.get(find(i), d), d)
    return sorted(((d, f, comps.get(find(i))) for i, ((d, _), f) in enumerate(zip(docs, fps))), key=str)


def corpus(seed=1, n=60):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    docs = []
    for i in range(n):
        words = [r.choice(vocab) for _ in range(r.choice([3, 30, 200]))]
        docs.append((10 * i, " ".join(words)))
        for k in range(r.choice([0, 0, 3])):
            copy = list(words)
            for _ in range(k):
                copy[r.randrange(len(copy))] = r.choice(vocab)
            docs.append((10 * i + k + 1, "\t".join(copy).title()))
    return docs


EDGE = [(9001, None), (9002, ""), (9003, " \n "), (9004, "one"), (9005, "ONE"), (9006, "É é é"), (None, "x y z"), (9007, "x y z"), (9007, "x y z"), (9008, "long " * 70000)]


def test_components_match_brute_force(spark):
    docs = corpus() + EDGE
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = simhash.near_duplicate_components(df).collect()
    assert sorted(((x.doc_id, x.fp % 2**64, x.component_id) for x in got), key=str) == brute(docs)


def test_hot_fingerprints_get_the_same_answers(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_SHARE", 4)
    docs = corpus(5, 12) + [(7000 + i, "one and the same text here") for i in range(90)] + EDGE[:8]
    got = simhash.near_duplicate_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert sorted(((x.doc_id, x.fp % 2**64, x.component_id) for x in got), key=str) == brute(docs)


def slow_mixed(h, t):
    if not t:
        return h
    z = (h + t * 0x9E3779B97F4A7C15) % 2**64
    z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    z = (z ^ z >> 27) * 0x94D049BB133111EB % 2**64
    return z ^ z >> 31


def slow_set(text, n, tables):
    words = (text or "").lower().split()
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return tuple(sum(1 << b for b in range(64) if 2 * sum(slow_mixed(h, t) >> b & 1 for h in hashes) > len(hashes)) for t in range(tables))


def test_several_fingerprints_link_in_any(spark):
    docs = corpus(8, 40)
    sets = [slow_set(t, 5, 3) for _, t in docs]
    assert [tuple(int(x) for x in simhash.fingerprint_set(t.encode(), 5, 3)) for _, t in docs] == sets
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if any(bin(a ^ b).count("1") <= 4 for a, b in zip(sets[i], sets[j])):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(docs):
        low[find(i)] = min(low.get(find(i), d), d)
    got = simhash.near_duplicate_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), shingle_words=5, tables=3).collect()
    assert {r.doc_id: r.component_id for r in got} == {d: low[find(i)] for i, (d, _) in enumerate(docs)}
    assert len(set(low.values())) < len(docs)


@pytest.mark.parametrize("most", [4_000_000, 30])
def test_links_match_brute_force_on_dense_fingerprints(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "MOST_PER_BUCKET", most)
    r = random.Random(2)
    fps = {0, 2**64 - 1}
    for _ in range(6):
        base = r.getrandbits(64)
        for _ in range(60):
            f = base
            for b in r.sample(range(64), r.randint(0, 6)):
                f ^= 1 << b
            fps.add(f)
    fps = sorted(fps)
    df = spark.createDataFrame([((f + 2**63) % 2**64 - 2**63,) for f in fps], "fp long")
    edges = simhash.fingerprint_links(df, len(fps)).collect()
    assert all(bin((e.src ^ e.dst) % 2**64).count("1") <= 64 for e in edges)

    def groups(pairs):
        root = {f: f for f in fps}

        def find(f):
            while root[f] != f:
                f = root[f]
            return f

        for a, b in pairs:
            x, y = sorted((find(a), find(b)))
            root[y] = x
        return {f: find(f) for f in fps}

    want = groups((a, b) for i, a in enumerate(fps) for b in fps[:i] if bin(a ^ b).count("1") <= 4)
    assert groups((e.src % 2**64, e.dst % 2**64) for e in edges) == want


def test_small_passes_find_the_same(monkeypatch):
    import numpy as np

    r = random.Random(3)
    base = r.getrandbits(64)
    fps = np.array(sorted({base ^ (1 << r.randrange(60)) ^ (1 << r.randrange(60)) for _ in range(50)}), np.uint64)
    head = int(fps[0] >> np.uint64(58))
    one = simhash._bucket_forest(fps, head, 6, 2)
    monkeypatch.setattr(simhash, "VARIANTS_PER_PASS", 20000)
    many = simhash._bucket_forest(fps, head, 6, 2)
    assert len(one[0]) == len(many[0]) == len(fps) - 1


def test_one_of_each_group_stays(spark):
    docs = [(5, "a b c d e"), (3, "A b c d e"), (3, "A b c d e"), (7, None), (8, ""), (None, "q r s t"), (None, "q r s t"), (None, "a b c d e"), (9, "other words here now")]
    df = spark.createDataFrame([(d, t, "fp") for d, t in docs], "doc_id long, text string, fp string")
    got = simhash.keep_one_per_component(df)
    assert got.columns == ["doc_id", "text", "fp"]
    assert sorted((str(x.doc_id), x.text) for x in got.collect()) == [("3", "A b c d e"), ("7", None), ("9", "other words here now"), ("None", "q r s t")]


def test_extra_columns_of_any_name(spark):
    docs = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (None, "q r s t u"), (3, "x y z")]
    names = ["_kept", "_fp", "_group", "fp", "component_id", "a.b", "hot_fp", "copies"]
    df = spark.createDataFrame([(d, t, *names) for d, t in docs], ["doc_id", "text", *names])
    got = simhash.keep_one_per_component(df)
    assert got.columns == df.columns
    rows = sorted((tuple(r) for r in got.collect()), key=str)
    assert rows == sorted([(1, "a b c d e f", *names), (3, "x y z", *names), (None, "q r s t u", *names)], key=str)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicate_components(df).count() == 0
    assert simhash.keep_one_per_component(df).count() == 0


def test_dropped_ids_beyond_what_is_broadcast(spark, monkeypatch):
    r = random.Random(9)
    texts = [" ".join(f"w{r.randint(0, 500)}" for _ in range(30)) for _ in range(12)]
    rows = [(i, texts[i % 12]) for i in range(30)] + [(5, texts[5]), (5, texts[6]), (None, "alone"), (None, texts[0]), (3, None), (40, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    few = sorted(map(str, simhash.keep_one_per_component(df).collect()))
    monkeypatch.setattr(simhash, "MOST_GONE", -1)
    assert sorted(map(str, simhash.keep_one_per_component(df).collect())) == few
    assert len(few) == 12  # a row with id 5 is the smallest of another group, too


@pytest.mark.parametrize("repeated", [0, 2])
def test_no_text_is_shuffled_for_ids_that_no_or_few_rows_repeat(spark, repeated):
    r = random.Random(4)
    texts = [" ".join(f"w{r.randint(0, 500)}" for _ in range(30)) for _ in range(20)]
    rows = [(i, texts[i % 18]) for i in range(20)] + [(7, texts[7])] * repeated
    df = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if all sides were large
    try:
        got = simhash.keep_one_per_component(df)
        text = got._jdf.queryExecution().executedPlan().toString()
        assert sorted(x.doc_id for x in got.collect()) == list(range(18))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in text
    if not repeated:
        assert "hashpartitioning" not in text
