import re

from aerotally.llm import host_rules

W = re.compile("[^\x20\x09-\x0d]+")


def slow(text):
    text = text or ""
    words = W.findall(text)
    lines = [x for x in text.split("\n") if W.search(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    win = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    rep = {j for i, w in enumerate(win) if win.count(w) > 1 for j in range(i, i + 3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(rep))


TEXTS = [None, "", " \n\t ", "a b c a b c a", "x\nx\n x\n\n\nx", "é ü z ÀB #*$ |<>&%", "a a a a", "a b c d a b c", "one", "w " * 30000, "q\x0bq\x0cq\rq", " ".join(f"w{i % 7} w{i % 11}" for i in range(120)), " em \x1c sep"]


def test_measures_match_brute_force():
    for t in TEXTS:
        if t != "w " * 30000:
            assert host_rules.measures(None if t is None else t.encode())[:5] == slow(t), t
    assert host_rules.measures(b"w " * 30000)[:5] == (30000, 30000, 0, 0, 30000)


def clean(i):
    return " ".join(f"word{i}x{j} of" if j % 9 else "The river" for j in range(60)) + "."


def corpus():
    junk = " ".join(f"WORD{j}!!" for j in range(80))
    docs = [(i, clean(i), f"host{i % 3}") for i in range(60)]
    docs += [(100 + i, junk.replace("W", "W" * (i + 1)), "host1") for i in range(8)]
    docs += [(200 + i, junk.replace("O", "O" * (i + 1)), "farm") for i in range(40)] + [(300, clean(300), "farm"), (301, clean(301), None)]
    return docs + [(400 + i, t, "host2") for i, t in enumerate(TEXTS)]


def test_verdicts_and_filter_agree(spark):
    df = spark.createDataFrame([(*d, "x", 1) for d in corpus()], "doc_id long, text string, source string, verdict string, n_words int")
    got = {r.doc_id: r for r in host_rules.judge(df).collect()}
    assert len(got) == len(corpus())
    for d, t, _ in corpus():
        assert tuple(got[d][m] for m in host_rules.MEASURES[:5]) == (slow(t) if t != "w " * 30000 else (30000, 30000, 0, 0, 30000))
    assert all(got[i].kept for i in range(60))
    assert not any(got[100 + i].kept for i in range(8))
    assert not got[300].kept and got[300].verdict == "blocked"
    assert got[301].kept
    kept = host_rules.keep_good(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, r in got.items() if r.kept)


def test_prior_shrinks_small_hosts(spark):
    rows = [("big", i < 30) for i in range(1000)] + [("other", i < 300) for i in range(1000)] + [("tiny", True)]
    got = {r.host: r for r in host_rules.host_verdicts(spark.createDataFrame(rows, "host string, failed boolean")).collect()}
    assert 0.03 < got["big"].rate < 0.04 and 0.29 < got["other"].rate < 0.31
    assert got["tiny"].rate < 0.6 and got["tiny"].verdict == "doubted"
    assert got["big"].verdict == "trusted" and got["big"].tolerance == 1.5 and got["other"].tolerance == 0.5
    assert host_rules.beta_prior(0, 0, 0, 0, 0) == (1.0, 1.0)


def test_verdicts_flip_documents_both_ways(spark):
    # 12 symbols in 100 words pass a limit of 10 on a good host; 8 fail it on a bad one
    borderline = lambda i, n: " ".join(f"word{i}x{j}" + ("#" if j < n else "") for j in range(100))
    junk = lambda i: " ".join(f"w{i}o{j} %%" for j in range(60))
    docs = [(i, clean(i), "good") for i in range(200)] + [(500, borderline(1, 12), "good"), (501, borderline(2, 8), "good")]
    docs += [(1000 + i, clean(i) if i % 3 else junk(i), "bad") for i in range(200)] + [(1500, borderline(3, 12), "bad"), (1501, borderline(4, 8), "bad")]
    docs += [(2000 + i, clean(i) if i % 7 else junk(i), f"usual{i % 5}") for i in range(1000)] + [(3000, borderline(5, 12), "usual1"), (3001, borderline(6, 8), "usual1")]
    got = {r.doc_id: r for r in host_rules.judge(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()}
    assert [got[i].kept for i in (500, 501, 1500, 1501, 3000, 3001)] == [True, True, False, False, False, True]
    assert {i for i, r in got.items() if r.flipped} == {500, 1501}


def test_min_words_is_a_parameter(spark):
    df = spark.createDataFrame([(1, "a short but clean text", "h"), (2, "", "h"), (3, None, "h"), (4, "#### %%", "h")], "doc_id long, text string, source string")
    assert [r.doc_id for r in host_rules.keep_good(df, min_words=1).collect()] == [1] and host_rules.keep_good(df).count() == 0


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert host_rules.judge(df).count() == 0 and host_rules.keep_good(df).count() == 0
