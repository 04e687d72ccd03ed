import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from aerotally.llm import divergence_audit as da

SCHEMA = "value long, source string, text string, doc_id long, lang string, rank string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs=3, ranks=200):
    df, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, source, text, _, lang, _ in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall((text or "").translate(LOWER))
        groups[lang].add(source)
        df[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= min_docs]
        v = len(kept)

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + v) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, ranks)):
                found = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found)]
    return sorted(out)


def found(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in da.audit(df, **kw).collect())


def documents(seed=1, n=220):
    r = random.Random(seed)
    words = ["The", "the", "THE", "thé", "THÉ", "abcdefgh", "abcdefghi", "abcdefghijklmnopq", "Abcdefghijklmnopr", "x1y", "don't", "[a]b^c`d{e", "ÿ", "日本", "日本語", "_", "12", "\x00nul", "\x7fdel", "a", "á"]
    words += ["".join(r.choice("abcé") for _ in range(r.randint(1, 12))) for _ in range(60)]
    rows = []
    for i in range(n):
        text = None if r.random() < 0.03 else "" if r.random() < 0.03 else r.choice([" ", "\n", "  ", "-"]).join(r.choice(words) for _ in range(r.randint(1, 40)))
        rows.append((1, r.choice(["hot"] * 5 + ["b", None, "", "d"]), text, i, r.choice(["en"] * 4 + ["de", None, ""]), "x"))
    rows += [(1, "rare", "unheard ofwords", 1000, "xx", "x"), (1, "none", "123", 1001, "xx", "x"), (1, "alone", None, 1002, "yy", "x")] + [(1, "again", "same row", 7, "zz", "x")] * 4
    return rows


def test_matches_brute_force(spark):
    rows = documents()
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows, min_docs=1, ranks=5) == brute(rows, 1, 5)


def test_slices_pieces_and_rows_of_any_size_give_the_same(spark, monkeypatch):
    rows = documents(2, 90) + [(1, "b", " ".join(f"w{'abc'[i % 3] * (i % 40)} the" for i in range(3000)), 5000, "en", "x")]
    for name, small in (("POINTERS_AT_ONCE", 50), ("BYTES_AT_ONCE", 300), ("GATHERED", 100), ("TERMS_PER_ROW", 7), ("CELLS", 9), ("BUCKETS", 3)):
        monkeypatch.setattr(da, name, small)
    assert found(spark, rows) == brute(rows)


def test_long_words_and_empty(spark):
    rows = [(1, "ab"[i % 2], ("é" * 30000 + "xy"[i % 3 == 0]) + " tail", i, "en", "x") for i in range(12)]
    assert found(spark, rows) == brute(rows)
    assert da.audit(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_pointer_sort_is_a_stable_sort_of_the_words(seed):
    r = random.Random(seed)
    words = [bytes(r.choice(b"abz\xc3") for _ in range(r.choice([1, 2, 7, 8, 9, 16, 17, 40]))) for _ in range(500)]
    words = [r.choice(words) for _ in range(2000)]
    lens = np.array(list(map(len, words)))
    data = np.r_[np.frombuffer(b"".join(words), np.uint8), np.zeros(8, np.uint8)]
    order, new = da.pointer_sort(data, np.cumsum(lens) - lens, lens)
    assert order.tolist() == sorted(range(len(words)), key=lambda i: words[i])
    assert [bool(x) for x in new] == [i == 0 or words[order[i]] != words[order[i - 1]] for i in range(len(words))]


def test_shares_are_exact_beyond_what_a_long_product_holds():
    r = random.Random(5)
    for _ in range(200):
        below = r.randint(1, 8 * 10**15)
        count = r.randint(0, below - 1)
        assert da.shares(np.array([count], np.int64), below)[0] == 1 + 10**9 * (count + 1) // below
