import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import hashlib
import random
from collections import Counter

import corpus_pipeline
import sentencepiece
from test_pivotal_mix import slow_targets
from test_simhash import brute as brute_components
from aerotally.llm import secret_forest, sentencepiece_codec as sc


def corpus():
    r = random.Random(6)
    word = lambda: "".join(r.choice(["an", "er", "ti", "re", "on", "st", "ou"]) for _ in range(r.randint(1, 4)))
    docs = []
    for i in range(120):
        text = " ".join(word() for _ in range(r.randint(60, 120))) + "."
        docs.append([i, text, "en", f"src{i % 4}"])
        if i % 10 == 0:
            docs.append([1000 + i, text.replace(" ", "  ").title(), "en", "src0"])
        if i % 15 == 7:
            docs[-1][1] += f' token = "{hashlib.sha1(text.encode()).hexdigest()}" end'
    docs += [[2000 + i, "SPAM!! " * (60 + i), "en", "src1"] for i in range(6)] + [[3000, None, "en", None], [3001, "", None, "src1"], [3002, "too short", "fr", "src2"]]
    docs += [[2100 + i, " ".join(word() + "###" for _ in range(80)), "en", "src2"] for i in range(6)]
    return [(*d, len(d[1] or "")) for d in docs]


def test_stages_against_brute_force(spark, tmp_path):
    rows = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    outs = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs = corpus_pipeline.materialise(docs, "test-stage")
        outs.append(docs.collect())
    rules, dedup, secrets, mixed, encoded = outs
    assert all(set(o[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars"} for o in outs[:-1])
    assert {r.doc_id for r in rules} == {d[0] for d in rows if d[0] < 2000} | {3002}
    want = {d for d, _, c in brute_components([(r.doc_id, r.text) for r in rules]) if d == c}
    assert {r.doc_id for r in dedup} == want and len(dedup) == len(want)
    assert {r.doc_id for r in secrets} == want
    before = {r.doc_id: r.text for r in dedup}
    for r in secrets:
        planted = 'token = "' in before[r.doc_id]
        assert planted == (secret_forest.MASK in r.text) and (planted or r.text == before[r.doc_id]) and r.n_chars == len(r.text)
    size = Counter()
    for r in secrets:
        size[r.source] += len(r.text.split())
    taken = Counter()
    for r in mixed:
        taken[r.source] += len(r.text.split())
    assert all(abs(taken[s] - t) <= 130 for s, t in slow_targets(dict(size)).items())
    assert max(Counter(r.doc_id for r in mixed).values()) <= 2
    ref = sentencepiece.SentencePieceProcessor(model_file=sc.DEFAULT_MODEL)
    text = {r.doc_id: r.text for r in mixed}
    assert len(encoded) == len(mixed) and all(list(r.ids) == ref.encode(text[r.doc_id]) and r.round_trip for r in encoded)
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == Counter(r.doc_id for r in mixed)


def test_pipeline_on_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_take_odd_rows_and_extra_columns(spark, tmp_path):
    long = " ".join(f"river{i} of land{i}" for i in range(60_000))
    usual = [" ".join(f"word{i} in place{j}" for j in range(20)) for i in range(5)]
    texts = [(None, usual[0]), (None, "an only child of its own kind"), (1, usual[1]), (1, usual[1]), (2, usual[1]), (3, None), (4, ""), (5, " \n "), (6, long), (7, f"{usual[2]} password=hunter2"), (None, None), (8, usual[3]), (9, usual[4])]
    extra = ["_kept", "_fp", "_group", "verdict", "fp", "copies", "token", "a.b", "n_words", "score", "_turn"]
    rows = [(d, t, None if i % 3 else "en", None if i % 4 == 0 else "s", None, *extra) for i, (d, t) in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in extra)
    docs = spark.createDataFrame(rows, schema)
    counts = []
    for _, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = corpus_pipeline.materialise(stage(spark, docs, str(tmp_path)), "test-odd")
        kept = docs.collect()
        counts.append(Counter(r.doc_id for r in kept))
        if "text" in columns and "ids" not in docs.columns:
            assert docs.columns == columns
        assert all(r[c] == c for r in kept for c in extra)
    rules, dedup, secrets, mixed, encoded = counts
    assert rules == Counter({None: 2, 1: 2, 2: 1, 6: 1, 7: 1, 8: 1, 9: 1})
    assert dedup == secrets == Counter({None: 2, 1: 1, 6: 1, 7: 1, 8: 1, 9: 1})
    assert encoded == mixed and max(mixed.values()) <= 4
