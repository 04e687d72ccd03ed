import base64
import re
from collections import Counter

import tiktoken

from aerotally.llm import token_rollups as tr

RANKS = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(tr.DEFAULT_RANKS, "rb"))}
ENC = tiktoken.Encoding("t", pat_str=tr.PATTERN, mergeable_ranks=RANKS, special_tokens={})
DOCS = [(i, f"document {i} is  about\n\n{'x ' * i}", ["a", "b", None][i % 3], "en" if i % 2 else None) for i in range(40)]
DOCS += [(100, None, "a", "de"), (101, "", "a", "de"), (102, "a b " * 40000, "c", "fr"), (7, "again  seven", "a", "en"), (None, "no id", "a", "en")]
LABELS = [(i, int(i % 5 > 0), int(i % 7 == 0)) for i in range(0, 60, 2)] + [(102, 0, 0), (7, 0, 0), (None, 0, 1)]


def n(t):
    return len(ENC.encode_ordinary(t)) if t else 0


def frames(spark):
    docs = spark.createDataFrame([(*d, 5, "k") for d in DOCS], "doc_id long, text string, source string, lang string, tokens int, tokenizer string")
    return docs, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def brute():
    toxic, poor = {d for d, _, t in LABELS if t} - {None}, {d for d, q, _ in LABELS if not q}
    squeeze = lambda t: re.sub(r"\s+", " ", t or "").strip(" ")
    out = Counter()
    docs = Counter()
    best = {}
    for d, t, s, g in DOCS:
        if d in poor:
            best[d] = max(best.get(d, 0), n(squeeze(t)))
    for d, t, s, g in DOCS:
        if d not in toxic:
            docs[s, g] += 1
            out[s, g] += best[d] if d in poor and d is not None else n(t)
    return {k: (docs[k], out[k]) for k in docs}


def test_maintain_matches_brute_force(spark):
    got = {(r.source, r.lang): (r.docs, r.tokens) for r in tr.maintain(*frames(spark)).collect()}
    assert got == brute()


def test_commits_are_idempotent_and_recover(spark):
    docs, labels = frames(spark)
    state = tr.Rollups(spark)
    counts = tr.counted(docs)
    assert state.commit(1, inserts=counts) and not state.commit(1, inserts=counts)
    first = sorted(map(str, state.totals().collect()))
    # a batch that broke off after its ledger: it doesn't count, and comes out the same when it runs again
    spark.createDataFrame([(1, "a", "en", "v", 1, 999)], tr.LEDGER).write.parquet(state._path("ledger", 2))
    assert sorted(map(str, state.totals().collect())) == first and state.batches() == [1]
    assert state.commit(2, deletes=docs.select("doc_id"))
    left = state.totals().collect()
    assert [(r.docs, r.tokens) for r in left] == [(1, n("no id"))]
    new = state.compact()
    assert [(r.docs, r.tokens) for r in new.totals().collect()] == [(1, n("no id"))] and new.batches() == [2]
    assert new.commit(3, inserts=counts) and not new.commit(2, inserts=counts)


def test_empty(spark):
    docs, labels = frames(spark)
    assert tr.maintain(docs.limit(0), labels.limit(0)).count() == 0
