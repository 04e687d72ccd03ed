import hashlib
import random
import re
from zlib import crc32

from aerotally.llm import prefix_trie

SCHEMA = "turn long, conv_id long, d1 string, role string, text string, depth int"


def brute(rows):
    convs = {}
    for turn, c, _, role, text, _ in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            convs.setdefault(c, []).append((turn is not None, turn or 0, tie, (role, text)))
    convs = {c: [x[-1] for x in sorted(ts, key=lambda x: x[:3])] for c, ts in convs.items()}
    made = {}
    for c, ts in convs.items():
        h = crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        made[c] = convs.get(base, [])[:h] + ts[h:]
    members = {}
    for c, ts in made.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        kids = children.get(p, [])
        leaves[p] = sum(leaves[k] for k in kids) or 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        saved[p] = (len(members[p]) - 1) * words + sum(saved[k] for k in kids)
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(made[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    names = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    return sorted((tuple(r[n] for n in names) for r in prefix_trie.trie(df, **kw).collect()), key=str)


def conversations(seed=1, n=90):
    r = random.Random(seed)
    words = ["a b", "", None, "c\td\ne", "long " * 30, "ü ß"]
    rows = []
    for c in [*range(-25, n), 4003, 4000]:
        if r.random() < 0.15:
            continue
        for t in range(r.choice([1, 2, 3, 5, 9])):
            rows.append((None if r.random() < 0.05 else t, c, "x", r.choice(["user", None, "bot"]) if r.random() < 0.3 else "user", r.choice(words[:4]) if r.random() < 0.7 else f"{r.random()} q", 1))
    return rows


def test_matches_brute_force_with_nulls_ties_and_missing_bases(spark):
    rows = conversations()
    rows += [(0, None, "x", "user", "nobody's", 1), (2, 7, "y", "user", "tied", 1), (2, 7, "y", "user", "also tied", 1), (2, 7, "y", "user", "tied", 1)]
    assert found(spark, rows) == brute(rows)


def test_a_sketch_without_room_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 8)
    rows = conversations(2)
    assert found(spark, rows, most_cells=8) == brute(rows)


def test_long_copies_and_a_common_conversation(spark):
    long = [(t, c, "x", "user", f"turn {t} of many" if t < 180 or c == 40 else f"{c} alone", 1) for c in (40, 60, 80) for t in range(200)]
    hot = [(t, c, "x", "user", f"same {t}", 1) for c in range(1000, 1400) for t in range(3)]
    rows = long + hot
    assert found(spark, rows) == brute(rows)


def test_pieces_of_member_lists_join_to_the_same_hash(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 60)
    rows = [(t, c, "x", "user", f"same {t}", 1) for c in range(2000, 2300) for t in range(2)]
    assert found(spark, rows) == brute(rows)


def test_one_turnless_conversation_and_empty(spark):
    turnless = next(c for c in range(1, 20) if crc32(str(c).encode()) % 4 > 1)
    rows = [(0, turnless, "x", "user", "its own", 1)]
    got = found(spark, rows)
    assert got == brute(rows) and got == [(turnless, 0, None, 1, 0, 1, 0, hashlib.sha256(str(turnless).encode()).hexdigest())]
    assert prefix_trie.trie(spark.createDataFrame([], SCHEMA)).count() == 0
