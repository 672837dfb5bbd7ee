"""The conversation trie against a plain loop."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from tallyloom.llm import convtrie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, kind int"


def plain(rows):
    turns = defaultdict(list)
    for c, t, r, x, *_ in rows:
        if c is not None:
            r, x = r or "", x or ""
            turns[c].append((t is not None, t or 0, r, hashlib.md5(f"{len(r)}:{r}{x}".encode()).hexdigest(), x))
    own = {c: [(r, x) for _, _, r, _, x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - c % 100, [])[:h] + v[h:]
    members = defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    done = {}

    def below(p):
        got = [below(k) for k in kids[p]]
        saved = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(g[1] for g in got)
        leaves = sum(g[0] for g in got) if got else 1
        ends = ",".join(str(c) for c in sorted(members[p]) if len(built[c]) == len(p))
        up = min(members[p[:-1]]) if p else None
        done[p] = (min(members[p]), len(p), up, len(members[p]), len(kids[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
        return leaves, saved

    if members:
        below(())
    return sorted(done.values(), key=repr)


def ours(spark, rows, **more):
    table = spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA)
    found = convtrie.prefix_trie(convtrie.rebuilt(convtrie.turn_arrays(table)), **more)
    return sorted((tuple(r) for r in found.collect()), key=repr)


def made(seed, n):
    rng = random.Random(seed)
    texts = ["", "a", "bé", "same", None, "x" * 3000]
    rows = []
    for c in rng.sample(range(-30, 1000), n):
        for t in range(rng.choice([1, 1, 2, 3, 7])):
            rows.append((c, t if rng.random() < 0.95 else None, rng.choice(["user", "assistant", None]), rng.choice(texts)))
    rows += rng.sample(rows, 5)  # repeated rows
    first = [("user", "hello"), ("assistant", "hi")]
    for c in range(2000, 2000 + n):  # one conversation makes up half of all
        rows += [(c, t, *x) for t, x in enumerate(first * 4)]
    return rows + [(None, 0, "user", "nobody's")]


@pytest.mark.parametrize("ranges, stitch", [(1, 256), (5, 256), (9, 2)])
def test_trie(spark, monkeypatch, ranges, stitch):
    monkeypatch.setattr(convtrie, "STITCH", stitch)
    rows = made(ranges, 120)
    assert ours(spark, rows, ranges=ranges) == plain(rows)


def test_trie_of_nothing(spark):
    assert ours(spark, []) == []
    assert ours(spark, [(None, 1, "a", "b")]) == []
    assert len(ours(spark, [(5, None, None, None)])) == len(plain([(5, None, None, None)]))


def test_long_conversations_share_all_but_the_last_turn(spark):
    rows = [(100 * c, t, "user", "t" if t < 399 else str(c)) for c in range(1, 5) for t in range(400)]
    assert ours(spark, rows, ranges=3) == plain(rows)


def test_common_turns():
    a = bytes(range(16)) * 9
    for k in range(10):
        b = a[: 16 * k] + b"\xff" * 16 * 4
        assert convtrie.common_turns(a, b) == min(k, 9)
    assert convtrie.common_turns(a, a[:48]) == 3 and convtrie.common_turns(b"", a) == 0
