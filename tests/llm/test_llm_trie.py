"""The conversation trie against one of Python dictionaries."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from edgeloom.llm import trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, path string, shard int, depth bigint"


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[: trie.WIDTH]


def expected(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    turns = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    rebuilt = {c: turns.get(c - c % 20, [])[: (h := zlib.crc32(str(c).encode()) % 4)] + ts[h:] for c, ts in turns.items()}
    members = defaultdict(list)
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)

    def below(p):
        leaves, saved = (0 if kids[p] else 1), (len(members[p]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0)
        for k in kids[p]:
            x, y = below(k)
            leaves, saved = leaves + x, saved + y
        return leaves, saved

    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), *below(p), hashlib.sha256(",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(p)).encode()).hexdigest())
        for p, m in members.items())


@pytest.mark.parametrize("shards", [1, 3, 40])
@pytest.mark.parametrize("piece", [1, 5000])
def test_trie_equals_dictionaries(spark, shards, piece):
    """Copies beyond a shard, nulls, ties, repeated rows, absent bases, no turns left, gaps, clashing names."""
    r = random.Random(shards)
    rows = [(c, t, r.choice(["user", None, ""]), r.choice(["a b", "c", None, "", "d e\x0bf"])) for c in range(0, 150, r.choice([1, 2])) for t in range(r.randint(1, 5)) if c % 40 or c > 80]
    rows += [(c, t, "user", "Same words here") for c in range(200, 290) for t in range(3)]
    rows += [(400, None, "user", "x"), (400, 1, "user", "y"), (400, 1, "user", "y"), (400, 1, "b", "z"), (None, 0, "user", "lost"), (401, 7, "user", "x")]
    rows += [(500, t, "user", f"{t}") for t in range(300)]
    got = trie.prefix_trie(trie.paths_of(spark.createDataFrame([(*x, "p", 1, 2) for x in rows], SCHEMA)), shards, piece)
    assert sorted((tuple(x) for x in got.collect()), key=str) == sorted(expected(rows), key=str)


def test_no_conversations(spark):
    assert trie.prefix_trie(trie.paths_of(spark.createDataFrame([], SCHEMA))).count() == 0


def test_long_paths_lower_the_number_of_shards(spark, monkeypatch):
    """The splitters stay within their bound, and results the same."""
    rows = [(c, t, "user", f"{c % 7} {t}") for c in range(60) for t in range(20)]
    frame = spark.createDataFrame([(*x, "p", 1, 2) for x in rows], SCHEMA)
    monkeypatch.setattr(trie, "SKELETON_BYTES", 2000)
    sent = trie._splitters(trie.paths_of(frame), 3, 3)
    assert sum(len(p) + 16 for p, _ in sent) <= 2000
    assert sorted((tuple(x) for x in trie.prefix_trie(trie.paths_of(frame), 50).collect()), key=str) == sorted(expected(rows), key=str)
