"""The Merkle manifest against trees built in plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from edgeloom.llm import merkle

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, tree string, hash string, root string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    doc_id, _, lang, source, n_chars = row
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def grown(nodes):
    """The root and each node's (before, after) by level."""
    paths, place, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for i, q in enumerate(place):
            first = q // 8 * 8
            paths[i].append(("".join(level[first:q]), "".join(level[q + 1 : first + 8])))
            place[i] = q // 8
        level = [digest(*level[k : k + 8]) for k in range(0, len(level), 8)]
    return level[0], paths


def expected(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[1])))
        trees.append((own, *grown([leaf_of(r, r[1]) for r in own])))
    root, above = grown([t[1] for t in trees]) if trees else ("", [])
    out = []
    for (own, subroot, paths), rest in zip(trees, above, strict=True):
        for row, path in zip(own, paths, strict=True):
            text = row[1]
            if text is not None and row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
                text = text.encode().lower().decode()
            node = leaf_of(row, text)
            for before, after in path + rest:
                node = digest(before, node, after)
            out.append((row[0], leaf_of(row, row[1]), subroot, root, digest(*(b + a for b, a in path + rest)), node, node == root))
    return sorted(out, key=str)


@pytest.mark.parametrize(("n", "height"), [(0, 3), (1, 3), (9, 1), (70, 1), (620, 3)])
def test_manifest_equals_trees_in_plain_python(spark, n, height):
    """Nulls, ties, repeated rows, clashing names, one language alone, several passes."""
    r = random.Random(n)
    rows = [
        (r.choice([None, *range(n)]) if n < 100 else i, r.choice([None, "", "Ab É\n", "Q z " * 9]), r.choice(["en", "en", "en", None, "", "é", "\U0001f600"]) if n > 1 else "en", r.choice([None, "s"]), r.choice([None, 3]))
        for i in range(n)
    ]
    docs = spark.createDataFrame([(*row, "t", "h", "r") for row in rows], SCHEMA)
    got = merkle.verify(docs, merkle.third_lowered(F.col("doc_id"), F.col("text")), height)
    assert sorted((tuple(x) for x in got.collect()), key=str) == expected(rows)


def test_level_strings(spark):
    rows = [(i, f"text {i}", "en", "s", i) for i in range(70)]
    manifest = merkle.build(spark.createDataFrame([(*row, "t", "h", "r") for row in rows], SCHEMA), height=1)
    leaves = [leaf_of(r, r[1]) for r in rows]
    first = manifest.levels[0].orderBy("block").collect()
    assert "".join(x.l0 for x in first) == "".join(leaves) and [x.top for x in first] == [digest(*leaves[k : k + 8]) for k in range(0, 70, 8)]
    assert manifest.proofs.where("leaf <> claim").isEmpty() and [x.hash for x in manifest.subroots.collect()] == [grown(leaves)[0]]
