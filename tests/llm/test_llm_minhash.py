"""HyperMinHash near-duplicates against comparing all sets."""

import random

import numpy as np
import pytest

from edgeloom.llm import hyperminhash as hm

SCHEMA = "doc_id bigint, text string, key string, band bigint, sketch string, fp string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k", 1, "s", "f") for i, t in rows], SCHEMA)


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(zip(words, words[1:])) if len(words) > 1 else frozenset(words)


def expected(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                root[top(i)] = top(j)
    names = {}
    for i, (doc_id, _) in enumerate(rows):
        names.setdefault(top(i), []).append(doc_id)
    named = {r: min((x for x in ids if x is not None), default=None) for r, ids in names.items()}
    return sorted(((d, len(s), named[top(i)], d == named[top(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=str)


def changed(r, words, n):
    """About n words replaced."""
    out = list(words)
    for _ in range(n):
        out[r.randrange(len(out))] = f"w{r.random()}"
    return out


def test_odd_rows(spark):
    five = "a b c d e f"
    rows = [(4, five), (3, five), (3, five), (9, "x " + five), (1, None), (2, ""), (5, " \n\t"), (6, "One"), (7, "one"), (None, "one"), (None, "lonely text here"), (8, "a b"), (10, "é" * 5 + " É"), (11, "\x0bq\x1cr s")]
    rows += [(12, "word " * 3000), (13, " ".join(f"v{i}" for i in range(40000))), (14, " ".join(f"v{i}" for i in range(36000)))]
    assert got(hm.kept_documents(frame(spark, rows))) == expected(rows)
    assert hm.kept_documents(frame(spark, [])).count() == 0


@pytest.mark.parametrize(("size", "edits", "members"), [(6, 1, 60), (40, 3, 120), (150, 12, 120), (300, 25, 80)])
def test_families_around_the_threshold(spark, size, edits, members):
    """Many members on either side of the threshold, chains, and two families that nearly touch."""
    r = random.Random(size)
    base = [f"b{r.randint(0, 10**6)}" for _ in range(size)]
    other = changed(r, base, edits)
    rows = [(k, " ".join(changed(r, base if k % 3 else other, r.randint(0, edits)))) for k in range(members)]
    link = base
    for k in range(30):
        link = changed(r, link, max(1, edits // 2))
        rows.append((1000 + k, " ".join(link)))
    r.shuffle(rows)
    assert got(hm.kept_documents(frame(spark, rows))) == expected(rows)


def test_registers_estimate_the_similarity():
    """Within five deviations, for sets smaller and larger than the sketch; empty buckets are filled alike."""
    r = np.random.default_rng(1)
    for n in (20, 300, 5000):
        for similarity in (0.2, 0.5, 0.8):
            found = []
            for _ in range(30):
                common = int(2 * n * similarity / (1 + similarity))
                x = hm._mix(r.integers(0, 2**63, 2 * n).astype(np.uint64))
                a, b = hm.registers(x[:n]), hm.registers(np.concatenate([x[:common], x[n : 2 * n - common]]))
                found.append(((a == b).mean(), common / (2 * n - common)))
            estimate, true = np.array(found).T
            assert abs((estimate - true).mean()) < 0.06 + 5 * (0.25 / hm.BUCKETS / 30) ** 0.5


def test_register_keeps_zeros_and_mantissa():
    values = np.array([1 << 40 | 5], np.uint64)
    least = int(hm._mix(values + hm._GOLDEN)[0])
    zeros = 64 - least.bit_length()
    assert set(hm.registers(values).tolist()) == {zeros << hm.MANTISSA | ((least << zeros & (2**64 - 1)) << 1 & (2**64 - 1)) >> (64 - hm.MANTISSA)}
