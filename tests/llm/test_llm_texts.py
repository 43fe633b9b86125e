"""Training-data operators on documents against brute force: nulls, empty and repeated rows, ties, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from edgeloom.llm import decontaminate, licenses, lm_score, packing, simhash, suffix_dedup, token_counts, token_files
from edgeloom.llm.tokens import Encoder, default_tokenizer, load_tokenizer

SCHEMA = "doc_id bigint, text string, lang string, start string, key string, fp string, label string, n_chars bigint"


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(["tha", "ré", "io", "SH", "un", "le", "ö"]) for _ in range(r.randint(1, 3))) for _ in range(n))


def texts() -> list[tuple[int | None, str | None]]:
    base, passage = words(1, 120), words(99, 60)
    return [
        (5, base), (2, base), (2, base), (9, base + " end"), (3, None), (4, ""), (6, " \n\t "), (None, words(3, 40)), (7, passage + words(4, 50)),
        (8, words(5, 30) + " " + passage), (8, "x"), (10, "ab " * 900), (11, words(7, 4000)), (12, "Released under the MIT License. " + words(8, 20)),
        (13, "é" * 150 + "日本" * 80), (14, "日本" * 80 + "!"), (15, "one"), (16, "One"),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, texts())


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "xx", "s", "k", "f", "l", len(t or "")) for i, t in rows], SCHEMA)


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def plain():
    tool = load_tokenizer(default_tokenizer())
    return lambda t: tool.encode(t or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_ids_equal_those_of_the_whole_text(plain):
    tool, r = Encoder(default_tokenizer(), capacity=50), random.Random(2)
    parts = [" ", "  ", "\n", "\t", "a", "'s", "é", "3", "!", "\x1c", "<|endoftext|>", "日", "\r\n", "bc", "\x85", "𝄞", "word"]
    made = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(3000)] + [t or "" for _, t in texts()]
    assert [x.tolist() for x in tool.encode(made)] == [plain(t) for t in made]


def test_token_files_round_trip(spark, docs, plain):
    got = token_files.token_files(docs)
    start, expected = 0, []
    for i, t in sorted(((i, t or "") for i, t in texts()), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode())):
        ids = plain(t) + [2]
        expected.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert rows(got, "doc_id", "start", "n_tokens", "ids_crc32") == sorted(expected, key=str)
    assert token_files.token_files(docs.limit(0)).count() == 0
    folder = token_files.stage_path(spark, "tokens")
    read = token_files.read_token_files(token_files.write_token_files(docs, folder), with_ids=True)
    assert {(r.doc_id, tuple(r.ids)) for r in read.collect()} == {(i, tuple(plain(t) + [2])) for i, t in texts()}


def test_packing_places_every_piece_once(docs, plain):
    got = packing.pack(docs, capacity=64).collect()
    expected = []
    for i, t in texts():
        ids, start = plain(t) + [0], 0
        size = (len(ids) - 1) % 64 + 1
        for k in range((len(ids) - 1) // 64 + 1):
            expected.append((i, k, start, size, crc(ids[start : start + size])))
            start, size = start + size, 64
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(expected, key=str)
    bins: dict[int, list] = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, size in sorted(held):
            assert offset == at
            at += size
        assert at <= 64
    counts: dict[int, int] = {}
    for r in got:
        counts[r.length] = counts.get(r.length, 0) + 1
    assert len(bins) == packing.lower_bound(counts, 64)
    assert packing.pack(docs.limit(0)).count() == 0


def fewest(items: list[int], capacity: int) -> int:
    """By trying all places."""
    best = len(items)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(items):
            best = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + items[k] <= capacity and bins[b] not in bins[:b]:
                place(k + 1, bins[:b] + [bins[b] + items[k]] + bins[b + 1 :])
        place(k + 1, [*bins, items[k]])

    place(0, [])
    return best


@pytest.mark.parametrize("seed", range(25))
def test_bin_completion_is_optimal_on_small_sets(seed):
    r = random.Random(seed)
    items = sorted((r.randint(1, 30) for _ in range(r.randint(1, 11))), reverse=True)
    counts = {s: items.count(s) for s in items}
    made = packing.solve(counts, 30)
    used = {}
    for pattern, times in made:
        assert sum(pattern) <= 30
        for s in pattern:
            used[s] = used.get(s, 0) + times
    assert used == counts
    assert sum(n for _, n in made) == fewest(items, 30) >= packing.lower_bound(counts, 30)


def simhash_brute(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    ones = [sum(xxhash.xxh64_intdigest(x, 42) >> b & 1 for x in runs) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(runs))


def test_simhash_components(spark, docs):
    more = texts() + [(100 + i, base) for i in range(3) for base in (words(40, 300 + i),)]
    prints = [(i, simhash_brute(t, 3)) for i, t in more]
    group = list(range(len(prints)))
    for _ in prints:
        for a, x in enumerate(prints):
            for b, y in enumerate(prints):
                if (x[1] ^ y[1]).bit_count() <= 2:
                    group[a] = group[b] = min(group[a], group[b])
    least = {g: min((prints[k][0] for k in range(len(prints)) if group[k] == g and prints[k][0] is not None), default=None) for g in set(group)}
    expected = sorted(((i, f"{f:016x}", least[group[k]]) for k, (i, f) in enumerate(prints)), key=str)
    assert rows(simhash.simhash_components(frame(spark, more)), "doc_id", "fingerprint", "component_id") == expected
    assert simhash.simhash_components(docs.limit(0)).count() == 0


def test_links_at_every_distance(spark):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(20)]
    found = {x ^ sum(1 << b for b in r.sample(range(64), d)) for x in base for d in range(5)}
    signed = [x - (1 << 64) if x >> 63 else x for x in found]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp bigint"), 2)
    got = {(r.node, r.component) for r in simhash.components(edges).collect()}
    parent = {x: x for x in signed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in signed:
        for y in signed:
            if x < y and ((x ^ y) & (1 << 64) - 1).bit_count() <= 2 and root(x) != root(y):
                a, b = sorted((root(x), root(y)))
                parent[b] = a
    joined = {x for x in signed for y in signed if x != y and root(x) == root(y)}
    assert got == {(x, min(y for y in signed if root(y) == root(x))) for x in joined}


def test_one_document_of_a_group_stays(spark, docs):
    long = words(50, 400).split()
    near = list(long)
    near[200] = "changed"
    more = texts() + [(200, " ".join(long)), (201, " ".join(near)), (202, words(51, 400))]
    kept = simhash.keep_one(frame(spark, more))
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 200 in ids and 201 not in ids and 202 in ids
    assert ids.count(2) == 1 and 5 not in ids  # copies
    assert {10, 11, 12, None} <= set(ids)


def test_strangers_on_a_variant_hide_no_link(spark):
    """b and c meet only where a, smaller and far from both on the whole, meets them too."""
    full = (1 << 26) - 1
    prints = [(1, [7, 0, 0]), (2, [7, full, full]), (3, [7, full ^ 7, full ^ 7]), (4, [7, full ^ (7 << 9), full ^ (7 << 9)])]
    edges = simhash.part_links(spark.createDataFrame(prints, "fp bigint, parts array<bigint>"), simhash.Parts(3, 26))
    got = {frozenset((r.a, r.b)) for r in edges.collect()}
    assert {frozenset((2, 3)), frozenset((2, 4))} <= got and not any(1 in e for e in got)


def test_near_copies_in_a_family_of_half_similar_texts(spark):
    """keep_one against brute-force Jaccard; what is deleted never depends on how many rows there are."""
    r, half = random.Random(9), words(90, 60)
    more = [(i, half + " " + words(1000 + i, 60)) for i in range(300)]
    for k in range(150):  # near copies at about 0.6 to 0.97
        w = more[k][1].split()
        for at in r.sample(range(len(w)), r.randint(1, 6)):
            w[at] = f"changed{k}x{at}"
        more.append((1000 + k, " ".join(w)))
    sets = [{tuple(w[s : s + 5]) for s in range(len(w) - 4)} for w in (t.lower().split() for _, t in more)]
    near = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in range(len(sets)) for b in range(a)}
    group = list(range(len(more)))
    for (a, b), j in near.items():
        if j >= 0.8:
            one, other = group[a], group[b]
            group = [min(one, other) if g in (one, other) else g for g in group]
    gone = {i for k, (i, _) in enumerate(more) if group[k] != k}
    found = {i for i, _ in more} - {x.doc_id for x in simhash.keep_one(frame(spark, more)).collect()}
    assert len(gone) > 50 and found <= gone
    assert len(found) >= 0.9 * len(gone)
    clear = {i for k, (i, _) in enumerate(more) if any(near.get((k, b), 0) >= 0.9 for b in range(k))}
    assert len(clear - found) <= 0.02 * len(clear)


def test_documents_without_an_id_of_their_own_stay(spark):
    more = texts() + [(None, words(52, 40)), (None, words(53, 40))]
    kept = simhash.keep_one(frame(spark, more)).collect()
    assert sorted(r.text for r in kept if r.doc_id is None) == sorted(t for i, t in more if i is None)
    assert sorted(r.text for r in kept if r.doc_id == 8) == sorted(t for i, t in more if i == 8)


def repeats_brute(rows, length):
    data = [(t or "").encode() for _, t in rows]
    seen: dict[bytes, int] = {}
    for b in data:
        for s in range(len(b) - length + 1):
            seen[b[s : s + length]] = seen.get(b[s : s + length], 0) + 1
    out = []
    for (i, _), b in zip(rows, data, strict=True):
        gone = [False] * len(b)
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@pytest.mark.parametrize("family,batch", [(4000, 100_000), (4000, 50), (1, 100)])
def test_repeated_bytes(spark, docs, monkeypatch, family, batch):
    """Whole families, families of many small batches, and windows counted by hash."""
    monkeypatch.setattr(suffix_dedup, "FAMILY", family)
    r = random.Random(5)
    shared = [words(60 + k, 60) for k in range(3)]
    more = texts() + [(300 + k, " ".join(r.choice(shared)[r.randint(0, 60) :][: r.randint(150, 400)] + words(400 + 9 * k + j, 4) for j in range(4))) for k in range(25)]
    add = suffix_dedup.Family.add
    if batch < 100_000:  # as many batches as there are windows, twice over
        def in_parts(self, keys, numbers):
            return np.unique(np.concatenate([add(self, keys[k : k + batch], numbers[k : k + batch]) for k in range(0, len(keys), batch)]))
        part = suffix_dedup.Family()
        keys = np.concatenate([suffix_dedup.windows_of(t.encode(), 200) for _, t in more if t and len(t.encode()) >= 200])
        numbers = np.arange(len(keys))
        assert np.array_equal(in_parts(part, keys, numbers), add(suffix_dedup.Family(), keys, numbers))
        assert len(part.levels) <= 2 + int(np.log2(len(keys)))
    assert rows(suffix_dedup.repeated_bytes(frame(spark, more)), *COLUMNS) == repeats_brute(more, 200)


def test_repeated_bytes_of_very_long_and_periodic_texts(spark, docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "STRETCH", 700)
    more = [(1, "abc" * 700), (2, words(70, 900)), (3, words(70, 900)[1000:4000]), (4, "a" * 199), (5, "b" * 200), (6, "b" * 201)]
    assert rows(suffix_dedup.repeated_bytes(frame(spark, more)), *COLUMNS) == repeats_brute(more, 200)
    left = suffix_dedup.without_repeats(frame(spark, more))
    assert left.columns == docs.columns
    assert {r.doc_id: r.text for r in left.collect()}[5] == ""
    assert all(r.n_chars == len(r.text) for r in left.collect())
    assert suffix_dedup.repeated_bytes(docs.limit(0)).count() == 0


def test_a_long_text_after_a_short_one_has_the_anchors_of_its_windows(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "STRETCH", 700)
    monkeypatch.setattr(suffix_dedup, "PLACE", 11)
    given = [words(71, 30).encode(), words(70, 400).encode(), words(72, 30).encode()]
    got = {}
    for numbers, offsets, part in suffix_dedup.stretches(given, 200):
        assert sum(len(x) for x in part) < 1 << 11
        for text, start, count, anchor, _ in zip(*suffix_dedup.fragments(part, 200), strict=True):
            got |= {(numbers[text], offsets[text] + int(start) + k): anchor for k in range(count)}
    assert len(given[1]) > 1 << 11
    assert got == {(i, k): suffix_dedup.fragments([t[k : k + 200]], 200)[3][0] for i, t in enumerate(given) for k in range(len(t) - 199)}


def hits_brute(rows, items, width):
    pattern, lower = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: pattern.findall((t or "").translate(lower))
    windows: dict[tuple, set] = {}
    for i, t in items:
        w = split(t)
        for s in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[s : s + width]), set()).add("" if i is None else str(i))
    out = []
    for i, t in rows:
        w, hit, met = split(t), set(), set()
        for s in range(len(w)):
            for n in range(1, width + 1):
                if (k := tuple(w[s : s + n])) in windows and len(k) == n:
                    hit.update(range(s, s + n))
                    met |= windows[k]
        out.append((i, len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_decontamination(spark, docs):
    lines = words(1, 120).split()
    items = [(1, " ".join(lines[20:45])), (11, " ".join(lines[30:60]) + " other"), (2, "one!"), (3, None), (4, " .. "), (5, words(7, 4000)[300:900]),
             (5, "ab ab ab ab"), (None, "x"), (6, "nowhere to be found"), (7, "ab " * 11), (8, words(80, 30))]
    table = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id bigint, text string, term string")
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert rows(decontaminate.decontaminate(docs, table), *names) == hits_brute(texts(), items, 10)
    assert rows(decontaminate.decontaminate(docs, table.limit(0)), *names) == hits_brute(texts(), [], 10)
    assert decontaminate.decontaminate(docs.limit(0), table).count() == 0
    clean = decontaminate.clean_only(docs, table)
    assert clean.columns == docs.columns
    assert rows(clean, "doc_id", "text") == sorted(((i, t) for i, t in texts() if not hits_brute([(i, t)], items, 10)[0][-1]), key=str)


def test_decontamination_runs_no_python(docs, spark):
    items = spark.createDataFrame([(1, "one two")], "item_id bigint, text string")
    plan = decontaminate.decontaminate(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_proximity(spark):
    made = frame(spark, [(1, "alpha x beta gamma"), (2, "alpha beta gamma"), (3, "alpha x y z beta gamma")])
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id bigint, text string")
    sought = decontaminate.windows(items).select("window_id", "terms")
    index = decontaminate.build_index(made, sought.selectExpr("explode(terms) as term").distinct())
    assert {r.doc for r in decontaminate.find(index, sought).collect()} == {2}
    assert {r.doc for r in decontaminate.find(index, sought, slop=1).collect()} == {1, 2}


def test_token_counts(spark, docs, plain):
    got = token_counts.count_tokens(docs).collect()
    for i, t in texts():
        if t and [x[0] for x in texts()].count(i) == 1:
            own = [r for r in got if r.doc_id == i]
            assert sum(r.n_tokens for r in own) == len(plain(t))
            assert "".join(t[r.start_char : r.end_char] for r in sorted(own, key=lambda r: r.section)) == t
    one = frame(spark, [(1, "alpha\n\n\n beta 日本"), (2, "abc")])
    lines = [(r.section, r.n_tokens) for r in token_counts.count_tokens(one).collect() if r.doc_id == 1]
    assert sum(n for _, n in lines) == len(plain("alpha\n\n\n beta 日本"))
    spans = spark.createDataFrame([(1, "head", 0, 5), (1, "tail", 7, 99), (1, "none", 5, 2), (2, None, None, 3), (3, "lost", 0, 1)], "doc_id bigint, name string, start bigint, end bigint")
    named = {(r.doc_id, r.name): r.n_tokens for r in token_counts.count_tokens(one, spans).collect()}
    assert named[1, "head"] == 1 and named[2, None] == 1
    assert sum(n for (i, _), n in named.items() if i == 1) == len(plain("alpha\n\n\n beta 日本"))
    assert token_counts.count_tokens(docs.limit(0)).count() == 0


@pytest.mark.parametrize("rule,expected", [("largest", [0, 1, 1, -1]), ("first", [0, 0, 1, -1]), ("last", [0, 1, 1, -1])])
def test_tokens_that_cross_a_boundary(rule, expected):
    at, crossing = token_counts.attribute(np.array([2, 6, 8, 12]), np.array([0, 3]), np.array([3, 7]), rule)
    assert at.tolist() == expected and crossing.tolist() == [False, True, True, False]


def sequences(patterns):
    return sum(n for _, n in patterns)


def test_packing_of_hard_lengths():
    """Lengths of which best fit wastes much: all pieces placed, and within a stated distance of the lower bound."""
    r = random.Random(1)
    [r.randint(300, 1200) for _ in range(500)]
    first = Counter(r.randint(500, 900) for _ in range(2000))
    made = packing.solve(first, 2048, nodes=100)
    assert sum((Counter({s: u.count(s) * n for s in set(u)}) for u, n in made), Counter()) == first and all(sum(u) <= 2048 for u, _ in made)
    assert sequences(made) <= 727 < sequences(packing.best_fit(first, 2048))  # 727 by pairs and triples
    for seed, low, high, gap in ((2, 500, 1000, 0.06), (3, 100, 1500, 0.01), (4, 600, 700, 0.05), (5, 1, 2048, 0.01), (6, 400, 800, 0.02)):
        r = random.Random(seed)
        counts = Counter(r.randint(low, high) for _ in range(3000))
        assert sequences(packing.solve(counts, 2048, nodes=50)) <= (1 + gap) * packing.lower_bound(counts, 2048) + 1


def test_fullest_filling_is_the_fullest():
    r = random.Random(8)
    for _ in range(60):
        left = Counter(r.randint(1, 30) for _ in range(r.randint(0, 9)))
        room = r.randint(0, 60)
        used = packing.fullest(left, sorted(left, reverse=True), room)
        sums = {0}
        for s in left.elements():
            sums |= {x + s for x in sums}
        assert sum(used) == max(x for x in sums if x <= room) and not Counter(used) - left


def aligned_everywhere(template, words):
    """Most template words in order, over all places of a text: a plain table, no bands."""
    row = [0] * (len(words) + 1)
    for t in template:
        new = [0]
        for j, w in enumerate(words):
            new.append(max(row[j + 1], new[j], row[j] + (t == w)))
        row = new
    return row[-1]


def test_licenses_against_plain_alignment():
    """Altered notices in random texts: what covers enough by a plain table is found, with as many words."""
    index, r = licenses.build_index(licenses.TEMPLATES), random.Random(5)
    for name in ("MIT notice", "Apache-2.0 header", "ISC", "GPL-3.0 notice", "BSD-3-Clause"):
        template = licenses.WORD.findall(licenses.TEMPLATES[name].lower())
        for _ in range(6):
            body = list(template)
            for _ in range(r.randint(0, len(body) // 25)):
                at = r.randrange(len(body))
                body[at : at + 1] = r.choice([[], ["foreign"], [body[at], "more"]])
            around = ["plain", "prose", "of", "no", "kind"] * r.randint(1, 4)
            found = {x[0]: x for x in licenses.scan_text(" ".join(around + body + around), index)}
            plain = aligned_everywhere(template, body)
            assert name in found and plain >= found[name][5] >= plain - 1 and found[name][3] >= len(around) - 1
    assert licenses.scan_text(" ".join(["plain", "the", "software", "license", "of"] * 200), index) == []


@pytest.mark.parametrize("k", [1, 2, 3, 8, 20])
def test_notices_in_a_row(k):
    index = licenses.build_index(licenses.TEMPLATES)
    for name in ("MIT notice", "ISC"):
        found = licenses.scan_text(f"{licenses.TEMPLATES[name]} " * k, index)
        assert [x[0] for x in found] == [name] * k and len({x[1] for x in found}) == k


@pytest.mark.parametrize("gap", [12, 20, 45])
def test_a_license_around_foreign_words(gap):
    index, mit = licenses.build_index(licenses.TEMPLATES), licenses.TEMPLATES["MIT"].split()
    text = "front " * 5 + " ".join(mit[:60] + [f"foreign{i}" for i in range(gap)] + mit[60:]) + " back" * 5
    (found,) = licenses.scan_text(text, index)
    assert found[0] == "MIT" and found[7] == 1.0 and found[3] == 5


def test_each_template_is_found_as_itself():
    index = licenses.build_index(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES.items():
        assert [x[0] for x in licenses.scan_text(f"before {text} after", index)] == [name]


def test_license_spans(spark, docs):
    mit = licenses.TEMPLATES["MIT"]
    changed = mit.replace("free of charge", "free of any charge").replace("merge, ", "").upper()
    made = frame(spark, texts() + [(400, words(8, 30) + "\n" + changed + "\n" + words(9, 30)), (401, "the license of the software")])
    got = {(r.doc_id, r.license): r for r in licenses.scan(made).collect()}
    assert set(got) == {(12, "MIT notice"), (400, "MIT")}
    r = got[400, "MIT"]
    assert 0.95 < r.coverage < 1 and r.matched_words == r.template_words - 1
    text = words(8, 30) + "\n" + changed
    assert text[r.start_char : r.end_char].startswith("PERMISSION IS") and text[r.start_char : r.end_char].endswith("SOFTWARE")
    assert licenses.scan(docs.limit(0)).count() == 0


def test_cross_entropy_difference(spark, docs):
    more = texts() + [(500 + i, words(i, 50)) for i in range(20)]
    made = frame(spark, more)
    target = made.where("doc_id >= 500").select("doc_id", "text", "label")
    points = lm_score.vocabulary(made, 12)
    counted: dict[str, int] = {}
    for _, t in more:
        for c in (t or "").lower():
            counted[c] = counted.get(c, 0) + 1
    assert points == [ord(c) for c in sorted(counted, key=lambda c: (-counted[c], c))[:10]]

    def tokens(t):
        return [0, 0] + [points.index(ord(c)) + 2 if ord(c) in points else 1 for c in (t or "").lower()]

    def model(inside):
        counts: dict[tuple, int] = {}
        for i, t in more:
            s = tokens(t)
            for k in range(2, len(s)):
                for n in range(3) if inside is None or i in inside else ():
                    counts[tuple(s[k - n : k + 1])] = counts.get(tuple(s[k - n : k + 1]), 0) + 1

        def p(context, w):
            if context is None:
                return 1 / 12
            below = p(context[1:] if context else None, w)
            after = [counts.get((*context, x), 0) for x in range(12)]
            total, kinds = sum(after), sum(x > 0 for x in after)
            return (after[w] + kinds * below) / (total + kinds) if total else below

        return p

    ours, every = model({500 + i for i in range(20)}), model(None)
    for r in lm_score.cross_entropy_difference(made, target, 12, 3).collect():
        t = next(t for i, t in more if i == r.doc_id and len(t or "") == r.n_tokens)
        if not t:
            assert r.score == 0 and r.target_loss is None
            continue
        if len(t) > 500:
            continue
        s = tokens(t)
        a, b = (-sum(np.log(m(tuple(s[k - 2 : k]), s[k])) for k in range(2, len(s))) / len(t) for m in (ours, every))
        assert abs(r.target_loss - a) < 1e-4 and abs(r.background_loss - b) < 1e-4 and abs(r.score - (a - b)) < 1e-4
    assert lm_score.cross_entropy_difference(docs.limit(0), target).count() == 0
    assert lm_score.cross_entropy_difference(docs, target.limit(0)).count() == len(texts())


def test_all_characters_are_told_apart(spark):
    """More than 46 characters: two texts of rare ones differ, by brute force, sent and joined alike."""
    common = "".join(chr(c) for c in range(0x61, 0x7B)) + "".join(chr(c) for c in range(0xE0, 0xFF) if c != 0xF7)
    more = [(k, common * 3) for k in range(3)] + [(10, "δελταζητα"), (11, "δελτα"), (12, "жукъездит"), (12, "жукъездит"), (None, "日本語日本"), (13, None), (14, "")]
    made, target = frame(spark, more), frame(spark, [(10, None), (11, None)])
    size = len({c for _, t in more for c in t or ""}) + 1

    def model(inside):
        counts: dict[str, int] = {}
        for i, t in more:
            s = "^^^" + (t or "")
            for k in range(3, len(s)):
                for n in range(4) if inside is None or i in inside else ():
                    counts[s[k - n : k + 1]] = counts.get(s[k - n : k + 1], 0) + 1

        def p(context, w):
            after = [n for g, n in counts.items() if len(g) == len(context) + 1 and g.startswith(context)]
            below = p(context[1:], w) if context else 1 / size
            return (counts.get(context + w, 0) + len(after) * below) / (sum(after) + len(after)) if after else below

        return p

    models = model({10, 11}), model(None)
    expected = []
    for i, t in more:
        s = "^^^" + (t or "")
        a, b = (-sum(np.log(m(s[k - 3 : k], s[k])) for k in range(3, len(s))) / max(1, len(s) - 3) for m in models)
        expected.append((str(i), len(t or ""), round(a - b, 9)))
    for sent in (lm_score.SENT, 0):
        got = lm_score.cross_entropy_difference(made, target, sent=sent).collect()
        assert sorted((str(r.doc_id), r.n_tokens, round(r.score, 9)) for r in got) == sorted(expected)
        assert all((r.target_loss is None) == (r.n_tokens == 0) for r in got)
