"""Fuzzy merge against brute force."""

import itertools
import random

from pyspark.sql import functions as F

from edgeloom.operators import align
from edgeloom.operators.fuzzy import fuzzy_merge, similar_names


def ratio(a, b):
    a, b = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    row = [0] * (len(b) + 1)
    for x in a:
        prev, row = row, [0]
        for j, y in enumerate(b):
            row.append(prev[j] + 1 if x == y else max(prev[j + 1], row[j]))
    return 200.0 * row[-1] / (len(a) + len(b))


def make_names():
    rng = random.Random(7)
    words = ["MINISTRY", "DEFENCE", "NATIONAL", "BANK", "COUNCIL", "FEDERATION", "INDUSTRY", "WORKERS", "UNION", "CENTRAL", "NORTHERN", "ASSEMBLY"]
    base = [" ".join(rng.sample(words, n)) for n in (2, 3, 4, 5, 6, 7, 8, 9) for _ in range(5)]
    out = set(base)
    for name in base:
        for edits in (1, 2, 3):
            text = list(name)
            for _ in range(edits):
                spot = rng.randrange(len(text))
                if rng.random() < 0.5:
                    text.insert(spot, rng.choice("ABCXYZ"))
                elif len(text) > 5 and text[spot] != " ":
                    text.pop(spot)
            out.add(" ".join("".join(text).split()))
    return sorted(out, key=lambda x: rng.random())


def test_similar_pairs_and_greedy_merge_match_brute_force(spark):
    names = make_names()
    rows = [(f"ORG_{i:06d}", n) for i, n in enumerate(names)]
    kept = spark.createDataFrame(rows, "org_id string, clean_name string")
    found = {(r.low_id, r.high_id) for r in similar_names(kept).collect()}
    expected = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if len(a[1]) >= 8 and len(b[1]) >= 8 and ratio(a[1], b[1]) >= 97}
    assert found == expected and len(expected) > 40

    gone, owner = set(), {}
    for a in rows:
        if a[0] in gone:
            continue
        for b in rows:
            if b[0] > a[0] and b[0] not in gone and (a[0], b[0]) in expected:
                gone.add(b[0])
                owner[b[0]] = a[0]
    assert {r.old_org_id: r.survivor_id for r in fuzzy_merge(kept).collect()} == owner


def test_qualifiers_keep_names_apart_and_align_redirects(spark):
    rows = [
        ("ORG_000001", "Head of Government Office (Ukraine)"), ("ORG_000002", "Head of Government Office (Ukrainee)"),
        ("ORG_000003", "Northern Federation of Workers Unions"), ("ORG_000004", "Northern Federation of Worker Unions"),
        ("ORG_000005", "Police"), ("ORG_000006", "The  Northern Federation of Workers Unions"),
    ]
    orgs = spark.createDataFrame([(i, n, n, n.upper(), n) for i, n in rows], "org_id string, canonical_name string, raw_name string, normalized_name string, clean_name string")
    table, aliases = align.align(orgs, fuzzy=True)
    assert [r.old_org_id for r in table.orderBy("org_id").collect()] == ["ORG_000001", "ORG_000002", "ORG_000003"]
    # The removed organization's own alias moves over; the fuzzy row repeats it and goes.
    owned = {(r.old_org_id, r.alias) for r in aliases.collect()}
    assert ("ORG_000003", "Northern Federation of Worker Unions") in owned
    assert ("ORG_000003", "The  Northern Federation of Workers Unions") in owned


def test_keys_grow_no_faster_than_names(spark):
    from edgeloom.operators.fuzzy import own_budget, rare_grams

    names = spark.createDataFrame([(f"O{n}", " ".join(f"W{k:03d}" for k in range(n))) for n in (4, 20, 40)], "org_id string, t string").selectExpr("*", "length(t) as size")
    names = names.withColumn("budget", own_budget(names["size"])).drop("size")
    keys = {r.org_id: r["count"] for r in rare_grams(names).groupBy("org_id").count().collect()}
    assert keys == {"O4": 4, "O20": 19, "O40": 37}


def test_names_of_frequent_parts_meet_only_their_partners(spark):
    from edgeloom.operators.fuzzy import candidate_pairs, own_budget

    base = [" ".join(c + "ABCDEFGHIJ"[i // 10**k % 10] * 4 for k, c in enumerate("KLMNO")) for i in range(600)]
    rows = [(f"B{i:05d}", n) for i, n in enumerate(base)] + [(f"V{i:05d}", n[:1] + n[2:]) for i, n in enumerate(base) if i % 3 == 0]
    names = spark.createDataFrame(rows, "org_id string, t string")
    names = names.withColumn("budget", own_budget(F.length("t")))
    # Each name has one partner; by grams, which tens of names share, there were thousands of pairs.
    assert candidate_pairs(names).count() == 200
    merged = fuzzy_merge(names.withColumnRenamed("t", "clean_name").drop("budget")).collect()
    assert {r.old_org_id: r.survivor_id for r in merged} == {f"V{i:05d}": f"B{i:05d}" for i in range(0, 600, 3)}


def test_equal_names_go_where_the_first_of_them_goes(spark):
    long, near = "NORTHERN FEDERATION OF WORKERS", "NORTHERN FEDERATION OF WORKER"
    rows = [("O1", near), ("O2", long), ("O3", long), ("O4", near), ("O5", "POLICE"), ("O6", "POLICE"), ("O7", "CENTRAL BANK"), ("O8", "CENTRAL BANK")]
    rows += [(f"P{i:03d}", "NATIONAL COUNCIL") for i in range(300)]
    merged = {r.old_org_id: (r.survivor_id, round(r.ratio, 3)) for r in fuzzy_merge(spark.createDataFrame(rows, "org_id string, clean_name string")).collect()}
    assert merged == {
        "O2": ("O1", round(200 * 29 / 59, 3)), "O3": ("O1", round(200 * 29 / 59, 3)), "O4": ("O1", 100.0), "O8": ("O7", 100.0),
        **{f"P{i:03d}": ("P000", 100.0) for i in range(1, 300)},
    }
