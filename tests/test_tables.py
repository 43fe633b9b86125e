"""Table operators on small fixtures: sources, responses, constraints, update, streaming."""

import random
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edgeloom.functions import temporal
from edgeloom.functions.sqlfuncs import register_sql_functions
from edgeloom.operators import candidates, constraints, dimension, edges, facts, ids, intervals, pairs, reduction, samples, update, views
from edgeloom.operators.dictionary import feed_a_dictionary, feed_b_dictionary, hot_names, look_up
from edgeloom.operators.facts import KEY
from edgeloom.sources import columns, files, readers, schemas, tables, testfeed, writers
from edgeloom.streaming import fuse, runs

SMALL = "/root/testdata/sf0.001"


# ---- sources and sinks ----------------------------------------------------------

def test_delimited_and_zipped_scans(spark, tmp_path):
    header = "\t".join(["Event Date", "Source Name", "CAMEO Code"])
    (tmp_path / "a").mkdir()
    (tmp_path / "all_tabs").mkdir()
    (tmp_path / "a" / "one.tab").write_text(f"{header}\n2023-01-02\tX \"Y\"\t010\n")
    (tmp_path / "all_tabs" / "old.tab").write_text(f"{header}\n2023-01-02\tOLD\t010\n")
    with zipfile.ZipFile(tmp_path / "a" / "two.zip", "w") as z:
        z.writestr("two.tab", f"{header}\n2023-01-03\tZ\t020\n2023-01-04\tW\t\n")
    (tmp_path / "a" / "broken.zip").write_bytes(b"not a zip")
    schema = schemas.text_schema("Event Date", "Source Name", "CAMEO Code")
    plain = readers.read_delimited(spark, str(tmp_path), schema, recursive=True, pattern="*.tab", exclude_directory="all_tabs", file_column="Source File")
    zipped = readers.read_zipped(spark, str(tmp_path), schema, file_column="Source File", recursive=True, skip_corrupt=True)
    assert [r.path.rsplit("/", 1)[-1] for r in readers.unreadable_archives(spark, str(tmp_path), recursive=True).collect()] == ["broken.zip"]
    with pytest.raises(Exception, match="not a zip file"):
        readers.read_zipped(spark, str(tmp_path), schema, recursive=True).collect()
    rows = sorted(tuple(r) for r in readers.union_drifted([plain, zipped]).fillna("").collect())
    assert [(r[0], r[2], r[3]) for r in rows] == [("2023-01-02", "010", "one.tab"), ("2023-01-03", "020", "two.zip"), ("2023-01-04", "", "two.zip")]


def test_feed_files_and_case_tables(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "x.tab").write_text("id\tv\n1\ta\n1\ta\n")
    got = readers.read_feed_files(spark, str(tmp_path / "f"), schemas.text_schema("id", "v"))
    assert [tuple(r) for r in got.collect()] == [("1", "a", "x.tab")]
    writers.export_cases({"one": spark.range(2), "two": spark.range(3)}, str(tmp_path / "c"))
    assert [r.case_name for r in readers.read_cases(spark, str(tmp_path / "c")).collect()] == ["one", "two"]
    assert readers.read_cases(spark, str(tmp_path / "c"), "two").count() == 3


def test_zipped_rows_of_any_width_quotes_members_and_exclusion(spark, tmp_path):
    for folder in ("in", "all_tabs"):
        (tmp_path / folder).mkdir()
        with zipfile.ZipFile(tmp_path / folder / "x.tab.zip", "w") as z:
            z.writestr("one.tab", 'id\tv\n1\t"plain ""q"" x"\textra\n2\n\n3\tNA\n')
            z.writestr("two.tab", 'v\tid\nw\t4\n"open\t5\n')
    with zipfile.ZipFile(tmp_path / "in" / "foreign.zip", "w") as z:
        z.writestr("a.bin", "x")
    schema = schemas.text_schema("id", "v")
    got = readers.read_feed_files(spark, str(tmp_path), schema, exclude_directory="all_tabs", file_column=None)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("1", 'plain "q" x'), ("2", None), ("3", None), ("4", "w"), (None, "open\t5")], key=str)
    first = readers.read_zipped(spark, str(tmp_path), schema, recursive=True, pattern="*.tab.zip", members="first", exclude_directory="all_tabs")
    assert first.count() == 3


def test_members_are_tasks_and_quotes_hold_line_breaks(spark, tmp_path):
    """An archive of several members is read by several tasks, its end alone while planning, and fields keep their line breaks."""
    with zipfile.ZipFile(tmp_path / "x.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for k in range(5):
            z.writestr(f"d/m{k}.tab", "id\tv\r\n" + "".join(f'{k}-{i}\t"two\nlines ""{i}"""\r\n' for i in range(300)))
    (tmp_path / "empty.zip").write_bytes(b"PK\x05\x06" + b"\0" * 18)
    schema = schemas.text_schema("id", "v")
    got = readers.read_zipped(spark, f"file://{tmp_path}", schema)
    assert got.rdd.getNumPartitions() == 5
    assert {(r.id, r.v) for r in got.collect()} == {(f"{k}-{i}", f'two\nlines "{i}"') for k in range(5) for i in range(300)}
    assert readers.read_zipped(spark, str(tmp_path), schema, multiline=False).count() == 5 * 600
    assert readers.read_zipped(spark, str(tmp_path), schema, pattern="empty*").count() == 0
    (tmp_path / "x.tab").write_text('id\tv\n1\t"a\nb"\n')
    assert [tuple(r) for r in readers.read_delimited(spark, str(tmp_path / "x.tab"), schema, multiline=True).collect()] == [("1", "a\nb")]


def test_headerless_zip_is_named_and_cut(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("b.csv", "1\t20230101\tx\textra\n2\t20230501\ty\textra\n")
    got = readers.read_zipped(spark, str(tmp_path), schemas.text_schema("id", "SQLDATE", "name"), header=False)
    assert [tuple(r) for r in facts.number_range(got, "SQLDATE", 20230101, 20230430).collect()] == [("1", "20230101", "x")]


def test_missing_table_is_empty_and_columns_resolve(spark, tmp_path):
    assert readers.read_or_empty(spark, str(tmp_path / "none"), schemas.EDGE_SCHEMA).count() == 0
    df = spark.createDataFrame([("a", "b", "1", "2023-01")], "subject_id string, object_id string, relation_code string, month string")
    assert set(columns.standard_edges(df).columns) >= {"subject_org_id", "object_org_id", "relation_type", "event_month"}
    with pytest.raises(ValueError, match="columns"):
        columns.resolve(df, ("nothing",))
    with pytest.raises(ValueError, match="lacks"):
        columns.standard_edges(df.drop("month"))


def test_interval_file_round_trip_and_quarantine(spark, tmp_path):
    table = spark.createDataFrame([("s", "3", "o", "20230101", "20230131"), ("s", "04", "o", "20230501", "20230131"), ("s", "05", "o", "bad", "20230131")], schemas.INTERVAL_TEXT_SCHEMA)
    writers.export_intervals(table, str(tmp_path / "i"))
    good, bad = readers.read_intervals(spark, str(tmp_path / "i"))
    assert sorted((r.relation_type, r.start_time, r.end_time) for r in good.collect()) == [("03", "2023-01", "2023-01"), ("04", "2023-01", "2023-05")]
    assert [r.relation_type for r in bad.collect()] == ["05"]


def test_timeline_and_candidate_sinks(spark, tmp_path):
    edges_after = sample_after(spark)
    month = views.timeline(views.links(edges_after), 5)
    writers.export_timeline(month, str(tmp_path / "t"))
    back = readers.read_timeline(spark, str(tmp_path / "t"))
    assert readers.timeline_links(back).count() == month.select(F.sum(F.size("links"))).first()[0]
    with pytest.raises(ValueError):
        views.timeline(views.links(edges_after), 0)
    empty = spark.createDataFrame([], schemas.RESPONSE_ITEM)
    writers.export_candidates(empty, str(tmp_path / "j"), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).columns == empty.columns


def sample_after(spark):
    rows = [("e1", "A", "B", "2023-01", "06", "a", "b", 3, "ICEWS", 3, 0, 0.7), ("e2", "A", "B", "2023-01", "17", "a", "b", 3, "GDELT", 0, 3, 0.5),
            ("e3", "A", "B", "2023-02", "06", "a", "b", 1, "GDELT;ICEWS", 1, 1, 0.9)]
    return spark.createDataFrame(rows, "edge_id string, subject_org_id string, object_org_id string, event_month string, relation_type string, subject_name string, object_name string, event_count long, source_datasets string, icews_event_count long, gdelt_event_count long, confidence double")


def test_upsert_sends_every_row_once(spark, tmp_path):
    folder = str(tmp_path)

    def send(batch):
        import uuid
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(r["edge_id"] for r in batch))

    writers.upsert_each_batch(sample_after(spark), send, batch_size=2)
    assert sorted(x for p in tmp_path.iterdir() for x in p.read_text().split("\n")) == ["e1", "e2", "e3"]


def test_an_append_counts_once(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([("2023-01", 1), ("2023-02", 2)], "event_month string, n int")
    path = str(tmp_path / "t")
    assert tables.read_appended(spark, path, df.schema).count() == 0
    assert tables.append_once(df, path, "a/b?") and not tables.append_once(df, path, "a/b?")

    def dies(*_):
        raise OSError("gone")

    real = tables.put_new
    monkeypatch.setattr(tables, "put_new", dies)
    with pytest.raises(OSError, match="gone"):
        tables.append_once(df, path, "c")
    monkeypatch.setattr(tables, "put_new", lambda *_: False)  # another writer of the same append was faster
    assert not tables.append_once(df, path, "d")
    monkeypatch.setattr(tables, "put_new", real)
    assert tables.read_appended(spark, path, df.schema).count() == 2 and tables.sweep_appends(spark, path) == 1
    assert tables.append_once(df, path, "c") and sorted(tuple(r) for r in tables.read_appended(spark, path, df.schema).select("event_month", "n").collect()) == [("2023-01", 1)] * 2 + [("2023-02", 2)] * 2
    assert set(tables.appends(spark, path)) == {"a/b?", "c"}


def test_upsert_rewrites_only_what_changes(spark, tmp_path):
    schema = "k string, v string, seq int"
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    table = tables.KeyedTable(spark, str(tmp_path / "t"), spark.createDataFrame([], schema).schema, ["k"], "seq", buckets=16, keep=2)
    assert table.read().count() == 0
    table.upsert(rows(*[(f"k{i}", "old", 1) for i in range(60)], ("k0", "older", 0), (None, "blank", None)))
    before = table.version()
    changed = table.upsert(rows(("k1", "new", 2), ("k2", "late", 0), ("k3", "old", 1), ("new", "row", None)))
    after = table.version()
    assert 1 <= len(changed) <= 2 and {b for b in after["buckets"] if after["buckets"][b] != before["buckets"].get(b)} == {str(b) for b in changed}
    assert table.upsert(rows(("k1", "new", 2))) == set() and table.version() == after
    got = {r.k: (r.v, r.seq) for r in table.read().collect()}
    assert got == {f"k{i}": ("new", 2) if i == 1 else ("old", 1) for i in range(60)} | {"new": ("row", None), None: ("blank", None)}
    assert {r.v for r in table.read(before["number"]).where("k = 'k1'").collect()} == {"old"}
    for n in range(3):
        table.upsert(rows(("k1", f"n{n}", 3 + n)))
    assert len(files.names_in(spark, f"{table.path}/versions")) == 2 and table.read().count() == 62


# ---- responses ------------------------------------------------------------------

ITEM = '{"constraint_name": "n", "relation_a": "08", "relation_b": "17", "scope": "same_subject_object", "forbidden_temporal_relation": "overlap", "hard_or_soft": "soft", "expected_action": "hide", "reason": "r"}'


def test_response_forms(spark):
    texts = {
        "plain": f"[{ITEM}, {ITEM}]", "fenced": f"Here:\n```json\n[{ITEM}]\n```\nDone.", "wrapped": f'{{"constraints": [{ITEM}]}}',
        "comma": f"[{ITEM},]", "prose": f"I think [{ITEM}] fits.", "loose": f"First {ITEM} and then {ITEM} too",
        "single": "[{'relation_a': '08', 'relation_b': '17'}]", "empty": "", "none": "no proposals",
        "single_wrapper": "{'rules': [{'relation_a': '08', 'relation_b': '17'}, {'relation_a': '08', 'relation_b': '17'}]}",
        "brackets_around": f'As [1] and {{x}} say: {{"rules": [{ITEM}, {ITEM}]}}, see [2] and {{y}}.',
        "nested": "first {'relation_a': '08', 'relation_b': '17', 'note': {'why': None}}, then {'other': 1}",
        "fenced_single": "```\n[{'relation_a': '08', 'relation_b': '17', 'exception': None},]\n```",
    }
    df = spark.createDataFrame(list(texts.items()), "response_id string, response_text string")
    got = {r.response_id: r.n for r in candidates.extract_proposals(df).where("relation_a = '08' and relation_b = '17'").groupBy("response_id").agg(F.count("*").alias("n")).collect()}
    assert got == {"plain": 2, "fenced": 1, "wrapped": 1, "comma": 1, "prose": 1, "loose": 2, "single": 1, "single_wrapper": 2, "brackets_around": 2, "nested": 1, "fenced_single": 1}


def test_every_gate_and_first_wins(spark):
    base = dict(constraint_name="", relation_a="06", relation_b="17", scope="same_subject_object", forbidden_temporal_relation="overlap", hard_or_soft="soft", expected_action="hide", exception="", reason="")
    cases = [
        ({}, None), ({"relation_a": "17", "relation_b": "6"}, "duplicate"), ({"relation_a": ""}, "blank_relation"), ({"relation_b": "06"}, "same_relation"),
        ({"relation_a": "any"}, "wildcard"), ({"relation_b": "18"}, "unknown_relation"), ({"relation_a": "07"}, "outside_pool"), ({"relation_a": "16"}, "implausible_pair"),
        ({"scope": ""}, "scope"), ({"forbidden_temporal_relation": "before"}, "forbidden_relation"), ({"reason": "因为不能同时与多个客体"}, "meaningless_reason"),
        ({"hard_or_soft": "hard"}, "hard_without_exception"), ({"forbidden_temporal_relation": "same_month", "hard_or_soft": "hard", "exception": "x"}, None),
    ]
    rows = [("r", i, *[{**base, **c}[k] for k in base]) for i, (c, _) in enumerate(cases)]
    proposals = spark.createDataFrame(rows, "response_id string, position int, " + ", ".join(f"{k} string" for k in base)).withColumns({
        "allowed_temporal_relations": F.lit(None).cast("array<string>"), "typical_positive_example": F.lit(""), "typical_negative_example": F.lit("")})
    inventory = spark.createDataFrame([(c, 50) for c in ("06", "07", "16", "17", "03")], "relation_type string, interval_count int")
    pool = spark.createDataFrame([("06", "17"), ("16", "17")], "relation_a string, relation_b string")
    reviewed = candidates.review_proposals(proposals, inventory, pool)
    assert [r.rejected for r in reviewed.orderBy("position").collect()] == [c[1] for c in cases]
    kept = candidates.accept_proposals(reviewed).collect()
    assert [(r.constraint_id, r.expected_action) for r in kept] == [("LLM_MUTEX_0001", "mark_mixed_or_downgrade"), ("LLM_MUTEX_0002", "mark_mixed_or_downgrade")]
    opened = candidates.review_proposals(proposals, inventory, pool.where("false"))
    assert opened.where("position = 6").first().rejected is None


def test_rule_counts(spark):
    levels = {r.candidate_level: r["count"] for r in dimension.pair_rules(spark).groupBy("candidate_level").count().collect()}
    assert levels == {"blocked": 139, "strong_candidate": 15, "weak_candidate": 36}


# ---- pairs against brute force --------------------------------------------------

def brute_kind(a, b):
    if a[1] < b[0]:
        return "meet" if a[1] + 1 == b[0] else "before"
    if b[1] < a[0]:
        return "meet" if b[1] + 1 == a[0] else "after"
    if a == b:
        return "equal"
    if a[0] <= b[0] and a[1] >= b[1]:
        return "contains"
    return "during" if a[0] >= b[0] and a[1] <= b[1] else "overlap"


def test_pair_counts_match_brute_force_with_long_and_repeated_intervals(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(400):
        start = rng.randrange(1, 24)
        rows.append((rng.choice("ST"), rng.choice("OP"), rng.choice(["03", "06", "17", "20"]), start, start + rng.choice([0, 0, 1, 4])))
    rows += rows[:20]
    df = spark.createDataFrame(rows, "subject_org_id string, object_org_id string, relation_type string, start_no int, end_no int")
    want = {}
    for i, x in enumerate(rows):
        for y in rows[i + 1:]:
            if x[:2] == y[:2] and x[2] != y[2]:
                a, b = (x, y) if x[2] < y[2] else (y, x)
                key = (*a[:2], a[2], b[2])
                want.setdefault(key, dict.fromkeys(pairs.RELATION_KINDS, 0))[brute_kind(a[3:], b[3:])] += 1
    got = {(r.subject_org_id, r.object_org_id, r.relation_a, r.relation_b): {k: r[f"{k}_count"] for k in pairs.RELATION_KINDS} for r in pairs.pair_counts(df).collect()}
    assert got == want and all(sum(v[k] for v in want.values()) for k in pairs.RELATION_KINDS)


def test_damaged_intervals_cost_little(spark):
    """Intervals from year 1 to 9999 among others: counts as by brute force, a few nodes for each, no month of theirs as a row."""
    rng = random.Random(5)
    months = lambda: sorted((rng.randrange(12, 120000), rng.randrange(12, 120000)))
    rows = [("s", rng.choice("OP"), rng.choice(["03", "06", "17"]), *rng.choice([(12, 119999), months(), (500, 500), (500 + rng.randrange(40), 560)])) for _ in range(60)]
    df = spark.createDataFrame(rows, "subject_org_id string, object_org_id string, relation_type string, start_no int, end_no int")
    want = {}
    for i, x in enumerate(rows):
        for y in rows[i + 1:]:
            if x[:2] == y[:2] and x[2] != y[2]:
                a, b = (x, y) if x[2] < y[2] else (y, x)
                want.setdefault((*a[:2], a[2], b[2]), dict.fromkeys(pairs.RELATION_KINDS, 0))[brute_kind(a[3:], b[3:])] += 1
    got = {(r.subject_org_id, r.object_org_id, r.relation_a, r.relation_b): {k: r[f"{k}_count"] for k in pairs.RELATION_KINDS} for r in pairs.pair_counts(df).collect()}
    assert got == want
    noded = df.withColumn("nodes", temporal.dyadic_nodes("start_no", "end_no"))
    assert noded.agg(F.max(F.size("nodes"))).first()[0] <= 2 * 17
    one = noded.select("start_no", "end_no", temporal.node_levels("nodes").alias("levels"), F.explode("nodes").alias("node")).where("start_no = end_no")
    assert one.where("levels <> 1 or node <> start_no").isEmpty() and not one.isEmpty()


def test_dyadic_nodes_cover_each_month_once(spark):
    df = spark.range(40).select(F.col("id").alias("s")).crossJoin(spark.range(40).select(F.col("id").alias("e"))).where("s <= e").crossJoin(spark.range(42).select(F.col("id").alias("m")))
    nodes = temporal.dyadic_nodes("s", "e")
    met = F.size(F.array_intersect(nodes, temporal.dyadic_ancestors("m", temporal.node_levels(nodes))))
    assert df.where(met != F.col("m").between(F.col("s"), F.col("e")).cast("int")).isEmpty()


def test_merge_is_idempotent(spark):
    rows = [("s", "03", "o", m, m) for m in (1, 2, 3, 7, 8, 12)] + [("s", "03", "o", 2, 5)]
    df = spark.createDataFrame(rows, "subject_org_id string, relation_type string, object_org_id string, start_no int, end_no int")
    once = intervals.merge_intervals(df)
    assert sorted((r.start_no, r.end_no) for r in once.collect()) == [(1, 5), (7, 8), (12, 12)]
    assert sorted((r.start_no, r.end_no) for r in intervals.merge_intervals(once).collect()) == [(1, 5), (7, 8), (12, 12)]


def test_mirrored_candidate_and_zero_support(spark):
    iv = spark.createDataFrame([("s", "o", "06", 1, 5), ("s", "o", "17", 2, 3), ("s", "o", "17", 9, 9)], "subject_org_id string, object_org_id string, relation_type string, start_no int, end_no int")
    cands = spark.createDataFrame([("C1", "17", "06"), ("C2", "07", "18")], "constraint_id string, relation_a string, relation_b string")
    got = {r.constraint_id: r for r in constraints.score_constraints(iv, cands).collect()}
    assert (got["C1"].during_count, got["C1"].after_count, got["C1"].structural_confidence) == (1, 1, 0.5)
    assert (got["C2"].comparable_count, got["C2"].structural_confidence, got["C2"].auto_filter_status) == (0, 0.0, "weak")
    first = constraints.trigger_instances(iv, cands, limit=1).collect()
    assert [(r.constraint_id, r.relation_a, r.interval_relation) for r in first] == [("C1", "17", "during")]


# ---- update ---------------------------------------------------------------------

def test_update_hides_downgrades_and_protects(spark):
    rows = [
        ("e1", "A", "B", "2023-01", "06", 3, "GDELT", 0, 3, 0.5), ("e2", "A", "B", "2023-01", "17", 9, "GDELT;ICEWS", 4, 5, 1.0),
        ("e3", "A", "B", "2023-01", "18", 3, "GDELT", 0, 3, 0.6), ("e4", "A", "C", "2023-01", "06", 3, "GDELT", 0, 3, 0.5),
    ]
    e = spark.createDataFrame(rows, "edge_id string, subject_org_id string, object_org_id string, event_month string, relation_type string, event_count long, source_datasets string, icews_event_count long, gdelt_event_count long, confidence double")
    final = spark.createDataFrame([
        ("C1", "06_17_overlap", "n", "06", "17", "enabled_for_update", "hide", "r1"), ("C2", "06_18_overlap", "n", "06", "18", "enabled_for_update", "downgrade", "r2"),
        ("C3", "06_20_overlap", "n", "06", "20", "enabled_for_update", "hide", "r3")],
        "constraint_id string, constraint_key string, constraint_name string, relation_a string, relation_b string, final_status string, proposed_action string, proposed_reason string").withColumns({
            "use_for_review": F.lit(True), "structural_confidence": F.lit(0.9), "source_weighted_confidence": F.lit(0.9), "violation_rate": F.lit(0.1),
            "auto_filter_status": F.lit("pass"), "candidate_level": F.lit("strong_candidate")})
    entries = update.edge_entries(e, final)
    found = {r.constraint_id: r for r in update.conflicts(update.edge_sides(entries)).collect()}
    assert {k: r.conflict_action for k, r in found.items()} == {"C1": "hide_low_evidence", "C2": "downgrade"}
    after = {r.edge_id: r for r in update.legacy_edges(update.updated_edges(entries)).collect()}
    assert (after["e1"].update_action, after["e1"].final_confidence, after["e1"].status) == ("hide_low_evidence", 0.25, "hidden")
    assert after["e1"].triggered_constraint_ids == "C1;C2" and after["e1"].update_reason == "r1;r2"
    assert (after["e2"].update_action, after["e2"].final_confidence) == ("mark_mixed", 1.0)
    assert (after["e3"].update_action, after["e3"].final_confidence) == ("downgrade", 0.48)
    assert (after["e4"].update_action, after["e4"].is_mutex_triggered) == ("keep", False)
    log = update.decisions(entries)
    assert log.count() == 2 * len(found)
    assert [r.final_confidence for r in log.where("edge_id = 'e1'").orderBy("constraint_id").collect()] == [0.25, 0.25]
    hidden = samples.hidden_sample(update.legacy_edges(update.updated_edges(entries)))
    assert [r.edge_id for r in hidden.collect()] == ["e1"]


def test_manual_review_precedence(spark):
    scored = spark.createDataFrame([("C1", "k1", "pass"), ("C2", "k2", "weak"), ("C3", "k3", "review"), ("C4", "k4", "pass")], "constraint_id string, constraint_key string, auto_filter_status string").withColumns({
        "candidate_level": F.lit(""), "proposed_action": F.lit(""), "structural_confidence": F.lit(0.9), "source_weighted_confidence": F.lit(0.9), "violation_rate": F.lit(0.1), "comparable_count": F.lit(50)})
    manual = spark.createDataFrame([("C1", "k9", "drop", 1), ("", "k1", "pass", 2), ("", "k2", "enable", 1), ("", "k2", "mark_mixed", 2), ("C3", "", " ", 1), (None, "k4", "odd_word", 1)], "constraint_id string, constraint_key string, decision string, review_seq int")
    got = {r.constraint_id: r.final_status for r in constraints.final_constraints(scored, manual).collect()}
    assert got == {"C1": "disabled", "C2": "enabled_for_mark_mixed", "C3": "review_only", "C4": "odd_word"}


# ---- ids, lookups, reduction ----------------------------------------------------

def test_dense_ids_follow_the_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    got = ids.dense_ids(df, ["v"], "n", "N_%04d", partitions=7).collect()
    assert sorted((r.v, r.n) for r in got) == [(i, f"N_{i + 1:04d}") for i in range(1000)]


def test_hot_names_are_found_and_looked_up_apart(spark):
    events = spark.range(500).select(F.when(F.col("id") % 3 == 0, "HOT").when(F.col("id") % 3 == 1, "LOST").otherwise(F.concat(F.lit("N"), F.col("id") % 50)).alias("k"), "id")
    events = events.unionByName(spark.createDataFrame([(None, 1000)], "k string, id bigint"))
    table = spark.createDataFrame([("HOT", "o1", "h")] + [(f"N{i}", f"o{i}", "c") for i in range(40)], "name_key string, org_id string, canonical_name string")
    hot = hot_names(events, "k")["k"]
    assert sorted(hot) == ["HOT", "LOST"] and hot_names(events.limit(0), "k") == {"k": []}
    for how in ("left", "inner"):
        plain, apart = look_up(events, table, "k", "x", how), look_up(events, table, "k", "x", how, hot)
        assert plain.count() > 100 and plain.exceptAll(apart).isEmpty() and apart.exceptAll(plain).isEmpty()


def test_a_hot_name_burdens_no_task(spark, tmp_path):
    """One name on 30 % of the rows: no task of the facts has over twice the median."""
    rows = spark.range(40000).select(
        F.when(F.col("id") % 10 < 3, "Hot").otherwise(F.concat(F.lit("Name "), F.col("id") % 997)).alias("Source Name"), F.concat(F.lit("Name "), F.col("id") % 991).alias("Target Name"),
        F.lit("2023-01-05").alias("Event Date"), F.lit("030").alias("CAMEO Code"))
    rows.repartition(4).write.parquet(str(tmp_path / "feed"))
    names = spark.range(997).select(F.concat(F.lit("o"), "id").alias("org_id"), F.concat(F.lit("Name "), "id").alias("canonical_name"))
    orgs = names.unionByName(spark.createDataFrame([("hot", "Hot")], "org_id string, canonical_name string"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sizes = {}
        for spread in (True, False):
            got = facts.event_facts(spark.read.parquet(str(tmp_path / "feed")), feed_a_dictionary(orgs), spread)
            sizes[spread] = sorted(r["count"] for r in got.groupBy(F.spark_partition_id().alias("task")).count().collect())
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert sum(sizes[True]) == sum(sizes[False]) == 40000
    assert sizes[True][-1] <= 2 * sizes[True][len(sizes[True]) // 2], sizes


def test_dictionary_last_writer_and_blank_names(spark):
    orgs = spark.createDataFrame([("ORG_1", "Police (A)"), ("ORG_2", "Police (B)"), ("ORG_3", "()")], "org_id string, canonical_name string")
    aliases = spark.createDataFrame([("ORG_1", "police", "POLICE")], "org_id string, alias string, alias_clean string")
    assert {r.name_key: r.org_id for r in feed_a_dictionary(orgs).collect()} == {"POLICE": "ORG_2"}
    assert {r.name_key: r.org_id for r in feed_a_dictionary(orgs, aliases).collect()} == {"POLICE": "ORG_1"}
    assert {r.name_key for r in feed_b_dictionary(orgs).collect()} == {"POLICE (A)", "POLICE (B)", "()"}


def test_reduction_counts_and_missing_columns(spark, tmp_path):
    rows = [("20230101", "Bank of X", "Ministry of Y"), ("20230101", "Bob", "Ministry"), ("20230101", "", "Ministry"), ("20230101", "People", "Police")]
    df = spark.createDataFrame(rows, "SQLDATE string, Actor1Name string, Actor2Name string")
    assert reduction.counted_write(df, str(tmp_path / "r")) == {"raw_rows": 4, "written_rows": 1}
    assert reduction.reduce_events(df, "any_org").count() == 3


# ---- merge table ----------------------------------------------------------------

def test_merge_table_stays_small_and_whole(spark, tmp_path):
    """Thirty batches of two streams: sums, a logarithm of runs, old versions still read, replays and empty batches change nothing."""
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("n", T.LongType())])
    table = runs.MergeTable(spark, str(tmp_path / "t"), schema, lambda rows: rows.groupBy("k").agg(F.sum("n").alias("n")), fanout=3, keep=4)
    assert table.read().count() == 0
    want = {}
    for batch in range(15):
        for stream in ("a", "b"):
            rows = [(f"k{batch % 4}", 1), ("all", batch)] if batch != 7 else []
            assert table.add(spark.createDataFrame(rows, schema), stream, batch)
            for k, n in rows:
                want[k] = want.get(k, 0) + n
        version = table.version()
        assert not table.add(spark.createDataFrame([("all", 1000)], schema), "a", batch) and not table.add(spark.createDataFrame([("x", 1)], schema), "b", 0)
        assert table.version() == version and len(version["runs"]) <= 2 * 4
    folded = lambda rows: {r.k: r.n for r in table.merge(rows).collect()}
    assert folded(table.read()) == want
    older = table.version()["number"] - 2  # before the last batch of both streams
    assert folded(table.read(older)) == {k: n - (2 if k == "k2" else 28 if k == "all" else 0) for k, n in want.items()}
    assert len(files.names_in(spark, f"{table.path}/versions")) == 4
    named = {r["folder"] for v in range(4) for r in table.version(table.version()["number"] - v)["runs"]}
    assert set(files.names_in(spark, f"{table.path}/runs")) == named and table.sweep() == 0


def test_merge_table_survives_a_lost_commit(spark, tmp_path, monkeypatch):
    """A writer that is overtaken goes on from the newer version; one that dies before its commit leaves nothing to see."""
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("n", T.LongType())])
    table = runs.MergeTable(spark, str(tmp_path / "t"), schema, lambda rows: rows.groupBy("k").agg(F.sum("n").alias("n")), fanout=2)
    row = spark.createDataFrame([("x", 1)], schema)
    table.add(row, "a", 0)
    real, calls = runs.put_new, []

    def overtaken(session, path, text):
        calls.append(path)
        if len(calls) == 1:
            monkeypatch.setattr(runs, "put_new", real)
            table.add(row, "b", 0)
            monkeypatch.setattr(runs, "put_new", overtaken)
        return real(session, path, text)

    monkeypatch.setattr(runs, "put_new", overtaken)
    assert table.add(row, "a", 1) and len(calls) == 2

    def dies(*_):
        raise OSError("gone")

    monkeypatch.setattr(runs, "put_new", dies)
    with pytest.raises(OSError, match="gone"):
        table.add(row, "a", 2)
    monkeypatch.setattr(runs, "put_new", real)
    assert table.read().agg(F.sum("n")).first()[0] == 3 and table.sweep() >= 1
    assert table.add(row, "a", 2) and table.read().agg(F.sum("n")).first()[0] == 4
    assert not files.put_new(spark, f"{table.path}/versions/{1:012d}", "{}")


# ---- stream = batch -------------------------------------------------------------

def test_stream_replay_equals_batch_with_a_late_file(spark, tmp_path):
    source, parts, state = (str(tmp_path / n) for n in ("in", "partials", "state"))
    feed = testfeed.feed_b(spark, SMALL, fold=True).drop("event_seq")
    b = feed_b_dictionary(testfeed.organizations(spark, SMALL))
    seed = facts.seed_edges(testfeed.feed_a(spark, SMALL, fold=True), feed_a_dictionary(testfeed.organizations(spark, SMALL), testfeed.aliases(spark, SMALL)))
    for months in ("SQLDATE < '19960201'", "SQLDATE >= '19960301'", "SQLDATE between '19960201' and '19960231'"):
        feed.where(months).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(feed.schema).parquet(source)
        fuse.fuse_stream(stream, b, parts, state, fanout=2).awaitTermination()
    classified = edges.classified_events(feed, b)
    batch, streamed = edges.fused_edges(seed, classified), fuse.stream_edges(spark, parts, seed)
    assert batch.count() > 100 and batch.exceptAll(streamed).isEmpty() and streamed.exceptAll(batch).isEmpty()
    before = fuse.partial_table(spark, parts).version()
    assert not fuse.partial_table(spark, parts).add(classified, state, 1) and fuse.partial_table(spark, parts).version() == before
    log, slog = edges.daily_log(seed, classified), fuse.stream_log(spark, parts, seed)
    assert log.exceptAll(slog).isEmpty() and slog.exceptAll(log).isEmpty()
    assert [r["batches"] for r in before["runs"]] == [2, 1]  # the first two batches were merged on the way


def test_first_keys_of_a_stream(spark, tmp_path):
    """Late rows lower the first day, the state has a row for each key, batches open what the keys before them lack."""
    source, out, state = (str(tmp_path / n) for n in ("in", "keys", "state"))
    feed = testfeed.feed_b(spark, SMALL, fold=True).drop("event_seq")
    b = feed_b_dictionary(testfeed.organizations(spark, SMALL))
    seed = facts.seed_edges(testfeed.feed_a(spark, SMALL, fold=True), feed_a_dictionary(testfeed.organizations(spark, SMALL), testfeed.aliases(spark, SMALL)))
    parts = [feed.where(F.pmod(F.xxhash64("SQLDATE", "EventCode"), F.lit(3)) == k) for k in range(3)]
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(source)
        query = fuse.first_keys_stream(spark.readStream.schema(feed.schema).parquet(source), b, out, state)
        query.awaitTermination()
    rows = edges.classified_events(feed, b).where("reason = 'mapped'")
    want = {tuple(r)[:4]: (r.first_day, r.events) for r in rows.groupBy(*KEY).agg(F.min("day").alias("first_day"), F.sum("n").alias("events")).collect()}
    opened = {tuple(r)[:4]: (r.first_day, r.events) for r in fuse.new_keys(spark, out, seed.limit(0)).collect()}
    assert opened == want and query.lastProgress.stateOperators[0].numRowsTotal == len(want)
    known, batches = set(), {}
    for k, part in enumerate(parts):
        own = {tuple(r) for r in edges.classified_events(part, b).where("reason = 'mapped'").select(*KEY).collect()}
        batches[k], known = len(own - known), known | own
    log = fuse.batch_log(spark, out, seed.limit(0)).groupBy("first_batch").agg(F.sum("new_edges").alias("n"))
    assert {r.first_batch: r.n for r in log.collect()} == {k: n for k, n in batches.items() if n}
    daily = edges.daily_log(seed, edges.classified_events(feed, b)).where("new_edges > 0").select("date", "new_edges")
    opened_by_day = fuse.batch_log(spark, out, seed).groupBy("date").agg(F.sum("new_edges").alias("new_edges"))
    assert daily.exceptAll(opened_by_day).isEmpty() and opened_by_day.exceptAll(daily).isEmpty()
    assert fuse.new_keys(spark, out, seed).count() == len(set(want) - {tuple(r) for r in seed.select(*KEY).collect()})
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != fuse.ROCKSDB


def test_sql_functions_register(spark):
    assert len(register_sql_functions(spark)) == 13
    row = spark.sql("select relation_compact('73') a, relation_padded('51') b, lookup_name('The Police (X)') c, month_interval_relation(1, 5, 2, 3) d").first()
    assert tuple(row) == ("07", "05", "POLICE", "contains")


def test_windowed_counts_run_as_a_stream(spark, tmp_path):
    rows = [("20230101", "a"), ("20230101", "b"), ("20230105", "a"), ("bad", "a"), ("20230110", "c")]
    df = spark.createDataFrame(rows, "SQLDATE string, k string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = fuse.windowed_counts(stream)
    query = out.writeStream.format("memory").queryName("daily_counts").outputMode("append").option(
        "checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.date, r.processed_events) for r in spark.table("daily_counts").collect()} == {("2023-01-01", 2), ("2023-01-05", 1)}


def test_responses_are_read_whole(spark, tmp_path):
    (tmp_path / "r.txt").write_text("line one\nline two\n")
    assert [tuple(r) for r in readers.read_responses(spark, str(tmp_path)).collect()] == [("r.txt", "line one\nline two\n")]


# ---- work once for all events ---------------------------------------------------

def test_names_and_dates_are_not_tested_for_every_event(spark):
    """What follows the counting reads a stage table, so no filter moves below it; actors are read from one as well."""
    from edgeloom.operators import actors
    from edgeloom.plans.build import Graph

    g = Graph(testfeed.feed_a(spark, SMALL), testfeed.feed_b(spark, SMALL), testfeed.organizations(spark, SMALL))
    for df in (g.seed, g.classified, g.classified_months):
        assert not any("lineitem" in f for f in df.inputFiles())
    assert g.classified_months.count() < g.classified.count()
    by_day = g.classified.groupBy("reason").agg(F.sum("n").alias("n"))
    assert by_day.exceptAll(g.classified_months.groupBy("reason").agg(F.sum("n").alias("n"))).isEmpty()
    found = actors.actors(actors.feed_a_hits(g.feed_a), actors.feed_b_hits(testfeed.feed_b(spark, SMALL, parties=True)))
    assert not any("lineitem" in f for f in actors.organization_actors(found).inputFiles())


def test_partial_counts_hold_a_row_for_each_key_and_for_each_day(spark):
    classified = edges.classified_events(testfeed.feed_b(spark, SMALL, fold=True), feed_b_dictionary(testfeed.organizations(spark, SMALL)))
    once = fuse._summed(fuse.partials(classified)).cache()
    keys, days = once.where("relation_type is not null"), once.where("relation_type is null")
    mapped = classified.where("reason = 'mapped'")
    want = mapped.groupBy(*KEY).agg(F.min("day").alias("day"), F.sum("n").alias("n"))
    assert keys.select(*KEY, "day", "n").exceptAll(want).isEmpty() and keys.count() == want.count() < mapped.count()
    assert days.select("day", "reason", "n").exceptAll(classified.groupBy("day", "reason").agg(F.sum("n").alias("n"))).isEmpty()
    assert fuse._summed(once).exceptAll(once).isEmpty()
