"""Scalar rules on hand-made values, one per branch."""

from pyspark.sql import functions as F

from edgeloom.functions import codes, names, parse
from edgeloom.functions.temporal import exclusion_truth, interval_relation
from edgeloom.operators import constraints, scoring, update


def evaluate(spark, values, **columns):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [tuple(r) for r in df.select(*[c("x").alias(n) for n, c in columns.items()]).collect()]


def test_feed_codes(spark):
    values = [None, "", "5", "10", "010", "40", "051", "100", "190", "210", "12.0", "x7", "73", "0"]
    rows = evaluate(spark, values, padded=codes.event_code_padded, a=codes.relation_from_padded, b=codes.relation_from_compact)
    assert rows == [
        ("", "", ""), ("", "", ""), ("005", "", "05"), ("010", "01", "10"), ("010", "01", "01"), ("040", "04", "04"),
        ("051", "05", "05"), ("100", "10", "10"), ("190", "19", "19"), ("210", "", ""), ("012", "01", "12"),
        ("007", "", "07"), ("073", "07", "07"), ("000", "", ""),
    ]


def test_relation_codes(spark):
    values = ["1", "01", "1.0", "01.0", "CAMEO_01", "21", "verbal_cooperation", " 6 ", None]
    rows = evaluate(spark, values, light=codes.relation_light, strict=codes.relation_strict, group=codes.relation_category)
    assert rows == [
        ("01", "01", "verbal_cooperation"), ("01", "01", "verbal_cooperation"), ("01", "01", "verbal_cooperation"),
        ("01", "01", "verbal_cooperation"), ("CAMEO_01", "01", "verbal_cooperation"), ("21", "", ""),
        ("verbal_cooperation", "", ""), ("06", "06", "material_cooperation"), ("", "", ""),
    ]


def test_months(spark):
    values = ["2023-03", "2023-3", "2023-03-01", "202303", "20230301", "2023030", "2023/03/01", "2023.03.01", "20230301.0", "2023-13", "nan", "2023", "0000-01", None]
    march = 2023 * 12 + 2
    rows = evaluate(spark, values, n=parse.month_number, p=parse.month_prefix)
    assert [r[0] for r in rows] == [march] * 9 + [None] * 5
    assert rows[1][1] == "2023-3" and rows[3][1] == "2023-03" and rows[8][1] == "2023-03"
    first, last = parse.month_bounds("x")
    df = spark.createDataFrame([("2024-02",), ("2023-02",), ("2023-2",)], "x string")
    assert [tuple(r) for r in df.select(first, last).collect()] == [("20240201", "20240229"), ("20230201", "20230228"), (None, None)]


def test_numbers_and_flags(spark):
    rows = evaluate(spark, ["12.0", "1e2", "abc", "", None, "inf", "NaN", "-3.7"], i=parse.to_long, d=parse.to_double)
    assert rows == [(12, 12.0), (100, 100.0), (0, 0.0), (0, 0.0), (0, 0.0), (0, 0.0), (0, 0.0), (-3, -3.7)]
    flags = evaluate(spark, ["True", "是", "0", None, "raw"], t=parse.to_flag, d=parse.derived_flag)
    assert flags == [(True, True), (True, True), (False, False), (False, True), (False, False)]
    df = spark.createDataFrame([("a;b", "b"), ("a", "c"), ("", "c"), ("a", "")], "o string, n string")
    assert [r[0] for r in df.select(parse.append_unique("o", "n")).collect()] == ["a;b", "a;c", "c", "a"]


def test_names(spark):
    values = ["Police (Israel)", "[X] {Y}", "The U.S.", "  the  world   bank ", "United Nations", "( )", "Museum of Art"]
    rows = evaluate(spark, values, aligned=names.aligned_name, lookup=names.lookup_name, light=names.light_name)
    assert rows == [
        ("POLICE (ISRAEL)", "POLICE", "POLICE (ISRAEL)"), ("(X) (Y)", "Y", "[X] {Y}"), ("US", "U S", "THE U.S."),
        ("WORLD BANK", "WORLD BANK", "THE WORLD BANK"), ("UN", "UNITED NATIONS", "UNITED NATIONS"), ("", "", "( )"),
        ("MUSEUM OF ART", "MUSEUM OF ART", "MUSEUM OF ART"),
    ]


def test_name_predicates(spark):
    values = ["", "123", "a b c d e f g h i j k l m", "CITIZEN (X)", "police", "GOV", "X", "World Bank", "Museum of Art", "Bank of Japan", "Bank", "Ruritania"]
    rows = evaluate(spark, values, bad=names.is_bad_name, org=names.has_org_name)
    assert [r[0] for r in rows] == [True] * 7 + [False, False, False, True, False]
    # A keyword on its own is no organization; "EU" inside MUSEUM counts, as the rule is by substring.
    assert [r[1] for r in rows] == [False] * 7 + [False, True, True, False, False]


def test_interval_relations(spark):
    rows = [
        (1, 1, 3, 3, "before"), (3, 3, 1, 1, "after"), (1, 1, 2, 2, "meet"), (2, 2, 1, 1, "meet"), (1, 2, 1, 2, "equal"),
        (1, 5, 2, 3, "contains"), (2, 3, 1, 5, "during"), (1, 3, 2, 5, "overlap"), (1, 3, 1, 2, "contains"), (2, 3, 1, 3, "during"),
    ]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int, expected string")
    kinds = df.select(interval_relation("a", "b", "c", "d").alias("k"), "expected")
    assert kinds.where("k <> expected").count() == 0
    truth = {(r.f, r.k): r.t for r in kinds.select("k", F.explode(F.array(F.lit("overlap"), F.lit("before"), F.lit(""))).alias("f"))
             .select("f", "k", exclusion_truth("k", "f").alias("t")).collect()}
    assert truth[("overlap", "equal")] == -1 and truth[("overlap", "meet")] == 1 and truth[("before", "before")] == -1
    assert truth[("before", "after")] == 1 and truth[("before", "overlap")] == 0 and truth[("", "during")] == -1


def test_scores_and_weights(spark):
    rows = [
        ("ICEWS;GDELT", 2, 1, 1, 0.1), ("ICEWS", 1, 1, 0, 0.1), ("ICEWS", 7, 7, 0, 0.1), ("GDELT", 4, 0, 4, 0.1),
        ("GDELT", 1, 0, 1, 0.1), ("GDELT", 2, 0, 2, 0.1), ("", 3, 0, 0, 0.9), ("ICEWS;GDELT", 100, 50, 50, 0.1),
    ]
    df = spark.createDataFrame(
        [(f"e{i}", "s", "o", "2023-01", "03", n, src, a, b, c) for i, (src, n, a, b, c) in enumerate(rows)],
        "edge_id string, subject_org_id string, object_org_id string, event_month string, relation_type string, event_count long, source_datasets string, icews_event_count long, gdelt_event_count long, confidence double")
    got = [(r.confidence, r.confidence_level) for r in scoring.score_edges(df).orderBy("edge_id").collect()]
    assert got == [(1.0, "high"), (0.4693, "low"), (0.75, "high"), (0.5609, "medium"), (0.1693, "low"), (0.3599, "low"), (1.0, "high"), (1.0, "high")]
    scored = scoring.score_edges(df)
    assert [r.w for r in scored.orderBy("edge_id").select(scoring.edge_weight(scored).alias("w")).collect()] == [1.2, 1.0, 1.0, 0.6, 0.6, 0.6, 0.75, 1.2]
    read = scored.withColumns({"num_mentions": F.lit("5"), "num_articles": F.lit("2")})
    assert [r.w for r in read.orderBy("edge_id").select(scoring.edge_weight(read).alias("w")).collect()][3:6] == [0.85, 0.6, 0.6]


def test_auto_status_thresholds(spark):
    rows = [
        ("strong_candidate", "x", 30, 0.85, 0.85, 0.15, "pass", "enabled_for_update"),
        ("strong_candidate", "x", 500, 0.74, 0.735, 0.26, "strong_soft", "enabled_for_mark_mixed"),
        ("weak_candidate", "mark_mixed", 500, 0.72, 0.1, 0.28, "mixed_candidate", "enabled_for_mark_mixed"),
        ("weak_candidate", "mark_mixed", 499, 0.72, 0.1, 0.28, "review", "review_only"),
        ("weak_candidate", "review", 29, 0.7, 0.7, 0.3, "weak_review", "review_only"),
        ("weak_candidate", "review", 9, 0.9, 0.9, 0.1, "weak", "disabled"),
        ("weak_candidate", "review", 30, 0.59, 0.9, 0.41, "weak", "disabled"),
    ]
    df = spark.createDataFrame(rows, "candidate_level string, proposed_action string, instantiation_count long, _confidence double, _weighted double, _violation double, expected string, final string")
    got = df.withColumn("auto_filter_status", constraints.auto_status()).withColumns({
        "structural_confidence": F.col("_confidence"), "source_weighted_confidence": F.col("_weighted"),
        "violation_rate": F.col("_violation"), "comparable_count": F.col("instantiation_count")})
    got = got.withColumn("got", constraints.auto_final_status())
    assert got.where("auto_filter_status <> expected or got <> final").count() == 0


def test_edge_action_branches(spark):
    rows = [
        ("review_only", "hide", True, False, False, "review"), ("enabled_for_mark_mixed", "hide", False, False, True, "mark_mixed"),
        ("other", "hide", True, False, True, "review"), ("enabled_for_update", "hide", False, False, True, "review"),
        ("enabled_for_update", "hide", True, True, True, "mark_mixed"), ("enabled_for_update", "hide", True, False, True, "hide_low_evidence"),
        ("enabled_for_update", "hide", True, False, False, "mark_mixed"), ("enabled_for_update", "downgrade", True, False, False, "downgrade"),
        ("enabled_for_update", "mark_mixed", True, False, True, "mark_mixed"),
        ("enabled_for_update", "mark_mixed_or_downgrade", True, False, True, "downgrade"),
        ("enabled_for_update", "mark_mixed_or_downgrade", True, False, False, "mark_mixed"), ("enabled_for_update", "review", True, False, True, "mark_mixed"),
    ]
    df = spark.createDataFrame(rows, "f string, e string, d boolean, c boolean, l boolean, expected string")
    assert df.where(update.edge_action(*[F.col(x) for x in "fedcl"]) != F.col("expected")).count() == 0


def test_fold_order(spark):
    rows = [
        (["review", "mark_mixed"], "mark_mixed", 1.0), (["downgrade", "downgrade"], "downgrade", 0.64),
        (["downgrade", "hide"], "hide", 0.4), (["hide", "downgrade"], "hide", 0.5), (["mark_mixed", "review"], "mark_mixed", 1.0),
        (["hide_low_evidence", "hide"], "hide", 0.25), ([], "keep", 1.0),
    ]
    df = spark.createDataFrame(rows, "steps array<string>, action string, confidence double").withColumn("start", F.lit(1.0))
    got = df.withColumn("out", update.fold_actions(F.col("steps"), F.col("start")))
    assert got.where("out.action <> action or out.confidence <> confidence or size(out.history) <> size(steps)").count() == 0
