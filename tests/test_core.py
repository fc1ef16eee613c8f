"""Golden cases, window edges, ties, skew, and properties of the core operators."""

import random
from datetime import datetime, timedelta

import pytest
from conftest import values
from pyspark.sql import functions as F

from tideline.functions import numbers, scores
from tideline.functions.clock import age_days, closes_day, instant
from tideline.operators import activity, asof, filters, merge, ranking
from tideline.plans import console, reports, rules, scoring

NOW = "2024-01-20 12:00:00"
ROLE = "role_id bigint, company_id bigint, first_seen_at timestamp_ntz, removed_at timestamp_ntz, role_type string, source string, is_remote_us boolean"


def ts(text):
    return datetime.fromisoformat(text)


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()[0]


# --- time and numbers ------------------------------------------------------------


@pytest.mark.parametrize(
    "at, days",
    [("2024-01-20 12:00:00", 0), ("2024-01-19 12:00:00.000001", 0), ("2024-01-19 12:00:00", 1), ("2024-01-20 12:00:00.000001", -1), ("2024-01-22 12:00:00", -2)],
)
def test_age_is_floored(spark, at, days):
    assert one(spark, age_days(instant(at), instant(NOW))) == days


def test_day_tail_and_rounding(spark):
    assert one(spark, closes_day(instant("2024-01-20 23:59:59.999999"))) == 1
    assert one(spark, closes_day(instant("2024-01-20 23:59:59.999998"))) == 0
    assert [one(spark, numbers.half_up(F.lit(x), 1)) for x in (0.25, 66.92952, 51.82381)] == [0.3, 66.9, 51.8]


# --- rollups (Q1) -----------------------------------------------------------------


EDGE_ROLES = [
    # 30-day window of 20 January: from 22 December 23:59:59.999999.
    (1, 1, "2023-12-22 23:59:59.999999", None), (2, 1, "2023-12-22 23:59:59.999998", None),
    (3, 1, "2024-01-14 23:59:59.999999", None), (4, 1, "2024-01-14 23:59:59.999998", None),
    (5, 1, "2024-01-20 23:59:59.999999", None), (6, 1, "2024-01-21 00:00:00", None),
    (7, 1, "2023-01-01 00:00:00", "2024-01-20 23:59:59.999999"), (8, 1, "2023-01-01 00:00:00", "2024-01-21 00:00:00"),
    (9, 1, "2023-01-01 00:00:00", "2023-12-22 23:59:59.999999"), (10, 1, "2023-01-01 00:00:00", "2023-12-22 23:59:59.999998"),
    # Removed before it was first seen.
    (11, 1, "2024-01-18 00:00:00", "2024-01-10 00:00:00"), (12, 1, "2024-01-25 00:00:00", "2024-01-10 00:00:00"),
]


def edge_roles(spark):
    rows = [(i, c, ts(a), ts(b) if b else None, "backend", "yc_jobs", i % 2 == 0) for i, c, a, b in EDGE_ROLES]
    return spark.createDataFrame(rows, ROLE)


def test_rollup_edges(spark):
    row = asof.role_rollup(edge_roles(spark), "2024-01-20").first()
    # Active: 1-5 and 8.  New in 7 days: 3, 5, 11.  New in 30: 1, 3, 4, 5, 11.  Removed in 30: 7, 9, 11.
    assert (row.active_roles_total, row.new_roles_7d, row.new_roles_30d, row.removed_roles_30d) == (6, 3, 5, 3)
    assert row.active_remote_roles_total == 3


def test_grid_equals_single_dates(spark):
    roles = edge_roles(spark)
    companies = roles.select("company_id").distinct()
    for step in (1, 3):
        grid = asof.Grid("2023-12-20", "2024-01-27", step)
        got = {r.as_of_date: r for r in asof.role_grid(companies, roles, grid).collect()}
        assert sorted(got) == grid.dates
        seen = [(r.first_seen_at, r.removed_at) for r in roles.collect()]
        for d, r in got.items():
            end = datetime(d.year, d.month, d.day, 23, 59, 59, 999999)
            known = [(a, b) for a, b in seen if a <= end]
            assert r.active_roles_total == sum(b is None or b > end for _, b in known), d
            assert r.new_roles_7d == sum(a >= end - timedelta(6) for a, _ in known), d
            assert r.new_roles_30d == sum(a >= end - timedelta(29) for a, _ in known), d
            assert r.removed_roles_30d == sum(b is not None and end - timedelta(29) <= b <= end for _, b in known), d
            assert r.label_new_roles_next_30d == sum(end < a <= end + timedelta(30) for a, _ in seen), d


def test_grid_work_is_dealt_by_rows_and_empty_intervals_make_no_steps(spark, monkeypatch):
    rows = [(1, "2020-01-01 00:00:00", "2020-06-01 00:00:00"), (1, "2020-01-01 00:00:00", None), (2, "2024-01-03 00:00:00", "2024-01-02 00:00:00")]
    roles = spark.createDataFrame(rows, "company_id long, seen string, gone string").selectExpr(
        "company_id", "CAST(seen AS timestamp_ntz) AS first_seen_at", "CAST(gone AS timestamp_ntz) AS removed_at", "false AS is_remote_us"
    )
    grid = asof.Grid("2024-01-01", "2024-01-10", 1)
    steps = values(asof.role_steps(roles, grid, ("active", "new_7d", "removed_30d")), "company_id", "pos", "measure", "step")
    assert steps == [(1, 0, 0, 1), (2, 2, 2, 1), (2, 2, 4, 1), (2, 8, 2, -1)]
    companies = spark.range(1, 101).withColumnRenamed("id", "company_id")
    monkeypatch.setattr(asof, "TASK_ROWS", 50)
    assert asof.role_grid(companies, roles, grid).rdd.getNumPartitions() == 20


def test_grid_rejects_bad_input():
    with pytest.raises(ValueError):
        asof.date_grid("2024-01-02", "2024-01-01", 1)
    with pytest.raises(ValueError):
        asof.date_grid("2024-01-01", "2024-01-02", 0)


# --- scores -------------------------------------------------------------------------


def company_row(spark, **changes):
    base = dict(
        company_id=1, name="Demo", funding_stage="series_b", headcount=45, remote_us=True, role_types=["backend", "distributed"], skills=["go", "python", "kubernetes"],
        last_funding_date=ts("2024-01-15 12:00:00"), last_role_posted=ts("2024-01-18 12:00:00"), oldest_open_days=8, has_founder_post=False, founder_post_date=None,
        spike_date=ts("2024-01-19 12:00:00"), spike_sigma=2.8, has_engineering_blog=True, last_funding_amount=67e6,
    )
    base.update(changes)
    ddl = (
        "company_id int, name string, funding_stage string, headcount int, remote_us boolean, role_types array<string>, skills array<string>,"
        "last_funding_date timestamp_ntz, last_role_posted timestamp_ntz, oldest_open_days int, has_founder_post boolean, founder_post_date timestamp_ntz,"
        "spike_date timestamp_ntz, spike_sigma double, has_engineering_blog boolean, last_funding_amount double"
    )
    return scoring.score_companies(spark.createDataFrame([tuple(base.values())], ddl), NOW).first()


def test_golden_company_score(spark):
    row = company_row(spark)
    assert (row.stack_match, row.domain_match, row.seniority_match, row.culture_proxy) == (18.0, 24.0, 15.0, 20.0)
    assert (row.fit_score, row.urgency_score, row.composite_score, row.urgency_label) == (77.0, 51.8, 66.9, "high")
    assert row.fit_breakdown.matching_skills == ["go", "python", "kubernetes"]


def test_urgency_branches(spark):
    quiet = dict(last_funding_date=None, last_role_posted=None, spike_date=None)
    assert company_row(spark, **quiet, oldest_open_days=19).urgency_score == 0
    assert [company_row(spark, **quiet, oldest_open_days=d).role_aging_points for d in (20, 40, 60, 61)] == [0.0, 7.5, 15.0, 5.0]
    assert company_row(spark, **{**quiet, "last_funding_date": ts("2024-02-20 00:00:00")}, last_funding_amount=1e6).funding_points == 20.0
    assert company_row(spark, **{**quiet, "last_funding_date": ts("2024-01-20 00:00:00")}, last_funding_amount=None).funding_points == 30.0
    # A future role or founder post decays above its base (Q3).
    assert company_row(spark, **{**quiet, "last_role_posted": ts("2024-01-23 12:00:00")}).new_role_points == pytest.approx(22.0)
    assert company_row(spark, **quiet, has_founder_post=True).founder_post_points == 15.0
    assert company_row(spark, **{**quiet, "spike_date": ts("2024-01-20 12:00:00")}, spike_sigma=1.99).github_points == 0.0
    nothing = company_row(spark, **quiet, skills=[], role_types=[], funding_stage=None, headcount=0, remote_us=None, has_engineering_blog=False)
    assert (nothing.stack_match, nothing.domain_match, nothing.culture_proxy) == (5.0, 8.0, 0.0)


def test_composite_halves_are_rounded_up(spark):
    row = company_row(
        spark, last_funding_date=None, last_role_posted=None, spike_date=None, skills=[], role_types=[], funding_stage=None, remote_us=None, has_engineering_blog=False, oldest_open_days=21,
    )
    assert (row.fit_total, row.urgency_total, row.composite_score) == (31.0, 0.375, 18.8)


def test_label_ladders(spark):
    from tideline.functions import labels

    for value, api, stored in [(75, "critical", "high"), (80, "critical", "critical"), (50, "high", "medium"), (60, "high", "high"), (25, "medium", "low"), (35, "medium", "medium"), (24.9, "low", "low")]:
        assert one(spark, labels.urgency_label(F.lit(value))) == api
        assert one(spark, labels.stored_urgency_label(F.lit(value))) == stored
    assert one(spark, labels.signal_type_label(F.lit("some_new_kind"))) == "Some New Kind"
    assert one(spark, labels.funding_label(F.lit(2_500_000.0), F.lit("seed"))) == "$2M seed"
    assert one(spark, labels.funding_label(F.lit(0.0), F.lit("series_d_plus"))) == "Series D Plus"
    assert one(spark, labels.stage_label(F.lit("unknown"), F.lit("$9M Series E"))) == "Series D+"


def test_blend(spark):
    assert one(spark, scoring.blend(F.lit(60.0), F.lit(100.0))) == 70.0
    assert one(spark, scoring.blend(F.lit(60.04), F.lit(None).cast("double"))) == 60.0


def test_golden_console_score(spark):
    cards = spark.createDataFrame(
        [(1, "A", "tag", "text", "Seed", 77.0, "high", True, "Remote US", "Remote", 9, 9)],
        "company_id bigint, name string, tagline string, description string, stage_label string, fit_score double, urgency_label string, remote_us boolean, remote_label string, location string, open_roles bigint, signal_count bigint",
    ).withColumn("tech_stack", F.expr("named_struct('languages', array('go'), 'frameworks', array('x'), 'infra', array('y'))"))
    roles = spark.createDataFrame(
        [(1, 1, "R1", "u1", "backend", True, 50.0, 1), (2, 1, "R2", "u2", "infra", True, 40.0, 10)],
        "role_id bigint, company_id bigint, title string, url string, role_type string, is_active boolean, fit_score double, days_open int",
    )
    signals = spark.createDataFrame(
        [(1, 1, "founder_post", "h1", ts("2024-01-20 09:00:00"), 70.0), (2, 1, "funding", "h2", ts("2024-01-19 06:00:00"), 60.0)],
        "signal_id bigint, company_id bigint, type string, headline string, signal_date timestamp_ntz, score double",
    )
    row = console.score_opportunities(cards, roles, signals, NOW, profile=None).first()
    assert (row.signal_strength, row.hiring_velocity, row.score, row.confidence, row.score_delta) == (61.5, 37, 61, "medium", "+2")
    evidence = console.evidence(console.score_opportunities(cards, roles, signals, NOW, profile=None), signals, roles, NOW, profile=None)
    assert [(r.label, r.contribution) for r in evidence.orderBy("rank").collect()] == [
        ("Founder hiring signal", 12), ("Strong stack fit", 8), ("Seed funding announcement", 5), ("Fresh backend role", 5),
    ]
    # Skills, stage, remote and role matches of a profile.
    mine = console.Candidate(preferred_roles=("backend",), preferred_skills=("Go", "rust"), target_company_ids=(1,))
    part = console.score_opportunities(cards, roles, signals, NOW, profile=mine).first()
    assert (part.fit_boost, part.skill_boost, part.stage_boost, part.remote_boost, part.target_boost, part.penalty) == (12, 5, 10, 12, 15, 0)
    assert part.personal_reasons[:2] == ["Role alignment: backend, infra", "Skill overlap: go"]


# --- rules ----------------------------------------------------------------------------


def test_rules(spark):
    added = ts("2024-01-01 00:00:00")
    companies = spark.createDataFrame(
        [(1, 85.0, False, None, 0, True), (2, 60.0, True, added, 5, False), (3, 60.1, True, added, 60, False), (4, 90.0, True, added, 100, False), (5, 71.9, False, None, 0, True)],
        "company_id bigint, composite_score double, on_watchlist boolean, watchlist_added_at timestamp_ntz, watchlist_priority int, remote_us boolean",
    )
    roles = spark.createDataFrame([(c, c, True, 1, "infra", f"T{c}", 1.0) for c in (1, 4, 5)], "role_id bigint, company_id bigint, is_active boolean, days_open int, role_type string, title string, fit_score double")
    signals = spark.createDataFrame([(c, c, "founder_post" if c == 1 else "news", "We recruit", 9.0, ts("2024-01-19 00:00:00")) for c in (1, 4, 5)], "signal_id bigint, company_id bigint, type string, headline string, score double, signal_date timestamp_ntz")
    outreach = spark.createDataFrame([(4, "drafted"), (1, "closed")], "company_id bigint, status string")
    decided = rules.apply_rules(companies, roles, signals, outreach, NOW)
    assert values(rules.watchlist_actions(decided)) == [(1, "add", True, 100), (2, "remove", False, None), (4, "reprioritise", True, 94)]
    assert [(r.company_id, r.contact_role, r.top_role) for r in rules.outreach_actions(decided, NOW).collect()] == [(1, "founder", "T1")]
    assert tuple(rules.run_summary(decided).first()) == (5, 1, 1, 2, 1)
    updates = {r.company_id: r for r in merge.watchlist_updates(decided, NOW).collect()}
    assert updates[2].watchlist_priority == 0 and updates[1].watchlist_added_at == ts(NOW)


# --- merges ---------------------------------------------------------------------------


COMPANY = (
    "name string, website string, career_page_url string, github_org string, description string, funding_stage string, funding_amount_usd double,"
    "last_funding_date timestamp_ntz, hq_city string, hq_country string, remote_friendly boolean, remote_us boolean, headcount int,"
    "tech_stack struct<languages:array<string>,frameworks:array<string>,infra:array<string>>, seq bigint"
)


def staged_company(seq, name="Acme Inc", **c):
    return (name, c.get("website", ""), "", "", c.get("description"), c.get("stage", "unknown"), c.get("amount"), None, c.get("city", ""), "", False, c.get("remote", False), c.get("headcount"), (c.get("lang", []), [], []), seq)


def empty_companies(spark):
    ddl = COMPANY.replace(", seq bigint", "") + ", slug string, company_id string, updated_at timestamp_ntz"
    return spark.createDataFrame([], ddl)


def test_company_merge_is_sequential_and_idempotent(spark):
    batch = spark.createDataFrame(
        [staged_company(1, city="Oslo", stage="seed", amount=5.0, lang=["go"]), staged_company(2, name="acme inc", city="Rome", website="w", lang=["rust", "go"], remote=True), staged_company(3, stage="unknown", amount=0.0, headcount=9)],
        COMPANY,
    )
    first = merge.merge_companies(empty_companies(spark), batch, NOW)
    row = first.first()
    assert (row["name"], row.slug, row.hq_city, row.funding_stage, row.funding_amount_usd, row.website, row.remote_us, row.headcount) == ("Acme Inc", "acme-inc", "Oslo", "seed", 5.0, "w", True, 9)
    assert row.tech_stack.languages == ["go", "rust"] and row.hq_country == "United States"
    assert values(merge.merge_companies(first, batch, NOW)) == values(first)
    one_by_one = empty_companies(spark)
    for i in (1, 2, 3):
        one_by_one = merge.merge_companies(one_by_one, batch.where(f"seq = {i}"), NOW)
    assert values(one_by_one) == values(first)


def test_funding_merge_is_null_safe(spark):
    ddl = "company_id string, announced_at timestamp_ntz, round_type string, amount_usd double, lead_investors array<string>, source string, source_url string"
    old = spark.createDataFrame([("1", ts(NOW), None, None, ["x"], "s", "u")], ddl)
    new = spark.createDataFrame([("1", ts(NOW), None, None, [], "s", "u2", 1), ("1", ts(NOW), "seed", None, [], "s", None, 2)], ddl + ", seq int")
    assert values(merge.merge_funding(old, new), "round_type", "lead_investors", "source_url") == [("seed", [], None), (None, ["x"], "u2")]


def brute_two_keys(rows):
    a, b, kept = set(), set(), []
    for seq, x, y in sorted(rows):
        if x not in a and y not in b:
            a.add(x), b.add(y), kept.append((seq,))
    return kept


def test_two_key_dedupe_equals_sequential(spark):
    rng = random.Random(7)
    for n, k in ((60, 8), (200, 40), (30, 2)):
        rows = [(i, rng.randrange(k), rng.randrange(k)) for i in range(n)]
        df = spark.createDataFrame(rows, "seq bigint, a int, b int")
        assert values(ranking.first_wins_two_keys(df, "a", "b", "seq"), "seq") == sorted(brute_two_keys(rows), key=repr)


def test_outreach_status_and_updates(spark):
    ddl = "outreach_id string, status string, notes string, sent_at timestamp_ntz, responded_at timestamp_ntz"
    table = spark.createDataFrame([("1", "drafted", "n", None, None), ("2", "sent", None, ts(NOW), None)], ddl)
    updates = spark.createDataFrame([("1", "sent", ""), ("2", "responded", "ok")], "outreach_id string, status string, notes string")
    assert values(merge.outreach_status_updates(table, updates, NOW)) == [("1", "sent", "n", ts(NOW), None), ("2", "responded", "ok", ts(NOW), ts(NOW))]


def test_diff_skips_equal_pages_and_first_crawls(spark):
    ddl = "company_id int, page_hash string, pos int, title string, location string, url string"
    old = spark.createDataFrame([(1, "a", 1, "X Engineer", "", "u"), (1, "a", 2, "Y", "", "u"), (2, "same", 1, "Z", "", "u")], ddl)
    new = spark.createDataFrame([(1, "b", 1, "x  engineer", "Oslo", "u"), (2, "same", 1, "Q", "", "u"), (3, "c", 1, "N", "", "u")], ddl)
    assert values(merge.snapshot_diff(old, new), "company_id", "slug", "status") == [(1, "x-engineer", "changed"), (1, "y", "removed")]


def test_mentions_equal_patterns(spark):
    import re

    from tideline.operators.mentions import match_mentions

    words = ["fly", "fly.io", "modal labs", "io", "c3", "a-b"]
    aliases = spark.createDataFrame([(f"n{i}", w) for i, w in enumerate(words)], "company_name string, alias string")
    texts = ["Fly.io grows", "butterfly", "the fly", "modal\nlabs", "modal labs!", "xfly.io", "fly.iox", "a-b c3", "a - b", "émodal labsé", ""]
    want = []
    for i, text in enumerate(texts):
        hits = [(len(w), f"n{j}") for j, w in enumerate(words) if re.search(rf"(?<![a-z0-9]){re.escape(w)}(?![a-z0-9])", text.lower())]
        if hits:
            want.append((i, max(hits)[1]))
    got = match_mentions(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), aliases, "id")
    assert values(got) == want


def test_split_and_execution(spark, tables):
    cells = tables.companies.select("company_id", F.explode(F.array(*[F.lit(f"2024-01-0{d}").cast("date") for d in (1, 2, 3)])).alias("as_of_date"))
    split = ranking.chronological_split(cells)
    n = cells.count()
    assert split.where("is_train").count() == int(n * 0.8) and split.count() == n
    assert split.where("is_train").agg(F.max("as_of_date")).first()[0] <= split.where("NOT is_train").agg(F.min("as_of_date")).first()[0]
    with pytest.raises(ValueError):
        ranking.chronological_split(cells.limit(5))


def test_boost_and_resolution(spark):
    rows = spark.createDataFrame([("A", ts(NOW), 90.0)] * 3 + [("B", ts(NOW), 50.0), ("A", ts("2024-01-01 00:00:00"), 10.0)], "company_name string, signal_date timestamp_ntz, score double")
    assert values(activity.boost_same_day(rows, NOW), "company_name", "score") == [("A", 100.0)] * 3 + [("A", 13.0), ("B", 50.0)]
    companies = spark.createDataFrame([(1, "Acme", "acme"), (2, "B", "acme-2")], "company_id int, name string, slug string")
    refs = spark.createDataFrame([("1",), ("ACME",), ("acme-2",), ("ACME-2",), ("zz",)], "ref string")
    assert values(filters.resolve_references(refs, companies)) == [("1", 1), ("ACME", 1), ("ACME-2", None), ("acme-2", 2), ("zz", None)]


def test_signal_scores(spark):
    def at(kind, days, **k):
        return one(spark, scores.signal_score(F.lit(kind), instant(NOW) - F.make_dt_interval(F.lit(days)), instant(NOW), **k))

    assert at("funding", 30, amount=F.lit(2e7)) == 35.0 and at("funding", 0) == 50.0
    assert at("ats_ashby", 15, batch=F.lit(True)) == 42.5 and at("ats_lever", 15) == 32.5
    assert at("github_spike", 0, sigma=F.lit(9.0)) == 75.0 and at("news", 99) == 30.0
    assert one(spark, scores.spike_score(F.lit(9.797959), F.lit(30))) == 76.0


# --- model ------------------------------------------------------------------------------


def test_model_round_trip(spark, tables, tmp_path):
    from tideline.plans import dataset, model

    assert len(dataset.FEATURE_COLUMNS) == 43
    rows = dataset.training_rows(tables.companies, tables.roles, tables.signals, tables.funding_history, "2023-06-01", "2023-12-28", 60)
    dataset.write_export(rows, str(tmp_path / "csv"))
    back = dataset.read_export(spark, str(tmp_path / "csv"))
    vectors = lambda df: values(dataset.vector_columns(df).withColumn("company_id", F.col("company_id").cast("string")), "company_id", "as_of_date", *dataset.FEATURE_COLUMNS[:26])
    assert vectors(back) == vectors(rows)
    meta = model.train(rows, str(tmp_path / "m"), model.ForestSettings(trees=5, max_depth=6))
    assert meta["train_rows"] + meta["valid_rows"] == rows.count() and meta["score_scale"] >= 3.0 and set(meta["metrics"]) == {f"{p}_{m}" for p in ("train", "valid") for m in ("mae", "rmse", "r2")}
    artifact = model.load(spark, str(tmp_path / "m"))
    out = model.predict(artifact, rows)
    assert out.where("model_score < 0 OR model_score > 100 OR model_confidence < 0 OR model_confidence > 100 OR predicted_new_roles_30d < 0").count() == 0
    # Mean of the leaf values is the forest's own prediction.
    from pyspark.ml.functions import vector_to_array

    scored = artifact.pipeline.transform(dataset.vector_columns(rows)).select("raw_prediction", "company_id", "as_of_date", F.posexplode(vector_to_array("leaves")).alias("tree", "leaf"))
    means = scored.join(artifact.leaves, ["tree", "leaf"]).groupBy("company_id", "as_of_date").agg(F.avg("value").alias("v"), F.max("raw_prediction").alias("p"))
    assert means.where("abs(v - p) > 1e-9").count() == 0 and means.count() == rows.count()


def test_forest_trains_on_varying_features_and_even_parts(spark, tables, tmp_path, monkeypatch):
    from tideline.plans import dataset, model

    rows = dataset.training_rows(tables.companies, tables.roles, tables.signals, tables.funding_history, "2023-06-01", "2023-12-28", 60)
    seen, settings = [], model.ForestSettings(trees=5, max_depth=6)
    fit = model.Pipeline.fit
    monkeypatch.setattr(model.Pipeline, "fit", lambda self, df: seen.append(df) or fit(self, df))
    model.train(rows.coalesce(1), str(tmp_path / "few"), settings, metrics=False)
    assert seen[0].rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    few = model.load(spark, str(tmp_path / "few"))
    varying = few.pipeline.stages[0].getInputCols()
    assert 1 < len(varying) < len(dataset.FEATURE_COLUMNS)
    # Columns of one value change nothing in the forest.
    monkeypatch.setattr(model, "_varying", lambda rows: list(dataset.FEATURE_COLUMNS))
    model.train(rows, str(tmp_path / "all"), settings, metrics=False)
    every = model.load(spark, str(tmp_path / "all"))
    assert len(every.pipeline.stages[0].getInputCols()) == len(dataset.FEATURE_COLUMNS)
    columns = ("company_id", "as_of_date", "predicted_new_roles_30d", "model_score", "model_confidence", "prediction_stddev")
    assert values(model.predict(few, rows), *columns) == values(model.predict(every, rows), *columns)


# --- skew: one company holds most rows ---------------------------------------------------


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_company_is_reduced_before_shuffles(spark, tables):
    top = plan_of(ranking.top_signals(tables.signals, 10))
    assert top.count("WindowGroupLimit") == 2  # before and after the exchange
    grid = plan_of(asof.role_grid(tables.companies, tables.roles, asof.Grid("2024-01-01", "2024-01-29", 7)))
    assert "partial_sum" in grid
    for df in (activity.busy_days(tables.signals), scoring.signal_inputs(tables.signals), asof.signal_metrics(tables.signals, "2024-01-20")):
        assert "partial_" in plan_of(df)
    for df in (reports.digest_totals(tables.companies, tables.role_state, tables.signals, tables.outreach, NOW), ranking.latest_signal(tables.signals)):
        assert "CartesianProduct" not in plan_of(df) and "BroadcastNestedLoopJoin" not in plan_of(df)


def test_hot_company_results(spark):
    rows = spark.range(20000).select(
        F.col("id").alias("signal_id"), F.when(F.col("id") % 3 < 2, 1).otherwise(F.col("id")).cast("bigint").alias("company_id"),
        (F.col("id") % 100).cast("double").alias("score"), (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("id").cast("int") % 40000)).alias("signal_date"),
    )
    best = ranking.top_signals(rows, 3).where("company_id = 1").collect()
    want = sorted(((r.score, r.signal_date, -r.signal_id) for r in rows.where("company_id = 1").collect()), reverse=True)[:3]
    assert sorted(((r.score, r.signal_date, -r.signal_id) for r in best), reverse=True) == want
