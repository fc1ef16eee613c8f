"""Whole ingest runs on a table store, and streams over their output."""

import json

import pytest
from conftest import values

from tideline.plans import ingest as plan
from tideline.schemas import STAGED_SIGNAL, Staged, combined
from tideline.sources import boards
from tideline.sources.store import TableStore
from tideline.streaming import live

NOW, LATER = "2024-01-20 12:00:00", "2024-01-25 12:00:00"


def board(spark, *titles, name="Acme", landed=1):
    body = json.dumps({"jobs": [{"id": i, "title": t, "content": "python", "updated_at": "2024-01-19T00:00:00Z", "location": {"name": "Remote"}} for i, t in enumerate(titles)]})
    return boards.greenhouse(spark.createDataFrame([(landed, name, name.lower(), body)], ["landed", "company_name", "token", "body"]), NOW)


@pytest.fixture(scope="module")
def filled(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("store"))
    store = TableStore(spark, root)
    first = plan.ingest(store, board(spark, "Backend Engineer", "ML Engineer"), NOW, "r1")
    again = plan.ingest(store, board(spark, "Backend Engineer", "ML Engineer"), NOW, "r1")
    rows = [
        ("ACME", "funding", "Raised", None, "https://n.example/1", None, "2024-01-18 00:00:00", 80.0, 3e7, "series b", None, None, None, (5, 0)),
        ("New.Co", "founder_post", "We hire", None, "https://n.example/2", None, "2024-01-19 00:00:00", 50.0, None, None, None, None, None, (5, 1)),
    ]
    df = spark.createDataFrame([r[:6] + (None,) + r[7:] for r in rows], STAGED_SIGNAL)
    from pyspark.sql import functions as F

    df = df.withColumn("signal_date", F.when(F.col("type") == "funding", F.lit("2024-01-18 00:00:00")).otherwise("2024-01-19 00:00:00").cast("timestamp_ntz"))
    base = board(spark, "Backend Engineer", "Platform Engineer", landed=2)
    news = Staged("social", base.companies.limit(0), df, base.roles.limit(0))
    second = plan.ingest(store, combined([base, news]), LATER, "r2")
    return store, first, again, second


def test_run_summaries(filled):
    store, first, again, second = filled
    assert again == {"run_id": "r1", "skipped": True}
    assert (first["companies_upserted"], first["signals_new"], first["roles_new"], first["roles_updated"]) == (1, 2, 2, 0)
    # Same urls and dates for job 0; job 1 has a new title under the same url.
    assert (second["signals_new"], second["roles_new"], second["roles_updated"], second["companies_rescored"]) == (2, 0, 2, 2)
    assert values(store.read("ingest_runs"), "run_id", "status", "records_new") == [("r1", "success", 4), ("r2", "success", 2)]


def test_state_tables(filled):
    store = filled[0]
    assert values(store.read("companies"), "slug", "name") == [("acme", "Acme"), ("new-co", "New.Co")]
    assert values(store.read("roles"), "title", "is_active", "days_open") == [("Backend Engineer", True, 5), ("Platform Engineer", True, 5)]
    assert store.read("roles").where("fit_score > 0").count() == 2
    assert values(store.read("funding_history"), "amount_usd", "round_type") == [(3e7, "series b")]
    scores = {r.slug: r for r in store.read("companies").collect()}
    # stack python 8, domain infra 16 (best of backend and infra), seniority 15, remote is not set on the company
    assert scores["acme"].fit_score == 39.0
    assert scores["new-co"].urgency_score > 0 and scores["acme"].last_signal_at is not None


def test_failed_run_changes_nothing(spark, filled):
    store = filled[0]
    before = values(store.read("companies"))
    broken = board(spark, "SRE", name="Broken")
    bad = Staged("x", broken.companies.withColumnRenamed("website", "nope"), broken.signals, broken.roles)
    with pytest.raises(Exception):
        plan.ingest(store, bad, LATER, "r3")
    assert values(store.read("companies")) == before and not store.has_run("r3")
    assert store.read("ingest_runs").where("status = 'error'").count() == 1


def test_crawl_deactivates_missing_roles(spark, filled, tmp_path):
    store = TableStore(spark, str(tmp_path))
    base = board(spark, "Backend Engineer", "ML Engineer")
    as_crawl = lambda s: Staged("career_page", s.companies, s.signals, s.roles.replace("greenhouse", "career_page", "ingest_source"))
    plan.ingest(store, as_crawl(base), NOW, "c1")
    plan.ingest(store, as_crawl(board(spark, "Backend Engineer")), LATER, "c2")
    assert values(store.read("roles"), "title", "is_active") == [("Backend Engineer", True), ("ML Engineer", False)]


def test_live_fold_equals_batch(spark, filled, tmp_path):
    store = filled[0]
    feed = live.read_feed(spark, store.feed_path, max_files=1)
    query = live.start_live_fold(feed, str(tmp_path / "live"), str(tmp_path / "cp"), once=True)
    query.awaitTermination(120)
    state = live.LiveState(spark, str(tmp_path / "live"))
    signals = store.read("signals")
    expected = sorted((r["company_id"], r["count"]) for r in signals.groupBy("company_id").count().collect())
    assert values(state.latest("counts"), "company_id", "signal_count") == expected
    assert state.latest("feed").count() == signals.count()
    assert state.latest("history").count() == signals.count()
    # A replay of the published files, in a later batch, changes nothing.
    published = spark.read.schema(live.PAYLOAD).json(store.feed_path).drop("run")
    last = max(int(p.name.removeprefix("batch=")) for p in (tmp_path / "live").glob("batch=*"))
    state.advance(published, last + 1)
    assert values(state.latest("counts"), "company_id", "signal_count") == expected


def test_unique_signals_stream(spark, filled, tmp_path):
    store = filled[0]
    unique = live.unique_signals(live.read_feed(spark, store.feed_path))
    query = unique.writeStream.format("memory").queryName("uniq").outputMode("append").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.sql("SELECT count(DISTINCT id) = count(*) AND count(*) > 0 FROM uniq").first()[0]


def test_streaming_ingest_equals_batch(spark, tmp_path):
    rows = board(spark, "Backend Engineer", "ML Engineer").signals
    rows.write.json(str(tmp_path / "in"))
    rows.write.mode("append").json(str(tmp_path / "in"))
    query = live.start_ingest(
        live.read_staged_signals(spark, str(tmp_path / "in")), str(tmp_path / "s"), str(tmp_path / "cp"), lambda i: NOW, once=True
    )
    query.awaitTermination(200)
    streamed = TableStore(spark, str(tmp_path / "s"))
    batch = TableStore(spark, str(tmp_path / "b"))
    empty = board(spark)
    plan.ingest(batch, Staged("stream", empty.companies.limit(0), rows, empty.roles.limit(0)), NOW, "x")
    assert values(streamed.read("signals"), "dedup_key") == values(batch.read("signals"), "dedup_key")
    assert values(streamed.read("companies"), "slug", "urgency_score") == values(batch.read("companies"), "slug", "urgency_score")


def test_busy_windows(spark, tables, tmp_path):
    from pyspark.sql import functions as F

    from tideline.operators.activity import busy_days

    source = str(tmp_path / "feed")
    tables.signals.select(
        F.col("signal_id").cast("string").alias("id"), F.col("company_id").cast("string"), "type", "headline", "score",
        F.date_format("signal_date", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("signal_date"),
    ).write.json(source)
    feed = live.read_feed(spark, source)
    query = live.busy_windows(feed).writeStream.format("memory").queryName("busy").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = values(spark.sql("SELECT CAST(company_id AS BIGINT) AS company_id, day, n FROM busy"))
    assert got == values(busy_days(tables.signals))


def test_daily_partitions_are_replaced(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    rows = lambda v, *days: spark.createDataFrame([(1, d, v) for d in days], "company_id bigint, as_of_date string, n int").selectExpr("company_id", "CAST(as_of_date AS DATE) AS as_of_date", "n")
    store.write_daily("role_daily", rows(1, "2024-01-01", "2024-01-02"))
    store.write_daily("role_daily", rows(2, "2024-01-02", "2024-01-03"))
    got = [(str(r.as_of_date), r.n) for r in store.read_daily("role_daily", "2024-01-01", "2024-01-02").orderBy("as_of_date").collect()]
    assert got == [("2024-01-01", 1), ("2024-01-02", 2)]


def test_a_run_without_roles_writes_no_role_files(spark, tmp_path):
    from pathlib import Path

    from tideline.schemas import STAGED_COMPANY, STAGED_ROLE, STAGED_SIGNAL, Staged, conform

    store = TableStore(spark, str(tmp_path / "s"))
    signal = spark.sql("SELECT 'Acme' AS company_name, 'founder_post' AS type, 'h' AS headline, '' AS detail, 'https://x/1' AS source_url, CAST(NULL AS timestamp_ntz) AS signal_date, 60.0 AS score, named_struct('landed', 1L, 'pos', 0) AS seq")
    staged = Staged("social", spark.createDataFrame([], STAGED_COMPANY), conform(signal, STAGED_SIGNAL), spark.createDataFrame([], STAGED_ROLE))
    first = plan.ingest(store, staged, "2024-01-20 06:00:00", "one")
    assert first["signals_new"] == 1 and not list(Path(tmp_path / "s").glob("roles/*"))
    # The undated signal is known in the next run.
    assert plan.ingest(store, staged, "2024-01-20 18:00:00", "two")["signals_new"] == 0


def _written(root, table, before=()):
    """Buckets of ``table`` with files that were not there ``before``."""
    from pathlib import Path

    return {p for p in Path(root, table).glob("bucket=*/*.parquet") if p not in before}


def test_a_run_rewrites_its_buckets_only(spark, tmp_path):
    root = str(tmp_path / "s")
    store = TableStore(spark, root)
    jobs = lambda n: json.dumps({"jobs": [{"id": 10 * n + k, "title": f"Backend Engineer {k}", "content": "python", "updated_at": "2024-01-19T00:00:00Z", "location": {"name": "Remote"}} for k in range(6)]})
    firms = [(n, f"Firm {n}", f"firm {n}", jobs(n)) for n in range(20)]
    many = boards.greenhouse(spark.createDataFrame(firms, ["landed", "company_name", "token", "body"]), NOW)
    plan.ingest(store, many, NOW, "first")
    tables = ("roles", "companies", "signal_facts")
    before = {t: _written(root, t) for t in tables}
    assert len({p.parent for p in before["roles"]}) > 20
    small = board(spark, "Backend Engineer 0", "Backend Engineer 1", "New Role", name="Firm 3")
    summary = plan.ingest(store, small, LATER, "second")
    assert summary["companies_rescored"] == 1
    new = {t: {p.parent.name for p in _written(root, t, before[t])} for t in tables}
    assert 1 <= len(new["roles"]) <= 3 and len(new["companies"]) == len(new["signal_facts"]) == 1
    # The same batches over a store of one bucket: a full merge.
    whole = TableStore(spark, str(tmp_path / "w"), buckets=1)
    plan.ingest(whole, many, NOW, "first")
    plan.ingest(whole, small, LATER, "second")
    for table in ("roles", "companies", "signals", "funding_history", "signal_facts"):
        assert values(store.read(table)) == values(whole.read(table))


def test_scores_need_no_old_signals(spark, filled):
    """The stored facts are those of all signals, and scores from them are the same."""
    from tideline.plans import scoring

    store = filled[0]
    facts, signals = store.read("signal_facts"), store.read("signals")
    assert values(facts, *sorted(facts.columns)) == values(scoring.signal_inputs(signals), *sorted(facts.columns))
    companies, roles = store.read("companies").drop("fit_score", "urgency_score", "composite_score"), store.read("roles")
    one, two = scoring.rescore(companies, roles, signals, LATER), scoring.rescore(companies, roles, None, LATER, facts=facts)
    assert values(one, "slug", "composite_score") == values(two, "slug", "composite_score")


@pytest.mark.parametrize("dies_at", ["_create", "_replace", "log_run", "_whole"])
def test_a_killed_run_leaves_each_key_once_when_repeated(spark, tmp_path, monkeypatch, dies_at):
    root = str(tmp_path / "s")
    store = TableStore(spark, root)
    plan.ingest(store, board(spark, "SRE"), NOW, "r0")
    batch = lambda: board(spark, "Backend Engineer", "ML Engineer", landed=2)
    real, calls = getattr(TableStore, dies_at), []

    def dying(self, *args):
        calls.append(args)
        ready = dies_at != "_create" or "_READY" in str(args[0])
        if ready and len(calls) >= (2 if dies_at == "_replace" else 1):
            raise KeyboardInterrupt
        return real(self, *args)

    monkeypatch.setattr(TableStore, dies_at, dying)
    with pytest.raises(KeyboardInterrupt):
        plan.ingest(store, batch(), LATER, "r1")
    monkeypatch.undo()
    with pytest.raises(RuntimeError, match="has not ended"):
        plan.ingest(TableStore(spark, root), batch(), LATER, "r2")
    plan.ingest(TableStore(spark, root), batch(), LATER, "r1")
    plain = TableStore(spark, str(tmp_path / "p"))
    plan.ingest(plain, board(spark, "SRE"), NOW, "r0")
    plan.ingest(plain, batch(), LATER, "r1")
    for table in ("roles", "companies", "signals", "ingest_runs"):
        assert values(store.read(table)) == values(plain.read(table))
    feeds = [spark.read.schema(live.PAYLOAD).json(s.feed_path) for s in (store, plain)]
    assert values(feeds[0], "id") == values(feeds[1], "id") and feeds[0].count() == feeds[0].select("id").distinct().count()
