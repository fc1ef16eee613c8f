"""Normalisers on small landed payloads."""

import json
from datetime import datetime

import pytest
from conftest import values
from pyspark.sql import functions as F

from tideline.functions import funding as fund, text, titles
from tideline.functions.clock import parse_instant
from tideline.sources import boards, elements, feeds, funding, pages, registry, repos

NOW = "2024-01-20 12:00:00"


def one(spark, expr, **columns):
    df = spark.createDataFrame([tuple(columns.values())], [*columns]) if columns else spark.range(1)
    return df.select(expr.alias("x")).first()[0]


def test_greenhouse_board(spark):
    body = json.dumps({"jobs": [
        {"id": 11, "title": " Senior Backend Engineer ", "content": "<p>Go, Kafka &amp; Postgres</p>", "updated_at": "2024-01-19T20:00:00-05:00", "location": {"name": "Remote - US"}},
        {"id": 12, "title": "Staff ML Engineer", "content": "", "updated_at": "2024-01-18T00:00:00Z", "location": {"name": "Berlin"}},
        {"id": 13, "title": "Site Reliability Engineer", "content": "", "updated_at": "2024-01-20T01:00:00Z", "location": {"name": "US"}},
        {"id": 14, "title": "Recruiter", "content": "", "updated_at": "2024-01-20T01:00:00Z", "location": {"name": "US"}},
    ]})
    landed = spark.createDataFrame([(1, "Acme", "acme", body), (2, "Bad", "bad", "not json")], ["landed", "company_name", "token", "body"])
    staged = boards.greenhouse(landed, NOW)
    roles = values(staged.roles, "title", "role_type", "seniority", "is_remote", "is_remote_us", "external_id")
    assert roles == [
        ("Senior Backend Engineer", "backend", "senior", True, True, "11"),
        ("Site Reliability Engineer", "infra", "mid", False, False, "13"),
        ("Staff ML Engineer", "ai_ml", "staff", False, False, "12"),
    ]
    skills = {r.title: (r.tech_stack.infra, r.required_skills) for r in staged.roles.collect()}
    assert skills["Senior Backend Engineer"] == (["postgres", "kafka"], ["go"]) or skills["Senior Backend Engineer"][1] == ["go"]
    signals = {r.headline: r for r in staged.signals.collect()}
    # 19 Jan 20:00 -05:00 is 20 Jan 01:00 UTC: three signals (one is the batch) on the day, all boosted.
    assert signals["Senior Backend Engineer — Remote - US"].signal_date == datetime(2024, 1, 20, 1)
    assert signals["Senior Backend Engineer — Remote - US"].score == pytest.approx(84.5)
    batch = [s for h, s in signals.items() if h.startswith("3 engineering roles")]
    assert len(batch) == 1 and batch[0].score == 100.0
    assert "Senior Backend Engineer, Staff ML Engineer, Site Reliability Engineer" in batch[0].headline


def test_ashby_board(spark):
    body = json.dumps({"jobBoard": {"jobBoardUrl": "https://jobs.ashbyhq.com/x"}, "jobs": [
        {"id": "a", "title": "Platform Engineer", "descriptionHtml": "Rust " + "y" * 6000 + " terraform", "location": "", "isRemote": True, "publishedAt": "2024-01-10T12:00:00.000+00:00"},
    ]})
    landed = spark.createDataFrame([(1, "Acme", "x", body)], ["landed", "company_name", "token", "body"])
    staged = boards.ashby(landed, NOW)
    role = staged.roles.first()
    assert (role.is_remote, role.is_remote_us, role.role_type) == (True, True, "infra")
    assert role.tech_stack.infra == ["terraform"] and len(role.description_raw) == 6015
    assert staged.signals.first().score == 55.0
    assert staged.companies.first().career_page_url == "https://jobs.ashbyhq.com/x"


def test_board_jobs_are_parsed_once(spark):
    rows = [(1, "Acme", "acme", '{"jobs": [{"id": "1", "title": "Backend Engineer"}, {"id": "2", "title": "Cook"}]}')]
    landed = spark.createDataFrame(rows, "landed bigint, company_name string, token string, body string")
    for staged in (boards.greenhouse(landed, NOW), boards.ashby(landed, NOW)):
        for part in (staged.roles, staged.signals):
            assert part.count() == 1
            assert "from_json" not in part._jdf.queryExecution().optimizedPlan().toString()


def test_portfolio_board(spark):
    body = json.dumps({"jobs": [
        {"title": "Backend Engineer", "companyName": "Acme", "url": "/jobs/1", "requiredSkills": [{"label": "Python"}, "Go"], "preferredSkills": {"name": "Kafka"},
         "markets": "Dev", "locations": [["Paris"], {"value": "Remote"}], "hybrid": True, "fundingLV": {"label": "Series B"}, "timeStamp": "2024-01-01T00:00:00Z"},
        {"title": "Backend Engineer II", "companyName": "Acme", "url": "/jobs/1"},
        {"title": "Software Engineer", "companyName": "Beta", "applyUrl": "https://b.example/2", "normalizedLocations": [{"name": "Oslo", "country": "Norway"}], "fundingLV": "IPO"},
        {"title": "", "companyName": "Nope", "url": "/3"},
    ]})
    landed = spark.createDataFrame([(1, "https://board.example/jobs", "Board", body)], ["landed", "board_url", "board_name", "body"])
    staged = boards.portfolio(landed, NOW)
    got = {r.url: r for r in staged.roles.collect()}
    assert set(got) == {"https://board.example/jobs/1", "https://b.example/2"}
    first = got["https://board.example/jobs/1"]
    assert first.title == "Backend Engineer" and first.required_skills == ["Python", "Go", "Kafka"]
    assert first.location == "Paris, Remote · Hybrid" and first.is_remote
    assert got["https://b.example/2"].location == "Oslo, Norway"
    stages = dict(values(staged.companies, "name", "funding_stage"))
    assert stages == {"Acme": "series_b", "Beta": "public"}
    assert values(staged.signals, "score") == [(57.0,), (60.0,)]


def test_listing_page(spark):
    data = json.dumps({"props": {"jobs": [
        {"id": 1, "title": "Founding Engineer", "companySlug": "a", "companyName": "A", "companyOneLiner": "Rust db", "roleType": "Backend", "jobType": "Full", "location": "Remote (US)"},
        {"id": 2, "title": "Designer", "companySlug": "a", "companyName": "A", "roleType": "design", "jobType": "Full", "location": "NY"},
        {"id": 3, "title": "Software Engineer", "companySlug": "b", "companyName": "B", "roleType": "Backend", "jobType": "Intern", "location": "NY"},
        {"id": 4, "title": "Growth", "companySlug": "a", "companyName": "A", "roleType": "iOS", "jobType": "Full", "location": "NY"},
    ]}})
    html = '<html><div class="x" id="jobs/public/pages/JobsPage-react-component-1" data-page="' + data.replace("&", "&amp;").replace('"', "&quot;") + '"></div></html>'
    landed = spark.createDataFrame([(1, html)], ["landed", "body"])
    staged = boards.listing(landed, NOW)
    assert values(staged.roles, "title", "role_type", "is_remote_us") == [("Founding Engineer", "backend", True), ("Growth", "mobile", False)]
    company = staged.companies.first()
    assert staged.companies.count() == 1 and company.remote_us and company.tech_stack.languages == ["rust"]


def test_offering_table(spark, tmp_path):
    path = tmp_path / "offerings.tsv"
    path.write_text(
        "Issuer Name\tFiling-Date\ttotalOfferingAmount\tTotal_Amount_Sold\tIndustryGroupType\n"
        "Acme Data Inc\t2024-01-05\t$20,000,000\t12000000\tTechnology\n"
        "Old Co\t2023-01-05\t20000000\t\tAI\n"
        "Small Co\t2024-01-05\t100000\t\tAI\n"
        "Undated AI\t\t9,000,000\tn/a\t\n"
    )
    other = tmp_path / "other.csv"
    other.write_text("a,b\n1,2\n3,4\n5,6\n7,8\n9,10\n")
    table = funding.choose_offering_table(funding.read_offering_tables(spark, [str(other), str(path)]))
    staged = funding.offerings(table, NOW)
    rows = values(staged.signals, "company_name", "funding_amount_usd", "score", "signal_date")
    assert rows == [
        ("Acme Data Inc", 12_000_000.0, 55.0, datetime(2024, 1, 5)),
        ("Undated AI", 9_000_000.0, 50.0, datetime(2024, 1, 20, 12)),
    ]
    assert staged.signals.where("company_name = 'Acme Data Inc'").first().detail == "Offering table: $12M sold of $20M offered."


RSS = """<?xml version="1.0"?><rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>t</title>
<item><title>Acme raises $25 million Series B to build databases</title><link>https://n.example/1</link><description>Cloud &lt;b&gt;infra&lt;/b&gt;</description><pubDate>Fri, 19 Jan 2024 10:00:00 +0000</pubDate><dc:creator>Jo</dc:creator></item>
<item><title>We are hiring senior engineers, join us</title><link>https://n.example/2</link><description>backend platform</description><pubDate>Thu, 18 Jan 2024 10:00:00 GMT</pubDate></item>
<item><title>Old funding news: Beta raises $30 million</title><link>https://n.example/3</link><pubDate>Mon, 01 Jan 2024 10:00:00 +0000</pubDate></item>
</channel></rss>"""
ATOM = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>f</title>
<entry><title type="html">Careers at Acme</title><link rel="self" href="https://a.example/self"/><link href="https://a.example/1"/><summary>open roles</summary><author><name>Ann</name></author><updated>2024-01-19T00:00:00Z</updated></entry>
<entry><title>No link</title><updated>2024-01-19T00:00:00Z</updated></entry></feed>"""


def feed_rows(spark):
    return spark.createDataFrame(
        [(1, RSS, "Acme", "blog_post", "Blog", "", "", 30.0, "https://n.example/rss"), (2, ATOM, "Acme", "founder_post", "Founders", "Ann", "Founder", 10.0, "https://a.example/feed")],
        ["landed", "body", "company_name", "kind", "source_label", "actor_name", "actor_role", "min_score", "feed_url"],
    )


def test_feed_entries(spark):
    entries = feeds.feed_entries(feed_rows(spark), NOW)
    got = values(entries, "title", "link", "summary", "author", "published_at")
    assert got == [
        ("Acme raises $25 million Series B to build databases", "https://n.example/1", "Cloud infra", "Jo", datetime(2024, 1, 19, 10)),
        ("Careers at Acme", "https://a.example/1", "open roles", "Ann", datetime(2024, 1, 19)),
        ("We are hiring senior engineers, join us", "https://n.example/2", "backend platform", "", datetime(2024, 1, 18, 10)),
    ]


def test_social_signals(spark):
    staged = feeds.social_signals(feeds.owned_feed_entries(feed_rows(spark), NOW))
    got = {r.source_url: r for r in staged.signals.collect()}
    # 6 + we are hiring 36 + hiring 24 + join us 18 + backend 8 + platform 8 + title 8 = 108, capped.
    assert got["https://n.example/2"].score == 95.0
    # 12 + careers 14 + open roles 20 + title 8 + actor 4
    assert got["https://a.example/1"].score == 58.0
    assert got["https://a.example/1"].headline == "Careers at Acme — founder hiring signal"
    assert set(got) == {"https://n.example/2", "https://a.example/1"}


def test_news_feed_events(spark):
    events = funding.news_feed(feed_rows(spark).where("landed = 1"), NOW)
    row = events.first()
    assert events.count() == 1
    assert (row.company_name, row.amount_usd, row.round_type, row.score) == ("Acme", 25e6, "series b", 95.0)
    staged = funding.staged_events(events)
    assert staged.signals.first().headline == "Raised $25M Series B — engineering hiring wave expected"
    assert staged.companies.first().funding_stage == "series_b"


def test_forum_items(spark):
    t = int(datetime(2024, 1, 19).timestamp())
    rows = [
        (1, json.dumps({"id": 7, "type": "story", "title": "Fly.io is hiring", "by": "x", "time": t})),
        (2, json.dumps({"id": 8, "type": "story", "title": "dead", "dead": True, "time": t})),
        (3, json.dumps({"id": 9, "type": "job", "title": "job", "time": t})),
        (4, json.dumps({"id": 10, "type": "comment", "text": "<p>I like butterfly io</p>", "time": t})),
    ]
    items = feeds.forum_items(spark.createDataFrame(rows, ["landed", "body"]), NOW)
    assert values(items, "title", "link") == [
        ("Fly.io is hiring", "https://news.ycombinator.com/item?id=7"), ("I like butterfly io", "https://news.ycombinator.com/item?id=10"),
    ]
    aliases = registry.registry_aliases(spark.createDataFrame([("Fly.io", ["fly"]), ("Other", ["io"])], ["name", "aliases"]))
    named = feeds.named_entries(items, aliases)
    assert values(named, "title", "company_name") == [("Fly.io is hiring", "Fly.io"), ("I like butterfly io", "Other")]


def test_funding_headlines(spark):
    cases = {
        "Exclusive: Acme raises $12.5M seed round": ("Acme", 12.5e6, "seed"),
        "Sequoia-backed Beta Labs secures $1.2 billion": None,
        "Gamma, a database startup, lands $40 million Series A": ("Gamma, a database startup", 40e6, "series a"),
        "Report: Delta: the story of how it closed $50m growth": ("Delta", 50e6, "growth"),
        "Acme raises $3 million": None,
        "Why Zeta captured $10 million": ("Zeta", 10e6, "unknown"),
        "Nothing here": None,
    }
    rows = fund.with_deal(spark.createDataFrame([(k,) for k in cases], ["t"]), F.col("t"), F.lit(""))
    got = {r.t: (r.company_name, r.amount_usd, r.round_type) for r in rows.collect()}
    assert got == {k: v for k, v in cases.items() if v}


def test_funding_pages(spark):
    directory = """<div><h3>Acme, </h3><p>What they do: AI databases</p><p>Quick facts: x</p><div>HQ: Paris, France</div>
      <div>Funding: $30M Series B 2023</div><p>Take action: go</p><h3>Filter by</h3><p>Funding: $9M</p></div>"""
    roundup = """<h2>Beta raises $15 million Series A</h2><p>When: January 5, 2024</p><p>Recipient Company: Beta Labs (US)</p><p>Details: Builds APIs. </p><p>Reference: x</p><h2>Other</h2>"""
    headlines = """<p><a href="/x">Gamma raises $20 million for its platform</a> January 7, 2024</p><p><a href="/y">Gamma raises $20 million for its platform</a></p>"""
    bullets = """<ul><li>Before (US): $50M on January 3, 2024</li></ul><h3>Exceptionally large rounds</h3><ul><li>Delta (US): $50M on January 3, 2024</li><li>Tiny (US): $500K on January 3, 2024</li></ul>
      <h3>Exceptionally small</h3><ul><li>After (US): $50M on January 3, 2024</li></ul>"""
    df = spark.createDataFrame(
        [(1, "https://d.example/", directory, "series b"), (2, "https://r.example/", roundup, ""), (3, "https://h.example/", headlines, ""), (4, "https://b.example/", bullets, "seed")],
        ["page_id", "url", "html", "default_round"],
    )
    d = funding.directory_pages(df.where("page_id = 1"), NOW).collect()
    assert [(r.company_name, r.amount_usd, r.round_type, r.announced_at, r.hq_city, r.description) for r in d] == [
        ("Acme", 30e6, "series b", datetime(2023, 7, 1), "Paris", "AI databases")
    ]
    r = funding.roundup_pages(df.where("page_id = 2"), NOW).collect()
    assert [(x.company_name, x.amount_usd, x.announced_at) for x in r] == [("Beta Labs", 15e6, datetime(2024, 1, 5))]
    assert r[0].detail == "Source: funding roundup. Builds APIs."
    h = funding.headline_pages(df.where("page_id = 3"), NOW).collect()
    assert [(x.company_name, x.source_url, x.announced_at) for x in h] == [("Gamma", "https://h.example/x", datetime(2024, 1, 7))]
    b = funding.bullet_pages(df.where("page_id = 4"), NOW).collect()
    assert [(x.company_name, x.amount_usd, x.announced_at, x.round_type) for x in b] == [("Delta", 50e6, datetime(2024, 1, 3), "seed")]


def test_api_rounds(spark):
    body = json.dumps({"entities": [
        {"properties": {"funded_organization_identifier": {"value": "Acme AI"}, "money_raised": {"value_usd": 5e7}, "investment_type": "series b", "announced_on": "2024-01-02"}},
        {"properties": {"funded_organization_identifier": {"value": "NoMoney"}, "investment_type": "seed"}},
        {"properties": {}},
    ]})
    got = values(funding.api_rounds(spark.createDataFrame([(1, body)], ["landed", "body"]), NOW), "company_name", "score", "announced_at")
    assert got == [("Acme AI", 95.0, datetime(2024, 1, 2)), ("NoMoney", 30.0, datetime(2024, 1, 20, 12))]


def page(spark, *htmls):
    return spark.createDataFrame([(i, "https://c.example/careers/", h, f"Co{i}") for i, h in enumerate(htmls)], ["page_id", "url", "html", "company_name"])


def test_career_page_strategies(spark):
    ld = '<script type="application/ld+json">{"@graph": [{"@type": "JobPosting", "title": "ML Engineer", "url": "https://c.example/1", "jobLocation": {"address": {"addressLocality": "Remote"}}}, {"@type": "Other"}]}</script><a href="/job/2">Software Engineer here</a>'
    lever = '<div class="posting"><a href="https://l.example/9"><h5>x</h5></a><div class="posting-title"><h5>Backend Engineer</h5></div><div class="posting-categories"><span class="location">Oslo</span></div></div>'
    opening = '<div class="opening"><a href="o/1">Data Engineer</a></div><div data-job-id="5"><h3>SRE lead</h3><a href="/a">see</a></div>'
    listed = '<ul class="jobs"><li><a href="j1">Platform Engineer</a><li><a href="j2">Cook</a></ul><h3>Software Engineer, Growth</h3><p>text</p><a href="j3">apply</a>'
    links = '<p><a href="/jobs/1">Software Engineer one</a><a href="/about">Software Engineer two</a><a href="/jobs/1b">Software Engineer one</a></p>'
    jobs = pages.page_jobs(page(spark, ld, lever, opening, listed, links))
    assert values(jobs, "page_id", "title", "url", "location") == [
        (0, "ML Engineer", "https://c.example/1", "Remote"),
        (1, "Backend Engineer", "https://l.example/9", "Oslo"),
        (2, "Data Engineer", "https://c.example/careers/o/1", ""),
        (2, "SRE lead", "https://c.example/a", ""),
        (3, "Platform Engineer", "https://c.example/careers/j1", ""),
        (3, "Software Engineer, Growth", "https://c.example/careers/j3", ""),
        (4, "Software Engineer one", "https://c.example/jobs/1", ""),
    ]


def test_career_page_diff(spark):
    html = lambda *jobs: "".join(f'<a href="/job/{i}">{j}</a>' for i, j in enumerate(jobs))
    old = page(spark, html("Software Engineer A", "Backend Engineer B"), html("Software Engineer C"), html("Software Engineer D"))
    new = page(spark, html("Software Engineer A", "Platform Engineer E"), html("Software Engineer C"), "<p>none</p>")
    previous = pages.snapshots(old, pages.page_jobs(old))
    staged = pages.career_pages(new, previous, NOW)
    assert values(staged.signals, "company_name", "headline", "score") == [
        ("Co0", "Backend Engineer B removed — role filled or paused", 25.0),
        ("Co0", "Platform Engineer E — direct listing, not yet syndicated to job boards", 72.0),
        ("Co2", "Software Engineer D removed — role filled or paused", 25.0),
    ]
    assert staged.roles.count() == 3
    assert pages.career_pages(new, None, NOW).signals.count() == 0


def test_alike_pages_are_parsed_in_all_partitions_and_jobs_found_once(spark):
    crawled = page(spark, *['<a href="/job/1">Software Engineer A</a>'] * 40)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert elements.page_elements(crawled).rdd.getNumPartitions() == parts > 1
    previous = pages.snapshots(crawled, pages.page_jobs(crawled))
    diff = pages.career_pages(crawled, previous, NOW).signals
    # Both readings of the diff are of stored rows, not of the jobs being found.
    assert diff.inputFiles() and all("/crawls-" in f for f in diff.inputFiles())
    assert diff.count() == 0


def test_career_links(spark):
    html = '<a href="/about">About</a><a href="jobs">Work</a><a href="https://x.example/z">Open Roles</a>'
    links = pages.career_links(spark.createDataFrame([(1, "https://c.example/", html)], ["page_id", "url", "html"]))
    # The page says "open roles" itself, so it is its own first link.
    assert values(links, "url") == [("https://c.example/",), ("https://c.example/jobs",), ("https://x.example/z",)]


def test_elements_nested_and_broken_markup():
    rows = list(elements.elements_of("<p>a<p><b>b <a href='x'>c &amp; d</a><script>no</script><li>e"))
    assert [(r[1], r[3], r[4]) for r in rows] == [("a", "x", "c & d"), ("#lines", None, "a\nb\nc & d\ne")]


def test_repo_activity(spark):
    repo_list = json.dumps([
        {"name": "core", "html_url": "https://g/core", "fork": False, "archived": False, "created_at": "2020-01-01T00:00:00Z", "pushed_at": "2024-01-20T00:00:00Z"},
        {"name": "k8s-gateway", "html_url": "https://g/new", "description": None, "created_at": "2024-01-18T00:00:00Z", "pushed_at": "2024-01-19T00:00:00Z"},
        {"name": "fork", "fork": True, "created_at": "2024-01-18T00:00:00Z", "pushed_at": "2024-01-19T00:00:00Z"},
    ])
    # Window sums 6, 9, 3, 6 and 30 recent commits.
    days = {"2024-01-06": 6, "2024-01-10": 9, "2024-01-12": 3, "2024-01-15": 6, "2024-01-18": 15, "2024-01-19": 15, "2024-01-20": 99}
    commits = json.dumps([{"commit": {"author": {"date": f"{d}T01:00:00Z"}}} for d, n in days.items() for _ in range(n)])
    orgs = spark.createDataFrame([(1, "Acme", "acme", repo_list)], ["landed", "company_name", "org", "body"])
    commit_rows = repos.commits(spark.createDataFrame([("acme", "core", commits)], ["org", "repo", "body"]))
    lang = repos.languages(spark.createDataFrame([("acme", "core", '{"Go": 900, "C": 30, "Rust": 100}'), ("acme", "fork", '{"Perl": 9999}')], ["org", "repo", "body"]))
    staged = repos.repo_activity(repos.repositories(orgs), commit_rows, lang, "2024-01-20 12:00:00")
    spike = staged.signals.where("github_commit_count IS NOT NULL").first()
    assert spike.github_commit_count == 30 and spike.score == pytest.approx(76.0)
    assert spike.headline.startswith("30 commits in 72h — 9.8σ")
    assert values(staged.signals.where("github_repo_name IS NOT NULL"), "github_repo_name", "score") == [("k8s-gateway", 45.0)]
    assert staged.companies.first().tech_stack.languages == ["go", "rust"]


def test_board_targets_and_page_targets(spark):
    reg = spark.createDataFrame(
        [("Acme", "", "", "acme", "", "", []), ("Beta", "https://b.example", "", "", "beta", "", [])], registry.REGISTRY.replace("array<string>", "array<string>")
    )
    companies = spark.createDataFrame(
        [("Acme 2", "https://boards.greenhouse.io/ACME/jobs/1"), ("Gamma", "https://x.example?for=gamma"), ("None", None)], ["name", "career_page_url"]
    )
    assert values(registry.board_targets(reg, companies, "greenhouse"), "name", "token") == [("Acme", "acme"), ("Gamma", "gamma")]
    pages_df = spark.createDataFrame([(1, "A", "u1"), (2, "a ", "u2"), (3, "B", "u1"), (4, "C", "u2"), (5, " ", "u9")], ["seq", "name", "url"])
    assert values(registry.page_targets(pages_df), "seq") == [(1,), (4,)]


def test_text_helpers(spark):
    assert one(spark, text.company_slug(F.lit(" Fly.io, Inc. "))) == "fly-io-inc"
    assert one(spark, text.job_slug(F.lit("Sr. C++ / Go Engineer!"))) == "sr-c-go-engineer"
    assert one(spark, text.source_host(F.lit("https://www.jobs.acme.com/x"))) == "acme.com"
    assert one(spark, text.distinct_ignoring_case(F.array(*map(F.lit, [" Go", "go", "", "Rust "])))) == ["Go", "Rust"]
    for base, href, want in [
        ("https://a.b/c/d?q=1", "e", "https://a.b/c/e"), ("https://a.b/c/d", "/e", "https://a.b/e"), ("https://a.b", "e", "https://a.b/e"),
        ("https://a.b/c", "//x.y/z", "https://x.y/z"), ("https://a.b/c", "", "https://a.b/c"), ("https://a.b/c?d#e", "#f", "https://a.b/c?d#f"),
    ]:
        assert one(spark, text.absolute_url(F.lit(base), F.lit(href))) == want
    for raw, want in [
        ("2024-01-05T10:00:00-05:00", datetime(2024, 1, 5, 15)), ("Fri, 19 Jan 2024 10:00:00 +0200", datetime(2024, 1, 19, 8)), ("January 5, 2024", datetime(2024, 1, 5)),
        ("2024-01-05", datetime(2024, 1, 5)), ("2024-01-05T10:00:00.123Z", datetime(2024, 1, 5, 10, 0, 0, 123000)), ("soon", None), ("", None),
    ]:
        assert one(spark, parse_instant(F.lit(raw))) == want, raw
    assert one(spark, fund.parse_money(F.lit("$1,250.5"))) == 1250.5
    assert one(spark, fund.parse_money(F.lit("N/A"))) is None


def test_title_rules(spark):
    for title, kind, level in [
        ("Principal Platform Engineer", "infra", "principal"), ("Sr Full-Stack Engineer", "fullstack", "senior"), ("Team Lead, Storage", "distributed", "lead"),
        ("Associate React Developer", "frontend", "junior"), ("Software Engineer", "backend", "mid"), ("Cook", "unknown", "mid"),
    ]:
        assert one(spark, titles.role_type(F.lit(title))) == kind, title
        assert one(spark, titles.seniority(F.lit(title))) == level, title
    stack = one(spark, titles.tech_stack(F.lit("We use Google Cloud and REST")))
    assert stack.languages == ["go"] and stack.frameworks == ["rest"]
    assert one(spark, titles.tech_stack(F.lit("We use Google Cloud"), whole_word=True)).languages == []


def test_heading_jobs_and_long_pages_pass_through_career_pages(spark):
    head = "<html><h3>Software Engineer, Growth</h3><p><a href='/jobs/1'>apply</a></p></html>"
    long = "".join(f"<p><a href='/x/{k}'>nothing {k}</a></p>" for k in range(30_000)) + "<h3>Backend Engineer, Platform</h3><a href='/jobs/2'>apply</a>"
    rows = [(1, "Acme", "https://acme.example/careers", head), (2, "Beta", "https://beta.example/careers", long)]
    crawled = spark.createDataFrame(rows, "page_id long, company_name string, url string, html string")
    staged = pages.career_pages(crawled, None, "2024-01-20 06:00:00")
    got = sorted((r.company_name, r.title, r.url) for r in staged.roles.collect())
    assert got == [("Acme", "Software Engineer, Growth", "https://acme.example/jobs/1"), ("Beta", "Backend Engineer, Platform", "https://beta.example/jobs/2")]


def test_character_references_are_decoded_once(spark):
    from tideline.functions.text import unescape

    texts = ["&#34;a&#x22; &eacute;&amp;lt; & &nothing; &#99999999; AT&T &hellip;", "plain", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(unescape(F.col("t"))).collect()]
    assert got == ['"a" é&lt; & &nothing; � AT&T …'.replace('"a" ', '"a" ').replace("\"a\"", "\"a\""), "plain", None]


def test_many_references_are_decoded_in_time(spark):
    import time

    from tideline.functions.text import unescape

    times = 100_000
    heavy = spark.range(1).select(F.repeat(F.lit("&zwnj;x&quot;&amp;quot;"), times).alias("t"))
    start = time.perf_counter()
    got = heavy.select(unescape(F.col("t")).alias("t")).first().t
    assert got == '\u200cx"&quot;' * times
    assert time.perf_counter() - start < 5


def test_strings_of_deeply_nested_lists(spark):
    rows = [("plain", ["plain"]), ('["a", ["b", ["c", ["d", {"label": "e"}], []]], null]', ["a", "b", "c", "d", "e"]), ("[" * 9 + '"x"' + "]" * 9, ["x"]), ("[not a list", ["[not a list"]), (None, [])]
    df = spark.createDataFrame([(k, v) for k, (v, _) in enumerate(rows)], "k int, value string")
    got = {r.k: r.s for r in df.select("k", boards.strings_in(F.col("value")).alias("s")).collect()}
    assert got == {k: want for k, (_, want) in enumerate(rows)}


def test_common_feed_dates_need_no_formatter(spark):
    texts = {
        "Mon, 06 Jan 2024 10:00:00 +0000": datetime(2024, 1, 6, 10), "6 Jan 2024 10:00:00 -0530": datetime(2024, 1, 6, 15, 30),
        "29 Feb 2024 23:59:59 +0100": datetime(2024, 2, 29, 22, 59, 59), "29 Feb 2023 10:00:00 +0000": None, "31 Apr 2024 10:00:00 +0000": None,
        "1 Jan 2024 24:00:00 +0000": None, "1 Jan 2024 10:00:60 +0000": None, "06 Jan 2024 10:00:00 +0000\n": None, "06 Jan 2024 10:00:00 GMT": datetime(2024, 1, 6, 10),
    }
    rows = spark.createDataFrame([(t,) for t in texts], "s string")
    assert {r.s: r.at for r in rows.select("s", parse_instant(F.col("s")).alias("at")).collect()} == texts
    # The common form is read by its places; the text's clean-up is worked out once.
    plan = rows.select(parse_instant(F.concat("s", F.lit("")))).toDF("at")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 1 and "try_make_timestamp" in plan.lower().replace("maketimestamp", "make_timestamp").replace("trymake", "try_make")
