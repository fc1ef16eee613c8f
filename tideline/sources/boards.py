"""Job-board payloads to staging frames.

Input is always a landing table with one payload per row: ``landed`` (bigint,
landing order), ``company_name``, ``token`` and ``body`` (text). Fetching is the
lander's work. Rows keep their place as ``seq`` = (landed, position in payload).
Where roles, signals and batches read the same jobs, payloads are parsed once and the
jobs stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions import funding, lexicons as lex, titles
from tideline.functions.clock import instant, parse_instant
from tideline.functions.scores import ashby_score
from tideline.functions.text import absolute_url, nonblank, unescape
from tideline.operators.activity import batch_postings, boost_same_day
from tideline.operators.filters import is_recent
from tideline.operators.ranking import first_wins
from tideline.schemas import Staged
from tideline.session import stored


def place(landed: str = "landed", pos: str = "pos") -> Column:
    return F.struct(F.col(landed).cast("bigint").alias("landed"), F.col(pos).cast("int").alias("pos"))


def text_or_blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def with_role_columns(df: DataFrame, title: Column, description: Column) -> DataFrame:
    """Role type, seniority, stack and skills of a posting."""
    out = titles.with_tech_stack(df, description)
    return out.withColumns(
        {"role_type": titles.role_type(title), "seniority": titles.seniority(title), "required_skills": F.col("tech_stack.languages")}
    )


def headline_of(title: Column, location: Column) -> Column:
    return F.concat(title, F.lit(" — "), F.coalesce(F.nullif(location, F.lit("")), F.lit("Remote")))


def _with_batches(signals: DataFrame, jobs: DataFrame, kind: str, as_of: str) -> DataFrame:
    """Batch-posting signals (A10) and the same-day boost on top of ``signals``."""
    recent = jobs.where(is_recent(F.col("dated"), instant(as_of))).select("company_name", "title", "seq", "board_url")
    boards = recent.groupBy("company_name").agg(F.min("board_url").alias("source_url"))
    batches = (
        batch_postings(recent, "seq")
        .join(boards, "company_name")
        .select(
            "company_name", F.lit(kind).alias("type"), "headline", "source_url", "score",
            F.lit("Batch posting: several roles opened within two days.").alias("detail"),
            instant(as_of).alias("signal_date"),
            F.struct(F.lit(2**62).alias("landed"), F.lit(0).alias("pos")).alias("seq"),
        )
    )
    return boost_same_day(signals.unionByName(batches, allowMissingColumns=True), as_of)


GREENHOUSE_BODY = "jobs array<struct<id:string,title:string,content:string,updated_at:string,location:struct<name:string>>>"


def greenhouse(landed: DataFrame, as_of: str) -> Staged:
    """S1"""
    parsed = landed.withColumn("body", F.from_json("body", GREENHOUSE_BODY))
    board = F.concat(F.lit("https://boards.greenhouse.io/"), F.col("token"))
    companies = parsed.where("body IS NOT NULL").select(
        F.col("company_name").alias("name"), board.alias("career_page_url"),
        F.struct(F.col("landed").cast("bigint").alias("landed"), F.lit(-1).alias("pos")).alias("seq"),
    )
    jobs = (
        parsed.select("landed", "company_name", "token", board.alias("board_url"), F.posexplode("body.jobs").alias("pos", "job"))
        .select(
            "company_name", "board_url", place().alias("seq"),
            F.trim(text_or_blank(F.col("job.title"))).alias("title"),
            F.concat(F.lit("https://job-boards.greenhouse.io/"), F.col("token"), F.lit("/jobs/"), text_or_blank(F.col("job.id"))).alias("url"),
            text_or_blank(F.col("job.content")).alias("description_raw"),
            text_or_blank(F.col("job.location.name")).alias("location"),
            F.col("job.id").alias("external_id"),
            parse_instant(F.col("job.updated_at")).alias("dated"),
        )
        .where(titles.is_target(F.col("title")))
    )
    jobs = stored(jobs, "greenhouse-jobs")
    remote, remote_us = titles.remote_flags("greenhouse", F.col("location"))
    roles = with_role_columns(jobs, F.col("title"), F.col("description_raw")).withColumns(
        {"is_remote": remote, "is_remote_us": remote_us, "source": F.lit("ats_greenhouse")}
    )
    signals = roles.select(
        "company_name", F.lit("ats_greenhouse").alias("type"), headline_of(F.col("title"), F.col("location")).alias("headline"),
        F.concat(F.lit("Public board posting · "), F.col("role_type"), F.lit(" role")).alias("detail"),
        F.col("url").alias("source_url"), F.coalesce("dated", instant(as_of)).alias("signal_date"),
        F.lit(lex.SOURCE_SCORES["greenhouse_job"]).alias("score"), "seq",
    )
    return Staged.of("greenhouse", companies, _with_batches(signals, jobs, "ats_greenhouse", as_of), roles)


ASHBY_BODY = (
    "jobBoard struct<jobBoardUrl:string>, jobs array<struct<id:string,title:string,descriptionHtml:string,"
    "description:string,location:string,locationName:string,isRemote:boolean,publishedAt:string>>"
)


def ashby(landed: DataFrame, as_of: str) -> Staged:
    """S2"""
    parsed = landed.withColumn("body", F.from_json("body", ASHBY_BODY))
    board = F.coalesce("body.jobBoard.jobBoardUrl", F.concat(F.lit("https://jobs.ashbyhq.com/"), F.col("token")))
    companies = parsed.where("body IS NOT NULL").select(
        F.col("company_name").alias("name"), board.alias("career_page_url"),
        F.struct(F.col("landed").cast("bigint").alias("landed"), F.lit(-1).alias("pos")).alias("seq"),
    )
    jobs = (
        parsed.select("landed", "company_name", "token", board.alias("board_url"), F.posexplode("body.jobs").alias("pos", "job"))
        .select(
            "company_name", "board_url", place().alias("seq"),
            F.trim(text_or_blank(F.col("job.title"))).alias("title"),
            F.concat(F.lit("https://jobs.ashbyhq.com/"), F.col("token"), F.lit("/"), text_or_blank(F.col("job.id"))).alias("url"),
            text_or_blank(F.coalesce(F.nullif(F.col("job.descriptionHtml"), F.lit("")), F.col("job.description"))).alias("full_text"),
            text_or_blank(F.coalesce(F.nullif(F.col("job.location"), F.lit("")), F.col("job.locationName"))).alias("location"),
            F.col("job.id").alias("external_id"),
            F.col("job.isRemote").alias("declared"),
            parse_instant(F.col("job.publishedAt")).alias("dated"),
        )
        .where(titles.is_target(F.col("title")))
    )
    jobs = stored(jobs, "ashby-jobs")
    remote, remote_us = titles.remote_flags("ashby", F.col("location"), F.col("declared"))
    roles = with_role_columns(jobs, F.col("title"), F.col("full_text")).withColumns(
        {
            "is_remote": remote, "is_remote_us": remote_us, "source": F.lit("ats_ashby"),
            "description_raw": F.col("full_text"),
        }
    )
    now = instant(as_of)
    at = F.coalesce("dated", now)
    signals = roles.select(
        "company_name", F.lit("ats_ashby").alias("type"), headline_of(F.col("title"), F.col("location")).alias("headline"),
        F.concat(F.lit("Public board posting · "), F.col("role_type"), F.lit(" role")).alias("detail"),
        F.col("url").alias("source_url"), at.alias("signal_date"), ashby_score(at, now).alias("score"), "seq",
    )
    return Staged.of("ashby", companies, _with_batches(signals, jobs, "ats_ashby", as_of), roles)


# Polymorphic fields are declared as text: Spark then keeps the JSON of a list or
# an object as it is, and the field is taken apart by `strings_in`.
PORTFOLIO_BODY = (
    "jobs array<struct<title:string,companyName:string,url:string,applyUrl:string,requiredSkills:string,"
    "preferredSkills:string,markets:string,locations:string,normalizedLocations:string,remote:boolean,hybrid:boolean,"
    "fundingLV:string,timeStamp:string>>"
)


def _named(item: Column) -> Column:
    """An object's first non-blank of label, name, value, title; text as it is."""
    fields = F.from_json(item, "label string, name string, value string, title string")
    from_object = F.coalesce(*[nonblank(fields[k]) for k in ("label", "name", "value", "title")])
    return F.when(item.startswith("{"), from_object).otherwise(nonblank(item))


def _items(value: Column) -> Column:
    """A list's items, or the value as the only item."""
    listed = F.when(value.startswith("["), F.from_json(value, "array<string>"))
    return F.coalesce(listed, F.array(value))


def strings_in(value: Column) -> Column:
    """S3: all strings of a text, object or list field, however deep lists nest."""
    opened = lambda items: F.flatten(F.transform(items, _items))
    # no list nests deeper than its opening brackets are many
    turns = F.sequence(F.lit(0), F.coalesce(F.regexp_count(value, F.lit(r"\[")), F.lit(0)))
    flat = F.aggregate(turns, _items(value), lambda items, _: F.when(F.exists(items, lambda item: item.startswith("[")), opened(items)).otherwise(items))
    return F.array_compact(F.transform(flat, _named))


def portfolio(landed: DataFrame, as_of: str) -> Staged:
    """S3: board pages; ``board_url`` and ``board_name`` name the board."""
    parsed = landed.withColumn("body", F.from_json("body", PORTFOLIO_BODY))
    raw = parsed.select("landed", "board_url", "board_name", F.posexplode("body.jobs").alias("pos", "job")).select(
        "board_url", "board_name", place().alias("seq"),
        nonblank(F.col("job.title")).alias("title"),
        nonblank(F.col("job.companyName")).alias("company_name"),
        absolute_url(F.col("board_url"), F.coalesce(nonblank(F.col("job.url")), nonblank(F.col("job.applyUrl")))).alias("url"),
        F.coalesce(nonblank(F.col("job.url")), nonblank(F.col("job.applyUrl"))).alias("given_url"),
        F.concat(
            F.coalesce(strings_in(F.col("job.requiredSkills")), F.array().cast("array<string>")),
            F.coalesce(strings_in(F.col("job.preferredSkills")), F.array().cast("array<string>")),
        ).alias("skills"),
        F.coalesce(strings_in(F.col("job.markets")), F.array().cast("array<string>")).alias("markets"),
        F.coalesce(strings_in(F.col("job.locations")), F.array().cast("array<string>")).alias("places"),
        F.from_json("job.normalizedLocations", "array<struct<name:string,country:string>>").alias("normalized"),
        F.coalesce("job.remote", F.lit(False)).alias("declared"),
        F.coalesce("job.hybrid", F.lit(False)).alias("hybrid"),
        funding.label_stage(
            F.when(F.col("job.fundingLV").startswith("{"), F.get_json_object("job.fundingLV", "$.label")).otherwise(F.col("job.fundingLV"))
        ).alias("funding_stage"),
        parse_instant(F.col("job.timeStamp")).alias("dated"),
    )
    complete = raw.where("title IS NOT NULL AND company_name IS NOT NULL AND given_url IS NOT NULL")
    labels = F.filter(
        F.transform("normalized", lambda n: F.array_join(F.array_compact(F.array(nonblank(n["name"]), nonblank(n["country"]))), ", ")),
        lambda label: label != "",
    )
    where = F.coalesce(
        F.nullif(F.array_join(F.col("places"), ", "), F.lit("")), F.array_join(labels, ", "), F.lit("")
    )
    located = complete.withColumn("place_text", where)
    remote, _ = titles.remote_flags("portfolio", F.col("place_text"), F.col("declared"))
    summary = F.array_join(
        F.array_compact(
            F.array(
                F.when(F.size("markets") > 0, F.concat(F.lit("Markets: "), F.array_join(F.col("markets"), ", "))),
                F.when(F.size("skills") > 0, F.concat(F.lit("Skills: "), F.array_join(F.col("skills"), ", "))),
            )
        ),
        " | ",
    )
    # One row per url: the first in landing order.
    jobs = first_wins(located, ["url"], ["seq"]).where(titles.is_target(F.col("title"))).withColumns(
        {
            "remote": remote,
            "location": F.when(F.col("hybrid") & (F.col("place_text") != ""), F.concat("place_text", F.lit(" · Hybrid"))).otherwise(F.col("place_text")),
            "description": summary,
        }
    )
    jobs = titles.with_tech_stack(jobs, F.concat_ws(" ", F.col("title"), F.col("description"), F.array_join("skills", " ")))
    companies = jobs.select(
        F.col("company_name").alias("name"), F.col("board_url").alias("career_page_url"), "funding_stage",
        F.col("remote").alias("remote_friendly"), F.col("remote").alias("remote_us"), "tech_stack", "seq",
    )
    # A company is described by its first job of the batch.
    companies = first_wins(companies, ["name"], ["seq"])
    roles = jobs.select(
        "company_name", "title", "url", F.lit("career_page").alias("source"), F.col("description").alias("description_raw"),
        titles.role_type(F.col("title")).alias("role_type"), titles.seniority(F.col("title")).alias("seniority"),
        F.col("remote").alias("is_remote"), F.col("remote").alias("is_remote_us"), "location", "tech_stack",
        F.col("skills").alias("required_skills"), "seq",
    )
    signals = jobs.select(
        "company_name", F.lit("career_page").alias("type"),
        F.concat("title", F.lit(" listed on "), "board_name").alias("headline"),
        F.concat(F.lit("Captured from "), "board_name").alias("detail"),
        F.col("url").alias("source_url"), F.coalesce(F.nullif("description", F.lit("")), "title").alias("raw_content"),
        F.coalesce("dated", instant(as_of)).alias("signal_date"),
        F.when(F.col("remote"), lex.SOURCE_SCORES["portfolio_remote"]).otherwise(lex.SOURCE_SCORES["portfolio_onsite"]).alias("score"),
        "seq",
    )
    return Staged.of("portfolio_boards", companies, signals, roles)


LISTING_BODY = (
    "props struct<jobs:array<struct<id:string,title:string,companySlug:string,companyName:string,companyOneLiner:string,"
    "companyBatch:string,roleType:string,jobType:string,location:string>>>"
)
LISTING_TAG = r"""(?s)<div\b[^>]*\bid=["']jobs/public/pages/JobsPage-react-component[^>]*>"""
LISTING_DATA = r"""(?s)\bdata-page=(?:"([^"]*)"|'([^']*)')"""


def listing(landed: DataFrame, as_of: str) -> Staged:
    """Listing pages with the jobs as JSON in an attribute."""
    tagged = landed.withColumn("tag", F.regexp_extract("body", LISTING_TAG, 0))
    data = F.coalesce(F.nullif(F.regexp_extract("tag", LISTING_DATA, 1), F.lit("")), F.regexp_extract("tag", LISTING_DATA, 2))
    parsed = tagged.withColumn("page", F.from_json(unescape(data), LISTING_BODY))
    jobs = (
        parsed.select("landed", F.posexplode("page.props.jobs").alias("pos", "job"))
        .select(
            place().alias("seq"),
            F.trim(text_or_blank(F.col("job.title"))).alias("title"),
            F.trim(text_or_blank(F.col("job.companySlug"))).alias("listing_slug"),
            F.trim(text_or_blank(F.col("job.companyName"))).alias("company_name"),
            text_or_blank(F.col("job.companyOneLiner")).alias("one_liner"),
            text_or_blank(F.col("job.location")).alias("location"),
            F.col("job.roleType").alias("listed_type"),
            F.col("job.jobType").alias("employment"),
            text_or_blank(F.col("job.id")).alias("external_id"),
        )
        .where(titles.is_listing_target(F.col("title"), F.col("listed_type"), F.col("employment")))
        .where("listing_slug <> '' AND company_name <> ''")
    )
    remote, remote_us = titles.remote_flags("listing", F.col("location"))
    roles = titles.with_tech_stack(jobs, F.col("one_liner")).withColumns(
        {
            "url": F.when(F.col("external_id") != "", F.concat(F.lit("https://www.workatastartup.com/jobs/"), "external_id")).otherwise(""),
            "role_type": titles.listing_role_type(F.col("title"), F.col("listed_type")),
            "seniority": titles.seniority(F.col("title")),
            "is_remote": remote,
            "is_remote_us": remote_us,
            "source": F.lit("yc_jobs"),
            "description_raw": F.col("one_liner"),
            "required_skills": F.col("tech_stack.languages"),
        }
    )
    companies = (
        roles.groupBy("listing_slug")
        .agg(
            F.min_by("company_name", "seq").alias("name"),
            F.min_by("one_liner", "seq").alias("description"),
            F.bool_or("is_remote").alias("remote_friendly"),
            F.bool_or("is_remote_us").alias("remote_us"),
            F.min("seq").alias("seq"),
        )
        .withColumns(
            {
                "career_page_url": F.concat(F.lit("https://www.workatastartup.com/companies/"), "listing_slug"),
                "hq_country": F.lit("United States"),
            }
        )
    )
    companies = titles.with_tech_stack(companies, F.col("description"))
    signals = roles.select(
        "company_name", F.lit("yc_jobs").alias("type"), headline_of(F.col("title"), F.col("location")).alias("headline"),
        F.concat(F.lit("Accelerator listing · "), F.col("role_type"), F.lit(" role")).alias("detail"),
        F.col("url").alias("source_url"), instant(as_of).alias("signal_date"), F.lit(lex.SOURCE_SCORES["yc_job"]).alias("score"), "seq",
    )
    return Staged.of("yc_jobs", companies, signals, roles)
