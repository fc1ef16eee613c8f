"""Company and role scores.

Children are reduced to one row per company before any join, so the joins run on
companies and never on raw signals or roles.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.clock import age_days, instant, linear_decay
from tideline.functions.labels import lookup, urgency_label
from tideline.functions.numbers import half_up, truthy


@dataclass(frozen=True)
class Profile:
    """What the user of the scores looks for. The defaults are fixed values."""

    primary_skills: tuple[str, ...] = (
        "go", "golang", "python", "rust", "distributed systems", "backend", "fastapi", "grpc",
    )
    secondary_skills: tuple[str, ...] = (
        "typescript", "javascript", "sql", "postgres", "redis", "docker", "kubernetes",
    )
    preferred_domains: tuple[str, ...] = ("distributed", "ai_ml", "infra", "backend", "platform", "fullstack")
    target_seniority: tuple[str, ...] = ("senior", "mid", "staff", "lead")
    preferred_stages: tuple[str, ...] = ("seed", "series_a", "series_b")
    fit_weight: float = 0.60
    urgency_weight: float = 0.40

    @property
    def skills(self) -> tuple[str, ...]:
        return self.primary_skills + self.secondary_skills


# --- per-company inputs (A13) -------------------------------------------------


def role_inputs(role_state: DataFrame, profile: Profile, skills: DataFrame | None, max_roles: int | None = None) -> DataFrame:
    """Active roles of a company: distinct types, matched profile skills, newest
    and oldest. Skills are cut down to the profile before they are collected, so
    the sets have a fixed bound. ``max_roles`` looks at the best roles only (Q10)."""
    active = role_state.where("is_active")
    if max_roles is not None:
        best = Window.partitionBy("company_id").orderBy(F.desc("fit_score"), "days_open", "role_id")
        active = active.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= max_roles)
    facts = active.groupBy("company_id").agg(
        F.sort_array(F.collect_set("role_type")).alias("role_types"),
        F.max("first_seen_at").alias("last_role_posted"),
        F.count(F.lit(1)).alias("active_roles"),
        F.max("days_open").alias("oldest_open_days"),
    )
    if max_roles is not None:
        # The oldest open role is taken over all active roles, whatever max_roles says.
        oldest = role_state.where("is_active").groupBy("company_id").agg(F.max("days_open").alias("oldest_open_days"))
        facts = facts.drop("oldest_open_days").join(oldest, "company_id")
    if skills is None:
        return facts.withColumn("skills", F.array().cast("array<string>"))
    wanted = skills.select("role_id", F.lower("skill").alias("skill")).where(F.col("skill").isin(*profile.skills))
    matched = (
        wanted.join(active.select("role_id", "company_id"), "role_id")
        .groupBy("company_id")
        .agg(F.sort_array(F.collect_set("skill")).alias("skills"))
    )
    return facts.join(matched, "company_id", "left").withColumn(
        "skills", F.coalesce("skills", F.array().cast("array<string>"))
    )


def signal_inputs(signals: DataFrame) -> DataFrame:
    """Signals of a company by kind: latest dates, the latest round's amount
    (Q11, ties to the larger amount), best spike sigma (Q13), blog posts (Q19)."""
    at, kind = F.col("signal_date"), F.col("type")
    amount = F.col("funding_amount_usd")
    sigma = F.col("sigma") if "sigma" in signals.columns else F.col("score") / 10
    return signals.groupBy("company_id").agg(
        F.max(F.when(kind == "funding", F.struct(at, F.coalesce(amount, F.lit(-1.0)), amount.alias("amount")))).alias("round"),
        F.max(F.when(kind == "founder_post", at)).alias("founder_post_date"),
        F.max(F.when(kind == "github_spike", at)).alias("spike_date"),
        F.max(F.when(kind == "github_spike", sigma)).alias("spike_sigma"),
        F.coalesce(F.bool_or(kind == "founder_post"), F.lit(False)).alias("has_founder_post"),
        F.coalesce(F.bool_or(kind == "blog_post"), F.lit(False)).alias("has_engineering_blog"),
    )


def merged_signal_inputs(stored: DataFrame, added: DataFrame) -> DataFrame:
    """What `signal_inputs` gives over the signals behind both tables: each of its values
    is a largest one or a flag, so rows of a company merge without their signals."""
    largest = ("round", "founder_post_date", "spike_date", "spike_sigma")
    both = stored.unionByName(added.select(*stored.columns))
    return both.groupBy("company_id").agg(*[F.max(c).alias(c) for c in largest], *[F.bool_or(c).alias(c) for c in ("has_founder_post", "has_engineering_blog")])


def scoring_inputs(
    companies: DataFrame, role_state: DataFrame, signals: DataFrame | None, skills: DataFrame | None = None,
    profile: Profile = Profile(), max_roles: int | None = None, facts: DataFrame | None = None,
) -> DataFrame:
    """One row per company with everything the scores need. ``facts``: the signals'
    part where it is known already."""
    stored_date = F.col("last_funding_date") if "last_funding_date" in companies.columns else F.lit(None).cast("timestamp_ntz")
    return (
        companies.join(role_inputs(role_state, profile, skills, max_roles), "company_id", "left")
        .join(signal_inputs(signals) if facts is None else facts, "company_id", "left")
        .withColumns(
            {
                "last_funding_date": F.coalesce("round.signal_date", stored_date),
                "last_funding_amount": F.when(F.col("round").isNotNull(), F.col("round.amount")).otherwise(
                    F.col("funding_amount_usd")
                ),
                "role_types": F.coalesce("role_types", F.array().cast("array<string>")),
                "skills": F.coalesce("skills", F.array().cast("array<string>")),
                "oldest_open_days": F.coalesce("oldest_open_days", F.lit(0)),
                "active_roles": F.coalesce("active_roles", F.lit(0)),
                "spike_sigma": F.coalesce("spike_sigma", F.lit(0.0)),
                "has_founder_post": F.coalesce("has_founder_post", F.lit(False)),
                "has_engineering_blog": F.coalesce("has_engineering_blog", F.lit(False)),
            }
        )
        .drop("round")
    )


# --- fit (C1, C2) ---------------------------------------------------------------


def stack_points(skills: Column, profile: Profile) -> Column:
    """Primary hits 8 each up to 28, secondary 2 each up to 7; 5 without any."""

    def hits(names: tuple[str, ...]) -> Column:
        return sum((F.array_contains(skills, n).cast("int") for n in names), F.lit(0))

    primary, secondary = hits(profile.primary_skills), hits(profile.secondary_skills)
    points = F.least(primary * 8, F.lit(28)) + F.least(secondary * 2, F.lit(7))
    return F.when(primary + secondary == 0, 5.0).otherwise(points.cast("double"))


def domain_points(role_types: Column, profile: Profile) -> Column:
    """Best preferred domain among the types; 4 points per rank from the end, 5
    for any other, at most 25; 8 without types."""
    domains = profile.preferred_domains
    value = {d: (len(domains) - i) * 4 for i, d in enumerate(domains)}
    per_type = F.transform(role_types, lambda t: lookup(t, value, F.lit(5)))
    best = F.least(F.array_max(per_type), F.lit(25)).cast("double")
    return F.when(F.size(role_types) > 0, best).otherwise(8.0)


def culture_points(remote: Column, blog: Column, stage: Column, headcount: Column, profile: Profile) -> Column:
    total = (
        F.when(remote, 8.0).otherwise(0.0)
        + F.when(blog, 5.0).otherwise(0.0)
        + F.when(stage.isin(*profile.preferred_stages), 4.0).otherwise(0.0)
        + F.when(truthy(headcount) & (headcount < 100), 3.0).otherwise(0.0)
    )
    return F.least(total, F.lit(20.0))


def fit_columns(profile: Profile) -> dict[str, Column]:
    """C1 over the columns of `scoring_inputs`."""
    remote, blog = F.coalesce("remote_us", F.lit(False)), F.col("has_engineering_blog")
    stage, headcount = F.coalesce("funding_stage", F.lit("unknown")), F.col("headcount")
    notes = F.array_compact(
        F.array(
            F.when(F.size(F.array_intersect("skills", F.array(*map(F.lit, profile.skills)))) == 0, F.lit("No direct stack overlap detected")),
            F.when(remote, F.lit("Remote US role")),
            F.when(blog, F.lit("Active engineering blog")),
            F.when(stage.isin(*profile.preferred_stages), F.concat(F.lit("Preferred stage: "), stage)),
            F.when(truthy(headcount) & (headcount < 100), F.format_string("Small team (%d)", headcount.cast("long"))),
        )
    )
    return {
        "stack_match": stack_points(F.col("skills"), profile),
        "domain_match": domain_points(F.col("role_types"), profile),
        "seniority_match": F.lit(15.0),
        "culture_proxy": culture_points(remote, blog, stage, headcount, profile),
        "matching_skills": F.filter(F.array(*map(F.lit, profile.skills)), lambda s: F.array_contains("skills", s)),
        "fit_notes": notes,
    }


FIT_PARTS = ("stack_match", "domain_match", "seniority_match", "culture_proxy")


def total_of(parts: tuple[str, ...]) -> Column:
    return F.least(sum((F.col(p) for p in parts[1:]), F.col(parts[0])), F.lit(100.0))


def role_fit_parts(skills: Column, profile: Profile) -> dict[str, Column]:
    """C2 over the columns of a role; ``skills`` is its array of lower-case skills."""
    level = F.coalesce("seniority", F.lit("unknown"))
    seniority = (
        F.when(level.isin(*profile.target_seniority), 20.0)
        .when(level.isin("mid", "unknown"), 14.0)
        .when(level == "junior", 5.0)
        .otherwise(10.0)
    )
    return {
        "stack_match": stack_points(skills, profile),
        "domain_match": domain_points(F.array(F.coalesce("role_type", F.lit("unknown"))), profile),
        "seniority_match": seniority,
        "culture_proxy": F.when(F.col("is_remote_us"), 8.0).otherwise(0.0),
    }


def role_fit(roles: DataFrame, skills: DataFrame | None = None, profile: Profile = Profile()) -> DataFrame:
    """Every role with its fit score and parts. ``skills`` is the long table
    (role_id, skill); without it the roles' own ``required_skills`` are used, and
    nothing is shuffled."""
    none = F.array().cast("array<string>")
    if skills is None:
        own = F.transform(F.coalesce("required_skills", none), lambda s: F.lower(s))
        with_skills = roles.withColumn("skills", own)
    else:
        wanted = skills.select("role_id", F.lower("skill").alias("skill")).where(F.col("skill").isin(*profile.skills))
        matched = wanted.groupBy("role_id").agg(F.sort_array(F.collect_set("skill")).alias("skills"))
        with_skills = roles.join(matched, "role_id", "left").withColumn("skills", F.coalesce("skills", none))
    parts = with_skills.drop("fit_score").withColumns(role_fit_parts(F.col("skills"), profile))
    return parts.withColumn("fit_score", total_of(FIT_PARTS))


# --- urgency (C3) -----------------------------------------------------------------


def urgency_columns(now: Column) -> dict[str, Column]:
    """C3 over the columns of `scoring_inputs`."""
    amount, sigma, open_days = F.col("last_funding_amount"), F.col("spike_sigma"), F.col("oldest_open_days")
    funded_days = F.greatest(age_days(F.col("last_funding_date"), now), F.lit(0))
    base = (
        F.when(~truthy(amount), 30.0).when(amount >= 50_000_000, 30.0).when(amount >= 20_000_000, 26.0).otherwise(20.0)
    )
    spike = (F.lit(5.0) + F.least((sigma - 2.0) * 2, F.lit(5.0))) * linear_decay(age_days(F.col("spike_date"), now), 7)
    posted = F.lit(20.0) * linear_decay(age_days(F.col("last_role_posted"), now), 30)
    founder = F.when(
        F.col("has_founder_post"),
        F.coalesce(F.lit(25.0) * linear_decay(age_days(F.col("founder_post_date"), now), 14), F.lit(15.0)),
    )
    aging = F.when(
        open_days.between(20, 60), F.least(F.lit(15.0) * ((open_days - 20) / F.lit(40.0)), F.lit(15.0))
    ).when(open_days > 60, 5.0)
    zero = F.lit(0.0)
    return {
        "funding_points": F.when(F.col("last_funding_date").isNotNull(), base * linear_decay(funded_days, 60)).otherwise(zero),
        "founder_post_points": F.coalesce(founder, zero),
        "new_role_points": F.when(F.col("last_role_posted").isNotNull(), posted).otherwise(zero),
        "role_aging_points": F.coalesce(aging, zero),
        "github_points": F.when(F.col("spike_date").isNotNull() & (sigma >= 2.0), spike).otherwise(zero),
    }


URGENCY_PARTS = ("funding_points", "founder_post_points", "new_role_points", "role_aging_points", "github_points")


# --- composite (C4-C6) --------------------------------------------------------------


def score_companies(inputs: DataFrame, as_of: str, profile: Profile = Profile()) -> DataFrame:
    """C4: fit, urgency and composite of every row of `scoring_inputs`, with parts."""
    parts = inputs.withColumns(fit_columns(profile)).withColumns(urgency_columns(instant(as_of)))
    totals = parts.withColumns({"fit_total": total_of(FIT_PARTS), "urgency_total": total_of(URGENCY_PARTS)})
    # Fit is a whole number, so its weighted value is a short decimal: the product of doubles may
    # lie below it, and then a sum that ends in 5 is rounded down (31 * 0.6 + 0.375 * 0.4 = 18.75).
    fit = (F.col("fit_total").cast("decimal(20,6)") * F.lit(Decimal(str(profile.fit_weight)))).cast("double")
    composite = fit + F.col("urgency_total") * profile.urgency_weight
    scored = {
        "fit_score": half_up(F.col("fit_total"), 1),
        "urgency_score": half_up(F.col("urgency_total"), 1),
        "composite_score": half_up(composite, 1),
        "urgency_label": urgency_label(F.col("urgency_total")),
        "fit_breakdown": F.struct(*FIT_PARTS, F.col("fit_total").alias("total"), "matching_skills", F.col("fit_notes").alias("notes")),
        "urgency_breakdown": F.struct(*URGENCY_PARTS, F.col("urgency_total").alias("total")),
    }
    return totals.withColumns(scored)


def blend(heuristic: Column, model: Column, weight: float = 0.25) -> Column:
    """A missing model score leaves the heuristic."""
    return half_up(F.coalesce((1.0 - weight) * heuristic + weight * model, heuristic), 1)


def rescore(
    companies: DataFrame, role_state: DataFrame, signals: DataFrame | None, as_of: str, skills: DataFrame | None = None,
    predictions: DataFrame | None = None, affected: DataFrame | None = None, profile: Profile = Profile(),
    model_weight: float = 0.25, max_roles: int | None = None, facts: DataFrame | None = None,
) -> DataFrame:
    """Scores of all companies, or of the ``affected`` ones (company_id) only;
    their children are reduced to the same companies before the aggregates."""
    if affected is not None:
        keys = affected.select("company_id").distinct()
        companies = companies.join(keys, "company_id", "left_semi")
        role_state = role_state.join(keys, "company_id", "left_semi")
        signals = signals.join(keys, "company_id", "left_semi") if signals is not None else None
    scored = score_companies(scoring_inputs(companies, role_state, signals, skills, profile, max_roles, facts), as_of, profile)
    if predictions is None:
        return scored.withColumn("model_score", F.lit(None).cast("double")).withColumn(
            "composite_score", blend(F.col("composite_score"), F.col("model_score"), model_weight)
        )
    return scored.join(predictions.select("company_id", "model_score"), "company_id", "left").withColumn(
        "composite_score", blend(F.col("composite_score"), F.col("model_score"), model_weight)
    )
