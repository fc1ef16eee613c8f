"""Console scoring: personalisation, opportunity score, evidence, ranked
opportunities and company details (C7-C11, A16, O5, W5, W6).

Signals and roles are reduced to one row per company (or to a fixed number of
ranked rows) before companies are joined. Weights are summed as whole tenths, so
the sum does not depend on the order of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions import lexicons as lex
from tideline.functions.clock import instant, shift
from tideline.functions.labels import lookup, signal_type_label
from tideline.functions.numbers import clamp, count_where, half_up
from tideline.functions.titles import freshness_band, role_families, role_focus
from tideline.operators.ranking import role_order, signal_order, top_k


@dataclass(frozen=True)
class Candidate:
    """Console profile. The defaults are fixed values."""

    preferred_roles: tuple[str, ...] = ("backend", "distributed", "infra", "platform", "ai_ml")
    preferred_skills: tuple[str, ...] = (
        "python", "typescript", "node", "postgres", "docker", "kubernetes", "aws", "fastapi", "react",
    )
    preferred_stages: tuple[str, ...] = ("seed", "series a", "series b", "series c")
    remote_only: bool = True
    preferred_locations: tuple[str, ...] = ("remote",)
    target_company_ids: tuple = ()
    avoid_company_ids: tuple = ()

    def words(self, name: str) -> list[str]:
        """Trimmed, lower-cased, distinct values of a list field."""
        return list(dict.fromkeys(w for w in (v.strip().lower() for v in getattr(self, name)) if w))


def _sum(columns: list[Column], start: Column | None = None) -> Column:
    return sum(columns, start if start is not None else F.lit(0))


def _among(c: Column, values) -> Column:
    return c.isin(*values) if values else F.lit(False)


# --- signals ------------------------------------------------------------------


def signal_weight(kind: Column) -> Column:
    return lookup(kind, lex.CONSOLE_SIGNAL_WEIGHT, F.lit(lex.CONSOLE_OTHER_SIGNAL_WEIGHT))


def recency_percent(at: Column, now: Column) -> Column:
    """145 under 6 hours, 120 under 24, 100 under 72, else 65; undated is 72 hours old."""
    return F.coalesce(
        F.when(at > shift(now, hours=-6), 145).when(at > shift(now, hours=-24), 120).when(at > shift(now, hours=-72), 100),
        F.lit(65),
    )


def signal_facts(signals: DataFrame, now: Column) -> DataFrame:
    """Strength in hundredths, count and founder flag per company."""
    hundredths = signal_weight(F.col("type")) * recency_percent(F.col("signal_date"), now)
    return signals.groupBy("company_id").agg(
        F.sum(hundredths).alias("strength_hundredths"),
        F.count(F.lit(1)).alias("signal_count"),
        F.bool_or(F.col("type") == "founder_post").alias("founder"),
        F.max_by("headline", F.struct(F.col("signal_date"), -F.col("signal_id"))).alias("latest_signal"),
        F.max("signal_date").alias("latest_signal_at"),
    )


# --- roles --------------------------------------------------------------------


def role_facts(role_state: DataFrame) -> DataFrame:
    """Velocity points, counts, first role and role families per company."""
    days = F.col("days_open")
    first = F.struct(-F.col("fit_score"), days, F.col("role_id"))
    points = F.when(days <= 2, 22).when(days <= 7, 14).when(days <= 14, 7).otherwise(3)
    return (
        role_state.where("is_active")
        .groupBy("company_id")
        .agg(
            F.sum(points).alias("velocity_points"),
            F.count(F.lit(1)).alias("open_roles"),
            count_where(days <= 2).alias("fresh_roles"),
            F.min(days).alias("youngest_days"),
            F.min(F.when(days <= 2, days)).alias("youngest_fresh_days"),
            F.min_by(F.struct("title", "url", "role_type", "days_open"), first).alias("top_role"),
            F.min_by(F.when(days <= 2, F.col("role_type")), F.when(days <= 2, first)).alias("fresh_type"),
            F.sort_array(F.collect_set("role_type")).alias("families"),
        )
    )


def matched_role_skills(role_state: DataFrame, skills: DataFrame, words: list[str]) -> DataFrame:
    """Profile skills asked for by the active roles of a company. Cut down to the
    profile's words before collecting: the sets have a fixed bound."""
    wanted = skills.select("role_id", F.lower(F.trim("skill")).alias("skill")).where(F.col("skill").isin(*words))
    active = role_state.where("is_active").select("role_id", "company_id")
    return wanted.join(active, "role_id").groupBy("company_id").agg(F.collect_set("skill").alias("role_skills"))


def tech_clues(companies: DataFrame, role_state: DataFrame, skills: DataFrame, k: int = 6) -> DataFrame:
    """U4: the first ``k`` distinct words of a company's stack, then of its roles'
    skills in role order; long form (company_id, rank, clue). Every (company, word)
    pair is reduced to its first place before the ranking."""
    stack = companies.select(
        "company_id", F.posexplode(F.concat(*[F.col(f"tech_stack.{p}") for p in ("languages", "frameworks", "infra")]))
    ).select("company_id", F.col("col").alias("clue"), F.struct(
        F.lit(0).alias("part"), F.lit(0.0).alias("a"), F.lit(0).alias("b"), F.lit(0).cast("bigint").alias("c"), F.col("pos").alias("pos")
    ).alias("place"))
    active = role_state.where("is_active").select("role_id", "company_id", "fit_score", "days_open")
    asked = skills.where(F.col("skill") != "").join(active, "role_id").select(
        "company_id", F.col("skill").alias("clue"),
        F.struct(
            F.lit(1).alias("part"), (-F.col("fit_score")).alias("a"), F.col("days_open").alias("b"),
            F.col("role_id").cast("bigint").alias("c"), F.col("pos").alias("pos"),
        ).alias("place"),
    )
    places = stack.unionByName(asked).groupBy("company_id", "clue").agg(F.min("place").alias("place"))
    return top_k(places, ["company_id"], [F.asc("place"), F.asc("clue")], k).drop("place")


# --- personalisation (C8) -----------------------------------------------------


def personal_columns(p: Candidate) -> dict[str, Column]:
    """C8 over cards joined with `role_facts`, `signal_facts` and matched skills."""
    text = F.concat_ws(
        " ", "tagline", "description", *[F.array_join(f"tech_stack.{k}", " ") for k in ("languages", "frameworks", "infra")]
    )
    families = F.coalesce("families", role_families(text))
    matches = _sum([F.array_contains(families, r).cast("int") for r in dict.fromkeys(p.preferred_roles)])
    stack = F.transform(
        F.concat(*[F.col(f"tech_stack.{k}") for k in ("languages", "frameworks", "infra")]), lambda s: F.lower(F.trim(s))
    )
    universe = F.array_union(stack, F.coalesce("role_skills", F.array().cast("array<string>")))
    skills = p.words("preferred_skills")
    n_skills = _sum([F.array_contains(universe, s).cast("int") for s in skills])
    stage_fits = _among(F.lower(F.trim("stage_label")), p.words("preferred_stages"))
    remote = F.coalesce("remote_us", F.lit(False))
    if p.remote_only:
        remote_boost, remote_penalty = F.when(remote, 12).otherwise(0), F.when(remote, 0).otherwise(20)
    else:
        here = _among(F.lower(F.trim("location")), p.words("preferred_locations"))
        remote_boost, remote_penalty = F.when(here, 6).otherwise(0), F.lit(0)
    target = _among(F.col("company_id"), p.target_company_ids)
    avoid = _among(F.col("company_id"), p.avoid_company_ids)
    founder_bias = F.coalesce("founder", F.lit(False)) & F.lit("backend" in p.preferred_roles)
    matched = F.array_compact(F.array(*[F.when(F.array_contains(universe, s), F.lit(s)) for s in skills])) if skills else F.array().cast("array<string>")
    reasons = F.array_compact(
        F.array(
            F.when(matches > 0, F.concat(F.lit("Role alignment: "), F.array_join(families, ", "))),
            F.when(n_skills > 0, F.concat(F.lit("Skill overlap: "), F.array_join(F.slice(matched, 1, 4), ", "))),
            F.when(stage_fits, F.concat(F.lit("Preferred stage: "), F.col("stage_label"))),
            F.when(remote, F.lit("Remote-compatible")).otherwise(F.lit("Penalized: not remote"))
            if p.remote_only
            else F.when(remote_boost > 0, F.concat(F.lit("Location match: "), F.col("location"))),
            F.when(target, F.lit("User target company")),
            F.when(avoid, F.lit("Avoid list")),
            F.when(founder_bias, F.lit("Founder intent + backend bias")),
        )
    )
    return {
        "fit_boost": F.when(matches > 0, F.least(F.lit(18), matches * 8)).otherwise(0) + F.when(founder_bias, 4).otherwise(0),
        "skill_boost": F.least(F.lit(20), n_skills * 5),
        "stage_boost": F.when(stage_fits, 10).otherwise(0),
        "remote_boost": remote_boost,
        "target_boost": F.when(target, 15).otherwise(0),
        "penalty": remote_penalty + F.when(avoid, 30).otherwise(0),
        "matched_skills": matched,
        "personal_reasons": reasons,
        "role_families": families,
    }


PERSONAL_PARTS = ("fit_boost", "skill_boost", "stage_boost", "remote_boost", "target_boost")


# --- opportunity score (C7) ---------------------------------------------------


def score_opportunities(
    cards: DataFrame, role_state: DataFrame, signals: DataFrame, as_of: str, skills: DataFrame | None = None,
    profile: Candidate | None = Candidate(), hours: int = 24 * 7,
) -> DataFrame:
    """One row per company card with score, confidence, delta and parts.

    ``cards`` come from `reports.company_cards`; signals older than ``hours`` are
    out of sight of the console."""
    now = instant(as_of)
    seen = signals.where((F.col("signal_date") >= shift(now, hours=-hours)) & (F.coalesce("score", F.lit(0.0)) >= 0))
    base = (
        cards.drop("open_roles", "signal_count")
        .join(role_facts(role_state), "company_id", "left")
        .join(signal_facts(seen, now), "company_id", "left")
    )
    if profile is not None and skills is not None and profile.preferred_skills:
        base = base.join(matched_role_skills(role_state, skills, profile.words("preferred_skills")), "company_id", "left")
    else:
        base = base.withColumn("role_skills", F.lit(None).cast("array<string>"))
    zero = ("strength_hundredths", "signal_count", "velocity_points", "open_roles", "fresh_roles")
    base = base.withColumns(
        {**{c: F.coalesce(c, F.lit(0)) for c in zero}, "founder": F.coalesce("founder", F.lit(False))}
    )
    if profile is None:
        personal = {c: F.lit(0) for c in (*PERSONAL_PARTS, "penalty")}
        personal["matched_skills"] = F.array().cast("array<string>")
        personal["personal_reasons"] = F.array().cast("array<string>")
    else:
        personal = personal_columns(profile)
    scored = base.withColumns(personal).withColumns(
        {
            "signal_strength": F.least(F.col("strength_hundredths") / 100, F.lit(100.0)),
            "hiring_velocity": F.least(F.col("velocity_points") + F.col("open_roles") * 4, F.lit(100)),
            "base_fit": clamp(half_up(F.coalesce("fit_score", F.lit(0.0))), 0.0, 100.0),
            "urgency_points": lookup(F.col("urgency_label"), {"critical": 100, "high": 82, "medium": 64}, F.lit(42)),
            "accessibility": F.when(F.col("founder"), 92).when(F.col("open_roles") > 0, 72).otherwise(38),
            "personal_total": _sum([F.col(c) for c in PERSONAL_PARTS]) - F.col("penalty"),
        }
    )
    weighted = (
        F.col("signal_strength") * 0.28
        + F.col("hiring_velocity") * 0.24
        + F.col("base_fit") * 0.18
        + F.col("urgency_points") * 0.15
        + F.col("accessibility") * 0.10
        + clamp(F.col("personal_total"), -25, 25)
    )
    n_signals, n_roles = F.col("signal_count"), F.col("open_roles")
    scored = scored.withColumn("score", clamp(half_up(weighted), 1.0, 99.0).cast("int"))
    return scored.withColumns(
        {
            "confidence": F.when((n_signals >= 4) & (n_roles >= 2), "high").when((n_signals >= 2) | (n_roles >= 1), "medium").otherwise("low"),
            "score_delta": F.when(F.col("score") >= 85, "+14").when(F.col("score") >= 75, "+9").when(F.col("score") >= 65, "+5").otherwise("+2"),
            "personalization": clamp(F.col("personal_total") + 50, 0, 100),
        }
    )


# --- evidence (C9, W6) -----------------------------------------------------------


def _item(place: int, key: Column, label: Column, source: Column, contribution: Column, note: Column) -> Column:
    points = contribution.cast("int")
    return F.struct(
        (-F.abs(points)).alias("order"), F.lit(place).alias("place"), key.cast("bigint").alias("item"), label.alias("label"),
        source.alias("source_type"), points.alias("contribution"), note.alias("note"),
    )


def _signal_item(s: Column, stage: Column) -> Column:
    kind = s["type"]
    label = (
        F.when(kind == "founder_post", "Founder hiring signal")
        .when(kind == "funding", F.when(stage != "Unverified", F.concat(stage, F.lit(" funding announcement"))).otherwise("Funding momentum"))
        .when(kind == "github_spike", "GitHub activity spike")
        .when(kind == "career_page", "Fresh hiring signal")
        .otherwise(signal_type_label(kind))
    )
    return _item(0, s["rank"], label, signal_type_label(kind), s["contribution"], s["headline"])


def evidence(
    scored: DataFrame, signals: DataFrame, role_state: DataFrame, as_of: str, profile: Candidate | None = Candidate(),
    hours: int = 24 * 7, k: int = 6,
) -> DataFrame:
    """The ``k`` strongest evidence rows per company, long form with rank.
    Of the signals only the ``k`` strongest can be among them, so only those leave
    their partition. ``scored`` is read once: a company's evidence is built as one
    array of at most ``k`` + 4 items, ordered and cut inside its row."""
    now = instant(as_of)
    seen = signals.where((F.col("signal_date") >= shift(now, hours=-hours)) & (F.coalesce("score", F.lit(0.0)) >= 0))
    raw = signal_weight(F.col("type")) * recency_percent(F.col("signal_date"), now) / 100
    seen = seen.withColumn("contribution", F.greatest(F.lit(1.0), half_up(raw * 0.28)))
    strongest = top_k(seen, ["company_id"], [F.desc("contribution"), *signal_order()], k)
    strongest = strongest.groupBy("company_id").agg(F.collect_list(F.struct("rank", "type", "contribution", "headline")).alias("strongest"))

    # The two first role titles, fresh roles when there are any.
    fresh = F.col("days_open") <= 2
    titles = top_k(role_state.where("is_active"), ["company_id"], [F.desc(fresh), *role_order()], 2)
    notes = titles.groupBy("company_id").agg(F.array_sort(F.collect_list(F.struct("rank", fresh.alias("fresh"), "title"))).alias("first_roles"))
    of = lambda rows: F.array_join(F.transform(rows, lambda r: r["title"]), " • ")
    any_note, fresh_note = of(F.col("first_roles")), of(F.filter("first_roles", lambda r: r["fresh"]))

    is_fresh = F.col("fresh_roles") > 0
    role_label = (
        F.when(F.col("fresh_roles") == 1, F.concat(F.lit("Fresh "), F.regexp_replace("fresh_type", "^([^_]*)_", "$1 "), F.lit(" role")))
        .when(is_fresh, F.concat(F.col("fresh_roles").cast("string"), F.lit(" roles opened in 48 hours")))
        .otherwise(F.concat(F.col("open_roles").cast("string"), F.lit(" active hiring roles")))
    )
    role_points = F.when(
        is_fresh, F.least(F.lit(24.0), half_up(F.col("fresh_roles") * 22 * 0.24))
    ).otherwise(F.greatest(F.lit(4.0), half_up(F.col("hiring_velocity") * 0.18)))
    items = [F.when(F.col("open_roles") > 0, _item(1, F.lit(0), role_label, F.lit("Role openings"), role_points, F.when(is_fresh, fresh_note).otherwise(any_note)))]

    if profile is not None and profile.remote_only:
        remote = F.coalesce("remote_us", F.lit(False))
        given = lambda c: F.when(F.col(c) != 0, F.col(c)).otherwise(12)
        items.append(
            _item(
                2, F.lit(0), F.when(remote, "Remote U.S. fit confirmed").otherwise("Remote mismatch penalty"), F.lit("Profile preference"),
                F.when(remote, given("remote_boost")).otherwise(-given("penalty")),
                F.when(remote, F.col("remote_label")).otherwise(F.concat("name", F.lit(" is not confirmed remote-compatible."))),
            )
        )
    overlap = F.size("matched_skills") > 0
    stack = _item(
        3, F.lit(0), F.when(overlap, "Strong stack overlap").otherwise("Strong stack fit"), F.lit("Fit model"),
        F.greatest(F.lit(6.0), F.when(overlap & (F.col("skill_boost") != 0), F.col("skill_boost").cast("double")).otherwise(half_up(F.col("base_fit") * 0.1))),
        F.when(overlap, F.array_join(F.slice("matched_skills", 1, 4), ", ")).otherwise(F.lit("Visible stack and role-family overlap support strong fit.")),
    )
    stage = F.col("stage_label")
    preferred = _item(
        4, F.lit(0), F.concat(F.lit("Preferred "), stage, F.lit(" stage")), F.lit("Profile preference"), F.col("stage_boost"), F.concat(F.lit("Preferred stage: "), stage)
    )
    items += [F.when(overlap | (F.col("base_fit") >= 75), stack), F.when(F.col("stage_boost") > 0, preferred)]

    whole = scored.join(notes, "company_id", "left").join(strongest, "company_id", "left")
    of_signals = F.when(F.col("strongest").isNotNull(), F.transform("strongest", lambda s: _signal_item(s, stage))).otherwise(F.array())
    ranked = F.slice(F.array_sort(F.concat(of_signals, F.array_compact(F.array(*items)))), 1, k)
    rows = whole.select("company_id", F.posexplode(ranked).alias("at", "e"))
    return rows.select("company_id", "e.place", "e.item", "e.label", "e.source_type", "e.contribution", "e.note", (F.col("at") + 1).alias("rank"))


def reasons(evidence_rows: DataFrame, k: int = 4) -> DataFrame:
    """Labels of the ``k`` largest positive evidence rows. Rows must be ranked
    among all evidence with ``k`` or more kept."""
    positive = top_k(
        evidence_rows.where("contribution > 0").drop("rank"), ["company_id"],
        [F.desc("contribution"), F.asc("place"), F.asc("item")], k,
    )
    ordered = F.array_sort(F.collect_list(F.struct("rank", "label")))
    return positive.groupBy("company_id").agg(F.transform(ordered, lambda r: r["label"]).alias("score_reasons"))


# --- opportunities and details (C10, C11, O5) -------------------------------------


def opportunities(
    scored: DataFrame, clues: DataFrame, execution: DataFrame | None = None
) -> DataFrame:
    """One opportunity per company: primary role, focus, action state and the
    code of the next action."""
    text = F.concat_ws(
        " ", "tagline", "description", *[F.array_join(f"tech_stack.{k}", " ") for k in ("languages", "frameworks", "infra")]
    )
    tags = clues.where("rank <= 4").groupBy("company_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "clue"))), lambda r: r["clue"]).alias("stack_tags")
    )
    out = scored.join(tags, "company_id", "left").withColumn(
        "stack_tags", F.coalesce("stack_tags", F.array().cast("array<string>"))
    )
    if execution is not None:
        state = execution.select("company_id", F.col("status").alias("execution_status"))
        out = out.join(state, "company_id", "left")
    else:
        out = out.withColumn("execution_status", F.lit(None).cast("string"))
    fallback = (
        F.when(F.lower(F.coalesce("latest_signal", F.lit(""))).contains("founder"), "reach_out")
        .when(F.col("urgency_label") == "critical", "apply_now")
        .when(F.col("signal_count") >= 5, "high_leverage")
        .otherwise("early_signal")
    )
    has_role = F.col("top_role").isNotNull()
    action = (
        F.when(F.col("founder"), "reach_out")
        .when(has_role & (F.col("top_role.days_open") <= 2), "apply_now")
        .when(F.col("open_roles") == 0, "early_signal")
        .otherwise(fallback)
    )
    default_next = (
        F.when(F.col("founder"), "reach_out_leadership")
        .when(has_role, F.when(F.col("top_role.days_open") <= 2, "apply_fresh_role").otherwise("apply_active_role"))
        .otherwise(F.concat(F.lit("company_"), action))
    )
    by_status = {
        "reached_out": "follow_up_outreach", "applied": "follow_up_application", "follow_up": "send_follow_up",
        "interview": "prepare_interview", "offer": "review_offer", "closed": "closed",
    }
    known = F.when(F.col("top_role.role_type") != "unknown", F.col("top_role.role_type"))
    return out.select(
        "company_id",
        F.col("name").alias("company_name"),
        F.col("tagline").alias("company_tagline"),
        "score",
        "confidence",
        "score_delta",
        F.col("top_role.title").alias("primary_role_title"),
        F.col("top_role.url").alias("primary_role_url"),
        F.when(has_role, F.coalesce(known, F.lit("backend"))).otherwise(role_focus(text)).alias("role_focus"),
        F.coalesce("description", F.lit("")).alias("summary"),
        "location",
        F.coalesce("remote_us", F.lit(False)).alias("remote"),
        "remote_label",
        F.col("top_role.days_open").alias("posted_days"),
        "stack_tags",
        action.alias("action_state"),
        lookup(F.col("execution_status"), by_status, default_next).alias("next_action"),
        F.col("urgency_label").alias("urgency"),
        "stage_label",
        "signal_count",
        "open_roles",
        "latest_signal",
        "latest_signal_at",
        F.coalesce("on_watchlist", F.lit(False)).alias("watchlisted"),
        "execution_status",
    )


def ranked_opportunities(opps: DataFrame, limit: int | None = None) -> DataFrame:
    """Best first. Rank numbers are given to a limited result only; a whole
    table keeps the score as its rank."""
    ordered = opps.orderBy(F.desc("score"), F.asc("company_id"))
    if limit is None:
        return ordered
    # The window sees at most `limit` rows.
    return ordered.limit(limit).withColumn(
        "rank", F.row_number().over(Window.orderBy(F.desc("score"), F.asc("company_id")))
    )


def open_role_rows(role_state: DataFrame, k: int = 5) -> DataFrame:
    """C11: the first ``k`` open roles of a company with their freshness band."""
    return top_k(role_state.where("is_active"), ["company_id"], role_order(), k).select(
        "company_id", "rank", "role_id", "title", "role_type", "days_open", freshness_band(F.col("days_open")).alias("status")
    )


def timeline_rows(signals: DataFrame, as_of: str, k: int = 4, hours: int = 24 * 7) -> DataFrame:
    """C11: the first ``k`` events of a company in list order."""
    seen = signals.where((F.col("signal_date") >= shift(instant(as_of), hours=-hours)) & (F.coalesce("score", F.lit(0.0)) >= 0))
    label = lookup(
        F.col("type"), {"funding": "FUNDING", "founder_post": "FOUNDER", "github_spike": "ENGINEERING", "career_page": "DIRECT"}, F.lit("HIGH")
    )
    return top_k(seen, ["company_id"], signal_order(), k).select(
        "company_id", "rank", "signal_id", label.alias("label"), "headline", signal_type_label(F.col("type")).alias("source")
    )


def score_breakdown(scored: DataFrame) -> DataFrame:
    """C11: the four bars of the detail view, long form."""
    return scored.select(
        "company_id",
        F.inline(
            F.array(
                F.struct(F.lit("Signal strength").alias("label"), F.col("signal_strength").cast("double").alias("value")),
                F.struct(F.lit("Hiring velocity").alias("label"), F.col("hiring_velocity").cast("double").alias("value")),
                F.struct(F.lit("Personal fit").alias("label"), F.col("base_fit").cast("double").alias("value")),
                F.struct(F.lit("Personalization").alias("label"), F.col("personalization").cast("double").alias("value")),
            )
        ),
    )


def command_metrics(opps: DataFrame) -> DataFrame:
    """A16"""
    return opps.agg(
        F.count(F.lit(1)).alias("opportunities"),
        F.coalesce(F.sum("open_roles"), F.lit(0)).alias("open_roles"),
        count_where(F.col("urgency").isin("critical", "high")).alias("high_priority"),
        count_where(F.col("watchlisted")).alias("watchlisted"),
        F.coalesce(F.sum("signal_count"), F.lit(0)).alias("signals_today"),
    )


def latest_feed(signals: DataFrame, k: int = 30) -> DataFrame:
    """The first ``k`` signals of the list order."""
    return signals.orderBy(*signal_order()).limit(k)
