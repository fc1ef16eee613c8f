"""Mixing sources to target weights by raking.

Documents are counted in cells of source, language and topic. Iterative proportional
fitting multiplies the cells' weights so that the weighted tokens of every source, then
every language, then every topic meet their target, again and again; a cell's weight
times the rate that meets the budget, 1 at most, is the probability with which each of
its documents is taken. The draw is a hash of the id and the seed, so it is repeatable,
and a document's copies by id share it.

All of it is DataFrame functions. The texts are read once for the counts; the rounds work
on the cells alone, each a sum per marginal joined back, stored after every round.

Defined results: null texts have no token. A missing source, language or topic is a
category of its own (the empty string). Cells without tokens keep weight 1. Targets that
name no present category have no effect; categories without a target keep their share.
Repeated rows are drawn alike. No document, no row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm import shared

ROUNDS = 8
RATE_ROUNDS = 5
TEMPER = {"source": 0.7, "lang": 0.7, "topic": 1.0}
BUDGET = 0.8
SEED = "mix-1"
BLANK = r"[\x20\x09-\x0D]+"
# The first that holds names the topic.
TOPICS = (
    ("notice", "lower({text}) LIKE '%license%' OR lower({text}) LIKE '%copyright%'"),
    ("table", "length({text}) - length(replace({text}, '|', '')) >= 5"),
    ("lines", "length({text}) - length(replace({text}, chr(10), '')) >= 20"),
)
OTHER = "prose"


def topic_sql(topics: Sequence[tuple[str, str]] = TOPICS, text: str = "text") -> str:
    return "CASE " + " ".join(f"WHEN {rule.format(text=text)} THEN '{name}'" for name, rule in topics) + f" ELSE '{OTHER}' END"


def describe(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", topics: Sequence[tuple[str, str]] = TOPICS, seed: str = SEED) -> DataFrame:
    """Per row: doc_id, source, lang, topic, n_tokens (words) and the draw, from 0 to 1."""
    rows = docs.select(F.col(id_column).alias("doc_id"), _name(source).alias("source"), _name(lang).alias("lang"), _name(text).alias("text"))
    body = F.expr("trim(BOTH ' \\t\\n\\u000B\\u000C\\r' FROM text)")
    return rows.select(
        "doc_id",
        "source",
        "lang",
        F.expr(topic_sql(topics)).alias("topic"),
        F.when(body == "", 0).otherwise(F.size(F.split(body, BLANK))).cast("long").alias("n_tokens"),
        _draw(F.col("doc_id"), seed).alias("draw"),
    )


def _name(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def _draw(ident: Column, seed: str) -> Column:
    """From 0 to 1, by a hash of the seed and the id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def rake(described: DataFrame, temper: Mapping[str, float] | None = None, targets: Mapping[str, DataFrame] | None = None, rounds: int = ROUNDS, budget: float = BUDGET) -> DataFrame:
    """(source, lang, topic, tokens, weight, probability) per cell. A marginal's target
    shares are ``targets[name]`` (category, share) or, without these, its token counts to
    the power ``temper[name]``, over their sum."""
    temper, targets = dict(TEMPER) if temper is None else dict(temper), targets or {}
    margins = ("source", "lang", "topic")
    cells = shared.stored(described.groupBy(*margins).agg(F.sum("n_tokens").alias("tokens")), "cells")
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    for m in margins:
        sums = cells.groupBy(m).agg(F.sum("tokens").cast("double").alias("now")).where("now > 0")
        if m in targets:
            given = targets[m].select(F.col("category").alias(m), F.col("share").cast("double").alias("share"))
            sums = sums.join(given, m, "left").withColumn("raw", F.coalesce(F.col("share"), F.col("now") / F.lit(float(total or 1))))
        else:
            sums = sums.withColumn("raw", F.pow("now", F.lit(float(temper[m]))))
        whole = sums.agg(F.sum("raw")).first()[0] or 1.0
        goal = sums.select(m, (F.col("raw") / F.lit(whole) * F.lit(float(total))).alias(f"goal_{m}"))
        cells = shared.stored(cells.join(goal.hint("merge"), m, "left"), "cells")
    cells = cells.withColumn("weight", F.lit(1.0))
    # Merge joins: a broadcast in every step costs the driver more than these small sorts.
    for _ in range(rounds):
        for m in margins:
            goal = F.col(f"goal_{m}")
            factor = cells.groupBy(m).agg((F.first(goal) / F.sum(F.col("weight") * F.col("tokens"))).alias("factor"))
            cells = cells.join(factor.hint("merge"), m).withColumn("weight", F.col("weight") * F.coalesce("factor", F.lit(1.0))).drop("factor")
        cells = shared.stored(cells, "raked")
    cells = cells.drop(*[f"goal_{m}" for m in margins])
    rate = budget
    for _ in range(RATE_ROUNDS):
        full = F.col("weight") * F.lit(rate) >= 1
        fixed, free = cells.agg(F.sum(F.when(full, F.col("tokens"))), F.sum(F.when(~full, F.col("tokens") * F.col("weight")))).first()
        if not free:
            break
        rate = max(0.0, (budget * total - (fixed or 0)) / free)
    return cells.withColumn("probability", F.least(F.lit(1.0), F.col("weight") * F.lit(rate)))


def mix_sources(docs: DataFrame, temper: Mapping[str, float] | None = None, targets: Mapping[str, DataFrame] | None = None, budget: float = BUDGET, **columns) -> DataFrame:
    """Per row: doc_id, source, lang, topic, n_tokens, weight, probability, kept."""
    described = shared.stored(describe(docs, **columns), "described")
    cells = rake(described, temper, targets, budget=budget).select("source", "lang", "topic", "weight", "probability")
    return described.join(cells, ["source", "lang", "topic"]).select(
        "doc_id", "source", "lang", "topic", "n_tokens", "weight", "probability", (F.col("draw") < F.col("probability")).alias("kept")
    )


def sampled(docs: DataFrame, id_column: str = "doc_id", temper: Mapping[str, float] | None = None, targets: Mapping[str, DataFrame] | None = None, budget: float = BUDGET, text: str = "text", source: str = "source", lang: str = "lang", topics: Sequence[tuple[str, str]] = TOPICS, seed: str = SEED) -> DataFrame:
    """The rows of ``docs`` that are taken, with their own columns. A row's draw follows
    from its id and its probability from its cell, so only the cells are joined: texts stay
    where they are as long as the stored cells are small enough for Spark to send around."""
    columns = {"id_column": id_column, "text": text, "source": source, "lang": lang, "topics": topics, "seed": seed}
    described = shared.stored(describe(docs, **columns).drop("doc_id", "draw"), "described")
    cells = shared.stored(rake(described, temper, targets, budget=budget).select(F.struct("source", "lang", "topic").alias("__cell"), "probability"), "probabilities")
    cell = F.struct(_name(source).alias("source"), _name(lang).alias("lang"), F.expr(topic_sql(topics, f"coalesce(cast(`{text}` as string), '')")).alias("topic"))
    placed = docs.withColumns({"__of": cell, "__draw": _draw(F.col(id_column), seed)})
    return placed.join(cells, (F.col("__of") == F.col("__cell")) & (F.col("__draw") < F.col("probability")), "left_semi").select(*[docs[c] for c in docs.columns])
