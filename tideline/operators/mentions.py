"""Company mentions in text (J7, S13 aliases)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.session import shared_folder


def aliases_of(registry: DataFrame) -> DataFrame:
    """Registry (name, aliases) to the long alias table (company_name, alias):
    the lower-cased name, without dots, with dots and dashes as blanks, and the
    listed aliases."""
    low = F.lower("name")
    own = F.array(
        low,
        F.replace(low, F.lit("."), F.lit("")),
        F.translate(low, ".-", "  "),
    )
    listed = F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.lower(a))
    return (
        registry.select(F.col("name").alias("company_name"), F.explode(F.array_union(own, listed)).alias("alias"))
        .where(F.col("alias") != "")
        .distinct()
    )


CORE = r"(?s)[a-z0-9](?:.*[a-z0-9])?"
WORD, BETWEEN = "[a-z0-9]+", "[^a-z0-9]+"
DEPTH = 6


def alias_trie(aliases: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The words of the aliases' cores as a trie of edges (depth, node, word, next, more,
    ends): nodes are the words so far, the root the empty string. ``more``: the trie goes
    on from there; ``ends``: the aliases that end with the edge, those of more words with
    the edge of the last depth."""
    steps = aliases.where("core <> ''").withColumn("words", F.split("core", BETWEEN)).withColumn("n", F.least(F.size("words"), F.lit(depth)))
    steps = steps.select("alias", "core", "words", "n", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("depth"))
    upto = lambda d: F.array_join(F.slice("words", F.lit(1), d), " ")
    last = F.when(F.col("depth") == F.col("n"), F.struct("alias", "core", F.split_part("alias", F.col("core"), F.lit(1)).alias("pre"), (F.size("words") > depth).alias("long")))
    edges = steps.select("depth", upto(F.col("depth") - 1).alias("node"), F.get("words", F.col("depth") - 1).alias("word"), upto(F.col("depth")).alias("next"), (F.col("depth") < F.col("n")).alias("more"), last.alias("end"))
    return edges.groupBy("depth", "node", "word", "next").agg(F.max("more").alias("more"), F.collect_set("end").alias("ends"))


def mention_candidates(texts: DataFrame, aliases: DataFrame, key: str) -> DataFrame:
    """All (key, alias) where an alias occurs in the text (column ``text``) with no
    [a-z0-9] before or behind it.

    The words of the aliases make a trie, stored first so that its size decides how it
    is joined. Texts are cut into words once, and of these only the ones that stand in the
    trie are kept, with their places and what stands around them. The walk goes from
    the words that begin an alias and takes one equi-join a depth, on the node and the next
    place; where an alias ends, its own marks are compared with those of the text. Only
    aliases of more than ``DEPTH`` words are looked for in whole texts after that. An alias
    without [a-z0-9] is looked up by its first character."""
    spark = texts.sparkSession
    folder = shared_folder(spark, "aliases")

    def kept(df: DataFrame, name: str) -> DataFrame:
        # small row groups, so that what one long input split gives is read in many tasks
        df.write.option("parquet.block.size", 4 << 20).parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    cored = aliases.select("alias").distinct().withColumn("core", F.regexp_extract("alias", CORE, 0))
    bare = cored.where("core = ''").select("alias", F.substring("alias", 1, 1).alias("mark"))
    trie = kept(alias_trie(cored), "trie")
    depth = trie.agg(F.max("depth")).first()[0]  # one number
    narrow = texts.select(key, F.lower("text").alias("low"))
    marks = narrow.select(key, F.explode(F.array_distinct(F.regexp_extract_all("low", F.lit("[^a-z0-9\\s]"), F.lit(0)))).alias("mark"))
    found = [] if bare.isEmpty() else [_holding(marks.join(bare, "mark").select(key, "alias").distinct(), narrow, key)]
    if depth:
        words, gaps = F.regexp_extract_all("low", F.lit(WORD), F.lit(0)), F.split("low", WORD)
        cut = narrow.select(key, F.arrays_zip(words.alias("word"), gaps.alias("before"), F.slice(gaps, F.lit(2), F.size(gaps)).alias("after")).alias("cut"))
        # the outer form, as the other one computes its array a second time for a filter
        cut = cut.select(key, F.size("cut").alias("n"), F.posexplode_outer("cut").alias("at", "c")).select(key, "at", (F.col("at") == F.col("n") - 2).alias("last"), "c.*")
        places = kept(cut.join(trie.select("word").distinct(), "word", "left_semi"), "places")
        walk = places.select(key, "at", "word", "last", "before", "after", F.lit("").alias("node"), F.col("word").alias("body"), (F.col("at") == 0).alias("first"))
        for d in range(1, depth + 1):
            walk = walk.join(trie.where(f"depth = {d}").drop("depth"), ["node", "word"])
            found.append(_ended(walk, narrow, key, d == DEPTH))
            if d < depth:
                on = kept(walk.where("more").select(key, (F.col("at") + 1).alias("at"), F.col("next").alias("node"), "body", "before", "first", F.col("after").alias("gap")), f"walk-{d}")
                walk = on.join(places.drop("before"), [key, "at"]).withColumn("body", F.concat("body", "gap", "word"))
    if not found:
        return narrow.select(key, F.lit("").alias("alias")).limit(0)
    return reduce(DataFrame.unionByName, found).distinct()


def _ended(walk: DataFrame, narrow: DataFrame, key: str, deepest: bool) -> DataFrame:
    """The aliases that end here and stand there with their own marks, no [a-z0-9] next
    to them."""
    ends = walk.select(key, "before", "after", "body", "first", "last", F.explode("ends").alias("end")).select("*", "end.*")
    post = F.substring("alias", F.length("pre") + F.length("core") + 1, F.length("alias"))
    ahead = (F.col("pre") == "") | (F.endswith("before", F.col("pre")) & (F.col("first") | (F.length("before") > F.length("pre"))))
    behind = (post == "") | (F.startswith("after", post) & (F.col("last") | (F.length("after") > F.length(post))))
    fits = ends.where(~F.col("long") & (F.col("body") == F.col("core")) & ahead & behind).select(key, "alias")
    return fits.unionByName(_holding(ends.where("long").select(key, "alias").distinct(), narrow, key)) if deepest else fits


def _holding(pairs: DataFrame, narrow: DataFrame, key: str) -> DataFrame:
    """The pairs whose alias stands in the text as it is written."""
    quoted = F.concat(F.lit("(?<![a-z0-9])"), F.regexp_replace("alias", r"([\\\[\](){}.*+?^$|#&~-])", r"\\$1"), F.lit("(?![a-z0-9])"))
    return pairs.join(narrow, key).where(F.contains("low", F.col("alias")) & F.regexp_like("low", quoted)).select(key, "alias")


def match_mentions(texts: DataFrame, aliases: DataFrame, key: str) -> DataFrame:
    """The company of every text with a mention: longest alias wins, then the
    greater name. All aliases of a company count, not only the first that its list
    has in the text. Of companies with one alias only the greater name can win, so an
    alias becomes one row before texts are joined."""
    named = aliases.where("alias <> ''").groupBy("alias").agg(F.max("company_name").alias("company_name"))
    found = mention_candidates(texts, named, key).join(named, "alias")
    best = F.max(F.struct(F.length("alias").alias("n"), F.col("company_name"))).alias("best")
    return found.groupBy(key).agg(best).select(key, F.col("best.company_name").alias("company_name"))
