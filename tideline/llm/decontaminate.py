"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact checks.

Words are split at ASCII white space after lower-casing; five of them are a shingle. A
window of a text has as many words as the item (or the whole text where that is
shorter), and every start in the text makes one. The similarity of window and item is the
sum of smaller occurrence counts of their shingles over the sum of larger ones; it must
reach ``threshold``.

A shingle's occurrences are features of their own, so weighted similarity is that of plain
sets, and a word that is repeated weighs as it should. Windows that could not pass if
every shared shingle in them counted are left out exactly, by running sums of the
places. The others get a fingerprint of 64 bits, as the item has one. Fingerprints
within ``RADIUS`` agree in one of RADIUS + 1 blocks, so equi-joins on blocks find all of
them, and the candidates' features are compared with the item's. At similarity 0.75 about
11 bits differ, with a deviation of 3; the radius lies over four deviations above. Windows
and items of fewer than ``FEW`` features, where bits scatter more, are all candidates.

All of it is DataFrame functions. The benchmark's shingles are broadcast after their
number is checked against ``BROADCAST_SHINGLES``; beyond it the same join shuffles.

Defined results: null texts are empty; texts or items of fewer than five words have no
shingle and match nothing. Of windows in a tie the first one is taken. Equal texts are worked on once. Repeated rows give one result
per id and item; a null id's results carry null. Other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm import shared

BROADCAST_SHINGLES = 1_000_000
RADIUS = 26
FEW = 24
BLANK = r"\x20\x09-\x0D"
TRIM = "trim(BOTH ' \\t\\n\\u000B\\u000C\\r' FROM lower(text))"


def _words(docs: DataFrame, *keep: Column | str) -> DataFrame:
    """Adds words (array) and n (their number)."""
    body = docs.select(*keep, F.expr(TRIM).alias("body"))
    words = F.split("body", f"[{BLANK}]+")
    return body.select(*[c for c in body.columns if c != "body"], F.when(F.col("body") == "", F.array().cast("array<string>")).otherwise(words).alias("words")).withColumn("n", F.size("words"))


def _shingles(words: str, first: str, count: str) -> str:
    parts = ", ".join(f"{words}[i + {k}]" for k in range(5))
    return f"if({count} > 0, transform(sequence({first}, {first} + {count} - 1), i -> xxhash64({parts})), cast(array() as array<bigint>))"


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.75, id_column: str = "doc_id", text: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, start, n_common, n_union, similarity) of the most similar
    window of every text and item that reach ``threshold``."""
    items = _words(benchmark.select(F.col(item_column).alias("item_id"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("text")), "item_id")
    items = items.where("n >= 5").dropDuplicates().withColumn("item", F.xxhash64("item_id", "words"))
    placed = items.select("item_id", "item", F.col("n").alias("size"), F.posexplode(F.expr(_shingles("words", "0", "n - 4"))).alias("place", "gram"))
    counted = placed.groupBy("item", "gram").agg(F.count("*").cast("int").alias("of_item"))
    placed = shared.stored(placed.join(counted, ["item", "gram"]), "items")
    few = placed.count() <= BROADCAST_SHINGLES
    sought = placed.select("gram", "item", "size", "of_item").distinct()

    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    split = _words(rows.select("doc_id", F.xxhash64("text").alias("k1"), F.hash("text").alias("k2"), "text"), "doc_id", "k1", "k2")
    grams = split.where("n >= 5").select("doc_id", "k1", "k2", "n", F.posexplode(F.expr(_shingles("words", "0", "n - 4"))).alias("pos", "gram"))
    hits = shared.stored(grams.join(F.broadcast(sought) if few else sought, "gram"), "hits")
    ids = hits.select("k1", "k2", "doc_id").distinct()

    # a window has no more common shingles than its whole text
    kind, pair = ["k1", "k2"], ["k1", "k2", "item"]
    stands = hits.select(*pair, "gram", "pos", "size", "n", "of_item").distinct()
    per_gram = shared.stored(stands.groupBy(*pair, "gram", "size", "n", "of_item").agg(F.sort_array(F.collect_list("pos")).alias("at")), "stands")
    union = lambda common: F.least("size", "n") - 4 + F.col("size") - 4 - common
    most = per_gram.groupBy(*pair, "size", "n").agg(F.sum(F.least(F.size("at"), "of_item")).alias("most"))
    able = most.where(F.col("most") / union(F.col("most")) >= threshold).select(*pair)
    able = shared.stored(per_gram.join(able, pair), "able").withColumn("last", F.greatest(F.lit(0), F.col("n") - F.col("size")))

    # windows with too few places of shared shingles are hopeless; the number changes at steps
    span = "least(size, n) - 5"
    steps = F.expr(f"flatten(transform(at, p -> array(struct(greatest(0, p - ({span})) as start, 1 as step), struct(p + 1 as start, -1 as step))))")
    steps = able.select(*pair, "size", "n", "last", F.explode(steps).alias("s")).select(*pair, "size", "n", "last", "s.*").where("start <= last")
    in_order = Window.partitionBy(*pair).orderBy("start")
    runs = steps.groupBy(*pair, "size", "n", "last", "start").agg(F.sum("step").alias("step"))
    runs = runs.select(*pair, "size", "n", "start", F.sum("step").over(in_order).alias("places"), (F.coalesce(F.lead("start").over(in_order), F.col("last") + 1) - 1).alias("until"))
    hopeful = runs.where(F.least(F.col("places"), F.col("size") - 4) / union(F.least(F.col("places"), F.col("size") - 4)) >= threshold)
    windows = hopeful.select(*pair, "size", "n", F.explode(F.expr("sequence(start, until)")).alias("start"))

    # fingerprints of these windows, and of the items
    # stored by themselves, so that their size decides whether texts have to move
    kinds = shared.stored(able.select(*kind).distinct(), "kinds")
    text_words = split.join(kinds, kind, "left_semi").groupBy(*kind).agg(F.first("words").alias("words"))
    window = [*pair, "start", "size", "n"]
    features = windows.join(text_words, kind).select(*window, F.explode(F.expr(_features("words", "start", "least(size, n) - 4"))).alias("feature"))
    features = shared.stored(features, "features")
    of_items = shared.stored(items.select("item", F.explode(F.expr(_features("words", "0", "n - 4"))).alias("feature")).distinct(), "item-features")
    prints, item_prints = shared.stored(_simhash(features, window), "prints"), _simhash(of_items, ["item"])
    blocks = lambda df: df.where(F.col("weight") >= FEW).withColumn("block", F.explode(F.array(*_blocks(F.col("print")))))
    theirs = blocks(item_prints).select("item", "block", F.col("print").alias("item_print"))
    near = blocks(prints).join(theirs, ["item", "block"]).where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS).select(*window)
    small = prints.join(item_prints.select("item", F.least("weight", F.lit(FEW)).alias("of_item")), "item").where(f"weight < {FEW} or of_item < {FEW}").select(*window)
    candidates = shared.stored(near.unionByName(small).distinct(), "candidates")

    # candidates are verified exactly
    common = features.join(candidates, window).join(of_items, ["item", "feature"]).groupBy(*window).agg(F.count("*").alias("n_common"))
    scored = common.withColumn("n_union", union(F.col("n_common")).cast("long")).withColumn("similarity", F.col("n_common") / F.col("n_union")).where(F.col("similarity") >= threshold)
    order = lambda at: F.struct(f"{at}similarity", -F.col(f"{at}start"))
    best = scored.groupBy(*pair).agg(F.max_by(F.struct("start", "n_common", "n_union", "similarity"), order("")).alias("best"))
    names = placed.select("item", "item_id").distinct()
    result = best.join(names, "item").join(ids, kind).groupBy("doc_id", "item_id").agg(F.max_by("best", order("best.")).alias("best"))
    return result.select("doc_id", "item_id", F.col("best.start").cast("long").alias("start"), "best.n_common", "best.n_union", "best.similarity")


def _features(words: str, first: str, count: str) -> str:
    """Hashes of (shingle, its number among equal ones): common features of two lists add
    up to the smaller counts of their shingles."""
    return f"flatten(transform(array(array_sort({_shingles(words, first, count)})), s -> transform(s, (x, i) -> xxhash64(x, i + 1 - array_position(s, x)))))"


def _simhash(features: DataFrame, key: list[str]) -> DataFrame:
    """(key, weight, print): bit b of the print is the majority of the features' bits b.
    Two bits are counted in one number."""
    sums = features.groupBy(*key).agg(F.count("*").alias("weight"), *[F.sum(F.shiftright("feature", b).bitwiseAND(0x100000001)).alias(f"b{b}") for b in range(32)])
    low, high = (lambda b: F.col(f"b{b}").bitwiseAND(0xFFFFFFFF)), (lambda b: F.shiftrightunsigned(f"b{b}", 32))
    one = lambda count, b: F.when(2 * count > F.col("weight"), F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))
    bits = [one(at(b), b + k) for k, at in ((0, low), (32, high)) for b in range(32)]
    return sums.select(*key, "weight", reduce(lambda x, y: x.bitwiseOR(y), bits).alias("print"))


def _blocks(fingerprint: Column) -> list[Column]:
    """RADIUS + 1 pieces of a fingerprint, each with its number: prints that differ in
    RADIUS bits or fewer have one piece alike."""
    edges = [64 * k // (RADIUS + 1) for k in range(RADIUS + 2)]
    return [F.shiftrightunsigned(fingerprint, a).bitwiseAND((1 << z - a) - 1) + 8 * k for k, (a, z) in enumerate(zip(edges, edges[1:]))]


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", **more) -> DataFrame:
    """``docs`` without the ids that hold a benchmark item. The ids are stored first, so
    their size decides whether texts have to move."""
    found = shared.stored(contaminated(docs, benchmark, id_column=id_column, **more).select(F.col("doc_id").alias("__found")).distinct(), "found")
    return docs.join(found, docs[id_column].eqNullSafe(F.col("__found")), "left_anti")
