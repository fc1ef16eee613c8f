"""N-gram Jaccard join by vertical partitioning.

The global n-gram order (rare before common, then by hash) is cut into fragments.
A first pass packs every document's distinct n-grams into one segment per hash
fragment; each fragment learns by itself which n-grams several sets share and sends
those segments back, so partial counts of shared n-grams are summed per document, and
a document with too few of them can link with nothing. Among the rest, documents that
share an n-gram of their prefixes become pairs, each pair's overlap is counted in every
fragment separately, and the counts are summed per pair.

Within a large group of near copies not all pairs are needed for the group's class:
pairs are first made with one centre per prefix n-gram, then with other centres, and at
last all pairs are made whose documents are still in different classes. So each link
is found or lies within a class, and no group is expanded into all its pairs.

Defined results: null or empty texts, or texts without words, have no n-gram, size 0
and a class of their own. A text of fewer words than ``width`` is one n-gram. Rows
with equal sets are one class, whatever their ids. Rows that repeat an id are documents of
their own; a null id's component is the smallest id linked with it, or null. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm import fragments, shared

PAIR_FRAGMENTS = 8


def _sets_of(part, data, offsets, width: int):
    """Distinct n-grams of each row (ordered by row, hash), their number, two keys."""
    low = shared._LOWER[data]
    starts, ends, rows = shared.word_spans(low, offsets)
    words = shared.span_hash(low, starts, ends)
    n = part.num_rows
    hashes, at = shared.distinct_in_rows(*shared.shingles(words, rows, n, width))
    sizes = np.bincount(at, minlength=n).astype(np.int64)
    key = shared.mix(shared.by_row(shared.mix(hashes), at, n) + sizes.astype(np.uint64))
    check = shared.by_row(shared.mix(hashes ^ np.uint64(0x5DEECE66D)), at, n)
    return hashes, at, sizes, key.view(np.int64), check.view(np.int64)


def _describe(batches: Iterator[pa.RecordBatch], width: int):
    for batch in batches:
        for part, data, offsets in shared.text_slices(batch, "text"):
            _, _, sizes, key, check = _sets_of(part, data, offsets, width)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), pa.array(key), pa.array(check), part.column(2)], ["doc_id", "n", "key", "check", "row"])


def _segments(batches: Iterator[pa.RecordBatch], text: str, width: int, n_parts: int):
    """Rows (part, blob): for each fragment the segments of a few thousand sets."""
    held: list[tuple] = []
    total = 0
    for batch in batches:
        for part, data, offsets in shared.text_slices(batch, text):
            hashes, at, sizes, key, _ = _sets_of(part, data, offsets, width)
            held.append((hashes, np.repeat(key, sizes)))
            total += len(hashes)
            if total >= fragments.FLUSH_TOKENS:
                yield fragments.flush(held, n_parts)
                held, total = [], 0
    if total:
        yield fragments.flush(held, n_parts)


def ngram_join(docs: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = 5) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id. Two rows link when their
    sets of lower-cased ``width``-word shingles have a Jaccard similarity of 0.75 or
    more; component_id is the smallest id that links reach."""
    return _components(docs, None, id_column, text, width).select("doc_id", "n_shingles", "component_id")


def first_of_each_group(docs: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = 5) -> DataFrame:
    """``docs`` with one row of each group of linked rows: that of the smallest id (null
    ids last, then by a hash of the row). Rows without words stay.

    Rows are told apart by all their columns, so ids may repeat or be null. What goes is
    stored before it is joined, so its size decides whether texts have to move."""
    row = F.xxhash64(*[F.col(c) for c in docs.columns])
    grouped = _components(docs, row, id_column, text, width).where("n_shingles > 0")
    rows = shared.stored(grouped.groupBy("row", "doc_id", "group").agg(F.count("*").alias("times")), "grouped")
    stays = rows.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")).select("group", F.col("first.row").alias("stays"))
    judged = rows.join(stays, "group")
    goes = shared.stored(judged.where("row <> stays or times > 1").select("row", (F.col("row") == F.col("stays")).alias("once")), "goes")
    kept = docs.join(goes.select(F.col("row").alias("__row")).distinct(), row == F.col("__row"), "left_anti")
    several = goes.where("once")
    if several.isEmpty():
        return kept
    # equal rows, of which one stays
    return kept.unionByName(docs.join(several.select(F.col("row").alias("__row")), row == F.col("__row"), "left_semi").dropDuplicates())


def _components(docs: DataFrame, row: Column | None, id_column: str, text: str, width: int) -> DataFrame:
    """Per row: row (as given), doc_id, n_shingles, component_id and group, a number that
    linked rows share."""
    spark = docs.sparkSession
    n_parts = shared.shuffle_partitions(spark)
    narrow = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"), (F.lit(None) if row is None else row).cast("long").alias("row"))
    sets = shared.stored(narrow.mapInArrow(partial(_describe, width=width), "doc_id long, n long, key long, check long, row long"), "sets")
    # a class goes by its key, so classes that share an id stay apart; ids only name components
    classes = sets.where("n > 0").groupBy("key", "check", "n").agg(F.min("doc_id").alias("rep"))
    classes = shared.stored(classes, "classes")
    flushes = narrow.select("text").mapInArrow(partial(_segments, text="text", width=width, n_parts=n_parts), "part int, blob binary")
    links = _links(classes, fragments.gathered(flushes, n_parts))
    labels = shared.stored(shared.components(links), "labels")
    named = classes.join(labels, F.col("key") == F.col("id"), "left").withColumn("linked", F.col("id").isNotNull()).drop("id")
    least = named.where("linked").groupBy("label").agg(F.min("rep").alias("least"))
    named = named.join(least, "label", "left").select(F.col("key").alias("k"), F.col("check").alias("c"), F.col("n").alias("m"), F.coalesce("label", "key").alias("group"), F.when(F.col("linked"), F.col("least")).otherwise(F.col("rep")).alias("component"))
    return sets.join(named, (F.col("key") == F.col("k")) & (F.col("check") == F.col("c")) & (F.col("n") == F.col("m")), "left").select(
        "row", "doc_id", "group", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id")
    )


def _links(classes: DataFrame, segments: DataFrame) -> DataFrame:
    ranked = (
        segments.select("key", F.arrays_zip("counts", "grams").alias("grams"), F.size("grams").alias("s"))
        .join(classes, "key")
        .where("4 * s >= 3 * n")
        .select(F.col("key").alias("id"), F.col("n").cast("int").alias("n"), F.col("s").cast("int").alias("s"), F.sort_array("grams").alias("grams"))
    )
    ranked = shared.stored(ranked, "ranked")
    keep = "s - (3 * n + 3) div 4 + 1"
    prefix = ranked.select("id", "n", "s", F.expr(f"posexplode(slice(grams, 1, {keep}))").alias("at", "g"))
    prefix = prefix.select(F.col("g.grams").alias("gram"), "id", "n", (F.col("n") - F.col("s")).alias("alone"), (F.col("s") - F.col("at")).alias("rest"))
    several = prefix.groupBy("gram").count().where("count > 1").select("gram")
    prefix = shared.stored(prefix.join(several, "gram"), "prefix")
    cut = shared.stored(
        ranked.select("id", F.explode(F.expr(f"transform(sequence(0, {PAIR_FRAGMENTS - 1}), f -> struct(f, transform(filter(grams, g -> pmod(shiftright(g.grams, 40), {PAIR_FRAGMENTS}) = f), g -> g.grams) as grams))")).alias("x")).select("id", "x.f", "x.grams").where("size(grams) > 0"),
        "fragments",
    )
    one = F.struct("id", "n", "label", "rest").alias("one")
    tried = found = None
    for turn in range(3):
        if turn == 0:
            now = prefix.withColumn("label", F.col("id"))
        else:
            labels = shared.stored(shared.components(found), "labels")
            now = prefix.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
        here = now.select("gram", one, F.col("id"), F.col("label"), F.col("alone"))
        if turn < 2:
            by = F.struct("alone", "id") if turn == 0 else F.struct(F.xxhash64("gram", "id"), "id")
            other = here.groupBy("gram").agg(F.min_by("one", by).alias("other"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("gram", "other")
            # stored, so that both sides of the join are plain shuffles, which Spark can split where a gram is hot
            other, left = shared.stored(other, "centres"), here.select("gram", "one")
        else:
            sizes = here.groupBy("gram", "label").count()
            main = sizes.groupBy("gram").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.count("*").alias("c")).where("c > 1").select("gram", "main")
            left = here.join(main, "gram").where("label <> main").select("gram", "one")
            other = here.select("gram", F.col("one").alias("other"))
        near = (
            left.join(other, "gram")
            .where("one.label <> other.label and 4 * least(one.n, other.n) >= 3 * greatest(one.n, other.n) and 7 * least(one.rest, other.rest) >= 3 * (one.n + other.n)")
            .select(F.expr("if(one.id < other.id, one, other)").alias("x"), F.expr("if(one.id < other.id, other, one)").alias("y"))
            .select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.expr("x.n + y.n").alias("both"))
            .distinct()
        )
        if tried is not None:
            near = near.join(tried, ["a", "b"], "left_anti")
        near = shared.stored(near, "pairs")
        passed = _verify(near, cut)
        tried = near.select("a", "b") if tried is None else tried.unionByName(near.select("a", "b"))
        found = shared.stored(passed if found is None else found.unionByName(passed), "found")
    return found


def _verify(pairs: DataFrame, cut: DataFrame) -> DataFrame:
    """The overlap of every pair, counted in each fragment by itself and summed."""
    first = cut.select(F.col("id").alias("a"), "f", F.col("grams").alias("grams_a"))
    second = cut.select(F.col("id").alias("b"), "f", F.col("grams").alias("grams_b"))
    part = pairs.join(first, "a").join(second, ["b", "f"]).select("a", "b", "both", F.size(F.array_intersect("grams_a", "grams_b")).alias("common"))
    return part.groupBy("a", "b", "both").agg(F.sum("common").alias("overlap")).where("7 * overlap >= 3 * both").select("a", "b")
