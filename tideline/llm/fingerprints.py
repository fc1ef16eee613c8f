"""Document fingerprints: one-permutation MinHash with optimal densification and packed bits.

Shingles are five words, split at ASCII white space after lower-casing A-Z. Each is hashed
once: the high bits name one of ``BINS`` bins, and a bin keeps its smallest hash. An empty
bin borrows from the first bin with a hash among those that it tries, in a random order of
its own that is the same for all texts, so all bins are filled after one permutation. The
low ``BITS`` bits of every bin are packed behind one another into the fingerprint.

Likeness is the share of equal bins, corrected for the ones that agree by chance:
(share - 2^-BITS) / (1 - 2^-BITS), 0 at least.

All of it is DataFrame functions. Fingerprints are made where texts are read. Followers
come from ids in ranges, so no task sees all of them. For edited texts each text is sent
to its own key once, and its head from there to the text that it follows.

Defined results: null text is empty. A text of fewer than five words is one shingle; one
without words has the empty fingerprint, of likeness 1 with itself and 0 with others.
Rows that repeat an id follow one another in the order of their texts' SHA-256; null ids
come last. A table of one row follows itself. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm import shared

BINS, BITS = 256, 8
TRIES = 16
KEY = ["k", "gone", "sha"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANK = r"\x20\x09-\x0D"


def attempts(bins: int = BINS) -> np.ndarray:
    """Row i: all bins but i in the order in which bin i tries them."""
    i = np.arange(bins, dtype=np.uint64)
    draws = shared.mix((i[:, None] << np.uint64(32)) + i[None, :] + np.uint64(0x0DE5))
    np.fill_diagonal(draws, np.iinfo(np.uint64).max)
    return draws.argsort(1, kind="stable")[:, :-1]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _numbers(values: np.ndarray) -> Column:
    return F.split(F.lit(",".join(map(str, values.ravel().tolist()))), ",").cast("array<int>")


def shingle_hashes(text: Column) -> Column:
    """The hashes of a text's shingles."""
    words = F.filter(F.split(F.translate(text, UPPER, LOWER), f"[{BLANK}]+"), lambda w: w != "")

    def hashes(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(5)]))
        return F.when(F.size(w) >= 5, runs).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))

    return _let(words, hashes)


def fingerprint(text: Column) -> Column:
    """Array of BINS numbers of BITS bits; empty for a text without words."""
    shift = 64 - (BINS - 1).bit_length()
    bin_of = lambda x: (F.shiftright(x, shift) + BINS // 2).cast("int")  # noqa: E731  ascending like the hashes
    low = lambda x: x.bitwiseAND((1 << BITS) - 1).cast("int")
    tried = attempts()
    rank = np.empty((BINS, BINS), np.int64)
    np.put_along_axis(rank, tried, np.arange(BINS - 1)[None, :], 1)
    np.fill_diagonal(rank, BINS)
    tries, ranks = _numbers(tried[:, :TRIES]), _numbers(rank)

    def smallest(hashes: Column) -> Column:
        """The smallest hash of each bin that has one."""
        return F.filter(hashes, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(hashes, i - 1))))

    def spread(mins: Column) -> Column:
        """One number per bin, null where it is empty."""
        gap = lambda x, i: bin_of(x) - F.coalesce(bin_of(F.get(mins, i - 1)), F.lit(-1)) - 1
        none = lambda n: F.array_repeat(F.lit(None).cast("int"), n)
        parts = F.flatten(F.transform(mins, lambda x, i: F.concat(none(gap(x, i)), F.array(low(x)))))
        return F.concat(parts, none(F.lit(BINS - 1) - bin_of(F.get(mins, F.size(mins) - 1))))

    def filled(mins: Column, values: Column) -> Column:
        def borrowed(i: Column) -> Column:
            some = [F.get(values, F.get(tries, i * TRIES + t)) for t in range(TRIES)]
            # beyond these tries: the bin that comes first of all that have a hash
            first = F.array_min(F.transform(mins, lambda x: F.get(ranks, i * BINS + bin_of(x)) * (1 << BITS) + low(x)))
            return F.coalesce(*some, low(first))

        return F.transform(values, lambda v, i: F.coalesce(v, borrowed(i)))

    def bins(mins: Column) -> Column:
        whole = F.transform(mins, low)
        packed = _let(spread(mins), lambda values: filled(mins, values))
        return F.when(F.size(mins).isin(0, BINS), whole).otherwise(packed)

    return _let(F.array_sort(shingle_hashes(text)), lambda h: _let(smallest(h), bins)).cast("array<smallint>")


def packed(bins: Column) -> Column:
    """The fingerprint as hexadecimal digits."""
    digits = F.split(F.lit(",".join(f"{v:0{BITS // 4}x}" for v in range(1 << BITS))), ",")
    return F.array_join(F.transform(bins, lambda v: F.get(digits, v.cast("int"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the texts behind two fingerprints' bins."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    chance = 2.0**-BITS
    share = F.greatest(F.lit(0.0), (equal / float(BINS) - chance) / (1 - chance))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(share)


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars, fingerprint."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(id_column).alias("doc_id"), F.char_length(body).cast("long").alias("n_chars"), packed(fingerprint(body)).alias("fingerprint"))


def _followed(rows: DataFrame) -> DataFrame:
    """Rows (k, gone, sha, n_chars, bins, times, next) of each different row, with the one
    after it; a row that is repeated also follows itself."""
    n = shared.shuffle_partitions(rows.sparkSession)
    prints = rows.select(*KEY, F.char_length("text").cast("long").alias("n_chars"), fingerprint(F.col("text")).alias("bins"))
    one = shared.stored(prints, "prints").groupBy(*KEY).agg(F.count("*").alias("times"), F.first("n_chars").alias("n_chars"), F.first("bins").alias("bins"))
    order = ["gone", "k", "sha"]
    ranged = shared.stored(one.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "ranged")
    me = F.struct(*order, "bins")
    heads = ranged.groupBy("part").agg(F.min(me).alias("head"))
    by_part = Window.orderBy("part")  # one row per part
    heads = heads.select("part", F.coalesce(F.lead("head").over(by_part), F.first("head").over(by_part)).alias("after"))
    linked = ranged.withColumn("next", F.lead(me).over(Window.partitionBy("part").orderBy(*order))).join(heads, "part")
    linked = linked.withColumn("next", F.coalesce("next", "after")).drop("after", "part")
    selves = linked.where("times > 1").withColumn("next", me).withColumn("times", F.col("times") - 1)
    return linked.withColumn("times", F.lit(1).cast("long")).unionByName(selves)


def edited_pairs(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars, edited (the text whose last quarter is replaced by as
    much of the next one's beginning), fingerprint, edited_fingerprint, near_edited and
    near_next."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(0).cast("long")).alias("k"), F.col(id_column).isNull().alias("gone"), F.sha2(body, 256).alias("sha"), body.alias("text"))
    links = _followed(rows)
    links = links.select(
        *[F.col(c).alias(f"_{c}") for c in KEY], *[F.col(f"next.{c}").alias(c) for c in KEY], F.expr("cast(n_chars div 4 as int)").alias("quarter"), "n_chars", "times", "bins", likeness(F.col("bins"), F.col("next.bins")).alias("near_next")
    )
    links = shared.stored(links, "links")
    texts = rows.groupBy(*KEY).agg(F.first("text").alias("text"))
    heads = texts.join(links, KEY).select(*[F.col(f"_{c}").alias(c) for c in KEY], F.expr("left(text, quarter)").alias("head"), "n_chars", "quarter", "times", "bins", "near_next")
    edited = texts.join(heads, KEY).select("k", "gone", "n_chars", "times", "bins", "near_next", F.expr("concat(left(text, cast(n_chars as int) - quarter), head)").alias("edited"))
    edited = edited.withColumn("edited_bins", fingerprint(F.col("edited")))
    result = edited.select(
        F.when(~F.col("gone"), F.col("k")).alias("doc_id"), "n_chars", "edited", packed(F.col("bins")).alias("fingerprint"), packed(F.col("edited_bins")).alias("edited_fingerprint"),
        likeness(F.col("bins"), F.col("edited_bins")).alias("near_edited"), "near_next", "times",
    )
    return result.withColumn("__turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("__turn", "times")
