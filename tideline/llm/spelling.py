"""Spelling variants by permuterm rotations.

A word with a terminator, as in ``word$``, has one rotation per position. Words that differ
in one replaced code point have rotations that agree in all but the last one, and a word
without one of another's code points is that common beginning: ``b$a`` is a rotation of
``ab`` and, without its end, one of each ``axb``. So all rotations are dealt and sorted by
the beginning that skips the last code point, together with the whole rotations, and
neighbours stand behind one another. A group holds one word per code point of the alphabet
and one shorter word, whatever the corpus, so it is scanned and each word gets its number
of neighbours and its best one; pairs are not made.

A code point can be left out of a run of equal ones at several places; only the first
place counts, so each pair of words is found once.

Forms are followed from the roots down: a form has at least twice its variant's count, so
there are at most about as many rounds as the largest count has bits.

Defined results: null texts have no word; a null id is written as nothing before the
colon. Repeated rows count again. Ties of counts go to the smallest word in code-point
order. No words, or an empty table, give no row. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import shared

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
END = "$"  # stands in no word
MANGLE = 97
HELD_WORDS = 300_000


def _words(batches: Iterator[pa.RecordBatch]):
    """(word, n): counts of a task's texts, given out before they grow large."""
    held: Counter = Counter()
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if not text:
                continue
            prefix = zlib.crc32(("" if key is None else f"{key}").encode() + b":")
            for run, n in Counter(RUN.findall(text.encode().translate(LOWER).decode())).items():
                h = zlib.crc32(run.encode(), prefix)
                if h % MANGLE == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1 :]
                held[run] += n
            if len(held) >= HELD_WORDS:
                yield _counted(held)
                held = Counter()
    if held:
        yield _counted(held)


def _counted(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])


def vocabulary(docs: DataFrame, id_column: str = "doc_id", text: str = "text", least_chars: int = 5, least_count: int = 3) -> DataFrame:
    """(word, n) of the words with ``least_chars`` code points and ``least_count``
    occurrences or more."""
    narrow = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    counted = narrow.mapInArrow(_words, "word string, n long").where(F.char_length("word") >= least_chars)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def rotations(words: DataFrame) -> DataFrame:
    """(key, last, n, first): of every rotation the beginning, with its last code point
    (``first``: no equal one stands before that in the word), and the whole rotation,
    whose ``last`` is empty."""
    rows = words.withColumn("size", F.char_length("word")).select("word", "n", "size", F.explode(F.expr("sequence(0, size)")).alias("i"))
    # the i code points before the cut follow the terminator
    turned = F.expr(f"concat(substring(word, i + 1), '{END}', left(word, i))")
    whole = rows.select(turned.alias("key"), F.lit("").alias("last"), "n", F.lit(True).alias("first"))
    skipped = rows.where("i > 0").select(
        F.expr(f"concat(substring(word, i + 1), '{END}', left(word, i - 1))").alias("key"), F.expr("substring(word, i, 1)").alias("last"), "n", F.expr("i = 1 or substring(word, i - 1, 1) <> substring(word, i, 1)").alias("first")
    )
    return whole.unionByName(skipped)


NEAR = "word string, n_near long, best long, form string"


def _scan(batches: Iterator[pa.RecordBatch]):
    """Reads sorted rotations group by group, some groups at a time."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        key = table.column("key").combine_chunks()
        cut = len(key) - 1
        while cut > 0 and key[cut - 1] == key[-1]:
            cut -= 1
        if cut:
            yield from neighbours(table.slice(0, cut).combine_chunks())
        rest = table.slice(cut)
    if rest is not None:
        yield from neighbours(rest.combine_chunks())


def neighbours(table: pa.Table):
    """Rows (word, n_near, best, form) of whole groups; a word's neighbours in one group
    are the others of its length, and those one code point longer or shorter."""
    key = table.column("key").combine_chunks()
    differs = np.concatenate([[True], np.asarray(pc.not_equal(key[1:], key[:-1]))]) if len(key) > 1 else np.ones(len(key), bool)
    group = np.cumsum(differs) - 1
    several = np.bincount(group)[group] > 1
    if not several.any():
        return
    table, group = table.filter(pa.array(several)), np.unique(group[several], return_inverse=True)[1]
    n, first = table.column("n").to_numpy(), table.column("first").to_numpy()
    last = table.column("last").combine_chunks()
    skips = np.asarray(pc.not_equal(last, ""))
    # the smaller the rank, the better: larger counts, then earlier code points
    point = np.array([ord(c) if c else 0 for c in last.to_pylist()], np.int64)
    order = np.lexsort((point, -n, group))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    size, none = int(group[-1]) + 1, len(order)

    def best_two(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of the best and second best of each group."""
        one, two = np.full(size, none), np.full(size, none)
        np.minimum.at(one, group[of], rank[of])
        rest = of[rank[of] != one[group[of]]]
        np.minimum.at(two, group[rest], rank[rest])
        return one, two

    words = table.select(["key", "last"])

    def found(of: np.ndarray, counts: np.ndarray, best: np.ndarray):
        """Words ``of`` with the number of their neighbours and their best one's row."""
        if len(of):
            yield pa.RecordBatch.from_arrays([_word(words, of), pa.array(counts.astype(np.int64)), pa.array(n[best]), _word(words, best)], [c.split()[0] for c in NEAR.split(", ")])

    equal = np.flatnonzero(skips)
    count = np.bincount(group[equal], minlength=size)
    one, two = best_two(equal)
    mine = equal[count[group[equal]] > 1]
    other = np.where(rank[mine] == one[group[mine]], two[group[mine]], one[group[mine]])
    yield from found(mine, count[group[mine]] - 1, order[other] if len(mine) else mine)
    short = np.flatnonzero(~skips)
    at = np.full(size, -1)
    at[group[short]] = short
    longer = equal[first[equal]]
    with_short = longer[at[group[longer]] >= 0]
    yield from found(with_short, np.ones(len(with_short)), at[group[with_short]])
    count = np.bincount(group[longer], minlength=size)
    one, _ = best_two(longer)
    mine = short[count[group[short]] > 0]
    yield from found(mine, count[group[mine]], order[one[group[mine]]] if len(mine) else mine)


def _word(rows: pa.Table, at: np.ndarray) -> pa.Array:
    """The words of rotations: what follows the terminator, the last one, the beginning."""
    key, last = rows.column("key").combine_chunks().take(pa.array(at)), rows.column("last").combine_chunks().take(pa.array(at))
    halves = pc.split_pattern(key, END)
    return pc.binary_join_element_wise(pc.list_element(halves, 1), last, pc.list_element(halves, 0), "")


def spelling_variants(docs: DataFrame, id_column: str = "doc_id", text: str = "text", least_chars: int = 5, least_count: int = 3) -> DataFrame:
    """Per word: word, n, n_near, form, form_n and root."""
    words = shared.stored(vocabulary(docs, id_column, text, least_chars, least_count), "words")
    n_parts = shared.shuffle_partitions(docs.sparkSession)
    dealt = rotations(words).repartition(n_parts, "key").sortWithinPartitions("key", "last")
    near = dealt.mapInArrow(_scan, NEAR).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best")).alias("less"), "form")).alias("best"))
    joined = words.join(near, "word", "left").withColumn("best_n", -F.col("best.less"))
    has = F.col("best_n") >= 2 * F.col("n")
    joined = joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best.form")).alias("form"), F.when(has, F.col("best_n")).alias("form_n"))
    joined = shared.stored(joined, "forms")
    return joined.join(_roots(joined), "word", "left").withColumn("root", F.coalesce("root", "word"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form. A round gives the root of the last
    round's words to those whose form they are; a word is the form of its neighbours only."""
    below = forms.where("form is not null").select("word", "form")
    reached = forms.where("form is null").select("word", F.col("word").alias("root"))
    all_roots = None
    while True:
        reached = shared.stored(below.join(reached.withColumnRenamed("word", "form"), "form").select("word", "root"), "roots")
        if reached.isEmpty():
            return reached if all_roots is None else all_roots
        all_roots = reached if all_roots is None else all_roots.unionByName(reached)
