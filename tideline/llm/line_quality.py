"""Quality rules: base rules per document and line frequency across documents.

Lines are normalised (A-Z lower-cased, digits as 0, white space as single blanks) and
hashed. Per host, the distinct texts that hold a line are counted; a line is above the
limits when they are more than ``least_docs`` and more than ``share`` of the host's texts.
Such lines are removed from all texts of the host but the one with the smallest id, which
keeps what it brought first. A document is depleted, and rejected, when over half of its
words go with removed lines. Copies of one text count once: that they are many is for
deduplication to judge, and makes none of their lines boilerplate.

Counts are combined in every task before they are shuffled, so a line of every document
of one host costs a row per task. The lines above the limits are few (each stands in more
than ``least_docs`` texts) and stored before they are joined back, so that their size
decides how.

Defined results: null is the empty text: no words, base_failed. A missing host is a host
of its own. Lines without a word are never counted or removed. Repeated rows get equal
results; a null id counts as larger than all. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import shared

LEAST_DOCS = 10
SHARE = 0.005
MIN_WORDS = 50
NO_ID = (1 << 63) - 1
SYMBOLS = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])
NORMAL = bytes(0x20 if k in (0x09, 0x0B, 0x0C, 0x0D) else 0x30 if 0x30 <= k <= 0x39 else k + 32 if 0x41 <= k <= 0x5A else k for k in range(256))
SCHEMA = "doc_id long, host string, text_key long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<long>, line_words array<int>"


def _counted(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _repeated(words: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Per row, the words in three-word windows that stand in it twice or more."""
    covered = np.zeros(len(words), bool)
    if len(words) >= 3:
        inside = np.flatnonzero(rows[:-2] == rows[2:])
        key = words[inside] * shared._STEP[0] + words[inside + 1] * shared._STEP[1] + words[inside + 2] * shared._STEP[2]
        key = shared.mix(shared.mix(key) ^ shared.mix(rows[inside].astype(np.uint64)))
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        at = inside[order[twice]]
        for k in range(3):
            covered[at + k] = True
    return np.bincount(rows[covered], minlength=n_rows)


def normal_lines(text: bytes) -> list[bytes]:
    return [b" ".join(line.split()) for line in text.translate(NORMAL).split(b"\n")]


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offsets in shared.text_slices(batch, "text"):
            n = part.num_rows
            starts, ends, rows = shared.word_spans(data, offsets)
            words = shared.span_hash(data, starts, ends)
            inside = ~shared._SPACE[data]
            raw = data.tobytes()
            dups, lines, sizes, edges = [], [], [], [0]
            for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                text = raw[a:z]
                own = [line for line in text.split(b"\n") if line.strip()]
                dups.append(len(own) - len(set(own)))
                held: dict[bytes, int] = {}
                for line in normal_lines(text):
                    if line:
                        held[line] = held.get(line, 0) + line.count(b" ") + 1
                lines += [xxhash.xxh3_64_intdigest(x) for x in held]
                sizes += held.values()
                edges.append(len(lines))
            columns = [
                part.column(0),
                part.column(1),
                part.column(2),
                pa.array(np.bincount(rows, minlength=n).astype(np.int64)),
                pa.array(_counted(inside & ((data & 0xC0) != 0x80), offsets)),
                pa.array(_counted(SYMBOLS[data], offsets)),
                pa.array(dups, pa.int64()),
                pa.array(_repeated(words, rows, n).astype(np.int64)),
                shared.lists(np.array(lines, np.uint64).view(np.int64), np.array(edges), pa.int64()),
                shared.lists(np.array(sizes, np.int32), np.array(edges), pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in SCHEMA.split(", ")])


def base_failed(n_words, n_repeat_words):
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > 50 * n_words)


def _narrow(docs: DataFrame, id_column: str, text: str, host: str) -> list:
    body = F.coalesce(docs[text].cast("string"), F.lit(""))
    return [docs[id_column].cast("long").alias("doc_id"), F.coalesce(docs[host].cast("string"), F.lit("")).alias("host"), F.xxhash64(body).alias("text_key"), body.alias("text")]


def _verdicts(docs: DataFrame, id_column: str, text: str, host: str, least_docs: int, share: float) -> DataFrame:
    rows = docs.select(*_narrow(docs, id_column, text, host))
    described = shared.stored(rows.mapInArrow(_describe, SCHEMA), "lines").withColumn("order", F.coalesce("doc_id", F.lit(NO_ID)))
    above = _above(described, least_docs, share)
    removed = (
        _host_lines(described)
        .join(above, "line")
        .where("order <> first")
        .dropDuplicates(["host", "text_key", "order", "line"])
        .groupBy("host", "text_key", "order")
        .agg(F.sum("words").alias("n_removed_words"))
    )
    return (
        described.drop("lines", "line_words")
        .join(shared.stored(removed, "removed"), ["host", "text_key", "order"], "left")
        .withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)).cast("long"))
        .withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
        .withColumn("depleted", 2 * F.col("n_removed_words") > F.col("n_words"))
        .withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))
    )


def line_quality(docs: DataFrame, id_column: str = "doc_id", text: str = "text", host: str = "source", least_docs: int = LEAST_DOCS, share: float = SHARE) -> DataFrame:
    """Per row: doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, n_removed_words, depleted, kept."""
    columns = "doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed_words, depleted, kept"
    return _verdicts(docs, id_column, text, host, least_docs, share).select(*columns.split(", "))


def _host_lines(described: DataFrame) -> DataFrame:
    pairs = described.select("host", "text_key", "order", F.explode(F.arrays_zip("lines", "line_words")).alias("x"))
    return pairs.select("host", "text_key", "order", F.xxhash64("host", "x.lines").alias("line"), F.col("x.line_words").alias("words"))


def _above(described: DataFrame, least_docs: int, share: float) -> DataFrame:
    """(line, first): the lines above the limits, and the smallest id that holds each."""
    texts = described.groupBy("host", "text_key").agg(F.min("order").alias("order"), F.first("lines").alias("lines"), F.first("line_words").alias("line_words"))
    hosts = described.groupBy("host", "text_key").count().groupBy("host").agg(F.greatest(F.lit(least_docs), F.floor(F.count("*") * F.lit(share))).alias("limit"))
    counts = _host_lines(texts).groupBy("line").agg(F.count("*").alias("docs"), F.min("order").alias("first"), F.first("host").alias("host")).where(F.col("docs") > least_docs)
    return shared.stored(counts.join(hosts, "host").where("docs > limit").select("line", "first"), "above")


def kept_documents(docs: DataFrame, id_column: str = "doc_id", text: str = "text", host: str = "source", least_docs: int = LEAST_DOCS, share: float = SHARE) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns. The base rules
    look at each row by itself; only the depleted ones have to be joined away."""
    depleted = _verdicts(docs, id_column, text, host, least_docs, share).where("depleted and not base_failed")
    depleted = shared.stored(depleted.select(F.col("host").alias("__host"), F.col("text_key").alias("__key"), F.col("order").alias("__order")).distinct(), "depleted")

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in shared.text_slices(batch, text):
                starts, ends, rows = shared.word_spans(data, offsets)
                words = shared.span_hash(data, starts, ends)
                failed = base_failed(np.bincount(rows, minlength=part.num_rows), _repeated(words, rows, part.num_rows))
                yield part.filter(pa.array(~failed))

    order = F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID))
    same = (F.coalesce(F.col(host).cast("string"), F.lit("")) == F.col("__host")) & (F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))) == F.col("__key")) & (order == F.col("__order"))
    return docs.mapInArrow(passing, docs.schema).join(depleted, same, "left_anti")


def without_lines(docs: DataFrame, id_column: str = "doc_id", text: str = "text", host: str = "source", least_docs: int = LEAST_DOCS, share: float = SHARE) -> DataFrame:
    """(doc_id, host, text): every row's text without its lines above the limits."""
    rows = docs.select(*_narrow(docs, id_column, text, host))
    described = shared.stored(rows.mapInArrow(_describe, SCHEMA), "lines").withColumn("order", F.coalesce("doc_id", F.lit(NO_ID)))
    above = _above(described, least_docs, share)
    gone = _host_lines(described).join(above, "line").where("order <> first").groupBy("host", "text_key", "order").agg(F.collect_set("line").alias("gone"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                text, hashes, gone = (batch.column(c)[k].as_py() for c in (2, 3, 4))
                drop = {h for h, line in zip(hashes, dict.fromkeys(x for x in normal_lines(text.encode()) if x)) if line and h in set(gone)} if gone else set()
                kinds = dict(zip(dict.fromkeys(x for x in normal_lines(text.encode()) if x), hashes))
                out.append("\n".join(raw for raw, line in zip(text.split("\n"), normal_lines(text.encode())) if kinds.get(line) not in drop) if drop else text)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["doc_id", "host", "text"])

    hashes = described.select("host", "text_key", "order", F.expr("transform(lines, x -> xxhash64(host, x))").alias("hashes")).dropDuplicates(["host", "text_key", "order"])
    joined = rows.withColumn("order", F.coalesce("doc_id", F.lit(NO_ID))).join(gone, ["host", "text_key", "order"], "left").join(hashes, ["host", "text_key", "order"])
    return joined.select("doc_id", "host", "text", "hashes", "gone").mapInArrow(cut, "doc_id long, host string, text string")
