"""Removal of repeated byte strings by blockwise suffix sorting with a difference cover.

A byte goes when a string of ``length`` bytes over it also starts in a text of a smaller
id. Every such string holds one anchor, its smallest ``GRAM``-byte piece by hash, and
equal strings hold equal anchors, so they meet in one hash fragment. Texts whose anchors
stand in no other text are done after the first pass; of the others only the surroundings
of shared anchors are sent to the fragments.

In a fragment the surroundings make one local text. Its suffixes are sorted one bucket
of leading bytes at a time: by ``COVER`` bytes, then long ties by the ranks of a sample
of suffixes, those at a difference cover of the positions modulo ``COVER``, that were
computed before. Sorting holds one bucket and the sample's ranks, never all suffixes.
Surroundings are laid out with their anchors at multiples of ``COVER``, so equal strings
have equal residues and one offset leads all of a tie to its ranks. Neighbours in the
order that agree on ``length`` bytes are equal strings; the bytes themselves decide.

Defined results: null texts are empty. Rows of equal text: all but those of the smallest
id lose everything (if it has ``length`` bytes); rows that repeat an id are one document
each for itself and never remove each other. A null id counts as larger than all. Other
columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import fragments, shared

GRAM = 25
COVER = 31
# A perfect difference set modulo 31: every difference is one of two members, once.
DIFFERENCE_SET = (0, 1, 3, 8, 12, 18)
BUCKET = 200_000
SLICE_BYTES = 1_000_000
FLUSH_BYTES = 4_000_000
FINER = 12  # fragments of surroundings for each fragment of anchors
NO_ID = (1 << 63) - 1
AT = np.uint64((1 << 24) - 1)


def _least(hashes: np.ndarray, span: int, block: int | None = None) -> np.ndarray:
    """Place of the smallest hash (its high bits; the first one in a tie) among every
    ``span`` successive ones. Places are packed into the low bits of the hashes, counted
    from the begin of a block; blocks share ``span - 1`` places, so none cuts a window."""
    block = int(AT) + 2 - span if block is None else block
    least = np.empty(len(hashes) - span + 1, np.int64)
    for begin in range(0, len(least), block):
        part = hashes[begin : begin + block + span - 1]
        low = (part & ~AT) | np.arange(len(part), dtype=np.uint64)
        width = 1
        while 2 * width <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < span:
            low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
        least[begin : begin + block] = (low & AT).astype(np.int64) + begin
    return least


def anchors(data: np.ndarray, offsets: np.ndarray, length: int):
    """Runs of window starts with one anchor: (first start, last start, anchor, hash, row)."""
    empty = np.zeros(0, np.int64)
    n = len(data) - GRAM + 1
    span = length - GRAM + 1
    if n < span or len(data) < length:
        return empty, empty, empty, np.zeros(0, np.uint64), empty
    place = np.arange(n, dtype=np.int64)
    hashes = shared.rolling_hash(shared.running(data), place, place + GRAM)
    least = _least(hashes, span)
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(sizes)), np.maximum(0, sizes - length + 1))
    first = np.concatenate([[0], np.cumsum(np.maximum(0, sizes - length + 1))])
    start = np.arange(len(row)) - first[row] + offsets[row]
    anchor = least[start]
    fresh = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])])) if len(row) else empty
    last = np.append(fresh[1:], len(row)) - 1 if len(row) else empty
    # smallest hashes lie low, so they are mixed again before they are dealt out by value
    return start[fresh], start[last], anchor[fresh], shared.mix(hashes[anchor[fresh]] ^ np.uint64(0xA0761D6478BD642F)), row[fresh]


def _grams(batches: Iterator[pa.RecordBatch], length: int, n_parts: int):
    held, total = [], 0
    for batch in batches:
        for part, data, offsets in shared.text_slices(batch, "text", SLICE_BYTES):
            _, _, _, hashes, rows = anchors(data, offsets, length)
            hashes, rows = shared.distinct_in_rows(hashes, rows)
            held.append((hashes, part.column(0).to_numpy(zero_copy_only=False)[rows]))
            total += len(hashes)
            if total >= fragments.FLUSH_TOKENS:
                yield fragments.flush(held, n_parts)
                held, total = [], 0
    if total:
        yield fragments.flush(held, n_parts)


def _gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of all spans behind one another."""
    shift = starts - (np.cumsum(sizes) - sizes)
    return data[np.repeat(shift, sizes) + np.arange(int(sizes.sum()))]


def _surroundings(batches: Iterator[pa.RecordBatch], length: int, n_parts: int, n_ranges: int):
    """Rows (part, blob) with the bytes around shared anchors. Of equal surroundings in
    one flush only that of the smallest id goes to its fragment; the others are marked
    here, so a common passage reaches a fragment once per flush."""
    held, total = [], 0
    for batch in batches:
        for part, data, offsets in shared.text_slices(batch, "text", SLICE_BYTES):
            first, last, anchor, hashes, rows = anchors(data, offsets, length)
            grams = part.column(2)
            edge = np.asarray(grams.offsets)
            wanted = np.asarray(grams.values)[edge[0] : edge[-1]].view(np.uint32).astype(np.uint64)
            of = np.repeat(np.arange(part.num_rows, dtype=np.uint64), np.diff(edge))
            mine = fragments.full(hashes, n_parts) & np.uint64(0xFFFFFFFF)
            hit = np.isin(shared.mix(mine ^ shared.mix(rows.astype(np.uint64))), shared.mix(wanted ^ shared.mix(of)))
            first, sizes, lead, rows = first[hit], last[hit] + length - first[hit], anchor[hit] - first[hit], rows[hit]
            ids, keys = (part.column(k).to_numpy(zero_copy_only=False)[rows] for k in (0, 3))
            kind = shared.span_hash(data, first, first + sizes) + lead.astype(np.uint64)
            numbers = np.stack([ids, first - offsets[rows], lead, sizes, keys], 1)
            held.append((fragments.fragment_of(hashes[hit], n_ranges), kind, numbers, _gather(data, first, sizes)))
            total += int(sizes.sum())
            if total >= FLUSH_BYTES:
                yield _send(held, n_ranges)
                held, total = [], 0
    if total:
        yield _send(held, n_ranges)


def _send(held: list[tuple], n_ranges: int) -> pa.RecordBatch:
    where, kind, numbers, data = (np.concatenate([h[k] for h in held]) for k in range(4))
    at = np.cumsum(numbers[:, 3]) - numbers[:, 3]
    order = np.lexsort((numbers[:, 0], kind))
    begin = np.flatnonzero(np.concatenate([[True], kind[order[1:]] != kind[order[:-1]]]))
    least = np.empty(len(order), np.int64)
    least[order] = np.repeat(numbers[order[begin], 0], np.diff(np.append(begin, len(order))))
    later = numbers[:, 0] > least
    parts, blobs = [], []
    sent = np.flatnonzero(~later)
    sent = sent[np.argsort(where[sent], kind="stable")]
    edges = np.searchsorted(where[sent], np.arange(n_ranges + 1))
    for f in np.flatnonzero(np.diff(edges)).tolist():
        mine = sent[edges[f] : edges[f + 1]]
        parts.append(f)
        blobs.append(np.int64(len(mine)).tobytes() + numbers[mine].tobytes() + _gather(data, at[mine], numbers[mine, 3]).tobytes())
    if later.any():
        gone = numbers[later]
        blob = np.stack([gone[:, 4], gone[:, 1], gone[:, 1] + gone[:, 3]], 1).tobytes()
        parts.append(n_ranges + zlib.crc32(blob) % n_ranges)
        blobs.append(blob)
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])


RUNS = pa.schema([("key", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])


def _rows(keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Table:
    order = np.lexsort((starts, keys))
    keys, starts, ends = keys[order], starts[order], ends[order]
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    edges = np.append(begin, len(keys))
    return pa.table({"key": pa.array(keys[begin]), "starts": shared.lists(starts, edges, pa.int64()), "ends": shared.lists(ends, edges, pa.int64())}, schema=RUNS)


def repeats(number: int, blobs: list[bytes], length: int, n_ranges: int) -> pa.Table:
    """The ranges of one fragment that also start in a text of a smaller id."""
    if number >= n_ranges:
        marked = np.concatenate([np.frombuffer(b, np.int64).reshape(-1, 3) for b in blobs])
        return _rows(marked[:, 0], marked[:, 1], marked[:, 2])
    numbers, pieces = [], []
    for blob in blobs:
        n = int(np.frombuffer(blob[:8], np.int64)[0])
        numbers.append(np.frombuffer(blob[8 : 8 + 40 * n], np.int64).reshape(-1, 5))
        pieces.append(np.frombuffer(blob, np.uint8, offset=8 + 40 * n))
    numbers, data = np.concatenate(numbers), np.concatenate(pieces)
    ids, at, lead, sizes, keys = (numbers[:, k] for k in range(5))
    begin = np.cumsum(sizes) - sizes
    hashes = shared.span_hash(data, begin, begin + sizes) + lead.astype(np.uint64)
    _, one, kind = np.unique(hashes, return_index=True, return_inverse=True)
    least = np.full(len(one), NO_ID, np.int64)
    np.minimum.at(least, kind, ids)
    sizes = sizes[one]
    window, owner = equal_to_smaller(_gather(data, begin[one], sizes), sizes, lead[one], least, length)  # those also go for the kind's smallest id
    later = ids > least[kind]
    out = [(keys[later], at[later], at[later] + sizes[kind[later]])]
    if len(window):
        cut = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (window[1:] != window[:-1] + 1)]))
        run_owner, run_from, run_to = owner[cut], window[cut], window[np.append(cut[1:], len(window)) - 1] + length
        per = np.bincount(run_owner, minlength=len(one))
        base = np.concatenate([[0], np.cumsum(per)])
        firsts = np.flatnonzero(~later)
        firsts = firsts[per[kind[firsts]] > 0]
        many = per[kind[firsts]]
        who = np.repeat(firsts, many)
        pick = np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many) + base[kind[who]]
        out.append((keys[who], at[who] + run_from[pick], at[who] + run_to[pick]))
    return _rows(*(np.concatenate([o[k] for o in out]) for k in range(3)))


def _words(text: np.ndarray) -> np.ndarray:
    """Eight bytes from every position, as a number that sorts like them."""
    return np.ndarray((len(text) - 7,), ">u8", text, 0, (1,))


def _keys(words: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """COVER bytes from each position as four numbers that sort like the bytes."""
    keys = [words[at + k].astype(np.uint64) for k in range(0, COVER, 8)]
    keys[-1] >>= np.uint64(8 * (8 * len(keys) - COVER))
    return keys


def _ranks(columns: list[np.ndarray]) -> np.ndarray:
    """Dense ranks of rows; the first column counts most."""
    order = np.lexsort(columns[::-1])
    step = np.zeros(len(order), bool)
    for c in columns:
        s = c[order]
        step[1:] |= s[1:] != s[:-1]
    ranks = np.empty(len(order), np.int32)
    ranks[order] = np.cumsum(step)
    return ranks


def equal_to_smaller(data: np.ndarray, sizes: np.ndarray, lead: np.ndarray, least: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(window start, kind) of windows that equal one of a kind with a smaller id, in
    order of kind and start. Kind k has ``sizes[k]`` bytes of ``data`` and its anchor at
    ``lead[k]`` in them; ``least[k]`` is its smallest id."""
    room = -(-(sizes + COVER + 1) // COVER) * COVER + COVER
    base = np.concatenate([[0], np.cumsum(room)[:-1]]) + (-lead) % COVER
    text = np.full(int(room.sum()) + 4 * COVER + length, 0xFF, np.uint8)  # no UTF-8 text holds this byte
    text[np.repeat(base - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(data))] = data
    words = _words(text)
    counts = sizes - length + 1
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), counts)
    start = np.repeat(base - (np.cumsum(counts) - counts), counts) + np.arange(len(owner))
    # a string whose hash stands alone equals no other: only the rest is sorted
    hashes = shared.rolling_hash(shared.running(text), start, start + length)
    order = np.argsort(hashes)
    same = hashes[order[1:]] == hashes[order[:-1]]
    several = np.zeros(len(order), bool)
    several[order[1:]] |= same
    several[order[:-1]] |= same
    del hashes, order, same
    owner, start = owner[several], start[several]
    residue = (start % COVER).astype(np.int8)
    offset = np.array([min(d for d in range(COVER) if (r + d) % COVER in DIFFERENCE_SET) for r in range(COVER)])
    # ranks of the cover sample that ties will ask for: by COVER bytes, then doubled
    sample = np.unique(start + offset[residue])
    depth = COVER
    while depth < length:
        sample = np.union1d(sample, np.minimum(sample + depth, len(text) - 2 * COVER))
        depth *= 2
    rank = np.zeros(len(text), np.int32)
    rank[sample] = _ranks(_keys(words, sample)) + 1
    depth = COVER
    while depth < length:
        rank[sample] = _ranks([rank[sample], rank[np.minimum(sample + depth, len(text) - 1)]]) + 1
        depth *= 2
    gone = np.zeros(len(start), bool)
    leading = text[start].astype(np.int32) * 256 + text[start + 1]
    by_lead = np.argsort(leading, kind="stable")
    edges = np.concatenate([[0], np.cumsum(np.bincount(leading, minlength=1 << 16))])
    lo = 0
    while lo < 1 << 16:  # a bucket: leading byte pairs with about BUCKET suffixes together
        hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + BUCKET, "right")) - 1)
        mine = by_lead[edges[lo] : edges[hi]]
        lo = hi
        if len(mine) < 2:
            continue
        s = start[mine]
        order = np.lexsort([rank[s + offset[residue[mine]]], residue[mine], *_keys(words, s)[::-1]])
        mine, s = mine[order], s[order]
        same = np.ones(len(s), bool)
        same[0] = False
        for b in [*range(0, length - 7, 8), length - 8]:
            c = words[s + b]
            same[1:] &= c[1:] == c[:-1]
        begin = np.flatnonzero(~same)
        smallest = np.minimum.reduceat(least[owner[mine]], begin)
        gone[mine] = least[owner[mine]] > np.repeat(smallest, np.diff(np.append(begin, len(s))))
    owner = owner[gone]
    return start[gone] - base[owner], owner


CUT = "sha string, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"


def _cut(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        rows = []
        for r in range(batch.num_rows):
            sha, text, starts, ends = (batch.column(k)[r].as_py() for k in range(4))
            spans: list[list[int]] = []
            for a, z in sorted(zip(starts, ends)):
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(z, spans[-1][1])
                else:
                    spans.append([a, z])
            kept, at = [], 0
            for a, z in spans:
                kept.append(text[at:a])
                at = z
            kept.append(text[at:])
            rows.append((sha, sum(z - a for a, z in spans), len(spans), hashlib.sha256(b"".join(kept)).hexdigest(), [{"start": a, "end": z} for a, z in spans]))
        columns = list(zip(*rows)) or [[]] * 5
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string(), span))], ["sha", "n_removed", "n_spans", "kept_sha256", "spans"])


def suffix_dedup(docs: DataFrame, id_column: str = "doc_id", text: str = "text", length: int = 50) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed byte
    ranges ``spans`` (start, end)."""
    if length <= GRAM:
        raise ValueError(f"length must be over {GRAM} bytes")
    if length > int(AT) // 2:
        raise ValueError(f"length must be {int(AT) // 2} bytes at most")
    spark = docs.sparkSession
    n_parts = shared.shuffle_partitions(spark)
    n_ranges = FINER * n_parts
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    narrow = docs.select(F.col(id_column).cast("long").alias("doc_id"), body.alias("text"))
    order = F.coalesce("doc_id", F.lit(NO_ID))
    hashed = narrow.select("doc_id", "text", F.sha2(F.col("text"), 256).alias("sha"), order.alias("order"))
    described = shared.stored(hashed.select("doc_id", "sha", "order", F.octet_length("text").cast("long").alias("n_bytes"), F.xxhash64("sha").alias("key")), "texts")
    classes = described.where(f"n_bytes >= {length}").groupBy("sha", "key").agg(F.min("order").alias("id"))

    def range_fragment(part: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        return repeats(part[0].as_py(), group.column("blob").to_pylist(), length, n_ranges)

    long = hashed.where(F.octet_length("text") >= length).select(F.xxhash64("sha").alias("key"), "text")
    flushes = long.mapInArrow(partial(_grams, length=length, n_parts=n_parts), "part int, blob binary")
    # 32 bits are enough here: one hash too many only sends surroundings in vain
    common = shared.stored(fragments.gathered(flushes, n_parts, narrow=True).join(classes, "key").select("sha", "key", "id", "grams"), "common")
    texts = hashed.select(F.col("sha").alias("sha_"), F.col("order").alias("id_"), "text")
    its_text = (F.col("sha") == F.col("sha_")) & (F.col("id") == F.col("id_"))
    # stored, so that surroundings are packed by as many tasks as the bytes want, not by every partition of the join
    candidates = shared.stored(common.join(texts, its_text).select("id", "text", "grams", "key", "sha"), "candidates")
    runs = (
        candidates.select("id", "text", "grams", "key")
        .mapInArrow(partial(_surroundings, length=length, n_parts=n_parts, n_ranges=n_ranges), "part int, blob binary")
        .groupBy("part")
        .applyInArrow(range_fragment, "key long, starts array<long>, ends array<long>")
        .groupBy("key")
        .agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"))
    )
    ranges = shared.stored(runs, "ranges")
    cut = shared.stored(candidates.select("key", "sha", F.col("text").cast("binary").alias("text")).join(ranges, "key").select("sha", "text", "starts", "ends").mapInArrow(_cut, CUT).dropDuplicates(["sha"]), "cut")
    # stored, so that the rows of one text are joined by a plain shuffle, which Spark can split
    per_text = shared.stored(classes.select("sha", "id").join(cut, "sha", "left"), "per-text")
    plain = described.join(per_text, "sha", "left")
    whole = (F.col("order") > F.col("id")) & (F.col("n_bytes") >= length)
    return plain.select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(whole, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))).otherwise(F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>"))).alias("spans"),
    )
