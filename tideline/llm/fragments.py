"""Which hashes several keys share, found in hash fragments.

A fragment is a range of hash values. ``flush`` packs the hashes of a few thousand keys
into one row per fragment, ``shared_grams`` finds, inside one fragment, the hashes that
two or more keys have, and ``by_key`` gives each key its own; ``gathered`` does both. Hashes that ``COMMON`` or more keys of
one flush have go past the fragments, which get a mark, so that no fragment receives one
hash from every key of the corpus.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tideline.llm import shared

FLUSH_TOKENS = 1_000_000
PIECE_TOKENS = 400_000  # what one step inside a fragment works on
COMMON = 64  # the number of keys with a hash is known up to this
LOW48 = np.uint64((1 << 48) - 1)


def fragment_of(hashes: np.ndarray, n_parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(48)) * np.uint64(n_parts) >> np.uint64(16)).astype(np.uint16)


def full(hashes: np.ndarray, n_parts: int) -> np.ndarray:
    """The form in which a shared hash comes back."""
    return fragment_of(hashes, n_parts).astype(np.uint64) << np.uint64(48) | hashes & LOW48


def _six(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unsix(b: memoryview) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view(np.uint64)


def _pack(keys: np.ndarray, counts: np.ndarray, grams: np.ndarray, common: np.ndarray) -> bytes:
    head = np.array([len(keys), len(grams), len(common)], np.int64)
    return head.tobytes() + keys.tobytes() + counts.astype(np.uint32).tobytes() + _six(grams) + _six(common)


def _unpack(view: memoryview):
    k, g, c = np.frombuffer(view[:24], np.int64)
    a, b = 24 + 8 * k, 24 + 12 * k
    return np.frombuffer(view[24:a], np.int64), np.frombuffer(view[a:b], np.uint32), _unsix(view[b : b + 6 * g]), _unsix(view[b + 6 * g : b + 6 * (g + c)])


def flush(held: list[tuple], n_parts: int) -> pa.RecordBatch:
    grams, keys = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    _, first = np.unique(keys[edge], return_index=True)  # a set that came before adds nothing
    sizes = np.diff(np.append(edge, len(keys)))
    fresh = np.zeros(len(edge), bool)
    fresh[first] = True
    fresh = np.repeat(fresh, sizes)
    grams, keys = grams[fresh], keys[fresh]
    frags = fragment_of(grams, n_parts)
    order = np.argsort(frags, kind="stable")
    grams, keys, frags = grams[order], keys[order], frags[order]
    sorted_grams = np.sort(grams)
    edges = np.flatnonzero(np.concatenate([[True], sorted_grams[1:] != sorted_grams[:-1], [True]]))
    common = sorted_grams[edges[:-1]][np.diff(edges) >= COMMON]
    hot = np.isin(grams, common) if len(common) else np.zeros(len(grams), bool)
    marks = fragment_of(common, n_parts)
    parts, blobs = [], []
    for f in range(n_parts):
        a, b = np.searchsorted(frags, [f, f + 1])
        if a == b:
            continue
        for mine, passes in ((~hot[a:b], False), (hot[a:b], True)):
            g, k = grams[a:b][mine], keys[a:b][mine]
            begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, int)
            counts = np.diff(np.append(begin, len(k)))
            blob = _pack(k[begin], counts, g & LOW48, common[marks == f] & LOW48 if not passes else common[:0])
            if passes and len(k):
                parts.append(n_parts + (zlib.crc32(blob) % n_parts))
                blobs.append(np.int32(f).tobytes() + blob)
            elif not passes:
                parts.append(f)
                blobs.append(np.int32(f).tobytes() + blob)
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])


def shared_grams(part: tuple, group: pa.Table, n_parts: int, narrow: bool = False) -> pa.Table:
    """Of one fragment: for each key its hashes that other keys have too, with the number
    of keys, COMMON at most; packed in one row per bucket of keys, which ``by_key`` opens.
    ``narrow``: the hashes' low 32 bits are enough."""
    blobs = [memoryview(b.as_buffer()) for b in group.column("blob")]
    sizes = np.array([np.frombuffer(b[12:20], np.int64)[0] for b in blobs], np.int64)
    if part[0].as_py() >= n_parts:
        pieces = []
        for piece in np.split(np.arange(len(blobs)), np.flatnonzero(np.diff(np.cumsum(sizes) // PIECE_TOKENS)) + 1):
            keys, grams = [], []
            for b in (blobs[i] for i in piece):
                k, c, g, _ = _unpack(b[4:])
                keys.append(np.repeat(k, c))
                grams.append(np.uint64(np.frombuffer(b[:4], np.int32)[0]) << np.uint64(48) | g)
            keys, grams = np.concatenate(keys), np.concatenate(grams)
            pieces.append(_packed(keys, grams, np.full(len(keys), COMMON, np.uint8), n_parts, narrow))
        return pa.concat_tables(pieces)
    marks = np.concatenate([_unpack(b[4:])[3] for b in blobs])
    n_ranges = int(-(-sizes.sum() // PIECE_TOKENS)) or 1
    found = [_range_shared(blobs, marks, s, n_ranges) for s in range(n_ranges)]
    keys, grams, counts = (np.concatenate([x[c] for x in found]) for c in range(3))
    return _packed(keys, np.uint64(part[0].as_py()) << np.uint64(48) | grams, counts, n_parts, narrow)


def _range_shared(blobs: list[memoryview], marks: np.ndarray, number: int, n_ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, hashes and counts of the shared hashes in one of ``n_ranges`` ranges of a
    fragment. A hash lies in one range, so the ranges together are the whole fragment."""
    keys, grams = [], []
    for b in blobs:
        k, c, g, _ = _unpack(b[4:])
        k = np.repeat(k, c)
        if n_ranges > 1:
            here = (g >> np.uint64(16)) * np.uint64(n_ranges) >> np.uint64(32) == number
            k, g = k[here], g[here]
        keys.append(k)
        grams.append(g)
    keys, grams = np.concatenate(keys), np.concatenate(grams)
    order = np.lexsort((keys, grams))
    keys, grams = keys[order], grams[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (grams[1:] != grams[:-1])
    keys, grams = keys[fresh], grams[fresh]
    begin = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, int)
    counts = np.diff(np.append(begin, len(grams)))
    counts = np.where(np.isin(grams[begin], marks), COMMON, np.minimum(counts, COMMON)) if len(begin) else counts
    each = np.repeat(counts, np.diff(np.append(begin, len(grams))))
    several = each > 1
    return keys[several], grams[several], each[several].astype(np.uint8)


def _packed(keys: np.ndarray, grams: np.ndarray, counts: np.ndarray, n_parts: int, narrow: bool) -> pa.Table:
    buckets = (shared.mix(keys.view(np.uint64)) % np.uint64(n_parts)).astype(np.uint16)
    order = np.argsort(keys, kind="stable")
    order = order[np.argsort(buckets[order], kind="stable")]
    keys, grams, counts, buckets = keys[order], grams[order], counts[order], buckets[order]
    grams = (grams & np.uint64(0xFFFFFFFF)).astype(np.uint32) if narrow else grams
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    sizes = np.diff(np.append(begin, len(keys))).astype(np.uint32)
    edges, heads = np.searchsorted(buckets, np.arange(n_parts + 1)), np.searchsorted(buckets[begin], np.arange(n_parts + 1))
    numbers = np.flatnonzero(np.diff(edges)).tolist()
    blobs = []
    for b in numbers:
        a, z, i, j = edges[b], edges[b + 1], heads[b], heads[b + 1]
        blobs.append(np.array([j - i, z - a], np.int64).tobytes() + keys[begin[i:j]].tobytes() + sizes[i:j].tobytes() + grams[a:z].tobytes() + counts[a:z].tobytes())
    return pa.table({"bucket": pa.array(numbers, pa.int32()), "blob": pa.array(blobs, pa.binary())}, schema=pa.schema([("bucket", pa.int32()), ("blob", pa.binary())]))


def by_key(group: pa.Table, narrow: bool = False) -> pa.Table:
    """One row per key of a bucket: its shared hashes, each once, and their counts."""
    kind = np.dtype(np.uint32 if narrow else np.uint64)
    parts = []
    for blob in group.column("blob").to_pylist():
        k, n = np.frombuffer(blob[:16], np.int64).tolist()
        a, b = 16 + 8 * k, 16 + 12 * k
        keys = np.repeat(np.frombuffer(blob[16:a], np.int64), np.frombuffer(blob[a:b], np.uint32))
        parts.append((keys, np.frombuffer(blob, kind, n, b), np.frombuffer(blob, np.uint8, n, b + n * kind.itemsize)))
    keys, grams, counts = (np.concatenate([p[c] for p in parts]) for c in range(3))
    order = np.lexsort((grams, keys))
    keys, grams, counts = keys[order], grams[order], counts[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (grams[1:] != grams[:-1])
    keys, grams, counts = keys[fresh], grams[fresh], counts[fresh]
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    edges = np.append(begin, len(keys))
    signed = grams.view(np.int32 if narrow else np.int64)
    return pa.table({"key": pa.array(keys[begin]), "grams": shared.lists(signed, edges, pa.int32() if narrow else pa.int64()), "counts": shared.lists(counts.view(np.int8), edges, pa.int8())})


def gathered(flushes: DataFrame, n_parts: int, narrow: bool = False) -> DataFrame:
    """(key, grams, counts) from rows (part, blob) that ``flush`` made: once by fragment,
    to find what is shared, and once by key."""

    def fragment(part: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        shared.give_back()
        return shared_grams(part, group, n_parts, narrow)

    def bucket(number: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        shared.give_back()
        return by_key(group, narrow)

    found = flushes.groupBy("part").applyInArrow(fragment, "bucket int, blob binary")
    return found.groupBy("bucket").applyInArrow(bucket, f"key long, grams array<{'int' if narrow else 'long'}>, counts array<byte>")
