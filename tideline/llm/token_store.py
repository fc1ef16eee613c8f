"""Token ids as raw binary shards with keyed access.

A shard holds a range of document ids in ascending order: ``shard-N.ids`` is nothing but
the ids, little-endian, two bytes each where the vocabulary allows it, and ``shard-N.index``
a minimal perfect hash of the documents' keys with, at each key's number, a 32-bit
fingerprint, the offset of the first id and the number of ids. A lookup is one number,
one comparison and one ranged read, however many documents there are; a key that isn't
there fails its fingerprint (but for one in 2^32).

Defined results: null is the empty text, which has the end id only. A repeated id's rows
are keyed by id and a running number, in the order of their texts; null ids come last.
Shards are cut between ids. Other columns are not read.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tideline.llm import files, shared
from tideline.llm.perfect_hash import PerfectHash
from tideline.llm.units import Units, punctuation

BATCH = 2_000
MAGIC = b"TLTOKEN1"
SLOT = np.dtype([("print", "<u4"), ("offset", "<u8"), ("length", "<u8")])
NULL_KEY = np.uint64(0xA5A5A5A5DEADBEEF)


@functools.lru_cache(maxsize=2)
def encoder(path: str, width: str) -> Units:
    """The tokenizers library, asked once per unit; other kinds than plain byte-level
    tokenizers encode whole texts."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks run side by side as it is; threads of each would only hold memory
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    kind = tokenizer.pre_tokenizer
    stray = any(regex.search(r"\s", t.content) or t.lstrip or t.rstrip for t in tokenizer.get_added_tokens_decoder().values())
    cuts = type(kind).__name__ == "ByteLevel" and not kind.add_prefix_space and kind.use_regex and tokenizer.normalizer is None and not stray

    def encode(texts: list[str]) -> list[list[int]]:
        return [e.ids for k in range(0, len(texts), BATCH) for e in tokenizer.encode_batch_fast(texts[k : k + BATCH], add_special_tokens=False)]

    special = "".join(t.content for t in tokenizer.get_added_tokens_decoder().values())
    return Units(encode, width, punctuation(special) if cuts else None)


def keys_of(ids: np.ndarray, missing: np.ndarray, turns: np.ndarray) -> np.ndarray:
    base = np.where(missing, NULL_KEY, ids.astype(np.int64).view(np.uint64))
    return shared.mix(base + np.uint64(0x51ED27)) ^ shared.mix(shared.mix(turns.astype(np.uint64)))


def _prints(keys: np.ndarray) -> np.ndarray:
    return (shared.mix(keys ^ np.uint64(0xC0FFEE)) >> np.uint64(32)).astype(np.uint32)


def _write(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, end_id: int, width: str):
    """Writes this partition's shard; gives its keys in order."""
    encode = encoder(tokenizer, width)
    shard = TaskContext.get().partitionId()
    name = f"shard-{shard:06d}"
    lengths, ids, missing = [], [], []
    with files.Finished(folder, f"{name}.ids") as out:
        for batch in batches:
            for part, data, offsets in shared.text_slices(batch, "text"):
                flat, counts = encode(data, offsets)
                whole = np.full(len(flat) + len(counts), end_id, width)
                whole[np.arange(len(flat)) + np.repeat(np.arange(len(counts)), counts)] = flat
                out.write(whole.tobytes())
                lengths += (counts + 1).tolist()
                ids += part.column(0).fill_null(0).to_pylist()
                missing += part.column(0).is_null().to_pylist()
    if not lengths:
        return
    doc, gone, lengths = np.array(ids, np.int64), np.array(missing, bool), np.array(lengths, np.uint64)
    fresh = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (gone[1:] != gone[:-1])]))
    turns = np.arange(len(doc)) - np.repeat(fresh, np.diff(np.append(fresh, len(doc))))
    keys = keys_of(doc, gone, turns)
    table = PerfectHash.build(keys)
    slots = np.zeros(len(keys), SLOT)
    at = table.number(keys)
    slots["print"][at], slots["length"][at] = _prints(keys), lengths
    slots["offset"][at] = np.cumsum(lengths) - lengths
    with files.Finished(folder, f"{name}.index") as out:
        out.write(MAGIC + np.array([len(keys), np.dtype(width).itemsize], np.int64).tobytes() + table.to_bytes() + slots.tobytes())
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(doc), shard), pa.int32()), pa.array(doc, pa.int64(), mask=gone), pa.array(turns, pa.int64())], ["shard", "doc_id", "turn"]
    )


class Shard:
    """Keyed access to one shard."""

    def __init__(self, folder: str, number: int):
        fs, path = files.place(folder)
        name = f"{path}/shard-{number:06d}"
        with fs.open_input_stream(f"{name}.index") as file:
            data = memoryview(file.read())
        if bytes(data[:8]) != MAGIC:
            raise ValueError(f"{name}.index is no index of token ids")
        n, size = np.frombuffer(data[8:24], np.int64).tolist()
        self.table, used = PerfectHash.from_bytes(data[24:])
        self.slots = np.frombuffer(data[24 + used :], SLOT, n)
        self.type = np.dtype(f"<u{size}")
        self.file = fs.open_input_file(f"{name}.ids")

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offset and number of ids of each key; -1 and 0 where it isn't here."""
        at = self.table.number(keys)
        if not len(self.slots):
            return np.full(len(keys), -1), np.zeros(len(keys), np.int64)
        slot = self.slots[np.maximum(at, 0)]
        here = (at >= 0) & (slot["print"] == _prints(keys))
        return np.where(here, slot["offset"].astype(np.int64), -1), np.where(here, slot["length"].astype(np.int64), 0)

    def ids(self, offset: int, length: int) -> np.ndarray:
        self.file.seek(offset * self.type.itemsize)
        return np.frombuffer(self.file.read(length * self.type.itemsize), self.type)


def _read(batches: Iterator[pa.RecordBatch], folder: str):
    number, shard = None, None
    for batch in batches:
        numbers, gone = batch.column(0).to_numpy(), np.asarray(batch.column(1).is_null().to_pylist(), bool)
        keys = keys_of(batch.column(1).fill_null(0).to_numpy(), gone, batch.column(2).to_numpy())
        offsets, lengths, sums = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for n in np.unique(numbers):
            if n != number:
                number, shard = n, Shard(folder, int(n))
            mine = np.flatnonzero(numbers == n)
            offsets[mine], lengths[mine] = shard.find(keys[mine])
            for k in mine:
                if offsets[k] < 0:
                    raise ValueError("a key of the shard is not in its index")
                sums[k] = zlib.crc32(shard.ids(int(offsets[k]), int(lengths[k])).astype("<u4").tobytes())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(offsets), pa.array(lengths), pa.array(sums)], ["shard", "doc_id", "turn", "offset", "n_tokens", "ids_crc32"])


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the shards of ``docs`` into ``folder``; gives their keys (shard, doc_id, turn).
    ``tokenizer``: a file of the tokenizers library that all executors have."""
    width = "<u2" if max(Tokenizer.from_file(tokenizer).get_vocab_size() - 1, end_id) < 1 << 16 else "<u4"
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    last = F.col("doc_id").isNull()
    ordered = rows.repartitionByRange(shared.shuffle_partitions(docs.sparkSession), last, "doc_id").sortWithinPartitions(last, "doc_id", "text")
    write = partial(_write, folder=folder, tokenizer=tokenizer, end_id=end_id, width=width)
    return shared.stored(ordered.mapInArrow(write, "shard int, doc_id long, turn long"), "keys")


def read_tokens(keys: DataFrame, folder: str) -> DataFrame:
    """Per key, from the files: start (ids of all documents before it), n_tokens, ids_crc32."""
    found = shared.stored(keys.mapInArrow(partial(_read, folder=folder), "shard int, doc_id long, turn long, offset long, n_tokens long, ids_crc32 long"), "found")
    sizes = found.groupBy("shard").agg(F.sum("n_tokens").alias("ids"))
    before = F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))  # one row per shard
    bases = sizes.select("shard", F.coalesce(before, F.lit(0)).alias("base"))
    return found.join(bases, "shard").select("doc_id", "turn", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", "shard")
