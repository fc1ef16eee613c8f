"""Token counts by a compiled finite-state tokenizer.

The tokenizer's file is compiled once per task into two deterministic transducers whose
transitions carry the number of tokens they emit:

- over characters: the classes of the byte-level split pattern. Before a white-space
  character that follows another kind of character, and before punctuation that follows
  a letter or digit, every run ends whatever the state was, so those places synchronise
  all states (``units``).
- over the bytes of one piece, ``Merger``: its state is the last token of the encoding
  of each prefix that a later token can still reach. A token may follow another when
  encoding both together gives just these two; exactly one last token fits each prefix,
  so the state is determined, also for pieces of any length, in one pass. Whole units
  become transitions of their own once they are known, within a bound.

A text is cut into chunks of ``chunk`` characters. The map of a chunk from the state in
which it is entered to the state in which it is left is (head, tokens, tail): the open
piece that comes in is finished by the head, the middle emits a fixed number, the tail
stays open; a chunk without a synchronising place only lengthens the open piece. Maps
are computed independently of each other, also on different executors, and compose by
a parallel prefix scan, as composition is associative.

Defined results: null is the empty text, 0 tokens. Repeated or null ids are rows of
their own. Other columns are not read.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import shared
from tideline.llm.units import Units, punctuation, unit_starts

CHUNK = 65_536
KNOWN_PIECES = 200_000
# Fixed: the split pattern of byte-level BPE tokenizers.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MAP = "struct<head:string,tokens:bigint,tail:string>"


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the byte-level vocabulary: visible Latin-1 characters
    stand for themselves, the other bytes for the characters from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(rest)}


class Merger:
    """Token count of one piece, byte by byte."""

    def __init__(self, vocabulary: dict[str, int], merges: list):
        self.letters = byte_alphabet()
        self.spell = {t: bytes(self.letters[c] for c in t) for t in vocabulary if all(c in self.letters for c in t)}
        self.rank = {}
        for n, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[self.spell[a], self.spell[b]] = n
        self.reach = [1] * 256  # the longest token that ends with each byte
        for token in self.spell.values():
            self.reach[token[-1]] = max(self.reach[token[-1]], len(token))
        made = {a + b for a, b in self.rank} | {bytes([k]) for k in range(256)}
        self.tokens = set(self.spell.values()) & made
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.whole: dict[bytes, bool] = {}

    def merged(self, piece: bytes) -> list[bytes]:
        """Encoding by the merge rules, for the short strings from which transitions are compiled."""
        parts = [piece[k : k + 1] for k in range(len(piece))]
        while len(parts) > 1:
            best, at = min((self.rank.get((a, b), len(self.rank)), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
            if best == len(self.rank):
                break
            a, b = parts[at], parts[at + 1]
            out, k = [], 0
            while k < len(parts):
                if k + 1 < len(parts) and parts[k] == a and parts[k + 1] == b:
                    out.append(a + b)
                    k += 2
                else:
                    out.append(parts[k])
                    k += 1
            parts = out
        return parts

    def stands(self, token: bytes) -> bool:
        if token not in self.whole:
            self.whole[token] = self.merged(token) == [token]
        return self.whole[token]

    def follows(self, before: bytes, token: bytes) -> bool:
        key = (before, token)
        if key not in self.fits:
            if len(self.fits) > 2 * KNOWN_PIECES:
                self.fits.clear()
            self.fits[key] = self.merged(before + token) == [before, token]
        return self.fits[key]

    def count(self, piece: bytes) -> int:
        last, emitted, tokens, fits = [b""], [0], self.tokens, self.fits
        for end in range(1, len(piece) + 1):
            for start in range(max(0, end - self.reach[piece[end - 1]]), end):
                token = piece[start:end]
                if token in tokens:
                    fit = fits.get((last[start], token)) if start else self.stands(token)
                    if self.follows(last[start], token) if fit is None else fit:
                        last.append(token)
                        emitted.append(emitted[start] + 1)
                        break
        return emitted[-1]


class Compiled:
    """The tokenizer as a transducer over whole texts."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        kind = made["pre_tokenizer"] or {}
        if made["model"]["type"] != "BPE" or made["normalizer"] or kind.get("type") != "ByteLevel" or not kind.get("use_regex") or kind.get("add_prefix_space"):
            raise ValueError("only byte-level BPE files without a normalizer are compiled")
        self.merger = Merger(made["model"]["vocab"], made["model"]["merges"])
        self.split = regex.compile(SPLIT)
        special = sorted((t["content"] for t in made["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.stray = max((len(s) for s in special if regex.search(r"\s", s)), default=0)
        if self.stray:
            raise ValueError("special strings with white space can't be cut at white space")
        self.pieces: dict[str, int] = {}
        marks = punctuation("".join(special))
        self.units = Units(lambda texts: [[self.unit(t)] for t in texts], np.int64, marks)

    def piece(self, text: str) -> int:
        n = self.pieces.get(text)
        if n is None:
            n = self.merger.count(text.encode("utf-8"))
            if len(self.pieces) >= KNOWN_PIECES:
                self.pieces.clear()
            self.pieces[text] = n
        return n

    def unit(self, text: str) -> int:
        """Tokens of a text that begins and ends at synchronising places."""
        n = 0
        for k, part in enumerate(self.special.split(text) if self.special else [text]):
            n += 1 if k % 2 else sum(map(self.piece, self.split.findall(part)))
        return n

    def count(self, text: str) -> int:
        data = np.frombuffer(text.encode("utf-8"), np.uint8)
        return int(self.units(data, np.array([0, len(data)]))[0].sum()) if len(data) else 0

    def chunk_maps(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[str, int, str | None]]:
        """(head, tokens, tail) of every row; tail is None where nothing synchronises."""
        starts = unit_starts(data, offsets, self.units.marks)
        counts, _ = self.units.each(data, starts)
        sums = np.concatenate([[0], np.cumsum(counts)])
        edge = np.searchsorted(starts, offsets)
        raw, maps = data.tobytes(), []
        for k, (a, z) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist())):
            begin, end = int(offsets[k]), int(offsets[k + 1])
            if z - a < 2:
                maps.append((raw[begin:end].decode("utf-8"), 0, None))
            else:
                maps.append((raw[begin : starts[a + 1]].decode("utf-8"), int(sums[z - 1] - sums[a + 1]), raw[starts[z - 1] : end].decode("utf-8")))
        return maps


def compose(machine: Compiled, x: tuple, y: tuple) -> tuple:
    """The map of two neighbouring chunks. Where the second begins with white space
    after another kind of character, its border synchronises too, which the open
    piece's own run then finds."""
    (a, n, b), (c, m, d) = x, y
    if b is None and d is None:
        return a + c, 0, None
    if b is None:
        return a + c, m, d
    if d is None:
        return a, n, b + c
    return a, n + machine.count(b + c) + m, d


def scan(machine: Compiled, maps: list[tuple]) -> tuple:
    """All chunks' maps in a row, neighbours first: as many rounds as the logarithm of
    their number."""
    while len(maps) > 1:
        maps = [compose(machine, *maps[k : k + 2]) if k + 1 < len(maps) else maps[k] for k in range(0, len(maps), 2)]
    return maps[0]


@functools.lru_cache(maxsize=2)
def compiled(path: str) -> Compiled:
    return Compiled(path)


def token_counts(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text: str = "text", limit: int = 1024, chunk: int = CHUNK) -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens, over_limit. ``tokenizer``: the place
    of a byte-level BPE file that all executors have."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_column).alias("doc_id"), body.alias("text"), F.monotonically_increasing_id().alias("row"))
    chunks = rows.select(
        "doc_id", "row", F.octet_length("text").cast("long").alias("n_bytes"), F.posexplode_outer(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0))).alias("at", "piece")
    )
    kind = docs.schema[id_column].dataType.simpleString()
    maps = chunks.mapInArrow(partial(_map_chunks, tokenizer=tokenizer), f"doc_id {kind}, row long, n_bytes long, at int, map {MAP}")
    whole = maps.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_bytes").alias("n_bytes"), F.array_sort(F.collect_list(F.struct("at", "map"))).alias("maps"))
    counts = whole.select("doc_id", "n_bytes", "maps").mapInArrow(partial(_fold, tokenizer=tokenizer), f"doc_id {kind}, n_bytes long, n_tokens long")
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)


def _map_chunks(batches: Iterator[pa.RecordBatch], tokenizer: str) -> Iterator[pa.RecordBatch]:
    machine = compiled(tokenizer)
    for batch in batches:
        for part, data, offsets in shared.text_slices(batch, "piece"):
            maps = machine.chunk_maps(data, offsets)
            columns = [pa.array([m[k] for m in maps], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], part.column(3).fill_null(0), pa.StructArray.from_arrays(columns, ["head", "tokens", "tail"])], ["doc_id", "row", "n_bytes", "at", "map"])


def _fold(batches: Iterator[pa.RecordBatch], tokenizer: str) -> Iterator[pa.RecordBatch]:
    machine = compiled(tokenizer)
    for batch in batches:
        tokens, ends = [], []
        for k in range(batch.num_rows):
            head, n, tail = scan(machine, [(m["map"]["head"], m["map"]["tokens"], m["map"]["tail"]) for m in batch.column(2)[k].as_py()])
            tokens.append(n)
            ends += [head, tail]
        # what stays open at either end of all texts, counted together
        data, offsets = shared.utf8(pa.array(ends, pa.string()))
        starts = unit_starts(data, offsets, machine.units.marks)
        counts, _ = machine.units.each(data, starts)
        rows = (np.searchsorted(offsets, starts, "right") - 1) // 2
        counts = np.array(tokens, np.int64) + np.bincount(rows, counts, minlength=len(tokens)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts)], ["doc_id", "n_bytes", "n_tokens"])
