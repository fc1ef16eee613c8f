"""Secret scan: base patterns, and character Markov models of random strings.

The base finds assignments of passwords and keys, access-key ids and long hexadecimal
runs. Two first-order Markov models over the characters of keys are trained on labelled
samples that the corpus itself gives: the values of base findings are random strings,
all other runs of key characters are ordinary identifiers. Their transitions are counted
over all texts; the counts are all that goes to the driver, ``len(ALPHABET) + 1`` squared
for each model at most. A run of ``min_length`` or more key characters with letters and
digits, outside base findings, is a secret when its log-likelihood ratio is at least
``margin`` per character.

Defined results: null is the empty text; texts without findings have empty spans.
Without any base finding the model of random strings is uniform. Repeated or null ids
are rows of their own. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import shared

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of [0-9a-f]+ with 24 or more
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SIZE = len(ALPHABET) + 1  # the last one stands for the beginning
MIN_LENGTH = 20
MARGIN = 1.0
PRIOR = 4.0  # weight of the single characters in a transition's estimate
TRAIN_LENGTH = 4  # shorter runs say little about identifiers

_CODE = np.full(256, -1, np.int64)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
RUN = re.compile(r"[A-Za-z0-9+/_=-]+")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the base findings, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def random_values(text: str) -> list[str]:
    """The labelled random strings of a text: values of its base findings."""
    values = {(m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6}
    values |= {(a, z) for a, kind, z in base_spans(text) if kind}
    return [text[a:z] for a, z in sorted(values)]


def transitions(data: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """Counts of character pairs, first ones after the beginning, in maximal runs of key
    characters of TRAIN_LENGTH or more whose characters are all allowed."""
    code = _CODE[data]
    inside = code >= 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    bad = np.concatenate([[0], np.cumsum(~allowed)])
    good = (ends - starts >= TRAIN_LENGTH) & (bad[ends] == bad[starts])
    starts, ends = starts[good], ends[good]
    counts = np.bincount((SIZE - 1) * SIZE + code[starts], minlength=SIZE * SIZE)
    mark = np.zeros(len(data) + 1, np.int32)
    np.add.at(mark, starts + 1, 1)
    np.add.at(mark, ends, -1)
    at = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
    return counts + np.bincount(code[at - 1] * SIZE + code[at], minlength=SIZE * SIZE)


def string_transitions(values: list[str]) -> np.ndarray:
    data = np.frombuffer("\n".join(values).encode("utf-8"), np.uint8)
    return transitions(data, np.ones(len(data), bool))


class Models:
    def __init__(self, random: np.ndarray, ordinary: np.ndarray):
        """From the two tables of transition counts. The random one is mixed evenly with
        the uniform distribution, as keys come in more alphabets than the samples show."""
        n = len(ALPHABET)
        uniform = 1.0 / n

        def likely(counts: np.ndarray) -> np.ndarray:
            """Transition probabilities; pairs that were not seen fall back on how
            frequent the second character is at all."""
            table = counts.reshape(SIZE, SIZE)[:, :n].astype(float)
            single = (table.sum(axis=0) + 0.5) / (table.sum() + 0.5 * n)
            return (table + PRIOR * single) / (table.sum(axis=1, keepdims=True) + PRIOR)

        self.ratio = np.log(0.5 * likely(random) + 0.5 * uniform) - np.log(likely(ordinary))

    def score(self, run: str) -> float:
        """Log-likelihood ratio per character; positive means random."""
        code = _CODE[np.frombuffer(run.encode("ascii"), np.uint8)]
        return float(self.ratio[np.concatenate([[SIZE - 1], code[:-1]]), code].mean())


def markov_spans(text: str, models: Models, base: list[tuple[int, int, int]], min_length: int, margin: float) -> list[tuple[int, int, int]]:
    found = []
    for m in re.finditer(rf"[A-Za-z0-9+/_=-]{{{min_length},}}", text):
        a, z = m.span()
        run = m[0]
        if any(x < z and a < y for x, _, y in base) or not (re.search("[A-Za-z]", run) and re.search("[0-9]", run)):
            continue
        if models.score(run) >= margin:
            found.append((a, 3, z))
    return found


def train(texts: DataFrame) -> Models:
    """Both models from the column ``text`` of all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = np.zeros((2, SIZE * SIZE), np.int64)
        for batch in batches:
            for _, data, offsets in shared.text_slices(batch, "text"):
                raw, allowed = data.tobytes(), np.ones(len(data), bool)
                for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                    text = raw[a:z].decode("utf-8")
                    base = base_spans(text)
                    if base:
                        tables[0] += string_transitions(random_values(text))
                        for x, _, y in base:
                            b = a + len(text[:x].encode("utf-8"))
                            allowed[b : b + len(text[x:y].encode("utf-8"))] = False
                if len(offsets) > 2:  # a run never crosses texts: a border is a byte that isn't allowed, put in between
                    data, allowed = np.insert(data, offsets[1:-1], 10), np.insert(allowed, offsets[1:-1], True)
                tables[1] += transitions(data, allowed)
        for label in (0, 1):
            at = np.flatnonzero(tables[label])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), label), pa.int32()), pa.array(at, pa.int32()), pa.array(tables[label][at])], ["label", "pair", "n"])

    counted = texts.select("text").mapInArrow(count, "label int, pair int, n long").groupBy("label", "pair").agg(F.sum("n").alias("n"))
    tables = np.zeros((2, SIZE * SIZE), np.int64)
    for label, pair, n in counted.collect():  # 2 * SIZE * SIZE rows at most
        tables[label, pair] = n
    return Models(tables[0], tables[1])


def secret_scan(docs: DataFrame, id_column: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, margin: float = MARGIN, models: Models | None = None) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans
    (kind:start:end in code points, comma-joined)."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    models = train(rows) if models is None else models

    def written(spans: list[tuple[int, int, int]]) -> str:
        return ",".join(f"{KINDS[kind]}:{a}:{z}" for a, kind, z in spans)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans = [], [], []
            for k in range(batch.num_rows):
                text = batch.column(1)[k].as_py()
                base = base_spans(text)
                found = markov_spans(text, models, base, min_length, margin)
                counts.append([sum(kind == n for _, kind, _ in base) for n in range(3)] + [len(found)])
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(sorted(base + found)))
            columns = [pa.array([c[n] for c in counts], pa.int64()) for n in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(digests, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string")
