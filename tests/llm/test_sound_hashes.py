"""Texts that polynomial hashes modulo 2^64 take for each other, and repeated ids."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tideline.llm import fragments, shared
from tideline.llm.line_quality import line_quality
from tideline.llm.ngram_join import first_of_each_group, ngram_join
from tideline.llm.shared import run_folder
from tideline.llm.suffix_dedup import suffix_dedup
from tideline.llm.token_counts import token_counts
from tideline.llm.token_store import read_tokens, write_tokens

DOCS = "doc_id long, text string, source string"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def thue_morse(n: int, letters: str = "ab") -> str:
    return "".join(letters[bin(k).count("1") % 2] for k in range(n))


def twins(n: int) -> tuple[str, str]:
    return thue_morse(n), thue_morse(n, "ba")


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_span_hash_tells_twins_apart(n):
    data = np.frombuffer("".join(twins(n)).encode(), np.uint8)
    for seed in (0, 1):
        a, b = shared.span_hash(data, np.array([0, n]), np.array([n, 2 * n]), seed)
        assert a != b


def test_span_hash_is_the_same_wherever_a_span_stands():
    rng = np.random.default_rng(3)
    for size in (0, 1, 7, 8, 9, 31, 32, 33, 64, 200):
        word = rng.integers(0, 256, size, dtype=np.uint8)
        gap = rng.integers(0, 256, 13, dtype=np.uint8)
        data = np.concatenate([word, gap, word, gap[:5], word])
        starts = np.array([0, size + 13, 2 * size + 18])
        assert len(set(shared.span_hash(data, starts, starts + size).tolist())) == 1
    # zero bytes at the end of a span count
    data = np.zeros(20, np.uint8)
    hashes = shared.span_hash(data, np.zeros(20, np.int64), np.arange(1, 21))
    assert len(set(hashes.tolist())) == 20


@pytest.mark.parametrize("n", [1024, 4096])
def test_twins_in_counts_and_stores(spark, n):
    """The second word comes in the same slice as the first, and in another one."""
    texts = [*twins(n), f"x {twins(n)[1]} y", f"x {twins(n)[0]} y"]
    docs = spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], DOCS).coalesce(1)
    tokenizer = Tokenizer.from_file(VOCABULARY)
    ids = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    counts = {r.doc_id: r.n_tokens for r in token_counts(docs, VOCABULARY).collect()}
    assert counts == {k: len(x) for k, x in enumerate(ids)}
    folder = run_folder(spark, "twins")
    rows = read_tokens(write_tokens(docs, folder, VOCABULARY, 2), folder).collect()
    assert {r.doc_id: r.ids_crc32 for r in rows} == {k: zlib.crc32(np.array([*x, 2], "<u4").tobytes()) for k, x in enumerate(ids)}


def test_twins_make_no_links_and_no_repeats(spark):
    a, b = twins(1024)
    rows = [(1, " ".join([a] * 3 + [f"w{k}" for k in range(7)]), "s"), (2, " ".join([b] * 3 + [f"w{k}" for k in range(7)]), "s")]
    rows += [(3, " ".join(a + str(k) for k in range(10)), "s"), (4, " ".join(b + str(k) for k in range(10)), "s")]
    docs = spark.createDataFrame(rows, DOCS)
    assert {r.doc_id: r.component_id for r in ngram_join(docs).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
    # three equal words and three twins aren't six words of one window found twice
    lines = spark.createDataFrame([(1, " ".join([a, b, a, a, b, b]), "s")], DOCS)
    assert line_quality(lines).first().n_repeat_words == 0


def test_twins_in_suffix_dedup(spark):
    a, b = twins(2000)
    docs = spark.createDataFrame([(1, a, "s"), (2, b, "s"), (3, "q" * 60 + a[:1024], "s")], DOCS)
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in suffix_dedup(docs, length=1500).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: 0, 2: 0, 3: 0}
    assert got[2][1] == hashlib.sha256(b.encode()).hexdigest()


def test_classes_that_share_an_id_stay_apart(spark):
    base = [f"a{k}" for k in range(60)]
    near = base[:58] + ["z1", "z2"]
    rows = [(1, " ".join(base), "s"), (5, " ".join(near), "s"), (5, " ".join(f"c{k}" for k in range(50)), "s"), (9, " ".join(f"c{k}" for k in range(49)), "s"), (7, " ".join(f"d{k}" for k in range(30)), "s"), (7, "", "s"), (None, None, "s")]
    got = ngram_join(spark.createDataFrame(rows, DOCS).withColumn("key", F.lit(1))).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == sorted([(1, 56, 1), (5, 56, 1), (5, 46, 5), (9, 45, 5), (7, 26, 7), (7, 0, 7), (None, 0, None)], key=repr)


def test_one_of_each_group_by_row(spark):
    """A lone row without an id doesn't keep other ones; a text under a repeated id stays."""
    base, near = [f"a{k}" for k in range(60)], [f"a{k}" for k in range(58)] + ["z1", "z2"]
    other, alone, third = (" ".join(f"{c}{k}" for k in range(40)) for c in "cde")
    rows = [(1, " ".join(base), "s"), (None, " ".join(near), "s"), (None, other, "s"), (None, other, "t"), (None, alone, "s"), (5, " ".join(near), "s"), (5, third, "s"), (8, "", "s"), (8, None, "s"), (3, alone + " x", "s"), (3, alone + " x", "s")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("row", F.lit(1)).withColumn("group", F.lit("g"))
    kept = first_of_each_group(docs)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id or 0, r.text or "", r.source) for r in kept.collect())
    assert [(i, t[:2]) for i, t, _ in got] == [(0, "c0"), (1, "a0"), (3, "d0"), (5, "e0"), (8, ""), (8, "")]
    assert first_of_each_group(docs.limit(0)).count() == 0


def test_fragments_in_pieces(monkeypatch):
    """Ranges of a fragment together find what the whole fragment does."""
    rng, held = np.random.default_rng(3), []
    pool = rng.integers(0, 2**63, 3000, dtype=np.int64).astype(np.uint64) * np.uint64(2)
    for _ in range(2):
        sets = [np.unique(np.concatenate([pool[rng.integers(0, 3000, 60)], pool[:4], rng.integers(0, 2**63, 40, dtype=np.int64).astype(np.uint64)])) for _ in range(200)]
        held.append(fragments.flush([(x, np.full(len(x), rng.integers(0, 2**60), np.int64)) for x in sets], 4))
    rows = pa.Table.from_batches(held)

    def found() -> list:
        parts = [fragments.shared_grams((pa.scalar(p, pa.int32()),), rows.filter(pc.equal(rows.column(0), p)), 4) for p in sorted(set(rows.column(0).to_pylist()))]
        both = pa.concat_tables(parts)
        return [sorted(map(repr, fragments.by_key(both.filter(pc.equal(both.column(0), b))).to_pylist())) for b in sorted(set(both.column(0).to_pylist()))]

    whole = found()
    assert sum(map(len, whole)) == 400
    monkeypatch.setattr(fragments, "PIECE_TOKENS", 700)
    assert found() == whole
