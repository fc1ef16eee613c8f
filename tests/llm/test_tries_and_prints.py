"""Prefix trie, spelling variants and fingerprints against brute force."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from tideline.llm import fingerprints, prefix_trie, spelling
from tideline.llm.shared import stored

CHATS = "conv_id long, turn long, role string, text string"
DOCS = "doc_id long, text string, source string"


def _rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            digest = hashlib.sha256(f"{len((role or '').encode())}:{role or ''}:{text or ''}".encode()).digest()
            own[conv].append((turn is not None, turn, digest, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(v, key=lambda x: (x[0], x[1] or 0, x[2]))] for c, v in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:]
    return out


def brute_trie(rows):
    chats = _rebuilt(rows)
    members = defaultdict(list)
    for c, turns in chats.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids, result = defaultdict(list), []
    for key in members:
        if key:
            kids[key[:-1]].append(key)
    order = sorted(members, key=len, reverse=True)
    leaves, saved = {}, {}
    for key in order:
        leaves[key] = sum(leaves[k] for k in kids[key]) or (0 if kids[key] else 1)
        saved[key] = sum(saved[k] for k in kids[key]) + ((len(members[key]) - 1) * len(key[-1][1]) if key else 0)
    for key, who in members.items():
        ends = ",".join(map(str, sorted(c for c in who if len(chats[c]) == len(key))))
        result.append((min(who), len(key), min(members[key[:-1]]) if key else None, len(who), len(kids[key]), leaves[key], saved[key], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(result, key=repr)


def trie(spark, rows, **sizes):
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, CHATS + (", depth int, p1 string" if rows and len(rows[0]) == 6 else "")), **sizes)
    return sorted((tuple(r) for r in got.collect()), key=repr)


ODD_CHATS = [
    (7, 0, "user", "hello"), (7, 1, "assistant", "ça va 🙂"), (0, 0, "user", "hello"), (0, 1, "assistant", "ça va 🙂"), (0, 2, "user", None),
    (3, None, None, "first"), (3, 4, "user", "x"), (3, 4, "user", "x"), (3, 4, "user", "w"), (105, 0, "user", "alone"), (None, 0, "user", "nobody's"),
    (200, 0, "user", ""), (201, 0, "user", ""), (202, 0, "user", ""), (203, 0, "user", "a"), (204, 0, "user", "a"), (-5, 0, "user", "below"), (2**40, 0, "user", "far"),
] + [(c, t, "user", f"turn {t}") for c in range(300, 340) for t in range(c % 9 + 1)]


@pytest.mark.parametrize("block,shard", [(4096, 400_000), (2, 5), (3, 1)])
def test_prefix_trie(spark, block, shard):
    assert trie(spark, ODD_CHATS, block=block, shard_rows=shard) == brute_trie(ODD_CHATS)


def test_prefix_trie_of_one_long_conversation(spark):
    rows = [(c, t, "user", "same" * (t % 3)) for c in (100, 101, 102) for t in range(300)] + [(c, 0, "user", "one") for c in range(1000, 1100)]
    assert trie(spark, rows, block=16, shard_rows=64, piece=40) == brute_trie(rows)


def test_prefix_trie_of_nothing_and_of_other_columns(spark):
    assert trie(spark, []) == []
    rows = [(1, 0, "user", "a", 3, "x"), (1, 1, "user", "b", 3, "x")]
    assert trie(spark, rows) == brute_trie([r[:4] for r in rows])


def test_equal_digests_of_other_prefixes_raise(spark, monkeypatch):
    """With a hash that ignores the turn, prefixes of equal length get one digest."""
    monkeypatch.setattr(prefix_trie.F, "xxhash64", lambda *c: F.lit(5).cast("long"))
    with pytest.raises(Exception, match="one digest"):
        trie(spark, [(1, 0, "user", "a"), (2, 0, "user", "b")] + [(c, 0, "user", str(c)) for c in range(3, 20)])


# ---- spelling ----------------------------------------------------------------


def brute_spelling(docs):
    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        if len(a) > len(b):
            a, b = b, a
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    forms, rows = {}, []
    for w, n in words.items():
        others = [v for v in words if near(w, v)]
        best = min(others, key=lambda v: (-words[v], v), default=None)
        forms[w] = (best if best and words[best] >= 2 * n else None, len(others))
    for w, n in words.items():
        root = w
        while forms[root][0]:
            root = forms[root][0]
        form = forms[w][0]
        rows.append((w, n, forms[w][1], form, words[form] if form else None, root))
    return sorted(rows)


def spelled(spark, docs):
    frame = spark.createDataFrame([(i, t, "s") for i, t in docs], DOCS + "").withColumn("word", F.lit("x")).withColumn("n", F.lit(1))
    return sorted(tuple(r) for r in spelling.spelling_variants(frame).select("word", "n", "n_near", "form", "form_n", "root").collect())


def test_spelling_variants(spark):
    variants = {"banana": 40, "bananna": 10, "banan": 9, "bananas": 20, "cabana": 3, "hannah": 5, "hanah": 5, "aaaaaa": 12, "aaaaa": 3, "aaaaaaa": 3, "straße": 7, "strasse": 3, "éclair": 6, "eclair": 3, "bonono": 4, "banano": 8, "x÷×yz": 3}
    text = " ".join(" ".join([w] * n) for w, n in variants.items())
    docs = [(1, text.upper()), (2, text), (3, None), (4, ""), (None, "Banana,banana;banana BANANÉ"), (2, text)] + [(100 + k, "banana hannah straßen " * 3) for k in range(200)]
    want = brute_spelling(docs)
    assert len(want) > 15 and any(r[3] for r in want)
    assert spelled(spark, docs) == want


def test_spelling_scan_cuts_batches_between_groups(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        words = [f"stem{a}{b}" for a in "abcdé" for b in "abcdé"] + ["stema", "stemb", "xstem"]
        docs = [(k, " ".join(words[k % 5 :])) for k in range(12)]
        assert spelled(spark, docs) == brute_spelling(docs)
        assert spelled(spark, []) == []
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


# ---- fingerprints --------------------------------------------------------------


def _chain(words):
    h = 42
    for w in words:
        h = xxhash.xxh64_intdigest(w.encode(), h)
    return h - (1 << 64) if h >> 63 else h


def brute_bins(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = [w for w in re.split("[\x20\x09-\x0d]+", low) if w]
    grams = {_chain(words[i : i + 5]) for i in range(len(words) - 4)} or ({_chain(words)} if words else set())
    mins = {}
    for g in grams:
        b = (g >> 56) + 128
        mins[b] = min(mins.get(b, g), g)
    if not mins:
        return []
    tried = fingerprints.attempts()
    return [(mins[b] if b in mins else mins[next(j for j in tried[b].tolist() if j in mins)]) & 255 for b in range(256)]


def brute_likeness(a, b):
    if not a or not b:
        return float(a == b)
    return max(0.0, (sum(x == y for x, y in zip(a, b)) / 256 - 1 / 256) / (1 - 1 / 256))


def brute_edited(docs):
    rows = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0, hashlib.sha256((d[1] or "").encode()).hexdigest()))
    out = []
    for k, (doc, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        prints = [brute_bins(t) for t in (text, edited, after)]
        hexed = ["".join(f"{v:02x}" for v in p) for p in prints]
        out.append((doc, len(text), edited, hexed[0], hexed[1], round(brute_likeness(prints[0], prints[1]), 9), round(brute_likeness(prints[0], prints[2]), 9)))
    return sorted(out, key=repr)


def edited(spark, docs):
    frame = spark.createDataFrame([(i, t, "s") for i, t in docs], DOCS).withColumn("sha", F.lit("x")).withColumn("part", F.lit(1)).withColumn("bins", F.lit(2))
    rows = fingerprints.edited_pairs(frame).select("doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", F.round("near_edited", 9), F.round("near_next", 9)).collect()
    return sorted((tuple(r) for r in rows), key=repr)


def test_edited_pairs(spark):
    long = " ".join(f"word{k * k % 977}" for k in range(3000))
    docs = [(5, long), (9, long.upper()), (1, "a b c"), (2, None), (3, ""), (4, " \t one two  three four five six \n"), (None, "no id at all but some words here"), (None, None), (7, "çà 🙂 é à ü ö ï"), (7, "same id other text entirely, with words"), (8, long), (8, long), (8, long), (11, "x " * 40)]
    docs += [(20 + k, " ".join(f"w{j}" for j in range(k, k + 6 * k))) for k in range(1, 30, 4)]
    assert edited(spark, docs) == brute_edited(docs)


def test_edited_pairs_of_one_row_and_none(spark):
    assert edited(spark, [(1, "one two three four five six seven eight")]) == brute_edited([(1, "one two three four five six seven eight")])
    assert edited(spark, []) == []


def test_likeness_estimates_jaccard(spark):
    """Over texts of many sizes the mean error is near 0 and few estimates are far off."""
    pairs, exact = [], []
    for k in range(200):
        n, cut = 30 + 7 * k, (30 + 7 * k) * (k % 5) // 5
        a = [f"{k}a{j}" for j in range(n)]
        b = a[:cut] + [f"{k}b{j}" for j in range(n - cut)]
        sets = [{tuple(x[j : j + 5]) for j in range(n - 4)} for x in (a, b)]
        pairs.append((" ".join(a), " ".join(b)))
        exact.append(len(sets[0] & sets[1]) / len(sets[0] | sets[1]))
    frame = spark.createDataFrame(pairs, "a string, b string")
    bins = stored(frame.select(fingerprints.fingerprint(F.col("a")).alias("x"), fingerprints.fingerprint(F.col("b")).alias("y"), "a"), "bins")
    got = {r.a: r.s for r in bins.select("a", fingerprints.likeness(F.col("x"), F.col("y")).alias("s")).collect()}
    errors = [got[a] - e for (a, _), e in zip(pairs, exact)]
    assert abs(sum(errors) / len(errors)) < 0.01
    assert sum(abs(e) > 0.12 for e in errors) <= 4
