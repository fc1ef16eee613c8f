"""Every stage of the pipeline against SQL or brute force on its own input."""

import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tideline.llm import queries_sql, shared

DATA = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def by_sql(docs, sql):
    con = duckdb.connect()
    con.register("documents", docs)
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{DATA}/benchmark.parquet'")
    return con.execute(sql).fetchdf()


def quality_rules(docs):
    kept = by_sql(docs, queries_sql.LINE_QUALITY)
    return set(kept[kept.kept].doc_id)


def one_of_each_group(docs):
    sets = {}
    for i, text in zip(docs.doc_id, docs.text):
        w = WORDS.findall(text.translate(LOW))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i for i in sets if find(i) == i}


def without_benchmark(docs):
    return set(docs.doc_id) - set(by_sql(docs, queries_sql.CONTAMINATED).doc_id)


def mixed(docs):
    drawn = by_sql(docs, queries_sql.MIXED)
    return set(drawn[drawn.kept].doc_id)


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "one_of_each_group", "without_benchmark", "mixed", "token_ids"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.toPandas()
        docs = shared.stored(stage(spark, docs, DATA), "test-stage")
        assert docs.columns == list(before.columns)
        after = docs.toPandas()
        want = globals()[name](before)
        assert set(after.doc_id) == want and len(after) == len(want) and len(want) > 0
        assert dict(zip(after.doc_id, after.text)) == {i: t for i, t in zip(before.doc_id, before.text) if i in want}
    got = [tuple(r) for r in corpus_pipeline.token_ids(spark, docs, DATA).orderBy("start").collect()]
    library, start, ids = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for i, text in sorted(zip(after.doc_id, after.text)):
        tokens = library.encode(text, add_special_tokens=False).ids + [corpus_pipeline.END_ID]
        ids.append((i, start, len(tokens), zlib.crc32(np.array(tokens, "<u4").tobytes())))
        start += len(tokens)
    assert got == ids
    assert sorted(map(tuple, corpus_pipeline.run(spark, DATA).collect())) == sorted(got)
