"""The pipeline against a plain version of each stage on its own input."""

import math
from collections import defaultdict

import corpus_pipeline
import numpy as np
from helpers import SF_CORRECT
from test_decontaminate import brute as brute_leaks
from test_decontaminate import words
from test_ngram_join import brute as brute_links
from test_tables import brute_lines
from test_texts import expected, library

from lodestone.llm import langid
from lodestone.llm.common import materialise


def test_stages(spark, duck):
    docs = spark.read.parquet(f"{SF_CORRECT}/documents.parquet")
    columns = docs.columns
    frames = {}
    for name, stage in corpus_pipeline.STAGES:
        frames[name] = (docs, out := materialise(stage(spark, docs, SF_CORRECT), name))
        docs = out
        assert name == "tokens" or docs.columns == columns

    rows = lambda df: [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]

    before, after = frames["language"]
    seen = langid.apply(before, langid.fit(before), keep=["doc_id"]).where("not rejected")
    assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in seen.collect())

    before, after = frames["lines"]
    import hashlib

    want = {i: sha for i, _, _, sha in brute_lines(rows(before))}
    assert {i: hashlib.sha256(t.encode()).hexdigest() for i, t in rows(after)} == want

    before, after = frames["near_copies"]
    assert sorted(i for i, _ in rows(after)) == sorted({least for _, _, least in brute_links(rows(before))})

    before, after = frames["benchmark_leaks"]
    items = duck.sql("select item_id, text from benchmark").fetchall()
    got = {i for i, _ in rows(after)}
    gone = [(i, t) for i, t in rows(before) if i not in got]
    assert all(v[2] for v in brute_leaks(gone, items)) and gone
    kept = [(i, t) for i, t in rows(after)][::25]
    assert not any(v[2] for v in brute_leaks(kept, items))

    before, after = frames["tokens"]
    lib = library()
    assert sorted(tuple(r) for r in after.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == sorted((i, *expected(lib, t)) for i, t in rows(before))


def test_run_equals_the_stages(spark):
    out = corpus_pipeline.run(spark, SF_CORRECT)
    assert out.columns[0] == "doc_id" and 800 < out.count() < 1000


def test_run_on_odd_rows_and_on_none(spark, tmp_path, odd):
    import os

    docs = spark.read.parquet(f"{SF_CORRECT}/documents.parquet")
    passage = spark.read.parquet(f"{SF_CORRECT}/benchmark.parquet").first().text
    more = odd.select("doc_id", "text", "lang", "source", odd.n_chars.cast(docs.schema["n_chars"].dataType).alias("n_chars"))
    more = more.withColumn("doc_id", more.doc_id + 100_000)
    leak = docs.where("doc_id = 0").selectExpr("200000L as doc_id", f"concat(text, ' {passage} ', text) as text", "lang", "source", "n_chars")
    sets = {"odd": docs.unionByName(more).unionByName(more.where("doc_id = 100001")).unionByName(leak).withColumns({"n_words": docs.n_chars, "kept": docs.source, "score": docs.n_chars}), "none": docs.where("false"), "nulls": docs.selectExpr("cast(null as bigint) as doc_id", "cast(null as string) as text", "cast(null as string) as lang", "cast(null as string) as source", "cast(null as int) as n_chars")}
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    for name, rows in sets.items():
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        os.symlink(f"{SF_CORRECT}/benchmark.parquet", f"{tmp_path}/{name}/benchmark.parquet")
        before = set(os.listdir(shared))
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert len(set(os.listdir(shared)) - before) == 1  # the last stage's input alone is left
        if name == "odd":
            ids = [r.doc_id for r in out]
            assert 800 < len(ids) < 1100 and 200_000 not in ids and ids.count(100_001) == 1 and 100_002 not in ids
        else:
            assert out == []


def plain_language(model, text):
    """(rejected, how clear that is): nearest centroid over hashed trigrams, a letter at a time."""
    codes = [0, *(ord(c) if c.isalpha() else 0 for c in text.lower()), 0]
    counts = np.zeros(langid.DIMS)
    for a, b, c in zip(codes, codes[1:], codes[2:]):
        if b:
            h = (a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + c * 0x165667B19E3779F9) * 0xD6E8FEB86659FD93 % (1 << 64)
            counts[h >> (64 - langid.BITS)] += 1
    if not counts.any():
        return True, 1.0
    x = np.log1p(counts) * model.idf
    cos = model.centre.astype(float) @ (x / np.sqrt((x * x).sum()))
    best = int(cos.argmax())
    margin = cos[best] - model.floor[best] * min(1.0, math.sqrt(counts.sum() / 200))
    return margin < 0, abs(margin)


def holds_leak(text, windows, sizes):
    """Whether a window stands anywhere; ``windows``: of each first word, all from there."""
    w = words(text)
    return any(tuple(w[s : s + k]) in windows[first] for s, first in enumerate(w) for k in sizes.get(first, ()))


def test_every_row_of_the_language_and_leak_stages(spark, duck):
    docs = spark.read.parquet(f"{SF_CORRECT}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())

    model = langid.fit(docs)
    judged = {r.doc_id: plain_language(model, r.text or "") for r in docs.collect()}
    clear = {i for i, (_, margin) in judged.items() if margin > 1e-5}
    after = materialise(stages["language"](spark, docs, SF_CORRECT), "language")
    assert len(clear) > 0.99 * len(judged) and any(no for no, _ in judged.values())
    assert [i for i in ids(after) if i in clear] == sorted(i for i in clear if not judged[i][0])

    before = after
    for name in ("lines", "near_copies"):
        before = materialise(stages[name](spark, before, SF_CORRECT), name)
    after = materialise(stages["benchmark_leaks"](spark, before, SF_CORRECT), "benchmark_leaks")
    windows, sizes = defaultdict(set), defaultdict(set)
    for (text,) in duck.sql("select text from benchmark").fetchall():
        v = words(text)
        k = min(13, len(v))
        for a in range(len(v) - k + 1 if v else 0):
            windows[v[a]].add(tuple(v[a : a + k]))
            sizes[v[a]].add(k)
    rows = before.select("doc_id", "text").collect()
    assert windows and ids(after) == sorted(r.doc_id for r in rows if not holds_leak(r.text, windows, sizes))
    assert len(ids(after)) < len(rows)
