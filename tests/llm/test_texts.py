"""Secret scans, BPE, language, quality."""

import hashlib
import random
import re

import numpy as np
import pytest
from helpers import SF, SF_CORRECT

from lodestone.llm import bpe, langid, quality, queries, secret_scan

tokenizers = pytest.importorskip("tokenizers")


# -- secrets

ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def plain_scan(text):
    """The contract, read word for word: base matches first, failing ones dropped after."""
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(f"(?ai){ASSIGN}", text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(out))


def test_scan_matches_the_contract():
    rnd = random.Random(2)
    bits = ["token", "PassWord", "api_key", "apikey", "secret", "\"", "'", " ", "=", ":", "abcdefgh", "0123456789abcdef", "AKIA", "ABCDEFGH", "x", "é", "K", "ſecret=abcdefgh1", "\n", "-", "."]
    for _ in range(4000):
        t = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 14)))
        assert ",".join(f"{k}:{s}:{e}" for s, e, k in secret_scan.scan(t)) == plain_scan(t), t


def test_secret_report(spark, odd, none):
    got = [(r.doc_id, r.spans, r.base_sha256) for r in secret_scan.report(odd).collect()]
    want = [(r.doc_id, s := plain_scan(r.text), hashlib.sha256(s.encode()).hexdigest()) for r in odd.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert secret_scan.report(none).count() == 0


def test_ledger_scans_only_unseen(spark, odd):
    first = secret_scan.update(odd.where("doc_id <= 5"))
    assert secret_scan.unseen(odd.where("doc_id <= 5"), first).count() == 0
    new = secret_scan.update(odd, first)
    assert new.select("blob").intersect(first.select("blob")).count() == 0
    whole = secret_scan.findings(odd, first.union(new))
    assert whole.count() == odd.count() and whole.where("spans is null").count() == 0
    assert secret_scan.unseen(odd, first, rules="other").count() == odd.selectExpr("coalesce(text, '') as t").distinct().count()


def test_commits_scan_each_blob_once(spark, odd, monkeypatch):
    ledgers = []
    kept = secret_scan.update
    monkeypatch.setattr(secret_scan, "update", lambda *a: ledgers.append(kept(*a)) or ledgers[-1])
    for commits in (1, 4):
        ledgers.clear()
        got = sorted(((r.doc_id, r.spans) for r in secret_scan.report(odd, commits).collect()), key=str)
        assert got == sorted(((r.doc_id, plain_scan(r.text)) for r in odd.collect()), key=str)
        blobs = [r.blob for x in ledgers for r in x.collect()]
        assert len(ledgers) == commits and len(blobs) == len(set(blobs)) == odd.selectExpr("coalesce(text, '')").distinct().count()


def test_findings_names_and_hot_blobs(spark, odd):
    more = odd.selectExpr("*", "'mine' as spans", "1 as BLOB").unionByName(spark.range(600).selectExpr("id as doc_id", "'token = abcdefghij' as text"), allowMissingColumns=True)
    got = secret_scan.findings(more, secret_scan.update(more), keep=["doc_id", "lang", "spans", "BLOB"])
    assert got.columns == ["doc_id", "lang", "blob", "spans", "n_assign", "n_access", "n_hex"]
    assert got.count() == more.count() and got.where("spans = 'assign:0:18' and n_assign = 1").count() == 600


# -- BPE


def library():
    t = tokenizers.Tokenizer.from_file(queries.vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def expected(lib, text):
    ids = lib.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_equals_the_library(spark, odd, none):
    lib = library()
    want = sorted([(r.doc_id, *expected(lib, r.text)) for r in odd.collect()], key=str)
    got = bpe.report(odd, queries.vocabulary())
    assert sorted([tuple(r) for r in got.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()], key=str) == want
    assert bpe.report(none, queries.vocabulary()).count() == 0


def test_bpe_on_the_whole_table(spark, duck):
    lib = library()
    want = sorted((i, *expected(lib, t)) for i, t in duck.sql("select doc_id, text from documents").fetchall())
    assert sorted(tuple(r) for r in queries.op5_bpe(spark, SF_CORRECT).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == want


def test_bpe_fuzz():
    lib, own = library(), bpe.WordBpe(queries.vocabulary())
    rnd = random.Random(4)
    pool = "aàéßİΣσςſKﬁ①²½٣  \u0085\u001c\t\n'sS'll日本語한글é😀👍🏽_-.,!012ǅ‍﻿"
    texts = ["".join(rnd.choice([*pool, "<|endoftext|>", "the ", "ing"]) for _ in range(rnd.randint(0, 40))) for _ in range(2000)] + ["a" * 3000, "<|startoftext|>"]
    for t, (ids, n, decoded) in zip(texts, own.encode_batch(texts), strict=True):
        e = lib.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == e and n == len(e), t
        assert decoded == lib.decode(e, skip_special_tokens=False) == own.decode(e)


def test_bpe_small_memory(monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY_WORDS", 3)
    own, other = bpe.WordBpe(queries.vocabulary()), library()
    for t in ("one two three four five", "two six", "seven one two"):
        assert np.frombuffer(own.encode_batch([t])[0][0], "<u4").tolist() == other.encode(t, add_special_tokens=False).ids


# -- language


def test_language_held_out(spark, duck):
    got = queries.op6_language_id(spark, "/root/testdata/sf0.1").where("held_out").select("doc_id", "lang_pred").toPandas()
    import duckdb

    truth = duckdb.sql("select doc_id, lang from '/root/testdata/sf0.1/documents.parquet'").df()
    m = got.merge(truth, on="doc_id")
    assert len(m) > 2000 and (m.lang_pred == m.lang).mean() > 0.99


def test_language_odd_rows(spark, odd, none):
    docs = spark.read.parquet(f"{SF_CORRECT}/documents.parquet")
    model = langid.fit(docs)
    got = langid.apply(odd, model, keep=["doc_id"]).collect()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert len(got) == odd.count()
    assert all(by[i].lang_pred == "und" and by[i].score == 0 and by[i].rejected for i in (4, 5, 6, 7))
    assert all(by[i].lang_pred in ("en", "fr", "de", "es") and 0 <= by[i].score <= 1 for i in (1, 8, 10, 11, 12, 13, 14))
    assert langid.apply(none, model, keep=["doc_id"]).count() == 0
    unlearned = langid.apply(odd, langid.fit(odd.where("false")), keep=["doc_id"])
    assert unlearned.where("lang_pred = 'und' and rejected").count() == odd.count()
    left = langid.drop_rejected(docs)
    assert left.columns == docs.columns and left.count() > 0.98 * docs.count()
    assert langid.drop_rejected(odd).columns == odd.columns


# -- quality


def test_quality_held_out(spark):
    import duckdb

    got = queries.op2_quality(spark, "/root/testdata/sf0.1").toPandas().merge(duckdb.sql("select * from '/root/testdata/sf0.1/labels.parquet'").df(), on="doc_id")
    m = got[got.held_out]
    good, bad = m[m.quality == 1].score.values, m[m.quality == 0].score.values
    auc = np.mean([(good > b).mean() + 0.5 * (good == b).mean() for b in bad])
    assert len(bad) > 50 and auc > 0.97
    assert (m[m.quality == 1].predicted == 1).mean() > 0.97 and (m[m.quality == 0].predicted == 0).mean() > 0.9


def test_quality_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, 0), (8, None, 0), (None, 1, 0), (9, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = quality.report(odd, labels)
    assert got.count() == odd.count() and got.where("score is null or score < 0 or score > 1 or predicted <> int(score >= 0.5)").count() == 0
    assert quality.report(none, labels).count() == 0
    assert quality.report(odd, labels.where("false")).where("score <> 0.5").count() == 0


def test_pu_risk_finds_the_classes():
    rng = np.random.default_rng(1)
    pos = rng.normal(1, 1, (600, 5)).astype(np.float32)
    unl = np.concatenate([rng.normal(1, 1, (420, 5)), rng.normal(-1, 1, (180, 5))]).astype(np.float32)
    s = quality.nn_pu_fit(pos, unl, 0.7).score(unl)
    assert (s[:420] > 0.5).mean() > 0.93 and (s[420:] < 0.5).mean() > 0.9


@pytest.mark.parametrize("share", [0.3, 0.7, 0.9])
def test_prior_is_found_without_bad_marks(share):
    rng = np.random.default_rng(2)
    n = int(3000 * share)
    pos = rng.normal(1.5, 1, (2000, 5)).astype(np.float32)
    unl = rng.permutation(np.concatenate([rng.normal(1.5, 1, (n, 5)), rng.normal(-1.5, 1, (3000 - n, 5))]).astype(np.float32))
    assert share - 0.08 < quality.estimated_prior(pos, unl) < share + 0.02


def test_quality_fit_does_not_depend_on_partitions(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    one, other = (quality.fit(docs.repartition(n), labels, max_rows=60) for n in (2, 7))
    assert np.array_equal(one.weight, other.weight) and one.bias == other.bias
    bad = labels.selectExpr("doc_id", "if(quality = 0, null, quality) as quality")
    assert np.array_equal(quality.fit(docs, bad, max_rows=60).weight, one.weight)  # bad marks play no part


def test_clashing_names_give_way(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = odd.selectExpr("*", "1 as Predicted", "2 as REJECTED")
    for out, added in ((quality.apply(extra, None), {"score", "predicted"}), (langid.apply(extra, langid.fit(docs)), {"lang_pred", "score", "rejected"}), (bpe.encode(extra, queries.vocabulary()), {"ids", "n_tokens", "decoded"})):
        names = [c for c in extra.columns if c.lower() not in added]
        assert out.columns[: len(names)] == names and set(out.columns[len(names) :]) == added and out.count() == extra.count()


def plain_counts(text):
    """Trigrams of letters in one pass over the whole text."""
    codes = [0, *(ord(c) if c.isalpha() else 0 for c in text.lower()), 0]
    out = np.zeros(langid.DIMS)
    for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
        if b:
            out[(a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + c * 0x165667B19E3779F9) * 0xD6E8FEB86659FD93 % (1 << 64) >> (64 - langid.BITS)] += 1
    return out


def test_long_texts_are_counted_in_pieces(monkeypatch):
    monkeypatch.setattr(langid, "PIECE", 7)
    texts = ["", "Ab", "one two-three, FOUR five six", "x" * 50, "été à Noël 1234567 fin", "1234567 8"]
    counts, lettered = langid.trigram_counts(texts)
    assert np.array_equal(counts, np.array([plain_counts(t) for t in texts])) and lettered.tolist() == [False, True, True, True, True, False]


def test_unlike_texts_of_any_length_are_rejected(spark):
    docs = spark.read.parquet(f"{SF_CORRECT}/documents.parquet")
    model = langid.fit(docs)
    rnd = random.Random(1)
    for n in (100, 1500, 20_000):
        texts = [" ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 9))) for _ in range(n)) for _ in range(5)]
        assert model.predict(*langid.trigram_counts(texts))[2].all()


def test_language_fit_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one, other = (langid.fit(docs.repartition(n), max_texts=20) for n in (2, 7))
    assert np.array_equal(one.centre, other.centre) and one.lang == other.lang
    hot = docs.unionByName(docs.where("doc_id = 0").crossJoin(spark.range(3000)).drop("id"))
    assert langid.fit(hot, max_texts=20).centre.shape[0] <= 16


def test_queries_are_whole(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for q in (queries.op2_quality, queries.op4_secret_scan, queries.op6_language_id):
        assert q(spark, SF).count() == n


def test_hot_blobs_of_long_spans(spark, monkeypatch):
    """Hot blobs are looked up by broadcast where their spans are short, else by a shuffle."""
    from lodestone.llm import common, secret_scan

    texts = ["token=abcdefgh"] * 40 + ["secret: 12345678 " * 9] * 50 + [None] * 30 + ["AKIA" + "Z" * 20, "plain"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = sorted(map(tuple, secret_scan.report(docs).collect()))
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    monkeypatch.setattr(secret_scan, "SHORT_BYTES", 40)
    assert sorted(map(tuple, secret_scan.report(docs).collect())) == want and len(want) == len(texts)


def test_scan_decodes_one_text_at_a_time():
    import tracemalloc

    import pyarrow as pa

    text = "\U0001f600" * 20_000 + " token=abcdefgh"
    batch = pa.RecordBatch.from_pydict({"blob": [str(i) for i in range(200)], "text": [text] * 199 + [None]})
    tracemalloc.start()
    out = pa.Table.from_batches(secret_scan._scan_blobs("r")(iter([batch]))).to_pydict()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out["blob"] == batch["blob"].to_pylist() and out["spans"] == ["assign:20001:20015"] * 199 + [""] and out["n_assign"] == [1] * 199 + [0]
    assert peak < 2_000_000


def test_ledgers_in_few_files(spark, monkeypatch, tmp_path):
    """Files of the tables and of the result follow the bytes of the input, not the partitions of a shuffle."""
    from lodestone.llm import common

    texts = [f"text {i} token=abcdefgh{i}" if i % 3 else "secret: 12345678" for i in range(400)] + [None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        for file_bytes, files in ((1 << 20, 1), (1 << 10, None), (1, None)):
            monkeypatch.setattr(common, "FILE_BYTES", file_bytes)
            mark = common.written()
            out = secret_scan.report(docs)
            assert {r.doc_id: r.spans for r in out.collect()} == {i: plain_scan(t) for i, t in enumerate(texts)} and out.count() == len(texts)
            made = [len(spark.read.parquet(p).inputFiles()) for p in common._WRITTEN[mark:] if "/paths-" not in p]
            assert len(made) == secret_scan.COMMITS + 1
            if files:
                assert made == [files] * len(made) and out.rdd.getNumPartitions() == files
            else:
                assert min(made) > 1
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
