import hashlib
import re

import pytest
from helpers import SF

from lodestone.llm import decontaminate as d
from lodestone.llm import queries


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for item, b in items:
            v = words(b)
            k = min(13, len(v))
            for a in range(len(v) - k + 1 if v else 0):
                for s in range(len(w) - k + 1):
                    if w[s : s + k] == v[a : a + k]:
                        hit |= set(range(s, s + k))
                        if item is not None:
                            found.add(str(item))
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(found), sha, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


ITEMS = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"), (2, "two words"), (2, "two words"), (3, None), (4, "!!"), (None, "same id"), (10, "word " * 30), (20, "größe straße")]


@pytest.mark.parametrize("block", [1 << 20, 10])
def test_against_brute_force(spark, odd, block):
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    rows = odd.select("doc_id", "text")
    short = [(r.doc_id, r.text) for r in rows.collect() if len(r.text or "") < 50_000]
    got = d.find_contamination(rows.where("length(coalesce(text, '')) < 50000"), bench, block_bytes=block).withColumn("n_hit", d.n_hit())
    got = [(r.doc_id, r.n_words, r.n_hit, len(r.hit_items), d.items_digest(r.hit_items), r.n_hit > 0 and 20 * r.n_hit >= r.n_words) for r in got.collect()]
    assert sorted(got, key=str) == brute(short, ITEMS)


def test_whole_texts_and_empty_tables(spark, odd, none):
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    got = {r.doc_id: r for r in d.report(odd, bench).where("doc_id in (10, 14)").collect()}
    assert (got[10].n_words, got[10].n_hit) == (1, 0) and (got[14].n_words, got[14].n_hit) == (20_000, 20_000)
    assert d.report(none, bench).count() == 0
    clean = d.report(odd, bench.where("false"))
    assert clean.count() == odd.count() and clean.where("contaminated or n_hit > 0").count() == 0
    left = d.drop_contaminated(odd, bench)
    assert left.columns == odd.columns
    assert left.count() == odd.count() - d.report(odd, bench).where("n_hit > 0").count()


def test_a_passage_in_a_long_document_goes(spark):
    passage = " ".join(f"p{i}" for i in range(13))
    body = [f"w{i}" for i in range(5000)]
    rows = [(1, " ".join([*body[:3000], passage, *body[3000:]])), (2, " ".join(body)), (3, " ".join([*body[:10], *passage.split()[:12], *body[10:]])), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, passage)], "item_id bigint, text string")
    assert not d.report(docs, bench).where("contaminated").count()
    assert sorted(r.doc_id for r in d.drop_contaminated(docs, bench).collect()) == [2, 3, 4]
    assert d.drop_contaminated(docs, bench.where("false")).count() == 4


def test_lanes_find_every_place():
    # windows recur all over a text that spans many lanes
    body = [b"w%d" % (i % 97) for i in range(30_000)]
    pattern = body[5:25]
    n, spans, items = d.BenchmarkIndex([("a", b" ".join(pattern)), ("b", b"w1 w2"), ("c", b"w3")]).search([b" ".join(body), b"w2 w3", b"w1", b"w2"])
    hit = set()
    for k, p in ((13, pattern[:13]), *((13, pattern[i : i + 13]) for i in range(1, 8)), (2, [b"w1", b"w2"]), (1, [b"w3"])):
        hit |= {j for s in range(len(body) - k + 1) if body[s : s + k] == p for j in range(s, s + k)}
    assert n.tolist() == [30_000, 2, 1, 1]
    assert {i for a, b in spans[0] for i in range(a, b)} == hit
    assert items[1] == {"c"} and items[2] == set() and spans[2] == []


def test_clashing_names_give_way(spark, odd):
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    extra = odd.selectExpr("*", "1 as HIT_SPANS", "2 as n_hits")
    found = d.find_contamination(extra, bench)
    assert found.columns == [*[c for c in odd.columns if c != "n_words"], "n_hits", "n_words", "hit_spans", "hit_items"]
    assert found.where("doc_id = 14 and n_words = 20000").count() == 1
    assert d.drop_contaminated(extra, bench).columns == extra.columns


def test_equal_windows_are_one():
    index = d.BenchmarkIndex([("a", b"word " * 30), ("b", b"word " * 20), (None, b"word " * 13), ("c", b"x y")])
    assert [len(s.whole) for s in index.searches] == [1, 1]
    _, spans, items = index.search([b"word " * 14 + b"x y"])
    assert d.merge_spans(spans[0]) == [(0, 16)] and items == [{"a", "b", "c"}]


def test_query_is_whole(spark):
    assert queries.op1_decontaminate(spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()
