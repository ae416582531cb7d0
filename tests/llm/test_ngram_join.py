import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import SF, SF_CORRECT
from test_decontaminate import words

from lodestone.llm import ngram_join as j
from lodestone.llm import queries


def shingles(text):
    """Word shingles, spelled out."""
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute(rows):
    """(doc_id, n_links, least id of the component) of every row, by all pairs that have a shingle in
    common."""
    sets = [shingles(t) for _, t in rows]
    at = defaultdict(list)
    for x, s in enumerate(sets):
        for g in s:
            at[g].append(x)
    common = Counter((a, b) for xs in at.values() for a in xs for b in xs if b < a)
    near = defaultdict(set)
    for (a, b), n in common.items():
        if 10 * n >= 8 * (len(sets[a]) + len(sets[b]) - n):
            near[a].add(b)
            near[b].add(a)
    out = []
    for a in range(len(rows)):
        seen, todo = {a}, [a]
        while todo:
            todo += (new := near[todo.pop()] - seen)
            seen |= new
        ids = [rows[x][0] for x in seen if rows[x][0] is not None]
        out.append((rows[a][0], len(near[a]), min(ids) if ids else None))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_links, r.class_id) for r in df.collect()), key=str)


def test_all_pairs_of_the_table(spark, duck):
    rows = duck.sql("select doc_id, text from documents").fetchall()
    assert got(queries.op3_ngram_join(spark, SF_CORRECT)) == brute(rows)


def test_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert got(j.links(odd)) == brute(rows)
    assert j.links(none).count() == 0


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(j, "BLOCK", 8)


def test_a_large_group_over_many_blocks(spark, small_blocks):
    rnd = random.Random(3)
    base = [f"w{i}" for i in range(160)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(len(w))] = f"x{rnd.random()}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(base)) for i in range(5)]
    assert got(j.links(spark.createDataFrame(rows, "doc_id bigint, text string"))) == brute(rows)


def test_buckets_of_a_chain(spark, small_blocks):
    """Near copies of near copies: buckets differ, the component is wide, every link counts once."""
    rnd = random.Random(5)
    w, rows = [f"w{i}" for i in range(120)], []
    for i in range(150):
        w = list(w)
        for _ in range(2):
            w[rnd.randrange(len(w))] = f"y{i}-{rnd.random()}"
        rows.append((i, " ".join(w)))
    rows += [(500 + i, t) for i, t in rows[:20]]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute(rows)
    assert got(j.links(df)) == want and max(n for _, n, _ in want) > 4


def test_keep_one(spark, odd, none):
    left = j.keep_one(odd)
    assert left.columns == odd.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in left.collect())
    kept = [t for n, i, t in ids if not n and i == 1]
    assert len(kept) == 1  # repeated row, copies in other case, near copy and the row without an id are gone
    assert sum(1 for n, i, t in ids if not n and i == 3) == 1
    assert sum(1 for n, i, t in ids if n) == 1 and sum(1 for n, i, _ in ids if not n and i in (8, 9)) == 1
    assert {4, 5, 6, 7} <= {i for n, i, _ in ids if not n}
    assert j.keep_one(none).count() == 0


def test_pruning_is_safe():
    """Pairs at the threshold survive; unlike pairs go early."""
    rng = np.random.default_rng(5)
    lost = 0
    for _ in range(200):
        s = np.unique(rng.integers(1, 2**63, 500, dtype=np.uint64))
        common = s[:445]  # 445 / 555 > 0.8
        a, b = np.sort(s), np.sort(np.concatenate([common, rng.integers(1, 2**63, 55, dtype=np.uint64)]))
        i, _ = j.surviving_pairs(np.array([j.signature(a), j.signature(b)]), np.arange(2), None)
        lost += not len(i)
    assert lost == 0
    far = np.array([j.signature(np.sort(rng.integers(1, 2**63, 500, dtype=np.uint64))) for _ in range(20)])
    assert len(j.surviving_pairs(far, np.arange(20), None)[0]) == 0


def test_verify_ways_agree():
    rng = np.random.default_rng(6)
    pool = np.unique(rng.integers(1, 2**62, 60, dtype=np.uint64))
    sets = [np.sort(rng.choice(pool, rng.integers(40, 58), replace=False)) for _ in range(30)]
    i, k = np.triu_indices(30, 1)
    many = j.verify(sets, i, k)
    assert many.tolist() == [10 * len(np.intersect1d(sets[a], sets[b])) >= 8 * len(np.union1d(sets[a], sets[b])) for a, b in zip(i, k, strict=True)]
    assert [bool(j.verify(sets, i[p : p + 1], k[p : p + 1])[0]) for p in range(len(i))] == many.tolist()


def test_no_pairs_in_the_plan(spark):
    assert queries.op3_ngram_join(spark, SF).columns == ["doc_id", "n_shingles", "class_id", "n_copies", "n_links"]
