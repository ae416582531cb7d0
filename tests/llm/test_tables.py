"""Sharding, line dedup, chat, vectors, the pipeline, and oracles."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import SF, SF_CORRECT, canonical

from pyspark.sql import functions as F

from lodestone.llm import ann, chat, common, line_dedup, queries, sharding
from lodestone.llm.common import components


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, duck, name):
    assert canonical(queries.QUERIES[name](spark, SF_CORRECT).toPandas()) == canonical(duck.sql(queries.ORACLES[name]).df())


# -- sharding


def check_shards(rows, got, shards=40):
    assert sorted(Counter((r.doc_id, r.size, r.text_crc32) for r in got).items(), key=str) == sorted(Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows).items(), key=str)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert all(0 <= s < shards for s in by)
    assert all(sorted(r.slot for r in rs) == list(range(len(rs))) for rs in by.values())
    return {s: sum(r.size for r in rs) for s, rs in by.items()}


def test_shards_are_near_equal(spark, duck):
    rows = duck.sql("select doc_id, text from documents").fetchall()
    sizes = check_shards(rows, queries.op7_sharding(spark, SF_CORRECT).collect())
    largest = max(len(t.encode()) for _, t in rows)
    assert len(sizes) == 40 and max(sizes.values()) - min(sizes.values()) <= 2 * largest


def test_shards_of_one_hot_text(spark, odd, none):
    rows = [(i, "same text") for i in range(3000)] + [(i, f"text {i} " * (i % 5)) for i in range(3000, 6000)] + [(7, "again")] * 3000
    got = sharding.report(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)).collect()
    sizes = check_shards(rows, got)
    assert len(sizes) == 40 and max(sizes.values()) - min(sizes.values()) <= 200
    check_shards([(r.doc_id, r.text) for r in odd.collect()], sharding.report(odd).collect())
    assert sharding.report(none).count() == 0
    assert {r.law for r in got} == {"bytes"} and all(r.grown_shard is None for r in got)


def test_boundaries_inside_a_run_of_equal_hashes():
    cuts = sorted([(5, 1, 1), (5, 3, 0), (5, 3, 9), (8, 0, 0)])
    keys = [(h, i, u) for h in (4, 5, 6, 8, 9) for i in (0, 1, 3, 4) for u in (0, 1, 9, 10)]
    h, i, u = (np.array(x, np.int64) for x in zip(*keys, strict=True))
    assert sharding.range_of(cuts, h, i, u).tolist() == [sum(c <= k for c in cuts) for k in keys]


# -- line dedup


def brute_lines(rows, min_length=20, min_docs=3):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    docs = defaultdict(set)
    rank = lambda i: -(1 << 63) if i is None else i
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_length:
                docs[key(line)].add(rank(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(docs.get(key(x), ())) >= min_docs and max(docs[key(x)]) > rank(i))]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_line_dedup_odd_rows(spark, odd, none):
    long = "a line that is long enough to count"
    more = [(20, f"{long}\nown\n\t{long.upper()} \nx"), (21, long), (22, long + "\n"), (23, f"\n{long}\r"), (23, long), (24, "short\nshort"), (25, "short"), (26, "short"), (None, long), (27, "é" * 19 + "\n" + "ü" * 20), (28, "ü" * 20), (29, "ü" * 20)]
    rows = [(r.doc_id, r.text) for r in odd.collect()] + more
    got = line_dedup.report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute_lines(rows)
    assert line_dedup.report(none).count() == 0
    left = line_dedup.cleaned(odd)
    assert left.columns == odd.columns and left.count() == odd.count()
    assert left.where("n_chars <> length(text)").count() == 0


def test_line_dedup_clashing_names_and_a_hot_line(spark, odd):
    long = "a line that is long enough to count"
    extra = odd.selectExpr("*", "'d' as doc", "1 as t1", "2 as T2", "3 as N_lines", "4 as gone")
    more = extra.unionByName(spark.range(100, 700).selectExpr("id as doc_id", f"'{long}\nown ' || id as text"), allowMissingColumns=True)
    out = line_dedup.dedup(more)
    assert out.columns == [*[c for c in more.columns if c not in ("kept", "N_lines")], "n_lines", "n_dropped", "kept"]
    assert out.where("doc_id between 100 and 699 and n_dropped = 1 and kept like 'own%'").count() == 599
    rows = [(r.doc_id, r.text) for r in more.collect()]
    got = [(r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.kept.encode()).hexdigest()) for r in out.collect()]
    assert sorted(got, key=str) == brute_lines(rows) and out.where("doc = 'd' and t1 = 1 and T2 = 2 and gone = 4").count() == odd.count()


def test_line_dedup_is_native(spark):
    df = queries.op8_line_dedup(spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_runs_compact(spark):
    runs = line_dedup.Runs(fanout=2)
    for b in range(5):
        runs.add(spark.createDataFrame([(k, -k, 100 - b * 10 - k) for k in range(b, 6)], "k1 bigint, k2 bigint, doc bigint"))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    got = {r.k1: (r.n, r.last) for r in line_dedup.merged(runs.all()).collect()}
    assert got == {k: (min(k, 4) + 1, 100 - k) for k in range(6)}


# -- chat


def talk(seed, turns, marked=1.0):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(turns):
        role = "user" if i % 2 == 0 else "assistant"
        text = ("How do I do thing %d?" % i) if role == "user" else "\n".join(["Here is an answer to that."] + ["- step %d of the answer" % k for k in range(3)])
        out.append((role, text, rng.random() < marked))
    return out


def test_long_talk_equals_one_viterbi(spark):
    """Segments joined by max-plus products decode as the whole does."""
    turns = talk(1, 60, 0.7)
    chunks = [(1, i, (f"{r.capitalize()}: " if m else "") + t) for i, (r, t, m) in enumerate(turns)]
    df = spark.createDataFrame(chunks, "conv_id bigint, turn bigint, text string")
    model = chat.fit(spark.createDataFrame([(1, i, r, t) for i, (r, t, _) in enumerate(turns)], "conv_id bigint, turn bigint, role string, text string"), unmarked=0.3)
    rows = lambda d: [(r.turn_no, r.role, r.content) for r in d.orderBy("turn_no").collect()]
    whole, cut = rows(chat.parse(df, model)), rows(chat.parse(df, model, segment=7))
    assert whole == cut
    assert [r for _, r, _ in whole] == [r for r, _, _ in turns]  # unmarked turns are recovered too
    assert [c for _, _, c in whole] == [t for _, t, _ in turns]


def test_markers():
    for line, want in (("User: hi", (1, "hi")), ("### Assistant: x", (2, "x")), ("**Human:** a", (1, "a")), ("<|im_start|>", (-1, "<|im_start|>")), ("[bot] y", (2, "y")), ("Username: z", (-1, "Username: z")), ("a:b", (-1, "a:b"))):
        assert chat.marker(line) == want


def test_chat_odd_rows(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, piece string"
    rows = [(1, 0, "user", "hi", ""), (1, 0, "user", "hi", ""), (1, 1, "assistant", None, ""), (2, None, "user", "q", ""), (None, 0, "assistant", "a", ""), (3, 0, None, "no role at all", ""), (4, 0, "robot", "x", ""), (5, 0, "user", "w " * 50_000, "")]
    df = spark.createDataFrame(rows, schema)
    got = {(r.conv_id, r.turn_no): r for r in chat.parse(chat.transcripts(df), chat.fit(df)).collect()}
    assert got[1, 0].role == "user" and got[1, 1].role == "assistant" and got[1, 1].content == ""
    assert got[2, 0].role == "user" and got[None, 0].role == "assistant" and len(got[5, 0].content.strip()) == 99_999
    got = {(r.conv_id, r.turn_no): r for r in chat.report(df).collect()}  # of one turn, a lost role may stay lost
    assert got[1, 0].role == "user" and got[1, 1].role == "assistant" and got[1, 1].n_chars == 0 and got[5, 0].n_chars == 99_999
    assert {k[0] for k in got} == {1, 2, None, 3, 4, 5}
    assert chat.report(spark.createDataFrame([], schema)).count() == 0


def test_roles_of_noisy_transcripts(spark):
    """Markers that are missing or lie are made good by what stands around them."""
    turns = spark.read.parquet("/root/testdata/sf0.1/conversations.parquet")
    noisy = {(r.conv_id, r.turn): r.text for r in chat.transcripts(turns, noisy=True).collect()}
    stored, heard = defaultdict(list), Counter()
    for r in turns.orderBy("conv_id", "turn").collect():
        stored[r.conv_id].append((r.role, r.text.strip(" \t\r\n")))
        role, _ = chat.marker(noisy[r.conv_id, r.turn].split("\n")[0])
        heard["missing" if role < 0 else "right" if chat.ROLES[role] == r.role else "wrong"] += 1
    assert heard["missing"] > 0.1 * heard.total() and heard["wrong"] > 0.03 * heard.total()
    found = defaultdict(list)
    for r in chat.parse(chat.transcripts(turns, noisy=True), chat.fit(turns, 1 / 8, 1 / 16, True)).orderBy("conv_id", "turn_no").collect():
        found[r.conv_id].append((r.role, r.content.strip(" \t\r\n")))
    whole = sum(found[c] == stored[c] for c in stored)
    print("conversations recovered", whole, "of", len(stored), dict(heard))
    assert whole > 0.99 * len(stored)


def test_segments_decode_as_plain_viterbi(spark):
    """Against Viterbi written out over all paths of short talks."""
    import itertools

    turns = [(1, i, r, t) for i, (r, t, _) in enumerate(talk(3, 4))]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    model = chat.fit(df, blank=True)
    for lines in (["User: a?", "", "b", "- c"], ["x", "Assistant: y", "", "z?"], ["", "System: q", "User: w"]):
        e = model.emit(lines)
        score = lambda p: model.start[p[0]] + e[0, p[0]] + sum(model.move[a, b] + x[b] for a, b, x in zip(p, p[1:], e[1:], strict=False))  # noqa: B023, E731
        assert max(itertools.product(range(chat.N), repeat=len(lines)), key=score) == tuple(model.decode(e, None, None))


def test_chat_keeps_turns_without_a_number(spark):
    said = [("user", "again?"), ("user", "again?"), ("assistant", "yes"), ("assistant", "yes"), ("assistant", "yes")]
    rows = [(1, None, r, t) for r, t in said] + [(None, None, "user", f"q {i % 3}?") for i in range(40)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3)
    for segment in (3, 512):
        got = defaultdict(list)
        for r in chat.parse(chat.transcripts(df), chat.fit(df), segment).orderBy("turn_no").collect():
            got[r.conv_id].append((r.role, r.content))
        assert got == {1: sorted(said), None: sorted((r, t) for c, _, r, t in rows if c is None)}


def test_chat_segments_are_bounded(spark, monkeypatch):
    """However many pieces of a conversation have one turn number or none, a segment has few."""
    seen = []
    kept = chat.materialise
    monkeypatch.setattr(chat, "materialise", lambda df, name, *a: seen.append(df) or kept(df, name, *a))
    rows = [(1, i % 2 or None, "user", f"q {i}?") for i in range(200)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    assert chat.parse(chat.transcripts(df), chat.fit(df), 7).count() == 200
    sizes = [r["count"] for r in seen[-1].groupBy("conv_id", "seg").count().collect()]
    assert len(sizes) >= 200 / 7 and max(sizes) <= 7


# -- vectors


def test_nearest_odd_rows(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.normal(size=4)], "x") for i in range(300)]
    rows[50] = (50, None, "x")
    rows += [(500, [0.0] * 4, "x"), (501, [1.0, None, 0.0, 0.0], "x"), (502, [float("nan")] * 4, "x"), (None, [1.0] * 4, "x"), (550, [float("inf"), 0.0, 0.0, 0.0], "x"), (600, [1.0, 2.0], "x"), (601, [2.0, 4.0], "x")]
    rows += [(700 + i, rows[0][1], "x") for i in range(40)]  # ties with a query
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, score string").repartition(5)
    got = defaultdict(list)
    for r in ann.report(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    ok = [(i, np.array(v)) for i, v, _ in rows if i is not None and v is not None and all(x is not None for x in v) and np.isfinite(v).all() and np.linalg.norm(v) > 0]
    want = {}
    for q, x in ok:
        if q % 50 == 0:
            near = sorted((-round(float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)), 12), i) for i, y in ok if i != q and len(y) == len(x))
            want[q] = [(k + 1, i) for k, (_, i) in enumerate(near[:5])]
    assert {q: [(k, i) for k, i, _ in rs] for q, rs in got.items()} == want
    assert ann.report(df.where("false")).count() == 0


@pytest.mark.parametrize("blocks", [{}, {"block_bytes": 40, "candidate_bytes": 200}])
def test_nearest_repeated_query_rows(spark, blocks):
    """Only one row, the query's own, is left out, whatever else has its id."""
    rng = np.random.default_rng(11)
    one, other = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]
    rows = [(50, one)] * 3 + [(51, one), (52, one), (53, one)]
    rows += [(99, other), *[(100, other)] * 12, *[(101, other)] * 2, (102, other), (103, other)]  # the query is not of least id
    rows += [(150, [0.0, 0.0, 1.0, 1.0]), (150, [0.0, 0.0, 1.0, 0.9]), (150, [0.0, 0.0, 0.0, 0.0])]
    rows += [(200 + i, [float(v) for v in rng.normal(size=4)]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = defaultdict(list)
    for r in ann.nearest(df.repartition(3), df.where("vec_id % 50 = 0"), **blocks).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    want = {}
    sound = [(i, x) for i, x in rows if any(x)]
    for q in {i for i, _ in sound if i % 50 == 0}:
        x = min(x for i, x in sound if i == q)
        rest = list(sound)
        rest.remove((q, x))
        near = sorted((-round(float(np.dot(x, y) / np.linalg.norm(y) / np.linalg.norm(x)), 12), i) for i, y in rest)
        want[q] = [i for _, i in near[:5]]
    assert got == want and want[50] == [50, 50, 51, 52, 53] and want[100] == [99, 100, 100, 100, 100] and want[150][0] == 150


def test_meeting_blocks_equal_one_block(spark):
    emb = spark.read.parquet(f"{SF}/embeddings.parquet")
    q = emb.where("vec_id % 50 = 0")
    one, many = (sorted(tuple(r) for r in ann.nearest(emb, q, **b).collect()) for b in ({}, {"block_bytes": 600, "candidate_bytes": 5000}))
    assert one == many and one


def test_first_copies_keep_every_querys_nearest():
    rng = np.random.default_rng(12)
    for _ in range(300):
        n, k = int(rng.integers(1, 40)), int(rng.integers(1, 5))
        ids, x = rng.integers(0, 8, n), rng.integers(0, 2, (n, 1)).astype(float) + 1
        keep = ann.first_copies(ids, x, k)
        for v in (1.0, 2.0):
            best = lambda at: sorted(i for i, y in zip(ids[at].tolist(), x[at, 0].tolist(), strict=True) if y == v)[:k]  # noqa: B023, E731
            assert best(keep) == best(np.arange(n)) and (x[keep, 0] == v).sum() <= k


def test_int8_bound_holds():
    rng = np.random.default_rng(10)
    a, b = (ann.Side(np.arange(n), rng.normal(size=(n, 64)) * rng.lognormal(size=(n, 1))) for n in (40, 200))
    dot = (a.code.astype(float) @ b.code.astype(float).T) * a.scale[:, None] * b.scale[None, :]
    true = (a.x @ b.x.T) / (a.norm[:, None] * b.norm[None, :])
    assert (np.abs(dot - true) <= a.left[:, None] + a.size[:, None] * b.left[None, :] + 1e-9).all()


# -- common


def test_sieve_lets_all_wanted_rows_pass(spark, monkeypatch):
    rows = spark.range(20_000).selectExpr("id", "xxhash64(id) as h")
    wanted = rows.where("id % 50 = 0")
    some = common.may_have(rows, wanted, "h", 400)
    assert some.columns == ["id", "h"] and some.where("id % 50 = 0").count() == 400 and some.count() < 400 + 20_000 / 8
    monkeypatch.setattr(common, "SIEVE_BITS", 1 << 15)  # too small for as many: all may pass, none is lost
    assert common.may_have(rows, rows, "h", 20_000).count() == 20_000
    assert common.may_have(rows, wanted.where("false"), "h", 0).count() == 0
    assert common.sieved(rows, wanted, "h", 400).count() == 20_000


def test_hot_keys_are_joined_too(spark):
    rows = spark.range(5000).selectExpr("id", "if(id % 3 = 0, 7, id) as k", "id as v")
    look = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("m"))
    got = common.looked_up(rows, look, ["k"], "n", 5000, 1667)
    assert sorted(map(tuple, got.select("id", "m").collect())) == sorted(map(tuple, rows.join(look, "k").select("id", "m").collect())) and got.count() == 5000


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (102, 101), (103, 100), (7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(51)} | {i: 100 for i in range(100, 104)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_components_in_few_files(spark, monkeypatch, tmp_path):
    """Files of the tables of a round follow the bytes of the edges, not the partitions of a shuffle."""
    from lodestone.llm import common

    edges = [(i, i + 1) for i in range(0, 300) if i % 10 != 9] + [(1000, i) for i in range(1001, 1200)]
    spark.createDataFrame(edges, "a bigint, b bigint").write.parquet(f"{tmp_path}/edges")
    want = {i: i - i % 10 for i in range(300)} | {i: 1000 for i in range(1000, 1200)}
    conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    made, kept = [], common.materialise
    monkeypatch.setattr(common, "materialise", lambda *a: (out := kept(*a), made.append(len(out.inputFiles())))[0])
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = {r.node: r.component for r in components(spark.read.parquet(f"{tmp_path}/edges")).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == want and made == [1] * len(made) and len(made) >= 3
