import numpy as np
import pytest
from helpers import SF, SF_CORRECT
from pyspark.sql import functions as F

from lodestone import schema
from lodestone.functions import classify as cl
from lodestone.operators import chat, chunk, evaluate, keyword, models, retrieve, sync, vector
from lodestone.sources import connector, files, store


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    ("path", "hint", "want"),
    [
        ("eks.tf.json", None, ("terraform", "generic")),
        ("Dockerfile", None, ("dockerfile", "code")),
        ("Puppetfile", None, ("ruby", "code")),
        ("INC-1.md", None, ("prose", "incident")),
        ("inc-1.md", None, ("prose", "generic")),
        ("kubernetes/core/a.yaml", None, ("yaml", "kubernetes_manifest")),
        ("x.md", "set/runbooks/x.md", ("prose", "runbook")),
        ("docker-compose.yml", None, ("yaml", "generic")),
        (".profile", None, ("prose", "generic")),
        ("a.b/c.PY", None, ("python", "code")),
        ("trail.", None, ("prose", "generic")),
    ],
)
def test_classify(spark, path, hint, want):
    df = spark.createDataFrame([(path, hint)], "p string, h string")
    r = df.select(cl.format_of(F.col("p")).alias("f"), cl.doc_type_of(F.col("p"), F.col("h")).alias("t")).first()
    assert (r.f, r.t) == want


def test_refusals(spark):
    df = spark.createDataFrame([("I could not find this information in the available documents.", True), ("The port is 8080.", False), (None, False)], "a string, want boolean")
    assert df.where(cl.is_refusal(F.col("a")) != F.col("want")).count() == 0


def test_topk_plans(spark):
    emb = spark.read.parquet(f"{SF}/embeddings.parquet")
    one = vector.topk_one(emb, emb.where("vec_id = 0"), 5)
    assert "TakeOrderedAndProject" in plan(one) and "CartesianProduct" not in plan(one)
    assert "WindowGroupLimit" in plan(vector.topk_batch(emb, emb.where("vec_id < 3"), 5))


def test_topk_batch_equals_one_by_one(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(200)] + [(200, None), (201, [0.0] * 8), (202, None)]
    emb = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    got = {}
    for r in vector.topk_batch(emb, emb.where("vec_id in (3, 5, 200, 201)"), 7).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.key, r.distance))
    want = {q: [(r.vec_id, r.distance) for r in vector.topk_one(emb, emb.where(f"vec_id = {q}"), 7).collect()] for q in (3, 5)}
    assert {q: [k for k, _ in v] for q, v in got.items()} == {q: [k for k, _ in v] for q, v in want.items()}


def test_neighbours(spark):
    chunks = spark.createDataFrame([(1, i) for i in range(6)], "document int, chunk_index int")
    hits = spark.createDataFrame([(1, 1), (1, 2)], "document int, chunk_index int")
    df = retrieve.neighbours(hits, chunks, 2)
    assert sorted((r.chunk_index, r.is_hit) for r in df.collect()) == [(0, False), (1, True), (2, True), (3, False), (4, False)]
    assert "CartesianProduct" not in plan(df) and "NestedLoop" not in plan(df)


def test_pool_and_rerank(spark):
    near = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id int, doc_id int, rank int")
    words = spark.createDataFrame([(1, 12, 1), (1, 10, 2)], "query_id int, doc_id int, rank int")
    pool = retrieve.pool(near, words)
    assert sorted((r.pool_pos, r.doc_id, r.origin) for r in pool.collect()) == [(1, 10, "vector"), (2, 11, "vector"), (3, 12, "keyword")]
    scores = spark.createDataFrame([(1, 10, 0.1), (1, 11, 0.5), (1, 12, 0.5)], "query_id int, doc_id int, score double")
    assert [(r.doc_id, r.relevance_rank, r.reading_rank) for r in retrieve.rerank(pool, scores, 2).orderBy("relevance_rank").collect()] == [(11, 1, 1), (12, 2, 2)]


def test_scores(spark):
    expected = spark.createDataFrame([(1, 10), (1, 11), (2, 10)], "query_id int, doc_id int")
    ranking = spark.createDataFrame([(1, 9, 1), (1, 11, 2), (1, 10, 3)], "query_id int, doc_id int, rank int")
    asked = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    got = {r.query_id: (r.recall, r.mrr, r.hit) for r in evaluate.scores(expected, ranking, asked).collect()}
    assert got == {1: (1.0, 0.5, 1), 2: (0.0, 0.0, 0), 3: (0.0, 0.0, 0)}
    turns = spark.createDataFrame([(1, 1), (2, 1), (9, 2)], "query_id int, trace_id int")
    traced = {r.trace_id: (r.n_turns, r.turn_hits, r.all_hit) for r in evaluate.traces(evaluate.scores(expected, ranking, asked), turns).collect()}
    assert traced == {1: (2, 1, 0), 2: (0, 0, 0)}


def test_sync(spark):
    stored = spark.createDataFrame([("a", "1"), ("b", "1"), ("d", None), ("gone", "1")], "file_id string, last_modified string")
    listing = spark.createDataFrame([("a", "1"), ("b", "0"), ("c", "1"), ("d", "")], "file_id string, last_modified string")
    act = sync.actions(listing, stored)
    assert dict((r.file_id, r.action) for r in act.collect()) == {"a": "unchanged", "b": "changed", "c": "new", "d": "unchanged"}
    done = act.withColumn("error", F.when(F.col("file_id") == "c", "boom"))
    assert tuple(sync.summary(done).first()) == (4, 0, 1, 2, 1) and sync.first_errors(done).count() == 1
    assert sorted(r.file_id for r in sync.replaced(stored, listing, act).collect()) == ["a", "b", "c", "d", "gone"]


def test_chat(spark):
    conv = spark.createDataFrame([(1, "New Chat", 3), (2, "Named", 1)], "conv_id int, title string, updated_at int")
    msgs = spark.createDataFrame([(1, 0, "user", "q" * 120), (1, 1, "assistant", "a")], "conv_id int, turn int, role string, text string")
    assert {r.conv_id: len(r.title) for r in chat.auto_titles(conv, msgs).collect()} == {1: 100, 2: 5}
    assert {r.conv_id: r.n_messages for r in chat.conversation_list(conv, msgs).collect()} == {1: 2, 2: 0}
    new = spark.createDataFrame([(2, "Other", 9)], "conv_id int, new_title string, at int")
    assert {r.conv_id: (r.title, r.updated_at) for r in chat.renamed(conv, new).collect()} == {1: ("New Chat", 3), 2: ("Other", 9)}
    size = spark.createDataFrame([("x" * 20480,), ("x" * 20481,), ("é" * 10241,), (None,)], "t string")
    assert [r.m for r in size.select(chat.attachment_mode(F.col("t")).alias("m")).collect()] == ["inline", "chunked", "chunked", "inline"]


def test_prose_header(spark):
    row = spark.createDataFrame([("Guide.md", "Intro > Setup", "google_drive", "/Ops", "a@x.io", "2026-01-02T03:04:05Z", 1, 3)], "t string, s string, o string, p string, a string, m string, i int, n int")
    c = F.col
    got = row.select(chunk.prose_header(c("t"), c("s"), c("o"), c("p"), c("a"), c("m"), c("i"), c("n")).alias("h")).first().h
    assert got == "[Document: Guide.md | Section: Intro > Setup | Source: google_drive | Path: /Ops | Author: a@x.io | Modified: 2026-01-02 | Part 1 of 3]\n"
    bare = row.select(chunk.prose_header(F.lit(None), F.lit(""), F.lit("upload"), F.lit("/"), F.lit(None), F.lit(None), c("i"), c("n")).alias("h")).first().h
    assert bare == "[Part 1 of 3]\n"


def test_models(spark):
    df = spark.createDataFrame([("one two",), ("",), (None,)], "t string")
    rows = models.embedded(df, "t", models.hashing_embedder).collect()
    assert all(len(r.embedding) == 64 for r in rows) and abs(sum(x * x for x in rows[0].embedding) - 1) < 1e-6
    assert df.select(models.rerank_score(F.lit("two three"), F.col("t")).alias("s")).first().s == 0.5
    assert df.select(models.generated(F.col("t"), lambda ps: [p.upper() for p in ps]).alias("a")).first().a == "ONE TWO"
    assert df.select(models.rewrite_prompts(F.col("t"), F.lit("q")).alias("p")).where("p is null").count() == 2


def test_schema(spark):
    docs = spark.createDataFrame([("corpus", None), ("attachment", "c"), ("corpus", "c"), ("attachment", None), (None, None)], "source_type string, conversation_id string")
    assert schema.scope_violations(docs).count() == 3
    with pytest.raises(ValueError, match="3 documents"):
        schema.checked(docs)
    vec = spark.createDataFrame([([1.0, 2.0],), (None,), ([1.0],)], "embedding array<double>")
    assert schema.width_violations(vec, 2).count() == 1
    for s in (schema.DOCUMENTS, schema.CHUNKS, schema.CONVERSATIONS, schema.MESSAGES, schema.INLINE_ATTACHMENTS, schema.LISTING):
        assert spark.createDataFrame([], s).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "runbooks").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "runbooks" / "a.md").write_bytes(b"\xef\xbb\xbfbad \xff byte")
    (tmp_path / "b.tf.json").write_text("{}")
    (tmp_path / "c.zip").write_text("z")
    (tmp_path / "node_modules" / "d.md").write_text("x")
    raw = files.read_files(spark, str(tmp_path))
    taken = files.classified(files.as_text(files.supported(raw)))
    got = {r.path.rsplit("/", 1)[-1]: (r.format, r.doc_type, r.content) for r in taken.collect()}
    assert got == {"a.md": ("prose", "runbook", "bad � byte"), "b.tf.json": ("terraform", "generic", "{}")}
    assert tuple(files.skipped_count(raw).first()) == (2, 2)
    with pytest.raises(ValueError):
        files.raw_text(spark, " ")
    assert files.raw_text(spark, " x ").first().text == "x"


def test_html():
    page = "<html><head><title>A &amp; B</title><style>p{}</style></head><body><h1>Top</h1><p>One <b>two</b></p><p> </p><ul><li>item</li></ul><table><tr><th>k</th></tr><tr><td>v</td></tr></table>loose</body></html>"
    assert files.html_elements(page) == [("Title", "A & B"), ("Title", "Top"), ("NarrativeText", "One two"), ("ListItem", "item"), ("Table", "| k |\n| --- |\n| v |"), ("UncategorizedText", "loose")]


def test_html_unclosed():
    rows = "<tr><th>k</th></tr>\n<tr><td>v</td></tr>"
    table = ("Table", "| k |\n| --- |\n| v |")
    assert files.html_elements(f"<p>a</p>\n<table>{rows}\n<tr><td>last<td>cell<p>after</p>end") == [("NarrativeText", "a"), table, ("UncategorizedText", "last"), ("UncategorizedText", "cell"), ("NarrativeText", "after"), ("UncategorizedText", "end")]
    assert files.html_elements("<table><p>all text</p>") == [("NarrativeText", "all text")]
    assert files.html_elements(f"<table>{rows}<p>x</p><table>{rows}</table><p>y</p>") == [table, ("NarrativeText", "x"), table, ("NarrativeText", "y")]
    assert files.html_elements("<table><tr><td>a<td>b</table><p>c</p>") == [("Table", "a b"), ("NarrativeText", "c")]
    for tag in ("noscript", "template"):
        assert files.html_elements(f"<p>a</p><{tag}><p>b</p><script>s</script><p>c</p>") == [("NarrativeText", x) for x in "abc"]
        assert files.html_elements(f"<p>a</p><{tag}><p>b</p></{tag}><p>c</p>") == [("NarrativeText", x) for x in "ac"]


class Memory(connector.Connector):
    name = "memory"

    def authenticate(self):
        pass

    def pages(self):
        return 2

    def list_page(self, page):
        return [(f"f{page}", f"n{page}.md", "text/markdown", ["p"], "a@x", "2026")]

    def fetch(self, file_id):
        return b""


def test_listing_source(spark):
    source = connector.ListingSource({"connector": "memory"})
    connector.REGISTRY["memory"] = Memory
    reader = source.reader(source.schema())
    assert [r[0] for p in reader.partitions() for r in reader.read(p)] == ["f0", "f1"]


def test_ingest_and_store(spark, tmp_path):
    from lodestone.plans import ingest
    from lodestone.sources import store

    root = tmp_path / "in"
    (root / "runbooks").mkdir(parents=True)
    (root / "runbooks" / "a.md").write_text("Words. " * 900)
    (root / "b.py").write_text("def f():\n    return 1\n")
    (root / "list.csv").write_text("k,v\n1,a\n2,b\n")
    (root / "empty.md").write_text("")
    (root / "c.zip").write_text("z")
    documents, chunks, refused = ingest.directory(spark, str(root), "drive")
    assert sorted(r.reason for r in refused.collect()) == ["unsupported type"]  # Spark's scan leaves empty files out
    store.write_corpus(documents, chunks, str(tmp_path / "out"))
    docs, parts = store.read_corpus(spark, str(tmp_path / "out"))
    got = {r.title: (r.metadata["format"], r.metadata["doc_type"], int(r.metadata["num_elements"])) for r in docs.collect()}
    assert got == {"a.md": ("prose", "runbook", 3), "b.py": ("python", "code", 1), "list.csv": ("csv", "generic", 2)}
    assert parts.count() == 6 and parts.where("size(embedding) <> 64").count() == 0
    assert parts.where("content like '[Document: a.md | Source: drive | Part 1 of 3]%'").count() == 1
    store.write_report(docs.select("title"), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 3


def test_ingest_parses(spark, tmp_path):
    from lodestone.plans import ingest

    (tmp_path / "page.html").write_text("<html><head><title>Guide</title><script>var x;</script></head><body><h1>Setup</h1><p>One <b>two</b></p><ul><li>item</li></ul></body></html>")
    (tmp_path / "old.htm").write_bytes('<meta charset="latin-1"><p>caf\xe9</p>'.encode("latin-1"))
    (tmp_path / "notes.md").write_text("# Top\n\n## Sub ##\nBody *here*.\n\n- a\n- b\n\n```\n# no title\n```\n")
    (tmp_path / "plain.txt").write_text("first\nline\n\n\nsecond")
    (tmp_path / "mail.eml").write_text("Subject: Hello\nContent-Type: text/plain\n\nDear all\n")
    (tmp_path / "paper.PDF").write_bytes(b"%PDF-1.7\n\x00\xff\xfe binary")
    (tmp_path / "deck.pptx").write_bytes(b"PK\x03\x04\x00")
    (tmp_path / "blank.html").write_text("<script>only()</script>")
    documents, chunks, refused = ingest.directory(spark, str(tmp_path), "upload")
    got = {r.content.split("]\n", 1)[0][1:]: (r.content.split("]\n", 1)[1], r.metadata["section"], r.metadata["element_types"]) for r in chunks.collect()}
    assert got == {
        "Document: page.html | Section: Guide > Setup | Part 1 of 1": ("Guide\n\nSetup\n\nOne two\n\nitem", "Guide > Setup", "ListItem,NarrativeText,Title"),
        "Document: old.htm | Part 1 of 1": ("caf\xe9", "", "NarrativeText"),
        "Document: notes.md | Section: Top > Sub | Part 1 of 1": ("Top\n\nSub\n\nBody *here*.\n\n- a\n\n- b\n\n```\n# no title\n```", "Top > Sub", "ListItem,NarrativeText,Title,UncategorizedText"),
        "Document: plain.txt | Part 1 of 1": ("first\nline\n\nsecond", "", "NarrativeText"),
        "Document: mail.eml | Section: Hello | Part 1 of 1": ("Hello\n\nDear all", "Hello", "NarrativeText,Title"),
    }
    assert documents.count() == 5
    assert {r.path.rsplit("/", 1)[-1]: r.reason for r in refused.collect()} == {"paper.PDF": "no parser for .pdf", "deck.pptx": "no parser for .pptx", "blank.html": "no content extracted"}

    def broken(raw):
        raise OSError("no such page")

    _, chunks, refused = ingest.directory(spark, str(tmp_path), "upload", parsers={".pdf": lambda raw: [("Title", "Paper"), ("NarrativeText", raw[:8].decode())], ".pptx": broken})
    assert chunks.where("content = '[Document: paper.PDF | Section: Paper | Part 1 of 1]\nPaper\n\n%PDF-1.7'").count() == 1
    assert {r.reason for r in refused.collect()} == {"parser failed: OSError", "no content extracted"}


def test_rst_titles():
    assert files.rst_elements("====\nTop\n====\n\nSub\n---\ntext\nmore\n\n* x\n") == [("Title", "Top"), ("Title", "Sub"), ("NarrativeText", "text\nmore"), ("NarrativeText", "* x")]


def test_keyword_ranking(spark):
    import math

    from lodestone.operators import keyword

    docs = spark.createDataFrame([(1, "Pods restart. pods!", "ops"), (2, "restarting a pod", "pods"), (3, None, None), (4, "", "restart"), (None, "pods", "x")], "doc_id bigint, text string, source string")
    asked = spark.createDataFrame([(7, ["pods", "restart"]), (8, []), (9, ["absent"])], "query_id bigint, terms array<string>")
    got = {(r.query_id, r.doc_id): (r.score, r.rank) for r in keyword.ranked(docs, asked, 5, {"text": 1.0, "source": 0.4}).collect()}
    s = lambda w, n: round(w / math.log(n + 1), 6)
    assert got == {(7, 1): (s(3, 4), 1), (7, 2): (s(0.4, 4), 3), (7, 4): (s(0.4, 1), 2)}
    stems = spark.createDataFrame([(7, ["pod", "restart"])], "query_id bigint, terms array<string>")
    english = {r.doc_id: r.score for r in keyword.ranked(docs, stems, 5, {"text": 1.0}, analyser=keyword.stemming).collect()}
    assert english == {1: s(3, 3), 2: s(2, 2)}
    assert keyword.ranked(docs, asked.where("false"), 5, {"text": 1.0}).count() == 0
    assert docs.select(keyword.or_query(F.lit("What's the CPU limit, cpu?")).alias("q")).first().q == "what | the | cpu | limit"
    assert docs.select(keyword.or_query(F.lit("a ? !")).alias("q")).first().q == ""


def test_scope(spark):
    rows = spark.createDataFrame([("corpus", None, True), ("attachment", 1, True), ("attachment", 2, False), ("attachment", None, False)], "t string, c int, want boolean")
    assert rows.where(F.coalesce(retrieve.in_scope(F.col("t"), F.col("c"), F.lit(1)), F.lit(False)) != F.col("want")).count() == 0


def test_answers(spark):
    from lodestone.plans import answer
    from lodestone.plans.queries import echo

    chunks = spark.createDataFrame(
        [
            (1, 0, "Guide", "", 2, "pods restart when probes fail", [1.0, 0.0], "corpus", None),
            (1, 1, "Guide", "", 2, "nothing here", [0.0, 1.0], "corpus", None),
            (2, 0, "Note", "", 1, "pods restart at night", [0.9, 0.1], "attachment", 7),
            (3, 0, "Other", "", 1, "pods restart elsewhere", [0.9, 0.1], "attachment", 8),
        ],
        "doc_id bigint, chunk_index int, title string, section string, total int, content string, embedding array<double>, source_type string, conversation_id bigint",
    )
    asked = spark.createDataFrame([(1, "why do pods restart", 7, [1.0, 0.0]), (2, "and at night?", 9, [0.0, 1.0])], "query_id bigint, question string, conv_id bigint, embedding array<double>")
    said = spark.createDataFrame([(9, 0, "user", "tell me about pods"), (9, 1, "assistant", "they run")], "conv_id bigint, turn int, role string, text string")
    inline = spark.createDataFrame([(7, "a.txt", "attached words")], "conv_id bigint, filename string, text string")
    got = {r.query_id: r for r in answer.answers(asked, chunks, said, echo, inline=inline).collect()}
    assert got[1].rewritten == "why do pods restart" and got[1].answer == "why do pods restart"
    assert {(s.doc_id, s.chunk_index) for s in got[1].sources} == {(1, 0), (1, 1), (2, 0)}  # not the other conversation's
    assert got[1].context.startswith('From user-attached file "a.txt":\nattached words\n---\n\nFrom "Guide":\n  [Part 1 of 2]\n')
    assert got[2].rewritten == "and at night?" and got[2].prompt.startswith("Previous conversation:\nUser: tell me about pods\n\nAssistant: they run\n---\n")
    assert {s.doc_id for s in got[2].sources} == {1}


def test_answers_expand_hits_and_embed_what_was_rewritten(spark):
    import dataclasses

    from lodestone.config import DEFAULTS
    from lodestone.plans import answer

    texts = ["alpha beta", "gamma delta", "zeta eta", "theta iota", "kappa"]
    chunks = spark.createDataFrame([(1, i, "T", "", 5, t, None, "corpus", None) for i, t in enumerate(texts)], "doc_id bigint, chunk_index int, title string, section string, total int, content string, embedding array<float>, source_type string, conversation_id bigint")
    chunks = models.embedded(chunks.drop("embedding"), "content", models.hashing_embedder)
    asked = spark.createDataFrame([(1, "and that?", 9, [0.0])], "query_id bigint, question string, conv_id bigint, embedding array<double>")
    said = spark.createDataFrame([(9, 0, "user", "tell me of theta")], "conv_id bigint, turn int, role string, text string")
    def model(prompts):
        return ["zeta eta" if p.startswith("Conversation history") else "done" for p in prompts]

    one = dataclasses.replace(DEFAULTS, top_k=1)
    got = answer.answers(asked, chunks, said, model, settings=one, embedder=models.hashing_embedder).first()
    assert got.rewritten == "zeta eta" and [s.chunk_index for s in got.sources] == [2]
    got = answer.answers(asked, chunks, said, model, settings=dataclasses.replace(one, neighbor_window=1), embedder=models.hashing_embedder).first()
    assert [s.chunk_index for s in got.sources] == [1, 2, 3]
    assert got.context == "From \"T\":\n" + "".join(f"  [Part {i + 1} of 5]\n  {texts[i]}\n" for i in (1, 2, 3))


def test_chunks_keep_their_keys(spark):
    rows = spark.createDataFrame([(2**53 + 1, "a b"), (None, "c"), (3, None)], "doc_id bigint, text string").coalesce(1)
    assert sorted(map(str, (tuple(r) for r in chunk.prose_chunks(rows).collect()))) == sorted(map(str, [(2**53 + 1, 0, 1, "a b"), (None, 0, 1, "c")]))


def test_listings_of_known_results(spark):
    from lodestone.plans import samples

    rows = spark.createDataFrame(samples.PERMISSIONS, "file_id string, permissions array<struct<type:string,emailAddress:string,displayName:string>>")
    got = rows.select("file_id", F.array_join(cl.flat_permissions(F.col("permissions")), ",").alias("p")).collect()
    assert {r.file_id: r.p for r in got} == samples.PERMISSIONS_GOT
    names = F.create_map(*[F.lit(x) for kv in samples.FOLDER_NAMES.items() for x in kv])
    rows = spark.createDataFrame(samples.PARENTS, "file_id string, parents array<string>")
    assert {r.file_id: r.p for r in rows.select("file_id", cl.folder_path(F.col("parents"), names).alias("p")).collect()} == samples.FOLDERS_GOT
    rows = spark.createDataFrame(samples.LISTING, "file_id string, name string, mime_type string")
    assert sorted(map(tuple, connector.eligible(rows).collect())) == samples.LISTING_GOT


def test_ranks_go_by_more_than_is_shown(spark):
    rows = spark.createDataFrame([(1, [1.0, 2e-4]), (2, [1.0, 1e-4]), (3, None), (4, [0.0, 0.0]), (5, [1.0])], "vec_id bigint, embedding array<double>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "vec_id bigint, embedding array<double>")
    assert [r.vec_id for r in vector.topk_one(rows, q, 2).collect()] == [2, 1]
    assert [r.key for r in vector.topk_batch(rows, q, 2).orderBy("rank").collect()] == [2, 1]


def test_meeting_blocks_equal_one_block(spark):
    emb = spark.read.parquet(f"{SF}/embeddings.parquet")
    q = emb.where("vec_id % 20 = 0")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(vector.topk_batch(emb, q, 7)) == rows(vector.topk_batch(emb, q, 7, block_bytes=600, row_bytes=5000))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    asked = docs.where("doc_id % 40 = 0").select(F.col("doc_id").alias("query_id"), F.slice(F.array_distinct(keyword.tokens(F.col("text"))), 1, 6).alias("terms"))
    one = rows(keyword.ranked(docs, asked, 5, {"text": 1.0}))
    assert one == rows(keyword.ranked(docs, asked, 5, {"text": 1.0}, block_questions=2, row_bytes=50_000)) and one


def test_answer_questions_over_all_documents(spark):
    import hashlib
    import math
    import re

    from lodestone.config import DEFAULTS
    from lodestone.functions.context import context_block
    from lodestone.operators.models import overlap_reranker
    from lodestone.plans import queries
    from lodestone.plans import relations as rel

    sf = SF_CORRECT
    docs = rel.documents(spark, sf).withColumn("place", F.xxhash64("doc_id", F.lit(0))).collect()
    vec = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    words = {x.doc_id: re.findall("[a-z0-9]+", (x.text or "").lower()) for x in docs}
    named = {x.doc_id: re.findall("[a-z0-9]+", x.title) for x in docs}
    got = {r.query_id: r for r in queries.answer_questions(spark, sf).collect()}
    want, blind = {}, 0
    for q in rel.vector_questions(spark, sf).collect():
        seen = [x for x in docs if x.source_type == "corpus" or x.conversation_id == q.query_id]
        a = np.array(q.embedding, float)
        far = lambda x: round(1 - float(a @ vec[x.doc_id]) / np.linalg.norm(a) / np.linalg.norm(vec[x.doc_id]), 12)  # noqa: B023, E731
        near = sorted((x for x in seen if x.doc_id in vec and np.linalg.norm(vec[x.doc_id]) > 0), key=lambda x: (far(x), x.place))[: DEFAULTS.vector_candidates]
        asked = got[q.query_id].rewritten  # a follow-up is retrieved as it was rewritten
        terms = {w for w in re.findall("[a-z0-9]+", asked.lower()) if len(w) >= 2}

        def score(x):
            n = len(words[x.doc_id]) + len(named[x.doc_id])
            return round((sum(w in terms for w in words[x.doc_id]) + 0.2 * sum(w in terms for w in named[x.doc_id])) / math.log(n + 1), 12)  # noqa: B023

        found = sorted((x for x in seen if score(x) > 0), key=lambda x: (-score(x), x.place))[: DEFAULTS.keyword_candidates]
        pool = list({x.doc_id: x for x in [*near, *found]}.values())
        value = overlap_reranker([asked] * len(pool), [x.text or "" for x in pool])
        top = [pool[i] for i in sorted(range(len(pool)), key=lambda i: (-value[i], i))[: DEFAULTS.top_k]]  # noqa: B023
        blind += sum(x.doc_id not in vec for x in top)
        text = context_block([{"document_id": x.doc_id, "title": x.title, "section": "", "position": 1, "total": 1, "content": x.text} for x in sorted(top, key=lambda x: x.doc_id)], limit=DEFAULTS.max_context_chars)
        want[q.query_id] = (len(top), hashlib.sha256(text.encode()).hexdigest())
    assert blind > 0
    assert {k: (r.n_sources, r.context_sha256) for k, r in got.items()} == want


def test_refusals_go_by_the_answer(spark):
    scored = spark.createDataFrame([(1, 0.0, 0.0, 0), (2, 1.0, 0.5, 1), (3, 0.5, 1.0, 1), (4, 0.0, 0.0, 0), (5, 1.0, 1.0, 1)], "query_id bigint, recall double, mrr double, hit int")
    asked = spark.createDataFrame([(1, "refusal", "I could not find this information in the available documents."), (2, "refusal", "The port is 8080."), (3, "runbook", None), (4, "refusal", None)], "query_id bigint, category string, answer string")
    got = {r.query_id: (r.recall, r.mrr, r.hit) for r in evaluate.with_refusals(scored, asked).collect()}
    assert got == {1: (1.0, 1.0, 1), 2: (0.0, 0.0, 0), 3: (0.5, 1.0, 1), 4: (0.0, 0.0, 0), 5: (1.0, 1.0, 1)}
    assert evaluate.with_refusals(scored.limit(0), asked).schema.names == scored.columns


def test_a_changed_file_leaves_its_neighbours(spark, tmp_path):
    root = str(tmp_path / "corpus")
    docs = lambda *rows: spark.createDataFrame([(i, s, t, "corpus", None) for i, s, t in rows], "id string, source string, title string, source_type string, conversation_id string")
    parts = lambda *rows: spark.createDataFrame(list(rows), "document_id string, chunk_index int, content string")
    store.upsert_corpus(docs(("a", "01", "A"), ("b", "01", "B"), ("c", "two", "C"), ("n", None, "N")), parts(("a", 0, "a0"), ("a", 1, "a1"), ("b", 0, "b0"), ("c", 0, "c0"), ("n", 0, "n0")), root)
    store.upsert_corpus(docs(("a", "01", "A2"), ("d", "01", "D"), ("m", None, "M")), parts(("a", 0, "new"), ("d", 0, "d0"), ("m", 0, "m0")), root)
    store.upsert_corpus(docs(), parts(), root)
    got = spark.read.schema("id string, title string, source string").parquet(root + "/documents")
    assert {(r.id, r.title, r.source) for r in got.collect()} == {("a", "A2", "01"), ("b", "B", "01"), ("d", "D", "01"), ("c", "C", "two"), ("n", "N", None), ("m", "M", None)}
    _, kept = store.read_corpus(spark, root)
    assert sorted((r.document_id, r.chunk_index, r.content) for r in kept.collect()) == [("a", 0, "new"), ("b", 0, "b0"), ("c", 0, "c0"), ("d", 0, "d0"), ("m", 0, "m0"), ("n", 0, "n0")]


def test_a_tile_is_small_however_many_queries_a_block_has():
    import tracemalloc

    import pyarrow as pa

    rnd = np.random.default_rng(2)
    q, x = rnd.normal(size=(5000, 8)), rnd.normal(size=(4096, 8))
    asked = pa.table({"query": pa.array(range(len(q)), pa.int64()), "vector": pa.array(list(q), pa.list_(pa.float64())), "conv": pa.nulls(len(q), pa.int64())})
    block = vector.Nearest(asked, 25, False)
    batch = pa.record_batch({"key": pa.array(range(len(x)), pa.int64()), "vector": pa.array(list(x), pa.list_(pa.float64()))})
    tracemalloc.start()
    block.meet(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 128 << 20
    got = block.found().to_pandas()
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    want = np.sort(np.argsort(np.round(1 - unit(q) @ unit(x).T, 12), axis=1, kind="stable")[:, :25], axis=1)
    assert np.array_equal(np.array(got.sort_values(["query_id", "key"]).key).reshape(-1, 25), want)


def test_tiles_of_any_size_find_the_same(monkeypatch):
    import pyarrow as pa

    rnd = np.random.default_rng(4)
    v = rnd.integers(-2, 3, (300, 3)).astype(float)  # many ties, some zero
    kinds, own = rnd.choice(["corpus", "attachment", "other"], 300).tolist(), rnd.integers(0, 3, 300).tolist()
    asked = pa.table({"query": pa.array(range(20), pa.int64()), "vector": pa.array(list(rnd.normal(size=(20, 3)).round() + 0.5), pa.list_(pa.float64())), "conv": pa.array(rnd.integers(0, 3, 20), pa.int64())})
    batch = pa.record_batch({"key": pa.array(rnd.permutation(300), pa.int64()), "vector": pa.array(list(v), pa.list_(pa.float64())), "kind": kinds, "own": pa.array(own, pa.int64())})
    for scoped in (False, True):
        seen = set()
        for rows, size in ((4096, 8 << 20), (7, 8 << 20), (50, 900), (1, 8)):
            monkeypatch.setattr(vector, "TILE_ROWS", rows)
            monkeypatch.setattr(vector, "TILE_BYTES", size)
            block = vector.Nearest(asked, 9, scoped)
            block.meet(batch)
            seen.add(tuple(sorted(zip(*(c.to_pylist() for c in block.found().columns), strict=True))))
        assert len(seen) == 1 and len(seen.pop()) == 180
