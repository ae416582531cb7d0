import importlib.util
from pathlib import Path

import pytest
from helpers import SF, SF_CORRECT, canonical

import __spark_entry__ as entry
from lodestone.plans import queries as q


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_oracle(spark, duck, name):
    assert canonical(q.QUERIES[name](spark, SF_CORRECT).toPandas()) == canonical(duck.sql(q.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.ORACLES)))
def test_rows(spark, name):
    assert q.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "doc_id", "score", "relevance_rank", "reading_rank"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_corpus_operators():
    root = Path(importlib.util.find_spec("lodestone").origin).parent
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "llm" not in f.read_text(), f


def test_splitter_on_whole_table(spark):
    df = q.recursive_split(spark, SF_CORRECT).toPandas()
    assert len(df) == 1428 and df.content.str.len().max() == 3000 and (df.groupby("doc_id").size() > 1).sum() == 218


def test_context_blocks_match_a_plain_fold(spark):
    from lodestone.functions.context import context_block
    from lodestone.plans import relations as r

    hits = {}
    for row in q.hybrid_rerank(spark, SF).collect():
        hits.setdefault(row.query_id, []).append(row.doc_id)
    lines = {}
    for row in r.line_chunks(spark, SF).orderBy("doc_id", "chunk_index").collect():
        lines.setdefault(row.doc_id, []).append(dict(document_id=row.doc_id, title=f"doc-{row.doc_id}", section="", position=row.chunk_index + 1, total=row.total, content=row.content))
    import hashlib

    got = {row.query_id: (row.n_chars, row.context_sha256) for row in q.context_block(spark, SF).collect()}
    plain = {k: context_block([c for d in sorted(ds) for c in lines.get(d, [])]) for k, ds in hits.items()}
    assert got == {k: (len(t), hashlib.sha256(t.encode()).hexdigest()) for k, t in plain.items()}


def test_context_cap_in_the_jvm_and_in_python_agree(spark):
    import random
    from dataclasses import replace

    from lodestone.config import DEFAULTS
    from lodestone.functions.context import context_block
    from lodestone.operators.context import context_blocks

    rnd = random.Random(8)
    rows, files = [], []
    for k in range(60):
        for d in range(rnd.randint(1, 4)):
            rows += [(k, d, rnd.choice([None, "T", "é"]) if p == 1 else "U", rnd.choice(["", "S"]), p, 9, "x" * rnd.choice([0, 5, 40, 120])) for p in range(1, rnd.randint(2, 7))]
        files += [(k, f"f{i}", "text") for i in range(rnd.choice([0, 0, 1, 2]))]
    files.append((99, "only", "a file"))
    hits = spark.createDataFrame(rows, "query_id bigint, document_id bigint, title string, section string, position int, total int, content string").repartition(3)
    inline = spark.createDataFrame(files, "query_id bigint, filename string, text string")
    names = hits.columns
    for strict in (False, True):
        for attached in (None, inline):
            got = {r.query_id: r.context for r in context_blocks(hits, attached, replace(DEFAULTS, max_context_chars=200), strict).collect()}
            for k, text in got.items():
                own = [dict(zip(names, r, strict=True)) for r in rows if r[0] == k]
                with_files = [{"filename": f, "text": t} for i, f, t in files if i == k] if attached is not None else []
                assert text == context_block(own, with_files, 200, strict)
            assert (99 in got) == (attached is not None)


def test_words_that_cancel_and_odd_spaces_still_have_vectors(spark, tmp_path):
    import duckdb

    texts = ["queas íar", "Ungchau dieverbepf rend*** to%%%", "rend*** to%%%", "\x0b", "\xa0", "\x1c\x1f", " 　\n", "a b", "\t\n\f\r ", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert canonical(q.embed_documents(spark, str(tmp_path)).toPandas()) == canonical(con.sql(q.ORACLES["embed_documents"]).df())


@pytest.mark.parametrize("name", ["yaml_header", "hcl_header", "puppet_header"])
def test_rows_of_one_small_file_are_spread_over_all_cores(spark, name):
    assert q.QUERIES[name](spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
