import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.functions import context, headers, jsonparts, split, structure
from lodestone.plans import samples

TEXT = st.text(alphabet="ab \n", max_size=300)


@pytest.mark.parametrize(
    ("text", "size", "overlap", "want"),
    [
        ("aaaa bbbb cccc", 9, 3, ["aaaa bbbb", "bbbb cccc"]),
        ("abcdefghij", 4, 1, ["abcd", "defg", "ghij"]),
        ("aa\n\nbbbbbbbb", 5, 2, ["aa", "bbbbb", "bbbbb"]),
        ("p1 alpha\n\np2 beta gamma\n\np3 delta", 20, 6, ["p1 alpha", "alpha\n\np2 beta gamma", "beta gamma\n\np3 delta"]),
        ("  hi  ", 10, 2, ["hi"]),
        ("   ", 10, 2, []),
    ],
)
def test_split_goldens(text, size, overlap, want):
    assert split.split_text(text, size, overlap) == want


@settings(max_examples=300, deadline=None)
@given(TEXT, st.integers(3, 40), st.integers(0, 5))
def test_split_properties(text, size, overlap):
    chunks = split.split_text(text, size, overlap)
    assert all(c and len(c) <= size for c in chunks)
    assert chunks == split.split_text(text, size, overlap)
    words = text.split()
    if all(len(w) <= size for w in words):
        assert set(words) <= {w for c in chunks for w in c.split()}


def test_section():
    titles = frozenset({"Intro", "Setup"})
    assert split.section_of("Intro\n\n Setup \nbody\nIntro", titles) == "Intro > Setup"
    assert split.section_of("body\nIntro", titles) == "" == split.section_of("Intro", frozenset())


@pytest.mark.parametrize("rows", [samples.YAML])
def test_yaml_goldens(rows):
    for name, text, want in rows:
        assert headers.header("yaml", text, name.split(":")[0] if ":" in name else None) == want


@pytest.mark.parametrize(("fmt", "name", "rows"), [("terraform", "main.tf", samples.HCL), ("puppet", "site.pp", samples.PUPPET)])
def test_capture_goldens(fmt, name, rows):
    for _, text, want in rows:
        assert structure.chunk_structured(text, fmt, name)[0].text.split("\n")[1] == want


@pytest.mark.parametrize(
    ("fmt", "text", "want"),
    [
        ("json", '{"k": 87}', "JSON object with keys: k."),
        ("json", "[1, 2]", "JSON array with 2 element(s)."),
        ("json", "5", "JSON scalar value."),
        ("json", "{}", "JSON object with keys: ."),
        ("terraform", '"resource": {"aws_eks_cluster": {"main": {"name": "x"}}}', "Terraform configuration fragment with keys: resource."),
        ("terraform", '{"resource": {"aws_eks_cluster": {"main": {"name": "x"}}}}', 'Terraform resource aws_eks_cluster "main". Attributes: name.'),
        ("terraform", '{"module": 3}', "Terraform module block."),
        ("python", "def f(): return 1", "Python configuration fragment."),
    ],
)
def test_header_goldens(fmt, text, want):
    assert headers.header(fmt, text) == want


def test_many_attributes():
    names = [f"a{i}" for i in range(17)]
    assert headers.hcl_header("data", "x", names).endswith(", a14 and 2 other attributes.")
    assert headers.puppet_header("class", "c", names, includes=["i"]).startswith('Puppet class "c" with parameters: a0')


JSON = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=30), lambda x: st.lists(x, max_size=6) | st.dictionaries(st.text(max_size=6), x, max_size=6), max_leaves=40)


def leaves(x):
    if isinstance(x, dict):
        return sorted((l for v in x.values() for l in leaves(v)), key=repr)
    if isinstance(x, list):
        return sorted((l for v in x for l in leaves(v)), key=repr)
    return [x]


@settings(max_examples=200, deadline=None)
@given(JSON, st.integers(20, 300))
def test_json_parts_lose_nothing(value, budget):
    parts = jsonparts.partition(value, budget)
    assert sorted((l for p in parts for l in leaves(p)), key=repr) == leaves(value)
    assert all(json.loads(json.dumps(p)) == p for p in parts)


def test_json_list_of_records():
    records = [{"id": i, "name": "n" * 20} for i in range(85)]
    assert [len(p) for p in jsonparts.partition(records, 500)] == [1] * 85
    assert len(jsonparts.partition({"records": records}, 500)) == 85
    assert max(len(p) for p in jsonparts.partition(list(range(1000)), 300)) > 10
    assert jsonparts.split_json('"k": {"a": 1},', 400) == ['{\n  "k": {\n    "a": 1\n  }\n}']
    assert jsonparts.split_json("{", 10) is None


def rows(*lengths, doc="d", title="T"):
    return [{"document_id": doc, "title": title, "section": "", "position": i + 1, "total": len(lengths), "content": "x" * n} for i, n in enumerate(lengths)]


def test_context_label_and_titles():
    assert context.context_block([{"document_id": 1, "title": "T", "section": "", "position": 1, "total": 2, "content": "hello"}]) == 'From "T":\n  [Part 1 of 2]\n  hello\n'
    assert context.context_block([{"document_id": 1, "title": None, "section": "S", "content": "c"}]) == 'From "Unknown Document":\n  [S]\n  c\n'
    assert context.context_block([]) == "" and context.chunk_label("", None, None) == "  [Chunk]"


def test_context_cap_counts_the_first_document_twice():
    n = 15_000 - len("  [Part 1 of 2]\n  \n")
    assert context.context_block(rows(n, n)).count("[Part") == 1
    assert context.context_block(rows(n, n), strict_cap=True).count("[Part") == 2
    assert context.context_block(rows(n, n), [{"filename": "f", "text": "t"}]).count("[Part") == 2
    both = context.context_block(rows(39_900) + rows(10, doc="e", title="E"))
    assert both.count("From") == 2  # a title whose chunk does not fit stays


def test_history_and_prompts():
    h = context.history_block([("user", "q"), ("assistant", "a")])
    assert h == "Previous conversation:\nUser: q\n\nAssistant: a" and context.history_block([]) == ""
    assert context.answer_prompt("Q", "", "").endswith("Answer from your general knowledge:")
    assert context.answer_prompt("Q", "C", h).startswith(h + "\n---\n\nContext from company documents:\n\nC\n---\n\nQuestion: Q")


def test_csv():
    got = structure.csv_rows('﻿id,name,note\n1,"a\nb",\n,,\n2,"c|d"\n3,x,y,surplus\n', "c.csv", {"source": "upload"})
    assert got == [(0, 3, "[File: c.csv]\nid: 1 | name: a b"), (1, 3, "[File: c.csv]\nid: 2 | name: c|d"), (2, 3, "[File: c.csv]\nid: 3 | name: x | note: y")]
    assert structure.csv_rows("a,b,a\n1,2,3\n", "c.csv")[0][2].endswith("a: 3 | b: 2") and structure.csv_rows("", "c.csv") == []
    assert structure.bracket("f", {"source": "drive", "folder_path": "/Ops"}) == "[File: f | Source: drive | Path: /Ops]\n"


def test_tables():
    for _, html, want in samples.TABLES:
        assert structure.table_markdown(html) == want


def test_yaml_is_read_fast_and_as_the_plain_parser_reads_it(monkeypatch):
    import random
    import time

    import yaml

    def read(f, text):
        try:
            return repr(list(f(text)))
        except Exception:
            return None

    rnd = random.Random(5)
    tokens = ["a", ": ", "- ", "\n", "\n  ", "'", '"', "#", " #", "1.5", "~", "---\n", "...\n", "é", "<<", "[", "]", "{", "}", ", ", "&a ", "*a", "!", "!!str ", "|", ">", "|-\n", "%YAML 1.2\n", "@", "? ", "\t", "\r\n", "\x85", "﻿", "\x01", "k: v\n"]
    odd = ["日\t: 1", "a: |#", "'!': !", "﻿﻿", "[" * 5000, "- " * 5000, "? " * 3000]
    for text in odd + ["".join(rnd.choices(tokens, k=rnd.randint(1, 14))) for _ in range(3000)]:
        assert read(headers.yaml_documents, text) == read(yaml.safe_load_all, text), text

    texts = [f"apiVersion: v1\nkind: ConfigMap\nmetadata:\n  name: c{i}\ndata:\n  name: 'x'\n" for i in range(300)]
    start = time.process_time()
    plain = [list(yaml.safe_load_all(t)) for t in texts]
    middle = time.process_time()
    assert [headers.yaml_documents(t) for t in texts] == plain
    assert not yaml.__with_libyaml__ or time.process_time() - middle < (middle - start) / 2
    monkeypatch.setattr(headers, "FAST", None)
    assert [headers.yaml_documents(t) for t in texts] == plain
