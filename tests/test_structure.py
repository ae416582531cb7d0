import yaml

from lodestone.functions import scan, structure
from lodestone.plans import samples as s


def names(grammar, text):
    return [(x.kind, x.name, text[x.start : x.end]) for x in scan.spans(grammar, text)]


def test_python():
    got = names("python", s.PYTHON)
    assert [n for _, n, _ in got] == ["f", None, "C"]
    assert got[1][2].startswith("@cache\ndef g") and got[2][2].endswith("pass")


def test_go():
    got = names("go", s.GO)
    assert [n for _, n, _ in got] == [None, "Name", "main"]
    assert got[1][2].endswith('return "}"\n}') and got[0][2].startswith("type T struct") and got[0][2].endswith("}")


def test_ruby():
    got = names("ruby", s.RUBY)
    assert [n for _, n, _ in got] == ["A", "c"]
    assert all(t.endswith("end") for _, _, t in got) and got[0][2].count("end") == 3


def test_scripts():
    assert [n for _, n, _ in names("javascript", s.JAVASCRIPT)] == ["f", "K", None]
    assert [n for _, n, _ in names("typescript", s.TYPESCRIPT)] == ["I", "T", "f"]
    assert [n for _, n, _ in names("bash", s.BASH)] == ["build", "deploy"]
    assert [t.split("\n")[0] for _, _, t in names("dockerfile", s.DOCKERFILE)] == ["FROM golang AS build", "FROM scratch"]


def test_hcl():
    text = "".join(x for _, x, _ in s.HCL)
    assert [(k, n) for k, n, _ in names("hcl", text)] == [("resource", "aws_eks_cluster"), ("module", "net"), ("locals", None), ("variable", "x")]
    heredoc = 'resource "a" "b" {\n  x = <<EOT\n}\nEOT\n  y = 1\n}\n'
    span = scan.spans("hcl", heredoc)[0]
    assert span.features["attributes"] == ["x", "y"] and heredoc[span.start : span.end] == heredoc.strip()


def test_puppet_and_json():
    text = "".join(x for _, x, _ in s.PUPPET)
    assert [t.split()[0] for _, _, t in names("puppet", text)] == ["class", "package", "node"]
    assert [n for _, n, _ in names("tfjson", s.TF_JSON)] == ["resource", "output"]
    assert names("json", ' {"a": "}"} ') == [(None, None, '{"a": "}"}')]


def test_every_sample_has_chunks():
    for path, content in s.FILES:
        name = path.split("/")[-1]
        fmt = {"go": "go", "py": "python", "rb": "ruby", "js": "javascript", "ts": "typescript", "sh": "bash", "tf": "terraform", "json": "json", "tfvars": "terraform", "yaml": "yaml", "pp": "puppet", "Dockerfile": "dockerfile"}.get(name.split(".")[-1])
        fmt = "terraform" if name.endswith(".tf.json") else fmt
        if fmt is None:
            continue
        chunks = structure.chunk_structured(content, fmt, name, {"source": "upload"})
        assert chunks, path
        assert [c.position for c in chunks] == list(range(1, len(chunks) + 1))
        for c in chunks:
            first, second = c.text.split("\n")[:2]
            assert first.startswith(f"[File: {name}") and first.endswith(f"Part {c.position} of {len(chunks)}]") and second.endswith(".")
            if fmt == "yaml":
                list(yaml.safe_load_all(c.text.split("\n\n", 1)[1]))


def test_fallbacks_never_drop_a_file():
    for fmt, name, text in (("python", "x.py", "def f(:\n"), ("terraform", "p.tfvars", 'region = "eu"\n'), ("json", "x.json", "5"), ("unknown", "x.q", "text")):
        (c,) = structure.chunk_structured(text, fmt, name)
        assert c.element_type == "fallback_char_split" and c.fallback_reason and "(structural parse unavailable)." in c.text
    assert structure.chunk_structured("  \n", "python", "x.py") == []


def test_oversize_yaml_keeps_comments_and_context():
    chunks = structure.chunk_structured(s.HELM, "yaml", "values.yaml", {"doc_type": "helm_values"}, size=1500)
    bodies = [c.text.split("\n\n", 1)[1] for c in chunks]
    assert len(chunks) > 1 and all(b.startswith("global:\n  domain: example.com\n---\n") for b in bodies)
    assert sum(b.count("# kept note") for b in bodies) == 6
    assert {f"s{i}" for i in range(6)} == {k for b in bodies for d in yaml.safe_load_all(b) for k in d if k.startswith("s")}


def test_oversize_json_is_json():
    chunks = structure.chunk_structured(s.RECORDS, "json", "hosts.json", size=500)
    assert len(chunks) == 60 and all("JSON object with keys: records." in c.text for c in chunks)


def test_oversize_code_is_cut_between_statements():
    body = "".join(f"\tstep{i}(arg)\n" for i in range(300))
    chunks = structure.chunk_structured("func big() {\n" + body + "}\n", "go", "m.go", size=1000)
    assert len(chunks) > 3 and all(len(c.text.split("\n\n", 1)[1]) <= 1000 for c in chunks)
    assert sum(c.text.count("step") for c in chunks) == 300
    assert chunks[0].name == f"big [part 1/{len(chunks)}]"


def test_equal_spans_stay():
    a, b, c = scan.Span(0, 9), scan.Span(0, 9), scan.Span(2, 5)
    assert scan.outermost([c, a, b]) == [a, b]
