"""Finding the parts of structured files: a scanner for each language over plain text.

A scanner yields ``Span(start, end, kind, name)``; what lies outside is not part of any chunk. The
shared walker knows strings, comments and nesting; Python has its own parser, YAML its marks.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import yaml


@dataclass
class Span:
    start: int
    end: int
    kind: str | None = None
    name: str | None = None
    features: dict[str, Any] = field(default_factory=dict)


QUOTES = {"c": "\"'`", "hcl": '"', "puppet": "\"'", "bash": "\"'"}
LINE_COMMENT = {"c": ("//",), "hcl": ("#", "//"), "puppet": ("#",), "bash": ("#",)}
BLOCK_COMMENT = {"c", "hcl"}
OPEN, CLOSE = "{[(", "}])"


def plain(text: str, style: str) -> str:
    """``text`` with every character of strings and comments turned to blanks, line ends kept."""
    out = list(text)
    i, n = 0, len(text)

    def blank(a: int, b: int) -> None:
        for k in range(a, min(b, n)):
            if out[k] != "\n":
                out[k] = " "

    while i < n:
        c = text[i]
        if style in BLOCK_COMMENT and text.startswith("/*", i):
            j = text.find("*/", i + 2)
            j = n if j < 0 else j + 2
        elif any(text.startswith(m, i) for m in LINE_COMMENT[style]) and (style != "bash" or i == 0 or text[i - 1] in " \t\n;"):
            j = text.find("\n", i)
            j = n if j < 0 else j
        elif style == "hcl" and (m := re.compile(r"<<[-~]?(\w+)[^\n]*\n").match(text, i)):
            stop = re.compile(rf"^[ \t]*{re.escape(m[1])}[ \t]*$", re.MULTILINE).search(text, m.end())
            j = stop.end() if stop else n
        elif c in QUOTES[style]:
            j = i + 1
            while j < n and text[j] != c:
                if c != "`" and text[j] == "\n" and style == "c":
                    break
                j += 2 if text[j] == "\\" and not (style == "bash" and c == "'") else 1
            j += 1
        else:
            i += 1
            continue
        blank(i, j)
        i = j
    return "".join(out)


def closing(flat: str, at: int) -> int:
    """Index just after the bracket that closes the one at ``at``; the end of the text if none does."""
    depth = 0
    for i in range(at, len(flat)):
        depth += (flat[i] in OPEN) - (flat[i] in CLOSE)
        if not depth:
            return i + 1
    return len(flat)


def outermost(spans: list[Span]) -> list[Span]:
    """Spans that lie in no other; of spans with equal ends none lies in another."""
    out: list[Span] = []
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if not out or s.end > out[-1].end or (s.start, s.end) == (out[-1].start, out[-1].end):
            out.append(s)
    return out


def _python(text: str) -> list[Span]:
    lines = [0]
    for m in re.finditer(r"\n", text):
        lines.append(m.end())
    raw = text.encode()
    heads = [0]
    for m in re.finditer(rb"\n", raw):
        heads.append(m.end())

    def offset(line: int, col: int) -> int:
        return lines[line - 1] + len(raw[heads[line - 1] : heads[line - 1] + col].decode(errors="replace"))

    def nodes(body: list[ast.stmt]) -> Iterator[ast.stmt]:
        for n in body:
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                yield n
            else:
                for inner in ("body", "orelse", "finalbody", "handlers"):
                    for x in getattr(n, inner, []) or []:
                        yield from nodes([x] if isinstance(x, ast.stmt) else x.body)

    out = []
    for n in nodes(ast.parse(text).body):
        if n.decorator_list:
            first = min(n.decorator_list, key=lambda d: (d.lineno, d.col_offset))
            start, name = text.rindex("@", 0, offset(first.lineno, first.col_offset) + 1), None
        else:
            start, name = offset(n.lineno, n.col_offset), n.name
        out.append(Span(start, offset(n.end_lineno, n.end_col_offset), None, name))
    return out


def _braced(pattern: str, style: str = "c", named: bool = True) -> Callable[[str], list[Span]]:
    """Declarations that ``pattern`` (with an optional group ``name``) begins at a line's start and a
    bracketed body, or the line's end, closes."""
    rx = re.compile(pattern, re.MULTILINE)

    def scan(text: str) -> list[Span]:
        flat = plain(text, style)
        out: list[Span] = []
        for m in rx.finditer(flat):
            start = m.start("decl")
            if out and start < out[-1].end:
                continue
            end = m.end()
            depth = 0
            for i in range(m.end("decl"), len(flat)):
                c = flat[i]
                if c in OPEN:
                    depth += 1
                elif c in CLOSE:
                    depth -= 1
                    if depth <= 0 and c == "}":
                        end = i + 1
                        break
                elif depth == 0 and (c == ";" or c == "\n" and flat[m.end("decl") : i].strip() and not flat[m.end("decl") : i].rstrip().endswith((",", "=", "|", "&", "=>"))):
                    end = i + (c == ";")
                    break
            else:
                end = len(flat)
            out.append(Span(start, end, None, m.groupdict().get("name") if named else None))
        return out

    return scan


_go = _braced(r"^(?P<decl>func\s+(?:\([^)]*\)\s*)?(?P<name>\w+)|type\b(?P<t>))")
_js = _braced(r"^[ \t]*(?:export\s+(?:default\s+)?)?(?P<decl>(?:async\s+)?function\s*\*?\s*(?P<name>[\w$]+)|class\s+(?P<cname>[\w$]+)|(?:const|let)\b)")
_ts = _braced(r"^[ \t]*(?:export\s+(?:default\s+)?)?(?:declare\s+)?(?P<decl>(?:async\s+)?function\s*\*?\s*(?P<name>[\w$]+)|class\s+(?P<cname>[\w$]+)|interface\s+(?P<iname>[\w$]+)|type\s+(?P<tname>[\w$]+)\s*(?:<[^=]*>)?\s*(?==))")


def _with_names(scan: Callable[[str], list[Span]], rx: str) -> Callable[[str], list[Span]]:
    """Names read again from each span's own beginning."""
    head = re.compile(rx)

    def named(text: str) -> list[Span]:
        out = scan(text)
        for s in out:
            m = head.match(text, s.start)
            s.name = m[1] if m else None
        return out

    return named


_go = _with_names(_go, r"func\s+(?:\([^)]*\)\s*)?(\w+)")
_js = _with_names(_js, r"(?:(?:async\s+)?function\s*\*?|class)\s*([\w$]+)")
_ts = _with_names(_ts, r"(?:(?:async\s+)?function\s*\*?|class|interface|type)\s*([\w$]+)")
_bash = _with_names(_braced(r"^[ \t]*(?P<decl>(?:function\s+(?P<name>[\w:.-]+)(?:\s*\(\))?|(?P<n2>[\w:.-]+)\s*\(\))(?=\s*\{))", "bash"), r"(?:function\s+)?([\w:.-]+)")

_RUBY_OPEN = re.compile(r"^\s*(?:class|module|def|if|unless|case|while|until|for|begin)\b|\bdo\b\s*(?:\|[^|]*\|)?\s*$|=\s*(?:if|case|begin|unless)\b")
_RUBY_HEAD = re.compile(r"^(\s*)(?:class|module|def)\s+((?:self\.)?[\w:?!=<>+\-*/\[\]]+)")


def _ruby(text: str) -> list[Span]:
    out: list[Span] = []
    depth, at, start, name = 0, 0, None, None
    for line in text.splitlines(keepends=True):
        code = re.sub(r"(\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*')|#(?!\{).*", lambda m: m[1] or "", line.rstrip("\r\n"))
        head = _RUBY_HEAD.match(code)
        if start is None and head:
            start, name, depth = at + len(head[1]), head[2].removeprefix("self."), 0
        if start is not None:
            one_line = bool(re.search(r"\bend\s*$", code)) and _RUBY_OPEN.search(code) and not re.match(r"\s*end\b", code)
            endless = bool(re.match(r"\s*def\s+[^=\n]*\)?\s+=\s", code))
            if _RUBY_OPEN.search(code) and not one_line and not endless:
                depth += 1
            elif re.match(r"\s*end\b", code):
                depth -= 1
            if depth <= 0:
                out.append(Span(start, at + len(line.rstrip("\r\n")), None, name))
                start = None
        at += len(line)
    if start is not None:
        out.append(Span(start, len(text.rstrip()), None, name))
    return out


def _dockerfile(text: str) -> list[Span]:
    """A stage runs from one FROM to the next."""
    heads = [m.start() for m in re.finditer(r"^[ \t]*FROM\b", text, re.MULTILINE | re.IGNORECASE)]
    return [Span(a, a + len(text[a:b].rstrip())) for a, b in zip(heads, [*heads[1:], len(text)], strict=True)]


_HCL_BLOCK = re.compile(r"^[ \t]*([A-Za-z_][\w-]*)((?:[ \t]+(?:\"[^\"\n]*\"|[A-Za-z_][\w-]*))*)[ \t]*\{", re.MULTILINE)


def _hcl(text: str) -> list[Span]:
    flat = plain(text, "hcl")
    out: list[Span] = []
    for m in _HCL_BLOCK.finditer(text):
        brace = m.end() - 1
        if out and m.start(1) < out[-1].end or flat[m.start(1)] == " " or flat[brace] != "{":
            continue
        end = closing(flat, brace)
        label = re.search(r'"([^"]*)"', m[2])
        out.append(Span(m.start(1), end, m[1], (label[1] or None) if label else None, {"attributes": _hcl_attributes(text[brace + 1 : end - 1])}))
    return out


def _hcl_attributes(body: str) -> list[str]:
    """Direct attributes, and direct blocks as ``<name> block``."""
    flat = plain(body, "hcl")
    out, depth = [], 0
    for line, seen in zip(body.split("\n"), flat.split("\n"), strict=True):
        if depth == 0 and (m := re.match(r"\s*([A-Za-z_][\w-]*)\s*(=(?!=)|(?:\s+\"[^\"]*\"|\s+[A-Za-z_][\w-]*)*\s*\{)", line)) and seen[len(seen) - len(seen.lstrip()) :][:1] not in ("", " "):
            out.append(m[1] if m[2].startswith("=") else f"{m[1]} block")
        depth += sum((c in OPEN) - (c in CLOSE) for c in seen)
    return out


_PUPPET_HEAD = re.compile(r"^[ \t]*(?:(class|node)\b[^{;]*\{|(@{0,2}[a-z][\w:]*)\s*\{)", re.MULTILINE)
_PUPPET_INNER = re.compile(r"(?<![\w:$'\"])([a-z][\w:]*)\s*\{(?=\s*(?:[\"'$\[\w]|default)[^{}]*?:)")
# Words that open a brace in Puppet without declaring a resource.
_PUPPET_WORDS = ("if", "unless", "else", "elsif", "case", "default", "class", "node", "define", "function")


def _puppet(text: str) -> list[Span]:
    flat = plain(text, "puppet")
    out: list[Span] = []
    for m in _PUPPET_HEAD.finditer(flat):
        begin = m.start(1) if m[1] else m.start(2)
        if (out and begin < out[-1].end) or (m[2] and m[2] in _PUPPET_WORDS):
            continue
        brace = m.end() - 1
        head = flat[begin:brace]
        if m[1] == "class" and "(" in head:  # a parameter list may hold braces of its own
            brace = flat.find("{", closing(flat, begin + head.index("(")))
            if brace < 0:
                continue
        end = closing(flat, brace)
        out.append(Span(begin, end, None, None, _puppet_features(text[begin:end])))
    return out


def _puppet_features(text: str) -> dict[str, Any]:
    flat = plain(text, "puppet")
    params: dict[str, None] = {}
    m = re.match(r"class\s+[\w:]+\s*\(", flat)
    if m:
        inside = flat[m.end() - 1 : closing(flat, m.end() - 1)]
        depth = 0
        wanted = True
        for t in re.finditer(r"[{\[(]|[}\])]|,|\$\w+|=", inside):
            c = t[0]
            if c in OPEN:
                depth += 1
            elif c in CLOSE:
                depth -= 1
            elif depth == 1 and c == ",":
                wanted = True
            elif depth == 1 and c == "=":
                wanted = False
            elif depth == 1 and wanted:
                params[c[1:]] = None
    types = [x[1] for x in _PUPPET_INNER.finditer(text) if flat[x.start(1)] != " " and x[1] not in _PUPPET_WORDS]
    return {"parameters": list(params), "resources": types, "ordering": bool(re.search(r"->|~>", flat))}


def _json(text: str) -> list[Span]:
    """The outermost object or array."""
    m = re.search(r"[{\[]", text)
    if not m:
        return []
    return [Span(m.start(), _json_end(text, m.start()))]


def _json_end(text: str, at: int) -> int:
    depth, i, n = 0, at, len(text)
    while i < n:
        c = text[i]
        if c == '"':
            i += 1
            while i < n and text[i] != '"':
                i += 2 if text[i] == "\\" else 1
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
            if depth == 0:
                return i + 1
        elif depth == 0 and c == ",":
            return i
        i += 1
    return n


def json_pairs(text: str) -> list[Span]:
    """The pairs of the outermost object, named by their keys."""
    out: list[Span] = []
    root = text.find("{")
    i = root + 1
    while 0 < i < len(text):
        m = re.compile(r'[\s,]*"((?:\\.|[^"\\])*)"\s*:\s*').match(text, i)
        if not m:
            break
        if text[m.end() : m.end() + 1] in ("{", "[", '"'):
            end = _json_end(text, m.end()) if text[m.end()] != '"' else re.compile(r'"(?:\\.|[^"\\])*"').match(text, m.end()).end()
        else:
            end = re.compile(r"[^,}\s]*").match(text, m.end()).end()
        out.append(Span(text.index('"', m.start()), end, None, m[1]))
        i = end
    return out


def _yaml(text: str) -> list[Span]:
    """Documents, from the first node of each to its last."""
    out = []
    for doc in yaml.compose_all(text, Loader=yaml.SafeLoader):
        start, end = doc.start_mark.index, doc.end_mark.index
        out.append(Span(start, start + len(text[start:end].rstrip())))
    return out


SCANNERS: dict[str, Callable[[str], list[Span]]] = {"python": _python, "go": _go, "ruby": _ruby, "javascript": _js, "typescript": _ts, "bash": _bash, "dockerfile": _dockerfile, "hcl": _hcl, "puppet": _puppet, "json": _json, "tfjson": json_pairs, "yaml": _yaml}


def grammar_of(fmt: str, filename: str) -> str | None:
    """Which scanner reads a format; Terraform has two."""
    if fmt == "terraform":
        return "tfjson" if filename.lower().endswith(".tf.json") else "hcl"
    return fmt if fmt in SCANNERS else None


def spans(grammar: str, text: str) -> list[Span]:
    return outermost([s for s in SCANNERS[grammar](text) if text[s.start : s.end].strip()])
