"""Symbols and raw edges of source files: Python by its own grammar, brace languages by a scanner of tokens."""

from __future__ import annotations

import ast
import io
import re
import tokenize
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import paths
from sparkloom.functions import text as X

PARSED = """file_path string, local_id long, parent_local_id long, symbol_name string, qualified_name string, symbol_type string, start_line long, end_line long,
source_code string, signature string, docstring string, search_terms array<string>, edges array<struct<relationship_type:string,target_name:string,via:string,confidence:double>>"""
IDENT = re.compile(X.IDENTIFIER)
_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
#: What sure an edge is, by kind: imports and bases of Python, calls on self, other calls, imports elsewhere.
SURE_IMPORT, SURE_BASE, SURE_SELF, SURE_CALL, SURE_OTHER_IMPORT = 0.9, 0.9, 0.9, 0.6, 0.8


def split_name(name: str) -> list[str]:
    return [name, *(p.lower() for p in X._CAMEL.findall(name))]


def identifiers(code: str) -> list[str]:
    return list(dict.fromkeys(x for x in IDENT.findall(code) if x.lower() not in X.STOP))[: X.MOST_IDENTIFIERS]


def terms_of(*groups: list[str]) -> list[str]:
    found: dict[str, str] = {}
    for ident in (i for g in groups for i in g):
        for t in split_name(ident):
            found.setdefault(t.lower(), t)
    return list(found.values())[: X.MOST_TERMS]


class Symbols:
    """The rows of one file, numbered in the order in which they come."""

    def __init__(self, path: str, module: str):
        self.path, self.module, self.rows = path, module, []

    def add(self, parent: int | None, name: str, qualified: str, kind: str, first: int, last: int, code: str, signature: str | None, docstring: str | None, edges: list[tuple]) -> int:
        if kind == "module" and parent is None:
            terms = terms_of(split_name(name), identifiers(code))
        else:
            terms = terms_of(split_name(name), qualified.split("."), identifiers(signature or ""), identifiers(code))
        self.rows.append((self.path, len(self.rows), parent, name, qualified, kind, first, last, code, signature, docstring, terms, edges))
        return len(self.rows) - 1


# --- Python


def _clean(raw: str) -> str:
    body = raw.strip().lstrip("rbfuRBFU")
    for quote in ('"""', "'''", '"', "'"):
        if len(body) >= 2 * len(quote) and body.startswith(quote) and body.endswith(quote):
            return body[len(quote) : -len(quote)].strip()
    return body.strip()


class _Python:
    def __init__(self, source: str):
        self.tree = ast.parse(source)
        self.lines = source.encode().splitlines(keepends=True)

    def cut(self, a: tuple[int, int], b: tuple[int, int]) -> str:
        """The text between two places (line from 1, byte in the line)."""
        part = self.lines[a[0] - 1 : b[0]]
        if not part:
            return ""
        if len(part) == 1:
            return part[0][a[1] : b[1]].decode("utf-8", "replace")
        return b"".join([part[0][a[1] :], *part[1:-1], part[-1][: b[1]]]).decode("utf-8", "replace")

    def span(self, node: ast.AST) -> tuple[tuple[int, int], tuple[int, int]]:
        start = (node.lineno, node.col_offset)
        if getattr(node, "decorator_list", None):
            d = node.decorator_list[0]
            start = (d.lineno, self.lines[d.lineno - 1].rindex(b"@", 0, d.col_offset))
        return start, (node.end_lineno, node.end_col_offset)

    def docstring(self, node: ast.AST) -> str | None:
        first = node.body[0] if node.body else None
        if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str | bytes):
            return _clean(self.cut((first.lineno, first.col_offset), (first.end_lineno, first.end_col_offset)))
        return None

    def comments(self) -> list[tuple[tuple[int, int], tuple[int, int]]]:
        out = []
        try:
            for t in tokenize.tokenize(io.BytesIO(b"".join(self.lines)).readline):
                if t.type == tokenize.COMMENT:
                    at = lambda p: (p[0], len(t.line[: p[1]].encode()))
                    out.append((at(t.start), at(t.end)))
        except (tokenize.TokenError, SyntaxError, IndentationError):
            pass
        return out


def _imports(node: ast.stmt) -> list[str]:
    if isinstance(node, ast.Import):
        return [a.name for a in node.names]
    if isinstance(node, ast.ImportFrom) and node.module != "__future__":
        module = "." * node.level + (node.module or "")
        return [module if a.name == "*" else f"{module}.{a.name}" for a in node.names]
    return []


def _calls(body: list[ast.stmt]) -> list[tuple[str, str]]:
    """(name, via) of each call, once, without those in nested definitions."""
    found: dict[tuple[str, str], None] = {}
    stack = [n for n in reversed(body) if not isinstance(n, _DEFS)]
    while stack:
        node = stack.pop()
        if isinstance(node, ast.Call):
            f = node.func
            if isinstance(f, ast.Name):
                found.setdefault((f.id, "bare"))
            elif isinstance(f, ast.Attribute):
                found.setdefault((f.attr, "self" if isinstance(f.value, ast.Name) and f.value.id == "self" else "attr"))
        stack += [n for n in reversed(list(ast.iter_child_nodes(node))) if not isinstance(n, _DEFS)]
    return list(found)


def _sound(source: str) -> str:
    """The source with the top-level statements that don't parse made blank, each for itself, so that lines keep their numbers."""
    lines = source.splitlines(keepends=True)
    begins = re.compile(r"(?!else\b|elif\b|except\b|finally\b)[^\s#)\]}]")
    starts = [i for i, x in enumerate(lines) if begins.match(x) and not (i and lines[i - 1].startswith("@"))]
    out = [x if not x.strip() else "\n" for x in lines[: starts[0] if starts else len(lines)]]
    for a, b in zip(starts, [*starts[1:], len(lines)], strict=True):
        part = "".join(lines[a:b])
        try:
            ast.parse(part)
            out.append(part)
        except (SyntaxError, ValueError, RecursionError):
            out.append("\n" * (b - a))
    return "".join(out)


def python_symbols(path: str, module: str, source: str) -> Symbols:
    """Module, classes, functions and methods. Of a file with errors the top-level statements that parse count; if none does, it is its module alone."""
    out = Symbols(path, module)
    name = module.rsplit(".", 1)[-1]
    for attempt in (source, None):
        try:
            py = _Python(source if attempt is not None else _sound(source))
            break
        except (SyntaxError, ValueError, RecursionError):
            py = None
    if py is None or attempt is None and not py.tree.body:
        out.add(None, name, module, "module", 1, source.count("\n") + 1, source, None, None, [])
        return out
    defs = [n for n in py.tree.body if isinstance(n, _DEFS)]
    rest = [n for n in py.tree.body if not isinstance(n, _DEFS)]
    spans = [py.span(n) for n in rest]
    taken = spans + [py.span(n) for n in defs]
    heads = sorted(spans + [c for c in py.comments() if not any(a <= c[0] < b for a, b in taken)])
    code = "\n".join(py.cut(*s) for s in heads)
    edges = [("IMPORTS", t, None, SURE_IMPORT) for n in rest for t in _imports(n)]
    out.add(None, name, module, "module", 1, heads[-1][1][0] if heads else 1, code, None, py.docstring(py.tree), edges)

    stack = [(n, 0, module, False) for n in reversed(defs)]
    while stack:
        node, parent, prefix, in_class = stack.pop()
        a, b = py.span(node)
        first = node.body[0]
        begin = py.span(first)[0] if isinstance(first, _DEFS) else (first.lineno, first.col_offset)
        signature = py.cut((node.lineno, node.col_offset), begin)
        signature = "\n".join(x for x in signature.split("\n") if not x.lstrip().startswith("#")).strip().rstrip(":").strip() or None
        is_class = isinstance(node, ast.ClassDef)
        if is_class:
            bases = [x.id if isinstance(x, ast.Name) else x.attr for x in node.bases if isinstance(x, ast.Name | ast.Attribute)]
            edges = [("INHERITS", x, None, SURE_BASE) for x in bases]
        else:
            edges = [("CALLS", t, via, SURE_SELF if via == "self" else SURE_CALL) for t, via in _calls(node.body)]
        qualified = f"{prefix}.{node.name}"
        own = out.add(parent, node.name, qualified, "class" if is_class else "method" if in_class else "function", a[0], b[0], py.cut(a, b), signature, py.docstring(node), edges)
        stack += [(n, own, qualified, is_class) for n in reversed(node.body) if isinstance(n, _DEFS)]
    return out


# --- Languages with braces

TOKEN = re.compile(
    r"(?P<skip>//[^\n]*|/\*.*?(?:\*/|\Z)|\s+)|(?P<str>\"(?:\\.|[^\"\\\n])*\"?|`(?:\\.|[^`\\])*`?|'(?:\\.|[^'\\\n])*')|(?P<word>[A-Za-z_$][\w$]*)|(?P<num>\d[\w.]*)|(?P<sign>=>|::|->|.)", re.S
)
_CLASS_WORDS = {
    "javascript": {"class"}, "typescript": {"class", "interface", "enum"}, "tsx": {"class", "interface", "enum"},
    "java": {"class", "interface", "enum", "record"}, "rust": {"struct", "enum", "trait", "union"}, "go": set(),
}
#: Words before a bracket that call nothing.
_COMMON = {"if", "for", "while", "switch", "return", "else"}
_SCRIPT = _COMMON | {"catch", "function", "super", "new", "await", "typeof", "do", "try", "in", "of"}
_NO_CALL = {"javascript": _SCRIPT, "typescript": _SCRIPT, "tsx": _SCRIPT, "java": _COMMON | {"catch", "super", "new", "synchronized", "do", "try"}, "rust": _COMMON | {"fn", "match", "loop", "in"}, "go": _COMMON | {"func", "defer", "go", "select", "range"}}


#: A regular expression of JavaScript; it may stand where a value may begin: after a sign, or after one of these words.
REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/\w*")
_BEFORE_VALUE = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "await", "yield", "instanceof"}


def _scan(source: str, regexes: bool) -> Iterator[tuple[str, str, int, int]]:
    at, last = 0, ("sign", ";")
    while m := TOKEN.match(source, at):
        kind, found = m.lastgroup, m[0]
        if kind == "sign" and found == "/" and regexes and (last[0] == "sign" and last[1] not in (")", "]", "}") or last[1] in _BEFORE_VALUE) and (r := REGEX.match(source, at)):
            kind, found = "str", r[0]
        at += len(found)
        if kind != "skip":
            last = (kind, found)
            yield kind, found, at - len(found), at


class _Tokens:
    """The tokens of a source without comments, and for each opening bracket where it closes."""

    def __init__(self, source: str, regexes: bool = False):
        self.source = source
        self.toks = list(_scan(source, regexes))
        self.close: dict[int, int] = {}
        stack: list[int] = []
        for i, (_, t, _, _) in enumerate(self.toks):
            if t in ("(", "[", "{"):
                stack.append(i)
            elif t in (")", "]", "}") and stack:
                self.close[stack.pop()] = i
        for i in stack:
            self.close[i] = len(self.toks) - 1

    def text(self, i: int) -> str:
        return self.toks[i][1] if 0 <= i < len(self.toks) else ""

    def word(self, i: int) -> bool:
        return 0 <= i < len(self.toks) and self.toks[i][0] == "word"

    def find(self, i: int, end: int, *what: str) -> int | None:
        """The next of these tokens outside brackets, before `end`."""
        while i < end:
            if self.text(i) in what:
                return i
            i = self.close[i] + 1 if i in self.close else i + 1
        return None


class _Braces:
    def __init__(self, path: str, module: str, language: str, source: str):
        self.language, self.t, self.module = language, _Tokens(source, language in ("javascript", "typescript", "tsx")), module
        self.starts = [0] + [m.end() for m in re.finditer("\n", source)]
        self.out = Symbols(path, module)
        self.spans: list[tuple[int, int]] = []

    def line(self, place: int) -> int:
        import bisect

        return bisect.bisect_right(self.starts, place)

    def definition(self, i: int, end: int, in_class: bool) -> tuple | None:
        """(kind, name, first token, body or None, last token) of the definition that begins at token i."""
        t, lang, j = self.t, self.language, i
        while t.text(j) in ("export", "default", "async", "public", "private", "protected", "static", "final", "abstract", "pub", "unsafe", "const", "readonly", "override", "declare", "sealed", "get", "set", "native", "synchronized", "extern", "strictfp") and j < end:
            if t.text(j) == "const" and lang in ("javascript", "typescript", "tsx"):
                break
            if t.text(j) == "pub" and t.text(j + 1) == "(":
                j = t.close[j + 1]
            if t.text(j + 1) in ("(", "=", ";", ":") and in_class:
                break  # a member called so
            j += 1
        word = t.text(j)
        if word == "@" or (word == "#" and t.text(j + 1) == "["):  # annotations and attributes belong to what follows
            k = t.close.get(j + 1, j + 1) + 1 if word == "#" else (t.close[j + 2] + 1 if t.text(j + 2) == "(" else j + 2)
            got = self.definition(k, end, in_class) if k < end and t.text(j + 1) != "interface" else None
            return (*got[:2], i, *got[3:]) if got else None
        whole = lambda kind, name, at: (kind, name, i, *self._body(at, end))
        if word in _CLASS_WORDS[lang] and t.word(j + 1):
            return whole("class", t.text(j + 1), j + 2)
        if word == "mod" and lang == "rust" and t.word(j + 1) and t.text(j + 2) == "{":
            return whole("module", t.text(j + 1), j + 2)
        if word == "impl" and lang == "rust":
            body = t.find(j, end, "{")
            if body is None:
                return None
            names = [k for k in range(j + 1, body) if t.word(k)]
            after = next((k for k in names if t.text(k) == "for"), None)
            where = next((k for k in names if t.text(k) == "where"), body)
            name = "".join(t.text(k) for k in range(after + 1, where)) if after else "".join(t.text(k) for k in range(t.find(j + 1, body, ">") + 1 if t.text(j + 1) == "<" else j + 1, where))
            return ("impl", name, i, body, t.close[body])
        if lang == "go":
            if word == "func":
                at, method = (t.close[j + 1] + 1, True) if t.text(j + 1) == "(" else (j + 1, False)
                if t.word(at):
                    return whole("method" if method else "function", t.text(at), at + 1)
            if word == "type" and t.word(j + 1):
                return whole("class", t.text(j + 1), j + 2)
            return None
        if word == "fn" and lang == "rust" and t.word(j + 1):
            return whole("method" if in_class else "function", t.text(j + 1), j + 2)
        if lang in ("javascript", "typescript", "tsx"):
            if word == "function":
                at = j + 2 if t.text(j + 1) == "*" else j + 1
                return whole("function", t.text(at), at + 1) if t.word(at) else None
            if word in ("const", "let", "var") and t.word(j + 1):
                eq = t.find(j + 2, end, "=", ";") if t.text(j + 2) in ("=", ":") else None
                if eq is not None and t.text(eq) == "=":
                    k = eq + 1 + (t.text(eq + 1) == "async")
                    arrow = t.close[k] + 1 if t.text(k) == "(" else k + 1
                    if t.text(arrow) == ":":
                        arrow = t.find(arrow, end, "=>", ";", "{") or arrow
                    if t.text(k) == "function" or t.text(arrow) == "=>":
                        at = arrow + 1 if t.text(arrow) == "=>" else k + 1
                        body, last = self._body(at, end)
                        if t.text(arrow) == "=>" and t.text(arrow + 1) != "{":
                            body, last = None, (t.find(arrow, end, ";") or t.find(arrow, end, "}") or end - 1)
                        return ("function", t.text(j + 1), i, body, last)
        if in_class or lang == "java":
            k = j
            while k < end and (t.word(k) or t.text(k) in ("<", ">", ",", "[", "]", ".", "?", "*", "#", "&")) and t.text(k + 1) != "(":
                k += 1
            if t.word(k) and t.text(k + 1) == "(" and t.text(k) not in _NO_CALL[lang] and in_class:
                after = t.close[k + 1] + 1
                if t.text(after) in (("{", ";", "throws", "default") if lang == "java" else ("{", ":")):
                    body, last = self._body(after, end)
                    if body is not None or lang == "java":
                        return ("method", t.text(k), i, body, last)
        return None

    def _body(self, at: int, end: int) -> tuple[int | None, int]:
        stop = self.t.find(at, end, "{", ";")
        if stop is None:
            return None, min(end, len(self.t.toks)) - 1
        return (stop, self.t.close[stop]) if self.t.text(stop) == "{" else (None, stop)

    def walk(self, i: int, end: int, parent: int, prefix: str, in_class: bool) -> list[tuple[int, int]]:
        """Emits the definitions among tokens [i, end) that aren't within one another; gives their spans of tokens."""
        t, spans = self.t, []
        while i < end:
            got = self.definition(i, end, in_class)
            if got is None:
                if in_class and self.language == "java" and (semi := t.find(i, end, ";", "{")) is not None:
                    i = t.close.get(semi, semi) + 1  # a field, or a block of statements
                else:
                    i = t.close[i] + 1 if i in t.close else i + 1
                continue
            kind, name, first, body, last = got
            spans.append((first, last))
            i = last + 1
            if kind == "impl":
                self.walk(body + 1, last, parent, f"{prefix}.{name}", True)
                continue
            a, z = t.toks[first][2], t.toks[last][3]
            head = t.source[t.toks[first][2] : t.toks[body][2] if body is not None else z].strip().rstrip("{;").strip() or None
            kind = "method" if kind == "function" and in_class else kind
            at = len(self.out.rows)
            edges: list[tuple] = []
            self.out.add(parent, name, f"{prefix}.{name}", kind, self.line(a), self.line(z - 1), t.source[a:z], head, None, edges)
            inner = self.walk(body + 1, last, at, f"{prefix}.{name}", kind == "class") if body is not None else []
            if kind in ("function", "method"):
                edges += [("CALLS", n, via, SURE_CALL) for n, via in self.calls(body if body is not None else first + 2, last, inner)]
        return spans

    def calls(self, i: int, end: int, inner: list[tuple[int, int]]) -> list[tuple[str, str]]:
        found: dict[tuple[str, str], None] = {}
        skip = {k for a, b in inner for k in range(a, b + 1)}
        for k in range(i, end):
            if k not in skip and self.t.word(k) and self.t.text(k + 1) == "(" and self.t.text(k) not in _NO_CALL[self.language] and self.t.text(k - 1) not in ("function", "fn", "func", "new"):
                found.setdefault((self.t.text(k), "attr" if self.t.text(k - 1) in (".", "::") else "bare"))
        return list(found)

    def imports(self, spans: list[tuple[int, int]]) -> list[str]:
        t, out, taken = self.t, [], {k for a, b in spans for k in range(a, b + 1)}
        for i in range(len(t.toks)):
            if i in taken or not t.word(i):
                continue
            word, end = t.text(i), None
            if word == "import" and (self.language == "go" or t.text(i + 1) != "("):
                if self.language == "go":
                    stop = t.close[i + 1] if t.text(i + 1) == "(" else min(i + 3, len(t.toks))
                    out += [t.text(k).strip("\"`'") for k in range(i + 1, stop) if t.toks[k][0] == "str"]
                elif self.language == "java":
                    end = t.find(i, len(t.toks), ";")
                    names = [t.text(k) for k in range(i + 1, end or i + 1) if t.text(k) != "static"]
                    out.append("".join(names).removesuffix(".*"))
                else:
                    k = i + 1
                    while k < len(t.toks) and t.toks[k][0] != "str" and t.text(k) != ";":
                        k = t.close.get(k, k) + 1
                    out += [t.text(k).strip("\"`'")] if k < len(t.toks) and t.toks[k][0] == "str" else []
            elif word == "use" and self.language == "rust":
                end = t.find(i, len(t.toks), ";")
                if end:
                    out.append(t.source[t.toks[i + 1][2] : t.toks[end][2]].strip())
        return out


def brace_symbols(path: str, module: str, language: str, source: str) -> Symbols:
    """As python_symbols(), by scanning tokens: names, spans, bodies and calls, without a full grammar or docstrings."""
    b = _Braces(path, module, language, source)
    name = module.rsplit(".", 1)[-1]
    imports: list[tuple] = []
    b.out.add(None, name, module, "module", 1, 1, "", None, None, imports)
    spans = b.walk(0, len(b.t.toks), 0, module, False)
    toks, heads, at = b.t.toks, [], 0
    for first, last in [*spans, (len(toks), len(toks))]:
        if at < first:
            heads.append((toks[at][2], toks[first - 1][3]))
        at = last + 1
    code = "\n".join(source[a:z] for a, z in heads)
    imports += [("IMPORTS", x, None, SURE_OTHER_IMPORT) for x in b.imports(spans)]
    row = list(b.out.rows[0])
    row[7], row[8], row[11] = b.line(heads[-1][1] - 1) if heads else 1, code, terms_of(split_name(name), identifiers(code))
    b.out.rows[0] = tuple(row)
    return b.out


def symbols_of(path: str, module: str, language: str, source: str) -> list[tuple]:
    if language == "python":
        return python_symbols(path, module, source).rows
    if language in _CLASS_WORDS:
        return brace_symbols(path, module, language, source).rows
    return []


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    edge = pa.struct([("relationship_type", pa.string()), ("target_name", pa.string()), ("via", pa.string()), ("confidence", pa.float64())])
    names = [x.strip().split(" ")[0] for x in re.sub(r"<[^<>]*(<[^<>]*>)?[^<>]*>", "", PARSED).split(",")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(edge)]
    for batch in batches:
        for path, module, language, source in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            rows = symbols_of(path, module, language, source or "")
            cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
            cols[12] = [[dict(zip(("relationship_type", "target_name", "via", "confidence"), e, strict=True)) for e in es] for es in cols[12]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def parse_files(files: DataFrame) -> DataFrame:
    """One row for each symbol of each file (path, text), with its raw edges; files in no known language give none."""
    language = paths.language_of(F.col("path"))
    return files.select("path", paths.module_name(F.col("path")).alias("module"), language.alias("language"), "text").filter("language is not null and text is not null").mapInArrow(_parse, PARSED)
