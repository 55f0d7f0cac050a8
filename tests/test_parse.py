"""Symbols and raw edges of source files."""

import random

import pytest

from sparkloom.functions import parse
from sparkloom.functions.parse import symbols_of


def rows(language, source, module="pkg.m", path="pkg/m.x"):
    return [dict(zip(("path", "id", "parent", "name", "qualified", "kind", "first", "last", "code", "signature", "doc", "terms", "edges"), r, strict=True)) for r in symbols_of(path, module, language, source)]


PY = '''"""About this."""
from __future__ import annotations
import os, a.b as c
from . import near
from m.n import x as y, z
from w import *

LIMIT = 3  # so many


@dec(1)
@other
class Thing(Base, pkg.Mixin, metaclass=M):
    r"""A thing."""

    size: int = 2

    @property
    def big(self) -> bool:
        """Is it?"""
        def inner():
            hidden()
        return self.check(len(self.items)) and helper(1) and helper(2)

    async def wait(
        self, n,
    ):
        await go.far(n)


def top(): return [f(x) for x in y]
tail()
'''


def test_python():
    got = {r["qualified"]: r for r in rows("python", PY)}
    assert list(got) == ["pkg.m", "pkg.m.Thing", "pkg.m.Thing.big", "pkg.m.Thing.big.inner", "pkg.m.Thing.wait", "pkg.m.top"]
    assert [got[k]["kind"] for k in got] == ["module", "class", "method", "function", "method", "function"]
    module, thing, big, inner, wait, top = got.values()
    assert (module["first"], module["last"], module["doc"]) == (1, 32, "About this.")
    assert "LIMIT = 3\n# so many\ntail()" in module["code"] and "class Thing" not in module["code"]
    assert [e[1] for e in module["edges"]] == ["os", "a.b", "..near", "m.n.x", "m.n.z", "w"]
    assert (thing["first"], thing["last"], thing["doc"], thing["signature"]) == (11, 28, "A thing.", "class Thing(Base, pkg.Mixin, metaclass=M)")
    assert [e[:2] for e in thing["edges"]] == [("INHERITS", "Base"), ("INHERITS", "Mixin")]
    assert thing["code"].startswith("@dec(1)\n@other\nclass Thing")
    assert {(t, via, c) for _, t, via, c in big["edges"]} == {("check", "self", 0.9), ("len", "bare", 0.6), ("helper", "bare", 0.6)}
    assert big["parent"] == thing["id"] and inner["parent"] == big["id"] and big["first"] == 18
    assert inner["edges"] == [("CALLS", "hidden", "bare", 0.6)]
    assert wait["signature"] == "async def wait(\n        self, n,\n    )" and wait["edges"] == [("CALLS", "far", "attr", 0.6)]
    assert (top["first"], top["last"], top["signature"]) == (31, 31, "def top()")
    assert "big" in big["terms"] and "thing" in [t.lower() for t in big["terms"]]


def test_python_that_does_not_parse_is_its_module():
    assert [(r["kind"], r["code"]) for r in rows("python", "def (:")] == [("module", "def (:")]
    got = rows("python", "import os\n\n@dec\ndef fine():\n    return os.name\n\nclass Broken(:\n    def lost(self): pass\n\nif x:\n    y = 1\nelse:\n    y = 2\n\ndef after(a,\n          b):\n    fine()\n")
    assert [(r["qualified"], r["first"]) for r in got[1:]] == [("pkg.m.fine", 3), ("pkg.m.after", 15)]
    assert [t for _, t, _, _ in got[0]["edges"]] == ["os"] and [t for _, t, _, _ in got[2]["edges"]] == ["fine"]
    assert [(r["kind"], r["last"]) for r in rows("python", "")] == [("module", 1)]
    assert rows("python", "x = 'é'\ndef f(ü): pass\n")[1]["code"] == "def f(ü): pass"


SOURCES = {
    "typescript": (
        'import { a } from "./lib/a";\nimport "side";\n// function no() {}\nexport interface Shape { area(): number; }\nexport class Box extends Base implements Shape {\n  private n = "}";\n  constructor(n: number) { super(n); this.fill(n); }\n'
        "  async area(): Promise<number> { return compute(this.n) }\n  static make() { return new Box(1); }\n}\nexport const add = (a: number, b: number): number => { return sum(a, b); };\nconst twice = x => x * 2;\nfunction run() { function deep() { inner(); } return add(1, 2).fix(); }\nrun();\n",
        [("pkg.m", "module"), ("pkg.m.Shape", "class"), ("pkg.m.Box", "class"), ("pkg.m.Box.constructor", "method"), ("pkg.m.Box.area", "method"), ("pkg.m.Box.make", "method"), ("pkg.m.add", "function"), ("pkg.m.twice", "function"), ("pkg.m.run", "function"), ("pkg.m.run.deep", "function")],
        ["./lib/a", "side"],
        {"pkg.m.Box.constructor": {("fill", "attr")}, "pkg.m.Box.area": {("compute", "bare")}, "pkg.m.add": {("sum", "bare")}, "pkg.m.run": {("add", "bare"), ("fix", "attr")}, "pkg.m.run.deep": {("inner", "bare")}},
    ),
    "go": (
        'package main\n\nimport (\n\t"fmt"\n\tx "net/http"\n)\n\ntype Server struct {\n\tn int\n}\n\nfunc (s *Server) Run(a int) error {\n\tgo s.loop()\n\treturn fmt.Errorf("}")\n}\n\nfunc main() {\n\tnewServer().Run(1)\n}\n',
        [("pkg.m", "module"), ("pkg.m.Server", "class"), ("pkg.m.Run", "method"), ("pkg.m.main", "function")],
        ["fmt", "net/http"],
        {"pkg.m.Run": {("loop", "attr"), ("Errorf", "attr")}, "pkg.m.main": {("newServer", "bare"), ("Run", "attr")}},
    ),
    "java": (
        "package a;\nimport java.util.List;\nimport static a.B.c;\n/* class No {} */\n@Entity(name = \"x\")\npublic final class Box<T> extends Base {\n  private final List<T> xs = make();\n  public Box(int n) { super(n); fill(n); }\n  @Override\n  protected List<T> all(int a) throws E { return this.xs.copy(a); }\n  abstract void none();\n  enum Kind { A, B }\n}\ninterface Shape { int area(); }\n",
        [("pkg.m", "module"), ("pkg.m.Box", "class"), ("pkg.m.Box.Box", "method"), ("pkg.m.Box.all", "method"), ("pkg.m.Box.none", "method"), ("pkg.m.Box.Kind", "class"), ("pkg.m.Shape", "class"), ("pkg.m.Shape.area", "method")],
        ["java.util.List", "a.B.c"],
        {"pkg.m.Box.Box": {("fill", "bare")}, "pkg.m.Box.all": {("copy", "attr")}},
    ),
    "rust": (
        "use std::io::{self, Read};\n#[derive(Debug)]\npub struct Point { x: i32 }\nimpl<T> Point {\n    pub fn new(x: i32) -> Self { helper(x) }\n    fn len(&self) -> usize { self.inner.size() }\n}\nimpl Show for Point { fn show(&self) { io::print() } }\npub trait Show { fn show(&self); }\nmod deep { pub fn go() { super::start() } }\nfn main() { if (true) { run() } }\n",
        [("pkg.m", "module"), ("pkg.m.Point", "class"), ("pkg.m.Point.new", "method"), ("pkg.m.Point.len", "method"), ("pkg.m.Point.show", "method"), ("pkg.m.Show", "class"), ("pkg.m.Show.show", "method"), ("pkg.m.deep", "module"), ("pkg.m.deep.go", "function"), ("pkg.m.main", "function")],
        ["std::io::{self, Read}"],
        {"pkg.m.Point.new": {("helper", "bare")}, "pkg.m.Point.len": {("size", "attr")}, "pkg.m.Point.show": {("print", "attr")}, "pkg.m.deep.go": {("start", "attr")}, "pkg.m.main": {("run", "bare")}},
    ),
}


@pytest.mark.parametrize("language", SOURCES)
def test_brace_languages(language):
    source, want, imports, calls = SOURCES[language]
    got = rows(language, source)
    assert [(r["qualified"], r["kind"]) for r in got] == want
    assert [e[1] for e in got[0]["edges"]] == imports
    for name, targets in calls.items():
        assert {(e[1], e[2]) for r in got if r["qualified"] == name for e in r["edges"]} == targets, name
    for r in got[1:]:
        assert "\n".join(source.split("\n")[r["first"] - 1 : r["last"]]).find(r["code"].split("\n")[0]) >= 0


@pytest.mark.parametrize("language", ["python", *SOURCES])
def test_noise_does_not_break_the_scan(language):
    r = random.Random(5)
    pieces = ["{", "}", "(", ")", "class A", "func f", "fn g", "def h():", "\n", "  ", '"', "'", "`", "/*", "*/", "//", "=>", "=", ";", "impl X for", "import", "@", "#[", "]", "const x", "é", ".", "mod m {", "type T"]
    for _ in range(400):
        source = " ".join(r.choice(pieces) for _ in range(r.randrange(40)))
        got = symbols_of("a/b.x", "a.b", language, source)
        assert got and got[0][5] == "module"
        assert all(x[6] <= x[7] for x in got)


def test_regular_expressions_and_long_annotations_hide_nothing():
    rest = "function one() { two(); }\nclass A { run() { return /[/}]/.test(x) ? a / b / c : 1; } }\n"
    for head in ("const re = /[\"'{]/;\n", "x.replace(/`/g, '').split(/\\//);\n", "if (a) return /{/i;\n", "const q = (a + b) / 2 / c;\n", ""):
        assert [r["qualified"] for r in rows("javascript", head + rest)] == ["pkg.m", "pkg.m.one", "pkg.m.A", "pkg.m.A.run"], head
    long = "export const pick: (" + ", ".join(f"a{i}: Map<string, number>" for i in range(30)) + ") => void = (a0) => { go(a0); };\n"
    assert [r["qualified"] for r in rows("typescript", long + "let z\nfunction f() {}\n")] == ["pkg.m", "pkg.m.pick", "pkg.m.f"]
    names = "import { " + ", ".join(f"n{i} as m{i}" for i in range(150)) + ' } from "./wide";\n'
    assert [t for _, t, _, _ in rows("typescript", names)[0]["edges"]] == ["./wide"]


def test_files(spark):
    files = spark.createDataFrame([("a/b.py", "def f(): pass"), ("a/c.txt", "def f(): pass"), ("d.go", "func g() {}"), ("e.py", None)], "path string, text string")
    got = {(r["file_path"], r["qualified_name"], r["symbol_type"]) for r in parse.parse_files(files).collect()}
    assert got == {("a/b.py", "a.b", "module"), ("a/b.py", "a.b.f", "function"), ("d.go", "d", "module"), ("d.go", "d.g", "function")}
