"""Outlines, names, Python call edges and protocols against plain Python on hard texts."""

import itertools
import random
import re

from pyspark.sql import functions as F

from tessera.operators import outline as O
from tessera.operators import python_code as P

TEXTS = {
    "python": ["", "\n\n  \nclass A(B):\n    def f(self):\n\n\n        def g(x): pass\n", "class\n A :\ndef f\n (x):", "x = 'class B:'\nclass C:\r\n\tdef h():\n", "def f(): pass\ndef f(): pass", "class Ünd(: pass", "no symbols"],
    "java": ["public class A {\n  return late(x);\n\n  new Thing(1);\n  if (a) b(c);\n  private static Map<String, int[]> get(int a) {\n  void\n  far (int b) {\n}}", "  throw e(x);\nnew B(2);\nint a(", "abstract class X\nfor (;;) run(1);\nreturnValue give(int x)"],
    "typescript": ["export class A {}\nexport async function f (a) {}\n  function g(\nasync function h()", "class A\nclass B {"],
    "javascript": ["class $A {}\nfunction _f$(a) {}\nexport function g() {}"],
    "scala": ["package a.b.c\nsealed abstract case class X\n  def f[T](x)\n def g(\n lazy val a = 1\nvar b = 2\nobject O\ntrait T\nenum E"],
}


def brute(lang, text):
    out = set()
    for kind, pattern in O.PATTERNS.get(lang, ()):
        for m in re.finditer(pattern, text, re.MULTILINE):
            line = text.count("\n", 0, m.start()) + 1
            if kind == "method" and re.match(r"(return|new|if|for|while|switch|catch|throw)\b", text.split("\n")[line - 1].strip()):
                continue
            out.add((m[1], kind, line))
    return out


def test_outline_equals_plain_matching(spark):
    rng, rows = random.Random(8), []
    for lang, texts in TEXTS.items():
        parts = [x + "\n" for t in texts for x in t.split("\n")]
        texts = texts + ["".join(rng.choice(parts) for _ in range(40)) for _ in range(12)]
        rows += [(f"{lang}/{i}", lang, t, "x", 1) for i, t in enumerate(texts)]
    rows += [("null", "java", None, "x", 1), ("other", "cobol", "class A:", "x", 1), ("none", None, "class A:", "x", 1)]
    df = spark.createDataFrame(rows, "path string, lang string, text string, kind string, line int").repartition(3)
    found = O.outline(df, ["path"]).collect()
    assert {(r.path, r.name, r.kind, r.line) for r in found} == {(p, *x) for p, lang, t, *_ in rows if t for x in brute(lang, t)}
    assert len(found) == len({(r.path, r.name, r.kind, r.line) for r in found})
    assert all(r.symbol_key == f"{r.name}:{r.line}" and r.end_line == r.line for r in found)
    assert O.outline(df.limit(0), ["path"]).collect() == []


def test_unicode_methods_and_decisions(spark):
    text = "class A {\n  public void größe(int a) {\n  }\r\n  Liste<T> größer() throws X { }\n  return ä(b) {\n  void plain() {}\n größe(a);\n  int été(x) {}\n"
    df = spark.createDataFrame([("a", "java", text), ("b", "java", None), ("c", "python", text)], "path string, lang string, text string")
    assert {(r.path, r.name, r.line) for r in O.unicode_methods(df, ["path"]).collect()} == {("a", "größe", 2), ("a", "größer", 4), ("a", "ä", 5), ("a", "été", 8)}
    rows = [("a.TS", "typescript", "x", 3), ("a.py", "python", "é" * 131_073, 1), ("a.py", "python", "é" * 131_072, 0), ("a.py", "python", "x", 2), ("a.vue", "vue", "x", 0)]
    df = spark.createDataFrame(rows, "p string, l string, t string, n int")
    assert [r.x.reason.removeprefix("l3_preprocess_") for r in df.select(O.decision(F.col("p"), F.col("t"), F.col("l"), F.col("n")).alias("x")).collect()] == ["tsls_fast_path", "large_file", "no_symbols", "supported_language", "unsupported_language"]


def test_names_kinds_and_missing_patterns(spark):
    names = [("java", " List<T> ", "List"), ("java", "run(int a)", "run"), ("java", "new Thing() {...}", ""), ("java", "x$value", ""), ("java", "get<T>(T x)", "get"), ("java", "<init>", "<init>"), ("javascript", "'quoted'", "quoted"), ("javascript", "[key]", "key"),
             ("javascript", '"[both]"', "both"), ("javascript", "<function>", ""), ("javascript", "app.get() callback", "get"), ("javascript", "run() callback", "run"), ("javascript", "'half\"", "'half\""), ("python", " f ", "f"), ("scala", "a(b)", "a(b)")]
    df = spark.createDataFrame(names, "l string, n string, e string")
    assert [tuple(r) for r in df.select("l", "n", O.symbol_name(F.col("l"), F.col("n"))).collect()] == names
    kinds = [("java", "constructor", "method"), ("java", "13", "variable"), ("python", "13", "field"), ("python", "variable", "field"), ("go", "variable", "variable"), ("scala", "trait", "interface"), ("scala", "12", "function"), ("kotlin", "19", "class"), ("typescript", "lexical_declaration", "variable"), ("javascript", "lexical_declaration", "field"), ("go", "thing", "other"), (None, "9", "method")]
    df = spark.createDataFrame(kinds, "l string, k string, e string")
    assert [tuple(r) for r in df.select("l", "k", O.kind_bucket(F.col("l"), F.col("k"))).collect()] == kinds
    missing = [("java", "9", "method", "A", "missing_constructor"), ("java", "7", "field", "a", "missing_field"), ("java", "5", "class", "A$B", "missing_nested_type"), ("java", "5", "class", "A", "missing_class"), ("scala", "12", "function", "f", "missing_method"), ("scala", "5", "class", "A", "missing_type"), ("go", "5", "class", "A.B", "missing_class")]
    df = spark.createDataFrame(missing, "l string, k string, b string, n string, e string")
    assert [tuple(r) for r in df.select("l", "k", "b", "n", O.missing_pattern(F.col("l"), F.col("k"), F.col("b"), F.col("n"))).collect()] == missing


def edges(text):
    return sorted((x[0].removeprefix("python_"), x[1], x[3], x[4]) for x in P.code_facts(text) if x[0].startswith("python_"))


def test_each_scanner_of_a_file():
    assert P.code_facts("def broken(:") == P.code_facts("a\0b") == P.code_facts(None) == []
    routes = "class App:\n async def make(self):\n  def deep():\n   return Route('/a', self.views.show)\n  routing.Route(path='/b', endpoint=views.list)\n  x.Route('/c')\n  api.add_api_route('/d', get_view().run)\n  xadd_api_route('/e', no)\n"
    assert edges(routes) == [("route_registration", "App.make", "list", 5), ("route_registration", "App.make", "run", 7), ("route_registration", "App.make", "show", 4)]
    dispatch = "class D:\n def __init__(self):\n  self.a = x.Tool()\n  self.b = self.c = Two()\n  self.d = 1\n def run(self):\n  t = self.a\n  t.call()\n  t = self.d\n  t.call(self.a.call())\n  self.b.call()\n  other.call()\n"
    assert sorted(set(edges(dispatch))) == [("mcp_dispatch", "D.run", "Tool.call", 8), ("mcp_dispatch", "D.run", "Tool.call", 10)]
    table = "class R:\n def __init__(self, s: Store):\n  self.s = s\n  self.one = {'k': self.s.load}\n  self.t = {'a': self.s.save, 'b': mod.f, 'c': self.own, **more, 1: x}\n def go(self, key):\n  self.one[key]()\n  t = self.t\n  t['a'](1)\n  h = t['b']\n  h()\n  self.t['c']()\n  t[key]()\n  unknown()\n"
    assert edges(table) == [("registry_dispatch", "R.go", "Store.load", 7), ("registry_dispatch", "R.go", "Store.save", 9), ("registry_dispatch", "R.go", "mod.f", 11), ("registry_dispatch", "R.go", "self.own", 12)]


def test_bound_calls_and_edges_across_files(spark):
    service = "class A:\n def __init__(self, r: 'x', s: db.Repo[int], n):\n  self.r: Repo = s\n  self.u = n\n  self.m = lib.make()\n def run(self):\n  self.r.find(self.m.go())\n  self.u.no()\n  self.r.find(1); self.r.find(2)\n"
    twin = "class B:\n class A:\n  def __init__(self, q: Q):\n   self.q = q\n  def run(self):\n   self.q.x()\nclass A:\n def run(self):\n  self.q.x()\n"
    files = [("r", "pkg/api.py", "import a\nrouter = x\nother = y\n@router.get('/')\ndef one(): pass\n@router.post\nasync def two(): pass\n@nothing.get\ndef three(): pass\n@other.thing\ndef four(): pass\n@router.get('/again')\n@router.post\ndef one(): pass\n"),
             ("r", "app.py", "from pkg.api import router, other as o\nfrom . import gone\ndef build():\n def inner():\n  include_router(router)\n app.include_router(o)\n app.include_router(pkg.router)\n app.include_router(gone)\n"),
             ("r", "tests/test_app.py", "from pkg.api import router as q\nclass T:\n def m(self):\n  self.x.include_router(q, 1)\n"), ("other", "app.py", "from pkg.api import router\ndef f():\n include_router(router)\n"), ("r", "s.py", service), ("r", "t.py", twin), ("r", "bad.py", "def f(:"), ("r", "null.py", None)]
    found = P.facts(spark.createDataFrame(files, "repo_root string, relative_path string, text string").repartition(3))
    calls = {(r.relative_path, r.evidence.removeprefix("python_"), r.from_symbol, r.to_symbol, r.line, r.confidence, r.scope) for r in P.call_edges(found).collect()}
    assert calls == {("pkg/api.py", "route_decorator", d, f, n, 0.8, "production") for d, f, n in (("router.get", "one", 5), ("router.post", "two", 7), ("nothing.get", "three", 9), ("router.get", "one", 14), ("router.post", "one", 14))} | {
        ("s.py", "bound_attribute_call", "A.run", t, n, 0.9, "production") for t, n in (("Repo.find", 7), ("make.go", 7), ("Repo.find", 9))} | {("t.py", "bound_attribute_call", "A.run", "Q.x", 6, 0.9, "production")}
    routers = lambda scope: {(r.relative_path, r.from_symbol, r.to_symbol, r.line, r.confidence, r.scope) for r in P.router_edges(found, scope).collect()}
    production = {("app.py", "build", x, 5, 0.75, "production") for x in ("one", "two")}
    assert routers("production") == production and routers("tests") == set()
    assert routers("all") == production | {("tests/test_app.py", "T.m", x, 4, 0.75, "tests") for x in ("one", "two")}


def test_protocols_equal_all_pairs(spark):
    rng, files, classes = random.Random(6), [], []
    methods = ["load(self, key)", "load(self, name)", "save(self, key, *, force)", "save(self, key)", "drop(self)", "_private(self)", "common(self)"]

    def source(name, bases, some):
        return f"class {name}({', '.join(bases)}):\n" + "".join(f" def {m}: ...\n" for m in some) + " x = 1\n"

    for i, path in enumerate(["core/ports.py", "my_ports.py", "a.py", "b.py", "lib/c.py", "tests/ports.py", "build/d.py", "ports.pyx", "supports.py"]):
        text = ""
        for j in range(8):
            bases = rng.sample(["Base", "x.Store0", "Store1[int]", "Protocol" if i < 3 else "Other", "typing.Protocol[T]" if i < 2 else "Other2"], rng.randrange(0, 3))
            some = rng.sample(methods, rng.randrange(0, 4))
            name = f"Store{j % 4}" if i < 2 else f"C{j}"
            line = text.count("\n") + 1
            text += source(name, bases, some)
            tails = [re.sub(r"\[.*", "", b).split(".")[-1] for b in bases]
            own = {m.split("(")[0]: m for m in some if m[0] != "_"}
            if path in ("core/ports.py", "my_ports.py", "a.py", "b.py", "lib/c.py", "supports.py"):
                classes.append((path, name, line, tails, own))
        files.append(("r", path, text))
    expected = set()
    ports = [c for c in classes if "Protocol" in c[3] and re.search(r"(^|/)([^/]*_)?ports\.py$", c[0])]
    for (_, p, _, _, need), (path, name, line, tails, own) in itertools.product(ports, classes):
        if "Protocol" not in tails:
            if p in tails:
                expected.add((p, path, name, line, "python_protocol_base", 0.9))
            elif need and need.items() <= own.items():
                expected.add((p, path, name, line, "python_structural_protocol_match", 0.8))
    found = P.protocol_implementations(P.class_specs(spark.createDataFrame([*files, ("r", "bad.py", "class A(:"), ("r", "null.py", None)], "repo_root string, relative_path string, text string")))
    rows = [(r.protocol, r.relative_path, r.name, r.line, r.evidence, r.confidence) for r in found.collect()]
    assert sorted(rows) == sorted(expected) and {x[4] for x in rows} == {"python_protocol_base", "python_structural_protocol_match"}
    none = spark.createDataFrame([], "repo_root string, relative_path string, name string, line int")
    some = P.implementations(none, found, "Store0", 3).collect()
    assert len(some) == min(3, len([x for x in expected if x[0] == "Store0"])) and [r.confidence for r in some] == sorted((r.confidence for r in some), reverse=True)
    one = spark.createDataFrame([("r", "z.py", "Store0Impl", 4)], none.schema)
    assert [r.name for r in P.implementations(one, found, "Store0", 3).collect()] == ["Store0Impl"]
