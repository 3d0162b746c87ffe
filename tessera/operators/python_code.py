"""Call edges and protocol implementations of Python sources: small facts by a syntax walk, everything between them by joins."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.shared import materialize

#: The confidence of each kind of evidence.
CONFIDENCE = {"python_route_registration": 0.9, "python_route_decorator": 0.8, "python_mcp_dispatch": 0.85, "python_bound_attribute_call": 0.9, "python_registry_dispatch": 0.8, "python_include_router": 0.75, "python_protocol_base": 0.9, "python_structural_protocol_match": 0.8}
#: Decorators that make a function an endpoint.
VERBS = ("get", "post", "put", "delete", "patch", "route", "websocket")
#: Names under which a route class is called.
ROUTES = ("Route", "routing.Route", "starlette.routing.Route")

#: owner: a function, class or decorator; at: the line of the class, 0 outside classes.
FACTS = "fact string, owner string, name string, target string, line int, at int"
_FUNCTION = (ast.FunctionDef, ast.AsyncFunctionDef)


def dotted(node: ast.AST, calls: bool = True) -> str:
    """a.b.c of a name with attributes, subscripts and (if wanted) calls stripped; what stands before the first name that is none is left out."""
    parts: list[str] = []
    while not isinstance(node, ast.Name):
        if isinstance(node, ast.Attribute):
            parts.append(node.attr)
        elif not isinstance(node, ast.Subscript) and not (calls and isinstance(node, ast.Call)):
            break
        node = node.func if isinstance(node, ast.Call) else node.value
    return ".".join(reversed([*parts, *([node.id] if isinstance(node, ast.Name) else [])]))


def tail(name: str) -> str:
    return name[name.rfind(".") + 1 :]


def _own(node: ast.AST) -> str:
    """The attribute of self.attribute."""
    return node.attr if isinstance(node, ast.Attribute) and isinstance(node.value, ast.Name) and node.value.id == "self" else ""


def _calls(node: ast.AST) -> Iterator[ast.Call]:
    return (x for x in ast.walk(node) if isinstance(x, ast.Call))


def _parsed(text: str | None) -> ast.Module | None:
    try:
        return ast.parse(text or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def _module_facts(tree: ast.Module) -> Iterator[tuple]:
    """Top-level names, imported names, decorators, registrations and inclusions of routers."""
    callables = [(f.name, f) for f in tree.body if isinstance(f, _FUNCTION)]
    for node in tree.body:
        if isinstance(node, ast.Assign):
            yield from (("assigned", "", t.id, "", node.lineno) for t in node.targets if isinstance(t, ast.Name))
        elif isinstance(node, ast.ImportFrom) and node.module:
            yield from (("imported", "", a.asname or a.name, f"{node.module}:{a.name}", node.lineno) for a in node.names)
        elif isinstance(node, ast.ClassDef):
            callables += [(f"{node.name}.{f.name}", f) for f in node.body if isinstance(f, _FUNCTION)]
    for name, f in callables:
        if "." not in name:
            yield from (("decorated", d, name, "", f.lineno) for d in map(dotted, f.decorator_list) if d)
        for call in _calls(f):
            called = dotted(call.func)
            if tail(called) == "include_router" and call.args and isinstance(call.args[0], ast.Name):
                yield "included", name, call.args[0].id, "", call.lineno
            elif called in ROUTES or called.endswith(".Route") or tail(called) == "add_api_route":
                named = [dotted(k.value) for k in call.keywords if k.arg == "endpoint"][:1]
                target = (dotted(call.args[1]) if len(call.args) > 1 else "") or "".join(named)
                if target:
                    yield "python_route_registration", name, "", tail(target), call.lineno


class _Bindings:
    """What a class's constructor binds to its attributes: made objects, typed arguments, tables of handlers."""

    def __init__(self, node: ast.ClassDef):
        makers = [f for f in node.body if isinstance(f, ast.FunctionDef) and f.name == "__init__"]
        self.made, self.types, self.tables = {}, {}, {}
        for statement in (s for f in makers for s in f.body if isinstance(s, ast.Assign)):
            if len(statement.targets) == 1 and isinstance(statement.value, ast.Call) and _own(statement.targets[0]) and (made := dotted(statement.value.func)):
                self.made[_own(statement.targets[0])] = tail(made)
        arguments, body = (makers[0].args.args, makers[0].body) if makers else ([], [])
        typed = {a.arg: tail(dotted(a.annotation)) for a in arguments if a.arg != "self" and a.annotation is not None}
        for statement in body:
            for target in statement.targets if isinstance(statement, ast.Assign) else [statement.target] if isinstance(statement, ast.AnnAssign) else []:
                value = statement.value
                kind = typed.get(value.id, "") if isinstance(value, ast.Name) else tail(dotted(value.func)) if isinstance(value, ast.Call) else ""
                if _own(target) and kind:
                    self.types[_own(target)] = kind
        for statement in body:
            if isinstance(statement, ast.Assign) and len(statement.targets) == 1 and isinstance(statement.value, ast.Dict) and (name := _own(statement.targets[0])):
                pairs = ((k.value, self._handler(v)) for k, v in zip(statement.value.keys, statement.value.values, strict=True) if isinstance(k, ast.Constant) and isinstance(k.value, str) and k.value)
                if table := {k: v for k, v in pairs if v}:
                    self.tables[name] = table

    def _handler(self, node: ast.AST) -> str:
        if not isinstance(node, ast.Attribute):
            return tail(dotted(node))
        owner = dotted(node.value)
        kind = self.types.get(owner[5:], "") if owner.startswith("self.") else ""
        return ".".join(x for x in (kind or tail(owner), node.attr) if x)


def _class_facts(node: ast.ClassDef) -> Iterator[tuple]:
    """Bindings, and calls by self, by local names and by tables of handlers."""
    bound = _Bindings(node)
    yield from (("bound", node.name, attr, kind, node.lineno) for attr, kind in bound.types.items())
    for f in (f for f in node.body if isinstance(f, ast.FunctionDef)):
        owner, objects, tables, handlers = f"{node.name}.{f.name}", {}, {}, {}

        def chosen(x: ast.AST, tables=tables) -> str:
            """The handler that a subscript of a table names."""
            if not isinstance(x, ast.Subscript):
                return ""
            table = tables.get(x.value.id) if isinstance(x.value, ast.Name) else bound.tables.get(_own(x.value))
            key = x.slice.value if isinstance(x.slice, ast.Constant) and isinstance(x.slice.value, str) else ""
            return "" if not table else table.get(key, "") if key else next(iter(table.values())) if len(table) == 1 else ""

        for statement in f.body:
            if isinstance(statement, ast.Assign) and len(statement.targets) == 1 and isinstance(statement.targets[0], ast.Name):
                local, attr = statement.targets[0].id, _own(statement.value)
                objects |= {local: bound.made[attr]} if attr in bound.made else {}
                tables |= {local: bound.tables[attr]} if attr in bound.tables else {}
                handlers |= {local: found} if (found := chosen(statement.value)) else {}
            for call in _calls(statement):
                at = call.func
                if isinstance(at, ast.Attribute) and at.attr == "call":
                    made = objects.get(at.value.id, "") if isinstance(at.value, ast.Name) else bound.made.get(_own(at.value), "")
                    if made:
                        yield "python_mcp_dispatch", owner, "", f"{made}.call", call.lineno
                if found := handlers.get(at.id, "") if isinstance(at, ast.Name) else chosen(at):
                    yield "python_registry_dispatch", owner, "", found, call.lineno
        if f.name != "__init__":
            for call in _calls(f):
                if isinstance(call.func, ast.Attribute) and (attr := _own(call.func.value)):
                    yield "called", owner, attr, call.func.attr, call.lineno


def code_facts(text: str | None) -> list[tuple]:
    tree = _parsed(text)
    return [] if tree is None else [*((*x, 0) for x in _module_facts(tree)), *((*x, c.lineno) for c in ast.walk(tree) if isinstance(c, ast.ClassDef) for x in _class_facts(c))]


def facts(files: DataFrame) -> DataFrame:
    """(repo_root, relative_path, fact, owner, name, target, line, at) of Python files (repo_root, relative_path, text), as a
    written table: every file is parsed once, whatever joins follow. Files that do not parse have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(r, p, *x) for r, p, t in zip(batch["repo_root"], batch["relative_path"], batch["text"], strict=True) for x in code_facts(t)]
            yield pd.DataFrame(rows, columns=["repo_root", "relative_path", "fact", "owner", "name", "target", "line", "at"])

    return materialize(files.select("repo_root", "relative_path", "text").mapInPandas(run, f"repo_root string, relative_path string, {FACTS}"), "facts")


def scope_of(path: Column) -> Column:
    """tests or production."""
    low = F.lower(F.trim(F.replace(path, F.lit("\\"), F.lit("/"))))
    return F.when(F.regexp_like(low, F.lit(r"(^|/)tests?(/|$)|(^|/)test_[^/]*$|_(test|spec)\.py$")), "tests").otherwise("production")


_EDGE = ["repo_root", "relative_path", "from_symbol", "to_symbol", "line", "evidence"]


def _edges(rows: DataFrame, owner: Column, target: Column, evidence: Column) -> DataFrame:
    return rows.select("repo_root", "relative_path", owner.alias("from_symbol"), target.alias("to_symbol"), "line", evidence.alias("evidence"))


def _weighed(edges: DataFrame) -> DataFrame:
    confidence = F.create_map(*(F.lit(x) for kv in CONFIDENCE.items() for x in kv))[F.col("evidence")]
    return edges.distinct().withColumn("confidence", confidence).withColumn("scope", scope_of(F.col("relative_path")))


def call_edges(found: DataFrame) -> DataFrame:
    """Edges within files, from facts(): registrations, decorators, dispatches, handler tables and calls of bound attributes, each
    once, with evidence, confidence and scope. A class's bindings meet its calls in a join."""
    fact = lambda *names: found.where(F.col("fact").isin(*names))
    direct = fact("python_route_registration", "python_mcp_dispatch", "python_registry_dispatch")
    direct = _edges(direct, F.col("owner"), F.col("target"), F.col("fact"))
    routes = _edges(fact("decorated").where(F.substring_index("owner", ".", -1).isin(*VERBS)), F.col("owner"), F.col("name"), F.lit("python_route_decorator"))
    file = ["repo_root", "relative_path"]
    bound = fact("bound").select(*file, "at", "name", F.col("target").alias("kind"))
    called = fact("called").join(bound, [*file, "at", "name"])
    called = _edges(called, F.col("owner"), F.concat_ws(".", "kind", "target"), F.lit("python_bound_attribute_call"))
    return _weighed(direct.unionByName(routes).unionByName(called))


def router_edges(found: DataFrame, scope: str = "production") -> DataFrame:
    """Edges across files: who includes a router reaches the endpoints that its module hangs on it, where the include's
    argument is a name imported from there. scope: all, tests or production files on both sides."""
    file = ["repo_root", "relative_path"]
    t = found if scope == "all" else found.where(scope_of(F.col("relative_path")) == scope)
    fact = lambda name: t.where(F.col("fact") == name)
    last = fact("imported").groupBy(*file, "name").agg(F.max_by("target", "line").alias("ref"))
    module = F.replace(F.regexp_replace("relative_path", r"...$", ""), F.lit("/"), F.lit("."))
    hung = fact("decorated").where(F.contains("owner", F.lit(".")) & F.substring_index("owner", ".", -1).isin(*VERBS)).select(*file, F.substring_index("owner", ".", 1).alias("router"), F.col("name").alias("endpoint"))
    exports = hung.join(fact("assigned").select(*file, F.col("name").alias("router")), [*file, "router"], "left_semi").select("repo_root", F.concat_ws(":", module, "router").alias("ref"), "endpoint")
    includes = fact("included").join(last, [*file, "name"]).select(*file, "owner", "line", "ref")
    return _weighed(_edges(includes.join(exports.distinct(), ["repo_root", "ref"]), F.col("owner"), F.col("endpoint"), F.lit("python_include_router")))


# --- protocols

_CLASS = "name string, line int, end_line int, bases array<string>, methods array<struct<name: string, positional: array<string>, keywords: array<string>>>"


def class_specs(files: DataFrame) -> DataFrame:
    """(repo_root, relative_path, name, line, end_line, bases, methods, is_protocol) of the classes of Python files, but tests,
    builds and environments. Public methods, the last of a name, with the names of their arguments behind the first."""
    low = F.lower(F.replace("relative_path", F.lit("\\"), F.lit("/")))
    kept = ~F.regexp_like(low, F.lit(r"(^|/)(tests|site-packages|build|dist|venv|\.venv[^/]*)(/|$)|(^|/)test_[^/]*$|_test\.py$")) & F.endswith(low, F.lit(".py"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for root, path, text in zip(batch["repo_root"], batch["relative_path"], batch["text"], strict=True):
                for c in ast.walk(_parsed(text) or ast.Module([], [])):
                    if isinstance(c, ast.ClassDef):
                        public = {f.name: f.args for f in c.body if isinstance(f, _FUNCTION) and f.name[0] != "_"}
                        methods = [(name, [x.arg for x in a.args[1:]], [x.arg for x in a.kwonlyargs]) for name, a in public.items()]
                        rows.append((root, path, c.name, c.lineno, c.end_lineno, [b for b in (dotted(x, False) for x in c.bases) if b], [dict(zip(("name", "positional", "keywords"), m, strict=True)) for m in methods]))
            yield pd.DataFrame(rows, columns=["repo_root", "relative_path", "name", "line", "end_line", "bases", "methods"])

    found = materialize(files.where(kept).select("repo_root", "relative_path", "text").mapInPandas(run, f"repo_root string, relative_path string, {_CLASS}"), "classes")  # every file is parsed once
    tails = F.transform("bases", lambda x: F.substring_index(x, ".", -1))
    return found.withColumn("bases", tails).withColumn("is_protocol", F.array_contains("bases", "Protocol"))


def protocol_implementations(specs: DataFrame) -> DataFrame:
    """(repo_root, protocol, relative_path, name, line, end_line, evidence, confidence): the classes that name a protocol of their repository
    as a base, and those that have all its methods with the same arguments. Protocols are those of ports.py or *_ports.py.

    Containment is joined by each protocol's rarest method only, so a protocol meets the classes that have that one, not all; the
    rest of its methods is then compared. A class that names the protocol is not matched by methods too."""
    signature = F.transform("methods", lambda m: F.concat(m["name"], F.lit("("), F.array_join(m["positional"], ","), F.lit("*"), F.array_join(m["keywords"], ","), F.lit(")")))
    spec = ["relative_path", "name", "line", "end_line"]
    t = specs.withColumn("has", signature)
    ports = t.where(F.col("is_protocol") & F.regexp_like("relative_path", F.lit(r"(^|/)([^/]*_)?ports\.py$")))
    ports = ports.select("repo_root", F.col("name").alias("protocol"), F.concat_ws("@", "relative_path", "line").alias("id"), F.col("has").alias("needs")).distinct()
    classes = t.where(~F.col("is_protocol")).select("repo_root", *spec, "bases", "has")
    named = ports.select("repo_root", "protocol").distinct()
    nominal = classes.select("repo_root", *spec, F.explode(F.array_distinct("bases")).alias("protocol")).join(named, ["repo_root", "protocol"]).withColumn("evidence", F.lit("python_protocol_base"))
    each = classes.select("repo_root", *spec, "bases", "has", F.explode(F.array_distinct("has")).alias("method"))
    counts = each.groupBy("repo_root", "method").agg(F.count("*").alias("n"))
    needed = ports.select("repo_root", "protocol", "id", "needs", F.explode("needs").alias("method")).join(counts, ["repo_root", "method"], "left")
    rarest = needed.groupBy("repo_root", "protocol", "id", "needs").agg(F.min_by("method", F.struct(F.coalesce("n", F.lit(0)), "method")).alias("method"))
    holds = (F.size(F.array_except("needs", "has")) == 0) & ~F.array_contains("bases", F.col("protocol"))
    structural = each.join(rarest, ["repo_root", "method"]).where(holds).select("repo_root", *spec, "protocol").distinct().withColumn("evidence", F.lit("python_structural_protocol_match"))
    confidence = F.create_map(*(F.lit(x) for kv in CONFIDENCE.items() for x in kv))[F.col("evidence")]
    return nominal.unionByName(structural).select("repo_root", "protocol", *spec, "evidence", confidence.alias("confidence"))


def implementations(named: DataFrame, matches: DataFrame, name: str, limit: int) -> DataFrame:
    """Symbols whose name holds the asked one (`named`, already filtered); without any, the classes that implement the protocol of
    that name, nominal ones first. Both sides: repo_root, relative_path, name, line."""
    cols = ["repo_root", "relative_path", "name", "line"]
    first = named.select(*cols, F.lit("symbol").alias("evidence"), F.lit(0.0).alias("confidence")).orderBy("repo_root", "relative_path", "line", "name").limit(limit)
    any_ = first.limit(1).select(F.lit(1).alias("some"))  # one row, at most
    rest = matches.where(F.col("protocol") == name).select(*cols, "evidence", "confidence").join(F.broadcast(any_), F.expr("some = 1"), "left_anti")
    return first.unionByName(rest).orderBy(F.desc("confidence"), "repo_root", "relative_path", "line", "name").limit(limit)
