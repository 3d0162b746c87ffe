"""Ignore rules against a matcher that walks pattern and path part by part."""

import fnmatch
import itertools

from tessera.operators import collect


def walk(pattern, path):
    """Whether the parts of a pattern match all parts of a path."""
    if not pattern:
        return not path
    if pattern[0] == "**":
        return bool(path) if len(pattern) == 1 else any(walk(pattern[1:], path[i:]) for i in range(len(path) + 1))
    return bool(path) and fnmatch.fnmatchcase(path[0], pattern[0]) and walk(pattern[1:], path[1:])


def plain(lines, path):
    """None: no line says anything; else whether the last that matches leaves the path out."""
    verdict = None
    for line in lines:
        if not line or line.startswith("#"):
            continue
        back, text = line.startswith("!"), line.removeprefix("!").rstrip(" ")
        folder, body = text.endswith("/"), text.strip("/").split("/")
        parts = path.split("/")
        heads = [parts[:n] for n in range(1, len(parts) + (not folder))]
        tied = text.startswith("/") or len(body) > 1
        if any(walk(body if tied else ["**", *body], h) for h in heads):
            verdict = not back
    return verdict


PATTERNS = ["*.lock", "!keep.lock", "/build", "build/", "docs/**", "**/gen", "a/**/z", "src/*.py", "# note", "", "te?t", "[ab]x", "[!ab]y", "**/x/y.py", "/a/b/", "*", "!*/", "!*.py", "deep/er", "x.y", "b  "]
PATHS = ["/".join(p) for n in (1, 2, 3) for p in itertools.product(("a", "b", "build", "docs", "src", "z", "x"), repeat=n - 1)] + [""]
PATHS = [f"{d}/{f}".strip("/") for d in PATHS for f in ("keep.lock", "t.lock", "m.py", "gen", "test", "ax", "cy", "y.py", "z", "xzy", "b")] + ["deep/er/m.py", "no/deep/er/m.py", "src/in/m.py"]


def test_rules_equal_the_walk(spark):
    sets = [[p] for p in PATTERNS] + [["*.lock", "!keep.lock", "/build"], ["build/", "!build/m.py", "docs/**"], ["*", "!*.py", "src/*.py"], ["!keep.lock", "*.lock"]]
    files = spark.createDataFrame([(f"r{i}", p) for i in range(len(sets)) for p in PATHS], "repo_root string, relative_path string")
    ignores = spark.createDataFrame([(f"r{i}", "", "\n".join(s)) for i, s in enumerate(sets)], "repo_root string, folder string, text string")
    found = {tuple(r) for r in collect.ignored(files, ignores).collect()}
    assert found == {(f"r{i}", p) for i, s in enumerate(sets) for p in PATHS if plain(s, p)} and len(found) > 1000


def test_folders_inherit_and_reasons_come_in_order(spark):
    ignores = [("r", "", "*.tmp\n/out/"), ("r", "a", "!b/*.tmp\nx.py"), ("r", "a/b", "c.tmp\n\\#odd.py\n\\!odd.py\n"), ("other", "", "*"), ("r", "none", None)]
    rows = [("r", "q.tmp", 1, "ignored"), ("r", "a/q.tmp", 1, "ignored"), ("r", "a/b/q.tmp", 1, "extension"), ("r", "a/b/c.tmp", 1, "ignored"), ("r", "x.py", 1, None), ("r", "a/d/x.py", 1, "ignored"), ("r", "out/m.py", 1, "ignored"), ("r", "a/out/m.py", 1, None),
            ("r", "a/b/#odd.py", 1, "ignored"), ("r", "a/b/!odd.py", 1, "ignored"), ("r", "big.py", 600_000, "size"), ("r", "q.tmp2", None, "extension"), ("r", ".git/m.py", 1, "hidden"), ("r", "a/.m.py", 1, "hidden"), ("/h/.c", "m.py", 1, "hidden"), ("r", "M.PY", 1, None), ("r", "py", 1, "extension"), ("r", "vendor/m.py", 1, "excluded"), ("r", "vendor/ok/m.py", 1, None), ("s", "m.py", 0, None)]
    files = spark.createDataFrame([r[:3] for r in rows], "repo_root string, relative_path string, size_bytes bigint").repartition(3)
    rules = spark.createDataFrame(ignores, "repo_root string, folder string, text string")
    got = collect.collectible(files, rules, (".py",), ("vendor/**", "!vendor/ok/**"))
    assert {tuple(r) for r in got.select("repo_root", "relative_path", "size_bytes", "reason").collect()} == set(rows)
    assert collect.collectible(files, rules.limit(0), (".py",)).where("reason = 'ignored'").count() == 0
    assert collect.collectible(files.limit(0), rules, (".py",)).collect() == []
