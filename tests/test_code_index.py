"""Readers of source files, and an index of code kept up to date."""

import random
import time

from pyspark.sql import functions as F

from palimpsest.operators import codebase as B
from palimpsest.sources import code
from palimpsest.sources.braces import read_go, read_script
from palimpsest.workspace import Workspace

TS = """import x from 'left-pad'
import { a, b as c } from "./y";
import type { T } from '../types'
export * from './all'
const y = require("./y2"), z = await import('./z')

/**
 * A nest.
 * @param eggs how many
 */
@Injectable({ a: `x${1}` })
export default class Nest<T extends { a: string }> extends Base<T> implements I {
  private eggs = 0 // {
  readonly rule = /[/}"']+/g;
  constructor(private readonly a: string, b = 5) { super(a); this.warm() }
  /** hatches */
  public async hatch(
    n: number,
    opts: { deep: boolean, list: Array<string> } = {},
    ...rest: string[]
  ): Promise<Map<string, number>> {
    this.warm(n)
    log.info(`}' ${fan(`${inner(1)} }`)} `)
    if (a && b || c) { for (;;) {} }
    return x ? y : z
  }
  static get size(): number { return this.eggs / 2 / this.two() }
  cool = async (t: T): Promise<void> => {
    fan(t)
  }
  short = (q) => q + walk(q)
  #secret() { return 1 }
  over(a: string): void
  over(a: any) { a?.b?.go(a) }
}
export function* walk<T>(a, { b, c } = {}, [d] = []) { step(a); function inner2() { deep() } }
const arrow = (q) => {
  return /}/.test(q) ? make(q) : new Thing(q);
};
let f1 = function named(x) { return x }, f2 = async y => await go(y), f3 = 5
export const handler: Handler = async (event, ctx) => ({ ok: run(event) })
app.get("/x", (req, res) => { res.send(1) })
"""


def test_script_symbols():
    symbols, calls, imports = read_script("a.ts", TS)
    got = {s.qualified_name: (s.signature, s.start_line, s.end_line, s.parameters) for s in symbols}
    assert got == {
        "Nest": ("class Nest extends Base<T> implements I", 12, 35, ["constructor", "hatch", "size", "#secret", "over"]),
        "Nest.constructor": ("constructor(a: string, b = ...)", 15, 15, ["a", "b"]),
        "Nest.hatch": ("async hatch(n: number, opts: { deep: boolean, list: Array<string> } = ..., ...rest: string[]): Promise<Map<string, number>>", 17, 26, ["n", "opts", "...rest"]),
        "Nest.size": ("get static size(): number", 27, 27, []),
        "Nest.cool": ("const cool = async (t: T): Promise<void> => ...", 28, 30, ["t"]),
        "Nest.short": ("const short = (q) => ...", 31, 31, ["q"]),
        "Nest.#secret": ("#secret()", 32, 32, []),
        "Nest.over": ("over(a: any)", 34, 34, ["a"]),
        "walk": ("function walk(a, { b, c } = ..., [d] = ...)", 36, 36, ["a", "{ b, c }", "[d]"]),
        "inner2": ("function inner2()", 36, 36, []),
        "arrow": ("const arrow = (q) => ...", 37, 39, ["q"]),
        "f1": ("const f1 = (x) => ...", 40, 40, ["x"]),
        "f2": ("const f2 = async (y) => ...", 40, 40, ["y"]),
        "handler": ("const handler = async (event, ctx) => ...", 41, 41, ["event", "ctx"]),
    }
    by = {s.qualified_name: s for s in symbols}
    assert by["Nest"].docstring == "A nest.\n@param eggs how many" and by["Nest.hatch"].docstring == "hatches" and by["Nest.hatch"].complexity == 6
    assert {n for n, s in by.items() if s.is_entrypoint} == {"Nest", "handler"} and {n for n, s in by.items() if not s.is_public} == {"Nest.#secret"}
    assert {(a, b) for _, a, b in calls} == {
        ("constructor", "warm"), ("hatch", "warm"), ("hatch", "log.info"), ("hatch", "fan"), ("hatch", "inner"), ("size", "two"), ("cool", "fan"), ("short", "walk"),
        ("over", "a.b.go"), ("walk", "step"), ("inner2", "deep"), ("arrow", "test"), ("arrow", "make"), ("f2", "go"), ("handler", "run"),
    }
    assert [m for _, m in imports] == ["left-pad", "./y", "../types", "./all", "./y2", "./z"]


def test_go_symbols():
    text = 'package p\nimport (\n\t"fmt"\n\tq "a/b"\n)\nimport "os"\n\n// Nest is a nest.\ntype Nest[T any] struct {\n\tEggs, Old int `json:"eggs"`\n\tsync.Mutex\n\t*Base\n\tFn func(a int) (struct{ X int }, error)\n}\ntype (\n\tA interface { Go(int) error }\n\tC = int\n)\n\nfunc (n *Nest[T]) Hatch(\n\tk, m int,\n\topts ...Option,\n) (res map[string]interface{}, err error) {\n\tx := \'{\'\n\tf := func(x int) int { return helper(x) }; f(1)\n\treturn nil, nil\n}\nfunc Map[K comparable, V any](m map[K]V, f func(K) V) []V { return pkg.Do(m)(1) }\nfunc TestIt() {}\nfunc external(int, string) error\n'
    symbols, calls, imports = read_go("b.go", text)
    assert [(s.qualified_name, s.symbol_type, s.signature, s.start_line, s.end_line, s.parameters, s.is_entrypoint) for s in symbols] == [
        ("Nest", "class", "type Nest struct", 9, 14, ["Eggs", "Old", "Fn"], False),
        ("A", "class", "type A interface", 16, 16, [], False),
        ("Nest.Hatch", "method", "func Hatch(k, m int, opts ...Option) (res map[string]interface{}, err error)", 20, 27, ["k", "m", "opts"], False),
        ("Map", "function", "func Map(m map[K]V, f func(K) V) []V", 28, 28, ["m", "f"], False),
        ("TestIt", "function", "func TestIt()", 29, 29, [], True),
    ]
    assert symbols[0].docstring == "Nest is a nest."
    assert {(a, b) for _, a, b in calls} == {("Hatch", "helper"), ("Hatch", "f"), ("Map", "Do")} and [m for _, m in imports] == ["fmt", "a/b", "os"]


def test_broken_files_take_no_long_time():
    for bad in ("'" * 200_000, "`${" * 50_000, "/" * 100_000, "({[" * 20_000, "/*" * 100_000, "<" * 100_000, "'\\\\" * 50_000, "const a = " * 10_000, "class A { " * 20_000, "class A<" * 5_000, "import (" * 10_000, "func (" * 10_000, "from " * 10_000, "({)" * 20_000):
        for read in (read_script, read_go):
            began = time.time()
            read("x", bad)
            assert time.time() - began < 5, bad[:12]


def test_odd_files(spark):
    rows = [("a.py", "python", None), ("b.py", "python", ""), ("c.py", "python", "def f(:"), ("d.rs", "rust", "fn main() {}"), (None, "go", "func main() {}"), ("e.py", "python", "x = '" + "y" * 300_000 + "'"), ("f.js", "javascript", "\x00 class {"), ("g.py", "python", "a\x00b")]
    files = spark.createDataFrame(rows, "file_path string, language string, content string")
    got = {r["file_path"]: (len(r["symbols"]), r["error"] is not None) for r in code.parsed(files).collect()}
    assert got == {"a.py": (0, False), "b.py": (0, False), "c.py": (0, True), "d.rs": (0, False), None: (1, False), "e.py": (0, False), "f.js": (0, False), "g.py": (0, True)}
    assert {r["file_path"] for r in code.parse(files).where("error IS NOT NULL").collect()} == {"c.py", "g.py"}


def rows_of(df, *without):
    return sorted((tuple(str(x) for x in r) for r in df.drop(*without).collect()))


def test_edges_after_any_edits_equal_a_rebuild(spark):
    """Files come, change and go; names are defined twice, moved and removed."""
    r = random.Random(1)

    def content(language):
        names, called, modules = ([f"n{r.randrange(12)}" for _ in range(3)] for _ in range(3))
        if language == "python":
            return "\n" * r.randrange(3) + "".join(f"import d.{m}\n" for m in modules) + "".join(f"def {n}():\n    {c}()\n" for n, c in zip(names, called, strict=True)) + f"class {names[0].upper()}:\n    def {called[0]}(self): return {called[1]}(1)\n"
        if language == "go":
            return "".join(f"func {n}() {{ {c}() }}\n" for n, c in zip(names, called, strict=True))
        return "".join(f"function {n}() {{ {c}() }}; " for n, c in zip(names, called, strict=True))

    ends = {"python": ".py", "go": ".go", "javascript": ".js"}
    tree, state = {}, B.empty_index(spark)
    for step in range(4):
        for path in r.sample(sorted(tree), min(len(tree), 4)):
            tree.pop(path)
        for _ in range(8 if step else 14):
            language = r.choice(["python", "python", "go", "javascript"])
            path = r.choice([f"d/n{r.randrange(12)}{ends[language]}", f"d/n{r.randrange(12)}/__init__.py" if language == "python" else f"e{r.randrange(9)}{ends[language]}"])
            tree[path] = (language, content(language))
        files = spark.createDataFrame([(p, *c) for p, c in tree.items()], "file_path string, language string, content string")
        work = Workspace(spark, f"index-{step}")
        before = {x["file_path"]: x["content_hash"] for x in state.files.collect()}
        state, audit = B.scan(files, state, work)
        whole = B.scan(files, B.empty_index(spark))[0]
        for name, without in (("files", ()), ("symbols", ("summary", "embed")), ("call_names", ()), ("import_names", ()), ("calls", ()), ("imports", ())):
            assert rows_of(getattr(state, name), *without) == rows_of(getattr(whole, name).select(*getattr(state, name).columns), *without), (step, name)
        # what was parsed is what changed, once each
        now = {x["file_path"]: x["content_hash"] for x in state.files.collect()}
        changed = sorted(p for p, h in now.items() if before.get(p) != h)
        assert sorted(x["file_path"] for x in work.load("parsed").collect()) == changed
        counts = audit.head()
        assert (counts["files_processed"], counts["files_unchanged"], counts["files_deleted"]) == (len(changed), len(now) - len(changed), len(before.keys() - now.keys()))
        assert "Arrow" not in state.calls._jdf.queryExecution().toString() + state.symbols._jdf.queryExecution().toString()
    assert state.calls.count() and state.imports.count() and state.calls.where("is_ambiguous").count()


def test_summaries_are_kept_where_code_is(spark):
    at = lambda text: spark.createDataFrame([("a.py", "python", text), ("b.go", "go", None)], "file_path string, language string, content string")
    first = B.scan(at("def f():\n    return 1\n\ndef g(x): pass\n"), B.empty_index(spark))[0]
    named = B.Index(first.files, first.symbols.withColumn("summary", F.lit("by a model")), first.call_names, first.import_names, first.calls, first.imports)
    second, audit = B.scan(at("def f():\n    return 1\n\ndef g(y): pass\n"), named)
    assert {(r["symbol_name"], r["summary"], r["embed"]) for r in second.symbols.collect()} == {("f", "by a model", False), ("g", "function g(y)", True)}
    assert audit.head().asDict() == {"files_processed": 1, "files_unchanged": 1, "files_deleted": 0, "symbols_indexed": 1, "symbols_deleted": 0, "parse_errors": 0}


def test_dropping_a_repository(spark):
    table = lambda: spark.createDataFrame([("o", "a", 1), ("o", "b", 2), (None, "a", 3)], "org_id string, repo string, n int")
    left = B.drop_repo(B.Index(*[table() for _ in range(6)]), "o", "a")
    assert all([r["n"] for r in t.orderBy("n").collect()] == [2, 3] for t in (left.files, left.symbols, left.call_names, left.import_names, left.calls, left.imports))


def test_symbols_need_their_file(spark):
    symbols = spark.createDataFrame([("a.py", "f"), ("b.py", "g"), (None, "h")], "file_path string, qualified_name string")
    files = spark.createDataFrame([("a.py",), ("a.py",), (None,)], "file_path string")
    assert [r["qualified_name"] for r in B.with_files(symbols, files).collect()] == ["f"]


def test_files_of_one_partition_are_parsed_by_many_tasks(spark):
    files = spark.createDataFrame([(f"m{i}.py", "python", f"def f{i}():\n    return f{i + 1}()\n") for i in range(40)], "file_path string, language string, content string").coalesce(1)
    rows = code.parsed(files)
    assert rows.rdd.getNumPartitions() > 1 and rows.count() == 40


def test_edges_by_one_reading_of_the_files(spark, monkeypatch):
    files = spark.createDataFrame([("a.py", "python", "import b\ndef f():\n    return g()\n"), ("b.py", "python", "def g(): pass\n"), ("c.py", "python", "def (")], "file_path string, language string, content string")
    given = [[tuple(r) for r in e.collect()] for e in B.edges_of(files, code.parse(files))]
    read, parsed = [], code.parsed
    monkeypatch.setattr(code, "parsed", lambda x: read.append(1) or parsed(x))
    own = [[tuple(r) for r in e.collect()] for e in B.edges_of(files)]
    assert own == given == [[("a.py", "f", "b.py", "g", False)], [("a.py", "b.py")]] and len(read) == 1


def test_counts_of_a_scan_need_no_edges(spark):
    import os

    files = lambda n: spark.createDataFrame([(f"m{i}.py", "python", f"def f{i}():\n    return {i * n}\n") for i in range(n)], "file_path string, language string, content string")
    none, works = B.empty_index(spark), [Workspace(spark, "counts") for _ in range(2)]
    old = B.scan_symbols(files(4), none.files, none.symbols, works[0])
    now = B.scan_symbols(files(3), old.files, old.symbols, works[1])
    assert now.audit.head() == B.scan(files(3), B.scan(files(4), none)[0])[1].head() and now.audit.head()["symbols_indexed"] == 2
    assert {x for x in os.listdir(works[1].at.removeprefix("file://")) if "call" in x or "import" in x} == set()


def test_nested_functions_count_what_is_inside_them():
    text = "def a(x=h()):\n    def b():\n        if x and y and z: c(); self.d()\n        import q.r\n    class K:\n        async def e(self): [f() for i in j]; a()\n    return a()\n"
    from palimpsest.sources.python import read_python

    symbols, calls, imports = read_python("m.py", text)
    assert [(s.symbol_name, s.complexity) for s in symbols] == [("a", 4)] and imports == [("m.py", "q.r")]
    assert calls == [("m.py", "a", x) for x in ("c", "d", "f", "h")] + [("m.py", "b", "c"), ("m.py", "b", "d"), ("m.py", "e", "a"), ("m.py", "e", "f")]
