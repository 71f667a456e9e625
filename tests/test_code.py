import os
import random

import pytest
from pyspark.sql import functions as F

from lorespark.operators import codeintel, graph
from lorespark.sources import code, scopes


def rows_of(content, language, kind):
    return [r for r in code.extract(content, language) if kind in r[:2]]


def calls(content, language):
    """``callee: (caller, receiver, type of the receiver)``."""
    return {r[7]: (r[6], r[8], r[11]) for r in rows_of(content, language, "calls")}


def index(spark, root, files):
    for path, content in files.items():
        os.makedirs(os.path.dirname(f"{root}/{path}") or root, exist_ok=True)
        with open(f"{root}/{path}", "w") as f:
            f.write(content)
    at = f"file://{root}/../index-{os.path.basename(root)}"
    code.refresh(spark, str(root), at)
    return code.index_tables(spark, at)["edges"]


def edges_of(edges, edge_type, source_file=None):
    rows = edges.where(F.col("edge_type") == edge_type)
    rows = rows if source_file is None else rows.where(F.col("source_file") == source_file)
    return {(r["source_symbol"], r["target_file"], r["target_symbol"], r["line"], r["provenance"], tuple(r["via"])) for r in rows.collect()}


# ---- one file -----------------------------------------------------------------


def test_receivers_of_calls():
    rust = "use crate::lib::{Foo, bare};\npub fn caller() {\n    bare();\n    let x = Foo::assoc();\n    x.method();\n    let y = Foo::new();\n    y.other();\n    if a < b && c > d { }\n    k.lookup::<Row>(1);\n}\n"
    got = calls(rust, "rust")
    assert got["bare"] == ("caller", None, None) and got["assoc"] == ("caller", "Foo", "Foo") and got["method"][:2] == ("caller", "x")
    assert got["new"] == ("caller", "Foo", "Foo") and got["other"] == ("caller", "y", "Foo") and got["lookup"][1] == "k"
    ts = "function caller(): void {\n  standalone();\n  const svc = new Service();\n  svc.run();\n  NS.util();\n}\n"
    assert calls(ts, "typescript") == {"standalone": ("caller", None, None), "run": ("caller", "svc", "Service"), "util": ("caller", "NS", "NS")}
    python = "from lib import Svc, standalone\ndef caller():\n    standalone()\n    s = Svc()\n    s.run()\n"
    assert calls(python, "python") == {"standalone": ("caller", None, None), "Svc": ("caller", None, None), "run": ("caller", "s", "Svc")}
    go = 'package main\nimport "fmt"\ntype Svc struct{}\nfunc (s *Svc) Run() {}\nfunc standalone() {}\nfunc caller() {\n\tstandalone()\n\ts := &Svc{}\n\ts.Run()\n\tfmt.Println("hi(x)")\n}\n'
    assert calls(go, "go") == {"standalone": ("caller", None, None), "Run": ("caller", "s", "Svc"), "Println": ("caller", "fmt", "fmt")}
    assert [(r[1], r[2], r[6]) for r in rows_of(go, "go", "symbol")] == [("type", "Svc", None), ("method", "Run", "Svc"), ("function", "standalone", None), ("function", "caller", None)]


def test_types_of_parameters_fields_and_self():
    rust = "struct Repo { db: Box<Db> }\nimpl Repo {\n    fn find(&self, q: &Query) -> u32 { self.db.get(1); q.run(); self.help(); Self::make() }\n}\n"
    assert {k: v[2] for k, v in calls(rust, "rust").items()} == {"get": "Db", "run": "Query", "help": "Repo", "make": "Repo"}
    ts = "class A { constructor(private db: Db) {}\n  log: Logger = makeLogger();\n  m(q: Query) { this.db.find(); q.run(); this.log.info(); this.m(q) }\n  arrow = async (b: Bee) => { b.buzz() }\n}\n"
    assert {k: v[:1] + v[2:] for k, v in calls(ts, "typescript").items()} == {"makeLogger": (None, None), "find": ("m", "Db"), "run": ("m", "Query"), "info": ("m", "Logger"), "m": ("m", "A"), "buzz": ("arrow", "Bee")}
    shadowed = "fn f(x: Foo) { x.one(); let x = other(); x.two(); }\nfn g() { x.three(); }\n"
    assert {k: v[2] for k, v in calls(shadowed, "rust").items()} == {"one": "Foo", "other": None, "two": None, "three": None}


def test_callers_and_what_is_no_call():
    ts = 'const run = async (a) => { inner(a) }\nconst short = (b) => other(b).x;\nafter();\nlog("see bar(x)");\nconst t = `${deep(1)} no(2)`;\nconst r = /re(g)ex/.test(x);\nfunction f() { items.map(i => each(i)); function g() { low() } }\n'
    got = calls(ts, "typescript")
    assert {k: v[0] for k, v in got.items()} == {"inner": "run", "other": "short", "after": None, "log": None, "deep": None, "test": None, "map": "f", "each": "f", "low": "g"}
    rust = 'fn f() {\n    /* a /* nested() */ b() */\n    let s = r#"fn no() { g("x") }"#;\n    let c = \'{\';\n    println!("{}", h(1));\n    real();\n}\nmacro_rules! m { ($x:expr) => { w($x) } }\nfn after<\'a>(x: &\'a str) { last() }\n'
    assert {k: v[0] for k, v in calls(rust, "rust").items()} == {"real": "f", "last": "after"}
    assert [r[2] for r in rows_of(rust, "rust", "symbol")] == ["f", "m", "after"]
    go = 'package p\nfunc f() {\n\ts := `g("x")`\n\tgo func() { h() }()\n\t// no()\n}\n'
    assert calls(go, "go") == {"h": ("f", None, None)}


def test_bases():
    found = lambda src, lang: {(r[1], r[6], r[7]) for kind in ("inherits", "implements") for r in rows_of(src, lang, kind)}
    rust = "struct Foo;\nimpl Display for Foo { fn fmt(&self) {} }\nimpl std::fmt::Debug for Bar<T> {}\nimpl<T: Clone> From<T> for Baz {}\ntrait Base {}\ntrait Derived: Base + Send + 'static {}\nimpl Foo {}\nfn f(x: impl Fn(u8)) {}\n"
    assert found(rust, "rust") == {("implements", "Foo", "Display"), ("implements", "Bar", "Debug"), ("implements", "Baz", "From"), ("inherits", "Derived", "Base"), ("inherits", "Derived", "Send")}
    ts = "interface S extends Z<Q> { serialize(): string; }\nclass Dog<T> extends Animal implements D, E<F> { serialize() { return this.name; } }\nclass X extends mixin(Y) {}\n"
    assert found(ts, "typescript") == {("inherits", "S", "Z"), ("inherits", "Dog", "Animal"), ("implements", "Dog", "D"), ("implements", "Dog", "E"), ("inherits", "X", "mixin")}
    assert [(r[1], r[2]) for r in rows_of(ts, "typescript", "symbol")] == [("interface", "S"), ("class", "Dog"), ("method", "serialize"), ("class", "X")]
    assert found("class K(Base, mod.Other):\n    pass\n", "python") == {("inherits", "K", "Base"), ("inherits", "K", "Other")}


def test_references_have_a_context():
    refs = lambda src, lang: sorted((r[10], r[7]) for r in rows_of(src, lang, "references"))
    rust = "struct Config { name: MyType, n: u32, s: String }\nfn process(input: MyType, k: usize) -> OtherType {\n    let items: Vec<CustomType> = vec![];\n    items\n}\nfn plain() -> bool { a < b && c > d }\n"
    assert refs(rust, "rust") == [("field", "MyType"), ("generic_arg", "CustomType"), ("parameter_type", "MyType"), ("return_type", "OtherType")]
    ts = "class A { owner: Person; age: number }\nfunction f(x: MyType, y?: Other, z: string): Ret { const q: Map<Key, string> = make<Gen>(); }\nconst g = (b: Bee) => b;\n"
    assert refs(ts, "typescript") == [("field", "Person"), ("generic_arg", "Gen"), ("generic_arg", "Key"), ("parameter_type", "Bee"), ("parameter_type", "MyType"), ("parameter_type", "Other"), ("return_type", "Ret")]


def test_imported_names():
    names = lambda src, lang: [(r[1], r[2], r[8], r[10]) for r in rows_of(src, lang, "name")]
    assert names("use a::{b::C as D, self, e::*};\npub(crate) use super::x::Y;\n", "rust") == [("import", "D", "C", "a::b"), ("import", "a", "a", ""), ("import", "*", "*", "a::e"), ("reexport", "Y", "Y", "super::x")]
    assert names("import Def, { a as b, type C } from './m'\nimport * as ns from \"./n\"\nexport { A } from './r';\nexport * from './all';\n", "typescript") == [("import", "Def", "default", "./m"), ("import", "b", "a", "./m"), ("import", "C", "C", "./m"), ("import", "ns", "", "./n"), ("reexport", "A", "A", "./r"), ("reexport", "*", "*", "./all")]


@pytest.mark.parametrize("language", ["rust", "typescript", "go", "python", "svelte", "html"])
def test_odd_sources_do_not_break(language):
    rng = random.Random(language)
    parts = ["fn", "f", "(", ")", "{", "}", "<", ">", "::", ".", "'", '"', "`", "${", "/*", "*/", "//", "\n", "class", "impl", "for", "let", "x", "=", ":", ";", "=>", "r#\"", "use", "a", ",", "[", "]", "import", "é", "\\", "func", "type", "struct", "const", "async", "#", "@", "?", "!", "1.5"]
    for n in (0, 1, 5, 40, 300):
        for _ in range(25):
            code.extract(" ".join(rng.choice(parts) for _ in range(n)), language)
    assert code.extract("", language) == [] and code.extract(None, language) == []


def test_comments_are_blanked_in_place():
    src = 'a /* x\n y */ b // c\n"/* no */" d\n'
    for language in ("rust", "typescript", "go"):
        assert scopes.without_comments(src, language) == 'a     \n      b     \n"/* no */" d\n'
    assert scopes.without_comments("/* a /* b */ c */ d", "rust").strip() == "d"
    assert scopes.without_comments("/* a /* b */ c", "go").strip() == "c"


# ---- across files -------------------------------------------------------------


def test_calls_and_imports_reach_files(spark, tmp_path):
    edges = index(spark, tmp_path / "src", {
        "src/lib.rs": "pub fn helper() -> u32 { 42 }\n", "src/main.rs": "\nuse crate::lib::helper;\n\npub fn caller() {\n    helper();\n}\n",
        "ts/utils.ts": "export function helper(): number { return 42; }\n", "ts/main.ts": "\nimport { helper as h } from './utils';\n\nexport function caller(): number {\n    return h();\n}\n",
        "twice.rs": "use crate::lib::helper;\npub fn b() -> u32 { helper() + helper() }\n",
    })
    assert edges_of(edges, "calls", "src/main.rs") == {("caller", "src/lib.rs", "helper", 5, "explicit", ())}
    assert edges_of(edges, "imports", "src/main.rs") == {(None, "src/lib.rs", "crate::lib::helper", 2, "explicit", ())}
    assert edges_of(edges, "calls", "ts/main.ts") == {("caller", "ts/utils.ts", "helper", 5, "explicit", ())}
    assert edges_of(edges, "imports", "ts/main.ts") == {(None, "ts/utils.ts", "./utils", 2, "explicit", ())}
    assert edges.where("source_file = 'twice.rs' and edge_type = 'calls'").count() == 2


def test_reexports_make_derived_edges(spark, tmp_path):
    edges = index(spark, tmp_path / "src", {
        "src/bar.rs": "pub struct Bar;\npub struct Baz;\n", "src/foo.rs": "pub use crate::bar::Bar;\npub use crate::bar::*;\n", "src/deep.rs": "pub use crate::foo::Bar as Again;\n",
        "src/main.rs": "use crate::foo::Bar;\nuse crate::foo::Baz;\nuse crate::deep::Again;\nuse crate::foo::Nothing;\npub fn take(_b: Bar) {}\n",
        "web/a.ts": "export class A { go() {} }\n", "web/index.ts": "export { A } from './a';\n", "web/main.ts": "import { A } from './index';\nfunction f(a: A) { a.go(); }\n",
        "py/pkg/__init__.py": "from .core import run\n", "py/pkg/core.py": "def run():\n    pass\n", "py/main.py": "from pkg import run\ndef main():\n    run()\n",
    })
    assert edges_of(edges, "imports", "src/main.rs") == {
        (None, "src/bar.rs", "crate::foo::Bar", 1, "derived", ("src/foo.rs",)), (None, "src/bar.rs", "crate::foo::Baz", 2, "derived", ("src/foo.rs",)),
        (None, "src/bar.rs", "crate::deep::Again", 3, "derived", ("src/deep.rs", "src/foo.rs")), (None, "src/foo.rs", "crate::foo::Nothing", 4, "explicit", ()),
    }
    assert edges_of(edges, "imports", "web/main.ts") == {(None, "web/a.ts", "./index", 1, "derived", ("web/index.ts",))}
    assert edges_of(edges, "calls", "web/main.ts") == {("f", "web/a.ts", "go", 2, "explicit", ())}
    assert edges_of(edges, "imports", "py/main.py") == {(None, "py/pkg/core.py", "pkg", 1, "derived", ("py/pkg/__init__.py",))}
    assert edges_of(edges, "calls", "py/main.py") == {("main", "py/pkg/core.py", "run", 3, "explicit", ())}


def test_receiver_types_choose_the_file(spark, tmp_path):
    edges = index(spark, tmp_path / "src", {
        "src/foo.rs": "pub struct Foo;\nimpl Foo {\n    pub fn new() -> Self { Foo }\n    pub fn method(&self) -> u32 { 1 }\n    pub fn helper(&self) {}\n    pub fn caller(&self) { self.helper(); }\n}\n",
        "src/bar.rs": "pub struct Bar;\nimpl Bar {\n    pub fn method(&self) -> u32 { 2 }\n}\n", "src/a.rs": "pub fn helper() {}\n",
        "src/main.rs": "use crate::foo::Foo;\npub fn caller() {\n    let x = Foo::new();\n    x.method();\n    let y = unknown();\n    y.method();\n}\n",
        "go/svc/svc.go": "package svc\nfunc Run() {}\n", "go/other/other.go": "package other\nfunc Run() {}\n", "go/main.go": "package main\nfunc main() { svc.Run() }\n",
    })
    got = {(r["line"], r["target_symbol"]): r["target_file"] for r in edges.where("edge_type = 'calls' and source_file = 'src/main.rs'").collect()}
    assert got[3, "new"] == "src/foo.rs" and got[4, "method"] == "src/foo.rs" and got[6, "method"] == "src/bar.rs"
    assert {r[1] for r in edges_of(edges, "calls", "src/foo.rs")} == {"src/foo.rs"}
    assert {r[1] for r in edges_of(edges, "calls", "go/main.go")} == {"go/svc/svc.go"}


def test_modules_from_the_files_own_place(spark, tmp_path):
    edges = index(spark, tmp_path / "src", {
        "src/a/mod.rs": "pub mod b;\nuse self::b::f;\n", "src/a/b.rs": "use super::c::g;\nuse self::inner::h;\nuse super::top;\npub fn f() {}\n", "src/a/c.rs": "pub fn g() {}\n",
        "src/a/b/inner.rs": "pub fn h() {}\n", "src/c.rs": "pub fn g() {}\n", "src/x.rs": "use std::fmt;\nuse super::super::y;\n",
    })
    assert {r[1] for r in edges_of(edges, "imports", "src/a/b.rs")} == {"src/a/c.rs", "src/a/b/inner.rs", "src/a/mod.rs"}
    assert {r[1] for r in edges_of(edges, "imports", "src/a/mod.rs")} == {"src/a/b.rs"}
    assert edges_of(edges, "imports", "src/x.rs") == set()


def test_static_import_cycles_only(spark, tmp_path):
    edges = index(spark, tmp_path / "src", {"a.ts": "import { b } from './b';\nexport const a = 1;\n", "b.ts": "import { a } from './a';\nexport const b = 1;\n", "c.ts": "import { d } from './d';\n", "d.ts": "const x = import('./c');\nexport const d = 1;\n"})
    assert [r["target_file"] for r in edges.where("edge_type = 'imports_deferred'").collect()] == ["c.ts"]
    assert [r["cycle"] for r in graph.import_cycles(codeintel.as_graph(edges)).collect()] == [["a.ts", "b.ts", "a.ts"]]


def plain_nearest(source, targets):
    def steps(a, b):
        a, b = a.split("/"), b.split("/")
        common = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        return len(a) + len(b) - 2 * common

    return min(targets, key=lambda t: (steps(source, t), len(t), t), default=None)


def some_paths(rng, n, end):
    return sorted({"/".join([*(rng.choice("ab") for _ in range(rng.randint(0, 4))), rng.choice("xyz") + str(rng.randint(0, 9)) + end]) for _ in range(n)})


def test_nearest_by_brute_force(spark):
    rng = random.Random(2)
    paths = some_paths(rng, 200, ".rs")
    targets = [(rng.choice("klm"), p) for p in paths for _ in range(2)]
    asked = [(i, rng.choice("klmn"), rng.choice(paths)) for i in range(150)]
    got = codeintel.nearest(spark.createDataFrame(asked, "_e long, name string, source_file string"), spark.createDataFrame(targets, "name string, target_file string"), ["name"])
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()
    want = {i: t for i, name, f in asked if (t := plain_nearest(f, [p for n, p in targets if n == name]))}
    assert {r["_e"]: r["target_file"] for r in got.collect()} == want


def test_aliases_by_brute_force(spark):
    rng = random.Random(7)
    files = some_paths(rng, 200, ".ts")
    dirs = ["", "a", "a/b", "b", "b/b/a"]
    patterns = ["@app/*", "@app/x/*", "@ui", "lib/*", "*"]
    settings, table = [], {}
    for d in dirs:
        base = rng.choice([".", "./src", "lib"])
        own = {p: [f"./{p.strip('@*/') or 'any'}/{'*' if '*' in p else 'one'}", "more/*"] for p in rng.sample(patterns, 3)}
        table[d] = "/".join(x for x in (d, base.removeprefix("./").removeprefix(".")) if x), own
        body = ",".join(f'"{p}": [{",".join(chr(34) + t + chr(34) for t in ts)}]' for p, ts in own.items())
        settings.append((f"{d}/tsconfig.json".lstrip("/"), '{ // why\n "compilerOptions": {"baseUrl": "%s", /* x */ "paths": {%s,}},\n}' % (base, body)))
    settings += [("a/b/b/tsconfig.json", "not json"), ("b/a/tsconfig.json", '{"compilerOptions": {"strict": true}}')]
    settings += [("package.json", '{"name": "root", "workspaces": ["packages/*"]}'), ("pnpm-workspace.yaml", "packages:\n  - 'libs/*'\n  # no\n  - ./tools/*\nother:\n  - no/*\n")]
    settings += [(f"{p}/package.json", '{"name": "%s"}' % n) for p, n in (("packages/ui", "@org/ui"), ("libs/core", "core"), ("tools/t", "tool"), ("no/x", "no"), ("packages/ui/sub", "sub"))]
    targets = ["@app/foo", "@app/x/y", "@ui", "@ui/z", "lib/q/r", "react", "./here", "@org/ui", "@org/ui/button", "core", "core/a/b", "tool", "no", "sub"]
    deps = [(f, t, "typescript") for f in files for t in targets]
    configs = spark.createDataFrame(settings, "path string, content string")
    packages = codeintel.workspace_packages(configs)
    assert {(r["package"], r["folder"]) for r in packages.collect()} == {("@org/ui", "packages/ui"), ("core", "libs/core"), ("tool", "tools/t")}
    found = codeintel.resolve_aliases(spark.createDataFrame(deps, "file string, target string, language string"), codeintel.config_mappings(configs), packages)
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan

    def plain(file, target):
        if target.startswith("."):
            return None
        above = max((d for d in dirs if not d or file.startswith(d + "/")), key=len)
        base, own = table[above]
        fits = [p for p in own if target == p or "*" in p and target.startswith(p[:-1])]
        if fits:
            p = max(fits, key=lambda p: ("*" not in p, len(p.removesuffix("*"))))
            star = target[len(p) - 1 :] if "*" in p else ""
            put = lambda t: t.replace("*", star) if "*" in t else "/".join(x for x in (t, star) if x)
            return [put("/".join(x for x in (base, t.removeprefix("./")) if x)) for t in own[p]]
        known = {"@org/ui": "packages/ui", "core": "libs/core", "tool": "tools/t"}
        n = 2 if target.startswith("@") else 1
        head, sub = "/".join(target.split("/")[:n]), "/".join(target.split("/")[n:]) or "index"
        return [f"{known[head]}/src/{sub}", f"{known[head]}/{sub}"] if head in known else None

    want = {(f, t): p for f, t, _ in deps if (p := plain(f, t))}
    assert {(r["file"], r["target"]): r["paths"] for r in found.collect()} == want


def test_aliased_imports_reach_files(spark, tmp_path):
    edges = index(spark, tmp_path / "src", {
        "tsconfig.json": '{"compilerOptions": {"baseUrl": ".", "paths": {"@app/*": ["./web/*"]}}}', "package.json": '{"workspaces": {"packages": ["packages/*"]}}', "packages/ui/package.json": '{"name": "@org/ui"}',
        "web/store.ts": "export class Store { load() {} }\n", "other/store.ts": "export class Store { load() {} }\n", "packages/ui/src/index.ts": "export function draw() {}\n",
        "other/main.ts": "import { Store } from '@app/store';\nimport { draw } from '@org/ui';\nimport React from 'react';\nfunction f() { const s = new Store(); s.load(); draw(); }\n", "node_modules/react/index.ts": "export default 1\n",
    })
    assert {(r[1], r[2]) for r in edges_of(edges, "imports", "other/main.ts")} == {("web/store.ts", "@app/store"), ("packages/ui/src/index.ts", "@org/ui")}
    assert {(r[1], r[2]) for r in edges_of(edges, "calls", "other/main.ts")} == {("web/store.ts", "load"), ("packages/ui/src/index.ts", "draw")}


def test_references_are_queried_by_context(spark, tmp_path):
    edges = index(spark, tmp_path / "src", {"t.rs": "pub struct Key;\n", "u.rs": "struct R { k: Key }\nfn f(k: Key) -> Key { k }\n"})
    got = {r["context"]: r["target_file"] for r in codeintel.query_edges(edges, edge_type="references").collect()}
    assert got == {"field": "t.rs", "parameter_type": "t.rs", "return_type": "t.rs"}
    assert codeintel.query_edges(edges, edge_type="references", context="field").count() == 1


def test_only_changed_files_are_read_again(spark, tmp_path):
    root = tmp_path / "src"
    edges = index(spark, root, {"a.rs": "pub fn a() {}\n", "b.rs": "use crate::a::a;\npub fn b() { a() }\n"})
    assert edges_of(edges, "calls") == {("b", "a.rs", "a", 2, "explicit", ())}
    (root / "b.rs").write_text("use crate::a::a;\npub fn b() { a(); a() }\n")
    at = f"file://{root}/../index-src"
    stats = code.refresh(spark, str(root), at).first()
    assert stats["changed"] == 1 and code.index_tables(spark, at)["edges"].where("edge_type = 'calls'").count() == 2


def test_pages_and_sources_are_one_graph(spark, tmp_path):
    from lorespark.plans.search import KnowledgeBase
    from lorespark.sources import wiki

    root, at = tmp_path / "src", f"file://{tmp_path}/index"
    root.mkdir()
    (root / "a.rs").write_text("pub fn helper() {}\n")
    (root / "b.rs").write_text("use crate::a::helper;\npub fn run() { helper() }\n")
    assert code.load_edges(spark, str(root), at) is None
    code.refresh(spark, str(root), at)
    (root / "c.rs").write_text("use crate::a::helper;\npub fn late() { helper() }\n")
    edges = code.load_edges(spark, str(root), at)  # refreshed first
    near = lambda *a: {(r["other"], r["direction"], r["edge_type"]) for r in codeintel.code_neighbors(edges, *a).collect()}
    assert near("a.rs#helper") >= {("b.rs#run", "in", "calls"), ("c.rs#late", "in", "calls")}
    assert near("b.rs") == {("a.rs#helper", "out", "calls"), ("a.rs#crate::a::helper", "out", "imports")}
    assert near("helper") == {("b.rs#run", "in", "calls"), ("c.rs#late", "in", "calls")}
    scores = {r["other"]: r["score"] for r in codeintel.code_neighbors(edges, "helper", "LATE").collect()}
    assert scores["c.rs#late"] == scores["b.rs#run"] + 2
    pages = wiki.pages(spark.createDataFrame([("a.md", "---\ntitle: A\n---\nSee [[b]].\n"), ("b.md", "---\ntitle: B\n---\nText.\n")], "path string, content string"))
    base = KnowledgeBase.from_pages(pages, code_edges=edges)
    assert {r["other"] for r in base.call("graph.neighbors", node="wiki:a").collect()} == {"wiki:b"}
    assert {r["other"] for r in base.call("graph.neighbors", node="helper").collect()} == {"b.rs#run", "c.rs#late"}


def test_findings_leave_a_batch_in_bounded_parts(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(code, "AT_ONCE", 10)
    files = [(f"f{i}", "html", "<p><b>x</b></p>" * (i % 9)) for i in range(30)] + [("g", None, "x"), ("h", "html", None)]
    batch = pa.record_batch([pa.array(c, pa.string()) for c in zip(*files, strict=True)], ["file", "language", "content"])
    parts = list(code._extract(iter([batch])))
    assert len(parts) > 10 and max(p.num_rows for p in parts) == 10
    got = [tuple(r.values()) for p in parts for r in p.to_pylist()]
    assert got == [(f, k, *found) for f, k, content in files for found in code.extract(content, k)]
