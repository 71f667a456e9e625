"""Code edges across files, as joins: symbols by name, imports by path suffix, cycles, queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from ..sources.store import checkpointed
from .graph import with_seq

RESOLVED = ["source_file", "source_symbol", "edge_type", "target_file", "target_symbol", "line", "provenance", "via", "language", "context"]
#: Files that stand for their folder, by the name without extension.
FOLDER_FILES = ("mod", "lib", "main", "index", "__init__")
TS_ENDS = (".ts", ".tsx", ".js", ".svelte", "/index.ts", "/index.tsx")


def folders(path: Column) -> Column:
    """The folders above a file, the root first, and the file itself, with the steps down to the file."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("folder"), (F.size(parts) - i).alias("steps")))


def nearest(rows: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """``(_e, source_file, target_file)``: of the ``targets(*keys, target_file)`` with a row's keys, the file by the fewest steps.

    The shorter path, then the lesser wins among equal ones.  Each folder keeps
    its nearest target a key, and rows look in the folders above them, so a key
    that many files share costs no pairs of files.
    """
    held = targets.select(*keys, "target_file", F.explode(folders(F.col("target_file"))).alias("f")).groupBy(*keys, "f.folder")
    held = held.agg(F.min(F.struct("f.steps", F.length("target_file").alias("n"), "target_file")).alias("t"))
    look = rows.select("_e", "source_file", *keys, F.explode(folders(F.col("source_file"))).alias("f")).select("_e", "source_file", *keys, "f.folder", "f.steps")
    best = look.join(held, [*keys, "folder"]).groupBy("_e", "source_file").agg(F.min(F.struct((F.col("steps") + F.col("t.steps")).alias("steps"), "t.n", "t.target_file")).alias("t"))
    return best.select("_e", "source_file", "t.target_file")


def qualified(symbols: DataFrame) -> DataFrame:
    """``(target_symbol, of, target_file)``: symbols by the type, module, package or file that holds them."""
    name = F.regexp_extract("file", r"([^/]*?)(?:\.[^./]*)?$", 1)
    folder = F.regexp_extract("file", r"([^/]+)/[^/]*$", 1)
    module = F.when((F.col("language") == "go") | name.isin(*FOLDER_FILES), folder).otherwise(name)
    of = F.explode(F.array_distinct(F.array_compact(F.array("owner", F.when(F.col("owner").isNull(), module)))))
    return symbols.select(F.col("name").alias("target_symbol"), of.alias("of"), F.col("file").alias("target_file")).distinct()


def resolve_symbols(edges: DataFrame, symbols: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Edges whose target symbol is declared somewhere, stamped explicit (Q8).

    In this order: where ``names`` (of ``resolve_names``) says that the name, or
    the receiver's type, comes from; the method of the receiver's type, module or package; the name in the
    nearest file that declares the receiver's type; the name in the nearest file
    that declares it.  A receiver that narrows to nothing is ignored.
    """
    rows = edges.withColumn("_e", F.xxhash64("source_symbol", "edge_type", "target_symbol", "receiver", "line", "column", "context"))
    declared = symbols.select(F.col("name").alias("target_symbol"), F.col("file").alias("target_file")).distinct()
    types = symbols.where("kind in ('class', 'struct', 'enum', 'union', 'trait', 'interface', 'type', 'module')").select(F.col("name").alias("of"), F.col("file").alias("target_file")).distinct()
    typed = rows.where("of is not null")
    pick = lambda found, rank: found.select("_e", "source_file", F.struct(F.lit(rank).alias("rank"), "target_file", "target_symbol").alias("t"))
    named = rows.select("_e", "source_file", "target_symbol", "of")
    of_type = nearest(typed, types, ["of"]).join(named.drop("of"), ["_e", "source_file"]).join(declared, ["target_symbol", "target_file"])
    hits = pick(nearest(typed, qualified(symbols), ["target_symbol", "of"]).join(named, ["_e", "source_file"]), 2)
    hits = hits.union(pick(of_type, 3)).union(pick(nearest(rows, declared, ["target_symbol"]).join(named, ["_e", "source_file"]), 4))
    if names is not None:
        known = names.select(F.col("file").alias("source_file"), F.col("local").alias("_local"), "target_file", F.col("name").alias("_there"))
        whole = F.when(F.col("receiver").isNull() & ~F.col("edge_type").isin("imports", "imports_deferred"), F.col("target_symbol")).otherwise(F.col("receiver"))
        bound = rows.withColumn("_local", whole).join(known, ["source_file", "_local"])
        there = F.when(F.col("receiver").isNull() & ~F.coalesce(F.col("_there"), F.lit("default")).isin("default", ""), F.col("_there")).otherwise(F.col("target_symbol"))
        by_type = typed.withColumn("_local", F.col("of")).join(known, ["source_file", "_local"]).select("_e", "source_file", "target_file", "target_symbol")
        bound = bound.withColumn("target_symbol", there).select("_e", "source_file", "target_file", "target_symbol").union(by_type)
        hits = pick(bound.join(declared, ["target_symbol", "target_file"]), 1).union(hits)
    best = hits.groupBy("_e", "source_file").agg(F.min("t").alias("t"))
    joined = rows.join(best, ["_e", "source_file"])
    return joined.select("source_file", "source_symbol", "edge_type", F.col("t.target_file").alias("target_file"), F.col("t.target_symbol").alias("target_symbol"), "line", F.lit("explicit").alias("provenance"), F.array().cast("array<string>").alias("via"), "language", "context")


def _up(path: Column, n: Column) -> Column:
    """``path`` without its last ``n`` parts."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - n, F.lit(0))), "/")


def import_candidates(deps: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Paths that an import may mean, the most specific first: ``(file, target, ord, candidate, ...)``.

    ``aliases(file, target, paths)`` has what configurations make of a target;
    those paths come first.
    """
    folder = F.regexp_replace("file", r"/?[^/]*$", "")
    target = F.col("target")
    joined = lambda *parts: F.concat_ws("/", *[F.nullif(p, F.lit("")) for p in parts])
    dots = F.length(F.regexp_extract(target, r"^(\.*)", 1))
    dotted = F.replace(F.regexp_replace(target, r"^\.*", ""), F.lit("."), F.lit("/"))
    py_base = F.when(dots > 0, joined(_up(folder, dots - 1), dotted)).otherwise(dotted)
    py = F.array(F.concat(py_base, F.lit(".py")), joined(py_base, F.lit("__init__.py")))

    def folded(path: Column) -> Column:
        step = lambda acc, p: F.when((p == "") | (p == "."), acc).when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
        return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")

    bare = F.regexp_replace(folded(F.when(F.startswith(target, F.lit(".")), joined(folder, target)).otherwise(target)), r"\.(ts|tsx|js|svelte)$", "")
    ts = F.array(*[F.concat(bare, F.lit(e)) for e in TS_ENDS])
    parts = F.split(F.regexp_replace(F.regexp_replace(target, r"(::)?\s*\{.*$", ""), r"\s+as\s+\w+$", ""), r"\s*::\s*")
    inner = F.filter(parts, lambda p: ~p.isin("crate", "self", "super", "*", ""))
    supers = F.size(F.filter(parts, lambda p: p == "super"))
    # a file is the module of its name, but for those that stand for their folder
    own = F.when(F.rlike("file", F.lit(rf"(^|/)({'|'.join(FOLDER_FILES)})\.rs$")), folder).otherwise(F.regexp_replace("file", r"\.rs$", ""))
    shorter = F.sequence(F.size(inner), F.lit(1), F.lit(-1))
    files = lambda base: F.flatten(F.transform(F.when(F.size(inner) > 0, shorter).otherwise(F.array().cast("array<int>")), lambda n: F.array(F.concat(joined(base, F.array_join(F.slice(inner, 1, n), "/")), F.lit(".rs")), joined(base, F.array_join(F.slice(inner, 1, n), "/"), F.lit("mod.rs")))))
    itself = lambda base: F.when(base != "", F.array(F.concat(base, F.lit(".rs")), *[joined(base, F.lit(f"{x}.rs")) for x in FOLDER_FILES[:3]])).otherwise(F.array().cast("array<string>"))
    first = F.get(parts, F.lit(0))
    rust = F.when(first.isin("self", "super"), F.concat(files(_up(own, supers)), itself(_up(own, supers)), files(_up(folder, supers)))).when(~first.isin("std", "core", "alloc"), files(F.lit("")))
    lists = F.when(F.col("language") == "python", py).when(F.col("language").isin("typescript", "svelte"), ts).when(F.col("language") == "rust", rust)
    if aliases is None:
        return deps.select("*", F.posexplode(lists).alias("ord", "candidate"))
    known = deps.join(aliases.select("file", "target", F.col("paths").alias("_paths")), ["file", "target"], "left")
    first_paths = F.coalesce(F.flatten(F.transform("_paths", lambda p: F.array(*[F.concat(folded(p), F.lit(e)) for e in TS_ENDS]))), F.array().cast("array<string>"))
    return known.withColumn("_all", F.concat(first_paths, F.coalesce(lists, F.array().cast("array<string>")))).drop("_paths").select("*", F.posexplode("_all").alias("ord", "candidate")).drop("_all")


def import_targets(deps: DataFrame, files: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """``(file, target, target_file)``: a candidate equals a path or ends it, the most specific first, then the nearest file."""
    distinct = deps.select("file", "target", "language").distinct()
    rows = import_candidates(distinct, aliases).withColumn("_e", F.xxhash64("target", "ord")).withColumnRenamed("file", "source_file")
    parts = F.split("path", "/")
    ends = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("candidate")
    suffixes = files.select(F.col("path").alias("target_file"), ends).join(rows.select("candidate").distinct(), "candidate", "left_semi")
    hits = nearest(rows, suffixes, ["candidate"]).join(rows.select("_e", "source_file", "target", "ord"), ["_e", "source_file"]).where("target_file <> source_file")
    return hits.groupBy(F.col("source_file").alias("file"), "target").agg(F.min_by("target_file", "ord").alias("target_file"))


def resolve_imports(deps: DataFrame, targets: DataFrame) -> DataFrame:
    """Import edges to the files of ``targets``; those that wait for a call are ``imports_deferred``."""
    found = deps.join(targets, ["file", "target"])
    kind = F.when(F.coalesce("deferred", F.lit(False)), "imports_deferred").otherwise("imports")
    listed = F.regexp_replace(F.regexp_replace("target", r"(::)?\s*\{.*$", ""), r"\s+as\s+\w+$", "")
    return found.select(F.col("file").alias("source_file"), F.lit(None).cast("string").alias("source_symbol"), kind.alias("edge_type"), "target_file", listed.alias("target_symbol"), "line", F.lit("explicit").alias("provenance"), F.array().cast("array<string>").alias("via"), "language", F.lit(None).cast("string").alias("context")).distinct()


def with_full(names: DataFrame) -> DataFrame:
    """Imported names with ``full``, the module's path that names them, should they be modules themselves."""
    whole = F.concat_ws("::", F.nullif("module", F.lit("")), F.when(F.col("name") != "*", F.col("name")))
    dotted = F.concat(F.regexp_replace("module", r"([^.])$", "$1."), F.col("name"))
    return names.withColumn("full", F.when(F.col("language") == "rust", whole).when((F.col("language") == "python") & (F.col("name") != "*"), dotted).otherwise(F.col("module")))


def asked_targets(deps: DataFrame, names: DataFrame) -> DataFrame:
    """``(file, target, language)`` of all that ``import_targets`` should find for imports and names."""
    of = lambda c: with_full(names).select("file", F.col(c).alias("target"), "language")
    return deps.select("file", "target", "language").union(of("full")).union(of("module")).where("target is not null").distinct()


def resolve_names(names: DataFrame, targets: DataFrame, symbols: DataFrame, depth: int = 2) -> DataFrame:
    """Where imported names come from: ``(file, local, name, module, target, line, language, kind, target_file, via)``.

    A name that the module's file doesn't declare is followed through what that
    file passes on (``pub use``, ``export ... from``, a package's imports), over
    at most ``depth`` files; ``via`` lists them.  Names that end nowhere stay with
    the module's file.
    """
    asked = with_full(names)
    inner = asked.join(targets.select("file", F.col("target").alias("full"), F.col("target_file").alias("_inner")), ["file", "full"], "left")
    placed = inner.join(targets.select("file", F.col("target").alias("module"), F.col("target_file").alias("_outer")), ["file", "module"], "left")
    placed = placed.withColumn("target_file", F.coalesce("_inner", "_outer")).drop("_inner", "_outer", "full").where("target_file is not null").distinct()
    declared = symbols.select(F.col("name"), F.col("file").alias("target_file")).distinct()
    # a file that bears the name is the module itself
    stem = F.regexp_extract(F.regexp_replace("target_file", rf"/({'|'.join(FOLDER_FILES)})\.[^.]*$", ""), r"([^/]*?)(?:\.[^./]*)?$", 1)
    here = checkpointed(placed.join(declared.withColumn("_declared", F.lit(True)), ["name", "target_file"], "left"))
    settled = F.col("_declared").isNotNull() | F.col("name").isin("*", "", "default") | (stem == F.col("name"))
    none = F.array().cast("array<string>")
    columns = ["file", "local", "name", "module", "target", "line", "language", "kind", "target_file"]
    out = here.where(settled).select(*columns, none.alias("via"))
    key = ["file", "local", "line", "module", "kind"]
    passes = here.where("kind = 'reexport'").select(F.col("file").alias("_at"), F.col("local").alias("_name"), F.when(F.col("local") == "*", None).otherwise(F.col("name")).alias("_next"), F.col("target_file").alias("_to")).distinct()
    now = here.where(~settled).select(*columns, F.col("name").alias("_wanted"), F.col("target_file").alias("_now"), none.alias("via"))
    left = now
    for _ in range(depth):
        if now.isEmpty():
            break
        by_name = now.join(passes, (F.col("_now") == F.col("_at")) & (F.col("_wanted") == F.col("_name")))
        by_star = now.join(passes.where("_name = '*'"), F.col("_now") == F.col("_at"))
        step = by_name.unionByName(by_star).where("_to <> file and not array_contains(via, _to)")
        step = step.withColumns({"via": F.array_append("via", F.col("_now")), "_now": F.col("_to"), "_wanted": F.coalesce("_next", "_wanted")}).drop("_at", "_name", "_next", "_to")
        ends = declared.withColumnsRenamed({"name": "_wanted", "target_file": "_now"}).withColumn("_ends", F.lit(True))
        now = checkpointed(step.join(ends, ["_wanted", "_now"], "left"))
        done = now.where("_ends").groupBy(*key).agg(F.min(F.struct("_now", "_wanted", "via")).alias("d"))
        done = checkpointed(done)
        out = out.unionByName(left.join(done, key).select(*[F.col("d._wanted").alias("name") if c == "name" else F.col("d._now").alias("target_file") if c == "target_file" else c for c in columns], F.col("d.via").alias("via")))
        left = checkpointed(left.join(done.select(key), key, "left_anti"))
        now = now.where("_ends is null").drop("_ends").join(done.select(key), key, "left_anti")
    return out.unionByName(left.select(*columns, none.alias("via")))


def with_derived(imports: DataFrame, names: DataFrame) -> DataFrame:
    """Import edges, those whose names all come through other files replaced by derived ones to where the names are declared."""
    chased = names.where(F.size("via") > 0)
    glue = F.when(F.col("language") == "rust", F.concat_ws("::", F.nullif("module", F.lit("")), "local")).otherwise(F.col("target"))
    derived = chased.select(F.col("file").alias("source_file"), F.lit(None).cast("string").alias("source_symbol"), F.lit("imports").alias("edge_type"), "target_file", glue.alias("target_symbol"), "line", F.lit("derived").alias("provenance"), "via", "language", F.lit(None).cast("string").alias("context")).distinct()
    all_chased = names.groupBy("file", "line", "target").agg(F.min(F.size("via")).alias("least")).where("least > 0").select(F.col("file").alias("source_file"), "line", F.col("target").alias("target_symbol"))
    return imports.join(all_chased, ["source_file", "line", "target_symbol"], "left_anti").select(RESOLVED).unionByName(derived.select(RESOLVED))


def config_mappings(configs: DataFrame) -> DataFrame:
    """``(config_dir, pattern, targets)`` of ``tsconfig.json`` files ``configs(path, content)``; comments and trailing commas are allowed."""
    clean = F.regexp_replace(F.col("content").cast("string"), r",(\s*[}\]])", "$1")
    parsed = F.from_json(clean, "compilerOptions struct<baseUrl: string, paths: map<string, array<string>>>", {"allowComments": "true"})
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    rows = configs.where(F.rlike("path", F.lit(r"(^|/)tsconfig\.json$"))).select(folder.alias("config_dir"), parsed.alias("j"))
    base = F.concat_ws("/", F.nullif("config_dir", F.lit("")), F.nullif(F.regexp_replace(F.coalesce("j.compilerOptions.baseUrl", F.lit(".")), r"^\.?/?", ""), F.lit("")))
    rows = rows.select("config_dir", base.alias("base"), F.explode("j.compilerOptions.paths").alias("pattern", "targets"))
    full = F.transform("targets", lambda t: F.concat_ws("/", F.nullif("base", F.lit("")), F.regexp_replace(t, r"^\./", "")))
    return rows.select("config_dir", "pattern", full.alias("targets"))


def workspace_packages(configs: DataFrame) -> DataFrame:
    """``(package, folder)`` of the packages below the workspace globs of the root's ``package.json`` and ``pnpm-workspace.yaml``."""
    text = F.col("content").cast("string")
    names = configs.where(F.rlike("path", F.lit(r"/package\.json$"))).select(F.get_json_object(text, "$.name").alias("package"), F.regexp_replace("path", r"/package\.json$", "").alias("folder")).where("package is not null")
    listed = F.coalesce(F.from_json(F.get_json_object(text, "$.workspaces"), "array<string>"), F.from_json(F.get_json_object(text, "$.workspaces.packages"), "array<string>"))
    npm = configs.where("path = 'package.json'").select(F.explode(listed).alias("glob"))
    block = F.regexp_extract(text, r"(?m)^packages:[ \t]*((?:\n[ \t]*(?:#[^\n]*|-[^\n]*)?)+)", 1)
    pnpm = configs.where("path = 'pnpm-workspace.yaml'").select(F.explode(F.regexp_extract_all(block, F.lit(r"-[ \t]*['\"]?([^'\"\n]+)"))).alias("glob"))
    above = npm.union(pnpm).select(F.regexp_replace(F.regexp_replace(F.trim("glob"), r"^\./", ""), r"/?\**$", "").alias("above")).distinct()
    keyed = names.withColumn("above", F.regexp_replace("folder", r"/?[^/]*$", ""))
    return keyed.join(above, "above").groupBy("package").agg(F.min("folder").alias("folder"))


def resolve_aliases(deps: DataFrame, mappings: DataFrame, packages: DataFrame | None = None) -> DataFrame:
    """``(file, target, paths)``: what configurations make of bare TypeScript targets.

    The nearest configuration above a file counts, as an equality on its folders;
    of its patterns an equal one, else that with the longest beginning.  Targets
    that no pattern fits may name a workspace package.
    """
    asked = deps.where(F.col("language").isin("typescript", "svelte") & ~F.startswith("target", F.lit("."))).select("file", "target").distinct()
    above = asked.select("file").distinct().select("file", F.explode(folders(F.col("file"))).alias("f")).select("file", F.col("f.folder").alias("config_dir"))
    dirs = mappings.select("config_dir").distinct()
    own = above.join(dirs, "config_dir").groupBy("file").agg(F.max_by("config_dir", F.length("config_dir")).alias("config_dir"))
    head = F.substring_index("pattern", "*", 1)
    star = F.contains("pattern", F.lit("*"))
    fits = F.when(star, F.startswith("target", head)).otherwise(F.col("target") == F.col("pattern"))
    tail = F.when(star, F.expr("substring(target, length(substring_index(pattern, '*', 1)) + 1)")).otherwise("")
    paths = F.transform("targets", lambda t: F.when(F.contains(t, F.lit("*")), F.replace(t, F.lit("*"), tail)).otherwise(F.concat_ws("/", F.regexp_replace(t, "/$", ""), F.nullif(tail, F.lit("")))))
    rank = F.struct(~star, F.length(head), "pattern")
    mapped = asked.join(own, "file").join(mappings, "config_dir").where(fits).groupBy("file", "target").agg(F.max_by(paths, rank).alias("paths"))
    if packages is None:
        return mapped
    scoped = F.when(F.startswith("target", F.lit("@")), F.lit(2)).otherwise(F.lit(1))
    parts = F.split("target", "/")
    rest = asked.join(mapped.select("file", "target"), ["file", "target"], "left_anti").withColumns({"package": F.array_join(F.slice(parts, 1, scoped), "/"), "sub": F.array_join(F.slice(parts, scoped + 1, F.size(parts)), "/")})
    sub = F.when(F.col("sub") == "", "index").otherwise(F.col("sub"))
    in_package = F.array(F.concat_ws("/", "folder", F.lit("src"), sub), F.concat_ws("/", "folder", sub))
    return mapped.unionByName(rest.join(packages, "package").select("file", "target", in_package.alias("paths")))


def query_symbols(symbols: DataFrame, name: str | None = None, kind: str | None = None, file: str | None = None, path: str | None = None, language: str | None = None, limit: int | None = None) -> DataFrame:
    """Symbols by part of the name, kind, file (or its end), folder and language."""
    out = symbols
    if name is not None:
        out = out.where(F.contains("name", F.lit(name)))
    if kind is not None:
        out = out.where(F.col("kind") == kind)
    if file is not None:
        out = out.where((F.col("file") == file) | F.endswith("file", F.lit("/" + file)))
    if path is not None:
        out = out.where(F.startswith("file", F.lit(path.rstrip("/") + "/")))
    if language is not None:
        out = out.where(F.col("language") == language)
    return out if limit is None else out.orderBy("file", "line", "name").limit(limit)


def query_dependencies(deps: DataFrame, file: str | None = None, target: str | None = None, reverse: bool = False, depth: int = 1, language: str | None = None) -> DataFrame:
    """A file's imports, or with ``reverse`` the files that import a target."""
    if depth > 1:
        raise ValueError("only direct dependencies: use affected() for more")
    out = deps if language is None else deps.where(F.col("language") == language)
    if reverse:
        return out.where(F.contains("target", F.lit(target or file or ""))).select("file").distinct()
    if file is not None:
        out = out.where((F.col("file") == file) | F.endswith("file", F.lit("/" + file)))
    return out if target is None else out.where(F.contains("target", F.lit(target)))


def query_edges(edges: DataFrame, file: str | None = None, symbol: str | None = None, reverse: bool = False, edge_type: str | None = None, provenance: str | None = None, language: str | None = None, context: str | None = None) -> DataFrame:
    """Edges out of (``reverse``: into) a file or symbol, by type, provenance, language and, for references, context."""
    side = "target" if reverse else "source"
    tests = {f"{side}_file": file, f"{side}_symbol": symbol, "edge_type": edge_type, "provenance": provenance, "language": language, "context": context}
    for column, value in tests.items():
        if value is not None:
            edges = edges.where(F.col(column) == value)
    return edges


def dependencies_by_file(deps: DataFrame, edges: DataFrame) -> DataFrame:
    """``(file, imports, edge_types)``: distinct imports and counts of resolved edges by type."""
    imports = deps.groupBy("file").agg(F.array_sort(F.collect_set("target")).alias("imports"))
    types = edges.groupBy("source_file", "edge_type").agg(F.count(F.lit(1)).alias("n")).groupBy(F.col("source_file").alias("file")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("edge_type", "n")))).alias("edge_types"))
    return imports.join(types, "file", "full_outer")


def as_graph(edges: DataFrame) -> DataFrame:
    """Code edges in the form of graph edges: nodes are ``file#symbol``, or the file where there is no symbol."""
    node = lambda side: F.concat_ws("#", F.col(f"{side}_file"), F.col(f"{side}_symbol"))
    target = F.when(F.col("edge_type").isin("imports", "imports_deferred"), F.col("target_file")).otherwise(node("target"))
    rows = edges.select(node("source").alias("src"), target.alias("dst"), "edge_type", "provenance", "line")
    return with_seq(rows, "src", "dst", "edge_type", "line")


def code_neighbors(edges: DataFrame, node: str, query: str | None = None) -> DataFrame:
    """Neighbours of ``file#symbol``, a file or a bare symbol name, in the columns of ``graph.neighbors``.

    A file, and a symbol's file with it, takes the edges of all its symbols.  A
    row an edge: its other end, a title (symbol or file name), and the score of
    its type, 2 more where the title has the query's text.
    """
    file, _, symbol = node.partition("#")
    source, target = (F.concat_ws("#", F.nullif(f"{s}_file", F.lit("")), F.nullif(f"{s}_symbol", F.lit(""))) for s in ("source", "target"))
    if symbol or has_file(edges, node):
        touches = (F.col("source_file") == file) | (F.col("target_file") == file)
    else:
        touches = (F.col("source_symbol") == node) | (F.col("target_symbol") == node)
    rows = edges.where(touches).dropDuplicates(["edge_type", "source_file", "source_symbol", "target_file", "target_symbol", "line"])
    out = (source == node) if symbol else (F.col("source_file") == file) if has_file(edges, node) else (F.col("source_symbol") == node)
    other = F.when(out, target).otherwise(source)
    named = rows.select(other.alias("other"), F.when(out, "out").otherwise("in").alias("direction"), "edge_type", "provenance", F.when(F.contains(other, F.lit("#")), F.substring_index(other, "#", -1)).otherwise(F.substring_index(other, "/", -1)).alias("title"), F.when(F.contains(other, F.lit("#")), "symbol").otherwise("file").alias("page_type"))
    more = F.when(F.contains(F.lower("title"), F.lit(query.lower())), 2.0).otherwise(0.0) if query else F.lit(0.0)
    return named.where("other <> ''").withColumn("score", scoring.edge_priority("edge_type").cast("double") + more).orderBy(F.desc("score"), "other", "edge_type")


def has_file(edges: DataFrame, file: str) -> bool:
    return not edges.where((F.col("source_file") == file) | (F.col("target_file") == file)).isEmpty()


def has_symbol(edges: DataFrame, file: str, symbol: str) -> bool:
    at = lambda side: (F.col(f"{side}_file") == file) & (F.col(f"{side}_symbol") == symbol)
    return not edges.where(at("source") | at("target")).isEmpty()


def affected_code(edges: DataFrame, node: str, max_depth: int = 10) -> DataFrame:
    """What breaks with ``file#symbol``, a file, or a bare symbol name: ``(id, depth, via)``, over edges of all types.

    A file node takes the edges into any of its symbols.  Sources of edges are
    ``file#symbol``, or the file where the edge has no symbol.  ``via`` is the
    node that was reached before.
    """
    spark = edges.sparkSession
    at = lambda side: F.concat_ws("#", F.col(f"{side}_file"), F.nullif(F.col(f"{side}_symbol"), F.lit("")))
    target = F.when(F.col("edge_type").isin("imports", "imports_deferred"), F.col("target_file")).otherwise(at("target"))
    links = edges.select(at("source").alias("id"), F.explode(F.array_distinct(F.array(target, F.col("target_file")))).alias("into")).distinct()
    if "#" not in node and not has_file(edges, node):
        starts = edges.where((F.col("target_symbol") == node) & ~F.col("edge_type").isin("imports", "imports_deferred")).select(at("source").alias("id")).distinct()
        seen = checkpointed(starts.select("id", F.lit(1).alias("depth"), F.lit(node).alias("via")))
        first = 2
    else:
        seen = checkpointed(spark.createDataFrame([(node, 0, None)], "id string, depth int, via string"))
        first = 1
    for d in range(first, max_depth + 1):
        front = seen.where(F.col("depth") == d - 1).select(F.col("id").alias("into"))
        new = front.join(links, "into").groupBy("id").agg(F.min("into").alias("via")).join(seen.select("id"), "id", "left_anti")
        new = checkpointed(new.select("id", F.lit(d).alias("depth"), "via"))
        if new.isEmpty():
            break
        seen = checkpointed(seen.unionByName(new))
    return seen.where(F.col("depth") > 0).orderBy("id")


def search_edges(edges: DataFrame, edge_type: str, pattern: str = "", path: str | None = None, extension: str | None = None, limit: int | None = 30) -> DataFrame:
    """Resolved edges of a type whose "source symbol target" text contains ``pattern``, by folder and extension of the source file."""
    words = F.concat_ws(" ", "source_file", "source_symbol", "target_symbol")
    out = edges.where((F.col("edge_type") == edge_type) & F.contains(words, F.lit(pattern)))
    if path is not None:
        out = out.where(F.startswith("source_file", F.lit(path.rstrip("/") + "/")))
    if extension is not None:
        out = out.where(F.endswith("source_file", F.lit("." + extension)))
    return out if limit is None else out.orderBy("source_file", "line", "target_symbol").limit(limit)


def grep(files: DataFrame, pattern: str, limit: int | None = 30, language: str | None = None) -> DataFrame:
    """First match a line, ``(path, line, text, match)``; in path and line order up to a limit, all without one."""
    rows = files if language is None else files.where(F.col("language") == language)
    lines = rows.select("path", F.posexplode(F.split(F.col("content").cast("string"), "\n")).alias("line", "text"))
    hits = lines.where(F.rlike("text", F.lit(pattern))).select("path", (F.col("line") + 1).alias("line"), "text", F.regexp_extract("text", f"({pattern})", 1).alias("match"))
    return hits if limit is None else hits.orderBy("path", "line").limit(limit)


def index_stats(before: DataFrame, changed: DataFrame, symbols: DataFrame, deps: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: files scanned and changed, and the totals of the index."""
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    out = n(before, "scanned")
    for df, name in ((changed, "changed"), (symbols, "symbols"), (deps, "deps"), (edges, "edges")):
        out = out.crossJoin(n(df, name))  # one row each
    return out
