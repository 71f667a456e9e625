"""Source trees as tables: scan with fingerprints, and extraction of symbols, imports and edges.

Python files are read with the standard ``ast``, those that don't parse by
patterns; Rust, TypeScript and Go by a scanner with a stack of scopes
(``scopes.py``); HTML and Svelte by patterns.  Import statements are read whole,
over any number of lines, and the names that they bring into the file are
findings of their own.  Extraction is a per-file helper inside Arrow batches;
everything that crosses files is a join (``operators/codeintel.py``).
"""

from __future__ import annotations

import ast
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scopes
from .store import confined, stored

# fixed values: languages by extension, and folders that scans leave out
LANGUAGES = {"rs": "rust", "ts": "typescript", "tsx": "typescript", "py": "python", "go": "go", "html": "html", "htm": "html", "svelte": "svelte"}
SKIPPED = ("target", "node_modules", ".git", "dist", "build", ".wm", "__pycache__", ".venv")

S = T.StringType()
FOUND = T.StructType(
    [
        T.StructField("what", S), T.StructField("kind", S), T.StructField("name", S), T.StructField("line", T.IntegerType()), T.StructField("column", T.IntegerType()),
        T.StructField("snippet", S), T.StructField("owner", S), T.StructField("target", S), T.StructField("receiver", S), T.StructField("deferred", T.BooleanType()),
        # what a reference's type is of, or a name's module; the type that a call's receiver has
        T.StructField("context", S), T.StructField("of", S),
    ]
)

#: Declaration patterns by language, (kind, pattern with the name in group 1).
DECLARATIONS = {
    "svelte": [("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+(\w+)"), ("const", r"^\s*(?:export\s+)?let\s+(\w+)")],
    "html": [],
}
#: Import statements in the whole text, the target in group 1.
IMPORTS = {
    "rust": r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);", "typescript": r"^[ \t]*(?:(?:import|export)\b[^'\";()]*?\bfrom\s*|import\s*)['\"]([^'\"]+)['\"]",
    "go": r"^[ \t]*import\s+(?:[\w.]+\s+)?\"([^\"]+)\"",
}
IMPORTS["svelte"] = IMPORTS["typescript"]
GO_BLOCK, GO_ENTRY = re.compile(r"^[ \t]*import\s*\(([^)]*)\)", re.M), re.compile(r"\"([^\"]+)\"")
PY_SYMBOL = re.compile(r"^([ \t]*)(?:async\s+)?(def|class)\s+(\w+)", re.M)
PY_IMPORT = re.compile(r"^([ \t]*)(?:from\s+([.\w]+)\s+import\s+(\([^)]*\)|[^\n#;]+)|import\s+([^\n#;]+))", re.M)
DYNAMIC = re.compile(r"\bimport\(\s*['\"]([^'\"]+)['\"]\s*\)")
CALL = re.compile(r"(?:\b([A-Za-z_]\w*)\s*(?:\.|::)\s*)?\b([A-Za-z_]\w*)\s*\(")
NOT_CALLS = {"if", "for", "while", "switch", "match", "return", "fn", "function", "func", "catch", "await", "new", "in", "and", "or", "not", "let", "super"}
#: What holds no elements of a page: comments, scripts and styles.
NO_MARKUP = re.compile(r"<!--.*?-->|<(?:script|style)\b.*?</(?:script|style)\s*>", re.S | re.I)
TAG = re.compile(r"<([A-Za-z][\w:.-]*)")
TS_CLAUSE = re.compile(r"^[ \t]*(import|export)\s+(?:type\s+)?([^'\";()]*?)\s*\bfrom\s*['\"]([^'\"]+)['\"]", re.M)
RUST_USE = re.compile(r"^[ \t]*(pub(?:\([^)]*\))?\s+)?use\s+([^;]+);", re.M)


def _row(what, kind, name, line, column=0, snippet="", owner=None, target=None, receiver=None, deferred=False, context=None, of=None) -> tuple:
    return what, kind, name, line, column, snippet.strip()[:200], owner, target, receiver, deferred, context, of


def _line(content: str, at: int) -> int:
    return content.count("\n", 0, at) + 1


def _broken_python(content: str) -> list[tuple]:
    """Declarations and imports of a file that doesn't parse."""
    lines, out = content.split("\n"), []
    for m in PY_SYMBOL.finditer(content):
        no = _line(content, m.start(2))
        kind = "class" if m[2] == "class" else "method" if m[1] else "function"
        out.append(_row("symbol", kind, m[3], no, len(m[1]), lines[no - 1]))
    for m in PY_IMPORT.finditer(content):
        no, inner = _line(content, m.end(1)), bool(m[1])
        names = [n.split(" as ")[0].strip() for n in (m[3] or m[4]).strip("() \t\n").split(",")]
        for n in filter(None, names):
            out.append(_row("import", "import", n, no, 0, lines[no - 1], target=m[2] or n, receiver=n if m[2] else None, deferred=inner))
    return out


def _imports(content: str, language: str) -> tuple[list[tuple], set[int]]:
    """Static imports of a text without comments, and the lines that they take up."""
    out, taken = [], set()
    lines = content.split("\n")

    def add(target: str, start: int, end: int) -> None:
        no = _line(content, start)
        taken.update(range(no, _line(content, end) + 1))
        out.append(_row("import", "import", target, no, 0, lines[no - 1], target=target))

    if language in IMPORTS:
        for m in re.finditer(IMPORTS[language], content, re.M):
            add(" ".join(m[1].split()), m.start() + len(m[0]) - len(m[0].lstrip()), m.end())
    if language == "go":
        for block in GO_BLOCK.finditer(content):
            for m in GO_ENTRY.finditer(content, block.start(1), block.end(1)):
                add(m[1], m.start(), m.end())
    return out, taken


def _rust_names(path: str, before: tuple[str, ...] = ()) -> list[tuple[str, str, str]]:
    """``(module, name, local name)`` of a use declaration's tree."""
    head, brace, rest = path.strip().partition("{")
    if not brace:
        path, _, local = head.strip().partition(" as ")
        parts = [*before, *filter(None, (x.strip() for x in path.split("::")))]
        if parts and parts[-1] == "self" and len(parts) > 1:
            parts.pop()
        return [("::".join(parts[:-1]), parts[-1], local.strip() or parts[-1])] if parts else []
    now = (*before, *filter(None, (x.strip() for x in head.split("::"))))
    out, depth, begin = [], 0, 0
    rest = rest.rstrip()[:-1] + ","
    for i, c in enumerate(rest):
        depth += (c == "{") - (c == "}")
        if c == "," and not depth:
            out += _rust_names(rest[begin:i], now) if rest[begin:i].strip() else []
            begin = i + 1
    return out


def _names(bare: str, language: str) -> list[tuple]:
    """The names that static imports bring in: name here, name there, module, and what the import is listed under."""
    out = []
    if language == "rust":
        for m in RUST_USE.finditer(bare):
            path = " ".join(m[2].split())
            listed = re.sub(r"(::)?\s*\{.*$", "", path).split(" as ")[0].strip()
            kind, no = "reexport" if m[1] else "import", _line(bare, m.end(0) - len(m[0].lstrip()))
            out += [_row("name", kind, local, no, target=listed, receiver=name, context=module) for module, name, local in _rust_names(path)]
    elif language in ("typescript", "svelte"):
        for m in TS_CLAUSE.finditer(bare):
            kind, no = "reexport" if m[1] == "export" else "import", _line(bare, m.end(0) - len(m[0].lstrip()))
            clause, _, braced = m[2].partition("{")
            for part in filter(None, (x.strip() for x in clause.split(","))):
                star, _, local = part.partition(" as ")
                name = "*" if star.strip() == "*" else "default"
                out.append(_row("name", kind, local.strip() or part, no, target=m[3], receiver=name if not local or name != "*" else "", context=m[3]))
            for part in filter(None, (x.strip() for x in braced.partition("}")[0].split(","))):
                name, _, local = part.removeprefix("type ").partition(" as ")
                out.append(_row("name", kind, local.strip() or name.strip(), no, target=m[3], receiver=name.strip(), context=m[3]))
    return out


def _python_type(node: ast.AST | None) -> str | None:
    """The class that an annotation or a constructor's call names."""
    if isinstance(node, ast.Call):
        name = _python_type(node.func)
        return name if name and name[:1].isupper() else None
    if isinstance(node, ast.Subscript):
        return _python_type(node.value)
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        return node.value if node.value.isidentifier() else None
    return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else None


def _python(content: str) -> list[tuple]:
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError):
        return _broken_python(content)
    lines, out, fields = content.split("\n"), [], {}
    at = lambda n: (n.lineno, n.col_offset, lines[n.lineno - 1] if n.lineno <= len(lines) else "")

    def receiver(f: ast.Attribute, types: dict, around: str | None) -> tuple[str, str | None]:
        text, v = " ".join(ast.unparse(f.value).split())[:200], f.value
        if isinstance(v, ast.Name):
            return text, around if v.id in ("self", "cls") else types.get(v.id) or (v.id if v.id[:1].isupper() else None)
        if isinstance(v, ast.Attribute) and isinstance(v.value, ast.Name) and v.value.id == "self":
            return text, fields.get((around, v.attr))
        return text, _python_type(v) if isinstance(v, ast.Call) else None

    def walk(node, owner: str | None, inside: str | None, around: str | None, types: dict) -> None:
        for n in ast.iter_child_nodes(node):
            here = owner
            if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
                out.append(_row("symbol", "method" if inside else "function", n.name, *at(n), owner=inside))
                args = [*n.args.posonlyargs, *n.args.args, *n.args.kwonlyargs]
                walk(n, n.name, None, around, types | {a.arg: t for a in args if (t := _python_type(a.annotation))})
                continue
            if isinstance(n, ast.ClassDef):
                out.append(_row("symbol", "class", n.name, *at(n)))
                for b in n.bases:
                    if name := _python_type(b):
                        out.append(_row("edge", "inherits", n.name, *at(n), owner=n.name, target=name))
                for x in ast.walk(n):
                    if isinstance(x, ast.Assign | ast.AnnAssign):
                        for t in x.targets if isinstance(x, ast.Assign) else [x.target]:
                            found = _python_type(x.annotation) if isinstance(x, ast.AnnAssign) else _python_type(x.value) if isinstance(x.value, ast.Call) else None
                            if found and isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name) and t.value.id == "self":
                                fields[n.name, t.attr] = found
                walk(n, owner, n.name, n.name, types)
                continue
            if isinstance(n, ast.Import):
                out.extend(_row("import", "import", a.name, *at(n), owner=owner, target=a.name, deferred=owner is not None) for a in n.names)
            elif isinstance(n, ast.ImportFrom):
                base = "." * n.level + (n.module or "")
                out.extend(_row("import", "import", a.name, *at(n), owner=owner, target=base, receiver=a.name, deferred=owner is not None) for a in n.names)
                if owner is None:
                    out.extend(_row("name", "reexport", a.asname or a.name, *at(n)[:1], target=base, receiver=a.name, context=base) for a in n.names)
            elif isinstance(n, ast.Call):
                f = n.func
                if isinstance(f, ast.Name):
                    out.append(_row("edge", "calls", owner, *at(n), owner=owner, target=f.id))
                elif isinstance(f, ast.Attribute):
                    text, of = receiver(f, types, around)
                    out.append(_row("edge", "calls", owner, *at(n), owner=owner, target=f.attr, receiver=text, of=of))
            elif isinstance(n, ast.Assign | ast.AnnAssign):
                for t in n.targets if isinstance(n, ast.Assign) else [n.target]:
                    if isinstance(t, ast.Name):
                        types.pop(t.id, None)
                        found = _python_type(n.annotation) if isinstance(n, ast.AnnAssign) else _python_type(n.value) if isinstance(n.value, ast.Call) else None
                        types |= {t.id: found} if found else {}
            walk(n, here, inside, around, types)

    walk(tree, None, None, None, {})
    return out


def extract(content: str | None, language: str | None) -> list[tuple]:
    """Symbols, imports, imported names and raw edges of one file, in the order of ``FOUND``."""
    if not content or language not in {*DECLARATIONS, *scopes.SCANNERS, "python"}:
        return []
    if language == "python":
        return _python(content)
    bare = content if language == "html" else scopes.without_comments(content, language)
    out, importing = _imports(bare, language)
    out += _names(bare, language)
    if language in scopes.SCANNERS:
        for m in DYNAMIC.finditer(bare) if language == "typescript" else ():
            no = _line(bare, m.start())
            out.append(_row("import", "import", m[1], no, 0, content.split("\n")[no - 1], target=m[1], deferred=True))
        return out + scopes.read(content, language, _row)
    lines = content.split("\n")
    markup = NO_MARKUP.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), content)
    for m in TAG.finditer(markup):
        no = _line(markup, m.start())
        kind = "component" if language == "svelte" and m[1][0].isupper() else "element"
        out.append(_row("symbol", kind, m[1], no, m.start() - markup.rfind("\n", 0, m.start()) - 1, lines[no - 1]))
    if language == "html":
        return out
    owner, depth, opened = None, 0, 0
    patterns = [(k, re.compile(p)) for k, p in DECLARATIONS[language]]
    for no, (line, code) in enumerate(zip(content.split("\n"), bare.split("\n"), strict=True), 1):
        declared = set()
        for kind, p in patterns:
            for m in p.finditer(code):
                out.append(_row("symbol", kind, m[1], no, m.start(1), line, owner=owner))
                declared.add(m[1])
                if kind == "function":
                    owner, opened = m[1], depth
        if no not in importing:
            for m in CALL.finditer(code):
                if m[2] not in NOT_CALLS and m[2] not in declared and m[1] not in NOT_CALLS:
                    out.append(_row("edge", "calls", owner, no, m.start(2), line, owner=owner, target=m[2], receiver=m[1]))
        depth += code.count("{") - code.count("}")
        if owner and depth <= opened and "}" in code:
            owner = None
    return out


#: Findings that leave a task's Python at once, or those of one file.
AT_ONCE = 4096
FINDINGS = T.StructType([T.StructField("file", S), T.StructField("language", S), *FOUND.fields])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Findings of ``(file, language, content)``, passed on file by file, so that no batch of files has its findings held."""
    kinds = [{"string": pa.string(), "integer": pa.int32(), "boolean": pa.bool_()}[f.dataType.typeName()] for f in FINDINGS]

    def passed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], FINDINGS.names)

    for batch in batches:
        rows: list[tuple] = []
        for i in range(batch.num_rows):
            file, language, content = (c[i].as_py() for c in batch.columns)
            for found in extract(content, language):
                rows.append((file, language, *found))
                if len(rows) >= AT_ONCE:
                    yield passed(rows)
                    rows = []
        if rows:
            yield passed(rows)


def language_of(path: Column | str) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    pairs = [F.lit(x) for kv in LANGUAGES.items() for x in kv]
    return F.element_at(F.create_map(*pairs), ext)


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, mtime, content, language)`` of known source files; content is only read if used.

    Spark's readers pass over names that begin with an underscore, so the
    ``__init__.py`` beside other Python files are read in tasks of their own, in
    stores that Arrow can open (local, S3, GCS, HDFS).
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    rows = raw.select(_relative(folder).alias("path"), F.col("modificationTime").alias("mtime"), "content").withColumn("language", language_of("path"))
    rows = rows.where(F.col("language").isNotNull() & _visible(F.col("path")))
    root = folder if "://" in folder else "file://" + folder.removeprefix("file:")
    if root.split("://")[0] not in STORES:
        return rows
    packages = rows.where("language = 'python'").select(F.regexp_replace("path", r"[^/]*$", "").alias("folder")).distinct()
    inits = packages.select(F.concat("folder", F.lit("__init__.py")).alias("path"), F.concat(F.lit(root.rstrip("/") + "/"), "folder", F.lit("__init__.py")).alias("uri")).mapInArrow(_opened, "path string, mtime timestamp, content binary")
    return rows.unionByName(inits.withColumn("language", F.lit("python")))


#: Stores whose files tasks open by Arrow.
STORES = ("file", "s3", "gs", "hdfs")


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for path, uri in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            store, at = fs.FileSystem.from_uri(uri)
            info = store.get_file_info(at)
            if info.type == fs.FileType.File:
                with store.open_input_stream(at) as f:
                    out.append((path, info.mtime_ns // 1000, f.read()))
        path, mtime, content = (list(c) for c in zip(*out, strict=True)) if out else ([], [], [])
        yield pa.record_batch([pa.array(path, pa.string()), pa.array(mtime, pa.timestamp("us", tz="UTC")), pa.array(content, pa.binary())], ["path", "mtime", "content"])


def _relative(folder: str) -> Column:
    base = folder.rstrip("/").removeprefix("file://").removeprefix("file:")
    return F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), f"^{re.escape(base)}/", "")


def _visible(path: Column) -> Column:
    hidden = "|".join(re.escape(d) for d in SKIPPED)
    return ~F.rlike(path, F.lit(f"(^|/)({hidden})/"))


def read_file(files: DataFrame, path: str) -> DataFrame:
    """One file of a scan as text; paths that leave the root or are hidden are refused."""
    return files.where(F.col("path") == confined(path)).select("path", F.col("content").cast("string").alias("content"))


def lag_seconds(files: DataFrame, manifest: DataFrame | None) -> int | None:
    """Whole seconds by which the newest file is ahead of the newest indexed one, 0 if it isn't; None without an index."""
    if manifest is None:
        return None
    newest, indexed = (df.agg(F.max(F.unix_micros("mtime"))).first()[0] or 0 for df in (files, manifest))
    return max(newest - indexed, 0) // 1_000_000


def refresh(spark: SparkSession, folder: str, path: str, force: bool = False) -> DataFrame:
    """Bring the code index below ``path`` up to date with a source tree; returns ``codeintel.index_stats``.

    Only files whose time, then hash, changed are parsed; rows of changed and
    vanished files are replaced, and edges are resolved anew over all findings.
    Every run writes a new version and names it last, so readers never see half.
    """
    from ..operators import codeintel

    files = scan(spark, folder)
    old = index_tables(spark, path)
    here = files.select("path", "mtime")
    if old is None or force:
        fresh_files, kept, manifest = files.withColumn("sha256", F.sha2("content", 256)), None, None
    else:
        fresh_files = changed(files, old["manifest"])
        gone = fresh_files.select(F.col("path").alias("file"))
        alive = here.select(F.col("path").alias("file"))
        kept = old["findings"].join(gone, "file", "left_anti").join(alive, "file", "left_semi")
        same = old["manifest"].join(fresh_files.select("path"), "path", "left_anti").select("path", "sha256")
        manifest = same.join(here, "path").select("path", "mtime", "sha256")
    new = stored(fresh_files, "changed-files")
    found = findings(new)
    found = stored(found if kept is None else kept.unionByName(found), "findings")
    marks = new.select("path", "mtime", "sha256")
    marks = marks if manifest is None else manifest.unionByName(marks)
    edges = resolved(found, here, configs(spark, folder))
    at = f"{path.rstrip('/')}/v{uuid.uuid4().hex}"
    for name, df in (("manifest", marks), ("findings", found), ("edges", edges)):
        df.write.parquet(f"{at}/{name}")
    spark.createDataFrame([(at,)], "at string").coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/current")
    read = index_tables(spark, path)
    return codeintel.index_stats(here, new, symbols(read["findings"]), dependencies(read["findings"]), read["edges"])


def resolved(found: DataFrame, files: DataFrame, settings: DataFrame | None = None) -> DataFrame:
    """All edges of ``findings`` over ``files(path)``; ``settings(path, content)`` has configuration files."""
    from ..operators import codeintel

    deps, own = dependencies(found), names(found)
    asked = codeintel.asked_targets(deps, own)
    aliases = None if settings is None else codeintel.resolve_aliases(asked, codeintel.config_mappings(settings), codeintel.workspace_packages(settings))
    targets = stored(codeintel.import_targets(asked, files, aliases), "import-targets")
    known = stored(codeintel.resolve_names(own, targets, symbols(found)), "names")
    imports = codeintel.with_derived(codeintel.resolve_imports(deps, targets), known)
    return imports.unionByName(codeintel.resolve_symbols(raw_edges(found), symbols(found), known))


def configs(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, content)`` of the files that say how TypeScript imports resolve, in folders that scans don't leave out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "{tsconfig.json,package.json,pnpm-workspace.yaml}").load(folder)
    return raw.select(_relative(folder).alias("path"), "content").where(_visible(F.col("path")))


def index_tables(spark: SparkSession, path: str) -> dict[str, DataFrame] | None:
    """``manifest``, ``findings`` and resolved ``edges`` of a stored code index; None where there is none."""
    jvm = spark.sparkContext._jvm
    mark = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/current/_SUCCESS")
    if not mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
        return None
    at = spark.read.parquet(f"{path.rstrip('/')}/current").first()["at"]
    return {name: spark.read.parquet(f"{at}/{name}") for name in ("manifest", "findings", "edges")}


def is_stale(files: DataFrame, manifest: DataFrame) -> bool:
    """Whether a source tree's number of files or newest change differs from what the manifest has; contents aren't read."""
    here, known = (df.agg(F.count(F.lit(1)).alias("n"), F.max(F.unix_micros("mtime")).alias("newest")).first() for df in (files, manifest))
    return here["n"] != known["n"] or (here["newest"] or 0) > (known["newest"] or 0)


def load_edges(spark: SparkSession, folder: str, path: str) -> DataFrame | None:
    """Resolved edges of the index at ``path``, brought up to date first if the tree has moved on; None where none was ever built."""
    tables = index_tables(spark, path)
    if tables is None:
        return None
    if is_stale(scan(spark, folder), tables["manifest"]):
        refresh(spark, folder, path)
        tables = index_tables(spark, path)
    return tables["edges"]


def metadata(spark: SparkSession, folder: str) -> DataFrame:
    """Number of files and the last change, without reading contents."""
    return scan(spark, folder).agg(F.count(F.lit(1)).alias("files"), F.max("mtime").alias("latest"))


def changed(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose mtime, then SHA-256, differs from ``manifest(path, mtime, sha256)``."""
    m = manifest.select("path", F.col("mtime").alias("_mtime"), F.col("sha256").alias("_sha"))
    touched = files.join(m, "path", "left").where(F.col("_mtime").isNull() | (F.col("_mtime") != F.col("mtime")))
    hashed = touched.withColumn("sha256", F.sha2("content", 256))
    return hashed.where(F.col("_sha").isNull() | (F.col("_sha") != F.col("sha256"))).drop("_mtime", "_sha")


def findings(files: DataFrame) -> DataFrame:
    """One row a finding: ``file, language`` and the fields of ``FOUND``."""
    return files.select(F.col("path").alias("file"), "language", F.col("content").cast("string").alias("content")).mapInArrow(_extract, FINDINGS)


def symbols(found: DataFrame) -> DataFrame:
    return found.where("what = 'symbol'").select("file", "name", "kind", "line", "column", "snippet", "language", "owner")


def dependencies(found: DataFrame) -> DataFrame:
    return found.where("what = 'import'").select("file", "target", "line", "kind", "language", "deferred")


def names(found: DataFrame) -> DataFrame:
    """Imported names: ``file, local, name, module, target, line, language, kind``; kind ``reexport`` where the file passes them on."""
    return found.where("what = 'name'").select("file", F.col("name").alias("local"), F.col("receiver").alias("name"), F.col("context").alias("module"), "target", "line", "language", "kind")


def raw_edges(found: DataFrame) -> DataFrame:
    """Edges before resolution: ``source_file, source_symbol, edge_type, target_symbol, receiver, of, context, line, column, language``."""
    return found.where("what = 'edge'").select(F.col("file").alias("source_file"), F.col("owner").alias("source_symbol"), F.col("kind").alias("edge_type"), F.col("target").alias("target_symbol"), "receiver", "of", "context", "line", "column", "language")
