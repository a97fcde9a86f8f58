"""Imports that nothing in the repository, its lockfiles or the language explains."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, functions as F

from sparkwarden.functions.arrays import running
from sparkwarden.functions.code import family_of, without_hidden
from sparkwarden.functions.paths import basename
from sparkwarden.session import stored

VERIFIER = "hallucination"
DESCRIPTION = "Imports of modules that do not exist"
RULE, SEVERITY = "hallucination.unresolved-import", "high"

#: Modules that come with a language; Python's own list is that of the running interpreter.
STANDARD = {
    "python": sorted(sys.stdlib_module_names),
    "script": "assert async_hooks buffer child_process cluster console crypto dgram dns events fs http http2 https module net os "
    "path perf_hooks process querystring readline stream string_decoder timers tls tty url util v8 vm worker_threads zlib".split(),
    "rust": "alloc core crate proc_macro self std super test".split(),
}
ECOSYSTEMS = {"PyPI": "python", "Rust": "rust", "npm": "script"}

#: Files whose folder, and the folders ``src`` and ``lib`` in it, are places where modules are looked for, as are those of the repository.
MANIFESTS = "pyproject.toml setup.py setup.cfg manage.py package.json tsconfig.json Cargo.toml go.mod".split()
INNER_ROOTS = ["src", "lib"]

#: Heads of Rust paths that are neither modules nor crates: primitive types and tools named in attributes.
RUST_HEADS = "bool char f32 f64 i8 i16 i32 i64 i128 isize str u8 u16 u32 u64 u128 usize clippy diagnostic miri rustdoc rustfmt".split()

_NAME = r"[^\W\d]\w*+"
_DOTTED = rf"{_NAME}(?:[ \t]*+\.[ \t]*+{_NAME})*+"
_START = r"(?mU)(?:^|[;:])[ \t]*+"
#: Statements of Python without strings and comments: the list of modules, and the module that names come from.
_PYTHON_LIST = rf"{_START}import[ \t]++([^\n;]*+)"
_PYTHON_FROM = rf"{_START}from(?=[ \t.])[ \t]*+((?:\.[ \t]*+)*+(?:{_DOTTED})?)[ \t]*+import\b"
#: Static, dynamic and required modules of scripts; templates with a placeholder name none.
_SCRIPT = (
    r"""(?:\bfrom\s*+|\brequire(?:\.resolve)?\s*+\(\s*+|\bimport\s*+(?:\(\s*+)?+)(?:/\*[^*]*+\*/\s*+)*+['"`](?!(?:[^'"`$]|\$(?!\{))*+\$\{)"""
    r"""(@[^'"`/]+/[^'"`/]+|[^'"`./@:][^'"`/:]*+)"""
)
_RUST_USE = r"\buse\s++([^;]++)(?:;|\z)"
_RUST_EXTERN = r"\bextern\s++crate\s++(\w++)"
#: Names that a file declares itself or binds by another name.
_RUST_DECLARED = r"\b(?:mod|enum|struct|trait|type|union)\s++(\w++)"
_RUST_ALIAS = r"\bextern\s++crate\s++\w++\s++as\s++(\w++)"
#: The head of a path in code; crates and modules begin with a small letter. A generic call is no path.
_RUST_PATH = r"(?<![\w:$.#>])(?:::\s*+)?([a-z_]\w*+)\s*+::(?!\s*+<)"

_NONE = "cast(array() as array<string>)"


def _spelled(name: Column, family: Column) -> Column:
    """Package names in files use underscores and lower case, but for scripts."""
    return F.when(family == "script", name).otherwise(F.lower(F.replace(name, F.lit("-"), F.lit("_"))))


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def _each(items: Column, read) -> Column:
    return F.flatten(F.transform(items, read))


def _once(value: Column, read) -> Column:
    """``read`` of a value that is worked out once, as an array."""
    return _each(F.array(value), read)


def _tight(name: Column) -> Column:
    return F.regexp_replace(name, F.lit(r"\s++"), F.lit(""))


def _python_modules(text: Column) -> Column:
    """Dotted modules; relative ones begin with their dots."""

    def read(code: Column) -> Column:
        lists = _each(_all(code, _PYTHON_LIST), lambda names: F.split(names, ","))
        heads = F.transform(lists, lambda name: _tight(F.regexp_extract(name, rf"(?U)^\s*+({_DOTTED})", 1)))
        return F.filter(F.concat(heads, F.transform(_all(code, _PYTHON_FROM), _tight)), lambda m: F.rlike(m, F.lit(r"[^.]")))

    return _once(F.replace(without_hidden(text, "python"), F.lit("\\\n"), F.lit(" ")), read)


def _rust_roots(tree: Column) -> Column:
    """First names of a use tree; a tree in braces has several: those of the parts that begin outside inner braces."""
    bare = F.regexp_replace(tree, r"^\s*+(?:::\s*+)?\{([\s\S]*)\}\s*+$", "$1")

    def read(parts: Column) -> Column:
        deeper = F.transform(parts, lambda t: F.length(F.regexp_replace(t, r"[^{]++", "")) - F.length(F.regexp_replace(t, r"[^}]++", "")))
        depth = running(deeper, F.lit(0), lambda a, b: a + b)
        outer = F.filter(F.zip_with(parts, depth, lambda t, d: F.when(d <= 0, t)), lambda t: t.isNotNull())
        return F.transform(outer, lambda t: F.regexp_extract(t, r"^\s*+(?:::\s*+)?([A-Za-z_]\w*+)", 1))

    return F.filter(_once(F.split(bare, ","), read), lambda root: root != "")


def _rust_bound(tree: Column) -> Column:
    """Names that a use tree brings into the file."""
    own = F.when(tree.rlike(r"\bself\b"), _all(tree, r"\b(\w++)\s*+::\s*+\{"))
    return F.concat(_all(tree, r"\b(\w++)\s*+(?:[,}]|$)"), F.coalesce(own, F.expr(_NONE)))


def _rust_modules(text: Column) -> Column:
    def read(code: Column) -> Column:
        uses = _all(code, _RUST_USE)
        bound = F.concat(_each(uses, _rust_bound), _all(code, _RUST_ALIAS), F.array(*[F.lit(h) for h in RUST_HEADS]))
        paths = F.array_except(_all(F.regexp_replace(code, _RUST_USE, ";"), _RUST_PATH), bound)
        named = F.concat(_each(uses, _rust_roots), _all(code, _RUST_EXTERN), paths)
        return F.array_except(named, _all(code, _RUST_DECLARED))

    return _once(without_hidden(text, "rust"), read)


MODULES = {"python": _python_modules, "script": lambda text: _all(text, _SCRIPT), "rust": _rust_modules}


def imported_modules(text: Column, language: Column) -> Column:
    """Distinct modules that a file imports: dotted ones of Python, packages of scripts, heads of paths of Rust."""
    out = None
    for family, modules in MODULES.items():
        out = (F if out is None else out).when(family_of(language) == family, modules(text))
    return F.array_distinct(out.otherwise(F.expr(_NONE)))


def _folder(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, F.lit(r"/[^/]*$"), F.lit(""))).otherwise(F.lit(""))


def _above(path: Column) -> Column:
    """All folders that hold a path, the repository's own ("") first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def _under(folder: Column, name: Column) -> Column:
    return F.when(folder == "", name).otherwise(F.concat(folder, F.lit("/"), name))


def module_roots(files: DataFrame) -> DataFrame:
    """``repo, root``: folders whose modules go by their own names."""
    named = files.where(basename(F.col("path")).isin(MANIFESTS)).select("repo", _folder(F.col("path")).alias("folder"))
    folders = files.select("repo", F.lit("").alias("folder")).unionByName(named).distinct()
    inner = F.array(F.col("folder"), *[_under(F.col("folder"), F.lit(name)) for name in INNER_ROOTS])
    return folders.select("repo", F.explode(inner).alias("root")).distinct()


def module_paths(files: DataFrame) -> DataFrame:
    """``repo, family, place``: every code file without its extension and every folder that holds one, spelled as in imports.

    A package's ``__init__`` is its folder; a crate is the folder that holds its ``lib.rs``, its manifest, or ``src/lib.rs``.
    Crates and script packages also go by the names in their manifests.
    """
    family = family_of(F.col("language"))
    code = files.select("repo", "path", family.alias("family")).where("family IN ('python', 'script')")
    stem = F.regexp_replace("path", F.lit(r"(?:\.d)?\.[^./]*$"), F.lit(""))
    places = F.concat(F.array(stem), F.filter(_above(F.col("path")), lambda f: f != ""))
    rows = code.select("repo", "family", F.explode(places).alias("place"))
    crates = files.where(F.rlike("path", F.lit(r"/(?:lib\.rs|Cargo\.toml)$")))
    crate = basename(F.regexp_replace("path", F.lit(r"(?:/src)?/[^/]*$"), F.lit("")))
    crates = crates.select("repo", F.lit("rust").alias("family"), crate.alias("place"))
    name = basename(F.col("path"))
    own = F.when(name == "Cargo.toml", F.regexp_extract("content", r'(?m)^[ \t]*+name[ \t]*+=[ \t]*+"([^"\n]++)"', 1))
    own = own.when(name == "package.json", F.get_json_object("content", "$.name"))
    kind = F.when(name == "Cargo.toml", F.lit("rust")).otherwise(F.lit("script"))
    named = files.where(name.isin("Cargo.toml", "package.json")).select("repo", kind.alias("family"), own.alias("place")).where("place <> ''")
    rows = rows.unionByName(crates).unionByName(named)
    return rows.select("repo", "family", _spelled(F.col("place"), F.col("family")).alias("place")).distinct()


def unresolved_imports(files: DataFrame, packages: DataFrame) -> DataFrame:
    """``repo, path, module, verifier_id, rule_id, severity`` of imports without a source, each module once per file.

    A module is known if it is a package of one of the repository's lockfiles, a standard module, or code of the same language
    family: in Python and scripts below a root (the repository, folders with a manifest, and ``src`` and ``lib`` in them), in Python
    also beside the importing file, in Rust a crate of the repository. Of a dotted module of Python the longest known beginning is looked for,
    and if it is the repository's own, the next part is missing; relative modules are looked for from the file's folder.

    Modules are made distinct per folder before they meet the known ones in equi joins; text goes through no shuffle.
    """
    family = family_of(F.col("language"))
    found = files.select("repo", "path", family.alias("family"), F.explode(imported_modules(F.col("content"), F.col("language"))).alias("ref"))
    dots = F.length(F.regexp_extract("ref", r"^\.*", 0))
    here = F.split(_folder(F.col("path")), "/")
    up = F.array_join(F.slice(here, F.lit(1), F.greatest(F.size(here) - dots + 1, F.lit(0))), "/")
    found = found.withColumn("dots", F.when(F.col("family") == "python", dots).otherwise(F.lit(0)))
    found = found.withColumn("folder", F.when(F.col("dots") > 0, up).when(F.col("family") == "python", _folder(F.col("path"))))
    found = found.withColumn("parts", F.when(F.col("family") == "python", F.split(F.expr("substring(ref, dots + 1)"), r"\.")).otherwise(F.array("ref")))
    head = F.get("parts", F.lit(0))
    standard = F.lit(False)
    for name, modules in STANDARD.items():
        standard = standard | ((F.col("family") == name) & head.isin(modules))
    found = stored(found.where(~(standard & (F.col("dots") == 0))))
    refs = found.select("repo", "family", "folder", "dots", "ref", "parts").distinct()

    ecosystem = F.create_map(*[F.lit(x) for pair in ECOSYSTEMS.items() for x in pair])
    declared = packages.select("repo", ecosystem[F.col("ecosystem")].alias("family"), "name").where("family IS NOT NULL")
    declared = declared.select("repo", "family", _spelled(F.col("name"), F.col("family")).alias("head")).distinct()
    refs = refs.withColumn("head", F.when(F.col("dots") == 0, _spelled(head, F.col("family"))))
    refs = refs.join(declared, ["repo", "family", "head"], "left_anti")

    beginning = F.transform(
        F.sequence(F.lit(1), F.size("parts")),
        lambda n: F.struct(n.alias("n"), F.array_join(F.slice("parts", F.lit(1), n), "/").alias("name")),
    )
    asked = refs.select("repo", "family", "folder", "dots", "ref", F.explode(beginning).alias("b"))
    asked = asked.select("repo", "family", "folder", "dots", "ref", "b.n", _spelled(F.col("b.name"), F.col("family")).alias("name"))
    places = module_paths(files)
    roots = module_roots(files).withColumnRenamed("root", "above")
    rooted = places.where("family <> 'rust'").select("repo", "family", "place", F.explode(_above(F.col("place"))).alias("above"))
    spelled_roots = roots.select("repo", F.explode(F.array_distinct(F.array("above", F.lower(F.replace("above", F.lit("-"), F.lit("_")))))).alias("above"))
    rooted = rooted.join(spelled_roots.distinct(), ["repo", "above"], "left_semi")
    inside = F.when(F.col("above") == "", F.col("place")).otherwise(F.expr("substring(place, length(above) + 2)"))
    rooted = rooted.select("repo", "family", inside.alias("name")).where("name <> ''")
    rooted = rooted.unionByName(places.where("family = 'rust'").withColumnRenamed("place", "name")).distinct()
    known = asked.where("dots = 0").join(rooted, ["repo", "family", "name"], "left_semi")
    beside = asked.where("folder IS NOT NULL").withColumn("place", _under(_spelled(F.col("folder"), F.col("family")), F.col("name")))
    beside = beside.join(places, ["repo", "family", "place"], "left_semi").drop("place")
    key = ["repo", "family", "folder", "ref"]
    reach = known.unionByName(beside).groupBy(*key).agg(F.max("n").alias("n")).alias("k")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"k.{c}")) if c == "folder" else F.col(f"r.{c}") == F.col(f"k.{c}") for c in key]
    open_refs = refs.alias("r").join(reach, same, "left").select("r.*", F.coalesce("k.n", F.lit(0)).alias("n")).where("n < size(parts)")
    missing = F.concat(F.expr("repeat('.', dots)"), F.array_join(F.slice("parts", F.lit(1), F.col("n") + 1), "."))
    open_refs = open_refs.select(*key, missing.alias("module")).alias("o")
    same = [F.col(f"f.{c}").eqNullSafe(F.col(f"o.{c}")) if c == "folder" else F.col(f"f.{c}") == F.col(f"o.{c}") for c in key]
    rows = found.alias("f").join(open_refs, same).select("f.repo", "f.path", "o.module").distinct()
    return rows.select(
        "repo", "path", "module", F.lit(VERIFIER).alias("verifier_id"), F.lit(RULE).alias("rule_id"), F.lit(SEVERITY).alias("severity")
    )
