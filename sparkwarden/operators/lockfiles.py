"""Package lists from lockfiles.

Each parser is an expression from file text to ``array<struct<name,version>>``: one row in, one row
out, no shuffle. Text that cannot be read gives an empty array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sparkwarden.functions.arrays import let
from sparkwarden.functions.paths import basename
from sparkwarden.functions.text import lines, strip

PACKAGE_ARRAY = "array<struct<name:string,version:string>>"

# Lockfile name -> (ecosystem, order in which the files of one ecosystem are tried).
LOCKFILES = {
    "package-lock.json": ("npm", 1),
    "pnpm-lock.yaml": ("npm", 2),
    "yarn.lock": ("npm", 3),
    "poetry.lock": ("PyPI", 1),
    "requirements.txt": ("PyPI", 2),
    "go.sum": ("Go", 1),
    "Cargo.lock": ("Rust", 1),
}


def _package(name: Column, version: Column) -> Column:
    return F.struct(name.alias("name"), version.alias("version"))


def _named(packages: Column) -> Column:
    return F.filter(packages, lambda p: (p["name"] != "") & (p["version"] != ""))


def _unix(text: Column) -> Column:
    return F.replace(text, F.lit("\r\n"), F.lit("\n"))


def npm_packages(text: Column) -> Column:
    """``packages`` map of a package-lock (version 2 and 3). The name follows the last ``node_modules/``."""
    parsed = F.from_json(text, "packages map<string,struct<version:string>>")
    entries = F.coalesce(F.map_entries(parsed["packages"]), F.expr("cast(array() as array<struct<key:string,value:struct<version:string>>>)"))
    # The same entries with their values as JSON: a version that is no string voids the file.
    raw = F.from_json(text, "packages map<string,map<string,variant>>")
    typed = F.map_values(raw["packages"])
    string = lambda v: F.schema_of_variant(v).isin("STRING", "VOID")
    sound = F.coalesce(F.forall(typed, lambda v: F.coalesce(string(F.try_element_at(v, F.lit("version"))), F.lit(True))), F.lit(True))
    found = F.transform(
        F.filter(entries, lambda e: (e["key"] != "") & e["value"]["version"].isNotNull()),
        lambda e: _package(F.substring_index(e["key"], "node_modules/", -1), e["value"]["version"]),
    )
    return F.when(sound, F.filter(found, lambda p: p["name"] != "")).otherwise(F.filter(found, lambda p: F.lit(False)))


def pnpm_packages(text: Column) -> Column:
    """Keys ``/name@version:`` in the ``packages:`` section; a peer suffix in parentheses is cut off."""
    # Every line that is not indented by two spaces and not empty opens a section.
    sections = F.filter(
        F.split(_unix(text), r"(?md)^(?=(?!  )[^\n])"), lambda s: F.startswith(s, F.lit("packages:"))
    )
    keys = F.flatten(
        F.transform(
            sections,
            lambda s: F.filter(
                F.transform(F.split(s, "\n"), strip),
                lambda line: F.startswith(line, F.lit("/")) & F.endswith(line, F.lit(":")),
            ),
        )
    )

    def read(key: Column) -> Column:
        bare = F.substring_index(F.regexp_replace(key, F.lit("(?s)^/(.*):$"), F.lit("$1")), "(", 1)
        return _package(
            F.regexp_extract(bare, r"(?s)^(@?[^@]*)@(.*)$", 1), F.regexp_extract(bare, r"(?s)^(@?[^@]*)@(.*)$", 2)
        )

    return _named(F.transform(keys, read))


def yarn_packages(text: Column) -> Column:
    """Yarn v1 blocks: name from the first descriptor, version from the first indented version line."""
    blocks = F.filter(
        F.split(_unix(text), r"(?md)^(?=[\p{IsAlphabetic}\p{N}\"][^,\n]*@)"),
        lambda b: F.rlike(b, F.lit(r"^[\p{IsAlphabetic}\p{N}\"][^,\n]*@")),
    )

    def read(block: Column) -> Column:
        head = strip(F.substring_index(F.regexp_replace(F.substring_index(block, "\n", 1), F.lit(":+$"), F.lit("")), ",", 1))
        first = F.regexp_replace(head, F.lit('^"+|"+$'), F.lit(""))
        name = F.regexp_replace(first, F.lit("@[^@]*$"), F.lit(""))
        raw = F.regexp_extract(block, r"(?md)^[^\S\n]+(?:version )+([^\n]*)$", 1)
        found = F.rlike(block, F.lit(r"(?md)^[^\S\n]+version "))
        return F.struct(
            name.alias("name"), F.regexp_replace(strip(raw), F.lit('^"+|"+$'), F.lit("")).alias("version"), found.alias("found")
        )

    return F.transform(
        F.filter(F.transform(blocks, read), lambda p: p["found"]), lambda p: _package(p["name"], p["version"])
    )


def toml_packages(text: Column) -> Column:
    """``[[package]]`` tables with name and version; one incomplete entry voids the whole file."""

    def read(entry: Column) -> Column:
        own = F.get(F.split(entry, r"(?md)^\["), F.lit(0))

        def value(key: str) -> Column:
            found = F.regexp_extract(own, rf"(?md)^\s*{key}\s*=\s*(\"[^\"\n]*\"|'[^'\n]*')", 1)
            return F.when(found != "", F.substring(found, F.lit(2), F.length(found) - 2))

        return _package(value("name"), value("version"))

    entries = F.split(_unix(text), r"(?md)^[^\S\n]*\[\[package\]\][^\S\n]*(?:#[^\n]*)?$")
    packages = F.transform(F.slice(entries, F.lit(2), F.size(entries)), read)
    return let(
        packages,
        lambda ps: F.when(F.forall(ps, lambda p: p["name"].isNotNull() & p["version"].isNotNull()), ps).otherwise(
            F.expr(f"cast(array() as {PACKAGE_ARRAY})")
        ),
    )


def requirement_packages(text: Column) -> Column:
    """Pinned lines ``name==version``; what follows the version is cut off, other lines are skipped."""
    pinned = F.filter(
        F.transform(lines(text), strip),
        lambda line: ~F.startswith(line, F.lit("#")) & ~F.startswith(line, F.lit("-r ")) & F.contains(line, F.lit("==")),
    )

    def read(line: Column) -> Column:
        halves = F.split(line, "==", 2)
        return _package(strip(halves[0]), strip(F.get(F.split(halves[1], "[;, ]", 2), F.lit(0))))

    return _named(F.transform(pinned, read))


def go_packages(text: Column) -> Column:
    """Module and version of each line, ``/go.mod`` marks removed, without repeats."""
    fields = F.transform(lines(text), lambda line: F.split(strip(line), r"(?U)\s+"))
    return F.array_distinct(
        F.transform(
            F.filter(fields, lambda f: F.size(f) >= 2),
            lambda f: _package(f[0], F.regexp_replace(f[1], F.lit(r"(?:/go\.mod)+$"), F.lit(""))),
        )
    )


PARSERS = {
    "package-lock.json": npm_packages,
    "pnpm-lock.yaml": pnpm_packages,
    "yarn.lock": yarn_packages,
    "poetry.lock": toml_packages,
    "requirements.txt": requirement_packages,
    "go.sum": go_packages,
    "Cargo.lock": toml_packages,
}


def _by_name(name: Column, values: dict) -> Column:
    out = None
    for key, value in values.items():
        out = (F if out is None else out).when(name == key, value)
    return out


def packages_in(path: Column, text: Column) -> Column:
    """Packages of one file by its name; null for files that are no lockfiles."""
    name = basename(path)
    parsed = _by_name(name, {key: parser(text) for key, parser in PARSERS.items()})
    return F.when(name.isin(list(LOCKFILES)), F.coalesce(parsed, F.expr(f"cast(array() as {PACKAGE_ARRAY})")))


def lockfile_rows(rows: DataFrame) -> DataFrame:
    """Ecosystem and order for rows of ``repo, path, packages``."""
    name = basename(F.col("path"))
    return rows.select(
        "repo",
        F.col("path").alias("lockfile_path"),
        name.alias("lockfile"),
        _by_name(name, {k: F.lit(v[0]) for k, v in LOCKFILES.items()}).alias("ecosystem"),
        _by_name(name, {k: F.lit(v[1]) for k, v in LOCKFILES.items()}).alias("priority"),
        "packages",
    )


def parsed_lockfiles(files: DataFrame, root_only: bool = True) -> DataFrame:
    """Each lockfile with its packages as an array. Only those at the root of a repository count.

    The path test for root lockfiles is a plain list of values, which the scan of a columnar table can use.
    """
    wanted = F.col("path").isin(list(LOCKFILES)) if root_only else basename(F.col("path")).isin(list(LOCKFILES))
    locks = files.where(wanted & F.col("content").isNotNull())
    return lockfile_rows(locks.select("repo", "path", packages_in(F.col("path"), F.col("content")).alias("packages")))


def all_packages(files: DataFrame, root_only: bool = True) -> DataFrame:
    """Packages of every lockfile, without choosing between lockfiles."""
    rows = parsed_lockfiles(files, root_only).select(
        "repo", "lockfile_path", "ecosystem", F.explode_outer("packages").alias("p")
    )
    return rows.where(F.col("p").isNotNull()).select("repo", "lockfile_path", "ecosystem", "p.name", "p.version")


def chosen_packages(files: DataFrame) -> DataFrame:
    """Packages per repository and ecosystem, from its first lockfile that gives any."""
    return first_lockfiles(parsed_lockfiles(files))


def first_lockfiles(parsed: DataFrame) -> DataFrame:
    """The choice between the (at most three) root lockfiles of each repository and ecosystem."""
    chosen = parsed.groupBy("repo", "ecosystem").agg(
        F.min_by(
            F.struct("lockfile_path", "packages"),
            F.when(F.size("packages") > 0, F.col("priority")),
        ).alias("first")
    )
    rows = chosen.select("repo", "first.lockfile_path", "ecosystem", F.explode_outer("first.packages").alias("p"))
    return rows.where(F.col("p").isNotNull()).select("repo", "lockfile_path", "ecosystem", "p.name", "p.version")
