"""File tables: reading a folder tree or a table of file rows, and the text checks every scan starts with."""

from __future__ import annotations

import os

import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparkwarden.functions.paths import basename, extension, glob_to_regex, language_of
from sparkwarden.session import stored

SNIFF_BYTES = 8192
# Content handed over by a reading task at a time.
READ_BYTES = 32 << 20


def looks_binary(content: Column) -> Column:
    """A NUL byte within the first 8192 bytes. Empty or missing content is not binary."""
    head = F.substring(content.cast("binary"), 1, SNIFF_BYTES)
    return F.coalesce(F.position(F.lit(b"\x00"), head) > 0, F.lit(False))


def utf8_text(content: Column) -> Column:
    """The content as text, or null where it is not valid UTF-8."""
    return F.try_validate_utf8(content.cast("string"))


def as_files(rows: DataFrame) -> DataFrame:
    """Bring rows of ``repo, path, content`` (binary or string) into the files schema.

    Binary files are dropped. Files that are not valid UTF-8 stay in the table with null content, so
    they count as candidates but give neither findings nor a score. A column ``problem`` (why there is no content) stays.
    """
    problem = ["problem"] if "problem" in rows.columns else []
    return rows.where(~looks_binary(F.col("content"))).select(
        "repo",
        "path",
        extension(F.col("path")).alias("ext"),
        language_of(F.col("path")).alias("language"),
        utf8_text(F.col("content")).alias("content"),
        F.octet_length("content").cast("long").alias("n_bytes"),
        *problem,
    )


def _list_folders(root: str, opened=None):
    """Task function: what lies in each given folder. Names starting with a dot or underscore are listed too.

    A folder that may not be read or is gone gives a row that says so, and its neighbours are listed. Other errors fail the
    task, so that Spark runs it again.
    """

    def run(batches):
        import pandas as pd
        from pyarrow import fs as arrow_fs

        files, base = (opened or arrow_fs.FileSystem.from_uri)(root)
        local = isinstance(files, arrow_fs.LocalFileSystem)
        kinds = {arrow_fs.FileType.Directory: "folder", arrow_fs.FileType.File: "file"}
        for batch in batches:
            for folder in batch["folder"]:
                try:
                    found = files.get_file_info(arrow_fs.FileSelector(folder))
                    rows = [(f.path, kinds[f.type]) for f in found if f.type in kinds and not (local and _through_link(f.path, base))]
                except PermissionError:
                    rows = [(folder, "folder not permitted")]
                except FileNotFoundError:
                    rows = [(folder, "folder not found")]
                yield pd.DataFrame([(p, p[len(base):].lstrip("/"), kind) for p, kind in rows], columns=["full", "rel", "kind"])

    return run


def _through_link(path: str, base: str) -> bool:
    """True if the file or a folder between it and the root is a symbolic link."""
    while len(path) > len(base.rstrip("/")):
        if os.path.islink(path):
            return True
        path = os.path.dirname(path)
    return False


def _read_files(root: str, opened=None):
    """Task function: content of each path, handed over in batches of bounded size.

    A file that may not be read or is gone has null content and says so. Other errors fail the task, so that Spark runs it again.
    """

    def run(batches):
        import pandas as pd
        from pyarrow import fs as arrow_fs

        files, _ = (opened or arrow_fs.FileSystem.from_uri)(root)
        for batch in batches:
            rows, size = [], 0
            for full, rel in zip(batch["full"], batch["rel"]):
                content, problem = None, None
                try:
                    with files.open_input_file(full) as stream:
                        content = stream.read(SNIFF_BYTES)
                        if b"\x00" not in content:  # else it is binary, and its beginning says so
                            content += stream.read()
                except PermissionError:
                    problem = "file not permitted"
                except FileNotFoundError:
                    problem = "file not found"
                rows.append((rel, content, problem))
                size += len(content or b"")
                if size >= READ_BYTES:
                    yield pd.DataFrame(rows, columns=["rel", "content", "problem"])
                    rows, size = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=["rel", "content", "problem"])

    return run


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """``full, rel, kind`` of all below ``root``; kind is file, folder, or why a folder could not be listed.

    Level by level, the folders of each dealt out evenly, so that one repository is listed by many tasks.
    """
    uri = _uri(root)
    files, base = pyarrow.fs.FileSystem.from_uri(uri)
    files.get_file_info(pyarrow.fs.FileSelector(base))  # a missing root raises here
    listed, folders, n = None, spark.createDataFrame([(base,)], "folder string"), 1
    while n:
        tasks = min(n, 4 * spark.sparkContext.defaultParallelism)
        level = stored(folders.repartition(tasks, "folder").mapInPandas(_list_folders(uri), "full string, rel string, kind string"))
        listed = level if listed is None else listed.unionByName(level)
        folders = level.where("kind = 'folder'").select(F.col("full").alias("folder"))
        n = folders.count()
    return listed


def _uri(root: str) -> str:
    return root if "://" in root else f"file://{os.path.abspath(root)}"


def _placed(rel: Column, repo: str | None) -> list[Column]:
    if repo is None:
        return [F.substring_index(rel, "/", 1).alias("repo"), F.regexp_replace(rel, F.lit("^[^/]*/"), F.lit("")).alias("path")]
    return [F.lit(repo).alias("repo"), rel.alias("path")]


def tree_errors(listed: DataFrame, repo: str | None = None) -> DataFrame:
    """``repo, path, verifier_id, reason`` of the folders of ``list_tree`` that could not be listed, for the errors table."""
    rows = listed.where("kind NOT IN ('file', 'folder')")
    return rows.select(*_placed(F.col("rel"), repo), F.lit("files").alias("verifier_id"), F.col("kind").alias("reason"))


def read_tree(
    spark: SparkSession, root: str, repo: str | None = None, name_glob: str | None = None, listed: DataFrame | None = None
) -> DataFrame:
    """Every regular file under ``root`` (a path or URI all executors see), hidden ones included, as a files table.

    Spark's own file sources pass over names that start with a dot or underscore, such as ignore files and
    ``__init__.py``. So tasks list the folders and then read the files, evenly spread. Links are not
    followed. ``listed`` is what ``list_tree`` gave, to take ``tree_errors`` from the same listing. With ``repo`` unset the first folder below the root names the repository. A missing root
    raises FileNotFoundError. For large corpora keep the files in a columnar table and use ``as_files``.
    """
    listed = (list_tree(spark, root) if listed is None else listed).where("kind = 'file'").select("full", "rel")
    if name_glob:
        listed = listed.where(F.rlike(basename(F.col("rel")), F.lit(glob_to_regex(name_glob) or "^$")))
    raw = listed.repartition("full").mapInPandas(_read_files(_uri(root)), "rel string, content binary, problem string")
    return as_files(raw.select(*_placed(F.col("rel"), repo), "content", "problem"))
