"""Folder trees as tables: repositories read file by file, and documents written one file each.

A Python data source lists before it reads. The driver lists the repositories and the folders at their top, no
deeper; each of these is a partition, whose task walks it and opens the files. Folders that hold no source are
left out while listing, so nothing below them is listed or opened.
"""

from __future__ import annotations

import os
import posixpath
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

# Folders that are never source.
SKIPPED_FOLDERS = (
    "node_modules", "target", ".git", "build", "dist", "out", "vendor", ".venv", "venv", "__pycache__", ".next",
)
#: Bytes of file content in one batch.
BATCH = 8 << 20


def open_tree(root: str) -> tuple[fs.FileSystem, str]:
    """File system and folder of a root: a path, or a uri that pyarrow knows (file, s3, gs, hdfs, abfs)."""
    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(root))


class Folder(InputPartition):
    """A folder of a repository; with ``deep`` also what is below it."""

    def __init__(self, repo: str, folder: str, deep: bool):
        super().__init__((repo, folder))
        self.repo, self.folder, self.deep = repo, folder, deep


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.skipped = frozenset(options.get("skip", ",".join(SKIPPED_FOLDERS)).split(","))

    def _list(self, files: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
        found = files.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return sorted((f for f in found if f.type != fs.FileType.Directory or f.base_name not in self.skipped), key=lambda f: f.path)

    def partitions(self) -> list[InputPartition]:
        files, base = open_tree(self.root)
        out: list[InputPartition] = []
        for repo in self._list(files, base):
            if repo.type == fs.FileType.Directory:
                out.append(Folder(repo.base_name, "", False))
                out += [Folder(repo.base_name, f.base_name, True) for f in self._list(files, repo.path) if f.type == fs.FileType.Directory]
        return out or [Folder("", "", False)]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        if not partition.repo:
            return
        files, base = open_tree(self.root)
        top = posixpath.join(base, partition.repo)
        todo, rows, size = [posixpath.join(top, partition.folder) if partition.folder else top], [], 0
        while todo:
            for f in self._list(files, todo.pop()):
                if f.type == fs.FileType.Directory:
                    todo += [f.path] if partition.deep else []
                    continue
                with files.open_input_stream(f.path, compression=None) as stream:
                    raw = stream.read()
                try:
                    source = raw.decode()
                except UnicodeDecodeError:
                    continue
                rows.append((partition.repo, posixpath.relpath(f.path, top), source))
                size += len(raw)
                if size >= BATCH:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["repo", "path", "source"])


class _Written(WriterCommitMessage):
    pass


class FileWriter(DataSourceWriter):
    """Writes to a name of its own and renames at the end, so that a task run again leaves whole files only."""

    def __init__(self, options: dict):
        self.root = options["path"]

    def commit(self, messages) -> None:
        pass

    def abort(self, messages) -> None:
        pass


def _place(files: fs.FileSystem, path: str) -> str:
    files.create_dir(posixpath.dirname(path), recursive=True)
    return f"{path}.{uuid.uuid4().hex}.part"


class TreeWriter(FileWriter):
    def write(self, iterator) -> WriterCommitMessage:
        files, base = open_tree(self.root)
        for row in iterator:
            inside = posixpath.normpath(posixpath.join("/", row.repo or "_", row.path)).lstrip("/")
            path = posixpath.join(base, inside)
            part = _place(files, path)
            with files.open_output_stream(part) as out:
                out.write((row.source or "").encode())
            files.move(part, path)
        return _Written()


class RepoTree(DataSource):
    """``<root>/<repo>/...`` as (repo, path, source); options: path, skip (folder names, by commas)."""

    @classmethod
    def name(cls) -> str:
        return "repo_tree"

    def schema(self) -> str:
        return "repo string, path string, source string"

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return TreeWriter(dict(self.options))


class SbomWriter(FileWriter):
    """One CycloneDX document per repository, component by component from rows in the order of repositories."""

    def write(self, iterator) -> WriterCommitMessage:
        import json

        files, base = open_tree(self.root)
        out = path = part = repo = None
        first = True

        def close() -> None:
            if out is not None:
                out.write(b"]}")
                out.close()
                files.move(part, path)

        try:
            for row in iterator:
                if out is None or row.repo != repo:
                    close()
                    repo, first = row.repo, True
                    path = posixpath.join(base, document_name(repo))
                    part = _place(files, path)
                    out = files.open_output_stream(part, buffer_size=1 << 20)
                    out.write(b'{"bomFormat":"CycloneDX","specVersion":"1.5","version":1,"components":[')
                fields = {"type": "library", "bom-ref": row.purl, "name": row.name, "version": row.version, "purl": row.purl}
                out.write((b"" if first else b",") + json.dumps({k: v for k, v in fields.items() if v is not None}, ensure_ascii=False, separators=(",", ":")).encode())
                first = False
            close()
        finally:
            if out is not None and not out.closed:
                out.close()
        return _Written()


def document_name(repo: str | None) -> str:
    """A file name for a repository: slashes and other odd characters are escaped."""
    from urllib.parse import quote

    return f"{quote(repo, safe='')}.cdx.json" if repo else "_.cdx.json"


class SbomDocuments(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sbom_documents"

    def schema(self) -> str:
        return "repo string, name string, version string, purl string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return SbomWriter(dict(self.options))


def read_tree(spark: SparkSession, root: str, skip=SKIPPED_FOLDERS) -> DataFrame:
    spark.dataSource.register(RepoTree)
    return spark.read.format("repo_tree").option("skip", ",".join(skip)).load(root)


def write_tree(files: DataFrame, root: str) -> None:
    """Every row of (repo, path, source) as a file; one that is there is replaced, paths cannot leave ``root``."""
    files.sparkSession.dataSource.register(RepoTree)
    files.select("repo", "path", "source").filter("path is not null").write.format("repo_tree").mode("append").save(root)


def write_sbom_documents(components: DataFrame, path: str) -> None:
    """The components (repo, name, version, purl) as one document file per repository.

    Rows of a repository go to one task, sorted, and are streamed into its file: a document of any size needs no more memory
    than one row.
    """
    components.sparkSession.dataSource.register(SbomDocuments)
    rows = components.select("repo", "name", "version", "purl").repartition("repo").sortWithinPartitions("repo", "purl", "name", "version")
    rows.write.format("sbom_documents").mode("append").save(path)
