"""One JSON document per capture, of any size, through a Python data sink.

Rows come sorted by document: first what stands at its head, then the entries of its list, each a JSON text already. A task
writes the documents of its rows one entry at a time, so no list is ever held, into a folder of the job; when all tasks are
done the documents are moved to their place, and a job that fails leaves nothing.
"""

from __future__ import annotations

import os
import urllib.parse
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .iq import open_path

SCHEMA = "file string, head boolean, body string"
SUFFIX = ".json"


@dataclass
class Written(WriterCommitMessage):
    """Documents of one task: (name where it was written, name where it belongs)."""
    documents: list[tuple[str, str]]


def _inner(folder: str) -> tuple[fs.FileSystem, str]:
    return open_path(folder if "://" in folder else urllib.parse.urlparse(folder).path if folder.startswith("file:") else folder)


class _Document:
    """An open document: the head's fields, then the list."""

    def __init__(self, out, file: str, field: str, head: str | None):
        self.out, self.entries = out, 0
        start = (head or "{}").rstrip()[:-1]
        self._put(f'{start}{"," if start != "{" else ""}"{field}":[')

    def _put(self, text: str) -> None:
        self.out.write(text.encode())

    def add(self, body: str) -> None:
        self._put(f'{"," if self.entries else ""}{body}')
        self.entries += 1

    def close(self) -> None:
        self._put("]}\n")
        self.out.close()


class DocumentWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.folder, self.field, self.overwrite = options["path"], options.get("field", "detections"), overwrite
        self.job = f"_job-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        filesystem, folder = _inner(self.folder)
        own = f"{folder}/{self.job}/{uuid.uuid4().hex}"
        file, doc, documents = None, None, []
        for batch in iterator:
            for name, head, body in zip(*(batch.column(c).to_pylist() for c in ("file", "head", "body"))):
                if doc is None or name != file:
                    if doc is not None:
                        doc.close()
                    if not documents:
                        filesystem.create_dir(own)
                    target = urllib.parse.quote(str(name), safe="") + SUFFIX
                    documents.append((f"{own}/{len(documents)}", f"{folder}/{target}"))
                    file, doc = name, _Document(filesystem.open_output_stream(documents[-1][0]), name, self.field, body if head else None)
                if not head:
                    doc.add(body)
        if doc is not None:
            doc.close()
        return Written(documents)

    def commit(self, messages) -> None:
        filesystem, folder = _inner(self.folder)
        filesystem.create_dir(folder)
        new = {to for m in messages if m is not None for _, to in m.documents}
        for m in messages:
            for was, to in m.documents if m is not None else []:
                filesystem.move(was, to)
        if self.overwrite:
            for f in filesystem.get_file_info(fs.FileSelector(folder, recursive=False)):
                if f.type == fs.FileType.File and f.path.endswith(SUFFIX) and os.path.normpath(f.path) not in {os.path.normpath(x) for x in new}:
                    filesystem.delete_file(f.path)
        self._clean()

    def abort(self, messages) -> None:
        self._clean()

    def _clean(self) -> None:
        filesystem, folder = _inner(self.folder)
        if filesystem.get_file_info(f"{folder}/{self.job}").type == fs.FileType.Directory:
            filesystem.delete_dir(f"{folder}/{self.job}")


class DocumentSink(DataSource):
    """format("documents"): path, field (name of the list)."""

    @classmethod
    def name(cls):
        return "documents"

    def schema(self):
        return SCHEMA

    def writer(self, schema, overwrite):
        return DocumentWriter(self.options, overwrite)


def write_documents(entries: DataFrame, heads: DataFrame | None, path: str, field: str, key: str = "file", order: list[Column] | None = None) -> None:
    """A document per value of `key`: the fields of its row in `heads` and the list `field` of its rows in `entries`, in
    `order` (by all fields if none). A file without entries has an empty list, one without a head its name and its list.
    Every document is written by one task that holds one entry at a time; the number of entries has no limit."""
    fields = [c for c in entries.columns if c != key]
    name = F.col(key).cast("string").alias("file")
    by = [c.alias(f"_{i}") for i, c in enumerate(order or [F.col(c) for c in fields])]
    places = [f"_{i}" for i in range(len(by))]
    x = entries.select(name, F.lit(1).alias("_kind"), F.to_json(F.struct(*fields)).alias("body"), *by)
    known = entries.select(F.col(key)).distinct()
    if heads is not None:
        known = known.join(heads.select(key), key, "left_anti")
        h = heads.select(name, F.lit(0).alias("_kind"), F.to_json(F.struct(key, *[c for c in heads.columns if c != key])).alias("body"))
        x = x.unionByName(h, allowMissingColumns=True)
    x = x.unionByName(known.select(name, F.lit(0).alias("_kind"), F.to_json(F.struct(key)).alias("body")), allowMissingColumns=True)
    x = x.repartition("file").sortWithinPartitions("file", "_kind", *places)
    x.sparkSession.dataSource.register(DocumentSink)
    x.select("file", (F.col("_kind") == 0).alias("head"), "body").write.format("documents").option("field", field).mode("overwrite").save(path)
