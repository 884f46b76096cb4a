"""Data source `result_documents`: readings of JSON result files, with files skipped before they are parsed.

Filters on `file` are answered from the listing alone. A filter that needs a text inside `name`
(equality, a prefix, a suffix, a part of it, one of several) lets a file be skipped if its bytes hold no such text;
Spark applies it to the rows as well. Files are dealt to input partitions by size, so a folder of
very many small files makes few tasks. A file may hold one document or several in a row.

Options: `path` (a folder or one file, any scheme that pyarrow can open; a plain path is local),
`group_bytes` (bytes of files in one input partition), `suffix` (names of result files).
"""

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

SCHEMA = ("file string, place int, context map<string, string>, name string, real_time double, cpu_time double, "
          "Comm_ms double, ComputeTime_ms double, Size double, Procs double")
NUMBERS = ("real_time", "cpu_time", "Comm_ms", "ComputeTime_ms", "Size", "Procs")


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listing(path: str, suffix: str) -> list[tuple[str, int]]:
    """(path below the folder, bytes) of all result files, in order."""
    from pyarrow import fs

    system, root = _filesystem(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.File:
        return [("", info.size)]
    found = system.get_file_info(fs.FileSelector(root, recursive=True))
    start = len(root.rstrip("/")) + 1
    return sorted((f.path[start:], f.size) for f in found if f.type == fs.FileType.File
                  and f.path.endswith(suffix) and not f.base_name.startswith(("_", ".")))


def _holds(wanted, value: str) -> bool:
    """Whether a text passes a pushed filter."""
    kind, text = type(wanted), wanted.value
    if kind in (ds.EqualTo, ds.EqualNullSafe):
        return value == text
    if kind is ds.In:
        return value in text
    if kind is ds.StringStartsWith:
        return value.startswith(text)
    if kind is ds.StringEndsWith:
        return value.endswith(text)
    return text in value


def _texts(wanted) -> list[str]:
    """Texts of which one must be part of a value that passes."""
    return [t for t in wanted.value if t is not None] if isinstance(wanted, ds.In) else [wanted.value]


_PUSHED = (ds.EqualTo, ds.EqualNullSafe, ds.In, ds.StringStartsWith, ds.StringEndsWith, ds.StringContains)


class Files(ds.InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class ResultReader(ds.DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path = schema, options["path"]
        self.group_bytes = int(options.get("group_bytes", 64 << 20))
        self.suffix = options.get("suffix", "")
        self.on_file, self.in_file = [], []

    def pushFilters(self, filters):
        for f in filters:
            usable = isinstance(f, _PUSHED) and f.value is not None and len(f.attribute) == 1
            if usable and f.attribute[0] == "file":
                self.on_file.append(f)
                continue
            if usable and f.attribute[0] == "name":
                self.in_file.append(f)
            yield f

    def selected(self) -> list[tuple[str, int]]:
        return [(name, size) for name, size in listing(self.path, self.suffix)
                if all(_holds(f, name) for f in self.on_file)]

    def partitions(self):
        groups, room = [], 0
        for name, size in self.selected():
            if not groups or size > room:
                groups.append([])
                room = self.group_bytes
            groups[-1].append(name)
            room -= size
        return [Files(names) for names in groups] or [Files([])]

    def may_hold(self, raw: bytes) -> bool:
        """False only if no reading of the file can pass; a file with escapes is always read."""
        return b"\\" in raw or all(any(t.encode() in raw for t in _texts(f)) for f in self.in_file)

    def read(self, partition):
        system, root = _filesystem(self.path)
        types = to_arrow_schema(self.schema)
        for name in partition.names:
            with system.open_input_stream(f"{root.rstrip('/')}/{name}" if name else root) as stream:
                raw = stream.read()
            if not self.may_hold(raw):
                continue
            rows = [[] for _ in types]
            for document in _documents(raw.decode()):
                context = document.get("context")
                context = None if context is None else [
                    (k, v if isinstance(v, str) else json.dumps(v)) for k, v in context.items()]
                for place, reading in enumerate(document.get("benchmarks") or ()):
                    values = {"file": name, "place": place, "context": context, "name": reading.get("name"),
                              **{k: _number(reading.get(k)) for k in NUMBERS}}
                    for column, field in zip(rows, types):
                        column.append(values.get(field.name))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, types)], schema=types)


def _number(value):
    try:
        return None if value is None else float(value)
    except (TypeError, ValueError):
        return None


def _documents(text: str):
    """JSON objects that follow each other in a text."""
    decoder, at = json.JSONDecoder(), 0
    while True:
        while at < len(text) and text[at].isspace():
            at += 1
        if at == len(text):
            return
        document, at = decoder.raw_decode(text, at)
        if isinstance(document, dict):
            yield document


class ResultDocuments(ds.DataSource):
    @classmethod
    def name(cls):
        return "result_documents"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return ResultReader(schema, self.options)


def scan_results(spark: SparkSession, path: str, **options) -> DataFrame:
    """The readings below a path through the data source; filters reach it where the session allows."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ResultDocuments)
    return spark.read.format("result_documents").options(**options).load(path)
