"""Digests of dump files, read once and in blocks."""

import hashlib
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F, types as T

BLOCK = 4 << 20
END_MARKER = b"-- Dump completed"
TAIL = 256

DIGESTS = [("artifact_sha256", "string"), ("payload_sha256", "string"), ("payload_bytes", "long"),
           ("has_end_marker", "boolean"), ("header_error", "boolean"), ("gzip_error", "string")]


class _Payload:
    """Inflates gzip members one after the other, keeping only digest, size and tail."""

    def __init__(self):
        self.sha, self.size, self.tail = hashlib.sha256(), 0, b""
        self.member, self.members, self.pending, self.error = None, 0, b"", None

    def feed(self, data: bytes):
        data = self.pending + data
        self.pending = b""
        while data and self.error is None:
            if self.member is None:
                if len(data) < 3:
                    self.pending = data
                    return
                if data[:3] != b"\x1f\x8b\x08":
                    self.error = "gzip: invalid header"
                    return
                self.member = zlib.decompressobj(wbits=31)
            try:
                data = self._inflate(data)
            except zlib.error as failure:
                self.error = "gzip: invalid checksum" if "incorrect" in str(failure) else f"flate: {failure}"

    def _inflate(self, data: bytes) -> bytes:
        """Inflates in bounded steps; returns what follows the end of the member."""
        while True:
            text = self.member.decompress(data, BLOCK)
            self._take(text)
            if self.member.eof:
                rest, self.member, self.members = self.member.unused_data, None, self.members + 1
                return rest
            data = self.member.unconsumed_tail
            if not data and len(text) < BLOCK:
                return b""

    def _take(self, text: bytes):
        self.sha.update(text)
        self.size += len(text)
        self.tail = (self.tail + text)[-TAIL:]

    def close(self):
        if self.error is None and (self.member is not None or self.pending or not self.members):
            self.error = "EOF" if not self.members and self.member is None and not self.pending else "unexpected EOF"

    @property
    def bad_header(self) -> bool:
        return self.error is not None and self.members == 0 and self.member is None


def _locate(path: str):
    """File system and name of a path as Spark writes it."""
    uri = path.replace("s3a://", "s3://", 1)
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri)


def _open(path: str):
    filesystem, name = _locate(path)
    return filesystem.open_input_stream(name, compression=None)


def _digest(path: str):
    whole, payload = hashlib.sha256(), _Payload()
    with _open(path) as stream:
        while block := stream.read(BLOCK):
            whole.update(block)
            if payload.error is None:
                payload.feed(block)
    payload.close()
    good = payload.error is None
    return (whole.hexdigest(), payload.sha.hexdigest() if good else None, payload.size,
            END_MARKER in payload.tail if good else False, payload.bad_header, payload.error)


def list_folders(folders: DataFrame) -> DataFrame:
    """What is in each folder of column ``run_folder``, listed by the tasks: (run_folder, rel_path, path, bytes).

    A folder that exists has one row without ``rel_path``; one that is gone
    has no row. Unlike Spark's file sources this also finds empty files.
    """
    schema = "run_folder string, rel_path string, path string, bytes bigint"
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64()]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], names=["run_folder", "rel_path", "path", "bytes"])

    def entries(batches):
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                filesystem, name = _locate(folder)
                if filesystem.get_file_info(name).type != fs.FileType.Directory:
                    continue
                yield batch_of([(folder, None, None, None)])
                found = [f for f in filesystem.get_file_info(fs.FileSelector(name, recursive=True))
                         if f.type == fs.FileType.File]
                rows = [(folder, f.path[len(name.rstrip("/")) + 1:], folder.rstrip("/") + f.path[len(name.rstrip("/")):], f.size)
                        for f in found]
                if rows:
                    yield batch_of(rows)

    wanted = folders.select("run_folder").where("run_folder != ''").distinct()
    return wanted.mapInArrow(entries, schema)


def listed_artifacts(listing: DataFrame) -> DataFrame:
    """The dumps of a folder listing as artifacts (run_folder, run_id, db, path, bytes).

    The same run id may stand for runs of several hosts; ``run_folder`` tells
    them apart, and joins them to the records that name it.
    """
    db = F.regexp_extract("rel_path", r"^([^/]+)\.sql\.gz$", 1)
    return listing.where(db != "").select(
        "run_folder", F.regexp_extract("run_folder", r"([^/]+)/*$", 1).alias("run_id"), db.alias("db"), "path", "bytes")


def listed_parts(listing: DataFrame) -> DataFrame:
    """Files of exports in a folder listing: (run_folder, section, db, table_name, part, path).

    ``section`` is data, or commit for the files of commit records.
    """
    data, commit = r"^([^_/][^/]*)/([^/]+)/([^/_.][^/]*\.parquet)$", r"^_commits/([^/]+)/([^/_.][^/]*\.parquet)$"
    def found(pattern, group):
        return F.nullif(F.regexp_extract("rel_path", pattern, group), F.lit(""))
    return listing.where(F.col("rel_path").rlike(data) | F.col("rel_path").rlike(commit)).select(
        "run_folder", F.when(F.col("rel_path").rlike(commit), "commit").otherwise("data").alias("section"),
        F.coalesce(found(commit, 1), found(data, 1)).alias("db"), found(data, 2).alias("table_name"),
        F.coalesce(found(commit, 2), found(data, 3)).alias("part"), "path")


def committed_rows(files: DataFrame) -> DataFrame:
    """Rows (keys of ``files``, table_name, part, sha256) of the commit records in column ``path``, read by tasks in
    row groups; a file that can't be read has one row without a table."""
    import pyarrow.parquet as pq

    keys = [c for c in files.columns if c != "path"]
    schema = T.StructType([files.schema[k] for k in keys]).add("table_name", "string").add("part", "string").add("sha256", "string")
    names = ["table_name", "part", "sha256"]

    def rows(batches):
        for batch in batches:
            for i, path in enumerate(batch.column("path").to_pylist()):
                filesystem, name = _locate(path)
                try:
                    with filesystem.open_input_file(name) as source:
                        for found in pq.ParquetFile(source).iter_batches(columns=names):
                            same = [batch.column(k).take(pa.array([i] * found.num_rows)) for k in keys]
                            yield pa.RecordBatch.from_arrays([*same, *(found.column(n) for n in names)], names=[*keys, *names])
                except (OSError, pa.ArrowInvalid) as failure:
                    same = [batch.column(k).slice(i, 1) for k in keys]
                    told = [pa.array([""]), pa.array([f"commit record unreadable: {failure}"[:200]]), pa.array([""])]
                    yield pa.RecordBatch.from_arrays([*same, *told], names=[*keys, *names])

    return files.repartition("path").mapInArrow(rows, schema)


def artifact_digests(artifacts: DataFrame) -> DataFrame:
    """Adds file and payload digest, end marker and gzip faults of the file in ``path``, in one pass each.

    The rows hold paths only; each file is streamed by one task in blocks, so
    its size does not matter. Concatenated gzip members are accepted.
    """
    schema = T.StructType(list(artifacts.schema.fields))
    for name, kind in DIGESTS:
        schema = schema.add(name, kind)
    kinds = [pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()]
    names = [name for name, _ in DIGESTS]

    def digests(batches):
        for batch in batches:
            at = batch.schema.get_field_index("path")
            for i, path in enumerate(batch.column(at).to_pylist()):
                found = [pa.array([v], k) for v, k in zip(_digest(path), kinds)]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, *found], names=[*batch.schema.names, *names])

    return artifacts.repartition("path").mapInArrow(digests, schema)


def file_sha256(files: DataFrame) -> DataFrame:
    """Adds ``sha256`` of the bytes of every file of column ``path``, streamed in blocks."""
    schema = T.StructType(list(files.schema.fields)).add("sha256", "string")

    def digests(batches):
        for batch in batches:
            hashes = []
            for path in batch.column(batch.schema.get_field_index("path")).to_pylist():
                whole = hashlib.sha256()
                with _open(path) as stream:
                    while block := stream.read(BLOCK):
                        whole.update(block)
                hashes.append(whole.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hashes, pa.string())],
                                             names=[*batch.schema.names, "sha256"])

    return files.repartition("path").mapInArrow(digests, schema)
