"""Who owns what: owners and permissions of the entries of folders, as a Spark data source.

Spark's file sources tell path, size and time of a file, not its owner. The source ``folder_entries`` walks folders
that are mounted on all executors; a partition is a root itself, or some of the folders and files right below it.
"""

import json
import os
import stat
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ENTRY = ("host string, root string, rel_path string, is_dir boolean, uid bigint, gid bigint, mode int, "
         "size bigint, error string")


@dataclass
class Part(InputPartition):
    """Names right below a root; without names, the root itself."""

    host: str
    root: str
    names: tuple | None


class EntryReader(DataSourceReader):
    def __init__(self, options):
        self.roots = json.loads(options["roots"])
        self.depth = int(options.get("depth", 2))
        self.per_task = int(options.get("per_task", 256))

    def partitions(self):
        parts = []
        for host, root in self.roots:
            parts.append(Part(host, root, None))
            try:
                names = sorted(os.listdir(root))
            except OSError:  # the row of the root tells
                continue
            parts += [Part(host, root, tuple(names[i:i + self.per_task])) for i in range(0, len(names), self.per_task)]
        return parts

    def read(self, part):
        if part is None:  # there are no roots
            return
        if part.names is None:
            yield self._row(part, None)
            return
        open_ = [(name, 0) for name in reversed(part.names)]
        while open_:
            name, depth = open_.pop()
            row = self._row(part, name)
            if row[3] and depth < self.depth:
                try:
                    below = sorted(os.listdir(os.path.join(part.root, name)), reverse=True)
                    open_ += [(f"{name}/{entry}", depth + 1) for entry in below]
                except OSError as failure:
                    row = (*row[:-1], str(failure))
            yield row

    def _row(self, part, name):
        try:  # a root may be a link to a folder; what is below is not followed
            found = os.stat(part.root) if name is None else os.lstat(os.path.join(part.root, name))
        except OSError as failure:
            return (part.host, part.root, name, None, None, None, None, None, str(failure))
        return (part.host, part.root, name, stat.S_ISDIR(found.st_mode), found.st_uid, found.st_gid,
                stat.S_IMODE(found.st_mode) & 0o777, found.st_size, None)


class EntrySource(DataSource):
    @classmethod
    def name(cls):
        return "folder_entries"

    def schema(self):
        return ENTRY

    def reader(self, schema):
        return EntryReader(self.options)


def read_entries(spark: SparkSession, roots, depth: int = 2, per_task: int = 256) -> DataFrame:
    """Entries of the folders ``roots``, pairs of host and folder, down to ``depth`` separators below them.

    The row without ``rel_path`` is the root. What can't be read has ``error``; links are not followed.
    """
    spark.dataSource.register(EntrySource)
    return (spark.read.format("folder_entries").option("roots", json.dumps([list(pair) for pair in roots]))
            .option("depth", depth).option("per_task", per_task).load())
