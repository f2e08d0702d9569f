"""A corpus folder as a data source, and records published into it.

Spark's own file readers leave out directories that begin with an underscore, which scopes may, and
follow links. The folder must be one that every executor sees. Directories are opened one below the
other without following links, for reading and for writing alike.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
import stat
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

from strandline.sources.folders import checkpointed

# Depth of the walk, largest file, names of records.
MAX_DEPTH, MAX_FILE = 10, 8 << 20
RECORD = re.compile(r"aj1-.*\.md")
#: Directories down to this depth are listed by the driver, those below by the tasks; how many make a partition.
LISTED_DEPTH, LISTED = 2, 16


class Directories(InputPartition):
    def __init__(self, listed: list[tuple[str, bool]], paths: list[str] | None = None):
        super().__init__(0)
        self.listed, self.paths = listed, paths or []


@contextmanager
def opened(root: str, below: str = "", create: bool = False) -> Iterator[int]:
    """A descriptor of a directory below ``root``; each part of the way must be a directory of its own, no link."""
    fd = os.open(root, os.O_RDONLY | os.O_DIRECTORY)
    try:
        for part in below.split("/") if below else ():
            if create:
                try:
                    os.mkdir(part, 0o700, dir_fd=fd)
                    os.fsync(fd)
                except FileExistsError:
                    pass
            inner = os.open(part, os.O_RDONLY | os.O_DIRECTORY | os.O_NOFOLLOW, dir_fd=fd)
            os.close(fd)
            fd = inner
        yield fd
    finally:
        os.close(fd)


def _entries(root: str, below: str) -> tuple[list[str], list[str]]:
    """Names of the directories and of the records in one directory."""
    with opened(root, below) as fd, os.scandir(fd) as found:
        listed = sorted((e.name, e.is_dir(follow_symlinks=False), e.is_file(follow_symlinks=False)) for e in found)
    return [n for n, d, _ in listed if d and not n.startswith(".")], [n for n, _, f in listed if f and RECORD.fullmatch(n)]


def walk(root: str, below: str = "", deep: bool = True) -> Iterator[tuple[str, str]]:
    """(kind, path below root) of records and of directories that can't be read; links are not followed."""
    under = lambda name: f"{below}/{name}" if below else name
    try:
        inner, records = _entries(root, below)
    except OSError:
        if not below:
            raise
        yield "unreadable", below
        return
    yield from (("episode", under(n)) for n in records)
    if deep and below.count("/") + bool(below) <= MAX_DEPTH - 1:
        for name in inner:
            yield from walk(root, under(name))


def contained(root: str, path: str, most: int = MAX_FILE) -> tuple[os.stat_result, bytes]:
    """One record's file below ``root``; ValueError if it is no regular file or has more than ``most`` bytes."""
    if not safe_path(path):
        raise ValueError(f"not a path inside the corpus: {path}")
    folder, _, name = path.rpartition("/")
    with opened(root, folder) as fd, open(os.open(name, os.O_RDONLY | os.O_NOFOLLOW | os.O_NONBLOCK, dir_fd=fd), "rb") as f:
        info = os.fstat(f.fileno())
        if not stat.S_ISREG(info.st_mode) or info.st_size > most:
            raise ValueError(f"no record of at most {most} bytes: {path}")
        content = f.read(most + 1)
        if len(content) > most:  # it has grown since
            raise ValueError(f"no record of at most {most} bytes: {path}")
        return info, content


class Reader(DataSourceReader):
    def __init__(self, options):
        self.root, self.bare = options["path"], options.get("stat_only", "false") == "true"
        self.only: list[str] | None = None

    def pushFilters(self, filters):
        """Filters that name paths are taken over: nothing is listed then, and no other file is opened."""
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("rel_path",):
                named = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = sorted(p for p in named if p is not None and (self.only is None or p in self.only))
            else:
                yield f

    def partitions(self):
        if self.only is not None:
            return [Directories([], self.only[i : i + LISTED]) for i in range(0, len(self.only), LISTED)] or [Directories([])]
        listed, level = [], [""]
        for depth in range(LISTED_DEPTH + 1):
            deep = depth == LISTED_DEPTH
            listed += [(d, deep) for d in level]
            level = [] if deep else [f"{d}/{n}" if d else n for d in level for n in self._inner(d)]
        return [Directories(listed[i : i + LISTED]) for i in range(0, len(listed), LISTED)]

    def _inner(self, below: str) -> list[str]:
        try:
            return _entries(self.root, below)[0]
        except OSError:
            if not below:
                raise
            return []

    def read(self, partition):
        for path in partition.paths:
            if self._is_record(path):
                yield self._row("episode", path)
        for below, deep in partition.listed:
            for kind, path in walk(self.root, below, deep):
                yield self._row(kind, path)

    def _is_record(self, path: str) -> bool:
        """Whether the walk would come upon this path."""
        folder, _, name = path.rpartition("/")
        if not safe_path(path) or not RECORD.fullmatch(name) or path.count("/") > MAX_DEPTH or any(p.startswith(".") for p in path.split("/")):
            return False
        try:
            with opened(self.root, folder) as fd:
                return stat.S_ISREG(os.stat(name, dir_fd=fd, follow_symlinks=False).st_mode)
        except OSError:
            return False

    def _row(self, kind: str, path: str) -> tuple:
        try:
            if kind == "unreadable":
                return path, None, None, None, kind
            if self.bare:
                folder, _, name = path.rpartition("/")
                with opened(self.root, folder) as fd:
                    info, content = os.stat(name, dir_fd=fd, follow_symlinks=False), None
                if info.st_size > MAX_FILE:
                    return path, None, None, info.st_size, "unreadable"
            else:
                info, content = contained(self.root, path)
            return path, content, max(int(info.st_mtime * 1000), 0), info.st_size, kind
        except (OSError, ValueError):
            return path, None, None, None, "unreadable"


@dataclass
class Written(WriterCommitMessage):
    log: str


class Claims:
    """Files that the attempts of one task are about to publish, noted by path, inode and time before they are.

    ``folder`` is the task's own; every attempt has a file there. What another attempt noted is this task's
    file whenever it came, and what nobody noted is somebody else's, even with the same bytes.
    """

    def __init__(self, folder: str):
        os.makedirs(folder, 0o700, exist_ok=True)
        self.folder, self.name, self.taken = folder, uuid.uuid4().hex, set()
        self.file = open(f"{folder}/{self.name}", "x", encoding="utf-8")

    @staticmethod
    def _line(path: str, info: os.stat_result) -> str:
        return json.dumps([path, info.st_ino, info.st_mtime_ns])

    def note(self, path: str, info: os.stat_result) -> None:
        self.file.write(self._line(path, info) + "\n")
        self.file.flush()
        os.fsync(self.file.fileno())

    def take(self, path: str, info: os.stat_result) -> bool:
        """Whether another attempt made this file; true for one row of this attempt."""
        line = self._line(path, info)
        if line in self.taken:
            return False
        for name in os.listdir(self.folder):
            if name != self.name:
                with open(f"{self.folder}/{name}", encoding="utf-8") as noted:
                    if any(n.rstrip("\n") == line for n in noted):
                        self.taken.add(line)
                        return True
        return False

    def __enter__(self) -> Claims:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()


class Writer(DataSourceWriter):
    """Publishes rows (rel_path, content, replace); a task that runs again finds its own files and says the same."""

    def __init__(self, options):
        self.root, self.log = options["path"], options["log"]

    def write(self, iterator):
        name = f"{self.log}/{uuid.uuid4().hex}.json"
        # Spark's readers leave out names with an underscore, so the claims aren't taken for outcomes.
        with open(name, "w", encoding="utf-8") as log, Claims(f"{self.log}/_task-{TaskContext.get().partitionId()}") as claims:
            for row in iterator:
                outcome = publish(self.root, row["rel_path"], bytes(row["content"]), row["replace"], claims=claims)
                log.write(json.dumps({"rel_path": row["rel_path"], "outcome": outcome}) + "\n")
        return Written(name)

    def commit(self, messages):
        """Logs of attempts that Spark gave up are left out."""
        for m in messages:
            if m is not None:
                os.rename(m.log, m.log.removesuffix(".json") + "-done.json")


class Corpus(DataSource):
    @classmethod
    def name(cls):
        return "corpus"

    def schema(self):
        return "rel_path string, content binary, mtime_ms long, size long, kind string"

    def reader(self, schema):
        return Reader(self.options)

    def writer(self, schema, overwrite):
        return Writer(self.options)


def read(spark: SparkSession, root: str, stat_only: bool = False) -> DataFrame:
    spark.dataSource.register(Corpus)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # else filters on paths would come after the files
    return spark.read.format("corpus").option("stat_only", str(stat_only).lower()).load(root)


def contents_at(root: str):
    """A function from (rel_path) to (rel_path, content) of the records there below ``root``, read by the tasks that have the paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with suppress(OSError, ValueError):  # gone, or no record any more
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([contained(root, path)[1]], pa.binary())], names=["rel_path", "content"])

    return lambda paths: paths.select("rel_path").mapInArrow(run, "rel_path string, content binary")


def hashes_at(root: str):
    """What ``sources`` of a search asks for: hashes of the records at some paths below ``root``."""
    ask = contents_at(root)
    return lambda paths: ask(paths).select("rel_path", F.sha2("content", 256).alias("file_hash"))


def signature(spark: SparkSession, root: str) -> DataFrame:
    """Number of records and their latest change, without reading them."""
    found = read(spark, root, True).filter(F.col("kind") == "episode")
    return found.agg(F.count("*").alias("files"), F.coalesce(F.max("mtime_ms"), F.lit(0)).alias("latest_ms"))


def safe_path(path: str) -> bool:
    parts = path.split("/")
    return not path.startswith("/") and "\\" not in path and all(p not in ("", ".", "..") for p in parts)


def publish(root: str, path: str, content: bytes, replace: bool = False, began: float | None = None, claims: Claims | None = None) -> str:
    """Put one file under ``root``, whole or not at all: published, replaced, or exists where another one was there.

    A file that another attempt noted in ``claims`` is this call's own. So is one with the same bytes that came
    since ``began``, for a caller who knows that nobody else has written since.
    """
    if not safe_path(path):
        raise ValueError(f"not a path inside the corpus: {path}")
    folder, _, name = path.rpartition("/")
    part = f".{name}.{uuid.uuid4().hex}.tmp"
    with opened(root, folder, create=True) as fd:
        with open(os.open(part, os.O_WRONLY | os.O_CREAT | os.O_EXCL | os.O_NOFOLLOW, 0o600, dir_fd=fd), "wb") as f:
            f.write(content)
            f.flush()
            os.fsync(f.fileno())
            made = os.fstat(f.fileno())
        try:
            if replace:
                os.replace(part, name, src_dir_fd=fd, dst_dir_fd=fd)
                return "replaced"
            if claims is not None:
                claims.note(path, made)
            os.link(part, name, src_dir_fd=fd, dst_dir_fd=fd, follow_symlinks=False)
            return "published"
        except FileExistsError:
            if claims is not None:
                with suppress(FileNotFoundError):
                    return "published" if claims.take(path, os.stat(name, dir_fd=fd, follow_symlinks=False)) else "exists"
            try:
                info, there = contained(root, path)
            except (OSError, ValueError):
                return "exists"
            return "published" if began is not None and info.st_mtime >= began and there == content else "exists"
        finally:
            with suppress(FileNotFoundError):  # a replaced one has its new name
                os.unlink(part, dir_fd=fd)
            os.fsync(fd)


def write(records: DataFrame, root: str) -> DataFrame:
    """Publish (rel_path, content) under ``root`` now; where a column ``replace`` is true, over what is there.

    Gives (rel_path, outcome): published, replaced, or exists where another file was there.
    """
    spark = records.sparkSession
    spark.dataSource.register(Corpus)
    os.makedirs(root, 0o700, exist_ok=True)
    log = os.path.join(root, f".outcomes-{uuid.uuid4().hex}")
    os.mkdir(log, 0o700)
    replace = F.col("replace") if "replace" in records.columns else F.lit(False)
    rows = records.select("rel_path", F.col("content").cast("binary").alias("content"), F.coalesce(replace, F.lit(False)).alias("replace"))
    try:
        rows.write.format("corpus").mode("append").option("log", log).save(root)
        done = spark.read.schema("rel_path string, outcome string").option("pathGlobFilter", "*-done.json").json(log)
        return checkpointed(done)
    finally:
        shutil.rmtree(log)


def remove_one(root: str, path: str, file_hash: str) -> str:
    """Take one record away if it still is what ``file_hash`` says: deleted, changed, or gone where nothing is there.

    What can't be read as a record counts as changed, and stays.
    """
    folder, _, name = path.rpartition("/")
    try:
        content = contained(root, path)[1]
        if hashlib.sha256(content).hexdigest() != file_hash:
            return "changed"
        with opened(root, folder) as fd:
            os.unlink(name, dir_fd=fd)
            os.fsync(fd)
        return "deleted"
    except FileNotFoundError:
        return "gone"
    except (OSError, ValueError):
        return "changed"


def remove(records: DataFrame, root: str) -> DataFrame:
    """Take (rel_path, file_hash) away below ``root`` as the result is computed: (rel_path, outcome).

    A task that runs again finds the files of its first attempt gone, so gone and deleted mean the same to a caller
    that saw them. An edit between the look and the removal goes with the file. Rows are small and each costs a
    look at a file, so they are dealt out by number, not by bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            outcomes = [remove_one(root, p, h) for p, h in zip(paths, hashes)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(outcomes, pa.string())], names=["rel_path", "outcome"])

    tasks = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return records.select("rel_path", "file_hash").repartition(tasks, "rel_path").mapInArrow(run, "rel_path string, outcome string")


def in_shared_directory(root: str) -> bool:
    """Whether others may write where ``root`` lies or would be made: into its nearest directory above that exists."""
    above = os.path.dirname(os.path.abspath(root))
    while not os.path.isdir(above) and above != os.path.dirname(above):
        above = os.path.dirname(above)
    return os.path.isdir(above) and bool(os.stat(above).st_mode & 0o022)
