"""File trees and git object databases as Spark sources.

Both list what there is when the job is planned, without contents, and deal it into partitions of about PART_BYTES; each task
reads the contents of its own. With the option pushdown=true filters on what the listing knows (type, size, path, key) are pushed
into it, so that objects nobody wants are never read. Spark wants its setting spark.sql.python.filterPushdown.enabled for that, and
keeps what it has pushed for all uses of a DataFrame, so load one for each use. With contents=false no contents are read. The folder
must be one that every executor sees. Register with register(spark).
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith

PART_BYTES = 64 << 20
MAX_OBJECT = 10 << 20
SCHEMA = "target string, object_key string, object_type string, path string, size bigint, skipped boolean, content binary"


@dataclass
class Part(InputPartition):
    items: list[tuple[str, str, int]]


def dealt(items: Iterator[tuple[str, str, int]], limit: int) -> list[Part]:
    """Items in their order, in parts of about PART_BYTES of contents that will be read."""
    parts, now, size = [], [], 0
    for item in items:
        now.append(item)
        size += 4096 + (item[2] if item[2] <= limit else 0)
        if size >= PART_BYTES:
            parts.append(Part(now))
            now, size = [], 0
    return [*parts, Part(now)]


#: How filters that can be pushed test a value that isn't null.
_TESTS = {
    EqualTo: lambda v, x: v == x, In: lambda v, x: v in x, LessThan: lambda v, x: v < x, LessThanOrEqual: lambda v, x: v <= x, GreaterThan: lambda v, x: v > x, GreaterThanOrEqual: lambda v, x: v >= x,
    StringStartsWith: lambda v, x: v.startswith(x), StringEndsWith: lambda v, x: v.endswith(x), StringContains: lambda v, x: x in v, IsNotNull: lambda v, x: True,
}


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root = os.path.abspath(options["path"])
        self.limit = int(options.get("max_object", MAX_OBJECT)) or 1 << 62
        self.target = options.get("target", os.path.basename(self.root))
        if options.get("contents", "true").lower() == "false":
            self.limit = -1
        self.wanted: list[Filter] = []

    def fits(self, key: str, kind: str, path: str | None, size: int) -> bool:
        known = {"target": self.target, "object_key": key, "object_type": kind, "path": path, "size": size}
        return all((v := known[f.attribute[0]]) is not None and _TESTS[type(f)](v, getattr(f, "value", None)) for f in self.wanted)

    def row(self, key: str, kind: str, path: str | None, size: int, content: bytes | None) -> tuple:
        return self.target, key, kind, path, size, 0 <= self.limit < size, content


class TreeReader(_Reader):
    def files(self) -> Iterator[tuple[str, str, int]]:
        """Regular files below the root, names that begin with a dot too; links aren't followed, .git isn't entered."""
        if os.path.isfile(self.root):
            yield self.root, os.path.basename(self.root), os.path.getsize(self.root)
            return
        for folder, folders, names in os.walk(os.path.realpath(self.root), followlinks=False):
            folders[:] = sorted(f for f in folders if f != ".git")
            for name in sorted(names):
                full = os.path.join(folder, name)
                if name != ".git" and not os.path.islink(full) and os.path.isfile(full):
                    yield full, os.path.relpath(full, os.path.realpath(self.root)).replace(os.sep, "/"), os.path.getsize(full)

    def partitions(self) -> list[Part]:
        return dealt((f for f in self.files() if self.fits(f[1], "file", f[1], f[2])), self.limit)

    def read(self, partition: Part) -> Iterator[tuple]:
        for full, path, size in partition.items:
            content = None
            if size <= self.limit:
                try:
                    with open(full, "rb") as f:
                        content = f.read()
                except OSError:  # unreadable: counted, not scanned
                    content = None
            yield self.row(path, "file", path, size, content)


class GitReader(_Reader):
    def git(self, *args: str, **more: object) -> subprocess.CompletedProcess:
        return subprocess.run(["git", "-C", self.root, *args], check=True, stdout=subprocess.PIPE, **more)

    def partitions(self) -> list[Part]:
        """Every blob, commit and tag of the database, reached by a ref or not."""
        listed = self.git("cat-file", "--batch-all-objects", "--batch-check", "--unordered").stdout.decode().splitlines()
        objects = (line.split(" ") for line in listed)
        known = ((sha, kind, int(size)) for sha, kind, size in (o for o in objects if len(o) == 3 and o[2].isdigit()) if kind in ("blob", "commit", "tag"))
        return dealt((o for o in known if self.fits(o[0], o[1], None, o[2])), self.limit)

    def read(self, partition: Part) -> Iterator[tuple]:
        for sha, kind, size in partition.items:
            if size > self.limit:
                yield self.row(sha, kind, None, size, None)
        wanted = [i for i in partition.items if i[2] <= self.limit]
        if not wanted:
            return
        import threading

        with subprocess.Popen(["git", "-C", self.root, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as git:

            def ask() -> None:
                with git.stdin as to:
                    to.writelines(f"{sha}\n".encode() for sha, _, _ in wanted)

            threading.Thread(target=ask, daemon=True).start()
            for sha, kind, size in wanted:
                head = git.stdout.readline().decode().split()
                if len(head) != 3:  # missing
                    continue
                content = git.stdout.read(int(head[2]))
                git.stdout.read(1)
                yield self.row(sha, kind, None, size, content)


def _asks(options: dict[str, str]) -> bool:
    return options.get("pushdown", "false").lower() == "true"


class _Pushed:
    """A reader that takes filters."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Keeps those that the listing can answer; gives back the others."""
        for f in filters:
            if type(f) in _TESTS and f.attribute[0] in ("target", "object_key", "object_type", "path", "size"):
                self.wanted.append(f)
            else:
                yield f


class PushedTreeReader(_Pushed, TreeReader):
    pass


class PushedGitReader(_Pushed, GitReader):
    pass


class FileTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> TreeReader:
        return (PushedTreeReader if _asks(self.options) else TreeReader)(self.options)


class GitObjects(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gitobjects"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> GitReader:
        return (PushedGitReader if _asks(self.options) else GitReader)(self.options)


def register(spark: SparkSession) -> None:
    for source in (FileTree, GitObjects):
        spark.dataSource.register(source)


def missing(names: DataFrame, objects: DataFrame) -> DataFrame:
    """The object_keys that were asked for and don't exist; what exists is the semi-join of the same tables."""
    return names.select("object_key").distinct().join(objects.select("object_key"), "object_key", "left_anti")


#: The names that stand for no commit, and the kinds of activity that rewrite history.
ZERO, REWRITES = "0" * 40, {"force_push": "force-pushed over", "branch_deletion": "branch deleted"}


def activity(spark: SparkSession, path: str, repo: str) -> DataFrame:
    """repo, before, after, ord and text of the rewrites in captured pages of a repository's activity: JSON arrays, one a file, whose names are in the order in which they were answered.

    An activity without an earlier head is none; an after of zeros is empty. ord numbers them over files and rows of the page, latest
    first, so the first rewrite of a commit is the one that the feed lists first.
    """
    fields = "array<struct<activity_type:string,before:string,after:string,ref:string,timestamp:string,actor:struct<login:string>>>"
    pages = spark.read.format("text").option("wholetext", "true").load(path).select(F.col("_metadata.file_path").alias("_page"), F.from_json("value", fields).alias("rows"))
    rows = pages.select("_page", F.posexplode("rows").alias("_n", "r")).filter(F.col("r.activity_type").isin(*REWRITES) & (F.coalesce("r.before", F.lit("")) != "") & (F.col("r.before") != ZERO))
    said = F.coalesce(*(F.when(F.col("r.activity_type") == k, v) for k, v in REWRITES.items()))
    text = F.concat_ws(" ", said, F.concat(F.lit("by "), F.col("r.actor.login")), F.concat(F.lit("on "), F.substring("r.timestamp", 1, 10)))
    return rows.select(F.lit(repo).alias("repo"), F.col("r.before").alias("before"), F.when(F.col("r.after") == ZERO, "").otherwise(F.coalesce("r.after", F.lit(""))).alias("after"), F.struct("_page", "_n").alias("ord"), text.alias("text"))


#: Commits that one task describes.
COMMITS = 2000


def history(spark: SparkSession, path: str, repo: str, per_task: int = COMMITS) -> dict[str, DataFrame]:
    """commits, refs, object_paths and object_intro of a repository as tables.

    The driver lists the names of commits and refs only. Commits are dealt into partitions; each task asks git about its own:
    their header fields, and what they change against their parents, so the work is linear in changes, not commits times files.
    An object's path is reachable if a commit that is reached by a ref or a reflog brings it; the earliest commit introduces it.
    """

    def git(*args: str, given: list[str] | None = None) -> Iterator[str]:
        done = subprocess.run(["git", "-C", path, "-c", "core.quotePath=false", *args], check=True, stdout=subprocess.PIPE, input="".join(f"{x}\n" for x in given).encode() if given is not None else None)
        return iter(done.stdout.decode("utf-8", "replace").split("\n")[:-1])

    refs = [(repo, *x.split(" ")[::-1]) for x in git("for-each-ref", "--format=%(objectname) %(refname)")]
    reached = set(git("rev-list", "--all", "--reflog")) if refs else set()
    shas = [(x.split()[0], x.split()[0] in reached) for x in git("cat-file", "--batch-all-objects", "--batch-check") if x.split()[1] == "commit"]
    named = spark.createDataFrame(shas, "sha string, reached boolean").repartition(max(1, -(-len(shas) // per_task)))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines = git("log", "--no-walk=unsorted", "--stdin", "--format=%H%x1f%P%x1f%an%x1f%ae%x1f%aI%x1f%ct%x1f%s", given=b.column(0).to_pylist()) if b.num_rows else ()
            rows = [x.split("\x1f", 6) for x in lines]
            yield pa.RecordBatch.from_pylist([{"repo": repo, "sha": h, "parents": p.split(), "author": n, "email": e, "date": d, "subject": s, "at": int(t)} for h, p, n, e, d, t, s in rows], schema)

    def changed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, sha = [], ""
            for x in git("diff-tree", "--stdin", "-r", "--root", "-m", "--no-renames", "--raw", "--no-abbrev", given=b.column(0).to_pylist()) if b.num_rows else ():
                if not x.startswith(":"):
                    sha = x[:40] if x else sha
                    continue
                meta, _, name = x.partition("\t")
                blob = meta.split(" ")[3]
                if blob.strip("0"):
                    rows.append({"sha": sha, "object_key": blob, "path": name})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([(n, pa.string()) for n in ("sha", "object_key", "path")]))

    schema = pa.schema([(n, pa.list_(pa.string()) if n == "parents" else pa.int64() if n == "at" else pa.string()) for n in ("repo", "sha", "parents", "author", "email", "date", "subject", "at")])
    commits = named.mapInArrow(described, "repo string, sha string, parents array<string>, author string, email string, date string, subject string, at bigint")
    brought = named.mapInArrow(changed, "sha string, object_key string, path string")
    return {
        "commits": commits.drop("at"),
        "refs": spark.createDataFrame(refs, "repo string, refname string, sha string"),
        "object_paths": brought.join(named, "sha").groupBy("object_key", "path").agg(F.bool_or("reached").alias("reachable")).select(F.lit(repo).alias("repo"), "object_key", "path", "reachable"),
        "object_intro": brought.join(commits.select("sha", "at"), "sha").groupBy("object_key").agg(F.min_by("sha", F.struct("at", "sha")).alias("commit_sha")).select(F.lit(repo).alias("repo"), "object_key", "commit_sha"),
    }
