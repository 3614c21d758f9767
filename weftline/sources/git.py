"""Git repositories as a Spark data source: commits, trees, contents and blame.

    spark.dataSource.register(GitDataSource)
    spark.read.format("git").option("path", repo).option("table", "commits").load()
"""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMAS = {
    "commits": "commit_hash string, author string, email string, message string, commit_time timestamp_ntz, files_changed array<struct<path:string,change_type:string>>",
    "tree": "path string, fingerprint string",
    "file": "path string, commit_hash string, content string",
    "blame": "path string, line_no int, commit_hash string, author string, commit_time timestamp_ntz, message string",
}
CHANGES = {"A": "added", "M": "modified", "D": "deleted", "R": "renamed", "C": "copied", "T": "modified"}
FIELD, RECORD = "\x1f", "\x1e"


def git(repo: str, *args: str) -> str:
    done = subprocess.run(["git", "-c", "safe.directory=*", "-c", "core.quotePath=false", "-C", repo, *args], capture_output=True)
    if done.returncode:
        raise RuntimeError(done.stderr.decode("utf-8", "replace").strip())
    return done.stdout.decode("utf-8", "replace")


class Part(InputPartition):
    def __init__(self, skip: int, count: int):
        self.skip, self.count = skip, count


class GitReader(DataSourceReader):
    """Commits are read in slices of the log, one task each; the other tables in one task, as they are one file or tree."""

    SLICE = 1000

    def __init__(self, options: dict[str, str]):
        self.repo, self.table = options["path"], options.get("table", "commits")
        self.commit, self.file = options.get("commit", "HEAD"), options.get("file", "")
        self.limit = int(options.get("limit", "1000"))

    def partitions(self) -> list[InputPartition]:
        if self.table != "commits":
            return [Part(0, 1)]
        n = min(self.limit, int(git(self.repo, "rev-list", "--count", self.commit)))
        return [Part(a, min(self.SLICE, n - a)) for a in range(0, n, self.SLICE)]

    def read(self, partition: Part) -> Iterator[tuple]:
        return getattr(self, self.table)(partition)

    def commits(self, p: Part) -> Iterator[tuple]:
        form = RECORD + FIELD.join(["%H", "%an", "%ae", "%B", "%at"]) + FIELD
        out = git(self.repo, "log", f"--skip={p.skip}", f"-n{p.count}", "--root", "-m", "--first-parent", "--name-status", "-M", f"--format={form}", self.commit)
        for rec in out.split(RECORD)[1:]:
            h, author, email, message, when, files = rec.split(FIELD)
            changed = [(ln.split("\t")[-1], CHANGES.get(ln[0], "modified")) for ln in files.strip().split("\n") if "\t" in ln]
            yield h, author, email, message.strip(), datetime.fromtimestamp(int(when), timezone.utc).replace(tzinfo=None), [{"path": a, "change_type": b} for a, b in changed]

    def tree(self, p: Part) -> Iterator[tuple]:
        for line in git(self.repo, "ls-tree", "-r", "-z", self.commit).split("\0"):
            if line:
                meta, path = line.split("\t", 1)
                _, kind, blob = meta.split()
                if kind == "blob":
                    yield path, blob


    def blame(self, p: Part) -> Iterator[tuple]:
        info: dict[str, dict[str, str]] = {}
        current, line_no = "", 0
        for line in git(self.repo, "blame", "--porcelain", self.commit, "--", self.file).split("\n"):
            if m := re.match(r"^([0-9a-f]{40}) \d+ (\d+)", line):
                current, line_no = m.group(1), int(m.group(2))
                info.setdefault(current, {})
            elif line.startswith("\t"):
                x = info[current]
                yield self.file, line_no, current, x.get("author"), datetime.fromtimestamp(int(x.get("author-time", "0")), timezone.utc).replace(tzinfo=None), x.get("summary")
            elif " " in line:
                k, v = line.split(" ", 1)
                info[current].setdefault(k, v)


class FileReader(GitReader):
    def read(self, partition: Part) -> Iterator[tuple]:
        try:
            text = git(self.repo, "show", f"{self.commit}:{self.file}")
        except RuntimeError:
            return
        yield self.file, git(self.repo, "rev-parse", self.commit).strip(), text


class GitDataSource(DataSource):
    """Options: path, table (commits, tree, file, blame), commit, file, limit."""

    @classmethod
    def name(cls) -> str:
        return "git"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "commits")]

    def reader(self, schema) -> DataSourceReader:
        return (FileReader if self.options.get("table") == "file" else GitReader)(self.options)
