"""The text of ``git log --format=%H||%an||%ae||%ai||%s --name-status`` as tables."""

from __future__ import annotations

import re
import subprocess
import threading
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.build import stable_id


#: What ``git log`` is asked for.
FORMAT = ("--format=%H||%an||%ae||%ai||%s", "--name-status")


def read_logs(repositories: DataFrame, timeout: int = 60) -> DataFrame:
    """(repository_id, record) of the logs of (id, path): ``git log`` runs in the tasks, and a record comes out as it is read.

    A path without a repository gives no row; a log that takes longer than
    ``timeout`` seconds ends there.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for repository, path in zip(batch["id"], batch["path"]):
                log = subprocess.Popen(["git", "-C", path, "log", *FORMAT], stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True, errors="replace")
                watch = threading.Timer(timeout, log.kill)
                watch.start()
                records, held = [], []
                for line in log.stdout:
                    if re.match(r"[0-9a-f]{40}\|\|", line) and held:
                        records.append("".join(held).rstrip("\n"))
                        held = []
                        if len(records) >= 1000:
                            yield pd.DataFrame({"repository_id": repository, "record": records})
                            records = []
                    held.append(line)
                if held:
                    records.append("".join(held).rstrip("\n"))
                watch.cancel()
                log.wait()
                if records:
                    yield pd.DataFrame({"repository_id": repository, "record": records})

    tasks = int(repositories.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return repositories.where(F.col("path").isNotNull()).select("id", "path").repartition(tasks).mapInPandas(run, "repository_id long, record string")


def log_records(logs: DataFrame) -> DataFrame:
    """(repository_id, record): the text of each commit from (repository_id, text) of whole logs."""
    return logs.select("repository_id", F.explode(F.split("text", r"\n(?=[0-9a-f]{40}\|\|)")).alias("record"))


def log_commits(records: DataFrame, known: DataFrame | None = None, max_count: int | None = None) -> DataFrame:
    """(id, repository_id, hash, author, email, committed_at, message, body) of the records that are commits.

    A message may hold the separator.  Commits whose (repository_id, hash) is
    in ``known`` are left out; ``max_count`` keeps so many of the rest, newest
    first.
    """
    head = F.regexp_extract("record", r"^([^\n]*)", 1)
    part = lambda n: F.regexp_extract(head, r"^([0-9a-f]{40})\|\|(.*?)\|\|(.*?)\|\|(.*?)\|\|(.*)$", n)
    rows = records.select(
        "repository_id", part(1).alias("hash"), part(2).alias("author"), part(3).alias("email"), part(4).alias("committed_at"), part(5).alias("message"),
        F.regexp_extract("record", r"(?s)^[^\n]*\n(.*)$", 1).alias("body"),
    ).where("hash <> ''").dropDuplicates(["repository_id", "hash"])
    if known is not None:
        rows = rows.join(known.select("repository_id", "hash"), ["repository_id", "hash"], "left_anti")
    if max_count is not None:
        rows = rows.orderBy(F.try_to_timestamp("committed_at", F.lit("yyyy-MM-dd HH:mm:ss Z")).desc_nulls_last(), "hash").limit(max_count)
    return rows.withColumn("id", stable_id("repository_id", "hash"))


def log_files(commits: DataFrame) -> DataFrame:
    """(commit_id, file_path, change_type): A, M and D lines; a rename adds the new path and deletes the old; others are dropped."""
    lines = commits.select(F.col("id").alias("commit_id"), F.explode(F.split("body", "\n")).alias("line")).where(F.col("line").contains("\t"))
    cells = F.split("line", "\t")
    entry = lambda path, kind: F.struct(path.alias("file_path"), F.lit(kind).alias("change_type"))
    first = F.substring(cells[0], 1, 1)
    entries = F.when(first == "R", F.array(entry(F.get(cells, F.lit(2)), "A"), entry(F.get(cells, F.lit(1)), "D")))
    for kind in ("A", "M", "D"):
        entries = entries.when(cells[0] == kind, F.array(entry(F.get(cells, F.lit(1)), kind)))
    return lines.select("commit_id", F.explode(entries).alias("e")).select("commit_id", "e.*").where("file_path IS NOT NULL")


def log_text(commits: DataFrame, commit_files: DataFrame) -> DataFrame:
    """(repository_id, record): commits written as log records, one row a commit.

    Inverse of the parser for complete rows; a null status is left out.
    """
    lines = commit_files.where("file_path IS NOT NULL AND change_type IN ('A', 'M', 'D')").groupBy(F.col("commit_id").alias("id")).agg(
        F.array_join(F.sort_array(F.collect_set(F.concat_ws("\t", "change_type", "file_path"))), "\n").alias("body")
    )
    head = F.concat_ws("||", "hash", F.coalesce("author", F.lit("")), F.coalesce("email", F.lit("")), F.coalesce("committed_at", F.lit("")), F.coalesce("message", F.lit("")))
    return commits.join(lines, "id", "left").select("repository_id", F.concat(head, F.lit("\n"), F.coalesce("body", F.lit(""))).alias("record"))
