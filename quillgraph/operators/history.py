"""Questions to the change history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import commit_time
from quillgraph.operators.build import stable_id


def file_history(commits: DataFrame, commit_files: DataFrame, path: str, limit: int = 30) -> DataFrame:
    """(hash, author, message, committed_ts, change_type) of a file, newest first by UTC time."""
    touched = commit_files.where(F.col("file_path") == path).select(F.col("commit_id").alias("id"), "change_type")
    rows = commits.join(touched, "id").withColumn("committed_ts", commit_time("committed_at"))
    ordered = rows.orderBy(F.col("committed_ts").desc_nulls_last(), "id", "change_type").limit(limit)
    return ordered.select("id", "hash", "author", "message", "committed_ts", "change_type")


def co_change(commits: DataFrame, commit_files: DataFrame, path: str, limit: int = 20) -> DataFrame:
    """(file_path, n, change_type): files in the commits that touch ``path``, most often first."""
    having = commit_files.where(F.col("file_path") == path).select("commit_id").distinct()
    others = commit_files.where((F.col("file_path") != path) & F.col("file_path").isNotNull())
    others = others.join(having, "commit_id", "left_semi").join(commits.select(F.col("id").alias("commit_id")), "commit_id", "left_semi")
    return others.groupBy("file_path").agg(F.count("*").alias("n"), F.min("change_type").alias("change_type")).orderBy(F.desc("n"), "file_path").limit(limit)


def author_impact(commits: DataFrame, commit_files: DataFrame, top: int = 10) -> DataFrame:
    """(author, file_path, changes, commits, rank): the files each author changed most."""
    rows = commit_files.where(F.col("file_path").isNotNull()).join(
        commits.where(F.col("author").isNotNull()).select(F.col("id").alias("commit_id"), "author"), "commit_id"
    )
    counts = rows.groupBy("author", "file_path").agg(F.count("*").alias("changes"), F.countDistinct("commit_id").alias("commits"))
    order = Window.partitionBy("author").orderBy(F.desc("changes"), "file_path")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def author_summary(commits: DataFrame, commit_files: DataFrame, commit_authors: DataFrame) -> DataFrame:
    """(author, commits, changes, files, email, total) of every author; address and stored total by name, the least and the greatest of several."""
    rows = commit_files.where(F.col("file_path").isNotNull()).join(commits.where(F.col("author").isNotNull()).select(F.col("id").alias("commit_id"), "author"), "commit_id")
    counts = rows.groupBy("author").agg(F.countDistinct("commit_id").alias("commits"), F.count("*").alias("changes"), F.countDistinct("file_path").alias("files"))
    known = commit_authors.groupBy(F.col("name").alias("author")).agg(F.min("email").alias("email"), F.max("commit_count").alias("total"))
    return counts.join(known, "author", "left")


def introductions(commits: DataFrame, commit_files: DataFrame) -> DataFrame:
    """(repository_id, file_path, hash, author, committed_ts): the oldest commit that touches each file.

    A commit whose date can't be read comes after all others.
    """
    rows = commit_files.where(F.col("file_path").isNotNull()).join(commits.withColumnRenamed("id", "commit_id"), "commit_id")
    rows = rows.withColumn("committed_ts", commit_time("committed_at"))
    first = rows.groupBy("repository_id", "file_path").agg(
        F.min(F.struct(F.col("committed_ts").isNull().alias("undated"), "committed_ts", "commit_id", "hash", "author")).alias("f")
    )
    return first.select("repository_id", "file_path", "f.hash", "f.author", "f.committed_ts")


def list_authors(commit_authors: DataFrame, limit: int = 20) -> DataFrame:
    """(name, email, commit_count), most commits first; a null count is last."""
    order = [F.col("commit_count").desc_nulls_last(), F.col("name"), F.col("id")]
    return commit_authors.orderBy(*order).limit(limit).select("id", "name", "email", "commit_count")


def count_authors(commits: DataFrame, commit_authors: DataFrame) -> DataFrame:
    """(repository_id, email, name, commit_count): stored counts replaced by what the commits say.

    Additive upsert by (repository, email): an author that the commits don't
    hold keeps the stored count; null emails stand for no author.
    """
    seen = (
        commits.where(F.col("email").isNotNull())
        .groupBy("repository_id", "email")
        .agg(F.countDistinct("hash").alias("seen"), F.min("author").alias("seen_name"))
    )
    old = commit_authors.where(F.col("email").isNotNull()).groupBy("repository_id", "email").agg(
        F.coalesce(F.max("commit_count"), F.lit(0)).alias("stored"), F.min("name").alias("name")
    )
    both = old.join(seen, ["repository_id", "email"], "full")
    return both.select(
        "repository_id", "email", F.coalesce("name", "seen_name").alias("name"), F.coalesce("seen", "stored").alias("commit_count")
    )


def add_authors(fresh: DataFrame, commit_authors: DataFrame) -> DataFrame:
    """(id, repository_id, name, email, commit_count): stored authors, their counts raised by new commits; ids come from repository and address.

    A null address stands for no author.
    """
    new = fresh.where(F.col("email").isNotNull()).groupBy("repository_id", "email").agg(F.countDistinct("hash").alias("more"), F.min("author").alias("new_name"))
    both = commit_authors.join(new, ["repository_id", "email"], "full")
    return both.select(
        F.coalesce("id", stable_id("repository_id", "email")).alias("id"), "repository_id", F.coalesce("name", "new_name").alias("name"), "email",
        F.when(F.col("commit_count").isNotNull() | F.col("more").isNotNull(), F.coalesce("commit_count", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("commit_count"),
    )
