"""Tables declared in sources: SQL, Prisma and model classes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# After the grammar of SQL: names may be quoted and qualified, types may have several words and a size.
_QUOTED = r"(?:\w+|`[^`]+`|\"[^\"]+\"|'[^']+'|\[[^\]]+\])"
_CREATE = re.compile(rf"\bCREATE\s+(?:GLOBAL\s+|LOCAL\s+)?(?:TEMP(?:ORARY)?\s+|UNLOGGED\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?(?P<name>{_QUOTED}(?:\s*\.\s*{_QUOTED})*)\s*\(", re.IGNORECASE)
_COLUMN = re.compile(rf"\s*(?P<name>{_QUOTED})\s+(?P<type>(?:DOUBLE\s+PRECISION|(?:CHARACTER|BIT|NATIONAL\s+CHARACTER)\s+VARYING|TIME(?:STAMP)?\s+WITH(?:OUT)?\s+TIME\s+ZONE|\w+)(?:\s*\([^()]*\))?)", re.IGNORECASE)
# First words of parts that are no column.
_CONSTRAINTS = {
    "PRIMARY", "FOREIGN", "UNIQUE", "INDEX", "KEY", "CONSTRAINT", "CHECK", "REFERENCES", "CLUSTERED", "NONCLUSTERED", "EXCLUDE", "FULLTEXT", "SPATIAL",
}
# Bases of model classes.
MODEL_BASES = ("Model", "models.Model", "django.db.models.Model")


def ddl_tables(text: str) -> list[tuple[str, int, str, str]]:
    """(table, position, column, type) of the CREATE TABLE statements in a text; brackets may nest."""
    out = []
    for m in _CREATE.finditer(text):
        depth, start, parts, end = 1, m.end(), [], None
        for at in range(m.end(), len(text)):
            ch = text[at]
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
                if depth == 0:
                    end = at
                    break
            elif ch == "," and depth == 1:
                parts.append(text[start:at])
                start = at + 1
        if end is None:
            continue
        parts.append(text[start:end])
        for part in parts:
            words = part.split()
            column = _COLUMN.match(part)
            if column and re.split(r"\W", words[0])[0].upper() not in _CONSTRAINTS:
                table = re.findall(_QUOTED, m["name"])[-1]
                out.append((table.strip("`\"'[]"), len(out), column["name"].strip("`\"'[]"), column["type"]))
    return out


def sql_tables(sources: DataFrame) -> DataFrame:
    """(repository_id, file_path, table_name, position, column_name, column_type) of the SQL texts in (repository_id, file_path, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(r, p, *t) for r, p, text in batch.itertuples(index=False) for t in ddl_tables(text)]
            yield pd.DataFrame(rows, columns=["repository_id", "file_path", "table_name", "position", "column_name", "column_type"])

    texts = sources.where((F.length("text") > 0) & F.col("text").rlike(r"(?i)create\s+table")).select("repository_id", "file_path", "text")
    return texts.mapInPandas(run, "repository_id long, file_path string, table_name string, position int, column_name string, column_type string")


def prisma_tables(sources: DataFrame) -> DataFrame:
    """(repository_id, file_path, table_name, column_name, column_type) of files named schema.prisma."""
    files = sources.where(F.col("file_path").rlike(r"(?:^|/)schema\.prisma$"))
    blocks = files.select("repository_id", "file_path", F.explode(F.regexp_extract_all("text", F.lit(r"(?ms)^\s*(model\s+\w+\s*\{.*?^\s*\})"), 1)).alias("block"))
    lines = blocks.select("repository_id", "file_path", F.regexp_extract("block", r"^model\s+(\w+)", 1).alias("table_name"), F.explode(F.split("block", "\n")).alias("line"))
    field = r"^\s+(\w+)\s+(\w+[\[\]?]*)"
    return lines.where(F.col("line").rlike(field)).select("repository_id", "file_path", "table_name", F.regexp_extract("line", field, 1).alias("column_name"), F.regexp_extract("line", field, 2).alias("column_type"))


def model_tables(entities: DataFrame) -> DataFrame:
    """(repository_id, file_path, table_name, column_name) of Python classes whose base is a model, with their constants as columns."""
    classes = entities.where((F.col("kind") == "class") & F.exists("relations", lambda r: r["target_name"].isin(*MODEL_BASES)))
    tables = classes.select("repository_id", "file_path", F.col("ordinal").alias("parent_ordinal"), F.lower("name").alias("table_name"))
    columns = entities.where(F.col("kind").isin("constant", "variable")).select("repository_id", "file_path", "parent_ordinal", F.col("name").alias("column_name"))
    return tables.join(columns, ["repository_id", "file_path", "parent_ordinal"], "left").drop("parent_ordinal")


def annotated_tables(entities: DataFrame) -> DataFrame:
    """(repository_id, file_path, table_name, column_name) of classes annotated as entities, with their fields as columns.

    The table is named by a @Table annotation, or like the class.
    """
    marks = F.array_join(F.from_json(F.get_json_object("metadata_json", "$.decorators"), "array<string>"), " ")
    classes = entities.where((F.col("kind") == "class") & (F.col("language") != "python")).withColumn("_m", marks).where(F.col("_m").rlike(r"@Entity\b"))
    stated = F.regexp_extract("_m", r"@Table\s*\([^)]*?name\s*=\s*\"(\w+)\"", 1)
    tables = classes.select("repository_id", "file_path", F.col("ordinal").alias("parent_ordinal"), F.coalesce(F.nullif(stated, F.lit("")), F.col("name")).alias("table_name"))
    columns = entities.where(F.col("kind") == "variable").select("repository_id", "file_path", "parent_ordinal", F.col("name").alias("column_name"))
    return tables.join(columns, ["repository_id", "file_path", "parent_ordinal"], "left").drop("parent_ordinal")


#: Ordinals of declared tables and of their columns start here, beyond those of definitions.
TABLE_ORDINAL, COLUMN_ORDINAL = 1 << 29, 3 << 28


def declared_entities(sources: DataFrame, entities: DataFrame) -> DataFrame:
    """(repository_id, file_path, ordinal, parent_ordinal, kind, name, metadata_json): declared tables, and their columns as constants below them."""
    columns = ["repository_id", "file_path", "table_name", "column_name", "column_type"]
    unknown = F.lit(None).cast("string").alias("column_type")
    rows = sql_tables(sources).select(*columns).unionByName(prisma_tables(sources).select(*columns))
    for found in (model_tables(entities), annotated_tables(entities)):
        rows = rows.unionByName(found.withColumn("column_type", unknown).select(*columns))
    # The tables of one file are few.
    of_file = Window.partitionBy("repository_id", "file_path")
    ranked = rows.distinct().withColumn("t", F.dense_rank().over(of_file.orderBy("table_name"))).withColumn("c", F.row_number().over(of_file.orderBy("table_name", "column_name", "column_type")))
    ranked = ranked.withColumn("ordinal", (F.col("t") + TABLE_ORDINAL).cast("int"))
    none = F.lit(None).cast("string").alias("metadata_json")
    tables = ranked.select("repository_id", "file_path", "ordinal", F.lit(None).cast("int").alias("parent_ordinal"), F.lit("table").alias("kind"), F.col("table_name").alias("name"), none).distinct()
    fields = ranked.where(F.col("column_name").isNotNull()).select(
        "repository_id", "file_path", (F.col("c") + COLUMN_ORDINAL).cast("int").alias("ordinal"), F.col("ordinal").alias("parent_ordinal"), F.lit("constant").alias("kind"), F.col("column_name").alias("name"),
        F.to_json(F.struct(F.col("column_type").alias("field_type"))).alias("metadata_json"),
    )
    return tables.unionByName(fields)
