"""SQLite fleets (S5 to S7): catalogs of many database files or of folders of DDL scripts, one database for each task at a time; all mapping after the scan is joins."""

from __future__ import annotations

import json
import re
import sqlite3
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = "snapshot_key string, kind string, owner string, position int, row string"
MAX_DDL = 64 << 20
# Statements that a DDL import refuses.
DENIED = re.compile(r"^\s*(attach|detach|pragma|vacuum|insert|update|delete|replace|select|with|create\s+temp|create\s+temporary|create\s+virtual)\b|load_extension", re.I)


def _scan(db: sqlite3.Connection) -> Iterator[tuple[str, str | None, int, dict]]:
    """(kind, owner, position, row) of a database's catalog, and of what its views read."""
    db.row_factory = sqlite3.Row
    for k, r in enumerate(db.execute("select type, name, tbl_name, sql from sqlite_schema order by rowid")):
        yield "entry", None, k, dict(r)
    relations = [dict(r) for r in db.execute("pragma table_list") if r["schema"] == "main" and not r["name"].startswith("sqlite_")]
    for k, r in enumerate(sorted(relations, key=lambda r: r["name"])):
        yield "relation", None, k, r
        name = r["name"].replace('"', '""')
        for c in db.execute(f'pragma table_xinfo("{name}")'):
            yield "column", r["name"], c["cid"], dict(c)
        for k2, x in enumerate(db.execute(f'pragma index_list("{name}")').fetchall()):
            yield "index", r["name"], k2, dict(x)
            index = x["name"].replace('"', '""')
            for t in db.execute(f'pragma index_xinfo("{index}")'):
                yield "term", x["name"], t["seqno"], dict(t)
        for x in db.execute(f'pragma foreign_key_list("{name}")'):
            yield "foreign_key", r["name"], x["id"] * 1000 + x["seq"], dict(x)
    seen: set[tuple[str, str, str]] = set()

    def watch(action, table, column, _database, accessor):
        if action == sqlite3.SQLITE_READ and accessor:
            seen.add((accessor, table, column or ""))
        return sqlite3.SQLITE_OK

    db.set_authorizer(watch)
    for r in relations:
        if r["type"] == "view":
            name = r["name"].replace('"', '""')
            try:
                db.execute(f'explain select * from "{name}"')
            except sqlite3.Error:
                continue
    db.set_authorizer(None)
    for k, (accessor, table, column) in enumerate(sorted(seen)):
        yield "access", accessor, k, {"relation": table, "column": column}


def _rows(snapshot_key: str, db: sqlite3.Connection) -> pd.DataFrame:
    got = [(snapshot_key, kind, owner, k, json.dumps(row, sort_keys=True)) for kind, owner, k, row in _scan(db)]
    return pd.DataFrame(got, columns=["snapshot_key", "kind", "owner", "position", "row"])


def scan_sqlite_fleet(files: DataFrame) -> DataFrame:
    """files(snapshot_key, content) of whole database files, as Spark's binaryFile reads them -> (snapshot_key, kind, owner, position, row as JSON). A file that is no database gives one row of kind error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for key, content in zip(b.snapshot_key, b.content, strict=True):
                db = sqlite3.connect(":memory:")
                try:
                    db.deserialize(content)
                    db.execute("pragma query_only = on")
                    yield _rows(key, db)
                except sqlite3.Error as e:
                    yield pd.DataFrame([(key, "error", None, 0, json.dumps({"message": str(e)}))], columns=["snapshot_key", "kind", "owner", "position", "row"])
                finally:
                    db.close()

    return files.select("snapshot_key", "content").mapInPandas(run, ROWS)


def scan_ddl_fleet(spark: SparkSession, folder_glob: str) -> DataFrame:
    """Each folder's .sql files in order of name, applied to a database of their own in memory and scanned as S5. Refused: statements of DENIED, scripts over 64 MiB in all. The check is by each statement's first words."""
    files = spark.read.option("pathGlobFilter", "*.sql").option("wholetext", True).text(folder_glob).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return apply_ddl(files.select(F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("snapshot_key"), F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "text"))


def _statements(text: str) -> Iterator[str]:
    held = ""
    for part in re.split(r"(?<=;)", text):
        held += part
        if sqlite3.complete_statement(held):
            yield held
            held = ""
    if held.strip():
        yield held


def apply_ddl(scripts: DataFrame) -> DataFrame:
    """scripts(snapshot_key, name, text): a group is one database's scripts, bounded by MAX_DDL."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        db = sqlite3.connect(":memory:")
        try:
            if rows.text.str.len().sum() > MAX_DDL:
                raise sqlite3.Error("the scripts are over 64 MiB")
            for text in rows.sort_values("name").text:
                for s in _statements(text):
                    plain = re.sub(r"^(\s|--[^\n]*\n|/\*.*?\*/)*", "", s, flags=re.S)
                    if DENIED.search(plain):
                        raise sqlite3.Error(f"refused: {plain[:40]}")
                    db.execute(plain)
            return _rows(key[0], db)
        except sqlite3.Error as e:
            return pd.DataFrame([(key[0], "error", None, 0, json.dumps({"message": str(e)}))], columns=["snapshot_key", "kind", "owner", "position", "row"])
        finally:
            db.close()

    return scripts.groupBy("snapshot_key").applyInPandas(run, ROWS)


def local_files(spark: SparkSession, folder: str) -> DataFrame:
    """Database files under a folder as scan_sqlite_fleet takes them; snapshot_key is sqlite: and the file's name."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.db").load(folder)
    return raw.select(F.concat(F.lit("sqlite:"), F.regexp_extract("path", r"([^/]+)\.db$", 1)).alias("snapshot_key"), "content")
