"""Relational sources: table definitions in SQL, and JSON plug-ins that hold a definition and rows."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SKIPPED = ("FOREIGN", "UNIQUE", "CHECK", "CONSTRAINT", "PRIMARY")


@dataclass
class Column:
    name: str
    type: str
    pk: bool = False
    ref: str | None = None


@dataclass
class Table:
    name: str
    columns: list[Column] = field(default_factory=list)

    @property
    def is_link(self) -> bool:
        """A key of two columns that both refer elsewhere, or else references to exactly two tables, none itself, of the
        columns outside the key."""
        keys = [c for c in self.columns if c.pk]
        if len(keys) == 2 and all(c.ref for c in keys):
            return True
        targets = {c.ref.split(".")[0] for c in self.columns if c.ref and not c.pk}
        return len(targets) == 2 and self.name not in targets


def top_level(text: str) -> list[str]:
    """The parts between commas outside parentheses."""
    parts, depth, at = [], 0, 0
    for i, ch in enumerate(text):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            parts.append(text[at:i])
            at = i + 1
    return [p.strip() for p in [*parts, text[at:]] if p.strip()]


def parse_tables(sql: str) -> list[Table]:
    """CREATE TABLE statements; only the first word of a type is kept, in upper case."""
    sql, out = re.sub(r"--[^\n]*", "", sql), []
    for m in re.finditer(r"(?i)create\s+table\s+(?:if\s+not\s+exists\s+)?[\"`]?(\w+)[\"`]?\s*\(", sql):
        depth, end = 1, m.end()
        while end < len(sql) and depth:
            depth += (sql[end] == "(") - (sql[end] == ")")
            end += 1
        table, keys = Table(m[1]), []
        for part in top_level(sql[m.end() : end - 1]):
            if key := re.match(r"(?i)primary\s+key\s*\(([^)]*)\)", part):
                keys += [k.strip().strip('"`') for k in key[1].split(",")]
            elif (words := part.split())[0].upper() not in SKIPPED:
                ref = re.search(r"(?i)references\s+[\"`]?(\w+)[\"`]?\s*\(\s*[\"`]?(\w+)[\"`]?\s*\)", part)
                kind = re.match(r"\w+", words[1]) if len(words) > 1 else None
                table.columns.append(Column(words[0].strip('"`'), kind[0].upper() if kind else "", bool(re.search(r"(?i)primary\s+key", part)), f"{ref[1]}.{ref[2]}" if ref else None))
        for c in table.columns:
            c.pk = c.pk or c.name in keys
        out.append(table)
    return out


def catalog(spark: SparkSession, sql: str) -> DataFrame:
    """(table, column, type, pk, ref, is_link) of the columns of parsed definitions."""
    rows = [(t.name, c.name, c.type, c.pk, c.ref, t.is_link) for t in parse_tables(sql) for c in t.columns]
    return spark.createDataFrame(rows, "table string, column string, type string, pk boolean, ref string, is_link boolean")


def plugins(spark: SparkSession, path: str) -> DataFrame:
    """(id, label, schema, data) of JSON files; those that don't parse or lack a definition are left out."""
    files = spark.read.text(path, wholetext=True).select("value", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("id"))
    return files.select("id", *[F.get_json_object("value", f"$.{k}").alias(k) for k in ("label", "schema", "data")]).where("schema is not null")


def plugin_rows(sources: DataFrame, table: str) -> DataFrame:
    """(id, row) of one table's rows, each row as a map of texts."""
    data = F.from_json("data", f"struct<`{table}`: array<map<string, string>>>")
    return sources.select("id", F.explode(data[table]).alias("row"))


def folder_id(text):
    """The folder id in a link, or the text itself if it is a bare id."""
    linked = F.regexp_extract(text, r"/folders/([A-Za-z0-9_-]+)", 1)
    asked = F.regexp_extract(text, r"[?&]id=([A-Za-z0-9_-]+)", 1)
    bare = F.regexp_extract(F.trim(text), r"^([A-Za-z0-9_-]{10,})$", 1)
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in (linked, asked, bare)])


def scope_of(text: str) -> tuple[str, str | None]:
    """``my-drive``, ``folder:ID`` or ``drive:ID``."""
    kind, _, id_ = text.partition(":")
    if (kind in ("folder", "drive") and id_) or (kind == "my-drive" and not id_):
        return kind, id_ or None
    raise ValueError(f"not a scope: {text}")
