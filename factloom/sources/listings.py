"""Files and activities as sources list them: scopes, the change feed, shortcuts and grants, cycles of polling.

All work on recorded rows, a table or a stream of them; what calls a source over a network is no part of this.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import BANDS, hash48

SHORTCUT = "application/vnd.google-apps.shortcut"  # fixed values: the type of a shortcut, the types of issue activity
ISSUE_ACTIVITY = (1, 2, 3)
CYCLE = 100  # activities of a cycle of polling


def listed(files: DataFrame, kind: str, scope: str | None = None) -> DataFrame:
    """Files (parents, drive, trashed) of a scope, but none in the trash: the direct children of a ``folder``, all of a
    ``drive``, or all there is (``my-drive``)."""
    kept = files.where(~F.coalesce("trashed", F.lit(False)))
    if kind == "folder":
        return kept.where(F.array_contains("parents", scope))
    if kind == "drive":
        return kept.where(F.col("drive") == scope)
    if kind == "my-drive":
        return kept
    raise ValueError(f"unknown kind of scope: {kind}")


def changed(changes: DataFrame, folder: str | None = None) -> DataFrame:
    """Changes (removed, trashed, parents) of a feed to map again. Removed and trashed files are passed over; a lane of
    a folder keeps its direct children. Works on a table and on a stream, whose checkpoint then is the token."""
    kept = changes.where(~F.coalesce("removed", F.lit(False)) & ~F.coalesce("trashed", F.lit(False)))
    return kept if folder is None else kept.where(F.array_contains("parents", folder))


def hydrated(files: DataFrame, known: DataFrame, grants: DataFrame) -> DataFrame:
    """Files (id, mime, target, permissions, ...) ready for mapping. A shortcut gives way to its target in ``known``
    (the same columns, one row an id), one step only; files without permissions take those of ``grants`` (id,
    permissions), and have none, which reads as the strictest, where nothing is granted. A shortcut whose target isn't
    known stays as it is; one that names no target is a file like others."""
    c = F.col
    targets = known.select(c("id").alias("__id"), F.struct(*known.columns).alias("__file"))
    follows = (c("mime") == SHORTCUT) & c("target").isNotNull()
    rows = files.withColumn("__to", F.when(follows, c("target"))).join(targets, c("__to") == c("__id"), "left")
    lost = c("__to").isNotNull() & c("__id").isNull()
    found = rows.select(*[F.when(c("__id").isNotNull(), c("__file")[n]).otherwise(c(n)).alias(n) for n in files.columns], lost.alias("__lost"))
    given = grants.select(c("id").alias("__id"), c("permissions").alias("__given"))
    out = found.join(given, (c("id") == c("__id")) & ~c("__lost") & c("permissions").isNull(), "left")
    return out.withColumn("permissions", F.coalesce("permissions", "__given")).select(*files.columns)


def drive_roots(drives: DataFrame) -> DataFrame:
    """Names of the root folders of shared drives (drive, name, at), which no listing holds, as facts."""
    return drives.select(F.lit("assert").alias("op"), (hash48(F.col("drive")) + BANDS["folder"]).alias("subject"), F.lit("folder-name").alias("predicate"), F.col("name").alias("object"), F.col("at").alias("valid_from"))


def polled(events: DataFrame, cursors: DataFrame, count: int = CYCLE, types: tuple[int, ...] = ISSUE_ACTIVITY) -> DataFrame:
    """The next cycle of each scope: its first ``count`` events (scope, id, type) beyond its cursor (scope, cursor)."""
    after = events.where(F.col("type").isin(*types)).join(cursors, "scope").where(F.col("id") > F.col("cursor"))
    return after.withColumn("__n", F.row_number().over(Window.partitionBy("scope").orderBy("id"))).where(F.col("__n") <= count).drop("__n", "cursor")


def next_cursors(cycle: DataFrame, cursors: DataFrame) -> DataFrame:
    """(scope, cursor) after a cycle; scopes without events keep theirs."""
    last = cycle.groupBy("scope").agg(F.max("id").alias("__last"))
    return cursors.join(last, "scope", "left").select("scope", F.greatest("cursor", "__last").alias("cursor"))
