"""Match logs on shared storage: scan, incremental index, summaries, slugs, re-layout.

A log is one Parquet file a match in a folder named after its map:
``<logs>/<map>/<name>_2026-01-24_10-00-00.parquet``. It may be a folder of part files, as
Spark writes one, and both names may carry a ``key=`` prefix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchspark.functions.scalars import base_name, start_of

#: Columns of a log; those that a file lacks are null.
EVENT = "timestamp int, event_type int, player_id int, x int, y int, z int, held_item int, inventory_count int, victim_id int, wool_id int"


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """All events below ``folder`` with ``match_file`` (``<map>/<name>``) and ``map_slug`` from the file's folder."""
    rows = spark.read.schema(EVENT).option("recursiveFileLookup", "true").parquet(folder)
    path = F.regexp_replace(F.regexp_replace(F.url_decode(F.col("_metadata.file_path")), r"\\", "/"), r"/part-[^/]*$", "")
    part = lambda n: F.regexp_replace(F.element_at(F.split(path, "/"), n), "^[^=/]*=", "")
    return rows.select(F.concat(part(-2), F.lit("/"), part(-1)).alias("match_file"), part(-2).alias("map_slug"), "*")


def summaries(events: DataFrame) -> DataFrame:
    """Per file: map, players, rows, start from the file's name, duration from START to END, else from first to last event.

    Of several START or END events the first counts. Rows without a player are no player.
    """
    at = lambda kind: F.min(F.when(F.col("event_type") == kind, F.col("timestamp")))
    rows = events.groupBy("match_file", "map_slug").agg(F.count_distinct("player_id").alias("player_count"), F.count("*").alias("row_count"), at(0).alias("s"), at(1).alias("e"), F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))
    duration = F.when(F.col("s").isNotNull() & F.col("e").isNotNull(), F.col("e") - F.col("s")).otherwise(F.col("hi") - F.col("lo"))
    return rows.select("match_file", "map_slug", "player_count", "row_count", start_of(base_name(F.col("match_file"))).alias("match_start"), duration.alias("match_duration"))


def slugs(files: DataFrame, history: DataFrame) -> DataFrame:
    """Map of each file: from ``history (parquet_file, map_name)`` by its path, else its base name, else its folder.

    Names are lower-cased; of several entries the smallest map name counts.
    """
    known = history.select(F.lower("parquet_file").alias("file"), F.lower("map_name").alias("name"))
    by = lambda key, out: known.select(key.alias("key"), "name").groupBy("key").agg(F.min("name").alias(out))
    path, base = by(F.col("file"), "by_path"), by(base_name(F.col("file")), "by_base")
    rows = files.join(path, F.lower("match_file") == path["key"], "left").drop("key")
    rows = rows.join(base, base_name(F.lower("match_file")) == base["key"], "left").drop("key")
    return rows.withColumn("map_slug", F.coalesce("by_path", "by_base", "map_slug")).drop("by_path", "by_base")


def numbered(rows: DataFrame, order: str, name: str, after: DataFrame | None = None) -> DataFrame:
    """``rows`` with dense numbers in the order of ``order``, from one past the greatest ``name`` of ``after``.

    Numbers come from range partitions and the counts of those before, so no task sorts all
    rows; ``rows`` are computed once, not again for the bounds of the ranges.
    """
    from matchspark.session import cut

    placed = cut(cut(rows).repartitionByRange(order).withColumn("__part", F.spark_partition_id()))
    counts = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    base = 0 if after is None else after.agg(F.coalesce(F.max(name), F.lit(0))).first()[0]
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(order))
    return placed.withColumn("__rank", rank).join(F.broadcast(before), "__part").withColumn(name, (F.col("__before") + F.col("__rank") + base).cast("long")).drop("__part", "__rank", "__before")


def index_new(found: DataFrame, matches: DataFrame) -> DataFrame:
    """Rows of ``matches`` for the files that it lacks, with the next match numbers in the order of their paths."""
    fresh = found.join(matches.select("match_file"), "match_file", "left_anti")
    return numbered(fresh, "match_file", "match_id", matches)


def with_stubs(maps: DataFrame, names: DataFrame) -> DataFrame:
    """``maps (map_id, map_slug, stub)`` with a stub row, numbered on, for each unknown ``map_slug`` of ``names``."""
    unknown = names.select("map_slug").where("map_slug is not null").distinct().join(maps, "map_slug", "left_anti")
    return maps.unionByName(numbered(unknown, "map_slug", "map_id", maps).withColumn("stub", F.lit(True)).select(*maps.columns))


def write_partitioned(events: DataFrame, folder: str, key: str = "map_slug") -> None:
    """Events in one folder a map; rows without a map go nowhere; maps written before are replaced."""
    events.where(F.col(key).isNotNull()).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(folder)


def organise(files: DataFrame, history: DataFrame, existing: DataFrame) -> DataFrame:
    """What becomes of each flat file: ``moved`` to its map, ``skipped`` if it is there already, ``unknown`` without a map."""
    named = slugs(files.withColumn("map_slug", F.lit(None).cast("string")), history)
    there = existing.select("map_slug", "match_file", F.lit(True).alias("there"))
    rows = named.join(there, ["map_slug", "match_file"], "left")
    return rows.select("match_file", "map_slug", F.when(F.col("map_slug").isNull(), "unknown").when(F.col("there"), "skipped").otherwise("moved").alias("outcome"))


def text_log(spark: SparkSession, path: str) -> DataFrame:
    """Matches of a text log: a header ``#12 - Name - 3m`` and the first Parquet name after it.

    Lines keep their order within a file; headers without a file are left out.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("source"), F.monotonically_increasing_id().alias("n"), "value")
    head = F.regexp_extract("value", r"^#(\d+) - (.+) - (\S+)\s*$", 1)
    rows = lines.select("source", "n", F.nullif(head, F.lit("")).cast("int").alias("number"), F.regexp_extract("value", r"^#(\d+) - (.+) - (\S+)\s*$", 2).alias("name"), F.nullif(F.regexp_extract("value", r"([\w\-./]+\.parquet)", 1), F.lit("")).alias("file"))
    since = Window.partitionBy("source").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.withColumn("at", F.last(F.when(F.col("number").isNotNull(), F.struct("n", "number", "name")), ignorenulls=True).over(since)).where("file is not null and at is not null")
    first = filled.groupBy("source", "at").agg(F.min_by("file", "n").alias("parquet_file"))
    return first.select(F.col("at.number").alias("number"), F.col("at.name").alias("map_name"), "parquet_file")
