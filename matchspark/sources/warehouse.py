"""Tables of the warehouse: idempotent replacement, upsert, write-back, purge, parity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from matchspark.session import cut


def replace_keys(rows: DataFrame, path: str, key: str) -> None:
    """Replace the partitions of the keys that ``rows`` hold and leave all others; running it again changes nothing."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def stored(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of a folder of ``replace_keys`` with the columns of ``schema``; none where nothing was ever written."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def replace_in_buckets(rows: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """As ``replace_keys`` for keys too many for a folder each: they are dealt over ``buckets`` folders.

    Buckets that ``rows`` touch are written anew with the rows of their other keys.
    """
    spark, bucket = rows.sparkSession, F.pmod(F.hash(key), F.lit(buckets)).alias("bucket")
    new = rows.select("*", bucket)
    touched = new.select("bucket").distinct()
    gone = rows.select(F.col(key).alias("__key")).distinct()
    kept = stored(spark, path, new.schema).join(F.broadcast(touched), "bucket", "left_semi").join(gone, F.col(key).eqNullSafe(F.col("__key")), "left_anti")
    whole = cut(new.unionByName(kept.select(*new.columns)).repartition(buckets, "bucket"))
    replace_keys(whole, path, "bucket")


def upsert(old: DataFrame, new: DataFrame, name: str, key: str) -> DataFrame:
    """``old`` with the columns of ``new`` where both have a ``name``, and rows for new names, keys counted on.

    Rows keep their key; columns that are null in ``new`` are set to null.
    """
    from matchspark.sources.match_logs import numbered

    values = [c for c in old.columns if c not in (name, key)]
    both = old.select(name, key).join(new.select(name, *values), name)
    rest = old.join(new, name, "left_anti")
    fresh = numbered(new.join(old, name, "left_anti"), name, key, old)
    return rest.select(*old.columns).unionByName(both.select(*old.columns)).unionByName(fresh.select(*old.columns))


def write_back(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``table`` with the columns of ``changes`` in the rows whose key it has."""
    names = [c for c in changes.columns if c != key]
    c = changes.select(key, F.struct(*names).alias("__new"))
    return table.join(c, key, "left").select(*(F.when(F.col("__new").isNotNull(), F.col(f"__new.{x}")).otherwise(F.col(x)).alias(x) if x in names else F.col(x) for x in table.columns))


def purge(tables: dict[str, DataFrame], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """All tables without the rows of the keys in ``gone``; rows without a key stay."""
    return {name: rows.join(gone.select(key).distinct(), key, "left_anti").select(*rows.columns) for name, rows in tables.items()}


def purge_targets(maps: DataFrame, matches: DataFrame, slugs: list[str] | None = None, without_matches: bool = False, stubs: bool = False) -> DataFrame:
    """Maps to purge: the named ones, those without matches, stubs; all if nothing is asked for."""
    if slugs is None and not without_matches and not stubs:
        return maps
    played = matches.select("map_id", F.lit(True).alias("played")).distinct()
    wanted = F.lit(False)
    if slugs is not None:
        wanted = wanted | F.col("map_slug").isin(slugs)
    if without_matches:
        wanted = wanted | F.col("played").isNull()
    if stubs:
        wanted = wanted | F.coalesce(F.col("stub"), F.lit(False))
    return maps.join(played, "map_id", "left").where(wanted).select(*maps.columns)


def reset(matches: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """Processing flags off for the chosen matches, or all."""
    if chosen is None:
        return matches.withColumn("processed", F.lit(False))
    hit = chosen.select("match_id", F.lit(True).alias("__hit")).distinct()
    return matches.join(hit, "match_id", "left").withColumn("processed", F.col("processed") & F.col("__hit").isNull()).select(*matches.columns)


def merge_dimension(rows: DataFrame, mapping: DataFrame, old: str, key: list[str]) -> DataFrame:
    """``rows`` with ``old`` redirected by ``mapping (old, new)``; of rows that then collide on ``key`` the one that had the target stays."""
    named = rows.join(mapping.withColumnsRenamed({"old": old}), old, "left")
    moved = named.withColumn("__moved", F.col("new").isNotNull().cast("int")).withColumn(old, F.coalesce("new", old)).drop("new")
    best = moved.groupBy(*key).agg(F.min_by(F.struct(*rows.columns), "__moved").alias("r"))
    return best.select("r.*")


def normalised_ids(rows: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """Numeric texts in ``column`` replaced by ``names (id, name)`` (the smallest name of an id); unknown ones stay."""
    n = names.groupBy("id").agg(F.min("name").alias("__name"))
    number = F.col(column).try_cast("int")
    return rows.join(n, number == n["id"], "left").withColumn(column, F.coalesce("__name", column)).select(*rows.columns)


def parity(left: dict[str, DataFrame], right: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table on both sides and whether they agree; a table that one side lacks counts null there."""
    count = lambda tables, side: reduce(DataFrame.unionByName, [x.agg(F.lit(n).alias("name"), F.count("*").alias(side)) for n, x in tables.items()])
    rows = count(left, "left_rows").join(count(right, "right_rows"), "name", "full")
    return rows.withColumn("state", F.when(F.col("left_rows").eqNullSafe(F.col("right_rows")), "OK").otherwise("MISMATCH"))


def missing_names(wanted: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """Names of one catalogue that another lacks."""
    return wanted.select(name).distinct().join(known.select(name), name, "left_anti")


def empty_fields(documents: DataFrame, key: str, text: str) -> DataFrame:
    """Fields of JSON documents that are null, empty texts, lists or objects: ``key, field, value``."""
    rows = documents.select(key, F.explode(F.from_json(text, "map<string,string>")).alias("field", "value"))
    bare = F.regexp_replace(F.coalesce("value", F.lit("null")), r"\s", "")
    return rows.withColumn("value", bare).where(F.col("value").isin("null", "", "[]", "{}"))


def json_documents(spark: SparkSession, path: str, schema: str, lines: bool = True) -> DataFrame:
    """Rows of the JSON documents below ``path``, with the file that each came from: one a line, or (``lines`` off) one a file."""
    return spark.read.schema(schema).option("multiLine", str(not lines).lower()).option("recursiveFileLookup", "true").json(path).withColumn("source", F.col("_metadata.file_path"))


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``12:NAME`` of a text file as ``ordinal, name``; other lines are left out."""
    parts = F.split("value", ":", 2)
    return spark.read.text(path).select(parts[0].try_cast("int").alias("ordinal"), F.trim(F.get(parts, F.lit(1))).alias("name")).where("ordinal is not null and name <> ''")


def save_graph(nodes: DataFrame, edges: DataFrame, path: str, key: str) -> None:
    """A graph's tables; what was saved of its keys before is replaced, other keys stay."""
    replace_in_buckets(nodes, f"{path}/nodes", key)
    replace_in_buckets(edges, f"{path}/edges", key)


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes").drop("bucket"), spark.read.parquet(f"{path}/edges").drop("bucket")


def lookup_misses(wanted: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Keys that a cache does not know yet."""
    return missing_names(wanted, cache, key)
