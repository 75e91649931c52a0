"""Statistics of matches and maps: listings, gaps, coverage, activity, integrity.

Matches are rows ``match_id, map_id, match_start, match_duration, player_count,
processed``; maps have ``map_id, map_slug, team_count, total_blocks, size_tier``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def maps_with_matches(maps: DataFrame, matches: DataFrame) -> DataFrame:
    """Matches, participations and mean duration of each map; maps without matches have 0."""
    played = matches.groupBy("map_id").agg(F.count("*").alias("n"), F.sum("player_count").alias("p"), F.avg("match_duration").alias("avg_duration"))
    joined = maps.select("map_id", "map_slug").join(played, "map_id", "left")
    return joined.select("map_id", "map_slug", F.coalesce("n", F.lit(0)).alias("n_matches"), F.coalesce("p", F.lit(0)).alias("players"), "avg_duration")


def statistics(matches: DataFrame) -> DataFrame:
    """Matches, processed ones and participations, for all maps and each."""
    rows = matches.rollup("map_id").agg(F.count("*").alias("n"), F.count_if("processed").alias("n_processed"), F.sum("player_count").alias("players"))
    return rows.select(F.coalesce(F.col("map_id").cast("string"), F.lit("ALL")).alias("map_key"), "n", "n_processed", "players")


def buckets_by_rank(rows: DataFrame, value: str, key: str, n: int) -> DataFrame:
    """``rows`` with ``size_bucket``: n buckets of equal size by ``value`` and ``key``, as ntile gives them.

    Ranks come from range partitions and the counts of those before, so no task sorts all rows.
    """
    placed = rows.repartitionByRange(value, key).withColumn("__part", F.spark_partition_id())
    ranked = placed.withColumn("__rank", F.row_number().over(Window.partitionBy("__part").orderBy(value, key)) - 1)
    from matchspark.session import cut

    ranked = cut(ranked)
    counts = ranked.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = ranked.agg(F.count("*").alias("__all"))
    rank, size, rest = F.col("__rank") + F.col("__before"), F.floor(F.col("__all") / n), F.col("__all") % n
    bucket = F.when(rank < rest * (size + 1), F.floor(rank / (size + 1))).otherwise(rest + F.floor((rank - rest * (size + 1)) / F.greatest(size, F.lit(1)))) + 1
    return ranked.join(F.broadcast(before), "__part").crossJoin(F.broadcast(total)).withColumn("size_bucket", bucket.cast("int")).select(*rows.columns, "size_bucket")


def span_text(seconds: Column) -> Column:
    """Seconds as ``1h 2m 3s``; hours and minutes only where there are any."""
    hours, minutes = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60)
    return F.concat(F.when(seconds >= 3600, F.concat(hours.cast("string"), F.lit("h "))).otherwise(""), F.when(minutes >= 1, F.concat(minutes.cast("string"), F.lit("m "))).otherwise(""), F.floor(seconds % 60).cast("string"), F.lit("s"))


def pauses(matches: DataFrame, least_minutes: int = 100) -> DataFrame:
    """Pauses of ``least_minutes`` or more between the end of a match and the start of the next one of all.

    Matches are dealt out by ranges of their start; the next match of a range's last one
    is the first of the ranges after it, so no task sorts all matches.
    """
    from matchspark.session import cut

    key = ["match_start", "match_id"]
    rows = matches.select("map_id", "match_duration", F.col("match_start").cast("timestamp_ntz").alias("match_start"), "match_id")
    rows = cut(rows.repartitionByRange(*key).withColumn("part", F.spark_partition_id()))
    following = F.struct("match_start", "match_id", "map_id")
    after = F.lead(following).over(Window.partitionBy("part").orderBy(*key))
    firsts = rows.groupBy("part").agg(F.min(following).alias("first"))
    firsts = firsts.select("part", F.lead("first").over(Window.orderBy("part")).alias("later"))  # a row a range
    rows = rows.withColumn("after", after).join(F.broadcast(firsts), "part").withColumn("next", F.coalesce("after", "later")).where("next is not null")
    ends = F.col("match_start") + F.make_dt_interval(secs=F.col("match_duration").cast("decimal(18,6)"))
    rows = rows.withColumn("gap_seconds", F.timestamp_diff("SECOND", ends, F.col("next.match_start"))).where(F.col("gap_seconds") >= 60 * least_minutes)
    return rows.select("map_id", "match_id", F.col("next.match_id").alias("next_match"), F.col("next.map_id").alias("next_map"), "gap_seconds", span_text(F.col("match_duration")).alias("duration"), span_text(F.col("gap_seconds")).alias("gap_duration"))


def lacking(parents: DataFrame, children: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``parents`` that no row of ``children`` refers to."""
    return parents.join(children.select(*keys).distinct(), keys, "left_anti")


def orphans(children: dict[str, DataFrame], parents: DataFrame, keys: list[str]) -> DataFrame:
    """Per table, rows that refer to no row of ``parents``; tables without any count 0."""
    known = parents.select(*keys).distinct()
    parts = [rows.join(known, keys, "left_anti").agg(F.lit(name).alias("kind"), F.count("*").alias("orphans")) for name, rows in children.items()]
    return reduce(DataFrame.unionByName, parts)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [rows.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, rows in tables.items()])


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has."""
    return rows.groupBy(*keys).agg(F.count("*").alias("dupes")).where("dupes > 1")


def stub_maps(maps: DataFrame, matches: DataFrame) -> DataFrame:
    """Matches of the maps that are only stubs."""
    counts = matches.groupBy("map_id").agg(F.count("*").alias("n"))
    return maps.where("stub").join(counts, "map_id", "left").select("map_id", "map_slug", F.coalesce("n", F.lit(0)).alias("match_count"))


def weekly_longest(matches: DataFrame, k: int = 3) -> DataFrame:
    """The k longest matches of each week; weeks start on Monday."""
    week = F.date_trunc("week", "match_start").cast("date")
    order = Window.partitionBy("week_start").orderBy(F.desc("match_duration"), "match_id")
    rows = matches.withColumn("week_start", week).withColumn("rn", F.row_number().over(order))
    return rows.where(F.col("rn") <= k).select("week_start", "match_id", "match_duration")


def daily_summary(matches: DataFrame) -> DataFrame:
    return matches.groupBy(F.to_date("match_start").alias("day")).agg(F.count("*").alias("n_matches"), F.count_distinct("map_id").alias("n_maps"))


def largest_tier(matches: DataFrame, tiers: list[str]) -> DataFrame:
    """Per day, the largest tier that any of its maps has; ``tiers`` from the largest down."""
    rank = F.array_position(F.array(*(F.lit(t) for t in tiers)), F.col("size_tier"))
    return matches.where(F.col("size_tier").isin(*tiers)).groupBy(F.to_date("match_start").alias("day")).agg(F.min_by("size_tier", rank).alias("tier"))


#: Upper ends of the buckets of matches per map; the last is open.
COVERAGE = (1, 5, 15, 30, 60)


def coverage_bucket(n: Column, ends: tuple[int, ...] = COVERAGE) -> Column:
    """``1``, ``2-5``, ..., ``61+``."""
    low, out = 1, None
    for end in ends:
        label = str(low) if low == end else f"{low}-{end}"
        out = F.when(n <= end, label) if out is None else out.when(n <= end, label)
        low = end + 1
    return out.otherwise(f"{low}+")


def match_coverage(matches: DataFrame) -> DataFrame:
    """Maps by their matches, and over all maps of a bucket the mean, median and most matches."""
    per = matches.groupBy("map_id").agg(F.count("*").alias("n"))
    return per.groupBy(coverage_bucket(F.col("n")).alias("bucket")).agg(F.count("*").alias("maps"), F.round(F.avg("n"), 6).alias("mean_matches"), F.median("n").alias("median_matches"), F.max("n").alias("most_matches"))


def thresholds(maps: DataFrame, matches: DataFrame, keys: list[str], steps: tuple[int, ...] = (0, 1, 5, 10, 20)) -> DataFrame:
    """Maps with at least so many matches by each of ``keys`` (one at a time) and in all."""
    played = matches.groupBy("map_id").agg(F.count("*").alias("n"))
    per = maps.select("map_id", *keys).join(played, "map_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    parts = []
    for key in keys:
        rows = per.rollup(key).agg(*(F.count_if(F.col("n") >= s).alias(f"n{s}") for s in steps))
        parts.append(rows.select(F.lit(key).alias("grouping_key"), F.coalesce(F.col(key).cast("string"), F.lit("ALL")).alias("label"), *(f"n{s}" for s in steps)))
    return reduce(DataFrame.unionByName, parts)


def activity(matches: DataFrame, zone: str = "Europe/Berlin") -> DataFrame:
    """Seconds of play and distinct matches of each local date and hour; a match counts in every hour that it touches."""
    start = F.col("match_start").cast("timestamp")
    rows = matches.where("match_duration > 0").withColumn("s", F.unix_timestamp(start)).withColumn("e", F.col("s") + F.col("match_duration"))
    hours = rows.withColumn("h", F.explode(F.sequence(F.floor(F.col("s") / 3600) * 3600, F.floor((F.col("e") - 1) / 3600) * 3600, F.lit(3600).cast("long"))))
    local = F.from_utc_timestamp(F.timestamp_seconds("h"), zone)
    seconds = F.least(F.col("e"), F.col("h") + 3600) - F.greatest("s", "h")
    return hours.groupBy(F.to_date(local).alias("day"), F.hour(local).alias("hour")).agg(F.sum(seconds).alias("seconds"), F.count_distinct("match_id").alias("matches"))


def set_fingerprint(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """md5 of the sorted, comma-joined distinct values of each key: changes when the set changes."""
    ids = F.transform(F.sort_array(F.collect_set(value)), lambda x: x.cast("string"))
    return rows.groupBy(*keys).agg(F.md5(F.array_join(ids, ",")).alias("fingerprint"))


def log_trend(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Slope and intercept of log10(y) over log10(x), values below 1 taken as 1."""
    lx, ly = F.log10(F.greatest(F.col(x), F.lit(1)).cast("double")), F.log10(F.greatest(F.col(y), F.lit(1)).cast("double"))
    return rows.groupBy(*keys).agg(F.round(F.regr_slope(ly, lx), 6).alias("slope"), F.round(F.regr_intercept(ly, lx), 6).alias("intercept"))


def domination(captures: DataFrame, teams: DataFrame) -> DataFrame:
    """Matches by their score: captures of the best team to those of the worst; teams without any count 0.

    ``captures``: ``match_id, team, wool_id``; ``teams``: ``match_id, team``.
    """
    scored = captures.groupBy("match_id", "team").agg(F.count_distinct("wool_id").alias("n"))
    grid = teams.distinct().join(scored, ["match_id", "team"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    per = grid.groupBy("match_id").agg(F.max("n").alias("best"), F.min("n").alias("worst"))
    return per.groupBy("best", "worst").agg(F.count("*").alias("matches"))
