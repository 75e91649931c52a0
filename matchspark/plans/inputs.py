"""Inputs of the registered queries: projections of the given tables to match and map tables.

The same projections stand in the oracles (``plans/oracles.py``); everything beyond them
is done by operators here and by hand-written SQL there.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchspark.operators import intervals, objectives, trajectories
from matchspark.plans import oracles
from matchspark.session import table


class Inputs:
    """The adapted tables of one folder; each is read when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def adapted(self, name: str) -> DataFrame:
        text = oracles.PROJECTIONS[name].replace("{ep}", "unix_micros(CAST(ts AS TIMESTAMP))/1000000.0")
        given = set(re.findall(r"\b(?:FROM|JOIN) (events|orders|customer|lineitem|part|nation|region)\b", text))
        text = re.sub(r"\b(FROM|JOIN) (events|orders|customer|lineitem|part|nation|region)\b", r"\1 {\2}", text)
        return self.spark.sql(f"WITH {text} SELECT * FROM {name}", **{t: table(self.spark, self.sf_dir, t) for t in given})

    @cached_property
    def log(self) -> DataFrame:
        return self.adapted("match_log")

    @cached_property
    def matches(self) -> DataFrame:
        return self.adapted("matches")

    @cached_property
    def maps(self) -> DataFrame:
        return self.adapted("maps")

    @cached_property
    def chests(self) -> DataFrame:
        return self.adapted("chests")

    @cached_property
    def blocks(self) -> DataFrame:
        return self.adapted("blocks")

    @cached_property
    def cells(self) -> DataFrame:
        return self.adapted("ground")

    @cached_property
    def areas(self) -> DataFrame:
        """Diamonds as polygons: ``map_id, polygon_id, kind, rings``."""
        point = lambda dx, dz: F.struct((F.col("cx") + dx).cast("double").alias("x"), (F.col("cz") + dz).cast("double").alias("z"))
        r = F.col("r")
        return self.adapted("diamonds").select("map_id", "polygon_id", "kind", F.array(F.array(point(-r, 0), point(0, r), point(r, 0), point(0, -r))).alias("rings"))

    @cached_property
    def staged(self) -> DataFrame:
        """Events with the map of their match."""
        return self.log.join(self.maps.select((F.col("map_id") - 1).alias("match_id"), "map_id", "map_slug"), "match_id")

    @cached_property
    def teams(self) -> DataFrame:
        side = F.when(F.abs("x") % 2 == 0, "red").otherwise("blue")
        return intervals.team_segments(intervals.spawn_teams(self.log, side))

    @cached_property
    def samples(self) -> DataFrame:
        return trajectories.life_samples(self.log)

    @cached_property
    def mapped(self) -> DataFrame:
        """Samples with one of five maps."""
        return self.samples.withColumn("map_id", F.col("match_id") % 5)

    @cached_property
    def firsts(self) -> DataFrame:
        return objectives.first_touches(self.log)

    @cached_property
    def centres(self) -> DataFrame:
        spawns = self.teams.join(self.log.select("match_id", F.col("row_id").alias("team_segment_id"), "x", "z"), ["match_id", "team_segment_id"])
        return objectives.team_centres(spawns, ["match_id"])
