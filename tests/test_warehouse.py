from pathlib import Path

from pyspark.sql import functions as F

from matchspark.session import scratch_path
from matchspark.sources import match_logs, warehouse


def test_saved_graphs_take_few_folders_and_replace_their_keys(spark):
    path = scratch_path(spark, "graph")
    nodes = spark.range(3000).select((F.col("id") % 1000).cast("int").alias("match_id"), F.col("id").alias("node"))
    edges = nodes.select("match_id", F.col("node").alias("src"), F.col("node").alias("dst")).withColumn("match_id", F.when(F.col("match_id") > 0, F.col("match_id")))
    warehouse.save_graph(nodes, edges, path, "match_id")
    for _ in range(2):
        warehouse.save_graph(nodes.where("match_id = 7").withColumn("node", -F.col("node")), edges.where("match_id is null").withColumn("dst", F.lit(-1).cast("long")), path, "match_id")
    got, links = warehouse.load_graph(spark, path)
    assert {tuple(r) for r in got.collect()} == {(i % 1000, -i if i % 1000 == 7 else i) for i in range(3000)} and got.count() == 3000
    assert links.count() == 3000 and {r.dst for r in links.where("match_id is null").collect()} == {-1}
    assert len(list(Path(path.removeprefix("file:")).glob("nodes/*=*"))) <= 64


def test_loads_without_rows_are_read_back_empty(spark):
    from matchspark.plans import room_queries, route_queries
    from matchspark.plans.inputs import Inputs

    bare = Inputs(spark, "/root/testdata/sf0.001")
    bare.blocks, bare.maps = bare.blocks.withColumn("block_id", F.lit(39)), bare.maps.where("map_id < 0")
    for load in (room_queries.l13_loaded_chests, route_queries.l46_spawn_table):
        assert load(bare).count() == 0


def test_chosen_layers_without_bedrock(spark):
    from matchspark.plans import source_queries
    from matchspark.plans.inputs import Inputs

    bare = Inputs(spark, "/root/testdata/sf0.001")
    bare.blocks = bare.blocks.withColumn("block_id", F.when((F.col("map_id") == 1) & (F.col("block_id") == 7), 7).otherwise(39))
    assert {tuple(r) for r in source_queries.s11_chosen_layers(bare).collect()} == {(1, "bedrock"), (2, "top_surface")}


def test_rule_files_hold_a_bounded_number_of_maps(spark):
    from matchspark.plans import room_queries
    from matchspark.plans.inputs import Inputs

    many = Inputs(spark, "/root/testdata/sf0.001")
    many.maps = spark.range(0, 100_000, 1, 1).select(F.col("id").cast("int").alias("map_id"), F.concat(F.lit("m"), "id").alias("map_slug"), F.lit(False).alias("stub"))
    rules = room_queries.rules(many)
    files = rules.groupBy(F.input_file_name()).count().agg(F.max("count").alias("most"), F.sum("count").alias("all")).first()
    assert files.most <= 10_000 and files["all"] == 100_000


def test_numbering_computes_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(n):
        seen.add(1)
        return n

    rows = match_logs.numbered(spark.range(100).select(F.udf(counted, "long")("id").alias("id")), "id", "n")
    assert {tuple(r) for r in rows.select("id", "n").collect()} == {(i, i + 1) for i in range(100)} and seen.value == 100


def test_replaced_partitions_write_no_file_a_match(spark, monkeypatch):
    from matchspark.plans import source_queries
    from matchspark.plans.inputs import Inputs

    monkeypatch.setattr(source_queries, "files", None)
    inputs = Inputs(spark, "/root/testdata/sf0.001")
    assert sum(r.n for r in source_queries.s14_replaced_partitions(inputs).collect()) == inputs.log.count()
