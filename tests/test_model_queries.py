from pledgelens.catalog import modeling


def test_queries_take_the_full_sizes(spark):
    zoo = {name: rule for name, (rule, _) in modeling.ZOO.items()}
    assert (zoo["RandomForest"].trees, zoo["RandomForest"].depth) == (300, 10)
    assert (zoo["GradBoost"].rounds, zoo["GradBoost"].depth) == (200, 3)
    assert (zoo["LeafBoost"].rounds, zoo["LeafBoost"].leaves, zoo["LevelBoost"].rounds, zoo["LevelBoost"].depth) == (200, 31, 200, 4)
    shallow = modeling.FOREST[0]
    assert (shallow.trees, shallow.depth) == (300, 6)


def test_specifications_cover_the_features():
    assert len(modeling._SPECS) == 5 and modeling._SPECS["M_full"] == modeling.FEATURES


def test_stream_reads_a_table_of_many_files(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert modeling.score_stream(spark, str(tmp_path)).count() == 200


def test_model_rows_are_dealt_to_all_cores(spark):
    assert modeling.model_table(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
