from fieldloom.streaming.ingest import stream_collection, stream_mappings

VECTOR = "id string, embedding array<double>, document string, metadata map<string,string>"


def test_collection_stream(spark, tmp_path):
    source, target, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    spark.createDataFrame([("a", [1.0], "one", {}), ("a", [1.0], "one", {}), ("b", None, "no vector", {})], VECTOR).write.parquet(source)
    stream = spark.readStream.schema(VECTOR).parquet(source)
    stream_collection(stream, target, mark).awaitTermination(60)
    spark.createDataFrame([("a", [9.0], "again", {}), ("c", [3.0], "three", {})], VECTOR).write.mode("append").parquet(source)
    stream_collection(stream, target, mark).awaitTermination(60)
    assert sorted((r.id, r.document) for r in spark.read.parquet(target).collect()) == [("a", "one"), ("c", "three")]


def test_mapping_stream(spark, tmp_path):
    schema = "source_file string, row_number bigint, header array<string>, cells array<string>"
    source, target, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    spark.createDataFrame([("f", 1, ["Source Table", "Field"], ["t", "x"]), ("f", 2, ["Source Table", "Field"], [" ", ""])], schema).write.parquet(source)
    stream_mappings(spark.readStream.schema(schema).parquet(source), target, mark).awaitTermination(60)
    assert [(r.source_table, r.target_field) for r in spark.read.parquet(target).collect()] == [("t", "x")]
