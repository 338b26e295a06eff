import datetime as dt

from tallyspark.streaming.windows import fresh_files, windowed


def test_stream_gives_what_the_table_gives(spark, tmp_path):
    path = "/root/testdata/sf0.001/events.parquet"
    batch = {tuple(r) for r in windowed(spark.read.parquet(path)).collect()}
    schema = spark.read.parquet(path).schema
    query = windowed(spark.readStream.schema(schema).parquet("/root/testdata/sf0.001/events.par*")).writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path)).start()
    query.processAllAvailable()
    query.stop()
    assert {tuple(r) for r in spark.table("w").collect()} == batch


def _stream(spark, tmp_path, query, name, batches, schema, mode):
    """Rows of a stream over files that come one by one."""
    folder = tmp_path / "in"
    folder.mkdir()
    stream = query(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder)))
    run = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).start()
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        run.processAllAvailable()
    run.stop()
    return {tuple(r) for r in spark.table(name).collect()}


def test_late_rows_stay_out_of_closed_windows(spark, tmp_path):
    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    batches = [[(at(0, 5), "a", 1.0), (at(0, 50), "a", 2.0), (None, "a", 9.0)], [(at(3), "a", 4.0)], [(at(0, 30), "a", 8.0)], [(at(6), "a", 16.0)], [(at(9), "b", 32.0)]]
    got = _stream(spark, tmp_path, windowed, "late", batches, "ts timestamp_ntz, event_type string, value double", "append")
    assert got == {(at(0), "a", 2, 3.0), (at(3), "a", 1, 4.0), (at(6), "a", 1, 16.0)}


def test_repeated_files_come_once(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    batches = [[("b", at(1), bytearray(b"x"))], [("a", at(2), bytearray(b"x")), ("c", at(3), bytearray(b"y"))]]
    schema = "path string, modificationTime timestamp, content binary"
    got = _stream(spark, tmp_path, lambda df: fresh_files(df).select("path"), "fresh", batches, schema, "append")
    table = fresh_files(spark.createDataFrame(sum(batches, []), schema)).select("path").collect()
    assert got == {tuple(r) for r in table} == {("b",), ("c",)}
