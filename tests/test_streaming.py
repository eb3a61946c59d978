from plinth.streaming import arrivals

SCHEMA = "id long, area double, stairs double, avg_floor_height double, height double"


def test_arrivals_are_cleaned_once(spark, tmp_path):
    rows = [(1, 20.0, 1.0, 3.0, 3.0), (2, 3.0, 1.0, 3.0, 3.0), (3, 20.0, 0.0, 3.0, 3.0), (4, 20.0, None, 3.0, None)]
    folder = str(tmp_path / "in")
    for part in (rows[:2], rows[2:]):
        spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(folder)
        kept, audit = arrivals.clean_arrivals(arrivals.read_arrivals(spark, folder, SCHEMA), "B")
        for name, df in (("kept", kept), ("audit", audit)):
            query = arrivals.write_arrivals(df, str(tmp_path / name), str(tmp_path / f"{name}-state"))
            query.awaitTermination(120)
    assert [r["id"] for r in spark.read.parquet(str(tmp_path / "kept")).collect()] == [1]
    audit = {r["row_idx"]: r["drop_reason"] for r in spark.read.parquet(str(tmp_path / "audit")).collect()}
    assert audit == {2: "small_utility_object", 3: "stairs_invalid", 4: "missing_height"}


def test_polygons_are_cleaned_as_they_arrive(spark, tmp_path):
    schema = "id long, wkt string, gkh_floor_count_min double, gkh_floor_count_max double"
    box = "POLYGON ((0 0,{0} 0,{0} 5,0 5,0 0))"
    rows = [(1, box.format(10), 3.0, 2.0), (2, box.format(2), None, None), (3, "POLYGON ((0 0, 1", None, None), (4, None, None, None), (5, "POLYGON ((0 0,10 10,10 0,0 10,0 0))", None, None), (6, "POLYGON ((0 0,10 0,10 10,0 10,0 0),(0 5,4 4,4 6,0 5))", None, None)]
    folder = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).write.parquet(folder)
    kept, audit = arrivals.clean_arrivals(arrivals.read_arrivals(spark, folder, schema), "A", "wkt", degrees=False)
    for name, df in (("kept", kept), ("audit", audit)):
        arrivals.write_arrivals(df, str(tmp_path / name), str(tmp_path / f"{name}-state")).awaitTermination(120)
    got = {r["id"]: (r["area"], r["repaired"], r["gkh_floor_count_min"]) for r in spark.read.parquet(str(tmp_path / "kept")).collect()}
    assert got == {1: (50.0, False, 2.0), 5: (50.0, True, None)}
    audit = {r["row_idx"]: r["drop_reason"] for r in spark.read.parquet(str(tmp_path / "audit")).collect()}
    assert audit == {2: "small_utility_object", 3: "broken_wkt", 4: "broken_wkt", 6: "invalid_holes"}
