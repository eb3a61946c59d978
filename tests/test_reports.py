"""Sources, sinks, the profiling book and pages."""

import json

import pytest
from pyspark.sql import functions as F

from plinth.operators import maplayers, profiling, reporting
from plinth.sources import readers, writers

BOM = "﻿"


def square(x, y, s=0.0005):
    return f"POLYGON (({x} {y}, {x + s} {y}, {x + s} {y + s}, {x} {y + s}, {x} {y}))"


@pytest.fixture(scope="module")
def sources(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("csv")
    a = [BOM + '"Unnamed: 0",id,geometry,area_sq_m,title,tags,gkh_floor_count_min,gkh_floor_count_max']
    b = ["id,wkt,purpose_of_building,stairs,avg_floor_height,height,name_street,number"]
    for k in range(30):
        x, y = 30 + 0.0004 * k, 59.9
        a.append(f'{k},a{k:02},"{square(x, y)}",{900 + k},"said ""{k}""\nagain","[t{k % 4}]",{k % 5 + 1},{k % 3 + 1}')
        b.append(f'b{k:02},"{square(x + 0.00001, y)}",{["house", "shop", "NA"][k % 3]},{k % 4},3.0,{9 + k % 7},{"Main" if k % 2 else ""},{k}')
    a += ['30,a30,"POLYGON ((0 0, 1 1",5,,,NA,NA', f'31,a31,"{square(30, 59.9)}",900,copy,,,']
    b += ['b30,POINT (1 2),house,1,3,3,,', 'b31,"POLYGON ((0 0,0.01 0,0.01 0.01,0 0.01,0 0),(0 0.005,0.004 0.004,0.004 0.006,0 0.005))",,2,3,6,,']
    for name, lines in (("a", a), ("b", b)):
        (folder / f"{name}.csv").write_text("\n".join(lines), encoding="utf-8")
    return (
        readers.read_csv(spark, str(folder / "a.csv"), readers.SCHEMA_A).drop("Unnamed: 0"),
        readers.read_csv(spark, str(folder / "b.csv"), readers.SCHEMA_B),
        str(folder),
    )


def test_csv(spark, sources):
    a, b, folder = sources
    assert a.count() == 32 and b.count() == 32
    row = a.where("id = 'a03'").first()
    assert row["title"] == 'said "3"\nagain' and row["area_sq_m"] == 903.0 and row["gkh_address"] is None
    assert b.where("purpose_of_building IS NULL").count() == 11
    assert readers.exists(spark, f"{folder}/a.csv") and not readers.exists(spark, f"{folder}/no.csv")
    parsed = readers.read_footprints(spark, f"{folder}/a.csv", readers.SCHEMA_A, "geometry")
    assert parsed.where("wkb IS NULL").count() == 1 and "Unnamed: 0" not in parsed.columns


def test_book(spark, sources, tmp_path):
    a, b, _ = sources
    sheets = reporting.eda_book(a, b)
    assert len(sheets) == 58 and len({s[1] for s in sheets}) == 58 and len({s[0] for s in sheets}) == 15
    index = writers.write_book(spark, sheets, str(tmp_path / "book"))
    assert index.count() == 58
    book = writers.read_book(spark, str(tmp_path / "book"))
    assert set(book) == {s[1] for s in sheets}
    quality = writers.metric_values(book["geo_basic_quality"])
    assert (quality["A_geometry_null"], quality["B_geometry_null"], quality["A_invalid_geometry"]) == ("1", "1", "1")
    assert writers.metric_values(book["holes_B_summary"])["invalid_holes"] == "1"
    assert book["dup_exact_A_summary"].first()["duplicates"] == 2
    assert book["nbr_A_stats"].first()["max"] >= 2
    assert writers.metric_values(book["near_dup_B_summary"])["near_duplicate_pairs_in_sample"] == "0"
    assert writers.metric_values(book["near_dup_A_summary"])["near_duplicate_pairs_in_sample"] == "1"
    ratio = book["area_top_mismatch"].first()
    assert ratio["geom_area_m2"] > 3 * ratio["area_sq_m"]
    full = reporting.measured(a, "geometry")
    block = reporting.dataset_block("A", a, full).first()
    assert block["total"] == 32 and block["null_geom"] == 1 and 0 <= block["score"] <= 100


def test_page(spark):
    bins = profiling.histogram(spark.range(100).withColumn("v", F.col("id").cast("double")), "v", 10)
    text = reporting.page("A & B", [reporting.table_html("t<1>", spark.range(3)), reporting.histogram_svg(bins, 10)])
    assert "A &amp; B" in text and "t&lt;1&gt;" in text and text.count("<rect") == 10


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], bytearray(b"\x01"), 30.0, 60.0)], "id long, uids array<string>, wkb binary, lon double, lat double")
    writers.write_csv(df, str(tmp_path / "c"))
    assert readers.read_csv(spark, str(tmp_path / "c")).first()["uids"] == '["a","b"]'
    writers.write_parquet(df, str(tmp_path / "p"))
    assert readers.read_geoparquet(spark, str(tmp_path / "p"), "wkb").count() == 1
    writers.write_geojson_lines(df.drop("wkb"), str(tmp_path / "g"))
    feature = json.loads(spark.read.text(str(tmp_path / "g")).first()["value"])
    assert feature["geometry"]["coordinates"] == [30.0, 60.0] and feature["properties"]["id"] == 1


def test_sheet_names():
    used = set()
    assert [writers.sheet_name(n, used) for n in ("a/b", "a:b", " " * 3, "x" * 40, "x" * 40)] == ["a_b", "a_b_1", "sheet", "x" * 31, "x" * 29 + "_1"]


def test_map_layers(spark):
    df = spark.createDataFrame([(k, 668304.0 + k, 6632947.0, 10.0 * k, "high", k % 2, "1:1") for k in range(30)], "component_id long, cx double, cy double, target_height_filled double, target_height_reliability string, target_height_was_predicted int, match_type string")
    at = maplayers.located(df)
    row = at.first()
    assert row["lon"] == pytest.approx(30.01, abs=0.02) and row["lat"] == pytest.approx(59.8, abs=0.02)
    assert maplayers.height_points(at).count() == 21 and maplayers.height_points(at, None).count() == 30
    assert maplayers.confidence_points(at, share=0.1).count() == 3
    assert {r["weight"] for r in maplayers.confidence_heat(at).collect()} == {3.0, 0.5}
