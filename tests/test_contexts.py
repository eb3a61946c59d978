"""Report contexts, pages, the command line, and the sinks for maps and GeoPackages."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from plinth import cli
from plinth.functions import kernels
from plinth.operators import contexts
from plinth.sources import writers


def square(x, y, s=0.0003):
    return f"POLYGON (({x} {y}, {x + s} {y}, {x + s} {y + s}, {x} {y + s}, {x} {y}))"


@pytest.fixture(scope="module")
def csvs(tmp_path_factory):
    """Two sources: A's and B's squares in pairs, with a broken text, a bow-tie, a bad hole, a copy, gaps and a greenhouse."""
    folder = tmp_path_factory.mktemp("raw")
    a = ["Unnamed: 0,id,geometry,area_sq_m,title,tags,gkh_floor_count_min,gkh_floor_count_max"]
    b = ["id,wkt,purpose_of_building,stairs,avg_floor_height,height,name_street,number"]
    for k in range(60):
        x, y = 30 + 0.002 * (k % 8), 59.9 + 0.002 * (k // 8)
        a.append(f'{k},a{k},"{square(x, y)}",{900 + k},t{k},[x],{3 if k == 5 else 1},2')
        if k % 6:
            purpose = cli.IRRELEVANT if k == 7 else ["house", "shop", ""][k % 3]
            text = "" if "," not in purpose else '"'
            height = "" if k == 13 else 9 + k % 7
            b.append(f'b{k},"{square(x + 0.00002, y)}",{text}{purpose}{text},{"" if k == 11 else k % 4 + 1},{0 if k == 14 else 3.0},{height},Main,{k}')
    a += ['60,a60,"POLYGON ((0 0, 1 1",5,,,,', f'61,a61,"{square(30, 59.9)}",900,copy,,,', '62,a62,"POLYGON ((30.1 59.9,30.101 59.901,30.101 59.9,30.1 59.901,30.1 59.9))",5,bow,,,']
    b += ['b60,"POLYGON ((30.2 59.9,30.21 59.9,30.21 59.91,30.2 59.91,30.2 59.9),(30.2 59.905,30.204 59.904,30.204 59.906,30.2 59.905))",,2,3,6,,']
    for name, lines in (("a", a), ("b", b)):
        (folder / f"{name}.csv").write_text("\n".join(lines), encoding="utf-8")
    return str(folder)


@pytest.fixture(scope="module")
def made(spark, csvs, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("out"))
    cli.main(["run", "--a", f"{csvs}/a.csv", "--b", f"{csvs}/b.csv", "--out", out, "--model", "linear", "--gpkg", f"{out}/b.gpkg"])
    return out


def test_run_from_raw_files(spark, made):
    audit = {s: {r["drop_reason"]: r["count"] for r in spark.read.parquet(f"{made}/audit_{s}").groupBy("drop_reason").count().collect()} for s in "ab"}
    assert audit == {"a": {"broken_wkt": 1, "duplicate": 1}, "b": {"invalid_holes": 1, "missing_height": 1}}
    clean = spark.read.parquet(f"{made}/clean_a")
    assert clean.count() == 61 and clean.where("repaired").count() == 1 and clean.where("status = 'repaired'").count() == 1
    table = spark.read.parquet(f"{made}/buildings")
    kinds = {r["match_type"]: r["count"] for r in table.groupBy("match_type").count().collect()}
    assert kinds == {"1:1": 48, "A_only": 13}  # 50 of B, less the one without height and the greenhouse
    assert table.where("target_height_filled IS NULL").count() == 0 and table.where("target_height_was_predicted = 1").count() == 13
    one = table.where("match_type = '1:1'").first()
    assert one["geometry_source"] == "B" and 0.8 < one["max_iou"] < 1 and 500 < one["union_area_a"] < 600
    shape = kernels.from_wkb(one["rep_geometry"])
    assert kernels.area(shape) == pytest.approx(one["union_area_b"], rel=1e-9)
    assert table.columns[:48] == cli.matching.FINAL_COLUMNS
    con = sqlite3.connect(f"{made}/b.gpkg")
    assert con.execute("SELECT count(*), count(geom) FROM buildings").fetchone() == (61, 61)
    for name in ("edges", "candidate_pairs", "importance"):
        assert spark.read.option("header", True).csv(f"{made}/{name}").count() > 0


def test_eda_page(spark, csvs, tmp_path):
    page = str(tmp_path / "eda.html")
    cli.main(["eda", "--a", f"{csvs}/a.csv", "--b", f"{csvs}/b.csv", "--book", str(tmp_path / "book"), "--out-html", page, "--title", "A & B", "--logo", "logo.png"])
    text = open(page, encoding="utf-8").read()
    assert "A &amp; B" in text and "logo.png" in text and "Likely duplicates" in text
    book = writers.read_book(spark, str(tmp_path / "book"))
    from plinth.sources import readers

    sources = {s: readers.read_csv(spark, f"{csvs}/{s.lower()}.csv", schema).drop("Unnamed: 0") for s, schema in (("A", readers.SCHEMA_A), ("B", readers.SCHEMA_B))}
    found = contexts.eda_context(sources, book)
    a, b = found["datasets"]
    assert (a["total"], a["null_geom"], a["invalid_geom"], a["signature_dups"], a["numeric_flags"]) == (63, 1, 2, 2, 1)  # a null counts as invalid, too
    assert (b["total"], b["invalid_holes"], b["null_geom"]) == (51, 1, 0) and b["rows_with_missing"] == 51
    assert found["cards"][0]["value"] == "114" and found["compare_rows"][0]["max"] == 63 and 0 <= a["score"] <= 100


def test_validation_page(spark, made, tmp_path):
    page = str(tmp_path / "v.html")
    cli.main(["validate", "--parquet", f"{made}/buildings", "--out-html", page])
    text = open(page, encoding="utf-8").read()
    assert text.count("<svg") == 2 and "flag and source disagree" in text
    table = spark.read.parquet(f"{made}/buildings")
    found = contexts.validation_context(table)
    assert found["score"] == 100 and found["hero_total"] == "61" and found["extreme"] is None
    assert {b["k"]: b["v"] for b in found["model"]}["predicted"] == "13" and found["fill_sources"] == {"observed": 48, "catboost": 13}
    damaged = table.withColumns({"target_height_filled": F.expr("CASE WHEN component_id % 10 = 0 THEN NULL WHEN component_id = 3 THEN 450D ELSE target_height_filled END"), "n_neighbors_100m": F.lit(1), "neighbor_height_mean_100m": F.lit(5.0), "target_height_was_predicted": F.expr("CASE WHEN component_id = 3 THEN 0 ELSE target_height_was_predicted END")})
    found = contexts.validation_context(damaged)
    assert found["score"] < 100 and found["extreme"]["target_height_filled"] == 450 and found["completeness"][0]["v"] == "6"
    with pytest.raises(ValueError, match="rep_geometry"):
        contexts.validation_context(table.drop("rep_geometry"))
    with pytest.raises(SystemExit):
        cli.main(["validate", "--parquet", str(tmp_path / "none"), "--out-html", page])


def test_geopackage(spark, tmp_path):
    path = str(tmp_path / "x.gpkg")
    wkb = kernels.to_wkb(kernels.parse_wkt("POLYGON ((0 0,1 0,1 1,0 0))"))
    df = spark.createDataFrame([(1, "a \"b\"", ["x", "y"], bytearray(wkb)), (2, None, None, None)], "id long, `na\"me` string, uids array<string>, wkb binary")
    assert writers.write_geopackage(df, path, "clean a") == 2
    con = sqlite3.connect(path)
    assert con.execute("SELECT table_name, srs_id FROM gpkg_contents").fetchall() == [("clean a", 32635)]
    assert con.execute("PRAGMA application_id").fetchone() == (1196444487,)
    rows = con.execute('SELECT id, "na""me", uids, geom FROM "clean a" ORDER BY id').fetchall()
    assert rows[0][:3] == (1, 'a "b"', '["x","y"]') and rows[1] == (2, None, None, None)
    head = rows[0][3]
    assert head[:4] == b"GP\x00\x01" and int.from_bytes(head[4:8], "little") == 32635 and head[8:] == wkb


def test_map_page(spark, tmp_path):
    points = spark.range(500).select((F.col("id") / 100 + 30).alias("lon"), F.lit(59.9).alias("lat"), F.lit("#fdae61").alias("colour"))
    assert writers.write_map(points, str(tmp_path / "m.html"), "a < b", "colour") == 500
    text = (tmp_path / "m.html").read_text()
    assert "a &lt; b" in text and "500 of 500" in text and "#fdae61" in text
    assert writers.write_map(points, str(tmp_path / "n.html"), "few", most=20) == 20 and "20 of 500" in (tmp_path / "n.html").read_text()
    assert writers.write_map(points.limit(0), str(tmp_path / "o.html"), "none") == 0


def test_map_pages_of_a_table(spark, made, tmp_path):
    import json

    cli.main(["maps", "--parquet", f"{made}/buildings", "--out", str(tmp_path)])
    pages = {name: (tmp_path / f"{name}.html").read_text() for name in ("heights", "heights_all", "confidence", "confidence_sample", "confidence_heat")}
    assert "61 of 61" in pages["heights"] and "6 of 6" in pages["confidence_sample"] and "#bd0026" in pages["heights"]
    one = json.loads(spark.read.text(str(tmp_path / "confidence")).first()["value"])
    assert 29.9 < one["geometry"]["coordinates"][0] < 30.2 and 59.8 < one["geometry"]["coordinates"][1] < 60
