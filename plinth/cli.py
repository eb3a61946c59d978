"""Command line: ``spark-submit -m plinth.cli`` or ``python -m plinth.cli``.

    eda --a A.csv --b B.csv --book FOLDER --out-html PAGE
    validate --parquet TABLE --out-html PAGE
    run --a A.csv --b B.csv --out FOLDER [--gpkg FILE]
    maps --parquet TABLE --out FOLDER
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from plinth.operators import cleaning, contexts, maplayers, matching, modelling, reporting, validation
from plinth.sources import geoparquet, readers, writers
from plinth.storage import checkpoint

# Fixed value: the purpose that is no building.
IRRELEVANT = "Парники, оранжереи, теплицы"


def eda(spark: SparkSession, args: argparse.Namespace) -> None:
    """Profile both sources into a book and write the page about it."""
    sources = {s: readers.read_csv(spark, path, schema).drop("Unnamed: 0") for s, path, schema in (("A", args.a, readers.SCHEMA_A), ("B", args.b, readers.SCHEMA_B))}
    writers.write_book(spark, reporting.eda_book(sources["A"], sources["B"]), args.book)
    context = contexts.eda_context(sources, writers.read_book(spark, args.book), args.title, args.logo)
    writers.write_text(spark, contexts.render(context), args.out_html)


def validate(spark: SparkSession, args: argparse.Namespace) -> None:
    """Write the page about a filled table."""
    if not readers.exists(spark, args.parquet):
        raise SystemExit(f"there is no {args.parquet}")
    writers.write_text(spark, contexts.render(contexts.validation_context(checkpoint(spark.read.parquet(args.parquet)), args.title, args.logo)), args.out_html)


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    """From the raw sources to the filled table: clean, match, fit, fill; writes every table that the steps yield."""
    sides = []
    for source, path, schema, wkt, clean in (("A", args.a, readers.SCHEMA_A, "geometry", cleaning.clean_a), ("B", args.b, readers.SCHEMA_B, "wkt", cleaning.clean_b)):
        raw = readers.read_csv(spark, path, schema)
        kept, audit = clean(checkpoint(raw.withColumn("__at", readers.file_order())), IRRELEVANT, ["wkb"], wkt=wkt)
        kept = checkpoint(kept)
        writers.write_parquet(kept.drop(wkt), f"{args.out}/clean_{source.lower()}")
        writers.write_parquet(audit, f"{args.out}/audit_{source.lower()}")
        rows = matching.shapes(cleaning.relevant_only(kept))
        sides.append(checkpoint(matching.with_uids(rows, source, "row_idx")))
    a, b = sides
    found = matching.polygon_pairs(a, b)
    pairs = checkpoint(matching.pair_metrics(found, found["inter"], found["dist"]))
    edges = checkpoint(pairs.where(matching.edge_rule()))
    members = checkpoint(matching.components(matching.vertices(a, b), edges))
    table = checkpoint(matching.final_table(a, b, members, edges))
    predicted, importance = modelling.fit_and_predict(table, args.model, modelling.FEATURE_SETS["baseline"], modelling.BEST.get(args.model))
    writers.write_parquet(validation.fill_heights(table, predicted), f"{args.out}/buildings")
    if args.gpkg:
        writers.write_geopackage(spark.read.parquet(f"{args.out}/buildings"), args.gpkg, "buildings", "rep_geometry")
    if args.geoparquet:
        geoparquet.write_geoparquet(spark.read.parquet(f"{args.out}/buildings"), args.geoparquet, "rep_geometry", geometry="rep_geometry")
    for name, df in (("candidate_pairs", pairs), ("edges", edges), ("importance", importance)):
        writers.write_csv(df, f"{args.out}/{name}")


def maps(spark: SparkSession, args: argparse.Namespace) -> None:
    """Write the map pages of a filled table, and their points as GeoJSON lines."""
    rows = checkpoint(maplayers.located(spark.read.parquet(args.parquet)))
    layers = {
        "heights": maplayers.height_points(rows), "heights_all": maplayers.height_points(rows, None), "confidence": maplayers.confidence_points(rows),
        "confidence_sample": maplayers.confidence_points(rows, share=0.1), "confidence_heat": maplayers.confidence_heat(rows),
    }
    for name, points in layers.items():
        shown = points if "colour" in points.columns else maplayers.shaded(points)
        writers.write_map(shown, f"{args.out}/{name}.html", name.replace("_", " "), "colour")
        writers.write_geojson_lines(points, f"{args.out}/{name}")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="plinth", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    steps = out.add_subparsers(dest="step", required=True)
    for name, action, needed, title in (("eda", eda, ["a", "b", "book", "out-html"], "EDA quality"), ("validate", validate, ["parquet", "out-html"], "Validation"), ("run", run, ["a", "b", "out"], None), ("maps", maps, ["parquet", "out"], None)):
        step = steps.add_parser(name, help=action.__doc__)
        step.set_defaults(action=action)
        for flag in needed:
            step.add_argument(f"--{flag}", required=True)
        if title:
            step.add_argument("--title", default=title)
            step.add_argument("--logo", default="")
    steps.choices["run"].add_argument("--gpkg", default="", help="a local GeoPackage to write the buildings to as well")
    steps.choices["run"].add_argument("--geoparquet")
    steps.choices["run"].add_argument("--model", default="ordered_categories", choices=["linear", "forest", "gbt", "boosted_categories", "histogram", "ordered_categories"])
    return out


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    args.action(SparkSession.builder.appName("plinth").getOrCreate(), args)


if __name__ == "__main__":
    main()
