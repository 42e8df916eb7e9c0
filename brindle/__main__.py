"""Command line: `python -m brindle normalize|order-lines -i names.csv -o folder [--name COL] [--brand COL]`.

Reads CSV (with a header) or Parquet and writes Parquet."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import brands, hotel
from brindle.plans import records

RECORD_COLUMNS = ["detected_brand", "normalized_name", "tokens_json", "core_name", "raw_spec", "normalized_spec", "core_tokens_json", "attributes_json"]


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path) if path.endswith(".csv") else spark.read.parquet(path)


def normalize(rows: DataFrame, name: str, brand: str | None, brand_list: DataFrame) -> DataFrame:
    """rows with the eight record columns behind the name column, free of control characters."""
    kept = [c for c in rows.columns if c not in RECORD_COLUMNS]
    out = records.process_records(rows.select(*kept), records.Dictionaries(brand_list), name, brand)
    return records.with_columns_after(out.select(*kept, *RECORD_COLUMNS), name, RECORD_COLUMNS)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="brindle")
    parser.add_argument("command", choices=["normalize", "order-lines"])
    parser.add_argument("-i", "--input", required=True)
    parser.add_argument("-o", "--output", required=True)
    parser.add_argument("--name", default="name", help="column of names or order lines")
    parser.add_argument("--brand", help="column of given brands")
    parser.add_argument("--brands", help="table whose first column lists the brands")
    parser.add_argument("--log-level", default="WARN")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("brindle").getOrCreate()
    spark.sparkContext.setLogLevel(args.log_level)
    rows = read(spark, args.input)
    if args.command == "normalize":
        listed = read(spark, args.brands) if args.brands else spark.createDataFrame([], "brand string")
        out = normalize(rows, args.name, args.brand, brands.brand_dictionary(listed, listed.columns[0]))
    else:
        out = hotel.export_order_lines(rows.withColumn("_order", F.monotonically_increasing_id()), args.name, "_order")
    out.write.mode("overwrite").parquet(args.output)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
