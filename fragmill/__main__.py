"""python -m fragmill strings.csv: train on the first rows, test round trips, report the accuracy."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from fragmill.plans.evaluate import first_failures, run_tested
from fragmill.sources.tables import first_rows, from_csv


def main(argv: list[str] | None = None) -> float | None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("csv", help="CSV files with a header; strings in the first column")
    p.add_argument("--train-n", type=int, default=50_000, help="the model learns from so many strings at the top of the files")
    p.add_argument("--eval-n", type=int, help="test so many strings only")
    p.add_argument("--vocab-size", type=int, default=1000, help="ids in all, bytes and special ones included")
    p.add_argument("--shuffle", action="store_true", help="put each string's fragments in a random order, and compare them as a set")
    p.add_argument("--compare", choices=["molecules", "strings"], default="molecules", help="what has to come back: the molecule, or the encoder's very string")
    p.add_argument("--failures", help="folder for a CSV of strings that come back changed")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    rows = from_csv(spark, a.csv).withColumn("mol_id", F.monotonically_increasing_id())
    tested = rows if a.eval_n is None else first_rows(rows, a.eval_n)
    table, failed = run_tested(first_rows(rows, a.train_n), tested, a.vocab_size, a.shuffle, a.failures, a.compare)
    found = table.first()
    print(f"{found['n_ok']} of {found['n']} round trips, accuracy {found['accuracy']}")
    for row in first_failures(failed, "mol_id").collect():  # ten rows
        print(f"{row['input']} came back as {row['decoded']}")
    return found["accuracy"]


if __name__ == "__main__":
    main()
