"""``python -m determina INPUT OUTPUT`` (or by spark-submit): the minimal FDs of a
delimited file as text lines."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

import determina as d


def main() -> None:
    parser = argparse.ArgumentParser(prog="determina", description=__doc__)
    parser.add_argument("input", help="headerless delimited text, one row per line")
    parser.add_argument("output", help="a folder that does not exist yet")
    parser.add_argument("--checkpoints", help="shared folder for staged tables; default: spark.checkpoint.dir")
    parser.add_argument("--separator", default=",")
    parser.add_argument("--width", type=int, help="number of columns; saves the pass that looks for the widest line")
    parser.add_argument("--max-lhs", type=int, help="largest left side to look for")
    parser.add_argument("--constants", choices=["strict", "expand"], default="strict")
    args = parser.parse_args()

    builder = SparkSession.builder.appName("determina")
    if args.checkpoints:
        builder = builder.config("spark.checkpoint.dir", args.checkpoints)
    spark = builder.getOrCreate()
    try:
        # The answer is the same for repeated rows; dropping them would only cost a shuffle.
        df = d.read_delimited(
            spark, args.input, width=args.width, separator=args.separator, distinct=False
        )
        fds = d.discover_fds(
            df, max_lhs=args.max_lhs, constants=args.constants, stage_input=True
        )
        d.write_fds(fds, args.output)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
