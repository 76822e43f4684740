"""The line job: each line of text files to a line of delimited tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import TRIMMED
from ..functions.segmenting import segment
from ..functions.text import joined
from ..operators.dictionary import Dictionary


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row (value) a line."""
    return spark.read.text(path)


def segmented_lines(lines: DataFrame, dictionary: Dictionary, delimiter: str = "|", safe: bool = False) -> DataFrame:
    """Column value: the tokens of each line, joined."""
    return lines.select(joined(segment(F.col("value"), dictionary, safe), delimiter).alias("value"))


def segment_files(spark: SparkSession, source: str, target: str, dict_path: str, delimiter: str = "|", safe: bool = False) -> None:
    """Reads lines from ``source`` and writes delimited ones to ``target``."""
    segmented_lines(read_lines(spark, source), Dictionary.from_file(spark, dict_path), delimiter, safe).write.text(target)


def main(argv: list[str] | None = None) -> int:
    """segment -d DICT [-s DELIMITER] [-z] [-p] < lines: one output line for each."""
    import argparse
    import io
    import sys

    from .. import ship
    from ..operators.lattice import Lexicon, segment_text

    p = argparse.ArgumentParser(prog="segment", description="Segment lines of Thai text.")
    p.add_argument("-d", "--dict-path", required=True, help="a file with one word a line")
    p.add_argument("-s", "--word-delimiter", default="|")
    p.add_argument("-z", "--safe", action="store_true", help="bound the work on ambiguous text")
    p.add_argument("-p", "--parallel", action="store_true", help="accepted; partitions are the unit of parallel work")
    p.add_argument("--input", help="text files to read in place of stdin, by Spark")
    p.add_argument("--output", help="a folder for the result of --input")
    a = p.parse_args(argv)
    if a.input:
        spark = SparkSession.builder.getOrCreate()
        ship(spark)
        segment_files(spark, a.input, a.output, a.dict_path, a.word_delimiter, a.safe)
        return 0
    with open(a.dict_path, encoding="utf-8") as f:
        lexicon = Lexicon(line.strip(TRIMMED) for line in f)
    # only a line feed ends a line, with a carriage return before it or without
    for line in io.TextIOWrapper(sys.stdin.buffer, encoding="utf-8", newline="\n"):
        line = line.removesuffix("\n").removesuffix("\r") if line.endswith("\n") else line
        print(a.word_delimiter.join(segment_text(line, lexicon, a.safe)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
