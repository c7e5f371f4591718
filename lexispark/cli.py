"""python -m lexispark.cli detect TEXT | batch FILE | bench | backends; a bare text is detected."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import evaluate
from .operators.backends import RELIABILITY, list_backends
from .plans.config import Config
from .plans.detect import Detector
from .functions.text import truncated
from .sources.files import json_array, jsonl, read_lines, write_jsonl

# Sentences to try a setup on.
GOLDEN = [("This is the house that we have seen and it was very old", "en"), ("Il est dans la maison avec les enfants et nous", "fr"), ("Das ist nicht die Frau von der wir auch noch sprechen", "de"), ("El perro que está en la casa no es de mi hermano pero sí de los otros", "es")]


def shown(text: str, result: dict, form: str) -> str:
    """A result as one line of JSON, as indented JSON, or as a table of its fields with the text cut at 100 characters."""
    fields = {k: v for k, v in result.items() if v is not None and k != "id"}
    if form == "table":
        rows = {"text": text if len(text) <= 100 else text[:100] + "...", **fields}
        return "\n".join(f"{name:<12} {value}" for name, value in rows.items())
    return json.dumps(fields, ensure_ascii=False, indent=2 if form == "pretty" else None)


def main(args: list[str] | None = None) -> int:
    args = list(sys.argv[1:] if args is None else args)
    if args and args[0] not in ("detect", "batch", "bench", "backends", "-h", "--help"):
        args.insert(0, "detect")
    parser = argparse.ArgumentParser(prog="lexispark")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("detect", "batch"):
        sub = commands.add_parser(name)
        sub.add_argument("input", help="a text, or a file of lines; - is standard input")
        sub.add_argument("--mode", default="default", choices=["short", "default", "long"])
        sub.add_argument("--langs", nargs="*", default=[])
        sub.add_argument("--top-k", type=int, default=1)
        sub.add_argument("--out")
        sub.add_argument("--format", default="json", choices=["json", "pretty", "table"] if name == "detect" else ["json", "array", "table"])
    commands.add_parser("bench")
    commands.add_parser("backends")
    asked = parser.parse_args(args)
    if asked.command == "backends":
        for name in list_backends():
            print(name, RELIABILITY.get(name, ""))
        return 0
    spark = SparkSession.builder.appName("lexispark").getOrCreate()
    if asked.command == "bench":
        rows = spark.createDataFrame([(i, t, e) for i, (t, e) in enumerate(GOLDEN)], "id long, text string, expected string")
        evaluate.accuracy(Detector(spark, Config(filter_proper_nouns=False)).detect_table(rows).join(rows.select("id", "expected"), "id")).show()
        return 0
    detector = Detector(spark, Config(mode=asked.mode, allowed=tuple(asked.langs)))
    if asked.command == "detect":
        text = sys.stdin.read() if asked.input == "-" else asked.input
        print(shown(text, detector.detect(text, top_k=asked.top_k), asked.format))
        return 0
    lines = spark.createDataFrame([(x.strip(),) for x in sys.stdin if x.strip()], "text string") if asked.input == "-" else read_lines(spark, asked.input)
    texts = lines.withColumn("id", F.monotonically_increasing_id()).select("id", "text")
    results = detector.detect_table(texts, top_k=asked.top_k)
    if asked.format == "table":
        columns = texts.join(results, "id").select("id", truncated(F.col("text"), 37, "...").alias("text"), "lang", F.round("confidence", 4).alias("confidence"))
        for row in columns.orderBy("id").toLocalIterator():
            print(f"{row['text']:<40} {row['lang']:<8} {row['confidence']:.4f}")
        return 0
    records = jsonl(texts, results, with_reason=asked.format == "json")
    if asked.format == "array":
        print(json_array(records).first()["value"])
        return 0
    if asked.out:
        write_jsonl(records, asked.out)
    else:
        for row in records.orderBy("id").toLocalIterator():
            print(row["value"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
