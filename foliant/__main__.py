"""python -m foliant convert IN... --output DIR, or bundle IN... --inbox DIR. Exits 2 without files, 1 after failures."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import text
from foliant.operators import chunking, manifest, publish
from foliant.sources import files


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="foliant", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)
    for name in ("convert", "bundle"):
        one = commands.add_parser(name)
        one.add_argument("inputs", nargs="+")
        one.add_argument("--config", help="a TOML file of options; what is given here counts more")
        one.add_argument("--preset", choices=sorted(files.PRESETS))
        one.add_argument("--max-rows", type=int)
        one.add_argument("--include-hidden", action="store_true")
        one.add_argument("--no-tables", action="store_true", help="tables of PDF files stay text")
        one.add_argument("--ocr-lang")
        one.add_argument("--timeout", type=float, default=0, help="seconds that one file may take; 0 is no limit")
        one.add_argument("--strict", action="store_true", help="the first file with an error ends the run")
        one.add_argument("--quiet", action="store_true", help="nothing but errors is told")
        one.add_argument("--ignore-errors", action="store_true", help="failures don't change the exit code")
    convert, bundle = commands.choices["convert"], commands.choices["bundle"]
    convert.add_argument("--output")
    convert.add_argument("--output-policy", choices=publish.POLICIES, default="overwrite")
    convert.add_argument("--chunk", type=int, default=0, help="tokens of a chunk; 0 makes none")
    convert.add_argument("--mark-uncertain", action="store_true")
    convert.add_argument("--stats", action="store_true")
    convert.add_argument("--report", help="a .json file for the report, or a folder for JSON lines")
    convert.add_argument("--stdout", action="store_true")
    bundle.add_argument("--inbox", required=True)
    bundle.add_argument("--include-warnings", action="store_true")
    return out


def options_of(args: argparse.Namespace) -> files.Options:
    options = files.PRESETS[args.preset] if args.preset else files.Options()
    if args.config:
        options, message = files.read_options(args.config)
        if message:
            print(message, file=sys.stderr)
    given = {"max_rows": args.max_rows, "include_hidden_sheets": args.include_hidden or None, "pdf_tables": False if args.no_tables else None, "ocr_lang": args.ocr_lang}
    return files.Options(**{**vars(options), **{k: v for k, v in given.items() if v is not None}})


def run(spark: SparkSession, argv: list[str]) -> int:
    args = parser().parse_args(argv)
    began = time.time()
    found = files.detections(files.scan(spark, *args.inputs, output=getattr(args, "output", None)))
    made = files.converted(found, options_of(args), timeout=args.timeout)
    results = (files.strictly(made) if args.strict else made).withColumns({"duration_s": F.lit(0.0), "output": F.lit(None).cast("string")}).cache()
    try:
        return finish(args, results, began)
    finally:
        results.unpersist()


def finish(args: argparse.Namespace, results: DataFrame, began: float) -> int:
    if results.isEmpty():
        print("no files", file=sys.stderr)
        return 2
    if args.command == "bundle":
        print(publish.drop(results, args.inbox, "source", include_warnings=args.include_warnings))
    else:
        shown = F.col("markdown")
        if args.mark_uncertain:
            shown = text.with_flags(shown, F.col("review_lines"))
        good = results.filter("success").withColumn("markdown", shown)
        if args.chunk > 0:
            good = good.withColumn("chunks", chunking.chunks(F.col("markdown"), args.chunk))
        if args.output:
            for r in publish.publish(publish.named(good, "source"), args.output, args.output_policy).toLocalIterator():
                if not args.quiet or r.path is None:
                    print(f"{r.source}: {r.path or r.outcome}")
        if args.stdout:
            print(publish.joined_text(good, "source").first().text)
        if args.stats:
            for r in manifest.savings_lines(manifest.savings(good.withColumn("original_size", F.col("length")))).toLocalIterator():
                print(r.line)
        if args.report:
            publish.write_report(results, args.report)
    total = manifest.summary(results).first()
    if not args.quiet:
        print(f"{total.converted} converted, {total.warned} with warnings, {total.failed} failed, about {total.tokens} tokens, {time.time() - began:.1f} s", file=sys.stderr)
    for r in results.filter("NOT success").select("source", "error").toLocalIterator():
        print(f"{r.source}: {r.error}", file=sys.stderr)
    return int(total.failed > 0 and not args.ignore_errors)


if __name__ == "__main__":
    sys.exit(run(SparkSession.builder.appName("foliant").getOrCreate(), sys.argv[1:]))
