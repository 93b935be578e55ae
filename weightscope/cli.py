"""Command line: scan, verify, compare."""

from __future__ import annotations

import argparse
import contextlib
import os
import sys

from pyspark.sql import SparkSession

from weightscope import api
from weightscope import constants as K
from weightscope.plans.progress import Progress


def session() -> SparkSession:
    """A session for one machine, or the cluster's own."""
    return SparkSession.builder.appName("weightscope").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def parser() -> argparse.ArgumentParser:
    """The arguments of all commands."""
    top = argparse.ArgumentParser(prog="weightscope", description="Look into model artifacts without loading them.")
    commands = top.add_subparsers(dest="command", required=True)
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--json", action="store_true", help="JSON instead of text")
    common.add_argument("--fail-on", default="high", type=lambda s: s.strip().lower(), choices=K.SEVERITIES)
    common.add_argument("--color", default="auto", choices=("auto", "always", "never"))
    common.add_argument("--svg", metavar="FILE", help="write a picture of the layers")
    common.add_argument("--mad-k", type=float, default=5.0)
    scanned = argparse.ArgumentParser(add_help=False)
    scanned.add_argument("path")
    scanned.add_argument("--allow-empty", action="store_true")
    scanned.add_argument("--deep", "--stats", action="store_true", help="statistics of the values")
    scanned.add_argument("--profile", action="store_true", help="layers as bars; implies --deep")
    scanned.add_argument("--scan-tensor-entropy", action="store_true", help="look for noise in integer tensors; implies --deep")
    scanned.add_argument("--no-progress", action="store_true", help="no line of progress on a terminal")
    commands.add_parser("scan", parents=[common, scanned])
    verify = commands.add_parser("verify", parents=[common, scanned])
    verify.add_argument("--bundle")
    verify.add_argument("--key")
    compare = commands.add_parser("compare", parents=[common])
    compare.add_argument("subject")
    compare.add_argument("baseline")
    compare.add_argument("--epsilon", type=float, default=1e-6)
    compare.add_argument("--force", action="store_true")
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run a command; returns the exit code."""
    o = parser().parse_args(args)
    spark = spark or session()
    color = o.color == "always" or (o.color == "auto" and sys.stdout.isatty() and "NO_COLOR" not in os.environ)
    if o.command == "compare":
        out = api.compare(spark, o.subject, o.baseline, mad_k=o.mad_k, epsilon=o.epsilon, force=o.force)
        code = out.exit_code(o.fail_on)
    else:
        deep = o.deep or o.profile or bool(o.svg) or o.scan_tensor_entropy
        with Progress(spark, sys.stderr) if sys.stderr.isatty() and not o.no_progress else contextlib.nullcontext():
            out = api.scan(spark, o.path, deep=deep, mad_k=o.mad_k, tensor_entropy=o.scan_tensor_entropy, bundle=getattr(o, "bundle", None), key=getattr(o, "key", None))
        code = out.exit_code(o.fail_on, o.allow_empty)
    sys.stdout.write(out.to_json() + "\n" if o.json else out.to_human(color))
    if o.command != "compare" and o.profile and not o.json:
        sys.stdout.write(out.sparklines(color))
    if o.svg and (picture := out.svg()):
        with open(o.svg, "w", encoding="utf-8") as f:
            f.write(picture)
    return code


if __name__ == "__main__":
    sys.exit(main())
