"""Command line: ``python -m gridloom.cli info|list|inspect|dump|decode FILE ...``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import frames
from .operators import relations as R
from .plans import reports
from .sources import sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gridloom")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("info").add_argument("file")
    c = sub.add_parser("list")
    c.add_argument("-d", "--dump", action="store_true")
    c.add_argument("file")
    c = sub.add_parser("inspect")
    for flag in ("sections", "submessages", "templates"):
        c.add_argument(f"-{'smt'[('sections', 'submessages', 'templates').index(flag)]}", f"--{flag}", action="store_true")
    c.add_argument("file")
    c = sub.add_parser("dump")
    c.add_argument("--no-color", action="store_true")
    c.add_argument("file")
    c.add_argument("index", nargs="?")
    c = sub.add_parser("decode")
    kind = c.add_mutually_exclusive_group()
    kind.add_argument("-b", "--big-endian", metavar="OUT")
    kind.add_argument("-l", "--little-endian", metavar="OUT")
    c.add_argument("file")
    c.add_argument("index")
    return p


def lines(rows: DataFrame, *order: str, column: str = "text"):
    """Rows one after the other, in order, without holding them all."""
    for r in rows.orderBy(*order).select(column).toLocalIterator():
        yield r[0]


def opened(spark: SparkSession, file: str) -> frames.Grib:
    g = frames.from_bytes(spark, sys.stdin.buffer.read()) if file == "-" else frames.read(spark, file)
    if not g.sections().limit(1).count():
        raise SystemExit("error: empty GRIB2 data")
    return g


def run(argv: list[str], spark: SparkSession, out=None) -> None:
    out = out or sys.stdout
    a = parser().parse_args(argv)
    g = opened(spark, a.file)
    key = R.KEYS
    if a.command == "info":
        out.writelines(lines(g.info(), *key))
    elif a.command == "list" and a.dump:
        out.writelines(f"{x}\n" for x in lines(g.describe(), *key))
    elif a.command == "list":
        out.writelines(f"{x}\n" for x in (reports.LIST_HEADER, *lines(g.list(), *key)))
    elif a.command == "inspect":
        wanted = [a.sections, a.submessages, a.templates]
        every = not any(wanted)
        sections, subs, templates = g.inspect()
        parts = (("Sections:", [], lines(sections, "path", "pos")), ("SubMessages:", [reports.SUBMESSAGE_HEADER], lines(subs, *key)), ("Templates:", [], lines(templates, "num", "template_num")))
        shown = [p for p, w in zip(parts, wanted, strict=True) if w or every]
        for i, (title, head, body) in enumerate(shown):
            out.write(("\n" if i else "") + (f"{title}\n" if len(shown) > 1 else ""))
            out.writelines(f"{x}\n" for x in (*head, *body))
    elif a.command == "dump":
        texts = lines(g.dump(a.index), *key, "line")
        out.writelines(f"{x if a.no_color else reports.colorized(x)}\n" for x in texts)
    else:
        if not R.at_index(g.submessages("none"), a.index).count():
            raise SystemExit(f"error: no such index: {a.index}")
        target = a.big_endian or a.little_endian
        if target:
            flat = sinks.flat_binary(F.col("values"), "big" if a.big_endian else "little")
            with open(target, "wb") as f:
                f.write(g.values(a.index).select(flat.alias("b")).first()[0])
        else:
            out.write(f"{reports.POINT_HEADER}\n")
            out.writelines(f"{x}\n" for x in lines(reports.point_lines(g.points(a.index, normalize=False)), *key, "pt"))


if __name__ == "__main__":
    run(sys.argv[1:], SparkSession.builder.appName("gridloom").getOrCreate())
