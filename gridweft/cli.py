"""Command line: types, get, diff, browse and convert over RDF/XML or ZIP files."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from gridweft.operators import diff as D
from gridweft.operators.access import Grid
from gridweft.operators.browse import CRUMB, paths, screen
from gridweft.plans.convert import Conversion
from gridweft.session import local_session
from gridweft.sources import rdfxml, sinks, splits
from gridweft.sources.ordered_text import join_parts
from gridweft.storage import bucketed, delete, new_path, stored


def _path(text: str) -> str:
    if not text.lower().endswith((".xml", ".zip")):
        raise argparse.ArgumentTypeError(f"{text} is neither .xml nor .zip")
    return text


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="gridweft")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("types", "get", "diff", "browse", "convert"):
        one = commands.add_parser(name)
        one.add_argument("path", type=_path)
        one.add_argument("--eqbd")
        if name == "diff":
            one.add_argument("other", type=_path)
            one.add_argument("--summary", action="store_true")
        if name in ("get", "diff", "browse"):
            one.add_argument("--mrid")
        if name in ("get", "diff"):
            one.add_argument("--type")
        if name == "get":
            one.add_argument("--fields")
            one.add_argument("--count", action="store_true")
        if name == "browse":
            one.add_argument("--hops", type=int, help="list what is within so many references, with the path to it; without, browse")
        if name == "convert":
            one.add_argument("--output")
        one.add_argument("--json", action="store_true")
    return top


def load(spark, path: str, boundary: str | None, name: str = "model") -> Grid:
    closed = stored(rdfxml.closed(splits.read_tags(spark, {name: path}, boundary)), "tags")
    objects = bucketed(rdfxml.objects(closed), "objects", "model", "doc_pos")
    return Grid(objects, stored(rdfxml.triples(closed, objects), "triples", by="pred"))


def _browse(grid: Grid, object_id: str, ask=input) -> int:
    """Show an object, then the one that an answer picks, or the one before, until ``q`` or the end of the answers."""
    trail = [object_id]
    while True:
        lines = screen(grid, trail[-1])
        if lines is None:
            print(f"{trail[-1]}: not_found", file=sys.stderr)
            return 1
        refs = [line.rpartition(": ")[2].removeprefix("#") for line in lines if line[3] != " "]
        crumb = CRUMB.join(r["type"] for one in trail for r in grid.by_id.where(F.col("id") == one).select("type").collect())
        print("\n".join([*lines, "", crumb, " ".join(f"[{n + 1}]" for n in range(len(refs))) + "  [b]ack" * (len(trail) > 1) + "  [q]uit"]))
        try:
            answer = ask().strip()
        except EOFError:
            return 0
        if answer[:1] == "q":
            return 0
        if answer[:1] == "b":
            if len(trail) > 1:
                trail.pop()
            else:
                print("Already at root")
        elif answer.isdigit() and 0 < int(answer) <= len(refs):
            trail.append(refs[int(answer) - 1])
        elif answer:
            print(f"Pick 1-{len(refs)}" if refs else "No references")


def main(argv: list[str] | None = None, spark=None) -> int:
    """Exit codes: 0, or 1 for a difference or an id that isn't there, or 2 for misuse."""
    args = parser().parse_args(argv)
    spark = spark or local_session("gridweft")
    grid = load(spark, args.path, args.eqbd)
    show = lambda rows, column: [print(r[column]) for r in rows.collect()]
    if args.command == "types":
        if args.json:
            show(sinks.types_json(grid), "json")
        else:
            for r in grid.types_report().orderBy(F.col("type").asc_nulls_last()).collect():
                print(f"{r['type'] or 'total'}  {r['n']}")
    elif args.command == "get":
        if args.mrid:
            status = grid.get_single(args.mrid, args.type).first()
            if status["status"] != "found":
                print(f"{args.mrid}: {status['status']} {status['type'] or ''}", file=sys.stderr)
                return 1
            show(sinks.object_json(grid).where(F.col("id") == args.mrid) if args.json else sinks.object_text(grid, args.mrid), "json" if args.json else "line")
        elif not args.type:
            print("an id or --type is needed", file=sys.stderr)
            return 2
        elif args.count:
            show(grid.get_count(args.type), "n")
        elif args.json:
            show(sinks.list_json(grid, args.type, args.fields), "json")
        else:
            for r in grid.get_list(args.type, args.fields).orderBy("doc_pos").collect():
                print("  ".join([r["id"], *r[4:]]))
    elif args.command == "diff":
        other = load(spark, args.other, args.eqbd)
        if args.mrid:
            row = D.diff_single(grid, other, args.mrid, args.type).first()
            if row is None or row["status"] == "not_found":
                print(f"No object found with mRID '{args.mrid}' in either file", file=sys.stderr)
                return 1
            if row["status"] == "type_mismatch":
                print(f"eq diff: object '{args.mrid}' is of type '{row['type']}', not '{args.type}'", file=sys.stderr)
                return 2
            if args.summary:
                show(D.diff_summary_text(*D.single(grid, other, args.mrid)), "line")
            elif args.json:
                show(D.diff_ndjson(*D.single(grid, other, args.mrid)), "line")
            else:
                show(D.single_text(grid, other, args.mrid, args.path, args.other).orderBy("sort_id"), "line")
            return int(row["status"] != "same")
        types = [args.type] if args.type else None
        if args.summary:
            show(D.diff_summary_text(grid, other, types).orderBy("type"), "line")
        elif args.json:
            show(D.diff_ndjson(grid, other, types).orderBy("type", "id"), "line")
        else:
            show(D.diff_text(grid, other, args.path, args.other, types).orderBy("sort_type", "sort_id"), "line")
        return int(D.had_diffs(grid, other, types))
    elif args.command == "browse":
        if args.hops is not None:
            for r in paths(grid, F.col("id") == args.mrid, args.hops).orderBy("distance", "id").toLocalIterator():
                print(f"{r['distance']}  {r['crumb']}  {r['id']}")
        else:
            return _browse(grid, args.mrid)
    else:
        conversion = Conversion(grid)
        for r in conversion.totals().orderBy("nth").collect():
            print(f"{r['metric']}: {r['n']}")
        network = sinks.NetworkJson(conversion)
        if args.output:
            folder = new_path(spark, "network")
            network.write(folder)
            join_parts(spark, f"{folder}/model=model", args.output, "\n")
            delete(spark, folder)
        else:
            for r in network.fragments().orderBy("section", "rank", "doc_pos").toLocalIterator():
                sys.stdout.write(r["value"] + sinks.END)
            sys.stdout.write("\n")
    return 0


if __name__ == "__main__":
    sys.exit(main())
