"""python -m semspark.cli index|visit|subdomain: thin commands over the library."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from semspark.operators import calculus, topology
from semspark.sources import fld, index


def pairs(text: str) -> tuple[float, float]:
    lo, hi = (float(x) for x in text.split(","))
    return lo, hi


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="semspark")
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("index", help="index the field files of a folder by type")
    i.add_argument("folder")
    i.add_argument("out")
    i.add_argument("--run-start", type=float, default=0.0)
    i.add_argument("--stat-start", type=float, default=0.0)
    v = sub.add_parser("visit", help="write the file that viewers open")
    v.add_argument("folder")
    v.add_argument("case")
    s = sub.add_parser("subdomain", help="write the elements within a box")
    s.add_argument("file")
    s.add_argument("out")
    s.add_argument("--case", default="sub")
    s.add_argument("--fields")
    s.add_argument("--order", type=int)
    for a in "xyz":
        s.add_argument(f"--{a}", type=pairs, help="lo,hi")
    o = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    if o.command == "index":
        rows = index.from_headers(fld.headers(spark, f"{o.folder}/*0.f*"), o.run_start, o.stat_start)
        for r in rows.select("file_type", "start_time").distinct().collect():
            index.write_json(rows.where(rows.file_type == r["file_type"]), f"{o.out}/{r['file_type'].removesuffix('.fld')}_index", r["start_time"])
    elif o.command == "visit":
        rows = index.from_headers(fld.headers(spark, f"{o.folder}/{o.case}0.f*"))
        with open(f"{o.folder}/{o.case}.nek5000", "w") as f:
            f.write(fld.visit_file(rows, o.case))
    else:
        names = [c.strip() for c in o.fields.split(",")] if o.fields else None
        df = fld.read(spark, o.file, None if names is None else ["x", "y", "z", *names])
        box = {a: getattr(o, a) for a in "xyz" if getattr(o, a)}
        df = topology.subdomain(df, box)
        head = fld.read_header(o.file)
        if o.order:
            df = calculus.p_refine(df, [c for b in head.blocks().values() for c in b if c in df.columns], o.order)
        fld.write(df.drop("path", "time", "step"), o.out, o.case, 0, head.time, head.step, head.word)


if __name__ == "__main__":
    main()
