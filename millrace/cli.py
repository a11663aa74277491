"""Command line: python -m millrace [-e SQL | -f FILE] [-i FILE] [--hiveconf K=V] [-S] [-v] [--recover] [--hive]."""

from __future__ import annotations

import argparse
import os
import subprocess
import sys
import time

from millrace.plans import render
from millrace.plans.dialect import statements
from millrace.plans.session import QueryExecutionError, Warehouse, build_session


def _script(w: Warehouse, path: str) -> str:
    """A script's text, from the local file system or any store that Spark reads."""
    if "://" in path:
        return "\n".join(r.value for r in w.spark.read.text(path).toLocalIterator())
    with open(path) as f:
        return f.read()


def run(w: Warehouse, text: str, silent: bool = False, verbose: bool = False, header: bool = False, out=sys.stdout, err=sys.stderr) -> int:
    """Run statements, ! shell commands and source FILE; stops at the first failure. 0: all went well."""
    for s in statements(text):
        if verbose:
            print(s, file=out)
        began = time.time()
        if s.startswith("!"):
            code = subprocess.run(s[1:], shell=True, stdout=out if out is not sys.stdout else None).returncode
            if code:
                return code
            continue
        if s.lower().startswith("source "):
            if code := run(w, _script(w, s.split(None, 1)[1].strip("'\"")), silent, verbose, header, out, err):
                return code
            continue
        if s.lower() in ("quit", "exit"):
            return 0
        try:
            df = w.sql_to_df(s)
            if header and df.columns != ["result"]:
                print("\t".join(df.columns), file=out)
            for r in w.rows(df):  # a partition at a time
                print(render.line(r), file=out)
        except (QueryExecutionError, OSError) as e:
            print(f"FAILED: {e}", file=err)
            return 1
        if not silent:
            print(f"Time taken: {time.time() - began:.3f} seconds", file=err)
    return 0




def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="millrace")
    p.add_argument("-e", action="append", default=[], metavar="SQL")
    p.add_argument("-f", metavar="FILE")
    p.add_argument("-i", action="append", default=[], metavar="FILE", help="run first")
    p.add_argument("-S", "--silent", action="store_true")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("--header", action="store_true")
    p.add_argument("--hive", action="store_true", help="with a metastore and SerDe formats")
    p.add_argument("--hiveconf", "--define", "-d", action="append", default=[], metavar="K=V")
    p.add_argument("--recover", action="store_true", help="hold cached tables again")
    p.add_argument("--master", default=os.environ.get("MASTER"))
    a = p.parse_args(argv)
    w = Warehouse(build_session(master=a.master, hive=a.hive), variables=dict(x.split("=", 1) for x in a.hiveconf))
    if a.recover:
        w.cached.recover()
    for f in a.i:
        if code := run(w, _script(w, f), True):
            return code
    if a.e or a.f:
        return run(w, ";\n".join(a.e) if a.e else _script(w, a.f), a.silent, a.verbose, a.header)
    pending = ""
    while True:
        try:
            pending += input("millrace> " if not pending else "        > ") + "\n"
        except EOFError:
            return 0
        if pending.rstrip().endswith(";"):
            if pending.strip().lower() in ("quit;", "exit;"):
                return 0
            run(w, pending, a.silent, a.verbose, a.header)
            pending = ""
