"""``python -m brindle --root DIR [--search-dir DIR]... [--no-cache] [--diagnostics]``: requests on stdin, responses on stdout, log on stderr."""

from __future__ import annotations

import argparse
import logging
import os
import sys

from brindle.model import QUERY_TIMEOUT


class Parser(argparse.ArgumentParser):
    """Ends with 1 on a wrong command line."""

    def error(self, message: str):
        self.print_usage(sys.stderr)
        self.exit(1, f"{self.prog}: {message}\n")


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = Parser(prog="brindle", allow_abbrev=False)
    p.add_argument("--root", required=True)
    p.add_argument("--search-dir", action="append", default=[], dest="dirs")
    p.add_argument("--no-cache", action="store_false", dest="cache")
    p.add_argument("--diagnostics", action="store_true")
    p.add_argument("--ignore-file", default=".declarations-ignore")
    p.add_argument("--rows-key", default="declarations", help="name of the result list and of the count in responses")
    p.add_argument("--query-timeout", type=float, default=QUERY_TIMEOUT, help="seconds; 0 for none")
    p.add_argument("--strict-compat", action="store_true", help="read every \\uXXXX in a request as ?")
    return p.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    a = arguments(argv)
    logging.basicConfig(stream=sys.stderr, level=logging.INFO)
    if not os.path.isdir(a.root):
        logging.error("no folder %s", a.root)
        return 1
    from pyspark.sql import SparkSession

    from brindle.streaming.service import Index, serve, status

    spark = SparkSession.builder.appName("brindle").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    index = Index(spark, a.root, a.dirs, a.cache, ignore_name=a.ignore_file, rows_key=a.rows_key, query_timeout=a.query_timeout or None, strict_compat=a.strict_compat)
    index.start()
    index.search("a", 1)  # so that the first query of a client finds its code compiled
    if a.diagnostics:
        for r in index.slowest():
            logging.info("%s %.3f s", r["path"], r["seconds"])
    print(status(index, 0), flush=True)
    sys.stdin.reconfigure(errors="replace")  # bytes that are no UTF-8 are a line like any other
    for response in serve(index, sys.stdin):
        print(response, flush=True)
    return 0


if __name__ == "__main__":
    sys.exit(main())
