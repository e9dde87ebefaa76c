"""Command line: catalog validate, compatibility and audit. Exit 0 if the report passed."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from grainline import verify
from grainline.catalog import load
from grainline.errors import CatalogError


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("grainline").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def main(argv: Sequence[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="grainline")
    areas = parser.add_subparsers(dest="area", required=True)
    catalog = areas.add_parser("catalog").add_subparsers(dest="command", required=True)
    for name in ("validate", "compatibility", "audit"):
        catalog.add_parser(name).add_argument("catalog")
    args = parser.parse_args(argv)
    try:
        layer = load(args.catalog)
    except CatalogError as error:
        print(json.dumps({"passed": False, "issues": [vars(i) for i in error.issues]}, sort_keys=True))
        return 1
    except OSError:
        print(json.dumps({"error": "the catalog can't be read"}))
        return 1
    report = {"validate": lambda: verify.static(layer), "compatibility": lambda: verify.compatibility(layer), "audit": lambda: verify.physical(layer, _session())}[args.command]()
    print(report.to_json())
    return int(not report.passed)


if __name__ == "__main__":
    sys.exit(main())
