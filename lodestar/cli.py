"""python -m lodestar.cli --path FOLDER COMMAND [ARGUMENT ..]: one command against a database folder."""

from __future__ import annotations

import argparse
import sys

from lodestar.functions.resp import Failure, shown


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--path", required=True)
    parser.add_argument("command", nargs=argparse.REMAINDER)
    given = parser.parse_args(argv)
    if not given.command:
        parser.print_usage()
        return 1
    from pyspark.sql import SparkSession

    from lodestar.plans.commands import Commands
    from lodestar.plans.engine import Engine

    reply = Commands(Engine(SparkSession.builder.getOrCreate(), given.path)).execute(given.command)
    print(shown(reply))
    return int(isinstance(reply, Failure))


if __name__ == "__main__":
    sys.exit(main())
