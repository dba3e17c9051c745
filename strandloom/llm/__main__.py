"""Run a query of this subpackage over a folder of tables: python -m strandloom.llm NAME FOLDER [OUT]."""
from __future__ import annotations

import sys

from strandloom.llm.queries import QUERIES
from strandloom.session import get_spark


def main(args: list[str]) -> int:
    if len(args) not in (2, 3) or args[0] not in QUERIES:
        print(__doc__, "\n".join(sorted(QUERIES)), sep="\n")
        return 2
    df = QUERIES[args[0]](get_spark(), args[1])
    if len(args) > 2:
        df.write.mode("overwrite").parquet(args[2])
    else:
        df.show(50, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
