"""Print the formatted physical plan of registered queries.

    python scripts/show_plans.py [sf_dir] name [name ...]

Queries that run multi-step jobs (near dedup, numbering) execute their
earlier steps while building the final DataFrame; the printed plan is the
last step.
"""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corpusforge.plans.queries import QUERIES  # noqa: E402
from corpusforge.session import build_session  # noqa: E402


def main():
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = build_session()
    for name in args or ["model_summary"]:
        print(f"===== {name}")
        QUERIES[name](spark, sf).explain("formatted")


if __name__ == "__main__":
    main()
