"""Physical plan trees (the top of explain('formatted')) of the headline
queries, as markdown.  usage: python tools/explain_plans.py SF_DIR > docs/PLANS_tree.md"""

from __future__ import annotations

import contextlib
import io
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import HEADLINE  # noqa: E402
from callrank.plans import catalog  # noqa: E402
from callrank.session import build_session  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session("local[8]", shuffle_partitions=16)
    spark.sparkContext.setLogLevel("ERROR")
    for name in HEADLINE:
        df = catalog.QUERIES[name](spark, sf)
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain("formatted")
        text = buf.getvalue()
        tree = text.split("\n\n\n")[0]
        scans = [ln for ln in text.splitlines() if ln.startswith(("ReadSchema", "PushedFilters"))]
        print(f"### {name}\n\n```\n{tree.strip()}\n```\n")
        if scans:
            print("Scans: " + "; ".join(f"`{s}`" for s in scans) + "\n")
    spark.stop()


if __name__ == "__main__":
    main()
