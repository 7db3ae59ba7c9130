"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line."""

import json
import os
import time

from larkspur import catalog
from larkspur.session import session

HEADLINE = ["J1", "J2", "AGG1", "AGG3", "AGG8", "AGG20", "Q11", "Q14", "Q22", "W4", "W7", "J3", "J5", "J15", "G2", "G3", "G6", "SRC6_table", "SRC13", "F2", "F7", "K3", "ST8", "EXT8_events"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    queries = catalog.queries()
    queries["Q2"](spark, sf).write.format("noop").mode("overwrite").save()
    out = {}
    for name in HEADLINE:
        began = time.time()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        out[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
