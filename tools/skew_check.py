"""Time a per-key running sum with one key holding a third of all rows:
plain window (one task gets the hot key) vs the chunked keyed scan.

Usage: python tools/skew_check.py [sf_dir] [chunk_rows] [copies]
``copies`` repeats lineitem that many times (derived by explode) to make
the hot key larger than one task should carry.
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from linetrail.plans.scan import keyed_scan  # noqa: E402
from linetrail.session import get_spark  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    chunk_rows = int(sys.argv[2]) if len(sys.argv) > 2 else 20000
    copies = int(sys.argv[3]) if len(sys.argv) > 3 else 1
    spark = get_spark("local[8]", shuffle_partitions=16, extra={"spark.driver.memory": "16g"})
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    if copies > 1:
        li = (li.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
              .withColumn("l_orderkey", F.col("l_orderkey") * copies + F.col("_copy")))
    df = li.select(F.when(F.col("l_orderkey") % 3 == 0, F.lit("hot"))
                   .otherwise(F.concat(F.lit("k"), F.col("l_partkey").cast("string"))).alias("k"),
                   (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"),
                   F.col("l_quantity").cast("bigint").alias("v"))
    res = {}
    for label, kw in (("plain", dict(chunk_rows=10 ** 12)), ("chunked", dict(chunk_rows=chunk_rows))):
        out = keyed_scan(df, ["k"], ["o"], number="rn", running_sum=("v", "cum"), **kw)
        for _ in range(2):
            t0 = time.time()
            row = out.agg(F.sum("rn"), F.sum("cum"), F.max("rn")).first()
            res[label] = (round(time.time() - t0, 2), tuple(row))
        print(label, res[label], flush=True)
    assert res["plain"][1] == res["chunked"][1]
    print("same results")


if __name__ == "__main__":
    main()
