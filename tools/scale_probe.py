"""Scaling probe: time headline batch queries on the sf folder and on an
events table Spark derives from it by replicating it ``K`` times (each copy
shifted by 30 days, fresh ids), so windows, weather and work all grow.

usage: python tools/scale_probe.py [sf_dir] [K] [scratch_dir]
"""

from __future__ import annotations

import os
import shutil
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from eventclime import build_session  # noqa: E402
from eventclime.plans import batch_queries as B  # noqa: E402

QUERIES = ["instability_index", "attention_share", "nearest_station", "avg_tone_by_temp"]


def derive(spark, sf_dir: str, k: int, out: str) -> str:
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = ev.agg(F.max("event_id") + 1).first()[0]
    rep = ev.select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("copy")).select(
        (F.col("event_id") + F.col("copy") * F.lit(n)).alias("event_id"),
        (F.col("ts") + F.make_dt_interval(F.col("copy") * 30)).alias("ts"),
        "user_id", "event_type", "value", "props",
    )
    rep.write.mode("overwrite").parquet(f"{out}/events.parquet")
    for t in ("supplier",):   # the other input is used as is
        os.makedirs(out, exist_ok=True)
        src = f"{sf_dir}/{t}.parquet"
        shutil.copyfile(src, f"{out}/{t}.parquet") if os.path.isfile(src) else None
    return out


def timed(spark, sf_dir, name) -> float:
    fn = B.QUERIES[name]
    fn(spark, sf_dir).write.format("noop").mode("overwrite").save()   # warm
    t = time.perf_counter()
    fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    k = int(sys.argv[2]) if len(sys.argv) > 2 else 20
    scratch = sys.argv[3] if len(sys.argv) > 3 else tempfile.mkdtemp(prefix="eventclime-scale-")
    spark = build_session()
    big = derive(spark, sf, k, scratch)
    n1 = spark.read.parquet(f"{sf}/events.parquet").count()
    nk = spark.read.parquet(f"{big}/events.parquet").count()
    print(f"events: {n1} -> {nk}")
    for q in QUERIES:
        a, b = timed(spark, sf, q), timed(spark, big, q)
        print(f"{q:22s} 1x {a:6.2f}s   {k}x {b:6.2f}s   ratio {b / a:5.2f}")
    spark.stop()


if __name__ == "__main__":
    main()
