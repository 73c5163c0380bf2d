"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time
from statistics import median

from pyspark.sql import SparkSession

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "4")
REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))
HEADLINES = ["map_exact_k0", "map_k1", "map_k3", "kmer_stride_index", "kmer_counts", "anchor_clusters", "exact_occurrences", "seq_global_stats", "baseline_agreement", "run_pair_agreement", "output_validation", "position_to_contig", "events_sessions"]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from strandmill import queries

    took: dict[str, float] = {}
    for name in HEADLINES:
        runs = []
        for k in range(REPEATS + 1):  # the first warms up
            began = time.perf_counter()
            queries.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            if k:
                runs.append(time.perf_counter() - began)
        took[name] = round(median(runs), 3)
    # mapping alone, over an index that is built once and opened again
    from strandmill.operators import index
    from strandmill.plans import mapper

    path = tempfile.mkdtemp(prefix="bench-")
    try:
        began = time.perf_counter()
        index.build_index(queries.contigs(spark, SF_DIR), path)
        took["index_build"] = round(time.perf_counter() - began, 3)
        reads = queries.reads(spark, SF_DIR)
        n_reads = reads.count()
        runs = []
        for k in range(REPEATS + 1):
            began = time.perf_counter()
            chunks, kmers, _, _ = index.open_index(spark, path, 16, 4)
            mapper.map_reads(reads, chunks, kmers, 1).write.format("noop").mode("overwrite").save()
            if k:
                runs.append(time.perf_counter() - began)
        took["map_k1_opened"] = round(median(runs), 3)
    finally:
        shutil.rmtree(path, ignore_errors=True)
    print(json.dumps({"metric": "headline queries, median of warm runs", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF_DIR.rsplit("sf", 1)[-1], "reads": n_reads, "reads_per_s_k1": round(n_reads / took["map_k1_opened"], 1), "reads_per_s_k1_with_build": round(n_reads / took["map_k1"], 1)}))
    spark.stop()


if __name__ == "__main__":
    main()
