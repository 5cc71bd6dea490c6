"""Times the headline queries: one JSON line on standard output."""

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from kmerweave import build_session  # noqa: E402
from kmerweave.plans.catalogue import QUERIES  # noqa: E402

HEADLINE = ["kmer_spectrum", "seed_pairs", "seed_self_compare", "score_seeds", "best_overlap_band", "overlap_all_pairs",
            "similar_segments", "multi_segments", "aln_score_global", "genotype_reads", "sv_chain_paths", "annotate_elements",
            "fasta_roundtrip"]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    memory = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") // 2 ** 20
    scratch = tempfile.TemporaryDirectory(prefix="bench-")
    spark = build_session("bench", master=f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": str(2 * int(cpus)), "spark.driver.memory": f"{min(20_000, memory // 2)}m",
        "spark.checkpoint.dir": scratch.name,
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    QUERIES["seed_pairs"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    took = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
        print(f"{name}: {took[name]}s", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total wall time of headline queries", "value": round(sum(took.values()), 3),
                      "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
