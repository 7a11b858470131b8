"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from plumbline.session import build_session  # noqa: E402
from plumbline.workload import tables  # noqa: E402
from plumbline.workload.catalog import ENTRIES  # noqa: E402

HEADLINE = [
    "text_chunk_rows", "order_table_chunks", "corpus_chunk_rows", "bm25_term_stats", "index_build", "vector_topk",
    "vector_topk_by_blocks", "bm25_topk", "hybrid_by_modality", "retrieve", "per_query_evaluation", "metric_breakdown",
    "ablation_grid", "answers", "chunk_upsert", "reindex_after_deletion", "history_at_each_turn", "newly_indexed",
    "answered_once_per_life", "rate_limits", "streamed_status",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session(os.environ.get("BENCH_CPUS", "8"), "bench", {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "4m"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    names = sys.argv[1:] or HEADLINE
    times = {}

    def timed(name, work):
        start = time.perf_counter()
        work()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)

    # what several searches read is built ahead, each in its own row, so that search times are those of searching
    timed("shared_index", lambda: tables.index(spark, sf_dir))
    timed("shared_judgements", lambda: tables.qrels(spark, sf_dir))
    for name in names:
        timed(name, lambda: ENTRIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save())
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
