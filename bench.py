"""Times the headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma
separated names, or "all"), BENCH_RUNS (default 1; the best run counts, after a warm-up of the session).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "text_profile", "script_language", "clean_corpus", "clean_report", "dedup_lines", "lines_changed", "keyword_search_documents", "phrase_search", "merge_ranges", "find_replace", "agreement", "similar_passages",
    "reconciled_readings", "upper_median_prices", "otsu_split_prices", "mad_outliers", "snap", "select_pages", "number_documents", "engine_lines", "ocr_stats", "overlap_pairs", "assign_regions", "visual_lines",
    "paragraphs", "build_table", "pdf_lines", "find_boxes", "claim_words", "scored_detections", "preset_fit", "rate_windows", "job_states", "stage_durations", "page_scorecard",
)


def main() -> None:
    from quire import catalog
    from quire.session import build_session

    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    queries = catalog.queries()
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(queries) if chosen == "all" else [n for n in chosen.split(",") if n] or list(HEADLINE)
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.log.level": "ERROR"})
    # Loads classes, compiles the common stages and starts the Python workers; not timed.
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    for name in ("text_profile", "visual_lines", "upper_median"):
        queries[name](spark, small if os.path.isdir(small) else sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(f"{name} {best:.2f}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline queries, total of best runs", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
