"""Times the headline queries on one machine and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from veriloom import catalog

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "jn_vector_pairs", "jn_context_retrieval", "agg_pair_accounts", "jn_lexical_pairs", "flags_planted", "prv_provenance", "win_depth_scores", "mrg_greedy_dedup", "grf_pagerank",
    "sentences", "txt_content_tokens", "txt_novel_tokens", "src_pdf_cleaning", "src_html_text", "sum_section_summaries", "per_markers", "agg_precision_recall",
    "res_resolutions", "res_one_sided", "jn_truth_matches", "per_supersession", "jn_conflict_notes", "srt_salient_rows", "mrg_context", "sum_model_inputs", "agg_retention", "seg_documents",
)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("veriloom-bench").config("spark.driver.memory", "12g").config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    queries = dict(catalog.QUERIES)
    chosen = {name: queries[name] for name in HEADLINE}
    try:
        from veriloom.llm import queries_index
    except ModuleNotFoundError as e:
        if e.name not in ("veriloom.llm", "veriloom.llm.queries_index"):
            raise
    else:
        chosen |= queries_index.QUERIES
    times = {}
    for name, run in chosen.items():
        began = time.time()
        run(spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
