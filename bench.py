"""Times headline queries; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores, BENCH_QUERIES (optional, comma
separated, or "all") the queries.
"""

from __future__ import annotations

import json
import os
import time

from checks import QUERIES
from reviewlab.session import build_session

HEADLINES = [
    "usable_pairs_per_store", "pair_turns", "preprocess_reviews", "additional_masking", "mask_entities_token",
    "mask_urls_emails", "normalise_text", "tokenise", "truncate_sentence_words", "char_totals", "literal_profile",
    "substring_total", "describe_lengths", "describe_scores", "histogram", "nunique", "reply_ratio_suppliers",
    "reply_total_events", "preview_per_store", "store_index_parts", "assign_block", "tfidf_pair_cosine",
    "word_vector_cosine", "threshold_labels", "label_jaccard", "rouge_1", "rouge_2", "rouge_l", "rouge_w",
    "prediction_report", "emotion_report", "score_pairs", "select_training_set", "fleiss_kappa", "hard_vote",
    "build_vocab", "encode_tokens", "causal_example_rated", "split_by_hash", "split_exact", "top_k_nucleus_filter",
    "sample_candidate", "extract_page_blocks", "columnar_round_trip", "write_reviews_csv", "stream_reply_totals",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else HEADLINES
    spark = build_session("bench", cpus, shuffle_partitions=cpus)
    spark.sparkContext.setLogLevel("ERROR")
    # Start workers and read file footers before the clock runs.
    for table in ("conversations", "documents", "embeddings", "events", "lineitem", "pages"):
        spark.read.parquet(f"{folder}/{table}.parquet").limit(1).collect()
    # Compiled code, Python workers and streams are warmed up as well.
    for name in ("usable_pairs_per_store", "word_vector_cosine", "rouge_1", "stream_reply_totals"):
        QUERIES[name](spark, folder.replace("sf0.1", "sf0.01")).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": folder.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
