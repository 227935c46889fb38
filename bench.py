"""Time the jobs of the catalogue and print one JSON line.

BENCH_SF_DIR names the folder of tables, BENCH_CPUS the local cores. ``build_*`` entries write the
shared tables from nothing; the others run a registered query on them, with all rows computed and
none kept.
"""

from __future__ import annotations

import json
import os
import time

from foretoken.plans.queries import QUERIES, pipeline
from foretoken.session import build_session

QUERY_NAMES = [
    "token_counts",
    "vocabulary",
    "encoded_documents",
    "pack_wrap",
    "pack_nowrap",
    "decoded_documents",
    "decode_samples",
    "ngram_partials",
    "bigrams",
    "trigrams",
    "fourgrams",
    "bigram_prefixes",
    "trigram_prefixes",
    "top_bigrams",
    "top_trigrams",
    "top_trigrams_scored",
    "prefix_rank_in_chunk",
    "fourgram_prefix_rank_in_chunk",
    "score_bigrams_by_slice",
    "score_trigrams_by_slice",
    "scan_windows",
    "next_token_dist",
    "scan_metrics",
    "scan_examples",
    "scan_filter",
    "scan_top",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            # Let small tables be written by all cores.
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m",
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}

    def timed(name, run):
        start = time.perf_counter()
        run()
        seconds[name] = round(time.perf_counter() - start, 3)

    # Start the JVM's and Python's workers on a corpus that no timed job reads.
    warm = pipeline(spark, sf_dir, "conversations")
    for start in (warm.samples, lambda: warm.top(2), lambda: warm.top(3), warm.scan_filter):
        start().count()

    tables = pipeline(spark, sf_dir)
    timed("build_tokens", tables.tokens)
    timed("build_encoded", tables.encoded)
    timed("build_samples", tables.samples)
    timed("build_bigrams", lambda: tables.ngrams(2))
    timed("build_trigrams", lambda: tables.ngrams(3))
    timed("build_bigram_prefixes", lambda: tables.prefixes(2))
    timed("build_trigram_prefixes", lambda: tables.prefixes(3))
    timed("build_top_bigrams", lambda: tables.top(2))
    timed("build_top_trigrams", lambda: tables.top(3))
    timed("build_scan_hits", tables.scan_hits)
    for name in QUERY_NAMES:
        timed(
            name,
            lambda: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save(),
        )
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
