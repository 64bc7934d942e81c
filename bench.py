"""Headline queries, timed end to end. Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from savanto.session import discard, local_session
from savanto.suite import load

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
HEADLINE = [
    "upsert_latest",
    "top_k_sort",
    "top_answerers",
    "user_tag_stats",
    "related_items",
    "paginate",
    "extract_links",
    "fuzzy_match",
    "combine_topics",
    "jaccard_pairs",
    "avg_jaccard",
    "expand_members",
    "cover_density",
    "tokenize",
    "remove_stopwords",
    "topic_vector",
    "inverted_index",
    "rank_users",
    "search_experts",
    "search_batch",
    "hits",
    "pagerank",
    "stream_leaderboard",
]


def main(names: list[str]) -> None:
    spark = local_session("bench", CPUS, "16g")
    cases = load()
    spark.read.parquet(f"{FOLDER}/lineitem.parquet").count()  # start the executors
    times = {}
    for name in names or HEADLINE:
        start = time.perf_counter()
        cases[name].run(spark, FOLDER).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        discard(spark)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline queries, total seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
                "cpus": CPUS,
            }
        )
    )


if __name__ == "__main__":
    main(sys.argv[1:])
