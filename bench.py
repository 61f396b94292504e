"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (names,
comma separated, or `all`). Each query is run once to warm up and timed on the second run,
all rows written to Spark's no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "src01_event_log",
    "flt01_event_filter",
    "flt05_program_filter",
    "det03_rename_pairs",
    "det09_network_logon_without_interactive",
    "det10_record_gaps",
    "det13_existed_ran_deleted",
    "tml01_supertimeline",
    "tml03_correlate_anchors",
    "sch01_literal_search",
    "sch02_regex_search",
    "sch03_multi_pattern",
    "sch03_pattern_table",
    "sch01_chunked_search",
    "sch05_answer_variants",
    "rcp02_data_fingerprint",
    "rcp05_link_chain",
    "rcp06_verify_chain",
    "rcp08_replay_drift",
    "rcp08_replay_event_log",
    "clm03_match_predicate",
    "clm05_verify_batch",
    "clm05_full_order",
    "ben05_score_attempt",
    "ben05_question_to_score",
    "ben07_breakdowns",
    "ben14_extract_pattern",
)


def main() -> None:
    from attestlake.plans import catalog
    from attestlake.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "attestlake-bench",
        master=f"local[{cpus}]",
        spark__ui__enabled="false",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
        spark__log__level="ERROR",
    )
    queries = catalog.queries()
    chosen = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE))
    names = list(queries) if chosen == "all" else chosen.split(",")
    seconds = {}
    for name in names:
        for _ in range(2):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
