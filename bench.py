"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local threads.
``--compare`` also times the same constraint rules as one job per rule.
"""

import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession

from tablekeep.operators import checks as chk
from tablekeep.operators import rules as rul
from tablekeep.plans.queries import CONSTRAINTS, QUERIES
from tablekeep.plans.star_catalogue import catalogue

HEADLINE = [
    "dq_constraints",
    "dq_regex",
    "dq_examples",
    "dq_column_duplicates",
    "dq_row_duplicates",
    "dq_validate",
    "dq_summary",
    "profile_numeric",
    "profile_distinct",
    "profile_sample_hash",
    "profile_signature",
    "sim_scores",
    "sim_parents",
    "col_match",
    "version_chain",
    "desc_upsert",
    "class_history",
    "graph_edges",
    "access_counts",
    "push_report",
]


def session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(frame: DataFrame) -> None:
    """Compute every column of every row without moving them to the driver."""
    frame.write.format("noop").mode("overwrite").save()


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def one_job_per_rule(spark: SparkSession, sf_dir: str) -> None:
    """The plain way: a count, and per rule a check, an error count and examples."""
    orders = catalogue(spark, sf_dir, "dirty_orders")
    orders.count()
    for rule in rul.bind_rules(rul.parse_rules(CONSTRAINTS), orders.schema):
        status = chk.constraint_results(orders, [rule]).first().status
        if status == "failed":
            failing = orders.filter(chk.failure_condition(rule, orders.schema))
            failing.count()
            failing.select(rule.column).limit(5).collect()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session()
    run(QUERIES["dq_constraints"](spark, sf_dir))  # warm-up: class loading, not measured
    times = {name: timed(lambda n=name: run(QUERIES[n](spark, sf_dir))) for name in HEADLINE}
    if "--compare" in sys.argv:
        times["one_job_per_rule"] = timed(lambda: one_job_per_rule(spark, sf_dir))
        times["fused_rules"] = timed(lambda: run(QUERIES["dq_examples"](spark, sf_dir)))
    total = sum(times[name] for name in HEADLINE)
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(total, 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
