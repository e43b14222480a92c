"""Time the headline jobs at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every job does all of its work each time: nothing is cached between jobs, and staged
tables belong to the job that wrote them.  Each is run twice and the second, warm time
counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import functions as F

from edgetide import build_session
from edgetide.checks import views
from edgetide.operators import cleaning, counters, traffic
from edgetide.plans import evict, metrics, report, training
from edgetide.sources import access_logs
from edgetide.staging import new_path

AS_OF, LIMIT_MB = views.AS_OF, views.LIMIT_MB


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def jobs(spark, sf_dir: str) -> dict:
    """The raw logs are written once, ahead of the timing, as input of the parse jobs."""
    plain, extended = new_path(spark, "bench-plain"), new_path(spark, "bench-extended")
    views.plain_lines(spark, sf_dir).select("value").write.text(plain)
    views.extended_lines(spark, sf_dir).select("value").write.text(extended)

    def parse_log():
        run(access_logs.parse_plain(access_logs.read_lines(spark, plain)))

    def top_objects():
        parsed = access_logs.parse_plain(access_logs.read_lines(spark, plain))
        kept = cleaning.without_bots(cleaning.ok_only(parsed))
        run(kept.groupBy("file_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "file_id")
            .limit(20))

    def request_metrics():
        records = access_logs.split_request(
            access_logs.parse_extended(access_logs.read_lines(spark, extended)))
        for table in metrics.metric_tables(records).values():
            run(table)

    def duration_histogram():
        run(counters.duration_histogram(views.records(spark, sf_dir)))

    def label_build():
        wide = views.accesses(spark, sf_dir).withColumn(
            "file_id", F.concat(F.lit("u"), "user_id", F.lit("_"), "k"))
        run(training.training_table(wide, "event_id", capacity=1000))

    def eviction_plan():
        plan = evict.plan_lru(views.snapshot(spark, sf_dir), AS_OF, LIMIT_MB)
        run(plan.evicted)
        run(plan.survivors)
        run(plan.metrics)

    def learned_plan():
        run(evict.plan_lrb(views.predictions(spark, sf_dir), LIMIT_MB, AS_OF).evicted)

    def traffic_report():
        run(report.traffic_report(views.probes(spark, sf_dir)))

    def drawn_items():
        items = traffic.cumulative_probability(
            traffic.url_counts(views.probes(spark, sf_dir)).withColumn(
                "weight", F.col("requests").cast("double")), ["url"])
        draws = views.table(spark, sf_dir, "events").select(
            "event_id", traffic.uniform_draw(F.col("event_id")).alias("u"))
        run(traffic.draw_items(draws, items, "url"))

    return {f.__name__: f for f in (parse_log, top_objects, request_metrics, duration_histogram,
                                    label_build, eviction_plan, learned_plan, traffic_report,
                                    drawn_items)}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    spark = build_session("edgetide-bench", f"local[{cpus}]", int(cpus),
                          **{"spark.ui.enabled": "false", "spark.driver.memory": "8g",
                             "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name, job in jobs(spark, sf_dir).items():
        for _ in range(2):
            start = time.perf_counter()
            job()
            seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]} s", file=sys.stderr)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir)}))


if __name__ == "__main__":
    main()
