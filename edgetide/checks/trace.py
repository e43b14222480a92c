"""Checks of positions, history features, look-ahead labels and exact LRU."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgetide.checks import query
from edgetide.checks.views import accesses
from edgetide.operators import cleaning, trace
from edgetide.operators.ordered import BLOCK

c = F.col
CAPACITY = 20
#: More blocks than a small table needs, so that the checks cross block borders.
BLOCKS = 6


def _clean(spark, d):
    rows = accesses(spark, d).select("event_id", "ts", "file_id", "file_type", "size", "status",
                                     "user_agent")
    return cleaning.clean_accesses(rows, "event_id")


def _positioned(spark, d, *columns):
    return trace.positioned(_clean(spark, d).select("event_id", "ts", "file_id", *columns),
                            "event_id", blocks=BLOCKS)


def r6(name):
    return F.round(c(name), 6).alias(name)


@query("trace_position_w1", "SELECT event_id, pos FROM trace")
def trace_position(spark, d):
    return _positioned(spark, d).select("event_id", "pos")


@query("sorted_trace_k1", """SELECT event_id, pos, lag(event_id) OVER (ORDER BY pos) AS before
    FROM trace""")
def sorted_trace(spark, d):
    """The trace sorted by time; each row also names the row before it, found by position."""
    rows = _positioned(spark, d)
    earlier = rows.select((c("pos") + 1).alias("pos"), c("event_id").alias("before"))
    return rows.join(earlier, "pos", "left").select("event_id", "pos", "before")


@query("running_count_w2", "SELECT event_id, seq AS access_count FROM trace")
def running_count(spark, d):
    return trace.history(_positioned(spark, d)).select("event_id", "access_count")


@query("time_since_previous_w3", """SELECT event_id,
    round(coalesce((epoch_us(ts) - epoch_us(prev_ts)) / 1e6, 0), 6) AS age_since_last_access,
    round(coalesce((epoch_us(ts) - epoch_us(prev_ts)) / 1e6, 0) / 3600, 6) AS age_hours FROM trace""")
def time_since_previous(spark, d):
    return trace.history(_positioned(spark, d)).select(
        "event_id", r6("age_since_last_access"), r6("age_hours"))


@query("rate_and_recency_w4", """
    SELECT event_id, round(CASE WHEN h > 0 THEN seq / h ELSE seq END, 6) AS access_rate,
      round(1 / (1 + h), 6) AS recency_score FROM (SELECT event_id, seq,
        coalesce((epoch_us(ts) - epoch_us(prev_ts)) / 1e6, 0) / 3600 AS h FROM trace)""")
def rate_and_recency(spark, d):
    return trace.history(_positioned(spark, d)).select(
        "event_id", r6("access_rate"), r6("recency_score"))


_NEXT = ", ".join(f"lead(pos, {i}) OVER w - pos AS d{i}" for i in range(1, 6))
_AHEAD = f"""WITH ahead AS (SELECT event_id, {_NEXT} FROM trace
    WINDOW w AS (PARTITION BY file_id ORDER BY pos))"""


@query("next_distance_w5", _AHEAD + "SELECT event_id, coalesce(d1, 300) AS next_access_distance FROM ahead")
def next_distance(spark, d):
    return trace.look_ahead(_positioned(spark, d)).select("event_id", "next_access_distance")


@query("reuse_probability_w6", _AHEAD + "SELECT event_id, round(least(1.0::DOUBLE, " + " + ".join(
    f"CASE WHEN d{i} <= 100 THEN 1.0::DOUBLE / d{i} ELSE 0 END" for i in range(1, 6)) + """), 6)
    AS future_reuse_prob FROM ahead""")
def reuse_probability(spark, d):
    return trace.look_ahead(_positioned(spark, d)).select("event_id", r6("future_reuse_prob"))


@query("accessed_within_w7", _AHEAD + """SELECT event_id,
    CAST(CASE WHEN d1 <= 100 THEN 1 ELSE 0 END AS INTEGER) AS will_be_accessed_in_n FROM ahead""")
def accessed_within(spark, d):
    return trace.look_ahead(_positioned(spark, d)).select("event_id", "will_be_accessed_in_n")


# the count of distinct others since the previous access, quadratic in the gap
LRU_SQL = f"""
    WITH p AS (SELECT event_id, file_id, pos, lag(pos) OVER (PARTITION BY file_id ORDER BY pos) AS prev
      FROM trace),
    seen AS (SELECT *, count(*) FILTER (prev IS NULL) OVER (ORDER BY pos ROWS BETWEEN
      UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM p),
    others AS (SELECT i.pos, count(*) AS d FROM p i JOIN p j ON j.pos > i.prev AND j.pos < i.pos
      AND (j.prev IS NULL OR j.prev < i.prev) GROUP BY i.pos),
    state AS (SELECT event_id, least(seen, {CAPACITY}) AS occupied,
      CASE WHEN prev IS NOT NULL THEN coalesce(d, 0) END AS d FROM seen LEFT JOIN others USING (pos)),
    lru AS (SELECT event_id, CAST(coalesce(d < {CAPACITY}, false) AS INTEGER) AS hit, CASE WHEN d < {CAPACITY}
      THEN occupied - d ELSE occupied + 1 END AS stack_distance_approx FROM state)
"""


@query("lru_hits_w8", LRU_SQL + "SELECT event_id, hit FROM lru")
def lru_hits(spark, d):
    return trace.with_lru(_positioned(spark, d), CAPACITY).select("event_id", "hit")


@query("lru_stack_position_w9", LRU_SQL + "SELECT event_id, stack_distance_approx FROM lru")
def lru_stack_position(spark, d):
    return trace.with_lru(_positioned(spark, d), CAPACITY).select(
        "event_id", "stack_distance_approx")


@query("lru_per_region_w8_w9", f"""
    WITH p AS (SELECT event_id, cdn_region, file_id, row_number() OVER w AS pos FROM accesses
      WINDOW w AS (PARTITION BY cdn_region ORDER BY ts, event_id)),
    q AS (SELECT *, lag(pos) OVER (PARTITION BY cdn_region, file_id ORDER BY pos) AS prev FROM p),
    seen AS (SELECT *, count(*) FILTER (prev IS NULL) OVER (PARTITION BY cdn_region ORDER BY pos ROWS BETWEEN
      UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM q),
    others AS (SELECT i.cdn_region, i.pos, count(*) AS d FROM q i JOIN q j ON i.cdn_region = j.cdn_region
      AND j.pos > i.prev AND j.pos < i.pos AND (j.prev IS NULL OR j.prev < i.prev) GROUP BY ALL),
    d AS (SELECT seen.*, CASE WHEN prev IS NOT NULL THEN coalesce(d, 0) END AS d FROM seen
      LEFT JOIN others USING (cdn_region, pos))
    SELECT event_id, d AS distance, """ + ", ".join(f"""CAST(coalesce(d < {n}, false) AS INTEGER) AS hit_{n},
      least(seen, {n}) + CASE WHEN d < {n} THEN -d ELSE 1 END AS stack_{n}""" for n in (5, CAPACITY, 60)) + " FROM d")
def lru_per_region(spark, d):
    """One cache per edge, three capacities from one table."""
    by = ("cdn_region",)
    log = accesses(spark, d).select("event_id", "ts", "cdn_region", "file_id")
    rows = trace.stack_distances(trace.positioned(log, "event_id", blocks=BLOCKS, by=by), by)
    for n in (5, CAPACITY, 60):
        rows = trace.lru_columns(rows, n).withColumnsRenamed({"hit": f"hit_{n}", "stack_distance_approx": f"stack_{n}"})
    return rows.select("event_id", "distance", *[f"{k}_{n}" for n in (5, CAPACITY, 60) for k in ("hit", "stack")])


@query("object_accesses_a1", "SELECT file_id, count(*) AS accesses FROM accesses GROUP BY ALL")
def object_accesses(spark, d):
    return accesses(spark, d).groupBy("file_id").agg(F.count("*").alias("accesses"))


@query("distinct_objects_a2", "SELECT count(DISTINCT file_id) AS objects FROM accesses")
def distinct_objects(spark, d):
    return accesses(spark, d).agg(F.count_distinct("file_id").alias("objects"))


@query("training_statistics_a5", LRU_SQL + """,
    ahead AS (SELECT event_id, lead(pos) OVER w - pos AS d1, """ + ", ".join(
        f"coalesce(CASE WHEN lead(pos, {i}) OVER w - pos <= 100 THEN 1.0::DOUBLE / (lead(pos, {i}) OVER w - pos) END, 0)"
        f" AS r{i}" for i in range(1, 6)) + """ FROM trace WINDOW w AS (PARTITION BY file_id ORDER BY pos))
    SELECT count(*) AS total_records, count(DISTINCT file_id) AS unique_files,
      round(avg(hit), 6) AS hit_rate, round(avg(coalesce(d1, 300)), 6) AS avg_access_distance,
      round(avg(least(1.0::DOUBLE, r1 + r2 + r3 + r4 + r5)), 6) AS avg_reuse_prob,
      round(avg(stack_distance_approx), 6) AS avg_stack_distance
    FROM trace JOIN lru USING (event_id) JOIN ahead USING (event_id)""")
def training_statistics(spark, d):
    rows = trace.with_lru(trace.look_ahead(_positioned(spark, d)), CAPACITY)
    stats = trace.training_statistics(rows)
    return stats.select("total_records", "unique_files", *[r6(n) for n in stats.columns[2:]])


@query("sample_of_trace_k12", """SELECT pos, '{"' || file_id || '":' || size || '}' AS entry FROM trace
    ORDER BY pos LIMIT 5""")
def sample_of_trace(spark, d):
    first = _positioned(spark, d, "size").orderBy("pos").limit(5)
    return first.select("pos", F.to_json(F.create_map("file_id", c("size").cast("bigint")))
                        .alias("entry"))


@query("self_join_next_distance_j9", """SELECT event_id,
    coalesce(lead(pos) OVER (PARTITION BY file_id ORDER BY pos) - pos, 300) AS next_access_distance
    FROM trace""")
def next_distance_by_join(spark, d):
    """Next access found through running counts: access n meets access n + 1 of its object.

    An equi-join on (object, count) replaces the join on every later position.
    """
    rows = trace.history(_positioned(spark, d)).select("event_id", "file_id", "pos", "access_count")
    following = rows.select("file_id", (c("access_count") - 1).alias("access_count"),
                            c("pos").alias("next_pos"))
    return rows.join(following, ["file_id", "access_count"], "left").select(
        "event_id", F.coalesce(c("next_pos") - c("pos"), F.lit(300).cast("bigint"))
        .alias("next_access_distance"))


@query("block_summary")
def block_summary(spark, d):
    """Rows per range block of the trace: the blocks are even whatever the objects are."""
    return _positioned(spark, d).groupBy(BLOCK).agg(
        F.count("*").alias("rows"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))
