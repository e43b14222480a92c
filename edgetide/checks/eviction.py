"""Checks of snapshots, scores, eviction plans and their metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgetide.checks import query
from edgetide.checks.views import AS_OF, LIMIT_MB, accesses, predictions, snapshot
from edgetide.functions import fixed_values as fixed
from edgetide.functions import scores
from edgetide.operators import eviction, snapshot as snapshots
from edgetide.plans import evict
from edgetide.sources import cache_indexes
from edgetide.staging import new_path

c = F.col
KEY = ["region", "file_id"]


def r6(name):
    return F.round(c(name), 6).alias(name)


@query("index_from_log_a32", """SELECT region, file_id, last_access, size, path, access_count, type
    FROM snapshot""")
def index_from_log(spark, d):
    return snapshot(spark, d)


@query("bytes_in_use_a3", """SELECT region, CAST(sum(size) AS BIGINT) AS bytes_used
    FROM snapshot GROUP BY ALL""")
def bytes_in_use(spark, d):
    return snapshots.bytes_in_use(snapshot(spark, d))


@query("bytes_to_free_a4", f"""SELECT region, CAST(sum(size) AS BIGINT) AS bytes_used,
    sum(size) > {LIMIT_MB * 1048576} AS over,
    CAST(greatest(sum(size) - {LIMIT_MB * 1048576}, 0) AS BIGINT) AS bytes_to_free
    FROM snapshot GROUP BY ALL""")
def bytes_to_free(spark, d):
    return snapshots.over_limit(snapshot(spark, d), LIMIT_MB)


# --- scores -------------------------------------------------------------------------

_CLIP_D = "least(greatest(distance / 300.0, 0), 1)"
_CLIP_R = "least(greatest(reuse, 0), 1)"


def lrb_sql(b, dist, r):
    return f"((1 - p) * {b} + {_CLIP_D} * {dist} + (1 - {_CLIP_R}) * {r})::DOUBLE"


LRB = lrb_sql("0.4", "0.3", "0.3")
FALLBACK = "(age_hours * 0.7::DOUBLE + 0.3::DOUBLE / greatest(access_count, 1))"
LRU = """(age_hours * (1 + 0.1::DOUBLE / greatest(access_count, 1))
  * least(greatest(size / 1048576.0 / 10, 0.1::DOUBLE), 1))"""
FREQ = "(access_count * greatest(0.1::DOUBLE, 1 - age_hours / 24))"
LFU = f"""(1 / greatest({FREQ}, 1) * (1 + age_hours / 168)
  * least(greatest(size / 1048576.0 / 10, 1), 2)
  * (1 + 1 / greatest(access_count / greatest(age_hours, 1), 0.1::DOUBLE)))"""


@query("lrb_score_m1", f"SELECT region, file_id, round({LRB}, 6) AS score FROM predictions")
def lrb_score(spark, d):
    return predictions(spark, d).select(*KEY, F.round(
        scores.lrb_score(c("p"), c("distance"), c("reuse")), 6).alias("score"))


@query("weighted_score_m2", f"""SELECT region, file_id, round({lrb_sql('0.5', '0.25', '0.25')}, 6)
    AS score FROM predictions""")
def weighted_score(spark, d):
    return predictions(spark, d).select(*KEY, F.round(scores.lrb_score(
        c("p"), c("distance"), c("reuse"), fixed.ALTERNATIVE_WEIGHTS), 6).alias("score"))


@query("fallback_score_m3", f"SELECT region, file_id, round({FALLBACK}, 6) AS score FROM predictions")
def fallback_score(spark, d):
    return predictions(spark, d).select(*KEY, F.round(scores.fallback_score(
        c("age_since_last_access"), c("access_count")), 6).alias("score"))


@query("all_zero_fallback_m4", f"""SELECT region, file_id, round(CASE WHEN region = 'sea'
    THEN {FALLBACK} ELSE {LRB} END, 6) AS score FROM predictions""")
def all_zero_fallback(spark, d):
    sea = c("region") == "sea"
    silent = predictions(spark, d).withColumns({
        "p": F.when(sea, 1.0).otherwise(c("p")), "distance": F.when(sea, 0.0).otherwise(c("distance")),
        "reuse": F.when(sea, 1.0).otherwise(c("reuse"))})
    return eviction.lrb_scored(silent).select(*KEY, r6("score"))


_SHARE = "greatest(distance, 0) / max(greatest(distance, 0)) OVER (PARTITION BY region)"


@query("belady_score_m5", f"""SELECT region, file_id, round((1 - p) * 0.4 + {_SHARE} * 0.4
    + (1 - {_CLIP_R}) * 0.2, 6) AS score FROM predictions""")
def belady_score(spark, d):
    return eviction.belady_scored(predictions(spark, d)).select(*KEY, r6("score"))


@query("belady_single_scores_m6", f"""SELECT region, file_id, round(1 - p, 6) AS by_binary,
    round({_SHARE}, 6) AS by_distance, round(1 - {_CLIP_R}, 6) AS by_reuse FROM predictions""")
def belady_single_scores(spark, d):
    rows = predictions(spark, d)
    out = None
    for strategy in ("binary", "distance", "reuse"):
        one = eviction.belady_scored(rows, strategy).select(
            *KEY, F.round("score", 6).alias(f"by_{strategy}"))
        out = one if out is None else out.join(one, KEY)
    return out


@query("belady_fallback_m7", """SELECT region, file_id, round(age_since_last_access
    / max(age_since_last_access) OVER (PARTITION BY region) * 0.6 + 0.4::DOUBLE / (access_count + 1), 6)
    AS score FROM featured""")
def belady_fallback(spark, d):
    return eviction.belady_fallback_scored(predictions(spark, d)).select(*KEY, r6("score"))


@query("max_for_normalisation_a27", """SELECT region, file_id, round(distance / max(distance) OVER (), 6)
    AS share FROM predictions""")
def max_for_normalisation(spark, d):
    rows = predictions(spark, d)
    return rows.select(*KEY, F.round(c("distance") / rows.select(F.max("distance")).scalar(), 6)
                       .alias("share"))


@query("lru_score_m8", f"SELECT region, file_id, round({LRU}, 6) AS score FROM featured")
def lru_score(spark, d):
    return eviction.lru_scored(snapshot(spark, d), AS_OF).select(*KEY, r6("score"))


@query("weighted_frequency_m9", f"SELECT region, file_id, round({FREQ}, 6) AS frequency FROM featured")
def weighted_frequency(spark, d):
    return snapshots.with_frequency(snapshot(spark, d), AS_OF).select(*KEY, r6("frequency"))


@query("lfu_score_m10", f"SELECT region, file_id, round({LFU}, 6) AS score FROM featured")
def lfu_score(spark, d):
    return eviction.lfu_scored(snapshots.with_frequency(snapshot(spark, d), AS_OF)).select(
        *KEY, r6("score"))


@query("prediction_clean_up_m20", f"""SELECT region, file_id, round(greatest(distance - 50, 0), 6) AS distance,
    round({_CLIP_R}, 6) AS reuse FROM predictions""")
def prediction_clean_up(spark, d):
    return predictions(spark, d).select(
        *KEY, F.round(scores.clean_distance(c("distance") - 50), 6).alias("distance"),
        F.round(scores.clean_probability(c("reuse")), 6).alias("reuse"))


# --- plans -----------------------------------------------------------------------------

def cut_sql(score: str, source: str, direction: str = "DESC") -> str:
    return f"""
    WITH scored AS (SELECT *, {score} AS score FROM {source}),
    target AS (SELECT region, sum(size) - {LIMIT_MB * 1048576} AS need FROM snapshot GROUP BY ALL),
    walked AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY region ORDER BY score {direction}, file_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed_before,
      row_number() OVER (PARTITION BY region ORDER BY score {direction}, file_id) AS rank FROM scored),
    evicted AS (SELECT walked.* FROM walked JOIN target USING (region) WHERE need > 0 AND freed_before < need)
    """


_PLAN = """SELECT region, file_id, size, round(score, 6) AS score, rank,
  CAST(freed_before AS BIGINT) AS freed_before FROM evicted"""


def _plan(df):
    return df.select(*KEY, "size", r6("score"), "rank", "freed_before")


@query("eviction_cut_w10_k2", cut_sql(LRB, "predictions") + _PLAN)
def eviction_cut(spark, d):
    scored = eviction.lrb_scored(predictions(spark, d))
    return _plan(eviction.eviction_cut(scored, LIMIT_MB, blocks=5))


@query("lrb_plan_m11", cut_sql(LRB, "predictions") + _PLAN)
def lrb_plan(spark, d):
    return _plan(evict.plan_lrb(predictions(spark, d), LIMIT_MB).evicted)


@query("lru_plan_m11", cut_sql(LRU, "featured") + _PLAN)
def lru_plan(spark, d):
    return _plan(evict.plan_lru(snapshot(spark, d), AS_OF, LIMIT_MB).evicted)


@query("lfu_plan_m11", cut_sql(LFU, "featured") + _PLAN)
def lfu_plan(spark, d):
    return _plan(evict.plan_lfu(snapshot(spark, d), AS_OF, LIMIT_MB).evicted)


@query("hit_probability_plan_m12_k3", cut_sql("p", "predictions", "ASC") + _PLAN)
def hit_probability_plan(spark, d):
    return _plan(evict.plan_hit_probability(predictions(spark, d), LIMIT_MB).evicted)


@query("hit_model_features_m12", """
    SELECT region, file_id, CAST(length(file_id) - length(replace(file_id, '_', '')) AS INTEGER) AS access_count,
      round(age_since_last_access, 6) AS age_since_last_access, type AS file_type,
      CAST(dense_rank() OVER (ORDER BY type) - 1 AS INTEGER) AS file_type_encoded,
      round(ln(1 + greatest(1, size)), 6) AS log_file_size FROM featured""")
def hit_model_features(spark, d):
    return snapshots.hit_model_features(snapshot(spark, d), AS_OF).select(
        *KEY, "access_count", r6("age_since_last_access"), "file_type", "file_type_encoded",
        r6("log_file_size"))


@query("survivors_j3_u4", cut_sql(LRU, "featured") + """SELECT region, file_id, size FROM snapshot
    ANTI JOIN evicted USING (region, file_id)""")
def survivors(spark, d):
    return evict.plan_lru(snapshot(spark, d), AS_OF, LIMIT_MB).survivors.select(*KEY, "size")


@query("candidates_with_entry_j4", cut_sql(LFU, "featured") + f"""SELECT region, file_id, rank,
    round({FREQ}, 6) AS frequency, access_count, size, last_access FROM evicted""")
def candidates_with_entry(spark, d):
    return evict.plan_lfu(snapshot(spark, d), AS_OF, LIMIT_MB).evicted.select(
        *KEY, "rank", r6("frequency"), "access_count", "size", "last_access")


@query("top_recommendations_k4_w11", f"""SELECT region, file_id, round({LRB}, 6) AS score,
    CAST(row_number() OVER (PARTITION BY region ORDER BY {LRB} DESC, file_id) AS INTEGER) AS rank
    FROM predictions QUALIFY rank <= 3""")
def top_recommendations(spark, d):
    return eviction.recommendations(eviction.lrb_scored(predictions(spark, d)), 3).select(
        *KEY, r6("score"), "rank")


@query("explained_recommendations_m13", f"""SELECT region, file_id, round(1 - p, 6) AS no_access_prob,
    round(distance, 6) AS predicted_distance, round({_CLIP_D}, 6) AS distance_score,
    round(reuse, 6) AS reuse_prob, round(1 - {_CLIP_R}, 6) AS no_reuse_score,
    round({LRB}, 6) AS total_score FROM predictions
    QUALIFY row_number() OVER (PARTITION BY region ORDER BY {LRB} DESC, file_id) <= 2""")
def explained_recommendations(spark, d):
    top = eviction.recommendations(eviction.lrb_scored(predictions(spark, d)), 2)
    parts = top.withColumn("e", scores.lrb_explanation(c("p"), c("distance"), c("reuse")))
    return parts.select(*KEY, *[F.round(f"e.{n}", 6).alias(n) for n in (
        "no_access_prob", "predicted_distance", "distance_score", "reuse_prob", "no_reuse_score",
        "total_score")])


@query("least_frequent_listing_k5", f"""SELECT region, file_id, round({LFU}, 6) AS score,
    round({FREQ}, 6) AS frequency, access_count FROM featured ORDER BY {LFU} DESC, file_id, region LIMIT 10""")
def least_frequent_listing(spark, d):
    scored = eviction.lfu_scored(snapshots.with_frequency(snapshot(spark, d), AS_OF))
    return scored.orderBy(F.desc("score"), "file_id", "region").limit(10).select(
        *KEY, r6("score"), r6("frequency"), "access_count")


@query("lru_order_w12", """SELECT region, file_id, row_number() OVER (PARTITION BY region
    ORDER BY last_access, file_id) AS lru_rank FROM snapshot""")
def lru_order(spark, d):
    return eviction.lru_order(snapshot(spark, d), blocks=5).select(*KEY, "lru_rank")


# --- metrics -----------------------------------------------------------------------------

_MB = "1048576.0::DOUBLE"


def metrics_sql(strategy: str, more: str = "") -> str:
    return f"""
    SELECT region, '{strategy}' AS strategy, count(e.file_id) AS files_evicted,
      CAST(coalesce(sum(e.size), 0) AS BIGINT) AS bytes_evicted,
      round(coalesce(sum(e.size), 0) / {_MB}, 6) AS mb_evicted,
      round(any_value(used) / {_MB}, 6) AS cache_size_before_mb,
      round((any_value(used) - coalesce(sum(e.size), 0)) / {_MB}, 6) AS cache_size_after_mb,
      round(coalesce(avg(e.size), 0), 6) AS avg_file_size, round(coalesce(avg(e.score), 0), 6)
      AS avg_{strategy.lower()}_score{more}, coalesce(string_agg(CASE WHEN rank <= 10 THEN e.file_id END, ','
      ORDER BY rank), '') AS first_evicted
    FROM (SELECT region, sum(size) AS used FROM snapshot GROUP BY ALL) s LEFT JOIN evicted e USING (region)
    GROUP BY region"""


_METRICS = ["files_evicted", "bytes_evicted"]
_ROUNDED = ["mb_evicted", "cache_size_before_mb", "cache_size_after_mb", "avg_file_size"]


def _first():
    return F.coalesce(F.array_join(c("evicted_files.file_id"), ","), F.lit("")).alias("first_evicted")



@query("lru_metrics_a7_k6", cut_sql(LRU, "featured") + metrics_sql("LRU"))
def lru_metrics(spark, d):
    m = evict.plan_lru(snapshot(spark, d), AS_OF, LIMIT_MB).metrics
    return m.select("region", "strategy", *_METRICS, *[r6(n) for n in _ROUNDED],
                    r6("avg_lru_score"), _first())


@query("lfu_metrics_a8", cut_sql(LFU, "featured") + metrics_sql("LFU", f""",
    round(coalesce(avg({FREQ}) FILTER (e.file_id IS NOT NULL), 0), 6) AS avg_frequency,
    round(coalesce(avg(e.access_count), 0), 6) AS avg_access_count"""))
def lfu_metrics(spark, d):
    m = evict.plan_lfu(snapshot(spark, d), AS_OF, LIMIT_MB).metrics
    return m.select("region", "strategy", *_METRICS, *[r6(n) for n in _ROUNDED],
                    r6("avg_lfu_score"), r6("avg_frequency"), r6("avg_access_count"), _first())


@query("frequency_statistics_a9", f"""SELECT region, count(*) AS total_tracked, round(avg({FREQ}), 6) AS avg_frequency,
    round(min({FREQ}), 6) AS min_frequency, round(max({FREQ}), 6) AS max_frequency,
    count(*) FILTER ({FREQ} < 2) AS low_freq_count, count(*) FILTER ({FREQ} > 10) AS high_freq_count
    FROM featured GROUP BY ALL""")
def frequency_statistics(spark, d):
    rows = snapshots.with_frequency(snapshot(spark, d), AS_OF)
    return snapshots.frequency_statistics(rows, by=["region"]).select(
        "region", "total_tracked", r6("avg_frequency"), r6("min_frequency"), r6("max_frequency"),
        "low_freq_count", "high_freq_count")


@query("metrics_history_s12_u3", cut_sql(LRU, "featured") + f""",
    lfu_scored AS (SELECT *, {LFU} AS score FROM featured),
    lfu_walked AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY region ORDER BY score DESC, file_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed_before FROM lfu_scored),
    lfu_evicted AS (SELECT lfu_walked.* FROM lfu_walked JOIN target USING (region)
      WHERE need > 0 AND freed_before < need)
    SELECT region, 'LRU' AS strategy, count(e.file_id) AS files_evicted,
      CAST(coalesce(sum(e.size), 0) AS BIGINT) AS bytes_evicted
      FROM target LEFT JOIN evicted e USING (region) GROUP BY region
    UNION ALL SELECT region, 'LFU', count(e.file_id), CAST(coalesce(sum(e.size), 0) AS BIGINT)
      FROM target LEFT JOIN lfu_evicted e USING (region) GROUP BY region""")
def metrics_history(spark, d):
    """Two runs append their records; the history is read back as one table."""
    path = new_path(spark, "metrics-history")
    snap = snapshot(spark, d)
    runs = [evict.plan_lru(snap, AS_OF, LIMIT_MB).metrics, evict.plan_lfu(snap, AS_OF, LIMIT_MB).metrics]
    for run in runs:
        cache_indexes.append_metrics(run, path)
    schema = runs[0].unionByName(runs[1], allowMissingColumns=True).schema
    return cache_indexes.read_metrics(spark, path, schema).select(
        "region", "strategy", "files_evicted", "bytes_evicted")


@query("index_after_eviction_s8", cut_sql(LRU, "featured") + """SELECT region, file_id, size, type
    FROM snapshot ANTI JOIN evicted USING (region, file_id)""")
def index_after_eviction(spark, d):
    path = new_path(spark, "index-after")
    evict.publish_survivors(evict.plan_lru(snapshot(spark, d), AS_OF, LIMIT_MB), path)
    return cache_indexes.read_index_lines(spark, path).select(*KEY, "size", "type")


# --- plans from index files -----------------------------------------------------------------

def _from_index(policy, predict=None):
    """Some entries lose their time or their size; what is left of the index afterwards."""
    def run(spark, d):
        from edgetide.checks.scans import index_fields, written_indexes
        flaw = F.substring("file_id", 7, 9).cast("int") % 10
        entries = index_fields(snapshot(spark, d)).withColumns({
            "last_access": F.when(flaw == 3, F.lit('"never"')).otherwise(c("last_access")),
            "size": F.when(flaw == 5, F.lit("0")).otherwise(c("size")),
            "name": F.concat(F.lit("cache_index_"), "region", F.lit(".json"))})
        path = new_path(spark, "index-next")
        plan = evict.from_index(spark, written_indexes(spark, entries, "name").replace("name=*", "name=cache_index_*"),
                                policy, AS_OF, 20, predict, path)
        left = cache_indexes.read_index_lines(spark, path).select(*KEY, c("size").alias("bytes"), "last_access")
        return left.withColumn("evicted", F.lit(False)).unionByName(plan.evicted.select(
            *KEY, c("size").alias("bytes"), F.date_format("last_access", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
            .alias("last_access")).withColumn("evicted", F.lit(True)))
    return run


def _stand_in(rows):
    return rows.withColumns({"p": (c("access_count") % 10) / 10.0, "distance": (c("size") / 100.0) % 400,
                             "reuse": (c("access_count") % 7) / 5.0 - 0.1})


def _index_sql(score):
    """Valid entries are cut by score; the rest of the index stays as it was."""
    return f"""
  WITH flawed AS (SELECT * EXCLUDE (size, last_access), CAST(substr(file_id, 7) AS INTEGER) % 10 AS flaw,
      CASE WHEN flaw = 5 THEN 0 ELSE size END AS size, last_access AS seen_at,
      CASE WHEN flaw = 3 THEN 'never' ELSE strftime(last_access, '%Y-%m-%dT%H:%M:%S.%f') END AS last_access FROM snapshot),
  valid AS (SELECT *, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(seen_at)) / 1e6 / 3600 AS age_hours,
      (access_count % 10) / 10.0 AS p, (size / 100.0) % 400 AS distance, (access_count % 7) / 5.0 - 0.1 AS reuse
    FROM flawed WHERE flaw NOT IN (3, 5) AND size > 0),
  cut AS (SELECT *, sum(size) OVER (PARTITION BY region) - {20 * 1048576} AS target,
      coalesce(sum(size) OVER (PARTITION BY region ORDER BY {score} DESC, file_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed FROM valid),
  gone AS (SELECT region, file_id FROM cut WHERE freed < target)
  SELECT region, file_id, size AS bytes, last_access, gone.file_id IS NOT NULL AS evicted
  FROM flawed LEFT JOIN gone USING (region, file_id)"""


query("lru_from_index_m11_f7", _index_sql(LRU))(_from_index("LRU"))
query("lfu_from_index_m11_f7", _index_sql(LFU))(_from_index("LFU"))
query("lrb_from_index_m11_f7", _index_sql(LRB))(_from_index("LRB", _stand_in))


# --- frequency state ------------------------------------------------------------------------

_OLD = """WITH old AS (SELECT cdn_region AS region, file_id, count(*) / 200.0::DOUBLE AS frequency
  FROM accesses GROUP BY ALL),
kept AS (SELECT region, file_id, frequency * pow(0.99, 2) AS f FROM old WHERE frequency * pow(0.99, 2) >= 0.1),
fresh AS (SELECT region, CASE WHEN access_count % 2 = 0 THEN file_id ELSE file_id || '_new' END AS file_id,
  access_count * greatest(0.1::DOUBLE, 1 - age_hours / 24) AS f FROM featured)"""


@query("decay_step_x8_j6", _OLD + """ SELECT region, file_id, round(greatest(coalesce(kept.f, 0),
    coalesce(fresh.f, 0)), 6) AS frequency FROM kept FULL JOIN fresh USING (region, file_id)""")
def decay_step(spark, d):
    tracker = (accesses(spark, d).groupBy(c("cdn_region").alias("region"), "file_id")
               .agg((F.count("*") / 200.0).alias("frequency")))
    # half of the current objects are new to the tracker
    name = F.when(c("access_count") % 2 == 0, c("file_id")).otherwise(
        F.concat("file_id", F.lit("_new")))
    current = snapshots.with_frequency(snapshot(spark, d), AS_OF).withColumn("file_id", name)
    return snapshots.decay_and_merge(tracker, current, 2.0).select(*KEY, r6("frequency"))


@query("policies_side_by_side_u3", f"""
    WITH scored AS (SELECT *, 'LRU' AS policy, {LRU} AS score FROM featured
      UNION ALL SELECT *, 'LFU', {LFU} FROM featured),
    target AS (SELECT region, sum(size) - {LIMIT_MB * 1048576} AS need FROM snapshot GROUP BY ALL),
    walked AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY policy, region ORDER BY score DESC, file_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed_before FROM scored)
    SELECT policy, region, file_id FROM walked JOIN target USING (region) WHERE need > 0 AND freed_before < need""")
def policies_side_by_side(spark, d):
    snap = snapshot(spark, d)
    both = evict.compare_policies({"LRU": evict.plan_lru(snap, AS_OF, LIMIT_MB),
                                   "LFU": evict.plan_lfu(snap, AS_OF, LIMIT_MB)})
    return both.select("policy", "region", "file_id")
