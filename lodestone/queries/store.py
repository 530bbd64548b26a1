"""Store, scoreboard and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import store
from lodestone.queries.base import query

FP = """fp AS (
  SELECT r.*, t.rating_id, t.thumbs_up, t.wrong_count, t.missed_count, t.verdicts_confirmed, t.unratable,
    CASE WHEN t.verdicts_confirmed AND v.n > 0 THEN 'per_match' WHEN t.wrong_count IS NOT NULL THEN 'count' END AS fp_source,
    CAST(CASE WHEN t.verdicts_confirmed AND v.n > 0 THEN v.wrong ELSE t.wrong_count END AS BIGINT) AS fp
  FROM runs r LEFT JOIN ratings t ON t.run_id = r.run_id
  LEFT JOIN (SELECT rating_id, count(*) AS n, sum(CASE WHEN correct THEN 0 ELSE 1 END) AS wrong FROM match_verdicts GROUP BY rating_id) v ON v.rating_id = t.rating_id
), met AS (
  SELECT *, retrieved - fp AS tp, retrieved - fp + missed_count AS expected, (retrieved - fp) / nullif(CAST(retrieved AS DOUBLE), 0) AS prec, (retrieved - fp) / nullif(CAST(retrieved - fp + missed_count AS DOUBLE), 0) AS rec FROM fp
)"""
WILSON = """CASE WHEN n = 0 THEN NULL WHEN s = 0 THEN 0.0 ELSE (s / n + {z} * {z} / (2 * n) - {z} * sqrt(s / n * (1 - s / n) / n + {z} * {z} / (4.0 * n * n))) / (1 + {z} * {z} / n) END AS low,
  CASE WHEN n = 0 THEN NULL WHEN s = n THEN 1.0 ELSE (s / n + {z} * {z} / (2 * n) + {z} * sqrt(s / n * (1 - s / n) / n + {z} * {z} / (4.0 * n * n))) / (1 + {z} * {z} / n) END AS high""".replace("{z}", "1.959963984540054")


@query(f"WITH {FP} SELECT run_id, rating_id, fp_source, fp, round(preprocess_ms + inference_ms + postprocess_ms, 6) AS total_ms FROM fp")
def run_fp(v):
    return store.run_fp(v.runs, v.ratings, v.match_verdicts).select("run_id", "rating_id", "fp_source", "fp", "total_ms")


@query(f"""WITH {FP} SELECT run_id, rating_id, tp, CAST(missed_count AS BIGINT) AS fn, expected, CASE WHEN fp IS NULL THEN 'unrated' WHEN retrieved = 0 THEN 'nothing_retrieved' ELSE 'ok' END AS precision_status,
  round(prec, 6) AS precision, round(rec, 6) AS recall FROM met""")
def run_metrics(v):
    return store.run_metrics(store.run_fp(v.runs, v.ratings, v.match_verdicts)).select("run_id", "rating_id", "tp", "fn", "expected", "precision_status", "precision", "recall")


@query("SELECT method, CAST(sum(CASE WHEN thumbs_up THEN 1 END) AS BIGINT) AS up, count(thumbs_up) AS rated, count(*) AS n_runs FROM runs LEFT JOIN ratings USING (run_id) GROUP BY method")
def method_thumbs(v):
    return store.method_thumbs(v.runs, v.ratings)


@query(f"WITH t AS (SELECT method, CAST(coalesce(sum(CASE WHEN thumbs_up THEN 1 END), 0) AS DOUBLE) AS s, count(thumbs_up) AS n FROM runs LEFT JOIN ratings USING (run_id) GROUP BY method), w AS (SELECT method, {WILSON} FROM t) SELECT method, round(low, 6) AS low, round(high, 6) AS high FROM w")
def wilson_by_method(v):
    return store.method_thumbs(v.runs, v.ratings).select("method", store.wilson(F.coalesce("up", F.lit(0)), F.col("rated")).alias("w")).select("method", "w.low", "w.high")


@query(f"""WITH {FP}, t AS (
  SELECT method, count(*) AS n_runs, count(thumbs_up) AS n, CAST(coalesce(sum(CASE WHEN thumbs_up THEN 1 END), 0) AS DOUBLE) AS s FROM runs LEFT JOIN ratings USING (run_id) GROUP BY method
), m AS (SELECT method, avg(prec) AS mp, count(prec) AS np, avg(rec) AS mr, count(rec) AS nr FROM met GROUP BY method),
o AS (SELECT method, quantile_cont(preprocess_ms + inference_ms + postprocess_ms, 0.5) AS p50, quantile_cont(preprocess_ms + inference_ms + postprocess_ms, 0.9) AS p90, quantile_cont(preprocess_ms + inference_ms + postprocess_ms, 0.99) AS p99,
  count(*) FILTER (WHERE outcome = 'empty') AS abstained, count(*) FILTER (WHERE outcome = 'error') AS errors FROM runs GROUP BY method), w AS (SELECT t.*, {WILSON} FROM t)
SELECT w.method, n_runs, n AS rated, CAST(s AS BIGINT) AS up, round(low, 6) AS low, round(high, 6) AS high, round(mp, 6) AS mean_precision, np AS n_precision, round(mr, 6) AS mean_recall, nr AS n_recall,
  round(p50, 6) AS p50_ms, round(p90, 6) AS p90_ms, round(p99, 6) AS p99_ms, abstained, errors FROM w JOIN m ON m.method = w.method JOIN o ON o.method = w.method""")
def scoreboard(v):
    return store.scoreboard(v.runs, v.ratings, v.match_verdicts)


@query(f"""WITH {FP} SELECT rating_id, CASE WHEN fp IS NOT NULL AND missed_count IS NOT NULL THEN 'complete' WHEN fp IS NOT NULL THEN 'precision_only' WHEN missed_count IS NOT NULL THEN 'recall_only' ELSE 'none' END AS tier,
  coalesce(fp_source = 'per_match' AND wrong_count IS NOT NULL AND wrong_count <> fp, false) AS discrepancy FROM fp WHERE rating_id IS NOT NULL""")
def rating_completeness(v):
    return store.rating_tiers(store.run_fp(v.runs, v.ratings, v.match_verdicts))


@query("""WITH v AS (SELECT rating_id, count(*) AS n, count(DISTINCT match_index) AS d, max(match_index) AS top FROM match_verdicts GROUP BY rating_id), bad AS (
  SELECT t.rating_id, CASE WHEN wrong_count < 0 OR wrong_count > retrieved - 1 THEN 'wrong_count' WHEN missed_count < 0 THEN 'missed_count' WHEN n <> d THEN 'repeated_verdict' WHEN top >= retrieved - 1 THEN 'verdict_index' WHEN verdicts_confirmed AND n <> retrieved - 1 THEN 'verdict_count' END AS reason
  FROM ratings t JOIN runs r USING (run_id) LEFT JOIN v USING (rating_id)) SELECT * FROM bad WHERE reason IS NOT NULL""")
def rating_violations(v):
    return store.rating_violations(v.runs.withColumn("retrieved", F.col("retrieved") - 1), v.ratings, v.match_verdicts)


@query("""WITH n AS (SELECT run_id, count(*) AS n FROM candidates GROUP BY run_id), bad AS (SELECT run_id, CASE WHEN outcome = 'ok' AND n IS NULL THEN 'ok_without_match' WHEN outcome <> 'ok' AND n > 0 THEN 'match_without_ok' END AS reason FROM runs LEFT JOIN n USING (run_id))
SELECT * FROM bad WHERE reason IS NOT NULL""")
def result_violations(v):
    return store.result_violations(v.runs, v.candidates)


@query("""WITH m AS (SELECT run_id, count(*) AS n, sum(score * (idx + 1)) AS s FROM matches GROUP BY run_id), c AS (SELECT run_id, count(*) AS n, sum(score * (rnk + 1)) AS s FROM candidates GROUP BY run_id)
SELECT r.run_id, coalesce(m.n, 0) AS n_matches, coalesce(c.n, 0) AS n_candidates, round(coalesce(m.s, 0), 6) AS match_digest, round(coalesce(c.s, 0), 6) AS candidate_digest FROM runs r LEFT JOIN m USING (run_id) LEFT JOIN c ON c.run_id = r.run_id""")
def run_detail(v):
    d = store.run_detail(v.runs, v.matches, v.candidates)
    digest = lambda c: F.aggregate(F.transform(c, lambda x, i: x["score"].cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return d.select("run_id", F.size("matches").alias("n_matches"), F.size("candidates").alias("n_candidates"), digest("matches").alias("match_digest"), digest("candidates").alias("candidate_digest"))


@query("SELECT t.rating_id, n AS n_verdicts, good FROM ratings t LEFT JOIN (SELECT rating_id, count(*) AS n, CAST(sum(CASE WHEN correct THEN 1 ELSE 0 END) AS BIGINT) AS good FROM match_verdicts GROUP BY rating_id) v USING (rating_id)")
def rating_detail(v):
    d = store.rating_detail(v.ratings, v.match_verdicts)
    return d.select("rating_id", F.when(F.col("verdicts").isNotNull(), F.size("verdicts").cast("bigint")).alias("n_verdicts"), F.when(F.col("verdicts").isNotNull(), F.size(F.filter("verdicts", lambda x: x["correct"])).cast("bigint")).alias("good"))


@query("SELECT rating_id, run_id FROM ratings WHERE run_id NOT IN (SELECT run_id FROM runs WHERE run_id % 5 <> 0)")
def orphan_ratings(v):
    return store.orphans(v.ratings, v.runs.where("run_id % 5 <> 0"), "run_id").select("rating_id", "run_id")


@query("SELECT run_id, idx FROM matches WHERE run_id % 10 <> 0")
def cascade_delete(v):
    gone = v.runs.where("run_id % 10 = 0")
    return store.delete_runs(gone, v.runs, matches=v.matches)["matches"].select("run_id", "idx")


@query("""SELECT run_id, CASE WHEN run_id % 2 = 0 THEN NULL ELSE 'map' END AS heatmap_left FROM runs""")
def diagnostics_cap(v):
    heat = F.when(F.col("run_id") % 2 == 0, F.repeat(F.lit("x"), 300_000)).otherwise("map")
    d = v.runs.select("run_id", store.without_large_heatmap(F.struct(F.array(F.lit("note")).alias("notes"), heat.alias("similarity_heatmap"))).alias("d"))
    return d.select("run_id", F.col("d.similarity_heatmap").alias("heatmap_left"))


@query("""SELECT run_id, sha256('{"method":"' || method || '","retrieved":' || CAST(retrieved AS VARCHAR) || ',"threshold":null}') AS config_hash FROM runs""")
def config_hash(v):
    return v.runs.select("run_id", store.config_hash(F.struct("method", F.col("retrieved"), F.lit(None).cast("double").alias("threshold"))).alias("config_hash"))


@query("SELECT method, outcome, count(*) AS n, round(avg(preprocess_ms + inference_ms + postprocess_ms), 6) AS mean_ms FROM runs GROUP BY method, outcome")
def outcome_counts(v):
    return v.runs.groupBy("method", "outcome").agg(F.count("*").alias("n"), F.avg(F.col("preprocess_ms") + F.col("inference_ms") + F.col("postprocess_ms")).alias("mean_ms"))
