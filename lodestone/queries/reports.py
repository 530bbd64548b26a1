"""Queries of bounds, filters, statistics and comparisons, beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import reports as rep
from lodestone.queries.base import query

AREA = "CAST(w AS BIGINT) * h"


@query("SELECT run_id, rnk, x, y, w, h, score FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, y, x, rnk) AS k FROM candidates) q WHERE k <= 3")
def top_candidates(v):
    return rep.top_of_each(v.candidates, ["run_id"], 3, F.col("score").desc(), F.col("y"), F.col("x"), F.col("rnk")).select("run_id", "rnk", "x", "y", "w", "h", "score")


@query("SELECT image_id, vid, distance FROM (SELECT image_id, vid, abs(crop_scale - scene_scale) AS distance, row_number() OVER (PARTITION BY image_id ORDER BY abs(crop_scale - scene_scale), vid) AS k FROM votes) q WHERE k <= 4")
def closest_correspondences(v):
    near = v.votes.select("image_id", "vid", F.abs(F.col("crop_scale") - F.col("scene_scale")).alias("distance"))
    return rep.top_of_each(near, ["image_id"], 4, F.col("distance"), F.col("vid"))


@query(f"SELECT image_id, idx FROM boxes WHERE score > 0.05 AND {AREA} <= CAST(200 * 200 * 0.1 AS DOUBLE)")
def kept_proposals(v):
    small = rep.below_frame_share(F.col("w").cast("bigint"), F.col("h"), F.lit(200), F.lit(200), 0.1)
    return v.boxes.where(rep.above_objectness(F.col("score"), 0.05) & small).select("image_id", "idx")


@query(f"SELECT image_id, idx, {AREA} >= 1000 AND {AREA} <= 2000 AS both, {AREA} >= 1000 AS no_most, {AREA} <= 2000 AS no_least FROM boxes")
def area_bands(v):
    area = F.col("w").cast("bigint") * F.col("h")
    return v.boxes.select("image_id", "idx", rep.in_area_band(area, 1000, 2000).alias("both"), rep.in_area_band(area, 1000, 0).alias("no_most"), rep.in_area_band(area, -1, 2000).alias("no_least"))


SIZED = f"CASE WHEN {AREA} < 1024 THEN 'small' WHEN {AREA} < 2000 THEN 'medium' ELSE 'large' END"


@query(f"""WITH e AS (SELECT image_id % 7 AS dataset, image_id, count(*) AS n, count(*) FILTER (WHERE {SIZED} = 'small') AS small, count(*) FILTER (WHERE {SIZED} = 'medium') AS medium, count(*) FILTER (WHERE {SIZED} = 'large') AS large FROM gt_boxes GROUP BY 1, 2)
SELECT dataset, count(*) AS images, CAST(sum(n) AS BIGINT) AS instances, min(n) AS fewest, quantile_cont(n, 0.5) AS median, max(n) AS most, CAST(sum(small) AS BIGINT) AS small, CAST(sum(medium) AS BIGINT) AS medium, CAST(sum(large) AS BIGINT) AS large FROM e GROUP BY dataset""")
def dataset_stats(v):
    return rep.dataset_statistics(v.gt_boxes.withColumn("dataset", F.col("image_id") % 7), ["dataset"], F.expr(SIZED))


@query(f"""WITH r AS (SELECT method, {SIZED} AS bucket, count(*) FILTER (WHERE (gid + run_id) % 3 <> 0) AS found, count(*) AS n FROM runs JOIN gt_boxes g ON g.image_id = run_id GROUP BY 1, 2),
g AS (SELECT method, sum(CASE WHEN bucket = 'large' THEN found END) / CAST(sum(CASE WHEN bucket = 'large' THEN n END) AS DOUBLE) - sum(CASE WHEN bucket = 'small' THEN found END) / CAST(sum(CASE WHEN bucket = 'small' THEN n END) AS DOUBLE) AS gap FROM r GROUP BY method)
SELECT method, round(gap, 6) AS gap, method = (SELECT method FROM g ORDER BY gap DESC, method DESC LIMIT 1) AS widest, method = (SELECT method FROM g ORDER BY gap, method LIMIT 1) AS narrowest FROM g""")
def recall_size_gap(v):
    truths = v.gt_boxes.withColumnRenamed("image_id", "run_id")
    each = v.runs.select("run_id", "method").join(truths, "run_id").withColumn("bucket", F.expr(SIZED))
    return rep.size_gap(each.groupBy("method", "bucket").agg(F.count_if((F.col("gid") + F.col("run_id")) % 3 != 0).alias("found"), F.count("*").alias("n")))


@query("SELECT image_id, round(sum(CASE WHEN outcome <> 'error' THEN preprocess_ms + postprocess_ms END), 6) AS latency_ms, count(*) FILTER (WHERE outcome <> 'error') AS runs FROM runs GROUP BY image_id")
def fusion_latency(v):
    return rep.fusion_latency(v.runs.withColumn("latency_ms", F.col("preprocess_ms") + F.col("postprocess_ms")), ["image_id"])


ARMS = ("HIGH", "LOW", "MEDIUM")


@query("""WITH f AS (SELECT dataset, method, split, 2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) AS f1 FROM image_results GROUP BY 1, 2, 3)
SELECT a.dataset, a.method AS arm, round(a.f1, 6) AS "default", round(b.f1, 6) AS tuned, round(b.f1 - a.f1, 6) AS gain FROM f a JOIN f b ON a.dataset = b.dataset AND a.method = b.method AND a.split = 'val' AND b.split = 'test' WHERE a.method IN ('HIGH', 'LOW', 'MEDIUM')""")
def arm_comparison(v):
    f1 = (2.0 * F.sum("tp") / (2 * F.sum("tp") + F.sum("fp") + F.sum("fn"))).alias("f1")
    setting = F.when(F.col("split") == "val", "default").otherwise("tuned").alias("setting")
    results = v.image_results.groupBy("dataset", F.col("method").alias("arm"), setting).agg(f1)
    return rep.arm_comparison(results, v.image_results, list(ARMS))


@query("SELECT image_id, count(*) AS exemplar, count(DISTINCT (scene_x, scene_y)) AS scene FROM votes GROUP BY image_id")
def keypoint_counts(v):
    exemplar = v.votes.select("image_id", F.lit("exemplar").alias("side"))
    return rep.keypoint_counts(exemplar.union(v.votes.select("image_id", "scene_x", "scene_y").distinct().select("image_id", F.lit("scene"))))


@query("""WITH b AS (SELECT CAST(extract(day FROM ts) AS INT) AS epoch, floor(value) AS class_loss, CASE WHEN event_type = 'purchase' THEN floor(value) END AS contrastive FROM {events})
SELECT epoch, count(*) AS batches, round(avg(class_loss), 6) AS class_loss, round(avg(contrastive), 6) AS contrastive FROM b GROUP BY epoch""".replace("{events}", "events"))
def epoch_means(v):
    events = v.spark.read.parquet(f"{v.sf_dir}/events.parquet")
    loss = F.floor("value").cast("double")
    return rep.epoch_means(events.select(F.dayofmonth("ts").alias("epoch"), loss.alias("class_loss"), F.when(F.col("event_type") == "purchase", loss).alias("contrastive")), ["class_loss", "contrastive"])


@query("""WITH e AS (SELECT i.method, canvas_size, TRY_CAST(split_part(canvas_size, 'x', 1) AS BIGINT) * TRY_CAST(split_part(canvas_size, 'x', 2) AS BIGINT) AS area, avg(i.run_id % 512) AS latency_ms FROM image_results i GROUP BY 1, 2, 3)
SELECT method, canvas_size, round(latency_ms, 6) AS latency_ms, dense_rank() OVER (PARTITION BY method ORDER BY area) AS place FROM e WHERE area IS NOT NULL""")
def latency_by_canvas(v):
    return rep.latency_by_canvas(v.image_results.select("method", "canvas_size", (F.col("run_id") % 512).alias("latency_ms")))


@query("SELECT DISTINCT image_id FROM boxes ORDER BY image_id LIMIT 100")
def ci_images(v):
    return rep.first_images(v.boxes, 100)


@query("SELECT DISTINCT image_id FROM split_ids WHERE split IN ('val', 'test')")
def scored_ids(v):
    return rep.scored_ids(v.split_ids)


@query("SELECT s.image_id, d.source FROM (SELECT DISTINCT image_id FROM split_ids WHERE split IN ('val', 'test')) s JOIN documents d ON d.doc_id = s.image_id")
def provenance_sources(v):
    docs = v.spark.read.parquet(f"{v.sf_dir}/documents.parquet")
    return rep.with_provenance(rep.scored_ids(v.split_ids), docs.select(F.col("doc_id").alias("image_id"), "source"))


@query("SELECT DISTINCT regexp_extract(url, '://([^/]+)/', 1) AS image_id FROM pages WHERE regexp_extract(url, '://([^/]+)/', 1) <> ''")
def path_ids(v):
    return rep.ids_of_paths(v.spark.read.parquet(f"{v.sf_dir}/pages.parquet"), "url", "://([^/]+)/")
