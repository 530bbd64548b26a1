"""Queries of peak strategies, decoded proposals, verdicts, splits by strategy and sweeps, beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions.geometry import affine_hull
from lodestone.operators import hough, peaks, splits, store, training
from lodestone.operators import proposals as prop
from lodestone.plans import sweeps
from lodestone.queries.base import query
from lodestone.queries.geometry import nms_sql
from lodestone.queries.vectors import VEC, cos

FLOOR, SIDE_W, SIDE_H = 75.0, 6, 4
RANKED = "c AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY v DESC, y, x) AS pid FROM ({source}))"
FIRST = "SELECT image_id, y, x, round(v, 6) AS v FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY v DESC, y, x) AS k FROM found) q WHERE k <= 50"
TOP = "(SELECT max({v}) FROM {t} o WHERE o.image_id = m.image_id AND abs(o.y - m.y) <= 1 AND abs(o.x - m.x) <= 1)"
D2 = f"""(SELECT m.image_id, m.y, m.x, m.v, CASE WHEN m.v > {FLOOR} THEN coalesce(min((m.y - b.y) * (m.y - b.y) + (m.x - b.x) * (m.x - b.x)), 1099511627776) ELSE 0 END AS d2
  FROM peak_maps m LEFT JOIN peak_maps b ON b.image_id = m.image_id AND b.v <= {FLOOR} GROUP BY m.image_id, m.y, m.x, m.v)"""


@query(f"SELECT image_id, y, x, CAST(d2 AS BIGINT) AS d2 FROM {D2} q")
def background_distance(v):
    return peaks.background_distance(v.peak_maps, FLOOR).select("image_id", "y", "x", "d2")


NMS_SOURCE = f"SELECT image_id, pid, greatest(x - {SIDE_W // 2}, 0) AS x, greatest(y - {SIDE_H // 2}, 0) AS y, {SIDE_W} AS w, {SIDE_H} AS h, -CAST(pid AS DOUBLE) AS score FROM c"


@query("WITH " + nms_sql(NMS_SOURCE, 0.3).replace("RECURSIVE ", "RECURSIVE " + RANKED.replace("{source}", f"SELECT * FROM peak_maps WHERE v > {FLOOR}") + ", ", 1) + f", found AS (SELECT c.image_id, c.y, c.x, c.v FROM c JOIN kept k ON k.image_id = c.image_id AND k.pid = c.pid) {FIRST}")
def extract_peaks_nms(v):
    return peaks.extract(v.peak_maps, "nms", SIDE_W, SIDE_H, FLOOR)


@query(f"""WITH RECURSIVE {RANKED.replace("{source}", f"SELECT * FROM peak_maps m WHERE v > {FLOOR} AND v = " + TOP.replace("{v}", "o.v").replace("{t}", "peak_maps"))}, walk AS (
  SELECT image_id, pid, [{{'y': y, 'x': x, 'v': v}}] AS kept FROM c WHERE pid = 1
  UNION ALL SELECT c.image_id, c.pid, CASE WHEN len(list_filter(w.kept, lambda k: (k.x - c.x) * (k.x - c.x) + (k.y - c.y) * (k.y - c.y) < 1)) > 0 THEN w.kept ELSE list_append(w.kept, {{'y': c.y, 'x': c.x, 'v': c.v}}) END
  FROM walk w JOIN c ON c.image_id = w.image_id AND c.pid = w.pid + 1
), u AS (SELECT image_id, unnest(arg_max(kept, pid)) AS b FROM walk GROUP BY image_id), found AS (SELECT image_id, b.y AS y, b.x AS x, b.v AS v FROM u) {FIRST}""")
def extract_peaks_local_max(v):
    return peaks.extract(v.peak_maps, "local-max", SIDE_W, SIDE_H, FLOOR)


@query(f"""WITH RECURSIVE d AS {D2}, m AS (SELECT * FROM d m WHERE v > {FLOOR} AND d2 = {TOP.replace("{v}", "o.d2").replace("{t}", "d")}),
reach AS (SELECT image_id, y, x, y AS ty, x AS tx FROM m UNION SELECT r.image_id, r.y, r.x, n.y, n.x FROM reach r JOIN m n ON n.image_id = r.image_id AND abs(n.y - r.ty) + abs(n.x - r.tx) = 1),
l AS (SELECT image_id, y, x, min((ty, tx)) AS label FROM reach GROUP BY 1, 2, 3), b AS (SELECT m.*, row_number() OVER (PARTITION BY m.image_id, label ORDER BY v DESC, m.y, m.x) AS k FROM m JOIN l USING (image_id, y, x)),
found AS (SELECT image_id, y, x, v FROM b WHERE k = 1) {FIRST}""")
def extract_peaks_watershed(v):
    return peaks.extract(v.peak_maps, "watershed", SIDE_W, SIDE_H, FLOOR)


@query("""WITH i AS (SELECT image_id, least(70, greatest(1, CAST(round_even(width * (70.0 / greatest(width, height)), 0) AS INT))) AS cw, least(70, greatest(1, CAST(round_even(height * (70.0 / greatest(width, height)), 0) AS INT))) AS ch FROM coco_images)
SELECT image_id, CAST(k // 5 AS BIGINT) AS gy, CAST(k % 5 AS BIGINT) AS gx, k % 5 * 14 + 7 < cw AND k // 5 * 14 + 7 < ch AS content FROM i, (SELECT unnest(range(25)) AS k)""")
def content_tokens(v):
    return peaks.content_tokens(v.coco_images, 70)


ANCHORS = "SELECT image_id, idx AS pid, CAST(x + 0.25 AS DOUBLE) AS x, CAST(y + 0.25 AS DOUBLE) AS y, CAST(w AS DOUBLE) AS w, CAST(h AS DOUBLE) AS h, score FROM boxes WHERE score > 0.02"


@query("WITH " + nms_sql(ANCHORS, 0.4) + f""", s AS (SELECT a.*, row_number() OVER (PARTITION BY a.image_id ORDER BY a.score DESC, a.y, a.x, a.pid) AS k FROM ({ANCHORS}) a JOIN kept q ON q.image_id = a.image_id AND q.pid = a.pid),
e AS (SELECT image_id, pid, score, CAST(least(greatest(round_even((x - 10) / 0.5, 0), 0), 400) AS INT) AS x, CAST(least(greatest(round_even((y - 5) / 0.5, 0), 0), 380) AS INT) AS y, CAST(least(greatest(round_even((x + w - 10) / 0.5, 0), 0), 400) AS INT) AS x2, CAST(least(greatest(round_even((y + h - 5) / 0.5, 0), 0), 380) AS INT) AS y2 FROM s WHERE k <= 4)
SELECT image_id, pid, x, y, x2 - x AS w, y2 - y AS h, score FROM e WHERE x2 - x >= 1 AND y2 - y >= 1""")
def decoded_proposals(v):
    b = v.boxes
    half = lambda c, side: (F.col(c) + 0.25 + F.col(side) / 2).alias("c" + c)
    anchors = b.select("image_id", F.col("idx").alias("pid"), half("x", "w"), half("y", "h"), F.col("w").cast("double").alias("w"), F.col("h").cast("double").alias("h"), "score")
    fit = F.struct(F.lit(0.5).alias("scale"), F.lit(10.0).alias("pad_x"), F.lit(5.0).alias("pad_y"))
    return prop.decoded(anchors, fit, F.lit(400), F.lit(380), 0.02, 0.4, 4)


SPAN = "((b.x <= 250 * 0.02 AND b.x + b.w >= 250 - 250 * 0.02) OR (b.y <= 240 * 0.02 AND b.y + b.h >= 240 - 240 * 0.02))"
SUBJECT = f"""b AS (SELECT image_id, pid, x, y, w, h, score * 8 AS score FROM pred_boxes), s AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY {SPAN}, round(CAST(w AS DOUBLE) * h * (1 - sqrt(pow(x + w / 2 - 125, 2) + pow(y + h / 2 - 120, 2)) / sqrt(CAST(250 * 250 + 240 * 240 AS DOUBLE))) * pow(score, 3), 9) DESC, pid) AS k FROM b)"""


def wide(v):
    return v.pred_boxes.withColumn("score", F.col("score") * 8)


@query(f"WITH {SUBJECT} SELECT image_id, pid, x, y, w, h FROM s WHERE k = 1")
def subject_proposals(v):
    return prop.subjects(wide(v), 250, 240).select("image_id", "pid", "x", "y", "w", "h")


OVER = "greatest(least(b.x + b.w, t.x + t.w) - greatest(b.x, t.x), 0) * CAST(greatest(least(b.y + b.h, t.y + t.h) - greatest(b.y, t.y), 0) AS DOUBLE)"


@query(f"""WITH {SUBJECT}, t AS (SELECT * FROM s WHERE k = 1) SELECT b.image_id, b.pid FROM b JOIN t ON t.image_id = b.image_id WHERE b.pid <> t.pid AND b.score >= 0.5 AND NOT {SPAN} AND b.w * b.h <= t.w * t.h * 2 AND {OVER} <= CAST(0.15 AS DOUBLE) * least(b.w * b.h, t.w * t.h)
AND sqrt(pow(greatest(b.x - (t.x + t.w), t.x - (b.x + b.w), 0), 2) + pow(greatest(b.y - (t.y + t.h), t.y - (b.y + b.h), 0), 2)) <= CAST(0.03 AS DOUBLE) * sqrt(CAST(250 * 250 + 240 * 240 AS DOUBLE))""")
def merge_partners(v):
    return prop.merge_partners(prop.subjects(wide(v), 250, 240), wide(v), 250, 240)


@query("""WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY idx) AS k FROM boxes), walk AS (SELECT image_id, k, [{'idx': idx, 'x': x, 'y': y, 'w': w, 'h': h}] AS kept FROM r WHERE k = 1
UNION ALL SELECT r.image_id, r.k, CASE WHEN len(list_filter(q.kept, lambda b: NOT (r.x + r.w + 3 <= b.x OR b.x + b.w + 3 <= r.x OR r.y + r.h + 3 <= b.y OR b.y + b.h + 3 <= r.y))) > 0 THEN q.kept ELSE list_append(q.kept, {'idx': r.idx, 'x': r.x, 'y': r.y, 'w': r.w, 'h': r.h}) END
FROM walk q JOIN r ON r.image_id = q.image_id AND r.k = q.k + 1), f AS (SELECT image_id, unnest(arg_max(kept, k)) AS b FROM walk GROUP BY image_id) SELECT image_id, b.idx AS idx, b.x AS x, b.y AS y, b.w AS w, b.h AS h FROM f""")
def placements(v):
    return prop.placed(v.boxes, 3, "idx")


@query("""WITH m AS (SELECT image_id, vid, 3 + vid % 4 AS inliers, scene_x - 100 AS tx, scene_y - 80 AS ty, CASE WHEN vid % 3 = 0 THEN -1 ELSE 1 END AS turn, (vid % 6 + 1) AS s FROM votes), b AS (SELECT *, least(tx, tx + s * 20) AS x1, greatest(tx, tx + s * 20) AS x2, least(ty, ty + turn * s * 20) AS y1, greatest(ty, ty + turn * s * 20) AS y2 FROM m)
SELECT image_id, vid, CASE WHEN least(x2, 60) > greatest(x1, 0) AND least(y2, 50) > greatest(y1, 0) THEN CASE WHEN turn > 0 AND s <= 5 AND inliers >= 5 THEN 'instance' ELSE 'candidate' END END AS verdict FROM b""")
def peak_verdicts(v):
    scale = (F.col("vid") % 6 + 1).cast("double")
    rows = v.votes.select("image_id", "vid", scale.alias("a"), F.lit(0.0).alias("b"), (F.col("scene_x") - 100).alias("tx"), (F.col("scene_y") - 80).alias("ty"), (F.col("vid") % 3 == 0).alias("mirrored"), (3 + F.col("vid") % 4).alias("inliers"))
    m = hough.similarity_matrix()
    boxed = affine_hull(m, F.lit(20.0), F.lit(20.0), F.lit(60), F.lit(50))
    return rows.select("image_id", "vid", hough.verdict(m, F.col("inliers"), boxed, 5).alias("verdict"))


@query("SELECT m.method, row_number() OVER (ORDER BY coalesce(w.low, -1) DESC, m.method) AS rank, eligible AS sweep_eligible, n - eligible AS sweep_excluded FROM (SELECT method, count(*) AS n, count(*) FILTER (WHERE t.verdicts_confirmed AND EXISTS (SELECT 1 FROM match_verdicts q WHERE q.rating_id = t.rating_id)) AS eligible FROM runs LEFT JOIN ratings t USING (run_id) GROUP BY method) m JOIN (SELECT method, (s / n + 1.9599639845400545 * 1.9599639845400545 / (2 * n) - 1.9599639845400545 * sqrt(s / n * (1 - s / n) / n + 1.9599639845400545 * 1.9599639845400545 / (4 * n * n))) / (1 + 1.9599639845400545 * 1.9599639845400545 / n) AS low FROM (SELECT method, CAST(count(*) FILTER (WHERE thumbs_up) AS DOUBLE) AS s, CAST(count(thumbs_up) AS DOUBLE) AS n FROM runs LEFT JOIN ratings USING (run_id) GROUP BY method)) w ON w.method = m.method")
def scoreboard_sweep(v):
    return store.sweep_ranks(store.scoreboard(v.runs, v.ratings, v.match_verdicts), store.run_fp(v.runs, v.ratings, v.match_verdicts))


@query(f"WITH {VEC}, a AS (SELECT CAST(id // 32 AS BIGINT) AS batch, id, v FROM e), p AS (SELECT x.batch, {cos('x.v', 'y.v')} AS c FROM a x JOIN a y ON y.batch = x.batch WHERE x.id % 4 <> 0 AND y.id % 4 = 0) SELECT batch, round(avg(c), 6) AS background FROM p GROUP BY batch")
def background_cosine(v):
    rows = v.vectors.select(F.floor(F.col("vec_id") / 32).alias("batch"), (F.col("vec_id") % 4 == 0).alias("outside"), F.col("embedding").alias("v"))
    return training.background_mean(rows.where("NOT outside"), rows.where("outside"), "batch")


@query("""WITH c AS (SELECT CAST(k AS BIGINT) AS cell, (k % 8 + 0.5) * 32 AS px, (floor(k / 8) + 0.5) * 32 AS py FROM (SELECT unnest(range(0, 64)) AS k)), i AS (SELECT DISTINCT image_id FROM gt_boxes),
o AS (SELECT image_id, cell, row_number() OVER (PARTITION BY image_id ORDER BY md5('4-' || CAST(image_id AS VARCHAR) || '-' || CAST(cell AS VARCHAR)), cell) AS k FROM i, c WHERE NOT EXISTS (SELECT 1 FROM gt_boxes b WHERE b.image_id = i.image_id AND px BETWEEN b.x AND b.x + b.w AND py BETWEEN b.y AND b.y + b.h)) SELECT image_id, cell FROM o WHERE k <= 10""")
def background_sample(v):
    return training.sampled_cells(training.background_cells(v.spark, v.gt_boxes, 8, 256.0), 10, 4)


STRATEGY_ROWS = "d AS (SELECT DISTINCT CASE image_id % 3 WHEN 0 THEN 'own' WHEN 1 THEN 'carved' ELSE 'held' END AS dataset, image_id, split FROM split_ids)"


@query(f"""WITH {STRATEGY_ROWS}, c AS (SELECT dataset, image_id, row_number() OVER (ORDER BY md5('6-' || CAST(image_id AS VARCHAR)), image_id) AS k, count(*) OVER () AS n FROM d WHERE dataset = 'carved' AND split = 'train')
SELECT dataset, image_id, split FROM d WHERE split = 'test' OR dataset = 'own' UNION ALL SELECT dataset, image_id, CASE WHEN k <= round_even(n * 0.2, 0) THEN 'val' ELSE 'train' END FROM c""")
def splits_by_strategy(v):
    name = F.when(F.col("image_id") % 3 == 0, "own").when(F.col("image_id") % 3 == 1, "carved").otherwise("held")
    return splits.by_strategy(v.split_ids.withColumn("dataset", name), {"own": "native", "held": "test-only"}, 0.2, 6)


@query("SELECT row_number() OVER (ORDER BY a, b, c) - 1 AS trial, threshold, nms_iou, kernel FROM (SELECT unnest([0.5, 0.7, 0.9]) AS threshold, unnest([0, 1, 2]) AS a), (SELECT unnest([0.1, 0.3]) AS nms_iou, unnest([0, 1]) AS b), (SELECT unnest(['ncc', 'mosse']) AS kernel, unnest([0, 1]) AS c)")
def sweep_grid(v):
    return sweeps.grid(v.spark, {"threshold": [0.5, 0.7, 0.9], "nms_iou": [0.1, 0.3], "kernel": ["ncc", "mosse"]})


@query("WITH c AS (SELECT method, outcome, count(*) AS n FROM runs GROUP BY 1, 2), m AS (SELECT method, map(list(outcome ORDER BY outcome), list(n ORDER BY outcome)) AS m FROM c GROUP BY method) SELECT method, array_to_string(map_keys(m), ',') AS outcomes, coalesce(m['ok'], 0) AS ok, coalesce(m['none'], 0) AS absent, cardinality(m) AS kinds FROM m")
def outcome_maps(v):
    each = v.runs.groupBy("method", "outcome").agg(F.count("*").alias("n"))
    m = each.groupBy("method").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("outcome", "n")))).alias("m"))
    count = lambda k: F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(0))
    return m.select("method", F.array_join(F.map_keys("m"), ",").alias("outcomes"), count("ok").alias("ok"), count("none").alias("absent"), F.size("m").cast("bigint").alias("kinds"))


@query()
def detection_assignment(v):
    """Held against all permutations in the tests, as SQL has no form for an assignment."""
    box = [(F.col("x") + F.col("w") / 2).alias("cx"), (F.col("y") + F.col("h") / 2).alias("cy"), F.col("w").cast("double").alias("w"), F.col("h").cast("double").alias("h")]
    preds = v.pred_boxes.select("image_id", "pid", F.array(F.col("score") * 10, 1 - F.col("score")).alias("logits"), *box)
    truths = v.gt_boxes.select("image_id", "gid", (F.col("gid") % 2).cast("int").alias("label"), *box)
    return training.cheapest_pairs(training.detection_costs(preds, truths))
