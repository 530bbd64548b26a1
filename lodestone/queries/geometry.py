"""Geometry, suppression and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import folds
from lodestone.functions import geometry as g
from lodestone.operators import evaluation as ev
from lodestone.queries.base import query

IOU = "CASE WHEN least({a}.x + {a}.w, {b}.x + {b}.w) > greatest({a}.x, {b}.x) AND least({a}.y + {a}.h, {b}.y + {b}.h) > greatest({a}.y, {b}.y) THEN CAST(least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x) AS DOUBLE) * (least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y)) / (CAST({a}.w AS DOUBLE) * {a}.h + CAST({b}.w AS DOUBLE) * {b}.h - CAST(least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x) AS DOUBLE) * (least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y))) ELSE 0.0 END"


def iou_sql(a: str, b: str) -> str:
    return IOU.replace("{a}", a).replace("{b}", b)


# greedy suppression over a ranked table r(image_id, k, x, y, w, h, pid, ...), k from 1: kept pids in a list of structs
def nms_sql(source: str, threshold: float) -> str:
    return f"""RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, y, x, pid) AS k FROM ({source})), walk AS (
  SELECT image_id, k, [{{'x': x, 'y': y, 'w': w, 'h': h, 'pid': pid}}] AS kept FROM r WHERE k = 1
  UNION ALL SELECT r.image_id, r.k, CASE WHEN len(list_filter(walk.kept, lambda b: ({iou_sql('b', 'r')}) > {threshold})) > 0 THEN walk.kept ELSE list_append(walk.kept, {{'x': r.x, 'y': r.y, 'w': r.w, 'h': r.h, 'pid': r.pid}}) END
  FROM walk JOIN r ON r.image_id = walk.image_id AND r.k = walk.k + 1
), final AS (SELECT image_id, unnest(arg_max(kept, k)) AS b FROM walk GROUP BY image_id), kept AS (SELECT image_id, b.pid AS pid, b.x AS x, b.y AS y, b.w AS w, b.h AS h FROM final)"""


# greedy matching: walks an image's predictions in order, carrying the truths taken so far; -1 for none
MATCH = """r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, y, x, pid) AS k FROM pred_boxes),
o AS (SELECT r.image_id, r.k, g.gid, {iou} AS o FROM r JOIN gt_boxes g ON g.image_id = r.image_id),
opts AS (SELECT image_id, k, list({{'gid': gid, 'o': o}} ORDER BY o DESC, gid) AS c FROM o WHERE o >= {t} GROUP BY image_id, k),
ranked AS (SELECT r.image_id, r.k, r.pid, coalesce(opts.c, []) AS c FROM r LEFT JOIN opts ON opts.image_id = r.image_id AND opts.k = r.k),
walk AS (
  SELECT image_id, k, pid, CASE WHEN len(c) > 0 THEN [CAST(c[1].gid AS BIGINT)] ELSE CAST([-1] AS BIGINT[]) END AS taken FROM ranked WHERE k = 1
  UNION ALL SELECT n.image_id, n.k, n.pid, list_append(w.taken, CAST(coalesce(list_filter(n.c, lambda z: NOT list_contains(w.taken, CAST(z.gid AS BIGINT)))[1].gid, -1) AS BIGINT)) FROM walk w JOIN ranked n ON n.image_id = w.image_id AND n.k = w.k + 1
), flags AS (SELECT image_id, k, pid, taken[-1] AS gid FROM walk)"""


def match(t: float) -> str:
    return MATCH.format(iou=iou_sql("r", "g"), t=t)


@query("SELECT image_id, idx, x + w AS x2, y + h AS y2, x + w / 2.0 AS cx, y + h / 2.0 AS cy, CAST(w AS BIGINT) * h AS area FROM boxes")
def box_geometry(v):
    b = v.boxes
    return b.select("image_id", "idx", *[e.alias(k) for k, e in g.derived(g.box()).items()])


@query(f"SELECT a.image_id, a.gid AS a, b.gid AS b, round({iou_sql('a', 'b')}, 6) AS iou FROM gt_boxes a JOIN gt_boxes b ON a.image_id = b.image_id AND a.gid < b.gid")
def iou_pairs(v):
    a = v.gt_boxes.select("image_id", F.col("gid").alias("a"), g.box().alias("ba"))
    b = v.gt_boxes.select("image_id", F.col("gid").alias("b"), g.box().alias("bb"))
    return a.join(b, "image_id").where("a < b").select("image_id", "a", "b", g.iou(F.col("ba"), F.col("bb")).alias("iou"))


@query(f"""WITH p AS (SELECT a.image_id, a.gid AS a, b.gid AS b, {iou_sql('a', 'b')} AS o, CAST(a.w AS DOUBLE) * a.h + CAST(b.w AS DOUBLE) * b.h AS s, CAST(greatest(a.x + a.w, b.x + b.w) - least(a.x, b.x) AS DOUBLE) * (greatest(a.y + a.h, b.y + b.h) - least(a.y, b.y)) AS hull FROM gt_boxes a JOIN gt_boxes b ON a.image_id = b.image_id AND a.gid < b.gid)
SELECT image_id, a, b, round(o - (hull - s / (1 + o)) / hull, 6) AS giou FROM p""")
def giou_pairs(v):
    a = v.gt_boxes.select("image_id", F.col("gid").alias("a"), g.box().alias("ba"))
    b = v.gt_boxes.select("image_id", F.col("gid").alias("b"), g.box().alias("bb"))
    return a.join(b, "image_id").where("a < b").select("image_id", "a", "b", g.giou(F.col("ba"), F.col("bb")).alias("giou"))


@query("""WITH c AS (SELECT image_id, idx, greatest(x - 10, 0) AS cx, greatest(y - 10, 0) AS cy, least(x - 10 + w, 150) AS x2, least(y - 10 + h, 120) AS y2 FROM boxes)
SELECT image_id, idx, cx AS x, cy AS y, x2 - cx AS w, y2 - cy AS h FROM c WHERE x2 - cx >= 1 AND y2 - cy >= 1""")
def clip_boxes(v):
    moved = g.box(x=F.col("x") - 10, y=F.col("y") - 10)
    return v.boxes.select("image_id", "idx", g.clip(moved, F.lit(150), F.lit(120)).alias("b")).where("b IS NOT NULL").select("image_id", "idx", "b.*")


@query("""WITH m AS (SELECT image_id, idx, x, y, w, h, CAST(round_even(w * 0.15, 0) AS INT) AS mx, CAST(round_even(h * 0.15, 0) AS INT) AS my FROM boxes)
SELECT image_id, idx, greatest(x - mx, 0) AS x, greatest(y - my, 0) AS y, least(x + w + mx, 230) - greatest(x - mx, 0) AS w, least(y + h + my, 230) - greatest(y - my, 0) AS h FROM m""")
def expand_boxes(v):
    return v.boxes.select("image_id", "idx", g.expand(g.box(), 0.15, F.lit(230), F.lit(230)).alias("b")).select("image_id", "idx", "b.*")


@query("""WITH xs AS (SELECT image_id, width, height, unnest(list_sort(list_distinct(list_append(generate_series(0, greatest(width - 256, 0), 204), greatest(width - 256, 0))))) AS x FROM coco_images)
SELECT image_id, x, unnest(list_sort(list_distinct(list_append(generate_series(0, greatest(height - 256, 0), 204), greatest(height - 256, 0))))) AS y, least(256, width) AS w, least(256, height) AS h FROM xs""")
def tile_grid(v):
    return v.coco_images.select("image_id", F.explode(g.tiles(F.col("width"), F.col("height"), 256, 0.2)).alias("t")).select("image_id", "t.*")


@query("""WITH f AS (SELECT image_id, width, height, least(960.0 / width, 960.0 / height) AS s FROM coco_images)
SELECT image_id, round(s, 6) AS scale, round((960 - width * s) / 2, 6) AS pad_x, round((960 - height * s) / 2, 6) AS pad_y, round((480 - (960 - width * s) / 2) / s, 6) AS x, round((480 - (960 - height * s) / 2) / s, 6) AS y FROM f""")
def letterbox_inverse(v):
    d = v.coco_images.withColumn("fit", g.letterbox(F.col("width"), F.col("height"), 960))
    return d.select("image_id", "fit.*", g.from_letterbox(F.lit(480.0), F.lit(480.0), F.col("fit")).alias("p")).select("image_id", "scale", "pad_x", "pad_y", "p.x", "p.y")


@query("""WITH c AS (SELECT ann_id, x / 640 AS cx, y / 640 AS cy, w / 640 AS cw, h / 640 AS ch FROM annotations), p AS (
  SELECT ann_id, CAST(least(greatest(round_even((cx - cw / 2) * 640, 0), 0), 600) AS INT) AS x1, CAST(least(greatest(round_even((cy - ch / 2) * 640, 0), 0), 400) AS INT) AS y1, CAST(least(greatest(round_even((cx + cw / 2) * 640, 0), 0), 600) AS INT) AS x2, CAST(least(greatest(round_even((cy + ch / 2) * 640, 0), 0), 400) AS INT) AS y2 FROM c)
SELECT ann_id, x1 AS x, y1 AS y, x2 - x1 AS w, y2 - y1 AS h FROM p WHERE x2 - x1 >= 1 AND y2 - y1 >= 1""")
def cxcywh_boxes(v):
    side = 640
    px = g.pixels(F.col("x") / side, F.col("y") / side, F.col("w") / side, F.col("h") / side, F.lit(side), F.lit(600), F.lit(400))
    return v.annotations.select("ann_id", px.alias("b")).where("b IS NOT NULL").select("ann_id", "b.*")


@query("SELECT ann_id, least(x, x + w, x - h) AS x, least(y, y + h, y + w) AS y, greatest(x, x + w, x - h) - least(x, x + w, x - h) AS w, greatest(y, y + h, y + w) - least(y, y + h, y + w) AS h FROM annotations")
def polygon_bbox(v):
    p = F.array(F.array("x", "y"), F.array(F.col("x") + F.col("w"), F.col("y") + F.col("h")), F.array(F.col("x") - F.col("h"), F.col("y") + F.col("w")))
    return v.annotations.select("ann_id", g.hull(p).alias("b")).select("ann_id", "b.*")


@query("""SELECT run_id, CASE WHEN image_id % 3 > 0 AND retrieved > 0 AND retrieved * 1.0 / (image_id % 3) > 1.5 THEN 'varied' ELSE 'fixed' END AS scale_bucket,
  CASE WHEN instance_count IS NULL THEN NULL WHEN instance_count <= 1 THEN '1' WHEN instance_count <= 5 THEN '2-5' WHEN instance_count <= 15 THEN '6-15' ELSE '16+' END AS crowding,
  CASE canvas_size WHEN '640x480' THEN 'small' WHEN '1280x720' THEN 'medium' WHEN '6000x4000' THEN 'large' END AS resolution,
  CASE image_id % 4 WHEN 0 THEN 'EASY' WHEN 1 THEN 'TEXTURED' WHEN 2 THEN 'VARIED' END AS regime FROM image_results JOIN (SELECT run_id AS rid, retrieved FROM runs) q ON rid = run_id""")
def buckets(v):
    d = v.image_results.join(v.runs.select("run_id", "retrieved"), "run_id")
    name = F.concat(F.element_at(F.array(F.lit("chipset-"), F.lit("textured-"), F.lit("varied-"), F.lit("other-")), (F.col("image_id") % 4 + 1).cast("int")), F.col("image_id").cast("string"))
    return d.select("run_id", g.scale_bucket((F.col("image_id") % 3).cast("double"), F.col("retrieved").cast("double")).alias("scale_bucket"), g.crowding_bucket(F.col("instance_count")).alias("crowding"), g.resolution_bucket(F.col("canvas_size")).alias("resolution"), g.regime(name).alias("regime"))


@query("SELECT image_id, gid, CASE WHEN CAST(w AS BIGINT) * h / 160000.0 < 0.004 THEN 'small' WHEN CAST(w AS BIGINT) * h / 160000.0 < 0.016 THEN 'medium' ELSE 'large' END AS bucket FROM gt_boxes")
def size_buckets(v):
    return v.gt_boxes.select("image_id", "gid", g.size_bucket(F.col("w").cast("bigint") * F.col("h"), F.lit(160000.0)).alias("bucket"))


@query("WITH " + nms_sql("SELECT image_id, pid, x, y, w, h, score FROM pred_boxes", 0.3) + " SELECT image_id, pid FROM kept")
def nms(v):
    return folds.nms(v.pred_boxes, ["image_id"], 0.3).select("image_id", "pid")


@query("WITH " + nms_sql("SELECT image_id, pid * 2 AS pid, x, y, w, h, score FROM pred_boxes UNION ALL SELECT image_id, gid * 2 + 1, x, y, w, h, CAST(0.05 AS DOUBLE) FROM gt_boxes", 0.5) + " SELECT image_id, pid FROM kept")
def fusion_dedupe(v):
    return ev.fuse([v.pred_boxes, v.gt_boxes.select("image_id", F.col("gid").alias("pid"), "x", "y", "w", "h", F.lit(0.05).alias("score"))]).select("image_id", "pid")


@query(f"SELECT p.image_id, p.pid FROM pred_boxes p WHERE NOT EXISTS (SELECT 1 FROM gt_boxes k WHERE k.image_id = p.image_id AND ({iou_sql('p', 'k')}) >= 0.3)")
def non_overlapping_candidates(v):
    return ev.apart_from(v.pred_boxes, v.gt_boxes, 0.3).select("image_id", "pid")


@query("SELECT run_id, CAST(idx AS BIGINT) AS k, score, true AS accepted FROM matches UNION ALL SELECT run_id, CAST(rnk AS BIGINT), score, false FROM candidates")
def candidate_log(v):
    m = v.matches.select("run_id", F.col("idx").cast("bigint").alias("k"), F.col("score").cast("double").alias("score"), F.lit(True).alias("accepted"))
    return m.unionByName(v.candidates.select("run_id", F.col("rnk").cast("bigint").alias("k"), F.col("score").cast("double").alias("score"), F.lit(False).alias("accepted")))


@query(f"""WITH RECURSIVE {match(0.5)}, n AS (SELECT image_id, count(*) FILTER (WHERE gid >= 0) AS tp, count(*) AS p FROM flags GROUP BY image_id), t AS (SELECT image_id, count(*) AS g FROM gt_boxes GROUP BY image_id)
SELECT coalesce(n.image_id, t.image_id) AS image_id, coalesce(tp, 0) AS tp, coalesce(p, 0) - coalesce(tp, 0) AS fp, coalesce(g, 0) - coalesce(tp, 0) AS fn FROM n FULL JOIN t ON n.image_id = t.image_id""")
def match_counts(v):
    return ev.match_counts(v.pred_boxes, v.gt_boxes)


@query(f"WITH RECURSIVE {match(0.75)} SELECT image_id, pid, CASE WHEN gid >= 0 THEN gid END AS gid FROM flags")
def match_flags(v):
    return ev.match_flags(v.pred_boxes, v.gt_boxes, 0.75)


@query(f"""WITH RECURSIVE {match(0.5)} SELECT image_id, CASE WHEN gid >= 0 THEN 'TP' ELSE 'FP' END AS kind, CAST(pid AS BIGINT) AS id FROM flags
UNION ALL SELECT t.image_id, 'FN', CAST(t.gid AS BIGINT) FROM gt_boxes t WHERE NOT EXISTS (SELECT 1 FROM flags f WHERE f.image_id = t.image_id AND f.gid = t.gid)""")
def overlay_labels(v):
    return ev.labelled_overlay(v.pred_boxes, v.gt_boxes)


PRF = f"""{match(0.5)}, n AS (SELECT image_id, count(*) FILTER (WHERE gid >= 0) AS tp, count(*) AS p FROM flags GROUP BY image_id), t AS (SELECT image_id, count(*) AS g FROM gt_boxes GROUP BY image_id),
c AS (SELECT coalesce(n.image_id, t.image_id) AS image_id, CAST(coalesce(tp, 0) AS DOUBLE) AS tp, coalesce(p, 0) - coalesce(tp, 0) AS fp, coalesce(g, 0) - coalesce(tp, 0) AS fn FROM n FULL JOIN t ON n.image_id = t.image_id)"""


@query(f"""WITH RECURSIVE {PRF}, q AS (SELECT *, tp / nullif(tp + fp, 0) AS p, tp / nullif(tp + fn, 0) AS r FROM c)
SELECT image_id, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / nullif(p + r, 0), 6) AS f1_strict, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1_dice FROM q""")
def prf_per_image(v):
    return ev.prf(ev.match_counts(v.pred_boxes, v.gt_boxes)).select("image_id", "precision", "recall", "f1_strict", "f1_dice")


CURVE = """n AS (SELECT image_id, count(*) AS n_gt FROM gt_boxes GROUP BY image_id), c AS (
  SELECT f.image_id, f.k AS rank, sum(CASE WHEN gid >= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY f.image_id ORDER BY f.k) AS tp, n_gt FROM flags f JOIN n ON n.image_id = f.image_id),
d AS (SELECT image_id, rank, CAST(tp AS BIGINT) AS tp, tp / CAST(rank AS DOUBLE) AS p, tp / CAST(n_gt AS DOUBLE) AS r FROM c),
curve AS (SELECT *, max(p) OVER (PARTITION BY image_id ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env, r - coalesce(lag(r) OVER (PARTITION BY image_id ORDER BY rank), 0) AS step FROM d)"""


@query(f"WITH RECURSIVE {match(0.5)}, {CURVE} SELECT image_id, rank, tp, round(p, 6) AS precision, round(r, 6) AS recall, round(env, 6) AS envelope, round(step, 6) AS step FROM curve")
def pr_curve(v):
    return ev.pr_curve(v.pred_boxes, v.gt_boxes)


@query(f"WITH RECURSIVE {match(0.5)}, {CURVE}, a AS (SELECT image_id, sum(step * env) AS ap FROM curve GROUP BY image_id) SELECT n.image_id, round(coalesce(ap, 0.0), 6) AS ap FROM n LEFT JOIN a ON a.image_id = n.image_id")
def average_precision(v):
    return ev.average_precision(v.pred_boxes, v.gt_boxes)


COCO_R = match(0.5).replace("FROM pred_boxes)", "FROM pred_boxes), ts AS (SELECT unnest(generate_series(50, 95, 5)) / 100.0 AS t)").replace("SELECT image_id, k, list(", "SELECT image_id, t, k, list(").replace("FROM o WHERE o >= 0.5 GROUP BY image_id, k", "FROM o JOIN ts ON o >= t GROUP BY image_id, t, k").replace("SELECT r.image_id, r.k, r.pid, coalesce(opts.c, []) AS c FROM r LEFT JOIN opts ON", "SELECT r.image_id, ts.t, r.k, r.pid, coalesce(opts.c, []) AS c FROM r CROSS JOIN ts LEFT JOIN opts ON opts.t = ts.t AND").replace("SELECT image_id, k, pid, CASE", "SELECT image_id, t, k, pid, CASE").replace("SELECT n.image_id, n.k, n.pid, list_append", "SELECT n.image_id, n.t, n.k, n.pid, list_append").replace("ON n.image_id = w.image_id AND n.k = w.k + 1", "ON n.image_id = w.image_id AND n.t = w.t AND n.k = w.k + 1").replace("SELECT image_id, k, pid, taken[-1] AS gid FROM walk", "SELECT image_id, t, k, pid, taken[-1] AS gid FROM walk")


@query(f"""WITH RECURSIVE {COCO_R}, n AS (SELECT image_id, count(*) AS n_gt FROM gt_boxes GROUP BY image_id), c AS (SELECT image_id, t, k, gid >= 0 AS hit, sum(CASE WHEN gid >= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY image_id, t ORDER BY k) / CAST(k AS DOUBLE) AS p FROM flags),
e AS (SELECT image_id, t, hit, max(p) OVER (PARTITION BY image_id, t ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env FROM c), a AS (SELECT n.image_id, ts.t, coalesce(sum(CASE WHEN hit THEN env / n_gt ELSE 0 END), 0) AS ap FROM n CROSS JOIN ts LEFT JOIN e ON e.image_id = n.image_id AND e.t = ts.t GROUP BY 1, 2)
SELECT image_id, round(avg(ap), 6) AS ap, round(max(CASE WHEN t = 0.5 THEN ap END), 6) AS ap50, round(max(CASE WHEN t = 0.75 THEN ap END), 6) AS ap75 FROM a GROUP BY image_id""")
def coco_ap(v):
    return ev.coco_ap(v.pred_boxes, v.gt_boxes)


@query(f"""WITH o AS (SELECT m.run_id, m.idx, {iou_sql('m', 'e')} AS o FROM matches m JOIN (SELECT run_id, x + 2 AS x, y, w, h FROM matches WHERE is_exemplar) e ON e.run_id = m.run_id)
SELECT run_id, arg_max(idx, (o, idx)) AS idx, round(max(o), 6) AS iou FROM o WHERE o >= 0.5 GROUP BY run_id""")
def exemplar_self_match(v):
    m = v.matches
    return ev.exemplar_match(m, m.where("is_exemplar").withColumn("x", F.col("x") + 2))


@query("""SELECT dataset, method, round(avg(abs(d)), 6) AS mae, round(sqrt(avg(d * d)), 6) AS rmse, round(coalesce(avg(CASE WHEN true_count > 0 THEN abs(d) / true_count END), 0), 6) AS nae
FROM (SELECT dataset, method, true_count, CAST(predicted_count AS DOUBLE) - true_count AS d FROM image_results) q GROUP BY dataset, method""")
def counting_errors(v):
    return ev.counting_errors(v.image_results, ["dataset", "method"])


AGG = """count(*) AS n, count(tp) AS n_scored, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, round(sum(tp) / nullif(CAST(sum(tp) + sum(fp) AS DOUBLE), 0), 6) AS precision, round(sum(tp) / nullif(CAST(sum(tp) + sum(fn) AS DOUBLE), 0), 6) AS recall,
  CASE WHEN sum(tp) > 0 THEN round(2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) END AS f1, round(avg(ap), 6) AS mean_ap, round(avg(latency_ms), 6) AS mean_latency_ms, count(*) FILTER (WHERE outcome = 'error') AS errors, count(*) FILTER (WHERE outcome = 'empty') AS abstained"""


@query(f"SELECT method, {AGG} FROM image_results GROUP BY method")
def micro_aggregate(v):
    return ev.micro_aggregate(v.image_results, ["method"])


@query(f"SELECT dataset, split, method, {AGG} FROM image_results GROUP BY dataset, split, method")
def research_aggregate(v):
    return ev.micro_aggregate(v.image_results, ["dataset", "split", "method"])


@query(f"""WITH k AS (SELECT *, CAST(instance_count AS VARCHAR) AS instances, CASE WHEN instance_count IS NULL THEN NULL WHEN instance_count <= 1 THEN '1' WHEN instance_count <= 5 THEN '2-5' WHEN instance_count <= 15 THEN '6-15' ELSE '16+' END AS crowding, CASE canvas_size WHEN '640x480' THEN 'small' WHEN '1280x720' THEN 'medium' WHEN '6000x4000' THEN 'large' END AS resolution FROM image_results),
u AS (SELECT 'canvas_size' AS slice, canvas_size AS key, * FROM k UNION ALL SELECT 'instances', instances, * FROM k UNION ALL SELECT 'scale_bucket', scale_bucket, * FROM k UNION ALL SELECT 'crowding', crowding, * FROM k UNION ALL SELECT 'resolution', resolution, * FROM k)
SELECT method, slice, key, {AGG} FROM u WHERE key IS NOT NULL GROUP BY method, slice, key""")
def slices_grouping_sets(v):
    return ev.sliced(v.image_results)


@query(f"""WITH RECURSIVE {match(0.5)}, b AS (SELECT CASE WHEN CAST(t.w AS BIGINT) * t.h / 160000.0 < 0.004 THEN 'small' WHEN CAST(t.w AS BIGINT) * t.h / 160000.0 < 0.016 THEN 'medium' ELSE 'large' END AS bucket, f.gid IS NOT NULL AS hit FROM gt_boxes t LEFT JOIN flags f ON f.image_id = t.image_id AND f.gid = t.gid)
SELECT n.bucket, count(b.bucket) AS n, count(*) FILTER (WHERE hit) AS found, round(count(*) FILTER (WHERE hit) / CAST(nullif(count(b.bucket), 0) AS DOUBLE), 6) AS recall FROM (VALUES ('small'), ('medium'), ('large')) n(bucket) LEFT JOIN b ON b.bucket = n.bucket GROUP BY n.bucket""")
def recall_by_size(v):
    return ev.recall_by_size(v.gt_boxes, ev.match_flags(v.pred_boxes, v.gt_boxes), 160000)


@query("SELECT run_id AS image_id, run_id IN (SELECT image_id FROM gt_boxes) AS labelled FROM runs")
def coverage(v):
    return ev.coverage(v.runs.select(F.col("run_id").alias("image_id")), v.gt_boxes)


SCORED = "scored AS (SELECT image_id, method, min(outcome) AS outcome, CASE WHEN sum(tp) > 0 THEN round(2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 9) END AS f1 FROM image_results GROUP BY image_id, method)"


def scored(v):
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    return v.image_results.groupBy("image_id", "method").agg(F.min("outcome").alias("outcome"), F.when(tp > 0, F.round(2.0 * tp / (2 * tp + fp + fn), 9)).alias("f1"))


PAIRED = f"""{SCORED}, s AS (SELECT *, CASE WHEN outcome = 'error' THEN -1.0 ELSE coalesce(f1, 0.0) END AS sc FROM scored),
paired AS (SELECT a.image_id, a.method AS method_a, b.method AS method_b, CASE WHEN abs(a.sc - b.sc) <= 1e-9 THEN 'tie' WHEN a.sc > b.sc THEN 'a' ELSE 'b' END AS winner FROM s a JOIN s b ON a.image_id = b.image_id AND a.method < b.method)"""


@query(f"WITH {PAIRED} SELECT * FROM paired")
def paired_winners(v):
    return ev.winners(scored(v)).select("image_id", "method_a", "method_b", "winner")


@query(f"""WITH {PAIRED}, e AS (SELECT method_a AS winner, method_b AS loser, CASE winner WHEN 'a' THEN 1.0 WHEN 'tie' THEN 0.5 ELSE 0.0 END AS w FROM paired UNION ALL SELECT method_b, method_a, CASE winner WHEN 'b' THEN 1.0 WHEN 'tie' THEN 0.5 ELSE 0.0 END FROM paired)
SELECT winner, loser, CAST(sum(w) AS DOUBLE) AS weight FROM e GROUP BY 1, 2""")
def win_graph(v):
    return ev.win_edges(ev.winners(scored(v)))


@query(f"WITH {SCORED}, k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY coalesce(f1, -1) DESC, method) AS k FROM scored) SELECT image_id, method, round(f1, 6) AS f1 FROM k WHERE k = 1")
def tuning_argmax(v):
    return ev.tuning_choice(scored(v), ["image_id"], trial="method").select("image_id", "method", "f1")


@query(f"WITH {SCORED} SELECT image_id, round(max(CASE WHEN method = 'HIGH' THEN f1 END) - max(CASE WHEN method = 'LOW' THEN f1 END), 6) AS delta FROM scored WHERE method IN ('HIGH', 'LOW') GROUP BY image_id")
def tuned_vs_default(v):
    s = scored(v)
    return ev.tuned_delta(s.where("method = 'HIGH'"), s.where("method = 'LOW'"), ["image_id"]).select("image_id", "delta")


REG = "reg AS (SELECT CASE image_id % 4 WHEN 0 THEN 'EASY' WHEN 1 THEN 'TEXTURED' WHEN 2 THEN 'VARIED' ELSE 'CLUTTERED' END AS regime, method, round(2.0 * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0), 9) AS f1 FROM image_results GROUP BY 1, 2)"


def regimes(v):
    name = F.element_at(F.array(*[F.lit(x) for x in ("EASY", "TEXTURED", "VARIED", "CLUTTERED")]), (F.col("image_id") % 4 + 1).cast("int"))
    return v.image_results.groupBy(name.alias("regime"), "method").agg(F.round(ev.f1_dice(F.sum("tp"), F.sum("fp"), F.sum("fn")), 9).alias("f1"))


@query(f"WITH {REG}, k AS (SELECT *, row_number() OVER (PARTITION BY regime ORDER BY f1 DESC, method) AS k FROM reg WHERE f1 IS NOT NULL) SELECT regime, method, round(f1, 6) AS f1 FROM k WHERE k = 1")
def regime_winner(v):
    return ev.regime_winner(regimes(v))


@query(f"WITH {REG} SELECT method, round(max(CASE WHEN regime = 'EASY' THEN f1 END), 6) AS easy, round(max(CASE WHEN regime = 'TEXTURED' THEN f1 END), 6) AS textured, round(max(CASE WHEN regime = 'VARIED' THEN f1 END), 6) AS varied, round(max(CASE WHEN regime = 'CLUTTERED' THEN f1 END), 6) AS cluttered FROM reg GROUP BY method")
def leaderboard(v):
    p = regimes(v).groupBy("method").pivot("regime", ["EASY", "TEXTURED", "VARIED", "CLUTTERED"]).agg(F.max("f1"))
    return p.select("method", F.col("EASY").alias("easy"), F.col("TEXTURED").alias("textured"), F.col("VARIED").alias("varied"), F.col("CLUTTERED").alias("cluttered"))


@query(f"WITH {REG} SELECT regime, method, round(f1 - round_even(f1, 2), 6) AS delta, round_even(f1, 2) IS NOT DISTINCT FROM round_even(round_even(f1, 2), 2) AS agrees FROM reg")
def reconcile(v):
    r = regimes(v)
    return ev.reconcile(r.select("regime", "method", F.bround("f1", 2).alias("published")), r.withColumnRenamed("f1", "measured"), ["regime", "method"], 2).select("regime", "method", "delta", "agrees")


@query("""WITH f AS (SELECT run_id, method, round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 9) AS f1, instance_count FROM image_results), e AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY f1 DESC, run_id) AS a, row_number() OVER (PARTITION BY method ORDER BY f1, run_id) AS b FROM f WHERE instance_count >= 3 AND f1 IS NOT NULL)
SELECT method, max(CASE WHEN a = 1 THEN run_id END) AS easy, max(CASE WHEN b = 1 THEN run_id END) AS hard FROM e GROUP BY method""")
def easy_hard(v):
    f1 = F.round(ev.f1_dice(F.col("tp"), F.col("fp"), F.col("fn")), 9)
    return ev.extremes(v.image_results.withColumn("f1", f1))
