"""Similarity, calibration, pose-vote, response-map, marker, training and split queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions.vectors import fnv1a
from lodestone.operators import calibration as cal
from lodestone.operators import dense, hough, markers, ranking, splits, training
from lodestone.operators import evaluation as ev
from lodestone.operators import similarity as sim
from lodestone.queries.base import query
from lodestone.queries.geometry import PAIRED, nms_sql, scored

VEC = "e AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM vectors)"
COS = "(list_inner_product({a}, {b}) / (greatest(sqrt(list_inner_product({a}, {a})), 1e-12) * greatest(sqrt(list_inner_product({b}, {b})), 1e-12)))"


def cos(a: str, b: str) -> str:
    return COS.replace("{a}", a).replace("{b}", b)


def tokens(v):
    return v.vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def queries_of(v, n=5):
    return v.vectors.where(F.col("vec_id") < n).select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"))


@query(f"WITH {VEC}, d AS (SELECT q.id AS q, e.id, round({cos('e.v', 'q.v')}, 9) AS d FROM e, e q WHERE q.id < 5), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d DESC, id) AS rank FROM d) SELECT q, id, round(d, 6) AS d, rank FROM r WHERE rank <= 10")
def cosine_topk(v):
    return sim.cosine_topk(queries_of(v), tokens(v), 10)


@query(f"WITH {VEC}, d AS (SELECT q.id AS q, e.id, round(sqrt(list_sum(list_transform(list_zip(e.v, q.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 9) AS d FROM e, e q WHERE q.id < 5), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, id) AS rank FROM d), k AS (SELECT q, max(CASE WHEN rank = 8 THEN d END) AS dk, max(CASE WHEN rank = 9 THEN d END) AS nx FROM r GROUP BY q) SELECT q, round(dk, 6) AS dk, round(nx, 6) AS next, dk < 0.98 * nx AS passes FROM k")
def l2_topk_kplus1(v):
    return sim.ratio_test(sim.l2_topk(queries_of(v), tokens(v), 9), 8, 0.98)


BITS = "b AS (SELECT vec_id AS id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(x * 100) AS BIGINT) & 255) AS v FROM vectors)"


@query(f"WITH {BITS}, d AS (SELECT q.id AS q, b.id, CAST(list_sum(list_transform(list_zip(b.v, q.v), lambda z: bit_count(xor(z[1], z[2])))) AS BIGINT) AS d FROM b, b q WHERE q.id < 5), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, id) AS rank FROM d) SELECT q, id, d, rank FROM r WHERE rank <= 8")
def hamming_topk(v):
    code = F.transform("embedding", lambda x: F.floor(x.cast("double") * 100).bitwiseAND(255))
    b = v.vectors.select(F.col("vec_id").alias("id"), code.alias("v"))
    return sim.hamming_topk(b.where("id < 5").select(F.col("id").alias("q"), F.col("v").alias("qv")), b, 8)


MEAN = "p AS (SELECT i, avg(x) AS x FROM (SELECT unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM {src}) GROUP BY i), m AS (SELECT list(x ORDER BY i) AS m FROM p)"


@query(f"WITH {VEC}, crop AS (SELECT v FROM e WHERE label = 3), {MEAN.replace('{src}', 'crop')} SELECT id, round({cos('e.v', 'm.m')}, 6) AS cosine FROM e, m")
def prototype_similarity(v):
    t = tokens(v)
    return sim.prototype_map(t, t.where("label = 3"))


@query(f"WITH {VEC}, d AS (SELECT e.id, {cos('e.v', 'c.v')} AS c FROM e, e c WHERE c.label = 3), r AS (SELECT id, c, row_number() OVER (PARTITION BY id ORDER BY c DESC) AS k FROM d) SELECT id, round(avg(c), 6) AS score FROM r WHERE k <= 3 GROUP BY id")
def maxtoken_similarity(v):
    t = tokens(v)
    return sim.max_token_map(t, t.where("label = 3"))


@query(f"WITH {VEC} SELECT e.id, round(max(({cos('e.v', 'q.v')} + 0.01 * (e.id % 7)) * (1.0 + 0.1 * (e.id % 5))), 6) AS score FROM e, e q WHERE q.id < 4 GROUP BY e.id")
def rotation_max(v):
    t = tokens(v).withColumns({"shift": 0.01 * (F.col("id") % 7), "scale": 1.0 + 0.1 * (F.col("id") % 5)})
    return sim.rotation_max(t, queries_of(v, 4))


@query(f"""WITH {VEC}, b AS (SELECT id, v, CASE WHEN id % 3 = 0 THEN 0.9 ELSE 0.4 END * 0.95 AS o FROM e), crop AS (SELECT * FROM b WHERE o >= 0.8 * (SELECT max(o) FROM b)), {MEAN.replace('{src}', 'crop')}, s AS (SELECT id, o, round({cos('crop.v', 'm.m')}, 9) AS l FROM crop, m)
SELECT id, CAST(round(o, 6) AS DOUBLE) AS o, round(l, 6) AS likeness FROM s ORDER BY l, id LIMIT 1""")
def query_patch(v):
    w = F.when(F.col("id") % 3 == 0, 0.9).otherwise(0.4)
    return sim.query_patch(tokens(v).withColumns({"x": F.lit(0.0), "y": F.lit(0.0), "w": w, "h": F.lit(0.95)}))


REGIONS = f"SELECT e.id % 20 AS image_id, e.id AS pid, CAST(e.id * 7 % 90 AS INT) AS x, CAST(e.id * 13 % 90 AS INT) AS y, 40 AS w, 40 AS h, round({cos('e.v', 'q.v')}, 9) AS score FROM e, e q WHERE q.id = 0 AND round({cos('e.v', 'q.v')}, 9) > 0.05"


@query("WITH " + nms_sql(REGIONS, 0.3).replace("RECURSIVE ", f"RECURSIVE {VEC}, ", 1) + f", s AS (SELECT k.image_id, k.pid, k.x, k.y, r.score FROM kept k JOIN ({REGIONS}) r ON r.pid = k.pid) SELECT image_id, pid, round(score, 6) AS score, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, y, x, pid) - 1 AS idx FROM s")
def retrieval_search(v):
    r = tokens(v).select((F.col("id") % 20).alias("image_id"), F.col("id").alias("pid"), (F.col("id") * 7 % 90).cast("int").alias("x"), (F.col("id") * 13 % 90).cast("int").alias("y"), F.lit(40).alias("w"), F.lit(40).alias("h"), "v")
    return sim.retrieve(r, queries_of(v, 1), 0.05).select("image_id", "pid", "score", "idx")


@query("""WITH r AS (SELECT image_id, score, lead(score) OVER w AS nx, row_number() OVER w AS k, count(*) OVER (PARTITION BY image_id) AS n FROM boxes WINDOW w AS (PARTITION BY image_id ORDER BY score DESC, idx)),
g AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY CASE WHEN k < 50 THEN round(score - nx, 9) END DESC NULLS LAST, k) AS b FROM r WHERE k <= 50) SELECT image_id, round(CASE WHEN n = 1 THEN score - 1e-9 ELSE (score + nx) / 2 END, 6) AS threshold FROM g WHERE b = 1""")
def calib_ratio(v):
    return cal.largest_gap(v.boxes.select("image_id", "score", F.col("idx").alias("key")), ["image_id"])


@query("SELECT image_id, round(0.5 * (avg(score) + stddev_pop(score)) + 0.5 * 0.85 * quantile_cont(score, 0.995), 6) AS threshold FROM boxes GROUP BY image_id")
def calib_contrast(v):
    """Scores are those of `boxes`, straight from the lines, as thresholds on the half of the sixth digit go by the order of adding: that of the table, as in the SQL."""
    lines = v.spark.read.parquet(f"{v.sf_dir}/lineitem.parquet")
    score = F.round(F.col("l_discount") + F.col("l_tax"), 2) + 0.0
    scores = lines.select(F.col("l_orderkey").alias("image_id"), score.alias("score"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return cal.contrast(scores, ["image_id"], ["file", "row"])


@query("SELECT image_id, round(max(score) * 0.85, 6) AS threshold FROM boxes GROUP BY image_id")
def calib_self(v):
    return v.boxes.groupBy("image_id").agg(F.max("score").alias("s")).select("image_id", cal.self_similarity(F.col("s")).alias("threshold"))


@query("WITH " + nms_sql("SELECT p.image_id, p.pid, p.x, p.y, p.w, p.h, p.score FROM pred_boxes p JOIN (SELECT image_id, max(score) AS s FROM pred_boxes GROUP BY image_id) q ON q.image_id = p.image_id WHERE p.score >= 0.9 * q.s", 0.3) + ", n AS (SELECT image_id, count(*) AS n FROM kept GROUP BY image_id) SELECT q.image_id, round(s * CASE WHEN n >= 2 THEN 0.85 ELSE 0.35 END, 6) AS threshold FROM (SELECT image_id, max(score) AS s FROM pred_boxes GROUP BY image_id) q LEFT JOIN n ON n.image_id = q.image_id")
def calib_repeat_aware(v):
    own = v.pred_boxes.groupBy("image_id").agg(F.max("score").alias("self_score"))
    return cal.repeat_aware(v.pred_boxes, own, ["image_id"])


@query("SELECT image_id, CASE WHEN image_id % 4 = 0 THEN 0.7 ELSE greatest(round(max(score) * 6, 6), 0.7) END AS threshold FROM boxes GROUP BY image_id")
def calib_floor(v):
    return v.boxes.groupBy("image_id").agg((F.max("score") * 6).alias("t")).select("image_id", cal.clamped(F.col("t"), F.col("image_id") % 4 == 0).alias("threshold"))


@query()
def calib_gmm(v):
    return cal.gmm(v.boxes, ["image_id"], "image_id bigint")


@query("SELECT image_id, vid, round(20 + scene_x - crop_x, 6) AS dx, round(15 + scene_y - crop_y, 6) AS dy FROM votes")
def hough_votes_translation(v):
    return hough.translation_votes(v.votes, 20.0, 15.0).select("image_id", "vid", "dx", "dy")


@query("""WITH t AS (SELECT *, scene_scale / crop_scale AS s, radians((scene_angle - crop_angle + 360) % 360) AS a FROM votes)
SELECT image_id, vid, round(scene_x + cos(a) * (20 - crop_x) * s - sin(a) * (15 - crop_y) * s, 6) AS dx, round(scene_y + sin(a) * (20 - crop_x) * s + cos(a) * (15 - crop_y) * s, 6) AS dy, round(log2(s), 6) AS log_scale, round(degrees(a), 6) AS theta_deg FROM t""")
def hough_votes_single(v):
    return hough.single_votes(v.votes, 20.0, 15.0)


@query("""WITH p AS (SELECT a.image_id, a.vid AS vid_a, b.vid AS vid_b, b.crop_x - a.crop_x AS ux, b.crop_y - a.crop_y AS uy, b.scene_x - a.scene_x AS vx, b.scene_y - a.scene_y AS vy, a.scene_x, a.scene_y, 20 - a.crop_x AS ox, 15 - a.crop_y AS oy FROM votes a JOIN votes b ON a.image_id = b.image_id AND a.vid < b.vid),
q AS (SELECT *, (vx * ux + vy * uy) / (ux * ux + uy * uy) AS p, (vy * ux - vx * uy) / (ux * ux + uy * uy) AS q FROM p WHERE ux * ux + uy * uy > 0 AND (vx <> 0 OR vy <> 0))
SELECT image_id, vid_a, vid_b, round(scene_x + p * ox - q * oy, 6) AS dx, round(scene_y + q * ox + p * oy, 6) AS dy, round(log2(p * p + q * q) / 2, 6) AS log_scale, round((degrees(atan2(q, p)) + 360) % 360, 6) AS theta_deg FROM q""")
def hough_votes_pairwise(v):
    return hough.pairwise_votes(v.votes, 20.0, 15.0)


HIST = """b AS (SELECT image_id, vid, round((20 + scene_x - crop_x) / 10.0 - 0.5, 9) AS bx, round((15 + scene_y - crop_y) / 10.0 - 0.5, 9) AS byy, round(-0.5, 9) AS bs, round(-0.5, 9) AS bt FROM votes), o AS (SELECT unnest([0, 1]) AS k),
s AS (SELECT image_id, vid, CAST(floor(bx) + i.k AS BIGINT) AS bx, CAST(floor(byy) + j.k AS BIGINT) AS byy, CAST(floor(bs) + s.k AS BIGINT) AS bs, CAST((floor(bt) + t.k + 12) % 12 AS BIGINT) AS bt,
  round((CASE WHEN i.k = 1 THEN bx - floor(bx) ELSE 1 - bx + floor(bx) END) * (CASE WHEN j.k = 1 THEN byy - floor(byy) ELSE 1 - byy + floor(byy) END) * 0.25, 12) AS w FROM b, o i, o j, o s, o t),
hist AS (SELECT image_id, bx, byy, bs, bt, round(sum(w), 9) AS weight, count(DISTINCT vid) AS n FROM s WHERE w > 0 GROUP BY ALL)"""


@query(f"WITH {HIST} SELECT image_id, bx, byy AS \"by\", bs, bt, round(weight, 6) AS weight, n FROM hist")
def hough_histogram(v):
    h = hough.histogram(hough.translation_votes(v.votes, 20.0, 15.0), 40.0)
    return h.select("image_id", "bx", "by", "bs", "bt", "weight", F.size("members").alias("n"))


@query()
def hough_peaks(v):
    return hough.peaks(hough.histogram(hough.translation_votes(v.votes, 20.0, 15.0), 40.0), 0.5)


@query()
def ransac_instances(v):
    return hough.ransac(v.votes, least=3)


@query("SELECT vid, image_id, CASE WHEN (vid % 5 - 2) * 1.0 < 0 THEN 'mirrored' WHEN sqrt(abs((vid % 5 - 2) * 1.0)) < 0.2 THEN 'scale' END AS fault FROM votes")
def degenerate_models(v):
    m = F.array((F.col("vid") % 5 - 2).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0))
    return v.votes.select("vid", "image_id", hough.model_fault(m).alias("fault"))


@query("""WITH c AS (SELECT image_id, vid, scene_x - 100 AS tx, scene_y - 80 AS ty FROM votes) SELECT image_id, vid, greatest(CAST(floor(least(tx, tx - 10)) AS INT), 0) AS x, greatest(CAST(floor(least(ty, ty + 30)) AS INT), 0) AS y,
  least(CAST(ceil(greatest(tx + 20, tx + 10, tx)) AS INT), 60) - greatest(CAST(floor(least(tx, tx - 10)) AS INT), 0) AS w, least(CAST(ceil(greatest(ty + 30 + 10, ty)) AS INT), 50) - greatest(CAST(floor(least(ty, ty + 30)) AS INT), 0) AS h FROM c
WHERE least(CAST(ceil(greatest(tx + 20, tx + 10, tx)) AS INT), 60) > greatest(CAST(floor(least(tx, tx - 10)) AS INT), 0) AND least(CAST(ceil(greatest(ty + 30 + 10, ty)) AS INT), 50) > greatest(CAST(floor(least(ty, ty + 30)) AS INT), 0)""")
def model_boxes(v):
    from lodestone.functions.geometry import affine_hull

    m = F.array(F.lit(1.0), F.lit(-0.5), F.col("scene_x") - 100, F.lit(0.5), F.lit(1.5), F.col("scene_y") - 80)
    return v.votes.select("image_id", "vid", affine_hull(m, F.lit(20.0), F.lit(20.0), F.lit(60), F.lit(50)).alias("b")).where("b IS NOT NULL").select("image_id", "vid", "b.*")


DENSE_MAX = "r AS (SELECT *, max(v) OVER (PARTITION BY y ORDER BY x RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM response_map), t AS (SELECT *, max(m) OVER (PARTITION BY x ORDER BY y RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS top FROM r)"


@query(f"WITH {DENSE_MAX} SELECT y, x, round(v, 6) AS v, round(top, 6) AS top FROM t")
def max_filter(v):
    return dense.windowed_max(v.response_map, 2, 2)


@query("WITH r AS (SELECT y, x, sum(v) OVER w AS s, sum(v * v) OVER w AS e FROM response_map WINDOW w AS (PARTITION BY y ORDER BY x RANGE BETWEEN CURRENT ROW AND 3 FOLLOWING)) SELECT y, x, round(sum(s) OVER w, 6) AS sum, round(sum(e) OVER w, 6) AS energy FROM r WINDOW w AS (PARTITION BY x ORDER BY y RANGE BETWEEN CURRENT ROW AND 2 FOLLOWING)")
def box_energy(v):
    return dense.windowed_sums(v.response_map, 3, 4).select("y", "x", "sum", "energy")


@query("WITH m AS (SELECT y, median(v) AS m FROM response_map GROUP BY y), d AS (SELECT r.*, m FROM response_map r JOIN m ON m.y = r.y), a AS (SELECT y, median(abs(v - m)) AS mad FROM d GROUP BY y) SELECT d.y, d.x, round((v - m) / (1.4826 * mad + 1e-9), 6) AS z FROM d JOIN a ON a.y = d.y")
def robust_z(v):
    return dense.robust_z(v.response_map.where("x is not null"), ["y"]).select("y", "x", "z")


@query("WITH " + nms_sql(f"SELECT 0 AS image_id, CAST(y * 100000 + x AS BIGINT) AS pid, x, y, 4 AS w, 3 AS h, v AS score FROM response_map WHERE v > 60", 0.25) + " SELECT y, x, round(v, 6) AS v FROM response_map JOIN kept USING (y, x)")
def peaks_nms(v):
    return dense.box_peaks(v.response_map, 60.0, 4, 3, 0.25)


@query()
def peaks_local_max(v):
    return dense.local_peaks(v.response_map, 40.0, 2, 2, 3.0)


@query("WITH p AS (SELECT y AS py, x AS px, v AS pv FROM response_map ORDER BY v DESC, y, x LIMIT 1) SELECT py, px, round(pv, 6) AS pv, round((pv - avg(v)) / stddev_pop(v), 6) AS psr FROM response_map, p WHERE abs(y - py) > 5 OR abs(x - px) > 5 GROUP BY py, px, pv")
def psr(v):
    return dense.peak_to_sidelobe(v.response_map)


@query("SELECT y, x, CASE WHEN x = 3 THEN '-inf' WHEN x = 4 THEN CAST(round((SELECT max(v) FROM response_map WHERE x NOT IN (3, 4)), 2) AS VARCHAR) ELSE 'same' END AS what FROM response_map")
def sanitise_map(v):
    raw = v.response_map.withColumn("o", F.col("v")).withColumn("v", F.when(F.col("x") == 3, float("nan")).when(F.col("x") == 4, float("inf")).otherwise(F.col("v")))
    d = dense.sanitised(raw)
    return d.select("y", "x", F.when(F.col("v") == float("-inf"), "-inf").when(F.col("x") == 4, F.round("v", 2).cast("string")).otherwise(F.when(F.col("v") == F.col("o"), "same").otherwise("other")).alias("what"))


@query("""WITH RECURSIVE k AS (SELECT y, x, v, y * 100000 + x AS id FROM response_map WHERE v >= 55), reach AS (SELECT id, id AS to_id FROM k UNION SELECT r.id, b.id FROM reach r JOIN k a ON a.id = r.to_id JOIN k b ON abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
l AS (SELECT id, min(to_id) AS label FROM reach GROUP BY id) SELECT CAST(label AS BIGINT) AS label, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, count(*) AS area, round(max(v), 6) AS top FROM l JOIN k ON k.id = l.id GROUP BY label""")
def components(v):
    return dense.components(v.response_map, 55.0)


def scene(v):
    """The response map as one 30 x 24 image, empty cells 0, with an exemplar box."""
    grid = v.spark.range(720).select((F.col("id") / 24 + 1).cast("int").alias("y"), (F.col("id") % 24).cast("int").alias("x"))
    cells = grid.join(v.response_map, ["y", "x"], "left").select("y", "x", F.coalesce("v", F.lit(0.0)).alias("v"))
    pixels = F.transform(F.sort_array(F.collect_list(F.struct("y", "x", "v"))), lambda c: c["v"])
    return cells.agg(pixels.alias("pixels")).select(F.lit(1).cast("bigint").alias("image_id"), F.lit(30).alias("height"), F.lit(24).alias("width"), "pixels", F.lit(2).alias("ex"), F.lit(3).alias("ey"), F.lit(10).alias("ew"), F.lit(10).alias("eh"))


@query()
def ncc_map(v):
    return dense.search_arrays(scene(v))


@query()
def mosse_map(v):
    return dense.search_arrays(scene(v), "mosse")


@query("""WITH m AS (SELECT image_id, gid AS marker_id, x + 5.0 AS tx, y + 5.0 AS ty, CASE WHEN gid % 2 = 0 THEN 1.0 ELSE 0.0 END AS ux, CASE WHEN gid % 2 = 0 THEN 0.0 ELSE 1.0 END AS uy, 50.0 AS size FROM gt_boxes WHERE gid < 3),
j AS (SELECT m.*, p.pid, p.score AS obj, p.w, p.h, p.x + p.w / 2.0 - tx AS dx, p.y + p.h / 2.0 - ty AS dy FROM m JOIN pred_boxes p ON p.image_id = m.image_id), d AS (SELECT *, sqrt(dx * dx + dy * dy) AS d, sqrt(CAST(w AS DOUBLE) * h) / size AS r FROM j),
s AS (SELECT image_id, marker_id, pid, round(exp(-d / 80.0) + 0.5 * greatest(0.0, CASE WHEN d > 0 THEN (dx * ux + dy * uy) / d ELSE 0.0 END) + 0.5 * obj + 0.3 * least(r, 1 / r), 9) AS score FROM d), k AS (SELECT *, row_number() OVER (PARTITION BY image_id, marker_id ORDER BY score DESC, pid) AS k FROM s)
SELECT image_id, marker_id, pid, round(score, 6) AS score FROM k WHERE k = 1""")
def marker_scores(v):
    even = F.col("gid") % 2 == 0
    m = v.gt_boxes.where("gid < 3").select("image_id", F.col("gid").alias("marker_id"), (F.col("x") + 5.0).alias("tx"), (F.col("y") + 5.0).alias("ty"), F.when(even, 1.0).otherwise(0.0).alias("ux"), F.when(even, 0.0).otherwise(1.0).alias("uy"), F.lit(50.0).alias("size"))
    return markers.best_proposals(m, v.pred_boxes.select("image_id", "pid", "x", "y", "w", "h", F.col("score").alias("objectness")), 80.0)


@query("""WITH c AS (SELECT image_id, avg(scene_x) AS cx, avg(scene_y) AS cy, var_pop(scene_x) AS vx, var_pop(scene_y) AS vy, covar_pop(scene_x, scene_y) AS vxy FROM votes GROUP BY image_id), u AS (SELECT *, cos(atan2(2 * vxy, vx - vy) / 2) AS ux, sin(atan2(2 * vxy, vx - vy) / 2) AS uy FROM c),
t AS (SELECT v.image_id, u.cx, u.cy, round((v.scene_x - cx) * ux + (v.scene_y - cy) * uy, 9) AS t FROM votes v JOIN u ON u.image_id = v.image_id) SELECT image_id, round(cx, 6) AS cx, round(cy, 6) AS cy, round(abs(max(t) + min(t)) / greatest(max(t) - min(t), 1e-9), 5) AS asymmetry FROM t GROUP BY image_id, cx, cy""")
def marker_geometry_pca(v):
    p = markers.principal_axis(v.votes.select("image_id", F.col("scene_x").alias("x"), F.col("scene_y").alias("y")), ["image_id"])
    return p.select("image_id", "cx", "cy", F.round("asymmetry", 5).alias("asymmetry"))


@query("""SELECT image_id, vid, round(radians(scene_angle) * 0 + cos(atan2(sin(radians(scene_angle)), cos(radians(scene_angle)))), 6) AS x, round(sin(atan2(sin(radians(scene_angle)), cos(radians(scene_angle)))), 6) AS y FROM votes""")
def marker_from_transform(v):
    a = F.radians("scene_angle")
    m = F.array(F.cos(a), -F.sin(a), F.lit(0.0), F.sin(a), F.cos(a), F.lit(0.0))
    return v.votes.select("image_id", "vid", markers.from_transform(m).alias("d")).select("image_id", "vid", "d.x", "d.y")


@query("""WITH h AS (SELECT CAST(y % 5 AS BIGINT) AS grp, CAST(floor(v) AS BIGINT) AS b, count(*) AS n FROM response_map GROUP BY 1, 2), c AS (SELECT grp, b, sum(n) OVER w AS w0, sum(n * b) OVER w AS s0, sum(n) OVER (PARTITION BY grp) AS w, sum(n * b) OVER (PARTITION BY grp) AS s FROM h WINDOW w AS (PARTITION BY grp ORDER BY b ROWS UNBOUNDED PRECEDING)),
g AS (SELECT grp, b, round(w0 * (w - w0) * pow(s0 / CAST(w0 AS DOUBLE) - (s - s0) / CAST(w - w0 AS DOUBLE), 2) / w / w, 9) AS q FROM c WHERE w0 < w), k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY q DESC, b) AS k FROM g) SELECT grp, b AS threshold FROM k WHERE k = 1""")
def foreground_otsu(v):
    return markers.otsu(v.response_map.select((F.col("y") % 5).cast("bigint").alias("grp"), F.floor("v").alias("v")), ["grp"])


PAIRS = f"{VEC}, p AS (SELECT CAST(floor(a.id / 32) AS BIGINT) AS batch, a.id AS i, b.id AS j, a.label = b.label AS same, {cos('a.v', 'b.v')} AS c FROM e a JOIN e b ON floor(a.id / 32) = floor(b.id / 32))"


@query(f"WITH {PAIRS} SELECT batch, round(avg(CASE WHEN same THEN c END), 6) AS same, round(avg(CASE WHEN NOT same THEN c END), 6) AS different, round(avg(CASE WHEN same THEN c END) - avg(CASE WHEN NOT same THEN c END), 6) AS gap FROM p WHERE i < j GROUP BY batch")
def cosine_gap(v):
    return training.cosine_gap(tokens(v).withColumn("batch", F.floor(F.col("id") / 32)), "batch")


@query(f"WITH {VEC}, c AS (SELECT {cos('a.v', 'b.v')} AS c FROM e a JOIN e b ON b.id = a.id + 100) SELECT round(avg(c), 6) AS mean, round(min(c), 6) AS least, round(max(c), 6) AS largest, count(*) AS n FROM c")
def crop_scene_agreement(v):
    t = tokens(v)
    return training.agreement(t, t.withColumn("id", F.col("id") - 100))


@query(f"WITH {PAIRS}, l AS (SELECT batch, i, ln(sum(exp(c / 0.1 - 10))) + 10 - avg(CASE WHEN same THEN c / 0.1 END) AS loss FROM p WHERE i <> j GROUP BY batch, i) SELECT batch, round(coalesce(avg(loss), 0.0), 6) AS loss FROM l GROUP BY batch")
def supcon_loss(v):
    return training.supcon_loss(tokens(v).withColumn("batch", F.floor(F.col("id") / 32)), "batch")


@query("SELECT s AS step, round(CASE WHEN s < 20 THEN 0.001 * (s + 1) / 20 ELSE 0.0005 * (1 + cos(pi() * (s - 20) / 180)) END, 6) AS rate FROM (SELECT unnest(range(0, 200)) AS s)")
def lr_schedule(v):
    return training.learning_rates(v.spark, 200, 20, 0.001)


@query("SELECT label, vec_id, CAST(floor((row_number() OVER (PARTITION BY label ORDER BY md5('3-' || CAST(vec_id AS VARCHAR)), vec_id) - 1) / 8) AS BIGINT) AS batch FROM vectors")
def seeded_batches(v):
    return training.batches(v.vectors.withColumn("o", splits.seeded("vec_id", 3)), 8, F.struct("o", "vec_id"), ["label"]).select("label", "vec_id", "batch")


@query("""WITH c AS (SELECT CAST(k AS BIGINT) AS cell, (k % 8 + 0.5) * 32 AS px, (floor(k / 8) + 0.5) * 32 AS py FROM (SELECT unnest(range(0, 64)) AS k)), i AS (SELECT DISTINCT image_id FROM gt_boxes)
SELECT image_id, cell FROM i, c WHERE NOT EXISTS (SELECT 1 FROM gt_boxes b WHERE b.image_id = i.image_id AND px BETWEEN b.x AND b.x + b.w AND py BETWEEN b.y AND b.y + b.h)""")
def background_cells(v):
    return training.background_cells(v.spark, v.gt_boxes, 8, 256.0)


@query("SELECT vec_id, round(-(CASE WHEN label < 5 THEN 0.25 ELSE 0.75 END) * pow(1 - q, 2) * ln(greatest(q, 1e-12)), 6) AS loss FROM (SELECT vec_id, label, CASE WHEN label < 5 THEN 1 / (1 + exp(-x)) ELSE 1 - 1 / (1 + exp(-x)) END AS q FROM (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x FROM vectors))")
def focal_loss(v):
    return v.vectors.select("vec_id", training.focal_loss(F.col("embedding")[0].cast("double"), F.when(F.col("label") < 5, 1).otherwise(0)).alias("loss"))


DROP = """j AS (SELECT a.*, c.name, i.width, i.height, greatest(i.width, i.height) AS side, CASE WHEN c.name IS NULL THEN 'unknown_category' WHEN i.width IS NULL THEN 'unknown_image' WHEN a.w <= 0 OR a.h <= 0 THEN 'degenerate' WHEN a.x + a.w > i.width OR a.y + a.h > i.height OR a.x < 0 OR a.y < 0 THEN 'out_of_range' END AS reason
  FROM annotations a LEFT JOIN categories c ON c.category_id = a.category_id LEFT JOIN coco_images i ON i.image_id = a.image_id)"""


@query(f"WITH {DROP} SELECT ann_id, name, round((x + w / 2) / side, 6) AS cx, round((y + h / 2) / side, 6) AS cy, round(w / side, 6) AS w, round(h / side, 6) AS h FROM j WHERE reason IS NULL")
def coco_targets(v):
    return training.coco_targets(v.annotations, v.coco_images, v.categories).where("reason IS NULL").select("ann_id", "name", "cx", "cy", "w", "h")


@query(f"WITH {DROP} SELECT reason, count(*) AS n FROM j WHERE reason IS NOT NULL GROUP BY reason")
def coco_drop_reasons(v):
    return training.coco_targets(v.annotations, v.coco_images, v.categories).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


@query()
def hungarian(v):
    return training.optimal_match(v.pred_boxes, v.gt_boxes)


@query("SELECT sha256(content) AS hash, min(image_id) AS image_id, count(*) AS copies FROM split_ids GROUP BY content")
def content_dedup(v):
    return splits.unique_content(v.split_ids)


@query("SELECT image_id FROM split_ids GROUP BY image_id HAVING count(DISTINCT split) > 1")
def split_leaks(v):
    return splits.leaks(v.split_ids)


@query("WITH k AS (SELECT * FROM split_ids WHERE image_id NOT IN (SELECT image_id FROM split_ids GROUP BY image_id HAVING count(DISTINCT split) > 1)) SELECT image_id, split FROM k WHERE image_id = (SELECT min(image_id) FROM k q WHERE q.content = k.content)")
def clean_splits(v):
    return splits.clean(v.split_ids).select("image_id", "split")


@query("WITH r AS (SELECT doc_id AS image_id, row_number() OVER (ORDER BY md5('5-' || CAST(doc_id AS VARCHAR)), doc_id) AS k, count(*) OVER () AS n FROM documents) SELECT image_id, CASE WHEN k <= round_even(n * 0.15, 0) THEN 'val' ELSE 'train' END AS split FROM r")
def carve_val_hash(v):
    ids = v.spark.read.parquet(f"{v.sf_dir}/documents.parquet").select(F.col("doc_id").alias("image_id"))
    return splits.carve_val(ids, 0.15, 5)


@query()
def carve_val_numpy(v):
    return splits.carve_val_numpy(v.split_ids.select("image_id").distinct(), 0.15, 5)


@query("""WITH RECURSIVE t AS (SELECT DISTINCT method, hex(encode(method)) AS h FROM runs), f AS (SELECT method, h, 1 AS i, CAST(2166136261 AS BIGINT) AS s FROM t UNION ALL SELECT method, h, i + 2, CAST((xor(s, CAST('0x' || substr(h, i, 2) AS BIGINT)) * 16777619) & 4294967295 AS BIGINT) FROM f WHERE i < length(h))
SELECT method, arg_max(s, i) AS seed FROM f GROUP BY method""")
def fnv1a_seed(v):
    return v.runs.select("method").distinct().select("method", fnv1a(F.col("method")).alias("seed"))


@query("WITH k AS (SELECT image_id, gid, row_number() OVER (PARTITION BY image_id ORDER BY gid = 2 DESC, md5('9-' || CAST(image_id AS VARCHAR) || '-' || CAST(gid AS VARCHAR)), gid) - 1 AS position FROM gt_boxes) SELECT * FROM k WHERE position < 3")
def exemplars_hash(v):
    return splits.exemplars(v.gt_boxes.withColumn("native", F.col("gid") == 2), 3, 9).select("image_id", "gid", "position")


@query("WITH a AS (SELECT *, CAST(w AS BIGINT) * h AS area FROM gt_boxes), m AS (SELECT image_id, median(area) AS m FROM a GROUP BY image_id), k AS (SELECT a.image_id, gid, row_number() OVER (PARTITION BY a.image_id ORDER BY abs(area - m), gid) - 1 AS position FROM a JOIN m ON m.image_id = a.image_id) SELECT * FROM k WHERE position < 2")
def exemplars_size_rep(v):
    return splits.size_representative(v.gt_boxes, 2).select("image_id", "gid", "position")


@query("SELECT run_id, min(part) AS part FROM (SELECT run_id, 0 AS part FROM runs WHERE run_id % 3 = 0 UNION ALL SELECT run_id, 1 FROM runs WHERE run_id % 2 = 0) GROUP BY run_id")
def ordered_union(v):
    return splits.ordered_union([v.runs.where("run_id % 3 = 0"), v.runs.where("run_id % 2 = 0")], "run_id")


@query("SELECT split, list(DISTINCT image_id ORDER BY image_id) AS ids FROM split_ids GROUP BY split")
def split_manifest(v):
    return splits.split_manifest(v.split_ids)


EDGES = f"{PAIRED}, w AS (SELECT method_a AS winner, method_b AS loser, CASE winner WHEN 'a' THEN 1.0 WHEN 'tie' THEN 0.5 ELSE 0.0 END AS w FROM paired UNION ALL SELECT method_b, method_a, CASE winner WHEN 'b' THEN 1.0 WHEN 'tie' THEN 0.5 ELSE 0.0 END FROM paired), edges AS (SELECT winner, loser, CAST(sum(w) AS DOUBLE) AS weight FROM w GROUP BY 1, 2)"


@query(f"WITH {EDGES}, m AS (SELECT DISTINCT winner AS m FROM edges) SELECT a.m AS winner, b.m AS loser, round(coalesce(weight, 0) + 0.1, 6) AS weight FROM m a JOIN m b ON a.m <> b.m LEFT JOIN edges ON winner = a.m AND loser = b.m")
def bt_regularised(v):
    return ranking.regularised(ev.win_edges(ev.winners(scored(v))))


@query(f"WITH RECURSIVE {EDGES}, r AS (SELECT winner AS a, loser AS b FROM edges WHERE weight > 0 UNION SELECT r.a, e.loser FROM r JOIN edges e ON e.winner = r.b AND e.weight > 0), n AS (SELECT count(DISTINCT winner) AS n FROM edges) SELECT n, count(*) AS pairs, count(*) = n * (n - 1) AS connected FROM r, n WHERE a <> b GROUP BY n")
def strong_connectivity(v):
    return ranking.strongly_connected(ev.win_edges(ev.winners(scored(v))))


BT_ROUNDS = 400


@query(f"""WITH RECURSIVE {EDGES}, g AS (SELECT a.winner AS i, a.loser AS j, a.weight + 0.1 AS w, a.weight + b.weight + 0.2 AS n FROM edges a JOIN edges b ON b.winner = a.loser AND b.loser = a.winner), ms AS (SELECT i, sum(w) AS won FROM g GROUP BY i),
it AS (SELECT 0 AS k, map(list(i ORDER BY i), list(CAST(1 AS DOUBLE) ORDER BY i)) AS p FROM ms
  UNION ALL SELECT k + 1, (SELECT map(list(i ORDER BY i), list(q / gm ORDER BY i)) FROM (SELECT i, q, exp(avg(ln(q)) OVER ()) AS gm FROM (SELECT ms.i, any_value(won) / sum(n / (it.p[ms.i] + it.p[g.j])) AS q FROM ms JOIN g ON g.i = ms.i GROUP BY ms.i))) FROM it WHERE k < {BT_ROUNDS}),
fin AS (SELECT p FROM it WHERE k = {BT_ROUNDS}), info AS (SELECT g.i AS gi, 1 / sqrt(sum(n * fin.p[g.i] * fin.p[g.j] / pow(fin.p[g.i] + fin.p[g.j], 2))) AS se FROM g, fin GROUP BY g.i), o AS (SELECT i AS method, fin.p[i] AS strength, se AS stderr FROM ms JOIN info ON gi = i, fin)
SELECT method, round(strength, 6) AS strength, round(stderr, 6) AS stderr, row_number() OVER (ORDER BY strength DESC, method) AS rank FROM o""")
def bradley_terry(v):
    return ranking.bradley_terry(ev.win_edges(ev.winners(scored(v))), tolerance=1e-12).select("method", "strength", "stderr", "rank")


@query("""WITH u AS (SELECT method, ap, b, CAST(CAST('0x' || substr(md5(CAST(run_id AS VARCHAR) || '-' || CAST(b AS VARCHAR)), 1, 7) AS BIGINT) AS DOUBLE) / 268435456.0 AS u FROM image_results, (SELECT unnest(range(0, 100)) AS b) WHERE ap IS NOT NULL),
w AS (SELECT method, b, ap, CASE WHEN u >= 0.36787944 THEN 1 ELSE 0 END + CASE WHEN u >= 0.73575888 THEN 1 ELSE 0 END + CASE WHEN u >= 0.91969860 THEN 1 ELSE 0 END + CASE WHEN u >= 0.98101184 THEN 1 ELSE 0 END + CASE WHEN u >= 0.99634015 THEN 1 ELSE 0 END AS w FROM u),
m AS (SELECT method, b, sum(w * ap) / nullif(sum(w), 0) AS m FROM w GROUP BY method, b) SELECT method, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m GROUP BY method""")
def bootstrap_ci_hash(v):
    return ranking.bootstrap_hash(v.image_results, "method", "run_id", "ap")


@query()
def bootstrap_ci_numpy(v):
    return ranking.bootstrap_numpy(v.image_results, "method", "ap")


