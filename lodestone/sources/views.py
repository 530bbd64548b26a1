"""The domain's tables (runs, matches, ratings, boxes, vectors ...) as views over the test tables.

Each view is one SELECT in the SQL that Spark and DuckDB share; `view` gives it as a DataFrame, `with_views` puts
it before a query for DuckDB. Scores tie on purpose, so that every ranking must end in a unique column.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "boxes": """
        SELECT l_orderkey AS image_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS idx,
          CAST(l_partkey * 7 % 200 AS INT) AS x, CAST(l_suppkey * 13 % 200 AS INT) AS y, CAST(20 + l_quantity AS INT) AS w, CAST(20 + 5 * l_linenumber AS INT) AS h,
          l_partkey, l_suppkey, round(l_discount + l_tax, 2) + 0.0 AS score
        FROM {lineitem}""",
    "gt_boxes": "SELECT image_id, idx AS gid, x, y, w, h FROM boxes WHERE idx < 8",
    "pred_boxes": """
        SELECT image_id, idx * 2 AS pid, greatest(0, x + CAST(l_partkey % 9 AS INT) - 4) AS x, greatest(0, y + CAST(l_suppkey % 7 AS INT) - 3) AS y, w, h, score FROM boxes WHERE l_partkey % 5 <> 0
        UNION ALL SELECT image_id, idx * 2 + 1, x + 1, y, w, h, round(score - 0.01, 2) + 0.0 FROM boxes WHERE l_suppkey % 6 = 0""",
    "runs": """
        SELECT o_orderkey AS run_id, o_orderkey % 200 AS image_id, substr(o_orderpriority, 3) AS method, CASE WHEN o_custkey % 4 = 0 THEN 'marker-conditioned' ELSE 'same-image' END AS exploration,
          CASE WHEN o_orderstatus = 'P' THEN 'error' WHEN o_orderstatus = 'O' OR n IS NULL THEN 'empty' ELSE 'ok' END AS outcome,
          CASE WHEN o_orderstatus = 'F' AND n IS NOT NULL THEN n ELSE 0 END AS retrieved,
          CAST(o_custkey % 17 AS DOUBLE) AS preprocess_ms, o_totalprice / 100 AS inference_ms, CAST(o_orderkey % 11 AS DOUBLE) AS postprocess_ms, o_orderdate AS created_at
        FROM {orders} LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM {lineitem} GROUP BY l_orderkey) AS lines ON l_orderkey = o_orderkey""",
    "matches": "SELECT r.run_id, b.idx, b.x, b.y, b.w, b.h, b.score, b.idx = 0 AS is_exemplar FROM runs r JOIN boxes b ON b.image_id = r.run_id WHERE r.outcome = 'ok'",
    "candidates": "SELECT r.run_id, b.idx AS rnk, b.x + 3 AS x, b.y + 2 AS y, b.w, b.h, round(b.score / 2, 3) AS score FROM runs r JOIN boxes b ON b.image_id = r.run_id WHERE r.outcome <> 'error'",
    "ratings": """
        SELECT run_id * 2 + k AS rating_id, run_id, (run_id + k) % 5 < 3 AS thumbs_up, CASE WHEN run_id % 4 = 0 THEN NULL ELSE least(run_id % 3, retrieved) END AS wrong_count,
          CASE WHEN run_id % 6 = 1 THEN NULL ELSE run_id % 4 END AS missed_count, run_id % 7 = 0 AS verdicts_confirmed, run_id % 50 = 4 AS unratable
        FROM runs CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) AS ks WHERE run_id % 3 <> 0 AND (k = 0 OR run_id % 10 = 1)""",
    "match_verdicts": "SELECT t.rating_id, m.idx AS match_index, (m.idx + t.run_id) % 3 <> 0 AS correct FROM ratings t JOIN matches m ON m.run_id = t.run_id WHERE t.verdicts_confirmed",
    "image_results": """
        SELECT r.run_id, r.image_id, r.method, r.outcome, CASE WHEN r.image_id % 9 = 0 THEN NULL WHEN r.image_id % 4 = 0 THEN '640x480' WHEN r.image_id % 4 = 1 THEN '1280x720' WHEN r.image_id % 4 = 2 THEN '6000x4000' ELSE 'bad' END AS canvas_size,
          CASE WHEN r.image_id % 7 = 0 THEN NULL ELSE r.image_id % 20 + 1 END AS instance_count, CASE WHEN r.image_id % 3 = 0 THEN 'varied' ELSE 'fixed' END AS scale_bucket,
          CASE WHEN r.outcome = 'error' THEN NULL ELSE r.retrieved END AS tp, CASE WHEN r.outcome = 'error' THEN NULL ELSE r.run_id % 3 END AS fp, CASE WHEN r.outcome = 'error' THEN NULL ELSE r.run_id % 5 END AS fn,
          CASE WHEN r.outcome = 'error' THEN NULL ELSE CAST(r.run_id % 101 AS DOUBLE) / 100 END AS ap, r.preprocess_ms + r.inference_ms + r.postprocess_ms AS latency_ms,
          CASE WHEN r.image_id < 60 THEN 'carpk' WHEN r.image_id < 120 THEN 'fscd147' ELSE 'rpine' END AS dataset, CASE WHEN r.image_id % 5 = 0 THEN 'test' ELSE 'val' END AS split,
          r.retrieved AS predicted_count, r.run_id % 8 AS true_count
        FROM runs r""",
    "vectors": "SELECT vec_id, embedding, label FROM {embeddings}",
    "response_map": """
        SELECT y, x, CAST(v AS DOUBLE) / 100 AS v FROM (SELECT CAST(extract(day FROM ts) AS INT) AS y, CAST(extract(hour FROM ts) AS INT) AS x, CAST(floor(sum(CAST(floor(value * 100) AS BIGINT)) / count(*)) AS BIGINT) AS v FROM {events} GROUP BY 1, 2) AS cells""",
    "peak_maps": """
        SELECT i.image_id, g.y, g.x, CAST(coalesce(c.v, 0) AS DOUBLE) / 100 AS v FROM (SELECT y, x FROM response_map) g CROSS JOIN (SELECT DISTINCT user_id % 12 AS image_id FROM {events}) i
          LEFT JOIN (SELECT user_id % 12 AS image_id, CAST(extract(day FROM ts) AS INT) AS y, CAST(extract(hour FROM ts) AS INT) AS x, CAST(floor(sum(CAST(floor(value * 100) AS BIGINT)) / count(*)) AS BIGINT) AS v FROM {events} GROUP BY 1, 2, 3) c ON c.image_id = i.image_id AND c.y = g.y AND c.x = g.x""",
    "split_ids": "SELECT doc_id AS image_id, text AS content, CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 8 THEN 'val' ELSE 'test' END AS split FROM {documents} UNION ALL SELECT doc_id, text, 'test' FROM {documents} WHERE doc_id % 97 = 0 AND doc_id % 10 < 7",
    "votes": """
        SELECT l_orderkey AS image_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS vid,
          CAST(l_partkey % 50 AS DOUBLE) AS crop_x, CAST(l_suppkey % 40 AS DOUBLE) AS crop_y, CAST(l_partkey % 50 + 100 + l_linenumber AS DOUBLE) AS scene_x, CAST(l_suppkey % 40 + 80 + l_linenumber AS DOUBLE) AS scene_y,
          1.0 + CAST(l_partkey % 3 AS DOUBLE) AS crop_scale, 1.0 + CAST(l_suppkey % 4 AS DOUBLE) AS scene_scale, CAST(l_partkey % 360 AS DOUBLE) AS crop_angle, CAST(l_suppkey % 360 AS DOUBLE) AS scene_angle
        FROM {lineitem}""",
    "annotations": """
        SELECT p_partkey AS ann_id, p_partkey % 60 AS image_id, p_size % 6 AS category_id, CAST(p_partkey * 11 % 600 AS DOUBLE) + 0.25 AS x, CAST(p_partkey * 5 % 400 AS DOUBLE) + 0.5 AS y,
          CAST(p_size % 13 AS DOUBLE) * 9 AS w, CAST(p_partkey % 11 AS DOUBLE) * 8.5 AS h FROM {part}""",
    "categories": "SELECT n_nationkey AS category_id, n_name AS name FROM {nation} WHERE n_nationkey < 5",
    "coco_images": "SELECT CAST(s_suppkey AS BIGINT) AS image_id, CAST(600 + s_suppkey % 7 * 10 AS INT) AS width, CAST(400 + s_suppkey % 5 * 10 AS INT) AS height FROM {supplier}",
}


def needed(sql: str) -> list[str]:
    """The views a query rests on, in order."""
    found, text = [], sql
    for name in reversed(list(VIEWS)):
        if re.search(rf"\b{name}\b", text):
            found.append(name)
            text += VIEWS[name]
    return found[::-1]


def with_views(sql: str) -> str:
    """The query with its views, for DuckDB's pre-registered tables."""
    names = [n for n in needed(sql)]
    parts = [f"{n} AS ({VIEWS[n].strip()})" for n in names]
    text = sql.strip()
    recursive = re.match(r"(?i)with\s+recursive\s+", text)
    plain = re.match(r"(?i)with\s+", text)
    if not parts:
        out = text
    elif recursive:
        out = "WITH RECURSIVE " + ", ".join(parts) + ", " + text[recursive.end() :]
    elif plain:
        out = "WITH " + ", ".join(parts) + ", " + text[plain.end() :]
    else:
        out = "WITH " + ", ".join(parts) + " " + text
    for t in TABLES:
        out = out.replace("{" + t + "}", t)
    return out


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = f"SELECT * FROM {name}"
    parts = ", ".join(f"{n} AS ({VIEWS[n].strip()})" for n in needed(sql))
    out = f"WITH {parts} {sql}"
    for t in TABLES:
        out = out.replace("{" + t + "}", f"parquet.`{sf_dir}/{t}.parquet`")
    return spark.sql(out)
