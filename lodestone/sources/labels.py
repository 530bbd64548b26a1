"""Readers of image labels in their native forms, all to (image_id, gid, x, y, w, h) and what else a form holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BOX = "struct<x:int,y:int,w:int,h:int>"
SIDECAR = f"image string, width int, height int, spec struct<width:int,height:int>, boxes array<{BOX}>, achieved_n int, requested_n int, seed bigint, exemplar_index int, exemplar_indices array<int>, slice_metadata struct<true_instance_count:int,instance_scale_min:double,instance_scale_max:double,rotation_min_deg:double,rotation_max_deg:double,clutter_level:double,exemplar_keypoint_count:int>"
COCO = "images array<struct<id:bigint,file_name:string,width:int,height:int>>, annotations array<struct<id:bigint,image_id:bigint,category_id:bigint,bbox:array<double>>>, categories array<struct<id:bigint,name:string>>"
DENSE_COUNTS = "map<string,struct<box_examples_coordinates:array<array<array<double>>>,points:array<array<double>>,boxes:array<array<int>>>>"


def file_stem() -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(\.gt)?\.[A-Za-z]+$", 1)


def sidecars(spark: SparkSession, roots: list[str], source: str | None = None) -> DataFrame:
    """Ground-truth sidecars `*.gt.json` under several roots; of equal image ids the earlier root's counts.

    The canvas is the pair width, height, else the pair in `spec`. `fault` says what is wrong: no boxes, another number of boxes than
    stated, or an exemplar that isn't there; such rows are not for use.
    """
    parts = None
    for rank, root in enumerate(roots):
        own = spark.read.schema(SIDECAR).option("multiLine", True).option("pathGlobFilter", "*.gt.json").json(root).withColumns({"image_id": file_stem(), "_rank": F.lit(rank)})
        parts = own if parts is None else parts.unionByName(own)
    first = parts.withColumn("_k", F.row_number().over(W.partitionBy("image_id").orderBy("_rank"))).where("_k = 1")
    both = F.col("width").isNotNull() & F.col("height").isNotNull()
    n = F.coalesce(F.size("boxes"), F.lit(0))
    indices = F.coalesce("exemplar_indices", F.array().cast("array<int>"))
    index = F.coalesce("exemplar_index", F.lit(0))
    fault = (
        F.when(n < 1, "no_boxes")
        .when(F.col("achieved_n").isNotNull() & (F.col("achieved_n") != n), "count")
        .when((index < 0) | (index >= n) | ~F.forall(indices, lambda i: (i >= 0) & (i < n)), "exemplar_index")
    )
    return first.select(
        "image_id", F.when(both, F.col("width")).otherwise(F.col("spec.width")).alias("width"), F.when(both, F.col("height")).otherwise(F.col("spec.height")).alias("height"), "boxes",
        index.alias("exemplar_index"), F.when(F.size(indices) > 0, indices).otherwise(F.array(index)).alias("exemplar_indices"), "slice_metadata",
        F.coalesce("slice_metadata.true_instance_count", "achieved_n", F.size("boxes")).alias("true_count"), F.lit(source).cast("string").alias("source"), fault.alias("fault"),
    )


def boxes_of(labels: DataFrame) -> DataFrame:
    """A row for each box of the faultless labels."""
    return labels.where("fault IS NULL").select("image_id", F.posexplode("boxes").alias("gid", "b")).select("image_id", F.col("gid").cast("bigint").alias("gid"), "b.*")


def corner_lines(spark: SparkSession, path: str, fields: int) -> DataFrame:
    """Text labels, one box a line as `x1 y1 x2 y2` with more fields behind (5 with a class). Lines that don't convert or hold no area are left out."""
    raw = spark.read.text(path).select(file_stem().alias("image_id"), F.split(F.trim("value"), r"\s+").alias("p"), F.monotonically_increasing_id().alias("_line"))
    whole = raw.where((F.size("p") == fields) & F.forall("p", lambda s: s.try_cast("int").isNotNull()))
    n = [F.get(F.transform("p", lambda s: s.try_cast("int")), i) for i in range(4)]  # the planner may look at lines before it leaves them out
    c = whole.select("image_id", "_line", n[0].alias("x"), n[1].alias("y"), (n[2] - n[0]).alias("w"), (n[3] - n[1]).alias("h")).where("w >= 1 and h >= 1 and x >= 0 and y >= 0")
    return c.withColumn("gid", (F.row_number().over(W.partitionBy("image_id").orderBy("_line")) - 1).cast("bigint")).select("image_id", "gid", "x", "y", "w", "h")


def car_lines(spark: SparkSession, path: str) -> DataFrame:
    return corner_lines(spark, path, 5)


def plain_lines(spark: SparkSession, path: str) -> DataFrame:
    return corner_lines(spark, path, 4)


def coco(spark: SparkSession, path: str, target: str | None) -> DataFrame:
    """COCO annotations of one category, by its name (None: of all), rounded to whole pixels, degenerate ones dropped."""
    raw = spark.read.schema(COCO).option("multiLine", True).json(path)
    kinds = raw.select(F.explode("categories").alias("c")).where(F.lit(target is None) | F.col("c.name").eqNullSafe(F.lit(target))).select(F.col("c.id").alias("category_id"))
    images = raw.select(F.explode("images").alias("i")).select(F.col("i.id").alias("image"), F.regexp_replace("i.file_name", r"\.[A-Za-z]+$", "").alias("image_id"), "i.width", "i.height")
    notes = raw.select(F.explode("annotations").alias("a")).select("a.id", F.col("a.image_id").alias("image"), "a.category_id", "a.bbox")
    b = [F.get(F.transform("bbox", lambda v: F.bround(v).cast("int")), i) for i in range(4)]
    rows = notes.join(kinds, "category_id").join(images, "image").select("image_id", "id", b[0].alias("x"), b[1].alias("y"), b[2].alias("w"), b[3].alias("h"), "width", "height")
    kept = rows.where("w >= 1 and h >= 1 and x >= 0 and y >= 0")
    return kept.withColumn("gid", (F.row_number().over(W.partitionBy("image_id").orderBy("id")) - 1).cast("bigint")).select("image_id", "gid", "x", "y", "w", "h", "width", "height")


def text_tree(spark: SparkSession, root: str, splits: dict[str, str]) -> DataFrame:
    """(split, image_id, gid, x, y, w, h) of a tree `<part>/labels/<image>.txt`, whose parts map to our splits. An image with a line that doesn't convert or holds no area is left out whole."""
    parts = []
    for part, ours in splits.items():
        path = f"{root}/{part}/labels"
        p = F.transform(F.split(F.trim("value"), r"\s+"), lambda s: s.try_cast("int"))
        lines = spark.read.text(path).where("trim(value) <> ''").select(file_stem().alias("image_id"), p.alias("n"))
        sound = (F.size("n") == 4) & F.forall("n", lambda v: v.isNotNull()) & (F.get("n", 2) > F.get("n", 0)) & (F.get("n", 3) > F.get("n", 1))
        bad = lines.where(~F.coalesce(sound, F.lit(False))).select("image_id").distinct()
        parts.append(plain_lines(spark, path).join(bad, "image_id", "left_anti").select(F.lit(ours).alias("split"), "*"))
    return reduce(DataFrame.unionByName, parts)


def coco_tree(spark: SparkSession, files: dict[str, str], target: str | None = None) -> DataFrame:
    """(split, image_id, gid, x, y, w, h, width, height) of COCO files by our splits' names."""
    return reduce(DataFrame.unionByName, [coco(spark, path, target).select(F.lit(ours).alias("split"), "*") for ours, path in files.items()])


def dense_counts(spark: SparkSession, path: str) -> DataFrame:
    """The dict-of-images JSON with xyxy boxes and example polygons: boxes, and for each example the box it overlaps most."""
    from lodestone.functions.geometry import hull, iou

    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", DENSE_COUNTS)).alias("name", "d"))
    boxes = F.transform("d.boxes", lambda b: F.struct(b[0].alias("x"), b[1].alias("y"), (b[2] - b[0]).alias("w"), (b[3] - b[1]).alias("h")))
    images = raw.select(F.regexp_replace("name", r"\.[A-Za-z]+$", "").alias("image_id"), boxes.alias("boxes"), "d.box_examples_coordinates")
    best = F.transform(
        "box_examples_coordinates",
        lambda p: F.aggregate(
            F.transform("boxes", lambda b, i: F.struct(iou(b, hull(p)).alias("o"), (-i).alias("i"))),
            F.struct(F.lit(-1.0).alias("o"), F.lit(0).alias("i")),
            lambda a, c: F.when(c > a, c).otherwise(a),
            lambda a: -a["i"],
        ),
    )
    return images.withColumn("exemplar_indices", best).drop("box_examples_coordinates")


def split_ids(spark: SparkSession, path: str) -> DataFrame:
    """(split, image_id) of a split manifest or native split file."""
    raw = spark.read.schema("dataset string, seed bigint, val_strategy string, train array<string>, val array<string>, test array<string>").option("multiLine", True).json(path)
    parts = F.array(*[F.struct(F.lit(s).alias("split"), F.col(s).alias("ids")) for s in ("train", "val", "test")])
    return raw.select("dataset", F.explode(parts).alias("p")).select("dataset", "p.split", F.explode("p.ids").alias("image_id"))


def image_catalogue(spark: SparkSession, path: str, labels: DataFrame | None = None) -> DataFrame:
    """Image files by id, with whether they are labelled; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{png,jpg,jpeg}").option("recursiveFileLookup", True).load(path).select(F.regexp_extract("path", r"([^/]+)\.[A-Za-z]+$", 1).alias("image_id"), "path", "length")
    if labels is None:
        return files.withColumn("has_ground_truth", F.lit(False)).orderBy("image_id")
    own = labels.select("image_id", F.lit(True).alias("_l")).distinct()
    return files.join(own, "image_id", "left").withColumn("has_ground_truth", F.coalesce("_l", F.lit(False))).drop("_l").orderBy("image_id")


def run_results(spark: SparkSession, path: str) -> DataFrame:
    """(method, then the fields of its per-image results) of results files: `methods` maps names to objects with a list `per_image`."""
    row = "image_id string, outcome string, canvas_size string, instance_count bigint, scale_bucket string, tp bigint, fp bigint, fn bigint, precision double, recall double, f1 double, ap double, latency_ms double, n_matches bigint"
    raw = spark.read.schema(f"methods map<string, struct<per_image: array<struct<{', '.join(x.replace(' ', ': ', 1) for x in row.split(', ')) }>>>>").option("multiLine", True).json(path)
    return raw.select(F.explode("methods").alias("method", "m")).select("method", F.explode("m.per_image").alias("r")).select("method", "r.*")
