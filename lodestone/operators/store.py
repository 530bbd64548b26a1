"""Runs, ratings and what follows from them. Null is not assessed, 0 is assessed and none; nothing fills nulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.rates import ratio, wilson


def run_fp(runs: DataFrame, ratings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """A row for each run and rating (runs without rating too): false positives, from confirmed verdicts where there are any, else the stated count."""
    counted = verdicts.groupBy("rating_id").agg(F.count("*").alias("n_verdicts"), F.sum((~F.col("correct")).cast("bigint")).alias("n_wrong"))
    joined = runs.join(ratings, "run_id", "left").join(counted, "rating_id", "left")
    by_match = F.col("verdicts_confirmed") & (F.col("n_verdicts") > 0)
    source = F.when(by_match, "per_match").when(F.col("wrong_count").isNotNull(), "count")
    fp = F.when(by_match, F.col("n_wrong")).otherwise(F.col("wrong_count").cast("bigint"))
    total = F.col("preprocess_ms") + F.col("inference_ms") + F.col("postprocess_ms")
    return joined.withColumns({"fp_source": source, "fp": fp, "total_ms": total}).drop("n_verdicts")


def run_metrics(fp: DataFrame) -> DataFrame:
    """Adds tp, expected, precision and recall, each null unless what it needs was assessed."""
    tp = F.col("retrieved") - F.col("fp")
    expected = tp + F.col("missed_count")
    status = F.when(F.col("fp").isNull(), "unrated").when(F.col("retrieved") == 0, "nothing_retrieved").otherwise("ok")
    return fp.withColumns({"tp": tp, "fn": F.col("missed_count"), "expected": expected, "precision_status": status, "precision": ratio(tp, F.col("retrieved")), "recall": ratio(tp, expected)})


def method_thumbs(runs: DataFrame, ratings: DataFrame) -> DataFrame:
    up = F.sum(F.when(F.col("thumbs_up"), 1))
    return runs.join(ratings, "run_id", "left").groupBy("method").agg(up.alias("up"), F.count("thumbs_up").alias("rated"), F.count("*").alias("n_runs"))


def scoreboard(runs: DataFrame, ratings: DataFrame, verdicts: DataFrame, confidence: float = 0.95) -> DataFrame:
    """A row for each method: thumbs with their interval, mean precision and recall of assessed runs, latency percentiles over runs, outcomes, rank.

    Latencies and outcomes come from runs alone, as a run of two ratings has two rows among the metrics.
    """
    metrics = run_metrics(run_fp(runs, ratings, verdicts))
    rated = metrics.groupBy("method").agg(F.avg("precision").alias("mean_precision"), F.count("precision").alias("n_precision"), F.avg("recall").alias("mean_recall"), F.count("recall").alias("n_recall"))
    total = F.col("preprocess_ms") + F.col("inference_ms") + F.col("postprocess_ms")
    own = runs.groupBy("method").agg(
        F.percentile(total, F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99))).alias("p"),
        F.count_if(F.col("outcome") == "empty").alias("abstained"),
        F.count_if(F.col("outcome") == "error").alias("errors"),
    )
    thumbs = method_thumbs(runs, ratings).withColumn("wilson", wilson(F.coalesce("up", F.lit(0)), F.col("rated"), confidence))
    return (
        thumbs.join(rated, "method")
        .join(own, "method")
        .select(
            "method", "n_runs", "rated", F.coalesce("up", F.lit(0)).alias("up"), F.col("wilson.low").alias("low"), F.col("wilson.high").alias("high"),
            "mean_precision", "n_precision", "mean_recall", "n_recall", F.col("p")[0].alias("p50_ms"), F.col("p")[1].alias("p90_ms"), F.col("p")[2].alias("p99_ms"), "abstained", "errors",
        )
        .orderBy(F.coalesce("low", F.lit(-1.0)).desc(), "method")
    )


def sweep_ranks(board: DataFrame, metrics: DataFrame) -> DataFrame:
    """Each method's place on the scoreboard (unrated ones last) and its rows whose false positives come from verdicts, which alone a threshold sweep can use."""
    eligible = metrics.groupBy("method").agg(F.count_if(F.col("fp_source") == "per_match").alias("sweep_eligible"), F.count("*").alias("_n"))
    place = F.row_number().over(W.orderBy(F.coalesce("low", F.lit(-1.0)).desc(), "method"))  # a row for each method
    return board.join(eligible, "method").select("method", place.alias("rank"), "sweep_eligible", (F.col("_n") - F.col("sweep_eligible")).alias("sweep_excluded"))


def completeness(wrong_known: Column, missed_known: Column) -> Column:
    return F.when(wrong_known & missed_known, "complete").when(wrong_known, "precision_only").when(missed_known, "recall_only").otherwise("none")


def rating_tiers(fp: DataFrame) -> DataFrame:
    """Per rating how much was assessed, and whether confirmed verdicts contradict the stated count."""
    differs = (F.col("fp_source") == "per_match") & F.col("wrong_count").isNotNull() & (F.col("wrong_count") != F.col("fp"))
    return fp.where("rating_id IS NOT NULL").select("rating_id", completeness(F.col("fp").isNotNull(), F.col("missed_count").isNotNull()).alias("tier"), F.coalesce(differs, F.lit(False)).alias("discrepancy"))


def rating_violations(runs: DataFrame, ratings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(rating_id, reason) of ratings that their run contradicts; bounds come before verdicts."""
    counted = verdicts.groupBy("rating_id").agg(F.count("*").alias("n"), F.countDistinct("match_index").alias("distinct_n"), F.max("match_index").alias("top"), F.min("match_index").alias("low"))
    reason = (
        F.when(F.col("wrong_count").isNotNull() & ((F.col("wrong_count") < 0) | (F.col("wrong_count") > F.col("retrieved"))), "wrong_count")
        .when(F.col("missed_count").isNotNull() & (F.col("missed_count") < 0), "missed_count")
        .when(F.col("n").isNotNull() & (F.col("n") != F.col("distinct_n")), "repeated_verdict")
        .when(F.col("n").isNotNull() & ((F.col("top") >= F.col("retrieved")) | (F.col("low") < 0)), "verdict_index")
        .when(F.col("n").isNotNull() & F.col("verdicts_confirmed") & (F.col("n") != F.col("retrieved")), "verdict_count")
    )
    joined = ratings.join(runs.select("run_id", "retrieved"), "run_id").join(counted, "rating_id", "left")
    return joined.select("rating_id", reason.alias("reason")).where("reason IS NOT NULL")


def result_violations(runs: DataFrame, matches: DataFrame) -> DataFrame:
    """Runs whose outcome and matches disagree: ok needs a match, empty and error have none."""
    n = matches.groupBy("run_id").agg(F.count("*").alias("n"))
    joined = runs.join(n, "run_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    reason = F.when((F.col("outcome") == "ok") & (F.col("n") == 0), "ok_without_match").when((F.col("outcome") != "ok") & (F.col("n") > 0), "match_without_ok")
    return joined.select("run_id", reason.alias("reason")).where("reason IS NOT NULL")


def run_detail(runs: DataFrame, matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Each run with its matches by index and its candidates by rank."""
    m = matches.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("idx", "x", "y", "w", "h", "score", "is_exemplar"))).alias("matches"))
    c = candidates.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("rnk", "x", "y", "w", "h", "score"))).alias("candidates"))
    none_m, none_c = F.array().cast(m.schema["matches"].dataType), F.array().cast(c.schema["candidates"].dataType)
    return runs.join(m, "run_id", "left").join(c, "run_id", "left").withColumns({"matches": F.coalesce("matches", none_m), "candidates": F.coalesce("candidates", none_c)})


def rating_detail(ratings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Each rating with its verdicts by match; null, not empty, where there are none."""
    v = verdicts.groupBy("rating_id").agg(F.sort_array(F.collect_list(F.struct("match_index", "correct"))).alias("verdicts"))
    return ratings.join(v, "rating_id", "left")


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return children.join(parents, key, "left_anti")


def delete_runs(gone: DataFrame, runs: DataFrame, **children: DataFrame) -> dict[str, DataFrame]:
    """runs and each child table without the runs in `gone` (run_id)."""
    ids = gone.select("run_id")
    return {"runs": runs.join(ids, "run_id", "left_anti")} | {k: v.join(ids, "run_id", "left_anti") for k, v in children.items()}


def without_large_heatmap(diagnostics: Column, limit: int = 262144) -> Column:
    """A diagnostics struct with its heatmap dropped where its JSON is over the limit."""
    size = F.octet_length(F.to_json(diagnostics, {"ignoreNullFields": "false"}))
    return F.when(size > limit, diagnostics.withField("similarity_heatmap", F.lit(None).cast("string"))).otherwise(diagnostics)


def config_hash(config: Column) -> Column:
    """sha256 of a config struct's JSON; its fields must be in alphabetic order."""
    return F.sha2(F.to_json(config, {"ignoreNullFields": "false"}), 256)
