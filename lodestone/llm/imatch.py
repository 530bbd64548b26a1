"""I-Match document fingerprints over randomised lexicon subsets; DataFrame operations only.

The lexicon is the terms whose share of documents lies in a band (`LEAST_SHARE` to `MOST_SHARE`, that is an inverse-document-
frequency band), from frequencies over all documents. A document's fingerprint is made of the sorted distinct terms it has
in the lexicon: `FAMILIES` random orders of the lexicon are drawn by hashing, and in each the terms are halved again and again,
which gives nested random subsets of the lexicon; every subset's terms are hashed as one value, 0 where none is left.
Large documents agree after an edit in the sparse subsets, small ones in the dense ones, so the likeness of two
fingerprints is the largest share of agreeing values among the subsets of one density.

A lexicon has a proven bound: a term above LEAST_SHARE needs that share of the documents, so there are at most (mean distinct
terms of a document) / LEAST_SHARE such terms, however many documents. It alone is broadcast, and only below
`BROADCAST_TERMS`; beyond it, the join is left to the planner.

Defined results: null text is the empty one; a text without a lexicon term is fingerprinted by all its terms, a text without
terms by itself, as one value a family, so that likeness follows from the fingerprints alone; the next document of the last is the first, of a single one itself; of rows that
share an id the smallest text is the id's next document; a null id comes after all others; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.common import durable, shuffle_partitions, text_or_empty

LEAST_SHARE = 0.001
MOST_SHARE = 0.1
LEAST_DOCUMENTS = 2
FAMILIES = 8
LEVELS = 12
BROADCAST_TERMS = 1_000_000
NO_ID = -(1 << 63)  # stands for a null id, which comes after all others
SPACES = "[\\x20\\x09-\\x0D]+"


def distinct_terms(text: Column) -> Column:
    """Hashes of the distinct words of the text in lower case."""
    words = F.array_distinct(F.split(F.lower(text), SPACES))
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def without_lexicon(text: Column) -> Column:
    """What stands for a text that has no lexicon term: the hash of its terms in order, or of the text if it has none."""
    terms = F.sort_array(distinct_terms(text))
    return F.transform(F.array(terms), lambda t: F.when(F.size(t) > 0, F.xxhash64(t)).otherwise(F.xxhash64(text)))[0]


def lexicon(docs: DataFrame, least: float = LEAST_SHARE, most: float = MOST_SHARE) -> DataFrame:
    """The terms (hashes) whose document frequency lies in the band; all documents count."""
    n = F.broadcast(docs.agg(F.count("*").alias("_n")))  # one row
    counted = docs.select(F.explode(distinct_terms(text_or_empty())).alias("term")).groupBy("term").agg(F.count("*").alias("_df"))
    return counted.join(n, (F.col("_df") >= F.greatest(F.col("_n") * least, F.lit(float(LEAST_DOCUMENTS)))) & (F.col("_df") <= F.greatest(F.col("_n") * most, F.lit(float(LEAST_DOCUMENTS))))).select("term")


def subset_hashes(terms: Column, alone: Column) -> Column:
    """Sorted terms -> FAMILIES x LEVELS hashes: level 0 of a family has all terms, each further one about half of those before. Without terms, level 0 is made of `alone`."""

    def family(seed: Column) -> Column:
        levels = F.aggregate(
            F.sequence(F.lit(0), F.lit(LEVELS - 1)),
            F.struct(terms.alias("left"), F.array().cast("array<int>").alias("out")),
            lambda acc, level: F.struct(
                F.filter(acc["left"], lambda t: F.bit_get(F.xxhash64(t, seed), level) == 0).alias("left"),
                F.concat(acc["out"], F.array(F.when(F.size(acc["left"]) > 0, F.hash(acc["left"], seed)).when((F.size(terms) == 0) & (level == 0), F.hash(alone, seed)).otherwise(0))).alias("out"),
            ),
        )
        return levels["out"]

    return F.flatten(F.transform(F.sequence(F.lit(1), F.lit(FAMILIES)), family))


def agreement(a: Column, b: Column) -> Column:
    """Per value 1 if both agree, -1 if not, 0 where neither has terms. To be a column of its own, as `likeness` reads it often."""
    return F.zip_with(a, b, lambda x, y: F.when((x == 0) & (y == 0), 0).when(x == y, 1).otherwise(-1))


def likeness(pairs: Column) -> Column:
    """The largest share of agreeing values among subsets of one density that at least half of the families have terms in."""

    def share(level: Column) -> Column:
        values = F.transform(F.sequence(F.lit(0), F.lit(FAMILIES - 1)), lambda f: F.element_at(pairs, f * LEVELS + level + 1))
        sums = F.aggregate(values, F.struct(F.lit(0).alias("same"), F.lit(0).alias("held")), lambda s, v: F.struct((s["same"] + (v == 1).cast("int")).alias("same"), (s["held"] + F.abs(v)).alias("held")))
        return F.transform(F.array(sums), lambda s: F.when(s["held"] >= FAMILIES // 2, s["same"] / s["held"]).otherwise(0.0))[0]

    return F.array_max(F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), share))


def as_text(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda v: F.lpad(F.lower(F.hex(v.cast("bigint").bitwiseAND(0xFFFFFFFF))), 8, "0")), "")


def next_ids(docs: DataFrame) -> DataFrame:
    """(id, next_id): the next lower of the distinct ids, after the last the first. No task holds more than its range of ids."""
    n = shuffle_partitions(docs.sparkSession)
    ids = docs.groupBy("id").agg(F.max(F.floor(F.length("text") / 3)).alias("need"))
    order = F.col("id").desc()
    dealt = durable(ids.repartitionByRange(n, order).withColumn("_part", F.spark_partition_id()))
    inside = dealt.withColumn("_next", F.lead(F.struct("id")).over(W.partitionBy("_part").orderBy(order)))
    heads = dealt.groupBy("_part").agg(F.max_by(F.struct("id"), F.col("id")).alias("_head"))
    around = W.orderBy("_part")
    following = heads.select(F.col("_part").alias("_p"), F.coalesce(F.lead("_head").over(around), F.first("_head").over(around.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("_after"))  # a row for each partition
    return inside.join(F.broadcast(following), F.col("_part") == F.col("_p")).select("id", F.coalesce("_next", "_after")["id"].alias("next_id"), "need")


def fingerprint_pairs(both: DataFrame, terms: DataFrame, about: Column) -> DataFrame:
    """(id, text, edited) -> (id, about, own, edit, rows): the values of both texts, with how many rows were equal.

    Terms are joined with the lexicon and gathered again by id, for which the rows stay in the partitions they are in.
    What is told about a row goes along with one of its exploded entries only.
    """
    entry = "struct<term:bigint,which:int,about:" + both.select(about.alias("a")).schema["a"].dataType.simpleString() + ">"

    def entries(text: str, which: int) -> Column:
        return F.transform(distinct_terms(F.col(text)), lambda t: F.struct(t.alias("term"), F.lit(which).alias("which"), F.lit(None).alias("about")).cast(entry))

    first = F.array(F.struct(F.lit(None).alias("term"), F.lit(0).alias("which"), about.alias("about")).cast(entry))
    exploded = both.select("id", F.xxhash64("text").alias("hash"), F.explode(F.concat(first, entries("text", 1), entries("edited", 2))).alias("e")).select("id", "hash", "e.*")
    in_lexicon = terms.select(F.col("term").alias("known"))
    kept = exploded.join(in_lexicon, F.col("term") == F.col("known"), "left").where((F.col("which") == 0) | F.col("known").isNotNull())

    def gathered(which: int) -> Column:
        return F.sort_array(F.array_distinct(F.collect_list(F.when(F.col("which") == which, F.col("term")))))

    found = kept.groupBy("id", "hash").agg(F.first("about", ignorenulls=True).alias("about"), gathered(1).alias("a"), gathered(2).alias("b"), F.count_if(F.col("which") == 0).alias("rows"))
    own, edit = subset_hashes(F.col("a"), F.col("about.alone")), subset_hashes(F.col("b"), F.col("about.edit_alone"))
    return found.select("id", "about", own.alias("own"), edit.alias("edit"), "hash", "rows")


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: its fingerprint, that of its edited text, and their likeness."""
    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID).cast("bigint")).alias("id"), text_or_empty().alias("text"))
    terms = durable(lexicon(docs))
    if terms.count() <= BROADCAST_TERMS:
        terms = F.broadcast(terms)
    pairs = next_ids(rows)
    lent = (  # for each id, the beginning of the next one's text, as long as its own longest text needs
        rows.join(pairs.select(F.col("id").alias("for_id"), F.col("next_id").alias("id"), "need"), "id")
        .groupBy(F.col("for_id").alias("id"))
        .agg(F.min(F.struct(F.expr("substring(text, 1, int(need))").alias("head"), F.xxhash64("text").alias("hash"), F.col("id").alias("next_id"))).alias("lent"))
    )
    both = rows.join(lent, "id").select(
        "id",
        "text",
        F.expr("concat(substring(text, 1, length(text) - int(floor(length(text) / 3))), substring(lent.head, 1, int(floor(length(text) / 3))))").alias("edited"),
        "lent.next_id",
        F.col("lent.hash").alias("next_hash"),
    )
    about = F.struct(F.length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), without_lexicon(F.col("text")).alias("alone"), without_lexicon(F.col("edited")).alias("edit_alone"), "next_id", "next_hash")
    found = durable(fingerprint_pairs(both, terms, about))
    following = found.select(F.col("id").alias("next_id"), F.col("hash").alias("next_hash"), F.col("own").alias("next_own"))
    return (
        found.select("id", "hash", "about.*", "own", "edit", "rows")
        .join(following, ["next_id", "next_hash"])
        .withColumns({"with_edit": agreement(F.col("own"), F.col("edit")), "with_next": agreement(F.col("own"), F.col("next_own"))})
        .withColumn("_", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
        .select(
            F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"),
            "n_chars",
            "edited_sha256",
            as_text(F.col("own")).alias("fingerprint"),
            as_text(F.col("edit")).alias("edited_fingerprint"),
            likeness(F.col("with_edit")).alias("near_edited"),
            likeness(F.col("with_next")).alias("near_next"),
        )
    )
