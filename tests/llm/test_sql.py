"""Operators and the pipeline against SQL and plain counting over whole small tables."""

import math
from collections import Counter, defaultdict

import duckdb
import pytest

from lodestone.llm import neardup, queries, sharding

SF = "/root/testdata/sf0.001"
WORDS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()
ODD = [None, "", " \t\n", "a", "A", "a b c d", "A b C d", "Ä ö ü ß €", "x" * 30_000, " ".join(WORDS), " ".join(WORDS), " ".join([*WORDS, "more"]), " ".join(WORDS[:14]), "\x0b\x1f\xa0", "a,b c d e f g"]


def rows_of(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, _part string, size int")


def by_sql(docs, sql):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toArrow())
    found = con.execute(sql)
    return [c[0] for c in found.description], sorted(found.fetchall(), key=str)


@pytest.mark.parametrize("report, sql", [(neardup.near_duplicates, neardup.NEAR_DUPLICATES_SQL), (sharding.shard_report, sharding.SHARD_SQL)])
def test_equals_sql(spark, report, sql):
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), rows_of(spark, ODD), rows_of(spark, [])):
        columns, want = by_sql(docs, sql)
        assert sorted(map(tuple, report(docs).select(*columns).collect()), key=str) == want


def test_shards_of_null_and_repeated_ids(spark):
    docs = rows_of(spark, ODD, [None, 3, 3, None, *range(len(ODD) - 4)])
    columns, want = by_sql(docs, sharding.SHARD_SQL)
    got = sharding.shard_report(docs).select(*columns).collect()
    assert sorted(map(tuple, got), key=str) == want


def test_pipeline_from_end_to_end(spark):
    """Each stage's decisions are seen in the last one's rows: pieces of a document repeat as often as the mix takes it."""
    import corpus_pipeline

    docs = corpus_pipeline.documents(spark, SF)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF).persist()
        assert kept.columns == docs.columns, name
        before, after = {r.doc_id for r in docs.collect()}, Counter(r.doc_id for r in kept.collect())
        assert set(after) <= before and (name == "mixing" or max(after.values()) == 1)
        if name == "near_dedup":
            _, groups = by_sql(docs, neardup.NEAR_DUPLICATES_SQL)
            assert set(after) == {r[0] for r in groups if r[3]}
        docs = kept
    copies = Counter(r.doc_id for r in docs.collect())
    pieces = corpus_pipeline.run(spark, SF).collect()
    places, heads = defaultdict(list), Counter()
    for p in pieces:
        places[p.sequence_id].append((p.offset, p.length))
        heads[p.doc_id] += p.piece == 0
    assert heads == copies
    assert all(sum(n for _, n in held) <= 1024 and all(a + n == b for (a, n), (b, _) in zip(sorted(held), sorted(held)[1:])) and min(held)[0] == 0 for held in places.values())
    assert len(places) <= math.ceil(sum(p.length for p in pieces) / 1024) * 1.05 + 1


def test_registered_sql_names_queries():
    assert set(queries.ORACLES) <= set(queries.QUERIES)
