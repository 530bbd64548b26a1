"""Near-duplicate documents by an inverted join over the coordinates of MinHash signatures.

A document's set is its distinct five-word shingles. Equal sets form a class, and the work goes on with classes.
A class is posted under each (coordinate, value) of its signature of `COORDINATES` minima. Sets of a similarity of at least
`SIMILAR` agree in `MATCHES` or more coordinates but for a chance of less than one in a million (9.5e-7, binomial); so

* prefix: ordered from rare to common, two such signatures share a posting among the first COORDINATES - MATCHES + 1 of
  both. Only these lists are merged; the later, more common postings are skipped, and looked up when a pair's collisions
  are counted; classes with too few shared postings drop out;
* skip: lists whose classes are all in one component already are left out, and within a list only pairs across components
  are formed;
* collisions: pairs below MATCHES collisions are dropped; the others are confirmed on full sets.

First each class is held against its lists' centres, which links large groups by no more pairs than they have postings. Then every pair left across components is looked at, so that no link between components is lost. Lists of up to
`SHORT` classes give their pairs. The classes of longer lists are posted once more, now exactly (`refined_pairs`): under those
of their shingles that are rarest among these classes, by lengths. Classes that share a passage but little else have no such
shingle in common and meet nowhere, however many they are.

Components come by contraction: in each round every node joins the one of least random rank among itself and its
neighbours, which about halves a chain and joins a star at once; what is left when no more than `FINISH` links remain is joined
in one task. There is no cap on rounds. All steps are kept in the checkpoint folder.

Defined results: null or wordless texts have an empty set, are linked with nothing and kept; fewer than five words are one
shingle; rows may repeat and ids too (a component's id is the smallest id of its rows, a null id counts as none); an empty
table gives no rows.
"""

from __future__ import annotations

from math import lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import durable, ship, stored
from lodestone.llm.textvec import ODD, blank_table, chunks, lower_table, mix, powers, segments, word_hashes

SHINGLE = 5
COORDINATES = 48
MATCHES = 21
PREFIX = COORDINATES - MATCHES + 1
SIMILAR = (75, 100)
CHUNK = 1 << 20
SHORT = 32
SPAN = 1.05
FINISH = 2_000_000


def factors(n: int, start: int) -> np.ndarray:
    return mix(np.arange(start, start + n, dtype=np.uint64) * ODD) | np.uint64(1)


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of the text) of all shingles, in the order of the texts."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = lower_table()[np.frombuffer(b"\n".join([*raw, b""]), np.uint8)]
    inside = blank_table()[data]
    starts, ends = segments(inside)
    words = word_hashes(data, starts, ends, inside, powers())
    owner = np.searchsorted(np.cumsum([len(x) + 1 for x in raw]), starts, side="right")
    count, weights = np.bincount(owner, minlength=len(texts)), factors(SHINGLE, 1)
    parts, owners = [], []
    n = len(words) - SHINGLE + 1
    if n > 0:
        h = words[:n] * weights[0]
        for i in range(1, SHINGLE):
            h = h + words[i : n + i] * weights[i]
        whole = owner[:n] == owner[SHINGLE - 1 :]
        parts.append(mix(h[whole]))
        owners.append(owner[:n][whole])
    few = np.flatnonzero((count > 0) & (count < SHINGLE))
    if len(few):
        first = np.concatenate(([0], np.cumsum(count)))[few]
        h = count[few].astype(np.uint64) * ODD
        for i in range(SHINGLE - 1):
            held = i < count[few]
            h[held] += words[first[held] + i] * weights[i]
        parts.append(mix(h))
        owners.append(few)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return hashes[order], owner[order]


def sets_of(texts: list[str]):
    """The sorted set of each text."""
    hashes, owner = shingles(texts)
    at = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [np.unique(hashes[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def node_of(found: np.ndarray) -> int:
    """A set's own 64-bit name, from two sums over its members."""
    sums = np.array([found.sum(dtype=np.uint64), mix(found ^ ODD).sum(dtype=np.uint64), len(found)], np.uint64)
    return int(mix(sums[:1] * ODD ^ sums[1:2] ^ sums[2:]).view(np.int64)[0])


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, node (the set's name), signature (null for an empty set), text_key (the text's hash)."""

    def run(batches):
        by = factors(COORDINATES, 1000)
        for batch in batches:
            for first, texts in chunks([t or "" for t in batch.column(1).to_pylist()], CHUNK):
                found = sets_of(texts)
                sizes = np.array([len(x) for x in found])
                flat = np.concatenate(found)
                held = np.flatnonzero(sizes)
                at = np.concatenate(([0], np.cumsum(sizes)))[held]
                minima = np.zeros((len(held), COORDINATES), np.int32)
                for k in range(COORDINATES if len(held) else 0):
                    minima[:, k] = np.minimum.reduceat((flat * by[k]) >> np.uint64(32), at).astype(np.uint32).view(np.int32)
                ends = np.concatenate(([0], np.cumsum((sizes > 0) * COORDINATES)))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(minima.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(sizes, pa.int64()), pa.array([node_of(x) for x in found], pa.int64()), lists, batch.column(2).slice(first, len(texts))], names=["doc_id", "n_shingles", "node", "signature", "text_key"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(run, "doc_id bigint, n_shingles bigint, node bigint, signature array<int>, text_key bigint")


def full_sets(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """(node, members) for needed (node, doc_id): only these documents' texts are hashed again."""
    ids = needed.select(F.col("doc_id").alias("_id")).distinct()

    def run(batches):
        for batch in batches:
            for _, texts in chunks([t or "" for t in batch.column(0).to_pylist()], CHUNK):
                found = [x for x in sets_of(texts) if len(x)]
                ends = np.concatenate(([0], np.cumsum([len(x) for x in found])))
                flat = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([node_of(x) for x in found], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=["node", "members"])

    texts = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("_id"))).select("text")
    return texts.mapInArrow(run, "node bigint, members array<bigint>").join(needed.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])


def alike(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """pairs (a, b) with `same`, the number of coordinates in which their signatures agree, where that reaches MATCHES."""
    a = nodes.select(F.col("node").alias("a"), F.col("signature").alias("sig_a"))
    b = nodes.select(F.col("node").alias("b"), F.col("signature").alias("sig_b"))
    same = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return pairs.join(a, "a").join(b, "b").select("a", "b", same.alias("same")).where(F.col("same") >= MATCHES)


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets have the similarity."""
    a = sets.select(F.col("node").alias("a"), F.col("members").alias("set_a"))
    b = sets.select(F.col("node").alias("b"), F.col("members").alias("set_b"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    scale = lcm(*SIMILAR) // SIMILAR[1]
    joined = pairs.join(a, "a").join(b, "b").select("a", "b", both.alias("both"), (F.size("set_a") + F.size("set_b")).alias("sum"))
    return joined.where(F.col("both") * (SIMILAR[1] * scale) >= (F.col("sum") - F.col("both")) * (SIMILAR[0] * scale)).select("a", "b")


def joined_in_one_task(links: DataFrame) -> DataFrame:
    """(node, label) of links (a, b), at most FINISH of them: every node with the least one that it reaches."""

    def run(batches):
        ends = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if ends:
            a, b = (np.concatenate([e[i] for e in ends]) for i in (0, 1))
            names, where = np.unique(np.concatenate([a, b]), return_inverse=True)
            a, b = where[: len(a)], where[len(a) :]
            root = np.arange(len(names))
            while True:
                low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
                apart = low != high
                if not apart.any():
                    break
                a, b = a[apart], b[apart]
                np.minimum.at(root, high[apart], low[apart])
                while (further := root[root]).tobytes() != root.tobytes():
                    root = further
            for at in range(0, len(names), 100_000):
                part = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(names[part]), pa.array(names[root[part]])], names=["node", "label"])

    return links.coalesce(1).mapInArrow(run, "node bigint, label bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of the nodes that have an edge: label is one node of the component, the same for all of it."""
    tidy = lambda df: durable(df.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    left, rounds = tidy(edges), []
    while left.count() > FINISH:
        ranked = lambda c: F.struct(F.xxhash64(F.lit(len(rounds)), F.col(c)).alias("rank"), F.col(c).alias("node"))  # noqa: B023, E731
        both = left.union(left.select("b", "a"))
        chosen = durable(both.groupBy("a").agg(F.min(ranked("b")).alias("near")).select(F.col("a").alias("node"), F.least(ranked("a"), "near")["node"].alias("to")))
        of = lambda end: chosen.select(F.col("node").alias(end), F.col("to").alias(f"to_{end}"))  # noqa: B023, E731
        left = tidy(left.join(of("a"), "a").join(of("b"), "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b")))
        rounds.append(chosen)
    labels = durable(joined_in_one_task(left))
    for chosen in reversed(rounds):  # a node without links in the next round is its own label there
        labels = durable(chosen.join(labels.withColumnRenamed("node", "to"), "to", "left").select("node", F.coalesce("label", "to").alias("label")))
    return labels


def posted(nodes: DataFrame) -> DataFrame:
    """(key, node, central): the prefix of each signature's postings, from rare to common, in lists of two and more.

    central is the larger, the more common a class's values are: the unedited middle of a group has the most.
    """
    postings = nodes.select("node", F.posexplode("signature").alias("at", "value")).select("node", (F.shiftleft(F.col("at").cast("bigint"), 32) + F.col("value").cast("bigint").bitwiseAND(0xFFFFFFFF)).alias("key"))
    shared = postings.groupBy("key").agg(F.count("*").alias("f")).where("f > 1")
    own = postings.join(shared, "key").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("f", "key"))).alias("own"))
    room = F.size("own") - (COORDINATES - PREFIX)  # postings of this class alone come first
    central = F.aggregate("own", F.lit(0).cast("bigint"), lambda n, p: n + p["f"])
    return own.where(room > 0).select("node", central.alias("central"), F.explode(F.slice("own", 1, room)).alias("p")).select("node", "central", "p.key")


def star_pairs(lists: DataFrame) -> DataFrame:
    """Each class with the centres of its lists: as many pairs as postings at most."""
    ends = lists.groupBy("key").agg(F.max(F.struct("central", "node")).alias("top"), F.count("*").alias("n")).where("n > 1").select("key", F.col("top.node").alias("end"))
    joined = lists.join(ends, "key").where("node <> end")
    return joined.select(F.least("node", "end").alias("a"), F.greatest("node", "end").alias("b")).distinct()


def open_lists(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, node, label, size) of the lists that have more than one component."""
    own = lists.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    held = own.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size")).where("low <> high")
    return own.join(held.select("key", "size"), "key")


def short_pairs(held: DataFrame) -> DataFrame:
    """All pairs across components in the short lists: fewer than SHORT a posting."""
    short = held.where(F.col("size") <= SHORT)
    left = short.select("key", F.col("node").alias("a"), F.col("label").alias("label_a"))
    right = short.select("key", F.col("node").alias("b"), F.col("label").alias("label_b"))
    return left.join(right, "key").where("a < b and label_a <> label_b").select("a", "b").distinct()


def up(n: Column, by: int) -> Column:
    """n / by, rounded up, in integers."""
    return F.floor((n + (by - 1)) / by)


def least_both(size: Column, other: Column) -> Column:
    """The fewest members that sets of these sizes share at the similarity."""
    return up((size + other) * SIMILAR[0], sum(SIMILAR))


def span_of(size: Column) -> Column:
    return F.floor(F.log(size) / float(np.log(SPAN)) + 1e-9).cast("int")


def refined_pairs(own: DataFrame) -> DataFrame:
    """Pairs (a, b) across labels among own (node, label, members): all that reach the similarity and few others.

    Members are ordered from rare to common among these classes. Two alike sets share a member that comes early in both: so early
    that what follows it still suffices for the members they must share. The smaller of two sets (of equal ones that of the lesser
    node) is posted under its early members with the span of sizes it is in; the larger asks under its own, for each span that
    is in reach, and the nearer the sizes, the earlier they are. In lists of several labels, those outside the commonest meet all,
    the commonest only them.
    """
    sized = own.withColumn("size", F.size("members").cast("bigint"))
    each = sized.select("node", "label", "size", F.explode("members").alias("member"))
    common = each.groupBy("member").agg(F.count("*").alias("f")).where("f > 1")
    ordered = each.join(common, "member").groupBy("node", "label", "size").agg(F.sort_array(F.collect_list(F.struct("f", "member"))).alias("own"))
    placed = ordered.select("node", "label", "size", (F.col("size") - F.size("own")).alias("alone"), F.posexplode("own").alias("at", "p"))
    placed = placed.select("node", "label", "size", "p.member", (F.col("alone") + F.col("at")).alias("at"))
    size, at = F.col("size"), F.col("at")
    fewest = up(size * SIMILAR[0], SIMILAR[1])
    index = placed.where(at <= size - least_both(size, size)).select("*", span_of(size).alias("span"), F.lit(False).alias("asks"))
    least_in = F.greatest(F.floor(F.pow(F.lit(SPAN), F.col("span")) * (1 - 1e-6)), fewest)
    asks = placed.where(at <= size - least_both(size, fewest)).select("*", F.explode(F.sequence(span_of(fewest), span_of(size))).alias("span"))
    asks = asks.where(at <= size - least_both(size, least_in)).select("*", F.lit(True).alias("asks"))
    rows = durable(index.union(asks))
    by_label = rows.groupBy("member", "span", "label").agg(F.count("*").alias("n"), F.max("asks").alias("some_ask"), F.min("asks").alias("all_ask"))
    lists = by_label.groupBy("member", "span").agg(F.max(F.struct("n", "label")).alias("most"), F.count("*").alias("labels"), F.max("some_ask").alias("some_ask"), F.min("all_ask").alias("all_ask"))
    lists = lists.where("labels > 1 and some_ask and not all_ask").select("member", "span", F.col("most.label").alias("most"))
    held = durable(rows.join(lists, ["member", "span"]).withColumn("outside", F.col("label") != F.col("most")).drop("most"))
    large = held.where("asks").select("member", "span", "outside", F.col("node").alias("x"), F.col("label").alias("label_x"), F.col("size").alias("size_x"), F.col("at").alias("at_x"))
    small = held.where("not asks").select("member", "span", F.col("outside").alias("outside_y"), F.col("node").alias("y"), F.col("label").alias("label_y"), F.col("size").alias("size_y"), F.col("at").alias("at_y"))
    room = F.least(F.col("size_x") - F.col("at_x"), F.col("size_y") - F.col("at_y"))
    fits = (F.col("label_x") != F.col("label_y")) & (F.struct("size_y", "y") < F.struct(F.col("size_x").alias("size_y"), F.col("x").alias("y"))) & (room >= least_both(F.col("size_x"), F.col("size_y")))
    on = ["member", "span"]
    pairs = large.where("outside").join(small, on).where(fits).select("x", "y").union(large.where("not outside").join(small.where("outside_y"), on).where(fits).select("x", "y"))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def linked(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: doc_id, n_shingles, text_key, label (one node of the component) and component_id, both null for an empty set."""
    signed = stored(signatures(docs))
    full = signed.where("n_shingles > 0")
    every = stored(full.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("signature").alias("signature")))
    lists = durable(posted(every))
    nodes = durable(every.join(lists.select("node").distinct(), "node"))
    sets = stored(full_sets(docs, nodes.select("node", "doc_id")))
    links = durable(confirmed(alike(star_pairs(lists), nodes).select("a", "b"), sets))
    labels = components(links)
    held = durable(open_lists(lists, labels))
    rest = confirmed(alike(short_pairs(held), nodes).select("a", "b"), sets)
    long = held.where(F.col("size") > SHORT).select("node", "label").distinct()
    if not long.isEmpty():
        rest = rest.union(confirmed(refined_pairs(long.join(sets, "node")), sets))
    rest = durable(rest)
    if not rest.isEmpty():
        labels = components(links.union(rest))
    named = every.select("node", F.col("doc_id").alias("least")).join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "least")
    ids = named.groupBy("label").agg(F.min("least").alias("component_id"))
    of_node = durable(named.join(ids, "label").select(F.col("node").alias("_node"), "label", "component_id"))
    return signed.join(of_node, (F.col("node") == F.col("_node")) & (F.col("n_shingles") > 0), "left").select("doc_id", "n_shingles", "text_key", "label", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: doc_id, n_shingles, component_id, kept."""
    joined = linked(docs)
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each component, that of the smallest id (null ids last; of that id's texts, the one of the smallest hash); wordless texts all stay."""
    full = F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("row")
    kept = linked(docs).where("n_shingles > 0").groupBy("label").agg(least).select(F.col("row.doc_id").alias("_id"), F.col("row.text_key").alias("_key"))
    keyed = docs.where(full).withColumn("_text_key", F.xxhash64("text"))
    mine = keyed.join(kept, (F.col("_text_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").dropDuplicates(["doc_id", "_text_key"])
    return mine.drop("_text_key").union(docs.where(~full))


NEAR_DUPLICATES_SQL = f"""WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' '))) END AS members FROM t),
n AS (SELECT doc_id, len(members) AS n FROM s), m AS (SELECT doc_id, unnest(members) AS member FROM s),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS held FROM m a JOIN m b ON a.member = b.member AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE {SIMILAR[1]} * held >= {SIMILAR[0]} * (x.n + y.n - held)),
ends AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM reach r JOIN ends e ON e.a = r.b),
least_of AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN least_of ON a = doc_id"""


ship(__name__)
