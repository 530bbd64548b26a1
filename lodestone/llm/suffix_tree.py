"""A probabilistic suffix tree over bytes as language model, and a word-frequency baseline beside it.

A text is its words, A-Z in lower case, each followed by one boundary symbol, and an end symbol. Symbols are the UTF-8 bytes, so
that no character of any script stands outside the model. Contexts have variable length:

* every string of `DEPTH` symbols and the next one is counted exactly over all training texts: in each task by sorting, then
  in one shuffle of sorted arrays, which alone tells how often each shorter context and its next symbols occur;
* a context is retained by evidence alone: if it has `LEAST_COUNT` occurrences and its next-symbol distribution diverges from that
  of its longest retained suffix by `DIVERGENCE` nats a symbol and by `EVIDENCE` nats over all its occurrences. None of
  these depends on the corpus' size, on its partitions or on the order of its rows, and the tree grows with the corpus;
* distributions are smoothed towards that of the longest retained suffix, down to the root's;
* a symbol is scored in the longest retained suffix of what precedes it.

Counts and the tree stay in tables. Contexts are learned in partitions by their three newest symbols, as a context, its
extensions and all but its shortest suffixes agree in these; contexts of up to two symbols are learned on the driver (at most 2^24
counts). For scoring the tree is broadcast in slices of up to `SLICE` counts, ranges of the two newest symbols; each further
slice is a further pass over the texts, in which only the symbols that follow its contexts are scored.
Word counts have no bound: words above `FREQUENT` of all tokens (at most 1 / FREQUENT) are looked up in a broadcast table,
the rest by a join.

Defined results: null text is the empty one, which has the end token alone; a null id is in no held-out part and its text is
learned from; without training rows all symbols are equally likely; repeated rows count and are scored each.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import durable, id_remainder, ship, shuffle_partitions, stored
from lodestone.llm.textvec import blank_table, chunks, lower_table, powers, segments, word_hashes

HELD_OUT = (7, 2)
DEPTH = 6
SHALLOW = 2  # contexts learned on the driver
SPACE, END = 32, 10  # both are bytes that no word has
LEAST_COUNT = 50
DIVERGENCE = 0.01
EVIDENCE = 100.0
SMOOTHING = 24.0
FREQUENT = 5e-7
SLICE = 8_000_000
HELD = 2_000_000
ROW = 512
WINDOW = 1 << 21
CHUNK = 1 << 21
SPREAD = 0x9E3779B97F4A7C15  # odd, to spread keys over buckets
END_WORD = 0x5E2D58D8B3BCDF1A  # the end token's place among word hashes


def prepared(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, A-Z lowered, each text followed by a line end; whether in a word; where the texts' line ends are)."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = lower_table()[np.frombuffer(b"\n".join([*raw, b""]), np.uint8)]
    return data, blank_table()[data], np.cumsum([len(x) + 1 for x in raw]) - 1


def stream(data: np.ndarray, inside: np.ndarray, line_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols with DEPTH ends before the first text; where each text's own end is). A text's symbols follow the end of the one before."""
    kept = inside.copy()
    kept[1:] |= inside[:-1] & ~inside[1:]  # one boundary after each word
    kept[line_ends] |= ~inside[line_ends]
    symbols = np.where(inside, data, np.uint8(SPACE))
    # a text's last word touches its line end, which is then both boundary and end
    double = np.zeros(len(data), bool)
    double[line_ends] = (line_ends > 0) & inside[np.maximum(line_ends - 1, 0)]
    double[line_ends[1:][np.diff(line_ends) == 1]] = False
    symbols[line_ends] = END
    times = kept.astype(np.int64) + double
    out = np.repeat(symbols, times)
    at = np.cumsum(times) - 1
    extra = at[line_ends[double[line_ends]]] - 1
    out[extra] = SPACE
    return np.concatenate([np.full(DEPTH, END, np.uint8), out]), at[line_ends] + DEPTH


def strings(symbols: np.ndarray, first: int, last: int) -> np.ndarray:
    """For the places from first to last: their symbol, then those before it, newest first, a byte each. What lies before a text counts as ends."""
    code = symbols[first:last].astype(np.uint64)
    known = np.ones(last - first, bool)
    for i in range(1, DEPTH + 1):
        x = symbols[first - i : last - i]
        code = code << np.uint64(8) | np.where(known, x, np.uint8(END))
        known &= x != END
    return code


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys)
    return totals(keys[order], n[order])


def totals(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys with their summed counts."""
    if not len(keys):
        return keys, n
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(n, first)


class Counter:
    """Sums of counts by key."""

    def __init__(self, kind: int):
        self.kind, self.parts, self.held = kind, [], 0

    def add(self, keys: np.ndarray) -> None:
        self.put(*np.unique(keys, return_counts=True))

    def put(self, keys: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((keys, n))
        self.held += len(keys)

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        keys, n = summed(self.parts) if self.parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.parts, self.held = [(keys, n)], len(keys)
        return keys, n

    def buckets(self, count: int, final: bool):
        """What exceeds HELD keys, or all at last, as rows of up to ROW keys of one bucket: their bytes and those of their counts."""
        if not final and (self.held <= HELD or len(self.sums()[0]) <= HELD // 2):
            return
        keys, n = self.sums()
        self.parts, self.held = [], 0
        alike = keys >> np.uint64(16)  # strings that differ in their two oldest symbols alone stay neighbours, which compresses them
        bucket = ((alike * np.uint64(SPREAD) >> np.uint64(32)) % np.uint64(count)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        bucket, keys, n = bucket[order], keys[order], n[order]
        size = np.bincount(bucket, minlength=count)
        inside = np.arange(len(keys)) - np.repeat(np.cumsum(size) - size, size)
        first = np.flatnonzero(inside % ROW == 0)
        ends = np.append(first[1:], len(keys))
        for at in range(0, len(first), 1000):
            spans = list(zip(first[at : at + 1000], ends[at : at + 1000], strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[first[at : at + 1000]]), pa.array(np.full(len(spans), self.kind, np.int32)), *(pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()) for x in (keys, n))],
                names=["bucket", "kind", "keys", "counts"],
            )


def survey(docs: DataFrame) -> DataFrame:
    """(kind, key, n) over all training texts: 0 words by hash, 1 strings of a symbol and the DEPTH before it.

    Counts go through one shuffle as arrays, by buckets of keys; a task adds up its buckets, and holds each key once.
    """
    partitions = shuffle_partitions(docs.sparkSession)
    count = 8 * partitions

    def run(batches):
        pows, words, found = powers(), Counter(0), Counter(1)
        for batch in batches:
            for _, texts in chunks([t or "" for t in batch.column(0).to_pylist()], CHUNK):
                data, inside, line_ends = prepared(texts)
                starts, ends = segments(inside)
                words.add(np.concatenate([word_hashes(data, starts, ends, inside, pows), np.full(len(texts), END_WORD, np.uint64)]))
                symbols, _ = stream(data, inside, line_ends)
                for first in range(DEPTH, len(symbols), WINDOW):
                    found.add(strings(symbols, first, min(first + WINDOW, len(symbols))))
                    yield from found.buckets(count, False)
                yield from words.buckets(count, False)
        yield from words.buckets(count, True)
        yield from found.buckets(count, True)

    def add_up(batches):
        counters = Counter(0), Counter(1)
        for batch in batches:
            for kind, keys, n in zip(*(batch.column(c) for c in ("kind", "keys", "counts")), strict=True):
                counter = counters[kind.as_py()]
                counter.put(np.frombuffer(keys.as_buffer(), np.uint64), np.frombuffer(n.as_buffer(), np.int64))
                if counter.held > max(HELD, 2 * len(counter.parts[0][0])):
                    counter.sums()
        for counter in counters:
            keys, n = counter.sums()
            for at in range(0, len(keys), 100_000):
                part = keys[at : at + 100_000].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), counter.kind, np.int32)), pa.array(part), pa.array(n[at : at + 100_000])], names=["kind", "key", "n"])

    sent = docs.select("text").mapInArrow(run, "bucket int, kind int, keys binary, counts binary")
    return sent.repartition(partitions, "bucket").mapInArrow(add_up, "kind int, key bigint, n bigint")


def shorter(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context, next symbol) keys with the oldest symbol of the contexts left out."""
    cut = keys >> np.uint64(16) << np.uint64(8) | keys & np.uint64(255)
    order = np.argsort(cut)
    return totals(cut[order], n[order])


def learn(keys: np.ndarray, n: np.ndarray, above: np.ndarray, p_above: np.ndarray):
    """One depth: the counts of (context, next symbol) keys against the probabilities of the depth above.

    Returns each key's context total, whether its context is retained, and its probability.
    """
    context = keys >> np.uint64(8)
    first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1]))) if len(keys) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(keys)))
    total = np.add.reduceat(n, first).astype(np.float64) if len(keys) else np.zeros(0)
    before = p_above[np.searchsorted(above, keys >> np.uint64(16) << np.uint64(8) | keys & np.uint64(255))]
    each = np.repeat(total, size)
    own = (n + SMOOTHING * before) / (each + SMOOTHING)
    left = SMOOTHING / (total + SMOOTHING)  # what an unseen next symbol's probability is multiplied by
    if len(keys):
        unseen = np.maximum(1 - np.add.reduceat(before, first), 0)
        gain = np.add.reduceat(own * np.log(own / before), first) + left * unseen * np.log(left)
        kept = np.repeat((total >= LEAST_COUNT) & (gain >= DIVERGENCE) & (gain * total >= EVIDENCE), size)
    else:
        kept = np.zeros(0, bool)
    return each.astype(np.int64), kept, np.where(kept, own, before)


def root(n: np.ndarray) -> np.ndarray:
    return (n + 0.5) / (n.sum() + 128.0)


def shallow_levels(keys: np.ndarray, n: np.ndarray) -> tuple[list, np.ndarray, np.ndarray]:
    """From the counts of (SHALLOW newest symbols, next symbol): the model's rows (depth, keys, n, totals), and the last depth's keys and probabilities."""
    levels = [(keys, n)]
    for _ in range(SHALLOW):
        levels.insert(0, shorter(*levels[0]))
    counts = np.zeros(256)
    counts[levels[0][0].astype(np.int64)] = levels[0][1]
    above, p = np.arange(256, dtype=np.uint64), root(counts)
    rows = [(0, levels[0][0], levels[0][1], np.full(len(levels[0][0]), counts.sum(), np.int64))]
    for depth in range(1, SHALLOW + 1):
        keys, n = levels[depth]
        total, kept, p = learn(keys, n, above, p)
        above = keys
        rows.append((depth, keys[kept], n[kept], total[kept]))
    return rows, above, p


def deep_levels(codes: np.ndarray, n: np.ndarray, above: np.ndarray, p: np.ndarray):
    """From all strings of some newest symbols: the model's rows (depth, keys, n, totals) below SHALLOW."""
    keys = (codes & np.uint64((1 << 8 * DEPTH) - 1)) << np.uint64(8) | codes >> np.uint64(8 * DEPTH)
    order = np.argsort(keys)
    levels = [totals(keys[order], n[order])]
    for _ in range(DEPTH - SHALLOW - 1):
        levels.insert(0, shorter(*levels[0]))
    for depth, (keys, n) in enumerate(levels, SHALLOW + 1):
        total, kept, p = learn(keys, n, above, p)
        above = keys
        yield depth, keys[kept], n[kept], total[kept]


def grown(found: DataFrame) -> tuple[DataFrame, tuple]:
    """(the table of the contexts deeper than SHALLOW, the arrays of the others): depth, key (context newest first, next symbol), n, total."""
    spark = found.sparkSession
    whole = found.where("kind = 1").select(F.col("key").alias("code"), "n")
    newest = F.shiftright("code", 8 * (DEPTH - SHALLOW)).bitwiseAND((1 << 8 * SHALLOW) - 1)  # code: symbol, newest, ..., oldest
    symbol = F.shiftright("code", 8 * DEPTH)
    low = whole.groupBy((F.shiftleft(newest, 8) + symbol).alias("key")).agg(F.sum("n").alias("n")).toArrow()  # at most 2^24 rows
    keys, n = low.column("key").to_numpy().astype(np.uint64), low.column("n").to_numpy()
    order = np.argsort(keys)
    rows, above, p = shallow_levels(keys[order], n[order])
    sent = spark.sparkContext.broadcast((above, p))

    def run(batches):
        above, p = sent.value
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if held:
            codes, n = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            for depth, keys, n, total in deep_levels(codes.view(np.uint64), n, above, p):
                for at in range(0, len(keys), 100_000):
                    part = slice(at, at + 100_000)
                    size = len(keys[part])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(size, depth, np.int32)), pa.array(keys[part].view(np.int64)), pa.array(n[part]), pa.array(total[part])], names=["depth", "key", "n", "total"])

    group = F.shiftright("code", 8 * (DEPTH - 3)).bitwiseAND((1 << 24) - 1)
    deep = whole.repartition(shuffle_partitions(spark), group).mapInArrow(run, "depth int, key bigint, n bigint, total bigint")
    return durable(deep), rows


class Tree:
    """For each depth the sorted (context, next symbol) keys with counts, and the contexts with totals."""

    def __init__(self, rows: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]):
        self.levels = []
        self.root = np.full(256, 1 / 256)
        for depth in range(DEPTH + 1):
            own = [r for r in rows if r[0] == depth]
            keys, n, total = (np.concatenate([r[i] for r in own]) if own else np.zeros(0, np.int64) for i in (1, 2, 3))
            keys = keys.astype(np.uint64)
            if depth == 0:
                counts = np.zeros(256)
                counts[keys.astype(np.int64)] = n
                self.root = root(counts)
                continue
            order = np.argsort(keys)
            keys, n, total = keys[order], n[order], total[order]
            first = np.flatnonzero(np.concatenate(([True], keys[1:] >> np.uint64(8) != keys[:-1] >> np.uint64(8)))) if len(keys) else np.zeros(0, np.int64)
            self.levels.append((keys, n.astype(np.float32), keys[first] >> np.uint64(8), total[first].astype(np.float32)))

    def probabilities(self, codes: np.ndarray) -> np.ndarray:
        """Of the first symbol of each string after those behind it."""
        symbol = codes >> np.uint64(8 * DEPTH)
        p = self.root[symbol.astype(np.int64)]
        context = codes & np.uint64((1 << 8 * DEPTH) - 1)
        for depth, (keys, n, contexts, total) in enumerate(self.levels, 1):
            if not len(contexts):
                continue
            own = context >> np.uint64(8 * (DEPTH - depth))
            at = np.minimum(np.searchsorted(contexts, own), len(contexts) - 1)
            held = np.flatnonzero(contexts[at] == own)
            if not len(held):
                continue
            key = own[held] << np.uint64(8) | symbol[held]
            place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            times = np.where(keys[place] == key, n[place], np.float32(0))
            p[held] = (times + SMOOTHING * p[held]) / (total[at[held]] + SMOOTHING)
        return p

    def score(self, symbols: np.ndarray, text_ends: np.ndarray, span: tuple[int, int]) -> np.ndarray:
        """Of each text, the sum of log10 over the symbols whose two newest before them lie in the span."""
        out = np.zeros(len(text_ends))
        for first in range(DEPTH, len(symbols), WINDOW):
            last = min(first + WINDOW, len(symbols))
            codes = strings(symbols, first, last)
            place = np.arange(first, last)
            if span != EVERYWHERE:
                newest = codes >> np.uint64(8 * (DEPTH - SHALLOW)) & np.uint64((1 << 8 * SHALLOW) - 1)
                own = (newest >= span[0]) & (newest < span[1])
                codes, place = codes[own], place[own]
            if len(codes):
                order = np.argsort(codes)  # equal ones are looked up once, neighbours together
                codes = codes[order]
                new = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
                logs = np.empty(len(codes))
                logs[order] = np.repeat(np.log10(self.probabilities(codes[new])), np.diff(np.append(new, len(codes))))
                of = np.searchsorted(text_ends, place[[0, -1]])
                owner = np.repeat(np.arange(of[0], of[1] + 1), np.diff(np.concatenate(([0], np.searchsorted(place, text_ends[of[0] : of[1]], side="right"), [len(place)]))))
                out += np.bincount(owner, logs, len(out))
        return out


EVERYWHERE = (0, 1 << 8 * SHALLOW)


def held_out() -> Column:
    return F.coalesce(id_remainder(HELD_OUT[0]) == HELD_OUT[1], F.lit(False))


class Model:
    """The tree's table of deep contexts, its shallow rows, the spans of the slices; the frequent words' counts, and where to find the rest."""

    def __init__(self, deep: DataFrame, shallow: list, spans: list[tuple[int, int]], words: DataFrame, n_tokens: int, n_words: int, hashes: np.ndarray, counts: np.ndarray):
        self.deep, self.shallow, self.spans = deep, shallow, spans
        self.words, self.n_tokens, self.n_words, self.hashes, self.counts = words, n_tokens, n_words, hashes, counts

    def tree(self, span: tuple[int, int]) -> Tree:
        """The slice of a span: at most about SLICE counts."""
        rows = self.deep if span == EVERYWHERE else self.deep.where(newest_of_key().between(span[0], span[1] - 1))
        found = rows.toArrow()
        depth, keys, n, total = (found.column(c).to_numpy() for c in ("depth", "key", "n", "total"))
        return Tree([*self.shallow, *((d, keys[depth == d].view(np.uint64), n[depth == d], total[depth == d]) for d in range(SHALLOW + 1, DEPTH + 1))])


def newest_of_key() -> Column:
    """The SHALLOW newest symbols of a model row's context."""
    out = F.lit(None).cast("bigint")
    for depth in range(SHALLOW + 1, DEPTH + 1):
        out = F.when(F.col("depth") == depth, F.shiftright("key", 8 * (depth + 1 - SHALLOW))).otherwise(out)
    return out


def spans_of(sizes: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """Ranges of the newest symbols, in which the sizes add up to `most` at most where a single one has no more."""
    out, start, held = [], 0, 0
    for at, n in sorted(sizes):
        if held and held + n > most:
            out.append((start, at))
            start, held = at, 0
        held += n
    return [*out, (start, EVERYWHERE[1])]


def fit(training: DataFrame) -> Model:
    found = stored(survey(training))
    words = found.where("kind = 0").select(F.col("key").alias("word"), F.col("n").alias("c"))
    size = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n_tokens, n_words = int(size[0]), int(size[1])
    deep, shallow = grown(found)
    sizes = [(int(r[0]), int(r[1])) for r in deep.groupBy(newest_of_key().alias("newest")).count().collect()]  # at most 2^16 rows
    frequent = words.where(F.col("c") >= max(1.0, FREQUENT * n_tokens)).where(F.lit(n_tokens) > 0).toArrow()
    hashes, counts = frequent.column("word").to_numpy(), frequent.column("c").to_numpy()
    order = np.argsort(hashes)
    return Model(deep, shallow, spans_of(sizes, SLICE), words, n_tokens, n_words, hashes[order], counts[order])


def span_scores(docs: DataFrame, tree: Tree, span: tuple[int, int]) -> DataFrame:
    """(text_key, part): what a further slice adds to the score of each text."""
    sent = docs.sparkSession.sparkContext.broadcast(tree)

    def run(batches):
        own = sent.value
        for batch in batches:
            for first, texts in chunks([t or "" for t in batch.column(1).to_pylist()], CHUNK):
                part = own.score(*stream(*prepared(texts)), span)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(part)], names=["text_key", "part"])

    return docs.select(text_key().alias("text_key"), "text").mapInArrow(run, "text_key string, part double").groupBy("text_key").agg(F.first("part").alias("part"))


def text_key() -> Column:
    return F.md5(F.coalesce("text", F.lit("")).cast("binary"))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """A row for each row of docs: doc_id, n_tokens, n_known, base_score, score."""
    spark = docs.sparkSession
    span, *others = model.spans
    sent = spark.sparkContext.broadcast((model.tree(span), model.hashes, np.log10(model.counts + 1.0)))
    least = max(1.0, FREQUENT * model.n_tokens)  # at 1, every known word is in the table

    def run(batches):
        pows = powers()
        tree, hashes, logs = sent.value
        for batch in batches:
            rid, ids, text_keys = batch.column(0), batch.column(1), batch.column(3)
            for first, texts in chunks([t or "" for t in batch.column(2).to_pylist()], CHUNK):
                n = len(texts)
                data, inside, line_ends = prepared(texts)
                total = tree.score(*stream(data, inside, line_ends), span)
                starts, ends = segments(inside)
                words = np.concatenate([word_hashes(data, starts, ends, inside, pows).view(np.int64), np.full(n, END_WORD, np.int64)])
                owner_of = np.concatenate([np.searchsorted(line_ends, starts), np.arange(n)])
                where, distinct = pd.factorize(words)
                at = np.minimum(np.searchsorted(hashes, distinct), max(len(hashes) - 1, 0))
                known = (hashes[at] == distinct if len(hashes) else np.zeros(len(distinct), bool))[where]
                value = (logs[at] if len(hashes) else np.zeros(len(distinct)))[where[known]]
                rare = np.flatnonzero(~known) if least > 1 else np.zeros(0, np.int64)
                rare = rare[np.argsort(owner_of[rare], kind="stable")]
                offsets = np.concatenate(([0], np.cumsum(np.bincount(owner_of[rare], minlength=n))))
                yield pa.RecordBatch.from_arrays(
                    [
                        rid.slice(first, n), ids.slice(first, n),
                        pa.array(np.bincount(owner_of, minlength=n)), pa.array(np.bincount(owner_of[known], minlength=n)),
                        pa.array(np.bincount(owner_of[known], value, n).astype(np.float64)), pa.array(total),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(words[rare])), text_keys.slice(first, n),
                    ],
                    names=["rid", "doc_id", "n_tokens", "n_known", "base", "score", "rare", "text_key"],
                )

    key = text_key() if others else F.lit(None).cast("string")
    scored = stored(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text", key.alias("text_key")).mapInArrow(run, "rid bigint, doc_id bigint, n_tokens bigint, n_known bigint, base double, score double, rare array<bigint>, text_key string"))
    rare = scored.select("rid", F.explode("rare").alias("word")).join(model.words, "word").groupBy("rid").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("c") + 1)).alias("extra"))
    if others:
        parts = [stored(span_scores(docs, model.tree(s), s)) for s in others]
        more = reduce(DataFrame.union, parts).groupBy("text_key").agg(F.sum("part").alias("part"))
        scored = scored.join(more, "text_key").withColumn("score", F.col("score") + F.col("part"))
    total = float(np.log10(model.n_tokens + model.n_words + 1))
    return scored.drop("rare", "text_key").join(rare, "rid", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        (F.col("base") + F.coalesce("extra", F.lit(0.0)) - F.col("n_tokens") * total).alias("base_score"),
        "score",
    )


def scoring_report(docs: DataFrame) -> DataFrame:
    model = fit(docs.where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.n_tokens).cast("bigint").alias("train_tokens"), "base_score", "score")


ship(__name__)
