"""A toxicity classifier with counterfactual regularisation.

Logistic regression over hashed words and word beginnings, each counted and divided by the root of the number of words: those
whose shares differ clearly between the labels, and those of the swapped terms. A second, small regression over a
document's densities of strongly weighted words corrects for length and gives the score.

In every labelled text that has a swappable term, this term is swapped for another one of its kind, and the squared change of
the score under the swap is added to the loss of both regressions. Terms that merely name a group so carry no weight
of their own, and neutral mentions are not taken for insults. Swappable are `IDENTITIES`, lists of terms that name groups, in
four languages, and, as a corpus may name its groups in words of its own, those frequent words that the labels don't
tell apart (`ALIKE` standard errors): these are dealt by frequency into kinds of `KIND` words.

The model is fitted on a bounded sample of labelled rows (`PER_CLASS` of each label, chosen by a hash of the id and
weighted back to their shares); every document is scored on its whole text.

Defined results: null and empty texts get the score of a text without words; with one label or none in the training
rows all scores are that label's share (0 without labels); repeated rows are scored alike; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lodestone.llm.common import id_remainder, ship, unit_hash
from lodestone.llm.textvec import chunks, letter_table, mix, powers, segments, word_hashes

BITS = 18
PREFIXES = (None, 5, 7)
PER_CLASS = 1500
CHUNK = 1 << 21
ROUNDS = 250
RIDGE = 1e-3
TELLING = 4.0
SWAP_WEIGHT = 50.0
ALIKE = 1.0
FREQUENT = 0.02
KIND = 4
HELD_OUT = (5, 0)
CUT = 0.5
# each kind ends with a word that names no group
IDENTITIES = (
    ("women", "men", "people"), ("woman", "man", "person"), ("girls", "boys", "children"), ("female", "male"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "people"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "african", "latino", "arab"), ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "natives", "people"), ("immigrant", "refugee", "foreigner", "native", "person"),
    ("old", "young", "elderly"), ("blind", "deaf", "disabled"),
    ("femmes", "hommes", "gens"), ("musulmans", "chrétiens", "juifs", "athées", "gens"), ("immigrés", "réfugiés", "étrangers", "gens"), ("noirs", "blancs", "arabes", "asiatiques"), ("gays", "lesbiennes"),
    ("frauen", "männer", "leute"), ("muslime", "christen", "juden", "atheisten", "leute"), ("einwanderer", "flüchtlinge", "ausländer", "leute"), ("schwarze", "weiße", "araber", "asiaten"), ("schwule", "lesben"),
    ("mujeres", "hombres", "gente"), ("musulmanes", "cristianos", "judíos", "ateos", "gente"), ("inmigrantes", "refugiados", "extranjeros", "gente"), ("negros", "blancos", "árabes", "asiáticos"), ("homosexuales", "lesbianas"),
)


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each distinct word of a text: (its text, its features as a word and by its beginnings, how often); the number of words of each text."""
    joined = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(joined) + b" ", np.uint8)
    inside = letter_table()[data]
    starts, ends = segments(inside)
    text = np.searchsorted(np.cumsum([len(x) + 1 for x in joined]), starts, side="right")
    pows = powers()
    found = [word_hashes(data, starts, ends, inside, pows, p) for p in PREFIXES]
    _, first, n = np.unique(mix(found[0] ^ mix(text.astype(np.uint64) + np.uint64(1))), return_index=True, return_counts=True)
    order = np.lexsort((found[0][first], text[first]))
    first, n = first[order], n[order]
    place = np.stack([(x[first] >> np.uint64(64 - BITS)).astype(np.int32) for x in found], 1) if len(first) else np.zeros((0, len(PREFIXES)), np.int32)
    return text[first], place, n, np.bincount(text, minlength=len(texts))


class Model:
    """weights of the hashed features; second: the second regression's weights, or a constant score; swapped: of how many counterfactual texts it was learned."""

    def __init__(self, weights: np.ndarray, bias: float, strong: float, second: np.ndarray | None, constant: float = 0.0, swapped: int = 0):
        self.weights, self.bias, self.strong, self.second, self.constant, self.swapped = weights, bias, strong, second, constant, swapped

    def shape(self, texts: list[str | None]) -> np.ndarray:
        """For each text: first score, words, strong words."""
        out = np.zeros((len(texts), 3))
        for at, held in chunks([t or "" for t in texts], CHUNK):
            text, place, n, words = features(held)
            out[at : at + len(held)] = shape_of(text, self.weights[place].sum(1, dtype=np.float64), n, words, self.bias, self.strong)
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.second is None:
            return np.full(len(texts), self.constant)
        return sigmoid(second_features(self.shape(texts)) @ self.second)


def shape_of(text: np.ndarray, weight: np.ndarray, n: np.ndarray, words: np.ndarray, bias: float, strong: float) -> np.ndarray:
    """From the weight of each distinct word: first score, words, strong words of each text."""
    size = len(words)
    return np.stack([np.bincount(text, n * weight, size) / np.sqrt(np.maximum(words, 1)) + bias, words.astype(float), np.bincount(text, n * (weight > strong), size).astype(float)], 1)


def second_features(shape: np.ndarray) -> np.ndarray:
    first, words, strong = shape.T
    dense = strong / np.maximum(words, 1)
    return np.stack([np.ones(len(first)), np.clip(first, -20, 20), np.log1p(strong), np.log1p(200 * dense), np.sqrt(strong) * np.sqrt(dense) * 10, np.log1p(words) / 5], 1)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def shares(rows: np.ndarray, columns: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each feature, in how many standard errors the shares of both labels' texts that have it differ, and how many texts have it."""
    ones, others = max(1, (label == 1).sum()), max(1, (label == 0).sum())
    a, b = np.bincount(columns, label[rows] == 1, 1 << BITS), np.bincount(columns, label[rows] == 0, 1 << BITS)
    p = (a + b) / (ones + others)
    return np.abs(a / ones - b / others) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / ones + 1 / others)), a + b


def kinds(place: np.ndarray, apart: np.ndarray, held: np.ndarray, size: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The kinds of swappable terms, a row of features for each term: the listed ones of which a text has one, and frequent words that the labels don't tell apart."""
    out = []
    for terms in IDENTITIES:
        own = np.concatenate([features([t])[1] for t in terms])
        if held[own[:, 0]].any():
            out.append(own)
    words, first = np.unique(place[:, 0], return_index=True)
    plain = (apart[words] < ALIKE) & (held[words] >= FREQUENT * size)
    words, first = words[plain], first[plain]
    order = np.lexsort((words, held[words]))
    first = first[order]
    return out, [place[first[at : at + KIND]] for at in range(0, len(first) - 1, KIND)]


class Swaps:
    """Counterfactual texts: text `row` with its term of features `a` replaced by that of features `b`, which moves its first score by `by` times their weights' difference."""

    def __init__(self, groups: list[np.ndarray], text: np.ndarray, place: np.ndarray, n: np.ndarray, words: np.ndarray, used: np.ndarray):
        kind_of = np.full(1 << BITS, -1)
        for k, terms in reversed(list(enumerate(groups))):
            kind_of[terms[:, 0]] = k
        own = np.flatnonzero(kind_of[place[:, 0]] >= 0)
        entries, others = [own[:0]], [np.zeros((0, len(PREFIXES)), np.int64)]
        for k, terms in enumerate(groups):
            of_kind = own[kind_of[place[own, 0]] == k]
            for other in terms:
                e = of_kind[place[of_kind, 0] != other[0]]
                e = e[used[place[e]].any(1) | used[other].any()]  # else nothing weighs on either side
                entries.append(e)
                others.append(np.tile(other, (len(e), 1)))
        e = np.concatenate(entries)
        self.a, self.b = place[e].astype(np.int64), np.concatenate(others).astype(np.int64)
        self.row, self.n = text[e], n[e]
        self.by = self.n / np.sqrt(np.maximum(words, 1))[self.row]
        each = np.bincount(self.row, minlength=len(words))
        self.part = 1.0 / np.maximum(each, 1)[self.row]  # all swaps of a text weigh as much as the text


def fit_model(text: np.ndarray, place: np.ndarray, n: np.ndarray, words: np.ndarray, label: np.ndarray, weight: np.ndarray) -> Model:
    """text, place, n: an entry for each distinct word of a text, as from `features`; words, label, weight: for each text."""
    total = weight.sum()
    if not len(label) or label.min() == label.max():
        return Model(np.zeros(1 << BITS, np.float32), 0.0, 1.0, None, float(label[0]) if len(label) else 0.0)
    size = len(label)
    key, where = np.unique(np.repeat(text.astype(np.int64), len(PREFIXES)) << BITS | place.reshape(-1), return_inverse=True)
    times = np.bincount(where, np.repeat(n, len(PREFIXES)), len(key))
    rows, columns = key >> BITS, key & ((1 << BITS) - 1)
    apart, held = shares(rows, columns, label)
    listed, plain = kinds(place, apart, held, size)
    used = (apart >= TELLING) & (held >= 3)
    for terms in listed:
        used[terms.reshape(-1)] = True
    swaps = Swaps(listed + plain, text, place, n, words, used)
    of = used[columns]
    rows, columns, times = rows[of], columns[of], times[of]
    value = times / np.sqrt(np.maximum(words, 1))[rows]
    names = np.flatnonzero(used)
    at = np.zeros(1 << BITS, np.int64)
    at[names] = np.arange(len(names))
    columns = at[columns]
    a, b = (np.where(used[x], at[x], len(names)) for x in (swaps.a, swaps.b))  # the last weight stays 0
    share = 0.5 * weight / np.where(label == 1, weight[label == 1].sum(), weight[label == 0].sum())  # both labels weigh alike in the first regression
    force = 2 * SWAP_WEIGHT * share[swaps.row] * swaps.part
    w, bias = np.zeros(len(names)), 0.0
    gather, gather_b = np.full(len(names), 1e-6), 1e-6
    for _ in range(ROUNDS):
        z = np.bincount(rows, value * w[columns], size) + bias
        p = sigmoid(z)
        off = share * (p - label)
        g = RIDGE * w
        if len(swaps.row):
            was = p[swaps.row]
            full = np.append(w, 0.0)
            now = sigmoid(z[swaps.row] + swaps.by * (full[b].sum(1) - full[a].sum(1)))
            pull = force * (now - was) * now * (1 - now)
            off += np.bincount(swaps.row, pull - force * (now - was) * was * (1 - was), size)
            for k in range(len(PREFIXES)):
                g += (np.bincount(b[:, k], pull * swaps.by, len(full)) - np.bincount(a[:, k], pull * swaps.by, len(full)))[:-1]
        g += np.bincount(columns, value * off[rows], len(names))
        gather += g * g
        gather_b += off.sum() ** 2
        w -= 0.5 * g / np.sqrt(gather)
        bias -= 0.5 * off.sum() / np.sqrt(gather_b)
    weights = np.zeros(1 << BITS, np.float32)
    weights[names] = w
    per_word = weights[place].sum(1, dtype=np.float64)
    positive = np.repeat(per_word, n)[np.repeat((per_word > 0) & (label[text] == 1), n)]
    strong = 0.4 * float(np.quantile(positive, 0.9)) if len(positive) else 1.0
    model = Model(weights, bias, strong, None, swapped=len(swaps.row))
    shape = shape_of(text, per_word, n, words, bias, strong)
    change = shape[swaps.row]
    before, after = weights[swaps.a].sum(1, dtype=np.float64), weights[swaps.b].sum(1, dtype=np.float64)
    change[:, 0] += swaps.by * (after - before)
    change[:, 2] += swaps.n * ((after > strong).astype(int) - (before > strong))
    x, swapped = second_features(shape), second_features(change)
    force = 2 * SWAP_WEIGHT * weight[swaps.row] * swaps.part / total
    second = np.zeros(x.shape[1])
    for _ in range(60):  # Gauss-Newton steps
        p = sigmoid(x @ second)
        slope = np.maximum(p * (1 - p), 1e-6)
        hess = (x * (weight * slope)[:, None]).T @ x / total + 1e-4 * np.eye(x.shape[1])
        g = x.T @ (weight * (p - label)) / total + 1e-4 * second
        if len(swaps.row):
            now = sigmoid(swapped @ second)
            turn = (now * (1 - now))[:, None] * swapped - (slope[:, None] * x)[swaps.row]
            hess += (turn * force[:, None]).T @ turn
            g += turn.T @ (force * (now - p[swaps.row]))
        second -= np.clip(np.linalg.solve(hess, g), -2, 2)
    model.second = second
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> tuple[DataFrame, dict[int, float]]:
    """(doc_id, text, label) of a hash sample of about per_class labelled rows of each label outside the held-out part, and what
    each stands for. The sample's ids, at most about 2 x per_class, are broadcast, so that the texts stay where they are."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).alias(label))
    sizes = {r[0]: r[1] for r in known.groupBy(label).count().collect()}  # two rows
    share = F.lit(0.0)
    for x, n in sizes.items():
        share = F.when(F.col(label) == x, min(1.0, per_class / n)).otherwise(share)
    drawn = known.where(unit_hash("doc_id", seed=10) < share)
    return docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id"), {x: max(1.0, n / per_class) for x, n in sizes.items()}


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> Model:
    """From documents (doc_id, text) and labels (doc_id, label 0 / 1); of several labels of one id the larger counts."""
    sample, stands_for = labelled_sample(docs, labels, label, per_class)

    def run(batches):
        for batch in batches:
            ys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, held in chunks([t or "" for t in texts], CHUNK):
                text, place, n, words = features(held)
                ends = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=len(held)))))
                lists = [pa.ListArray.from_arrays(pa.array(ends * k, pa.int32()), pa.array(x)) for k, x in ((len(PREFIXES), place.reshape(-1)), (1, n.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays([pa.array(ys[first : first + len(held)], pa.int32()), pa.array(words, pa.int64()), *lists], names=["label", "words", "place", "n"])

    found = sample.select(F.col(label).cast("int"), "text").mapInArrow(run, "label int, words bigint, place array<int>, n array<int>").toArrow()
    y, words = found.column("label").to_numpy(), found.column("words").to_numpy()
    place, n = found.column("place").combine_chunks(), found.column("n").combine_chunks()
    text = np.repeat(np.arange(len(y)), np.diff(n.offsets.to_numpy()))
    return fit_model(text, place.flatten().to_numpy().reshape(-1, len(PREFIXES)), n.flatten().to_numpy(), words, y, np.array([stands_for.get(int(v), 1.0) for v in y]))


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """docs with the score; a column of that name is replaced."""
    kept = [f for f in docs.schema.fields if f.name != name]
    at = [f.name for f in kept].index(text)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sent.value.score(batch.column(at).to_pylist()), pa.float64())], names=[*batch.schema.names, name])

    return docs.select(*[f"`{f.name}`" for f in kept]).mapInArrow(run, StructType([*kept, StructField(name, DoubleType())]))


def held_out() -> Column:
    return F.coalesce(id_remainder(HELD_OUT[0]) == HELD_OUT[1], F.lit(False))


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


ship(__name__)
