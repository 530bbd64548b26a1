"""Quality by votes of the nearest labelled documents in a latent semantic space.

A text's terms are its words, hashed, n-grams of its shape (runs of capitals, small letters, digits, blanks, and each other mark
as such) and its repetitions (words, pairs of words and lines that recur). Their logged rates, weighted by inverse document
frequency, make a vector of unit length for each of the three kinds; how much words and repetitions weigh beside the shape is
fitted: of `WEIGHTS`, those whose votes among the labelled sample foretell each left-out label best. The vectors are
projected on the leading singular vectors of the labelled sample. The sample's latent vectors are broadcast; each
document's cosine with every one of them is computed exactly, block by block, and its `NEIGHBOURS` nearest vote
with their labels, weighted by similarity and by the rows they stand for.

The sample has a bound (`PER_CLASS` rows of each label, chosen by a hash of the id), so the broadcast has one too.
Every document is scored on its whole text.

Defined results: null and empty texts have the zero vector and get the labels' mean; without labelled rows all scores are 1;
repeated rows are scored alike; empty tables give no rows; extra columns are kept by `score`.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lodestone.llm.common import ship
from lodestone.llm.textvec import blank_table, chunks, mix, powers, segments, word_hashes
from lodestone.llm.toxicity import held_out, labelled_sample

BITS = 11
GRAMS = 3
LATENT = 64
NEIGHBOURS = 15
SHARPNESS = 6
PER_CLASS = 1500
CHUNK = 1 << 20
CUT = 0.3
OWN = 4  # repetitions: the last terms of the shape's part
WEIGHTS = (0.25, 0.5, 1.0, 2.0)  # of the words and of the repetitions beside the shape
KINDS = (slice(0, (1 << BITS) - OWN), slice((1 << BITS) - OWN, 1 << BITS), slice(1 << BITS, 2 << BITS))  # shape, repetitions, words


def shape_table() -> np.ndarray:
    """Byte classes: 1 small letter (and all bytes beyond ASCII), 2 capital, 3 digit, 4 blank, 5 line end, other marks their own."""
    t = np.arange(256, dtype=np.uint8) + np.uint8(8)
    t[0x80:] = 1
    t[ord("a") : ord("z") + 1] = 1
    t[ord("A") : ord("Z") + 1] = 2
    t[ord("0") : ord("9") + 1] = 3
    t[[9, 11, 12, 13, 32]] = 4
    t[10] = 5
    return t


def recurring(owner: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """How many values of each owner have occurred in it before."""
    key = np.sort(mix(value ^ mix(owner.astype(np.uint64) + np.uint64(1))))
    order = np.argsort(mix(value ^ mix(owner.astype(np.uint64) + np.uint64(1))), kind="stable")
    return np.bincount(owner[order][1:][key[1:] == key[:-1]], minlength=n) if len(key) else np.zeros(n, int)


def terms(texts: list[str | None]) -> np.ndarray:
    """A row of logged term rates for each text, before weighting."""
    size = 1 << BITS
    out = np.zeros((len(texts), 2 * size), np.float32)
    for first, held in chunks([t or "" for t in texts], CHUNK):
        raw = [t.encode("utf-8", "surrogatepass") for t in held]
        n = len(raw)
        data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        owner = np.repeat(np.arange(n), [len(x) + 1 for x in raw])
        kinds = shape_table()[data]
        new = np.concatenate(([True], (kinds[1:] != kinds[:-1]) | (owner[1:] != owner[:-1])))
        code, own = kinds[new].astype(np.uint64), owner[new]
        runs = np.diff(np.append(np.flatnonzero(new), len(data)))
        code = code * np.uint64(2) + (runs > 1)
        h, places = code[:0], []
        for k in range(1, GRAMS + 1):
            if len(code) < k:
                break
            h = code if k == 1 else h[:-1] * np.uint64(0x100000001B3) + code[k - 1 :]
            inside = own[: len(h)] == own[k - 1 :]
            places.append(own[: len(h)][inside] * size + (mix(h + np.uint64(k)) % np.uint64(size - OWN)).astype(np.int64)[inside])
        counts = np.bincount(np.concatenate(places), minlength=n * size).reshape(n, size).astype(np.float32)
        rates = counts / np.maximum(np.bincount(own, minlength=n), 1)[:, None]
        inside = blank_table()[data]
        starts, ends = segments(inside)
        words, of = word_hashes(data, starts, ends, inside, powers()), owner[starts]
        total = np.maximum(np.bincount(of, minlength=n), 1)
        again = (words[1:] == words[:-1]) & (of[1:] == of[:-1])
        line = data != 10
        s2, e2 = segments(line)
        lines, of2 = word_hashes(data, s2, e2, line, powers()), owner[s2]
        rates[:, size - 1] = np.bincount(of[1:][again], minlength=n) / total
        rates[:, size - 2] = recurring(of2, lines, n) / np.maximum(np.bincount(of2, minlength=n), 1)
        rates[:, size - 3] = recurring(of, words, n) / total
        pairs = mix(words[1:] * np.uint64(0x100000001B3) + words[:-1])
        rates[:, size - 4] = recurring(of[1:][of[1:] == of[:-1]], pairs[of[1:] == of[:-1]], n) / total
        out[first : first + n, :size] = np.log1p(100 * rates)
        place, n_of = np.unique(of * size + (mix(words + np.uint64(7)) % np.uint64(size)).astype(np.int64), return_counts=True)
        out[first + place // size, size + place % size] = np.log1p(100 * n_of / total[place // size])
        out[first : first + n][[not x for x in raw]] = 0
    return out


class Space:
    """The projection of weighted terms, and the labelled vectors with labels and what each stands for."""

    def __init__(self, x: np.ndarray, label: np.ndarray, weight: np.ndarray):
        self.mean = float((label * weight).sum() / weight.sum()) if len(label) else 1.0
        self.label, self.weight = label.astype(np.float32), weight.astype(np.float32)
        self.known = len(label) > 0
        if not self.known:
            return
        self.idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 0.1).astype(np.float32)
        x = by_kind(x * self.idf)
        self.force = self.fitted(x)
        x = unit(x * self.force)
        self.projection = leading(x, LATENT)
        self.vectors = unit(x @ self.projection)

    def fitted(self, x: np.ndarray) -> np.ndarray:
        """How much each term weighs: of WEIGHTS, those by which the others' votes foretell each label best."""
        shape, repeated, words = (x[:, k] @ x[:, k].T for k in KINDS)
        best = None
        for r, w in itertools.product(WEIGHTS, WEIGHTS):
            cosine = shape + r * r * repeated + w * w * words
            length = np.sqrt(np.maximum(np.diag(cosine), 1e-9))
            cosine = cosine / length[:, None] / length
            np.fill_diagonal(cosine, -1)
            off = np.clip(self.votes(cosine), 1e-3, 1 - 1e-3)
            loss = float(-(self.weight * np.log(np.where(self.label == 1, off, 1 - off))).sum())
            if best is None or loss < best[0] - 1e-9:
                best = (loss, r, w)
        out = np.ones(x.shape[1], np.float32)
        out[KINDS[1]], out[KINDS[2]] = best[1:]
        return out

    def votes(self, cosine: np.ndarray) -> np.ndarray:
        """Of the nearest labelled rows, for each row of cosines; the labels' mean where none is near."""
        k = min(NEIGHBOURS, len(self.label))
        near = np.argpartition(cosine, -k, axis=1)[:, -k:]
        force = np.clip(np.take_along_axis(cosine, near, 1), 0, 1).astype(np.float64) ** SHARPNESS * self.weight[near]
        total = force.sum(1)
        return np.where(total > 0, (force * self.label[near]).sum(1) / np.where(total > 0, total, 1), self.mean)

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), self.mean)
        if not self.known:
            return out
        for at in range(0, len(texts), 256):
            v = unit((by_kind(terms(texts[at : at + 256]) * self.idf) * self.force) @ self.projection)
            out[at : at + len(v)] = self.votes(v @ self.vectors.T)
        return np.clip(out, 0, 1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def by_kind(x: np.ndarray) -> np.ndarray:
    """Each kind of terms with unit length."""
    out = np.empty_like(x)
    for k in KINDS:
        out[:, k] = unit(x[:, k])
    return out


def leading(x: np.ndarray, n: int) -> np.ndarray:
    """The n leading right singular vectors, by subspace iteration."""
    q = np.random.default_rng(0).standard_normal((x.shape[1], min(2 * n, len(x)))).astype(np.float32)
    for _ in range(12):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    values, turned = np.linalg.eigh(np.float64(1) * (x @ q).T @ (x @ q))
    return (q @ turned[:, ::-1][:, :n]).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> Space:
    """From documents (doc_id, text) and labels (doc_id, label 0 / 1)."""
    sample, stands_for = labelled_sample(docs, labels, label, per_class)

    def run(batches):
        for batch in batches:
            ys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(texts), 256):
                x = terms(texts[at : at + 256])
                rows, columns = np.nonzero(x)
                ends = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=len(x)))))
                offsets = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(ys[at : at + 256], pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(columns.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(x[rows, columns]))], names=["label", "at", "value"])

    found = sample.select(F.col(label).cast("int"), "text").mapInArrow(run, "label int, at array<int>, value array<float>").toArrow()
    y = found.column("label").to_numpy()
    at, value = found.column("at").combine_chunks(), found.column("value").combine_chunks()
    x = np.zeros((len(y), 2 << BITS), np.float32)
    x[np.repeat(np.arange(len(y)), np.diff(at.offsets.to_numpy())), at.flatten().to_numpy()] = value.flatten().to_numpy()
    order = np.lexsort((*x[:, KINDS[1]].T, x.sum(1), y))  # the same rows in any order give the same space
    return Space(x[order], y[order], np.array([stands_for.get(int(v), 1.0) for v in y[order]]))


def score(docs: DataFrame, space: Space, text: str = "text", name: str = "score") -> DataFrame:
    """docs with the score; a column of that name is replaced."""
    kept = [f for f in docs.schema.fields if f.name != name]
    at = [f.name for f in kept].index(text)
    sent = docs.sparkSession.sparkContext.broadcast(space)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sent.value.score(batch.column(at).to_pylist()), pa.float64())], names=[*batch.schema.names, name])

    return docs.select(*[f"`{f.name}`" for f in kept]).mapInArrow(run, StructType([*kept, StructField(name, DoubleType())]))


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    space = fit(docs, labels)
    scored = score(docs.select("doc_id", "text"), space)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


ship(__name__)
