"""Language identification by bit-sliced Bloom filters of character n-grams.

One Bloom filter for each language, stored as slices: a position holds a bitmask with a bit for each language, so
that the AND of an n-gram's few positions gives all languages that contain it at once. A text's n-grams are
counted for each language by popcounts of these masks; the count expected from false positives, known from the
fill of the language's slice, is taken off; the language with the most left decides.

A language contains an n-gram if its rate there is at least `SHARE` of its largest rate in any language. The filters
are fitted on a bounded sample of labelled rows (`PER_LANGUAGE` of each language, chosen by a hash of the id); every
document is then scored on its whole text.

Defined results: `und` with score 0 for null texts and texts without a letter, and where no language was learned;
a text with letters but no known n-gram gets the commonest learned language and score 0. Repeated rows are scored
alike; empty tables give no rows; extra columns are kept by `identify` (those of the result's names are replaced).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from lodestone.llm.common import id_remainder, ship, unit_hash
from lodestone.llm.textvec import mix

UNKNOWN = "und"
SIZES = (3, 4)
PER_LANGUAGE = 3000
SHARE = 0.25
LEAST_RATE = 1e-5
BITS_A_GRAM = 24
HASHES = 3
CHUNK = 1 << 19
HELD_OUT = (4, 2)


def letters_only(text: str) -> np.ndarray:
    """Code points of the lower-cased text between blanks, all that are no letters being one blank."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    known = np.array([chr(i).isalpha() for i in range(0x250)])
    letter = np.where(codes < 0x250, known[np.minimum(codes, 0x24F)], ((codes < 0x2000) | (codes > 0x2BFF)) & ((codes < 0x3000) | (codes > 0x303F)))
    codes = np.where(letter, codes, 32).astype(np.uint64)
    codes = np.concatenate(([np.uint64(32)], codes, [np.uint64(32)]))
    return codes[np.concatenate(([True], (codes[1:] != 32) | (codes[:-1] != 32)))]


def grams(codes: np.ndarray) -> np.ndarray:
    """Hashes of all n-grams of SIZES."""
    out, h = [], codes[:0]
    for n in range(1, max(SIZES) + 1):
        if len(codes) < n:
            break
        h = codes[: len(codes) - n + 1] if n == 1 else h[:-1] * np.uint64(0x100000001B3) + codes[n - 1 :]
        if n in SIZES:
            out.append(mix(h + np.uint64(n)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def pieces(text: str):
    """The code points in pieces that overlap by one n-gram less a point, so that long texts need bounded memory."""
    codes = letters_only(text)
    step = max(SIZES) - 1
    if len(codes) <= CHUNK:
        yield codes
        return
    for at in range(0, len(codes) - step, CHUNK):
        yield codes[at : at + CHUNK + step]


class Filters:
    """Bit-sliced Bloom filters: masks[w][p] has the bits of languages 64 w to 64 w + 63 at position p."""

    def __init__(self, languages: list[str], grams_of: list[np.ndarray], prior: int):
        self.languages, self.prior = languages, prior
        largest = max([1, *map(len, grams_of)])
        self.bits = int(np.clip(np.ceil(np.log2(largest * BITS_A_GRAM)), 10, 21))
        self.masks = np.zeros(((len(languages) + 63) // 64, 1 << self.bits), np.uint64)
        for i, found in enumerate(grams_of):
            for p in self.positions(found):
                self.masks[i // 64][p] |= np.uint64(1 << i % 64)
        fill = np.array([((self.masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(languages))])
        self.false_rate = fill**HASHES

    def positions(self, found: np.ndarray):
        for k in range(HASHES):
            yield ((found >> np.uint64(k * 21)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def counts(self, found: np.ndarray) -> np.ndarray:
        """For each language how many of the n-grams its filter contains."""
        out = np.zeros(len(self.languages), np.int64)
        places = list(self.positions(found))
        for w, masks in enumerate(self.masks):
            hit = masks[places[0]]
            for p in places[1:]:
                hit &= masks[p]
            here = min(64, len(self.languages) - 64 * w)
            if here <= 12:
                by_mask = np.bincount(hit.astype(np.int64), minlength=1 << here)
                values = np.arange(len(by_mask))
                out[64 * w : 64 * w + here] = [by_mask[(values >> i) & 1 == 1].sum() for i in range(here)]
            else:
                out[64 * w : 64 * w + here] = [int(((hit >> np.uint64(i)) & np.uint64(1)).sum()) for i in range(here)]
        return out

    def decide(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, share of n-grams that it contains)."""
        if text is None or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, 0.0
        total, counts = 0, np.zeros(len(self.languages), np.int64)
        for codes in pieces(text):
            found = grams(codes)
            total += len(found)
            counts += self.counts(found)
        real = np.maximum((counts - total * self.false_rate) / np.maximum(1 - self.false_rate, 1e-9), 0)
        if not real.any():
            return self.languages[self.prior], 0.0, 0.0
        best = int(real.argmax())
        return self.languages[best], float(real[best] / real.sum()), float(min(1.0, real[best] / max(total, 1)))


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Filters:
    """Filters from rows (doc_id, text, lang) without nulls. Rates are of occurrences in a hash sample of the rows."""
    sizes = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}  # a row for each language
    languages = sorted(sizes)
    if not languages:
        return Filters([], [], 0)
    index = {x: i for i, x in enumerate(languages)}
    share = F.lit(0.0)
    for x in languages:
        share = F.when(F.col("lang") == x, min(1.0, per_language / sizes[x])).otherwise(share)
    sample = labelled.where(unit_hash("doc_id", seed=3) < share).select("text", "lang")

    def count(batches):
        held: dict[int, list] = {}

        def merged(parts):
            keys, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            keys, where = np.unique(keys, return_inverse=True)
            return keys, np.bincount(where, n).astype(np.int64)

        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                parts = held.setdefault(index[lang], [])
                for codes in pieces(text.as_py()):
                    parts.append(np.unique(grams(codes), return_counts=True))
                if len(parts) >= 256:
                    held[index[lang]] = [merged(parts)]
        for lang, parts in held.items():
            keys, n = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), lang, np.int32)), pa.array(keys.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    counted = sample.mapInArrow(count, "lang int, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = {r[0]: r[1] for r in counted.groupBy("lang").agg(F.sum("n")).collect()}
    least = F.lit(2.0)
    for i in totals:
        least = F.when(F.col("lang") == i, max(2.0, LEAST_RATE * totals[i])).otherwise(least)
    found = counted.where(F.col("n") >= least).toArrow()  # at most 1 / LEAST_RATE for each language
    lang, gram, n = (found.column(c).to_numpy() for c in ("lang", "gram", "n"))
    rate = n / np.array([totals.get(i, 1) for i in range(len(languages))], float)[lang]
    keys, where = np.unique(gram, return_inverse=True)
    top = np.zeros(len(keys))
    np.maximum.at(top, where, rate)
    held = rate >= SHARE * top[where]
    return Filters(languages, [gram[held & (lang == i)].view(np.uint64) for i in range(len(languages))], max(range(len(languages)), key=lambda i: (sizes[languages[i]], -i)))


def identify(docs: DataFrame, filters: Filters, text: str = "text") -> DataFrame:
    """docs with lang_pred, score and coverage (the share of n-grams that the language contains)."""
    kept = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score", "coverage")]
    schema = StructType([*kept, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("coverage", DoubleType())])
    at = [f.name for f in kept].index(text)
    sent = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches):
        own = sent.value
        for batch in batches:
            found = [own.decide(x.as_py()) for x in batch.column(at)]
            lang, score, coverage = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(coverage, pa.float64())], names=[*batch.schema.names, "lang_pred", "score", "coverage"])

    return docs.select(*[f"`{f.name}`" for f in kept]).mapInArrow(run, schema)


def held_out() -> Column:
    return F.coalesce(id_remainder(HELD_OUT[0]) == HELD_OUT[1], F.lit(False))


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")


def language_report(docs: DataFrame) -> DataFrame:
    filters = fit(training_rows(docs))
    return identify(docs.select("doc_id", "text"), filters).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "coverage")


ship(__name__)
