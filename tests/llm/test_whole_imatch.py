"""Fingerprints and likenesses against plain Python over whole tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash

from lodestone.llm import imatch

SF = "/root/testdata/sf0.001"


def signed(x, bits):
    return x - (1 << bits) if x >> bits - 1 else x


def xx(raw, seed=42):
    return xxhash.xxh64_intdigest(raw, seed)


def murmur(raw, seed):
    """32-bit Murmur3 of whole 4-byte blocks."""
    h = seed & 0xFFFFFFFF
    for i in range(0, len(raw), 4):
        k = int.from_bytes(raw[i : i + 4], "little") * 0xCC9E2D51 & 0xFFFFFFFF
        k = (k << 15 | k >> 17) & 0xFFFFFFFF
        h ^= k * 0x1B873593 & 0xFFFFFFFF
        h = (h << 13 | h >> 19) & 0xFFFFFFFF
        h = h * 5 + 0xE6546B64 & 0xFFFFFFFF
    h ^= len(raw)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> shift) * factor & 0xFFFFFFFF
    return h ^ h >> 16


def chained(values, seed):
    """The engine's hash of some longs and then an int: each value's hash seeds the next."""
    h = 42
    for v in values:
        h = murmur(v.to_bytes(8, "little", signed=True), h)
    return murmur(seed.to_bytes(4, "little"), h)


def terms_of(text):
    return {signed(xx(w.encode()), 64) for w in re.split(imatch.SPACES, text.lower()) if w}


def values_of(text, lexicon):
    terms = sorted(terms_of(text))
    own = [t for t in terms if t in lexicon]
    h = 42
    for t in terms:
        h = xx(t.to_bytes(8, "little", signed=True), h)
    alone = signed(h, 64) if terms else signed(xx(text.encode()), 64)
    out = []
    for seed in range(1, imatch.FAMILIES + 1):
        left = own
        for level in range(imatch.LEVELS):
            out.append(chained(left, seed) if left else chained([alone], seed) if not own and level == 0 else 0)
            left = [t for t in left if not xx(seed.to_bytes(4, "little"), xx(t.to_bytes(8, "little", signed=True))) >> level & 1]
    return out


def likeness(a, b):
    best = 0.0
    for level in range(imatch.LEVELS):
        pairs = [(x, y) for x, y in zip(a[level :: imatch.LEVELS], b[level :: imatch.LEVELS], strict=True) if x or y]
        if len(pairs) >= imatch.FAMILIES // 2:
            best = max(best, sum(x == y for x, y in pairs) / len(pairs))
    return best


def by_hand(rows):
    texts = [(i, t or "") for i, t in rows]
    df = Counter(w for _, t in texts for w in terms_of(t))
    lexicon = {w for w, n in df.items() if max(len(rows) * imatch.LEAST_SHARE, imatch.LEAST_DOCUMENTS) <= n <= max(len(rows) * imatch.MOST_SHARE, imatch.LEAST_DOCUMENTS)}
    groups = defaultdict(list)
    for i, t in texts:
        groups[imatch.NO_ID if i is None else i].append(t)
    order = sorted(groups, reverse=True)
    out = []
    for at, k in enumerate(order):
        need = max(len(t) // 3 for t in groups[k])
        following = min(groups[order[(at + 1) % len(order)]], key=lambda t: (t[:need], signed(xx(t.encode()), 64)))
        for t in groups[k]:
            n = len(t) // 3
            edited = t[: len(t) - n] + following[:n]
            own, edit, after = (values_of(x, lexicon) for x in (t, edited, following))
            text = ["".join(f"{v:08x}" for v in values) for values in (own, edit)]
            out.append((None if k == imatch.NO_ID else k, len(t), hashlib.sha256(edited.encode()).hexdigest(), *text, likeness(own, edit), likeness(own, after)))
    return out


def odd(rng):
    def text(n):
        return " ".join(f"w{int(rng.random() ** 2 * 60)}" for _ in range(n))

    rows = [(i, text(rng.randrange(1, 40))) for i in range(40)] + [(None, text(rng.randrange(30))) for _ in range(60)] + [(None, None), (None, ""), (90, None), (91, ""), (92, " \t"), (93, "É é Ab aB"), (94, "ß" * 5000)]
    return rows + rows[:5] + rows[40:60] + [(7, "a wholly different text under one id")]


@pytest.mark.parametrize("which", ["documents", "odd", "one row", "none"])
def test_equals_plain_python(spark, which):
    if which == "documents":
        rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    else:
        rows = {"odd": odd(random.Random(4)), "one row": [(1, "a b c d e f")], "none": []}[which]
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id bigint, text string, hash string, salt int")
    got = imatch.fingerprint_report(docs).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next").collect()
    assert sorted(map(tuple, got), key=str) == sorted(by_hand(rows), key=str)
