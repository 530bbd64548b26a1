import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import suffix_tree


def texts(spark, parts=1):
    rows = [(k, "the cat sat on the mat and the dog lay by the log " * 4 + "quaz " * (k % 3)) for k in range(60)]
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)


def contexts(model):
    """Contexts as they are read, oldest symbol first."""
    out = set()
    for depth, held in enumerate(model.tree(suffix_tree.EVERYWHERE).levels, 1):
        out |= {int(x).to_bytes(depth, "big")[::-1] for x in held[2]}
    return out


def scores(docs, model):
    return {r.doc_id: r.score for r in suffix_tree.score(docs, model).collect()}


def symbols_of(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    return b"".join(w + b" " for w in words) + b"\n"


class Brute:
    """The same model by plain counting."""

    def __init__(self, rows):
        d = suffix_tree.DEPTH
        self.n = [Counter() for _ in range(d + 1)]
        for t in rows:
            s = b"\n" * d + symbols_of(t)
            for i in range(d, len(s)):
                for k in range(d + 1):
                    self.n[k][s[i - k : i], s[i]] += 1
        self.total = [Counter() for _ in range(d + 1)]
        for k in range(d + 1):
            for (c, _), n in self.n[k].items():
                self.total[k][c] += n
        self.kept = set()
        for k in range(1, d + 1):
            for c, total in self.total[k].items():
                below = [self.p(c[1:], a) for a in range(256)]
                own = [(self.n[k][c, a] + suffix_tree.SMOOTHING * below[a]) / (total + suffix_tree.SMOOTHING) for a in range(256)]
                gain = sum(x * math.log(x / y) for x, y in zip(own, below, strict=True))
                if total >= suffix_tree.LEAST_COUNT and gain >= suffix_tree.DIVERGENCE and gain * total >= suffix_tree.EVIDENCE:
                    self.kept.add(c)

    def p(self, c, a):
        if not c:
            return (self.n[0][b"", a] + 0.5) / (self.total[0][b""] + 128)
        below = self.p(c[1:], a)
        if c not in self.kept:
            return below
        return (self.n[len(c)][c, a] + suffix_tree.SMOOTHING * below) / (self.total[len(c)][c] + suffix_tree.SMOOTHING)

    def score(self, t):
        d = suffix_tree.DEPTH
        s = b"\n" * d + symbols_of(t)
        return sum(math.log10(self.p(s[i - d : i], s[i])) for i in range(d, len(s)))


ODD = [None, "", " ", "\t a \n", "É É жи ☃ \x00\x02", "x" * 3000, "the the the", "The  end"]


def test_scores_equal_plain_counting(spark, monkeypatch):
    monkeypatch.setattr(suffix_tree, "LEAST_COUNT", 3)
    monkeypatch.setattr(suffix_tree, "EVIDENCE", 2.0)
    rng = random.Random(2)
    rows = [" ".join(rng.choice(["the", "then", "cat", "жи", "1abcde2", "3abcde4"]) for _ in range(rng.randrange(30))) for _ in range(60)] + ODD
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    want = Brute(rows)
    model = suffix_tree.fit(docs.repartition(5))
    assert contexts(model) == want.kept and any(len(x) == suffix_tree.DEPTH for x in want.kept)
    assert scores(docs, model) == {k: pytest.approx(want.score(t), rel=1e-6) for k, t in enumerate(rows)}


def test_contexts_are_retained_by_evidence_alone(spark, monkeypatch):
    monkeypatch.setattr(suffix_tree, "EVIDENCE", 30.0)
    few = texts(spark)
    other = spark.createDataFrame([(1000 + k, "zzzz yyyy xxxx " * 400) for k in range(60)], "doc_id bigint, text string")
    held = contexts(suffix_tree.fit(few))
    assert b"qua" in held or b"qu" in held or b"q" in held
    assert {x for x in held if b"q" in x} <= contexts(suffix_tree.fit(few.union(other)))  # however large the rest is


def test_contexts_and_scores_do_not_depend_on_blocks_and_slices(spark, monkeypatch):
    monkeypatch.setattr(suffix_tree, "EVIDENCE", 3.0)
    docs = texts(spark)
    one = suffix_tree.fit(docs)
    want = scores(docs, one)
    assert contexts(suffix_tree.fit(texts(spark, 16))) == contexts(one)
    monkeypatch.setattr(suffix_tree, "WINDOW", 50)
    monkeypatch.setattr(suffix_tree, "CHUNK", 100)
    monkeypatch.setattr(suffix_tree, "HELD", 20)
    monkeypatch.setattr(suffix_tree, "SLICE", 10)
    cut = suffix_tree.fit(texts(spark, 3))
    assert len(cut.spans) > 1 and contexts(cut) == contexts(one)
    assert scores(docs, cut) == {k: pytest.approx(v, rel=1e-5) for k, v in want.items()}


def test_characters_of_any_script_are_learned(spark):
    common = "".join(chr(c) for c in range(0x3B1, 0x3B1 + 61))
    rows = [(k, f"{common} {common} жи ж") for k in range(50)]
    model = suffix_tree.fit(spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = scores(spark.createDataFrame([(1, "ж"), (2, "и"), (3, "☃")], "doc_id bigint, text string"), model)
    assert got[1] > got[2] > got[3]


def test_probabilities_sum_to_one(spark):
    tree = suffix_tree.fit(texts(spark)).tree(suffix_tree.EVERYWHERE)
    for context in (b"\n\n\n\n\n\n", b"e cat ", b"zzzzzz", b"on the"):
        code = int.from_bytes(context[::-1], "big")
        p = tree.probabilities(np.array([a << 8 * suffix_tree.DEPTH | code for a in range(256)], np.uint64))
        assert p.sum() == pytest.approx(1, abs=1e-6)


def test_streams():
    for rows in (["ab cd", "", " x ", "y"], ["", ""], ["a"], [" "], ["a\n b"]):
        symbols, ends = suffix_tree.stream(*suffix_tree.prepared(rows))
        assert bytes(symbols) == b"\n" * suffix_tree.DEPTH + b"".join(symbols_of(t) for t in rows)
        assert ends.tolist() == [suffix_tree.DEPTH + sum(len(symbols_of(t)) for t in rows[: k + 1]) - 1 for k in range(len(rows))]
