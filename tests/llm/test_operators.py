"""The corpus operators against brute force, round trips and held-out labels, with null, empty, long and repeated rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.llm import imatch, langid, media, mixing, packing, quality_knn, sharding, suffix_tree, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, shard string, media string, size string"
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "Ab cd"), (5, "aB  CD"), (6, "²³ x½  y <|endoftext|>"), (7, "same text here"), (7, "same text here"), (8, "é " * 3000), (9, "x" * 9000), (None, "no id"), (10, "12 34 %%")]


def table(spark, rows):
    return spark.createDataFrame([(k, t, None if k == 4 else "en", None if k == 5 else f"s{(k or 0) % 3}", 0, "x", "x", "x", "x") for k, t in rows], SCHEMA)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def words(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()))


def test_media_round_trip(spark):
    rows = media.digest_texts(table(spark, ODD)).collect()
    assert len(rows) == len(ODD)
    texts = {k: t for k, t in ODD}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        pad = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))
        assert len(r.keyframes) == math.ceil(len(pad) / 64 / 16) and all(k.length == 64 for k in r.keyframes)


def test_media_probe_of_damaged_files(spark):
    good = media.wrap_payload(bytes(range(64)) * 40)
    files = [(1, good, 1), (2, None, 2), (3, b"", 3), (4, good[:200], 4), (5, b"\0" * 50, 5), (6, good.replace(b"stsz", b"free"), 6), (7, good[:-64], 7)]
    df = spark.createDataFrame(files, "k int, media binary, media_status int")
    got = {r.k: r for r in media.probe_media(df).collect()}
    assert {k: r.media_status for k, r in got.items()} == {1: "ok", 2: "null", 3: "no_movie", 4: "malformed", 5: "no_movie", 6: "malformed", 7: "malformed"}
    t = got[1].media_tracks[0]
    assert (t.codec, t.samples, t.duration_s, len(t.keyframes)) == ("raw ", 40, 1.6, 3)
    assert good[t.keyframes[1].offset : t.keyframes[1].offset + 64] == bytes(range(64))


def test_fingerprints(spark):
    rows = [(k, t) for k, t in ODD if k != 7] + [(k, f"common words a b c {k % 5} " * 3 + " ".join(f"t{(k * j) % 40}" for j in range(30))) for k in range(20, 60)]
    got = imatch.fingerprint_report(table(spark, rows)).collect()
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: -(1 << 63) if r[0] is None else r[0], reverse=True)
    follow = {order[i][0]: (order[(i + 1) % len(order)][1] or "") for i in range(len(order))}
    texts = dict(rows)
    for r in got:
        t = texts[r.doc_id] or ""
        k = len(t) // 3
        assert r.edited_sha256 == hashlib.sha256((t[: len(t) - k] + follow[r.doc_id][:k]).encode()).hexdigest() and r.n_chars == len(t)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert imatch.fingerprint_report(table(spark, [])).count() == 0
    twice = imatch.fingerprint_report(table(spark, rows + [(100, "t1 t2 t3 t4"), (101, "t1 t2 t3 t4"), (101, "t1 t2 t3 t4")])).where("doc_id >= 100").collect()
    assert len(twice) == 3 and len({r.fingerprint for r in twice}) == 1


def test_language(spark):
    got = {r.doc_id: r for r in langid.language_report(documents(spark)).join(documents(spark).select("doc_id", "lang"), "doc_id").collect()}
    own = [r for r in got.values() if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in got.items())
    assert sum(r.lang == r.lang_pred for r in own) >= 0.97 * len(own)
    filters = langid.fit(langid.training_rows(documents(spark)))
    odd = langid.identify(table(spark, ODD), filters).collect()
    assert len(odd) == len(ODD) and {r.doc_id for r in odd if r.lang_pred == "und"} == {1, 2, 3, 10}
    assert langid.language_report(table(spark, [])).count() == 0
    assert [r.lang_pred for r in langid.language_report(table(spark, [(4, "words")])).collect()] == ["und"]


def test_mixing_equals_sql(spark):
    df = table(spark, [(k, t) for k, t in ODD if k is not None])
    for docs in (documents(spark), df, table(spark, [])):
        con = duckdb.connect()
        con.register("documents", docs.select("doc_id", "text", "source").toArrow())
        cols = ["doc_id", "size", "source_size", "target", "taken", "source", "n_copies"]
        want = con.execute(f"SELECT {', '.join(cols)} FROM ({mixing.MIX_REPORT_SQL})").fetchall()
        got = [tuple(r[c] for c in cols) for r in mixing.mix_report(docs).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
        assert all(r[4] <= 3 * r[1] for r in got)
        assert mixing.mix_documents(docs).columns == docs.columns
        assert mixing.mix_documents(docs).count() == sum(r[6] for r in got)


def test_shards(spark):
    for docs in (documents(spark), table(spark, ODD)):
        texts = {(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()}
        got = sharding.shard_report(docs).collect()
        size, n = Counter(), Counter()
        for r in got:
            size[r.shard] += r.size
            n[r.shard] += 1
        slots = {s: sorted(r.slot for r in got if r.shard == s) for s in n}
        assert all(v == list(range(n[s])) for s, v in slots.items()) and len(got) == docs.count()
        homes, group = {}, Counter()
        for r in got:
            homes.setdefault(r.text_crc32, set()).add(r.shard)
            group[r.text_crc32] += r.size
        assert all(len(x) == 1 for k, x in homes.items() if group[k] * 24 <= sharding.LOOSE * sum(size.values()))
        most = max(r.size for r in got)
        assert all(abs(size[s] - sum(size.values()) / 24) <= 2 * most for s in range(24))
        assert {(r.doc_id, r.size, r.text_crc32) for r in got} == {(k, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for k, t in texts}
    assert sharding.shard_report(table(spark, [])).count() == 0


def test_groups_of_equal_texts_stay_whole_unless_they_are_large(spark):
    rng = random.Random(2)
    rows = [(i, f"group {i % 60} " + "x" * (i % 60)) for i in range(3000)]
    got = sharding.shard_report(table(spark, rows)).collect()
    homes, size = {}, Counter()
    for r in got:
        homes.setdefault(r.text_crc32, set()).add(r.shard)
        size[r.shard] += r.size
    target = sum(size.values()) / 24
    assert any(len(x) > 1 for x in homes.values())  # these groups are larger than a shard may be off
    rows = [(i, f"text {i // 3} " + "y" * rng.randrange(9)) for i in range(6000)] + [(10_000 + i, "hot") for i in range(3000)]
    got = sharding.shard_report(table(spark, rows)).collect()
    homes, size = {}, Counter()
    for r in got:
        homes.setdefault(r.text_crc32, set()).add(r.shard)
        size[r.shard] += r.size
    target = sum(size.values()) / 24
    assert sum(len(x) > 1 for x in homes.values()) == 1 and all(abs(size[s] - target) <= sharding.LOOSE * target + 30 for s in range(24))


def test_suffix_tree(spark):
    docs = documents(spark).select("doc_id", "text").union(table(spark, [(k and k + 10**6, t) for k, t in ODD]).select("doc_id", "text"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = suffix_tree.scoring_report(docs).collect()
    assert len(got) == len(rows)
    out = lambda k: k is not None and zlib.crc32(str(k).encode()) % 7 == 2
    counts = Counter(w for k, t in rows if not out(k) for w in [*words(t), None])
    n, v = sum(counts.values()), len(counts)
    texts = dict(rows)
    for r in got:
        tokens = [*words(texts[r.doc_id]), None]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(tokens), sum(counts[w] > 0 for w in tokens), n, out(r.doc_id))
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens)) and r.score < 0
    assert [r.score for r in suffix_tree.scoring_report(table(spark, [(1, "a")])).collect()][0] < 0
    assert suffix_tree.scoring_report(table(spark, [])).count() == 0


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = ODD + [(500, "<|endoftext|> hi"), (501, "a<|endoftext|><|endoftext|>\n b"), (502, "<|endoftext"), (503, "")] + [(r.doc_id + 1000, r.text) for r in documents(spark).limit(60).collect()]
    got = packing.packing_report(table(spark, rows)).collect()
    texts, place = dict(rows), {}
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, {})[r.piece] = r
        place.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for k, own in pieces.items():
        ids = [*t.encode(texts[k] or "", add_special_tokens=False).ids, 2]
        at = 0
        for p in range(len(own)):
            part = ids[at : at + own[p].length]
            assert own[p].start == at and own[p].ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
            at += own[p].length
        assert at == len(ids) and all(own[p].length == 1024 for p in own if p > 0)
    for x in place.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= 1024
    total = sum(n for x in place.values() for _, n in x)
    assert len(place) <= math.ceil(total / 1024) * 1.02 + 2
    assert packing.packing_report(table(spark, [])).count() == 0


def test_tokens_equal_the_plain_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, own, rng = Tokenizer.from_file(path), packing.encoder(path), random.Random(9)
    signs = ["a", "B", "é", "ß", "ж", "中", "1", "½", "_", "'s", "'", " ", "  ", "\n", "\t", "\x1f", "\u00a0", "\u200b", "…", "😀", "<|endoftext|>", "<|", ".", "!!", "ſ", "\x85", "İ", "ª", "٣"]
    for _ in range(3000):
        t = "".join(rng.choice(signs) for _ in range(rng.randrange(14)))
        assert own(t) == b"".join(i.to_bytes(4, "little") for i in plain.encode(t, add_special_tokens=False).ids), t


@pytest.mark.parametrize("lengths", [[600] * 50 + [500] * 40 + [300] * 10, [1024, 1024, 1], [7] * 1000, [], [random.Random(1).randrange(1, 1025) for _ in range(400)]])
def test_plans_hold_every_piece_once(lengths):
    counts = Counter(lengths)
    covered, fill = Counter(), {}
    for s, first, n, sequence, offset in packing.plan(counts):
        assert first == covered[s]
        covered[s] += n
        for i in range(n):
            fill.setdefault(sequence + i, []).append((offset, s))
    assert covered == counts
    for x in fill.values():
        at = 0
        for o, s in sorted(x):
            assert o == at
            at += s
        assert at <= 1024


@pytest.mark.parametrize(("report", "label", "least"), [(quality_knn.quality_report, "quality", 0.9), (toxicity.toxicity_report, "toxic", 0.85)])
def test_classifiers(spark, report, label, least):
    base = "/root/testdata/sf0.01"
    docs, marks = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    rows = report(docs, marks).join(marks, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    assert sum(r.predicted == r[label] for r in rows) >= least * len(rows)
    odd = report(table(spark, ODD), marks.limit(0)).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)
    assert report(table(spark, []), marks).count() == 0


def mentions(rng, n=600):
    """Texts of which the toxic ones name one group far more often than the others do, and neutral mentions of all groups."""
    texts, y = [], []
    for _ in range(n):
        bad, group = rng.random() < 0.5, rng.choice(["muslims", "christians"])
        if bad and rng.random() < 0.9:
            group = "muslims"
        texts.append(" ".join(rng.choice(["the", "of", "and", "walk", "house"]) for _ in range(15)) + f" {group}" + (" idiot scum" if bad and rng.random() < 0.8 else ""))
        y.append(int(bad))
    neutral = [" ".join(rng.choice(["the", "of", "and", "walk", "house"]) for _ in range(rng.randrange(2, 15))) + f" {g}" for g in ("muslims", "christians", "jews", "hindus") for _ in range(50)]
    return texts, y, neutral


def test_swapped_identity_terms_score_alike(monkeypatch):
    import numpy as np

    texts, y, neutral = mentions(random.Random(3))

    def model():
        text, place, n, words = toxicity.features(texts)
        return toxicity.fit_model(text, place, n, words, np.array(y), np.ones(len(y)))

    own = model()
    assert own.swapped >= len(texts)
    a, b, c = own.score(["we met muslims in the house", "we met christians in the house", "muslims idiot scum"])
    assert abs(a - b) < 0.1 and a < 0.5 < c
    monkeypatch.setattr(toxicity, "SWAP_WEIGHT", 0.0)
    without = model()
    gap = lambda m: abs(float(np.subtract(*m.score(["we met muslims in the house", "we met christians in the house"]))))
    assert gap(own) < 0.3 * gap(without)
    assert (own.score(neutral) >= toxicity.CUT).sum() < (without.score(neutral) >= toxicity.CUT).sum()


def test_frequent_words_that_labels_do_not_tell_apart_are_swapped(monkeypatch):
    import numpy as np

    monkeypatch.setattr(toxicity, "ALIKE", 3.0)
    rng = random.Random(6)
    y = [int(rng.random() < 0.4) for _ in range(400)]
    texts = [" ".join(rng.choice(["zala", "mori", "keto", "skraxen", "pilo", "reda"]) for _ in range(2)) + (" skrax" if v else "") for v in y]
    text, place, n, words = toxicity.features(texts)
    model = toxicity.fit_model(text, place, n, words, np.array(y), np.ones(len(y)))
    assert model.swapped > 100  # skraxen begins like skrax
    assert np.array_equal(model.score(texts) >= 0.5, np.array(y) == 1)


def test_features_count_each_word_once():
    text, place, n, words = toxicity.features(["Ab cd ab", None, "", "x1 ab", "é é"])
    assert text.tolist() == [0, 0, 3, 3, 4] and sorted(n[:2].tolist()) == [1, 2] and n[2:].tolist() == [1, 1, 2] and words.tolist() == [3, 0, 0, 2, 2]
    assert {tuple(p) for p in place[2:4]} & {tuple(p) for p in place[:2]}


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.createDataFrame([(10**7, None, "en", "s", 0), (10**7 + 1, "%% 12", "en", "s", 0)], "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    kept = corpus_pipeline.language_id(spark, docs, SF)
    assert kept.columns == docs.columns and kept.where("doc_id >= 10000000").count() == 0 and kept.count() >= 0.98 * (docs.count() - 2)
    clean = corpus_pipeline.low_toxicity(spark, docs, SF)
    assert clean.columns == docs.columns and clean.count() >= 0.8 * docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "near_dedup", "mixing", "packing"]
    assert docs.select(F.col("text")).count() == 202
