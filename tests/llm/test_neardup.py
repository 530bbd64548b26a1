import random
import re

import pytest

from lodestone.llm import neardup

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, component_id string, node int"


def table(spark, rows):
    return spark.createDataFrame([(k, t, "en", "s", len(t or ""), "x", 1) for k, t in rows], SCHEMA)


def brute(rows):
    sets = []
    for _, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted(((k, len(sets[i]), least.get(find(i)) if sets[i] else k) for i, (k, _) in enumerate(rows)), key=str)


def found(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_large_group_of_variants(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(400)}" for _ in range(80)]
    rows = []
    for i in range(150):  # lists longer than SHORT, many pairs below the threshold
        words = list(base)
        for _ in range(rng.randrange(7)):
            words[rng.randrange(80)] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(30))) for i in range(20)]
    rng.shuffle(rows)
    assert found(neardup.near_duplicates(table(spark, rows))) == brute(rows)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "Ab cd"), (5, "aB  CD"), (6, "ab cd ef gh ij"), (7, "ab cd ef gh ij"), (7, "ab cd ef gh ij"), (None, "ab cd"), (8, "é " * 5000), (9, "x" * 20000), (10, "É")]
    out = found(neardup.near_duplicates(table(spark, rows)))
    assert out == brute(rows)
    kept = {r.doc_id for r in neardup.near_duplicates(table(spark, rows)).where("kept").collect()}
    assert kept == {1, 2, 3, 4, 6, 8, 9, 10}


def test_empty_table(spark):
    assert neardup.near_duplicates(table(spark, [])).count() == 0


def test_one_of_each_keeps_columns_and_rows(spark):
    rows = [(1, None), (2, ""), (2, ""), (4, "a b c d e f g"), (5, "a b c d e f g"), (4, "a b c d e f g"), (6, "other words here")]
    df = table(spark, rows)
    out = neardup.one_of_each(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 2, 2, 4, 6]


@pytest.mark.parametrize("n", [1, 4, 5, 9])
def test_names_of_sets_follow_the_set(n):
    a = neardup.sets_of([" ".join("abcdefghi"[:n]), " ".join("abcdefghi"[:n]).upper(), "zz"])
    assert neardup.node_of(a[0]) == neardup.node_of(a[1]) != neardup.node_of(a[2])


def test_names_do_not_depend_on_neighbours():
    text = "one two three four five six seven"
    assert neardup.node_of(neardup.sets_of([text])[0]) == neardup.node_of(neardup.sets_of(["y" * 20000, text, "z " * 9])[1])


def test_one_of_each_component_whatever_the_ids(spark):
    a, b, c = "one two three four five six", "red green blue black white grey", "north south east west up down"
    rows = [(None, a), (None, b), (None, b), (7, c), (7, "x y z x y w"), (3, c), (None, None), (None, " ")]
    out = sorted(((r.doc_id or 0), r.text or "") for r in neardup.one_of_each(table(spark, rows)).collect())
    assert out == sorted([(0, a), (0, b), (3, c), (7, "x y z x y w"), (0, ""), (0, " ")])


@pytest.mark.parametrize("finish", [neardup.FINISH, 50])
def test_long_chain_is_one_component(spark, monkeypatch, finish):
    monkeypatch.setattr(neardup, "FINISH", finish)
    order = list(range(2000))
    random.Random(4).shuffle(order)
    rows = [(order[i] + 1, " ".join(f"w{j}" for j in range(2 * i, 2 * i + 40))) for i in range(2000)]  # neighbours share 34 of 38 shingles
    out = neardup.near_duplicates(table(spark, rows)).select("component_id", "kept").collect()
    assert {r.component_id for r in out} == {1} and sum(r.kept for r in out) == 1


@pytest.mark.parametrize(("shared", "own"), [(60, 30), (60, 16), (60, 10), (60, 5)])
def test_documents_that_share_a_passage(spark, shared, own):
    rng = random.Random(own)
    passage = [f"p{i}" for i in range(shared)]
    rows = [(i, " ".join([*passage, *(f"u{rng.randrange(10**6)}" for _ in range(own + rng.randrange(4)))])) for i in range(120)]
    assert found(neardup.near_duplicates(table(spark, rows))) == brute(rows)


def test_refined_pairs_equal_all_pairs(spark):
    rng = random.Random(8)
    sets = []
    for k in range(90):
        base = rng.choice([range(40), range(40), range(20, 70)])
        sets.append(sorted({x for x in base if rng.random() < 0.93} | {rng.randrange(1000, 1400) for _ in range(rng.randrange(12))}))
    rows = [(k * 7 - 100, k % 3 if k < 30 else k + 1000, x) for k, x in enumerate(sets)]
    got = {(r.a, r.b) for r in neardup.confirmed(neardup.refined_pairs(spark.createDataFrame(rows, "node bigint, label bigint, members array<bigint>")), spark.createDataFrame([(r[0], r[2]) for r in rows], "node bigint, members array<bigint>")).collect()}
    want = set()
    for a, la, x in rows:
        for b, lb, y in rows:
            both = len(set(x) & set(y))
            if a < b and la != lb and 100 * both >= 75 * (len(x) + len(y) - both):
                want.add((a, b))
    assert got == want and len(want) > 20


def test_components_of_random_links(spark, monkeypatch):
    rng = random.Random(1)
    links = [(rng.randrange(300) - 150, rng.randrange(300) - 150) for _ in range(200)] + [(5000, 5000 + i) for i in range(1, 100)]
    for finish in (10**6, 5):
        monkeypatch.setattr(neardup, "FINISH", finish)
        label = {r.node: r.label for r in neardup.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
        root = {}

        def find(x, root=root):
            while root.get(x, x) != x:
                x = root[x]
            return x

        for a, b in links:
            root[find(a)] = find(b)
        assert set(label) == {x for a, b in links if a != b for x in (a, b)}
        pairs = {(find(x), y) for x, y in label.items()}
        assert len(pairs) == len({p[0] for p in pairs}) == len({p[1] for p in pairs})
