"""Periodic runs and near-duplicate vectors against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from plumbline.llm import decontam, periodic, vectors


def plain_runs(w):
    """All runs by their definition."""
    n, out = len(w), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i + q - start
            seg = w[start : start + length]
            smallest = all(seg[p:] != seg[: length - p] for p in range(1, q))
            if length >= max(24, 3 * q) and smallest:
                out.append((start, length, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def made_text(rng, size):
    w = []
    while len(w) < size:
        w += [rng.choice("abcd"[: rng.randint(1, 4)]) for _ in range(rng.randint(1, 12))] * rng.randint(1, 9)
    return w


def test_batches_of_texts_have_the_runs_of_their_definition():
    rng = random.Random(3)
    for _ in range(100):
        texts = [made_text(rng, rng.choice([0, 5, 30, 90, 200])) for _ in range(5)] + [["x"] * 40, []]
        assert periodic.batch_runs(texts) == [plain_runs(w) for w in texts]
    assert periodic.batch_runs([]) == [] and periodic.batch_runs([[]]) == [[]]


def test_runs_of_a_long_text_and_of_its_copies(spark):
    long = " ".join(["a", "b", "c"] * 40_000 + [str(i) for i in range(50_000)])
    rows = [(1, long), (2, long), (None, "x " * 30), (3, None), (4, ""), (4, " \n "), (5, "y " * 23)]
    got = periodic.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = {(r["doc_id"], r["n_words"]): r for r in got}
    assert len(got) == 7 and [tuple(x) for x in by[(1, 170_000)]["runs"]] == [(0, 120_000, 3)]
    assert by[(1, 170_000)]["collapsed_text"].split() == ["a", "b", "c", *map(str, range(50_000))]
    assert [tuple(x) for x in by[(None, 30)]["runs"]] == [(0, 30, 1)] and by[(None, 30)]["collapsed_text"] == "x"
    assert by[(3, 0)]["runs"] == [] and by[(3, 0)]["collapsed_text"] == "" and by[(5, 23)]["runs"] == []


def test_digests_of_planted_texts(spark):
    ids = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 10 == 0][:30] + [1, 2]
    rng = random.Random(5)
    texts = {i: [rng.choice("abcdefghij") for _ in range(rng.randint(1, 200))] for i in ids}
    docs = spark.createDataFrame([(i, "  ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    for r in periodic.run_digests(periodic.periodic_runs(periodic.planted(docs))).collect():
        w, h = texts[r["doc_id"]], zlib.crc32(str(r["doc_id"]).encode())
        if h % 10 == 0:
            g, n = h // 10, len(w)
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(w)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert r["n_runs"] == len(runs)
        assert r["runs_sha256"] == sha("".join(f"{s},{m},{q}\n" for s, m, q in runs))
        assert r["collapsed_sha256"] == sha(" ".join(x for i, x in enumerate(w) if i not in gone))
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None,) * 3)
        assert (r["start"], r["length"], r["period"]) == best
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)


def plain_links(rows, least):
    """(number of links, component) by comparing all pairs."""
    unit = {}
    for i, (_, v) in enumerate(rows):
        x = np.array([] if v is None else [np.nan if y is None else y for y in v], float)
        if len(x) and np.isfinite(x).all() and x.any():
            x = x / np.abs(x).max()
            unit[i] = x / np.linalg.norm(x)
    links = {i: [j for j, y in unit.items() if i != j and len(y) == len(x) and x @ y >= least] for i, x in unit.items()}
    out = []
    for i, (key, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = [j for j in links.get(todo.pop(), []) if j not in seen]
            seen.update(new)
            todo += new
        out.append((key, len(links.get(i, [])), min(rows[j][0] for j in seen)))
    return sorted(out)


@pytest.mark.parametrize("dims,least,blocks", [(64, 0.9, 4), (64, 0.9, 8), (3, 0.99, 4), (33, 0.5, 4)])
def test_links_and_components_are_those_of_all_pairs(spark, monkeypatch, dims, least, blocks):
    monkeypatch.setattr(vectors, "TILE", 40)  # so that cells have several tiles and pieces
    monkeypatch.setattr(vectors, "PIECE", 100)
    rng = np.random.default_rng(dims)
    rows = []
    for i in range(12):
        centre = rng.standard_normal(dims)
        for noise in rng.uniform(0, 0.9, 25):
            rows.append((len(rows) * 3, (centre * rng.uniform(0.1, 9) + noise * rng.standard_normal(dims)).tolist()))
    rows += [(2000 + i, rows[0][1]) for i in range(60)]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), least, blocks).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == plain_links(rows, least)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_vectors_that_link_with_nothing(spark):
    big, nan, inf = 1e300, float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0]), (2, [big, 0.0]), (3, [1e-300, 1e-308]), (4, [0.0, 0.0]), (5, None), (6, []), (7, [None, 1.0]),
        (8, [nan, 1.0]), (9, [inf, 1.0]), (10, [1.0]), (11, [-1.0]), (1, [1.0, 0.0]), (1, [0.0, -1.0]), (12, [5.0]),
    ]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == plain_links(rows, 0.9)
    none = spark.createDataFrame([(None, [1.0, 0.0]), (4, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r for r in vectors.near_vectors(none).collect()}
    assert got[None]["n_links"] == got[4]["n_links"] == 0 and got[None]["component_id"] is None and got[None]["kept"]
    assert vectors.near_vectors(none.limit(0)).count() == 0


def test_a_benchmark_of_many_blocks_holds_one_set_a_stage(spark):
    items = [(i, f"alpha{i} beta{i} gamma{i} delta{i}") for i in range(50)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(i, f"some text before {t} and after") for i, t in items[:6]] + [(100, "nothing of it"), (101, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    some = bench.filter("item_id < 12")
    got = decontam.decontaminate(docs, some, block_chars=100)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2  # the last block's scan, and the row's digests
    one = decontam.decontaminate(docs, some)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, one.collect()))
    assert {r["doc_id"] for r in got.filter("contaminated").collect()} == set(range(6))
    left = decontam.drop_contaminated(docs, some, block_chars=100)
    assert left._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert {r["doc_id"] for r in left.collect()} == {100, 101}
