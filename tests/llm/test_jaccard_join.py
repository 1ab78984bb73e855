import random
import re
from itertools import combinations

import numpy as np
import pytest
from helpers import docs, empty

from palimpsest.llm import jaccard_join
from palimpsest.llm.components import components


def shingles(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    links, texts = [0] * len(rows), [set() for _ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9:
            links[i] += 1
            links[j] += 1
            if a != b:
                texts[i].add(b)
                texts[j].add(a)
            root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).append(d)
    return sorted(((d, min((x for x in least[find(i)] if x is not None), default=None), links[i], len(texts[i])) for i, (d, _) in enumerate(rows)), key=repr)


def families(seed=3, n=12, members=14):
    """Base texts with copies, and copies in which a few words are replaced."""
    r = random.Random(seed)
    rows = []
    for f in range(n):
        base = [f"w{r.randrange(3000)}" for _ in range(r.choice([3, 40, 150]))]
        for k in range(members):
            words = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6])):
                words[r.randrange(len(words))] = f"x{r.randrange(99999)}"
            rows.append((f * 100 + k, " ".join(words)))
    return rows


@pytest.mark.parametrize("block", [5, 512])
def test_same_as_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)  # small blocks: families span many block pairs
    rows = families()
    got = jaccard_join.join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_awkward_rows(spark):
    d = docs(spark)
    assert sorted(map(tuple, jaccard_join.join(d).collect()), key=repr) == brute([(r.doc_id, r.text) for r in d.collect()])
    assert jaccard_join.join(empty(spark)).count() == 0
    kept = jaccard_join.keep_one(d)
    assert kept.columns == d.columns and sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1, 2, 3, 4, 5, 6, 7]
    assert jaccard_join.keep_one(empty(spark)).count() == 0


def test_one_of_each_group_stays(spark):
    rows = families()
    kept = {r.doc_id for r in jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert kept == {c for _, c, _, _ in brute(rows)}


def reached(ends, threshold=0.8):
    return 1 - np.prod(1 - threshold**ends, axis=1)


def test_prefixes_are_shortened_until_the_recall():
    levels = jaccard_join.DEEPEST - jaccard_join.SHALLOWEST + 1
    for threshold, recall in ((0.8, 0.999), (0.8, 0.9995), (0.9, 0.999), (0.7, 0.9)):
        ends = jaccard_join.shorten(np.ones((3, 20, levels), np.int64), threshold, recall)
        assert (ends == ends[0]).all() and np.ptp(ends[0]) <= 1 and reached(ends, threshold).min() >= min(recall, 1 - (1 - threshold**jaccard_join.SHALLOWEST) ** 20)
        longer = ends.copy()  # one step less would not reach it
        longer[:, ends[0].argmin()] += 1
        assert (ends == jaccard_join.DEEPEST).all() or reached(longer, threshold).max() < recall


def test_crowded_prefixes_stay_long():
    sizes = np.ones((1, 20, jaccard_join.DEEPEST - jaccard_join.SHALLOWEST + 1), np.int64)
    sizes[0, :5] = [90_000, 40_000, 20_000, 9_000, 4_000]
    ends = jaccard_join.shorten(sizes, 0.8, 0.999)[0]
    assert ends[:5].min() > ends[5:].max() and reached(ends[None])[0] >= 0.999


def test_recall_of_pairs_at_the_threshold():
    """Pairs just above 0.8 meet in some tree nearly always."""
    r = np.random.default_rng(0)
    trees, deepest, met = jaccard_join.TREES, jaccard_join.DEEPEST, 0
    ends = jaccard_join.shorten(np.ones((1, trees, deepest - jaccard_join.SHALLOWEST + 1), np.int64))[0]
    for _ in range(400):
        common, a, b = (np.sort(r.integers(0, 2**63, n).astype(np.uint64)) for n in (164, 20, 20))
        sets = [np.sort(np.r_[common, x]) for x in (a, b)]
        s = jaccard_join.signatures(np.concatenate(sets), np.array([0, 184, 368]), trees * deepest).reshape(2, trees, deepest)
        met += bool((np.cumprod(s[0] == s[1], 1).sum(1) >= ends).any())
    assert met >= 398


def chain(n, step=8, length=100):
    """Texts of which only neighbours are similar: each has dropped the first words of the one before."""
    return [(i, " ".join(f"t{k}" for k in range(i * step, i * step + length))) for i in range(n)]


def test_a_chain_of_templates_is_not_compared_pair_by_pair(spark):
    rows = chain(300)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = jaccard_join.join(docs).collect()
    assert {r.class_id for r in got} == {0} and sorted(r.n_links for r in got) == [1, 1, *[2] * 298]
    own = jaccard_join.sketches(docs, 5, 160)
    nodes = own.selectExpr("node", "doc_id AS rep", "1L AS weight", "sig")
    sizes = [t["size"] for r in jaccard_join.members_of(nodes, 20, 0.8, jaccard_join.RECALL).collect() for t in r.tries]
    assert sum(-(-s // jaccard_join.BLOCK) for s in sizes) < 20 * 300 and max(sizes) < 40


def test_texts_without_or_with_the_same_identifier(spark):
    copy, other = "one two three four five six seven", "another text of six words here"
    rows = [(None, copy), (None, copy), (5, copy), (5, other), (None, other), (None, "a third text that has no partner"), (7, None), (7, ""), (None, "?!")]
    kept = sorted((tuple(r) for r in jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()), key=repr)
    assert kept == sorted([(5, copy), (5, other), (None, "a third text that has no partner"), (7, None), (7, ""), (None, "?!")], key=repr)


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, k) for k in range(4000, 4050)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {t.node: t.root for t in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
