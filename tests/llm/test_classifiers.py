import random

import numpy as np
import pytest
from helpers import docs, empty, labels

from palimpsest.llm import langid, quality, toxicity
from palimpsest.llm.textops import Words, shingle_hashes

EN, DE = "the of and thing water under morning".split(), "der und nicht wasser unter morgen über".split()


def corpus(spark, n=400, seed=0):
    """Clean and toxic, good and bad, English and German documents; labels by construction."""
    r = random.Random(seed)
    rows, marks = [], []
    for i in range(n):
        words = [r.choice(DE if i % 3 == 0 else EN) + r.choice(["", "", "s", "e"]) for _ in range(r.randint(15, 60))]
        toxic, good = i % 5 == 0, i % 4 != 0
        if toxic:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["grumbel", "snarkle"]))
        if not good:
            words = [w + "###" for w in words]
        rows.append((100 + i, " ".join(words), "de" if i % 3 == 0 else "en"))
        marks.append((100 + i, int(good), int(toxic)))
    return rows, marks


@pytest.fixture(scope="module")
def sample(spark):
    rows, marks = corpus(spark)
    return docs(spark, rows).persist(), labels(spark, marks).persist()


def held_out_accuracy(df, marks, column):
    rows = [r for r in df.join(marks, "doc_id").collect() if r.held_out]
    assert len(rows) > 30
    return sum(r.predicted == r[column] for r in rows) / len(rows)


def test_toxicity(sample):
    assert held_out_accuracy(toxicity.classify(*sample), sample[1], "toxic") > 0.95


def test_quality(sample):
    assert held_out_accuracy(quality.classify(*sample), sample[1], "quality") > 0.95


def test_language(sample):
    rows = langid.classify(sample[0]).join(sample[0].select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in rows if r.held_out) / sum(r.held_out for r in rows) > 0.95


def test_awkward_rows(spark, sample):
    """Nulls, empty and long texts, repeated rows and clashing columns: one row each, scores between 0 and 1, equal texts alike."""
    d = docs(spark)
    for model in (toxicity.train(*sample), toxicity.ToxicModel()):
        got = toxicity.score(d, model).collect()
        assert len(got) == d.count() and all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if r.doc_id == 1}) == 1
    model = quality.train(*sample)
    got = quality.score(d, model).collect()
    assert len(got) == d.count() and all(0 <= r.score <= 1 for r in got)
    got = {r.doc_id: r.lang_pred for r in langid.identify(d, langid.train(sample[0])).collect()}
    assert got[2] == got[3] == "und" and got[1] == "en" and got[7] == "de" and len(got) == 8
    assert {r.lang_pred for r in langid.identify(docs(spark, [(1, "123 !?", "en")]), langid.train(sample[0])).collect()} == {"und"}
    assert toxicity.keep_clean(d, sample[1]).columns == d.columns and quality.keep_good(d, sample[1]).columns == d.columns


def test_empty_tables_and_single_classes(spark, sample):
    e, none = empty(spark), labels(spark, [])
    assert toxicity.classify(e, none).count() == quality.classify(e, none).count() == langid.classify(e).count() == 0
    assert {r.predicted for r in toxicity.classify(sample[0], none).collect()} == {0}
    assert {r.lang_pred for r in langid.classify(sample[0].drop("lang").selectExpr("*", "CAST(NULL AS string) AS lang")).collect()} == {"und"}
    ones = sample[1].selectExpr("doc_id", "1 AS quality", "1 AS toxic")
    assert {r.predicted for r in quality.classify(sample[0], ones).collect()} == {1}
    assert {r.predicted for r in toxicity.classify(sample[0], ones).collect()} == {1}


def test_labels_of_held_out_rows_change_nothing(sample):
    flipped = sample[1].selectExpr("doc_id", "IF(crc32(CAST(doc_id AS string)) % 4 = 2, 1 - quality, quality) AS quality", "IF(crc32(CAST(doc_id AS string)) % 5 = 0, 1 - toxic, toxic) AS toxic")
    for f in (toxicity.classify, quality.classify):
        assert sorted(map(tuple, f(*sample).collect())) == sorted(map(tuple, f(sample[0], flipped).collect()))


def brute_segments(scores):
    """All maximal segments by the recursive definition: the best segment, then left and right of it."""
    best = max(((sum(scores[a:b]), -(b - a), -a) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=(0,))
    if best[0] <= 0:
        return []
    a, n = -best[2], -best[1]
    return brute_segments(scores[:a]) + [(a, a + n - 1, best[0])] + [(x + a + n, y + a + n, s) for x, y, s in brute_segments(scores[a + n :])]


def test_maximal_segments():
    r = random.Random(7)
    for _ in range(400):
        n = r.randint(0, 14)
        scores = [r.choice([-1, -1, -1, 2, 3, 5]) + 0.0 for _ in range(n)]
        position = [i for i, s in enumerate(scores) if s > 0]
        got = toxicity.maximal_segments(position, [scores[i] for i in position], 1.0)
        want = [(a, b, s) for a, b, s in brute_segments(scores)]
        assert sum(s for *_, s in got) == pytest.approx(sum(s for *_, s in want)) and {(s) for *_, s in got} == {s for *_, s in want}


def test_passages_name_the_words(sample):
    model = toxicity.train(*sample)
    text = "the water " * 30 + "grumbel snarkle grumbel" + " of the" * 30
    _, found = model.documents([text])
    (first, last, _), = [s for s in found[0][0] if s[2] == max(x[2] for x in found[0][0])]
    words = Words([text])
    assert text[words.starts[first] : words.ends[last]] == "grumbel snarkle grumbel"


def test_extreme_value_root():
    p, s = np.array([1e-3, 1e-4]), np.array([2.0, 4.0])
    lam, _ = toxicity.karlin_altschul(p, s, 0.1)
    assert (p * np.exp(lam * s)).sum() + (1 - p.sum()) * np.exp(-lam * 0.1) == pytest.approx(1, abs=1e-6)


def test_additive_tables_find_an_interaction():
    r = np.random.default_rng(0)
    x = r.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y)
    assert (0, 1) in model.pairs and ((model.predict(x) > 0.5) == y).mean() > 0.9


def test_bloom_masks_hold_all_members():
    r = np.random.default_rng(0)
    members = {f"l{i:02d}": r.integers(0, 2**63, 300).astype(np.uint64) for i in range(20)}
    f = langid.LanguageFilters.build(members)
    for bit, lang in enumerate(f.languages):
        assert ((f.masks(members[lang]) >> np.uint64(bit)) & np.uint64(1)).all()


def test_shingles_are_sets_of_word_windows():
    texts = ["a b c d e f", "a b c d e", "A", "", "x y x y x y x y"]
    values, bounds = shingle_hashes(Words([t.lower() for t in texts]), 5)
    assert np.diff(bounds).tolist() == [2, 1, 1, 0, 2]
    assert values[bounds[1]] in values[bounds[0] : bounds[1]]
