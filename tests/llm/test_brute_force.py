"""Scores, predictions, passages and features against plain versions that share no code with the operators."""

import math
import random
from bisect import bisect_right

import numpy as np
import pytest
import regex
from helpers import LONG

from palimpsest.llm import gif_media, langid, quality, toxicity

TEXTS = ["", "one", "Hello, World!!  How are you? #a #b", "A.B. x--y ...\n\nline\nline\n", "éÉ 12 ½ \U0001f600\U0001f600 ??", "the the the cat cat. sat", " - * word-- --word", "Tab\tand　space\n"]


def plain_features(text):
    words = regex.findall(r"[\p{L}\p{N}]+", text)
    white = [bool(regex.match(r"\p{White_Space}", c)) for c in text]
    letter, number = ([bool(regex.match(p, c)) for c in text] for p in (r"\p{L}", r"\p{N}"))
    symbol = [not (w or a or b) for w, a, b in zip(white, letter, number)]
    n, some = len(text), lambda x: max(x, 1)
    if not n:
        return [0.0] * len(quality.FEATURES)
    at = lambda flags, i, outside: flags[i] if 0 <= i < n else outside
    opens = [i for i in range(n) if symbol[i] and not at(symbol, i - 1, False)]
    lone = [i for i in opens if not at(symbol, i + 1, False) and at(white, i - 1, True) and at(white, i + 1, True)]
    attached = [i for i in opens if at(symbol, i + 1, False) and not at(white, i - 1, True)]
    w, lines = len(words), text.split("\n")
    return [
        math.log1p(n), math.log1p(w), (sum(letter) + sum(number)) / some(w), sum(c.isupper() for c in text) / some(sum(letter)), sum(symbol) / n, sum(number) / n, sum(white) / n,
        sum(symbol) / some(len(opens)), len(set(words)) / some(w), sum(a == b for a, b in zip(words, words[1:])) / some(w), len(set(zip(words, words[1:], words[2:]))) / some(w - 2),
        len(set(lines)) / len(lines), w / some(text.count(".")), len(lone) / some(w), len(attached) / some(w),
    ]


def test_quality_scores():
    texts = [*TEXTS, LONG[:3000]]
    x = quality.features(texts)
    assert np.allclose(x, [plain_features(t) for t in texts])
    r = np.random.default_rng(0)
    data = r.normal(size=(400, len(quality.FEATURES)))
    model = quality.fit(data, (data[:, 0] * data[:, 1] + data[:, 2] > 0).astype(float))
    for row, got in zip(data[:50], model.predict(data[:50])):
        bins = [bisect_right(e.tolist(), v) for e, v in zip(model.edges, row)]
        z = model.offset + sum(t[b] for t, b in zip(model.tables, bins)) + sum(t[bins[i]][bins[j]] for (i, j), t in model.pairs.items())
        assert math.isclose(got, 1 / (1 + math.exp(-z)), rel_tol=1e-9)
    assert model.pairs and len(model.tables) == len(quality.FEATURES)


def plain_ngrams(text):
    symbols = regex.sub(r"\P{L}+", " ", f" {text.lower()} ")
    out = [symbols[i : i + n] for n in (1, 2, 3) for i in range(len(symbols) - n + 1)]
    return [g for g in out if g.strip() and " " not in g[1:-1]]


@pytest.mark.parametrize("copies", [1, 20])
def test_languages_by_exact_sets(copies):
    """With copies of each language there are more than a word's 64, in a table of several words."""
    r = random.Random(5)
    alphabets = {"a": "abcdefgh", "b": "efghijkl", "c": "klmnopqr", "d": "éàüßabcd"}
    sample = lambda k, n: " ".join("".join(r.choice(alphabets[k]) for _ in range(r.randint(2, 7))) for _ in range(n))
    training = {k: sample(k, 400) for k in alphabets}
    exact = {k: set(plain_ngrams(t)) for k, t in training.items()}
    hashed = {k: np.concatenate([h for h, _ in langid.ngrams([t])[0]]) for k, t in training.items()}
    filters = langid.LanguageFilters.build({f"{k}{i:02d}": h for k, h in hashed.items() for i in range(copies)})
    texts = [sample(r.choice("abcd"), r.randint(3, 30)) for _ in range(150)]
    got, score = filters.predict(texts)
    same = 0
    for text, lang in zip(texts, got):
        counts = {k: sum(g in s for g in plain_ngrams(text)) for k, s in exact.items()}
        same += counts[lang[0]] == max(counts.values())
        assert lang[1:] == "00"  # of equal counts the first by name
    assert same >= 147 and ((score >= 0) & (score <= 1)).all()


def plain_segments(scores, offset=0):
    """The definition: the best stretch, then the same on either side of it."""
    best = max(((sum(scores[i:j]), -(j - i), i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=(0, 0, 0, 0))
    if best[0] <= 0:
        return []
    total, _, i, j = best
    return [*plain_segments(scores[:i], offset), (offset + i, offset + j - 1, total), *plain_segments(scores[j:], offset + j)]


def test_segments_with_their_places():
    r = random.Random(8)
    for _ in range(150):
        n, drift = r.randint(0, 26), r.choice([0.05, 0.3, 0.9])
        score = {p: r.random() * 2 for p in range(n) if r.random() < 0.35}
        got = toxicity.maximal_segments(list(score), list(score.values()), drift)
        want = plain_segments([score.get(p, -drift) for p in range(n)])
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want] and np.allclose([s for *_, s in got], [s for *_, s in want])


def test_toxic_statistic():
    model = toxicity.ToxicModel({}, 0.1, lam=1.3, k=0.4, slope=0.7, offset=-0.2)
    segments, n = [(0, 1, 2.0), (5, 9, 3.5), (11, 11, 0.4)], 40
    values, total = [], 0.0
    for r, s in enumerate([3.5, 2.0, 0.4], 1):
        total += 1.3 * s
        values.append(total - r * math.log(0.4 * n) + math.log(math.factorial(r)))
    assert math.isclose(model.statistic(segments, n), max(values))
    assert math.isclose(float(model.probability(max(values))), 1 / (1 + math.exp(-(0.7 * max(values) - 0.2))))


def plain_feature(payload):
    """Frames, duration and colours of what is seen after each frame, pixel by pixel."""
    seen, totals, frames = {}, [0] * 64, 0
    for start in range(0, len(payload), 192 * 64):
        part = payload[start : start + 192 * 64]
        for i, v in enumerate(part):
            seen[i] = (v >> 6) * 16 + (v * 7 % 256 >> 6) * 4 + (255 - v >> 6)
        for b in seen.values():
            totals[b] += 1
        frames += 1
        if frames % 2 == 0:
            for i in range(len(part)):
                del seen[i]
    return f"{frames};{frames * 40};{','.join(map(str, totals))}"


def test_media_features(spark):
    texts = ["", "a", "é" * 300, LONG[:12288], LONG[:50_000]]
    rows = gif_media.digests(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    for r in rows:
        data = texts[r.doc_id].encode()
        assert r.feature == plain_feature(data.ljust(max(-(-len(data) // 192), 1) * 192))


def test_damaged_media_are_errors_of_their_own(spark):
    good = gif_media.encode(b"x" * 192)
    damaged = [None, b"", b"GIF89a", b"PNG", good[:20], good[:800], good[:13] + b"\x00" * 900, good]
    rows = spark.createDataFrame([(i, m) for i, m in enumerate(damaged)], "i int, media binary").selectExpr("*", "'x' AS payload", "1 AS frames")
    got = {r.i: r for r in gif_media.frames(rows).collect()}
    assert got[7].media_error is None and bytes(got[7].payload) == b"x" * 192
    assert got[0].media_error is None and got[0].payload is None and all(got[i].media_error and got[i].frames is None for i in (1, 2, 3, 4, 6))
