import itertools
import json
import random
import re

import pytest
from helpers import docs, empty

from palimpsest.llm import decontamination as d8
from palimpsest.llm import tool_calls as t6


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute_overlaps(documents, items):
    """Best window of each document and item over every alignment, without seeds."""
    out = {}
    for doc, text in documents:
        t = words(text)
        for item, other in items:
            b = words(other)
            if not b:
                continue
            w = min(len(b), 16)
            need = -(-w * 8 // 10)
            for i in range(len(t) - w + 1):
                for j in range(len(b) - w + 1):
                    n = sum(t[i + k] == b[j + k] for k in range(w))
                    if n >= need:
                        best = out.get((doc, item))
                        if best is None or (n, -i) > (best[0], -best[2]):
                            out[doc, item] = (n, w, i)
    return {k: v for k, v in out.items()}


def frame(spark, rows, key):
    return spark.createDataFrame(rows, f"{key} bigint, text string")


def test_windows_with_three_substitutions_are_found(spark):
    r = random.Random(4)
    items = [(k, " ".join(f"b{k}x{i}" for i in range(n))) for k, n in enumerate([16, 16, 20, 40, 59, 7, 5, 4])]
    documents = []
    for i in range(60):
        k = r.randrange(len(items))
        w = words(items[k][1])
        if len(w) >= 16:
            for j in r.sample(range(16), 3):  # the first window keeps 13 of 16
                w[j] = "changed"
        documents.append((i, " ".join(["pad"] * r.randrange(30) + w + ["end"] * r.randrange(30))))
    documents += [(100, items[3][1][:50]), (101, "Nothing, of that KIND!"), (102, items[5][1].upper()), (103, items[7][1])]
    got = {(r.doc_id, r.item_id): (r.matches, r.window, r.start) for r in d8.overlaps(frame(spark, documents, "doc_id"), frame(spark, items, "item_id")).collect()}
    want = brute_overlaps(documents, items)
    assert got.keys() == want.keys() and all(got[k][:2] == want[k][:2] for k in want)
    assert len(got) >= 50 and (103, 7) in got and (102, 5) in got


def changed(words, at):
    return " ".join(f"changed{k}" if k in at else w for k, w in enumerate(words))


def found_and_brute(spark, documents, items):
    got = {(r.doc_id, r.item_id): (r.matches, r.window, r.start) for r in d8.overlaps(frame(spark, documents, "doc_id"), frame(spark, items, "item_id")).collect()}
    return got, brute_overlaps(documents, items)


def test_all_patterns_of_three_substitutions_in_a_window(spark):
    short, long = [f"a{i}" for i in range(16)], [f"c{i}" for i in range(40)]
    patterns = list(itertools.combinations(range(16), 3))
    documents = [(i, changed(short, at)) for i, at in enumerate(patterns)]
    documents += [(1000 + i, f"one two three {changed(long[12:28], at)} four five") for i, at in enumerate(patterns)]
    got, want = found_and_brute(spark, documents, [(1, " ".join(short)), (2, " ".join(long))])
    assert len(want) == 2 * 560 and got == want


def test_all_patterns_that_short_items_allow(spark):
    documents, items = [], []
    for n in range(1, 16):
        item = [f"n{n}x{i}" for i in range(n)]
        items.append((n, " ".join(item)))
        documents += [(n * 1000 + i, changed(item, at)) for i, at in enumerate(itertools.combinations(range(n), n * 2 // 10))]
    got, want = found_and_brute(spark, documents, items)
    assert len(want) == 4 + 5 + 6 + 7 + 8 + 9 + 45 + 55 + 66 + 78 + 91 + 455 and got == want


@pytest.mark.parametrize("n", range(1, 17))
def test_masks_hit_every_allowed_pattern(n):
    masks = next(m for least, most, m in d8.FAMILIES if least <= n <= (most or 16))
    places = [{at + o for o in m} for m in masks for at in range(n - m[-1])]
    assert all(any(not p & set(lost) for p in places) for lost in itertools.combinations(range(n), n - d8.needed(n)))


def test_a_seed_that_recurs_in_a_long_text(spark):
    """Every position of a text hits every position of an item: the hits are verified row by row, none is gathered."""
    got, want = found_and_brute(spark, [(1, "same " * 3000), (2, "same " * 15)], [(1, "same " * 40), (2, "same " * 16), (3, "same")])
    assert got == want and got[1, 1] == (16, 16, 0) and (2, 2) not in got


def test_shuffled_seeds_give_the_same(spark, monkeypatch):
    documents = frame(spark, [(i, " ".join(f"w{(i * 7 + k) % 50}" for k in range(40))) for i in range(30)], "doc_id")
    items = frame(spark, [(k, " ".join(f"w{(k + j) % 50}" for j in range(18))) for k in range(0, 50, 5)], "item_id")
    broadcast = sorted(map(tuple, d8.overlaps(documents, items).collect()))
    monkeypatch.setattr(d8, "BROADCAST_SEEDS", 0)
    assert sorted(map(tuple, d8.overlaps(documents, items).collect())) == broadcast != []


def test_awkward_documents(spark):
    d = docs(spark)
    items = frame(spark, [(1, "the cat sat on the mat near the door and looked at the bird outside"), (2, None), (3, ""), (1, "der hund lief über die straße"), (None, "a text without an identifier")], "item_id")
    got = sorted(((r.doc_id, r.item_id) for r in d8.overlaps(d, items).collect()), key=repr)
    assert got == sorted([(1, 1), (7, 1), (None, None)], key=repr)
    kept = d8.keep_clean(d, items)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 5, 6]
    other = spark.createDataFrame([(1, "der hund lief über die straße"), (1, "nothing of that kind"), (None, "nothing either")], "doc_id bigint, text string")
    assert sorted(r.text for r in d8.keep_clean(other, items).collect()) == ["nothing either", "nothing of that kind"]
    assert d8.keep_clean(empty(spark), items).count() == 0
    assert d8.overlaps(empty(spark), items).count() == 0 and d8.overlaps(d, frame(spark, [], "item_id")).count() == 0


def test_no_python_on_the_main_path(spark):
    def names(df):
        return df._jdf.queryExecution().executedPlan().toString()

    assert not re.search("Python|Pandas|Arrow", names(d8.overlaps(docs(spark), frame(spark, [(1, "a b c d e f g h i j k l m")], "item_id"))))
    calls, results = t6.of_conversations(messages(spark, CONVERSATION))
    assert not re.search("Python|Pandas|Arrow", names(t6.link(calls, results, t6.SCHEMAS)))


LONG = "a question of at least forty characters, yes"
CONVERSATION = [(1, 0, "system", "be kind"), (1, 1, "user", LONG), (1, 2, "assistant", 'an "answer"\n'), (1, 3, "user", "short"), (1, 4, "assistant", None), (1, 4, "assistant", "again"), (2, 5, "assistant", "orphan"), (3, 2, "user", None), (None, 1, "user", LONG), (4, None, "user", LONG)]


def messages(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 AS level", "'x' AS call_id", "'y' AS name")


def test_conversations(spark):
    calls, results = t6.of_conversations(messages(spark, CONVERSATION))
    got = {r.call_id: r for r in t6.link(calls, results, t6.SCHEMAS).collect()}
    assert set(got) == {"1:1", "1:3", "2:4", "3:2"}
    a = got["1:1"]
    assert (a.status, a.name, a.position, a.n_results, a.result_turn, a.errors) == ("linked", "ask", 0, 1, 2, "")
    assert a.exchange == json.dumps({"arguments": {"text": LONG, "turn": 1}, "id": "1:1", "name": "ask", "result": 'an "answer"\n'}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    b = got["1:3"]
    assert (b.status, b.position, b.n_results, b.errors) == ("linked", 1, 2, "text: too short") and '"after":"1:1"' in b.exchange
    assert got["2:4"].status == "orphan" and got["3:2"].status == "unanswered" and got["3:2"].errors == "text: missing"
    e = messages(spark, [])
    assert t6.link(*t6.of_conversations(e), t6.SCHEMAS).count() == 0


CALLS = "conv_id bigint, turn bigint, call_id string, name string, arguments string, after array<string>"


def test_topological_order(spark):
    rows = [(1, 0, "a", "ask", "{}", ["c"]), (1, 1, "b", "ask", "{}", ["a"]), (1, 2, "c", "ask", "{}", ["gone"]), (2, 0, "a", "ask", "{}", ["b"]), (2, 1, "b", "ask", "{}", ["a"]), (2, 2, "d", "ask", "{}", []), (3, 300, "x", "ask", "{}", None), (3, 9, "y", "ask", "{}", []), (5, 0, None, "ask", "{}", ["q"])]
    got = {(r.conv_id, r.call_id): r.position for r in t6.topological(spark.createDataFrame(rows, CALLS)).collect()}
    assert got == {(1, "c"): 0, (1, "a"): 1, (1, "b"): 2, (2, "a"): None, (2, "b"): None, (2, "d"): 0, (3, "y"): 0, (3, "x"): 1, (5, None): 0}
    backwards = t6.topological(spark.createDataFrame([(1, i, f"k{i}", "ask", "{}", [f"k{i + 1}"]) for i in range(7)], CALLS))
    assert {r.turn: r.position for r in backwards.collect()} == {i: 6 - i for i in range(7)}


def test_long_conversations_are_counted_in_parts(spark):
    rows = [(7, i, f"k{i}", "ask", "{}", [f"k{i - 1}"]) for i in range(1000)]
    got = t6.topological(spark.createDataFrame(rows, CALLS)).collect()
    assert all(r.position == r.turn for r in got) and len(got) == 1000


SCHEMA = {"f": {"properties": {"n": {"type": "integer"}, "s": {"type": "string", "maxLength": 3}, "x": {"type": "number"}, "o": {"type": "object"}, "l": {"type": "array"}, "b": {"type": "boolean"}, "d.t": {"type": "string", "pattern": "^a"}, "e": {"enum": ["x", 2, None]}, "r": {"type": "number", "minimum": 0, "maximum": 9}}, "required": ["n"], "additionalProperties": False}}


@pytest.mark.parametrize(("arguments", "errors"), [
    ('{"n": 1}', ""), ('{"n": "1"}', "n: not integer"), ('{"s": "abcd"}', "n: missing; s: too long"), ('{"n": 1, "z": 0, "a": 1}', "a,z: not allowed"), ("[1]", "arguments: not an object"),
    ("nonsense", "arguments: not an object"), (None, "arguments: not an object"), ('{"n": 2, "x": 1.5, "o": {}, "l": [], "b": true}', ""), ('{"n": null}', "n: not integer"), ('{"n": 1, "b": "true"}', "b: not boolean"),
    ('{"n": 12345678901234567890123, "d.t": "ab", "e": 2, "r": 9}', ""), ('{"n": 1.5}', "n: not integer"), ('{"n": 1.0, "d.t": "ba"}', "d.t: not of the pattern"), ('{"n": 1, "e": "2"}', "e: not one of those allowed"), ('{"n": 1, "e": null, "r": 9.5}', "r: too large"),
    ('{"n": 1, "r": -1, "d.t": 3}', "d.t: not string; r: too small"), ('{"n": 1, "n": 1}', "arguments: not an object"),
])
def test_schemas(spark, arguments, errors):
    rows = spark.createDataFrame([(1, 1, "a", "f", arguments, [])], CALLS)
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, call_id string, content string")
    assert t6.link(rows, none, SCHEMA).first().errors == errors
    assert t6.link(rows.withColumn("name", rows.call_id), none, SCHEMA).first().errors == "unknown tool"


def test_canonical_json(spark):
    rows = spark.createDataFrame([('{ "b": [1, {"z": 1, "a": "\\u00e9"}], "a": null }',), ("no",)], "j string")
    assert [r[0] for r in rows.select(t6.canonical(rows.j)).collect()] == ['{"a":null,"b":[1,{"a":"é","z":1}]}', None]


def test_long_texts_and_repeated_calls(spark):
    text = "long " * 400_000
    rows = [(1, 1, "user", text), (1, 1, "user", text), (1, 2, "assistant", text)]
    got = t6.link(*t6.of_conversations(messages(spark, rows)), t6.SCHEMAS).collect()
    assert [(r.call_id, r.status, r.n_results, r.errors) for r in got] == [("1:1", "linked", 1, "")] * 2 and sorted(r.position for r in got) == [0, 1]
    assert json.loads(got[0].exchange)["result"] == text
