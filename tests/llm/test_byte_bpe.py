import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from helpers import docs, empty
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import byte_bpe
from palimpsest.llm.textops import joined_codepoints

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
with open(PATH, "rb") as f:
    VOCABULARY = byte_bpe.Vocabulary.parse(f.read())
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=VOCABULARY.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet="a'sltvermd 1.\n\té! S ", max_size=40)), max_size=4))
def test_same_as_the_library(texts):
    ids, bounds, offsets = VOCABULARY.encode(texts)
    for i, t in enumerate(texts):
        own = ids[bounds[i] : bounds[i + 1]]
        assert own.tolist() == REFERENCE.encode_ordinary(t)
        assert VOCABULARY.decode(own) == t.encode()
        assert [len(VOCABULARY.decode(own[:k])) for k in range(len(own))] == offsets[bounds[i] : bounds[i + 1]].tolist()


def test_every_code_point():
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for start in range(0, len(points), 200_000):
        text = "".join(f"a{chr(c)}1{chr(c)} {chr(c)}'s" for c in points[start : start + 200_000])
        assert VOCABULARY.encode([text])[0].tolist() == REFERENCE.encode_ordinary(text)


def test_scan_is_the_sequential_fold():
    r = random.Random(1)
    of_symbol, table, _ = byte_bpe.monoid()
    elements = of_symbol[[r.randrange(8) for _ in range(3000)]]
    acc, want = 0, []
    for x in elements:
        acc = table[acc, x]
        want.append(acc)
    for width in (2, 7, 256, 5000):
        assert byte_bpe.scan(elements, width).tolist() == want


@pytest.mark.parametrize("piece", ["x" * 20_000, "ab" * 5000, "é" * 3000])
def test_long_pieces(piece):
    assert VOCABULARY.encode([piece])[0].tolist() == REFERENCE.encode_ordinary(piece)


def test_no_texts():
    assert len(byte_bpe.boundaries(*joined_codepoints([])[1:])) == 0


def test_spark_round_trip(spark):
    d = docs(spark)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.digests(d, PATH).collect())
    want = []
    for r in d.collect():
        ids = REFERENCE.encode_ordinary(r.text or "")
        want.append((r.doc_id is None, r.doc_id or 0, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert byte_bpe.digests(empty(spark), PATH).count() == 0


def test_small_vocabulary_file(tmp_path, spark):
    path = tmp_path / "r"
    path.write_bytes(b"".join(base64.b64encode(bytes([i])) + b" %d\n" % i for i in range(256)) + base64.b64encode(b"th") + b" 256\n")
    assert byte_bpe.encode(spark.createDataFrame([(1, "this")], "doc_id bigint, text string"), str(path)).first().ids == [256, ord("i"), ord("s")]
