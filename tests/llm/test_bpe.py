import random
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from penumbra.llm import bpe

RANKS = Path(bpe.TOKENIZERS) / "byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not RANKS.exists(), reason="no vocabulary")
HARD = ["", " ", "a", "a" * 3000, "\n\n  \t x", "don't we'll", "naïve café Ünïcödé", "日本語のテキスト", "👩‍🌾🏽 emoji", "x" * 17 + "é" * 40, "<|endoftext|>", "\x00﻿​", "0123456789" * 30, "ACGT" * 500, " " * 500 + "end", "zzzzqqqqxxxx" * 40]


@pytest.fixture(scope="module")
def enc():
    return bpe.encoder(RANKS.read_bytes())


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(RANKS.with_suffix(".json")))
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


@pytest.mark.parametrize("text", HARD)
def test_hard_texts(enc, reference, text):
    assert enc.encode(text) == reference(text)
    assert b"".join(enc.v.bytes[i] for i in enc.encode(text)) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(RANKS.with_suffix(".json")))
    t.encode_special_tokens = True
    assert bpe.encoder(RANKS.read_bytes()).encode(text) == t.encode(text, add_special_tokens=False).ids


def test_prefix_table_is_the_definition(enc):
    r = random.Random(2)
    for _ in range(60):
        data = bytes(r.choice(b"etaoinshr lumpgabc") for _ in range(r.randint(1, 40)))
        assert bpe.PrefixTable(enc.v, data).ids() == enc.v.merged(data)


def test_append_and_replace_are_exact(enc):
    r = random.Random(5)
    data = bytes(r.choice(b"theandofxyz") for _ in range(2000))
    t = bpe.PrefixTable(enc.v, data[:700])
    t.append(data[700:])
    assert t.ids() == bpe.PrefixTable(enc.v, data).ids()
    for _ in range(20):
        a = r.randint(0, len(data))
        b = min(len(data), a + r.randint(0, 8))
        new = bytes(r.choice(b"theandofxyz") for _ in range(r.randint(0, 8)))
        data = data[:a] + new + data[b:]
        t.replace(a, b, new)
        assert t.data == data and t.ids() == bpe.PrefixTable(enc.v, data).ids()
    assert t.replace(10, 11, b"q") < 600  # near the edit only


def test_table(spark, reference):
    rows = [(1, None, "x"), (2, "", "x"), (3, "some text", None), (3, "some text", None), (None, "null key", ""), (5, "word " * 40_000, "")]
    got = bpe.encode(spark.createDataFrame(rows, "doc_id bigint, text string, ids string"), "doc_id", "text").collect()
    want = sorted((str(k), reference(t) if t else []) for k, t, _ in rows)
    assert sorted((str(r["doc_id"]), list(r["ids"])) for r in got) == want
    assert bpe.encode(spark.createDataFrame([], "doc_id bigint, text string"), "doc_id", "text").count() == 0
