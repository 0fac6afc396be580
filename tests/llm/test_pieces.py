"""Encoding against the installed library, decoding as a round trip, and both kinds of model."""

from __future__ import annotations

import random
import struct

import pytest
import sentencepiece

from catalogspark.llm import pieces
from catalogspark.llm.queries import PIECES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def machine():
    with open(PIECES, "rb") as file:
        return pieces.compile_model(file.read())


def test_same_ids_as_the_library(machine, library):
    rng = random.Random(0)
    texts = ["", " ", "  a  b ", "\t\n", "a\x00b", "漢字🙂", "é" * 50, "x" * 3000, "<s> </s> <0x41>", "thethe   the    in" + " " * 40]
    for alphabet in ("abcdeghilnorst \n\té漢🙂ß.,123ABC    ", "the in er  on at ing ion   tion"):
        texts += ["".join(rng.choices(alphabet, k=rng.randrange(90))) for _ in range(1500)]
    for text in texts:
        ids = list(machine.encode(text))
        assert ids == library.encode(text), text
        assert machine.decode(ids) == text == library.decode(ids)


def test_search_agrees_with_merging(machine):
    rng = random.Random(1)
    for _ in range(2000):
        word = pieces.MARK + "".join(rng.choices("etaoinshrdlucmw", k=rng.randrange(1, 25)))
        assert machine._only_path(word) == machine.merge(word)


def test_broken_bytes_decode(machine):
    assert machine.decode([machine.byte_ids[0xFF], machine.byte_ids[0x41]]) == "�A"


def _message(number, kind, value):
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    head = varint(number << 3 | kind)
    return head + (varint(len(value)) + value if kind == 2 else value if kind == 5 else varint(value))


def small_model(vocabulary, kind):
    data = b""
    for name, score, type_ in [("<unk>", 0.0, 2), *vocabulary]:
        data += _message(1, 2, _message(1, 2, name.encode()) + _message(2, 5, struct.pack("<f", score)) + _message(3, 0, type_))
    return data + _message(2, 2, _message(3, 0, kind)) + _message(3, 2, _message(3, 0, 1) + _message(4, 0, 0))


def test_unigram_takes_the_cheapest_path():
    vocabulary = [("▁", -5.0, 1), ("a", -2.0, 1), ("b", -2.5, 1), ("ab", -3.0, 1), ("ba", -3.1, 1), ("▁a", -3.5, 1), ("aba", -4.75, 1)]
    machine = pieces.compile_model(small_model(vocabulary, pieces.UNIGRAM))
    cost = {n: -s for n, s, _ in vocabulary}

    def cheapest(text):
        if not text:
            return 0.0
        return min((cost[text[:k]] + cheapest(text[k:]) for k in range(1, 4) if text[:k] in cost and k <= len(text)), default=9e9)

    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choices("ab", k=rng.randrange(1, 12)))
        names = [machine.names[i] for i in machine.encode(text)]
        assert "".join(names) == "▁" + text
        assert abs(sum(cost[n] for n in names) - cheapest("▁" + text)) < 1e-6
    assert list(machine.encode("aXb")).count(machine.unknown) == 1


@pytest.mark.parametrize("with_bytes", [False, True])
def test_unigram_ids_of_the_library(with_bytes):
    rng = random.Random(11)
    compared = 0
    for _ in range(60):
        names = {"▁"} if rng.random() < 0.8 else set()
        while len(names) < 25:
            name = "".join(rng.choices("abcdxé漢", k=rng.choice([1, 1, 2, 2, 3, 4])))
            names.add("▁" + name if rng.random() < 0.3 else name)
        vocabulary = [(n, -rng.uniform(1, 12), 4 if n[0] != "▁" and rng.random() < 0.08 else 1) for n in sorted(names)]
        vocabulary += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] if with_bytes else []
        data = small_model(vocabulary, pieces.UNIGRAM) + (_message(2, 2, _message(35, 0, 1)) if with_bytes else b"")
        library, machine = sentencepiece.SentencePieceProcessor(model_proto=data), pieces.compile_model(data)
        for _ in range(60):
            text = "".join(rng.choices("abcdxyQé漢🙂 ", k=rng.randrange(0, 30)))
            assert list(machine.encode(text)) == library.encode(text), (text, vocabulary)
            compared += 1
    assert compared == 3600


def test_probed_unigram_texts():
    machine = pieces.compile_model(small_model([("▁", -1.0, 1), ("a", -1.0, 1), ("b", -1.0, 1), ("ab", -9.0, 1), ("xy", -2.0, 1)], pieces.UNIGRAM))
    assert [machine.names[i] for i in machine.encode("axy")] == ["▁", "a", "xy"]
    assert [machine.names[i] for i in machine.encode("aQQb")] == ["▁", "a", "<unk>", "b"]


def test_query(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op4_sentencepiece"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.token_ids == library.encode(texts[r.doc_id]) and r.n_tokens == len(r.token_ids) and r.round_trip


def test_odd_rows(spark):
    rows = [(1, None, "x"), (1, "", "y"), (None, "▁", "z"), (2, "same same", "z"), (2, "same same", "z"), (3, "long " * 50_000, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _ids string")
    got = pieces.with_tokens(docs, PIECES).collect()
    assert [(r.text, r._ids) for r in got] == [(t, x) for _, t, x in rows]
    assert [(r.n_tokens, r.round_trip) for r in got][:3] == [(None, None), (0, True), (1, False)]
    assert got[3].token_ids == got[4].token_ids and got[5].round_trip
    assert pieces.with_tokens(docs.limit(0), PIECES).count() == 0
