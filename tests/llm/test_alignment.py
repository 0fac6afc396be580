"""Alignment of two tokenizers against plain Python, and edge cases."""

from __future__ import annotations

import base64
import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

from catalogspark.llm import alignment
from catalogspark.llm.queries import BYTE_PAIRS, PIECES, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def libraries():
    a = Tokenizer.from_file(BYTE_PAIRS)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECES)


def byte_tokens():
    """Bytes by id, from the other form in which the vocabulary is published."""
    lines = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb")
    return {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}


def spans(lengths):
    out, at = [], 0
    for n in lengths:
        out.append((at, at + n))
        at += n
    return out


def brute(rows):
    """Every pair of tokens of a text is tested for overlap."""
    a, b = libraries()
    a_bytes, found, counts = byte_tokens(), [], Counter()
    for doc_id, text in rows:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        names = [b.id_to_piece(i) for i in ids_b]
        of_b = [bytes([int(n[3:5], 16)]) if b.is_byte(i) else n.replace("▁", " ").encode() for i, n in zip(ids_b, names)]
        whole = b" " + (text or "").encode()
        if b"".join(a_bytes[i] for i in ids_a) != whole or b"".join(of_b) != whole:
            ids_a, ids_b, of_b = [], [], []
        sa, sb = spans([len(a_bytes[i]) for i in ids_a]), spans(map(len, of_b))
        links = [(ids_a[i], ids_b[j]) for i, (s, e) in enumerate(sa) for j, (u, v) in enumerate(sb) if s < v and u < e]
        cuts = sorted({e for _, e in sa} & {e for _, e in sb})
        groups, before = [], 0
        for cut in cuts:
            side = lambda ids, sp: ",".join(str(i) for i, (s, e) in zip(ids, sp) if before <= s and e <= cut)  # noqa: E731, B023
            groups.append(side(ids_a, sa) + "|" + side(ids_b, sb))
            before = cut
        counts.update(links)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if ids_a else ""
        found.append((doc_id, len(ids_a), len(ids_b), len(groups), links, digest))
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return sorted(
        (
            (i, na, nb, g, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), d)
            for i, na, nb, g, links, d in found
        ),
        key=repr,
    )


EDGES = [None, "", " ", "  \n\t x", "a", "<|endoftext|> <s></s>", "a▁b", "<0x41> <0x0A>", "naïve ‘quoted’ – 日本語 текст 😀‍", "\x00\x01\u0085\xa0  x", "x" * 300, "word " * 400]


@pytest.mark.parametrize("chunk", [alignment.CHUNK, 50])
def test_against_every_pair_of_tokens(spark, chunk):
    rng = random.Random(5)
    words = ["the", "Alignment", "don't", "naïveté", "x1y2", "1234567", "\n\n", "  ", "über", "—", "Ω", "tokenizers", "ﬁ"]
    texts = EDGES + [" ".join(rng.choices(words, k=rng.randrange(1, 60))) for _ in range(30)]
    ids = [*range(len(texts) - 3), 7, 7, None]
    docs = spark.createDataFrame([(i, t, 5, "q") for i, t in zip(ids, texts)], "doc_id long, text string, chunk int, pairs string").repartition(3)
    got = alignment.align(docs, BYTE_PAIRS, PIECES, chunk=chunk)
    assert got.columns == COLUMNS
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(list(zip(ids, texts)))
    assert alignment.align(docs.limit(0), BYTE_PAIRS, PIECES).count() == 0
    assert {tuple(r)[1:] for r in alignment.align(docs.where("text = ''"), BYTE_PAIRS, PIECES).collect()} == {(0, 0, 0, 0, 0, 0, "")}


def test_both_libraries_encode_alike():
    rng, texts = random.Random(2), list(EDGES[1:])
    for top in (0x80, 0x250, 0x2030, 0x10000):
        texts += ["".join(chr(c) for c in rng.choices([c for c in range(top) if not 0xD800 <= c < 0xE000], k=80)) for _ in range(100)]
    texts += ["".join(rng.choices(" \n\t'sdltre\x0b\u0085\xa0—A1é", k=60)) for _ in range(200)]
    own = alignment.ByteTokenizer(open(BYTE_PAIRS, encoding="utf-8").read())
    assert isinstance(own.ranks, tiktoken.Encoding)
    library = libraries()[0]
    assert [ids.tolist() for ids in own.encode(texts)] == [library.encode(" " + t, add_special_tokens=False).ids for t in texts]


def test_query_against_plain_python(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 3000").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in alignment.align(docs, BYTE_PAIRS, PIECES).collect()), key=repr) == brute(rows)
    whole = QUERIES["op12_cross_tokenizer_alignment"](spark, SF).collect()
    library = libraries()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(whole) == len(texts)
    for r in whole:
        assert r.n_b == len(library[1].encode(texts[r.doc_id])) and r.n_links == r.n_a + r.n_b - r.n_groups
    assert any(r.n_a > 2000 for r in whole)
