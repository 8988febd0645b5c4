from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from haltline.llm.packed_ids import (
    pack,
    packed_digests,
    read_packed_ids,
    unpack_range,
    write_packed_ids,
)
from haltline.llm.piece_tokens import encode_pieces, piece_digests
from haltline.llm.rank_counts import token_counts
from tests.llm.conftest import prose

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "  ", " a", "a ", "a  b", "\n", "a\n b", "a \nb", "▁", "a▁b ▁", "<s> </s> <unk> <0x0A>",
    "<|endoftext|> a<|endoftext|>", "😀 é\x00x", "日本 語　x", "x" * 3000, " " * 70 + "b", "the" * 300, "'s 've",
]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    mixed = ["".join(rng.choice("aeinth  .\n\t/1é日") for _ in range(rng.randint(1, 400))) for _ in range(60)]
    texts = [*ODD, *mixed, prose(1, 30_000), "same text", "same text"]
    return [*enumerate(texts), (None, "no id"), (3, "  ")]


def _text(value):
    return value or ""


def test_ids_and_decoded_texts_equal_the_library(spark, documents, rows):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = sorted(
        (repr(i), tuple(model.encode(_text(t))), model.decode(model.encode(_text(t)))) for i, t in rows
    )
    got = encode_pieces(documents(rows), PIECES).collect()
    assert sorted((repr(r.doc_id), tuple(r.ids), r.decoded) for r in got) == want


def test_digests_and_counts_equal_the_library(spark, documents, rows):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = documents(rows)
    want_digest, want_count = [], []
    for i, text in rows:
        ids = model.encode(_text(text))
        listed = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        decoded = hashlib.sha256(model.decode(ids).encode()).hexdigest()
        want_digest.append((repr(i), len(ids), listed, decoded))
        want_count.append((repr(i), len(_text(text).encode()), len(ids), len(ids) > 4096))
    got = [(repr(r[0]), *r[1:]) for r in piece_digests(docs, PIECES).collect()]
    assert sorted(got) == sorted(want_digest)
    got = [(repr(r[0]), *r[1:]) for r in token_counts(docs, PIECES).collect()]
    assert sorted(got) == sorted(want_count)


def test_packed_ids_come_back_from_their_files(spark, documents, rows, tmp_path):
    tokenizer = Tokenizer.from_file(BYTES)
    write_packed_ids(documents(rows), BYTES, f"{tmp_path}/ids")
    got = packed_digests(read_packed_ids(spark, f"{tmp_path}/ids")).orderBy("start").collect()
    first = lambda i: (i is not None, i or 0)
    assert [first(r.doc_id) for r in got] == sorted(first(i) for i, _ in rows)
    start = 0
    for row in got:
        assert row.start == start
        start += row.n_tokens
    want = []
    for i, text in rows:
        ids = [*tokenizer.encode(_text(text), add_special_tokens=False).ids, 2]
        want.append((repr(i), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted((repr(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted(want)


@pytest.mark.parametrize("bits", [1, 5, 16, 17, 31])
def test_any_range_of_a_block_is_unpacked(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1003).astype(np.uint32)
    payload = pack(ids, bits)
    assert len(payload) == -(-1003 * bits // 8)
    for start, stop in ((0, 1003), (7, 8), (500, 500), (333, 999)):
        assert (unpack_range(payload, bits, start, stop) == ids[start:stop]).all()


def test_empty_tables(spark, documents, tmp_path):
    none = documents([]).limit(0)
    assert encode_pieces(none, PIECES).count() == piece_digests(none, PIECES).count() == 0
    assert token_counts(none, PIECES).count() == 0
    write_packed_ids(none, BYTES, f"{tmp_path}/none")
    assert packed_digests(read_packed_ids(spark, f"{tmp_path}/none")).count() == 0
