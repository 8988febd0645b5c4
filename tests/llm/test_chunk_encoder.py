"""The chunk encoder: ids as of whole texts, with few calls of the tokenizer."""

from __future__ import annotations

import random

import public_tokenizers
import pyarrow as pa
import pytest

from haltline.llm import packed_ids

ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a\n b", "a b\n", "Ġ Ġa ĠĠ", "x <|endoftext|> y", "</s> <s>a", "it's 'tis", "é  b", "　 c", "日本 語", "tab\tb c", "é f", "😀 😀g"]


class Counted:
    def __init__(self, tokenizer):
        self.tokenizer, self.strings = tokenizer, 0

    def encode_batch_fast(self, strings, **options):
        self.strings += len(strings)
        return self.tokenizer.encode_batch_fast(strings, **options)


@pytest.mark.parametrize("remembered", [300_000, 50])
@pytest.mark.parametrize("line", [512, 3])
def test_joined_chunks_give_the_ids_of_whole_texts(monkeypatch, line, remembered):
    monkeypatch.setattr(packed_ids, "LINE", line, raising=False)
    monkeypatch.setattr(packed_ids, "REMEMBERED", remembered)
    encoder = packed_ids.ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    whole = encoder.tokenizer
    encoder.tokenizer = Counted(whole)
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdeéß.,'1-", k=rng.randrange(1, 12))) for _ in range(3_000)]
    plain = [" ".join(rng.choices(words, k=400)) for _ in range(20)]
    mixed = ODD + [" ".join(rng.choices(ODD + words[:40], k=30)) for _ in range(60)]
    for texts in (plain, mixed, plain + mixed):
        ids, offsets = encoder.encode(pa.array(texts))
        for n, one in enumerate(whole.encode_batch(texts, add_special_tokens=False)):
            assert ids[offsets[n] : offsets[n + 1]].tolist() == one.ids, texts[n]
        if texts is plain and line == 512:
            assert encoder.tokenizer.strings < 100
