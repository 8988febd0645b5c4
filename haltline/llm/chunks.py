"""Distinct chunks of a block of texts: every chunk once, and where each text uses it.

Texts are cut only where no token can cross, so a tokenizer sees each distinct chunk once a block.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from haltline.llm.blocks import ragged_take

_SPACED = re.compile(r" *[^ ]+| +$")


@dataclass
class ChunkTable:
    """`chunks[codes[offsets[i]:offsets[i + 1]]]` are the chunks of text i, in order."""

    chunks: list[str]
    codes: np.ndarray
    offsets: np.ndarray


def space_chunks(texts: pa.Array) -> ChunkTable:
    """Cut before every run of spaces.

    The first space of a run is left out of every chunk but a text's first, as it only marks the cut:
    "a  b c" gives "a", " b", "c"; a last run of k spaces gives a chunk of k - 1 spaces, and " a" stays
    " a". An empty text has no chunk.
    """
    texts = pa.concat_arrays([texts.cast(pa.string())])
    loose = pc.or_(
        pc.match_substring(texts, "  "),
        pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " ")),
    ).to_numpy(zero_copy_only=False)
    loose |= pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    plain = pc.split_pattern(texts.filter(pa.array(~loose)), " ")
    odd = []
    for text in texts.filter(pa.array(loose)).to_pylist():
        found = _SPACED.findall(text)
        odd.append(found[:1] + [chunk[1:] for chunk in found[1:]])
    lists = pa.concat_arrays([plain, pa.array(odd, pa.list_(pa.string()))])
    encoded = pc.dictionary_encode(lists.flatten())
    codes = encoded.indices.to_numpy(zero_copy_only=False)
    offsets = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(), dtype=np.int64)))
    if odd:  # back into the order of the texts
        rows = np.empty(len(texts), dtype=np.int64)
        rows[np.flatnonzero(~loose)] = np.arange(len(plain))
        rows[np.flatnonzero(loose)] = np.arange(len(plain), len(texts))
        codes, offsets = ragged_take(codes, offsets, rows)
    return ChunkTable(encoded.dictionary.to_pylist(), codes, offsets)


#: White space that is no plain space, or a second space, in front of a space.
_JOINED = r"[\t-\r\x{1c}-\x{1f}\x{85}\p{Z}] "


def spaced_chunks(texts: pa.Array) -> ChunkTable:
    """Cut before every single space, which stays with the chunk behind it: "a b" gives "a", " b".

    For tokenizers that always start a new word at a space between two other characters. A text with a
    space behind other white space stays whole. An empty text has one empty chunk.
    """
    texts = pa.concat_arrays([texts.cast(pa.string())])
    whole = pc.match_substring_regex(texts, _JOINED)
    words = pc.split_pattern(pc.if_else(whole, "", texts), " ")
    offsets = words.offsets.to_numpy().astype(np.int64)
    flat = words.flatten()
    inner = pc.dictionary_encode(flat)
    first = pc.dictionary_encode(pc.if_else(whole, texts, flat.take(words.offsets[:-1])))
    spaced = pc.binary_join_element_wise(" ", inner.dictionary, "")
    codes = inner.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    codes[offsets[:-1]] = first.indices.to_numpy(zero_copy_only=False) + len(spaced)
    return ChunkTable(spaced.to_pylist() + first.dictionary.to_pylist(), codes, offsets)
