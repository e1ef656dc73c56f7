"""Token ids of the byte-level vocabulary for a batch of texts.

Each distinct pre-token is encoded once per worker by the tokenizers library and remembered;
the ids of a text are those of its pre-tokens in order.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

from tidemark.llm.common import string_buffer
from tidemark.llm.pretokens import UNSAFE, SeenWords, Text, byte_level, gather, word_ids


@functools.cache
def tokenizer(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


_seen: dict[str, SeenWords] = {}


def encode(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a column of texts without nulls (uint32), and how many each text has."""
    offsets, data = string_buffer(texts)
    library = tokenizer(path)

    def by_library(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        coded = library.encode([w.decode() for w in words], is_pretokenized=True, add_special_tokens=False)
        lengths = np.bincount(np.array(coded.word_ids, np.int64), minlength=len(words))
        return lengths, np.array(coded.ids, np.uint32)

    text = Text(offsets, data)
    rest = text.unsafe_rows(text.kind == UNSAFE)
    if len(data) == 0:
        return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
    if len(rest):  # their characters are not split here
        text.kind = np.where(text.kind == UNSAFE, 3, text.kind).astype(np.uint8)
    begin = byte_level(text)
    starts = text.place[begin]
    ends = np.append(starts[1:], len(data))
    seen, number = word_ids(_seen.setdefault(path, SeenWords()), data, starts, ends, by_library)
    ids, lengths = gather(seen, number)
    total = np.concatenate([[0], np.cumsum(lengths)])
    bounds = total[np.searchsorted(starts, offsets)]
    counts = np.diff(bounds)
    if not len(rest):
        return ids, counts
    parts, done = [], 0
    for row in rest.tolist():
        whole = library.encode(texts[row].as_py(), add_special_tokens=False).ids
        parts += [ids[done : bounds[row]], np.array(whole, np.uint32)]
        done, counts[row] = bounds[row + 1], len(whole)
    return np.concatenate([*parts, ids[done:]]), counts
