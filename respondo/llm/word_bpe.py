"""Token ids of whole texts by a word-level tokenizer file.

The tokenizer works on each word alone (its pre-tokenizer never crosses
white space, and lower-casing and NFC act inside words), so the ids of a
text are the ids of its words in order. Every distinct word of a slice is
encoded once.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from respondo.llm.common import RecentCache, gather, word_codes


def tokenizer(state: dict):
    """The tokenizer and word cache, built once per worker process."""
    if "tokenizer" not in state:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        tok = Tokenizer.from_str(state["file"].decode())
        tok.encode_special_tokens = True  # such strings in a text are ordinary text
        ids = {c: tok.encode(c, add_special_tokens=False).ids for c in "\u00a7\u00b6~^"}
        state["mark"] = next((c, x[0]) for c, x in ids.items() if len(x) == 1)
        state["cache"] = RecentCache(300_000)
        state["tokenizer"] = tok
    return state["tokenizer"], state["cache"]


def encode_words(words: list[str], state: dict) -> list[bytes]:
    """Packed ids of each word. Words are encoded many at a time, with a
    mark between them that is one id of its own; if a word holds that id
    too, the block is encoded word by word."""
    tok = state["tokenizer"]
    mark, mark_id = state["mark"]
    ids = np.array(tok.encode_batch_fast([f" {mark} ".join([*words, ""])],
                                         add_special_tokens=False)[0].ids, "<u4")
    ends = np.flatnonzero(ids == mark_id)
    if len(ends) != len(words):
        return [np.array(e.ids, "<u4").tobytes()
                for e in tok.encode_batch_fast(words, add_special_tokens=False)]
    flat, ends = ids.tobytes(), (ends * 4).tolist()
    return [flat[a:b] for a, b in zip([0, *(e + 4 for e in ends)], ends)]


def word_ids(words: list[str], state: dict) -> list[bytes]:
    """Ids of each word as little-endian unsigned 32-bit integers."""
    cache = tokenizer(state)[1]
    out = list(map(cache.new.get, words))
    missing = []
    for i in [i for i, x in enumerate(out) if x is None]:
        out[i] = cache.get(words[i])  # may be in the older generation
        if out[i] is None:
            missing.append(i)
    for k in range(0, len(missing), 1000):
        part = missing[k:k + 1000]
        for i, ids in zip(part, encode_words([words[i] for i in part], state)):
            out[i] = ids
            cache.put(words[i], ids)
    return out


def token_counts(texts: pa.Array, state: dict) -> np.ndarray:
    """Number of ids of each text."""
    codes, first, words = word_codes(texts)
    lens = np.fromiter(map(len, word_ids(words.to_pylist(), state)), np.int64, len(words)) // 4
    total = np.concatenate([[0], np.cumsum(lens[codes])])
    return total[first[1:]] - total[first[:-1]]


def token_ids(texts: pa.Array, state: dict) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and where each text begins (one
    more at the end)."""
    codes, first, words = word_codes(texts)
    ids = word_ids(words.to_pylist(), state)
    lens = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    flat = np.frombuffer(b"".join(ids), "<u4")
    starts = np.cumsum(lens) - lens
    total = np.concatenate([[0], np.cumsum(lens[codes])])
    return flat[gather(starts[codes], lens[codes])], total[first]
