"""Byte-level BPE encoding and decoding with a segment tree per piece.

A text is cut by the tokenizer's pattern; inside each piece, a segment tree
over the byte positions stores the leftmost minimum pair rank. A merge reads
the root, joins the pair, and makes three logarithmic point updates: the
merged position, its live left neighbour and the removed right one. Short
pieces run many trees side by side as rows of one array; longer pieces run
one tree each, so a piece of n bytes costs n log n.

Defined results: a null text is empty and has no ids; decoding a null gives
empty bytes; repeated rows and equal texts give equal rows; an empty table
gives no rows. Texts are never cut.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from respondo.llm.common import RecentCache, gather, slices, text_array

#: Pieces of at most this many bytes share one array of trees.
SIDE_BY_SIDE = 64
NONE = np.int64(1) << 60


class Vocabulary:
    """Ranks, and the rank that each mergeable pair of tokens gets."""

    def __init__(self, rank_file: bytes):
        self.ranks = {base64.b64decode(a): int(b)
                      for a, b in (line.split() for line in rank_file.splitlines() if line)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = rank
        self.pairs = pairs
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or NONE; a negative token is no token."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        known = (self.pair_keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(known, self.pair_ranks[at], NONE)


def merge_rows(pieces: list[bytes], width: int, v: Vocabulary) -> list[bytes]:
    """Trees side by side: row i of each array belongs to piece i. Positions
    run from 1 to ``width``; 0 and ``width + 1`` stand beyond the ends."""
    n = len(pieces)
    raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8)
    size = np.fromiter(map(len, pieces), np.int64, n)
    token = np.full((n, width + 2), -1, np.int64)
    token[:, 1:-1] = v.bytes[raw.reshape(n, width)]
    token[:, 1:-1][np.arange(width) >= size[:, None]] = -1
    after = np.tile(np.arange(1, width + 3), (n, 1))
    before = np.tile(np.arange(-1, width + 1), (n, 1))
    tree = np.full((n, 2 * width), NONE << 1, np.int64)

    def keys(rank: np.ndarray, position: np.ndarray) -> np.ndarray:
        # smallest rank first, then the leftmost position
        return np.where(rank < NONE, rank << 7 | position, NONE << 1)

    tree[:, width:] = keys(v.pair_rank(token[:, 1:-1], token[:, 2:]), np.arange(1, width + 1))
    level = width // 2
    while level:
        tree[:, level:2 * level] = np.minimum(tree[:, 2 * level:4 * level:2],
                                              tree[:, 2 * level + 1:4 * level:2])
        level //= 2
    rows = np.flatnonzero(tree[:, 1] < NONE << 1)
    while len(rows):
        root = tree[rows, 1]
        at = root & 127
        gone = after[rows, at]
        left, right = before[rows, at], after[rows, gone]
        token[rows, at] = root >> 7  # a merged pair's token is its rank
        token[rows, gone] = -1
        after[rows, at] = right
        before[rows, np.minimum(right, width + 1)] = at
        merged = token[rows, at]
        r3 = np.concatenate([rows, rows, rows])
        p3 = np.concatenate([at, gone, np.maximum(left, 1)])
        ranks = v.pair_rank(
            np.concatenate([merged, token[rows, np.maximum(left, 0)]]),
            np.concatenate([token[rows, np.minimum(right, width + 1)], merged]))
        k = len(rows)
        new = np.concatenate([keys(ranks[:k], at), np.full(k, NONE << 1),
                              np.where(left >= 1, keys(ranks[k:], left), 0)])
        # where nothing stands on the left, position 1 is the merged one itself
        new[2 * k:] = np.where(left >= 1, new[2 * k:], new[:k])
        node = p3 - 1 + width
        tree[r3, node] = new
        node = node >> 1
        while node[0]:
            tree[r3, node] = np.minimum(tree[r3, 2 * node], tree[r3, 2 * node + 1])
            node = node >> 1
        rows = rows[tree[rows, 1] < NONE << 1]
    live = token[:, 1:-1] >= 0
    flat = token[:, 1:-1][live].astype("<u4").tobytes()
    ends = np.cumsum(live.sum(axis=1)) * 4
    return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


def merge_one(piece: bytes, v: Vocabulary) -> bytes:
    """One tree for a long piece."""
    n, none = len(piece), 1 << 62
    width = 1 << max(0, (n - 1).bit_length())
    shift = width.bit_length()
    token = v.bytes[np.frombuffer(piece, np.uint8)].tolist()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    pairs = v.pairs

    def key(i: int) -> int:
        j = after[i]
        rank = pairs.get(token[i] << 20 | token[j]) if j < n else None
        return none if rank is None else rank << shift | i

    tree = [none] * width + [key(i) for i in range(n)] + [none] * (width - n)
    for node in range(width - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])

    def put(i: int, value: int) -> None:
        node = i + width
        tree[node] = value
        node >>= 1
        while node:
            a, b = tree[2 * node], tree[2 * node + 1]
            tree[node] = a if a < b else b
            node >>= 1

    while tree[1] < none and n > 1:
        i = tree[1] & ((1 << shift) - 1)
        gone = after[i]
        token[i] = tree[1] >> shift
        after[i] = after[gone]
        if after[gone] < n:
            before[after[gone]] = i
        token[gone] = -1
        put(gone, none)
        put(i, key(i))
        if before[i] >= 0:
            put(before[i], key(before[i]))
    return np.array([t for t in token if t >= 0], "<u4").tobytes()


def encode_pieces(pieces: list[bytes], v: Vocabulary) -> list[bytes]:
    """Ids of each piece as little-endian unsigned 32-bit integers."""
    out: list = [None] * len(pieces)
    groups: dict[int, list[int]] = {}
    for i, p in enumerate(pieces):
        rank = v.ranks.get(p)
        if rank is not None:  # a piece that is a token needs no merges
            out[i] = rank.to_bytes(4, "little")
        elif len(p) > SIDE_BY_SIDE:
            out[i] = merge_one(p, v)
        else:
            groups.setdefault(1 << max(1, (len(p) - 1).bit_length()), []).append(i)
    for width, members in groups.items():
        step = (1 << 18) // width
        for k in range(0, len(members), step):
            part = members[k:k + step]
            for i, ids in zip(part, merge_rows([pieces[i] for i in part], width, v)):
                out[i] = ids
    return out


def prepared(state: dict, pattern: str) -> tuple[Vocabulary, RecentCache, object]:
    if "vocabulary" not in state:
        state["cache"] = RecentCache()
        state["split"] = regex.compile(pattern).findall
        state["vocabulary"] = Vocabulary(state["file"])
    return state["vocabulary"], state["cache"], state["split"]


def encode_texts(texts: list[str], state: dict, pattern: str) -> list[bytes]:
    """Ids of each text; every distinct piece is merged once."""
    v, cache, split = prepared(state, pattern)
    pieces: list[str] = []
    ends = [0]
    for t in texts:
        pieces += split(t)
        ends.append(len(pieces))
    coded = pa.array(pieces, pa.string()).dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    ids = [cache.get(p) for p in distinct]
    missing = [i for i, x in enumerate(ids) if x is None]
    for i, x in zip(missing, encode_pieces([distinct[i].encode() for i in missing], v)):
        ids[i] = x
        cache.put(distinct[i], x)
    lens = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    flat = np.frombuffer(b"".join(ids), "<u4")
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(lens) - lens
    whole = flat[gather(starts[codes], lens[codes])].tobytes()
    at = (np.concatenate([[0], np.cumsum(lens[codes])])[ends] * 4).tolist()
    return [whole[a:b] for a, b in zip(at, at[1:])]


def encode(docs: DataFrame, vocabulary: Broadcast, pattern: str, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of every whole text as packed little-endian
    unsigned 32-bit integers."""
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text"):
                ids = encode_texts(text_array(rows.column("text")).to_pylist(),
                                   vocabulary.value, pattern)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(ids, pa.binary())],
                                                 ["doc_id", "ids"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(kernel, "doc_id long, ids binary"))


def decode(encoded: DataFrame, vocabulary: Broadcast, pattern: str) -> DataFrame:
    """Add ``decoded``, the bytes of the tokens in ``ids``."""
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token = prepared(vocabulary.value, pattern)[0].tokens.__getitem__
            for rows in slices(batch, "ids"):
                ids = rows.column("ids").to_pylist()
                out = [b"".join(map(token, np.frombuffer(x or b"", "<u4").tolist())) for x in ids]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(out, pa.binary())],
                                                 [*rows.schema.names, "decoded"])

    return (encoded.select("doc_id", "ids")
            .mapInArrow(kernel, "doc_id long, ids binary, decoded binary"))


def n_tokens(packed):
    """Number of ids in a packed column."""
    return (F.octet_length(packed) / 4).cast("long")
