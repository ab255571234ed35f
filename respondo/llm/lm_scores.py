"""Language-model scores from a log-frequency Bloom filter.

The model is a two-word (bigram) model over lower-cased words with one end
per text. Word counts are exact. The filter holds what is known of pairs:
an entry (pair, 1), ..., (pair, q) says that the pair's count, on a scale
whose steps grow by ``BASE``, has reached q; for a first word it holds in
the same way how many different pairs it begins and how often they occur.
Membership probes until the first miss give a count back. A token's
probability after h is

    (count(h, w) + (pairs(h) + rest(h)) * p(w)) / (count(h) + pairs(h)),

where rest(h) is what count(h) leaves beside the stored pairs, and
p(w) = (count(w) + 1) / (tokens + words + 1).

Every pair of the training texts is kept, however rare. The filter is cut
into hash ranges, as many as the text bytes ask for, so that a range's part
has a bounded size. Each slice of texts sends its distinct pairs to their
ranges; there a part is built, probed, and the steps go back to the slices,
where they are summed per document. A pair moves once per slice it is in.

What is broadcast has a proven bound at every corpus size: words with at
least the share ``WORD_SHARE`` of all tokens (at most 1 / WORD_SHARE), with
what they begin. Rarer words are joined, with their exact counts.

Defined results: a null or empty text is one end; a null id is hashed as an
empty text; repeated rows are scored (and learnt from) each time; without
training texts every token has probability 1 / 1; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from respondo.llm.common import SLICE_BYTES, numbered, slices, stage, sums, text_array, word_codes

WORD_SHARE, PAIR_SHARE = 2e-7, 0.0  # every pair is kept
RANGE_BYTES = 4 << 20  # text bytes whose pairs share one hash range of the filter
BASE, HASHES, BITS_PER_ENTRY = 1.5, 4, 12
END, BEGIN = np.int64(1), np.int64(2)  # keys of the ends; words have hashed keys
PAIR, PAIRS, OCCUR = 0, 1, 2           # what an entry counts


def mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One key for a pair of keys."""
    return mix(mix(a.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + b.view(np.uint64)).view(np.int64)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all tokens (each text's words, then its end), where each
    text begins, and the key of each code."""
    codes, first, words = word_codes(pc.ascii_lower(texts))
    keys = np.fromiter(map(xxhash.xxh64_intdigest, pc.cast(words, pa.large_binary()).to_pylist()),
                       np.uint64, len(words)).view(np.int64)
    codes = np.insert(codes, first[1:], len(keys))
    return codes, first + np.arange(len(first)), np.append(keys, END)


def level(count: np.ndarray) -> np.ndarray:
    """Step that a count of 1 or more reaches; 0 for less."""
    c = np.maximum(np.asarray(count, np.float64), 0.5)
    return np.where(c >= 1, 1 + np.floor(np.log(c) / math.log(BASE) + 1e-9), 0).astype(np.int64)


def count_at(q: np.ndarray) -> np.ndarray:
    """Mean of the counts that stop at a step; 1 at the first."""
    low, high = BASE ** (q - 1.0), BASE ** q.astype(np.float64)
    return np.where(q <= 0, 0.0, np.where(q == 1, 1.0, (low + high - 1) / 2))


def positions(key: np.ndarray, kind: int, q, bits: int) -> list[np.ndarray]:
    """The bits of entry (key, kind, q)."""
    h = mix(key.view(np.uint64) + np.uint64(0x632BE59BD9B4E019) * np.uint64(kind + 1)
            + mix(np.asarray(q, np.uint64)))
    step = mix(h + np.uint64(1)) | np.uint64(1)
    return [((h + np.uint64(i) * step) % np.uint64(bits)).astype(np.int64) for i in range(HASHES)]


def probe(words: np.ndarray, bits: int, key: np.ndarray, kind: int) -> np.ndarray:
    """Steps of the keys: entries are looked up until one is missing."""
    q = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        there = np.ones(len(live), bool)
        for p in positions(key[live], kind, q[live] + 1, bits):
            there &= (words[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) != 0
        live = live[there]
        q[live] += 1
    return q


def word_counts(training: DataFrame) -> DataFrame:
    """(key, n) over all tokens; counted inside each slice first."""
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text"):
                codes, _, keys = tokens(text_array(rows.column("text")))
                n = np.bincount(codes, minlength=len(keys))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))],
                                                 ["key", "n"])

    return (training.select("text").mapInArrow(kernel, "key long, n long")
            .groupBy("key").agg(F.sum("n").alias("n")))


def found(keys: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    """Place of each key, or -1."""
    if not len(sorted_keys):
        return np.full(len(keys), -1, np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


def neighbours(codes: np.ndarray, first: np.ndarray, begin: int) -> np.ndarray:
    """The code before each token; ``begin`` before a text's first."""
    before = np.empty_like(codes)
    before[1:] = codes[:-1]
    before[first[:-1]] = begin
    return before


def coded(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Slices of the batch with their tokens: the slice, where each text
    begins, the codes, the keys of the codes (BEGIN's comes last) and the
    codes of the distinct pairs, ``before * len(keys) + code``, with the
    place of each token's pair. Equal batches give equal slices."""
    for rows in slices(batch, "text", SLICE_BYTES // 2):
        codes, first, keys = tokens(text_array(rows.column("text")))
        keys = np.append(keys, BEGIN)
        pair, inverse = np.unique(neighbours(codes, first, len(keys) - 1) * len(keys) + codes,
                                  return_inverse=True)
        yield rows, first, codes, keys, pair, inverse


def dealt(key: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the keys, range by range, and where each range begins. The
    range follows from all bits of a key, so that the low ones still tell
    apart the keys of one range."""
    part = (mix(key.view(np.uint64)) % np.uint64(ranges)).astype(np.int64)
    return np.argsort(part, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(part, minlength=ranges))])


KEY_BYTES = 6  # low bytes of a pair's key that travel: a range holds a few million pairs at most


def short(key: np.ndarray) -> bytes:
    return np.ascontiguousarray(key.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]).tobytes()


def long(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // KEY_BYTES, 8), np.uint8)
    out[:, :KEY_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, KEY_BYTES)
    return out.view("<i8").ravel().astype(np.int64, copy=False)


ASKED = "range int, kind int, block long, pair binary, h binary, runs binary, n binary"
ANSWERED = "kind int, block long, range int, data binary, key long, pairs long, occur long"
SEEN, BEGUN, RARE = 0, 1, 2  # kinds of rows: a slice's pairs, what a word begins, a slice's rare word


def in_runs(h: np.ndarray, n: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """``h`` as the values and lengths of its runs, and ``n``."""
    start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    runs = np.diff(np.append(start, len(h))).astype(np.int32)
    return h[start].tobytes(), runs.tobytes(), (n.astype(np.uint8) if n.max() < 256 else n).tobytes()


def asking_kernel(head: Broadcast, ranges: int):
    """Each slice's distinct pairs, one row per hash range, with their
    counts in training texts (a byte each where they fit); and the slice's
    words beyond the head. What a pair begins with (``h``) is in runs, as
    pairs come in its order. A slice is named by its first row."""
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = head.value["keys"]
        for batch in batches:
            for rows, first, codes, keys, pair, inverse in coded(batch):
                learnt = ~rows.column("held_out").to_numpy(zero_copy_only=False)
                n = np.bincount(inverse[np.repeat(learnt, np.diff(first))], minlength=len(pair)).astype(np.int32)
                h = keys[pair // len(keys)]
                key = joined(h, keys[pair % len(keys)])
                used = np.unique(np.concatenate([codes, [len(keys) - 1]]))
                rare = keys[used[:-1]][found(keys[used[:-1]], known) < 0]
                block = rows.column("row")[0].as_py()
                del codes, inverse, used
                out = []
                for kind, what in ((SEEN, key), (RARE, rare)):
                    order, start = dealt(what, ranges)
                    for r in np.flatnonzero(np.diff(start)):
                        at = order[start[r]:start[r + 1]]
                        out.append((int(r), kind, block, short(what[at]) if kind == SEEN else what[at].tobytes(),
                                    *(in_runs(h[at], n[at]) if kind == SEEN else (b"", b"", b""))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4))],
                    ["range", "kind", "block", "pair", "h", "runs", "n"])
    return kernel


def answering_kernel(least: int):
    """One hash range: its part of the filter is built from the pairs that
    occur ``least`` times or more, and probed for every slice's pairs."""
    def kernel(part: pa.Table) -> pa.Table:
        kind = part["kind"].to_numpy()
        ask, rare = part.filter(pa.array(kind == SEEN)), part.filter(pa.array(kind == RARE))
        many = lambda t, c, d: np.frombuffer(b"".join(t[c].to_pylist()), d)
        size = pc.binary_length(ask["pair"]).to_numpy().astype(np.int64) // KEY_BYTES
        key, place, inverse = np.unique(long(b"".join(ask["pair"].to_pylist())), return_index=True, return_inverse=True)
        counts = [np.frombuffer(x, np.uint8 if len(x) == k else np.int32) for x, k in zip(ask["n"].to_pylist(), size)]
        n = np.bincount(inverse, weights=np.concatenate([np.zeros(0, np.int32), *counts]),
                        minlength=len(key)).astype(np.int64)
        kept = n >= least
        begun = np.cumsum(many(ask, "runs", np.int32), dtype=np.int64)
        h, of = np.unique(many(ask, "h", np.int64)[np.searchsorted(begun, place[kept], "right")], return_inverse=True)
        bits = filter_size(int(level(n[kept]).sum()))
        words = np.zeros(bits // 64, np.uint64)
        bit, value = filter_bits(key[kept], np.full(int(kept.sum()), PAIR), n[kept], bits)
        words[bit] = value
        q = probe(words, bits, key, PAIR)[inverse].astype(np.uint8).tobytes()
        ends = np.cumsum(size)
        rare_key = many(rare, "pair", np.int64)
        rare_size = pc.binary_length(rare["pair"]).to_numpy().astype(np.int64) // 8
        kinds = np.repeat([SEEN, BEGUN, RARE], [len(size), len(h), len(rare_key)]).astype(np.int32)
        zeros = lambda k: np.zeros(k, np.int64)
        more = len(h) + len(rare_key)
        return pa.table({
            "kind": kinds,
            "block": np.concatenate([ask["block"].to_numpy(), zeros(len(h)),
                                     np.repeat(rare["block"].to_numpy(), rare_size)]),
            "range": np.full(len(kinds), part["range"][0].as_py(), np.int32),
            "data": pa.array([q[e - k:e] for e, k in zip(ends, size)] + [None] * more, pa.binary()),
            "key": np.concatenate([zeros(len(size)), h, rare_key]),
            "pairs": np.concatenate([zeros(len(size)), np.bincount(of, minlength=len(h)), zeros(len(rare_key))]),
            "occur": np.concatenate([zeros(len(size)), np.bincount(of, weights=n[kept], minlength=len(h))
                                     .astype(np.int64), zeros(len(rare_key))])})
    return kernel


def filter_size(entries: int) -> int:
    return max(64, -(-entries * BITS_PER_ENTRY // 64) * 64)


def filter_bits(key: np.ndarray, kind: np.ndarray, n: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The filter's words that the keys with these counts set, and the bits set in them."""
    q = level(n)
    out = [np.zeros(0, np.int64)]
    for s in range(1, int(q.max(initial=0)) + 1):
        for k in (PAIR, PAIRS, OCCUR):
            out += positions(key[(q >= s) & (kind == k)], k, s, bits)
    place = np.unique(np.concatenate(out))
    word, start = np.unique(place >> 6, return_index=True)
    bit = np.uint64(1) << (place & 63).astype(np.uint64)
    return word, np.bitwise_or.reduceat(bit, start) if len(bit) else bit


def bloom_filter(entries: DataFrame) -> tuple[np.ndarray, int]:
    """The filter's 64-bit words and its number of bits. ``entries`` has
    (key, kind, n); tasks set bits, equal words are combined by OR, and at
    most one row per filter word reaches the driver."""
    steps = F.greatest(F.lit(0), F.floor(F.log("n") / math.log(BASE) + 1e-9) + 1)
    total = entries.agg(F.sum(steps)).first()[0] or 0
    bits = filter_size(int(total))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, value = filter_bits(*(batch.column(c).to_numpy() for c in ("key", "kind", "n")), bits)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(value.view(np.int64))],
                                             ["word", "value"])

    table = (entries.select("key", "kind", "n").mapInArrow(kernel, "word long, value long")
             .groupBy("word").agg(F.bit_or("value").alias("value"))).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[table["word"].to_numpy()] = table["value"].to_numpy().view(np.uint64)
    return words, bits


def code_type(keys: np.ndarray):
    """The shortest type that holds the codes of these keys."""
    return np.uint16 if len(keys) <= 1 << 16 else np.int32


def text_kernel():
    """Each slice as one row: its texts' columns, where they begin, codes and keys."""
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text", SLICE_BYTES // 2):  # those of ``coded``
                codes, first, keys = tokens(text_array(rows.column("text")))
                keys = np.append(keys, BEGIN)
                one = [0, rows.num_rows]
                whole = lambda c: pa.ListArray.from_arrays(
                    pa.array(one, pa.int32()), rows.column(c).take(pa.array(np.arange(rows.num_rows))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([rows.column("row")[0].as_py()]), whole("id"), whole("held_out"),
                     *[pa.array([x.tobytes()], pa.binary()) for x in (first, codes.astype(code_type(keys)), keys)]],
                    ["block", "id", "held_out", "first", "codes", "keys"])
    return kernel


def score_kernel(model: Broadcast, ranges: int):
    """One slice with the answers to its pairs and its rare words."""
    def kernel(slice_: pa.Table, answers: pa.Table) -> pa.Table:
        m = model.value
        known, count, bits, words = m["keys"], m["counts"], m["bits"], m["words"]
        size = m["tokens"] + m["words_known"] + 1
        if "begins" not in m:  # what each frequent word begins; BEGIN comes last
            h = np.append(known, BEGIN)
            m["begins"] = count_at(probe(words, bits, h, PAIRS)), count_at(probe(words, bits, h, OCCUR))
            m["total"] = np.append(count, m["texts"]).astype(np.float64)
        first, keys = (np.frombuffer(slice_[c][0].as_py(), np.int64) for c in ("first", "keys"))
        codes = np.frombuffer(slice_["codes"][0].as_py(), code_type(keys)).astype(np.int64)
        pair, inverse = np.unique(neighbours(codes, first, len(keys) - 1) * len(keys) + codes,
                                  return_inverse=True)
        h, w = pair // len(keys), pair % len(keys)
        asked = answers.filter(pa.array(answers["kind"].to_numpy() == SEEN))
        order, start = dealt(joined(keys[h], keys[w]), ranges)
        seen = np.full(len(pair), -1, np.int64)
        for r, data in zip(asked["range"].to_pylist(), asked["data"].to_pylist()):
            seen[order[start[r]:start[r + 1]]] = np.frombuffer(data, np.uint8)
        if len(seen) and seen.min() < 0:
            raise RuntimeError("a slice's pairs were not all answered")
        seen = count_at(seen)
        # exact counts of the slice's words: of the head, or those that were joined
        at = np.append(found(keys[:-1], known), len(known))
        pairs, occur, total = (np.where(at >= 0, x[at], 0.0) for x in (*m["begins"], m["total"]))
        rare = answers.filter(pa.array(answers["kind"].to_numpy() == RARE)).sort_by("key")
        place = found(keys, rare["key"].to_numpy())
        here = (at < 0) & (place >= 0)
        for into, c in ((total, "n"), (pairs, "pairs"), (occur, "occur")):
            value = rare[c].to_numpy().astype(np.float64)[place[here]]
            into[here] = value if c == "n" else count_at(level(value))
        rest = np.maximum(total - occur, 0)
        p = (total + 1) / size
        # behind an unknown word, the word alone counts
        smooth = np.where(total > 0, (pairs + rest) / np.maximum(total + pairs, 1e-9), 1.0)
        smooth = np.where(smooth > 0, smooth, 1e-9)
        after = np.where(total[h] > 0, seen / np.maximum(total + pairs, 1e-9)[h], 0.0)
        part = np.log10(np.minimum(after + smooth[h] * p[w], 1.0))
        return pa.table({
            "doc_id": slice_["id"].combine_chunks().flatten(),
            "held_out": slice_["held_out"].combine_chunks().flatten(),
            "n_tokens": np.diff(first), "n_known": sums((total > 0).astype(np.int64)[codes], first),
            "train_tokens": np.full(len(first) - 1, m["tokens"], np.int64),
            "base_score": sums(np.log10(p)[codes], first), "score": sums(part[inverse], first)})
    return kernel


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id",
          text_col: str = "text", word_share: float = WORD_SHARE,
          pair_share: float = PAIR_SHARE) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out`` (the given condition;
    the model learns from the others), ``n_tokens``, ``n_known``,
    ``train_tokens``, ``base_score`` (words alone) and ``score``."""
    spark = docs.sparkSession
    rows, _ = numbered(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                                   F.coalesce(held_out, F.lit(False)).alias("held_out")), "row")
    rows = rows.select("row", "id", "held_out", "text")  # read twice, in the same batches
    words = stage(word_counts(rows.where(~F.col("held_out"))), "word-counts")
    n, v, texts = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"),
                            F.coalesce(F.sum(F.when(F.col("key") == int(END), F.col("n"))), F.lit(0))).first()
    least_word, least_pair = (max(1, math.ceil(s * n)) for s in (word_share, pair_share))
    often = words.where(F.col("n") >= least_word).toArrow()  # at most 1 / word_share rows
    keys, counts = often["key"].to_numpy(), often["n"].to_numpy()
    order = np.argsort(keys)
    head = {"keys": keys[order], "counts": counts[order]}
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, math.ceil(size / RANGE_BYTES))
    answered = stage(rows.mapInArrow(asking_kernel(spark.sparkContext.broadcast(head), ranges), ASKED)
                     .groupBy("range").applyInArrow(answering_kernel(least_pair), ANSWERED), "pairs")
    begun = stage(answered.where(F.col("kind") == BEGUN).groupBy("key").agg(
        F.sum("pairs").alias("pairs"), F.sum("occur").alias("occur")), "begun")
    of_head = begun.join(words.where(F.col("n") >= least_word).select("key"), "key", "left_semi").union(
        begun.where(F.col("key") == int(BEGIN)))
    entries = (of_head.select("key", F.lit(PAIRS).cast("long").alias("kind"), F.col("pairs").alias("n"))
               .union(of_head.select("key", F.lit(OCCUR).cast("long"), "occur")))
    bitmap, bits = bloom_filter(stage(entries, "filter-entries"))
    model = spark.sparkContext.broadcast(
        {**head, "words": bitmap, "bits": bits, "tokens": n, "words_known": v, "texts": texts})
    rare_words = words.where(F.col("n") < least_word).join(begun, "key", "left")
    rare = (answered.where(F.col("kind") == RARE).select("kind", "block", "range", "data", "key")
            .join(rare_words, "key")
            .select("kind", "block", "range", "data", "key", "n", F.coalesce("pairs", F.lit(0)).alias("pairs"),
                    F.coalesce("occur", F.lit(0)).alias("occur")))
    none = F.lit(0).cast("long")
    answers = answered.where(F.col("kind") == SEEN).select(
        "kind", "block", "range", "data", "key", none.alias("n"), "pairs", "occur").union(rare)
    id_type = rows.schema["id"].dataType.simpleString()
    texts_of = rows.mapInArrow(text_kernel(), f"block long, id array<{id_type}>, held_out array<boolean>, "
                                              "first binary, codes binary, keys binary")
    return texts_of.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        score_kernel(model, ranges), f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, "
                                     "train_tokens long, base_score double, score double")
