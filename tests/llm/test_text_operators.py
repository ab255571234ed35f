"""Quality ledger, tokenizers, packing, token counts, shards and language
model against plain Python versions, on edge cases."""

import collections
import hashlib
import math
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from respondo.llm import byte_bpe, lm_scores, packing, quality, queries, sharding, token_counts
from respondo.llm.common import broadcast_file, slices, text_array

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table_of(tmp_path, df, name="documents"):
    df.write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_slices_are_their_own_arrays():
    import pyarrow.compute as pc
    texts = [f"Ünï {i} " * 10 for i in range(50)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    got = [x for s in slices(batch, "text", 300) for x in pc.ascii_lower(text_array(s.column("text"))).to_pylist()]
    assert got == [(t or "").translate(LOWER) for t in texts]


def measures(text):
    words = WORD.findall(text or "")
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered))


def test_quality_ledger(spark, docs, no_docs, clash, edge_docs, tmp_path):
    out = queries.op8_rule_ledger(spark, table_of(tmp_path, docs)).collect()
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines,
                               r.n_repeat_words, r.base_failed) for r in out)
    want = collections.Counter()
    for i, t, *_ in edge_docs:
        m = measures(t)
        want[(i, *m, m[0] < 50 or 100 * m[4] > 50 * m[0])] += 1
    assert got == want
    assert all(not r.kept for r in out if r.base_failed)
    assert not next(r for r in out if r.doc_id == 14).kept and next(r for r in out if r.doc_id == 1).kept
    book = quality.ledger(clash(docs))
    assert book.count() == len(edge_docs) and dict(book.dtypes)["failed"] == "bigint"
    assert quality.ledger(no_docs).count() == 0


def test_ablation_counts_single_causes(spark, docs):
    book = quality.ledger(docs)
    rows = {r.rule: r for r in quality.ablation(book, "v1").collect()}
    masks = [r.failed for r in book.collect()]
    for i, rule in enumerate(quality.rules()):
        assert rows[rule].fails == sum(m >> i & 1 for m in masks)
        assert rows[rule].fails_only_this == sum(m == 1 << i for m in masks)
        assert rows[rule].rejected == sum(m != 0 for m in masks)


def test_window_codes_beyond_63_bits():
    codes = np.array([5, 6, 7, 5, 6, 7, 9], np.int64)
    small, large = quality.window_codes(codes, 10), quality.window_codes(codes, 1 << 30)
    assert [list(small).index(x) for x in small] == [list(large).index(x) for x in large]


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import base64

    import tiktoken
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe(spark, docs, no_docs, edge_docs, tmp_path, tiktoken_encoding):
    out = queries.op3_segment_tree_bpe(spark, table_of(tmp_path, docs)).collect()
    want = collections.Counter()
    for i, t, *_ in edge_docs:
        ids = np.array(tiktoken_encoding.encode_ordinary(t or ""), "<u4")
        want[(i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(),
              hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert collections.Counter(map(tuple, out)) == want
    vocabulary = broadcast_file(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    empty = byte_bpe.encode(no_docs, vocabulary, public_tokenizers.PATTERN)
    assert byte_bpe.decode(empty, vocabulary, public_tokenizers.PATTERN).count() == 0


def test_segment_trees_on_random_pieces(tiktoken_encoding):
    state = {"file": open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read()}
    r = random.Random(7)
    pools = ["ab ", "the in's\n", "".join(map(chr, range(32, 127))), "".join(map(chr, range(32, 0x3000)))]
    texts = ["".join(r.choice(pool) for _ in range(r.choice([3, 40, 400]))) for pool in pools for _ in range(100)]
    texts += ["aé" * 400, "z" * 3000]
    got = byte_bpe.encode_texts(texts, state, public_tokenizers.PATTERN)
    assert got == [np.array(tiktoken_encoding.encode_ordinary(t), "<u4").tobytes() for t in texts]


def word_ids(text):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tok.encode_special_tokens = True
    return lambda t: tok.encode(t or "", add_special_tokens=False).ids


def test_packing(spark, docs, no_docs, clash, edge_docs, tmp_path):
    encode = word_ids(None)
    out = queries.op1_min_bin_slack_packing(spark, table_of(tmp_path, clash(docs))).collect()
    want = collections.Counter()
    for i, t, *_ in edge_docs:
        ids = np.array(encode(t) + [0], "<u4")
        for k, start in enumerate(range(0, len(ids), 2048)):
            piece = ids[start:start + 2048]
            want[(i, k, start, len(piece), zlib.crc32(piece.tobytes()))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    sequences = collections.defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    total = sum(r.length for r in out)
    assert len(sequences) <= -(-total // 2048) + 1
    vocabulary = broadcast_file(spark, public_tokenizers.path("word_bpe_49k.json"))
    assert packing.pack(no_docs, vocabulary).count() == 0
    with_ids = packing.pack(docs.where("doc_id = 10"), vocabulary, with_ids=True).collect()
    assert [r.ids for r in with_ids] == [encode(edge_docs[11][1]) + [0]] * 2


def test_fullest_is_the_best_sum():
    r = random.Random(3)
    for _ in range(60):
        counts = {r.randrange(1, 40): r.randrange(1, 3) for _ in range(6)}
        slack = r.randrange(1, 90)
        sums = {0}
        for length, n in counts.items():
            sums = {s + k * length for s in sums for k in range(n + 1)}
        used = packing.fullest(counts, slack)
        assert sum(k * v for k, v in used.items()) == max(s for s in sums if s <= slack)
        assert all(used[k] <= counts[k] for k in used)


def test_token_counts(spark, docs, no_docs, edge_docs):
    encode = word_ids(None)
    lens = sorted(len(encode(t)) for _, t, *_ in edge_docs)
    vocabulary = broadcast_file(spark, public_tokenizers.path("word_bpe_49k.json"))
    sums = token_counts.suffix_sums(token_counts.histogram(docs, vocabulary), block=64).cache()
    for r in sums.collect():
        longer = [x for x in lens if x > r.n_tokens]
        assert r.n_docs == lens.count(r.n_tokens) and r.docs_over == len(longer)
        assert r.docs_to == len(lens) - len(longer) and r.tokens_over == sum(longer)
        assert r.tokens_truncated == sum(min(x, r.n_tokens) for x in lens) and r.total_tokens == sum(lens)
    for r in token_counts.truncated_totals(sums, [1, 100, 2048]).collect():
        assert r.tokens == sum(min(x, r.context) for x in lens)
        assert r.docs_cut == sum(x > r.context for x in lens)
    for r in token_counts.quantiles(sums, [0.25, 0.5, 1.0]).collect():
        assert r.n_tokens == lens[math.ceil(r.share * len(lens)) - 1]
    assert token_counts.suffix_sums(token_counts.histogram(no_docs, vocabulary)).count() == 0


def test_shards(spark, docs, no_docs, clash, edge_docs, tmp_path):
    out = queries.op9_feistel_shards(spark, table_of(tmp_path, docs)).collect()
    want = collections.Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()))
                               for i, t, *_ in edge_docs)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in out) == want
    assert len({(r.shard, r.slot) for r in out}) == len(edge_docs)
    assert sharding.shard(clash(docs), 3).count() == len(edge_docs)
    assert sharding.shard(no_docs, 3).count() == 0


def scalar_feistel(at, n, seed):
    """The same network on one number, by the standard 64-bit hash."""
    a, b = sharding.domain(n)

    def value(part, k):
        h = xxhash.xxh64_intdigest(struct.pack("<q", part), 42)
        return xxhash.xxh64_intdigest(struct.pack("<i", seed * 1000 + k), h)

    def signed(h):
        return h - (1 << 64) if h >> 63 else h
    while True:
        left, right = divmod(at, b)
        for k in range(sharding.ROUNDS):
            left = (left + signed(value(right, 2 * k)) % a) % a
            right = (right + signed(value(left, 2 * k + 1)) % b) % b
        at = left * b + right
        if at < n:
            return at


def test_shards_follow_a_scalar_walk(spark):
    for n, shards in ((1, 4), (41, 40), (1003, 40), (2500, 7)):
        out = sharding.shard(spark.range(n), shards, seed=3).collect()
        assert {r["row_number"] for r in out} == set(range(n))
        for r in out:
            at = scalar_feistel(r["row_number"], n, 3)
            assert (r["shard"], r["slot"]) == (at % shards, at // shards)
        slots = collections.defaultdict(list)
        for r in out:
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
        counts = [len(slots[s]) for s in range(shards)]
        assert max(counts) - min(counts) <= 1


def test_feistel_permutes_and_inverts(spark):
    for n in (1, 2, 17, 1000, 5003):
        rows = sharding.shuffled(spark.range(n).withColumn("at", F.col("id")), "at", n, seed=5)
        assert sorted(r["at"] for r in rows.collect()) == list(range(n))
        places = rows.selectExpr("id", "cast(at % 7 as int) shard", "at div 7 slot")
        back = sharding.source_row(places, n, 7, seed=5).collect()
        assert all(r["id"] == r["row_number"] for r in back)


def test_lm_scores(spark, docs, no_docs, edge_docs, tmp_path):
    def check(word_share, pair_share):
        out = lm_scores.score(docs, F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2,
                              word_share=word_share, pair_share=pair_share).collect()
        held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
        tokens = lambda t: WORD.findall((t or "").translate(LOWER)) + [None]
        count = collections.Counter(w for i, t, *_ in edge_docs if not held(i) for w in tokens(t))
        n, v = sum(count.values()), len(count)
        want = collections.Counter()
        for i, t, *_ in edge_docs:
            ws = tokens(t)
            base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws)
            want[(i, held(i), len(ws), sum(count[w] > 0 for w in ws), n, round(base, 4))] += 1
        assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens,
                                    round(r.base_score, 4)) for r in out) == want
        assert all(r.score <= 0 and math.isfinite(r.score) for r in out)
        return {(r.doc_id, r.n_tokens): r for r in out}

    fine = check(2e-7, 1e-6)
    check(1e-3, 1e-2)  # most words are rare here, and joined
    assert fine[(5, 121)].score > fine[(5, 121)].base_score  # a learnt copy is likelier by pairs
    assert lm_scores.score(no_docs, F.lit(False)).count() == 0


def test_filter_gives_counts_back(spark):
    keys = np.arange(1, 3001, dtype=np.int64) * 7919
    counts = (np.arange(3000) % 50 + 1).astype(np.int64)
    entries = spark.createDataFrame([(int(k), 0, int(c)) for k, c in zip(keys, counts)],
                                    "key long, kind long, n long")
    words, bits = lm_scores.bloom_filter(entries)
    got = lm_scores.probe(words, bits, keys, 0)
    assert (got >= lm_scores.level(counts)).all() and (got == lm_scores.level(counts)).mean() > 0.97
    absent = lm_scores.probe(words, bits, keys + 1, 0)
    assert (absent > 0).mean() < 0.03


def test_lm_keeps_rare_pairs_at_every_size(spark, monkeypatch):
    passage = " ".join(f"only{i} once{i}" for i in range(200))
    rows = [(1, "x " * 2_200_000), (2, passage), (3, passage), (4, " ".join(reversed(passage.split())))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    scores = []
    for size in (4 << 20, 50_000):  # one or two hash ranges, and many
        monkeypatch.setattr(lm_scores, "RANGE_BYTES", size)
        out = {r.doc_id: r for r in lm_scores.score(docs, F.col("doc_id") > 2).collect()}
        # a pair learnt once: (1 + p(w)) / 2 after a word seen once, so about 0.3 a token
        assert out[3].score > -0.35 * 401 and out[4].score < -4 * 401
        scores.append([out[i].score for i in (1, 2, 3)])
    assert np.allclose(*scores, rtol=0.02)
    out = {r.doc_id: r for r in lm_scores.score(docs, F.col("doc_id") > 2, word_share=1e-3).collect()}
    assert out[3].score > -0.35 * 401  # pairs of joined words too


def test_short_pair_keys():
    keys = np.random.default_rng(5).integers(-2 ** 63, 2 ** 63 - 1, 200_000)
    assert (lm_scores.long(lm_scores.short(keys)) == keys & (2 ** 48 - 1)).all()
    assert len(lm_scores.long(lm_scores.short(keys[:0]))) == 0
    for ranges in (1, 4, 1 << 16):  # powers of two: the low bytes must not depend on the range
        order, start = lm_scores.dealt(keys, ranges)
        assert sorted(order) == list(range(len(keys))) and start[-1] == len(keys)
        assert np.diff(start).max() < 8 * (len(keys) / ranges + 3)
        first = lm_scores.long(lm_scores.short(keys[order[:start[1]]]))
        assert len(np.unique(first)) == len(first)


def test_lm_scores_equal_a_plain_bigram_model(spark, docs):
    """With counts on the filter's scale, a plain two-word model gives the
    same scores, but for the few pairs that the filter takes for others."""
    begin = ("begin",)
    out = lm_scores.score(docs, F.lit(False)).collect()
    texts = [WORD.findall((r.text or "").translate(LOWER)) + [None] for r in docs.collect()]
    n = collections.Counter(t for x in texts for t in x)
    pair = collections.Counter(p for x in texts for p in zip([begin] + x, x))
    total, size = sum(n.values()), sum(n.values()) + len(n) + 1
    begun, occur = collections.Counter(h for h, _ in pair), collections.Counter()
    for (h, _), k in pair.items():
        occur[h] += k
    n[begin] = len(texts)
    scaled = lambda k: float(lm_scores.count_at(lm_scores.level(np.array([k])))[0])

    def plain(x):
        s = 0.0
        for h, w in zip([begin] + x, x):
            pairs, rest = scaled(begun[h]), max(n[h] - scaled(occur[h]), 0)
            p = (n[w] + 1) / size
            share = (pairs + rest) / (n[h] + pairs) or 1e-9
            s += math.log10(min(scaled(pair[h, w]) / (n[h] + pairs) + share * p, 1.0))
        return s

    want, got = sorted(map(plain, texts)), sorted(r.score for r in out)
    assert len(want) == len(got) and {r.train_tokens for r in out} == {total}
    off = np.abs(np.array(want) - np.array(got)) / np.maximum(1, np.abs(want))
    assert off.max() < 0.05 and np.median(off) < 0.005
