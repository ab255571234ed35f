"""Spelling variants, the Merkle manifest and the additive model against
plain Python versions, on edge cases."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from respondo.llm import additive, merkle, queries, spelling

CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = str.maketrans(CAPITALS, CAPITALS.lower())


def table_of(tmp_path, df, name="documents"):
    df.write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def plain_counts(rows):
    counts = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def plain_variants(counts):
    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))
    beside = {w: [v for v in counts if v != w and abs(len(v) - len(w)) < 2 and near(v, w)] for w in counts}
    form = {}
    for w, vs in beside.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        if best and counts[best] >= 5 * counts[w]:
            form[w] = best
    out = {}
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        f = form.get(w)
        out[w] = (f, root, counts[w], len(beside[w]), counts[f] if f else None)
    return out


def variant_texts():
    """Words with all kinds of edits, at the start, in the middle, at the
    end, in runs of equal letters, and in words of several hundred letters."""
    long = "abcdefghij" * 30
    words = {"balloon": 130, "baloon": 25, "ballon": 26, "baloons": 5, "balloons": 5, "xalloon": 5, "alloon": 6,
             "ballooz": 5, "aaaaaa": 9, "aaaaaaa": 45, "aaaaaaaa": 300, "baaaaa": 5, "Straße": 50, "strase": 5,
             "straße": 5, "éclair": 30, "eclair": 6, "éclaire": 5, "eeclair": 5, long: 30, long + "k": 5,
             long[:150] + "z" + long[151:]: 5, long[1:]: 5, "short": 99, "shorts": 20, "shorted": 5, "unique": 4}
    r = np.random.default_rng(7)
    for _ in range(400):
        words.setdefault("".join(r.choice(list("abc"), r.integers(6, 9))), int(r.integers(3, 60)))
    flat = [w for w, n in words.items() for _ in range(n)]
    r.shuffle(flat)
    return [(k, " ".join(flat[k::37])) for k in range(37)]


def got_variants(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_spelling_variants(spark, docs, no_docs, clash, edge_docs, tmp_path):
    rows = [(d[0], d[1]) for d in edge_docs] + variant_texts() + [(None, "balloon " * 7)]
    both = clash(docs.select("doc_id", "text").union(spark.createDataFrame(rows[len(edge_docs):], "doc_id long, text string")))
    want = plain_variants(plain_counts(rows))
    assert sum(v[0] is not None for v in want.values()) > 20
    assert got_variants(queries.op11_trie_frontier(spark, table_of(tmp_path, both))) == want
    words = spelling.word_counts(both)
    # nodes with many copies of their rows, and node rows dealt by salt
    assert got_variants(spelling.variants(words, block=3)) == want
    assert got_variants(spelling.variants(spelling.word_counts(no_docs))) == {}


def test_one_crowded_prefix(spark):
    """All words share a first half, and most are near one another."""
    words = {f"prefix{a}{b}": 5 + i % 70 for i, (a, b) in enumerate((x, y) for x in "abcdefghijkl" for y in "mnopqrstuvwxyz")}
    rows = spark.createDataFrame(list(words.items()), "word string, n long")
    assert got_variants(spelling.variants(rows, block=10)) == plain_variants(words)


def test_crc_of_joined_parts():
    tables = {}
    for tail in (b"a", b"abc", b"\xc3\xa9" * 400):
        heads = [b"1:", b"12345678901234:", b":"]
        crcs = np.array([zlib.crc32(x) for x in heads], np.uint32)
        got = spelling.shifted(crcs, len(tail), tables) ^ np.uint32(zlib.crc32(tail))
        assert got.tolist() == [zlib.crc32(x + tail) for x in heads]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_manifest(rows):
    """(doc_id, text, lang, source, n_chars) -> a count of result rows."""
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(d, text):
        return sha("".join(map(field, (d[0], d[3], d[2], d[4], text))))

    def grow(digests):
        levels = [digests]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i:i + 8])) for i in range(0, len(levels[-1]), 8)])
        return levels

    def beside(levels, i):
        for level in levels[:-1]:
            a = i // 8 * 8
            yield "".join(level[a:i]), "".join(level[i + 1:a + 8])
            i //= 8

    groups = collections.defaultdict(list)
    for d in rows:
        own = leaf(d, d[1])
        tampered = d[0] is not None and d[1] is not None and zlib.crc32(str(d[0]).encode()) % 3 == 0
        groups[d[2]].append((d[0] is not None, d[0] or 0, own, leaf(d, d[1].translate(LOWER)) if tampered else own))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda x: x[:3])
        trees[g] = grow([x[2] for x in groups[g]])
    top = grow([trees[g][-1][0] for g in names])
    root, out = top[-1][0], collections.Counter()
    for k, g in enumerate(names):
        for i, (known, doc_id, own, fold) in enumerate(groups[g]):
            proof = [*beside(trees[g], i), *beside(top, k)]
            for a, b in proof:
                fold = sha(a + fold + b)
            out[(doc_id if known else None, own, trees[g][-1][0], root, sha("".join(a + b for a, b in proof)),
                 fold, fold == root)] += 1
    return out


def got_manifest(df):
    return collections.Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified)
                               for r in df.collect())


@pytest.mark.parametrize("langs, n", [(1, 1), (1, 9), (3, 700), (11, 30)])
def test_manifest(spark, tmp_path, langs, n):
    rows = [(i * 7 % n if i % 5 else None, f"Text {i}" if i % 4 else None, None if i % langs == 1 else f"l{i % langs}",
             "S", i if i % 3 else None) for i in range(n)]
    rows += rows[:n // 3]  # repeated rows
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert got_manifest(queries.op12_time_forward_manifest(spark, table_of(tmp_path, df))) == plain_manifest(rows)


def test_manifest_edges(spark, docs, no_docs, clash, edge_docs):
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, merkle.ascii_lower(F.col("text")))
    want = plain_manifest(edge_docs)
    assert got_manifest(merkle.manifest(clash(docs), changed)) == want
    assert got_manifest(merkle.manifest(clash(docs), changed, levels=1)) == want  # a chunk per node
    assert merkle.manifest(no_docs, changed).count() == 0
    out = merkle.manifest(docs, with_proof=True).collect()
    assert all(r.verified for r in out)
    for r in out:  # the proof itself leads to the root
        fold = r.leaf
        for a, b in zip(r.lefts, r.rights):
            fold = sha(a + fold + b)
        assert fold == r.root and sha("".join(a + b for a, b in zip(r.lefts, r.rights))) == r.proof_sha256


def test_quality_features():
    texts = ["", "Two WORDS!", "a a a\na a a\nb", "é ß 12 ###", "x" * 50_000]
    got = dict(zip(additive.FEATURES, additive.shares(pa.array(texts, pa.large_string()))))
    assert np.expm1(got["words"]).round(6).tolist() == [0, 2, 7, 4, 1]
    assert got["top_word"].round(6).tolist() == [0, .5, round(6 / 7, 6), .25, 1]
    assert got["capitals"].round(6).tolist() == [0, .75, 0, 0, 0]
    assert got["duplicate_lines"].round(6).tolist() == [0, 0, round(1 / 3, 6), 0, 0]
    assert got["symbols"].tolist() == [0, 0, 0, .75, 0] and got["calls"].tolist() == [0, .5, 0, 0, 0]
    assert all(np.isfinite(v).all() for v in got.values())


def test_trees_are_the_best_ones():
    r = np.random.default_rng(3)
    g, h = r.normal(size=(16, 16)), r.uniform(0.5, 2, (16, 16))

    def leaf_gain(rows, cols, p, q):
        return p[rows][:, cols].sum() ** 2 / (q[rows][:, cols].sum() + additive.RIDGE)

    best = 0
    for p, q in ((g, h), (g.T, h.T)):
        for a in range(1, 16):
            total = 0
            for rows in (slice(0, a), slice(a, 16)):
                total += max(leaf_gain(rows, slice(0, c), p, q) + leaf_gain(rows, slice(c, 16), p, q)
                             for c in range(1, 16))
            best = max(best, total)
    gain, values = additive.four_leaves(g, h)
    assert np.isclose(gain, best - g.sum() ** 2 / (h.sum() + additive.RIDGE))
    # the gain is what the values take off the second-order loss
    assert np.isclose(-2 * ((g * values).sum() + (values ** 2 * h).sum() / 2
                            + additive.RIDGE / 2 * sum(v * v for v in np.unique(values))), best, rtol=1e-6)
    line = additive.three_leaves(np.array([3., 3, -5, -5, 1, 1, 1]), np.ones(7))
    assert np.allclose(line, [-2, -2, 10 / 3, 10 / 3, -.75, -.75, -.75])


def quality_docs(n):
    """Label 1: prose; label 0: shouting, symbols, repeats. An interaction:
    digits are fine in long texts only."""
    from tests.llm.conftest import prose
    rows, labels = [], []
    for i in range(n):
        text, good = prose(i, 40 + i % 90), 1
        kind = i % 6
        if kind == 0:
            text, good = text.upper() + "!!", 0
        elif kind == 1:
            text, good = " ".join(w + "###" for w in text.split()), 0
        elif kind == 2:
            text, good = " ".join(text.split()[:8]) * 9, 0
        rows.append((i, text, "en", "s", None))
        labels.append((i, good, 0))
    return rows, labels


def test_quality_classifier(spark, docs, no_docs, edge_docs, clash, tmp_path, monkeypatch):
    rows, labels = quality_docs(600)
    df = spark.createDataFrame(rows, docs.schema).union(docs.where("doc_id > 9 or doc_id is null"))
    marks = spark.createDataFrame(labels + [(5, None, 0), (None, 1, 0), (99_999, 0, 0), (3, 1, 0)],
                                  "doc_id long, quality int, toxic int")
    sf = table_of(tmp_path, clash(df))
    table_of(tmp_path, marks, "labels")
    out = queries.op13_additive_boosting(spark, sf).collect()
    assert len(out) == df.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= .7) for r in out)
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 4 == 2) for r in out)
    want = {i: q for i, q, _ in labels}
    held = [r for r in out if r.held_out and r.doc_id in want and r.doc_id > 20]
    assert len(held) > 100 and np.mean([r.predicted == want[r.doc_id] for r in held]) > .97
    # labels of held-out rows are never seen
    flipped = marks.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2,
                                                 1 - F.col("quality")).otherwise(F.col("quality")))
    cond = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    again = additive.classify(clash(df), flipped, cond).collect()
    near = lambda rs: sorted((r.doc_id is not None, r.doc_id or 0, round(r.score, 9)) for r in rs)
    assert near(again) == near(out)
    # several bags
    monkeypatch.setattr(additive, "BAG_ROWS", 100)
    bagged = {r.doc_id: r for r in additive.classify(df, marks, cond).collect()}
    assert np.mean([bagged[r.doc_id].predicted == want[r.doc_id] for r in held]) > .95


def test_quality_without_rows_or_labels(spark, docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert additive.classify(no_docs, none, F.lit(False)).count() == 0
    assert {r.score for r in additive.classify(docs, none, F.lit(False)).collect()} == {0.5}
