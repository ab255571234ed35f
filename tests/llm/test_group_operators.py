"""Near duplicates, embeddings, secrets, WARC and the pipeline against
brute force, on edge cases and crowds."""

import base64
import collections
import hashlib
import random
import re

import numpy as np
import pytest

from respondo.llm import components, embedding_dedup, minhash, queries, secrets, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, k=5):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def groups(n, links):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x
    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def text_components(ids, texts, percent):
    sets = [shingle_set(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i)
             if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    top = groups(len(sets), links)
    least = collections.defaultdict(list)
    for i, g in zip(ids, top):
        least[g].append(i)
    return sets, [min((x for x in least[g] if x is not None), default=None) for g in top]


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(spark, edge_docs, clash, percent, monkeypatch):
    from llm.crowds import crowd
    monkeypatch.setattr(minhash, "BUCKET_BLOCK", 16)   # crowds over many blocks
    monkeypatch.setattr(minhash, "ROW_BLOCK", 16)
    rows = [(i, t) for i, t, *_ in edge_docs] + crowd(100, 90)
    df = clash(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    out = minhash.near_duplicates(df, percent=percent).collect()
    sets, least = text_components([i for i, _ in rows], [t for _, t in rows], percent)
    want = collections.Counter((i, len(s), c, i is not None and i == c) for (i, _), s, c in zip(rows, sets, least))
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out) == want
    firsts = collections.Counter(r.first for r in out)
    assert firsts[True] == len({c for c in least if c is not None}) + sum(c is None for c in least)


def test_near_duplicates_of_nothing(no_docs):
    assert minhash.near_duplicates(no_docs).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (None, 3)]
    out = {r.node: r.component for r in components.components(
        spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(60)}}


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "UNIT", 60)   # many units and visits
    r = np.random.default_rng(5)
    x = r.normal(size=(300, 16))
    crowd = x[0] + 0.12 * np.linalg.norm(x[0]) / 4 * r.normal(size=(150, 16))
    chain = [np.eye(16)[0] * np.cos(a) + np.eye(16)[1] * np.sin(a) for a in np.arange(12) * 0.4]
    vectors = [list(map(float, v)) for v in np.concatenate([x, crowd, np.array(chain)]).astype(np.float32)]
    vectors += [vectors[3]] * 9 + [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15,
                                   [None] + [1.0] * 15, [1.0] * 8]
    ids = [*range(1000, 1000 + len(vectors) - 1), None]
    df = spark.createDataFrame(list(zip(ids, vectors)), "vec_id long, embedding array<float>").repartition(3)
    out = {q.vec_id: q for q in embedding_dedup.near_duplicates(df).collect()}
    fine = [i for i, v in enumerate(vectors) if v and len(v) == 16 and None not in v
            and np.isfinite(v).all() and any(v)]
    m = np.array([vectors[i] for i in fine])
    m /= np.linalg.norm(m, axis=1)[:, None]
    near = m @ m.T >= 0.9
    np.fill_diagonal(near, False)
    assert sum(out[ids[i]].n_links for i in fine) >= 0.99 * near.sum()
    assert all(out[ids[i]].n_links <= near[k].sum() for k, i in enumerate(fine))
    top = groups(len(fine), zip(*np.nonzero(near)))
    same = np.mean([out[ids[i]].component_id == ids[fine[top[k]]] for k, i in enumerate(fine)])
    assert same >= 0.99
    for i in set(range(len(vectors))) - set(fine):
        assert out[ids[i]].n_links == 0 and out[ids[i]].component_id == ids[i]
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_dedup.near_duplicates(none).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, None)], "vec_id long, embedding array<float>")
    assert [q.n_links for q in embedding_dedup.near_duplicates(nulls).collect()] == [0, 0]


def test_embeddings_keep_pairs_beside_a_crowd(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "UNIT", 20)   # many shards
    monkeypatch.setattr(embedding_dedup, "SAMPLE", 150)
    r = np.random.default_rng(9)
    one = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    x = one(r.normal(size=(1000, 64)))
    side = r.normal(size=x.shape)
    side = one(side - (side * x).sum(axis=1, keepdims=True) * x)
    pairs = np.concatenate([x, 0.91 * x + np.sqrt(1 - 0.91 ** 2) * side])
    crowd = one(r.normal(size=64)) + 0.01 * r.normal(size=(1000, 64))
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(np.concatenate([pairs, crowd]))],
                               "vec_id long, embedding array<float>").repartition(4)
    out = {q.vec_id: q for q in embedding_dedup.near_duplicates(df, visits=1).collect()}
    assert np.mean([out[i].n_links >= 1 for i in range(2000)]) >= 0.93
    # links too rare for an audit: planted pairs set the visits
    c = embedding_dedup.centres(x[:100], 100)
    shares = [embedding_dedup.planted(x[100:], c, v, 0.9) for v in (1, 4, 100)]
    assert shares[0] < shares[1] < shares[2] == 1.0


def test_embeddings_of_several_dimensions(spark, monkeypatch):
    r = np.random.default_rng(3)
    vectors = []
    for d, n in ((16, 90), (8, 120), (3, 1), (24, 10)):
        x = r.normal(size=(n, d))
        vectors += [list(map(float, v)) for v in np.concatenate([x, x, 2 * x + 0.01]).astype(np.float32)]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").repartition(3)
    m = [np.array(v) / np.linalg.norm(v) for v in vectors]
    near = [(i, j) for i, v in enumerate(m) for j, w in enumerate(m) if i != j and len(v) == len(w) and v @ w >= 0.9]
    top, links = groups(len(m), near), np.bincount([i for i, _ in near], minlength=len(m))
    for unit in (1500, 60):  # small dimensions whole, larger ones searched
        monkeypatch.setattr(embedding_dedup, "UNIT", unit)
        out = {q.vec_id: q for q in embedding_dedup.near_duplicates(df).collect()}
        assert np.mean([out[i].n_links == links[i] for i in out]) >= (1 if unit == 1500 else 0.97)
        assert np.mean([out[i].component_id == top[i] for i in out]) >= (1 if unit == 1500 else 0.97)


BASE = [("assign", re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                              r"""([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[1]) >= 8),
        ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
        ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32)]


def secret_texts():
    r = random.Random(11)
    abc = secrets.ALPHABETS["base64"]
    rand = lambda n, a=abc[:62]: "".join(r.choice(a) for _ in range(n))
    return [None, "", "token: abc token=abcdefgh secret: token: longenough1",
            "é😀 password = \"" + rand(20) + "\" AKIA" + rand(16, abc[:26]) + " AKIAAKIA",
            "hex " + rand(40, "0123456789abcdef") + " and " + rand(31, "0123456789abcdef"),
            "plain " + rand(48) + " key", "plain " + rand(64) + ", " + rand(60),
            "someVeryLongIdentifierNameInCamelCase2 aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1B",
            "20240101202401012024010120240101 path/to/some/long/file/name/v2/index",
            " ".join(["token=abcdefgh"] * 700)]


def test_secrets(spark, no_docs, tmp_path):
    texts = secret_texts()
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(
        str(tmp_path / "documents.parquet"))
    out = {r.doc_id: r for r in queries.op6_randomness_battery(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        spans = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(BASE)
                       for m in p.finditer(t or "") if ok(m))
        listed = [f"{BASE[k][0]}:{a}:{b}" for a, k, b in spans]
        assert out[i].base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest(), i
        assert (out[i].n_assign, out[i].n_access, out[i].n_hex) == tuple(
            sum(s.startswith(k) for s in listed) for k, *_ in BASE)
        assert set(listed) <= set(out[i].spans.split(",")) or not listed
    extra = {i: [s for s in out[i].spans.split(",") if s.startswith("random")] for i in out}
    assert len(extra[5]) == 1 and len(extra[6]) == 2   # random strings without a marker
    assert not extra[7] and not extra[8]                # identifiers, numbers and paths stay
    assert secrets.find(no_docs).count() == 0


def test_secrets_of_every_shape(spark):
    r = random.Random(4)
    lower, upper, digits = secrets.LOWER, secrets.UPPER, secrets.DIGITS
    rand = lambda n, a: "".join(r.choice(a) for _ in range(n))
    shapes = [lambda: rand(60, upper + digits), lambda: "sk-" + rand(60, lower + digits),
              lambda: rand(48, lower + upper), lambda: rand(60, lower + digits + "_-"),
              lambda: rand(60, upper + digits + "+/"), lambda: rand(60, lower + upper + "-_"),
              lambda: "-".join(rand(n, "0123456789abcdef") for n in (8, 8, 8, 8, 8, 8, 16))]
    plain = ["path/to/some/long/file/name/without/digits", "a-long-title-of-words-joined-by-hyphens-in-it",
             "AnotherIdentifierInCamelCaseWithoutDigits", "CONSTANT_NAME_OF_A_LONG_SETTING_VALUE", "-" * 40,
             "2024010120240101202401012024010", "internationalisationsverfahren", "2024-01-01-2024-01-01-2024"]
    texts = [f"see {shape()} here" for shape in shapes for _ in range(20)] + [f"see {p} here" for p in plain]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {q.doc_id: q.text for q in secrets.find(df).select(
        "doc_id", secrets.redacted("text", "found").alias("text")).collect()}
    for k in range(len(shapes)):
        assert sum(got[i] == "see [SECRET] here" for i in range(20 * k, 20 * k + 20)) >= 15, k
    assert [got[20 * len(shapes) + i] for i in range(len(plain))] == [f"see {p} here" for p in plain]


def test_redaction_merges_overlaps(spark):
    rows = [("ab password=12345678 é" + "0123456789abcdef" * 3,), (None,), ("clean",)]
    df = spark.createDataFrame(rows, "text string")
    found = secrets.find(df)
    got = [r[0] for r in found.select(secrets.redacted("text", "found")).collect()]
    assert sorted(got, key=str) == sorted(["ab [SECRET] é[SECRET]", None, "clean"], key=str)


def test_warc(spark, tmp_path, monkeypatch, clash):
    monkeypatch.setattr(warc, "CHUNK", 100)
    tricky = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 9
    pages = [(1, "http://a/", "x" * 1000), (2, None, "x" * 1000), (3, "http://b/ü \r\n", tricky), (4, "u", None),
             (5, "u", ""), (6, "u", "WARC/1.1"), (7, "u", "é😀" * 333 + "\r\n\r"), (None, "u", tricky),
             (8, "u", "one"), (8, "u", "one"), (9, "u", "\r\n\r\n")]
    df = clash(spark.createDataFrame(pages, "page_id long, url string, html string")).repartition(2)
    warc.write(df, str(tmp_path / "w"), "page_id", "url", "html", min_bytes=1)
    out = warc.read(spark, str(tmp_path / "w")).collect()
    want, first = collections.Counter(), {}
    for i, _, h in sorted(pages, key=lambda p: (p[0] is None, p[0] or 0)):
        b = (h or "").encode()
        to = first.setdefault(b, (i,)) if b else (i,)
        new = not b or not any(k[2] == base64.b32encode(hashlib.sha1(b).digest()).decode() for k in want)
        want[(i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(),
              "response" if new else "revisit", None if new else to[0])] += 1
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)
                               for r in out) == want
    assert all(r.intact for r in out)
    import glob
    import gzip
    data = b"".join(gzip.open(f).read() for f in glob.glob(str(tmp_path / "w" / "*.gz")))
    seen = 0
    while data:  # the archives are plain WARC: length after length
        head, _, rest = data.partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n")
        n = int(re.search(rb"Content-Length: (\d+)$", head)[1])
        assert rest[n:n + 4] == b"\r\n\r\n"
        data, seen = rest[n + 4:], seen + 1
    assert seen > len(pages)
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(none).count() == 0


def test_pipeline(spark, tmp_path, edge_docs):
    import corpus_pipeline
    from llm.crowds import crowd
    from respondo.llm.common import stage
    leak = " token = " + "0123456789abcdef" * 2
    rows = edge_docs + [(i, t, "en", "s", len(t)) for i, t in crowd(500, 20)]
    rows += [(900, crowd(77, 1)[0][1] + leak, "en", "s", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.withColumn("row", docs.lang).write.parquet(str(tmp_path / "documents.parquet"))
    now, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, step in corpus_pipeline.STAGES:
        columns = now.columns
        now = stage(step(spark, now, str(tmp_path)), name.replace(" ", "-"))
        seen.append((now, columns))
    kept = [r for r in seen[0][0].collect()]
    assert {14, 2, 3, 7}.isdisjoint({r.doc_id for r in kept}) and 10 in {r.doc_id for r in kept}
    for frame, columns in seen[:3]:
        assert frame.columns == columns
    _, least = text_components([k for k in range(len(kept))], [r.text for r in kept], 80)
    assert seen[1][0].count() == len(set(least))
    clean = {r.doc_id: r for r in seen[2][0].collect()}
    assert clean[900].text.endswith("[SECRET]") and clean[900].n_chars == len(clean[900].text)
    assert "0123456789abcdef" not in clean[900].text
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert final.columns == now.columns and final.count() == now.count()
    empty = spark.createDataFrame([], docs.schema)
    for name, step in corpus_pipeline.STAGES:
        empty = stage(step(spark, empty, ""), "none")
        assert empty.count() == 0


@pytest.mark.parametrize("unit", [1500, 2])
def test_embeddings_in_doubles(spark, monkeypatch, unit):
    """Very short and very long vectors link; a cosine is not rounded to singles first."""
    monkeypatch.setattr(embedding_dedup, "UNIT", unit)
    rows = [(0, [1.0, 0.0]), (1, [1e-300, 0.0]), (2, [1e300, 0.0]), (3, [0.0, 5e-324]), (4, [0.0, 1.0]),
            (5, [0.0, float("inf")]), (6, [-1e300, 1e-300])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = {q.vec_id: (q.n_links, q.component_id) for q in embedding_dedup.near_duplicates(df).collect()}
    assert out == {0: (2, 0), 1: (2, 0), 2: (2, 0), 3: (1, 3), 4: (1, 3), 5: (0, 5), 6: (0, 6)}
