"""Secret scans of very long texts, and the randomness battery against a
plain Python version."""

import collections
import hashlib
import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from respondo.llm import secrets


def one_text(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_200_000_hyphen_groups_in_one_text(spark):
    t0 = time.time()
    text = "see " + "-".join(["ab12"] * 200_000) + " end"
    got = secrets.find(one_text(spark, text, "x")).orderBy("doc_id").select(
        F.size("base").alias("n"), F.size("found").alias("m")).collect()
    assert [tuple(r) for r in got] == [(0, 0), (0, 0)]  # two letters and two digits over and over are not random
    assert time.time() - t0 < 120


def test_100_000_hashes_in_one_text(spark):
    t0 = time.time()
    lines = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(100_000)]
    text = "é " + "\n".join(lines) + " end"
    out = secrets.find(one_text(spark, text)).select(
        F.size("base").alias("n"), F.size("found").alias("m"), F.element_at("base", -1).alias("last"),
        F.sha2(secrets.redacted("text", "found"), 256).alias("clean")).first()
    assert (out.n, out.m) == (100_000, 100_000)
    assert (out.last.start, out.last.end) == (2 + 99_999 * 65, 2 + 99_999 * 65 + 64)
    assert out.clean == hashlib.sha256(("é " + "\n".join(["[SECRET]"] * 100_000) + " end").encode()).hexdigest()
    assert time.time() - t0 < 180


def test_redaction_of_many_overlapping_spans(spark):
    r = random.Random(8)
    text = "".join(r.choice("abcé😀 ") for _ in range(30_000))
    spans = sorted((a, r.randrange(4), a + r.randrange(1, 9)) for a in r.choices(range(29_000), k=6_000))
    df = spark.createDataFrame([(text, [dict(zip(("start", "kind", "end"), s)) for s in spans])],
                               "text string, found array<struct<start:int,kind:int,end:int>>")
    want, at = [], 0
    merged = []
    for a, _, b in spans:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        want.append(text[at:a])
        at = b
    want.append(text[at:])
    assert df.select(secrets.redacted("text", "found")).first()[0] == "[SECRET]".join(want)


@pytest.mark.parametrize("n, m", [(0, 5), (5, 0), (1, 1), (300, 200), (2_000, 70)])
def test_spans_that_nothing_touches(spark, n, m):
    r = random.Random(n)
    base = sorted((a, r.randrange(3), a + r.randrange(1, 40)) for a in r.choices(range(20_000), k=n))
    cuts = sorted(r.sample(range(20_000), 2 * m))
    mine = [(a, 3, b) for a, b in zip(cuts[::2], cuts[1::2])]
    kind = "array<struct<start:int,kind:int,end:int>>"
    df = spark.createDataFrame([(base, mine)], f"base {kind}, mine {kind}")
    got = df.select(secrets.bound(F.col("mine"), lambda x: secrets.untouched(x, F.col("base")))).first()[0]
    assert [tuple(x) for x in got] == [s for s in mine if not any(b[0] < s[2] and s[0] < b[2] for b in base)]


def tail(z):
    return 0.5 * math.erfc(z / math.sqrt(2))


def encoding(s):
    kinds = [any(c in k for c in s) for k in (secrets.DIGITS, secrets.LOWER, secrets.UPPER, "+/_-")]
    digit, lower, upper, sign = kinds
    if re.fullmatch("[0-9a-f]+|[0-9A-F]+", s) and digit and (lower or upper):
        return "hex"
    if re.fullmatch("[A-Z2-7]+", s) and digit and upper:
        return "base32"
    names = {(1, 1, 1): ("base62", "base64"), (1, 1, 0): ("base36", "lower38"), (1, 0, 1): ("upper36", "upper38"),
             (0, 1, 1): ("base52", "base54"), (0, 1, 0): ("lower26", "lower28"), (0, 0, 1): ("upper26", "upper28"),
             (1, 0, 0): ("base10", "base12"), (0, 0, 0): ("signs", "signs")}
    return names[int(digit), int(lower), int(upper)][sign]


def battery(s):
    """(family, bin) of a candidate, number by number."""
    s = re.sub(secrets.PREFIX, "", s)
    if re.fullmatch("[A-Za-z0-9]{4,}(-[A-Za-z0-9]{4,})+", s):
        s = s.replace("-", "")
    e = encoding(s)
    s = s.lower() if e == "hex" else s.replace("-", "+").replace("_", "/")
    abc, n = secrets.ALPHABETS[e], len(s)
    a, x, count = len(abc), [abc.index(c) for c in s], collections.Counter(s)
    chi = sum((count[c] - n / a) ** 2 / (n / a) for c in abc)
    df = a - 1
    even = ((max(chi, 0) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    high = [v >= a / 2 for v in x]
    n1, runs = sum(high), 1 + sum(p != q for p, q in zip(high, high[1:]))
    mu = 2 * n1 * (n - n1) / n + 1
    z_runs = (runs - mu) / math.sqrt(max((mu - 1) * (mu - 2) / (n - 1), 1e-9))
    mean = sum(x) / n
    spread = sum((v - mean) ** 2 for v in x)
    lag = sum((p - mean) * (q - mean) for p, q in zip(x, x[1:]))
    serial = (lag / spread + 1 / n) * math.sqrt(n) if spread > 1e-9 else 99.0
    kind = [0 if c.isdigit() else 1 if c in secrets.UPPER else 2 if c in secrets.LOWER else 3 for c in s]
    changes = sum(p != q for p, q in zip(kind, kind[1:]))
    shift = n * secrets.UNEVEN[e]
    plain = (chi - df - shift) / math.sqrt(2 * (df + 2 * shift))
    many = (changes - 0.5 - (n - 1) * secrets.CHANGES) / math.sqrt((n - 1) * secrets.CHANGES * (1 - secrets.CHANGES))
    odd = min(tail(even), 2 * tail(abs(z_runs)), 2 * tail(abs(serial)))
    p = 1.0 if odd < secrets.VETO else max(tail(-plain), 0 if e in secrets.ONE_KIND else tail(many))
    return f"{e}:{int(math.log2(n))}", min(secrets.BINS, math.floor(-secrets.PER_DECADE * math.log10(max(p, 1e-30))))


def test_random_spans_equal_a_plain_battery(spark):
    r = random.Random(11)
    pick = lambda n, abc: "".join(r.choice(abc) for _ in range(n))
    texts = []
    for _ in range(120):
        abc = secrets.ALPHABETS[r.choice(sorted(secrets.ALPHABETS))]
        words = [pick(r.randrange(20, 90), abc), "plain", pick(r.randrange(4, 30), "abcdefgh") + "_" + pick(30, "etaoin"),
                 "-".join(pick(r.randrange(4, 9), secrets.LOWER) for _ in range(6)), "token=" + pick(20, secrets.DIGITS),
                 "sk-" + pick(40, secrets.LOWER + secrets.DIGITS), pick(34, "0123456789abcdef")]
        r.shuffle(words)
        texts.append(" ".join(words[:r.randrange(1, 8)]))
    out = {q.doc_id: q for q in secrets.find(one_text(spark, *texts)).collect()}
    cands = [(i, m.start(), m.end(), *battery(m.group())) for i, t in enumerate(texts)
             for m in re.finditer(secrets.CANDIDATE, t)]
    families = collections.defaultdict(list)
    for c in cands:
        families[c[3]].append(c[4])
    least = {}
    for f, bins in families.items():
        good = [b for b in set(bins) if 10 ** (-b / 10) * len(bins) <= 0.01 * sum(x >= b for x in bins)]
        if good:
            least[f] = min(good)
    want = collections.defaultdict(list)
    for i, a, b, family, k in cands:
        if family in least and k >= least[family] and not any(x.start < b and a < x.end for x in out[i].base):
            want[i].append((a, b))
    got = {i: [(x.start, x.end) for x in q.found if x.kind == 3] for i, q in out.items()}
    assert sum(map(len, got.values())) > 20
    assert got == {i: want[i] for i in out}


def test_clashing_columns(spark, clash):
    df = clash(one_text(spark, "password=12345678 x", None)).withColumn("tests", F.lit("y"))
    out = secrets.find(df).orderBy("doc_id").collect()
    assert [len(r.base) for r in out] == [1, 0] and [r.tests for r in out] == ["y", "y"]
    assert out[0].asDict()["row"] == "x"
