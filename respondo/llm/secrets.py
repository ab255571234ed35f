"""Secret scans by patterns and a battery of randomness tests.

Three patterns (``BASE``) find assignments, access keys and hexadecimal
runs. Beside them, every run of encoding characters is a candidate. Its
encoding is inferred from the characters in it, without a short prefix
(``sk-``) and without the hyphens between groups: hexadecimal, base 32, or
else the kinds of characters that occur. Every candidate is tested

* for a uniform alphabet (chi-squared), for runs above and below the
  alphabet's middle, and for serial correlation: what a random string would
  show in fewer than one of ``VETO`` cases is not random;
* against ordinary text of the same length and encoding: how often such
  text has an alphabet as even (chi-squared, shifted by the unevenness of
  ordinary letters) and as many changes between letters, capitals and
  digits. The larger of the two tail probabilities is its p-value; with one
  kind of characters alone, which has no changes, it is the first.

False discoveries are controlled length by length: the candidates of one
encoding and length class (a power of two) form a family, and the
Benjamini-Hochberg rule with rate ``rate`` finds the family's p-value limit
from a histogram of p-values. The histogram has a bounded number of rows.

Everything is made of SQL expressions over whole texts; positions are code
points, ends exclusive. Defined results: null and empty texts have no
spans; equal texts and repeated rows are judged alike; an empty table gives
no rows; columns to carry along are named in ``keep``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from respondo.llm.common import stage

# Kinds in the order in which equal starts are listed.
KINDS = ["assign", "access", "hex", "random"]
BASE = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]{32,}",
}
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
PREFIX = r"^(?:[A-Za-z]{1,8}[-_]){1,2}(?=[A-Za-z0-9+/_-]{16,}$)"
#: possessive: the matcher loops over the groups instead of recursing into each
GROUPS = r"^[A-Za-z0-9]{4,}+(?:-[A-Za-z0-9]{4,}+)++$"
DIGITS, LOWER, UPPER, SIGNS = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "+/"
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": DIGITS + LOWER,
    "base64": UPPER + LOWER + DIGITS + SIGNS,  # - and _ count as + and /
    "upper36": DIGITS + UPPER, "base62": UPPER + LOWER + DIGITS, "base52": UPPER + LOWER,
    "lower26": LOWER, "upper26": UPPER, "base10": DIGITS,
    "lower38": LOWER + DIGITS + SIGNS, "upper38": UPPER + DIGITS + SIGNS, "base54": UPPER + LOWER + SIGNS,
    "lower28": LOWER + SIGNS, "upper28": UPPER + SIGNS, "base12": DIGITS + SIGNS, "signs": SIGNS,
}
#: Unevenness of ordinary text (alphabet size times the chance that two of
#: its characters are equal, less one), and its rate of class changes.
UNEVEN = {"hex": 0.9, "base32": 1.1, "base36": 1.2, "base64": 3.2, "upper36": 1.2, "base62": 3.1, "base52": 2.4,
          "lower26": 0.7, "upper26": 0.7, "base10": 0.5, "lower38": 1.5, "upper38": 1.5, "base54": 2.5,
          "lower28": 0.8, "upper28": 0.8, "base12": 1.0, "signs": 0.5}
ONE_KIND = ["lower26", "upper26", "base10", "signs"]
CHANGES = 0.15
VETO = 1e-4
BINS, PER_DECADE = 200, 10


def bound(value: Column, use) -> Column:
    """``use(value)``, ``value`` being evaluated once: inside a lambda an
    expression would be evaluated again for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, merge, start: Column, levels: int = 2, block: int = 64) -> Column:
    """For each element, ``merge`` of ``start`` and the elements before it
    (``values`` is bound). Blocks are merged first and their running results
    found likewise, so that a text with very many matches costs little more
    per match than one with few."""
    def total(x: Column) -> Column:
        return F.aggregate(x, start, merge)
    if not levels:
        return F.transform(values, lambda _, i: total(F.slice(values, F.lit(1), i)))
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(values) - 1, F.lit(0)), F.lit(block)),
                         lambda k: total(F.slice(values, k + 1, F.lit(block))))
    return bound(blocks, lambda b: bound(running(b, merge, start, levels - 1, block), lambda before: F.transform(
        values, lambda _, i: F.aggregate(
            F.slice(values, i - i % block + 1, i % block),
            F.get(before, F.floor(i / block).cast("int")), merge))))


def with_matches(df: DataFrame, text: str, pattern: str, name: str) -> DataFrame:
    """Add ``name``: array of (start, end, s) of all matches, left to right."""
    empty = "CAST(array() AS array<struct<start:int,end:int,s:string>>)"

    def spans(found: Column) -> Column:
        def placed(gaps: Column) -> Column:
            sizes = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: g + F.length(m))
            return bound(sizes, lambda z: bound(running(z, lambda a, v: a + v, F.lit(0)), lambda at: F.transform(
                found, lambda m, i: F.struct(
                    (F.get(at, i) + F.get(gaps, i)).alias("start"),
                    (F.get(at, i) + F.get(gaps, i) + F.length(m)).alias("end"), m.alias("s")))))
        return F.when(F.size(found) > 0, bound(F.transform(F.split(text, pattern, -1), F.length), placed))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return df.withColumn(name, F.coalesce(
        F.when(F.col(text).rlike(pattern), bound(found, spans)), F.expr(empty)))


def upper_tail(z: Column) -> Column:
    """P(N > z) for a standard normal N (Abramowitz and Stegun 26.2.17)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (
        -1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) * 0.3989422804014327 * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def bare(s: Column) -> Column:
    """The candidate without a short prefix and the hyphens between groups."""
    rest = F.regexp_replace(s, PREFIX, "")
    return F.when(rest.rlike(GROUPS), F.translate(rest, "-", "")).otherwise(rest)


def encoding(s: Column) -> Column:
    """The narrowest encoding whose alphabet holds the string; every string
    of candidate characters has one."""
    digit, lower, upper, sign = (s.rlike(c) for c in ("[0-9]", "[a-z]", "[A-Z]", "[+/_-]"))
    return (F.when(s.rlike("^[0-9a-f]+$|^[0-9A-F]+$") & digit & (lower | upper), "hex")
            .when(s.rlike("^[A-Z2-7]+$") & digit & upper, "base32")
            .when(digit & lower & upper, F.when(sign, "base64").otherwise("base62"))
            .when(digit & lower, F.when(sign, "lower38").otherwise("base36"))
            .when(digit & upper, F.when(sign, "upper38").otherwise("upper36"))
            .when(lower & upper, F.when(sign, "base54").otherwise("base52"))
            .when(lower, F.when(sign, "lower28").otherwise("lower26"))
            .when(upper, F.when(sign, "upper28").otherwise("upper26"))
            .when(digit, F.when(sign, "base12").otherwise("base10"))
            .otherwise("signs"))


def judged(s: Column) -> Column:
    """The candidate's statistics step by step, as nested structs: each step
    is bound, so that it is evaluated once."""
    then = bound

    def pick(name: Column, values: dict) -> Column:
        out = F.when(name == next(iter(values)), F.lit(next(iter(values.values()))))
        for k, v in list(values.items())[1:]:
            out = out.when(name == k, F.lit(v))
        return out

    def named(c: Column) -> Column:
        return F.struct(c.s.alias("s"), encoding(c.s).alias("e"))

    def shape(c: Column) -> Column:
        plain = F.when(c.e == "hex", F.lower(c.s)).otherwise(F.translate(c.s, "-_", "+/"))
        return F.struct(c.e.alias("e"), plain.alias("s"), pick(c.e, ALPHABETS).alias("abc"),
                        F.length(c.s).cast("double").alias("n"))

    def indexed(c: Column) -> Column:
        chars = F.split(c.s, "")
        return F.struct(
            c.e.alias("e"), c.n.alias("n"), F.length(c.abc).cast("double").alias("a"),
            F.transform(chars, lambda x: F.expr("0D") + F.instr(c.abc, x) - 1).alias("x"),
            F.transform(chars, lambda x: F.when(x.between("0", "9"), 0).when(x.between("A", "Z"), 1)
                        .when(x.between("a", "z"), 2).otherwise(3)).alias("k"),
            F.aggregate(F.split(c.abc, ""), F.lit(0.0), lambda acc, ch: acc + F.pow(
                c.n - F.length(F.replace(c.s, ch, F.lit(""))), F.lit(2))).alias("squares"))

    def counted(c: Column) -> Column:
        def pairs(arr: Column, f) -> Column:
            size = F.size(arr)
            return F.aggregate(F.zip_with(F.slice(arr, F.lit(1), size - 1), F.slice(arr, F.lit(2), size - 1), f),
                               F.lit(0.0), lambda a, v: a + v)
        mean = F.aggregate(c.x, F.lit(0.0), lambda a, v: a + v) / c.n
        high = lambda v: v >= c.a / 2
        return F.struct(
            c.e.alias("e"), c.n.alias("n"), c.a.alias("a"),
            (c.a / c.n * c.squares - c.n).alias("chi"),
            F.aggregate(c.x, F.lit(0.0), lambda a, v: a + F.when(high(v), 1.0).otherwise(0.0)).alias("n1"),
            (pairs(c.x, lambda p, q: F.when(high(p) != high(q), 1.0).otherwise(0.0)) + 1).alias("runs"),
            pairs(c.k, lambda p, q: F.when(p != q, 1.0).otherwise(0.0)).alias("changes"),
            mean.alias("m"), pairs(c.x, lambda p, q: p * q).alias("lag"),
            F.aggregate(c.x, F.lit(0.0), lambda a, v: a + v * v).alias("power"),
            (F.get(c.x, F.lit(0)) + F.get(c.x, c.n.cast("int") - 1)).alias("ends"))

    def tested(c: Column) -> Column:
        df = c.a - 1
        w = 2 / (9 * df)
        even = (F.pow(F.greatest(c.chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - w)) / F.sqrt(w)
        mu = 2 * c.n1 * (c.n - c.n1) / c.n + 1
        runs = (c.runs - mu) / F.sqrt(F.greatest((mu - 1) * (mu - 2) / (c.n - 1), F.lit(1e-9)))
        spread = c.power - c.n * c.m * c.m
        # sum of (x - m)(y - m) over neighbours
        lag = c.lag - c.m * (2 * c.n * c.m - c.ends) + (c.n - 1) * c.m * c.m
        serial = F.when(spread > 0, (lag / spread + 1 / c.n) * F.sqrt(c.n)).otherwise(F.lit(99.0))
        shift = c.n * pick(c.e, UNEVEN)
        plain = (c.chi - df - shift) / F.sqrt(2 * (df + 2 * shift))
        many = (c.changes - 0.5 - (c.n - 1) * CHANGES) / F.sqrt((c.n - 1) * CHANGES * (1 - CHANGES))
        odd = F.least(upper_tail(even), 2 * upper_tail(F.abs(runs)), 2 * upper_tail(F.abs(serial)))
        p = F.when(odd < VETO, 1.0).otherwise(F.greatest(
            upper_tail(-plain), F.when(c.e.isin(ONE_KIND), 0.0).otherwise(upper_tail(many))))
        return F.struct(F.concat_ws(":", c.e, F.floor(F.log2(c.n))).alias("family"),
                        F.least(F.lit(BINS), F.floor(-PER_DECADE * F.log10(F.greatest(p, F.lit(1e-30))))
                                .cast("int")).alias("bin"))

    return then(then(then(then(then(F.struct(bare(s).alias("s")), named), shape), indexed), counted), tested)


def spans_of(matches: Column, kind: str) -> Column:
    number = F.lit(KINDS.index(kind))
    return F.transform(matches, lambda m: F.struct(
        m.start.alias("start"), number.alias("kind"), m.end.alias("end")))


def scan(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """``keep``, the base spans (start, kind, end) and the judged candidates
    of every text, written to the shared folder."""
    df = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    for kind, pattern in BASE.items():
        df = with_matches(df, "__text", pattern, f"__{kind}")
    df = with_matches(df, "__text", CANDIDATE, "__candidate")
    long_enough = {
        "assign": lambda m: F.length(F.regexp_extract(m.s, BASE["assign"], 1)) >= 8,
        "access": lambda m: F.length(m.s) >= 16,
        "hex": lambda m: F.length(m.s) >= 32,
    }
    spans = [spans_of(F.filter(f"__{kind}", long_enough[kind]), kind) for kind in BASE]
    tests = F.transform("__candidate", lambda m: F.struct(
        m.start.alias("start"), m.end.alias("end"), judged(m.s).alias("t")))
    return stage(df.select(*keep, F.array_sort(F.concat(*spans)).alias("base"), tests.alias("__tests")),
                 "secret-scan")


def limits(scanned: DataFrame, rate: float) -> dict[str, int]:
    """Benjamini-Hochberg per family: the lowest bin (of -10 log10 p) whose
    p-value, times the family's candidates, is at most ``rate`` times the
    candidates with a p-value as small. At most one row per encoding and
    power of two is collected."""
    counts = (scanned.select(F.explode("__tests.t").alias("t")).groupBy("t.family", "t.bin")
              .agg(F.count("*").alias("n")))
    by_family = counts.groupBy("family").agg(
        F.sum("n").alias("m"), F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("bins"))
    # a bin holds p-values up to 10^(-bin / 10)
    as_small = lambda b: F.aggregate(F.filter("bins", lambda x: x.bin >= b), F.lit(0).cast("long"),
                                     lambda a, x: a + x.n)
    good = F.filter(F.transform("bins", lambda x: x.bin),
                    lambda b: F.pow(F.lit(10.0), -b / PER_DECADE) * F.col("m") <= rate * as_small(b))
    return {r[0]: r[1] for r in by_family.select("family", F.array_min(good).alias("least"))
            .where("least is not null").collect()}


def untouched(spans: Column, base: Column) -> Column:
    """Those of ``spans`` (start, kind, end; sorted, apart from each other)
    that no span of ``base`` overlaps: among all of them by start, no base
    span before one reaches into it, and none after it begins in it."""
    none = F.lit(1 << 30)

    def checked(events: Column) -> Column:
        ends = F.transform(events, lambda x: F.when(x.mine, 0).otherwise(x.end))
        starts = F.reverse(F.transform(events, lambda x: F.when(x.mine, none).otherwise(x.start)))
        return bound(ends, lambda e: bound(starts, lambda s: bound(
            running(e, lambda a, v: F.greatest(a, v), F.lit(0)), lambda reach: bound(
                F.reverse(running(s, lambda a, v: F.least(a, v), none)), lambda after: F.filter(
                    events, lambda x, i: x.mine & (F.get(reach, i) <= x.start) & (F.get(after, i) >= x.end))))))

    def marked(x: Column, mine: bool) -> Column:
        return F.transform(x, lambda s: F.struct(
            s.start.alias("start"), F.lit(mine).alias("mine"), s.end.alias("end"), s.kind.alias("kind")))

    kept = bound(F.array_sort(F.concat(marked(base, False), marked(spans, True))), checked)
    return F.when((F.size(spans) > 0) & (F.size(base) > 0), F.transform(kept, lambda x: F.struct(
        x.start.alias("start"), x.kind.alias("kind"), x.end.alias("end")))).otherwise(spans)


def find(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None,
         rate: float = 0.01) -> DataFrame:
    """``keep`` (all columns by default), ``base`` (spans of the patterns)
    and ``found`` (with the random strings that no base span touches):
    sorted arrays of (start, kind, end), kind being a place in ``KINDS``.
    Kept columns of these two names are replaced."""
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("base", "found")]
    scanned = scan(docs, text_col, kept)
    least = F.create_map(*[F.lit(x) for pair in {"": BINS + 1, **limits(scanned, rate)}.items()
                           for x in pair])
    likely = F.filter("__tests", lambda c: c.t.bin >= F.coalesce(least[c.t.family], F.lit(BINS + 1)))
    extra = bound(spans_of(likely, "random"), lambda spans: untouched(spans, F.col("base")))
    return scanned.withColumn("found", F.array_sort(F.concat("base", extra))).drop("__tests")


def listed(spans: str) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s.kind), s.start, s.end)), ",")


def count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s.kind == KINDS.index(kind))).cast("long")


def cut(text: Column, ranges: Column, levels: int = 2, block: int = 64) -> Column:
    """The parts of ``text`` that ``ranges`` (start, end; sorted, apart from
    each other; bound) lists. Finding a code point takes a scan from the
    text's begin, so stretches with many parts are cut out first."""
    def within(text: Column, offset: Column, ranges: Column, levels: int) -> Column:
        if not levels:
            return F.transform(ranges, lambda r: F.substr(text, r.start - offset + 1, r.end - r.start))
        many = block ** levels
        return F.flatten(F.transform(
            F.sequence(F.lit(0), F.size(ranges) - 1, F.lit(many)),
            lambda k: bound(F.slice(ranges, k + 1, F.lit(many)), lambda part: bound(
                F.get(part, F.lit(0)).start, lambda first: bound(
                    F.substr(text, first - offset + 1, F.element_at(part, -1).end - first),
                    lambda stretch: within(stretch, first, part, levels - 1))))))
    return within(text, F.lit(0), ranges, levels)


def redacted(text: str, spans: str, mark: str = "[SECRET]") -> Column:
    """The text with every span (overlapping ones as one) replaced. A span
    that begins where all earlier ones have ended begins a replacement;
    what lies between is kept."""
    def kept(s: Column) -> Column:
        def ranges(reach: Column) -> Column:
            gaps = F.zip_with(s, reach, lambda x, r: F.struct(r.alias("start"), x.start.alias("end"), x.end.alias("to")))
            # spans that only touch stay two replacements, with nothing between them
            between = F.filter(gaps, lambda g: g.start <= g.end)
            end = F.struct(F.array_max(F.transform(s, lambda x: x.end)).alias("start"),
                           F.length(text).alias("end"), F.lit(0).alias("to"))
            return F.concat(between, F.array(end))
        ends = F.transform(s, lambda x: x.end)
        return bound(bound(ends, lambda e: bound(running(e, lambda a, v: F.greatest(a, v), F.lit(0)), ranges)),
                     lambda r: F.array_join(cut(F.col(text), r), mark))
    return F.when(F.size(spans) > 0, bound(F.col(spans), kept)).otherwise(F.col(text))
