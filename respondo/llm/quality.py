"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the
measurements and one failure bit per rule; a policy is a named, versioned
set of rules (a mask), applied later without reading a text again. What
each rule costs (ablation) comes from counting distinct masks and combining
them bit by bit.

Defined results: a null text has no words (like an empty one); repeated
rows are measured each on their own; an empty table gives no rows; input
columns are kept, except that a column named like a measurement or the
ledger's ``failed`` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from respondo.llm.common import gather, slices, sums, text_array, word_codes

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "n_lines", "n_alpha_words")
SYMBOLS = r"[#*$%&|<>]"


def window_codes(codes: np.ndarray, distinct: int) -> np.ndarray:
    """A number for each three-word window; equal windows, equal numbers.
    Pairs are numbered anew when three codes don't fit 63 bits."""
    if len(codes) < 3:
        return np.zeros(0, np.int64)
    pair = codes[:-1] * distinct + codes[1:]
    if distinct ** 3 >= 1 << 62:
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    return pair[:-1] * distinct + codes[2:]


def repeated_words(codes: np.ndarray, first: np.ndarray, distinct: int) -> np.ndarray:
    """Per text: words inside three-word windows that occur twice or more in it."""
    n = np.diff(first)
    windows = np.maximum(n - 2, 0)
    owner = np.repeat(np.arange(len(n)), windows)
    at = gather(first[:-1], windows)
    number = window_codes(codes, max(1, distinct))[at] if len(at) else np.zeros(0, np.int64)
    order = np.argsort(number, kind="stable")  # texts stay in order among equal windows
    a, b = number[order], owner[order]
    same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    again = np.zeros(len(a), bool)
    again[1:] |= same
    again[:-1] |= same
    twice = at[order[again]]
    covered = np.zeros(len(codes), bool)
    for k in range(3):
        covered[twice + k] = True
    return sums(covered, first)


def duplicate_lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Per text: lines with a word, and those equal to an earlier line."""
    parts = pc.split_pattern(texts, "\n")
    first = parts.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    first = first - first[0]
    lines = parts.flatten()
    full = pc.not_equal(pc.binary_length(pc.ascii_trim_whitespace(lines)), 0)
    real = full.to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))[real]
    codes = lines.filter(full).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    seen = np.unique(owner * (len(codes) + 1) + codes)
    distinct = np.bincount(seen // (len(codes) + 1), minlength=len(first) - 1)
    n = sums(real, first)
    return n, n - distinct


def measure(texts: pa.Array) -> list[np.ndarray]:
    """The columns of ``MEASURES`` for one slice of texts."""
    codes, first, words = word_codes(texts)
    chars = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    alpha = pc.match_substring_regex(words, r"\p{L}").to_numpy(zero_copy_only=False)
    symbols = pc.count_substring_regex(texts, SYMBOLS).to_numpy(zero_copy_only=False)
    lines, dup_lines = duplicate_lines(texts)
    per_word = lambda x: sums(x[codes] if len(codes) else np.zeros(0, np.int64), first)
    return [np.diff(first), per_word(chars), symbols, dup_lines,
            repeated_words(codes, first, len(words)), lines, per_word(alpha)]


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the columns of ``MEASURES`` (long)."""
    kept = [c for c in docs.columns if c not in MEASURES]
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}"
                       for f in docs.select(*[F.col(f"`{c}`") for c in kept]).schema.fields)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, text_col):
                new = measure(text_array(rows.column(text_col)))
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, *(pa.array(x.astype(np.int64)) for x in new)],
                    [*rows.schema.names, *MEASURES])

    return (docs.select(*[F.col(f"`{c}`") for c in kept])
            .mapInArrow(kernel, schema + "".join(f", {m} long" for m in MEASURES)))


def rules() -> dict[str, Column]:
    """Failure conditions over the measurements, in bit order. Rules are
    only ever added at the end, so that stored masks keep their meaning."""
    n, chars, symbols = F.col("n_words"), F.col("word_chars"), F.col("n_symbols")
    return {
        "few_words": n < 50,
        "repeated_windows": 100 * F.col("n_repeat_words") > 50 * n,
        "short_words": chars < 2 * n,
        "long_words": chars > 20 * n,
        "symbols": 10 * symbols > n,
        "duplicate_lines": 100 * F.col("n_dup_lines") > 50 * F.col("n_lines"),
        "few_letters": 100 * F.col("n_alpha_words") < 60 * n,
    }


#: Versioned policies: the rules that reject a document.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "short_words", "long_words", "symbols",
           "duplicate_lines", "few_letters"),
}


def mask(policy: str) -> int:
    names = list(rules())
    return sum(1 << names.index(r) for r in POLICIES[policy])


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the measurements and ``failed``, a bit per rule."""
    bits = [F.when(bad, F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
            for i, bad in enumerate(rules().values())]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measured(docs, text_col).withColumn("failed", total)


def passes(policy: str) -> Column:
    return F.col("failed").bitwiseAND(F.lit(mask(policy))) == 0


def ablation(book: DataFrame, policy: str) -> DataFrame:
    """Per rule of the policy: documents that fail it, that fail only it
    (kept without it), and that the whole policy rejects. The ledger is
    first counted by mask, so at most 2^rules rows are combined."""
    names, all_bits = list(rules()), mask(policy)
    by_mask = (book.groupBy(F.col("failed").bitwiseAND(F.lit(all_bits)).alias("m"))
               .agg(F.count("*").alias("n")))
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"),
                                        F.lit(1 << names.index(r)).cast("long").alias("bit"))
                               for r in POLICIES[policy]]))
    hit = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    return (by_mask.select("m", "n", each.alias("r"))
            .groupBy(F.col("r.rule").alias("rule"))
            .agg(hit(F.col("m").bitwiseAND(F.col("r.bit")) != 0).alias("fails"),
                 hit(F.col("m") == F.col("r.bit")).alias("fails_only_this"),
                 hit(F.col("m") != 0).alias("rejected")))
