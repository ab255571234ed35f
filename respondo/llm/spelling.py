"""Spelling variants: words one edit apart, by a relational trie frontier.

Words are counted over whole texts. The words that occur often enough form
a trie, kept as a table: one row per node that ends a word or has several
children, with its edges (label, child). An edge's label holds all letters
up to the next such node, so that a long run of letters is one edge.

The search is a frontier of states (word, position, node, edits), joined
with the edge table level by level. A state without an edit walks along its
own word. At the node where another word leaves that path, the edit takes
place: a letter is replaced, or the last of a run of equal letters is left
out (an insertion is a deletion seen from the longer word). A state with an
edit must follow the rest of its word exactly; when it ends where a word
ends, the two are neighbours. Each pair is found once. An edge tells which
(length, last two letters) occur below it, as 64 bits, and a state enters
it only if what it has to end with may be there.

Every word starts at the root and passes the first letters' nodes, so these
are hot: a node's row is repeated once per ``block`` words below it, and a
state takes one of the copies by its word's hash. No list of the words of a
node, no pair of words but neighbours is ever formed.

Defined results: a null text has no words; a null id counts as an empty
text in the hash; repeated rows count again; the largest count among equal
counts goes to the smallest word in code-point order; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from respondo.llm.common import slices, stage, text_array, word_codes

#: Rows a task gathers before it adds up equal words.
HELD = 400_000
#: Words below a node for each copy of its row.
BLOCK = 20_000

#: Nodes with several copies (they are broadcast); ``BLOCK`` grows where there would be more.
MOST_HOT = 50_000


def letters_only(texts: pa.Array) -> pa.Array:
    """The texts with everything but A-Z, a-z and U+00C0 to U+00FF blanked
    and A-Z lower-cased. In UTF-8 these characters are the ASCII letters and
    0xC3 with the byte behind it, so lengths in bytes stay."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    base, end = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[base:end]
    to = np.full(256, 32, np.uint8)
    to[97:123] = np.arange(97, 123)
    to[65:91] = np.arange(97, 123)
    to[0xC3] = 0xC3
    out = to[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    out[lead + 1] = raw[lead + 1]
    return pa.LargeStringArray.from_buffers(
        len(texts), pa.py_buffer((offsets - base).astype(np.int64).tobytes()), pa.py_buffer(out.tobytes()))


def crc_shift_table(n_bytes: int) -> np.ndarray:
    """What ``n_bytes`` more bytes do to a CRC-32: the effect on each byte of
    the old value, as a 4 x 256 table (the CRC is linear)."""
    one = np.zeros((4, 8), np.uint32)
    pad = bytes(n_bytes)
    zero = zlib.crc32(pad)
    for k in range(4):
        for b in range(8):
            one[k, b] = zlib.crc32(pad, 1 << (8 * k + b)) ^ zero
    out = np.zeros((4, 256), np.uint32)
    for b in range(8):
        out ^= np.where(np.arange(256) >> b & 1, one[:, b:b + 1], np.uint32(0)).astype(np.uint32)
    return out


def shifted(crcs: np.ndarray, n_bytes: int, tables: dict) -> np.ndarray:
    if n_bytes not in tables:
        tables[n_bytes] = crc_shift_table(n_bytes)
    t = tables[n_bytes]
    return (t[0][crcs & 255] ^ t[1][crcs >> 8 & 255] ^ t[2][crcs >> 16 & 255] ^ t[3][crcs >> 24])


def run_counts(ids: list, texts: pa.Array, every: int, least_len: int, tables: dict) -> pa.Table:
    """(word, n) of one slice: runs, some with a letter deleted. The hash of
    an id and a run is put together from the two hashes, for all runs of a
    length at once."""
    codes, first, words = word_codes(letters_only(texts))
    own = np.fromiter((zlib.crc32(w) for w in words.cast(pa.large_binary()).to_pylist()),
                      np.uint32, len(words))
    sizes = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    chars = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    before = np.fromiter((zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids), np.uint32, len(ids))
    n = np.bincount(codes, minlength=len(words))
    size_of = sizes[codes]
    order = np.argsort(size_of, kind="stable")
    cuts = np.flatnonzero(np.diff(size_of[order], prepend=-1, append=-1))
    changed = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        at = order[a:b]
        h = shifted(before, int(size_of[at[0]]), tables)[owner[at]] ^ own[codes[at]]
        hit = np.flatnonzero(h % every == 0)
        for code, value in zip(codes[at[hit]].tolist(), h[hit].tolist()):
            n[code] -= 1
            if chars[code] > least_len:
                word, k = words[code].as_py(), value % int(chars[code])
                changed.append(word[:k] + word[k + 1:])
    real = (n > 0) & (chars >= least_len)
    return pa.table({"word": pa.concat_arrays([words.filter(pa.array(real)).cast(pa.string()),
                                               pa.array(changed, pa.string())]),
                     "n": pa.array(np.concatenate([n[real], np.ones(len(changed), np.int64)]))})


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 199,
                least_len: int = 6, least_n: int = 5) -> DataFrame:
    """(word, n): the distinct words of at least ``least_len`` code points
    that occur ``least_n`` times or more in all texts."""
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict = {}
        held, rows = [], 0

        def added() -> list[pa.RecordBatch]:
            total = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")])
            return pa.table({"word": total["word"], "n": total["n_sum"]}).combine_chunks().to_batches()

        for batch in batches:
            for part in slices(batch, "text"):
                held.append(run_counts(part.column("id").to_pylist(), text_array(part.column("text")),
                                       every, least_len, tables))
                rows += held[-1].num_rows
                if rows >= HELD:
                    yield from added()
                    held, rows = [], 0
        if held:
            yield from added()

    return (docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(kernel, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n))


def tail_bit(length: Column, ending: Column) -> Column:
    """One of 64 bits for a word's length and its last two letters."""
    return F.call_function("shiftleft", F.lit(1).cast("long"),
                           F.pmod(F.xxhash64(length, ending), F.lit(64)).cast("int"))


def node_name(prefix: Column) -> Column:
    """A node is named by its prefix; a long one by a digest (with a
    character that no word has)."""
    return F.when(F.length(prefix) <= 24, prefix).otherwise(F.concat(F.lit("#"), F.sha2(prefix, 256)))


def words_prefixes(words: DataFrame) -> DataFrame:
    """(key, depth, node, next, tail) for every prefix of every word: the
    word's name, the prefix's length and name, the letter behind it (none:
    the word ends) and the word's ``tail_bit``. Long words are hashed letter
    by letter, so that their cost stays linear."""
    named = words.select("word", node_name(F.col("word")).alias("key"),
                         tail_bit(F.length("word"), F.expr("right(word, 2)")).alias("tail"))
    short = (named.where(F.length("word") <= 24)
             .withColumn("depth", F.explode(F.sequence(F.lit(0), F.length("word"))))
             .select("key", "depth", F.expr("substring(word, 1, depth)").alias("node"),
                     F.expr("substring(word, depth + 1, 1)").alias("next"), "tail"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                word, out, h = row["word"], [], hashlib.sha256()
                for depth, letter in enumerate([*word, ""]):
                    name = word[:depth] if depth <= 24 else "#" + h.copy().hexdigest()
                    out.append({"key": row["key"], "depth": depth, "node": name, "next": letter,
                                "tail": row["tail"]})
                    h.update(letter.encode())
                    if len(out) == 10_000 or depth == len(word):
                        yield pa.RecordBatch.from_pylist(out, schema=schema)
                        out = []

    schema = pa.schema([("key", pa.string()), ("depth", pa.int32()), ("node", pa.string()),
                        ("next", pa.string()), ("tail", pa.int64())])
    return short.unionByName(named.where(F.length("word") > 24).mapInArrow(
        kernel, "key string, depth int, node string, next string, tail long"))


def trie(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows (node, copy, edges): the nodes that end a word or have several
    children, each ``copy`` with all edges by first letter (at most one per
    letter of the alphabet). An edge has its label, its child, the child's
    number of copies, the word that ends there, and what ends below it."""
    prefixes = words_prefixes(words)
    below = F.bit_or("tail").alias("below")
    by_node = stage(prefixes.groupBy("node", "next").agg(F.count("*").alias("n"), below)
                    .groupBy("node").agg(F.count("*").alias("ways"), F.sum("n").alias("n"),
                                         F.bit_or("below").alias("below"), F.max(F.col("next") == "").alias("ends"))
                    .where("ways > 1 or ends or node = ''"), "nodes")
    # at most MOST_HOT nodes have more than one copy, whatever the number of words
    block = max(block, (by_node.agg(F.sum("n")).first()[0] or 0) // MOST_HOT)
    nodes = by_node.select("node", "below", F.ceil(F.col("n") / block).cast("int").alias("copies"))
    hot = F.broadcast(nodes.where("copies > 1"))
    # every word lists the nodes it passes: neighbours in the list are edges
    at_node = prefixes.select("key", "depth", "node")
    passed = (at_node.join(hot, "node")
              .unionByName(at_node.join(hot.select("node"), "node", "left_anti")
                           .join(nodes.where("copies = 1"), "node"))
              .groupBy("key").agg(F.sort_array(F.collect_list(
                  F.struct("depth", "node", "copies", "below"))).alias("path"))
              .join(words.select("word", node_name(F.col("word")).alias("key")), "key"))
    hops = F.explode(F.zip_with(
        F.slice("path", F.lit(1), F.size("path") - 1), F.slice("path", F.lit(2), F.size("path") - 1),
        lambda a, b: F.struct(a.node.alias("node"), a.depth.alias("depth"), b.alias("to"))))
    edges = (passed.select("word", hops.alias("hop"))
             .select(F.col("hop.node").alias("node"), F.col("hop.to.node").alias("child"), F.struct(
                 F.expr("substring(word, hop.depth + 1, hop.to.depth - hop.depth)").alias("label"),
                 F.col("hop.to.node").alias("child"), F.col("hop.to.copies").alias("copies"),
                 F.col("hop.to.below").alias("below")).alias("edge"),
                 F.when(F.col("hop.to.depth") == F.length("word"), F.col("word")).alias("ending"))
             .groupBy("node", "child").agg(F.first("edge").alias("edge"), F.max("ending").alias("ending"))
             .groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct(
                 F.expr("substring(edge.label, 1, 1)"), F.struct("edge.*", "ending")))).alias("edges")))
    return nodes.select("node", "copies").join(edges, "node").select(
        "node", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), "edges")


def neighbours(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of different words that differ by one inserted, deleted
    or replaced letter; each pair once."""
    nodes = stage(trie(words.select("word"), block), "trie")

    def deal(copies: Column) -> Column:
        return F.pmod(F.xxhash64("word"), copies).cast("int")

    top = nodes.where("node = ''").agg(F.max("copy")).first()[0]
    frontier = words.select("word", F.lit(0).alias("position"), F.lit("").alias("node"),
                            deal(F.lit((top or 0) + 1)).alias("copy"), F.lit(0).alias("edits"),
                            F.lit(-1).cast("long").alias("tail"))
    size, e = F.length("word"), F.col("edge")
    rest = F.col("position") + F.length(e.label)
    # what the label has to be equal to, by the kind of step
    same = F.expr("substring(word, position + 1, length(edge.label)) = edge.label")
    other = F.expr("position < length(word) and substring(edge.label, 1, 1) > substring(word, position + 1, 1)"
                   " and substring(word, position + 2, length(edge.label) - 1) = substring(edge.label, 2)")
    left_out = F.expr("substring(edge.label, 1, 1) <> substring(word, position + 1, 1)"
                      " and substring(word, position + 2, length(edge.label)) = edge.label")
    # an edit before the last two letters leaves them; else any ending may follow (all bits)
    any_end = size - F.col("position") < 3
    ending = F.expr("right(word, 2)")
    tail = {k: F.when(any_end, F.lit(-1).cast("long")).otherwise(tail_bit(n, ending))
            for k, n in (("as_long", size), ("shorter", size - 1))}

    def may_end(tail: Column) -> Column:
        return e.below.bitwiseAND(tail) != 0

    def step(at: Column, edits: int, tail: Column) -> Column:
        return F.struct(at.alias("position"), F.lit(edits).alias("edits"), tail.cast("long").alias("tail"),
                        F.when((F.lit(edits) == 1) & (at == size), e.ending).alias("near"))

    unedited, edited = F.col("edits") == 0, F.col("edits") == 1
    steps = F.array(
        F.when(unedited & same & (rest < size), step(rest, 0, F.lit(-1))),
        # the last letter is left out where a word ends before it
        F.when(unedited & same & (rest == size - 1), F.struct(
            size.alias("position"), F.lit(1).alias("edits"), F.lit(-1).cast("long").alias("tail"),
            e.ending.alias("near"))),
        F.when(unedited & other & may_end(F.col("as_long")), step(rest, 1, F.col("as_long"))),
        F.when(unedited & left_out & may_end(F.col("shorter")), step(rest + 1, 1, F.col("shorter"))),
        F.when(edited & same & may_end(F.col("tail")), step(rest, 1, F.col("tail"))))
    # an edited state has one way to go, an unedited one may take every edge
    ways = F.when(unedited, F.map_values("edges")).otherwise(
        F.array(F.try_element_at("edges", F.expr("substring(word, position + 1, 1)"))))
    found = []
    while True:
        met = stage(frontier.join(nodes, ["node", "copy"])
                    .select("word", "position", "edits", "tail", F.explode(ways).alias("edge"),
                            *[c.alias(k) for k, c in tail.items()])
                    .where("edge is not null")
                    .select("word", F.col("edge.child").alias("node"), deal(e.copies).alias("copy"),
                            F.explode(steps).alias("s"))
                    .where("s.near is not null or s.position < length(word)")
                    .select("word", "node", "copy", "s.*"), "frontier")
        found.append(met.where("near is not null").select(F.col("word").alias("a"), F.col("near").alias("b")))
        frontier = met.where("near is null").drop("near")
        if not frontier.limit(1).count():
            break
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def variants(words: DataFrame, times: int = 5, block: int = BLOCK) -> DataFrame:
    """``words`` (word, n) with ``n_near``, the number of neighbours,
    ``form``, the most frequent neighbour (``form_n`` occurrences) if it
    occurs at least ``times`` times as often, and ``root``, the last word
    that the forms lead to. The counts grow along the forms, so they end;
    each round doubles the length of the jumps."""
    pairs = stage(neighbours(words, block), "neighbours")
    both = pairs.union(pairs.select("b", "a"))
    named = words.select(F.col("word").alias("b"), F.col("n").alias("near_n"))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("b"))).alias("best")
    near = both.join(named, "b").groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), best)
    fits = -F.col("best.less") >= times * F.col("n")
    out = stage(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(fits, F.col("best.b")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")), "forms")
    jumps = out.where("form is not null").select("word", F.col("form").alias("to"))
    while True:
        on = jumps.select(F.col("word").alias("to"), F.col("to").alias("further"))
        after = stage(jumps.join(on, "to", "left").select(
            "word", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")), "jumps")
        jumps = after.drop("moved")
        if not after.where("moved").limit(1).count():
            break
    return out.join(jumps, "word", "left").select(
        "word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")
