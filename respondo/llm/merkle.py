"""Merkle manifest of a data set by time-forward processing.

Every row is a leaf: the SHA-256 of its columns. Per group (language) the
leaves ascend by id, and runs of ``FAN`` nodes become their hash until one
node, the group's subroot, remains; the subroots become the root likewise.

Digests travel as messages in the order of the nodes' labels (level, place).
A node takes its children's messages out of a priority queue, hashes them
and puts a message for its parent in. The queue is external: a chunk of
``FAN ** LEVELS`` neighbouring nodes is worked on in one stream of a task,
and the message that leaves a chunk is a row of a written table, which the
next round shuffles and sorts by label. A reversed sweep then takes the
labels from the root down: a node's message to a child is the child's
siblings followed by what the node itself got, so that a leaf receives the
suffixes of its proof from its own level up to the root. Chunks, not groups,
are dealt to tasks, so one group may hold any share of the rows, and a
task holds one chunk at a time.

Defined results: a null column is written ``-``; rows with a null id come
first and are never tampered with; rows with equal ids are ordered by their
digest; equal rows are separate leaves, of which any may come first; a null
group is a group of its own, before the others; an empty table gives no
rows; columns other than the hashed ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from respondo.llm.common import scan_positions, stage

FAN, LEVELS = 8, 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "lefts array<string>, rights array<string>"


def field(c: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    c = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))


def leaf(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


def ascii_lower(c: Column) -> Column:
    letters = "".join(map(chr, range(65, 91)))
    return F.translate(c, letters, letters.lower())


def height(size: int, fan: int) -> int:
    """Levels above the leaves until one node remains."""
    steps = 0
    while size > 1:
        size, steps = -(-size // fan), steps + 1
    return steps


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``pos`` (0, 1, ... in the order of ``order`` inside ``tree``) and
    ``size`` (rows of the tree). Rows are sorted over all tasks; what is
    summed up has one row per tree and task."""
    placed = stage(rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
                   .select("*", F.spark_partition_id().alias("__part"),
                           F.monotonically_increasing_id().alias("__at")), "sorted")
    spans = stage(placed.groupBy("tree", "__part").agg(
        F.min("__at").alias("__first"), F.count("*").alias("__n")), "spans")
    whole = Window.partitionBy("tree")
    earlier = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("tree", "__part", "__first", F.sum("__n").over(whole).alias("size"),
                         F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    return (placed.join(spans, ["tree", "__part"])
            .withColumn("pos", F.col("__at") - F.col("__first") + F.col("__before"))
            .drop("__part", "__at", "__first", "__before"))


def chunked(nodes: DataFrame, chunk: int) -> DataFrame:
    """Rows by chunk and place: whole chunks one after another in a task."""
    return (nodes.withColumn("chunk", F.coalesce(F.col("chunk"), F.floor(F.col("pos") / chunk)))
            .repartition("tree", "chunk").sortWithinPartitions("tree", "chunk", "pos"))


def kernels(fan: int, levels: int):
    """The work on one chunk: ``rise`` towards the root, ``sink`` towards
    the leaves, and the stream of chunks of a task."""
    import hashlib
    import heapq

    def steps_of(size: int) -> int:
        return min(levels, height(size, fan))

    def digest(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
        """The rows of one chunk after another."""
        held, key = [], None
        for batch in batches:
            for row in batch.to_pylist():
                at = (row["tree"], row["chunk"])
                if at != key and held:
                    yield held
                    held = []
                key = at
                held.append(row)
        if held:
            yield held

    def rise(digests: list[str], steps: int) -> tuple[str, dict]:
        """The chunk's top digest, and what each inner node received: its
        children's digests, by label (level, place)."""
        if not steps:
            return digests[0], {}
        queue = [(1, i // fan, i, d) for i, d in enumerate(digests)]  # sorted, hence a heap
        received, top = {}, ""
        while queue:
            level, place = queue[0][:2]
            children = []
            while queue and queue[0][:2] == (level, place):
                children.append(heapq.heappop(queue)[3])
            received[level, place] = children
            top = digest("".join(children))
            if level < steps:
                heapq.heappush(queue, (level + 1, place // fan, place, top))
        return top, received

    def sink(received: dict, steps: int, suffix: tuple) -> dict[int, tuple]:
        """The reversed sweep: (siblings to the left, to the right, rest) for
        every leaf of the chunk, as linked pairs that share their rests."""
        queue, out = [(-steps, 0, suffix)], {}
        while queue:
            level, place, rest = heapq.heappop(queue)
            if not level:
                out[place] = rest
                continue
            children = received[-level, place]
            for i in range(len(children)):
                near = ("".join(children[:i]), "".join(children[i + 1:]), rest)
                heapq.heappush(queue, (level + 1, place * fan + i, near))
        return out

    return steps_of, digest, runs, rise, sink


def climb(nodes: DataFrame, fan: int, levels: int) -> DataFrame:
    """One round up: ``nodes`` (tree, pos, size, digest) -> the chunk tops,
    numbered in their order."""
    steps_of, _, runs, rise, _ = kernels(fan, levels)
    chunk = fan ** levels

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for rows in runs(batches):
            first = rows[0]
            top = rise([r["digest"] for r in rows], steps_of(first["size"]))[0]
            out.append({"tree": first["tree"], "pos": first["chunk"],
                        "size": -(-first["size"] // chunk), "digest": top})
            if len(out) >= 4096:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("size", pa.int64()),
                        ("digest", pa.string())])
    return chunked(nodes.select("tree", F.lit(None).cast("long").alias("chunk"), "pos", "size", "digest"),
                   chunk).mapInArrow(kernel, "tree string, pos long, size long, digest string")


def descend(nodes: DataFrame, messages: DataFrame, fan: int, levels: int,
            leaves: bool, with_proof: bool = False) -> DataFrame:
    """One round down: ``messages`` (tree, pos, lefts, rights, subroot) for
    the chunk tops -> the same for every node of the chunks; for ``leaves``
    the hash of the proof and the root folded from ``tampered``."""
    steps_of, digest, runs, rise, sink = kernels(fan, levels)
    blank = lambda kind: F.lit(None).cast(kind)
    carried = ["doc_id", "tampered"] if leaves else []
    down = nodes.select("tree", blank("long").alias("chunk"), "pos", "size", "digest", *carried,
                        blank("array<string>").alias("lefts"), blank("array<string>").alias("rights"),
                        blank("string").alias("subroot"))
    told = messages.select("tree", F.col("pos").alias("chunk"), F.lit(-1).cast("long").alias("pos"),
                           blank("long").alias("size"), blank("string").alias("digest"),
                           *[blank("long" if c == "doc_id" else "string").alias(c) for c in carried],
                           "lefts", "rights", "subroot")

    def listed(suffix: tuple) -> tuple[list[str], list[str]]:
        lefts, rights = [], []
        while suffix:
            left, right, suffix = suffix
            lefts.append(left)
            rights.append(right)
        return lefts, rights

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for rows in runs(batches):
            told, rows = rows[0], rows[1:]  # the message sorts before the nodes
            suffix: tuple = ()
            for left, right in zip(reversed(told["lefts"]), reversed(told["rights"])):
                suffix = (left, right, suffix)
            steps = steps_of(rows[0]["size"])
            received = rise([r["digest"] for r in rows], steps)[1]
            for i, got in sink(received, steps, suffix).items():
                r = rows[i]
                lefts, rights = listed(got)
                new = {"tree": r["tree"], "pos": r["pos"], "lefts": lefts, "rights": rights,
                       "subroot": told["subroot"]}
                if leaves:
                    new |= {"doc_id": r["doc_id"], "leaf": r["digest"],
                            "proof_sha256": digest("".join(a + b for a, b in zip(lefts, rights)))}
                    fold = r["tampered"]
                    for left, right in zip(lefts, rights):
                        fold = digest(left + fold + right)
                    new["folded_root"] = fold
                out.append(new)
            if len(out) >= 4096:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema=schema)

    proof = [("lefts", pa.list_(pa.string())), ("rights", pa.list_(pa.string()))]
    if leaves:
        fields = [("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()),
                  ("proof_sha256", pa.string()), ("folded_root", pa.string()),
                  *(proof if with_proof else [])]
        spark_schema = ("doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string"
                        + (", " + PROOF if with_proof else ""))
    else:
        fields = [("tree", pa.string()), ("pos", pa.int64()), *proof, ("subroot", pa.string())]
        spark_schema = f"tree string, pos long, {PROOF}, subroot string"
    schema = pa.schema(fields)
    return chunked(down.unionByName(told), fan ** levels).mapInArrow(kernel, spark_schema)


def tree_rounds(nodes: DataFrame, fan: int, levels: int) -> list[DataFrame]:
    """The tables of all rounds: the nodes, their chunk tops, the tops of
    these, ... until every tree has one node."""
    most = nodes.agg(F.max("size")).first()[0] or 0
    tables = [nodes]
    for _ in range(-(-height(most, fan) // levels)):
        tables.append(stage(climb(tables[-1], fan, levels), "tops"))
    return tables


def manifest(docs: DataFrame, tampered_text: Column | None = None, columns: tuple[str, ...] = COLUMNS,
             id_col: str = "doc_id", group_col: str = "lang", text_col: str = "text", fan: int = FAN,
             levels: int = LEVELS, with_proof: bool = False) -> DataFrame:
    """One row per row of ``docs``: its leaf, its group's subroot, the root,
    the hash of its proof, and the root folded from the leaf that
    ``tampered_text`` gives (null: the original) and the proof.
    ``with_proof`` adds the proof: per level, the siblings to the left and
    to the right, joined."""
    plain = [F.col(c) for c in columns]
    changed = [tampered_text if c == text_col else F.col(c) for c in columns]
    own = docs.select(*dict.fromkeys([*columns, id_col, group_col]))
    # a row's place in its file tells equal rows apart, so that a crowd of them is cut between tasks
    rows = scan_positions(own, "__file", "__row").select(
        # a null group sorts before all others, which keep their byte order
        F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("")).alias("tree"),
        F.col(id_col).cast("long").alias("doc_id"), leaf(plain).alias("digest"),
        (F.lit(None) if tampered_text is None else
         F.when(tampered_text.isNotNull(), leaf(changed))).cast("string").alias("tampered"),
        F.xxhash64("__file").alias("__file"), "__row")
    leaves = stage(ranked(rows, ["doc_id", "digest", "__file", "__row"])
                   .withColumn("tampered", F.coalesce("tampered", "digest"))
                   .drop("__file", "__row"), "leaves")
    groups = tree_rounds(leaves, fan, levels)
    tops = groups[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    tops = stage(ranked(tops, ["name"]), "subroots")
    forest = tree_rounds(tops, fan, levels)
    top = forest[-1].select("digest").first()
    root = top[0] if top else None
    none = F.array().cast("array<string>")
    down = forest[-1].select("tree", "pos", none.alias("lefts"), none.alias("rights"),
                             F.lit(None).cast("string").alias("subroot"))
    for nodes in reversed(forest[:-1]):
        down = stage(descend(nodes, down, fan, levels, leaves=False), "suffixes")
    # what a subroot got goes to the top of its group's tree
    down = tops.join(down.drop("subroot"), ["tree", "pos"]).select(
        F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), "lefts", "rights",
        F.col("digest").alias("subroot"))
    for nodes in reversed(groups[1:-1]):
        down = stage(descend(nodes, down, fan, levels, leaves=False), "suffixes")
    out = descend(groups[0], down, fan, levels, leaves=True, with_proof=with_proof)
    return out.select("doc_id", "leaf", "subroot", F.lit(root).cast("string").alias("root"), "proof_sha256",
                      "folded_root", (F.col("folded_root") == F.lit(root)).alias("verified"),
                      *(["lefts", "rights"] if with_proof else []))
