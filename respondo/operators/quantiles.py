"""Exact percentiles without gathering a column in one task.

Spark's exact ``percentile`` keeps every distinct value of a group in one
aggregation buffer, and a global percentile ends in one task holding the
whole column. This operator returns the same values (linear interpolation
at position ``p * (n - 1)``, like ``percentile`` / ``quantile_cont``) by
narrowing down instead:

1. one aggregation: exact counts and mergeable ``percentile_approx``
   sketches at ``p -/+ margin`` per group and column give a bracket
   ``[lo, hi]`` for every target (group, column, probability);
2. one aggregation counts, per target, the rows below ``lo``, up to
   ``hi``, equal to ``lo`` and strictly inside, which proves the bracket
   holds the needed ranks (a failing bracket is opened, so the result
   never depends on the sketch); runs of values equal to a bracket end are
   resolved from these counts alone, so a hot value costs nothing;
3. while the inside of a bracket still holds more than ``max_band`` rows,
   a sketch over just those rows narrows it (then it is verified again);
4. the rows strictly inside each bracket are ranked by a window
   partitioned per target; the (at most two) rows at the needed ranks come
   back and are interpolated.

All passes read the input in its wide form (no row multiplication) from a
stage table of the needed columns, so that a plan with joins runs once and
nothing is held in executor memory; brackets are literals in the plan, and only brackets, counts and the
picked values reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from respondo.session import staged

_STEPS = 256
_REFINE = [i / _STEPS for i in range(_STEPS + 1)]
INF = float("inf")


def exact_percentiles(df: DataFrame, columns: list[str], probs: list[float],
                      by: list[str] | None = None, accuracy: int = 10_000,
                      max_band: int = 100_000, max_rounds: int = 6,
                      written: bool = False, some: DataFrame | None = None) -> DataFrame:
    """``(by..., feature, p_idx, value)``: the exact percentile of each
    column (per group) for each probability in ``probs``; NULL and NaN are
    left out. ``written`` tells that ``df`` reads a stage table already.
    ``some`` (without ``by``) are rows of ``df`` in no special order, e.g.
    those of a hash range: the first brackets come from them instead of a
    sketch of all rows, and are proved or opened like any other."""
    by = list(by or [])
    if by and some is not None:
        raise ValueError("rows to start from are for a whole table, not for groups")
    spark = df.sparkSession
    cols = list(columns)
    # read by every pass below
    numbers = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in cols]
    data = df.select(*by, *numbers)
    data = data if written else staged(data, "quantile-input")
    by_fields = list(data.select(*by).schema.fields) if by else []
    margin = 2.0 / accuracy if some is None else max(2.0 / accuracy, 2.0 / max(1, some.count()) ** 0.5)
    clamp = lambda v: min(1.0, max(0.0, v))
    grid = sorted({clamp(p + s * margin) for p in probs for s in (-1, 1)})
    # targets[(group, column, p_idx)] -> bracket state (small, on the driver)
    targets: dict[tuple, dict] = {}

    def ranks(p, n):
        pos = p * (n - 1)
        return {"pos": pos, "lp": int(pos // 1), "hp": int(-(-pos // 1))}

    if some is None:
        first = data.groupBy(*by).agg(*[
            agg for c in cols for agg in (
                F.count(F.col(c)).alias(f"n__{c}"),
                F.percentile_approx(c, grid, accuracy).alias(f"q__{c}"))]).collect()
        for r in first:
            g = tuple(r[b] for b in by)
            for c in cols:
                if not r[f"n__{c}"]:
                    continue
                qs = dict(zip(grid, r[f"q__{c}"]))
                for i, p in enumerate(probs):
                    targets[(g, c, i)] = {**ranks(p, r[f"n__{c}"]),
                                          "lo": qs[clamp(p - margin)], "hi": qs[clamp(p + margin)]}
    else:
        r = some.select(*numbers).agg(*[F.percentile_approx(c, grid, accuracy).alias(c) for c in cols]).first()
        for c in cols:
            qs = dict(zip(grid, r[c])) if r[c] else {}
            for i, p in enumerate(probs):
                targets[((), c, i)] = {"lo": qs.get(clamp(p - margin), -INF), "hi": qs.get(clamp(p + margin), INF)}

    out_schema = StructType(by_fields + [StructField("feature", StringType()),
                                         StructField("p_idx", IntegerType()),
                                         StructField("value", DoubleType())])
    if not targets:
        return spark.createDataFrame([], out_schema)
    groups = sorted({g for g, _, _ in targets}, key=repr)

    def in_group(g):
        cond = F.lit(True)
        for b, v in zip(by, g):
            cond = cond & (F.col(b).isNull() if v is None else (F.col(b) == F.lit(v)))
        return cond

    def bound(c, i, which):
        """The bracket end for column ``c``/probability ``i`` of each row's
        group: a literal (or a CASE over the few groups)."""
        if not by:
            t = targets.get(((), c, i))
            return F.lit(float(t[which]) if t else None).cast("double")
        expr = None
        for g in groups:
            t = targets.get((g, c, i))
            if t is None:
                continue
            cond, val = in_group(g), F.lit(float(t[which]))
            expr = F.when(cond, val) if expr is None else expr.when(cond, val)
        return expr

    def count_brackets():
        aggs = []
        for c in cols:
            x = F.col(c)
            aggs += [F.count(x).alias(f"n__{c}")]
            for i in range(len(probs)):
                lo, hi = bound(c, i, "lo"), bound(c, i, "hi")
                aggs += [F.count_if(x < lo).alias(f"b__{c}__{i}"),
                         F.count_if(x <= hi).alias(f"u__{c}__{i}"),
                         F.count_if(x == lo).alias(f"l__{c}__{i}"),
                         F.count_if((x > lo) & (x < hi)).alias(f"m__{c}__{i}")]
        got = {tuple(r[b] for b in by): r for r in data.groupBy(*by).agg(*aggs).collect()}
        opened = False
        for (g, c, i), t in list(targets.items()):
            r = got.get(g)
            if "pos" not in t:  # of ``some`` rows: how many there are of all is known only now
                if not (r and r[f"n__{c}"]):
                    del targets[(g, c, i)]
                    continue
                t.update(ranks(probs[i], r[f"n__{c}"]))
            below, upto, eq_lo, mid = [r[f"{k}__{c}__{i}"] if r else 0 for k in "bulm"]
            if below > t["lp"]:
                t["lo"], opened = -INF, True
            if upto < t["hp"] + 1:
                t["hi"], opened = INF, True
            t.update(below=below, eq_lo=eq_lo, mid=mid)
        return opened

    def inner_ranks(t):
        """1-based ranks of lp/hp among the rows strictly inside, or None
        when the rank falls on the run equal to a bracket end."""
        out = []
        for rank in (t["lp"], t["hp"]):
            r = rank - t["below"] + 1
            out.append(r - t["eq_lo"] if t["eq_lo"] < r <= t["eq_lo"] + t["mid"] else None)
        return out

    def inside(pairs):
        """(by..., feature, p_idx, x) for rows strictly inside the brackets
        of ``pairs`` (column, p_idx): the small share that needs ranks."""
        items = []
        for c, i in pairs:
            lo, hi = bound(c, i, "lo"), bound(c, i, "hi")
            hit = (F.col(c) > lo) & (F.col(c) < hi)
            items.append(F.when(hit, F.struct(F.lit(c).alias("feature"), F.lit(i).alias("p_idx"),
                                              F.col(c).alias("x"))))
        return data.select(*by, F.explode(F.array_compact(F.array(*items))).alias("t")) \
            .select(*by, "t.feature", "t.p_idx", "t.x")

    verified = False
    for _ in range(max_rounds):
        if count_brackets():
            continue
        verified = True
        big = {k for k, t in targets.items()
               if t["mid"] > max_band and any(r is not None for r in inner_ranks(t))}
        if not big:
            break
        rq = {(tuple(r[b] for b in by), r["feature"], r["p_idx"]): r["q"]
              for r in inside(sorted({(c, i) for _, c, i in big})).groupBy(*by, "feature", "p_idx")
              .agg(F.percentile_approx("x", _REFINE, accuracy).alias("q")).collect()}
        for k in big:
            t = targets[k]
            ra, rb = inner_ranks(t)
            mid = max(1, t["mid"])
            a = ((ra if ra is not None else 1) - 1) / mid
            b = (rb if rb is not None else mid) / mid
            q = rq.get(k)
            if q:
                t["lo"] = max(t["lo"], q[max(0, int(a * _STEPS) - 2)])
                t["hi"] = min(t["hi"], q[min(_STEPS, int(-(-b * _STEPS // 1)) + 2)])
        verified = False
    if not verified and count_brackets():
        count_brackets()   # opened brackets always hold their ranks

    need = {k: inner_ranks(t) for k, t in targets.items()}
    wanted = [(g, c, i, r) for (g, c, i), rs in need.items() for r in rs if r is not None]
    vals: dict[tuple, dict[int, float]] = {}
    if wanted:
        # one window partition per target: only its strictly-inside rows
        ranked = inside(sorted({(c, i) for _, c, i, _ in wanted})).withColumn(
            "rn", F.row_number().over(Window.partitionBy(*by, "feature", "p_idx").orderBy("x")))
        pick = spark.createDataFrame(
            sorted({tuple(list(g) + [c, i, r]) for g, c, i, r in wanted}, key=repr),
            StructType(by_fields + [StructField("feature", StringType()),
                                    StructField("p_idx", IntegerType()),
                                    StructField("rn", IntegerType())]))
        for r in ranked.join(F.broadcast(pick), [*by, "feature", "p_idx", "rn"]).collect():
            k = (tuple(r[b] for b in by), r["feature"], r["p_idx"])
            vals.setdefault(k, {})[r["rn"]] = r["x"]

    def value_at(k, t, rank, inner):
        if inner is not None:
            return vals[k][inner]
        return t["lo"] if rank - t["below"] + 1 <= t["eq_lo"] else t["hi"]

    result = []
    for k, t in targets.items():
        g, c, i = k
        ra, rb = need[k]
        v = value_at(k, t, t["lp"], ra)
        if t["hp"] != t["lp"]:
            v = (t["hp"] - t["pos"]) * v + (t["pos"] - t["lp"]) * value_at(k, t, t["hp"], rb)
        result.append(tuple(list(g) + [c, i, v]))
    return spark.createDataFrame(result, out_schema)


def percentiles_wide(df: DataFrame, columns: list[str], probs: list[float],
                     by: list[str] | None = None, **kw) -> DataFrame:
    """One row per (group, column) with ``q0, q1, ...`` columns."""
    by = list(by or [])
    long = exact_percentiles(df, columns, probs, by, **kw)
    return long.groupBy(*by, "feature").agg(*[
        F.max(F.when(F.col("p_idx") == i, F.col("value"))).alias(f"q{i}")
        for i in range(len(probs))])
