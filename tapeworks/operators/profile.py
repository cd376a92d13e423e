"""All statistics of a table's columns in one pass over it: a mergeable state for each series and run of rows.

A state is one array of doubles: rows, and of each column its values, extremes, mean and central moments up to the fourth, then the
co-moments of all pairs. Each task folds its batches into a state for each series and run it meets; states merge pairwise
(parallel updates of central moments, no sums of raw powers), so the result doesn't hang on where a column's zero lies.
A task's states are a few kB for each series and run; where there are many tasks, states of `FOLD` tasks merge first.
Series of at most `WHOLE` rows, whose states would be larger than they are, go without: each lies whole in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from tapeworks.functions.durable import durable
from tapeworks.operators.winsor import with_series
from tapeworks.schema import TINY

#: States that a task holds before it hands them on; tasks whose states are merged first.
HELD, FOLD = 2000, 64
STATE = "_s string, _run long, state array<double>"
#: Rows of a series up to which it is worked on whole by one task.
WHOLE = 10_000


@dataclass
class Shape:
    """Where a state of k columns has what."""

    k: int

    def __post_init__(self):
        self.i, self.j = np.triu_indices(self.k)
        self.length = 1 + 7 * self.k + len(self.i)

    def parts(self, s: np.ndarray) -> list[np.ndarray]:
        """Of states (one a row): rows; values, low, high, mean, m2, m3, m4 of each column; co-moments."""
        k = self.k
        return [s[:, :1], *(s[:, 1 + p * k : 1 + (p + 1) * k] for p in range(7)), s[:, 1 + 7 * k :]]

    def of(self, x: np.ndarray) -> np.ndarray:
        """The state of rows; not-a-number stands for a missing value."""
        there = ~np.isnan(x)
        n = there.sum(0)
        with np.errstate(all="ignore"):
            mean = np.where(there, x, 0.0).sum(0) / np.maximum(n, 1)
            d = x - mean  # missing values stay so: pairs of such a column have no co-moment
            z = np.where(there, d, 0.0)
            low, high = (f(np.where(there, x, e), axis=0, initial=e) for f, e in ((np.min, np.inf), (np.max, -np.inf)))
            z2 = z * z
            co = (d.T @ d)[self.i, self.j]
        return np.concatenate([[len(x)], n, low, high, mean, z2.sum(0), (z2 * z).sum(0), (z2 * z2).sum(0), co])

    def merged(self, states: np.ndarray) -> np.ndarray:
        """One state of several, two by two."""
        while len(states) > 1:
            odd = states[-1:] if len(states) % 2 else states[:0]
            states = np.concatenate([self._two(states[: len(states) // 2 * 2 : 2], states[1::2]), odd])
        return states[0]

    def _two(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ra, na, la, ha, ma, a2, a3, a4, ca = self.parts(a)
        rb, nb, lb, hb, mb, b2, b3, b4, cb = self.parts(b)
        with np.errstate(all="ignore"):
            n = np.maximum(na + nb, 1)
            d = np.where((na > 0) & (nb > 0), mb - ma, 0.0)
            mean = np.where(na > 0, ma, mb) + d * nb / n
            w = na * nb / n
            m2 = a2 + b2 + d**2 * w
            m3 = a3 + b3 + d**3 * w * (na - nb) / n + 3 * d * (na * b2 - nb * a2) / n
            m4 = a4 + b4 + d**4 * w * (na**2 - na * nb + nb**2) / n**2 + 6 * d**2 * (na**2 * b2 + nb**2 * a2) / n**2 + 4 * d * (na * b3 - nb * a3) / n
            co = ca + cb + d[:, self.i] * d[:, self.j] * ra * rb / np.maximum(ra + rb, 1)
        return np.concatenate([ra + rb, na + nb, np.minimum(la, lb), np.maximum(ha, hb), mean, m2, m3, m4, co], axis=1)


def states(df: DataFrame, columns: list[str]) -> DataFrame:
    """_s, _run, state from rows with _s, _run and the columns: one pass, whose states are written; merged where a series' run has
    states of many tasks."""
    shape = Shape(len(columns))

    def fold(batches):
        import pandas as pd

        held: dict[tuple, np.ndarray] = {}

        def out():
            frame = pd.DataFrame({"_s": [k[0] for k in held], "_run": [k[1] for k in held], "state": list(held.values())})
            held.clear()
            return frame

        for pdf in batches:
            x = pdf[columns].to_numpy(dtype=np.float64)
            for key, at in pdf.groupby(["_s", "_run"], sort=False).indices.items():
                s = shape.of(x[at])
                held[key] = shape.merged(np.stack([held[key], s])) if key in held else s
            if len(held) > HELD:
                yield out()
        if held:
            yield out()

    def merge(key, pdf):
        import pandas as pd

        return pd.DataFrame({"_s": [key[0]], "_run": [key[1]], "state": [shape.merged(np.stack(pdf["state"].to_list()))]})

    part = durable(df.mapInPandas(fold, STATE).withColumn("_fold", F.floor(F.spark_partition_id() / FOLD)))
    most = part.groupBy("_s", "_run").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    return part.groupBy("_s", "_run", "_fold").applyInPandas(merge, STATE) if most > FOLD else part.drop("_fold")


FOUND = "a string, b string, n long, missing long, low double, high double, mean double, std double, skewness double, kurtosis double, drift_ratio double, r double"


def found_of(shape: Shape, columns: list[str], threshold: float, names: list, total, n, low, high, mean, m2, m3, m4, co, ratio):
    """_s and FOUND of many series, a row of each array for each of them: a row for each column (b null), and one for each pair that
    correlates. ratio: their drift, not a number where there is none."""
    import pyarrow as pa

    k, m = len(columns), len(names)
    with np.errstate(all="ignore"):
        std = np.sqrt(m2 / n)
        few, flat = n < 4, ~(std >= TINY)
        skew, kurt = (np.where(few | flat, 0.0, v) for v in (m3 / n / std**3, m4 / n / std**4 - 3))
        shown = np.where(few | flat, 0.0, std)
        ratio = ratio / np.where(shown > TINY, shown, 1.0)
        deviation = np.sqrt(np.maximum(co[:, shape.i == shape.j] / total[:, None], 0.0))
        r = co / total[:, None] / (deviation[:, shape.i] * deviation[:, shape.j])
        strong = (shape.i < shape.j) & (deviation[:, shape.i] > TINY) & (deviation[:, shape.j] > TINY) & (np.abs(r) > threshold)
    none = lambda v, gone=False: pa.array(v.ravel(), mask=np.isnan(v.ravel()) | np.ravel(gone))
    one = [pa.array(names).take(pa.array(np.repeat(np.arange(m), k))), pa.array(columns * m), pa.nulls(m * k, pa.string()), pa.array(n.astype(np.int64).ravel()), pa.array((total[:, None] - n).astype(np.int64).ravel())]
    one += [none(low, n < 1), none(high, n < 1), *map(none, (np.where(few, 0.0, mean), shown, skew, kurt, ratio)), pa.nulls(m * k, pa.float64())]
    s, p = np.nonzero(strong)
    two = [pa.array(names).take(pa.array(s)), pa.array([columns[x] for x in shape.i[p]], pa.string()), pa.array([columns[x] for x in shape.j[p]], pa.string()), pa.array(total[s].astype(np.int64)), pa.nulls(len(s), pa.int64())]
    two += [*[pa.nulls(len(s), pa.float64())] * 7, pa.array(r[s, p])]
    fields = ["_s", *(x.split()[0] for x in FOUND.split(", "))]
    return pa.concat_tables([pa.Table.from_arrays(x, names=fields) for x in (one, two)])


def finish(shape: Shape, columns: list[str], runs: int, threshold: float):
    """found_of() one series' states."""

    def rows(key, group):
        run, many = group.column("_run").to_numpy(), group.column("state").combine_chunks()
        many = many.flatten().to_numpy(zero_copy_only=False).reshape(len(run), -1)
        by_run = np.stack([shape.merged(many[run == r]) for r in np.unique(run)])
        total, *rest = shape.parts(shape.merged(by_run)[None])
        ratio = np.full((1, len(columns)), np.nan)
        if total[0, 0] // runs >= 2:
            _, n, _, _, mean, *_ = shape.parts(by_run)
            means = np.where(n < 4, 0.0, mean)
            ratio[0] = means.max(0) - means.min(0)
        return found_of(shape, columns, threshold, [key[0].as_py()], total[:, 0], *rest, ratio)

    return rows


def whole(df: DataFrame, columns: list[str], runs: int, threshold: float) -> DataFrame:
    """_s and FOUND of series of few rows (_s, _run, _rows and the columns), each of which lies whole in one task: rows are shuffled once, and
    a task works on all series of a batch together. A state for each series and run would be larger than its rows."""
    shape = Shape(len(columns))

    def of(names, run, x):
        """Of many series' rows, in the order of series and run."""
        first = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
        begin = np.flatnonzero(np.r_[True, (names[1:] != names[:-1]) | (run[1:] != run[:-1])])  # of runs
        rows = np.diff(np.r_[first, len(x)])
        there = ~np.isnan(x)
        n, own = np.add.reduceat(there, first, dtype=np.int64), np.add.reduceat(there, begin, dtype=np.int64)
        low, high = (f.reduceat(np.where(there, x, e), first) for f, e in ((np.minimum, np.inf), (np.maximum, -np.inf)))
        with np.errstate(all="ignore"):
            base = np.where(np.isfinite(low), low, 0.0)  # a constant's deviations are exactly zero
            y = x - np.repeat(base, rows, axis=0)
            z = np.where(there, y, 0.0)
            mean = np.add.reduceat(z, first) / np.maximum(n, 1)
            means = np.add.reduceat(z, begin) / np.maximum(own, 1) + np.repeat(base, np.diff(np.r_[np.searchsorted(begin, first), len(begin)]), axis=0)
            means = np.where(own < 4, 0.0, means)
            at = np.searchsorted(begin, first)
            ratio = np.where(rows[:, None] // runs >= 2, np.maximum.reduceat(means, at) - np.minimum.reduceat(means, at), np.nan)
            d = y - np.repeat(mean, rows, axis=0)  # missing values stay so: pairs of such a column have no co-moment
            co = np.stack([(part.T @ part)[shape.i, shape.j] for part in np.split(d, first[1:])])
            z = np.where(there, d, 0.0)
            z2 = z * z
            m2, m3, m4 = (np.add.reduceat(v, first) for v in (z2, z2 * z, z2 * z2))
        return found_of(shape, columns, threshold, names[first].tolist(), rows, n, low, high, mean + base, m2, m3, m4, co, ratio)

    def found(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            names, run = batch.column("_s").to_numpy(zero_copy_only=False), batch.column("_run").to_numpy()
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns], axis=1).astype(np.float64)
            if held:
                names, run, x = (np.concatenate(z) for z in zip(held, (names, run, x)))
            last = int(np.argmax(names == names[-1]))  # the last series may go on in the next batch
            if last:
                yield from of(names[:last], run[:last], x[:last]).to_batches()
            held = names[last:], run[last:], x[last:]
        if held:
            yield from of(*held).to_batches()

    return df.repartition("_s").sortWithinPartitions("_s", "_run").mapInArrow(found, f"_s string, {FOUND}")


def profile(df: DataFrame, columns: list[str], by: list[str] | None = None, runs: int = 5, seq: str = "idx", threshold: float = 0.9, sizes: DataFrame | None = None) -> DataFrame:
    """by, and FOUND: of each series a row for each column, with its statistics and its drift over `runs` runs of rows (by their
    place `seq`, dense from 0 in each series; null under two rows a run), and a row for each pair of columns (a before b in
    their order) that correlates. sizes: by, _rows of each series, if known. Written, as it is small: some kB a series. A
    missing value is null or not a number; a column with one has no pairs. An empty table gives no rows."""
    by = by or []
    if not columns:
        return df.sparkSession.createDataFrame([], T.StructType([*(df.schema[c] for c in by), *T._parse_datatype_string(FOUND).fields]))
    values = [F.col(c).cast("double").alias(c) for c in columns]
    if by:
        sizes = durable(sizes if sizes is not None else df.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows")))
        sized, name = with_series(df, sizes, by), F.to_json(F.struct(*by), {"ignoreNullFields": "false"})
    else:
        sized, name = df.withColumn("_rows", F.lit(df.count() if sizes is None else sizes.first()[0]).cast("long")), F.lit("")
    size = F.greatest(F.floor(F.col("_rows") / runs), F.lit(1)).cast("long")
    run = F.least(F.floor(F.col(seq) / size), F.lit(runs - 1)).cast("long")
    part = lambda rows: rows.select(name.alias("_s"), run.alias("_run"), *values)
    by_states = lambda rows: states(part(rows), columns).groupBy("_s").applyInArrow(finish(Shape(len(columns)), columns, runs, threshold), f"_s string, {FOUND}")
    if not by:
        found = durable(by_states(sized))
    else:
        found = whole(part(sized.where(F.col("_rows") <= WHOLE)), columns, runs, threshold)
        if sizes.where(F.col("_rows") > WHOLE).limit(1).count():
            found = found.unionByName(by_states(sized.where(F.col("_rows") > WHOLE)))
        found = durable(found)
    if not by:
        return found.drop("_s")
    keys = T.StructType([df.schema[c] for c in by])
    return found.withColumn("_k", F.from_json("_s", keys)).select(*[F.col(f"_k.{c}").alias(c) for c in by], *[x.split()[0] for x in FOUND.split(", ")])
