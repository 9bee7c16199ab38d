"""Hierarchical series and reconciliation.

The summing matrix is a sparse long table ``(node, bottom, weight)``;
aggregating through the hierarchy is a join on ``bottom`` plus a grouped sum
(J14), with partial aggregation before the shuffle, so the root node (which
receives every bottom series) is summed map-side first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from seriesspark.functions.contracts import DEFAULT, Cols
from seriesspark.session import cut_lineage, write_once


def _node(keys: list[str], depth: int):
    """Node id at a depth: 'total', the path of the upper levels, or the bottom id."""
    if depth == 0:
        return F.lit("total")
    if depth == len(keys):
        return F.col(keys[-1])
    return F.concat_ws("/", *[F.col(k) for k in keys[:depth]])


def build_hierarchy(bottom: DataFrame, tree: DataFrame, levels: list[str],
                    cols: Cols = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """All-level series ``Y`` and summing table ``S`` from bottom series.

    ``tree`` maps the bottom id to its ancestors (``levels`` from the top).
    ``Y`` is the rollup of the levels computed as a chain: bottom rows pass
    through unchanged (``(id, ds)`` is unique), the deepest inner level
    aggregates the bottoms, and every higher level aggregates the level below
    it, so only the first aggregate reads the full data (a GROUPING SETS
    plan would expand every bottom row once per level). ``level`` names the
    deepest grouped column. Node ids: ``total``, ``a/b`` paths for inner
    levels, the bottom id itself for bottoms. ``S`` lists for every bottom the
    nodes it sums into, weight 1.
    """
    keys = [*levels, cols.id]
    j = bottom.select(cols.id, cols.ds, cols.y).join(tree.select(*keys), cols.id, "inner")
    parts = [j.select(F.col(cols.id), cols.ds, cols.y, F.lit(cols.id).alias("level"))]
    cur = j
    for d in range(len(levels), -1, -1):
        grp = levels[:d]
        cur = cur.groupBy(*grp, cols.ds).agg(F.sum(cols.y).alias(cols.y))
        parts.append(cur.select(_node(keys, d).alias(cols.id), cols.ds, cols.y,
                                F.lit(levels[d - 1] if d else "total").alias("level")))
    Y = parts[0]
    for p_ in parts[1:]:
        Y = Y.unionByName(p_)
    paths = tree.select(*keys).distinct()
    S = None
    for d in range(0, len(keys) + 1):
        part = paths.select(_node(keys, d).alias("node"), F.col(cols.id).alias("bottom"))
        S = part if S is None else S.unionByName(part)
    return Y, S.withColumn("weight", F.lit(1.0))


def aggregate_through(bottom_values: DataFrame, S: DataFrame, value_cols: list[str],
                      cols: Cols = DEFAULT) -> DataFrame:
    """``S @ values``: every node's value as the weighted sum of its bottoms."""
    j = bottom_values.join(S, bottom_values[cols.id] == S["bottom"], "inner")
    return (j.groupBy(F.col("node").alias(cols.id), cols.ds)
            .agg(*[F.sum(F.col("weight") * F.col(v)).alias(v) for v in value_cols]))


def bottom_up(forecasts: DataFrame, S: DataFrame, value_cols: list[str], cols: Cols = DEFAULT) -> DataFrame:
    """Bottom-up reconciliation (F18): keep bottom forecasts, sum them upwards."""
    bottoms = S.select(F.col("bottom").alias(cols.id)).distinct()
    fb = forecasts.join(bottoms, cols.id, "left_semi")
    return aggregate_through(fb, S, value_cols, cols)


def coherence_gap(values: DataFrame, S: DataFrame, value_col: str, cols: Cols = DEFAULT) -> DataFrame:
    """Max absolute gap between each node and the sum of its bottoms."""
    bottoms = S.select(F.col("bottom").alias(cols.id)).distinct()
    summed = aggregate_through(values.join(bottoms, cols.id, "left_semi"), S, [value_col], cols)
    j = values.join(summed.withColumnRenamed(value_col, "_sum"), [cols.id, cols.ds], "inner")
    return j.agg(F.max(F.abs(F.col(value_col) - F.col("_sum"))).alias("max_gap"),
                 F.count(F.lit(1)).alias("n_checked"))


# ------------------------------------------------------------ MinT with shrinkage

TILE = 256      # nodes per tile of the residual moments
STAMPS = 4096   # stamps of a tile
BLOCK = 256     # upper nodes of a block of the preconditioner
PATTERNS = 256  # sets of stamps with residuals that the moments by stamps take, at most
GRAM_NODES = 2048  # nodes that a task adds into its moments by stamps
GRAM_BYTES = 32 << 20  # moments by stamps that meet in one group


def _node_rows(residuals: DataFrame, cols: Cols, value_col: str) -> DataFrame:
    """``node, t, x, sd``: a row per node with its stamps, centred residuals and their deviation, written once."""
    value = F.col(value_col).cast("double")
    rows = residuals.where(value.isNotNull() & F.col(cols.id).isNotNull()).withColumn("_at", F.monotonically_increasing_id())  # repeated stamps keep their order
    g = rows.groupBy(F.col(cols.id).alias("node")).agg(
        F.sort_array(F.collect_list(F.struct(F.col(cols.ds).alias("t"), "_at", value.alias("v")))).alias("s"), F.avg(value).alias("m"), F.stddev_samp(value).alias("sd"))
    return write_once(g.select("node", F.col("s.t").alias("t"), F.transform("s", lambda e: e["v"] - F.col("m")).alias("x"), F.greatest("sd", F.lit(1e-4)).alias("sd")))


def shrinkage(residuals: DataFrame, cols: Cols = DEFAULT, value_col: str = "resid") -> float:
    """Shrinkage intensity of the residual correlations (D29, Schafer and Strimmer 2005), in [0, 1].

    Sum of the variances of the off-diagonal correlations over the sum of their
    squares, exactly, from products of nodes or of stamps: whichever writes less
    (``_shrinkage``). No k x k matrix exists anywhere.
    """
    return _shrinkage(_node_rows(residuals, cols, value_col))


def _shrinkage(X: DataFrame) -> float:
    """``shrinkage`` of ``_node_rows``.

    Products of nodes copy every residual to each tile of nodes, which grows with the
    square of the nodes. Products of stamps take a square of the stamps per set of
    stamps that nodes share (a pattern), which does not grow with the nodes.
    """
    k, rows = X.agg(F.count(F.lit(1)), F.sum(F.size("t"))).first()
    n = X.select(F.explode("t").alias("t")).distinct().count()
    tiles = max(1, -(-k // TILE))
    if tiles > 1 and n <= STAMPS:
        patterns = X.select(F.xxhash64("t").alias("p")).distinct().count()
        if patterns <= PATTERNS and (patterns + -(-k // GRAM_NODES)) * n * n * 4 < tiles * rows * 16:
            var, sq = _moments_by_stamps(X, k)
            return float(min(1.0, max(0.0, var / sq))) if sq else 0.0
    var, sq = _moments_by_nodes(X, tiles, max(1, -(-n // STAMPS)))
    return float(min(1.0, max(0.0, var / sq))) if sq else 0.0


def _moments_by_stamps(X: DataFrame, k: int) -> tuple[float, float]:
    """The sums of ``shrinkage`` from Gram matrices over stamps.

    The number of stamps two nodes share depends on their patterns only, so sums over
    pairs of nodes are sums over pairs of patterns: with ``Z_p`` (stamps x nodes) the squared products
    add up to ``|Z_p' Z_q|^2``, which is the inner product of ``Z_p Z_p'`` and ``Z_q Z_q'``. Tasks
    read nodes sorted by pattern and add each pattern's Gram matrix; groups of stamps
    multiply all patterns' parts. A node with itself is taken off at the end.
    """
    shared = X.groupBy(F.xxhash64("t").alias("p")).agg(F.first(F.transform("t", lambda s: F.xxhash64(s))).alias("t")).orderBy("p").collect()
    names = np.array([r["p"] for r in shared])
    stamps = np.unique(np.concatenate([r["t"] for r in shared]))
    places, last = {}, {}  # of a stamp that repeats the last value counts
    for r in shared:
        t, behind = np.unique(r["t"][::-1], return_index=True)
        places[r["p"]], last[r["p"]] = np.searchsorted(stamps, t), len(r["t"]) - 1 - behind
    n, parts = len(stamps), -(-k // GRAM_NODES)
    height = max(1, GRAM_BYTES // (8 * n * (len(names) + parts)))  # stamps of a group

    def gram(batches):
        p, G, squares, own = None, np.zeros((0, 0)), np.zeros(0), np.zeros(2)

        def close():
            for a in range(0, n, height):  # the lower half; an entry off the diagonal counts twice
                rows = np.zeros((min(a + height, n) - a, min(a + height, n)))
                at = places[p]
                i, j = (at >= a) & (at < a + height), at < a + height
                rows[np.ix_(at[i] - a, at[j])] = G[np.ix_(i, j)]
                if i.any():
                    yield pa.RecordBatch.from_pydict({"block": pa.array([a // height], pa.int32()), "p": [p], "g": [rows.tobytes()]})
            yield pa.RecordBatch.from_pydict({"block": pa.array([-1], pa.int32()), "p": [p], "g": [np.concatenate([squares, own]).tobytes()]})

        for batch in batches:
            keys = batch.column("p").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if keys[a] != p:
                    if p is not None:
                        yield from close()
                    p = int(keys[a])
                    G, squares, own = np.zeros((len(places[p]), len(places[p]))), np.zeros(len(places[p])), np.zeros(2)
                part = batch.slice(a, b - a)
                Z = part.column("x").flatten().to_numpy().reshape(b - a, -1)[:, last[p]] / part.column("sd").to_numpy()[:, None]
                G += Z.T @ Z
                squares += (Z * Z).sum(axis=0)
                own += (Z * Z).sum(axis=1) @ (Z * Z).sum(axis=1), (Z ** 4).sum()
        if p is not None:
            yield from close()

    def products(table: pa.Table) -> pa.Table:
        """Inner products of all patterns' Gram matrices over one group of stamps."""
        block = table.column("block")[0].as_py()
        a = block * height
        b = min(a + height, n)
        twice = np.tril(np.full((b - a, b), 2.0), a - 1) + np.eye(b - a, b, a)
        sums: dict[int, np.ndarray] = {}
        for p, g in zip(table.column("p").to_pylist(), table.column("g")):
            part = np.frombuffer(g.as_buffer()).reshape(b - a, b)
            sums[p] = sums[p] + part if p in sums else part
        keys = sorted(sums)
        flat = np.stack([sums[p].reshape(-1) for p in keys])
        f = (flat * twice.reshape(-1)) @ flat.T
        return pa.table({"p": np.repeat(keys, len(keys)), "q": np.tile(keys, len(keys)), "f": f.reshape(-1)})

    # null-free rows, nodes of a pattern side by side, as many in each task
    nodes = X.select(F.xxhash64("t").alias("p"), "x", "sd").repartitionByRange(parts, "p", F.xxhash64("node")).sortWithinPartitions("p")
    grams = write_once(nodes.mapInArrow(gram, "block int, p bigint, g binary"))
    s, own = np.zeros((len(names), n)), np.zeros((len(names), 2))
    for r in grams.where("block = -1").collect():  # one vector over stamps per pattern and task
        v, i = np.frombuffer(r["g"]), np.searchsorted(names, r["p"])
        s[i, places[r["p"]]] += v[:-2]
        own[i] += v[-2:]
    F_pq = np.zeros((len(names), len(names)))
    inner = grams.where("block >= 0").groupBy("block").applyInArrow(products, "p bigint, q bigint, f double")
    for r in inner.groupBy("p", "q").agg(F.sum("f").alias("f")).collect():
        F_pq[np.searchsorted(names, r["p"]), np.searchsorted(names, r["q"])] = r["f"]
    present = np.zeros((len(names), n))
    for i, p in enumerate(names):
        present[i, places[p]] = 1.0
    sums = lambda w2, ww, n: (float((n / (n - 1) ** 3 * (w2 - ww / n)).sum()), float((ww / (n - 1) ** 2).sum()))
    all_var, all_sq = sums(s @ s.T, F_pq, np.maximum(present @ present.T, 2))
    own_var, own_sq = sums(own[:, 1], own[:, 0], np.maximum(present.sum(axis=1), 2))
    return all_var - own_var, all_sq - own_sq


def _moments_by_nodes(X: DataFrame, tiles: int, runs: int) -> tuple[float, float]:
    """The sums of ``shrinkage`` from products of nodes.

    A node's standardised residuals are arrays of some STAMPS stamps; nodes are
    dealt into tiles. A group multiplies two tiles over one run of stamps, a second
    one adds up a pair's runs and returns two numbers, so no task sees more than two
    tiles of one run.
    """
    z = X.select(F.pmod(F.xxhash64("node"), F.lit(tiles)).cast("int").alias("t"), "node", F.transform("t", lambda s: F.xxhash64(s)).alias("ds"),
                 F.transform("x", lambda v: v / F.col("sd")).alias("z"))
    if runs == 1:
        z = z.withColumn("run", F.lit(0))
    else:
        z = z.select("t", "node", F.explode(F.arrays_zip("ds", "z")).alias("e")).select("t", "node", "e.ds", "e.z")
        z = z.groupBy("t", "node", F.pmod("ds", F.lit(runs)).cast("int").alias("run")).agg(F.collect_list("ds").alias("ds"), F.collect_list("z").alias("z"))
    z = z.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    z = z.select(F.least("t", "o").alias("i"), F.greatest("t", "o").alias("j"), "t", "node", "run", "ds", "z")

    def products(table: pa.Table) -> pa.Table:
        """Counts, products and products of squares of the nodes of two tiles over one run."""
        table = table.combine_chunks().sort_by("node")
        t, (i, j) = table.column("t").to_numpy(), (table.column(c)[0].as_py() for c in "ij")
        ds, values = (table.column(c).combine_chunks() for c in ("ds", "z"))
        row = np.repeat(np.arange(len(table)), np.diff(np.asarray(ds.offsets)))
        stamps, at = np.unique(ds.flatten().to_numpy(), return_inverse=True)
        Z, M = np.zeros((len(stamps), len(table))), np.zeros((len(stamps), len(table)))
        Z[at, row], M[at, row] = values.flatten().to_numpy(), 1.0
        A, B = t == i, t == j
        sums = [M[:, A].T @ M[:, B], Z[:, A].T @ Z[:, B], (Z[:, A] ** 2).T @ (Z[:, B] ** 2)]
        names = np.array(table.column("node").to_pylist(), object)
        return pa.table({"i": pa.array([i], pa.int32()), "j": pa.array([j], pa.int32()), "a": [names[A].astype(str).tolist()], "b": [names[B].astype(str).tolist()],
                         **{c: [x.tobytes()] for c, x in zip(("n", "w", "w2"), sums)}})

    def moments(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        names = [sorted({x for r in rows for x in r[c]}) for c in "ab"]
        n, w, w2 = (np.zeros((len(names[0]), len(names[1]))) for _ in range(3))
        for r in rows:  # a run lacks the nodes without a value in it
            place = np.ix_(np.searchsorted(names[0], r["a"]), np.searchsorted(names[1], r["b"]))
            for total, c in ((n, "n"), (w, "w"), (w2, "w2")):
                total[place] += np.frombuffer(r[c]).reshape(len(r["a"]), len(r["b"]))
        n = np.maximum(n, 2)
        var, sq = n / (n - 1) ** 3 * (w2 - w ** 2 / n), (w / (n - 1)) ** 2
        own = rows[0]["i"] == rows[0]["j"]
        if own:
            np.fill_diagonal(var, 0.0)
            np.fill_diagonal(sq, 0.0)
        times = 1.0 if own else 2.0
        return pa.table({"var": [times * float(var.sum())], "sq": [times * float(sq.sum())]})

    parts = z.groupBy("i", "j", "run").applyInArrow(products, "i int, j int, a array<string>, b array<string>, n binary, w binary, w2 binary")
    var, sq = parts.groupBy("i", "j").applyInArrow(moments, "var double, sq double").agg(F.sum("var"), F.sum("sq")).first()
    return var or 0.0, sq or 0.0


def _entries() -> list:
    """The stamps ``t`` and residuals ``x`` of ``_node_rows``, a row each."""
    return [F.inline(F.arrays_zip("t", "x")).alias("t", "x")]


class _Constraints:
    """The system ``U' W U z = U' y`` over the upper nodes, as distributed rows.

    ``W = a D + c X'X`` with the centred residuals ``X`` and their variances ``D``; ``U`` holds
    "node minus the sum of its bottoms". As ``X U`` are the residuals' own violations,
    summed once, the system needs rows of upper nodes only: ``M = U' D U`` by pairs of
    nodes that share bottoms, and ``XU`` by node and stamp.
    """

    def __init__(self, A: DataFrame, D: DataFrame, X: DataFrame, a: float, c: float, names: list[str]):
        self.a, self.c, self.names = a, c, names
        upper = A.select("a").distinct()
        m = upper.count()
        self.blocks = max(1, -(-m // BLOCK))
        block = F.pmod(F.xxhash64("a"), F.lit(self.blocks)).cast("int").alias("block")
        self.upper = upper.select("a", block)
        below = A.join(D, A["b"] == D["node"]).select("a", "b", "weight", "d")
        other = A.select(F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("weight").alias("w2"))
        shared = below.join(other, F.col("b") == F.col("b2")).groupBy("a", "a2").agg(F.sum(F.col("weight") * F.col("w2") * F.col("d")).alias("v"))
        own = upper.join(D, F.col("a") == F.col("node")).select("a", F.col("a").alias("a2"), F.col("d").alias("v"))
        self.M = cut_lineage(shared.unionByName(own).groupBy("a", "a2").agg(F.sum("v").alias("v")))
        part = X.join(upper, F.col("node") == F.col("a")).select("a", *_entries())
        # all upper nodes of a bottom meet its row at once, so that the join sends it once
        above = A.groupBy("b").agg(F.collect_list(F.struct("a", "weight")).alias("up"))
        sums = X.join(above, X["node"] == above["b"]).select("up", *_entries()).select("t", "x", F.explode("up").alias("u")) \
            .groupBy("u.a", "t").agg((-F.sum(F.col("u.weight") * F.col("x"))).alias("x"))
        self.XU = cut_lineage(part.unionByName(sums).groupBy("a", "t").agg(F.sum("x").alias("x")))
        self.diagonal = cut_lineage(self._diagonal_blocks())

    def _diagonal_blocks(self) -> DataFrame:
        """``block, a, a2, v``: the system's entries inside each block of upper nodes."""
        def gram(table: pa.Table) -> pa.Table:
            names, row = np.unique(np.array(table.column("a").to_pylist(), object).astype(str), return_inverse=True)
            stamps, at = np.unique(table.column("t").to_numpy(), return_inverse=True)
            Z = np.zeros((len(stamps), len(names)))
            Z[at, row] = table.column("x").to_numpy()
            k = len(names)
            return pa.table({"block": pa.array([table.column("block")[0].as_py()] * k * k, pa.int32()), "a": pa.array(np.repeat(names, k), pa.string()),
                             "a2": pa.array(np.tile(names, k), pa.string()), "v": (Z.T @ Z).reshape(-1)})
        runs = max(1, -(-self.XU.select("t").distinct().count() // STAMPS))
        rows = self.XU.join(self.upper, "a").select("block", F.col("a").cast("string").alias("a"), F.xxhash64("t").alias("t"), "x", F.pmod(F.xxhash64("t"), F.lit(runs)).alias("run"))
        dense = rows.groupBy("block", "run").applyInArrow(gram, "block int, a string, a2 string, v double").select("block", "a", "a2", (F.lit(self.c) * F.col("v")).alias("v"))
        second = self.upper.select(F.col("a").alias("a2"), F.col("block").alias("block2"))
        sparse = self.M.join(self.upper, "a").join(second, "a2").where("block = block2") \
            .select("block", F.col("a").cast("string"), F.col("a2").cast("string"), (F.lit(self.a) * F.col("v")).alias("v"))
        return dense.unionByName(sparse).groupBy("block", "a", "a2").agg(F.sum("v").alias("v"))

    def per_stamp(self, v: DataFrame, prefix: str) -> DataFrame:
        """``X U v`` by stamp."""
        return self.XU.join(v, "a").groupBy("t").agg(*[F.sum(F.col("x") * F.col(prefix + c)).alias(c) for c in self.names])

    def times_p(self, state: DataFrame) -> DataFrame:
        """``state`` with ``q = U' W U p``."""
        p = state.select("a", *[f"p{c}" for c in self.names])
        back = self.XU.join(self.per_stamp(p, "p"), "t").groupBy("a").agg(*[(F.lit(self.c) * F.sum(F.col("x") * F.col(c))).alias(f"_b{c}") for c in self.names])
        near = self.M.join(p.withColumnRenamed("a", "a2"), "a2").groupBy("a").agg(*[(F.lit(self.a) * F.sum(F.col("v") * F.col(f"p{c}"))).alias(f"_m{c}") for c in self.names])
        return state.join(back, "a", "left").join(near, "a", "left").select(
            *state.columns, *[(F.coalesce(f"_b{c}", F.lit(0.0)) + F.coalesce(f"_m{c}", F.lit(0.0))).alias(f"q{c}") for c in self.names])

    def precondition(self, state: DataFrame) -> DataFrame:
        """``state`` with ``h``, the solution of each diagonal block for the residuals ``r``."""
        names = self.names

        def solve(rows: pa.Table, entries: pa.Table) -> pa.Table:
            order = np.argsort(np.array(rows.column("a").cast(pa.string()).to_pylist()))
            rows = rows.take(pa.array(order))
            keys = np.array(rows.column("a").cast(pa.string()).to_pylist())
            K = np.zeros((len(keys), len(keys)))
            i, j = (np.searchsorted(keys, np.array(entries.column(c).to_pylist(), dtype=keys.dtype)) for c in ("a", "a2"))
            K[i, j] = entries.column("v").to_numpy()
            h = np.linalg.solve(K, np.column_stack([rows.column(f"r{c}").to_numpy() for c in names]))
            for k, c in enumerate(names):
                rows = rows.append_column(f"h{c}", pa.array(h[:, k]))
            return rows

        out = StructType([*state.schema.fields, *[StructField(f"h{c}", DoubleType()) for c in names]])
        return state.groupBy("block").cogroup(self.diagonal.groupBy("block")).applyInArrow(solve, out)

    def solve(self, rhs: DataFrame, size: list[float], tolerance: float, max_rounds: int) -> tuple[DataFrame, int]:
        """``a, z`` and the rounds it took. ``rhs`` has ``a`` and the names; a column is done once its residual is below ``tolerance`` times ``size``.

        Conjugate gradients for all columns at once; with up to BLOCK upper nodes the
        preconditioner is the inverse and one round does it.
        """
        names = self.names
        dots = lambda df, x, y: [v or 0.0 for v in df.agg(*[F.sum(F.col(x + c) * F.col(y + c)) for c in names]).first()]
        state = rhs.join(self.upper, "a").select("a", "block", *[F.col(c).alias(f"r{c}") for c in names], *[F.lit(0.0).alias(f"z{c}") for c in names])
        state = cut_lineage(self.precondition(state).select("*", *[F.col(f"h{c}").alias(f"p{c}") for c in names]).drop(*[f"h{c}" for c in names]))
        rounds, rr = 0, dots(state, "r", "r")
        rh = None
        while not all(q <= tolerance ** 2 * max(s, 1e-30) for q, s in zip(rr, size)):
            if rounds == max_rounds:
                raise RuntimeError(f"MinT did not converge in {max_rounds} rounds")
            if rh is None:
                rh = dots(state, "r", "p")
            state = cut_lineage(self.times_p(state))
            alpha = [x / w if w else 0.0 for x, w in zip(rh, dots(state, "p", "q"))]
            step = state.select("a", "block", *[(F.col(f"r{c}") - F.lit(f) * F.col(f"q{c}")).alias(f"r{c}") for c, f in zip(names, alpha)],
                                *[(F.col(f"z{c}") + F.lit(f) * F.col(f"p{c}")).alias(f"z{c}") for c, f in zip(names, alpha)], *[f"p{c}" for c in names])
            state = cut_lineage(self.precondition(step))
            sums = dots(state, "r", "r"), dots(state, "r", "h")
            beta = [x / w if w else 0.0 for x, w in zip(sums[1], rh)]
            state = state.select("a", "block", *[f"r{c}" for c in names], *[f"z{c}" for c in names],
                                 *[(F.col(f"h{c}") + F.lit(f) * F.col(f"p{c}")).alias(f"p{c}") for c, f in zip(names, beta)])
            (rr, rh), rounds = sums, rounds + 1
        return state.select("a", *[F.col(f"z{c}").alias(c) for c in names]), rounds


def mint_solve(base: DataFrame, residuals: DataFrame, S: DataFrame, value_cols: list[str], cols: Cols = DEFAULT,
               value_col: str = "resid", tolerance: float = 1e-10, max_rounds: int = 500) -> tuple[DataFrame, int]:
    """``mint_reconcile`` and the rounds of its solver."""
    stamps = [r[0] for r in base.select(cols.ds).distinct().orderBy(cols.ds).collect()]  # the horizon
    names = [f"_v{i}" for i in range(len(stamps) * len(value_cols))]
    y = cut_lineage(base.groupBy(F.col(cols.id).alias("node")).agg(*[
        F.coalesce(F.max(F.when(F.col(cols.ds) == F.lit(s), F.col(v).cast("double"))), F.lit(0.0)).alias(names[i * len(value_cols) + j])
        for i, s in enumerate(stamps) for j, v in enumerate(value_cols)]))
    A = cut_lineage(S.where(F.col("node") != F.col("bottom")).select(F.col("node").alias("a"), F.col("bottom").alias("b"), "weight"))
    X = _node_rows(residuals, cols, value_col)
    n = X.select(F.explode("t").alias("t")).distinct().count()
    a = max(1e-6, _shrinkage(X))
    c = (1 - a) / max(n - 1, 1)
    squares = X.select("node", (F.aggregate("x", F.lit(0.0), lambda s, x: s + x * x) / max(n - 1, 1)).alias("d"))
    D = cut_lineage(y.select("node").join(squares, "node", "left").select("node", F.greatest(F.coalesce("d", F.lit(0.0)), F.lit(1e-8)).alias("d")))
    system = _Constraints(A, D, X, a, c, names)
    below = A.join(y, A["b"] == y["node"]).groupBy("a").agg(*[F.sum(F.col("weight") * F.col(v)).alias(f"_s{v}") for v in names])
    rhs = y.join(below, y["node"] == below["a"]).select("a", *[(F.col(v) - F.col(f"_s{v}")).alias(v) for v in names])
    size = [v or 0.0 for v in y.agg(*[F.sum(F.col(v) * F.col(v)) for v in names]).first()]
    z, rounds = system.solve(rhs, size, tolerance, max_rounds)
    # y - W U z: U z by node, X U z by stamp
    down = A.join(z, "a").groupBy(F.col("b").alias("node")).agg(*[(-F.sum(F.col("weight") * F.col(v))).alias(v) for v in names])
    spread = z.withColumnRenamed("a", "node").unionByName(down).toDF("node", *[f"_u{v}" for v in names])
    # a row per stamp goes to every task: the residuals stay where they are
    back = X.select("node", *_entries()).join(F.broadcast(system.per_stamp(z, "")), "t").groupBy("node").agg(*[F.sum(F.col("x") * F.col(v)).alias(f"_b{v}") for v in names])
    out = y.join(D, "node").join(spread, "node", "left").join(back, "node", "left").select("node", *[
        (F.col(v) - F.lit(a) * F.col("d") * F.coalesce(f"_u{v}", F.lit(0.0)) - F.lit(c) * F.coalesce(f"_b{v}", F.lit(0.0))).alias(v) for v in names])
    per_stamp = F.array(*[F.struct(F.lit(s).alias("ds"), *[F.col(names[i * len(value_cols) + j]).alias(v) for j, v in enumerate(value_cols)])
                          for i, s in enumerate(stamps)])
    return out.select(F.col("node").alias(cols.id), F.explode(per_stamp).alias("_f")) \
        .select(cols.id, F.col("_f.ds").cast(base.schema[cols.ds].dataType).alias(cols.ds), *[F.col(f"_f.{v}").alias(v) for v in value_cols]), rounds


def mint_reconcile(base: DataFrame, residuals: DataFrame, S: DataFrame, value_cols: list[str], cols: Cols = DEFAULT,
                   value_col: str = "resid", tolerance: float = 1e-10, max_rounds: int = 500) -> DataFrame:
    """MinT-reconciled forecasts of every node with the shrinkage covariance.

    With ``W = a D + (1 - a) X'X / (n - 1)`` (``X`` the centred residuals, ``D`` their
    variances, ``a`` the shrinkage, floored at 1e-6 so that W is regular) and ``U``
    the constraints "node minus the sum of its bottoms", the reconciled forecasts
    are ``y - W U z`` with ``(U' W U) z = U' y``. The system lives on the upper nodes;
    it is solved by conjugate gradients preconditioned with its diagonal blocks, whose
    products are joins and grouped sums over distributed rows: the number of nodes is
    not limited. One solve for all forecast stamps; what reaches the driver are a few
    sums per stamp and round. Raises when ``max_rounds`` do not reach the tolerance.
    """
    return mint_solve(base, residuals, S, value_cols, cols, value_col, tolerance, max_rounds)[0]
