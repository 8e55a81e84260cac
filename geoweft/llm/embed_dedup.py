"""Embedding near-duplicates: subspace pigeonhole join.

Unit vectors with cosine >= t lie within squared distance 2 (1 - t).  After a fixed random rotation
the coordinates are cut into blocks; by pigeonhole a pair within the budget is within a block's share
(budget x block dimensions / dimensions) in at least one block.  Each block is range-joined on a grid
over its leading coordinates, with cells twice the block's radius wide: a vector goes to the cells
that its box [x, x + radius] touches, and a pair belongs to the cell of its coordinate-wise maximum.
A pair found in several blocks is counted in the first.  Candidates are verified by cosine in double
precision.  Large cells are dealt in pairs of sub-blocks, and a task gives counts and a spanning
forest of its links, never the pairs of a group.

Defined results: null label, null or zero vectors and vectors with null or non-finite components link
with nothing; vectors of different length never link; equal vectors form one class first; rows with
equal vec_id are one node whose links add up; a null vec_id keeps its links but has no component;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.components import components as connected_components
from ..plans.store import materialize

BLOCK_DIMS = 8
#: Vectors of a cell compared with one another in one task.
CELL_ROWS = 2000


@lru_cache(maxsize=8)
def rotation(dims: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(dims).standard_normal((dims, dims)))[0]


def _blocks(dims: int) -> list[slice]:
    return [slice(s, min(dims, s + BLOCK_DIMS)) for s in range(0, dims, BLOCK_DIMS)]


def _vectors(table: DataFrame) -> DataFrame:
    """vec_id, label, dims, raw (little-endian, as wide as the column), h, g; raw is null where nothing may link."""
    kind = "<f4" if dict(table.dtypes)["embedding"] == "array<float>" else "<f8"

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        import xxhash

        for batch in batches:
            lists, size = batch.column(2), batch.num_rows
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            labelled = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            dims, raw, h, g = np.zeros(size, np.int32), [None] * size, np.zeros(size, np.int64), np.zeros(size, np.int64)
            for d in np.unique(lengths[labelled & (lengths > 0)]).tolist():
                at = np.flatnonzero(labelled & (lengths == d))
                # a null component becomes NaN
                x = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                good = np.isfinite(x).all(axis=1) & x.any(axis=1)
                x = (x[good] + 0).astype(kind)
                for i, v in zip(at[good].tolist(), x):
                    raw[i] = v.tobytes()
                    digest = xxhash.xxh3_128_digest(raw[i])
                    dims[i] = d
                    h[i] = int.from_bytes(digest[:8], "little", signed=True)
                    g[i] = int.from_bytes(digest[8:], "little", signed=True)
            columns = [batch.column(0), batch.column(1), pa.array(dims), pa.array(raw, pa.binary()), pa.array(h), pa.array(g)]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "dims", "raw", "h", "g"])

    cols = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    return cols.mapInArrow(run, "vec_id long, label string, dims int, raw binary, h long, g long")


def _unit(raw, dims: int) -> np.ndarray:
    raw = list(raw)
    x = np.frombuffer(b"".join(raw), f"<f{len(raw[0]) // dims}").astype(np.float64).reshape(-1, dims)
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / scale
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _cells(reps: DataFrame, budget: float, grid: int, carry: bool) -> DataFrame:
    """One row for each block and each grid cell that a vector's box touches."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            for dims in set(batch.column(2).to_pylist()):
                part = batch.filter(pc.equal(batch.column(2), dims))
                y = _unit(part.column(3).to_pylist(), dims) @ rotation(dims)
                for j, s in enumerate(_blocks(dims)):
                    r = math.sqrt(budget * (s.stop - s.start) / dims) + 1e-9
                    x = y[:, s][:, :grid]
                    low, high = np.floor(x / (2 * r)).astype(np.int64), np.floor((x + r) / (2 * r)).astype(np.int64)
                    for corner in range(1 << x.shape[1]):
                        up = np.array([corner >> k & 1 for k in range(x.shape[1])], bool)
                        keep = np.flatnonzero((~up | (high > low)).all(axis=1))
                        if not len(keep):
                            continue
                        c = np.where(up, high[keep], low[keep])
                        code = np.zeros(len(keep), np.int64)
                        for k in range(c.shape[1]):
                            code = code * 1_000_003 + c[:, k]
                        rows = part.take(pa.array(keep))
                        cols = [rows.column(1), rows.column(2), pa.array(np.full(len(keep), j, np.int32)), pa.array(code), rows.column(0)]
                        if carry:
                            cols += [rows.column(4), rows.column(3)]
                        yield pa.RecordBatch.from_arrays(cols, names=["label", "dims", "block", "cell", "rep", "n", "raw"][: len(cols)])

    return reps.select("rep", "label", "dims", "raw", "n").mapInArrow(run, "label string, dims int, block int, cell long, rep long" + (", n long, raw binary" if carry else ""))


def _hook(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the trees of a[i] and b[i]; every node of ``root`` points to the least of its tree."""
    while True:
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
        if not len(a):
            return
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root[:] = root[root]


def _joined(unit: np.ndarray, y: np.ndarray, rep: np.ndarray, n: np.ndarray, mine: np.ndarray, j: int, cell: int, low: int, high: int, cosine: float, budget: float, grid: int):
    """Links of one cell: how many each row has, and for each row the row that stands for its tree."""
    dims = unit.shape[1]
    blocks = _blocks(dims)
    shares = [budget * (s.stop - s.start) / dims + 1e-9 for s in blocks]
    r = math.sqrt(budget * (blocks[j].stop - blocks[j].start) / dims) + 1e-9
    own = y[:, blocks[j]]
    at = own[:, :grid]
    first = np.flatnonzero(mine == low)
    second = first if low == high else np.flatnonzero(mine == high)
    counts = np.zeros(len(unit), np.int64)
    root = np.arange(len(unit))
    square = (own * own).sum(axis=1)
    for part in np.array_split(first, max(1, len(first) // 256)):
        d = square[part][:, None] + square[second][None] - 2 * own[part] @ own[second].T
        p, q = np.nonzero(d <= shares[j] + 1e-9)
        p, q = part[p], second[q]
        if low == high:
            once = rep[p] < rep[q]
            p, q = p[once], q[once]
        for s in range(0, len(p), 100_000):
            a, b = p[s : s + 100_000], q[s : s + 100_000]
            top = np.floor(np.maximum(at[a], at[b]) / (2 * r)).astype(np.int64)
            code = np.zeros(len(a), np.int64)
            for k in range(top.shape[1]):
                code = code * 1_000_003 + top[:, k]
            a, b = a[code == cell], b[code == cell]
            ok = np.einsum("ij,ij->i", unit[a], unit[b]) >= cosine
            a, b = a[ok], b[ok]
            for i in range(j):  # a pair is counted in its first block
                diff = y[a][:, blocks[i]] - y[b][:, blocks[i]]
                ok = (diff * diff).sum(axis=1) > shares[i]
                a, b = a[ok], b[ok]
            np.add.at(counts, a, n[b])
            np.add.at(counts, b, n[a])
            _hook(root, a, b)
    return counts, root


#: A cell's key, by which its rows are shuffled and sorted.
KEY = ["label", "dims", "block", "cell", "lo", "hi"]


def _cell_links(cosine: float, budget: float, grid: int):
    """For mapInArrow over rows sorted by KEY: rows (u, null, n) are counts, rows (u, v, 0) a spanning forest.

    Only the rows of a batch and of the cell at its end, at most 2 * CELL_ROWS, are held.
    """

    def limits(table) -> np.ndarray:
        """Where each cell starts, and the end."""
        import pyarrow.compute as pc

        change = np.zeros(table.num_rows - 1, bool)
        for name in KEY:
            c = table.column(name)
            change |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy()
        return np.concatenate([[0], np.flatnonzero(change) + 1, [table.num_rows]])

    def links(table, starts):
        import pyarrow as pa

        dims, block, cell, low, high, rep, n, mine = (table.column(c).to_numpy() for c in ("dims", "block", "cell", "lo", "hi", "rep", "n", "mine"))
        raw, u, v, k = table.column("raw").to_pylist(), [], [], []
        s = 0
        while s < len(starts) - 1:  # cells that follow one another and have equal dimensions are rotated at once
            e = s + 1
            while e < len(starts) - 1 and dims[starts[e]] == dims[starts[s]]:
                e += 1
            base, d = starts[s], int(dims[starts[s]])
            unit = _unit(raw[base : starts[e]], d)
            y = unit @ rotation(d)
            for g in range(s, e):
                a, b = starts[g], starts[g + 1]
                if b - a < 2:
                    continue
                i, o = slice(a, b), slice(a - base, b - base)
                counts, root = _joined(unit[o], y[o], rep[i], n[i], mine[i], int(block[a]), int(cell[a]), int(low[a]), int(high[a]), cosine, budget, grid)
                linked, hung = np.flatnonzero(counts), np.flatnonzero(root != np.arange(b - a))
                u += [rep[i][linked], rep[i][hung]]
                v += [np.full(len(linked), -1), rep[i][root[hung]]]
                k += [counts[linked], np.zeros(len(hung), np.int64)]
            s = e
        u, v, k = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (u, v, k))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v, mask=k > 0), pa.array(k)], names=["u", "v", "n"])

    def run(batches):
        import pyarrow as pa

        kept = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = (pa.concat_tables([kept, table]) if kept is not None else table).combine_chunks()
            starts = limits(table)
            kept = table.slice(starts[-2])
            if starts[-2]:
                yield links(table.slice(0, starts[-2]), starts[:-1])
        if kept is not None:
            yield links(kept, limits(kept))

    return run


def embedding_links(table: DataFrame, cosine: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row a vector."""
    budget = 2 * (1 - cosine)
    known = materialize(_vectors(table).withColumn("row", F.monotonically_increasing_id()), "vectors")
    valid = known.where("raw is not null")
    node = F.coalesce(F.col("vec_id"), F.col("row") + (1 << 62))
    classes = materialize(valid.groupBy("label", "dims", "h", "g").agg(F.min(F.struct(node.alias("rep"), "row")).alias("m"), F.count("*").alias("n")), "classes")
    classes = classes.select("label", "dims", "h", "g", "m.rep", F.col("m.row").alias("first"), "n")
    reps = valid.select("raw", "row").join(classes.select("rep", "label", "dims", "n", F.col("first").alias("row")), "row")
    reps = materialize(reps.select("rep", "label", "dims", "raw", "n"), "representatives")
    most = reps.groupBy("label", "dims").count().agg(F.max("count")).first()[0] or 1
    grid = min(BLOCK_DIMS, max(1, 1 + int(math.log(max(1, most / 256)) / math.log(3.5))))
    where = ["label", "dims", "block", "cell"]
    # a stored table has a known size: Spark broadcasts it while small, and the vectors are shuffled once only
    large = materialize(_cells(reps, budget, grid, False).groupBy(*where).count().where(F.col("count") > CELL_ROWS), "large-cells")
    cells = _cells(reps, budget, grid, True).join(large, where, "left").withColumn("s", F.ceil(F.coalesce("count", F.lit(1)) / CELL_ROWS))
    cells = cells.withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("s"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    cells = cells.withColumn("lo", F.least("mine", "other")).withColumn("hi", F.greatest("mine", "other")).drop("count", "s", "other")
    cells = cells.select(*KEY, "rep", "n", "mine", "raw").repartition(*KEY).sortWithinPartitions(*KEY)
    found = cells.mapInArrow(_cell_links(cosine, budget, grid), "u long, v long, n long")
    found = materialize(found, "embedding-links")
    links = found.where("v is null").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("more"))
    members = valid.select(node.alias("id"), "row", "label", "dims", "h", "g").join(classes, ["label", "dims", "h", "g"])
    members = materialize(members.join(links, "rep", "left").select("id", "row", "rep", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links")), "members")
    edges = found.where("v is not null").select("u", "v").union(members.where("id <> rep").select("id", "rep"))
    parts = connected_components(edges).where("component is not null")
    out = known.select("vec_id", "row").join(members.select("row", "n_links"), "row", "left").join(parts, F.col("vec_id") == F.col("node"), "left")
    least = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), least.alias("component_id"), (F.col("vec_id") == least).alias("kept"))
