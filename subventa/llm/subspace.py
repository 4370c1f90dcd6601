"""Near-duplicate vectors: pigeonhole join over subspaces.

Unit vectors with cosine >= c have a squared distance of at most 2 - 2c. A fixed
random rotation spreads the distance over all coordinates; the rotated vectors
are cut into blocks of `BLOCK_DIMS` coordinates. If two vectors are near, some
block holds at most its share of the squared distance, so it is enough to join
each block by its own radius and to unite what is found:

* Vectors equal in label and components are one class with a weight.
* A block's first `KEY_DIMS` coordinates lie on a grid of twice the radius. A
  vector is at home in one cell and visits the cells its radius touches, at most
  two per coordinate. Label, block and cell are the equi-join key.
* Inside a cell, homes and visitors are compared on the block, then on the whole
  vector in double precision. A pair counts in its first near block only, and
  only where the smaller id visits, so it counts once.
* A cell with many vectors is cut into pieces; every pair of pieces is a group.

Pairs never leave a group: it returns, per vector, the weight it is linked with
and one link to the smallest vector it reaches inside the group.

Defined cases: a row links with nothing if its label, vec_id or vector is null or
the vector is empty, zero or has null or non-finite components; vectors of
different lengths never link. Components of any finite size count, the smallest
doubles as well. An empty table gives an empty one. Repeated rows are vectors of their own (each is a
link of the other). Rows that share a vec_id but not the vector are one node in
the components. Extra columns are not carried.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subventa.llm.graph import components
from subventa.llm.store import materialise

BLOCK_DIMS = 8
KEY_DIMS = 2
# Rows of one side of a group.
PIECE = 2048
# Candidate pairs checked at a time.
STRIP = 1 << 15
SLACK = 1e-9

_SEED = 20


def rotation(dims: int) -> np.ndarray:
    """The same orthogonal matrix for every task."""
    q, r = np.linalg.qr(np.random.default_rng(_SEED + dims).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def blocks(dims: int) -> list[slice]:
    return [slice(a, min(a + BLOCK_DIMS, dims)) for a in range(0, dims, BLOCK_DIMS)]


def levelled(vectors: np.ndarray) -> np.ndarray:
    """Each vector times a power of two that brings its largest component near 1.

    No component is rounded, and squares of very small or large ones neither vanish nor overflow.
    """
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, initial=0))[1][:, None])


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def budgets(dims: int, cosine: float) -> list[float]:
    """Squared distance of each block, in proportion to its coordinates."""
    return [(2 - 2 * cosine + SLACK) * (b.stop - b.start) / dims for b in blocks(dims)]


def _cell_batches(cosine: float, with_vectors: bool):
    names = ["label", "dims", "block", "cell", "side"] + ["node", "weight", "embedding"] * with_vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = {}
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("embedding"))
            lengths = np.diff(column.offsets.to_numpy())
            for dims in np.unique(lengths):
                at = np.flatnonzero(lengths == dims)
                rows = batch.take(pa.array(at))
                vectors = rows.column(rows.schema.get_field_index("embedding")).flatten().to_numpy().reshape(-1, dims).astype(np.float64)
                vectors = levelled(vectors)
                if dims not in turn:
                    turn[dims] = rotation(int(dims))
                turned = unit(vectors) @ turn[dims]
                for b, (part, budget) in enumerate(zip(blocks(int(dims)), budgets(int(dims), cosine))):
                    radius = budget**0.5 * (1 + 1e-9) + 1e-12
                    keyed = turned[:, part.start : min(part.stop, part.start + KEY_DIMS)]
                    low = np.floor((keyed - radius) / (2 * radius)).astype(np.int64)
                    high = np.floor((keyed + radius) / (2 * radius)).astype(np.int64)
                    home = np.floor(keyed / (2 * radius)).astype(np.int64)
                    cells, places, sides = [home], [np.arange(len(at))], [np.ones(len(at), np.int32)]
                    for corner in itertools.product((0, 1), repeat=keyed.shape[1]):
                        pick = np.array(corner, bool)
                        fresh = ((high > low) | ~pick).all(axis=1)
                        cells.append(np.where(pick, high, low)[fresh])
                        places.append(np.flatnonzero(fresh))
                        sides.append(np.zeros(int(fresh.sum()), np.int32))
                    grid = np.concatenate(cells)
                    code = np.zeros(len(grid), np.int64)
                    for k in range(grid.shape[1]):
                        code = code * np.int64(1 << 20) + grid[:, k]
                    take = pa.array(np.concatenate(places))
                    count = len(grid)
                    columns = [
                        rows.column(rows.schema.get_field_index("label")).take(take),
                        pa.array(np.full(count, dims, np.int32)),
                        pa.array(np.full(count, b, np.int32)),
                        pa.array(code),
                        pa.array(np.concatenate(sides)),
                    ]
                    if with_vectors:
                        columns += [rows.column(rows.schema.get_field_index(n)).take(take) for n in ("node", "weight", "embedding")]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _labels(n: int, a: np.ndarray, b: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Smallest rank each of n nodes reaches over the pairs."""
    out = rank.copy()
    while True:
        low = np.minimum(out[a], out[b])
        new = out.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        if (new == out).all():
            return out
        out = new


def _compare(cosine: float):
    schema = pa.schema([("node", pa.int64()), ("other", pa.int64()), ("links", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        dims, block = table.column("dims")[0].as_py(), table.column("block")[0].as_py()
        side = table.column("side").to_numpy()
        node, weight = table.column("node").to_numpy(), table.column("weight").to_numpy()
        plain = levelled(table.column("embedding").combine_chunks().flatten().to_numpy().reshape(-1, dims).astype(np.float64))
        turned = unit(plain) @ rotation(dims)
        norm = np.sqrt(np.einsum("ij,ij->i", plain, plain))
        parts, budget = blocks(dims), budgets(dims, cosine)
        starts = [p.start for p in parts]
        visitors, homes = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(visitors) or not len(homes):
            return schema.empty_table()
        v, h = turned[visitors, parts[block]], turned[homes, parts[block]]
        square = (v * v).sum(axis=1)[:, None] + (h * h).sum(axis=1)[None, :] - 2 * (v @ h.T)
        near = (square <= budget[block] + SLACK) & (node[visitors][:, None] < node[homes][None, :])
        left, right = np.nonzero(near)
        left, right = visitors[left], homes[right]
        keep = np.zeros(len(left), bool)
        for i in range(0, len(left), STRIP):
            a, b = left[i : i + STRIP], right[i : i + STRIP]
            apart = np.add.reduceat((turned[a] - turned[b]) ** 2, starts, axis=1) <= np.array(budget)
            first = apart.argmax(axis=1)
            cos = np.einsum("ij,ij->i", plain[a], plain[b]) / (norm[a] * norm[b])
            keep[i : i + STRIP] = apart[np.arange(len(a)), first] & (first == block) & (cos >= cosine)
        left, right = left[keep], right[keep]
        if not len(left):
            return schema.empty_table()
        # A class may stand on both sides; number classes, not rows.
        ids, at = np.unique(node, return_inverse=True)
        a, b = at[left], at[right]
        links = np.bincount(a, weights=weight[right], minlength=len(ids)) + np.bincount(b, weights=weight[left], minlength=len(ids))
        reach = _labels(len(ids), a, b, np.arange(len(ids)))
        hit = np.flatnonzero(links)
        return pa.Table.from_arrays([pa.array(ids[hit]), pa.array(ids[reach[hit]]), pa.array(links[hit].astype(np.int64))], schema=schema)

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept. Only vectors of one label are compared."""
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding", F.col("label").cast("string"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    classes = materialise(
        rows.filter("usable").groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("weight")), "vectors"
    )
    key = ["label", "dims", "block", "cell"]
    shape = "label string, dims int, block int, cell long, side int"
    carried = f", node long, weight long, embedding {vectors.schema['embedding'].dataType.simpleString()}"
    counts = classes.mapInArrow(_cell_batches(cosine, False), shape).groupBy(*key).agg(
        F.ceil(F.count_if(F.col("side") == 0) / PIECE).cast("int").alias("vs"), F.ceil(F.count_if(F.col("side") == 1) / PIECE).cast("int").alias("hs")
    )
    hot = counts.filter("vs > 1 or hs > 1")
    placed = classes.mapInArrow(_cell_batches(cosine, True), shape + carried).join(hot, key, "left")
    own, others = F.when(F.col("side") == 0, F.col("vs")).otherwise(F.col("hs")), F.when(F.col("side") == 0, F.col("hs")).otherwise(F.col("vs"))
    own, others = F.greatest(F.coalesce(own, F.lit(1)), F.lit(1)), F.greatest(F.coalesce(others, F.lit(1)), F.lit(1))
    placed = placed.withColumn("mine", F.pmod(F.xxhash64("node"), own).cast("int")).withColumn("theirs", F.explode(F.sequence(F.lit(0), others - 1)))
    i, j = F.when(F.col("side") == 0, F.col("mine")).otherwise(F.col("theirs")), F.when(F.col("side") == 0, F.col("theirs")).otherwise(F.col("mine"))
    found = (
        placed.withColumns({"i": i, "j": j})
        .select(*key, "i", "j", "side", "node", "weight", "embedding")
        .groupBy(*key, "i", "j")
        .applyInArrow(_compare(cosine), "node long, other long, links long")
    )
    found = materialise(found, "near")
    groups = components(found, "node", "other").select(F.col("id").alias("node"), F.col("component"))
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = classes.join(linked, "node", "left").join(groups, "node", "left")
    known = classes.select(
        "label", "embedding", F.lit(True).alias("usable"),
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"),
    )
    out = rows.join(known, ["usable", "label", "embedding"], "left")
    own_id = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), own_id.alias("component_id"), F.col("vec_id").eqNullSafe(own_id).alias("kept"))
