"""Batch nearest-neighbour search by cosine similarity."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from subventa.operators.bounds import collect_within, spread_small
from subventa.operators.order import top_per_key
from subventa.operators.query_block import MAX_BLOCK_QUERIES, QueryBlock
from subventa.operators.running_top import RunningTop
from subventa.sources.shared import shared_path, stored

# Corpus rows compared at once, and those of one cell of the approximate search.
CELL_ROWS = 100_000
# Similarities are compared at this precision so that ranks do not depend on
# the summation order of a block product.
DIGITS = 9
_QUERY_STRIPE = 256
# Rows of a cell that are compared at once, and those looked at first.
_TILE, _FIRST_TILE = 4_096, 1_024
# From this share of pairs that meet on, a cell compares whole blocks.
_WHOLE_SHARE = 0.25


def live_vectors(corpus: DataFrame) -> DataFrame:
    """Live rows that have a vector."""
    return corpus.filter(F.col("deleted_at").isNull() & F.col("embedding").isNotNull())


def _unit(rows) -> np.ndarray:
    m = np.array([np.asarray(v, dtype=np.float64) for v in rows])
    norm = np.sqrt(np.einsum("ij,ij->i", m, m))
    with np.errstate(invalid="ignore", divide="ignore"):
        return m / norm[:, None]


def filter_groups(queries: pd.DataFrame) -> list[tuple[dict, np.ndarray]]:
    """Query positions per combination of filter values; null filters nothing."""
    keys = [c for c in ("portal", "country") if c in queries]
    if not keys:
        return [({}, np.arange(len(queries)))]
    groups: dict[tuple, list[int]] = {}
    for at, values in enumerate(queries[keys].itertuples(index=False)):
        groups.setdefault(tuple(None if pd.isna(v) else v for v in values), []).append(at)
    return [({c: v for c, v in zip(keys, g) if v is not None}, np.array(at)) for g, at in groups.items()]


class _Best:
    """Best k rows per query over the batches of one task."""

    def __init__(self, queries: pd.DataFrame, k: int, rows: int = CELL_ROWS):
        self.rows = rows
        self.top = RunningTop(queries["qid"].to_numpy(), k)
        self.block = _unit(queries["embedding"])
        self.groups = filter_groups(queries)

    def add(self, rows: pd.DataFrame) -> None:
        if len(rows) > self.rows:
            for start in range(0, len(rows), self.rows):
                self.add(rows.iloc[start : start + self.rows])
            return
        if rows.empty:
            return
        ids, vectors = rows["grant_id"].to_numpy(), _unit(rows["embedding"])
        for wanted, queries in self.groups:
            use = np.ones(len(ids), dtype=bool)
            for column, value in wanted.items():
                use &= rows[column].to_numpy() == value
            if not use.any():
                continue
            own, m = ids[use], vectors[use].T
            for start in range(0, len(queries), _QUERY_STRIPE):
                stripe = queries[start : start + _QUERY_STRIPE]
                for q, sims in zip(stripe, np.round(self.block[stripe] @ m, DIGITS)):
                    self.top.offer(q, own, sims)

    def frames(self) -> Iterator[pd.DataFrame]:
        return self.top.frames("similarity")


def _columns(df: DataFrame, id_col: str) -> list[str]:
    return [id_col, "embedding", *[c for c in ("portal", "country") if c in df.columns]]


def dense_top_k(
    queries: DataFrame, corpus: DataFrame, k: int = 50, max_block_queries: int = MAX_BLOCK_QUERIES,
    cell_rows: int = CELL_ROWS, block: QueryBlock | None = None,
) -> DataFrame:
    """(qid, grant_id, similarity, rank) of the k most similar rows per query.

    `queries`: qid, embedding and optionally portal / country, where null means
    no filter (country is compared upper-case). Exact. Up to
    `max_block_queries` queries travel to the tasks and the corpus is only
    scanned. More queries are written in blocks of about that many, and a job
    per block scans the corpus and writes the block's best rows; these jobs run
    here. Either way no corpus row is shuffled, but for inputs below one full
    split per core, and a task hands at most k rows per query on. `cell_rows`
    bounds the rows compared at once. `block` has the queries where they are
    held already.
    """
    q, rows, schema = _sides(queries, corpus)
    near = block.vectors() if block is not None else collect_within(q, max_block_queries)
    if near is not None:
        return _merged(_scan(near, rows, schema, lambda b: _Best(b, k, cell_rows))[0], k)
    return _by_blocks(q, max_block_queries, lambda b: _scan(b, rows, schema, lambda own: _Best(own, k, cell_rows)), k)


def _merged(partial: DataFrame, k: int) -> DataFrame:
    return top_per_key(partial, ["qid"], [F.desc("similarity"), F.col("grant_id")], k)


def _by_blocks(q: DataFrame, size: int, scan: Callable[[pd.DataFrame], tuple[DataFrame, Broadcast]], k: int) -> DataFrame:
    """Best rows of any number of queries: blocks of about `size` of them are written, then searched one by one.

    One block at a time is on the driver and the executors. A query's rows come from one job, so blocks need no merge.
    """
    spark = q.sparkSession
    blocks = max(1, -(-q.count() // size))
    dealt = stored(q.withColumn("_block", F.pmod(F.xxhash64("qid"), F.lit(blocks))).repartition("_block"), shared_path(spark, "queries"))
    out = shared_path(spark, "tops")
    schema = None
    for i in range(blocks):
        found, sent = scan(dealt.filter(F.col("_block") == i).drop("_block").toPandas())
        top = _merged(found, k)
        top.write.mode("overwrite").parquet(f"{out}/block={i}")
        sent.destroy()
        schema = top.schema
    return spark.read.schema(schema).parquet(*[f"{out}/block={i}" for i in range(blocks)])


def _sides(queries: DataFrame, corpus: DataFrame) -> tuple[DataFrame, DataFrame, T.StructType]:
    q = queries.filter(F.col("embedding").isNotNull()).select(*_columns(queries, "qid"))
    if "country" in q.columns:
        q = q.withColumn("country", F.upper("country"))
    filters = [c for c in ("portal", "country") if c in q.columns]
    rows = live_vectors(corpus).select("grant_id", "embedding", *filters)
    schema = T.StructType(
        [
            T.StructField("qid", q.schema["qid"].dataType),
            T.StructField("grant_id", rows.schema["grant_id"].dataType),
            T.StructField("similarity", T.DoubleType()),
        ]
    )
    return q, rows, schema


def _scan(
    queries: pd.DataFrame, rows: DataFrame, schema: T.StructType, start: Callable[[pd.DataFrame], _Best]
) -> tuple[DataFrame, Broadcast]:
    """One pass over the corpus for one bounded block of queries, and the block as it was sent."""
    block = rows.sparkSession.sparkContext.broadcast(queries)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if block.value.empty:
            return
        best = start(block.value)
        for batch in batches:
            best.add(batch)
        yield from best.frames()

    return spread_small(rows).mapInPandas(scan, schema), block


# --- approximate search ---------------------------------------------------------------


def projection_lines(dims: int, lines: int, tables: int, seed: int) -> np.ndarray:
    """(tables, dims, lines) of +1 and -1."""
    return np.random.default_rng(seed).choice(np.array([-1.0, 1.0]), size=(tables, dims, lines))


def projection_keys(vectors: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """(rows, tables): the signs along each table's lines as bits, the first line lowest."""
    bits = np.einsum("nd,tdl->ntl", vectors, directions) >= 0
    return (bits * (1 << np.arange(directions.shape[2]))).sum(axis=2)


def _keyed(df: DataFrame, lines: int, tables: int, seed: int) -> DataFrame:
    """`df` with its key in every table, `_k`."""
    schema = T.StructType([*df.schema.fields, T.StructField("_k", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            unit = _unit(batch["embedding"])
            keys = projection_keys(unit, projection_lines(unit.shape[1], lines, tables, seed))
            yield batch.assign(_k=list(keys.astype(np.int64)))

    return df.mapInPandas(run, schema)


def _rows_of(column: pa.ChunkedArray) -> np.ndarray:
    """The lists of a column as rows of a matrix."""
    parts = [np.asarray(c.flatten().to_numpy(zero_copy_only=False)) for c in column.chunks]
    return np.concatenate(parts).reshape(len(column), -1)


def _places(flags: np.ndarray) -> np.ndarray:
    """Flat places of the few flags that are set; eight are looked at at once."""
    flat = flags.ravel()
    words = flat[: len(flat) // 8 * 8].view(np.uint64)
    near = (np.flatnonzero(words)[:, None] * 8 + np.arange(8)).ravel()
    return np.concatenate([near[flat[near]], np.flatnonzero(flat[len(words) * 8 :]) + len(words) * 8])


class _Cell:
    """Best k rows, ids counted once, of the queries of one cell among those of its rows they meet by sign keys."""

    def __init__(self, queries: pa.Table, rows: pa.Table, k: int, lines: int, flips: int):
        self.k, self.flips, self.keys = k, flips, 1 << lines
        self.asked, self.rows = _unit(_rows_of(queries["embedding"])), _unit(_rows_of(rows["embedding"]))
        self.near_asked, self.near_rows = self.asked.astype(np.float32), self.rows.astype(np.float32)
        # What a product of unit vectors may be off by in single precision, at most.
        self.slack = (self.asked.shape[1] + 8) * 2.0**-22
        small = np.min_scalar_type(self.keys - 1)
        self.asked_keys, self.row_keys = _rows_of(queries["_k"]).astype(small), _rows_of(rows["_k"]).astype(small)
        self.codes, names = pd.factorize(rows["grant_id"].to_pandas(), sort=True)
        self.lone = np.zeros(len(self.codes), bool)
        self.lone[np.unique(self.codes, return_index=True)[1]] = True
        self.repeats = not self.lone.all()
        self.sims = np.full((len(self.asked), k), -np.inf)
        self.held = np.zeros((len(self.asked), k), np.int64)

    def compare(self, queries: np.ndarray, rows: np.ndarray) -> None:
        """Whole blocks where most pairs meet (keys are looked at for pairs that come near the best), by keys elsewhere."""
        queries = queries[np.isfinite(self.asked[queries]).all(axis=1)]
        rows = rows[np.isfinite(self.rows[rows]).all(axis=1)]
        if not len(queries) or not len(rows):
            return
        tables = range(self.row_keys.shape[1])
        near = np.bitwise_count(np.arange(self.keys)[:, None] ^ np.arange(self.keys)) <= self.flips
        asked, held = ([np.bincount(own[at, t], minlength=self.keys) for t in tables] for own, at in ((self.asked_keys, queries), (self.row_keys, rows)))
        pairs = sum(a @ near.astype(np.float64) @ b for a, b in zip(asked, held))
        if pairs > _WHOLE_SHARE * len(queries) * len(rows):
            self._offer(queries, rows, False)
            return
        self.repeats = True  # a pair may meet in several tables
        for t in tables:
            by_key = rows[np.argsort(self.row_keys[rows, t], kind="stable")]
            own_keys = self.row_keys[by_key, t]
            for key in np.flatnonzero(asked[t]):
                met = by_key[near[key][own_keys]]
                if len(met):
                    self._offer(queries[self.asked_keys[queries, t] == key], met, True)

    def _meet(self, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Whether the keys are near in some table; the places of queries and rows broadcast."""
        met = False
        for t in range(self.row_keys.shape[1]):
            met = met | (np.bitwise_count(self.asked_keys[queries, t] ^ self.row_keys[rows, t]) <= self.flips)
        return met

    def _offer(self, queries: np.ndarray, rows: np.ndarray, sure: bool) -> None:
        """All pairs in single precision; exact similarities for those that may be among the best."""
        # The first tile is short: where no k rows are held yet, it is looked at pair by pair.
        cuts = [0, *range(min(_FIRST_TILE, len(rows)), len(rows), _TILE), len(rows)]
        for begin, end in zip(cuts, cuts[1:]):
            tile = rows[begin:end]
            m = self.near_rows[tile].T
            for start in range(0, len(queries), _QUERY_STRIPE):
                stripe = queries[start : start + _QUERY_STRIPE]
                sims = self.near_asked[stripe] @ m
                floor = self.sims[stripe, -1].copy()
                fresh = np.flatnonzero(floor == -np.inf)
                if len(fresh) and len(tile) >= self.k:
                    use = self.lone[tile] if sure else self._meet(stripe[fresh, None], tile[None, :]) & self.lone[tile]
                    own = np.where(use, sims[fresh], -np.inf)
                    floor[fresh] = np.partition(own, len(tile) - self.k, axis=1)[:, len(tile) - self.k] - self.slack
                floor = (floor - self.slack).astype(np.float32)
                hits = _places(sims >= floor[:, None])
                q, r = stripe[hits // len(tile)], tile[hits % len(tile)]
                if not sure:
                    met = self._meet(q, r)
                    q, r = q[met], r[met]
                if len(q):
                    self._hold(q, r)

    def _hold(self, queries: np.ndarray, rows: np.ndarray) -> None:
        # Some thousands of pairs at a time: both vectors of a pair are fetched.
        exact = [np.einsum("ij,ij->i", self.asked[queries[i : i + _TILE]], self.rows[rows[i : i + _TILE]]) for i in range(0, len(rows), _TILE)]
        own, at = np.unique(queries, return_inverse=True)
        q = np.concatenate([np.repeat(np.arange(len(own)), self.k), at])
        s = np.concatenate([self.sims[own].ravel(), np.round(np.concatenate(exact), DIGITS)])
        r = np.concatenate([self.held[own].ravel(), rows])
        q, s, r = (x[s > -np.inf] for x in (q, s, r))
        if self.repeats:
            order = np.lexsort((-s, self.codes[r], q))
            q, s, r = q[order], s[order], r[order]
            c = self.codes[r]
            once = np.append(True, (q[1:] != q[:-1]) | (c[1:] != c[:-1]))
            q, s, r = q[once], s[once], r[once]
        order = np.lexsort((self.codes[r], -s, q))
        q, s, r = q[order], s[order], r[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        best = place < self.k
        self.sims[own] = -np.inf
        self.sims[own[q[best]], place[best]], self.held[own[q[best]], place[best]] = s[best], r[best]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of query and row, and similarity, of what is held."""
        q, at = np.nonzero(self.sims > -np.inf)
        return q, self.held[q, at], self.sims[q, at]


def approximate_top_k(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = 50,
    lines: int = 8,
    tables: int = 4,
    flips: int = 2,
    seed: int = 42,
    cell_rows: int = CELL_ROWS,
    cell_queries: int = MAX_BLOCK_QUERIES,
) -> DataFrame:
    """As dense_top_k, but a query meets only rows near it by sign keys.

    Each table gives a vector the signs along its lines as a key. A query looks
    up its own key and those that differ in at most `flips` bits; it is ranked
    exactly among the rows it meets in any table. So these are about
    tables * (1 + lines + ...) / 2**lines of the rows at most. More lines or
    fewer flips compare less and suit clustered vectors; the defaults suit
    vectors with little structure. Queries and rows are cut into blocks of
    bounded size by their ids; a cell is a block of either, so a query hands on
    k rows per block of rows, whatever the number of keys.
    """
    q, rows, schema = _sides(queries, corpus)
    left, right = _keyed(spread_small(q), lines, tables, seed), _keyed(spread_small(rows), lines, tables, seed)

    def blocks(df: DataFrame, size: int, name: str) -> DataFrame:
        return df.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / size)).cast("int").alias(name))

    cuts = F.broadcast(blocks(q, cell_queries, "_bs").crossJoin(blocks(rows, cell_rows, "_cs")))

    def block_of(column: str, count: str) -> Column:
        return F.pmod(F.xxhash64(column), F.col(count)).cast("int")

    def every(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    left = left.crossJoin(cuts).withColumns({"_b": block_of("qid", "_bs"), "_c": every("_cs")}).drop("_bs", "_cs")
    right = right.crossJoin(cuts).withColumns({"_c": block_of("grant_id", "_cs"), "_b": every("_bs")}).drop("_bs", "_cs")
    arrow = to_arrow_schema(schema)

    def cell_best(own: pa.Table, chunk: pa.Table) -> pa.Table:
        if not own.num_rows or not chunk.num_rows:
            return arrow.empty_table()
        cell = _Cell(own, chunk, k, lines, flips)
        filters = own.select([c for c in ("portal", "country") if c in own.column_names]).to_pandas()
        for wanted, asked in filter_groups(filters) if len(filters.columns) else [({}, np.arange(own.num_rows))]:
            use = np.ones(chunk.num_rows, dtype=bool)
            for column, value in wanted.items():
                use &= chunk[column].to_pandas().to_numpy() == value
            cell.compare(asked, np.flatnonzero(use))
        at, row, sims = cell.found()
        return pa.table([own["qid"].take(at), chunk["grant_id"].take(row), sims], schema=arrow)

    met = left.groupBy("_b", "_c").cogroup(right.groupBy("_b", "_c")).applyInArrow(cell_best, schema)
    once = met.groupBy("qid", "grant_id").agg(F.max("similarity").alias("similarity"))
    return top_per_key(once, ["qid"], [F.desc("similarity"), F.col("grant_id")], k)
