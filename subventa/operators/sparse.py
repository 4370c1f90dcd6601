"""Batch trigram search: a scan with the queries' grams, or a join by set similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from subventa.functions.text import let
from subventa.functions.trigram import trigrams
from subventa.operators.bounds import collect_within, spread_small
from subventa.operators.dense import filter_groups
from subventa.operators.order import top_per_key
from subventa.operators.query_block import QueryBlock
from subventa.operators.running_top import RunningTop
from subventa.operators.similarity_join import similarity_join

# Similarity a field needs (fixed value: the public trigram default).
THRESHOLD = 0.3
# Query grams that may be broadcast, some 40 bytes each.
MAX_BROADCAST_GRAMS = 2_000_000
# Score cells and postings one step of a scan holds; slack for size bounds in doubles.
_CELLS = 200_000
_POSTINGS = 1_000_000
_SLACK = 1e-9


def query_grams(queries: DataFrame) -> DataFrame:
    """(qid, q_size, gram[, portal, country]); a blank query has no rows."""
    filters = [c for c in ("portal", "country") if c in queries.columns]
    sized = queries.select("qid", *filters, trigrams(F.col("query")).alias("_g"))
    out = sized.select("qid", *filters, F.size("_g").alias("q_size"), F.explode("_g").alias("gram"))
    return out.withColumn("country", F.upper("country")) if "country" in filters else out


def sparse_top_k(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = 50,
    threshold: float = THRESHOLD,
    max_broadcast_grams: int = MAX_BROADCAST_GRAMS,
    block: QueryBlock | None = None,
) -> DataFrame:
    """(qid, grant_id, score, rank): best of title and summary similarity >= threshold.

    Live rows only. Two sets can reach the threshold only if the smaller has
    that share of the larger, so fields of unsuitable size are left out early;
    this loses nothing. A bounded batch of queries travels to the tasks as an
    inverted gram index and the corpus is only scanned, with at most k rows per
    query and task to shuffle. A larger batch is joined by its sets' rarest grams
    (`operators/similarity_join.py`). `block` has the queries where they are held already.
    """
    grams = query_grams(queries)
    filters = [c for c in ("portal", "country") if c in grams.columns]
    live = corpus.filter(F.col("deleted_at").isNull()).select("grant_id", "title", "summary", *filters)
    index = block.grams() if block is not None else collect_within(grams, max_broadcast_grams)
    if index is not None and len(index) <= max_broadcast_grams:
        partial = _scan_with_index(index, grams, live, filters, k, threshold)
    else:
        partial = _join_by_sets(queries, live, filters, threshold)
    return top_per_key(partial, ["qid"], [F.desc("score"), F.col("grant_id")], k)


class _GramIndex:
    """Queries' grams as a vocabulary with postings, in numpy."""

    def __init__(self, rows: pd.DataFrame):
        filters = [c for c in ("portal", "country") if c in rows]
        queries = rows[["qid", "q_size", *filters]].drop_duplicates("qid").reset_index(drop=True)
        self.qids, self.sizes = queries["qid"].to_numpy(), queries["q_size"].to_numpy().astype(np.int64)
        self.groups = filter_groups(queries)
        codes, vocabulary = pd.factorize(rows["gram"])
        owner = pd.Index(queries["qid"]).get_indexer(rows["qid"])
        self.vocabulary = pa.array(vocabulary, pa.string())
        self.postings = owner[np.argsort(codes, kind="stable")]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(vocabulary)))])

    def scores(self, grams: pa.ListArray) -> np.ndarray:
        """Similarity of every listed gram set to every query."""
        n, q = len(grams), len(self.qids)
        size = pc.list_value_length(grams).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        known = pc.index_in(grams.flatten(), self.vocabulary).to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(n), size)
        hit = ~np.isnan(known) if known.dtype.kind == "f" else np.ones(len(known), dtype=bool)
        gram, owner = known[hit].astype(np.int64), owner[hit]
        length = self.starts[gram + 1] - self.starts[gram]
        shared = np.zeros(n * q, dtype=np.int64)
        cuts = np.searchsorted(np.cumsum(length), np.arange(_POSTINGS, length.sum(), _POSTINGS))
        for g, o, ln in zip(np.split(gram, cuts), np.split(owner, cuts), np.split(length, cuts)):
            # positions of all postings of these grams, one run after the other
            first = np.cumsum(ln) - ln
            at = np.arange(ln.sum()) - np.repeat(first - self.starts[g], ln)
            shared += np.bincount(np.repeat(o * q, ln) + self.postings[at], minlength=n * q)
        shared = shared.reshape(n, q)
        return shared / (size[:, None] + self.sizes[None, :] - shared)


def _size_range(smallest: int | None, largest: int | None, threshold: float) -> tuple[float, float]:
    return (smallest or 1) * threshold - _SLACK, (largest or 0) / threshold + _SLACK


def _scan_with_index(
    rows: pd.DataFrame, grams: DataFrame, live: DataFrame, filters: list[str], k: int, threshold: float
) -> DataFrame:
    block = grams.sparkSession.sparkContext.broadcast(rows)
    sizes = rows["q_size"]
    low, high = _size_range(None, None, threshold) if rows.empty else _size_range(int(sizes.min()), int(sizes.max()), threshold)

    def sized(text: str) -> Column:
        # a field of unsuitable size cannot qualify: no grams travel for it
        def keep(g: Column) -> Column:
            return F.when(F.size(g).between(low, high), g)

        return let(trigrams(F.col(text)), keep).alias(text)

    fields = spread_small(live).select("grant_id", *filters, sized("title"), sized("summary"))
    schema = T.StructType(
        [
            T.StructField("qid", grams.schema["qid"].dataType),
            T.StructField("grant_id", live.schema["grant_id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )
    arrow_schema = to_arrow_schema(schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if block.value.empty:
            return
        index = _GramIndex(block.value)
        top = RunningTop(index.qids, k)
        step = max(1, _CELLS // max(1, len(index.qids)))
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                score = np.fmax(index.scores(part.column("title")), index.scores(part.column("summary")))
                ids = part.column("grant_id").to_numpy(zero_copy_only=False)
                for wanted, members in index.groups:
                    use = np.ones(len(ids), dtype=bool)
                    for column, value in wanted.items():
                        use &= part.column(column).to_numpy(zero_copy_only=False) == value
                    own, hits = ids[use], score[use][:, members]
                    good = hits >= threshold
                    for at in np.flatnonzero(good.any(axis=0)):
                        top.offer(members[at], own[good[:, at]], hits[good[:, at], at])
        for frame in top.frames("score"):
            yield pa.RecordBatch.from_pandas(frame, schema=arrow_schema, preserve_index=False)

    return fields.mapInArrow(scan, schema)


def _join_by_sets(queries: DataFrame, live: DataFrame, filters: list[str], threshold: float) -> DataFrame:
    """Any number of queries: pairs whose rarest grams meet, compared on whole sets."""
    left = queries.select(F.col("qid").alias("l_id"), *[F.col(c).alias(f"l_{c}") for c in filters], trigrams(F.col("query")).alias("grams"))
    allowed = None
    for c in filters:
        wanted = F.upper("l_country") if c == "country" else F.col(f"l_{c}")
        fits = wanted.isNull() | (wanted == F.col(f"r_{c}"))
        allowed = fits if allowed is None else allowed & fits
    both = F.array(trigrams(F.col("title")), trigrams(F.col("summary")))
    right = live.select(F.col("grant_id").alias("r_id"), *[F.col(c).alias(f"r_{c}") for c in filters], F.posexplode(both).alias("r_id_field", "grams"))
    pairs = similarity_join(left, right, threshold, allowed)
    return pairs.groupBy(F.col("l_id").alias("qid"), F.col("r_id").alias("grant_id")).agg(F.max("score").alias("score"))
