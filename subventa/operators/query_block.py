"""A bounded batch of queries, fetched once for all legs of a search."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subventa.functions.trigram import trigrams

# Queries a block holds: 64 MiB at 1,024 doubles each.
MAX_BLOCK_QUERIES = 8_192
_GRAMS, _COUNTRY = "_block_grams", "_block_country"


@dataclass(frozen=True)
class QueryBlock:
    """`frame` has the queries in the plan itself, so nothing computes them again; `table` has them on the driver."""

    frame: DataFrame
    table: pa.Table

    def __len__(self) -> int:
        return self.table.num_rows

    def _rows(self, *more: str) -> pd.DataFrame:
        names = ["qid", *[c for c in ("portal", "country") if c in self.frame.columns], *more]
        rows = self.table.select([_COUNTRY if c == "country" else c for c in names])
        return rows.rename_columns(names).to_pandas()

    def vectors(self) -> pd.DataFrame:
        """qid, filters and embedding of the queries that have one."""
        rows = self._rows("embedding")
        return rows[rows["embedding"].notna()].reset_index(drop=True)

    def grams(self) -> pd.DataFrame:
        """qid, filters, q_size and gram, a row per gram; a blank query has none."""
        rows = self._rows(_GRAMS)
        rows["q_size"] = rows[_GRAMS].map(len)
        return rows[rows["q_size"] > 0].explode(_GRAMS, ignore_index=True).rename(columns={_GRAMS: "gram"})


def held(queries: DataFrame, limit: int = MAX_BLOCK_QUERIES) -> QueryBlock | None:
    """The queries as a block if there are at most `limit`, else None. One pass, which fetches no more than that."""
    extra = {}
    if "query" in queries.columns:
        extra[_GRAMS] = trigrams(F.col("query"))
    if "country" in queries.columns:
        extra[_COUNTRY] = F.upper("country")
    rows = queries.withColumns(extra).limit(limit + 1).toArrow()
    if rows.num_rows > limit:
        return None
    return QueryBlock(queries.sparkSession.createDataFrame(rows.select(queries.columns), queries.schema), rows)
