"""Join of two tables by the similarity of their gram sets, without the pairs that cannot reach it.

A set's grams are put in one order for both tables, the rarest first. Two sets of similarity
t share a gram among the first n - ceil(t * n) + 1 of each, so only these prefixes meet. A
meeting counts only if the sizes fit and enough grams follow on both sides; the pairs that
are left are compared on whole sets. Nothing is lost: the first gram two similar sets share
always passes these bounds.

The order comes from counts of grams in a fixed number of buckets, which is all the driver
holds. A gram that few pairs share meets in a join. One that many share is left out of it: sets
with such a gram in their prefix are packed into blocks of like size and bounded weight, which
are written once. Tasks read two blocks of fitting sizes from there, so no copy of a set is
written however many blocks it meets; parity sketches come before the whole sets, and only
similar pairs are handed on. So neither pairs that fail nor prefixes of common grams are
written anywhere, and what is written grows with the sets and the pairs found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from subventa.sources.shared import shared_path, stored

BUCKET_BITS = 16
# Pairs of rows that a gram may bring together in the join; with more, its sets meet in blocks.
CELL_ROWS = 20_000
# Grams a block holds, per pair above; with few sets it holds less, down to this part, so that all cores have some.
_GRAMS_PER_ROW = 200
_LEAST_PART = 64
# Ratio of sizes between two classes, and from which threshold a sketch tells sets apart.
_CLASS_RATIO = 1.02
_SKETCH_FROM = 0.5
# Places a folded sketch has for each gram in which similar sets may differ, its words at most, and those of a whole sketch for one of it.
_PLACES = 2.75
_SKETCH_WORDS = 64
_FOLDS = 4
# Grams looked up at once, and pairs handed on in one batch.
_LOOKED_UP = 1 << 20
_PAIRS = 100_000
_SLACK = 1e-9


def _codes(grams: pa.Array) -> np.ndarray:
    """A gram of three characters as one number, 21 bits a character."""
    points = np.frombuffer("".join(grams.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
    if len(points) != 3 * len(grams):
        raise ValueError("grams must have three characters each")
    points = points.reshape(-1, 3)
    return points[:, 0] << 42 | points[:, 1] << 21 | points[:, 2]


def _bucket(codes: np.ndarray) -> np.ndarray:
    return (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def coded(sets: DataFrame) -> DataFrame:
    """`sets` with the grams as numbers, which are compared and moved at less cost than texts."""
    schema = T.StructType([T.StructField("grams", T.ArrayType(T.LongType())) if f.name == "grams" else f for f in sets.schema.fields])
    arrow = to_arrow_schema(schema)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("grams")
            column = batch.column(at)
            size = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
            codes = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(_codes(column.flatten())))
            yield pa.RecordBatch.from_arrays([codes if i == at else c for i, c in enumerate(batch.columns)], schema=arrow)

    return sets.mapInArrow(code, schema)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all grams, and how many each row has."""
    return column.flatten().to_numpy(), pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)


def gram_counts(sets: DataFrame) -> np.ndarray:
    """Coded rows per bucket of grams; at most 2**BUCKET_BITS rows reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            n += np.bincount(_bucket(_flat(batch.column(0))[0]), minlength=len(n))
        hit = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(n[hit])], names=["bucket", "n"])

    out = np.zeros(1 << BUCKET_BITS, np.int64)
    for r in sets.select("grams").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def _ordered(codes: np.ndarray, size: np.ndarray, counts: np.ndarray, threshold: float) -> tuple[np.ndarray, ...]:
    """Row, gram, bucket and place of all grams in prefixes, set by set and the rarest first."""
    row = np.repeat(np.arange(len(size)), size)
    bucket = _bucket(codes)
    order = np.lexsort((codes, counts[bucket], row))
    pos = np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size)
    use = pos < (size - np.ceil(threshold * size - _SLACK).astype(np.int64) + 1)[row]
    return row[use], codes[order][use], bucket[order][use], pos[use]


def _prefixes(sets: DataFrame, counts: np.ndarray, cuts: np.ndarray, others: np.ndarray, threshold: float, own: str, other: str) -> DataFrame:
    """The sets' columns but the grams, once per gram of the prefix and cell of the other side; a gram without cells is left out.

    Adds gram, size, pos (place in the order), `own` (the row's cell) and `other` (the cells it visits).
    """
    kept = [f for f in sets.schema.fields if f.name != "grams"]
    schema = T.StructType(
        [*kept, *(T.StructField(n, T.LongType()) for n in ("gram", "size", "pos")), *(T.StructField(n, T.IntegerType()) for n in (own, other))]
    )
    arrow = to_arrow_schema(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("grams")
            codes, size = _flat(batch.column(at))
            row, codes, bucket, pos = _ordered(codes, size, counts, threshold)
            visits = others[bucket]
            again = np.repeat(np.arange(len(row)), visits)
            visit = np.arange(len(again)) - np.repeat(np.cumsum(visits) - visits, visits)
            cell = (row % cuts[bucket])[again]  # rows of a stored batch are dealt in turn
            columns = [batch.column(i).take(pa.array(row[again])) for i in range(batch.num_columns) if i != at]
            numbers = [codes[again], size[row][again], pos[again]]
            yield pa.RecordBatch.from_arrays(
                [*columns, *map(pa.array, numbers), pa.array(cell.astype(np.int32)), pa.array(visit.astype(np.int32))], schema=arrow
            )

    return sets.mapInArrow(cut, schema)


def _meeting(counts: np.ndarray, asked: np.ndarray, cell_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Per bucket of grams whether its rows meet in the join, and whether they are too many for it."""
    pairs = counts.astype(np.float64) * asked
    return (pairs > 0) & (pairs <= cell_rows), pairs > cell_rows


def _met(left: DataFrame, right: DataFrame, counts: np.ndarray, asked: np.ndarray, threshold: float, allowed: Column | None, cell_rows: int) -> DataFrame:
    cells = _meeting(counts, asked, cell_rows)[0].astype(np.int64)
    one, order = np.ones_like(counts), counts + asked
    a = _prefixes(left, order, one, cells, threshold, "l_cell", "r_cell").withColumnsRenamed({"size": "l_size", "pos": "l_pos"})
    b = _prefixes(right, order, one, cells, threshold, "r_cell", "l_cell").withColumnsRenamed({"size": "r_size", "pos": "r_pos"})
    t = F.lit(threshold)
    l_size, r_size = F.col("l_size"), F.col("r_size")
    fits = (l_size >= t * r_size - _SLACK) & (r_size >= t * l_size - _SLACK)
    follow = F.least(l_size - F.col("l_pos"), r_size - F.col("r_pos"))
    fits = fits & (follow * (1 + t) >= t * (l_size + r_size) - _SLACK)
    met = a.join(b, ["gram", "l_cell", "r_cell"]).filter(fits)
    if allowed is not None:
        met = met.filter(allowed)
    return met


def candidates(left: DataFrame, right: DataFrame, threshold: float, allowed: Column | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Distinct pairs (the ids of both sides) that share a prefix gram within the bounds, one that at most `cell_rows` pairs have.

    `left` has columns named l_*, `right` r_*, and both `grams`, coded. Ids are l_id and all columns of the right that
    begin with r_id; `allowed` is a further condition on the other columns.
    """
    met = _met(left, right, gram_counts(right), gram_counts(left), threshold, allowed, cell_rows)
    return met.select("l_id", *[c for c in right.columns if c.startswith("r_id")]).distinct()


def _class_of(size: np.ndarray) -> np.ndarray:
    """Class of sizes from 1 on; it does not fall as they grow."""
    return np.floor(np.log(np.maximum(size, 1)) / np.log(_CLASS_RATIO)).astype(np.int32)


def _marked(sets: DataFrame, side: str, order: np.ndarray, hot: np.ndarray, threshold: float) -> DataFrame:
    """Adds whether a set has a gram for the blocks in its prefix, and its size class."""
    added = [T.StructField(f"{side}_hot", T.BooleanType()), T.StructField(f"{side}_class", T.IntegerType())]
    schema = T.StructType([*sets.schema.fields, *added])
    arrow = to_arrow_schema(schema)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, size = _flat(batch.column(batch.schema.get_field_index("grams")))
            row, _, bucket, _ = _ordered(codes, size, order, threshold)
            flag = np.zeros(len(size), bool)
            flag[row[hot[bucket]]] = True
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(flag), pa.array(_class_of(size))], schema=arrow)

    return sets.mapInArrow(mark, schema)


def _words(size: int, threshold: float) -> int:
    """Words of the folded sketch of sets of up to this size, a power of two."""
    least = _PLACES * 2 * size * (1 - threshold) / (1 + threshold) / 64
    return min(_SKETCH_WORDS, max(2, 1 << max(0, int(np.ceil(least)) - 1).bit_length()))


def _sketches(codes: np.ndarray, size: np.ndarray, words: int) -> np.ndarray:
    """Per set the parity of its grams in each of 64 * words places; two sets differ in at least as many grams as places."""
    row = np.repeat(np.arange(len(size)), size)
    mixed = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    # Twice, so that the first character, which stands in the highest bits, decides, too.
    place = ((mixed ^ mixed >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(33)) % np.uint64(64 * words)
    bits = np.empty((len(size), words), np.uint64)
    ends = np.concatenate([[0], np.cumsum(size)])
    step = max(1, (1 << 21) // (64 * words))
    for start in range(0, len(size), step):
        n = min(step, len(size) - start)
        own = slice(ends[start], ends[start + n])
        odd = np.bincount((row[own] - start) * 64 * words + place[own].astype(np.int64), minlength=n * 64 * words) & 1
        bits[start : start + n] = np.packbits(odd.astype(np.uint8).reshape(n, words, 64), axis=2).reshape(n, words, 8).view(np.uint64)[:, :, 0]
    return bits


def _folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """Sketches of fewer words, a power of two: places that are equal modulo 64 * words become one."""
    return np.bitwise_xor.reduce(sketches.reshape(len(sketches), -1, words), axis=1)


def _packed(sets: DataFrame, side: str, ids: list[str], kept: list[str], weight: int, threshold: float) -> DataFrame:
    """Blocks of sets of like size, a row each, of about `weight` grams.

    A row has the sets' other columns, their sizes (which ascend), the distinct grams, the grams as places among these, and sketches.
    """
    spark = sets.sparkSession
    # A row a class: some hundreds.
    found = sets.groupBy(f"{side}_class").agg(F.sum(F.size("grams")).alias("n")).orderBy(f"{side}_class").collect()
    total = sum(r["n"] for r in found)
    weight = max(1, weight // _LEAST_PART, min(weight, total // (2 * spark.sparkContext.defaultParallelism)))
    cuts, block, held = [], 0, 0
    for r in found:
        parts = max(1, round(r["n"] / weight))
        if held and held + r["n"] > weight:
            block, held = block + 1, 0
        cuts.append((r[f"{side}_class"], block, parts))
        block, held = (block + parts, 0) if parts > 1 else (block, held + r["n"])
    small = F.broadcast(spark.createDataFrame(cuts, f"{side}_class int, first int, parts int"))
    own = (F.col("first") + F.pmod(F.xxhash64(*ids), "parts")).cast("int")
    dealt = sets.join(small, f"{side}_class").select(own.alias("block"), F.struct(*kept).alias("row"), "grams")
    schema = T.StructType(
        [
            *(T.StructField(n, T.IntegerType()) for n in ("block", "low", "high")),
            T.StructField("rows", T.ArrayType(dealt.schema["row"].dataType)),
            *(T.StructField(n, T.BinaryType()) for n in ("sizes", "codes", "grams", "sketches")),
        ]
    )
    arrow = to_arrow_schema(schema)

    def pack(table: pa.Table) -> pa.Table:
        size = pc.list_value_length(table.column("grams")).to_numpy().astype(np.int64)
        table, size = table.take(pa.array(np.argsort(size, kind="stable"))), np.sort(size)
        codes = table.column("grams").combine_chunks().flatten().to_numpy()
        sketches = _sketches(codes, size, _FOLDS * _words(int(size[-1]), threshold)) if threshold >= _SKETCH_FROM else np.empty(0, np.uint64)
        known, at = np.unique(codes, return_inverse=True)
        rows = table.column("row").combine_chunks()
        values = [
            table.column("block")[0].as_py(), int(size[0]), int(size[-1]), pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows),
            *(x.tobytes() for x in (size.astype(np.int32), known, at.astype(np.uint16 if len(known) <= 1 << 16 else np.uint32), sketches)),
        ]
        columns = [v if isinstance(v, pa.Array) else pa.array([v], f.type) for v, f in zip(values, arrow)]
        return pa.Table.from_arrays(columns, names=arrow.names).cast(arrow)

    blocks = dealt.repartition(max(1, block + 1), "block").groupBy("block").applyInArrow(pack, schema)
    return stored(blocks, shared_path(spark, f"blocks-{side}"))


class _Block:
    """Sets of a block, read without a copy; `size` ascends."""

    def __init__(self, batch: pa.RecordBatch, at: int, side: str):
        def numbers(name: str, kind: type) -> np.ndarray:
            return np.frombuffer(batch.column(f"{side}_{name}")[at].as_buffer(), kind)

        self.rows = batch.column(f"{side}_rows")[at].values
        self.number = batch.column(f"{side}_block")[at].as_py()
        self.size, self.codes = numbers("sizes", np.int32).astype(np.int64), numbers("codes", np.int64)
        self.begin = np.cumsum(self.size) - self.size
        count = int(self.size.sum())
        wide = len(batch.column(f"{side}_grams")[at].as_buffer()) > 2 * count
        self.grams = numbers("grams", np.uint32 if wide else np.uint16)
        self.sketches = numbers("sketches", np.uint64).reshape(len(self.size), -1)


def _near(left: _Block, right: _Block, threshold: float, once: bool) -> Iterator[tuple[int, np.ndarray]]:
    """For each left set the right ones that may reach the threshold by size and sketch; with `once`, only those behind it."""
    most = (1 - threshold) / (1 + threshold)
    sketched = threshold >= _SKETCH_FROM
    if sketched:
        words = min(left.sketches.shape[1], right.sketches.shape[1])
        whole = [_folded(s.sketches, words) for s in (left, right)]
        first = [_folded(s, words // _FOLDS) for s in whole]
        columns = np.ascontiguousarray(first[1].T)
        other, some = np.empty(len(right.size), np.uint64), np.empty(len(right.size), np.uint8)
        # Eight bits may run over with more than four words, which would only keep more.
        apart = np.empty(len(right.size), np.uint8 if len(columns) <= 4 else np.uint16)
        close = np.zeros(-(-len(right.size) // 8) * 8, bool)
    sizes, starts = np.unique(left.size, return_index=True)
    for n, start, end in zip(sizes, starts, [*starts[1:], len(left.size)]):
        low = int(np.searchsorted(right.size, np.ceil(threshold * n - _SLACK), "left"))
        high = int(np.searchsorted(right.size, np.floor(n / threshold + _SLACK), "right"))
        if low >= high:
            continue
        if sketched:
            limit = np.floor(most * (n + right.size[low:high]) + _SLACK)
            coarse = np.minimum(limit, np.iinfo(apart.dtype).max).astype(apart.dtype)
        for i in range(start, end):
            begin = max(low, i + 1) if once else low
            if begin >= high:
                break
            if not sketched:
                yield i, np.arange(begin, high)
                continue
            x, c, d = other[: high - begin], some[: high - begin], apart[: high - begin]
            for word, column in enumerate(columns):
                np.bitwise_xor(column[begin:high], first[0][i, word], out=x)
                if word:
                    np.add(d, np.bitwise_count(x, out=c), out=d)
                else:
                    np.bitwise_count(x, out=d)
            np.less_equal(d, coarse[begin - low :], out=close[: high - begin])
            close[high - begin : -(-(high - begin) // 8) * 8] = False
            eights = np.flatnonzero(close[: -(-(high - begin) // 8) * 8].view(np.uint64))
            if len(eights):
                near = (eights[:, None] * 8 + np.arange(8)).ravel()
                near = near[close[near]] + begin
                differ = np.bitwise_count(whole[1][near] ^ whole[0][i]).sum(axis=1, dtype=np.int64)
                near = near[differ <= limit[near - low]]
                if len(near):
                    yield i, near


def _similar(left: _Block, right: _Block, threshold: float, once: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For left sets the right ones that reach the threshold, and their similarity, on whole sets."""
    at = np.searchsorted(left.codes, right.codes)
    at[at == len(left.codes)] = 0
    same = np.where(left.codes[at] == right.codes, at, len(left.codes)).astype(np.int32)
    r_grams = None
    own = np.zeros(len(left.codes) + 1, bool)
    for i, near in _near(left, right, threshold, once):
        if r_grams is None:
            r_grams = same[right.grams]
        n = left.size[i]
        mine = left.grams[left.begin[i] : left.begin[i] + n]
        own[mine] = True
        step = max(1, _LOOKED_UP // int(right.size[near[-1]]))
        for start in range(0, len(near), step):
            some = near[start : start + step]
            length = right.size[some]
            first = np.cumsum(length) - length
            flat = np.arange(length.sum()) + np.repeat(right.begin[some] - first, length)
            shared = np.add.reduceat(own[r_grams[flat]], first, dtype=np.int64)
            score = shared / (n + length - shared)
            good = score >= threshold
            if good.any():
                yield i, some[good], score[good]
        own[mine] = False


def _by_blocks(left: DataFrame, right: DataFrame | None, threshold: float, cell_rows: int) -> DataFrame:
    """All columns but the grams, and score, of the similar pairs of marked sets that have grams for the blocks.

    Without a right side those of the left with one another, each pair once; the r_* columns are then called like the left ones.
    """
    weight, once = _GRAMS_PER_ROW * cell_rows, right is None
    blocks, fields = {}, []
    for side, sets in (("l", left), ("r", right)):
        if sets is None:
            blocks[side] = blocks["l"]
            fields += [T.StructField(f"r_{f.name[2:]}", f.dataType) for f in fields]
            continue
        kept = [c for c in sets.columns if c not in ("grams", f"{side}_hot", f"{side}_class")]
        ids = ["l_id"] if side == "l" else [c for c in kept if c.startswith("r_id")]
        blocks[side] = _packed(sets.filter(f"{side}_hot"), side, ids, kept, weight, threshold)
        fields += [sets.schema[c] for c in kept]
    schema = T.StructType([*fields, T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(schema)
    a, b = (blocks[s].select(*[F.col(c).alias(f"{s}_{c}") for c in blocks[s].columns]) for s in ("l", "r"))
    fits = (F.col("l_high") >= threshold * F.col("r_low") - _SLACK) & (F.col("r_high") >= threshold * F.col("l_low") - _SLACK)
    if once:
        fits = fits & (F.col("l_block") <= F.col("r_block"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                x, y = (_Block(batch, at, s) for s in ("l", "r"))

                def pairs(found: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
                    i, j = np.repeat([f[0] for f in found], [len(f[1]) for f in found]), np.concatenate([f[1] for f in found])
                    columns = [*x.rows.take(pa.array(i)).flatten(), *y.rows.take(pa.array(j)).flatten(), pa.array(np.concatenate([f[2] for f in found]))]
                    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

                found, n = [], 0
                for hits in _similar(x, y, threshold, once and x.number == y.number):
                    found.append(hits)
                    n += len(hits[1])
                    if n >= _PAIRS:
                        yield pairs(found)
                        found, n = [], 0
                if found:
                    yield pairs(found)

    # Every task reads its blocks from where they are stored: nothing is shuffled, and a pair of blocks is written nowhere.
    return a.hint("shuffle_replicate_nl").join(b, fits).mapInArrow(compare, schema)


def similarity_join(left: DataFrame, right: DataFrame | None, threshold: float, allowed: Column | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """l_id, the r_id* columns and score of all pairs whose sets have at least the similarity `threshold` (above 0).

    As `candidates`, but `grams` are distinct texts of three characters; ids are unique on each side, rows without one are
    left out. An empty or null set is similar to none. Sets of sizes that no set of the other side allows are left out first.
    Both sides are stored, as the counts, the prefixes and the comparison read them. Of two sets that both have grams for the
    blocks the blocks decide, of others the join.

    Without a right side the left is joined with itself: r_id is an l_id then, and each pair of different ids comes once, the
    smaller id on the left. The sets are stored and compared once, and only l_id is kept of the other columns.
    """
    if not 0 < threshold <= 1:
        raise ValueError("a similarity join needs a threshold above 0 and up to 1")
    alone = right is None
    if alone and allowed is not None:
        raise ValueError("a condition needs two sides")
    spark = left.sparkSession
    ids = ["r_id"] if alone else [c for c in right.columns if c.startswith("r_id")]

    def kept(sets: DataFrame, keys: list[str], low: float, high: float) -> DataFrame:
        named = sets.filter(F.size("grams").between(low, high))
        for c in keys:
            named = named.filter(F.col(c).isNotNull())
        return named

    def mirrored(sets: DataFrame) -> DataFrame:
        return sets.select(*[F.col(c).alias(f"r_{c[2:]}" if c.startswith("l_") else c) for c in sets.columns])

    if alone:
        left, allowed = left.select("l_id", "grams"), F.col("l_id") < F.col("r_id")
    left = stored(coded(kept(left, ["l_id"], 1, float("inf"))), shared_path(spark, "sets-l"))
    asked = gram_counts(left)
    if alone:
        counts = asked
    else:
        ends = left.agg(F.min(F.size("grams")).alias("low"), F.max(F.size("grams")).alias("high")).head()
        low, high = ((ends["low"] or 1) * threshold - _SLACK, (ends["high"] or 0) / threshold + _SLACK)
        right = stored(coded(kept(right, ids, low, high)), shared_path(spark, "sets-r"))
        counts = gram_counts(right)
    hot = _meeting(counts, asked, cell_rows)[1]

    def marked(sets: DataFrame, side: str) -> DataFrame:
        if not hot.any():
            return sets.withColumn(f"{side}_hot", F.lit(False))
        return stored(_marked(sets, side, counts + asked, hot, threshold), shared_path(spark, f"marked-{side}"))

    left = marked(left, "l")
    right = mirrored(left) if alone else marked(right, "r")
    cold = ~(F.col("l_hot") & F.col("r_hot"))
    pairs = _met(left, right, counts, asked, threshold, cold if allowed is None else cold & allowed, cell_rows).select("l_id", *ids).distinct()
    sets = pairs.join(left.select("l_id", "l_hot", F.col("grams").alias("l_grams")), "l_id").join(
        right.select(*ids, "r_hot", F.col("grams").alias("r_grams")), ids
    ).filter(cold)
    shared = F.size(F.array_intersect("l_grams", "r_grams"))
    scored = sets.select("l_id", *ids, (shared / (F.size("l_grams") + F.size("r_grams") - shared)).alias("score"))
    scored = scored.filter(F.col("score") >= threshold)
    if not hot.any():
        return scored
    close = _by_blocks(left, None if alone else right, threshold, cell_rows)
    if alone:
        close = close.select(F.least("l_id", "r_id").alias("l_id"), F.greatest("l_id", "r_id").alias("r_id"), "score")
    return scored.unionByName((close if allowed is None else close.filter(allowed)).select("l_id", *ids, "score"))
