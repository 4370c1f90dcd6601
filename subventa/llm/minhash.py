"""Near-duplicate documents by MinHash bands, odd sketches and full sets.

1. A text's set holds the hashes of its distinct word shingles. Documents of the
   same set are one class, so copies cost one row each from here on.
2. MinHash values are cut into bands. Classes that share a band are candidates;
   per band bucket every class meets the bucket's smallest class only.
3. The MinHash samples also toggle bits of a parity bitmap, the odd sketch. Of
   two sketches the XOR population count grows with the samples that differ and
   is precise where similarity is high; a pair far below the threshold goes.
4. The rest is confirmed on full sets. Classes of confirmed pairs are joined.
5. Where a bucket still holds several groups, its largest class meets the classes of
   other groups the same way, `STARS` times, each time without the one before.
6. Other classes that share a bucket but not yet a group are compared with each other
   in blocks by size and sketch. Rows that find a partner meet again with their
   full sets, and links that join two groups are written. Pairs that only a test
   sees are never rows.

Chances to lose a link at the threshold similarity: no band is shared with at most
`MISS`; the sketch limit lies six standard deviations above the samples expected
to differ.

Defined cases: a text without words (null and empty ones too) has an empty set,
no links, its own component and is kept; a text with fewer words than a shingle
is one shingle. Rows that repeat a doc_id are judged by their own text and count
as one node. A null doc_id is no node: such a row takes the component of its
copies if it has any. Extra columns are not carried; join on doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subventa.llm import utf8
from subventa.llm.graph import components
from subventa.llm.store import free_name, materialise

# Chance that a pair at the threshold shares no band.
MISS = 1e-8
SKETCH_WORDS = 16  # 64 bits each
# Rows of one side when members of a bucket are compared by sketch, and bytes of their sets when by set.
BLOCK_ROWS, BLOCK_BYTES = 4096, 16 * 1024 * 1024

# Rounds in which the largest class of a bucket meets the others.
STARS = 2

_SEED = 0x5EED5EED


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(_SEED).integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1)


def banding(percent: int) -> tuple[int, int]:
    """Bands and values per band: a pair at the threshold shares none with a chance of at most MISS."""
    rows = 6 if percent >= 75 else 4 if percent >= 60 else 2
    return max(1, int(np.ceil(np.log(MISS) / np.log(1 - (percent / 100) ** rows)))) if percent < 100 else 1, rows


def sketch_limit(samples: int, percent: int) -> int:
    """XOR bits a pair at the threshold stays below, but for six standard deviations."""
    differ = 1 - percent / 100
    return int(2 * (samples * differ + 6 * (samples * differ * (1 - differ)) ** 0.5)) + 1


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles in order, and where each row's begin (one more entry than rows)."""
    starts, ends, first = utf8.words(data, offsets)
    lowered = utf8.LOWER[data]
    hashed = utf8.span_hashes(lowered, starts, ends)
    counts = np.diff(first)
    out_counts = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    out_first = np.zeros(len(first), np.int64)
    np.cumsum(out_counts, out=out_first[1:])
    total = int(out_first[-1])
    row = np.repeat(np.arange(len(counts)), out_counts)
    at = first[row] + np.arange(total) - out_first[row]
    end = first[row] + counts[row]
    out = np.zeros(total, np.uint64)
    for i in range(width):
        inside = at + i < end
        step = np.zeros(total, np.uint64)
        step[inside] = hashed[(at + i)[inside]]
        out = utf8.mix(out * np.uint64(0xC2B2AE3D27D4EB4F) + step + inside.astype(np.uint64))
    return out, out_first


def distinct_sets(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of every row, and where each row's begin."""
    parts = []
    counts = np.zeros(len(first) - 1, np.int64)
    for i in range(len(first) - 1):
        part = np.sort(values[first[i] : first[i + 1]])
        if len(part) > 1:
            part = part[np.concatenate(([True], part[1:] != part[:-1]))]
        counts[i] = len(part)
        parts.append(part)
    begins = np.zeros(len(first), np.int64)
    np.cumsum(counts, out=begins[1:])
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), begins


def _signature_batches(bands: int, rows: int, width: int):
    multipliers = _multipliers(bands * rows)
    samples = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in utf8.slices(batch, "text"):
                sets, begins = distinct_sets(*shingle_hashes(data, offsets, width))
                counts = np.diff(begins)
                full = np.flatnonzero(counts)
                n = part.num_rows
                fa, fb = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                band = np.zeros((n, bands), np.uint64)
                sketch = np.zeros((n, SKETCH_WORDS), np.uint64)
                if len(full):
                    at = begins[:-1][full]
                    fa[full] = np.add.reduceat(utf8.mix(sets), at)
                    fb[full] = np.bitwise_xor.reduceat(utf8.mix(sets + np.uint64(_SEED)), at)
                    small = (sets >> np.uint64(32)).astype(np.uint32)
                    scaled = np.empty_like(small)
                    mins = np.empty((len(full), samples), np.uint32)
                    for i in range(samples):
                        np.multiply(small, multipliers[i], out=scaled)
                        mins[:, i] = np.minimum.reduceat(scaled, at)
                    keys = utf8.mix(mins.astype(np.uint64) + (np.arange(samples, dtype=np.uint64) << np.uint64(32)))
                    bits = (keys & np.uint64(64 * SKETCH_WORDS - 1)).astype(np.int64)
                    flips = np.zeros((len(full), 64 * SKETCH_WORDS), np.uint8)
                    np.add.at(flips, (np.arange(len(full))[:, None], bits), 1)
                    packed = np.packbits(flips & 1, axis=1)
                    sketch[full] = packed.view(np.uint64)
                    grouped = keys.reshape(len(full), bands, rows)
                    key = np.zeros((len(full), bands), np.uint64) + np.arange(bands, dtype=np.uint64)
                    for i in range(rows):
                        key = utf8.mix(key * np.uint64(0xC2B2AE3D27D4EB4F) + grouped[:, :, i])
                    band[full] = key
                lists = lambda m: pa.FixedSizeListArray.from_arrays(pa.array(m.view(np.int64).ravel()), m.shape[1]).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(part.schema.get_field_index("doc_id")).cast(pa.int64()),
                        pa.array(counts),
                        pa.array(fa.view(np.int64)),
                        pa.array(fb.view(np.int64)),
                        lists(band),
                        lists(sketch),
                    ],
                    names=["doc_id", "n_shingles", "fa", "fb", "bands", "sketch"],
                )

    return run


def signatures(docs: DataFrame, bands: int, rows: int, width: int) -> DataFrame:
    """Per row: doc_id, set size, 128-bit set fingerprint, band keys and odd sketch."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _signature_batches(bands, rows, width),
        "doc_id long, n_shingles long, fa long, fb long, bands array<long>, sketch array<long>",
    )


def _set_batches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in utf8.slices(batch, "text"):
                sets, begins = distinct_sets(*shingle_hashes(data, offsets, width))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(sets.view(np.int64)))],
                    names=["node", "members"],
                )

    return run


def _bit_distance(x: str, y: str):
    bits = [F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(SKETCH_WORDS)]
    total = bits[0]
    for b in bits[1:]:
        total = total + b
    return total


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold."""
    left = sets.select(F.col("node").alias("a"), F.col("members").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("members").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    return both.filter(100 * F.col("common") >= percent * (F.size("sa") + F.size("sb") - F.col("common"))).select("a", "b")


def _sides(rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    return rows[rows["side"] == 0].reset_index(drop=True), rows[rows["side"] == 1].reset_index(drop=True)


def _stacked(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64)


class _Near:
    """Which rows of the right block a row of the left block may be linked with, by size and sketch.

    A pair belongs to its first common band only, and to the order of its ids.
    """

    def __init__(self, left: pd.DataFrame, right: pd.DataFrame, band: int, limit: int, percent: int):
        self.band, self.limit, self.percent = band, limit, percent
        self.ls, self.rs = _stacked(left["sketch"]).view(np.uint64), _stacked(right["sketch"]).view(np.uint64)
        self.lb, self.rb = _stacked(left["bands"]), _stacked(right["bands"])
        self.ln, self.rn = left["node"].to_numpy(), right["node"].to_numpy()
        self.lz, self.rz = left["n_shingles"].to_numpy(), right["n_shingles"].to_numpy()

    def of(self, i: int, right_components: np.ndarray, component: int) -> np.ndarray:
        at = np.flatnonzero((right_components != component) & (self.rn > self.ln[i]))
        low, high = np.minimum(self.rz[at], self.lz[i]), np.maximum(self.rz[at], self.lz[i])
        at = at[100 * low >= self.percent * high]
        if len(at):
            at = at[np.bitwise_count(self.rs[at] ^ self.ls[i]).sum(axis=1) <= self.limit]
        if len(at) and self.band:
            at = at[~(self.rb[at, : self.band] == self.lb[i, : self.band]).any(axis=1)]
        return at


def _crossing(limit: int, percent: int):
    """Rows of a bucket with a partner of another group that size and sketch let pass: rows, not pairs."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        left, right = _sides(rows)
        hit: dict[int, int] = {}
        if len(left) and len(right):
            near = _Near(left, right, int(rows["band"].iloc[0]), limit, percent)
            components = right["component"].to_numpy()
            for i, component in enumerate(left["component"].to_numpy()):
                at = near.of(i, components, component)
                if len(at):
                    hit[int(near.ln[i])] = int(component)
                    hit.update(zip(near.rn[at].tolist(), components[at].tolist()))
        out = pd.DataFrame({"node": pd.Series(list(hit), dtype="int64"), "component": pd.Series(list(hit.values()), dtype="int64")})
        return out.assign(band=rows["band"].iloc[0], key=rows["key"].iloc[0])[["band", "key", "node", "component"]]

    return run


def _linking(limit: int, percent: int):
    """Links between groups in a bucket, confirmed on full sets; one that joins nothing new is not written."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        left, right = _sides(rows)
        found: list[tuple[int, int]] = []
        if len(left) and len(right):
            near = _Near(left, right, int(rows["band"].iloc[0]), limit, percent)
            lc, rc = left["component"].to_numpy().copy(), right["component"].to_numpy().copy()
            sets = [np.asarray(v, np.int64) for v in right["members"]]
            sizes = np.array([len(v) for v in sets])
            owner = np.repeat(np.arange(len(sets)), sizes)
            values = np.concatenate(sets)
            order = np.argsort(values, kind="stable")
            values, owner = values[order], owner[order]
            for i in range(len(left)):
                at = near.of(i, rc, lc[i])
                if not len(at):
                    continue
                own = np.asarray(left["members"][i], np.int64)
                lo, hi = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
                times = hi - lo
                places = np.repeat(lo - (np.cumsum(times) - times), times) + np.arange(times.sum())
                common = np.bincount(owner[places], minlength=len(sets))[at]
                for j in at[100 * common >= percent * (len(own) + sizes[at] - common)]:
                    a, b = lc[i], rc[j]
                    if a != b:
                        found.append((int(near.ln[i]), int(near.rn[j])))
                        lc[lc == max(a, b)] = min(a, b)
                        rc[rc == max(a, b)] = min(a, b)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def _in_blocks(members: DataFrame, carried: list[str], weight: Column, most: int) -> DataFrame:
    """Every pair of blocks of a bucket as a group: a row stands on the left of each pair once and on the right once.

    A block weighs about `most`.
    """
    sizes = members.groupBy("band", "key").agg(F.ceil(F.sum(weight) / most).cast("int").alias("blocks"))
    placed = members.join(sizes, ["band", "key"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    spots = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda o: F.array(
            F.struct(F.col("block").alias("i"), o.alias("j"), F.lit(0).alias("side")),
            F.struct(o.alias("i"), F.col("block").alias("j"), F.lit(1).alias("side")),
        ),
    )
    return placed.withColumn("spot", F.explode(F.flatten(spots))).select("band", "key", "spot.i", "spot.j", "spot.side", *carried).groupBy("band", "key", "i", "j")


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Two texts are linked when 100 * common shingles >= percent * all shingles.
    """
    bands, rows = banding(percent)
    sig = materialise(signatures(docs, bands, rows, width), "signatures")
    limit = sketch_limit(bands * rows, percent)

    classes = sig.filter("n_shingles > 0").groupBy("fa", "fb", "n_shingles").agg(
        F.min("doc_id").alias("node"), F.min_by("bands", "doc_id").alias("bands"), F.min_by("sketch", "doc_id").alias("sketch")
    )
    classes = materialise(classes.filter("node is not null"), "classes")

    keyed = classes.select("node", F.posexplode("bands").alias("band", "key"))
    buckets = keyed.groupBy("band", "key").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least < most")
    members = materialise(keyed.join(buckets.select("band", "key", "least"), ["band", "key"]), "members")

    def plausible(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose sketches are near enough."""
        sketches = classes.select("node", "sketch")
        return (
            pairs.distinct()
            .join(sketches.select(F.col("node").alias("a"), F.col("sketch").alias("ka")), "a")
            .join(sketches.select(F.col("node").alias("b"), F.col("sketch").alias("kb")), "b")
            .filter(_bit_distance("ka", "kb") <= limit)
            .select("a", "b")
        )

    starred = materialise(plausible(members.filter("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))), "starred")

    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text")
    met = members.select("node").distinct()
    sets = texts.join(met, "node", "left_semi").mapInArrow(_set_batches(width), "node long, members array<long>")
    sets = materialise(sets, "sets")
    linked = materialise(_confirmed(starred, sets, percent), "linked")

    def in_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
        return rows.join(groups, rows["node"] == groups["id"], "left").select("band", "key", "node", F.coalesce("component", "node").alias("component"))

    def split_buckets(grouped: DataFrame) -> DataFrame:
        ends = grouped.groupBy("band", "key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max(F.struct("node", "component")).alias("top"))
        return ends.filter("lo < hi").select("band", "key", F.col("top.node").alias("top"), F.col("top.component").alias("top_component"))

    # Classes in one bucket but in different groups. The bucket's smallest has met all others; now the largest does, and
    # then the largest of those that are left.
    grouped = members.filter("node <> least").select("band", "key", "node")
    for _ in range(STARS):
        grouped = in_groups(grouped, components(linked))
        grouped = materialise(grouped.join(split_buckets(grouped), ["band", "key"]), "mixed")
        pairs = grouped.filter("component <> top_component").select(F.col("node").alias("a"), F.col("top").alias("b"))
        linked = materialise(linked.union(_confirmed(materialise(plausible(pairs), "starred"), sets, percent)), "linked")
        grouped = grouped.filter("node <> top").select("band", "key", "node")

    # What is left meets in blocks. A class has at most one bucket a band, so it meets its details once.
    grouped = in_groups(grouped, components(linked))
    mixed = grouped.join(split_buckets(grouped).select("band", "key"), ["band", "key"])
    held = mixed.groupBy("node", "component").agg(F.collect_list(F.struct("band", "key")).alias("buckets"))
    details = classes.select("node", "n_shingles", "sketch", "bands")
    mixed = materialise(held.join(details, "node").withColumn("bucket", F.explode("buckets")).select("bucket.*", *details.columns, "component"), "mixed")
    carried = ["node", "component", "n_shingles", "sketch", "bands"]
    crossing = _in_blocks(mixed, carried, F.lit(1), BLOCK_ROWS).applyInPandas(
        _crossing(limit, percent), "band int, key long, node long, component long"
    )
    crossing = materialise(crossing.distinct(), "crossing")
    detailed = details.join(sets, "node").join(crossing.select("node").distinct(), "node", "left_semi")
    full = crossing.join(detailed, "node")
    more = _in_blocks(full, [*carried, "members"], 8 * F.col("n_shingles"), BLOCK_BYTES).applyInPandas(_linking(limit, percent), "a long, b long")
    links = linked.union(materialise(more.distinct(), "linked"))
    final = components(links)

    labelled = classes.join(final, classes["node"] == final["id"], "left").select(
        "fa", "fb", "n_shingles", F.coalesce("component", "node").alias("component_id")
    )
    out = sig.select("doc_id", "n_shingles", "fa", "fb").join(labelled, ["fa", "fb", "n_shingles"], "left")
    own = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def one_of_each(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """`docs` with one row per near-duplicate group, that of the smallest doc_id; columns as they are.

    A row without doc_id stands under a negative hash of its text. Of rows that
    repeat both doc_id and text one stays.
    """
    key = free_name(docs, "_key")
    own = F.coalesce(F.col("doc_id").cast("long"), -F.abs(F.xxhash64(F.coalesce("text", F.lit("")))))
    keyed = docs.withColumn(key, own)
    kept = near_duplicates(keyed.select(F.col(key).alias("doc_id"), "text"), percent, width).filter("kept").select(F.col("doc_id").alias(key))
    counted = materialise(kept.groupBy(key).agg(F.count(F.lit(1)).alias("n")), "kept")
    left = keyed.join(counted.select(key), key, "left_semi")
    if counted.filter("n > 1").take(1):
        left = left.dropDuplicates([key, "text"])
    return left.select(docs.columns)
