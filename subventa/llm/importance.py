"""Resampling of documents towards a target corpus by hashed word n-grams.

Features of a text are its runs of 1 to `RUN` words; a feature's bucket is the CRC-32 of
its bytes modulo `BUCKETS`. A bucket's gain is the logarithm of its share in the target
over its share in the documents, a document's weight the sum of its features' gains, and
the highest weights, disturbed by Gumbel noise from the id, are drawn.

1. Texts are cut into slices of bounded size. The distinct words of a slice, each between
   two delimiters, go into an Aho-Corasick automaton. Payload of a word: the CRC-32 of its
   bytes, that of a blank and its bytes, and its length.
2. The automaton scans the slice once and emits a payload per word. The CRC of a longer run
   is composed from the payloads of adjacent words: crc(a + b) = shift(crc(a), len(b)) ^
   crc(b), where the shift is linear, so a table per power of two does it. No n-gram is
   ever built or hashed as a string.
3. Buckets are written once, two bytes a feature, and read for counting and for scoring.
   Counts are summed per task, then per bucket.
4. Scores are numbered over sorted ranges, so no task ranks all documents.

The driver holds one count and one gain per bucket, whatever the table's size.

Defined cases: a null or empty text has no features and weight 0. Whole texts are scanned,
however long; a slice holds `SLICE` bytes or one longer text, a word of any length is a
payload like others. Repeated rows are scored and drawn one by one. A null doc_id takes
its noise from an empty id. Ties in score go to the smaller doc_id (null first). Empty
tables give no rows; an empty target leaves gains from the documents alone. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subventa.llm import utf8
from subventa.llm.ranking import numbered
from subventa.llm.store import materialise

BUCKETS = 10_000
RUN = 3
SLICE = 8 * 1024 * 1024
MIN_WORDS = 20
SEED = 42

_DIGITS, _LETTERS = range(0x30, 0x3A), range(0x61, 0x7B)


def _normaliser() -> bytes:
    """Bytes of words in lower case, a blank for any other ASCII byte; bytes from 128 belong to words."""
    table = bytearray(b" " * 128) + bytearray(range(128, 256))
    for b in [*_DIGITS, *_LETTERS]:
        table[b] = b
    for b in _LETTERS:
        table[b - 32] = b
    return bytes(table)


NORMAL = _normaliser()


def _shift_tables(powers: int = 32) -> list[np.ndarray]:
    """Of every power of two, a table per byte of a CRC: what it becomes when so many bytes follow."""
    crc_of = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)  # linear part
    values = np.arange(256, dtype=np.uint32)
    one = np.stack([(v := values << np.uint32(8 * j)) >> np.uint32(8) ^ crc_of[v & np.uint32(255)] for j in range(4)])
    tables = [one]
    for _ in range(powers - 1):
        tables.append(_through(tables[-1], tables[-1]))
    return tables


def _through(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    low = np.uint32(255)
    return table[0][crc & low] ^ table[1][crc >> np.uint32(8) & low] ^ table[2][crc >> np.uint32(16) & low] ^ table[3][crc >> np.uint32(24)]


def shifted(crc: np.ndarray, n_bytes: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """What the CRCs add to those of texts that have `n_bytes` more bytes."""
    out = crc.copy()
    for k in range(int(n_bytes.max(initial=0)).bit_length()):
        hit = np.flatnonzero(n_bytes >> k & 1)
        out[hit] = _through(tables[k], out[hit])
    return out


def scanned(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Payloads (CRC, CRC behind a blank, bytes) of the slice's words in order, and the row of each."""
    import ahocorasick

    # A text may end in a word and the next begin with one: a blank between them moves row r by r + 1 places.
    raw = data.tobytes()
    texts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    whole = (b" " + b" ".join(texts) + b" ").translate(NORMAL).decode("latin-1")
    words = list(set(whole.split(" ")) - {""})
    if not words:
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, word in enumerate(words):
        automaton.add_word(f" {word} ", i)
    automaton.make_automaton()
    found = np.fromiter(chain.from_iterable(automaton.iter(whole)), np.int64).reshape(-1, 2)
    as_bytes = [w.encode("latin-1") for w in words]
    payload = np.array([[zlib.crc32(w), zlib.crc32(b" " + w), len(w)] for w in as_bytes], np.int64)
    which = found[:, 1]
    row = np.searchsorted(offsets[1:] + np.arange(1, len(offsets)), found[:, 0] - 1, "right")
    return payload[which, 0].astype(np.uint32), payload[which, 1].astype(np.uint32), payload[which, 2], row


def feature_buckets(data: np.ndarray, offsets: np.ndarray, tables: list[np.ndarray], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features row by row, the features of every row, and its words."""
    rows = len(offsets) - 1
    alone, behind, size, row = scanned(data, offsets)
    crc, at = alone, np.arange(len(alone))
    found, owner = [crc], [row]
    for more in range(1, RUN):
        ok = at < len(row) - more
        at, crc = at[ok], crc[ok]
        ok = row[at] == row[at + more]
        at, crc = at[ok], crc[ok]
        last = at + more
        crc = shifted(crc, size[last] + 1, tables) ^ behind[last]
        found.append(crc)
        owner.append(row[at])
    owners = np.concatenate(owner)
    order = np.argsort(owners, kind="stable")
    return (np.concatenate(found) % np.uint32(buckets))[order], np.bincount(owners, minlength=rows), np.bincount(row, minlength=rows)


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables = _shift_tables()
    for batch in batches:
        for part, data, offsets in utf8.slices(batch, "text", SLICE):
            found, features, words = feature_buckets(data, offsets, tables)
            places = np.concatenate([[0], np.cumsum(features)]) * 2
            packed = pa.Array.from_buffers(
                pa.large_binary(), len(features), [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(found.astype("<u2"))]
            )
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(words), pa.array(features), packed.cast(pa.binary())], names=["doc_id", "n_words", "n_features", "buckets"]
            )


def features(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_features and the buckets of all features, as little-endian 16-bit numbers."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _scan_batches, "doc_id long, n_words long, n_features long, buckets binary"
    )


def _buckets_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    places = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    found = np.frombuffer(raw, "<u2", count=(places[-1] - places[0]) // 2, offset=int(places[0])) if raw is not None and places[-1] > places[0] else np.zeros(0, "<u2")
    return found, (places - places[0]) // 2


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        counts += np.bincount(_buckets_of(batch.column(0))[0], minlength=BUCKETS)
    hit = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(counts[hit])], names=["bucket", "n"])


def bucket_counts(rows: DataFrame) -> np.ndarray:
    """Features of each bucket in the whole table; at most `BUCKETS` rows reach the driver."""
    counts = np.zeros(BUCKETS, np.int64)
    for r in rows.select("buckets").mapInArrow(_count_batches, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[r["bucket"]] = r["n"]
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of a bucket's share in the target over its share in the source, smoothed by one."""
    s_all, t_all = int(source.sum()) + BUCKETS, int(target.sum()) + BUCKETS
    return np.array(
        [math.floor(1000 * math.log(float((t + 1) * s_all) / float((s + 1) * t_all))) for s, t in zip(source.tolist(), target.tolist())], np.int64
    )


def _weigh_batches(gain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, places = _buckets_of(batch.column(3))
            sums = np.concatenate([[0], np.cumsum(gain[found])])
            weight = sums[places[1:]] - sums[places[:-1]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return run


def noise(doc_id: str, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the digest of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weighed(docs: DataFrame, target: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every document; `target` has the texts to move towards."""
    rows = materialise(features(docs), "features")
    wanted = features(target.select(F.lit(None).cast("long").alias("doc_id"), "text"))
    gain = gains(bucket_counts(rows), bucket_counts(wanted))
    scored = rows.mapInArrow(_weigh_batches(gain), "doc_id long, n_words long, n_features long, weight long")
    return scored.withColumn("score", F.col("weight") + noise("doc_id", seed))


def resampled(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """`weighed` with `rank`: 1, 2, ... for the drawn `percent` of the documents with `min_words` words, null for others."""
    rows = materialise(weighed(docs, target, seed).withColumn("enough", F.col("n_words") >= min_words), "weights")
    order = [F.col("enough").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("n_features"), F.col("weight")]
    placed = numbered(rows, [], order, "scores")
    drawn = rows.filter("enough").count() * percent // 100
    return placed.withColumn("rank", F.when(F.col("enough") & (F.col("idx") < drawn), F.col("idx") + 1)).drop("idx", "n", "enough")
