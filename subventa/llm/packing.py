"""Packing of documents into token sequences of a fixed window.

A document is cut at multiples of the window; a full piece is a sequence of its
own, the rest (shorter than the window) is packed with others:

1. The rests' histogram has one entry per length, so it is smaller than the
   window whatever the table's size. Combinations of two or three lengths that
   fill a window are enumerated.
2. Non-negative least squares finds repeat counts of the combinations against
   the histogram, by coordinate descent on the steepest coordinates, which keeps
   most counts at zero. It stops when no step moves half a repeat.
3. Counts are rounded down; what is left is packed greedily, the largest length
   first and then the largest that fits. Rests that would leave more than `SLACK`
   places free are laid end to end instead and cut where a sequence is full, so
   that only the last sequence is padded.

Rows meet the plan by their rank among the rows of equal length. Ranks come from
blocks of bounded size, so a length that many documents share is spread.

Defined cases: a null text is an empty one, its only token is the end mark. Special
strings of the vocabulary inside a text are their one id, as the library has it by default.
Whole texts are tokenised, however long.
Repeated rows are packed one by one, a null doc_id is carried along, extra
columns are not. An empty table gives no pieces. Plans depend on the rows alone,
so a task that runs again makes the same pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from subventa.llm.store import materialise

WINDOW = 1024
END = 0
# Rows ranked together.
RANKED = 50_000
# Free places a sequence of uncut rests may leave.
SLACK = 4
# Coordinates that may step at once; they share no length, so none disturbs another.
TOGETHER = 512
# The descent ends when no repeat count is off by more than one in this many rests (and by half a repeat at least).
PRECISION = 200_000


def combinations(counts: np.ndarray, window: int = WINDOW, slack: int = SLACK) -> np.ndarray:
    """Lengths of two (leaving `slack` at most) or three (leaving none) that fill a window; 0 is no piece."""
    have = counts > 0
    lengths = np.flatnonzero(have)
    lengths = lengths[lengths > 0]
    found = []
    for gap in range(slack + 1):
        rest = window - gap - lengths
        ok = rest >= lengths
        ok[ok] &= have[rest[ok]]
        found.append(np.stack([lengths[ok], rest[ok], np.zeros(ok.sum(), np.int64)], axis=1))
    for a in lengths[lengths <= window // 3]:
        b = lengths[(lengths >= a) & (2 * lengths <= window - a)]
        c = window - a - b
        ok = have[c]
        found.append(np.stack([np.full(ok.sum(), a), b[ok], c[ok]], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def repeat_counts(combos: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """x >= 0 with small |A x - counts|, A holding how often a combination uses a length.

    Every coordinate is within max(0.5, rests / PRECISION) of its best value given the others, so the number of
    steps does not grow with the counts; what that leaves is packed greedily.
    """
    off = max(0.5, float(counts[1:].sum()) / PRECISION)
    x = np.zeros(len(combos))
    left = counts.astype(float)
    left[0] = 0.0
    uses = (combos[:, :, None] == combos[:, None, :]) & (combos[:, :, None] > 0)
    weight = uses.sum(axis=(1, 2)).astype(float)  # squared column norms
    while len(x):
        step = np.maximum(left[combos].sum(axis=1) / weight, -x)
        gain = step * step * weight
        best = np.argsort(-gain, kind="stable")[:TOGETHER] if len(gain) <= TOGETHER else np.argpartition(-gain, TOGETHER)[:TOGETHER]
        best = best[np.abs(step[best]) >= off]
        if not len(best):
            break
        taken = np.zeros(len(counts), bool)
        for j in best[np.argsort(-gain[best], kind="stable")]:
            lengths = combos[j][combos[j] > 0]
            if taken[lengths].any():
                continue
            taken[lengths] = True
            x[j] += step[j]
            np.subtract.at(left, lengths, step[j])
    return x


def greedy(counts: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) that use up `counts`; each round uses up one length at least."""
    counts = counts.copy()
    out = []
    top = window - 1
    while True:
        while top > 0 and counts[top] == 0:
            top -= 1
        if top <= 0:
            return out
        used = {}
        pattern, space = [], window
        length = top
        while length > 0:
            if length <= space and counts[length] > used.get(length, 0):
                pattern.append(length)
                used[length] = used.get(length, 0) + 1
                space -= length
            else:
                length = min(length - 1, space)
        repeats = min(int(counts[k]) // v for k, v in used.items())
        for k, v in used.items():
            counts[k] -= repeats * v
        out.append((tuple(pattern), repeats))


def plan(counts: np.ndarray, window: int = WINDOW, slack: int = SLACK) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """Patterns with repeats, and the rests to lay end to end; together they hold every rest once.

    `counts[l]` rests have length l.
    """
    counts = counts.astype(np.int64).copy()
    counts[0] = 0
    combos = combinations(counts, window, slack)
    x = np.floor(repeat_counts(combos, counts) + 1e-9).astype(np.int64)
    out = []
    for j in sorted(np.flatnonzero(x), key=lambda j: (-x[j], j)):
        lengths, times = np.unique(combos[j][combos[j] > 0], return_counts=True)
        repeats = int(min(x[j], (counts[lengths] // times).min()))
        if repeats:
            counts[lengths] -= repeats * times
            out.append((tuple(int(v) for v in sorted(combos[j][combos[j] > 0], reverse=True)), repeats))
    stream = np.zeros(window, np.int64)
    for lengths, repeats in greedy(counts, window):
        if window - sum(lengths) <= slack:
            out.append((lengths, repeats))
        else:
            np.add.at(stream, list(lengths), repeats)
    return out, stream


def segments(patterns: list[tuple[tuple[int, ...], int]], stream: np.ndarray, window: int = WINDOW) -> tuple[dict[str, np.ndarray], int]:
    """Where the ranks of every length go, as arrays sorted by (length, first rank); and the number of sequences.

    `step` is 0 for a pattern: rank r lies in sequence + r - rank at the offset.
    In the stream it is the length: the rest begins offset + (r - rank) * step
    places behind the start of the sequence.
    """
    taken = np.zeros(window, np.int64)
    rows = []
    sequence = 0
    for lengths, repeats in patterns:
        offset = 0
        for length in lengths:
            rows.append((length, taken[length], sequence, offset, 0))
            taken[length] += repeats
            offset += length
        sequence += repeats
    at = 0
    for length in range(window - 1, 0, -1):
        if stream[length]:
            rows.append((length, taken[length], sequence, at, length))
            at += length * int(stream[length])
    rows.sort()
    names = ("length", "rank", "sequence", "offset", "step")
    table = np.array(rows, np.int64).reshape(-1, 5)
    return {k: table[:, i].copy() for i, k in enumerate(names)}, sequence + -(-at // window)


def _token_batches(ranks_path: str, json_path: str, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64
        import json

        import tiktoken
        from public_tokenizers import PATTERN

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        with open(json_path, encoding="utf-8") as lines:
            marks = {t["content"]: t["id"] for t in json.load(lines)["added_tokens"]}
        fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=marks)
        slow = []

        def encode(text: str) -> np.ndarray:
            try:
                return fast.encode_to_numpy(text, allowed_special="all", disallowed_special=())
            except BaseException as error:  # the pattern engine gives up on extreme texts
                if isinstance(error, (KeyboardInterrupt, SystemExit, MemoryError)):
                    raise
                if not slow:
                    from tokenizers import Tokenizer

                    slow.append(Tokenizer.from_file(json_path))
                return np.array(slow[0].encode(text, add_special_tokens=False).ids, np.uint32)

        for batch in batches:
            sizes, checks, rests = [], [], []
            for text in batch.column(1):
                ids = np.append(encode(text.as_py() or ""), np.uint32(END)).astype("<u4")
                sizes.append(len(ids))
                checks.append([zlib.crc32(ids[i : i + window].tobytes()) for i in range(0, len(ids), window)])
                rests.append(ids[len(ids) - len(ids) % window :].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(checks, pa.list_(pa.int64())), pa.array(rests, pa.binary())],
                names=["doc_id", "doc_tokens", "checks", "rest_ids"],
            )

    return run


def tokenized(docs: DataFrame, window: int = WINDOW, ranks: str | None = None, vocabulary: str | None = None) -> DataFrame:
    """doc_id, doc_tokens, the CRC-32 of every piece and the ids of the rest. The rank file holds the vocabulary's merges as ranks."""
    import public_tokenizers

    ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _token_batches(ranks, vocabulary, window), "doc_id long, doc_tokens long, checks array<long>, rest_ids binary"
    )


def _piece_batches(places: dict[str, np.ndarray], rest_sequences: int, window: int):
    big = np.int64(1) << np.int64(48)
    keys = places["length"] * big + places["rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            tokens, rank, full_before = (col[n].to_numpy(zero_copy_only=False) for n in ("doc_tokens", "rank", "full_before"))
            full, rest = tokens // window, tokens % window
            at = np.searchsorted(keys, rest * big + rank, "right") - 1
            if len(keys):
                sequence, step = places["sequence"][at], places["step"][at]
                nth = rank - places["rank"][at]
                begin = places["offset"][at] + nth * step
                sequence = np.where(step > 0, sequence + begin // window, sequence + nth)
                offset = np.where(step > 0, begin % window, places["offset"][at])
            else:
                sequence = offset = step = np.zeros(len(tokens), np.int64)
            head = np.minimum(rest, window - offset)
            pieces = full + (rest > 0) + (head < rest)
            row = np.repeat(np.arange(len(tokens)), pieces)
            k = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            part = k - full[row]  # 0 and 1: first and second piece of the rest
            start = np.where(part == 1, full[row] * window + head[row], k * window)
            length = np.where(part < 0, window, np.where(part == 0, head[row], rest[row] - head[row]))
            checks = col["checks"].flatten().to_numpy()
            listed = full + (rest > 0)
            crc = checks[np.minimum(k, listed[row] - 1) + (np.cumsum(listed) - listed)[row]]
            for i in np.flatnonzero(head < rest):
                ids = col["rest_ids"][int(i)].as_py()
                first = np.searchsorted(row, i) + full[i]
                crc[first], crc[first + 1] = zlib.crc32(ids[: 4 * head[i]]), zlib.crc32(ids[4 * head[i] :])
            yield pa.RecordBatch.from_arrays(
                [
                    col["doc_id"].take(pa.array(row)),
                    pa.array(start),
                    pa.array(length),
                    pa.array(crc),
                    pa.array(tokens[row]),
                    pa.array(np.where(part < 0, rest_sequences + full_before[row] + k, sequence[row] + part)),
                    pa.array(np.where(part == 0, offset[row], 0)),
                ],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return run


def packed(docs: DataFrame, window: int = WINDOW, ranks: str | None = None, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    rows = materialise(tokenized(docs, window, ranks, vocabulary), "tokens").withColumns(
        {"rest": F.col("doc_tokens") % window, "full": F.floor(F.col("doc_tokens") / window)}
    )
    # One row per length of a rest: fewer than the window.
    lengths = rows.groupBy("rest").agg(F.count(F.lit(1)).alias("n"), F.sum("full").alias("full")).collect()
    counts, full = np.zeros(window, np.int64), np.zeros(window, np.int64)
    for r in lengths:
        counts[r["rest"]], full[r["rest"]] = r["n"], r["full"]
    patterns, stream = plan(counts, window)
    places, sequences = segments(patterns, stream, window)
    before = np.cumsum(full) - full

    of_length = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("rest").cast("int") + 1)
    # Ids travel only with lengths that the stream may cut.
    rows = rows.withColumn("rest_ids", F.when(of_length(stream) > 0, F.col("rest_ids")))
    blocked = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "doc_tokens", "checks"), of_length(counts // RANKED + 1)))
    sums = blocked.groupBy("rest", "block").agg(F.count(F.lit(1)).alias("n"), F.sum("full").alias("f"))
    earlier = Window.partitionBy("rest").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        "rest", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"), F.coalesce(F.sum("f").over(earlier), F.lit(0)).alias("f0")
    )
    inner = Window.partitionBy("rest", "block").orderBy("doc_id", "doc_tokens", "checks")
    ranked = (
        blocked.withColumns({"i": F.row_number().over(inner), "f": F.sum("full").over(inner.rowsBetween(Window.unboundedPreceding, 0))})
        .join(sums, ["rest", "block"])
        .select(
            "doc_id",
            "doc_tokens",
            "checks",
            "rest_ids",
            (F.col("n0") + F.col("i") - 1).alias("rank"),
            (of_length(before) + F.col("f0") + F.col("f") - F.col("full")).alias("full_before"),
        )
    )
    return ranked.mapInArrow(
        _piece_batches(places, sequences, window),
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    )
