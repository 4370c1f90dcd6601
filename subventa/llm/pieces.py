"""N-best segmentation into SentencePiece pieces, and decoding.

A text's lattice has an edge for every piece of the model that stands at a place;
a path's score is the sum of its pieces' scores. No piece of the model crosses
from another character to a space mark, so the lattice falls into chunks (space
marks and what follows up to the next), and paths of chunks are chosen
independently:

1. Forward Viterbi scores of all distinct chunks of a slice are computed at once,
   chunks of equal length in one array; backward scores tell how much the second
   best path of a chunk loses.
2. The N best paths of a text differ from the best in the N - 1 chunks that lose
   least, at most. For those an A* search runs backward over the chunk's lattice
   with the forward scores as heuristic. They are exact, so paths come out in the
   order of their scores.
3. The chunks' lists are merged, best sums first.

A character without a piece costs the lowest score less `UNKNOWN` and becomes its
UTF-8 bytes, so decoding gives the text back; the space mark itself is read as a
space. Scores that tie may come in either order; the order is the same each run.

Defined cases: null and empty texts have one segmentation without pieces and
score 0. Repeated rows are encoded one by one, a null doc_id is carried along,
extra columns are not. Texts have as many rows in the result as segmentations
exist, N at most.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subventa.llm import utf8

MARK = "▁"
UNKNOWN = 10.0
# Chunks up to this length are handled in arrays, longer ones one by one.
ARRAY_CHARS = 40
SLICE = 3 * 1024 * 1024
# Chunks whose lists a task remembers.
REMEMBERED = 50_000

_TABLE_BITS = 21


def _char_values(points: np.ndarray) -> np.ndarray:
    return utf8.mix(points.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))


class Model:
    """Pieces and scores of a SentencePiece model file, with tables for array look-ups."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.bytes = [b""] * n
        self.byte_ids = [0] * 256
        self.pieces: dict[str, tuple[int, float]] = {}
        for i in range(n):
            text = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(text[3:5], 16)
                self.bytes[i], self.byte_ids[value] = bytes([value]), i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.bytes[i] = text.replace(MARK, " ").encode()
                self.pieces[text] = (i, float(sp.get_score(i)))
                if any(a != MARK and b == MARK for a, b in zip(text, text[1:])):
                    raise ValueError("a piece crosses into a space mark; chunks would not be independent")
        self.longest = max(map(len, self.pieces))
        self.unknown = min(s for _, s in self.pieces.values()) - UNKNOWN
        # Score and ids of every piece, and () for what only begins one.
        self.prefixes: dict[str, tuple] = {p[:i]: () for p in self.pieces for i in range(1, len(p))}
        self.prefixes |= {p: (score, (i,)) for p, (i, score) in self.pieces.items()}
        names = list(self.pieces)
        self.ids = np.array([self.pieces[p][0] for p in names] + [-1])
        self.scores = np.array([self.pieces[p][1] for p in names] + [-np.inf])
        points = np.frombuffer("".join(names).encode("utf-32-le"), "<u4")
        ends = np.cumsum([len(p) for p in names])
        self.hashes = np.append(_hashes(*_prefix(points), ends - [len(p) for p in names], ends), np.uint64(0))
        # Two tables by different bits; what meets in the first goes to the second.
        size = 1 << _TABLE_BITS
        self.first = np.full(size, len(names), np.int32)
        self.second = np.full(size, len(names), np.int32)
        for k, h in enumerate(self.hashes[:-1]):
            a, b = int(h) & (size - 1), (int(h) >> _TABLE_BITS) & (size - 1)
            if self.first[a] == len(names):
                self.first[a] = k
            elif self.second[b] == len(names):
                self.second[b] = k
            else:
                raise ValueError("piece hashes collide")
        self.sizes = np.array([len(b) for b in self.bytes])
        self.begins = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.blob = np.frombuffer(b"".join(self.bytes), np.uint8)

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """Place of the piece with each hash, or the last place if there is none."""
        mask = np.uint64((1 << _TABLE_BITS) - 1)
        k = self.first[(h & mask).astype(np.int64)]
        wrong = self.hashes[k] != h
        if wrong.any():
            other = self.second[((h[wrong] >> np.uint64(_TABLE_BITS)) & mask).astype(np.int64)]
            k = k.copy()
            k[wrong] = np.where(self.hashes[other] == h[wrong], other, len(self.ids) - 1)
        return k

    def best_paths(self, chunk: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best (score, ids) of a chunk: forward Viterbi, then A* backward."""
        size, known = len(chunk), self.prefixes
        forward = [0.0] + [-np.inf] * size
        ending = [[] for _ in range(size + 1)]  # (start, score, ids) of the edges that end at a place
        for start in range(size):
            so_far = forward[start]
            for end in range(start + 1, size + 1):
                found = known.get(chunk[start:end])
                if found is None:
                    break
                if found:
                    score, ids = found
                    ending[end].append((start, score, ids))
                    if so_far + score > forward[end]:
                        forward[end] = so_far + score
            if chunk[start] not in self.pieces:
                ending[start + 1].append((start, self.unknown, tuple(self.byte_ids[b] for b in chunk[start].encode())))
                forward[start + 1] = max(forward[start + 1], so_far + self.unknown)
        heap = [(-forward[size], 0, size, 0.0, None)]
        count, out = 1, []
        while heap and len(out) < n:
            _, _, at, done, tail = heapq.heappop(heap)
            if at == 0:
                ids: list[int] = []
                while tail is not None:
                    own, tail = tail
                    ids += own
                out.append((done, ids))
                continue
            for start, score, ids in ending[at]:
                heapq.heappush(heap, (-(done + score + forward[start]), count, start, done + score, (ids, tail)))
                count += 1
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the text; the space that stands for the text's beginning goes."""
        sizes = self.sizes[ids]
        at = np.repeat(self.begins[ids] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        return self.blob[at].tobytes()[1:]


def _prefix(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = utf8.powers(len(points) + 1)
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(_char_values(points) * up[: len(points)], out=sums[1:])
    return sums, down


def _hashes(sums: np.ndarray, down: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return utf8.mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _array_chunks(model: Model, sums: np.ndarray, down: np.ndarray, starts: np.ndarray, length: int):
    """For chunks of one length: best score, loss of the second best path, ids padded with -1, and whether a character has no piece."""
    m = len(starts)
    none = len(model.ids) - 1
    piece = np.full((length, min(length, model.longest), m), none, np.int32)  # by start and length - 1
    for s in range(length):
        for n in range(1, min(length - s, model.longest) + 1):
            piece[s, n - 1] = model.look_up(_hashes(sums, down, starts + s, starts + s + n))
    score = model.scores[piece]
    forward = np.full((length + 1, m), -np.inf)
    forward[0] = 0
    took = np.zeros((length + 1, m), np.int64)
    for e in range(1, length + 1):
        for n in range(1, min(e, model.longest) + 1):
            new = forward[e - n] + score[e - n, n - 1]
            better = new > forward[e]
            forward[e] = np.where(better, new, forward[e])
            took[e] = np.where(better, n, took[e])
    lost = (score[:, 0] == -np.inf).any(axis=0)
    backward = np.full((length + 1, m), -np.inf)
    backward[length] = 0
    for s in range(length - 1, -1, -1):
        for n in range(1, min(length - s, model.longest) + 1):
            np.maximum(backward[s], score[s, n - 1] + backward[s + n], out=backward[s])
    ids = np.full((length, m), -1, np.int64)
    at, rows = np.full(m, length), np.arange(m)
    on_path = np.zeros(piece.shape, bool)
    for k in range(length - 1, -1, -1):
        live = (at > 0) & ~lost
        if not live.any():
            break
        r, n = rows[live], took[at[live], rows[live]]
        s = at[live] - n
        ids[k, r] = model.ids[piece[s, n - 1, r]]
        on_path[s, n - 1, r] = True
        at[live] = s
    second = np.full(m, -np.inf)
    for s in range(length):
        for n in range(1, min(length - s, model.longest) + 1):
            through = np.where(on_path[s, n - 1], -np.inf, forward[s] + score[s, n - 1] + backward[s + n])
            np.maximum(second, through, out=second)
    with np.errstate(invalid="ignore"):
        return forward[length], forward[length] - second, ids, lost


def merged(lists: list[list[float]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n largest sums of one entry per list (each sorted, largest first), with the places taken."""
    best = [(0.0, ())]
    for own in lists:
        best = heapq.nlargest(n, ((a + b, (*p, k)) for a, p in best for k, b in enumerate(own)), key=lambda x: x[0])
    return best


def encoded(texts: list[str], model: Model, n: int, memory: dict[str, list]) -> list[list[tuple[float, np.ndarray]]]:
    """The n best (score, ids) of every text."""
    marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
    points = np.frombuffer("".join(marked).encode("utf-32-le"), "<u4")
    whole = "".join(marked)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in marked])])
    if not len(points):
        return [[(0.0, np.zeros(0, np.uint32))] for _ in texts]
    mark = points == ord(MARK)
    begin = mark.copy()
    begin[1:] &= ~mark[:-1]
    begin[bounds[:-1][bounds[:-1] < len(points)]] = True
    starts = np.flatnonzero(begin)
    ends = np.append(starts[1:], len(points))
    first = np.searchsorted(starts, bounds)
    sums, down = _prefix(points)
    _, lead, which = np.unique(_hashes(sums, down, starts, ends), return_index=True, return_inverse=True)
    total, loss = np.zeros(len(lead)), np.full(len(lead), np.inf)
    lists: dict[int, list] = {}

    def paths(u: int) -> list:
        chunk = whole[starts[lead[u]] : ends[lead[u]]]
        found = memory.get(chunk)
        if found is None:
            if len(memory) >= REMEMBERED:
                memory.clear()
            found = memory[chunk] = model.best_paths(chunk, n)
        return found

    lengths = (ends - starts)[lead]
    parts, part_of, place = [], np.zeros(len(lead), np.int64), np.zeros(len(lead), np.int64)
    counts = np.zeros(len(lead), np.int64)
    for length in np.unique(lengths):
        own = np.flatnonzero(lengths == length)
        slow = own
        if length <= ARRAY_CHARS:
            best, gap, ids, lost = _array_chunks(model, sums, down, starts[lead[own]], int(length))
            total[own], loss[own] = best, gap
            fine = own[~lost]
            counts[fine] = (ids[:, ~lost] >= 0).sum(axis=0)
            part_of[fine], place[fine] = len(parts), np.concatenate([[0], np.cumsum(counts[fine])[:-1]])
            flat = ids[:, ~lost].T
            parts.append(flat[flat >= 0])
            slow = own[lost]
        for u in slow:
            found = paths(int(u))
            total[u], loss[u] = found[0][0], found[0][0] - found[1][0] if len(found) > 1 else np.inf
            counts[u], part_of[u] = len(found[0][1]), len(parts)
            parts.append(np.array(found[0][1], np.int64))
    begins = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    pool = np.concatenate(parts)
    at = begins[part_of] + place
    out = []
    for i in range(len(texts)):
        own = which[first[i] : first[i + 1]]
        if not len(own):
            out.append([(0.0, np.zeros(0, np.uint32))])
            continue
        sizes = counts[own]
        into = np.concatenate([[0], np.cumsum(sizes)])
        ids = pool[np.repeat(at[own] - into[:-1], sizes) + np.arange(into[-1])].astype(np.uint32)
        base = float(total[own].sum())
        gaps = loss[own]
        near = np.argsort(gaps, kind="stable")[: n - 1] if len(own) < 4 * n else np.sort(np.argpartition(gaps, n - 1)[: n - 1])
        near = [int(k) for k in near if np.isfinite(gaps[k])]
        choices = [paths(int(own[k])) for k in near]
        results = []
        for lost_score, picks in merged([[s - c[0][0] for s, _ in c] for c in choices], n):
            swapped, end, new = [], 0, sorted((k, c[p][1]) for k, c, p in zip(near, choices, picks) if p)
            for k, path in new:
                swapped += [ids[end : into[k]], np.array(path, np.uint32)]
                end = into[k + 1]
            results.append((base + lost_score, np.concatenate([*swapped, ids[end:]]) if swapped else ids))
        out.append(results)
    return out


def _encode_batches(path: str, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memory = Model(path), {}
        for batch in batches:
            for part, _, _ in utf8.slices(batch, "text", SLICE):
                texts = [t or "" for t in part.column(1).to_pylist()]
                rows = {"doc_id": [], "rank": [], "score": [], "ids": [], "decoded": []}
                for doc, text, found in zip(part.column(0).to_pylist(), texts, encoded(texts, model, n, memory)):
                    wanted = text.replace(MARK, " ").encode()
                    for rank, (score, ids) in enumerate(found):
                        rows["doc_id"].append(doc)
                        rows["rank"].append(rank)
                        rows["score"].append(score)
                        rows["ids"].append(ids.astype("<u4").tobytes())
                        rows["decoded"].append(model.decode(ids.astype(np.int64)) == wanted)
                yield pa.RecordBatch.from_pydict(
                    rows, schema=pa.schema([("doc_id", pa.int64()), ("rank", pa.int32()), ("score", pa.float64()), ("ids", pa.binary()), ("decoded", pa.bool_())])
                )

    return run


def segmentations(docs: DataFrame, n: int = 4, model: str | None = None) -> DataFrame:
    """doc_id, rank from 0, score, ids (little-endian unsigned 32-bit), and whether the ids decode to the text."""
    import public_tokenizers

    model = model or public_tokenizers.path("piece_bpe_32k.model")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _encode_batches(model, n), "doc_id long, rank int, score double, ids binary, decoded boolean"
    )


def _decode_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(path)
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            texts = [None if b is None else model.decode(np.frombuffer(b, "<u4").astype(np.int64)).decode("utf-8", "replace") for b in batch.column(at).to_pylist()]
            yield batch.set_column(at, pa.field("text", pa.string()), pa.array(texts, pa.string()))

    return run


def decoded(rows: DataFrame, model: str | None = None) -> DataFrame:
    """`rows` with column `ids` replaced by `text`; null ids give a null text."""
    import public_tokenizers
    from pyspark.sql import types as T

    model = model or public_tokenizers.path("piece_bpe_32k.model")
    schema = T.StructType([T.StructField("text", T.StringType()) if f.name == "ids" else f for f in rows.schema])
    return rows.mapInArrow(_decode_batches(model), schema)


def digests(rows: DataFrame) -> DataFrame:
    """One row per segmentation with the number of its pieces and the CRC-32 of its ids."""
    return rows.select("doc_id", "rank", "score", (F.octet_length("ids") / 4).cast("long").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"), "decoded")
