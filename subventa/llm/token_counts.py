"""Token counts of a word-end BPE vocabulary by rank-synchronous merging of arrays.

1. Special strings are cut out of the raw text, each one token. What lies between is brought
   to NFC and lower case, and cut into pre-tokens by the classes of its code points: runs of
   letters, single digits, runs of other characters, English contractions.
2. A slice's pre-tokens are held as one ragged array of symbols, a byte each at first, the
   last one of a pre-token in its word-end form. Equal pre-tokens are held once.
3. In every round each sequence applies its own lowest-rank pair at all its places at once,
   left to right; sequences without a pair leave. What survives is counted.

A round is exact because every merge makes a symbol of its own that only later ranks
use: no merge brings a pair of lower rank. The loader holds the vocabulary to that.

Sequences of more than `LONG` symbols would need as many rounds, so theirs are merged place
by place from a heap, to the same result. Code points that this Python does not know
yet are classed by the library's own rules; such texts take its normaliser and splitter and
then the same merging.

Defined cases: a null text is an empty one and has no tokens. Whole texts are counted,
whatever their length; a slice holds `SLICE` bytes or one longer text. Repeated rows are
counted one by one, a null doc_id is carried along, an empty table gives no rows, other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subventa.llm import utf8

LIMIT = 2048
SLICE = 2 * 1024 * 1024
LONG = 1024
NO_RANK = np.int64(1) << np.int64(40)

SPACE, LETTER, DIGIT, OTHER, UNKNOWN = range(5)
# Fixed values of the vocabulary: contractions are tokens of their own.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    for p in range(0x110000):
        category = unicodedata.category(chr(p))
        if category[0] == "L":
            out[p] = LETTER
        elif category[0] == "N":
            out[p] = DIGIT
        elif category == "Cn":
            out[p] = UNKNOWN
        elif category[0] == "Z" or 9 <= p <= 13 or p == 0x85:
            out[p] = SPACE
    return out


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next from 256 on."""
    own = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b if b in own else spare))
        spare += b not in own
    return out


class Vocabulary:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as lines:
            spec = json.load(lines)
        model = spec["model"]
        ids, end = model["vocab"], model["end_of_word_suffix"]
        letters = byte_letters()
        self.inner = np.array([ids[c] for c in letters], np.int64)
        self.last = np.array([ids[c + end] for c in letters], np.int64)
        self.size = len(ids)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right = (np.array([ids[m[i]] for m in merges], np.int64) for i in (0, 1))
        self.made = np.array([ids[a + b] for a, b in merges], np.int64)
        born = np.full(max(ids.values()) + 1, -1)
        born[self.made] = np.arange(len(merges))
        if len(set(self.made.tolist())) < len(merges) or (np.maximum(born[left], born[right]) >= np.arange(len(merges))).any():
            raise ValueError("a merge of this vocabulary may bring a pair of lower rank")
        keys = left * self.size + right
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        added = spec["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("special strings that take in what stands around them are not known")
        self.special = re.compile("|".join(re.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))) if added else None
        self.library = Tokenizer.from_file(path)
        self.byte_of = {c: b for b, c in enumerate(letters)}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.order[at], NO_RANK)

    def survivors(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """How many symbols each sequence of the ragged array keeps."""
        counts = lengths.copy()
        many = lengths > LONG
        if many.any():
            begins = np.cumsum(lengths) - lengths
            for i in np.flatnonzero(many):
                counts[i] = self._long(symbols[begins[i] : begins[i] + lengths[i]])
        mine = ~many & (lengths > 1)
        symbols = symbols[np.repeat(mine, lengths)]
        owner = np.repeat(np.flatnonzero(mine), lengths[mine])
        rank = self._pairs(symbols, owner)
        while len(symbols):
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            size = np.diff(np.append(first, len(owner)))
            low = np.minimum.reduceat(rank, first)
            counts[owner[first]] = size
            live = low < NO_RANK
            if not live.all():
                stay = np.repeat(live, size)
                symbols, owner, rank = symbols[stay], owner[stay], rank[stay]
                low, size = low[live], size[live]
                if not len(symbols):
                    break
            hit = np.flatnonzero(rank == np.repeat(low, size))
            # Of places that overlap (a pair of equal symbols in a row), every second one from the left.
            follows = np.concatenate([[False], np.diff(hit) == 1])
            if follows.any():
                start = np.maximum.accumulate(np.where(follows, 0, np.arange(len(hit))))
                hit = hit[(np.arange(len(hit)) - start) % 2 == 0]
            symbols[hit] = self.made[rank[hit]]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            place = hit - np.arange(len(hit))
            symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
            stale = np.unique(np.concatenate([place, place[place > 0] - 1]))
            rank[stale] = self._pairs(symbols, owner, stale)
        return counts

    def _pairs(self, symbols: np.ndarray, owner: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """Ranks of the pairs that begin at the places."""
        at = np.arange(len(symbols)) if at is None else at
        out = np.full(len(at), NO_RANK)
        inner = np.flatnonzero(at + 1 < len(symbols))
        inner = inner[owner[at[inner]] == owner[at[inner] + 1]]
        out[inner] = self.ranks(symbols[at[inner]], symbols[at[inner] + 1])
        return out

    def _long(self, symbols: np.ndarray) -> int:
        """Symbols that one long sequence keeps: pairs leave a heap by rank and place."""
        symbol = symbols.tolist()
        after = [*range(1, len(symbol)), -1]
        before = [-1, *range(len(symbol) - 1)]
        rank = self.ranks(symbols[:-1], symbols[1:])
        heap = [(int(r), i, symbol[i], symbol[i + 1]) for i, r in enumerate(rank) if r < NO_RANK]
        heapq.heapify(heap)
        known: dict[tuple[int, int], int] = {}
        left = len(symbol)

        def push(i: int) -> None:
            pair = symbol[i], symbol[after[i]]
            r = known.get(pair)
            if r is None:
                r = known[pair] = int(self.ranks(np.array(pair[:1]), np.array(pair[1:]))[0])
            if r < NO_RANK:
                heapq.heappush(heap, (r, i, *pair))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != a or j < 0 or symbol[j] != b:
                continue
            symbol[i], symbol[j] = int(self.made[r]), -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
                push(i)
            if before[i] >= 0:
                push(before[i])
            left -= 1
        return left


def normal(text: str) -> str:
    """NFC in lower case, letter by letter: a sigma at the end of a word is lowered like others."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def pretokens(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of the pre-tokens of all rows, and whether a row has a code point of unknown class."""
    kind = classes()[points]
    n = len(points)
    fresh = np.zeros(n + 1, bool)
    fresh[offsets] = True
    fresh[1:n] |= kind[1:] != kind[:-1]
    fresh[:n] |= kind == DIGIT
    quote = np.flatnonzero((points == ord("'")) & fresh[:n])
    for letters in CONTRACTIONS:
        size = len(letters)
        at = quote[quote + size < n]
        for k, letter in enumerate(letters, 1):
            at = at[points[at + k] == ord(letter)]
        row_end = offsets[np.searchsorted(offsets, at, "right")]
        at, row_end = at[at + size < row_end], row_end[at + size < row_end]
        fresh[at + 1] = False
        fresh[(at + size + 1)[at + size + 1 < row_end]] = True
    cuts = np.flatnonzero(fresh)
    begins, ends = cuts[:-1], cuts[1:]
    solid = kind[begins] != SPACE if n else np.zeros(0, bool)
    odd = np.zeros(len(offsets) - 1, bool)
    odd[np.searchsorted(offsets, np.flatnonzero(kind == UNKNOWN), "right") - 1] = True
    return begins[solid], ends[solid], odd


def _unique(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A first span of each distinct one, and which of them every span equals."""
    _, lead, which = np.unique(utf8.span_hashes(data, begins, ends), return_index=True, return_inverse=True)
    size = ends - begins
    twin = lead[which]
    same = size == size[twin]
    into = np.arange(size[same].sum()) - np.repeat(np.cumsum(size[same]) - size[same], size[same])
    differs = data[np.repeat(begins[same], size[same]) + into] != data[np.repeat(begins[twin[same]], size[same]) + into]
    wrong = np.flatnonzero(~same)
    if differs.any():
        wrong = np.union1d(wrong, np.flatnonzero(same)[np.unique(np.repeat(np.arange(same.sum()), size[same])[differs])])
    which[wrong] = len(lead) + np.arange(len(wrong))  # equal hashes of unequal spans
    return np.concatenate([lead, wrong]), which


def counted(texts: list[str], vocabulary: Vocabulary) -> np.ndarray:
    """Tokens of each text."""
    tokens = np.zeros(len(texts), np.int64)
    pieces, owner = [], []
    for i, text in enumerate(texts):
        parts = vocabulary.special.split(text) if vocabulary.special else [text]
        tokens[i] += len(parts) - 1
        pieces += parts
        owner += [i] * len(parts)
    owner = np.array(owner, np.int64)
    plain = [normal(p) for p in pieces]
    whole = "".join(plain)
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in plain])]).astype(np.int64)
    points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    begins, ends, odd = pretokens(points, offsets)
    row = np.searchsorted(offsets, begins, "right") - 1
    if odd.any():
        fine = ~odd[row]
        begins, ends, row = begins[fine], ends[fine], row[fine]
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    places = np.concatenate([[0], np.cumsum(width)])
    data, begins, ends = np.frombuffer(whole.encode(), np.uint8), places[begins], places[ends]
    if odd.any():
        more, lengths, rows = [], [], []
        for i in np.flatnonzero(odd):
            for token, _ in vocabulary.library.pre_tokenizer.pre_tokenize_str(vocabulary.library.normalizer.normalize_str(pieces[i])):
                more.append(bytes(vocabulary.byte_of[c] for c in token))
                lengths.append(len(more[-1]))
                rows.append(i)
        stops = len(data) + np.cumsum(lengths, dtype=np.int64)
        data = np.concatenate([data, np.frombuffer(b"".join(more), np.uint8)])
        begins, ends = np.concatenate([begins, stops - lengths]), np.concatenate([ends, stops])
        row = np.concatenate([row, rows]).astype(np.int64)
    if not len(begins):
        return tokens
    lead, which = _unique(data, begins, ends)
    lengths = (ends - begins)[lead]
    stops = np.cumsum(lengths)
    raw = data[np.repeat(begins[lead] - (stops - lengths), lengths) + np.arange(stops[-1])]
    symbols = vocabulary.inner[raw]
    symbols[stops - 1] = vocabulary.last[raw[stops - 1]]
    kept = vocabulary.survivors(symbols, lengths)
    np.add.at(tokens, owner[row], kept[which])
    return tokens


def _count_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(path)
        for batch in batches:
            for part, _, offsets in utf8.slices(batch, "text", SLICE):
                texts = utf8.text_column(part.column(1)).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(offsets)), pa.array(counted(texts, vocabulary))], names=["doc_id", "n_bytes", "n_tokens"]
                )

    return run


def token_counts(docs: DataFrame, vocabulary: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether these exceed `limit`, for every document."""
    import public_tokenizers

    vocabulary = vocabulary or public_tokenizers.path("word_bpe_49k.json")
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_count_batches(vocabulary), "doc_id long, n_bytes long, n_tokens long")
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
