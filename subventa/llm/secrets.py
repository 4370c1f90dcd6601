"""Secret scan: fixed patterns and a linear-chain conditional random field.

Patterns find the base spans. The field tags every token (run of characters
other than ASCII white space) as begin, inside or outside of a secret and adds
what the patterns did not cover; base spans always stay as they are.

* Features of a token: its shape (length, shares of digits, capitals and marks,
  changes between letter and digit, signs it holds), key words it is or starts
  with, the same of its neighbours, and features of its file (shares of digits
  and code signs). Each is a small category with one weight per tag, so a token's
  scores are sums of table entries, computed for all tokens of a slice at once.
* Training maximises the likelihood of two bounded sets: `MADE_LINES` made lines
  with secrets of many kinds and look-alikes, and the lines of `SAMPLE_ROWS` rows
  of the table, tagged by the patterns. It runs on the driver; its size does not
  grow with the table.
* Decoding is exact. A token whose best gain over "outside" cannot make up for
  any transition is outside on every best path; Viterbi runs over what is left.

Defined cases: a null or empty text has no spans, an empty table gives an empty
one. Repeated rows are scanned one by one, a null doc_id is carried along, extra
columns stay in `masked` and are not carried by `scanned`. Offsets count code
points. A text of any length is one sequence; its cost grows with its length and
spans alone. The sample follows the hashes of doc_id where there is one, so it
does not depend on how the table lies in files; rows without an id are not
sampled.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subventa.llm import utf8
from subventa.llm.store import sample_by_hash

# The base patterns, on UTF-8 bytes; they hold ASCII only.
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "crf")

MADE_LINES = 800
SAMPLE_ROWS = 50
# Tokens of a training line; longer lines are cut into several.
LINE_TOKENS = 40

_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key", "authorization", "bearer", "credential", "private_key", "access_key", "pwd")
_MASK = b"[SECRET]"

# Character classes of bytes.
_DIGIT, _UPPER, _LOWER, _OTHER, _SIGN = range(5)
_CLASS = np.full(256, _SIGN, np.uint8)
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123], _CLASS[128:] = _DIGIT, _UPPER, _LOWER, _OTHER
_HEXED = np.zeros(256, bool)
_HEXED[[*range(48, 58), *range(97, 103)]] = True
_B64 = np.zeros(256, bool)
_B64[[*range(48, 58), *range(65, 91), *range(97, 123), 43, 45, 47, 61, 95]] = True
_CODE = np.zeros(256, bool)
_CODE[[ord(c) for c in "{}[]();=<>"]] = True

# Number of values of each feature.
SIZES = (9, 5, 5, 4, 4, 2, 2, 4, 3, 3, 4, 4, 3, 3, 9, 2)


def _hash_of(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(utf8.span_hashes(raw, np.array([0]), np.array([len(raw)]))[0])


def _sums(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flags) + 1, np.int32)
    np.cumsum(flags, out=out[1:], dtype=np.int32)
    return out


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One column per feature, one row per token."""
    n = len(starts)
    length = (ends - starts).astype(np.int32)
    kind = _CLASS[data]
    per = lambda flags: (lambda s: s[ends] - s[starts])(_sums(flags))
    digits, uppers, signs = per(kind == _DIGIT), per(kind == _UPPER), per(kind == _SIGN)
    others = per(kind == _OTHER)
    flip = np.zeros(len(data), bool)
    flip[1:] = (kind[1:] == _DIGIT) & (kind[:-1] != _DIGIT) & (kind[:-1] < _OTHER) | (kind[:-1] == _DIGIT) & (kind[1:] != _DIGIT) & (kind[1:] < _OTHER)
    flips = per(flip)
    assigned = per((data == 61) | (data == 58))
    quoted = per((data == 34) | (data == 39))
    mail = per(data == 64)
    dots = per(data == 46)
    longest = np.array([0, 4, 8, 12, 16, 20, 32, 48])
    sized = np.searchsorted(longest, length, "right").astype(np.int8)
    share = lambda x: np.where(x == 0, 0, np.where(4 * x < length, 1, np.where(2 * x < length, 2, np.where(x < length, 3, 4)))).astype(np.int8)

    lowered = utf8.LOWER[data]
    # The word of a token: its leading letters and underscores.
    letter = (kind == _UPPER) | (kind == _LOWER) | (data == 95)
    stops = np.flatnonzero(~letter)
    opening = starts + ((data[starts] == 34) | (data[starts] == 39) if n else np.zeros(0, bool))
    opening = np.minimum(opening, ends)
    nxt = np.searchsorted(stops, opening)
    head_end = np.minimum(np.where(nxt < len(stops), stops[np.minimum(nxt, max(len(stops) - 1, 0))] if len(stops) else len(data), len(data)), ends)
    hashed = utf8.span_hashes(lowered, opening, head_end)
    known = np.isin(hashed, np.array([_hash_of(w) for w in _KEYWORDS], np.uint64)) & (head_end > opening)
    follow = np.where(head_end < ends, data[np.minimum(head_end, max(len(data) - 1, 0))] if len(data) else 0, 0)
    key = np.where(~known, 0, np.where(head_end == ends, 1, np.where((follow == 61) | (follow == 58), 2, 3))).astype(np.int8)
    bare = (length == 1) & ((data[starts] == 61) | (data[starts] == 58) if n else np.zeros(0, bool))
    link = np.where(bare, 2, np.where((assigned > 0) & np.isin(data[ends - 1] if n else data[:0], (61, 58)), 1, 0)).astype(np.int8)

    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    shifted = lambda x, by: _shift(x, row, by)
    total = np.maximum(np.add.reduceat(np.append(length, 0), first[:-1])[: len(first) - 1] if n else np.zeros(len(first) - 1), 1)
    count = lambda x: np.where(np.diff(first) > 0, np.add.reduceat(np.append(x, 0), first[:-1]) if n else 0, 0) / total
    file_digits = np.searchsorted([0.002, 0.02, 0.1], count(digits), "right")
    file_code = np.searchsorted([0.002, 0.02], count(per(_CODE[data])), "right")
    out = np.empty((n, len(SIZES)), np.int8)
    columns = (
        sized,
        share(digits),
        share(uppers),
        np.minimum(flips, 3) if n else flips,
        np.where(signs == 0, 0, np.where(4 * signs < length, 1, np.where(2 * signs < length, 2, 3))),
        per(_HEXED[data]) == length - quoted,
        per(_B64[data]) == length - quoted,
        key,
        link,
        np.where(mail > 0, 2, np.where(dots >= 2, 1, 0)),
        shifted(key, 1),
        shifted(key, 2),
        shifted(link, 1),
        shifted(link, -1),
        np.where(digits == 0, 0, sized),
        others > 0,
    )
    for i, c in enumerate(columns):
        out[:, i] = c
    return np.concatenate([out, file_digits[row][:, None].astype(np.int8), file_code[row][:, None].astype(np.int8)], axis=1)


ALL_SIZES = (*SIZES, 4, 3)
_BEGINS = np.concatenate([[0], np.cumsum(ALL_SIZES)[:-1]])


def _shift(x: np.ndarray, row: np.ndarray, by: int) -> np.ndarray:
    """x of the token `by` places before in the same row, else 0."""
    out = np.zeros_like(x)
    if abs(by) < len(x):
        if by > 0:
            same = row[by:] == row[:-by]
            out[by:] = np.where(same, x[:-by], 0)
        else:
            same = row[:by] == row[-by:]
            out[:by] = np.where(same, x[-by:], 0)
    return out


@dataclass
class Field:
    """Weights of the field. Tags: 0 outside, 1 begin, 2 inside."""

    weights: np.ndarray  # (sum of sizes, 3)
    moves: np.ndarray  # (3, 3)

    def scores(self, table: np.ndarray) -> np.ndarray:
        out = np.zeros((len(table), 3), np.float32)
        w = self.weights.astype(np.float32)
        for k, begin in enumerate(_BEGINS):
            out += w[begin + table[:, k]]
        return out


def train(tables: list[np.ndarray], tags: list[np.ndarray], rounds: int = 80, decay: float = 3e-4) -> Field:
    """Maximum likelihood with a small penalty, by full-batch Adam; the same input gives the same field."""
    m, longest = len(tables), max(map(len, tables))
    seen = np.arange(longest) < np.array([len(a) for a in tables])[:, None]
    y = np.zeros((m, longest), np.int64)
    y[seen] = np.concatenate(tags)
    flat = np.concatenate(tables).astype(np.int64) + _BEGINS
    total = int(sum(ALL_SIZES))
    theta = np.zeros((total + 3, 3))
    spread = lambda w: np.stack([sum(np.bincount(flat[:, k], weights=w[:, tag], minlength=total) for k in range(flat.shape[1])) for tag in range(3)], axis=1)
    add = lambda a, axis: (lambda top: np.log(np.exp(a - top).sum(axis=axis)) + top.squeeze(axis))(a.max(axis=axis, keepdims=True))
    pair = seen[:, 1:]
    gold = np.zeros_like(theta)
    gold[:total] = spread(np.eye(3)[y[seen]])
    np.add.at(gold, (total + y[:, :-1][pair], y[:, 1:][pair]), 1)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        emit = np.zeros((m, longest, 3))
        emit[seen] = theta[flat].sum(axis=1)
        move = theta[total:]
        alpha, beta = np.zeros((m, longest, 3)), np.zeros((m, longest, 3))
        alpha[:, 0] = emit[:, 0]
        for t in range(1, longest):
            on = seen[:, t]
            alpha[:, t] = alpha[:, t - 1]
            alpha[on, t] = add(alpha[on, t - 1, :, None] + move, 1) + emit[on, t]
        for t in range(longest - 2, -1, -1):
            on = seen[:, t + 1]
            beta[on, t] = add(move + (emit[on, t + 1] + beta[on, t + 1])[:, None, :], 2)
        norm = add(alpha[:, -1], 1)
        model = np.zeros_like(gold)
        model[:total] = spread(np.exp(alpha + beta - norm[:, None, None])[seen])
        both = np.exp(alpha[:, :-1, :, None] + move + (emit[:, 1:] + beta[:, 1:])[:, :, None, :] - norm[:, None, None, None])
        model[total:] = both[pair].sum(axis=0)
        slope = (gold - model) / len(flat) - decay * theta / 10
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope * slope
        theta = theta + 0.3 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Field(theta[:total], theta[total:])


def decode(scores: np.ndarray, moves: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Best tags of every row's tokens. `first` holds the place of each row's first token, and the end."""
    tags = np.zeros(len(scores), np.int8)
    if not len(scores):
        return tags
    gain = scores[:, 1:] - scores[:, :1]
    # What tag t can win over 0 by its two moves, at most.
    into = (moves[:, 1:] - moves[:, :1]).max(axis=0)
    out = (moves[1:] - moves[:1]).max(axis=1)
    bound = np.maximum(into, 0) + np.maximum(out, 0)
    live = (gain + bound > 0).any(axis=1)
    at = np.flatnonzero(live)
    if not len(at):
        return tags
    edge = np.zeros(len(scores) + 1, bool)
    edge[first] = True
    breaks = np.flatnonzero((np.diff(at) > 1) | edge[at[1:]]) + 1
    for run in np.split(at, breaks):
        a, b = int(run[0]), int(run[-1]) + 1
        best = scores[a].astype(float) + (0 if edge[a] else moves[0])
        back = []
        for t in range(a + 1, b):
            step = best[:, None] + moves
            back.append(step.argmax(axis=0))
            best = step.max(axis=0) + scores[t]
        if not edge[b]:
            best = best + moves[:, 0]
        tag = int(best.argmax())
        for t in range(b - 1, a - 1, -1):
            tags[t] = tag
            if t > a:
                tag = int(back[t - a - 1][tag])
    return tags


def base_spans(raw: bytes) -> list[tuple[int, int, int]]:
    """(start, end, kind) in bytes."""
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(raw) if len(m[2]) >= 6]
    out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(raw) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(raw)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def may_hold_base(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows that can match a base pattern: a colon or an equals sign, AKIA, or 24 hex characters in a row."""
    n = len(data)
    hit = [np.flatnonzero((data == 61) | (data == 58))]
    if n >= 4:
        hit.append(np.flatnonzero((data[:-3] == 65) & (data[1:-2] == 75) & (data[2:-1] == 73) & (data[3:] == 65)))
    other = np.flatnonzero(np.concatenate(([True], ~_HEXED[data], [True]))) - 1
    gaps = np.flatnonzero(np.diff(other) > 24)
    hit.append(other[gaps + 1] - 1)
    out = np.zeros(len(offsets) - 1, bool)
    places = np.concatenate(hit)
    rows = np.searchsorted(offsets, places, "right") - 1
    out[rows[(rows >= 0) & (rows < len(out))]] = True
    # A run of hex characters may cross rows; then the rows it touches are looked at as well.
    starts = other[gaps] + 1
    for a, b in zip(np.searchsorted(offsets, starts, "right") - 1, np.searchsorted(offsets, other[gaps + 1] - 1, "right") - 1):
        out[max(a, 0) : b + 1] = True
    return out


_EDGE = b"\"'`,.;:()[]{}<> \t\n\r\x0b\x0c"


def _merged(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that `spans`, sorted by start, cover."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b, _ in spans:
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _uncovered(a: int, b: int, starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """The parts of (a, b) outside of the stretches, found from the first that ends behind a."""
    out = []
    k = bisect_right(ends, a)
    while k < len(starts) and starts[k] < b:
        if a < starts[k]:
            out.append((a, starts[k]))
        a = ends[k]
        k += 1
    return [*out, (a, b)] if a < b else out


def spans_of(data: np.ndarray, offsets: np.ndarray, field: Field) -> list[list[tuple[int, int, int]]]:
    """Per row: (start, end, kind) in bytes of the row, by start and kind."""
    rows = len(offsets) - 1
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(rows)]
    for i in np.flatnonzero(may_hold_base(data, offsets)):
        found[i] = base_spans(data[offsets[i] : offsets[i + 1]].tobytes())
    starts, ends, first = utf8.words(data, offsets)
    tags = decode(field.scores(features(data, starts, ends, first)), field.moves, first)
    at = np.flatnonzero(tags)
    if not len(at):
        return found
    row = np.searchsorted(first, at, "right") - 1
    fresh = np.concatenate(([True], (np.diff(at) > 1) | (np.diff(row) > 0))) | (tags[at] == 1)
    heads = np.flatnonzero(fresh)
    tails = np.append(heads[1:], len(at)) - 1
    covered: dict[int, tuple[list[int], list[int]]] = {}
    for i, a, b in zip(row[heads].tolist(), starts[at[heads]].tolist(), ends[at[tails]].tolist()):
        if i not in covered:
            covered[i] = _merged(found[i])
        for a, b in _uncovered(a - int(offsets[i]), b - int(offsets[i]), *covered[i]):
            raw = data[offsets[i] + a : offsets[i] + b].tobytes()
            a, b = a + len(raw) - len(raw.lstrip(_EDGE)), b - (len(raw) - len(raw.rstrip(_EDGE)))
            if a < b:
                found[i].append((a, b, 3))
    return [sorted(x, key=lambda s: (s[0], s[2])) for x in found]


_WORDS = "the of and to in is that was for on with as by at from this be are it or an der die und von zu mit el la que los de les des est une pour".split()
_ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def made_lines(n: int = MADE_LINES, seed: int = 5) -> list[tuple[str, list[tuple[int, int]]]]:
    """Lines with secrets of many kinds, with look-alikes that are none, and plain ones; with the secrets' spans."""
    rng = random.Random(seed)
    pick = lambda alphabet, k: "".join(rng.choice(alphabet) for _ in range(k))
    hexed, caps, digit = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "0123456789"
    mixed = lambda a, b: pick(_ALNUM, rng.randint(a, b))
    secret = [
        lambda: f"password={mixed(8, 24)}",
        lambda: f"passwd: {mixed(8, 20)}",
        lambda: f'token = "{pick(hexed, rng.choice([32, 40, 64]))}"',
        lambda: f"secret: {mixed(20, 44)}",
        lambda: f"api_key={mixed(24, 40)}",
        lambda: f"apikey = '{mixed(24, 40)}'",
        lambda: "AKIA" + pick(caps, 16),
        lambda: pick(hexed, rng.choice([32, 40, 64])),
        lambda: f"Authorization: Bearer {mixed(30, 60)}",
        lambda: f"private_key = {mixed(40, 64)}",
        lambda: f"access_key: {mixed(36, 44)}",
        lambda: "ghp_" + mixed(36, 36),
        lambda: "sk_live_" + mixed(24, 24),
        lambda: "xoxb-" + pick(digit, 12) + "-" + mixed(24, 24),
        lambda: "eyJ" + mixed(20, 30) + "." + mixed(40, 60) + "." + mixed(30, 43),
    ]
    plain = [
        lambda: f"{pick('abcdefghij', 6)}.{pick(digit, 2)}@mail{pick(digit, 1)}.example.com",
        lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4)),
        lambda: pick(digit, 16),
        lambda: pick(digit, rng.randint(1, 8)),
        lambda: f"https://{pick('abcdefgh', 8)}.example.com/{pick('abcdefgh', 5)}/{pick(digit, 3)}?page={pick(digit, 1)}",
        lambda: f"20{pick(digit, 2)}-0{rng.randint(1, 9)}-1{pick(digit, 1)}",
        lambda: f"+49 {pick(digit, 4)} {pick(digit, 6)}",
        lambda: f"version {pick(digit, 1)}.{pick(digit, 1)}.{pick(digit, 2)}",
        lambda: f"v{pick(digit, 2)}",
        lambda: f"{rng.choice(_WORDS).upper()}!! {rng.choice(_WORDS).upper()}!!",
        lambda: f"{rng.choice(_WORDS)}### {rng.choice(_WORDS)}*** {rng.choice(_WORDS)}$$$",
        lambda: f"the token of the {rng.choice(_WORDS)}",
        lambda: f"a secret: {rng.choice(_WORDS)} {rng.choice(_WORDS)}",
        lambda: f"x = {pick(digit, 2)}",
        lambda: f"note: {rng.choice(_WORDS)}",
        lambda: "".join(rng.choice(_WORDS) for _ in range(rng.randint(2, 8))),
    ]
    lines = []
    for _ in range(n):
        parts, spans, at = [], [], 0
        for _ in range(rng.randint(1, 3)):
            prose = ["".join(rng.choice(_WORDS) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(0, 7))]
            for text, bad in [(" ".join(prose), False), ((rng.choice(secret)(), True) if rng.random() < 0.35 else (rng.choice(plain)(), False))]:
                if text:
                    text = text[:1].upper() + text[1:] if rng.random() < 0.2 and not bad else text
                    parts.append(text)
                    if bad:
                        spans.append((at, at + len(text)))
                    at += len(text) + 1
        lines.append((" ".join(parts), spans))
    return lines


def _tagged(data: np.ndarray, offsets: np.ndarray, spans: list[list[tuple[int, int]]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    starts, ends, first = utf8.words(data, offsets)
    table = features(data, starts, ends, first)
    tags = np.zeros(len(starts), np.int64)
    for i, own in enumerate(spans):
        for a, b in own:
            at = np.flatnonzero((starts < offsets[i] + b) & (ends > offsets[i] + a))
            tags[at] = 2
            tags[at[:1]] = 1
    tables, out = [], []
    for a, b in zip(first[:-1], first[1:]):
        for c in range(a, b, LINE_TOKENS):
            tables.append(table[c : min(b, c + LINE_TOKENS)])
            out.append(tags[c : min(b, c + LINE_TOKENS)])
    return tables, out


def trained(docs: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> Field:
    """Field for the lines of `docs`."""
    lines = made_lines()
    for r in sample_by_hash(docs, text, sample_rows, "doc_id" if "doc_id" in docs.columns else None):
        for line in (r[0] or "").split("\n"):
            raw = line.encode()
            merged: list[tuple[int, int]] = []
            for a, b, _ in base_spans(raw):
                if merged and a < merged[-1][1]:
                    merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
                else:
                    merged.append((a, b))
            if merged or len(lines) < 2 * MADE_LINES:
                lines.append((line, merged))
    raws = [line.encode() for line, _ in lines]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raws])])
    tables, tags = _tagged(np.frombuffer(b"".join(raws), np.uint8), offsets, [s for _, s in lines])
    return train(tables, tags)


def _points(data: np.ndarray, at: list[int]) -> list[int]:
    """Code points before each place, a byte offset."""
    begins = np.flatnonzero((data & 0xC0) != 0x80)
    return np.searchsorted(begins, at).tolist()


def _scan_batches(field: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in utf8.slices(batch, "text"):
                lists = []
                for i, spans in enumerate(spans_of(data, offsets, field)):
                    if not spans:
                        lists.append([])
                        continue
                    own = data[offsets[i] : offsets[i + 1]]
                    begins, ends = _points(own, [a for a, _, _ in spans]), _points(own, [b for _, b, _ in spans])
                    lists.append([{"kind": KINDS[k], "begin": a, "end": b} for a, b, (_, _, k) in zip(begins, ends, spans)])
                kind = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lists, kind)], names=["doc_id", "found"])

    return run


def scanned(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id and found, the array of (kind, begin, end) by begin and kind."""
    field = field or trained(docs)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _scan_batches(field), "doc_id long, found array<struct<kind:string,begin:long,end:long>>"
    )


def _mask_batches(field: Field, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in utf8.slices(batch, text):
                at = part.schema.get_field_index(text)
                values = part.column(at)
                changed = {}
                for i, spans in enumerate(spans_of(data, offsets, field)):
                    if spans:
                        raw, out, end = data[offsets[i] : offsets[i + 1]].tobytes(), [], 0
                        for a, b, _ in spans:
                            if a >= end:
                                out += [raw[end:a], _MASK]
                            end = max(end, b)
                        changed[i] = b"".join([*out, raw[end:]]).decode()
                if changed:
                    values = pa.array([changed.get(i, v) for i, v in enumerate(values.to_pylist())], values.type)
                yield part.set_column(at, part.schema.field(at), values)

    return run


def masked(docs: DataFrame, text: str = "text", field: Field | None = None) -> DataFrame:
    """`docs` with every secret in `text` replaced by [SECRET]."""
    field = field or trained(docs, text)
    return docs.mapInArrow(_mask_batches(field, text), docs.schema)
