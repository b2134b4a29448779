"""Byte-level BPE encoding and decoding over whole texts, vectorised.

Pre-tokenisation runs without a regex. Code points become classes by table
look-up, classes become symbols (with one or two code points of look-ahead),
and every symbol is a transition function on eight states. Function composition
is associative, so the state before each code point comes from a blocked
parallel scan over function numbers: the finite monoid that the symbols
generate is tabulated once, and composing two functions is one look-up. State
and symbol then say where a piece starts.

The pieces go through a bounded cache of merged pieces. Token offsets (bytes)
are kept beside the ids; decoding puts every token's bytes at its offset.

The splitting rules are those of ``public_tokenizers.PATTERN``:
contractions 's 't 're 've 'm 'll 'd; letters, numbers, or others, each with an
optional space before; white space, whose last character goes to what follows.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadframe.llm.common import text_and
from leadframe.llm.textscan import blocks, text_bytes

CACHE_PIECES = 60_000       # bound of the cache of merged pieces, about 15 MB
BLOCK_BYTES = 1 << 18
SCAN_WIDTH = 64

# Unicode White_Space, which \s stands for
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

# classes of code points
OTHER, LETTER, NUMBER, SPACE, BLANK, QUOTE, STMD, R_, V_, L_, E_ = range(11)
# symbols
S_L, S_N, S_O, S_SPACE, S_BLANK, S_INNER, S_SHORT, S_LONG = range(8)
# states: what the code points before belong to
NONE, IN_L, IN_N, IN_O, PENDING, IN_W, ONE_MORE, TWO_MORE = range(8)


@cache
def class_table() -> np.ndarray:
    """Class of every code point."""
    first = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((first.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[WHITE] = BLANK
    out[0x20] = SPACE
    out[ord("'")] = QUOTE
    for c in "stmd":
        out[ord(c)] = STMD
    for c, k in zip("rvle", (R_, V_, L_, E_)):
        out[ord(c)] = k
    return out


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """(next state, whether a piece starts at the symbol)."""
    if symbol in (S_L, S_N, S_O):
        if state in (ONE_MORE, TWO_MORE):           # letters of a contraction
            return (NONE if state == ONE_MORE else ONE_MORE), False
        run = (IN_L, IN_N, IN_O)[symbol]
        return run, state not in (run, PENDING)
    if symbol in (S_SHORT, S_LONG):                 # a quote that may open a contraction
        if state in (IN_O, PENDING):
            return IN_O, False
        return (ONE_MORE if symbol == S_SHORT else TWO_MORE), True
    if symbol == S_SPACE:                           # last of its run, goes to what follows
        return PENDING, True
    if symbol == S_BLANK:                           # last of its run, a piece of its own
        return NONE, True
    return IN_W, state != IN_W


@cache
def _machine():
    """(function number of each symbol, composition table, states by function, starts by state and symbol).

    Symbols from 8 on are the same ones at the start of a document.
    """
    step = [[_step(q, a) for q in range(8)] for a in range(8)]
    step += [[step[a][NONE]] * 8 for a in range(8)]
    funcs = {tuple(range(8)): 0}
    of_symbol = [funcs.setdefault(tuple(q for q, _ in row), len(funcs)) for row in step]
    todo = list(funcs)
    while todo:                                     # close the set under composition
        f = todo.pop()
        for row in step:
            g = tuple(row[q][0] for q in f)
            if g not in funcs:
                funcs[g] = len(funcs)
                todo.append(g)
    every = list(funcs)
    then = np.array([[funcs[tuple(g[q] for q in f)] for g in every] for f in every], np.uint16)
    starts = np.array([[step[a][q][1] for a in range(16)] for q in range(8)])
    return np.array(of_symbol, np.uint16), then, np.array(every, np.uint8), starts


def states_before(f: np.ndarray) -> np.ndarray:
    """State before each element of a sequence of function numbers, by a blocked scan."""
    _, then, apply, _ = _machine()
    n, size = len(f), then.shape[0]
    if n == 0:
        return np.zeros(0, np.uint8)
    rows = -(-n // SCAN_WIDTH)
    x = np.zeros(rows * SCAN_WIDTH, np.uint16)      # function 0 is the identity
    x[:n] = f
    x = np.ascontiguousarray(x.reshape(rows, SCAN_WIDTH).T)
    flat = then.ravel()
    before = np.empty_like(x)
    acc = np.zeros(rows, np.intp)
    for j in range(SCAN_WIDTH):                     # all blocks side by side
        before[j] = acc
        acc = flat[acc * size + x[j]].astype(np.intp)
    if rows > 1:
        start = states_before(acc.astype(np.uint16))    # the blocks' products, scanned the same way
    else:
        start = np.full(1, NONE, np.uint8)
    return np.ascontiguousarray(apply[before, start[None, :]].T).ravel()[:n]


def piece_starts(points: np.ndarray, doc_at: np.ndarray) -> np.ndarray:
    """Indices of the code points at which a piece starts; doc_at: first code point of each document."""
    n = len(points)
    if n == 0:
        return np.zeros(0, np.int64)
    c = np.full(n + 2, BLANK, np.uint8)
    c[:n] = class_table()[points]
    first = np.zeros(n + 3, bool)
    first[doc_at[doc_at < n]] = True
    first[n:] = True
    one, two = c[1:n + 1], c[2:n + 2]
    here = c[:n]
    symbol = np.array([S_O, S_L, S_N, S_INNER, S_INNER, S_O, S_L, S_L, S_L, S_L, S_L], np.uint8)[here]
    followed = ~first[1:n + 1] & (one != BLANK) & (one != SPACE)
    symbol[(here == SPACE) & followed] = S_SPACE
    symbol[(here == BLANK) & followed] = S_BLANK
    quote = np.flatnonzero((here == QUOTE) & followed)
    if len(quote):
        a, b = one[quote], two[quote]
        symbol[quote[a == STMD]] = S_SHORT
        pair = ((((a == R_) | (a == V_)) & (b == E_)) | ((a == L_) & (b == L_))) & ~first[quote + 2]
        symbol[quote[pair]] = S_LONG
    of_symbol, _, _, starts = _machine()
    symbol[first[:n]] += 8
    return np.flatnonzero(starts[states_before(of_symbol[symbol]), symbol])


class Tokens:
    """The bytes of every token of a tiktoken rank file."""

    def __init__(self, content: bytes):
        pairs = sorted((int(b), base64.b64decode(a)) for a, b in map(bytes.split, content.splitlines()) if a)
        self.length = np.zeros(pairs[-1][0] + 1, np.int64)
        self.length[[r for r, _ in pairs]] = [len(t) for _, t in pairs]
        self.bytes = np.frombuffer(b"".join(t for _, t in pairs), np.uint8)
        self.at = np.cumsum(self.length) - self.length

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset of each token."""
        n = self.length[ids]
        return np.cumsum(n) - n

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> bytes:
        """Put each token's bytes at its offset."""
        if len(ids) == 0:
            return b""
        n = self.length[ids]
        out = np.empty(int(offsets[-1] + n[-1]), np.uint8)
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(offsets.astype(np.int64), n) + inside] = self.bytes[np.repeat(self.at[ids], n) + inside]
        return out.tobytes()


class Vocabulary(Tokens):
    """Tokens with their ranks, the pairs that merge, and the cache of merged pieces."""

    def __init__(self, content: bytes, cache_pieces: int = CACHE_PIECES):
        super().__init__(content)
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}
        self.top = len(self.length)
        self.of_byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        # every pair of tokens whose bytes together are a token
        key, rank = array("q"), array("q")
        for t, r in self.ranks.items():
            for i in range(1, len(t)):
                a, b = self.ranks.get(t[:i]), self.ranks.get(t[i:])
                if a is not None and b is not None:
                    key.append(a * self.top + b)
                    rank.append(r)
        key, rank = np.array(key), np.array(rank)
        order = np.argsort(key)
        self.pair = np.append(key[order], 1 << 62)
        self.pair_rank = np.append(rank[order], 0)
        self.pieces: dict[bytes, bytes] = {}
        self.most = cache_pieces

    def encode(self, raw: bytes, cuts: list[int], docs: list[int]) -> list[bytes]:
        """Ids of the pieces between the cuts, as little-endian unsigned 32-bit integers.

        docs: index in ``cuts`` of each document's first piece, and the end.
        """
        pieces, known = [raw[a:b] for a, b in zip(cuts, cuts[1:])], self.pieces
        if len(known) > self.most:
            known.clear()
        ids = list(map(known.get, pieces))
        missing = [i for i, x in enumerate(ids) if x is None]
        merged = dict(self.merge_many(list({pieces[i] for i in missing})))
        for i in missing:
            ids[i] = merged[pieces[i]]
        known.update((p, x) for p, x in merged.items() if len(p) <= 64)     # long pieces rarely come again
        return [b"".join(ids[a:b]) for a, b in zip(docs, docs[1:])]

    def merge_many(self, pieces: list[bytes]):
        """(piece, packed ids), merged side by side among pieces of like length."""
        by_width: dict[int, list] = {}
        for p in pieces:
            rank = self.ranks.get(p)
            if rank is not None:
                yield p, rank.to_bytes(4, "little")
            elif len(p) > 64:
                yield p, np.array(merge(p, self.ranks), "<u4").tobytes()
            else:
                by_width.setdefault(max(4, 1 << (len(p) - 1).bit_length()), []).append(p)
        for width, group in by_width.items():
            for at in range(0, len(group), 8192):
                yield from self._merge_group(group[at:at + 8192], width)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the pairs; top where there is none."""
        key = a * self.top + b
        i = np.searchsorted(self.pair, key)
        return np.where((self.pair[i] == key) & (a >= 0) & (b >= 0), self.pair_rank[i], self.top)

    def _merge_group(self, group: list[bytes], width: int):
        n = np.array([len(p) for p in group])
        raw = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in group]), np.uint8).reshape(len(group), width)
        ids = np.where(np.arange(width) < n[:, None], self.of_byte[raw], -1)
        rank = np.full((len(group), width), self.top)
        rank[:, :-1] = self._rank(ids[:, :-1], ids[:, 1:])
        done, size, live = np.zeros((len(group), width), "<u4"), np.zeros(len(group), np.int64), np.arange(len(group))
        col = np.arange(width)
        while len(live):
            j = rank.argmin(axis=1)                 # the leftmost of the lowest rank
            r = rank[np.arange(len(live)), j]
            more = r < self.top
            if not more.all():
                end = live[~more]
                done[end], size[end] = ids[~more], n[~more]
            live, ids, rank, n, j, r = live[more], ids[more], rank[more], n[more] - 1, j[more], r[more]
            if not len(live):
                break
            take = np.minimum(col + (col > j[:, None]), width - 1)      # close the gap
            ids, rank = np.take_along_axis(ids, take, 1), np.take_along_axis(rank, take, 1)
            row = np.arange(len(live))
            ids[:, -1], rank[:, -1] = -1, self.top
            ids[row, j] = r
            right = np.minimum(j + 1, width - 1)
            rank[row, j] = np.where(j + 1 < width, self._rank(r, ids[row, right]), self.top)
            left = np.maximum(j - 1, 0)
            rank[row, left] = np.where(j > 0, self._rank(ids[row, left], r), rank[row, left])
        packed, step = done.tobytes(), 4 * width
        return [(p, packed[i * step:i * step + 4 * k]) for i, (p, k) in enumerate(zip(group, size.tolist()))]


def merge(piece: bytes, ranks: dict) -> list[int]:
    """Merge the pair of lowest rank, leftmost first, until none is left.

    A heap of pairs over a linked list: a piece of n bytes takes n log n steps.
    """
    n = len(piece)
    end = list(range(1, n + 1))         # end of the part that starts at i; 0 once merged away
    last = list(range(-1, n))           # start of the part before i
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, e = heapq.heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != e:      # one of the two parts has changed
            continue
        end[i], end[j] = e, 0
        if e < n:
            last[e] = i
            if (r := ranks.get(piece[i:end[e]])) is not None:
                heapq.heappush(heap, (r, i, end[e]))
        if i:
            p = last[i]
            if (r := ranks.get(piece[p:e])) is not None:
                heapq.heappush(heap, (r, p, e))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = end[i]
    return out


_loaded: dict = {}


def _once(kind, content):
    """The task's tokens or vocabulary, built once per Python worker."""
    key = (kind, hash(content.value))
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = kind(content.value)
    return _loaded[key]


def encode_block(data: np.ndarray, off: np.ndarray, vocabulary: Vocabulary) -> list[bytes]:
    """Packed ids of each document of a block of UTF-8 bytes."""
    raw = data.tobytes()
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:      # not UTF-8: replacement characters, row by row
        rows = [raw[a:b].decode("utf-8", "replace").encode() for a, b in zip(off[:-1], off[1:])]
        raw, off = b"".join(rows), np.concatenate(([0], np.cumsum([len(r) for r in rows])))
        text = raw.decode("utf-8")
    if len(text) == len(raw):
        points, byte_at = np.frombuffer(raw, np.uint8), None
        doc_at = off[:-1]
    else:
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        size = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        byte_at = np.cumsum(size) - size
        doc_at = np.searchsorted(byte_at, off[:-1])
    at = piece_starts(points, doc_at)
    at = at if byte_at is None else byte_at[at]
    return vocabulary.encode(raw, [*at.tolist(), len(raw)], np.searchsorted(at, off).tolist())


def read_ranks(path: str) -> bytes:
    """A rank file (read on the driver; the vocabulary's size is fixed)."""
    with open(path, "rb") as f:
        return f.read()


def encode(df: DataFrame, ranks: bytes, text_col: str = "text", carry: tuple = ("doc_id",),
           with_offsets: bool = True, decoded_col: str | None = None) -> DataFrame:
    """Return the ``carry`` columns, n_tokens, ids and (with_offsets) offsets, one row per input row.

    ``ids`` are little-endian unsigned 32-bit integers, ``offsets`` the byte
    offset of each token in the text, packed alike. ``decoded_col`` adds what
    ids and offsets decode to, in the same pass (one Python worker a task, not
    two). Null text counts as empty and has no tokens; repeated rows are
    encoded separately; bytes that are not UTF-8 count as replacement
    characters; columns not named are not read. No shuffle: each task streams
    its rows in blocks of bounded size.
    """
    spark = df.sparkSession
    content = spark.sparkContext.broadcast(ranks)
    x = text_and(df, text_col, carry)
    kept = x.drop("t").schema
    more = [("offsets", "binary")] * with_offsets + ([(decoded_col, "binary")] if decoded_col else [])
    for name, kind in (("n_tokens", "long"), ("ids", "binary"), *more):
        kept = kept.add(name, kind)

    def run(batches):
        vocabulary = _once(Vocabulary, content)
        for batch in batches:
            data, off = text_bytes(batch.column(0))
            for i, j in blocks(off, BLOCK_BYTES):
                ids = encode_block(data[off[i]:off[j]], off[i:j + 1] - off[i], vocabulary)
                cols = [c.slice(i, j - i) for c in batch.columns[1:]]
                cols += [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                numbers = [np.frombuffer(x, "<u4") for x in ids] if more else ()
                offsets = [vocabulary.offsets(x) for x in numbers]
                if with_offsets:
                    cols.append(pa.array([x.astype("<u4").tobytes() for x in offsets], pa.binary()))
                if decoded_col:
                    cols.append(pa.array([vocabulary.decode(x, y) for x, y in zip(numbers, offsets)], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, kept.names)
            del batch, data, off        # before the next batch is read
    return x.mapInArrow(run, kept).toDF(*carry, *kept.names[len(carry):])


def decode(df: DataFrame, ranks: bytes, ids_col: str = "ids", offsets_col: str = "offsets",
           out_col: str = "decoded") -> DataFrame:
    """Replace ids and offsets by the bytes they stand for; other columns stay."""
    content = df.sparkSession.sparkContext.broadcast(ranks)
    x = df.select(ids_col, offsets_col, *[c for c in df.columns if c not in (ids_col, offsets_col)])
    schema = x.drop(ids_col, offsets_col).schema.add(out_col, "binary")

    def run(batches):
        tokens = _once(Tokens, content)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                out = [tokens.decode(np.frombuffer(a.as_buffer(), "<u4"), np.frombuffer(b.as_buffer(), "<u4"))
                       for a, b in zip(part.column(0), part.column(1))]
                yield pa.RecordBatch.from_arrays([*part.columns[2:], pa.array(out, pa.binary())], schema.names)
    return x.mapInArrow(run, schema)
