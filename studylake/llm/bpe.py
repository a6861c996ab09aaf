"""Byte-level BPE: operators 3 (encode and decode by monoid tree reduction) and 4 (token counts by heap merging).

Both run over whole texts inside Arrow batches. Tasks share nothing, so the jobs are map-only: no shuffle, and a lost
executor costs only its own tasks. Per worker, results for repeated words are kept in tables of bounded size.
"""

from __future__ import annotations

import base64
import functools
import heapq
import json
import re
import sys
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_batches, rows_of, to_batches

#: Entries (about 200 bytes each) in a generation of a worker's tables, of chunks and of shorter strings; two generations
#: are held at most, and none once a task has ended. Fewer take less memory and more time.
CHUNKS, PARTS = 120_000, 40_000

#: Strings up to this length are merged directly; they are the leaves of the tree.
LEAF_BYTES = 5

# The characters with the Unicode property White_Space.
_SPACE = "\t-\r \x85\xa0  -     　"
#: A text falls into chunks, each a run of white space and the run of other characters after it. No match of the split
#: pattern reaches from a non-space into a space: only its white-space alternatives hold more than one leading space,
#: and those hold nothing else. So chunks can be split on their own, and repeated chunks only once.
_CHUNK = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks from a tiktoken file."""
    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    return ranks


class Pairs:
    """Adjacent pairs that merge, by whole numbers: `rank` of a pair (left symbol shifted by `shift`, or right), `made` of a rank."""

    def __init__(self, ranked: Iterable[tuple[int, int, int, int]], top: int):
        self.shift = max(1, top.bit_length())
        self.rank, self.made = {}, {}
        for left, right, rank, symbol in ranked:
            self.rank[left << self.shift | right] = rank
            self.made[rank] = symbol

    def merge(self, symbols: list[int]) -> int:
        """Merge adjacent symbols in place, lowest rank first and leftmost among equals, until no pair has a rank.

        The symbols form a linked list; a heap holds rank and place of the ranked pairs as one number. A popped pair is
        stale unless the pair that now starts there has this rank. A symbol that went into the one before it is left as
        -1. Returns how many merges there were. O(n log n).
        """
        n, shift, rank_of, made = len(symbols), self.shift, self.rank.get, self.made
        heap = []
        for i in range(n - 1):
            rank = rank_of(symbols[i] << shift | symbols[i + 1])
            if rank is not None:
                heap.append(rank * n + i)
        if not heap:
            return 0
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges = 0
        while heap:
            rank, i = divmod(pop(heap), n)
            j = after[i]
            if symbols[i] < 0 or j == n or rank_of(symbols[i] << shift | symbols[j]) != rank:
                continue
            merges += 1
            symbol = symbols[i] = made[rank]
            symbols[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                rank = rank_of(symbol << shift | symbols[k])
                if rank is not None:
                    push(heap, rank * n + i)
            h = before[i]
            if h >= 0:
                rank = rank_of(symbols[h] << shift | symbol)
                if rank is not None:
                    push(heap, rank * n + h)
        return merges


class Recent(dict):
    """A table of results that holds what was used lately: when it is full it becomes the old generation, from which
    entries that are used again come back. Frequent words stay, words seen once go, memory is bounded. Keys of more than
    64 bytes or characters are not held."""

    def __init__(self, make, entries: int, long: int | None = 64):
        self.make, self.entries, self.long, self.old = make, entries, long, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if self.long is not None and len(key) > self.long:
                return value
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value

    def forget(self):
        self.old = {}
        self.clear()


class TreeEncoder:
    """BPE as a tree reduction: the tokens of a string are the join of the tokens of its halves.

    Joining is exact by this argument. Call tokens a, b compatible if the bytes of a + b encode to [a, b]. If all
    neighbours of a sequence are compatible, the sequence is the encoding of its bytes: take the first merge of the
    whole string that crosses a boundary between two of its tokens. All merges before it lie inside tokens, so the
    symbols of these two have gone through just the merges (lowest rank first, leftmost among equals) that encoding
    the two alone would do, and the crossing merge would come there too, against their compatibility. So no merge
    crosses, and each token is built as when it is encoded alone. A join therefore re-encodes a window around the
    seam and is done when the window's ends are compatible with the tokens outside; else the window grows, in the
    end to the whole string.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, chunks: int = CHUNKS, parts: int = PARTS):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.single = [ranks[bytes([b])] for b in range(256)]
        cuts = ((ranks.get(token[:k]), ranks.get(token[k:]), rank, rank) for token, rank in ranks.items() for k in range(1, len(token)))
        self.pairs = Pairs((c for c in cuts if c[0] is not None and c[1] is not None), max(self.bytes_of))
        self.shift, self.mask, self.never = self.pairs.shift, (1 << self.pairs.shift) - 1, 1 << 62
        self.cuts: dict[int, tuple[int, int]] = {}
        self.windows, self.chunks, self.fits = Recent(self._window, parts), Recent(self._chunk, chunks), Recent(self._compatible, parts, None)

    def _window(self, text: bytes) -> tuple:
        """The encoding of a window, by merging alone: a short one by looking for the least rank each time, which beats a heap there."""
        symbols = [self.single[b] for b in text]
        if len(symbols) > 48:
            self.pairs.merge(symbols)
            return tuple([s for s in symbols if s >= 0])
        rank_of, shift, never = self.pairs.rank.get, self.pairs.shift, self.never
        ranks = [rank_of(a << shift | b, never) for a, b in zip(symbols, symbols[1:])]
        while ranks:
            rank = min(ranks)
            if rank == never:
                break
            i = ranks.index(rank)
            symbols[i] = rank
            del symbols[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank_of(symbols[i - 1] << shift | rank, never)
            if i < len(ranks):
                ranks[i] = rank_of(rank << shift | symbols[i + 1], never)
        return tuple(symbols)

    def cut(self, token: int) -> tuple[int, int]:
        """The two tokens that a token is merged from last; itself for a single byte."""
        found = self.cuts.get(token)
        if found is None:
            text = self.bytes_of[token]
            below = {}
            if len(text) > 1:
                symbols = [self.single[b] for b in text]
                while len(symbols) > 2:
                    ranks = [self.pairs.rank.get(a << self.pairs.shift | b, self.never) for a, b in zip(symbols, symbols[1:])]
                    i = ranks.index(min(ranks))
                    symbols[i : i + 2] = [ranks[i]]
                found = tuple(symbols)
            else:
                found = (token, token)
            self.cuts[token] = found
        return found

    def _compatible(self, pair: int) -> bool:
        """Whether the bytes of two neighbours encode to just these two: the merges along the seam are followed from the
        tokens down to their bytes, the later merge first; one that would come before both sides are built is against it."""
        shift, rank_of, cut = self.pairs.shift, self.pairs.rank.get, self.cut
        a, b = pair >> shift, pair & self.mask
        limit = self.never
        while True:
            rank = rank_of(a << shift | b)
            if rank is not None and rank < limit:
                return False
            # undo the later of the two merges; what is left meets at the seam before that merge
            if a > b:
                limit = a
                a = cut(a)[1]
                if a == limit:
                    limit = b + 1
                    b = cut(b)[0]
                    if b + 1 == limit:
                        return True
            else:
                limit = b + 1
                b = cut(b)[0]
                if b + 1 == limit:
                    limit = a
                    a = cut(a)[1]
                    if a == limit:
                        return True

    def join(self, left: tuple, right: tuple) -> tuple:
        """Tokens of two strings' concatenation, whose seam does not hold."""
        shift, fits, bytes_of, width = self.shift, self.fits, self.bytes_of, 1
        while True:
            lo, hi = max(0, len(left) - width), width
            window = self.windows[b"".join([bytes_of[t] for t in left[lo:] + right[:hi]])]
            if (lo == 0 or fits[left[lo - 1] << shift | window[0]]) and (hi >= len(right) or fits[window[-1] << shift | right[hi]]):
                return left[:lo] + window + right[hi:]
            width *= 2

    def encode_piece(self, text: bytes) -> tuple:
        """Tokens of one match of the split pattern: encode both halves, join."""
        half = len(text) >> 1
        if half > LEAF_BYTES - 1:
            left, right = self.encode_piece(text[:half]), self.encode_piece(text[half:])
        elif len(text) > LEAF_BYTES:
            left, right = self.windows[text[:half]], self.windows[text[half:]]
        else:
            return self.windows[text]
        if self.fits[left[-1] << self.shift | right[0]]:
            return left + right
        return self.join(left, right)

    def _chunk(self, chunk: str) -> bytes:
        ids: tuple = ()
        for piece in self.split(chunk):
            ids += self.encode_piece(piece.encode("utf-8"))
        return array("I", ids).tobytes()

    def encode(self, text: str) -> array:
        """Ids of a text. Matches of the pattern join by plain concatenation."""
        return array("I", b"".join(map(self.chunks.__getitem__, _CHUNK.findall(text))))

    def forget(self) -> None:
        """Empty the tables, so that a worker that waits for its next task holds the vocabulary alone."""
        for held in (self.windows, self.chunks, self.fits):
            held.forget()


def decode_ids(ids: array, bytes_of: dict[int, bytes]) -> bytes:
    """Bytes of ids, concatenated up the tree of halves; its leaves hold up to 64 ids."""
    if len(ids) <= 64:
        return b"".join([bytes_of[i] for i in ids])
    half = len(ids) // 2
    return decode_ids(ids[:half], bytes_of) + decode_ids(ids[half:], bytes_of)


@functools.cache
def _bytes_of(path: str) -> dict[int, bytes]:
    """Id to bytes alone: a worker that decodes needs no tables of merges."""
    return {rank: token for token, rank in load_ranks(path).items()}


@functools.cache
def _encoder(path: str, pattern: str, chunks: int, parts: int) -> TreeEncoder:
    """One for each Python worker, as the worker lives on from task to task."""
    return TreeEncoder(load_ranks(path), pattern, chunks, parts)


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: Iterable[str] = (), chunks: int = CHUNKS, parts: int = PARTS) -> DataFrame:
    """Encode whole texts. Returns `id_col`, the columns in `keep`, n_tokens, ids (binary: little-endian unsigned 32-bit integers).

    A null text counts as empty: no tokens. Rows are kept one to one, repeated rows and null ids included; other
    columns are left out. Columns in `keep` that have the names of results are refused. Very long texts are encoded whole,
    and an empty table stays empty. `chunks` and `parts` bound a worker's tables; they change time and memory only.
    """
    keep = [c for c in keep if c != id_col]
    if {"n_tokens", "ids"} & {id_col, *keep}:
        raise ValueError("n_tokens and ids are results and can't be kept")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = _encoder(ranks_path, pattern, chunks, parts)
        for batch in batches:
            schema = pa.schema([*(batch.schema.field(k) for k in range(len(keep) + 1)), ("n_tokens", pa.int64()), ("ids", pa.binary())])
            encoded = ((row, tree.encode(text or "")) for *row, text in rows_of([batch]))
            yield from to_batches(((*row, len(ids), _packed(ids)) for row, ids in encoded), schema, weigh=len(keep) + 2, most=1 << 20)
        tree.forget()

    out = T.StructType([*(df.schema[c] for c in (id_col, *keep)), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    return df.select(id_col, *keep, F.col(text_col).cast("string").alias("__text")).transform(in_batches, run, out)


def decode(df: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """Replace `ids_col` (as `encode` returns it) by decoded (binary); other columns stay, rows stay one to one. Null ids
    decode to null, empty ones to no bytes. Long lists are bounded only by what a row may hold. An empty table stays empty.

    An id outside the vocabulary fails the job, as it can't have come from `encode`. A column of the name decoded is refused.
    """
    if "decoded" in df.columns:
        raise ValueError("decoded is a result and can't be kept")
    kept = [c for c in df.columns if c != ids_col]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = _bytes_of(ranks_path)
        for batch in batches:
            schema = pa.schema([*(batch.schema.field(k) for k in range(len(kept))), ("decoded", pa.binary())])
            decoded = ((*row[:-1], None if row[-1] is None else decode_ids(_unpacked(row[-1]), bytes_of)) for row in rows_of([batch]))
            yield from to_batches(decoded, schema, weigh=len(kept))

    out = T.StructType([*(df.schema[c] for c in kept), T.StructField("decoded", T.BinaryType())])
    return df.select(*kept, ids_col).transform(in_batches, run, out)


def _packed(ids: array) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    if sys.byteorder == "big":
        ids.byteswap()
    return ids.tobytes()


def _unpacked(packed: bytes) -> array:
    ids = array("I", packed)
    if sys.byteorder == "big":
        ids.byteswap()
    return ids


class HeapCounter:
    """Token counts under a byte-level BPE of the tokenizers library: initial symbols minus merges; no ids are given out.

    The contents of added tokens count as one token wherever they stand in a text, the library's default.
    """

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        split = spec["pre_tokenizer"]
        if spec["normalizer"] or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"] or spec["model"]["ignore_merges"]:
            raise ValueError("only byte-level BPE without normalizer, prefix space and ignore_merges is supported")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take white space or need word ends are not supported")
        self.split = regex.compile(pattern).findall
        number = spec["model"]["vocab"]
        self.first = [number[letter] for letter in _byte_letters()]
        merges = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.pairs = Pairs(((number[a], number[b], rank, number[a + b]) for rank, (a, b) in enumerate(merges)), max(number.values()))
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.pieces, self.chunks = Recent(self._piece, PARTS), Recent(self._chunk, CHUNKS)

    def _piece(self, piece: str) -> int:
        """Tokens of one match of the split pattern: its bytes less the merges they take."""
        symbols = [self.first[b] for b in piece.encode("utf-8")]
        return len(symbols) - self.pairs.merge(symbols)

    def _chunk(self, chunk: str) -> int:
        pieces = self.split(chunk)
        if len(pieces) == 1:  # the table of chunks holds it
            return self._piece(chunk)
        return sum(map(self.pieces.__getitem__, pieces))

    def count(self, text: str) -> int:
        total = 0
        if self.added:
            parts = self.added.split(text)
            total += len(parts) - 1
        else:
            parts = [text]
        return total + sum(sum(map(self.chunks.__getitem__, _CHUNK.findall(part))) for part in parts)

    def forget(self) -> None:
        self.pieces.forget()
        self.chunks.forget()


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where it prints, else the next from 256 on."""
    shown = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)}
    letters, free = [], 256
    for b in range(256):
        letters.append(chr(b if b in shown else free))
        free += b not in shown
    return letters


@functools.cache
def _counter(path: str, pattern: str) -> HeapCounter:
    return HeapCounter(path, pattern)


def count_tokens(df: DataFrame, tokenizer_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token counts of whole texts. Returns `id_col`, n_bytes (UTF-8), n_tokens.

    A null text counts as empty: 0 bytes, 0 tokens. Rows are kept one to one, repeated rows and null ids included; other
    columns are left out, whatever their names. Of very long texts a worker holds one batch and the merges of one piece. An
    empty table stays empty.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer_path, pattern)
        for batch in batches:
            schema = pa.schema([("id", batch.schema.field(0).type), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
            yield from to_batches(((i, len((text or "").encode("utf-8")), counter.count(text or "")) for i, text in rows_of([batch])), schema)
        counter.forget()

    out = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).transform(in_batches, run, out).withColumnRenamed("id", id_col)
