"""Packing of documents into windows of 4096 tokens by non-negative least squares.

1. Every text is tokenised; its ids (and the end id) are written to the shared folder.
2. A document fills as many whole windows as it can; what remains has one of 4095 lengths.
   Combinations of two to four lengths that fill a window exactly are enumerated to a
   shallow depth, and non-negative least squares finds how often to repeat each so that
   together they use up the histogram of remainders. The counts are rounded down and
   made feasible, then raised greedily while remainders last.
3. The written documents are dealt out by length and salt, so that a document's rank in its
   length is known in its task: ranks within the plan take the plan's places, uncut. All
   others are packed greedily, each task filling windows one after the other, cutting
   documents at a window's end. A task's last tokens go into sequences of powers of two,
   so nothing is padded.

What reaches the driver is the histogram: lengths times salts, of fixed size. A length that
many documents share is spread over ``SALTS`` tasks. Words are tokenised once for each
worker and kept (up to a bound) by hash and text: a word whose text is not the kept one
has its whole row tokenised. Texts are cut only where the tokenizer's own pre-tokenizer
cuts, so ids are those of the whole text.

Defined results: a null or empty text is the end id alone; repeated rows are packed each;
ids of sequences are unique, not dense; other columns are not looked at.
"""

from __future__ import annotations

import os
import zlib
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binaries, mapped, table, written
from .textkit import ASCII_SPACE, LOWER, HashIndex, Words, chunks, find_words, word_hashes

WINDOW = 4096
END = 2
SALTS = 64
#: Enumeration: the most common lengths that combinations of three and of four begin with.
TRIPLE_LENGTHS, QUAD_LENGTHS = 160, 24
ROUNDS = 300
_CACHE_BITS = 21


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _classes() -> np.ndarray:
    """Of bytes: 0 white space, 1 letter, 2 punctuation, 3 digit, 4 what is never cut from its neighbours."""
    out = np.full(256, 4, np.uint8)
    for b in range(0x21, 0x7F):
        c = chr(b)
        out[b] = 1 if c.isalpha() else 3 if c.isdigit() else 4 if c == "'" else 2
    out[ASCII_SPACE] = 0
    return out


_CLASS = _classes()


class Vocabulary:
    """Token ids of text pieces by hash and text; emptied when its bound is reached."""

    def __init__(self, path: str, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.end = end
        self.clear()

    def clear(self):
        self.index = HashIndex(_CACHE_BITS)
        self.size = 1
        self.starts, self.lengths = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.lengths[0] = 1  # piece 0 is the end id
        self.flat = np.full(1, self.end, self.kind)
        self.used = 1
        self.text, self.written = np.zeros(1 << 16, np.uint8), 0
        self.text_at, self.text_size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def add(self, h: np.ndarray, raw: list[bytes]):
        """New, distinct hashes and their texts."""
        pieces = [x.decode() for x in raw]
        if self.size + len(h) > 1 << (_CACHE_BITS - 1):
            self.clear()
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        sizes = np.array([len(x) for x in ids])
        need = self.size + len(h)
        if need > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros(need, np.int64)])
            self.lengths = np.concatenate([self.lengths, np.zeros(need, np.int64)])
            self.text_at = np.concatenate([self.text_at, np.zeros(need, np.int64)])
            self.text_size = np.concatenate([self.text_size, np.zeros(need, np.int64)])
        own = LOWER[np.frombuffer(b"".join(raw), np.uint8)]
        bytes_ = np.array([len(x) for x in raw])
        if self.written + len(own) > len(self.text):
            self.text = np.concatenate([self.text, np.zeros(self.written + len(own), np.uint8)])
        self.text[self.written : self.written + len(own)] = own
        self.text_at[self.size : need] = self.written + np.cumsum(bytes_) - bytes_
        self.text_size[self.size : need] = bytes_
        self.written += len(own)
        self.starts[self.size : need] = self.used + np.cumsum(sizes) - sizes
        self.lengths[self.size : need] = sizes
        more = np.array([t for x in ids for t in x], self.kind)
        if self.used + len(more) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(self.used + len(more), self.kind)])
        self.flat[self.used : self.used + len(more)] = more
        self.used += len(more)
        self.index.add(h, np.arange(self.size, need, dtype=np.int32))
        self.size = need

    def _differ(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Pieces whose text is not that kept for their hash."""
        size = end - begin
        bad = size != self.text_size[found]
        # pieces of one size class together: eight bytes of each at a time
        at, to, left = begin.copy(), self.text_at[found], np.where(bad, 0, size)
        on = np.flatnonzero(left)
        eight = lambda x: np.ndarray((len(x) + 1,), "<u8", np.concatenate([x, np.zeros(8, np.uint8)]), strides=(1,))
        mine, kept = eight(data), eight(self.text[: self.written])
        at, to, left = at[on], to[on], left[on]
        while len(on):
            same = (mine[at] ^ kept[to]) << ((8 - np.minimum(left, 8)) * 8).astype(np.uint64) == 0
            bad[on[~same]] = True
            go = np.flatnonzero(same & (left > 8))
            on, at, to, left = on[go], at[go] + 8, to[go] + 8, left[go] - 8
        return np.flatnonzero(bad)

    def encode(self, chunk) -> tuple[np.ndarray, np.ndarray]:
        """All rows' ids, each row's followed by the end id, and how many each row has."""
        data, n = chunk.data, len(chunk.data)
        words = find_words(chunk, data, ASCII_SPACE)
        cls = _CLASS[data]
        lead = np.flatnonzero(data[:-1] == 0xC3)
        lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
        cls[lead] = cls[lead + 1] = 1
        cut = np.zeros(n + 1, bool)
        a, b = cls[:-1], cls[1:]
        cut[1:n] = (a != b) & (a != 4) & (b != 4) | (a == 3) & (b == 3)
        cut[words.begin] = True
        inside = cls != 0
        begin = np.flatnonzero(cut[:n] & inside)
        end = np.append(begin[1:], n)
        if len(words.end):
            end = np.minimum(end, words.end[np.searchsorted(words.begin, begin, "right") - 1])
        pieces = Words(begin, end, np.searchsorted(begin, chunk.begins), np.searchsorted(begin, chunk.ends))
        special = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))
        whole = np.unique(np.searchsorted(chunk.ends, special, "right"))  # rows that may hold a special token's text
        lowered = LOWER[data]
        h = np.maximum(word_hashes(lowered, pieces), 1)
        found = self.index.find(h)
        miss = np.flatnonzero(found < 0)
        if len(miss):
            new, first = np.unique(h[miss], return_index=True)
            at = miss[first]
            before = self.size
            self.add(new, [data[x:y].tobytes() for x, y in zip(begin[at], end[at], strict=True)])
            if self.size < before + len(new):  # it was emptied
                known = np.unique(h, return_index=True)
                lost = self.index.find(known[0]) < 0
                at = known[1][lost]
                self.add(known[0][lost], [data[x:y].tobytes() for x, y in zip(begin[at], end[at], strict=True)])
                found = self.index.find(h)
            else:
                found[miss] = self.index.find(h[miss])
        if len(other := self._differ(lowered, begin, end, found)):
            whole = np.union1d(whole, np.searchsorted(pieces.row_to, other, "right"))
        counts = pieces.row_to - pieces.row_from
        # the end id's piece after each row's pieces
        order = np.zeros(len(found) + chunk.rows, np.int64)
        to = np.cumsum(counts + 1)
        own = np.ones(len(order), bool)
        own[to - 1] = False
        order[own] = found
        sizes = self.lengths[order]
        ends = np.cumsum(sizes)
        flat = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[order] - (ends - sizes), sizes)]
        sizes = np.diff(np.append(0, ends[to - 1]))
        if len(whole):
            parts = np.split(flat, np.cumsum(sizes)[:-1])
            for r in whole:
                text = data[chunk.begins[r] : chunk.ends[r]].tobytes().decode()
                parts[r] = np.array([*self.tokenizer.encode(text, add_special_tokens=False).ids, self.end], self.kind)
            flat, sizes = np.concatenate(parts), np.array([len(p) for p in parts])
        return flat, sizes


_vocabularies: dict = {}


def vocabulary(path: str, end: int) -> Vocabulary:
    """One for each worker process, kept between tasks."""
    if (path, end) not in _vocabularies:
        _vocabularies[path, end] = Vocabulary(path, end)
    return _vocabularies[path, end]


def tokenise(docs: DataFrame, id_col: str, text_col: str, path: str, end: int, window: int, salts: int) -> DataFrame:
    """doc_id, n (ids, with the end id), rest (n modulo the window), salt, ids as little-endian bytes."""

    def run(batch):
        v = vocabulary(path, end)
        for c in chunks(batch.column(1), 1 << 19):
            flat, sizes = v.encode(c)
            wide = flat.itemsize
            ends = np.cumsum(sizes)
            ids = binaries(flat.view(np.uint8), (ends - sizes) * wide, ends * wide)
            rest = sizes % window
            yield {"doc_id": batch.column(0).slice(c.first, c.rows), "n": sizes, "rest": rest.astype(np.int32), "width": np.full(c.rows, wide, np.int32), "ids": ids}

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = mapped(rows, run, "doc_id long, n long, rest int, width int, ids binary")
    return out.withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int"))


def enumerate_fills(histogram: np.ndarray, window: int) -> list[tuple[int, ...]]:
    """Combinations of lengths present that fill the window: all pairs; threes and fours of common lengths and one to fit."""
    there = np.flatnonzero(histogram[1:]) + 1
    out = {(int(a), int(window - a)) for a in there if 2 * a <= window and histogram[window - a]}
    common = there[np.argsort(-histogram[there], kind="stable")]
    for depth, most in ((2, TRIPLE_LENGTHS), (3, QUAD_LENGTHS)):
        for parts in combinations_with_replacement(sorted(map(int, common[:most])), depth):
            last = window - sum(parts)
            if 0 < last < window and histogram[last]:
                out.add(tuple(sorted((*parts, last))))
    return sorted(out)


def repeat_counts(histogram: np.ndarray, fills: list[tuple[int, ...]], rounds: int = ROUNDS) -> np.ndarray:
    """Non-negative least squares: x >= 0 with |A x - histogram| least, by multiplicative updates; then whole and feasible."""
    if not fills:
        return np.zeros(0, np.int64)
    which = np.concatenate([np.full(len(f), k) for k, f in enumerate(fills)])
    length = np.concatenate([np.array(f) for f in fills])
    h = histogram.astype(np.float64)
    x = np.ones(len(fills))
    target = np.bincount(which, h[length], len(fills))
    for _ in range(rounds):
        used = np.bincount(length, x[which], len(h))
        x *= target / np.maximum(np.bincount(which, used[length], len(fills)), 1e-12)
    left = histogram.astype(np.int64).copy()
    out = np.zeros(len(fills), np.int64)
    needs = [np.unique(f, return_counts=True) for f in fills]
    order = np.argsort(-x, kind="stable")
    for final in (False, True):  # rounded down first, then whatever remainders still allow
        for k in order:
            lengths, times = needs[k]
            most = int((left[lengths] // times).min())
            n = most if final else min(most, int(x[k]))
            if n:
                out[k] += n
                left[lengths] -= n * times
    return out


class Plan:
    """Places for remainders: for a length, the ranks [first, first + n) go to sequences from ``sequence``, at ``offset``."""

    def __init__(self, histogram: np.ndarray, window: int):
        fills = enumerate_fills(histogram, window)
        counts = repeat_counts(histogram, fills)
        taken = np.zeros(window, np.int64)
        rows: list[list] = [[] for _ in range(window)]
        sequence = 0
        for f, n in zip(fills, counts.tolist(), strict=True):
            if not n:
                continue
            offset = 0
            for length in f:
                rows[length].append((int(taken[length]), sequence, offset))
                taken[length] += n
                offset += length
            sequence += n
        self.taken = taken
        self.places = {k: tuple(np.array(r).T) for k, r in enumerate(rows) if r}
        self.sequences = sequence

    def place(self, length: int, rank: int):
        """(sequence, offset) or None."""
        if rank >= self.taken[length]:
            return None
        first, sequence, offset = self.places[length]
        k = int(np.searchsorted(first, rank, "right")) - 1
        return int(sequence[k] + rank - first[k]), int(offset[k])


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end: int = END, window: int = WINDOW, salts: int = SALTS) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    if window & (window - 1):
        raise ValueError("the window is a power of two")
    tokens = written(tokenise(docs, id_col, text_col, path or tokenizer_path(), end, window, salts), "tokens", "zstd")
    found = tokens.groupBy("rest", "salt").count().toArrow()  # lengths times salts at most
    n = np.zeros((window, salts), np.int64)
    n[found["rest"].to_numpy(), found["salt"].to_numpy()] = found["count"].to_numpy()
    plan = Plan(np.where(np.arange(window) > 0, n.sum(1), 0), window)
    shared = docs.sparkSession.sparkContext.broadcast((plan, np.cumsum(n, 1) - n))

    def run(batches):
        plan, base = shared.value
        ranks: dict = {}
        open_, filled = [], 0  # pieces of the sequence being filled: doc_id, start, ids, doc_tokens
        number = (TaskContext.get().partitionId() + 1) << 40
        rows: list[tuple] = []

        def put(doc, start, ids, total, sequence, offset):
            rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, sequence, offset))

        def batch_of():
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            docs_, sizes, rests, widths, raw, salt = (batch.column(k) for k in range(6))
            for doc, total, rest, wide, ids, s in zip(docs_.to_pylist(), sizes.to_pylist(), rests.to_pylist(), widths.to_pylist(), raw, salt.to_pylist(), strict=True):
                ids = np.frombuffer(ids.as_buffer(), "<u2" if wide == 2 else "<u4")
                for start in range(0, total - rest, window):
                    put(doc, start, ids[start : start + window], total, number, 0)
                    number += 1
                if not rest:
                    continue
                start = total - rest
                rank = ranks.get((rest, s), 0)
                ranks[rest, s] = rank + 1
                at = plan.place(rest, int(base[rest, s]) + rank)
                if at:
                    put(doc, start, ids[start:], total, *at)
                    continue
                while start < total:
                    take = min(total - start, window - filled)
                    open_.append((doc, start, ids[start : start + take], total))
                    filled, start = filled + take, start + take
                    if filled == window:
                        at = 0
                        for piece in open_:
                            put(*piece, number, at)
                            at += len(piece[2])
                        number, open_, filled = number + 1, [], 0
            # pieces still open must not keep the batch's memory
            open_ = [(d, a, x.copy(), t) for d, a, x, t in open_]
            if rows:
                yield batch_of()
        while filled:
            size = 1 << (filled.bit_length() - 1)
            at = 0
            while at < size:
                doc, start, ids, total = open_.pop(0)
                take = min(len(ids), size - at)
                put(doc, start, ids[:take], total, number, at)
                if take < len(ids):
                    open_.insert(0, (doc, start + take, ids[take:], total))
                at += take
            number, filled = number + 1, filled - size
        if rows:
            yield batch_of()

    dealt = tokens.select("doc_id", "n", "rest", "width", "ids", "salt").repartition("rest", "salt")
    return dealt.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
