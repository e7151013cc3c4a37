"""Benchmark decontamination: approximate occurrences of test items in documents.

Text is compared by its words: lower case, runs of ASCII letters, digits and all other
scripts' characters; in scripts written without spaces (``UNSPACED``) each character is a word.
An item of m words may be found with up to e = m * rate errors (inserted, lost or changed
words), so one under ten words only as it is (e = 0). By the pigeonhole principle, of e + 1 pieces of the item
one stands unchanged in every such occurrence; rolling word hashes of each piece length
find those, and each hit's surroundings are verified with Myers' bit-parallel edit
distance over words.

The benchmark is the query set: it is read in blocks of at most ``BLOCK_WORDS`` words, so
what is broadcast has a fixed bound, and each block passes over all documents once; where
there are several, a block's result is written before the next block is read. The
documents are only mapped: nothing is shuffled.

Defined results: one row for each document row and item found in it, with the least
distance and, of those, the earliest end; documents without an item have no row. Null texts
and items contain nothing, nor do items without a word; equal items are all reported; ids may be null or repeated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, table, written
from .textkit import ALNUM_SEP, Chunk, Words, chunks, find_words, gram_hashes, starts_of, word_hashes

ERROR_RATE = 0.1
BLOCK_WORDS = 4_000_000
#: Thai, Lao, Tibetan, Myanmar, Khmer, Tai scripts, radicals, kana, bopomofo, Han, Yi, Javanese, Tai Viet, and Han beyond the first plane.
UNSPACED = [(0xE00, 0xFFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19FF), (0x1A20, 0x1AAF), (0x2E80, 0x2FFF), (0x3040, 0x312F), (0x3180, 0x33FF), (0x3400, 0x4DBF), (0x4E00, 0xA4CF), (0xA980, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF), (0xFF40, 0xFF9F), (0x1B000, 0x1BFFF), (0x20000, 0x3FFFF)]


def _unspaced_table() -> np.ndarray:
    """Whether a character is one of a script without spaces, by its first two bytes (blocks of 64; of 4096 from U+10000)."""
    out = np.zeros((256, 256), bool)
    for low, high in UNSPACED:
        for c in range(low, high + 1, 64):
            b = chr(c).encode()
            out[b[0], b[1]] = True
    return out.ravel()


_UNSPACED = _unspaced_table()


def words_of(chunk: Chunk) -> Words:
    """Words, and single characters of scripts without spaces."""
    data = chunk.data
    words = find_words(chunk, data, ALNUM_SEP)
    lead = np.flatnonzero(data >= 0xE0)  # of characters of three or four bytes
    lead = lead[_UNSPACED[(data[lead].astype(np.int64) << 8) | data[lead + 1]]]
    if not len(lead):
        return words
    starts = np.zeros(len(data) + 1, bool)
    starts[lead] = True
    starts[lead + 3 + (data[lead] >= 0xF0)] = True
    starts[words.begin] = False
    inside = np.zeros(len(data) + 1, np.int8)
    inside[words.begin] += 1
    inside[words.end] -= 1
    cuts = np.flatnonzero(starts & (np.cumsum(inside) > 0))
    begin, end = np.sort(np.concatenate([words.begin, cuts])), np.sort(np.concatenate([words.end, cuts]))
    return Words(begin, end, np.searchsorted(begin, chunk.begins), np.searchsorted(begin, chunk.ends))


def pieces(words: int, errors: int) -> list[tuple[int, int]]:
    """(start, size) of errors + 1 pieces of nearly equal size that make up the item."""
    cuts = [words * k // (errors + 1) for k in range(errors + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: dict, size: int, text: list) -> tuple[int, int]:
    """Least edit distance of the pattern to a part of the text, and where the earliest such part ends.

    pattern: for each symbol the bits of its places. The bit vectors are Python integers, of any width.
    """
    full, top = (1 << size) - 1, 1 << (size - 1)
    pv, mv, score = full, 0, size
    best, end = size, 0
    for j, symbol in enumerate(text):
        eq = pattern.get(symbol, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


class Index:
    """Pieces of a block of items, by length and hash."""

    def __init__(self, ids: list, texts: list, rate: float):
        self.ids, self.items, self.errors = [], [], []
        by_size: dict[int, list] = {}
        for c in chunks(pa.array(texts, pa.string())):
            words = words_of(c)
            hashes = word_hashes(c.data, words)
            for r in range(c.rows):
                own = hashes[words.row_from[r] : words.row_to[r]]
                if not len(own):
                    continue
                errors = int(len(own) * rate)
                k = len(self.items)
                self.ids.append(ids[c.first + r])
                self.items.append(own)
                self.errors.append(errors)
                for start, size in pieces(len(own), errors):
                    by_size.setdefault(size, []).append((int(gram_hashes(own[start : start + size], size)[0]), k, start))
        self.tables = {}
        for size, rows in by_size.items():
            rows.sort()
            h = np.array([r[0] for r in rows], np.uint64)
            seen = np.zeros(1 << max(14, (64 * len(h)).bit_length()), bool)
            seen[(h & np.uint64(len(seen) - 1)).view(np.int64)] = True
            self.tables[size] = (h, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), np.packbits(seen))
        self.patterns: dict[int, dict] = {}

    def pattern(self, k: int) -> dict:
        if k not in self.patterns:
            out: dict = {}
            for i, h in enumerate(self.items[k].tolist()):
                out[h] = out.get(h, 0) | (1 << i)
            self.patterns[k] = out
        return self.patterns[k]

    def hits(self, chunk, filters: dict) -> list[tuple]:
        """(row, item, distance, first word, word after the last) for the chunk's rows."""
        words = words_of(chunk)
        hashes = word_hashes(chunk.data, words)
        found = set()
        for size, (h, item, start, packed) in self.tables.items():
            if size not in filters:
                filters[size] = np.unpackbits(packed).view(bool)
            grams = gram_hashes(hashes, size)
            at = np.flatnonzero(filters[size][(grams & np.uint64(len(filters[size]) - 1)).view(np.int64)])
            if not len(at):
                continue
            a, b = np.searchsorted(h, grams[at], "left"), np.searchsorted(h, grams[at], "right")
            some = b > a
            if not some.any():
                continue
            at, a, b = at[some], a[some], b[some]
            inside = starts_of(words, size, len(grams))[at]
            at, a, b = at[inside], a[inside], b[inside]
            n = b - a
            each = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
            place = np.repeat(at, n)
            row = np.searchsorted(words.row_to, place, "right")
            found.update(zip(row.tolist(), item[each].tolist(), (place - start[each]).tolist(), strict=True))
        best: dict = {}
        for row, k, diagonal in sorted(found):
            if (row, k) in best and not best[row, k][0]:
                continue  # no later place is better
            m, errors = len(self.items[k]), self.errors[k]
            begin = max(diagonal - errors, words.row_from[row])
            part = hashes[begin : min(diagonal + m + errors, words.row_to[row])].tolist()
            distance, end = myers(self.pattern(k), m, part)
            if distance <= errors:
                # where it begins: the same search from the end
                back = {s: int(f"{v:0{m}b}"[::-1], 2) for s, v in self.pattern(k).items()}
                _, size = myers(back, m, part[:end][::-1])
                place = int(begin - words.row_from[row])
                got = (distance, place + end, place + end - size)
                best[row, k] = min(best.get((row, k), got), got)
        return [(row, self.ids[k], d, a, b) for (row, k), (d, b, a) in sorted(best.items())]


def blocks(items: DataFrame, id_col: str, text_col: str, most: int):
    """The query set in blocks of about ``most`` words, one at a time on the driver, and whether it is the last."""
    ids, texts, size = [], [], 0
    rows = items.select(F.col(id_col).cast("long").alias("i"), F.lower(F.col(text_col).cast("string")).alias("t")).where("t IS NOT NULL")
    for row in rows.toLocalIterator():
        ids.append(row["i"]), texts.append(row["t"])
        size += len(row["t"]) - sum(map(str.isascii, row["t"])) // 2 + 1  # any other character may be a word
        if size >= most:
            held, ids, texts, size = (ids, texts), [], [], 0
            yield *held, False
    yield ids, texts, True


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rate: float = ERROR_RATE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, key (see row_key), item_id, distance, first_word, end_word."""
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(id_col).cast("long"), text).alias("key"), F.lower(text).alias("text"))
    out = None
    for ids, texts, last in blocks(items, item_col, item_text, block_words):
        shared = spark.sparkContext.broadcast(Index(ids, texts, rate))

        def find(batch, shared=shared, filters={}):  # noqa: B006  kept between the batches of a task
            for c in chunks(batch.column(2)):
                got = shared.value.hits(c, filters)
                if got:
                    row, item, distance, first, end = map(list, zip(*got, strict=True))
                    at = pa.array(np.array(row) + c.first)
                    yield {"doc_id": batch.column(0).take(at), "key": batch.column(1).take(at), "item_id": item, "distance": distance, "first_word": first, "end_word": end}

        part = mapped(rows, find, "doc_id long, key long, item_id long, distance long, first_word long, end_word long")
        if not last:
            part = written(part, "hits")
            shared.unpersist()
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rate: float = ERROR_RATE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs, with all their columns, in which no item is found."""
    schema, found = docs.schema, docs
    for ids, texts, last in blocks(items, item_col, item_text, block_words):
        shared = docs.sparkSession.sparkContext.broadcast(Index(ids, texts, rate))

        def run(batches, shared=shared):
            filters: dict = {}
            for batch in batches:
                hit = {c.first + got[0] for c in chunks(batch.column(batch.num_columns - 1)) for got in shared.value.hits(c, filters)}
                keep = pa.array([k for k in range(batch.num_rows) if k not in hit], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(k).take(keep) for k in range(len(schema))], [f.name for f in schema])

        lowered = "lowered_text"
        while lowered in [c.lower() for c in docs.columns]:
            lowered += "_"
        found = found.withColumn(lowered, F.lower(F.col(text_col).cast("string"))).mapInArrow(run, schema)
        if not last:
            found = written(found, "clean", "zstd")
            shared.unpersist()
    return found


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")
