"""Substring deduplication: passages of 35 words that start more than once are cut out.

Two passes over the text. A window of 35 words is represented by its *seed*: of its 21
runs of 15 words the one with the least hash (the leftmost of equals). Equal windows have
equal seeds at equal places, and a seed serves about eleven windows in a row (a *span*),
so the count of a seed's occurrences bounds every window's count from above.

1. Count-min prefilter. The sketch's hash function takes a window to the cell of its seed,
   so that a span counts once and not once a window. Each partition counts in a sketch of
   two rows; sketches are merged slice by slice and come down to one bit a cell (seen twice
   or more), which is broadcast. Its size follows the bytes of all texts, and is at most
   ``MOST_BITS``. For more text than that serves, the repeated seeds are a table instead,
   counted by a shuffle and joined to the spans: nothing is broadcast then.
2. Exact grouping of the windows whose seed may be repeated. Spans are grouped by a hash
   of 128 bits: all windows of a span seen twice are repeated. Only where one seed stands
   in different spans are single windows grouped, by 128 bits again. What was found is
   joined to the occurrences, gathered by document, and the words covered are removed.

Hot passages are combined before each shuffle, and spans of one seed are salted; where
occurrences meet their spans the join has no other operator on its shuffles, so skewed
partitions are split at run time.
A document is never compared with another one.

Defined results: null and empty texts have no words and keep the digest of the empty
string; texts under 35 words lose nothing; repeated rows count as repeated text; rows
equal in id and text get equal results; other columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lists, mapped, row_key, table
from .common import written as write_table
from .textkit import ASCII_SPACE, chunks, find_words, gram_hashes, mix, signed, sliding, starts_of, word_hashes

WINDOW = 35
SEED_WORDS = 15
#: Cells of each of the sketch's two rows, as a power of two: about one for eight bytes of text (some eight a span), 2**30 bits or 128 MB in all at most.
LEAST_BITS, MOST_BITS = 20, 29
BYTES_A_CELL = 8
#: Spans of a seed are dealt over this many tasks where they are told apart by window.
SALTS = 16
_SLICE_BITS = 20
_FLUSH = 1 << 22


def span_hashes(hashes: np.ndarray, begin: np.ndarray, size: np.ndarray, window: int, which: int) -> np.ndarray:
    """Hash of each span's words: of its first and its last window, and how far they lie apart. A span is shorter than two windows."""
    grams = gram_hashes(hashes, window, which)
    return mix(mix(grams[begin]) ^ (grams[begin + size - 1] + size.astype(np.uint64)))


class Spans:
    """Seeds of a chunk's windows and the runs of windows they serve."""

    def __init__(self, chunk, window: int, seed: int):
        self.words = find_words(chunk, chunk.data, ASCII_SPACE)
        self.hashes = word_hashes(chunk.data, self.words)
        n = len(self.hashes)
        self.begin = self.size = self.row = np.zeros(0, np.int64)
        self.seed = np.zeros(0, np.uint64)
        if n < window:
            return
        grams = gram_hashes(self.hashes, seed)
        low = np.uint64((1 << 31) - 1)  # a text has fewer words
        least = sliding((grams & ~low) | np.arange(len(grams), dtype=np.uint64), window - seed + 1, np.minimum)
        at = np.flatnonzero(starts_of(self.words, window, len(least)))
        if not len(at):
            return
        place = (least[at] & low).astype(np.int64)
        new = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)))
        self.begin, self.size = at[new], np.diff(np.append(new, len(at)))
        self.seed = grams[place[new]]
        self.row = np.searchsorted(self.words.row_to, self.begin, "right")


def _cells(seed: np.ndarray, bits: int) -> list[np.ndarray]:
    """The cell of each seed in each row of the sketch, numbered through both rows."""
    low = np.uint64((1 << bits) - 1)
    return [((seed >> np.uint64(shift)) & low) + np.uint64(row << bits) for row, shift in enumerate((0, 64 - bits))]


def sketch_bits(docs: DataFrame, text_col: str) -> int:
    """Size of the sketch that the texts ask for; more than ``MOST_BITS`` is not built."""
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")).cast("long")).alias("n")).first()["n"] or 0
    return max(LEAST_BITS, (size // BYTES_A_CELL).bit_length())


def repeated_seeds(docs: DataFrame, text_col: str, window: int, seed: int) -> DataFrame:
    """seed: those that stand twice or more, by exact counts."""

    def count(batch):
        for c in chunks(batch.column(0)):
            found, n = np.unique(Spans(c, window, seed).seed, return_counts=True)
            yield {"seed": signed(found), "n": n}

    each = mapped(docs.select(F.col(text_col).cast("string").alias("text")), count, "seed long, n long")
    return each.groupBy("seed").agg(F.sum("n").alias("n")).where("n > 1").select("seed")


def sketch(docs: DataFrame, text_col: str, window: int, seed: int, bits: int) -> np.ndarray:
    """Bits of the merged count-min sketch: which cells were counted twice or more. 2**(bits + 1) of them."""
    slice_bits = min(_SLICE_BITS, bits)

    def flush(cells):
        found, n = np.unique(np.concatenate(cells), return_counts=True)
        which = found >> np.uint64(slice_bits)
        cut = np.flatnonzero(np.append(True, which[1:] != which[:-1]))
        ends = np.append(cut[1:], len(found))
        inside = (found & np.uint64((1 << slice_bits) - 1)).astype(np.uint32)
        rows = [np.where(n[a:b] > 1, inside[a:b] | np.uint32(1 << 31), inside[a:b]).tobytes() for a, b in zip(cut, ends, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(which[cut].astype(np.int32)), pa.array(rows, pa.binary())], ["slice", "cells"])

    def count(batches):
        held, size = [], 0
        for batch in batches:
            for c in chunks(batch.column(0)):
                for cells in _cells(Spans(c, window, seed).seed, bits):
                    held.append(cells)
                    size += len(cells)
                if size > _FLUSH:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    def merge(batches):
        now, seen, twice = None, None, None
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if k != now:
                    if now is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(twice).tobytes()], pa.binary())], ["slice", "bits"])
                    now, seen, twice = k, np.zeros(1 << slice_bits, bool), np.zeros(1 << slice_bits, bool)
                cells = np.frombuffer(raw.as_buffer(), np.uint32)
                at = cells & np.uint32(0x7FFFFFFF)
                twice[at] |= seen[at] | (cells >> np.uint32(31)).astype(bool)
                seen[at] = True
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(twice).tobytes()], pa.binary())], ["slice", "bits"])

    parts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "slice int, cells binary")
    merged = parts.repartition("slice").sortWithinPartitions("slice").mapInArrow(merge, "slice int, bits binary")
    out = np.zeros((1 << (bits + 1 - slice_bits), max(1, (1 << slice_bits) // 8)), np.uint8)
    for row in merged.collect():  # the sketch's fixed size at most
        out[row["slice"]] = np.frombuffer(row["bits"], np.uint8)
    return out.ravel()


def _estimated_twice(table_bits: np.ndarray, seed: np.ndarray, bits: int) -> np.ndarray:
    ok = np.ones(len(seed), bool)
    for cell in _cells(seed, bits):
        cell = cell.view(np.int64)
        ok &= (table_bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
    return ok


def occurrences(docs: DataFrame, seen_twice, with_windows: bool, window: int, seed: int, bits: int) -> DataFrame:
    """A row for each span whose seed may be repeated. docs: id, key, text; seen_twice: a broadcast sketch, or a table of seeds."""
    by_join = isinstance(seen_twice, DataFrame)
    shared = None if by_join else seen_twice

    def find(batch):
        flags = None if shared is None else np.frombuffer(shared.value, np.uint8)
        for c in chunks(batch.column(2)):
            s = Spans(c, window, seed)
            keep = np.arange(len(s.seed)) if flags is None else np.flatnonzero(_estimated_twice(flags, s.seed, bits))
            if not len(keep):
                continue
            begin, size, row = s.begin[keep], s.size[keep], s.row[keep]
            other = word_hashes(c.data, s.words, 1)
            out = {"seed": signed(s.seed[keep]), "a": signed(span_hashes(s.hashes, begin, size, window, 0)), "b": signed(span_hashes(other, begin, size, window, 1)), "size": size.astype(np.int32)}
            if with_windows:
                each = np.repeat(begin - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
                yield out | {"windows": lists(signed(gram_hashes(other, window, 1)[each]), size, pa.int64())}
            else:
                at = pa.array(row + c.first)
                yield out | {"id": batch.column(0).take(at), "key": batch.column(1).take(at), "at": begin - s.words.row_from[row]}

    kinds = "seed long, a long, b long, size int, " + ("windows array<long>" if with_windows else "id long, key long, at long")
    found = mapped(docs, find, kinds)
    return found.join(seen_twice, "seed", "left_semi") if by_join else found


def repeated_spans(docs: DataFrame, seen_twice, window: int, seed: int, bits: int) -> DataFrame:
    """a, b, mask: which of a span's windows (bit i: the i-th) start more than once in all documents."""
    spans = occurrences(docs, seen_twice, True, window, seed, bits).groupBy("seed", "a", "b", "size").agg(F.count("*").alias("n"), F.first("windows").alias("windows"))
    spans = write_table(spans, "spans")
    several = spans.groupBy("seed").agg(F.count("*").alias("c")).where("c > 1").select("seed", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = spans.withColumn("salt", F.pmod("a", F.lit(SALTS)).cast("int"))
    single = dealt.join(several, ["seed", "salt"]).select("seed", "a", "b", "n", F.posexplode("windows").alias("i", "w"))
    twice = single.groupBy("seed", "w").agg(F.sum("n").alias("t")).where("t > 1").select("seed", "w")
    parts = single.where("n = 1").join(twice, ["seed", "w"]).groupBy("a", "b").agg(F.expr("bit_or(shiftleft(1L, i))").alias("mask"))
    return spans.where("n > 1").select("a", "b", F.expr("shiftleft(1L, size) - 1").alias("mask")).unionByName(parts)


def marks(docs: DataFrame, window: int = WINDOW, seed: int = SEED_WORDS, most_bits: int = MOST_BITS) -> DataFrame:
    """id, key, marks: for each document with repeated windows, start and mask of its spans in one number each."""
    if window - seed + 1 > 21:
        raise ValueError("a span's mask has 21 bits")
    bits = sketch_bits(docs, "text")
    if bits <= most_bits:
        seen_twice = docs.sparkSession.sparkContext.broadcast(sketch(docs, "text", window, seed, bits).tobytes())
    else:
        seen_twice = write_table(repeated_seeds(docs, "text", window, seed), "seeds")
    spans = repeated_spans(docs, seen_twice, window, seed, bits)
    found = occurrences(docs, seen_twice, False, window, seed, bits).join(spans, ["a", "b"])
    return found.groupBy("id", "key").agg(F.collect_list(F.expr("shiftleft(at, 21) | mask")).alias("marks"))


def _removed(chunk, words, packed: pa.Array, window: int) -> np.ndarray:
    """Which of the chunk's words are covered by a marked window."""
    packed = packed.fill_null([])
    counts = np.diff(packed.offsets.to_numpy()) if len(packed) else np.zeros(0, int)
    values = packed.flatten().to_numpy()
    start = (values >> 21) + np.repeat(words.row_from, counts)
    change = np.zeros(len(words.begin) + 1, np.int64)
    for i in range(21):
        at = start[(values >> i) & 1 == 1] + i
        change += np.bincount(at, minlength=len(change))[: len(change)]
        change -= np.bincount(at + window, minlength=len(change))[: len(change)]
    return np.cumsum(change[:-1]) > 0


def _gather(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of ``data`` laid end to end with ``gap`` spaces after each; where each begins."""
    to = np.concatenate([[0], np.cumsum(sizes + gap)])
    out = np.full(to[-1], 0x20, np.uint8)
    step = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[step + np.repeat(to[:-1], sizes)] = data[step + np.repeat(begins, sizes)]
    return out, to


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, keep: tuple = (), window: int = WINDOW, seed: int = SEED_WORDS, most_bits: int = MOST_BITS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256; with keep_text also kept_text, whose words keep their white space; and the columns of keep."""
    made = ("doc_id", "n_words", "n_removed", "kept_sha256", *(("kept_text",) if keep_text else ()))
    if clash := [c for c in keep if c.lower() in made]:
        raise ValueError(f"columns made here cannot be kept: {clash}")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(f"keep_{c}") for c in keep))
    rows = rows.select("id", row_key("id", "text").alias("key"), "text", *(f"keep_{c}" for c in keep))
    found = marks(rows.select("id", "key", "text"), window, seed, most_bits)
    both = rows.join(found.withColumnRenamed("id", "_id").withColumnRenamed("key", "_key"), F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")

    def cut(batch):
        for c in chunks(batch.column(2)):
            words = find_words(c, c.data, ASCII_SPACE)
            gone = _removed(c, words, batch.column(3).slice(c.first, c.rows), window)
            live = np.flatnonzero(~gone)
            size = words.end[live] - words.begin[live]
            joined, to = _gather(c.data, words.begin[live], size, 1)
            first = np.searchsorted(live, words.row_from)
            last = np.searchsorted(live, words.row_to)
            raw = memoryview(joined)
            digests = [hashlib.sha256(raw[to[a] : to[b] - 1] if b > a else b"").hexdigest() for a, b in zip(first, last, strict=True)]
            out = {"doc_id": batch.column(0).slice(c.first, c.rows), "n_words": words.count, "n_removed": words.count - (last - first), "kept_sha256": digests}
            if keep_text:
                # a word goes with the white space after it
                after = np.append(words.begin[1:], len(c.data))
                ends = np.repeat(c.ends, words.count)
                whole, to = _gather(c.data, words.begin[live], np.minimum(after, ends)[live] - words.begin[live], 0)
                raw = whole.tobytes()
                out |= {"kept_text": [raw[to[a] : to[b]].decode() for a, b in zip(first, last, strict=True)]}
            yield out | {name: batch.column(4 + k).slice(c.first, c.rows) for k, name in enumerate(keep)}

    kept = "".join(f", {c} {dict(docs.dtypes)[c]}" for c in keep)
    kinds = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text + kept
    return mapped(both.select("id", "key", "text", "marks", *(f"keep_{c}" for c in keep)), cut, kinds)


def op6_substrings(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


#: The same result by grouping every window; DuckDB's regexp reads \x escapes.
OP6_SQL = r"""
WITH w AS (SELECT rowid AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)),
p AS (SELECT r, unnest(range(0, greatest(len(words) - 34, 0))) AS i, words FROM w),
h AS (SELECT r, i, array_to_string(words[i + 1 : i + 35], ' ') AS k FROM p),
t AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY k) AS n FROM h) WHERE n > 1),
c AS (SELECT DISTINCT r, i + unnest(range(0, 35)) AS j FROM t),
g AS (SELECT r, list(j) AS gone FROM c GROUP BY r),
k AS (SELECT w.r, doc_id, words, gone, CASE WHEN gone IS NULL THEN words ELSE list_filter(words, lambda x, i: NOT list_contains(gone, i - 1)) END AS kept FROM w LEFT JOIN g ON w.r = g.r)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - len(kept))::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
