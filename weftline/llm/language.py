"""Language identification of mixed-language text by Viterbi over per-word scores.

A model is learned from labelled texts: log-probabilities of the byte trigrams of words
for each language (hashed to 2**16 buckets), and which languages write in which script.
Counts cover every training document; the model's size is languages times buckets (256 KB
a language), and texts are worked on in blocks of words that shrink as languages grow.

To label a text, each word gets a score for each language, the sum of its trigrams'
log-probabilities. The word's script, by code point ranges, narrows the candidates first.
Viterbi with one penalty for every switch then labels words, and runs of equal labels are
the spans. Where no run of words prefers other languages by more than the penalty, the
best constant path is the optimum, which one pass of sums proves; only the other texts
go through the recursion, all texts of a slice in step.

Defined results: ``und`` with score 0 for null texts and texts without a letter, and for
all texts when nothing could be learned; ties go to the first language by name; letters of
scripts that are not listed count as one script, ``other``; words in scripts of no learned
language favour none; texts of such words only get the most common
language with score 0. Ids may be null or repeated; other columns are not looked at.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, mapped, table
from .textkit import chunks, find_words, mix

BUCKETS = 1 << 16
SWITCH_PENALTY = 12.0
SMOOTHING = 0.5
#: A script counts as one of a language's own from this share of the language's letters.
SCRIPT_SHARE = 0.01
_SLICE = 1 << 18
#: Scores (words times languages) held at once.
_CELLS = 1 << 21
#: Languages a task counts before it hands its counts on.
_HELD = 128
#: Scripts by ranges of code points: fixed values of the Unicode block chart.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
}
#: Letters outside these ranges are of one more script.
_NAMES = [*SCRIPTS, "other"]


def _script_table() -> np.ndarray:
    """Bit of the script for a character's first byte * 256 + second byte (ASCII: any second byte).

    Two bytes tell code points below U+0800 apart, and blocks of 64 above.
    """
    out = np.zeros((256, 256), np.uint32)
    for k, ranges in enumerate(SCRIPTS.values()):
        for low, high in ranges:
            for c in range(low, high + 1, 1 if low < 0x800 else 64):
                b = chr(c).encode()
                out[b[0], b[1] if len(b) > 1 else slice(None)] = 1 << k
    other = np.uint32(1 << len(SCRIPTS))
    for low in [*range(0x80, 0x800), *range(0x800, 0xD800, 64), *range(0xE000, 0x40000, 64)]:  # no letters beyond
        b = chr(low).encode()
        if not out[b[0], b[1]] and any(unicodedata.category(chr(c))[0] == "L" for c in range(low, low + (1 if low < 0x800 else 64))):
            out[b[0], b[1]] = other
    return out.ravel()


_SCRIPT = _script_table()
_NOT_LETTER = np.ones(256, bool)
_NOT_LETTER[0x41:0x5B] = _NOT_LETTER[0x61:0x7B] = _NOT_LETTER[0x80:] = False


class Features:
    """Words of a chunk, the bucket of the trigram round each byte of them, and their scripts."""

    def __init__(self, chunk):
        data = chunk.data
        self.words = w = find_words(chunk, data, _NOT_LETTER)
        n = len(data)
        size = w.end - w.begin
        self.offset = np.cumsum(size) - size
        at = np.arange(size.sum()) + np.repeat(w.begin - self.offset, size)
        here = data[at].astype(np.uint64)
        left = data[np.maximum(at - 1, 0)].astype(np.uint64)
        right = data[np.minimum(at + 1, n - 1)] if n else data
        second = right.astype(np.int64)
        right = right.astype(np.uint64)
        left[self.offset] = 0
        right[self.offset + size - 1] = 0
        self.bucket = (mix((left << np.uint64(16)) | (here << np.uint64(8)) | right) >> np.uint64(48)).view(np.int64)
        bits = _SCRIPT[(data[at].astype(np.int64) << 8) | second]
        self.script_of_byte = bits
        self.script = np.bitwise_or.reduceat(bits, self.offset) if len(size) else np.zeros(0, np.uint32)
        self.size = size


class Model:
    """languages: names in order; logp: (buckets, languages); writes: (scripts, languages), who writes in which."""

    def __init__(self, languages, counts, scripts):
        """counts: for each language its counts by bucket, taken one by one; scripts: (languages, scripts) letters, read after them."""
        self.languages = languages
        self.logp = np.empty((BUCKETS, len(languages)), np.float32)
        for k, n in enumerate(counts):
            n = np.asarray(n, np.float64) + SMOOTHING
            self.logp[:, k] = np.log(n / n.sum())
        total = np.asarray(scripts, np.float64)
        self.writes = (total >= SCRIPT_SHARE * np.maximum(total.sum(1, keepdims=True), 1)).T & (total.T > 0)
        self.common = int(np.argmax(total.sum(1))) if len(languages) else 0

    @property
    def slice(self) -> int:
        """Bytes of text worked on at once."""
        return max(1 << 14, min(_SLICE, (1 << 20) // max(1, len(self.languages))))


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Model:
    """From all rows whose language and text are not null."""
    n_scripts = len(_NAMES)

    def count(batches):
        names: dict[str, int] = {}
        grams, scripts = [], []

        def flush():
            for name, g, s in zip(names, grams, scripts, strict=True):
                some = np.flatnonzero(g)
                which = np.concatenate([some, np.arange(n_scripts) + BUCKETS]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(which), pa.string()), pa.array(which), pa.array(np.concatenate([g[some], s]))], ["lang", "bucket", "n"])
            names.clear(), grams.clear(), scripts.clear()

        for batch in batches:
            langs = batch.column(0).to_pylist()
            for c in chunks(batch.column(1), _SLICE):
                f = Features(c)
                own = langs[c.first : c.first + c.rows]
                for x in own:
                    if x not in names:
                        names[x] = len(names)
                        grams.append(np.zeros(BUCKETS, np.int64))
                        scripts.append(np.zeros(n_scripts, np.int64))
                index = np.array([names[x] for x in own])
                per_byte = np.repeat(np.repeat(index, f.words.count), f.size)
                for k in np.unique(index):
                    here = per_byte == k
                    grams[k] += np.bincount(f.bucket[here], minlength=BUCKETS)
                    bits = f.script_of_byte[here]
                    scripts[k] += [int(np.count_nonzero(bits & np.uint32(1 << s))) for s in range(n_scripts)]
                if len(names) > _HELD:
                    yield from flush()
        yield from flush()

    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    rows = rows.select("lang", F.lower("text").alias("text"))
    counted = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # one row a language: lists of at most the buckets' number
    found = counted.groupBy("lang").agg(F.collect_list("bucket").alias("bucket"), F.collect_list("n").alias("n")).orderBy("lang").toArrow()
    scripts = np.zeros((found.num_rows, n_scripts), np.int64)

    def each():
        for k, (b, n) in enumerate(zip(found["bucket"], found["n"], strict=True)):
            counts = np.zeros(BUCKETS + n_scripts, np.int64)
            counts[b.values.to_numpy()] = n.values.to_numpy()
            scripts[k] = counts[BUCKETS:]
            yield counts[:BUCKETS]

    return Model(found["lang"].to_pylist(), each(), scripts)


def _word_scores(f: Features, model: Model, which: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray]:
    """Scores of words (rows) for each language; which of them have a candidate at all."""
    k = len(model.languages)
    size, offset, script = f.size[which], f.offset[which], f.script[which]
    if not len(size):
        return np.zeros((0, k)), np.zeros(0, bool)
    begin = np.cumsum(size) - size
    if isinstance(which, slice):
        bucket = f.bucket[offset[0] : offset[-1] + size[-1]]
    else:
        bucket = f.bucket[np.arange(size.sum()) + np.repeat(offset - begin, size)]
    scores = np.add.reduceat(model.logp[bucket], begin, 0).astype(np.float64)
    able = np.zeros((len(size), k), bool)
    for s in range(len(_NAMES)):
        uses = (script >> np.uint32(s)) & 1 == 1
        if uses.any():
            able[uses] |= model.writes[s]
    known = able.any(1)
    scores[~able] = -1e5
    scores[~known] = 0
    return scores, known


def _paths(scores_of, begins: np.ndarray, counts: np.ndarray, penalty: float, labels: np.ndarray, cells: int = _CELLS) -> None:
    """Viterbi in step over texts, given by their first word and length: sets the labels of their words.

    scores_of: scores of an array of words. They are asked for a run of steps at a time, and of the
    way back one bit a word and language is kept.
    """
    order = np.argsort(-counts, kind="stable")
    begins, counts = begins[order], counts[order]
    active = np.searchsorted(-counts, -np.arange(counts[0]), "left")
    value = scores_of(begins)
    k = value.shape[1]
    stays, bests = [], []
    t = 1
    while t < counts[0]:
        to = t + 1
        cost = active[t] * k
        while to < counts[0] and cost + active[to] * k <= cells:
            cost += active[to] * k
            to += 1
        ahead = scores_of(np.concatenate([begins[: active[x]] + x for x in range(t, to)]))
        at = 0
        for x in range(t, to):
            n = active[x]
            v = value[:n]
            best = v.argmax(1)
            jump = v[np.arange(n), best] - penalty
            stay = v >= jump[:, None]
            stays.append(np.packbits(stay, axis=1) if k > 8 else stay)
            bests.append(best.astype(np.int32))
            value[:n] = np.where(stay, v, jump[:, None]) + ahead[at : at + n]
            at += n
        t = to
    state = value.argmax(1)
    for t in range(counts[0] - 1, 0, -1):
        n = active[t]
        labels[begins[:n] + t] = state[:n]
        now = state[:n]
        stay = stays[t - 1][np.arange(n), now] if k <= 8 else (stays[t - 1][np.arange(n), now >> 3] >> (7 - (now & 7))) & 1 == 1
        state[:n] = np.where(stay, now, bests[t - 1])
    labels[begins] = state


def label_words(f: Features, model: Model, penalty: float, cells: int = _CELLS) -> tuple[np.ndarray, np.ndarray]:
    """Each word's language, and whether it has a candidate at all."""
    count = f.words.count
    n, k = len(f.size), len(model.languages)
    known = np.zeros(n, bool)
    if not n:
        return np.zeros(0, np.int32), known
    row = np.repeat(np.arange(len(count)), count)
    total = np.zeros((len(count), k))
    step = max(1, cells // k)
    blocks = [slice(a, min(n, a + step)) for a in range(0, n, step)]
    whole = None
    for b in blocks:
        scores, known[b] = _word_scores(f, model, b)
        cut = np.flatnonzero(np.append(True, row[b][1:] != row[b][:-1]))
        total[row[b][cut]] += np.add.reduceat(scores, cut, 0)
        whole = scores if len(blocks) == 1 else None
    best = total.argmax(1)
    labels = np.repeat(best, count).astype(np.int32)
    if k == 1:
        return labels, known
    # the gain of leaving the best language, and the best run of it: at most the penalty, so staying is optimal
    gain = np.zeros(n + 1)
    for b in blocks:
        scores = _word_scores(f, model, b)[0] if whole is None else whole.copy()
        at = np.arange(len(scores))
        own = scores[at, labels[b]]
        scores[at, labels[b]] = -np.inf
        gain[b.start + 1 : b.stop + 1] = np.clip(scores.max(1) - own, -1e5, 1e5)
    gain = np.cumsum(gain)
    far = (np.abs(gain).max() + 1) * 4
    some = np.flatnonzero(count)
    low = np.minimum.accumulate(gain[:-1] - row * far) + row * far
    rise = gain[1:] - low
    most = np.maximum.reduceat(rise, f.words.row_from[some])
    hard = some[most > penalty - 1e-6]
    if len(hard):
        scores_of = (lambda which: whole[which]) if whole is not None else (lambda which: _word_scores(f, model, which)[0])
        _paths(scores_of, f.words.row_from[hard], count[hard], penalty, labels, cells)
    return labels, known


def has_letter(text: F.Column) -> F.Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = SWITCH_PENALTY, keep: tuple = ()) -> DataFrame:
    """doc_id, lang_pred, score, n_spans, spans and the columns of ``keep``.

    score: the share of lang_pred in the letters of words with a candidate; spans: ``lang@word``
    for each span, by its first word.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def find(batch):
        m = shared.value
        for c in chunks(batch.column(1), m.slice):
            letter = batch.column(2).slice(c.first, c.rows).to_pylist()
            out = {n: batch.column(3 + i).slice(c.first, c.rows) for i, n in enumerate(keep)}
            names, share, number, texts = [], [], [], []
            if m.languages:
                f = Features(c)
                labels, known = label_words(f, m, penalty)
                row = np.repeat(np.arange(c.rows), f.words.count)
                k = len(m.languages)
                weight = np.bincount(row * k + labels, f.size * known, c.rows * k).reshape(c.rows, k) if len(row) else np.zeros((c.rows, k))
                top, total = weight.argmax(1), weight.sum(1)
                new = np.flatnonzero(np.append(True, (labels[1:] != labels[:-1]) | (row[1:] != row[:-1]))) if len(row) else np.zeros(0, int)
                at = np.searchsorted(row[new], np.arange(c.rows + 1))
            for i in range(c.rows):
                if not letter[i] or not m.languages:
                    names.append("und"), share.append(0.0), number.append(0), texts.append("")
                    continue
                names.append(m.languages[top[i] if total[i] else m.common])
                share.append(float(weight[i, top[i]] / total[i]) if total[i] else 0.0)
                own = new[at[i] : at[i + 1]]
                number.append(len(own))
                texts.append(" ".join(f"{m.languages[labels[j]]}@{j - f.words.row_from[i]}" for j in own))
            yield out | {"doc_id": batch.column(0).slice(c.first, c.rows), "lang_pred": names, "score": share, "n_spans": number, "spans": texts}

    if clash := [n for n in keep if n.lower() in ("doc_id", "lang_pred", "score", "n_spans", "spans")]:
        raise ValueError(f"columns made here cannot be kept: {clash}")
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.lower(text).alias("text"), has_letter(text).alias("letter"), *(F.col(c).alias(f"keep_{c}") for c in keep))
    kinds = ", ".join(f"{n} {dict(docs.dtypes)[n]}" for n in keep)
    return mapped(rows, find, "doc_id long, lang_pred string, score double, n_spans long, spans string" + (", " + kinds if kinds else ""))


def learn_from_split(docs: DataFrame) -> Model:
    """From the documents that the contract does not hold out."""
    return learn(docs.where(~held_out("doc_id", 4) & F.col("doc_id").isNotNull()))


def op2_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "text", held_out("doc_id", 4).alias("held_out"))
    return identify(rows, learn_from_split(docs), keep=("held_out",))
