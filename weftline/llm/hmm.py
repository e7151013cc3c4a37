"""Language model: a hidden Markov model over words, trained by Baum-Welch across partitions.

Tokens are words (A-Z in lower case) and one end token a text. Training counts of all
words are summed over all training documents. The ``EMITTED`` most common words are symbols
of a model that is broadcast; all other training words, the tail, share ``CLASSES`` symbols
there, by their hashes. In each round tasks add up expected counts over whole texts, and
Spark sums them as integers, so that order does not matter. In the last round the tail's
occurrences are counted by state word for word too, in a table that grows with the input: a
state's probability of a tail word is that of its class times the word's share of the
state's counts of the class, smoothed with its share of all counts of the class; unknown
words have the smoothing alone. So the probabilities of all texts sum to one.

Texts are cut into pieces of ``PIECE`` tokens that are worked on in step, without loss: the
product of a piece's transitions and emissions, a small matrix, carries the forward and
backward messages over it exactly. Only pieces between others need it: the forward message
out of a text's first piece and the backward one into its last are vectors. Expected counts
and likelihoods are those of the scaled recursions over whole texts; messages are scaled
every ``LEVEL`` tokens, long before they leave the range of doubles.

Texts stand in blocks of about ``BLOCK`` tokens, each read by one task, which numbers the
block's tail words as they first occur. To be scored, these words, once a block each, meet
their counts in a join, and each block is read with its own words by number.

Defined results: a null or empty text is the end token alone; without training documents
all counts are 0 and states are uniform; rows of equal text get equal scores, and repeated
rows count again; a null id is not held out. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binaries, held_out, lists, mapped, removed, table, written
from .textkit import ASCII_SPACE, LOWER, HashIndex, chunks, find_words, mix, signed, word_hashes

STATES = 8
ROUNDS = 5
EMITTED = 16_384
CLASSES = 8192
PIECE = 64
LEVEL = 4
BLOCK = 1 << 21
#: Added to every expected count.
PRIOR = 0.05
#: Counts are summed in these parts: of symbols and states; of the tail's words.
_UNIT, _WORD_UNIT = 1 << 16, 1 << 8
_FLUSH = 1 << 21
#: Bytes of symbols (two a token) worked on at once.
_SLICE = 1 << 19
#: Tokens whose weights are turned to stand by state at once.
_TURN = 1 << 11
_END = 0


def class_of(h):
    """A tail word's symbol; also of a column of hashes."""
    if isinstance(h, Column):
        return (h.bitwiseAND(CLASSES - 1) + 1).cast("int")
    return (h & h.dtype.type(CLASSES - 1)).astype(np.int64) + 1


def _is_tail(symbols: np.ndarray) -> np.ndarray:
    return (symbols > _END) & (symbols <= CLASSES)


def _hashes(chunk):
    data = LOWER[chunk.data]
    words = find_words(chunk, data, ASCII_SPACE)
    return words, np.maximum(word_hashes(data, words), 1)


def count_words(docs: DataFrame) -> DataFrame:
    """h, n: each word's count in all texts; h = 0 is the end token, once a row."""

    def run(batches):
        held, size, ends = [], 0, 0

        def flush():
            h, n = np.unique(np.concatenate([*held, np.zeros(ends, np.uint64)]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(n.astype(np.int64))], ["h", "n"])

        for batch in batches:
            ends += batch.num_rows
            for c in chunks(batch.column(0)):
                _, h = _hashes(c)
                held.append(h)
                size += len(h)
                if size > _FLUSH:
                    yield flush()
                    held, size, ends = [], 0, 0
        if ends or size:
            yield flush()

    return docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


class Lexicon:
    """The most common words, by count, totals over all words, and tokens and types of the tail's classes."""

    def __init__(self, hashes, counts, ends: int, tokens: int, types: int, class_tokens, class_types):
        self.index = HashIndex.of(np.asarray(hashes, np.int64).view(np.uint64))
        self.counts = np.asarray(counts, np.int64)
        self.ends, self.tokens, self.types = ends, tokens, types
        self.class_tokens, self.class_types = np.asarray(class_tokens), np.asarray(class_types)

    def base(self, c):
        return np.log10((c + 1) / (self.tokens + self.types + 1))

    def symbol_counts(self) -> np.ndarray:
        return np.concatenate([[self.ends], self.class_tokens, self.counts]).astype(np.float64)


def _crossing(groups: pa.Table, by: str, most: int) -> tuple[int | None, int]:
    """Going down the groups, the first that does not fit into ``most`` (None if all do), and how many words come before it."""
    groups = groups.sort_by([(by, "descending")])
    sums = np.cumsum(groups["count"].to_numpy())
    k = int(np.searchsorted(sums, most, "right"))
    return (groups[by][k].as_py() if k < len(sums) else None), int(sums[k - 1]) if k else 0


def common_words(words: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the ``most`` most common words, in order; words of the last count are taken by their hashes.

    Words are grouped by steps of 64 to a doubling of the count (64 * 63 at most), then by the counts
    in the step that crosses the limit, so that only groups and chosen words reach the driver.
    """
    words = words.withColumn("step", F.floor(F.log2("n") * 64))
    step, before = _crossing(words.groupBy("step").count().toArrow(), "step", most)
    chosen = words if step is None else words.where(F.col("step") > step)
    if step is not None:
        inside = words.where(F.col("step") == step)
        count, fit = _crossing(inside.groupBy("n").count().toArrow(), "n", most - before)
        equal = inside.where(F.col("n") == count)
        share = (most - before - fit) / equal.count()
        # hashes are spread evenly: this many and a few more
        bound = int(min(1.0, share * 1.1 + 1e-4) * (1 << 64)) - (1 << 63) - 1
        chosen = chosen.unionByName(inside.where(F.col("n") > count)).unionByName(equal.where(F.col("h") <= bound))
    top = chosen.select("h", "n").toArrow()
    h, n = top["h"].to_numpy(), top["n"].to_numpy()
    order = np.lexsort((h, -n))[:most]
    return h[order], n[order]


def lexicon(counts: DataFrame, emitted: int) -> Lexicon:
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.col("h") == 0, F.col("n"))).alias("e")).first()
    words = counts.where("h <> 0")
    h, n = common_words(words, emitted)
    each = words.groupBy(class_of(F.col("h")).alias("c")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).toArrow()
    tokens, types = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    tokens[each["c"].to_numpy() - 1], types[each["c"].to_numpy() - 1] = each["n"].to_numpy(), each["v"].to_numpy()
    np.subtract.at(tokens, class_of(h) - 1, n)
    np.subtract.at(types, class_of(h) - 1, 1)
    return Lexicon(h, n, total["e"] or 0, total["n"] or 0, total["v"], tokens, types)


class Numbers:
    """Numbers of a block's tail words, in order of their first occurrence."""

    def __init__(self, bits: int = 16):
        self.index, self.hashes = HashIndex(bits), [np.zeros(0, np.uint64)]
        self.size = 0

    def of(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each word, and where in ``h`` those that are new stand."""
        out = self.index.find(h).astype(np.int64)
        miss = np.flatnonzero(out < 0)
        if not len(miss):
            return out, miss
        new, first, which = np.unique(h[miss], return_index=True, return_inverse=True)
        order = np.argsort(first)
        rank = np.empty(len(new), np.int64)
        rank[order] = np.arange(self.size, self.size + len(new))
        out[miss] = rank[which]
        if 2 * (self.size + len(new)) > len(self.index.keys):
            self.index = HashIndex(int(4 * (self.size + len(new))).bit_length())
            old = np.concatenate(self.hashes)
            self.index.add(old, np.arange(len(old), dtype=np.int32))
        self.index.add(new, rank.astype(np.int32))
        self.hashes.append(new[order])
        self.size += len(new)
        return out, miss[first[order]]


def encode(docs: DataFrame, lex) -> DataFrame:
    """doc_id, held_out, block, n_tokens, symbols (bytes of 16 bits each), tail (hashes of the words that are no symbols, in order), numbers (theirs in the block; a word that the block has not had before has -1 less its number)."""

    def run(batch, state=[None, 0, None]):  # noqa: B006  the task's block, tokens so far, the block's numbers
        m: Lexicon = lex.value
        rids = batch.column(0).to_numpy()
        for c in chunks(batch.column(3)):
            words, h = _hashes(c)
            n = words.count
            at = m.index.find(h)
            own = at >= 0
            tokens = n + 1
            ends = np.cumsum(tokens)
            symbols = np.full(ends[-1], _END, np.uint16)
            place = np.ones(len(symbols), bool)
            place[ends - 1] = False
            symbols[place] = np.where(own, at + 1 + CLASSES, class_of(h))
            block = (rids[c.first : c.first + c.rows] >> 33 << 24) + (state[1] + ends - tokens) // BLOCK
            state[1] += int(ends[-1])
            tail = np.flatnonzero(~own)
            row = np.repeat(np.arange(c.rows), n)[tail]
            numbers = np.zeros(len(tail), np.int64)
            for k in np.unique(block):
                if k != state[0]:
                    state[0], state[2] = k, Numbers()
                x, y = np.searchsorted(row, np.searchsorted(block, (k, k + 1)))
                numbers[x:y], new = state[2].of(h[tail[x:y]])
                numbers[x + new] = -1 - numbers[x + new]
            counts = np.bincount(row, minlength=c.rows)
            yield {
                **{name: batch.column(k)[c.first : c.first + c.rows] for k, name in ((1, "doc_id"), (2, "held_out"))},
                "block": block, "n_tokens": tokens, "symbols": binaries(symbols.view(np.uint8), (ends - tokens) * 2, ends * 2),
                "tail": lists(signed(h[tail]), counts, pa.int64()), "numbers": lists(numbers.astype(np.int32), counts, pa.int32()),
            }

    return mapped(docs.select("rid", "doc_id", "held_out", "text"), run, "doc_id long, held_out boolean, block long, n_tokens long, symbols binary, tail array<long>, numbers array<int>")


class Model:
    """start (K), move (K, K), emit (symbols, K): probabilities by state."""

    def __init__(self, start, move, emit):
        self.start, self.move, self.emit = start, move, emit


def first_model(counts: np.ndarray, states: int) -> Model:
    """Unigram emissions, moved apart by fixed pseudo-random factors; sticky states."""
    symbols = len(counts)
    noise = mix(np.arange(1, symbols * states + 1, dtype=np.uint64)).astype(np.float64).reshape(symbols, states) / 2.0**64
    emit = (counts[:, None] + PRIOR) * (0.5 + noise)
    move = np.full((states, states), 0.1 / max(states - 1, 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(0))


def _active(sizes: np.ndarray) -> np.ndarray:
    """How many of these sizes, largest first, are greater than 0, 1, ..."""
    return np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), "left")


def _level(x: np.ndarray, scale: np.ndarray) -> None:
    """Divides each lane of x (rows, lanes, states) by its sum, whose log10 is added to scale."""
    s = np.einsum("inj->n", x)
    x /= s[:, None]
    scale += np.log10(s)


class Pieces:
    """Pieces of texts, longest first: where they begin, their sizes, and how they follow each other."""

    def __init__(self, model: Model, symbols: np.ndarray, begins: np.ndarray, sizes: np.ndarray):
        self.model, self.symbols = model, symbols
        count = -(-sizes // PIECE)
        text = np.repeat(np.arange(len(sizes)), count)
        number = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        size = np.minimum(PIECE, sizes[text] - number * PIECE)
        order = np.argsort(-size, kind="stable")
        self.begin, self.size, self.first = (begins[text] + number * PIECE)[order], size[order], number[order] == 0
        self.active = _active(self.size)
        lane = np.empty(len(order), np.int64)
        lane[order] = np.arange(len(order))
        # lanes of the texts' pieces with number j, for texts with most pieces first
        by = np.argsort(-count, kind="stable")
        base = (np.cumsum(count) - count)[by]
        many = np.searchsorted(-count[by], -np.arange(count.max()), "left")
        self.texts, self.steps = by, [lane[base[:k] + j] for j, k in enumerate(many)]
        last = (number == count[text] - 1)[order]
        self._carry(np.flatnonzero(self.first), np.flatnonzero(~self.first & ~last), np.flatnonzero(~self.first & last))

    def _emitted(self, places: np.ndarray) -> np.ndarray:
        return self.model.emit.take(self.symbols.take(places), 0)

    def _over(self, lanes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, lanes, states): what these rows, messages at the first token, become over each piece; log10 of its scale."""
        m = self.model
        out, scale = np.empty((len(rows), len(lanes), len(m.start))), np.zeros(len(lanes))
        out[:] = rows[:, None]
        moved = np.empty_like(out)
        begin = self.begin[lanes]
        for t, k in enumerate(_active(self.size[lanes])):
            now = out[:, :k]
            if t:
                now = np.matmul(now, m.move, out=moved[:, :k])
            np.multiply(now, self._emitted(begin[:k] + t), out=out[:, :k])
            if t % LEVEL == LEVEL - 1:
                _level(out[:, :k], scale[:k])
        _level(out, scale)
        return out, scale

    def _back(self, lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lanes, states): the backward message before each piece that ends its text; log10 of its scale."""
        back = np.ascontiguousarray(self.model.move.T)
        out, scale = np.ones((len(lanes), len(back))), np.zeros(len(lanes))
        begin, active = self.begin[lanes], _active(self.size[lanes])
        for t in range(len(active) - 1, -1, -1):
            k = active[t]
            e = self._emitted(begin[:k] + t)
            e *= out[:k]
            np.matmul(e, back, out=out[:k])
            if t % LEVEL == 0:
                _level(out[None, :k], scale[:k])
        return out, scale

    def _carry(self, first: np.ndarray, inner: np.ndarray, last: np.ndarray) -> None:
        """before: the forward message that reaches each piece but a text's first; after: the backward message at its end; logs: log10 of each text's probability."""
        m = self.model
        at = np.empty(len(self.begin), np.int64)
        for lanes in (first, inner, last):
            at[lanes] = np.arange(len(lanes))
        (ahead, logs), (over, scale), (back, ending) = self._over(first, m.start[None]), self._over(inner, m.move), self._back(last)
        self.before, self.after = np.empty((len(at), len(m.start))), np.ones((len(at), len(m.start)))
        self.logs = np.empty(len(self.texts))
        follow = [*(len(lanes) for lanes in self.steps[1:]), 0]  # of the pieces with number j, those that are not their texts' last
        heads, k = at[self.steps[0]], follow[0]
        a, logs = ahead[0, heads], logs[heads]
        self.logs[self.texts[k:]] = logs[k:]
        for j in range(1, len(self.steps)):
            lanes, k = self.steps[j], follow[j]
            a, logs = a[: len(lanes)], logs[: len(lanes)]
            self.before[lanes] = a
            end = at[lanes[k:]]
            self.logs[self.texts[k : len(lanes)]] = logs[k:] + np.log10(np.einsum("ni,ni->n", a[k:], back[end])) + ending[end]
            to = at[lanes[:k]]
            a = np.einsum("ni,inj->nj", a[:k], over[:, to])
            s = a.sum(1)
            a /= s[:, None]
            logs = logs[:k] + np.log10(s) + scale[to]
        for j in range(len(self.steps) - 1, 0, -1):
            lanes, k = self.steps[j], follow[j]
            b = np.concatenate([np.einsum("inj,nj->ni", over[:, at[lanes[:k]]], self.after[lanes[:k]]), back[at[lanes[k:]]]])
            self.after[self.steps[j - 1][: len(lanes)]] = b / b.max(1)[:, None]

    def expect(self, totals) -> tuple[np.ndarray, np.ndarray]:
        """Adds expected counts to totals (start, move, emit). Gives the places of all tokens and their states' probabilities."""
        m = self.model
        start, move, emit = totals
        ends = np.cumsum(self.active)
        of = [slice(end - k, end) for end, k in zip(ends, self.active, strict=True)]  # the tokens of each step
        place = self.begin[np.arange(ends[-1]) - np.repeat(ends - self.active, self.active)] + np.repeat(np.arange(len(ends)), self.active)
        which = self.symbols.take(place)
        e = m.emit.take(which, 0)
        weight, scales = np.empty_like(e), {}
        np.multiply(np.where(self.first[:, None], m.start, self.before @ m.move), e[of[0]], out=weight[of[0]])
        for t in range(1, len(of)):
            a = np.matmul(weight[of[t - 1]][: self.active[t]], m.move, out=weight[of[t]])
            a *= e[of[t]]
            if t % LEVEL == 0:
                scales[t] = a.sum(1, keepdims=True)
                a /= scales[t]
        back, beta, moves, j = np.ascontiguousarray(m.move.T), self.after.copy(), np.zeros_like(m.move), 0
        for t in range(len(of) - 1, -1, -1):
            k, a, right = self.active[t], weight[of[t]], e[of[t]]
            beta[j:k] /= np.einsum("ni,ni->n", a[j:], beta[j:k])[:, None]
            right *= beta[:k]
            if t in scales:
                right /= scales[t]
            a *= beta[:k]
            if t:
                moves += weight[of[t - 1]][:k].T @ right
                np.matmul(right, back, out=beta[:k])
            j = k
        start += weight[of[0]][self.first].sum(0)
        later = ~self.first
        moves += self.before[later].T @ e[of[0]][later]
        move += m.move * moves
        by_state = np.empty(weight.shape[::-1])
        for x in range(0, len(weight), _TURN):
            by_state[:, x : x + _TURN] = weight[x : x + _TURN].T
        for s, values in enumerate(by_state):
            emit[:, s] += np.bincount(which, values, len(emit))
        return place, weight


def _rows_of(column: pa.Array):
    """Slices of rows: their first row and number, all symbols, where each row begins and its size."""
    for c in chunks(column, _SLICE):
        yield c, c.data.view("<u2").astype(np.int64), c.begins // 2, (c.ends - c.begins) // 2


class Tail:
    """What the shares of tail words by state come from: counts of their classes by state, and how much they are smoothed."""

    def __init__(self, lex: Lexicon, totals: np.ndarray):
        self.totals, self.weight = totals, lex.class_types + 1
        self.n = lex.class_tokens + lex.class_types + 1

    def shares(self, classes: np.ndarray, n: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """(words, states): of words of these classes (as symbols) with these counts, in all and by state, within their classes."""
        c = classes - 1
        weight = self.weight[c][:, None]
        return (counts + weight * ((n + 1) / self.n[c])[:, None]) / (self.totals[c] + weight)


def improve(encoded: DataFrame, model: Model, by_word: bool) -> tuple[Model, np.ndarray, DataFrame | None]:
    """One round of Baum-Welch over all training rows: the model, the classes' counts by state and, if asked, a table of the tail's by word (h, n, s0, ...)."""
    states, symbols = len(model.start), len(model.emit)
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    names = [f"s{k}" for k in range(states)]

    def sums(kind: bool, which: np.ndarray, n: np.ndarray, values: np.ndarray):
        values = np.rint(values * (_WORD_UNIT if kind else _UNIT)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(which), kind)), pa.array(which.astype(np.int64)), pa.array(n.astype(np.int64)), *(pa.array(values[:, k]) for k in range(states))], ["tail", "which", "n", *names])

    def run(batches):
        m = shared.value
        start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros((symbols, states))
        held, size = [], 0

        def words():
            h, weight = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(h, kind="stable")
            cut = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1])) if len(h) else order
            return sums(True, h[order][cut], np.diff(np.append(cut, len(h))), np.add.reduceat(weight[order], cut, 0) if len(h) else weight)

        for batch in batches:
            for c, ids, begins, sizes in _rows_of(batch.column(0)):
                place, weight = Pieces(m, ids, begins, sizes).expect((start, move, emit))
                if by_word:
                    at = np.flatnonzero(_is_tail(ids[place]))
                    at = at[np.argsort(place[at])]  # in order of the texts
                    held.append((batch.column(1).slice(c.first, c.rows).flatten().to_numpy(), weight[at]))
                    size += len(at)
            if size > _FLUSH // 4:
                yield words()
                size = 0
        if held:
            yield words()
        some = np.flatnonzero(emit.any(1))
        which = np.concatenate([some, symbols + np.arange(states + 1)])
        yield sums(False, which, np.zeros(len(which)), np.concatenate([emit[some], move, start[None]]))

    kinds = "tail boolean, which long, n long, " + ", ".join(f"{n} long" for n in names)
    taught = encoded.where("NOT held_out").select("symbols", *(["tail"] if by_word else []))
    found = taught.mapInArrow(run, kinds).groupBy("tail", "which").agg(*(F.sum(n).alias(n) for n in ("n", *names)))
    if by_word:
        found = written(found, "states")
    known = found.where("NOT tail").toArrow()  # symbols and states at most
    total = np.zeros((symbols + states + 1, states))
    if known.num_rows:
        total[known["which"].to_numpy()] = np.stack([known[n].to_numpy() for n in names], 1) / _UNIT
    own = found.where("tail").select(F.col("which").alias("h"), "n", *names) if by_word else None
    tail = slice(1, 1 + CLASSES)
    if by_word:  # the words' counts are rounded one by one
        each = own.groupBy(class_of(F.col("h")).alias("c")).agg(*(F.sum(n).alias(n) for n in names)).toArrow()
        total[tail] = 0
        if each.num_rows:
            total[each["c"].to_numpy()] = np.stack([each[n].to_numpy() for n in names], 1) / _WORD_UNIT
    classes = total[tail].copy()
    total += PRIOR
    emit, move, start = total[:symbols], total[symbols : symbols + states], total[-1]
    return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0)), classes, own


def log_likelihoods(model: Model, symbols: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log10 of each sequence's probability."""
    return Pieces(model, symbols, begins, sizes).logs if len(sizes) else np.zeros(0)


def train(encoded: DataFrame, lex: Lexicon, counts: DataFrame, states: int, rounds: int) -> tuple[Model, Tail, DataFrame]:
    model, totals = first_model(lex.symbol_counts(), states), np.zeros((CLASSES, states))
    words = counts.select("h", "n", *(F.lit(0).cast("long").alias(f"s{k}") for k in range(states)))
    for k in range(rounds):
        model, totals, words = improve(encoded, model, k == rounds - 1)
    return model, Tail(lex, totals), words


def score(docs: DataFrame, held: F.Column, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, rounds: int = ROUNDS, emitted: int = EMITTED) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. held: which rows are not learned from."""
    if emitted + CLASSES >= 1 << 16:
        raise ValueError("symbols have 16 bits")
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    counts = written(count_words(rows.where("NOT held_out")), "counts")
    lex = lexicon(counts, emitted)
    encoded = written(encode(rows, context.broadcast(lex)), "encoded", "zstd")
    model, tail, learned = train(encoded, lex, counts, states, rounds)
    shared = context.broadcast((model, tail, lex))
    names = [f"s{k}" for k in range(states)]
    if rounds:
        removed(docs.sparkSession, counts)
    # the tail words of each block, once a block, with what is known of them
    each = encoded.select(F.col("block").alias("block"), F.explode(F.arrays_zip("tail", "numbers")).alias("x")).where("x.numbers < 0")
    words = each.select("block", (-1 - F.col("x.numbers")).alias("number"), F.col("x.tail").alias("h")).join(learned, "h", "left")
    words = words.select("block", "number", class_of(F.col("h")).alias("class"), *(F.coalesce(n, F.lit(0)).alias(n) for n in ("n", *names)))
    kept = ("doc_id", "held_out", "n_tokens")

    def forward(texts, words):
        m, t, lex = shared.value
        order = np.argsort(words["number"].to_numpy())
        n, which = words["n"].to_numpy()[order], words["class"].to_numpy()[order]
        counts = np.stack([words[k].to_numpy() for k in names], 1)[order] / _WORD_UNIT
        own = Model(m.start, m.move, np.concatenate([m.emit, m.emit[which] * t.shares(which, n, counts)]))
        times = np.concatenate([[lex.ends], np.zeros(CLASSES, np.int64), lex.counts, n])  # in training, by symbol
        base = lex.base(times)
        flat = texts["numbers"].combine_chunks().flatten().to_numpy().astype(np.int64)
        flat = np.where(flat < 0, -1 - flat, flat) + len(m.emit)
        used, paths, bases, known = 0, [], [], []
        for _, ids, begins, sizes in _rows_of(texts["symbols"].combine_chunks()):
            some = np.flatnonzero(_is_tail(ids))
            ids[some] = flat[used : used + len(some)]
            used += len(some)
            paths.append(log_likelihoods(own, ids, begins, sizes))
            bases.append(np.add.reduceat(base[ids], begins))
            known.append(np.add.reduceat((times[ids] > 0).astype(np.int64), begins))
        out = texts.select(kept)
        for name, parts in (("path", paths), ("base", bases), ("known", known)):
            out = out.append_column(name, pa.array(np.concatenate(parts)))
        return out

    texts = encoded.select(*kept, "block", "symbols", "numbers").groupBy("block")
    scored = texts.cogroup(words.groupBy("block")).applyInArrow(forward, "doc_id long, held_out boolean, n_tokens long, path double, base double, known long")
    return scored.select("doc_id", "held_out", "n_tokens", F.col("known").alias("n_known"), F.lit(int(lex.tokens)).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("path").alias("score"))


def op10_hmm(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, held_out("doc_id", 7))


def unigram_scores(spark, sf_dir: str) -> DataFrame:
    """The columns of op10_hmm that SQL can express; DuckDB has no crc32, so all documents are learned from, in one round of two states."""
    got = score(table(spark, sf_dir, "documents"), F.lit(False), states=2, rounds=1)
    return got.select("doc_id", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


UNIGRAM_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, list_concat(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), [' ']) AS words FROM documents),
t AS (SELECT r, unnest(words) AS word FROM w), c AS (SELECT word, count(*) AS n FROM t GROUP BY 1), z AS (SELECT sum(n) AS n, count(*) AS v FROM c),
s AS (SELECT r, count(*) AS n_tokens, sum(log10((c.n + 1) / (z.n + z.v + 1))) AS base FROM t JOIN c USING (word), z GROUP BY r)
SELECT doc_id, n_tokens::BIGINT AS n_tokens, n_tokens::BIGINT AS n_known, z.n::BIGINT AS train_tokens, round(base, 4) AS base_score FROM w JOIN s USING (r), z
"""
