"""Language model, shards, chat formatting and the pipeline."""

import itertools
import json
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import chat, hmm, sharding
from weftline.llm.common import held_out
from weftline.llm.graph import components


def tokens(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


# ---- language model ----


@pytest.fixture(scope="module")
def scored(odd):
    return hmm.score(odd, held_out("doc_id", 7), states=3, rounds=2, emitted=50).collect()


def test_counts_and_base_scores_equal_brute_force(scored, rows, spark):
    out = {r.doc_id: r.h for r in spark.createDataFrame([(x,) for x in {r[0] for r in rows}], "doc_id long").select("doc_id", held_out("doc_id", 7).alias("h")).collect()}
    count = Counter(t for r in rows if not out[r[0]] for t in tokens(r[1]))
    n, v = sum(count.values()), len(count)
    want = Counter((r[0], out[r[0]], len(tokens(r[1])), sum(t in count for t in tokens(r[1])), n, round(sum(math.log10((count[t] + 1) / (n + v + 1)) for t in tokens(r[1])), 5)) for r in rows)
    got = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in scored)
    assert got == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in scored)


def test_forward_recursion_sums_over_all_paths():
    rng = np.random.default_rng(4)
    k, m = 3, 5
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    model = hmm.Model(norm(rng.random(k), 0), norm(rng.random((k, k)), 1), norm(rng.random((m, k)), 0))
    symbols = rng.integers(0, m, 11)
    got = hmm.log_likelihoods(model, symbols, np.array([0, 5, 7]), np.array([5, 2, 4]))
    for x, b, n in zip(got, (0, 5, 7), (5, 2, 4), strict=True):
        total = 0.0
        for path in itertools.product(range(k), repeat=n):
            p = model.start[path[0]] * model.emit[symbols[b], path[0]]
            for t in range(1, n):
                p *= model.move[path[t - 1], path[t]] * model.emit[symbols[b + t], path[t]]
            total += p
        assert math.isclose(x, math.log10(total), rel_tol=1e-9)


def test_expected_counts_equal_those_over_all_paths():
    rng = np.random.default_rng(6)
    k, m, n = 2, 4, 6
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    model = hmm.Model(norm(rng.random(k), 0), norm(rng.random((k, k)), 1), norm(rng.random((m, k)), 0))
    symbols = rng.integers(0, m, n)
    start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((m, k))
    hmm.Pieces(model, symbols, np.array([0]), np.array([n])).expect((start, move, emit))
    want, total = np.zeros((m, k)), 0.0
    turns = np.zeros((k, k))
    for path in itertools.product(range(k), repeat=n):
        p = model.start[path[0]] * np.prod([model.move[a, b] for a, b in zip(path, path[1:], strict=False)]) * np.prod([model.emit[s, z] for s, z in zip(symbols, path, strict=True)])
        total += p
        for s, z in zip(symbols, path, strict=True):
            want[s, z] += p
        for a, b in zip(path, path[1:], strict=False):
            turns[a, b] += p
    assert np.allclose(emit, want / total) and np.allclose(move, turns / total) and math.isclose(start.sum(), 1)


def test_training_raises_the_likelihood_and_beats_counts(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one, five = ({r.doc_id: r for r in hmm.score(d, held_out("doc_id", 7), rounds=k).collect()} for k in (0, 4))
    held = [k for k, r in one.items() if r.held_out]
    assert sum(five[k].score for k in held) > sum(one[k].score for k in held)
    assert sum(five[k].score for k in held) > sum(five[k].base_score for k in held)


def small_lexicon(monkeypatch):
    """Two symbols of 8 tokens; a tail of 8 tokens of 5 words in two classes."""
    monkeypatch.setattr(hmm, "CLASSES", 2)
    return hmm.Lexicon([1, 2], [5, 3], 4, 20, 8, [5, 3], [3, 2])


def test_probabilities_of_symbols_sum_to_one(monkeypatch):
    lex = small_lexicon(monkeypatch)
    model = hmm.first_model(lex.symbol_counts(), 4)
    assert model.emit.shape == (5, 4) and np.allclose(model.emit.sum(0), 1) and np.allclose(model.move.sum(1), 1)


def test_rare_words_have_emissions_by_state(spark, monkeypatch):
    """Two kinds of text with rare words of their own: with one symbol of its own, every word still tells the kinds apart."""
    rng = np.random.default_rng(1)
    text = lambda kind: " ".join(f"{kind}{k}" for k in rng.integers(0, 40, 60))
    rows = [(k, text("ab"[k % 2])) for k in range(60)] + [(100, text("a")), (101, text("b")), (102, " ".join(f"{'ab'[k % 2]}{k % 40}" for k in range(60)))]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    held = F.col("doc_id") >= 100
    got = {r.doc_id: r for r in hmm.score(d, held, states=2, rounds=12, emitted=1).collect()}
    assert len(got) == len(rows) and got[100].score > got[102].score + 5 and got[101].score > got[102].score + 5
    assert abs(got[102].base_score - got[100].base_score) < 5
    monkeypatch.setattr(hmm, "BLOCK", 100)  # blocks do not change the result
    again = {r.doc_id: r for r in hmm.score(d, held, states=2, rounds=12, emitted=1).collect()}
    assert all(math.isclose(got[k].score, again[k].score, rel_tol=1e-3) for k in got)


def test_shares_of_tail_words_sum_to_one(monkeypatch):
    """Known words of a class and one unknown word share its whole mass."""
    lex = small_lexicon(monkeypatch)
    h, n = np.array([10, 12, 14, 11, 13, 16, 15]), np.array([2, 2, 1, 2, 1, 0, 0])
    counts = np.array([[2, 0], [1, 1], [0, 1], [1, 1], [0, 1], [0, 0], [0, 0]])
    even = h % 2 == 0
    shares = hmm.Tail(lex, np.array([counts[even].sum(0), counts[~even].sum(0)])).shares(hmm.class_of(h), n, counts)
    assert np.allclose(shares[even].sum(0), 1) and np.allclose(shares[~even].sum(0), 1)


def test_transitions_between_pieces_count(monkeypatch):
    rng = np.random.default_rng(3)
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    model = hmm.Model(norm(rng.random(3), 0), norm(rng.random((3, 3)), 1), norm(rng.random((7, 3)), 0))
    monkeypatch.setattr(hmm, "PIECE", 4)
    start, move, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((7, 3))
    sizes = np.array([11, 4, 1, 8])
    hmm.Pieces(model, rng.integers(0, 7, 24), np.cumsum(sizes) - sizes, sizes).expect((start, move, emit))
    assert math.isclose(move.sum(), (sizes - 1).sum()) and math.isclose(emit.sum(), 24)


@pytest.mark.parametrize("states", [1, 3])
def test_pieces_do_not_change_counts_or_likelihoods(monkeypatch, states):
    rng = np.random.default_rng(5)
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    model = hmm.Model(norm(rng.random(states), 0), norm(rng.random((states, states)), 1), norm(rng.random((9, states)) ** 6, 0))
    sizes = rng.integers(1, 90, 40)
    symbols, begins = rng.integers(0, 9, sizes.sum()), np.cumsum(sizes) - sizes
    out = []
    for piece in (1000, 7, 1):
        monkeypatch.setattr(hmm, "PIECE", piece)
        totals = np.zeros(states), np.zeros((states, states)), np.zeros((9, states))
        p = hmm.Pieces(model, symbols, begins, sizes)
        place, weight = p.expect(totals)
        by_place = np.empty_like(weight)
        by_place[place] = weight
        out.append((*totals, p.logs, by_place))
    for other in out[1:]:
        assert all(np.allclose(a, b) for a, b in zip(out[0], other, strict=True))


def test_only_pieces_between_others_are_carried_as_matrices(monkeypatch):
    """Messages over texts of one or two pieces take one row a token, not one a token and state."""
    monkeypatch.setattr(hmm, "PIECE", 16)
    rng = np.random.default_rng(8)
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    model = hmm.Model(norm(rng.random(8), 0), norm(rng.random((8, 8)), 1), norm(rng.random((9, 8)), 0))
    rows, matmul = [], np.matmul
    monkeypatch.setattr(np, "matmul", lambda a, *rest, **named: (rows.append(a.size // 8), matmul(a, *rest, **named))[1])
    for sizes, most in ((rng.integers(1, 33, 50), 1), (np.array([160]), 1 + 7 * 8 / 10)):
        rows.clear()
        hmm.Pieces(model, rng.integers(0, 9, sizes.sum()), np.cumsum(sizes) - sizes, sizes)
        assert 0 < sum(rows) <= most * sizes.sum()


def test_messages_of_improbable_tokens_stay_in_range(monkeypatch):
    """Emissions of 1e-20, and states that hardly change: scaled often enough."""
    rng = np.random.default_rng(9)
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    model = hmm.Model(norm(rng.random(3), 0), norm(np.eye(3) + 1e-12, 1), rng.random((9, 3)) * 1e-20)
    sizes = np.array([300, 64, 65, 1, 129])
    symbols, begins = rng.integers(0, 9, sizes.sum()), np.cumsum(sizes) - sizes
    want = []
    for b, n in zip(begins, sizes, strict=True):
        a, log = model.start * model.emit[symbols[b]], 0.0
        for x in symbols[b + 1 : b + n]:
            log += math.log10(a.sum())
            a = a / a.sum() @ model.move * model.emit[x]
        want.append(log + math.log10(a.sum()))
    totals = np.zeros(3), np.zeros((3, 3)), np.zeros((9, 3))
    p = hmm.Pieces(model, symbols, begins, sizes)
    p.expect(totals)
    assert np.allclose(p.logs, want, rtol=1e-12) and np.allclose([x.sum() for x in totals], [5, (sizes - 1).sum(), sizes.sum()])


@pytest.mark.parametrize("most", [1, 3, 4, 6, 9, 100])
def test_common_words_come_in_order_of_count(spark, most):
    n = [1000, 1001, 1002, 90, 90, 7, 7, 7, 1, 1]
    rng = np.random.default_rng(2)
    h = rng.integers(-(2**63), 2**63 - 1, len(n))
    got_h, got_n = hmm.common_words(spark.createDataFrame(list(zip(h.tolist(), n, strict=True)), "h long, n long"), most)
    assert got_n.tolist() == sorted(n, reverse=True)[: len(got_n)] and len(got_n) >= min(most, len(n)) - 2
    assert all(dict(zip(h, n, strict=True))[a] == b for a, b in zip(got_h, got_n, strict=True))


def test_numbers_of_words_are_dense_and_in_order():
    rng = np.random.default_rng(3)
    numbers, have = hmm.Numbers(4), {}
    for size in (0, 1, 50, 400, 3):
        h = rng.integers(1, 300, size).astype(np.uint64)
        got, new = numbers.of(h)
        want = []
        for x in h.tolist():
            want.append(have.setdefault(x, len(have)))
        assert got.tolist() == want and len(set(h[new].tolist())) == len(new)
    assert numbers.size == len(have)


def test_language_model_of_words_that_all_occur_once(spark):
    d = spark.createDataFrame([(k, " ".join(f"v{k}x{j}" for j in range(50))) for k in range(20)], "doc_id long, text string")
    got = hmm.score(d, F.col("doc_id") > 17, states=2, rounds=2, emitted=100).collect()
    assert {(r.n_tokens, r.n_known, r.train_tokens) for r in got} == {(51, 51, 18 * 51), (51, 1, 18 * 51)}


def test_language_model_of_empty_tables(empty, docs):
    assert hmm.score(empty, held_out("doc_id", 7)).collect() == []
    got = hmm.score(docs, F.lit(True), states=2, rounds=1).collect()
    assert len(got) == docs.count() and all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in got)


# ---- shards ----


def test_store_keeps_every_row_and_column_through_compaction(spark, odd, tmp_path):
    store = sharding.Store(spark, f"file://{tmp_path}/s")
    first = store.append(odd.where("doc_id < 100"), rows=5)
    store.append(odd.where("doc_id >= 100 OR doc_id IS NULL"), rows=5)
    before = store.shards()
    last = store.compact(target=1 << 20, fan_in=2)
    assert len(store.shards()) < len(before) and all(s.bytes <= 1 << 20 for s in store.shards())
    want = Counter(map(str, odd.collect()))
    assert Counter(map(str, store.read(last).collect())) == want
    assert Counter(map(str, store.read(first).collect())) == Counter(map(str, odd.where("doc_id < 100").collect()))
    assert store.vacuum() > 0 and Counter(map(str, store.read().collect())) == want
    assert store.plan(1 << 20, 2) == []


def test_runs_of_a_round_are_files_of_their_own(spark, tmp_path):
    """Several runs merged by one job: each in its own file, within the target size."""
    store = sharding.Store(spark, f"file://{tmp_path}/s")
    store.append(spark.range(0, 4000, 1, 4).withColumn("x", F.sha2(F.col("id").cast("string"), 256)), rows=100)
    runs = store.plan(target=40_000, fan_in=3, base=1 << 10)
    assert len(runs) > 3
    version = store.compact(target=40_000, fan_in=3, base=1 << 10)
    shards = store.shards(version)
    assert 3 < len(shards) < 20 and all(s.bytes <= 45_000 for s in shards)
    assert sorted(r.id for r in store.read(version).collect()) == list(range(4000))


def test_store_commits_atomically(spark, docs, tmp_path):
    store = sharding.Store(spark, f"file://{tmp_path}/s")
    base = store.manifest()
    store.append(docs)
    with pytest.raises(sharding.Conflict):
        store._publish(base | {"version": 1})
    other = sharding.Store(spark, f"file://{tmp_path}/s")
    other.append(docs)
    assert store.versions() == [1, 2] and store.read().count() == 2 * docs.count()
    with pytest.raises(sharding.Conflict):
        store._commit_change({"data/none"}, [], None, False)


def test_racing_writers_lose_nothing(spark, docs, tmp_path, monkeypatch):
    """Writers that append and compact at once: every commit is there, under a number of its own."""
    from concurrent.futures import ThreadPoolExecutor

    monkeypatch.setattr(sharding, "LISTED", 3)
    folder = f"file://{tmp_path}/s"
    sharding.Store(spark, folder).append(docs.where("false"))

    def write(k):
        store = sharding.Store(spark, folder)
        for j in range(4):
            store.append(spark.createDataFrame([(100 * k + j,)], "x long").coalesce(1))

    sharding.Store(spark, folder).append(spark.createDataFrame([(-1,)], "x long"))
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(write, range(4)))
    store = sharding.Store(spark, folder)
    want = {-1, *(100 * k + j for k in range(4) for j in range(4))}
    assert {r.x for r in store.read().collect()} == want and store.versions() == list(range(1, 19))
    before = store.versions()[-1]
    assert store.compact(target=1 << 20, fan_in=2, base=64) > before and {r.x for r in store.read().collect()} == want
    assert {r.x for r in store.read(before).collect()} == want  # older versions stay readable until they are vacuumed
    assert store.vacuum() > 0 and {r.x for r in store.read().collect()} == want
    with pytest.raises(sharding.Conflict):
        store._publish({"version": store.versions()[-1], "lists": []})


def test_store_of_an_empty_table(spark, empty, tmp_path):
    store = sharding.Store(spark, f"file://{tmp_path}/s")
    store.append(empty)
    assert store.compact() >= 1 and store.read().collect() == []


# ---- chat ----

TOOLS = {"sum": {"a": ("integer", True), "b": ("number", False), "note": ("string", False)}}


def event(conv, turn, kind, call=None, name=None, args=None, dep=None, content=None, role="r"):
    return conv, turn, role, kind, call, name, args, dep, content


def test_calls_are_linked_ordered_and_validated(spark):
    rows = [
        event(1, 0, "message", content="héllo\n\"q\""),
        event(1, 1, "call", "a", "sum", '{"note": "x",  "a": 1}'),
        event(1, 2, "result", "a", content="2"), event(1, 3, "result", "a", content="again"),
        event(1, 4, "call", "b", "sum", '{"a": 1.5}', "a"), event(1, 5, "call", "c", "sum", '{"a": 2, "z": 1}', "b"),
        event(1, 6, "call", "a", "sum", '{"a": 9}'), event(1, 7, "result", "zz", content="?"),
        event(1, 8, "call", "d", "other", "{}", "nowhere"), event(1, 9, "call", "e", "sum", "not json"),
        event(2, 0, "call", "x", "sum", '{"a": 1}', "y"), event(2, 1, "call", "y", "sum", '{"a": 1}', "x"), event(2, 2, "call", "w", "sum", '{"a": 1}', "y"),
        event(None, 0, "call", "a", "sum", '{"a": 1}'), event(3, None, "call", None, None, None), event(3, 1, None),
    ]
    got = chat.format_events(spark.createDataFrame(rows, chat.EVENT).withColumn("level", F.lit("clash")).withColumn("found", F.lit(0)), TOOLS).collect()
    assert len(got) == len(rows)
    by = {(r.conv_id, r.turn): r for r in got}
    pick = lambda c, t: (by[c, t].n_links, by[c, t].level, by[c, t].position, by[c, t].errors)
    assert pick(1, 1) == (2, 0, 0, "") and pick(1, 2) == (1, 0, 1, "") and pick(1, 3) == (1, 0, 1, "")
    assert pick(1, 4) == (0, 1, 2, "type:a") and pick(1, 5) == (0, 2, 4, "unknown_argument")
    assert pick(1, 6) == (0, None, None, "duplicate_id") and pick(1, 7) == (0, None, None, "no_call")
    assert pick(1, 8) == (0, 0, 0, "no_dependency,unknown_tool") and pick(1, 9) == (0, 0, 0, "not_an_object")
    assert all(by[2, t].errors == "cycle" and by[2, t].level is None for t in range(3))
    assert by[1, 1].json == '{"arguments":{"a":1,"note":"x"},"call_id":"a","conv_id":1,"kind":"call","level":0,"name":"sum","role":"r","turn":1}'
    assert json.loads(by[1, 0].json)["content"] == "héllo\n\"q\""


def test_arguments_keep_to_their_limits(spark):
    tools = {"t": {"s": ("string", True, {"max_length": 3, "among": ["a", "bb", "long"]}), "n": ("number", False, {"minimum": 0, "maximum": 2.5}), "i": ("integer", False, {"maximum": 9})}}
    cases = {'{"s": "a"}': "", '{"s": "c"}': "limit:s", '{"s": "long"}': "limit:s", '{"s": "bb", "n": 2.5, "i": 9}': "", '{"s": "bb", "n": -0.1, "i": 10}': "limit:i,limit:n", '{"s": 1, "n": "x"}': "type:n,type:s"}
    rows = [event(1, k, "call", f"c{k}", "t", args) for k, args in enumerate(cases)]
    got = {r.turn: r.errors for r in chat.format_events(spark.createDataFrame(rows, chat.EVENT), tools).collect()}
    assert [got[k] for k in range(len(cases))] == [*cases.values()]


def test_links_are_hash_joins(spark):
    """No sort-merge join in the plan that links calls and results."""
    rows = [event(1, 0, "call", "a", "sum", '{"a": 1}'), event(1, 1, "result", "a", content="1")]
    plan = chat.format_events(spark.createDataFrame(rows, chat.EVENT), TOOLS)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_long_chains_and_hot_identifiers(spark):
    rows = [event(1, k, "call", f"c{k}", "sum", '{"a": 1}', f"c{k - 1}" if k else None) for k in range(70)]
    rows += [event(1, 100 + k, "result", "c0") for k in range(200)]
    got = chat.format_events(spark.createDataFrame(rows, chat.EVENT), TOOLS).collect()
    assert sorted(r.level for r in got if r.kind == "call") == list(range(70))
    assert next(r.n_links for r in got if r.turn == 0) == 200


def test_chat_of_empty_and_odd_conversations(spark):
    kinds = "conv_id long, turn long, role string, text string, call_id string"
    assert chat.format_events(chat.events_of_turns(spark.createDataFrame([], kinds)), chat.REPLY_TOOLS).collect() == []
    rows = [(1, 0, "user", None, "z"), (1, 1, "assistant", "", "z"), (1, 1, "assistant", "", "z"), (None, 2, "user", "x", None), (1, 3, None, "y", None)]
    got = chat.format_events(chat.events_of_turns(spark.createDataFrame(rows, kinds)), chat.REPLY_TOOLS).collect()
    assert len(got) == 5 and {r.errors for r in got if r.turn == 0} == {"missing:prompt"}


# ---- components ----


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7)]
    got = {r.u: r.c for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100 + k: 100 for k in range(30)}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


# ---- pipeline ----


def test_pipeline_without_languages_keeps_what_has_a_letter(spark, docs):
    import corpus_pipeline as p

    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    got = p.identify_language(spark, bare, "").collect()
    want = Counter(r.doc_id for r in bare.collect() if r.doc_id not in (3, 4, 5))
    assert Counter(r.doc_id for r in got) == want and want and {r.lang for r in got} == {None}


def test_pipeline_stages_take_effect_and_keep_the_rest(spark, odd, tmp_path):
    import corpus_pipeline as p

    leak = "benchmark words that nobody else would write in this order ever again today"
    clean = "a clean document that says something of its own without any repetition"
    more = spark.createDataFrame([(900, leak + " tail", None, "s", 1), (901, clean, None, None, 1)], "doc_id long, text string, lang string, source string, n_chars long")
    odd.select(*p.COLUMNS).unionByName(more).withColumn("extra", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in p.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == list(p.COLUMNS)
        seen.append(Counter(r.doc_id for r in docs.select("doc_id").collect()))
    language_, near_, cut, left = seen
    assert not {3, 4, 5} & set(language_) and language_[1] == 2
    assert sum(near_[k] for k in (0, 1, 2)) == 1 and sum(near_[k] for k in (9, 10)) == 1
    assert 6 in cut and 7 in cut and 900 in cut and 900 not in left and 901 in left
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert texts[901] == clean and "p" not in {w[0] for w in texts[7].split()}
    packed = {r.doc_id for r in p.run(spark, str(tmp_path)).collect()}
    assert packed == set(left)
