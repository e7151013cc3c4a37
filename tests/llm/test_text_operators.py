"""Each operator against a plain version of itself on documents with every hard case."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import decontaminate, language, licenses, media, near, packing, substrings
from weftline.llm.common import held_out


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def multiset(rows):
    return Counter(map(tuple, rows))


# ---- media ----


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_media_reads_back_what_was_stored(request, rows, which):
    got = multiset((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in media.read(media.store(request.getfixturevalue(which))).collect())
    want = []
    for doc, text, *_ in rows:
        raw = (text or "").encode()
        full = raw + bytes(-len(raw) % 64) or bytes(64)
        want.append((doc, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:])))
    assert got == multiset(want)


def test_media_of_an_empty_table(empty):
    assert media.read(media.store(empty)).collect() == []


def test_jpeg_thumbnails_of_many_rows_and_long_payloads():
    rng = np.random.default_rng(1)
    for rows in ([1], [3, 1, 130], [media.MOST_ROWS + 5, 2]):
        payload = rng.integers(0, 256, sum(rows) * media.ROW, dtype=np.uint8)
        data, sizes = media.encode(payload, np.array(rows))
        ends = np.cumsum(sizes)
        thumbs = media.thumbnails(data, ends - sizes, ends)
        assert np.concatenate([t.ravel() for _, t in thumbs]).tolist() == payload.tolist()
        assert [len(f) for f, _ in thumbs] == [-(-r // media.MOST_ROWS) for r in rows]


def test_jpeg_with_chroma_and_ac_coefficients():
    """A hand-made 4:2:0 file without restarts: DC codes, a run of AC codes and several components."""
    dc = bytes([0] * 3 + [12] + [0] * 12) + bytes(range(12))
    ac = bytes([0, 0, 0, 4] + [0] * 12) + bytes([0x00, 0x01, 0x12, 0xF0])
    bits, value = "", {}

    def dc_bits(diff):
        size = int(diff).bit_length() if diff >= 0 else int(-diff).bit_length()
        return f"{size:04b}" + (f"{diff if diff > 0 else diff + (1 << size) - 1:0{size}b}" if size else "")

    last = [0, 0, 0]
    lum = [[5, -7, 100, -100], [3, 3, 0, 1]]
    for m in range(2):
        for c, blocks in ((0, lum[m]), (1, [m]), (2, [-m])):
            for v in blocks:
                bits += dc_bits(v - last[c])
                last[c] = v
                if c == 0:
                    bits += "0001" + "1" + "0010" + "01"  # run 0 size 1, run 1 size 2
                bits += "0000"
    bits += "1" * (-len(bits) % 8)
    scan = b"".join(bytes([int(bits[i : i + 8], 2)]) + (b"\0" if bits[i : i + 8] == "11111111" else b"") for i in range(0, len(bits), 8))
    seg = media._segment
    comp = bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    raw = b"\xff\xd8" + seg(0xDB, bytes([0, 16] + [1] * 63)) + seg(0xC0, bytes([8, 0, 16, 0, 32, 3]) + comp) + seg(0xC4, b"\0" + dc) + seg(0xC4, b"\x10" + ac) + seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    (_, thumb), = media.thumbnails(np.frombuffer(raw, np.uint8), [0], [len(raw)])
    want = np.array([[5, -7, 3, 3], [100, -100, 0, 1]])
    assert thumb.tolist() == np.clip(want * 2 + 128, 0, 255).tolist()
    del value
    with pytest.raises(ValueError):
        media.thumbnails(np.frombuffer(raw.replace(b"\xff\xc0", b"\xff\xc2"), np.uint8), [0], [len(raw)])


# ---- language ----


def test_language_spans_und_and_neutral_words(spark, docs, odd):
    model = language.learn(docs)
    got = language.identify(odd, model).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    for doc in (3, 4):
        assert (by[doc].lang_pred, by[doc].score) == ("und", 0.0)
    assert by[5].lang_pred == "und" and by[9].lang_pred in ("en", "fr")
    assert all(0 <= r.score <= 1 for r in got)


def test_language_finds_the_switch(spark):
    a = [(k, "lorem ipsum dolor amet quantum nocturna " * 5, "la") for k in range(5)]
    b = [(10 + k, "knock which through thick wharf yellow " * 5, "en") for k in range(5)]
    model = language.learn(spark.createDataFrame(a + b, "doc_id long, text string, lang string"))
    mixed = spark.createDataFrame([(1, "lorem dolor quantum nocturna amet which yellow knock through wharf thick", "x"), (2, "привет мир", None)], "doc_id long, text string, lang string")
    one, two = sorted(language.identify(mixed, model).collect(), key=lambda r: r.doc_id)
    assert one.spans == "la@0 en@5" and one.n_spans == 2
    assert two.lang_pred in ("la", "en") and two.score == 0


def test_language_of_scripts_that_are_not_listed(spark):
    ta, te, km = "வணக்கம் உலகம் எப்படி இருக்கிறீர்கள் நன்றி", "నమస్కారం ప్రపంచం మీరు ఎలా ఉన్నారు ధన్యవాదాలు", "សួស្តី ពិភពលោក អរគុណ ច្រើន"
    taught = [(k, text, lang) for k, (lang, text) in enumerate([("en", "hello world how are you thanks"), ("ta", ta), ("te", te), ("km", km)] * 3)]
    model = language.learn(spark.createDataFrame(taught, "doc_id long, text string, lang string"))
    asked = [(1, "உலகம் நன்றி"), (2, "ప్రపంచం ధన్యవాదాలు"), (3, "អរគុណ ពិភពលោក"), (4, "thanks world"), (5, "thanks world you are உலகம் வணக்கம் நன்றி")]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    assert [got[k].lang_pred for k in range(1, 5)] == ["ta", "te", "km", "en"] and got[1].score == got[3].score == 1
    assert got[5].spans == "en@0 ta@4"


def test_every_letter_is_of_a_script():
    import unicodedata

    known = lambda c: any(a <= c <= b for ranges in language.SCRIPTS.values() for a, b in ranges)
    for c in [*range(0x80, 0xD800, 7), *range(0xE000, 0x40000, 31)]:
        b = chr(c).encode()
        if unicodedata.category(chr(c))[0] == "L" and not known(c):
            assert language._SCRIPT[b[0] * 256 + b[1]], hex(c)


@pytest.mark.parametrize("cells", [1 << 21, 50])
def test_language_paths_equal_a_plain_viterbi(cells):
    rng = np.random.default_rng(3)
    scores = rng.normal(0, 3, (400, 3))
    begins, counts = np.array([0, 150, 390]), np.array([150, 240, 10])
    got = np.zeros(400, np.int32)
    language._paths(lambda which: scores[which], begins, counts, 5.0, got, cells)
    for b, n in zip(begins, counts, strict=True):
        v, back = scores[b].copy(), []
        for t in range(1, n):
            best = v.argmax()
            stay = v >= v[best] - 5.0
            back.append(np.where(stay, np.arange(3), best))
            v = np.where(stay, v, v[best] - 5.0) + scores[b + t]
        path = [int(v.argmax())]
        for choice in reversed(back):
            path.append(int(choice[path[-1]]))
        assert got[b : b + n].tolist() == path[::-1]


def plain_labels(scores, penalty):
    """Viterbi by the book, each step over all pairs of labels; ties stay, then go to the first."""
    k = scores.shape[1]
    v, back = scores[0].copy(), []
    for s in scores[1:]:
        choice = [max(range(k), key=lambda j: (v[j] - penalty * (j != i), j == i, -j)) for i in range(k)]
        back.append(choice)
        v = np.array([v[j] - penalty * (j != i) for i, j in enumerate(choice)]) + s
    path = [int(v.argmax())]
    for choice in reversed(back):
        path.append(choice[path[-1]])
    return path[::-1]


def test_labels_of_words_equal_brute_force_in_any_blocks():
    """The proof that a text is of one language agrees with the recursion over all labels."""
    import pyarrow as pa

    rng = np.random.default_rng(12)
    k = 11
    logp = rng.integers(0, 40, (k, language.BUCKETS)) ** 2
    model = language.Model([f"l{x}" for x in range(k)], logp, np.ones((k, len(language._NAMES)), int))
    texts = [" ".join("".join(rng.choice(list("abcdeé"), rng.integers(1, 5))) for _ in range(n)) for n in (1, 0, 30, 7, 60)] + ["aa bb cc " * 20]
    (c,) = language.chunks(pa.array(texts))
    f = language.Features(c)
    scores, _ = language._word_scores(f, model, slice(0, len(f.size)))
    for penalty in (0.5, 3.0, 12.0):
        want = [x for a, b in zip(f.words.row_from, f.words.row_to, strict=True) if b > a for x in plain_labels(scores[a:b], penalty)]
        for cells in (1 << 21, 100, 1):
            got, _ = language.label_words(f, model, penalty, cells)
            assert len(set(got.tolist())) > 1 and got.tolist() == want


def test_more_than_512_languages(spark):
    rng = np.random.default_rng(2)
    stem = {k: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 9)) for k in range(520)}
    taught = spark.createDataFrame([(k, " ".join([w, w + w[:3], w[::-1]]), f"x{k:03d}") for k, w in stem.items()], "doc_id long, text string, lang string")
    model = language.learn(taught)
    assert len(model.languages) == 520
    got = language.identify(taught.select("doc_id", "text"), model).collect()
    assert sum(r.lang_pred == f"x{r.doc_id:03d}" for r in got) >= 515


def test_language_learns_nothing_from_nothing(empty, docs):
    model = language.learn(empty)
    assert {r.lang_pred for r in language.identify(docs, model).collect()} == {"und"}
    assert language.identify(empty, model).collect() == []


def test_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = d.select("doc_id", "text", "lang", held_out("doc_id", 4).alias("held_out"))
    got = language.identify(rows, language.learn_from_split(d), keep=("held_out", "lang")).where("held_out").collect()
    assert len(got) > 20 and sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)


# ---- near duplicates ----


def shingles(text, n=5):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
    return None if not w else {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def brute_classes(rows):
    sets = [shingles(r[1]) for r in rows]
    n = len(rows)
    link = [[i != j and sets[i] is not None and sets[j] is not None and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in range(n)] for i in range(n)]
    root = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in range(n):
                if link[i][j]:
                    root[i] = root[j] = min(root[i], root[j])
    ids = defaultdict(list)
    for i, r in enumerate(rows):
        ids[root[i]].append(r[0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return multiset((rows[i][0], least[root[i]], sum(link[i])) for i in range(n))


@pytest.mark.parametrize("block", [256, 2])
def test_near_classes_equal_brute_force(odd, rows, block, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", block)
    got = multiset((r.id, r.class_id, r.n_links) for r in near.jaccard_classes(odd).collect())
    assert got == brute_classes(rows)


def test_near_keeps_a_tie_in_a_cluster_of_three(spark):
    """36 of 45 is 0.8 exactly, whether or not a third text shares a band."""
    w = [f"t{k}" for k in range(44)]
    texts = [w, w[:40] + [f"u{k}" for k in range(5)], [*w, "more"]]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    got = multiset((r.id, r.class_id, r.n_links) for r in near.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == multiset([(0, 0, 2), (1, 0, 1), (2, 0, 1)]) == brute_classes(rows)


def test_ties_are_links_at_any_size():
    for k in range(1, 200):
        sets = [np.arange(5 * k), np.arange(4 * k), np.arange(10**6, 10**6 + k)]
        nodes, links, _ = near._links(np.arange(3), np.ones(3, np.int64), sets, 0, 0.8)
        assert nodes.tolist() == [0, 1] and links.tolist() == [1, 1], k


def test_near_of_an_empty_table(empty):
    assert near.jaccard_classes(empty).collect() == []


def test_banding_reaches_its_recall():
    bands, rows = near.banding(0.8, 0.9999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= 128


# ---- substrings ----


def brute_removed(rows, window=35):
    all_words = [plain_words(r[1]) for r in rows]
    count = Counter(tuple(w[i : i + window]) for w in all_words for i in range(len(w) - window + 1))
    out = []
    for r, w in zip(rows, all_words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((r[0], len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return multiset(out)


@pytest.mark.parametrize(("least", "most"), [(20, 29), (4, 29), (20, 3)])
def test_substrings_equal_brute_force(odd, rows, least, most, monkeypatch):
    """Also with a small sketch, which lets much through, and with repeated seeds as a table."""
    monkeypatch.setattr(substrings, "LEAST_BITS", least)
    monkeypatch.setattr(substrings, "BYTES_A_CELL", 8 if least > 4 else 1 << 20)
    got = multiset((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(odd, most_bits=most).collect())
    assert got == brute_removed(rows)


def thue_morse(n, a, b):
    out = [a]
    while len(out) < n:
        out += [b if x == a else a for x in out]
    return out[:n]


def test_words_and_texts_of_regular_sequences_are_told_apart(spark):
    """Sums modulo 2**64 give these words, and these texts, equal hashes."""
    one, two = "".join(thue_morse(4096, "a", "b")), "".join(thue_morse(4096, "b", "a"))
    shared = [f"w{k}" for k in range(34)]
    texts = [" ".join([*shared[:17], x, *shared[17:]]) for x in (one, two)] + [" ".join(thue_morse(4096, *x)) for x in (("p", "q"), ("q", "p"))]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = list(enumerate(texts))
    assert multiset((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(d).collect()) == brute_removed(rows)
    assert multiset((r.id, r.class_id, r.n_links) for r in near.jaccard_classes(d).collect()) == brute_classes(rows)
    assert {(r.doc_id, r.n_removed) for r in substrings.remove_repeats(d).collect()} >= {(0, 0), (1, 0)}


def test_word_hashes_tell_all_words_apart():
    import pyarrow as pa

    from weftline.llm import textkit

    rng = np.random.default_rng(4)
    words = {"".join(rng.choice(list("ab0é"), n)) for n in [*range(1, 80), 200, 1000] for _ in range(40)}
    words |= {"".join(thue_morse(2**k, *x)) for k in range(13) for x in ("ab", "ba")}
    words = sorted(words)
    (c,) = textkit.chunks(pa.array([" ".join(words)]))
    w = textkit.find_words(c, c.data, textkit.ASCII_SPACE)
    both = [textkit.word_hashes(c.data, w, k) for k in (0, 1)]
    assert len(set(both[0].tolist())) == len(words) == len(set(both[1].tolist())) and not set(both[0].tolist()) & set(both[1].tolist())
    again = textkit.word_hashes(c.data[w.begin[5] :], textkit.Words(w.begin[5:] - w.begin[5], w.end[5:] - w.begin[5], None, None))
    assert again.tolist() == both[0][5:].tolist()  # a word's place does not matter
    for n in (1, 2, 5, 35):
        grams = textkit.gram_hashes(both[0], n)
        assert len(grams) == len(words) - n + 1 and textkit.gram_hashes(both[0][3 : 3 + n], n)[0] == grams[3]


def test_substrings_with_periodic_text_and_kept_white_space(spark):
    rng = np.random.default_rng(5)
    free = " ".join(f"f{k}" for k in rng.integers(0, 10**6, 50))
    texts = ["ab " * 80, "one\n two\t" + free, "x y " * 30 + free[:40], None]
    rows = [(k, t) for k, t in enumerate(texts)]
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), keep_text=True).collect()
    assert multiset((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_removed(rows)
    assert {r.doc_id: r.kept_text for r in got}[1] == texts[1]


def test_substrings_of_an_empty_table(empty):
    assert substrings.remove_repeats(empty).collect() == []


# ---- licences ----


def test_licence_places_equal_brute_force(spark, odd):
    extra = [(500, "MIT License, mit license! the APACHE  license; GNU General Public License general public\nlicense", None, None, 0), (501, "Licensed under CC BY-NC 4.0.", None, None, 0), (502, "mit", None, None, 0)]
    notice = "x " * 40 + licenses.TEMPLATES["mit"][0].replace("free of charge,", "free of any charge,") + " y"
    extra.append((503, notice, None, None, 0))
    base = odd.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long"))
    got = licenses.scan(base).collect()
    want = []
    for r in base.collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        at = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        want.append((r.doc_id, len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))))
    assert multiset((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == multiset(want)
    by = {r.doc_id: r for r in got}
    assert by[501].labels == "cc-by-nc" and by[502].labels == "" and by[3].score == 0
    assert by[503].labels == "mit" and by[503].base_labels == "" and 0.85 <= by[503].score < 1


def test_repeats_of_a_part_of_a_licence_do_not_add_up(spark):
    line = "GNU Lesser General Public License"
    texts = ["General Public License " * 2, "General Public License " * 50, f"{line} " * 3, "GNU Lesser truly General Public License", ""]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[k].labels for k in range(5)] == ["gpl", "gpl", "gpl,lgpl", "gpl", ""]
    assert [(s.start, s.end, s.covered) for s in got[2].spans if s.label == "lgpl"] == [(0, 5, 1.0), (5, 10, 1.0), (10, 15, 1.0)]
    assert got[0].n_base == 2 and got[1].n_base == 50 and got[4].score == 0
    few = licenses.scan(spark.createDataFrame([(1, texts[1])], "doc_id long, text string"), base={})
    assert [(r.labels, r.score) for r in few.collect()] == [("", 0.5)]


def test_alignments_equal_brute_force():
    rng = np.random.default_rng(8)
    for _ in range(60):
        hits = {(int(p), int(q)) for p, q in zip(rng.integers(0, 14, 14), rng.integers(0, 6, 14), strict=True)}
        best: dict = {}
        for p, q in sorted(hits):
            best[p, q] = 1 + max((n for (a, b), n in best.items() if a < p and b < q and abs(p - q - a + b) <= licenses.NEAR), default=0)
        spans = licenses.align(list(hits))
        assert spans[0][0] == max(best.values())
        places = sorted((a, b) for _, a, b in spans)
        assert all(x[1] < y[0] for x, y in zip(places, places[1:], strict=False))


def test_licences_of_an_empty_table(empty):
    assert licenses.scan(empty).collect() == []


# ---- decontamination ----


def brute_distance(item, text):
    """Least edit distance of the words to a part of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_contamination_equals_brute_force(spark, rows, odd):
    rng = np.random.default_rng(2)
    base = next(r[1] for r in rows if r[0] == 6).split()
    items = [(1, " ".join(base[20:50])), (2, " ".join(base[60:70] + ["inserted"] + base[70:85])), (3, None), (4, "too short"), (5, " ".join(base[5:25]).upper()), (5, " ".join(base[5:25])), (6, " ".join(f"q{k}" for k in rng.integers(0, 99, 20))), (7, " ".join(base[90:100] + base[103:118]))]
    got = decontaminate.contaminated(odd, spark.createDataFrame(items, "item_id long, text string"), block_words=40).collect()
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    want = []
    for r in rows:
        for item, text in items:
            m = split(text)
            if m and len(split(r[1])) < 10_000:
                d = brute_distance(m, split(r[1]))
                if d <= int(len(m) * decontaminate.ERROR_RATE):
                    want.append((r[0], item, d))
    assert multiset((r.doc_id, r.item_id, r.distance) for r in got) == multiset(want) and len(want) >= 5
    kept = decontaminate.clean(odd, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == odd.columns
    hit = {w[0] for w in want}
    assert multiset((r.doc_id,) for r in kept.collect()) == multiset((r[0],) for r in rows if r[0] not in hit)


def test_contamination_of_every_size_of_item(spark):
    """Items of one to thirty words stand word for word in a document; none is too short to be found."""
    words = [f"w{k}" for k in range(200)]
    items = [(n, " ".join(words[100 - n : 100])) for n in range(1, 31)]
    d = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:90])), (3, "")], "doc_id long, text string").withColumn("LOWERED_TEXT", F.lit("x"))
    i = spark.createDataFrame(items, "item_id long, text string")
    for most in (10**6, 100):
        got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, i, block_words=most).collect() if not r.distance}
        assert got == {(1, n) for n in range(1, 31)} | {(2, n) for n in ()}
        kept = decontaminate.clean(d, i, block_words=most).collect()
        assert [(r.doc_id, r.LOWERED_TEXT) for r in kept] == [(2, "x"), (3, "x")]


def test_contamination_of_short_items_and_scripts_without_spaces(spark):
    long = "水は摂氏何度で沸騰しますかという問題に答えてください。次の四つの中から正しいものを一つ選びなさい"
    thai = "เมืองหลวงของประเทศไทยคือเมืองใด"
    items = [(1, "Who wrote Faust?"), (2, "法国的首都是哪里"), (3, long), (4, thai), (5, "?!"), (6, "𠀋𠮟𠀋")]
    texts = ["He asked: who wrote Faust? Nobody knew", "who then wrote faust", "问题：法国的首都是哪里？", "首都是法国的哪里", "前文" + long.replace("四つ", "五つ") + "後", "abc" + thai + "def", "的", "x𠀋𠮟𠀋", "who", None]
    d, i = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.distance) for r in decontaminate.contaminated(d, i).collect()}
    assert got == {(0, 1, 0), (2, 2, 0), (4, 3, 1), (5, 4, 0), (7, 6, 0)}
    assert sorted(r.doc_id for r in decontaminate.clean(d, i).collect()) == [1, 3, 6, 8, 9]


def test_words_and_single_characters():
    import pyarrow as pa

    from weftline.llm.textkit import chunks

    texts = ["a水 b", "水", None, "straße水水x", "", "𠀋y", "สวัส"]
    (c,) = chunks(pa.array(texts))
    w = decontaminate.words_of(c)
    got = [[c.data[w.begin[k] : w.end[k]].tobytes().decode() for k in range(a, b)] for a, b in zip(w.row_from, w.row_to, strict=True)]
    assert got == [["a", "水", "b"], ["水"], [], ["straße", "水", "水", "x"], [], ["𠀋", "y"], list("สวัส")]


def test_contamination_with_nothing(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(docs, none).collect() == []
    assert decontaminate.contaminated(empty, none).collect() == []


def test_myers_equals_the_plain_distance():
    rng = np.random.default_rng(9)
    for _ in range(200):
        item, text = rng.integers(0, 4, rng.integers(1, 90)).tolist(), rng.integers(0, 4, rng.integers(0, 40)).tolist()
        bits = {}
        for i, s in enumerate(item):
            bits[s] = bits.get(s, 0) | 1 << i
        assert decontaminate.myers(bits, len(item), text)[0] == brute_distance(item, text)


# ---- packing ----


@pytest.mark.parametrize("window", [4096, 64])
def test_packing_is_whole_gapless_and_unpadded(odd, rows, window):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    got = packing.pack(odd, window=window).collect()
    ids = [np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4") for r in rows]
    want = defaultdict(list)
    for r, x in zip(rows, ids, strict=True):
        want[r[0]].append(x)
    assert Counter(p.doc_id for p in got if p.start == 0) == {k: len(v) for k, v in want.items()}
    for p in got:
        assert any(len(x) == p.doc_tokens and zlib.crc32(x[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for x in want[p.doc_id])
    assert sum(p.length for p in got) == sum(map(len, ids))
    sequences = defaultdict(list)
    for p in got:
        sequences[p.sequence_id].append((p.offset, p.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window and not at & (at - 1)


def test_packing_of_an_empty_table(empty):
    assert packing.pack(empty).collect() == []


def test_repeat_counts_are_feasible_and_use_the_histogram_up():
    h = np.zeros(64, np.int64)
    h[[10, 20, 24, 40, 44, 54]] = [90, 30, 20, 30, 20, 10]
    fills = packing.enumerate_fills(h, 64)
    assert all(sum(f) == 64 for f in fills) and (24, 40) in fills and (10, 10, 44) in fills
    n = packing.repeat_counts(h, fills)
    used = np.zeros(64, np.int64)
    for f, k in zip(fills, n, strict=True):
        for x in f:
            used[x] += k
    # (10, 54) ten times, (24, 40) twenty times and (20, 44) or (10, 10, 44) twenty times is the most that can fit
    assert (used <= h).all() and (used * np.arange(64)).sum() == 50 * 64


def test_vocabulary_compares_texts_not_only_hashes(monkeypatch):
    """Even if all hashes are equal, ids are those of the tokenizer."""
    import pyarrow as pa

    from weftline.llm.textkit import chunks

    texts = ["one two one", "three four", "thirteen-letter thirteen-letters Thirteen", None, "one", "".join(thue_morse(2048, "a", "b")) + " " + "".join(thue_morse(2048, "b", "a"))]
    for bits in (0, 1, 64):
        real = packing.word_hashes
        monkeypatch.setattr(packing, "word_hashes", lambda *a, b=bits, f=real: f(*a) & np.uint64((1 << b) - 1))
        v = packing.Vocabulary(packing.tokenizer_path(), 2)
        for _ in range(2):
            for c in chunks(pa.array(texts)):
                flat, sizes = v.encode(c)
                want = [[*v.tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
                assert flat.tolist() == sum(want, []) and sizes.tolist() == [len(w) for w in want]
        monkeypatch.setattr(packing, "word_hashes", real)


def test_vocabulary_survives_being_emptied(monkeypatch):
    import pyarrow as pa

    from weftline.llm.textkit import chunks

    monkeypatch.setattr(packing, "_CACHE_BITS", 9)
    v = packing.Vocabulary(packing.tokenizer_path(), 2)
    for k in range(6):
        text = " ".join(f"word{k}x{j}" for j in range(60))
        (chunk,) = chunks(pa.array([text]))
        flat, sizes = v.encode(chunk)
        assert flat.tolist() == [*v.tokenizer.encode(text, add_special_tokens=False).ids, 2] and sizes.tolist() == [len(flat)]
