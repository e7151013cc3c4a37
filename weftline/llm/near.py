"""N-gram Jaccard join: MinHash banding, then exact verification on full n-gram sets.

Texts are compared by the sets of their runs of five words (lower case, ASCII letters and
digits and all other scripts' characters; a shorter text is one run). The number of bands
and the rows of a band are the fewest hashes that reach the target recall at the threshold.

1. Each text's words give a hash of 128 bits; equal ones are copies and become one node.
2. Nodes are shuffled on their band hashes. Of each bucket only the edges to its least
   node are kept, and connected components of these are the candidate clusters: no pair
   within a bucket is lost, and none is written out.
3. Every pair within a cluster is verified on its n-gram sets. A cluster larger than a
   block is cut into blocks and each pair of blocks goes to a task of its own; a task gives
   one row a node (its number of links, one linked node), not one a pair.
4. Connected components of verified links are the classes.

Defined results: one row a document row. Texts without words are linked to nothing; the
class of a document is the least id in it (null only if all are); n_links counts all other
documents with a similarity of at least the threshold, copies included. Repeated rows are
copies of each other; other columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NEAR_DUPLICATE_SIMILARITY, NEAR_DUPLICATE_WORDS, lists, mapped, row_key, table, written
from .graph import components
from .textkit import ALNUM_SEP, chunks, find_words, gram_hashes, mix, row_hashes, signed, word_hashes

RECALL = 0.9999
#: Nodes of a block: a task verifies two blocks against each other.
BLOCK = 256
#: Rows of one class are dealt over this many tasks where they meet the class's id.
SALTS = 16


def banding(similarity: float, recall: float, most_rows: int = 16) -> tuple[int, int]:
    """(bands, rows): the longest bands for which ``recall`` of pairs at the similarity share one, within 128 hashes."""
    best = (1, 1)
    for rows in range(1, most_rows + 1):
        p = similarity**rows
        bands = 1 if p >= recall else math.ceil(math.log1p(-recall) / math.log1p(-p))
        if bands * rows <= 128:
            best = (bands, rows)
    return best


def _grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """N-grams of one text's words."""
    if len(hashes) >= n:
        return gram_hashes(hashes, n)
    return mix(gram_hashes(hashes, len(hashes)) + np.uint64(len(hashes))) if len(hashes) else hashes


def signatures(rows: DataFrame, words: int, bands: int, per_band: int) -> DataFrame:
    """id, key, n_words, s1, s2 (hash of all words), bands. rows: id, key, text."""
    factors = mix(np.arange(1, bands * per_band + 1, dtype=np.uint64)) | np.uint64(1)
    offsets = mix(np.arange(1, bands * per_band + 1, dtype=np.uint64) + np.uint64(1 << 32))

    def run(batch):
        for c in chunks(batch.column(2), 1 << 18):
            w = find_words(c, c.data, ALNUM_SEP)
            h, other = word_hashes(c.data, w), word_hashes(c.data, w, 1)
            some = np.flatnonzero(w.count)
            cut = slice(c.first, c.first + c.rows)
            s1, s2 = (row_hashes(x, w, k) for k, x in enumerate((h, other)))
            sizes = np.maximum(w.count[some] - words + 1, 1)
            parts = gram_hashes(h, words)
            if (w.count[some] < words).any() or not len(parts):
                flat = np.concatenate([_grams(h[a:b], words) for a, b in zip(w.row_from[some], w.row_to[some], strict=True)] or [h])
            else:
                at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(w.row_from[some], sizes)
                flat = parts[at]
            begin = np.cumsum(sizes) - sizes
            least = np.empty((len(some), bands * per_band), np.uint64)
            for k in range(bands * per_band if len(some) else 0):
                least[:, k] = np.minimum.reduceat(flat * factors[k] + offsets[k], begin)
            band = np.zeros((len(some), bands), np.uint64)
            for k in range(per_band):
                band = mix(band + least[:, k::per_band])
            band = mix(band + np.arange(1, bands + 1, dtype=np.uint64))
            yield {"id": batch.column(0)[cut], "key": batch.column(1)[cut], "n_words": w.count, "s1": signed(s1), "s2": signed(s2), "bands": lists(signed(band.ravel()), np.where(w.count > 0, bands, 0), pa.int64())}

    return mapped(rows, run, "id long, key long, n_words long, s1 long, s2 long, bands array<long>")


def clusters(nodes: DataFrame) -> DataFrame:
    """node, cluster, blocks: nodes that share a band with another, by the component of such sharing."""
    each = nodes.select("node", F.explode("bands").alias("band"))
    least = each.groupBy("band").agg(F.min("node").alias("v"), F.count("*").alias("n")).where("n > 1").select("band", "v")
    found = written(components(each.join(least, "band").select(F.col("node").alias("u"), "v").where("u <> v")), "clusters")
    sizes = found.groupBy("c").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    return found.join(sizes, "c").select(F.col("u").alias("node"), F.col("c").alias("cluster"), "blocks")


def _overlaps(sets: list[np.ndarray], split: int) -> np.ndarray:
    """Sizes of the intersections of sets before ``split`` (rows) with those from there (all with all if split is 0)."""
    left, right = (sets[:split], sets[split:]) if split else (sets, sets)
    if len(left) * len(right) <= 4:
        return np.array([[len(np.intersect1d(a, b, assume_unique=True)) for b in right] for a in left])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, code, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = n > 1
    number = np.cumsum(shared) - 1
    keep = shared[code]
    owner, code = owner[keep], number[code[keep]]
    out = np.zeros((len(left), len(right)), np.int64)
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    for first in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(code, (first, first + 4096))
        has = np.zeros((len(sets), 4096), np.float32)
        has[owner[a:b], code[a:b] - first] = 1
        out += ((has[:split] if split else has) @ (has[split:] if split else has).T).astype(np.int64)  # 4096 at most: exact
    return out


def _links(nodes: np.ndarray, copies: np.ndarray, sets: list[np.ndarray], split: int, similarity: float):
    """(node, links, root) of nodes with a link; root: the least node reached by the links found here."""
    sizes = np.array([len(s) for s in sets])
    both = _overlaps(sets, split)
    rows, cols = (np.arange(split), np.arange(split, len(sets))) if split else (np.arange(len(sets)),) * 2
    # a/b >= similarity in whole numbers, to a billionth
    total = sizes[rows][:, None] + sizes[cols][None, :] - both
    near = both * 1_000_000_000 >= round(similarity * 1_000_000_000) * total
    if not split:
        np.fill_diagonal(near, False)
    links = np.zeros(len(sets), np.int64)
    np.add.at(links, rows, near @ copies[cols])
    if split:
        np.add.at(links, cols, near.T @ copies[rows])
    root = nodes.copy()
    a, b = np.nonzero(near)
    a, b = rows[a], cols[b]
    while True:
        before = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        if (root == before).all():
            break
    some = links > 0
    return nodes[some], links[some], root[some]


def verify(members: DataFrame, words: int, similarity: float) -> DataFrame:
    """node, links, root for each block pair. members: cluster, b1, b2, side, node, copies, text."""
    names = ["node", "links", "root"]

    def run(batches):
        held: dict = {}  # node: (side, copies, set)
        now, out, size = None, [], 0

        def finish():
            if len(held) > 1:
                order = sorted(held, key=lambda k: (held[k][0], k))
                split = 0 if now[1] == now[2] else sum(held[k][0] == 0 for k in order)
                if now[1] == now[2] or 0 < split < len(order):
                    out.append(_links(np.array(order), np.array([held[k][1] for k in order]), [held[k][2] for k in order], split, similarity))
            held.clear()

        def flush():
            cols = [np.concatenate(c) for c in zip(*out, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names)

        for batch in batches:
            cluster, b1, b2, side, node, copies = (batch.column(k).to_pylist() for k in range(6))
            for c in chunks(batch.column(6)):
                w = find_words(c, c.data, ALNUM_SEP)
                h = word_hashes(c.data, w)
                for r in range(c.rows):
                    k = c.first + r
                    group = cluster[k], b1[k], b2[k]
                    if group != now:
                        finish()
                        now = group
                    if node[k] not in held:  # a repeated row is here more than once
                        held[node[k]] = side[k], copies[k], np.unique(_grams(h[w.row_from[r] : w.row_to[r]], words))
            size = sum(len(x[0]) for x in out)
            if size > 1 << 14:
                yield flush()
        finish()
        if out:
            yield flush()

    dealt = members.repartition("cluster", "b1", "b2").sortWithinPartitions("cluster", "b1", "b2")
    return dealt.select("cluster", "b1", "b2", "side", "node", "copies", "text").mapInArrow(run, "node long, links long, root long")


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = NEAR_DUPLICATE_WORDS, similarity: float = NEAR_DUPLICATE_SIMILARITY, recall: float = RECALL) -> DataFrame:
    """rid, id, key, node, class (the least rid of the class), class_id, n_links for each row of docs."""
    bands, per_band = banding(similarity, recall)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("id", row_key("id", "text").alias("key"), F.lower("text").alias("text"))
    found = signatures(rows, words, bands, per_band).withColumn("rid", F.monotonically_increasing_id())
    # texts without words stand alone
    alone = F.col("n_words") == 0
    found = written(found.withColumn("s1", F.when(alone, F.col("rid")).otherwise(F.col("s1"))).withColumn("s2", F.when(alone, F.lit(-1)).otherwise(F.col("s2"))), "signatures")
    nodes = written(found.groupBy("s1", "s2").agg(F.min("rid").alias("node"), F.count("*").alias("copies"), F.min_by("bands", "rid").alias("bands")), "nodes")
    where = clusters(nodes).join(nodes.select("node", "copies"), "node").join(found.select(F.col("rid").alias("node"), "id", "key"), "node")
    members = where.join(rows.withColumnsRenamed({"id": "_id", "key": "_key"}), (F.col("key") == F.col("_key")) & F.col("id").eqNullSafe(F.col("_id")))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j, F.col("block")).alias("b1"), F.greatest(j, F.col("block")).alias("b2"), F.when(j < F.col("block"), 1).otherwise(0).alias("side")))
    pairs = members.withColumn("block", block).withColumn("pair", F.explode(others)).select("cluster", "pair.b1", "pair.b2", "pair.side", "node", "copies", "text")
    links = written(verify(pairs, words, similarity), "links")
    classes = components(links.select(F.col("node").alias("u"), F.col("root").alias("v"))).withColumnRenamed("u", "node")
    degree = links.groupBy("node").agg(F.sum("links").alias("links"))
    info = nodes.select("s1", "s2", "node", "copies").join(degree, "node", "left").join(classes, "node", "left")
    info = info.select("s1", "s2", "node", F.coalesce("c", "node").alias("class"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    each = written(found.select("rid", "id", "key", "s1", "s2").join(info, ["s1", "s2"]).drop("s1", "s2"), "classes")
    # a document without links is a class of its own; the others meet their class's id in salted groups
    salt = F.pmod(F.xxhash64("rid"), F.lit(SALTS)).cast("int")
    least = each.where("n_links > 0").groupBy("class").agg(F.min("id").alias("class_id")).select("class", "class_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    linked = each.where("n_links > 0").withColumn("salt", salt).join(least, ["class", "salt"]).drop("salt")
    return linked.unionByName(each.where("n_links = 0").withColumn("class_id", F.col("id")))


def op3_near(spark, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "class_id", "n_links")


#: The same by all pairs that share a run of five words: links on whole sets, classes by walking the links.
OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
t AS (SELECT min(r) AS k, words, count(*) AS copies FROM w WHERE len(words) > 0 GROUP BY words),
g AS (SELECT DISTINCT k, array_to_string(words[i : i + 4], ' ') AS gram FROM (SELECT k, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM t)),
n AS (SELECT k, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.k AS a, b.k AS b, count(*) AS shared FROM g a JOIN g b ON a.gram = b.gram AND a.k <> b.k GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.k = a JOIN n y ON y.k = b WHERE 5 * shared >= 4 * (x.n + y.n - shared)),
reach AS (SELECT k AS a, k AS b FROM t UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b),
c AS (SELECT a AS k, min(b) AS class FROM reach GROUP BY 1),
d AS (SELECT l.a AS k, sum(t.copies) AS links FROM l JOIN t ON t.k = l.b GROUP BY 1),
e AS (SELECT w.r, doc_id, c.class, t.copies - 1 + coalesce(links, 0) AS n_links FROM w LEFT JOIN t ON t.words = w.words LEFT JOIN c ON c.k = t.k LEFT JOIN d ON d.k = t.k),
m AS (SELECT class, min(doc_id) AS class_id FROM e GROUP BY 1)
SELECT doc_id, CASE WHEN e.class IS NULL THEN doc_id ELSE m.class_id END AS class_id, coalesce(n_links, 0)::BIGINT AS n_links FROM e LEFT JOIN m ON m.class = e.class
"""
