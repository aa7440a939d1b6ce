"""Ranked lexical search by branch-and-bound over a trie of document term vectors.

Terms are the runs ``TERM`` of a text, ASCII lower-cased. Scores are those of the result contract
(``weight``, ``saturated``): integers that grow with a term's occurrences tf and fall with the document's m.

* One map pass keeps of each document the number n of its terms and tf of those terms that some item asks for
  (its restricted vector); N, L and document frequencies are sums over all documents.
* Vectors are ordered by falling document frequency and laid into tries, as in an FP-tree: documents of one
  trie that begin alike share a path. Every inner node knows, for each term below it, the largest tf, and the smallest m.
* All items search a trie together, depth first: an item enters a node only while the score of a document with
  those maxima and that minimum reaches the item's tenth best score so far. ``LEAF`` documents or
  fewer are scored themselves.
* A task's tries are bounded by ``POSTINGS``; each task returns the best of each item, and these are merged in two
  steps. Items are searched in blocks of at most ``BLOCK_CHARS`` of text, each against all documents.

Results: item_id, rank, doc_id, score, at most ``top`` rows an item, scores above 0, equal scores by ascending doc_id
(null ids last). A null or empty text has no terms: such an item finds nothing and such a document is neither found nor
counted in N. Every row of ``benchmark`` is an item of its own and every row of ``documents`` a document, repeated ones
too. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from agora.llm.common import chunked, keyed, materialize, prepared, release

TOP = 10
#: Documents of a trie that are scored themselves, and postings that a trie is made of.
LEAF = 8
POSTINGS = 1 << 18
#: Text of the items that are searched together, in characters (a longer item stands alone).
BLOCK_CHARS = 1 << 22
#: Tasks whose best are merged in one group of the first step.
MERGED = 256

#: Pattern of a term, and the bytes that stand between terms (fixed by the result contract).
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_APART = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))
_NO_ID = (1 << 63) - 1


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().translate(_APART).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def saturated(tf, m):
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def _blocks(benchmark: DataFrame) -> Iterator[list]:
    """Rows of ``benchmark`` with the place of each, a bounded number at a time."""
    held, size = [], 0
    for at, row in enumerate(benchmark.select("item_id", "text").toLocalIterator()):
        if held and size + len(row["text"] or "") > BLOCK_CHARS:
            yield held
            held, size = [], 0
        held.append((at, row["item_id"], row["text"]))
        size += len(row["text"] or "") + 64
    if held:
        yield held


def restricted(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """doc_id, n, terms (numbers, ascending), tfs: of every document that has a term."""
    spark = docs.sparkSession
    prepared(spark)
    sent = spark.sparkContext.broadcast(numbers)  # terms of one block of items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            ids, lengths, found, tfs = [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                own = terms(text)
                if own:
                    held = sorted(Counter(known[w] for w in own if w in known).items())
                    ids.append(doc_id)
                    lengths.append(len(own))
                    found.append([t for t, _ in held])
                    tfs.append([c for _, c in held])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), pa.array(found, pa.list_(pa.int32())),
                 pa.array(tfs, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "tfs"])

    return keyed(docs, "doc_id", "text").select("doc_id", "text").mapInArrow(
        run, "doc_id long, n long, terms array<int>, tfs array<long>")


class Wants:
    """Which items of a block ask for a term, and how often: item lists by term rank."""

    def __init__(self, counts: list[Counter], n_terms: int):
        pairs = sorted((t, i, c) for i, own in enumerate(counts) for t, c in own.items())
        at, self.items, self.times = (np.array(x, np.int64) for x in (zip(*pairs) if pairs else ([], [], [])))
        self.starts = np.searchsorted(at, np.arange(n_terms + 1))
        self.n_items = len(counts)

    def sums(self, ranks: np.ndarray, parts: np.ndarray, rows: np.ndarray, n_rows: int,
             active: np.ndarray) -> np.ndarray:
        """Scores by row and item: the sum of ``parts`` of the terms ``ranks`` that the item asks for. Only those
        of ``active`` items are right, the others are 0."""
        sizes = self.starts[ranks + 1] - self.starts[ranks]
        which = np.repeat(np.arange(len(ranks)), sizes)
        at = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + self.starts[ranks][which]
        items = self.items[at]
        on = active[items]
        which, at, items = which[on], at[on], items[on]
        out = np.zeros(n_rows * self.n_items, np.int64)
        np.add.at(out, rows[which] * self.n_items + items, parts[which] * self.times[at])
        return out.reshape(n_rows, self.n_items)


class Best:
    """The best (score, doc_id) of every item so far."""

    def __init__(self, n_items: int, top: int):
        self.top = top
        self.held: list[list[tuple[int, int]]] = [[] for _ in range(n_items)]  # (-score, id), ascending
        self.score, self.last = np.zeros(n_items, np.int64), np.full(n_items, -1, np.int64)  # the one to beat

    def reaches(self, bound: np.ndarray) -> np.ndarray:
        return (bound >= self.score) & (bound > 0)

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        better = (scores > self.score) | ((scores == self.score) & (ids[:, None] < self.last))
        for row, item in zip(*np.nonzero(better & (scores > 0))):
            own, new = self.held[item], (-int(scores[row, item]), int(ids[row]))
            if len(own) == self.top and new >= own[-1]:
                continue
            own.append(new)
            own.sort()
            del own[self.top:]
            if len(own) == self.top:
                self.score[item], self.last[item] = -own[-1][0], own[-1][1]


class Trie:
    """Restricted vectors as a trie with its unbranched paths contracted: documents in the order of their vectors, a
    node is a range of them that share more terms with each other than with the rest."""

    def __init__(self, vectors: list[tuple], m: np.ndarray, ids: np.ndarray, weights: np.ndarray):
        """``vectors``: (ranks, tfs), ranks ascending (falling document frequency)."""
        order = sorted(range(len(vectors)), key=lambda d: vectors[d][0])
        self.ids, self.m = ids[order], m[order]
        own = [vectors[d] for d in order]
        self.edge = np.concatenate([[0], np.cumsum([len(r) for r, _ in own])]).astype(np.int64)
        self.ranks = np.array([t for r, _ in own for t in r], np.int64)
        self.tfs = np.array([t for _, f in own for t in f], np.int64)
        self.weights = weights
        self.shared = np.array([self._common(a[0], b[0]) for a, b in zip(own, own[1:])], np.int64)

    @staticmethod
    def _common(a: list, b: list) -> int:
        for i, (x, y) in enumerate(zip(a, b)):
            if x != y:
                return i
        return min(len(a), len(b))

    def children(self, lo: int, hi: int, depth: int) -> list[tuple[int, int, int]]:
        """The branches of the node of documents lo..hi that share ``depth`` terms: (lo, hi, terms shared)."""
        edges = [lo, *(np.flatnonzero(self.shared[lo:hi - 1] == depth) + lo + 1).tolist(), hi]
        return [(a, b, self.depth(a, b)) for a, b in zip(edges, edges[1:])]

    def depth(self, lo: int, hi: int) -> int:
        """Terms that documents lo..hi share; -1 for one document."""
        return int(self.shared[lo:hi - 1].min(initial=1 << 40)) if hi - lo > 1 else -1

    def maxima(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Terms of documents lo..hi and the largest tf of each."""
        ranks, tfs = self.ranks[self.edge[lo]:self.edge[hi]], self.tfs[self.edge[lo]:self.edge[hi]]
        order = np.argsort(ranks, kind="stable")
        ranks, first = np.unique(ranks[order], return_index=True)
        return ranks, np.maximum.reduceat(tfs[order], first) if len(first) else tfs

    def search(self, wants: Wants, best: Best) -> None:
        """Depth first with an own stack (a trie is as deep as its documents have terms)."""
        stack = [(0, len(self.ids), self.depth(0, len(self.ids)), np.ones(wants.n_items, bool))]
        while stack:
            lo, hi, depth, active = stack.pop()
            if hi - lo <= LEAF:
                self._score(lo, hi, wants, active, best)
                continue
            ranks, most = self.maxima(lo, hi)
            parts = self.weights[ranks] * saturated(most, self.m[lo:hi].min())
            bound = wants.sums(ranks, parts, np.zeros(len(ranks), np.int64), 1, active)[0]
            active = active & best.reaches(bound)
            if active.any():
                stack += [(*part, active) for part in reversed(self._grouped(self.children(lo, hi, depth)))]

    @staticmethod
    def _grouped(parts: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Small branches next to each other are scored as one leaf."""
        out: list[tuple[int, int, int]] = []
        for part in parts:
            if out and part[1] - out[-1][0] <= LEAF:
                out[-1] = (out[-1][0], part[1], -1)
            else:
                out.append(part)
        return out

    def _score(self, lo: int, hi: int, wants: Wants, active: np.ndarray, best: Best) -> None:
        a, b = self.edge[lo], self.edge[hi]
        rows = np.repeat(np.arange(hi - lo), np.diff(self.edge[lo:hi + 1]))
        parts = self.weights[self.ranks[a:b]] * saturated(self.tfs[a:b], self.m[lo:hi][rows])
        best.offer(wants.sums(self.ranks[a:b], parts, rows, hi - lo, active), self.ids[lo:hi])


def _ranked(spark: SparkSession, docs: DataFrame, block: list, top: int) -> DataFrame | None:
    counts = [Counter(terms(text)) for _, _, text in block]
    numbers = {t: i for i, t in enumerate(sorted(set().union(*counts)))}
    if not numbers:
        return None
    vectors = materialize(restricted(docs, numbers), "term-vectors")
    n_docs, length = vectors.agg(F.count("*"), F.sum("n")).first()
    if not n_docs:
        release(vectors)
        return None
    df = dict(vectors.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator())  # terms of the block
    order = sorted(df, key=lambda t: (-df[t], t))
    rank = np.full(len(numbers), -1, np.int64)
    rank[order] = np.arange(len(order))
    weights = np.array([weight(n_docs, df[t]) for t in order], np.int64)
    wants = Wants([Counter({int(rank[numbers[t]]): c for t, c in own.items() if numbers[t] in df}) for own in counts],
                  len(order))
    sent = spark.sparkContext.broadcast((rank, weights, wants))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, weights, wants = sent.value
        best = Best(wants.n_items, top)
        for batch in batches:
            sizes = batch.column("terms").value_lengths().to_pylist()
            for lo, hi in chunked(sizes, POSTINGS):
                part = batch.slice(lo, hi - lo)
                own = []
                for found, tfs in zip(part.column("terms").to_pylist(), part.column("tfs").to_pylist()):
                    pairs = sorted(zip(rank[found].tolist(), tfs))
                    own.append(([t for t, _ in pairs], [c for _, c in pairs]))
                m = np.array([25 + 75 * n * n_docs // length for n in part.column("n").to_pylist()], np.int64)
                ids = np.array([_NO_ID if i is None else i for i in part.column("doc_id").to_pylist()], np.int64)
                Trie(own, m, ids, weights).search(wants, best)
        rows = [(i, None if d == _NO_ID else d, -s) for i, own in enumerate(best.held) for s, d in own]
        item, doc_id, score = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc_id, pa.int64()),
                                          pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    found = (vectors.where(F.size("terms") > 0).select("doc_id", "n", "terms", "tfs")
             .mapInArrow(search, "item int, doc_id long, score long")
             .withColumn("_group", F.spark_partition_id() % MERGED))
    first = F.col("score").desc(), F.col("doc_id").asc_nulls_last()
    for keys in (["item", "_group"], ["item"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*first))).where(
            F.col("rank") <= top)
    names = spark.createDataFrame([(i, item_id) for i, (_, item_id, _) in enumerate(block)], "item int, item_id long")
    return materialize(found.join(names, "item").select("item_id", "rank", "doc_id", "score"), "ranked")


def ranked(docs: DataFrame, benchmark: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` best documents of every item."""
    spark = docs.sparkSession
    done = [r for r in (_ranked(spark, docs, block, top) for block in _blocks(benchmark)) if r is not None]
    if not done:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, done)


#: The same result in DuckDB: every document is scored for every item.
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text,
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') AS t FROM documents),
sizes AS (SELECT r, doc_id, len(t)::HUGEINT AS n FROM d WHERE len(t) > 0),
total AS (SELECT count(*)::HUGEINT AS nd, sum(n)::HUGEINT AS l FROM sizes),
tf AS (SELECT r, term, count(*)::HUGEINT AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY r, term),
b AS (SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(text,
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') AS t FROM benchmark),
want AS (SELECT i, item_id, term, count(*) AS times FROM (SELECT i, item_id, unnest(t) AS term FROM b)
         GROUP BY i, item_id, term),
w AS (SELECT term, floor(1000 * ln((2 * max(nd) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
      FROM tf, total WHERE term IN (SELECT term FROM want) GROUP BY term),
score AS (SELECT i, item_id, r, any_value(doc_id) AS doc_id,
            sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * nd) // l))))::BIGINT AS score
          FROM want JOIN w USING (term) JOIN tf USING (term) JOIN sizes USING (r), total GROUP BY i, item_id, r),
best AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST, r) AS rank
         FROM score WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM best WHERE rank <= {TOP}
"""
