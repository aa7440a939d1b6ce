"""Words that are one edit apart, found through a reduced alphabet, and the word each is a variant of.

Words are the runs ``RUN`` of the texts, ASCII lower-cased; the slip rule (``slipped``) takes a letter
out of some runs, as the result contract asks. Words of ``LEAST`` letters or more that occur twice or more are compared:

* letters are hashed to ``SYMBOLS`` symbols, so a word becomes a reduced word, and words at one edit have reduced
  words at one edit or none. Each reduced word is known by a hash of its symbols that a neighbour's hash follows
  from in constant time, so a very long word costs a few numbers a letter.
* from every reduced word its neighbours are generated: itself, every deletion, and every replacement by a
  larger symbol. Insertions and replacements by smaller symbols are the same pairs seen from the other word.
* neighbours that a Bloom filter of the reduced words knows are joined with the reduced words, and the
  words behind both sides are compared as written (Levenshtein distance 1).
* a reduced word of more than ``CROWD`` words would compare all its words with each other. Such words are
  left out there and found exactly by their deletions instead: a word with one place left out is shared by no more
  words than there are letters to put back.

Results: ``variants`` gives a row per word. Null texts have no words; a null doc_id hashes as empty text; repeated
rows count each. Ties between near words go to the smallest by code points. No rows give no rows. Other
columns are ignored.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.llm import bloom
from agora.llm.common import BATCH_CHARS, materialize, prepared, release

#: Letters of a word (fixed by the result contract), and the fewest that are compared.
LETTERS = "A-Za-zÀ-ÿ"
LEAST = 7
RUN = re.compile(f"[{LETTERS}]{{{LEAST},}}")
SLIP = 31
SYMBOLS = 8
#: Words behind one reduced word that are still compared through it.
CROWD = 64
#: A form has at least so many times the occurrences of its variant.
TIMES = 10

#: Different words that a task counts before it passes them on.
_HELD = 200_000
_P = np.uint64((1 << 31) - 1)
_BASES = (np.uint64(1_103_515_245), np.uint64(1_566_083_941))


def slipped(run: str, prefix: int) -> str:
    """The word that a run stands for; ``prefix``: crc32 of ``<doc_id>:``."""
    h = zlib.crc32(run.encode(), prefix)
    if h % SLIP:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def words(docs: DataFrame) -> DataFrame:
    """word, n: occurrences of every word of ``LEAST`` letters or more."""
    prepared(docs.sparkSession)

    def flush(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())],
                                          ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                # lower() of bytes changes A-Z only
                held.update(w for w in (slipped(r, prefix) for r in RUN.findall((text or "").encode().lower().decode()))
                            if len(w) >= LEAST)
                if len(held) > _HELD:
                    yield flush(held)
                    held = Counter()
        yield flush(held)

    return docs.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def letters(words_: list[str]) -> np.ndarray:
    """The code points of words of one length, a row each."""
    return np.frombuffer("".join(words_).encode("utf-32-le"), np.uint32).astype(np.uint64).reshape(len(words_), -1)


def reduced(at: np.ndarray, symbols: int = SYMBOLS) -> np.ndarray:
    """A symbol, from 1, for each letter."""
    return at % np.uint64(symbols) + np.uint64(1)


def _alike(words_: list[str]) -> Iterator[np.ndarray]:
    """Numbers of words of one length, at most ``BATCH_CHARS`` letters together or one word."""
    lengths = np.array([len(w) for w in words_], np.int64)
    for n in np.unique(lengths).tolist():
        at, most = np.flatnonzero(lengths == n), max(1, BATCH_CHARS // max(1, n))
        for lo in range(0, len(at), most):
            yield at[lo:lo + most]


def _heads(values: np.ndarray, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all prefixes of each row (the empty one first), and powers of the base."""
    m, n = values.shape
    heads, powers = np.zeros((m, n + 1), np.uint64), np.ones(n + 1, np.uint64)
    for i in range(n):
        heads[:, i + 1] = (heads[:, i] * base + values[:, i]) % _P
        powers[i + 1] = powers[i] * base % _P
    return heads, powers


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a << np.uint64(31)) | b).view(np.int64)


def whole_keys(values: np.ndarray) -> np.ndarray:
    """The hash that each row is known by."""
    return _joined(*[_heads(values, base)[0][:, -1].copy() for base in _BASES])


def deletions(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every different row with one place left out."""
    m, n = values.shape
    found = []
    for base in _BASES:
        heads, powers = _heads(values, base)
        behind = powers[n - 1 - np.arange(n)]
        tail = (heads[:, n:] + _P * _P - heads[:, 1:] * behind) % _P  # what stands behind each place
        found.append((heads[:, :n] * behind + tail) % _P)
    other = np.ones((m, n), bool)  # inside a run of one symbol all deletions are the same
    other[:, 1:] = values[:, 1:] != values[:, :-1]
    return np.nonzero(other)[0], _joined(found[0][other], found[1][other])


def replacements(values: np.ndarray, symbols: int = SYMBOLS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, key) of every row with one place replaced by a larger symbol."""
    n = values.shape[1]
    at = [(heads[:, -1:], powers[n - 1 - np.arange(n)])
          for heads, powers in (_heads(values, base) for base in _BASES)]
    for more in range(1, symbols):
        fits = values + np.uint64(more) <= np.uint64(symbols)
        moved = [((whole + np.uint64(more) * behind) % _P)[fits] for whole, behind in at]
        yield np.nonzero(fits)[0], _joined(*moved)


def _keyed(vocabulary: DataFrame, symbols: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("word").to_pylist()
            keys = np.zeros(len(own), np.int64)
            for some in _alike(own):
                keys[some] = whole_keys(reduced(letters([own[i] for i in some.tolist()]), symbols))
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(keys)],
                                             ["word", "n", "key"])

    return vocabulary.mapInArrow(run, "word string, n long, key long")


def near_pairs(vocabulary: DataFrame, symbols: int = SYMBOLS, crowd: int = CROWD) -> DataFrame:
    """word, n, near, near_n: both directions of each pair of ``vocabulary`` (word, n; words differ) at one edit."""
    prepared(vocabulary.sparkSession)
    known = materialize(_keyed(vocabulary, symbols), "spelling-words")
    sizes = materialize(known.groupBy("key").agg(F.count("*").alias("size"), F.min("word").alias("word")), "spelling-keys")
    calm, crowded = sizes.where(F.col("size") <= crowd), sizes.where(F.col("size") > crowd)
    held = bloom.build(calm.select("key"))

    def generate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, keys = batch.column("word").to_pylist(), batch.column("key").to_numpy()
            for some in _alike(own):
                values = reduced(letters([own[i] for i in some.tolist()]), symbols)
                parts = [(np.arange(len(some)), keys[some]), deletions(values)]
                for rows, near in itertools.chain(parts, replacements(values, symbols)):
                    hit = bloom.passes(held.value, near)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[some[rows[hit]]]), pa.array(near[hit])],
                                                     ["key", "near_key"])

    links = calm.select("key", "word").mapInArrow(generate, "key long, near_key long")
    behind = (known.join(calm.select("key"), "key", "left_semi").groupBy(F.col("key").alias("near_key"))
              .agg(F.collect_list(F.struct("word", "n")).alias("others")))  # at most ``crowd`` words
    one = F.levenshtein(F.col("word"), F.col("near"), 1) == 1
    found = (links.join(behind, "near_key").join(known, "key")
             .select("word", "n", F.explode("others").alias("o"), "key", "near_key")
             # words of one key meet from both sides
             .where((F.col("key") != F.col("near_key")) | (F.col("word") < F.col("o.word")))
             .select("word", "n", F.col("o.word").alias("near"), F.col("o.n").alias("near_n")))
    dense = _by_deletions(known.select("word", "n"), known.join(crowded.select("key"), "key", "left_semi"))
    return _both(found.where(one)).unionByName(_both(dense.where(one)).distinct())


def _both(pairs: DataFrame) -> DataFrame:
    names = ("word", "n", "near", "near_n")
    there, back = (F.struct(*[F.col(c).alias(n) for c, n in zip(order, names)])
                   for order in (names, ("near", "near_n", "word", "n")))
    return pairs.select(F.inline(F.array(there, back)))


def _by_deletions(known: DataFrame, crowd: DataFrame) -> DataFrame:
    """Pairs of a word of ``crowd`` and any word that are equal but for one place."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, counts = batch.column("word").to_pylist(), batch.column("n").to_numpy()
            for some in _alike(own):
                values = letters([own[i] for i in some.tolist()])
                for rows, cuts in ((np.arange(len(some)), whole_keys(values)), deletions(values)):
                    at = some[rows]
                    yield pa.RecordBatch.from_arrays([pa.array([own[i] for i in at.tolist()], pa.string()),
                                                      pa.array(counts[at]), pa.array(cuts)], ["word", "n", "cut"])

    schema = "word string, n long, cut long"
    some = crowd.select("word", "n").mapInArrow(cut, schema)
    wanted = bloom.build(some.select("cut"))

    def cut_known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches):
            hit = bloom.passes(wanted.value, batch.column("cut").to_numpy())
            if hit.any():
                yield batch.filter(pa.array(hit))

    every = known.mapInArrow(cut_known, schema)
    return (some.alias("a").join(every.alias("b"), F.expr("a.cut = b.cut AND a.word <> b.word"))
            .select("a.word", "a.n", F.col("b.word").alias("near"), F.col("b.n").alias("near_n")).distinct())


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: the last of the forms that follow from a word. A form occurs ``TIMES`` times as often as its word
    and counts are 64-bit numbers, so chains have fewer than 20 links and five rounds of doubling reach their end."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    for _ in range(5):
        after = now.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        before, now = now, materialize(now.join(after, F.col("root") == F.col("_at"), "left").select(
            "word", F.coalesce("_next", "root").alias("root")), "spelling-roots")
        release(before)
    return now


def variants(docs: DataFrame, symbols: int = SYMBOLS, crowd: int = CROWD) -> DataFrame:
    """word, form, root, n, n_near, form_n."""
    vocabulary = materialize(words(docs).where("n >= 2"), "spelling-vocabulary")
    near = near_pairs(vocabulary, symbols, crowd)
    told = near.groupBy("word", "n").agg(F.count("*").alias("n_near"),
                                         F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    told = told.select("word", "n_near", F.when(-F.col("best.less") >= TIMES * F.col("n"), F.col("best")).alias("best"))
    told = materialize(told.select("word", "n_near", F.col("best.near").alias("form"),
                                   (-F.col("best.less")).alias("form_n")), "spelling-near")
    roots = _roots(told.where("form IS NOT NULL"))
    return (vocabulary.join(told, "word", "left").join(roots, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n",
                    F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n"))
