"""Language identification by nearest centroids.

A text's vector holds hashed counts of its letter 1- to 3-grams (lower case, other
characters as one space), damped, weighted by inverse document frequency and normalised.
``fit`` counts document frequencies over all training rows, and clusters a sample of at most
``SAMPLE`` different texts a language (those of the smallest hashes) into ``CLUSTERS`` centroids a language.
``classify`` gives the language of the centroid with the largest cosine; a text farther from
it than ``SLACK`` times the usual distance span of that language's sample is rejected.

Results: one row per input row with lang_pred, score (that cosine, 0 to 1) and
``rejected``. Null texts, and texts without a letter, have ``und``, score 0 and are rejected; so
have all texts where nothing could be learned. Ties go to the first language in order.
Texts of more than ``SEGMENT`` characters are counted in segments. A null doc_id counts as
the empty text. Repeated rows are judged each. No rows give no rows. Labels are language
codes, so their number is taken to fit the driver. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agora.llm.common import chunked, materialize, prepared

BUCKETS = 1 << 13
CLUSTERS = 4
#: Bound on the labelled texts that centroids are fitted on, for each language.
SAMPLE = 1500
ROUNDS = 8
SLACK = 0.25
UNKNOWN = "und"
SEGMENT = 1 << 20
_ROWS = 192
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def _counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """n-gram counts (texts x BUCKETS) and the number of letters of each text."""
    codes = [np.frombuffer((t.lower() + "\n").encode("utf-32-le"), np.uint32) for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(c) for c in codes])
    code = np.concatenate(codes)
    letter = _is_letter()[code]
    letters = np.bincount(owner[letter], minlength=len(texts))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    code, owner = np.where(letter, code, 32)[keep].astype(np.uint32), owner[keep]
    out = np.zeros(len(texts) * BUCKETS, np.int64)
    h = np.zeros(len(code), np.uint32)
    for n in range(1, 4):
        m = max(len(code) - n + 1, 0)
        h = h[:m] * np.uint32(0x01000193) + code[n - 1:] * np.uint32(0x85EBCA6B) + np.uint32(n)
        at = ((h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1)) >> np.uint32(19)
        same = owner[:m] == owner[n - 1:]
        out += np.bincount(owner[:m][same] * BUCKETS + at[same], minlength=len(out))
    return out.reshape(len(texts), BUCKETS), letters


def vectors(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, damped counts, letters) for runs of texts."""
    for lo, hi in chunked((max(len(t), SEGMENT // _ROWS) for t in texts), SEGMENT):
        if hi - lo == 1 and len(texts[lo]) > SEGMENT:
            parts = [_counts([texts[lo][i:i + SEGMENT]]) for i in range(0, len(texts[lo]), SEGMENT)]
            counts, letters = (sum(p[i] for p in parts) for i in (0, 1))
        else:
            counts, letters = _counts(texts[lo:hi])
        yield lo, np.log1p(counts).astype(np.float32), letters


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(size > 0, size, 1)


@dataclass
class Model:
    idf: np.ndarray
    langs: list[str]        # of each centroid
    centroids: np.ndarray   # unit rows
    least: np.ndarray       # of each centroid, the cosine below which a text is rejected


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _frequencies(train: DataFrame) -> tuple[np.ndarray, int]:
    """Document frequency of every bucket over all rows, and their number."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            for _, x, letters in vectors([t or "" for t in batch.column("text").to_pylist()]):
                total[:-1] += (x > 0).sum(axis=0)
                total[-1] += (letters > 0).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS + 1)), pa.array(total)], ["bucket", "n"])

    sums = (train.select("text").mapInArrow(count, "bucket long, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")).collect())  # BUCKETS + 1 rows
    found = np.zeros(BUCKETS + 1, np.int64)
    for r in sums:
        found[r["bucket"]] = r["n"]
    return found[:-1], int(found[-1])


def clustered(x: np.ndarray, k: int = CLUSTERS, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means of unit rows: centroids, and the cosine of each row to its own."""
    centers = _unit(x.mean(axis=0, keepdims=True))
    while len(centers) < min(k, len(x)):  # the row farthest from all so far
        far = int((x @ centers.T).max(axis=1).argmin())
        centers = np.vstack([centers, x[far:far + 1]])
    for _ in range(rounds):
        own = (x @ centers.T).argmax(axis=1)
        sums = np.vstack([x[own == c].sum(axis=0) if (own == c).any() else centers[c]
                          for c in range(len(centers))])
        centers = _unit(sums)
    return centers, (x @ centers.T).max(axis=1)


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Learn from ``docs`` (doc_id, text, lang); rows without text or lang are left out."""
    spark = docs.sparkSession
    prepared(spark)
    train = docs.select("doc_id", "text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    df, n = _frequencies(train)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    scale = 1 << 30
    rate = F.element_at(F.create_map(*[F.lit(x) for lang, m in sizes.items()
                                       for x in (lang, min(scale, round(scale * sample / m)))]), F.col("lang"))
    shared = spark.sparkContext.broadcast(idf)

    def vector(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for lo, x, letters in vectors(batch.column("text").to_pylist()):
                rows = _unit(x * shared.value).astype(np.float16)
                at = np.flatnonzero(letters > 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([langs[lo + i] for i in at], pa.string()),
                     pa.array([rows[i].tobytes() for i in at], pa.binary())], ["lang", "x"])

    # different texts, about ``sample`` a language before the bound; copies are reduced where they are read
    place = F.xxhash64("text")
    some = (train.withColumn("at", F.pmod(place, F.lit(scale))).where(F.col("at") < rate)
            .groupBy("lang", "at", place.alias("h")).agg(F.first("text").alias("text")))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("at", "h"))
    drawn = (some.withColumn("nth", first).where(F.col("nth") <= sample).select("lang", "text")
             .mapInArrow(vector, "lang string, x binary"))

    def centers(lang, rows):
        import pandas as pd
        x = np.vstack([np.frombuffer(b, np.float16) for b in rows["x"]]).astype(np.float32)
        found, own = clustered(x)
        return pd.DataFrame({"lang": lang[0], "x": [c.astype(np.float32).tobytes() for c in found],
                             "low": float(np.quantile(own, 0.01)) * SLACK})

    drawn = materialize(drawn, "langid")
    # CLUSTERS rows a language come back
    found = sorted(drawn.groupBy("lang").applyInPandas(centers, "lang string, x binary, low double").collect(),
                   key=lambda r: (r["lang"], bytes(r["x"])))
    if not found:
        return None
    return Model(idf, [r["lang"] for r in found],
                 np.vstack([np.frombuffer(r["x"], np.float32) for r in found]),
                 np.array([r["low"] for r in found]))


def classify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with lang_pred, score and rejected; only ``text`` is looked at."""
    spark = docs.sparkSession
    prepared(spark)
    shared = spark.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            langs, scores, far = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            for lo, x, letters in vectors(texts) if m else ():
                cosine = _unit(x * m.idf) @ m.centroids.T
                best = cosine.argmax(axis=1)
                for i in np.flatnonzero(letters > 0):
                    langs[lo + i] = m.langs[best[i]]
                    scores[lo + i] = min(max(float(cosine[i, best[i]]), 0.0), 1.0)
                    far[lo + i] = scores[lo + i] < m.least[best[i]]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(langs), pa.array(scores), pa.array(far)],
                [*names, "lang_pred", "score", "rejected"])

    schema = docs.select(*names).schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return docs.select(*names).mapInArrow(judge, schema)


def identified(docs: DataFrame) -> DataFrame:
    """``fit`` on the rows that are not held out, then ``classify`` all: doc_id, held_out,
    lang_pred, score, rejected."""
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return classify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def recognised(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that language identification rejects."""
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "text")
    return classify(whole, model).where("NOT rejected").select("doc.*")
