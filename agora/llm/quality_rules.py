"""Quality rules whose cutoffs keep a stated risk of rejecting good documents.

Every text is described by counts (``described``). Its base rules are fixed: fewer than ``LEAST_WORDS`` words,
or more than 30 % of the words in repeated windows, fail. Each further rule is a score of 0 to 1000, larger is
worse, and a cutoff per stratum (a language by default) from which documents are rejected. Cutoffs come from
labelled documents that pass the base, in two folds by a hash of the text:

* the holdout certifies. The rejection of good documents at a cutoff is tested against ``risk / rules`` with the
  exact binomial tail. Cutoffs are tested from the laxest on and the first that fails ends the sequence, so
  a rule needs no correction for its number of cutoffs; rules and strata are corrected for by Bonferroni.
  With probability 1 - ``delta`` no stratum rejects more than ``risk`` of its good documents.
* the other fold picks, of the certified cutoffs, the one that rejects most bad documents less ``WEIGHT``
  times the good ones; the laxest of equals, none where no cutoff gains.

A stratum with too few labels certifies nothing, and its documents are kept.

Spark: one map pass counts; labels meet documents by id; what is gathered is a histogram of at most 1001 scores
a rule and stratum. Nothing else leaves the executors.

Results: one row per document. A null text has no words, so it fails the base; an empty one too. A null stratum
is a stratum. Equal texts of a stratum are one observation (copies are no evidence of their own), good if any
of them is labelled good; a document with several labels is good if one says so; null labels and null ids
in ``labels`` are ignored. Repeated rows each get their row. Without labels, or without a table's rows, the base
alone decides. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agora.llm.common import keyed, materialize, prepared

LEAST_WORDS = 20
WINDOW = 8
#: Share of a stratum's good documents that may be rejected, and the probability that some stratum exceeds it.
RISK, DELTA = 0.05, 0.05
#: Bad documents that a rejected good one must be worth when a cutoff is picked.
WEIGHT = 2

_SYMBOLS = b"#*$%&|<>"
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside ``width``-word windows that the text holds twice or more."""
    n = len(words) - width + 1
    if n < 2 or len(set(words)) == len(words):
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    span = 1
    while span < width:  # numbers of windows of 1, 2, 4, ... words
        step = min(span, width - span)
        _, ids = np.unique(ids[:len(ids) - step] * np.int64(len(words)) + ids[step:], return_inverse=True)
        span += step
    again = np.flatnonzero(np.bincount(ids)[ids] > 1)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + width, -1)
    return int(np.count_nonzero(np.cumsum(edge)[:-1]))


def counts(text: str) -> tuple[int, ...]:
    """The values of ``_COUNTS`` for a text."""
    raw = text.encode()
    words = raw.split()  # bytes split at exactly \x20 and \x09-\x0D
    if not words:
        return (0, 0, sum(raw.count(c) for c in _SYMBOLS), 0, 0, 0)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return (len(words), len(text) - (len(raw) - sum(map(len, words))), sum(raw.count(c) for c in _SYMBOLS),
            len(lines) - len(set(lines)), repeated_words(words), len(lines))


def described(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """_row, doc_id, stratum, the counts, and ``digest``, 16 bytes that stand for the text."""
    prepared(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            columns = zip(*map(counts, texts)) if texts else [()] * len(_COUNTS)
            digests = [hashlib.blake2b(t.encode(), digest_size=16).digest() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("_row", "doc_id", "stratum")],
                 *[pa.array(c, pa.int64()) for c in columns], pa.array(digests, pa.binary())],
                ["_row", "doc_id", "stratum", *_COUNTS, "digest"])

    rows = keyed(docs, "doc_id", stratum, "text").select(
        "_row", "doc_id", F.col(stratum).cast("string").alias("stratum"), "text")
    schema = ", ".join(["_row long, doc_id long, stratum string", *[f"{c} long" for c in _COUNTS], "digest binary"])
    return rows.mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def scores() -> dict[str, Column]:
    """Rules as scores of 0 to 1000, larger is worse; for documents that have words."""
    mean = F.expr("50 * word_chars div n_words")
    of_words = lambda c: F.expr(f"1000 * {c} div n_words")
    raw = {"symbols": of_words("n_symbols"), "repeated_words": of_words("n_repeat_words"),
           "repeated_lines": F.expr("1000 * n_dup_lines div n_lines"), "long_words": mean, "short_words": 1000 - mean,
           "few_words": 1000 - F.col("n_words")}
    return {rule: F.greatest(F.lit(0), F.least(F.lit(1000), score)).cast("int") for rule, score in raw.items()}


def tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial X of n trials, exactly (a sum of its terms in logarithms)."""
    if k >= n:
        return 1.0
    i = np.arange(k, dtype=np.float64)
    logs = n * math.log1p(-p) + np.concatenate(
        [[0.0], np.cumsum(np.log((n - i) / (i + 1)) + math.log(p) - math.log1p(-p))])
    top = logs.max()
    return min(1.0, float(np.exp(top) * np.exp(logs - top).sum()))


def cutoff(score: np.ndarray, held_good: np.ndarray, fit_good: np.ndarray, fit_bad: np.ndarray,
           risk: float, delta: float) -> tuple[int | None, int, int]:
    """(cutoff or None, good documents in the holdout, those of them rejected) for one rule: counts of
    documents by score, in any order."""
    order = np.argsort(-score, kind="stable")
    score, held, good, bad = (x[order] for x in (score, held_good, fit_good, fit_bad))
    n, best, gain = int(held.sum()), None, 0
    rejected, picked, worth = 0, 0, 0
    for s, h, g, b in zip(score.tolist(), held.tolist(), good.tolist(), bad.tolist()):
        rejected += h
        if s == 0 or rejected > risk * n or tail(rejected, n, risk) > delta:
            break  # a score of 0 says nothing against a document
        worth += b - WEIGHT * g
        if worth > gain:
            best, gain, picked = s, worth, rejected
    return best, n, picked


def cutoffs(stats: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """stratum, rule, cutoff, n_good and n_rejected (of the holdout): the certified cutoffs in use."""
    known = (labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
             .groupBy("doc_id").agg(F.max("quality").alias("quality")))
    rules = scores()
    texts = (stats.where(~base_failed()).join(known, "doc_id")
             .groupBy("stratum", "digest").agg(F.max("quality").alias("quality"),
                                               *[F.max(c).alias(c) for c in _COUNTS]))
    holdout = F.xxhash64("digest") % 2 == 0
    good = F.col("quality") > 0
    tallied = (texts.select("stratum", holdout.alias("held"), good.alias("good"), F.explode(F.array(
        *[F.struct(F.lit(r).alias("rule"), s.alias("score")) for r, s in rules.items()])).alias("s"))
        .groupBy("stratum", "s.rule", "s.score").agg(
            F.count_if(F.expr("held AND good")).alias("held_good"),
            F.count_if(F.expr("NOT held AND good")).alias("fit_good"),
            F.count_if(F.expr("NOT held AND NOT good")).alias("fit_bad")))
    tallied = materialize(tallied, "rule-scores")
    strata = tallied.select(F.coalesce(F.concat(F.lit("="), "stratum"), F.lit("")).alias("s")).distinct().count()
    each_risk, each_delta = risk / len(rules), delta / (len(rules) * max(1, strata))

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        found = cutoff(*[group[c].to_numpy(np.int64) for c in ("score", "held_good", "fit_good", "fit_bad")],
                       each_risk, each_delta)
        keys = [group["stratum"].iloc[0], group["rule"].iloc[0]]
        rows = [[*keys, *found]] if found[0] is not None else []
        return pd.DataFrame(rows, columns=["stratum", "rule", "cutoff", "n_good", "n_rejected"])

    return materialize(tallied.groupBy("stratum", "rule").applyInPandas(
        pick, "stratum string, rule string, cutoff int, n_good long, n_rejected long"), "rule-cutoffs")


def judged(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK,
           delta: float = DELTA) -> DataFrame:
    """The counts of each document with base_failed, ``failed`` (the rules that reject it) and kept."""
    stats = materialize(described(docs, stratum), "rule-counts")
    limits = (cutoffs(stats, labels, risk, delta).groupBy(F.col("stratum").alias("_stratum"))
              .agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("limits")))
    told = stats.join(limits, F.expr("stratum <=> _stratum"), "left")
    over = [F.when(s >= F.col("limits")[rule], F.lit(rule)) for rule, s in scores().items()]
    return told.select(
        "doc_id", "stratum", *_COUNTS, base_failed().alias("base_failed"),
        F.when(base_failed(), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*over))).alias("failed")
    ).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))
