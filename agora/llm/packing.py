"""Best-fit packing of token sequences.

Only the histogram of piece lengths (``capacity`` numbers at most) decides how sequences are
filled, whatever the number of documents. The configuration linear program (how many
sequences of each filling; every length covered) is solved by multiplicative weights: a
knapsack dynamic program prices the best filling under the present weights, it is taken
a number of times, and the weights of what it covers shrink. The solution is rounded down, and
what is left is packed largest first with the subset-sum filling that wastes least. The
fillings are then dealt to the pieces, which are ranked within their length on Spark.

Results: one row per piece. A null text is empty (one piece, the end token). Texts of more
than ``capacity`` ids are cut from the end, so that only the first piece may be shorter.
Repeated rows and equal ids are packed each. No rows give no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agora.llm import tokens
from agora.llm.common import keyed, materialize, prepared

CAPACITY = 1024
END = 2
#: Steps of the multiplicative weights at least, and at most for each length; between them they go on until
#: every length is covered.
LEAST_STEPS, STEPS = 64, 4
RATE = 0.5
#: Pieces of one length that are ranked in one part, about.
RANKED = 1 << 18

Filling = tuple[tuple[int, int], ...]  # (length, how many)


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int | None = END,
           with_ids: bool = False) -> DataFrame:
    """_row, doc_id, piece, start, length, ids_crc32 (and ``ids``, little-endian 32-bit)."""
    spark = docs.sparkSession
    prepared(spark)
    shared = tokens.share(spark, path)
    rows = keyed(docs, "doc_id", "text")
    tail = [] if end is None else [end]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = tokens.codec(shared)
        for batch in batches:
            out: dict[str, list] = {c: [] for c in schema.names}
            for row, doc, text in zip(*(batch.column(c).to_pylist() for c in ("_row", "doc_id", "text"))):
                ids = np.array(codec.encode(text or "") + tail, "<u4").tobytes()
                n = len(ids) // 4
                first = n if n <= capacity else n % capacity or capacity
                edges = [0, *range(first, n + 1, capacity)]
                for i, (a, b) in enumerate(zip(edges, edges[1:])):
                    part = ids[4 * a:4 * b]
                    for c, v in zip(out, (row, doc, i, a, b - a, zlib.crc32(part), part)):
                        out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, schema)

    names = "_row long, doc_id long, piece int, start long, length long, ids_crc32 long"
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    schema = pa.schema([*zip([x.split()[0] for x in names.split(", ")], kinds),
                        *([("ids", pa.binary())] if with_ids else [])])
    return rows.mapInArrow(cut, names + ", ids binary" * with_ids)


def priced(value: np.ndarray, capacity: int) -> Filling:
    """Knapsack dynamic program: the filling of largest value (``value`` by length from 0)."""
    best, item = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        total = value[1:c + 1] + best[c - 1::-1][:c]
        s = int(total.argmax())
        if total[s] > best[c - 1]:
            best[c], item[c] = total[s], s + 1
        else:
            best[c] = best[c - 1]
    found, c = Counter(), capacity
    while c > 0:
        if item[c]:
            found[int(item[c])] += 1
            c -= int(item[c])
        else:
            c -= 1
    return tuple(sorted(found.items()))


def relaxed(demand: np.ndarray, capacity: int) -> dict[Filling, float]:
    """Fractional solution of the configuration program by multiplicative weights: each step
    takes the best filling as often as its scarcest length is asked for, and lowers the
    weights of what it covers. Covers every length it can, up to a common factor."""
    size = np.arange(len(demand)) / capacity
    live = demand > 0
    # a long piece has fewer fillings to go into, so its first weight is above its share of room
    first = np.where(live, size * (1 + size), 0)
    covered = np.zeros(len(demand))
    x: dict[Filling, float] = {}
    for step in range(max(LEAST_STEPS, STEPS * int(live.sum())) if live.any() else 0):
        if step >= LEAST_STEPS and (covered[live] > 0).all():
            break
        filling = priced(first * np.exp(-RATE * covered), capacity)
        times = min(demand[s] / k for s, k in filling)
        x[filling] = x.get(filling, 0) + times
        for s, k in filling:
            covered[s] += times * k / demand[s]
    # no length more often than asked for
    return {f: n / max(covered[s] for s, _ in f) for f, n in x.items()}


def widest(left: np.ndarray, room: int) -> Filling:
    """The lengths, no more often than left, whose sum is the largest up to ``room``; longest first."""
    full = (1 << (room + 1)) - 1
    reach, seen = 1, []
    for s in range(min(room, len(left) - 1), 0, -1):
        for _ in range(min(int(left[s]), room // s)):
            grown = (reach | reach << s) & full
            if grown == reach:
                break
            seen.append((s, reach))
            reach = grown
        if reach >> room & 1:
            break
    at, found = reach.bit_length() - 1, Counter()
    for s, before in reversed(seen):
        if not before >> at & 1:
            found[s] += 1
            at -= s
    return tuple(found.items())


def _rounded(histogram: dict[int, int], capacity: int, x: dict[Filling, float]) -> list[tuple[Filling, int]]:
    left = np.zeros(capacity + 1, np.int64)
    for s, n in histogram.items():
        left[s] = n
    out: list[tuple[Filling, int]] = []

    def take(filling: Filling, times: int) -> None:
        times = min([times, *(int(left[s]) // k for s, k in filling)])
        if times > 0:
            out.append((filling, times))
            for s, k in filling:
                left[s] -= times * k

    take(((capacity, 1),), int(left[capacity]))
    for filling, n in x.items():
        take(filling, int(n))
    while left.any():
        top = int(np.flatnonzero(left)[-1])
        left[top] -= 1
        rest = Counter(dict(widest(left, capacity - top)))
        left[top] += 1
        rest[top] += 1
        take(tuple(sorted(rest.items())), int(left[top]))
    return out


def solve(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Filling, int]]:
    """(filling, number of sequences) that hold exactly the pieces of the histogram: the relaxed
    solution rounded down wholly, by half, and by all; the one with fewest sequences."""
    demand = np.array([histogram.get(s, 0) if s < capacity else 0 for s in range(capacity + 1)], float)
    least = -(-sum(s * n for s, n in histogram.items()) // capacity)
    x, best = relaxed(demand, capacity), None
    for share in (1, 0.5, 0):
        plan = _rounded(histogram, capacity, {f: n * share for f, n in x.items()})
        if best is None or sum(n for _, n in plan) < sum(n for _, n in best):
            best = plan
        if sum(n for _, n in best) == least:
            break
    return best


def slots(plan: list[tuple[Filling, int]]) -> dict[int, np.ndarray]:
    """For each length the runs of its places, in order: rank of the first, places in a sequence, number
    of the first sequence, offset of the first place. A run covers its sequences one after the other."""
    runs: dict[int, list] = {}
    have, sequence = Counter(), 0
    for filling, times in plan:
        offset = 0
        for s, k in filling:
            runs.setdefault(s, []).append((have[s], k, sequence, offset))
            have[s] += times * k
            offset += s * k
        sequence += times
    return {s: np.array(r, np.int64) for s, r in runs.items()}


def pack(sized: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows with ``_row``, ``piece`` and ``length``; ``sized`` must be
    materialized, as its rows are counted first and dealt then."""
    histogram = {r["length"]: r["n"] for r in
                 sized.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    places = slots(solve(histogram, capacity))
    salts = max(1, -(-max(histogram.values(), default=0) // RANKED))
    salted = sized.withColumn("_salt", F.pmod(F.xxhash64("_row", "piece"), F.lit(salts)).cast("int"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = (salted.groupBy("length", "_salt").agg(F.count("*").alias("n"))
             .select("length", "_salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base")))
    nth = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("_row", "piece"))
    ranked = (salted.withColumn("_nth", nth).join(bases, ["length", "_salt"])
              .withColumn("_rank", F.col("_base") + F.col("_nth") - 1).drop("_salt", "_nth", "_base")
              .select(*sized.columns, "_rank"))

    columns = sized.columns

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for s in np.unique(length):
                at, runs = np.flatnonzero(length == s), places[int(s)]
                run = runs[np.searchsorted(runs[:, 0], rank[at], side="right") - 1]
                nth = rank[at] - run[:, 0]
                sequence[at] = run[:, 2] + nth // run[:, 1]
                offset[at] = run[:, 3] + nth % run[:, 1] * s
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(sequence), pa.array(offset)],
                [*columns, "sequence_id", "offset"])

    return ranked.mapInArrow(deal, sized.schema.add("sequence_id", "long").add("offset", "long"))


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY,
                   end: int | None = END) -> DataFrame:
    """One row per piece of every document: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(materialize(pieces(docs, path, capacity, end), "pieces"), capacity).drop("_row")
