"""Near-duplicate vectors by a robust-pruned flat graph.

Equal vectors are one node. Centroids fitted on a bounded sample cut the nodes into
shards; every node joins its ``OVERLAP`` nearest, so shards overlap. A shard of more than ``CROWD``
nodes is dealt over tiles of pairs of its parts, so that no task holds more than about twice ``PART``.
A group of near copies may have many centroids, more than a node joins shards of: the nodes nearest
to two centroids whose shards may hold links with each other (``near_cells``) also meet in tiles, in
bundles of about ``PART``.

1. *Build.* In each shard every node keeps, of its nearest candidates and some spread over the
   shard, those that no kept one is closer to (robust pruning, at most ``DEGREE``).
2. *Union.* A node's lists from all its shards become one.
3. *Search.* In each shard and tile of bundles (the latter also by lists of its own) every node is a query: a greedy search with a beam of ``BEAM`` runs from
   the shard's medoids (and the query's own place in the graph); then the range grows from
   all nodes found within it, along the graph, until nothing new lies in range.
4. *Verify.* The cosine of what was found is computed in double precision.

A pair counts in the first shard or tile that both share, so links are counted without listing pairs; a
task emits a count and one link to the component in its shard for each node. ``audit`` counts the
links of ``AUDIT`` nodes by brute force.

Results: one row per input row. A null vector, or one that is zero or holds null or non-finite
components, links with nothing (n_links 0, its own component). Vectors of different
lengths never link. Repeated rows are vectors of their own, which link. A null vec_id
is never a component's id unless it stands alone. No rows give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agora.llm.common import keyed, materialize, prepared
from agora.llm.components import components

COSINE = 0.9
#: Nodes in a shard on average, shards of a node, and the most shards.
SHARD, OVERLAP, SHARDS = 800, 4, 1 << 15
#: Nodes (expected) that centroids are fitted on, and rounds of that.
SAMPLE, ROUNDS = 20_000, 4
CROWD, PART = 2048, 512
DEGREE, NEAR, SPREAD, ALPHA = 24, 48, 16, 1.2
BEAM, MEDOIDS = 32, 16
#: Nodes whose links are counted by brute force (expected).
AUDIT = 64
#: Slack for the single-precision search.
_SLACK = 1e-5


def usable(x: Column) -> Column:
    """Neither null nor zero, all components finite."""
    finite = F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < float("inf")) & ~F.isnan(v))
    return x.isNotNull() & finite & F.exists(x, lambda v: v != 0)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # neither overflow nor underflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def centroids(x: np.ndarray, k: int) -> np.ndarray:
    x = x.astype(np.float32)
    found = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)]
    for _ in range(ROUNDS):
        own = np.concatenate([(x[i:i + 4096] @ found.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(found)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        found = np.where(size > 0, sums / np.where(size > 0, size, 1), found)
    return found


def near_cells(x: np.ndarray, centers: np.ndarray, cosine: float) -> list[np.ndarray]:
    """For each centroid the others whose nearest nodes may link with its own: centroids in the link radius
    of each other, or the cosines of such nodes (of mean and spread as in the sample ``x``) reach it."""
    x = x.astype(np.float32)
    own = np.concatenate([(x[i:i + 4096] @ centers.T).argmax(axis=1) for i in range(0, len(x), 4096)])
    sums = np.zeros_like(centers)
    np.add.at(sums, own, x)
    count = np.bincount(own, minlength=len(centers))
    rho = np.where(count > 0, np.linalg.norm(sums, axis=1) / np.maximum(count, 1), 1).clip(0, 1)
    loose, out = 1 - rho * rho, []
    for lo in range(0, len(centers), 512):
        r, f = rho[lo:lo + 512, None], loose[lo:lo + 512, None]
        cos = (centers[lo:lo + 512] @ centers.T).clip(-1, 1)
        apart = 1 - cos * cos
        var = (f * loose + apart * (r * r * loose + rho * rho * f)) / max(x.shape[1] - 1, 1)
        near = (cos >= cosine - _SLACK) | (cos * r * rho + 3 * np.sqrt(var) >= cosine)
        near[np.arange(len(near)), lo + np.arange(len(near))] = False
        out += [np.flatnonzero(row) for row in near]
    return out


def bundles(near: list[np.ndarray], sizes: dict[int, int]) -> tuple[dict[int, int], dict[int, int], set[tuple[int, int]]]:
    """Cells with near others in bundles of ``PART`` nodes (a larger cell stands alone): the bundle of each
    such cell, the nodes of each bundle, and the pairs of bundles (both ways) that hold near cells."""
    of: dict[int, int] = {}
    held: dict[int, int] = {}
    seen: set[int] = set()
    for first in range(len(near)):
        if first in seen or not sizes.get(first) or not len(near[first]):
            continue
        queue, at = [first], None  # neighbours in one bundle where they fit
        seen.add(first)
        for cell in queue:
            if at is None or held[at] + sizes[cell] > PART:
                at = len(held)
                held[at] = 0
            of[cell] = at
            held[at] += sizes[cell]
            new = [c for c in near[cell].tolist() if c not in seen and sizes.get(c)]
            seen.update(new)
            queue += new
    pairs = {(of[a], b) for a in of for b in {of[c] for c in near[a].tolist() if c in of}}
    return of, held, pairs


def pruned(x: np.ndarray) -> list[np.ndarray]:
    """Neighbour lists of the rows of ``x`` (unit, single precision)."""
    m = len(x)
    out: list[np.ndarray] = []
    spread = np.unique(np.linspace(0, m - 1, min(SPREAD, m)).astype(int))
    for lo in range(0, m, 512):
        rows = np.arange(lo, min(lo + 512, m))
        near = x[rows] @ x.T
        near[np.arange(len(rows)), rows] = -2
        k = min(NEAR, m - 1)
        cand = np.argpartition(-near, k - 1, axis=1)[:, :k] if k else np.empty((len(rows), 0), int)
        cand = np.hstack([cand, np.broadcast_to(spread, (len(rows), len(spread)))])
        sim = np.take_along_axis(near, cand, axis=1)
        alive = sim > -2
        at = np.arange(len(rows))
        kept = np.full((len(rows), DEGREE), -1)
        for d in range(DEGREE):
            best = np.where(alive, sim, -3).argmax(axis=1)
            some = alive[at, best]
            if not some.any():
                break
            chosen = cand[at, best]
            kept[some, d] = chosen[some]
            # a candidate goes if the chosen one is closer to it, by ALPHA, than the node is
            among = np.einsum("rcd,rd->rc", x[cand], x[chosen])
            alive &= ~(ALPHA * (1 - among) <= 1 - sim) | ~some[:, None]
            alive[at, best] = False
            alive &= ~((cand == chosen[:, None]) & some[:, None])
        out += [r[r >= 0] for r in kept]
    return out


def _graph(lists: list[np.ndarray], m: int) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours with both directions: where each node's begin, and all of them."""
    a = np.repeat(np.arange(m), [len(r) for r in lists])
    b = np.concatenate(lists).astype(int) if m else np.empty(0, int)
    code = np.unique(np.concatenate([a * m + b, b * m + a]))
    return np.searchsorted(code // m, np.arange(m + 1)), code % m


def medoids(x: np.ndarray) -> np.ndarray:
    """The node nearest to the mean, then each time the one farthest from those before."""
    first = int((x @ x.mean(axis=0)).argmax())
    found, least = [first], x @ x[first]
    while len(found) < min(MEDOIDS, len(x)):
        found.append(int(least.argmin()))
        least = np.maximum(least, x @ x[found[-1]])
    return np.unique(found)


def in_range(x: np.ndarray, graph: tuple[np.ndarray, np.ndarray], cosine: float) -> np.ndarray:
    """found[q, r]: r was found within ``cosine`` (less the slack) of q."""
    m = len(x)
    seen, found = np.zeros((m, m), bool), np.zeros((m, m), bool)
    at = np.arange(m)

    def visit(q: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        code = q * m + r
        code = np.unique(code[~seen.ravel()[code]])
        q, r = code // m, code % m
        seen[q, r] = True
        sim = np.concatenate([np.einsum("nd,nd->n", x[q[i:i + 65536]], x[r[i:i + 65536]])
                              for i in range(0, len(q), 65536)]) if len(q) else np.empty(0, np.float32)
        near = sim >= cosine - _SLACK
        found[q[near], r[near]] = True
        return q, r, sim

    start = medoids(x)
    beam_node = np.full((m, BEAM), -1)
    beam_sim = np.full((m, BEAM), -2.0, np.float32)
    opened = np.ones((m, BEAM), bool)

    def merge(q: np.ndarray, r: np.ndarray, sim: np.ndarray) -> None:
        nonlocal beam_node, beam_sim, opened
        if not len(q):
            return
        order = np.lexsort((-sim, q))
        q, r, sim = q[order], r[order], sim[order]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        q, r, sim, nth = (v[nth < BEAM] for v in (q, r, sim, nth))
        new_node, new_sim = np.full((m, BEAM), -1), np.full((m, BEAM), -2.0, np.float32)
        new_node[q, nth], new_sim[q, nth] = r, sim
        node, s = np.hstack([beam_node, new_node]), np.hstack([beam_sim, new_sim])
        done = np.hstack([opened, new_node < 0])
        best = np.argsort(-s, axis=1, kind="stable")[:, :BEAM]
        beam_node, beam_sim, opened = (np.take_along_axis(v, best, axis=1) for v in (node, s, done))

    def neighbours(q: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin, to = graph
        n = begin[r + 1] - begin[r]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[r], n)
        return np.repeat(q, n), to[place]

    merge(*visit(*(np.concatenate([a, b]) for a, b in
                   zip((np.repeat(at, len(start)), np.tile(start, m)), (at, at)))))
    while True:  # greedy: each query opens the best place of its beam not opened yet
        best = np.where(opened, -3, beam_sim).argmax(axis=1)
        live = np.flatnonzero(~opened[at, best])
        if not len(live):
            break
        node = beam_node[live, best[live]]
        opened[live, best[live]] = True
        merge(*visit(*neighbours(live, node)))
    front = np.nonzero(found)
    while len(front[0]):  # the range grows from all that lies in it
        grown = []
        for lo in range(0, len(front[0]), 65536):
            q, r, sim = visit(*neighbours(front[0][lo:lo + 65536], front[1][lo:lo + 65536]))
            near = sim >= cosine - _SLACK
            grown.append((q[near], r[near]))
        front = tuple(np.concatenate(v) for v in zip(*grown))
    return found | found.T


def _shards(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroids of each row, and the nearest one."""
    k = min(OVERLAP, len(centers))
    near = x.astype(np.float32) @ centers.T
    return np.sort(np.argpartition(-near, k - 1, axis=1)[:, :k], axis=1), near.argmax(axis=1)


def _earlier(tiles: list[list[int]], tile: int) -> np.ndarray | None:
    """[a, b]: rows a and b share a tile that comes before ``tile`` (None: no two rows do)."""
    row = np.repeat(np.arange(len(tiles)), [len(t) for t in tiles])
    ids = np.array([i for t in tiles for i in t], np.int64)
    row, ids = row[ids < tile], ids[ids < tile]
    _, at, n = np.unique(ids, return_inverse=True, return_counts=True)
    column = np.cumsum(n > 1) - 1
    row, at = row[n[at] > 1], column[at[n[at] > 1]]
    if not len(row):
        return None
    both = np.zeros((len(tiles), len(tiles)), bool)
    for lo in range(0, int(at.max()) + 1, 256):
        some = (at >= lo) & (at < lo + 256)
        held = np.zeros((len(tiles), 256), np.float32)
        held[row[some], at[some] - lo] = 1
        both |= held @ held.T > 0
    return both


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64)


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept, audit_links (links by brute force of audited nodes)."""
    spark = vectors.sparkSession
    prepared(spark)
    rows = keyed(vectors, "vec_id", "embedding")
    good = rows.where(usable(F.col("embedding")))
    nodes = materialize(
        good.groupBy("embedding").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"))
        .select(F.monotonically_increasing_id().alias("node"), "embedding", "copies", "first",
                F.size("embedding").alias("width")), "vectors")
    total = nodes.count()
    shards = max(1, min(SHARDS, -(-total * OVERLAP // SHARD)))
    scale = 1 << 30
    drawn = nodes.where(F.pmod(F.xxhash64("embedding"), F.lit(scale)) < min(scale, scale * SAMPLE // max(total, 1)))
    centers: dict[int, np.ndarray] = {}
    near: dict[int, list[np.ndarray]] = {}
    by_width: dict[int, list] = {}
    for r in drawn.select("width", "embedding").collect():  # SAMPLE rows, expected
        by_width.setdefault(r["width"], []).append(r["embedding"])
    for width, xs in by_width.items():
        x = _unit(np.array(sorted(xs)))
        centers[width] = centroids(x, shards)
        near[width] = near_cells(x, centers[width], cosine)
    shared = spark.sparkContext.broadcast(centers)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = batch.column("width").to_numpy()
            lists: list = [None] * batch.num_rows
            homes = np.zeros(batch.num_rows, np.int64)
            for w in np.unique(width):
                at = np.flatnonzero(width == w)
                own = shared.value.get(int(w))
                found, home = _shards(_unit(_matrix(batch.column("embedding").take(pa.array(at)))), own) \
                    if own is not None else (np.zeros((len(at), 1), int), 0)
                homes[at] = int(w) * SHARDS + home
                for i, f in zip(at.tolist(), found.tolist()):
                    lists[i] = [int(w) * SHARDS + c for c in f]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("embedding"), batch.column("copies"),
                 pa.array(lists, pa.list_(pa.int64())), pa.array(homes)],
                ["node", "embedding", "copies", "shards", "home"])

    kind = nodes.schema["embedding"].dataType.simpleString()
    placed = materialize(nodes.mapInArrow(
        place, f"node long, embedding {kind}, copies long, shards array<long>, home long"), "vectors")
    one = placed.select("node", F.explode("shards").alias("shard"))
    crowds = one.groupBy("shard").agg(F.count("*").alias("n")).where(f"n > {CROWD}").select(
        "shard", F.ceil(F.col("n") / PART).cast("long").alias("parts"))
    # a tile is shard, part, part; a node's tiles are all those of its part
    own = F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1)))
    tiled = (one.join(crowds, "shard", "left").withColumn("own", own)
             .withColumn("other", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(
                 F.array_remove(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), F.col("own")))))
             .withColumn("tile", F.xxhash64("shard", F.least("own", "other"), F.greatest("own", "other"))))
    tiled = tiled.select("node", "tile", F.lit(False).alias("met"))
    if any(len(c) for cells in near.values() for c in cells):
        tiled = tiled.unionByName(_met(placed, near).withColumn("met", F.lit(True)))
    lists = tiled.groupBy("node").agg(F.sort_array(F.collect_set("tile")).alias("tiles"),
                                      F.collect_set(F.when(~F.col("met"), F.col("tile"))).alias("built"))
    member = materialize(placed.select("node", "embedding", "copies").join(lists, "node"), "vectors")

    def build(table):
        node = table.column("node").to_numpy()
        order = np.argsort(node)
        node, x = node[order], _unit(_matrix(table.column("embedding")))[order].astype(np.float32)
        near = [node[r].tolist() for r in pruned(x)] if len(node) > 1 else [[]] * len(node)
        return pa.table({"node": pa.array(node), "near": pa.array(near, pa.list_(pa.int64()))})

    dealt = member.withColumn("tile", F.explode("built"))
    edges = (dealt.select("tile", "node", "embedding").groupBy("tile")
             .applyInArrow(build, "node long, near array<long>"))
    union = edges.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    ready = materialize(member.join(union, "node"), "vectors").withColumn("tile", F.explode("tiles")).withColumn(
        "met", ~F.array_contains("built", F.col("tile"))).drop("built")

    def search(key, table):
        node = table.column("node").to_numpy()
        order = np.argsort(node)
        table, node, tile = table.take(pa.array(order)), node[order], key[0].as_py()
        exact = _unit(_matrix(table.column("embedding")))
        lists = []
        for r in table.column("near").to_pylist():
            r = np.array(r, np.int64)
            at = np.searchsorted(node, r)
            at = at[at < len(node)] if len(at) and at.max() >= len(node) else at
            lists.append(at[np.isin(node[at], r)] if len(at) else at)
        x = exact.astype(np.float32)
        if len(node) > 1 and table.column("met")[0].as_py():  # no graph was built there before
            lists = [np.union1d(a, b).astype(int) for a, b in zip(lists, pruned(x))]
        q, r = np.nonzero(in_range(x, _graph(lists, len(node)), cosine))
        sure = np.concatenate([np.einsum("nd,nd->n", exact[q[i:i + 65536]], exact[r[i:i + 65536]]) >= cosine
                               for i in range(0, len(q), 65536)]) if len(q) else np.empty(0, bool)
        sure &= q != r
        q, r = q[sure], r[sure]
        # the first tile in both lists owns the pair
        before = _earlier(table.column("tiles").to_pylist(), tile)
        links = np.zeros(len(node), np.int64)
        copies = table.column("copies").to_numpy()
        first = ~before[q, r] if before is not None else np.ones(len(q), bool)
        np.add.at(links, q[first], copies[r[first]])
        label = np.arange(len(node))
        while True:
            low = label.copy()
            np.minimum.at(low, q, label[r])
            low = low[low]
            if (low == label).all():
                break
            label = low
        return pa.table({"node": pa.array(node), "links": pa.array(links), "to": pa.array(node[label])})

    found = materialize(ready.groupBy("tile").applyInArrow(search, "node long, links long, to long"), "vectors")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(found.select("node", "to"), "node", "to")
    named = (nodes.select("node", "embedding", "copies", "first").join(links, "node", "left")
             .join(classes.withColumnRenamed("id", "node"), "node", "left")
             .withColumn("component", F.coalesce("component", "node")))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    told = (named.join(least, "component").join(_audited(nodes, total, cosine), "node", "left")
            .select("embedding", "component_id", "audit",
                    (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")))
    linked = good.join(told, "embedding").select("vec_id", "links", "component_id", "audit")
    alone = rows.where(~usable(F.col("embedding"))).select(
        "vec_id", F.lit(0).cast("long").alias("links"), F.col("vec_id").alias("component_id"),
        F.lit(None).cast("long").alias("audit"))
    return linked.unionByName(alone).select(
        "vec_id", F.col("links").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept"),
        F.col("audit").alias("audit_links"))


def _met(placed: DataFrame, near: dict[int, list[np.ndarray]]) -> DataFrame:
    """node, tile: the tiles of pairs of bundles."""
    spark = placed.sparkSession
    sizes: dict[int, dict[int, int]] = {}
    for r in placed.groupBy("home").agg(F.count("*").alias("n")).collect():  # SHARDS rows a width at most
        sizes.setdefault(r["home"] // SHARDS, {})[r["home"] % SHARDS] = r["n"]
    cells, meet = [], []
    for width, lists in near.items():
        of, held, pairs = bundles(lists, sizes.get(width, {}))
        parts = {b: -(-n // PART) for b, n in held.items()}
        cells += [(width * SHARDS + c, width * SHARDS + b, parts[b]) for c, b in of.items()]
        meet += [(width * SHARDS + a, width * SHARDS + b, parts[b]) for a, b in pairs]
    homes = spark.createDataFrame(cells, "home long, bundle long, parts long")
    others = spark.createDataFrame(meet, "bundle long, other long, others long")
    here = F.struct(F.col("bundle").alias("b"), F.pmod(F.xxhash64("node", F.lit("part")), "parts").alias("p"))
    return (placed.select("node", "home").join(homes, "home").withColumn("here", here).join(others, "bundle")
            .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1)))
            .withColumn("there", F.struct(F.col("other").alias("b"), F.col("part").alias("p")))
            .select("node", F.xxhash64(F.least("here", "there"), F.greatest("here", "there")).alias("tile")))


def _audited(nodes: DataFrame, total: int, cosine: float) -> DataFrame:
    """node, audit: the links of some nodes, counted against all by brute force."""
    scale = 1 << 30
    few = nodes.where(F.pmod(F.xxhash64("embedding", F.lit("audit")), F.lit(scale))
                      < min(scale, scale * AUDIT // max(total, 1)))
    asked = {}
    for r in few.select("node", "embedding", "copies", "width").collect():  # AUDIT rows, expected
        asked.setdefault(r["width"], []).append((r["node"], r["embedding"], r["copies"]))
    queries = {w: (np.array([a[0] for a in rows]), _unit(np.array([a[1] for a in rows])),
                   np.array([a[2] for a in rows])) for w, rows in asked.items()}
    shared = nodes.sparkSession.sparkContext.broadcast(queries)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = batch.column("width").to_numpy()
            for w, (node, x, _) in shared.value.items():
                at = np.flatnonzero(width == w)
                if not len(at):
                    continue
                part = batch.take(pa.array(at))
                near = _unit(_matrix(part.column("embedding"))) @ x.T >= cosine
                near[part.column("node").to_numpy()[:, None] == node[None, :]] = False
                sums = (near * part.column("copies").to_numpy()[:, None]).sum(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(sums)], ["node", "audit"])

    sums = nodes.select("node", "embedding", "copies", "width").mapInArrow(count, "node long, audit long")
    copies = nodes.select("node", "copies")
    return (sums.groupBy("node").agg(F.sum("audit").alias("audit")).join(copies, "node")
            .select("node", (F.col("audit") + F.col("copies") - 1).alias("audit")))
