"""The k most similar vectors of every vector: vantage-point trees per shard.

1. Vectors that cannot have neighbours (null, wrong size, zero, NaN or infinite
   parts) are dropped. Exact copies are searched once: each batch turns a group
   of copies into one row with its ``k + 1`` smallest ids before the shuffle.
   The members of larger groups get their result by a join on the vector's hash.
2. A routing vantage-point tree, fitted on a sample of bounded size, cuts the
   space into a bounded number of shards. Every vector is stored in its home
   shard. What the shards really hold is counted: one with too many vectors is
   kept in parts, one with too many visitors is searched by several tasks, so no
   task's group grows with the table.
3. As a query, a vector visits the shards the triangle inequality does not rule
   out. With a least similarity asked for, its radius is known from the start.
   Without, it searches its home shard first; the angle to the k-th best there is
   its radius for the others.
4. In a shard, vectors are indexed in a vantage-point tree with vectorised leaf
   scans and the visiting queries descend it together.

At a node with vantage point v, whose near side reaches out to a and whose far
side begins at b, a query at distance d visits the near side if d - a <= factor
* r and the far side if b - d <= factor * r, r being the radius it still searches
(the angle to its k-th best so far, or of the least similarity asked for). By
the triangle inequality factor 1 loses nothing. In many dimensions two close
vectors differ far less in their distance to a third one than the inequality
allows, so a smaller factor prunes much more and loses little. When all vectors
are queries, a pair is lost only if both directions prune it, and only at the
one node that parts it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.session import cut_lineage

#: Vectors a shard is meant to hold at most and, to keep all cores busy, at least.
SHARD_ROWS, LEAST_SHARD_ROWS = 100_000, 10_000
#: Bounds of the routing tree: its leaves, and the sampled vectors it is fitted on, in all and per leaf.
MOST_SHARDS, MOST_SAMPLED, SAMPLE_PER_LEAF = 1 << 12, 1 << 18, 256
#: Vectors one task holds as a multiple of what a shard is meant to hold; visitors it takes as a multiple of its vectors.
FULL, VISITORS = 2, 4
LEAF_ROWS = 512
#: Rounding of float32 angles near zero, in radians.
SLACK = 1e-3

#: Factors for searches without a least similarity, where the k-th neighbour is far: within a shard, and between
#: shards. Chosen for a recall above 0.9.
OPEN_FACTOR, ROUTE_FACTOR = 0.4, 0.2
#: Parts into which the members of a group of copies are spread where they are told the group's result.
MEMBER_SALTS = 16

ROUTED = "task long, kind int, uids array<string>, more boolean, h1 long, h2 long, bound float, dense array<float>"
FOUND = "uid string, h1 long, h2 long, other string, cosine double"


def _unit(rows: np.ndarray) -> np.ndarray:
    x = rows.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float32).reshape(-1, dim)


def _angles(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ v, -1.0, 1.0))


@dataclass
class Node:
    """A vantage point with its two sides, or a leaf with the rows ``begin:end`` of the ordered matrix."""

    begin: int
    end: int
    vantage: np.ndarray | None = None
    near_max: float = 0.0
    far_min: float = 0.0
    near: Node | None = None
    far: Node | None = None
    shard: int = 0
    #: Tasks that share the vectors of the shard, and tasks that share the visitors of each part.
    parts: int = 1
    salts: int = 1


def build_tree(x: np.ndarray, leaf_rows: int, seed: int = 7) -> tuple[Node, np.ndarray]:
    """The tree over the rows of ``x`` and the row order in which leaves are contiguous.

    Of a few random candidates the vantage point is the one whose distances
    spread most. Sides are halves by rank, so equal vectors cannot unbalance it.
    """
    rng = np.random.default_rng(seed)
    order = np.arange(len(x))
    root = Node(0, len(x))
    todo = [root]
    while todo:
        node = todo.pop()
        own = order[node.begin : node.end]
        if len(own) <= leaf_rows:
            continue
        probe = x[rng.choice(own, min(200, len(own)), replace=False)]
        candidates = x[rng.choice(own, min(12, len(own)), replace=False)]
        node.vantage = candidates[np.argmax(np.arccos(np.clip(probe @ candidates.T, -1, 1)).std(axis=0))]
        d = _angles(x[own], node.vantage)
        half = len(own) // 2
        by = np.argpartition(d, half)
        order[node.begin : node.end] = own[by]
        node.near_max, node.far_min = float(d[by[:half]].max()), float(d[by[half:]].min())
        node.near, node.far = Node(node.begin, node.begin + half), Node(node.begin + half, node.end)
        todo += [node.near, node.far]
    return root, order


def leaves(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        if n.near is None:
            out.append(n)
        else:
            todo += [n.far, n.near]
    return out


def home_leaf(root: Node, x: np.ndarray) -> np.ndarray:
    """The shard of the leaf each row belongs to: the side whose edge is closer."""
    out, todo = np.zeros(len(x), dtype=np.int64), [(root, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if node.near is None:
            out[rows] = node.shard
        elif len(rows):
            near = _angles(x[rows], node.vantage) <= (node.near_max + node.far_min) / 2
            todo += [(node.near, rows[near]), (node.far, rows[~near])]
    return out


def visited(root: Node, x: np.ndarray, radius: np.ndarray, factor: float) -> Iterator[tuple[Node, np.ndarray]]:
    """(leaf, rows) for all leaves the rows have to visit within the radius of each.

    Routing edges are taken at the middle of the gap: vectors outside the sample
    are stored by it.
    """
    todo = [(root, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if node.near is None:
            yield node, rows
        elif len(rows):
            d, edge, reach = _angles(x[rows], node.vantage), (node.near_max + node.far_min) / 2, factor * radius[rows] + SLACK
            todo += [(node.near, rows[d - edge <= reach]), (node.far, rows[edge - d <= reach])]


class TopK:
    """The k best (cosine, row) of every query, filled in blocks."""

    def __init__(self, n: int, k: int, least: np.ndarray):
        self.k, self.cos, self.row = k, np.full((n, k), -np.inf, dtype=np.float32), np.full((n, k), -1, dtype=np.int64)
        self.least = least

    def add(self, rows: np.ndarray, sims: np.ndarray, first: int) -> None:
        """``sims[i, j]``: similarity of query rows[i] to the indexed row first + j."""
        bar = np.maximum(self.cos[rows, -1], self.least[rows])
        some = (sims >= bar[:, None]).any(axis=1)
        if not some.any():
            return
        rows, sims = rows[some], sims[some]
        keep = min(self.k, sims.shape[1])
        at = np.argpartition(-sims, keep - 1, axis=1)[:, :keep]
        cos = np.concatenate((self.cos[rows], np.take_along_axis(sims, at, 1)), axis=1)
        row = np.concatenate((self.row[rows], at + first), axis=1)
        best = np.argsort(-cos, axis=1, kind="stable")[:, : self.k]
        self.cos[rows], self.row[rows] = np.take_along_axis(cos, best, 1), np.take_along_axis(row, best, 1)

    def radius(self, rows: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(np.maximum(self.cos[rows, -1], self.least[rows]), -1, 1))


def search(root: Node, x: np.ndarray, q: np.ndarray, k: int, factor: float, least: float | np.ndarray) -> TopK:
    """The k best rows of the ordered matrix ``x`` for every query, at least as similar as ``least``; nearest side first."""
    top = TopK(len(q), k, np.broadcast_to(np.asarray(least, dtype=np.float32), len(q)))
    todo = [(root, np.arange(len(q)), None)]
    while todo:
        node, rows, gap = todo.pop()
        if gap is not None:
            rows = rows[gap <= factor * top.radius(rows) + SLACK]
        if not len(rows):
            continue
        if node.near is None:
            for s in range(0, len(rows), 2048):
                top.add(rows[s : s + 2048], q[rows[s : s + 2048]] @ x[node.begin : node.end].T, node.begin)
            continue
        d = _angles(q[rows], node.vantage)
        near = d <= (node.near_max + node.far_min) / 2
        todo.append((node.near, rows[~near], d[~near] - node.near_max))
        todo.append((node.far, rows[near], node.far_min - d[near]))
        todo.append((node.far, rows[~near], None))
        todo.append((node.near, rows[near], None))
    return top


def usable(vectors: DataFrame, uid: str, dense: str, dim: int) -> DataFrame:
    """(uid, dense, h1, h2), without vectors that have no neighbours. h1 and h2 are 128 bits of hash of the vector."""
    x = F.col(dense)
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    fit = (F.size(x) == dim) & ~F.exists(x, bad) & F.exists(x, lambda v: v != 0)
    rows = vectors.where(F.col(uid).isNotNull() & x.isNotNull()).where(fit).select(F.col(uid).alias("uid"), x.cast("array<float>").alias("dense"))
    return rows.withColumn("h1", F.xxhash64("dense")).withColumn("h2", F.xxhash64(F.lit(1), "dense"))


def routing_tree(rows: DataFrame, dim: int, shard_rows: int = SHARD_ROWS) -> Node:
    """A tree with a leaf per shard, fitted on a bounded sample of (uid, dense).

    Shards are meant for up to ``shard_rows`` vectors, for fewer while there are
    not yet as many shards as the cluster has cores, and for more once there are
    ``MOST_SHARDS``. The sample has ``SAMPLE_PER_LEAF`` vectors per leaf, 4,096
    at least and ``MOST_SAMPLED`` at most, a fixed choice by hash; the tree that
    travels to the tasks is one vector per leaf.
    """
    n, cores = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    shards = 1
    while shards < MOST_SHARDS and (shards * shard_rows < n or (shards < cores and shards * LEAST_SHARD_ROWS < n)):
        shards *= 2
    if shards == 1:
        return Node(0, 0)
    want = min(MOST_SAMPLED, max(4096, shards * SAMPLE_PER_LEAF))
    share = int(min(1.0, 1.2 * want / n) * (1 << 40)) + 1
    taken = rows.where(F.pmod(F.xxhash64("uid"), F.lit(1 << 40)) < share).select("dense").limit(2 * want).toArrow()
    x = _unit(_matrix(taken.column("dense").combine_chunks(), dim))
    root, _ = build_tree(x, max(1, -(-len(x) // shards)))
    for i, leaf in enumerate(leaves(root)):
        leaf.shard = i
    return root


def balance(root: Node, loads: DataFrame, shard_rows: int) -> None:
    """Sets the parts and salts of the leaves by (shard, stored, visits), counted over all rows; one row per shard comes to the driver."""
    by = {r.shard: (r.stored, r.visits) for r in loads.groupBy("shard").agg(F.sum("stored").alias("stored"), F.sum("visits").alias("visits")).collect()}
    for leaf in leaves(root):
        stored, visits = by.get(leaf.shard, (0, 0))
        leaf.parts = max(1, -(-stored // (FULL * shard_rows)))
        leaf.salts = max(1, -(-visits // (VISITORS * max(1, stored // leaf.parts, LEAST_SHARD_ROWS))))


def _groups(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): rows ordered so that equal hashes are adjacent, and where each group starts."""
    order = np.lexsort((h2, h1))
    new = np.concatenate(([True], (np.diff(h1[order]) != 0) | (np.diff(h2[order]) != 0)))
    return order, np.flatnonzero(new)


def _distinct_copies(b: pa.RecordBatch, dim: int, k: int) -> tuple:
    """The distinct vectors of a batch of (uid, dense, h1, h2, asks): (unit rows, batch rows, ids, more than k + 1 ids, who asks)."""
    names, h1, h2, asking = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3, 4))
    order, starts = _groups(h1, h2)
    first = order[starts]
    ask = np.maximum.reduceat(asking[order].astype(np.int32), starts)
    # copies of a vector become one row with the smallest ids, so a hot group is one row per batch
    lists, many = [[names[i]] for i in first], np.zeros(len(first), dtype=bool)
    for g in np.flatnonzero(np.diff(np.append(starts, len(order))) > 1):
        ids = sorted(set(names[order[starts[g] : starts[g + 1] if g + 1 < len(starts) else None]]))
        lists[g], many[g] = ids[: k + 1], len(ids) > k + 1
    return _unit(_matrix(b.column(1).take(pa.array(first)), dim)), first, pa.array(lists, pa.list_(pa.string())), many, ask


def _task(shard: np.ndarray, part: np.ndarray | int, salt: np.ndarray | int) -> np.ndarray:
    return shard << 32 | part << 16 | salt


def _stored_at(root: Node, home: np.ndarray, h1: np.ndarray, h2: np.ndarray, ask: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, tasks, kinds): a vector is stored with every task of its part, and asks one of them and one of each other part."""
    own = {leaf.shard: leaf for leaf in leaves(root)}
    parts, salts = (np.array([getattr(own[s], what) for s in range(len(own))], dtype=np.int64) for what in ("parts", "salts"))
    part, mine = np.abs(h2) % parts[home], np.abs(h1) % salts[home]
    out, every = [], np.arange(len(home))
    for salt in range(int(salts[home].max())):
        r = every[salts[home] > salt]
        out.append((r, _task(home[r], part[r], salt), 1 + 2 * (ask[r] & (mine[r] == salt))))
    for other in range(int(parts[home].max()) if (parts[home] > 1).any() else 0):
        r = every[(parts[home] > other) & (part != other) & (ask > 0)]
        out.append((r, _task(home[r], other, mine[r]), np.full(len(r), 2)))
    return out


def _visits_at(leaf: Node, rows: np.ndarray, h1: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for part in range(leaf.parts):
        yield rows, _task(np.full(len(rows), leaf.shard, dtype=np.int64), part, np.abs(h1[rows]) % leaf.salts), np.full(len(rows), 2)


def _routed(parts: list[tuple], uids: pa.Array, more: np.ndarray, h1: np.ndarray, h2: np.ndarray, bound: np.ndarray, dense: pa.Array) -> pa.RecordBatch:
    take, task, kind = (np.concatenate([p[i] for p in parts]) for i in range(3))
    at = pa.array(take)
    return pa.RecordBatch.from_arrays(
        [pa.array(task.astype(np.int64)), pa.array(kind.astype(np.int32)), uids.take(at), pa.array(more[take]), pa.array(h1[take]), pa.array(h2[take]), pa.array(bound[take].astype(np.float32)), dense.take(at)],
        names=[x.split()[0] for x in ROUTED.split(", ")],
    )


def _search_task(table: pa.Table, dim: int, k: int, factor: float, least_cosine: float, tell_radius: bool) -> pa.Table:
    """The results of one task's queries; with ``tell_radius`` also the queries themselves, with what they know of their radius."""
    kind, h1, h2, more, bound = (table.column(c).to_numpy() for c in ("kind", "h1", "h2", "more", "bound"))
    order, starts = _groups(h1, h2)
    first = order[starts]
    kind, more, bound = np.bitwise_or.reduceat(kind[order], starts), np.maximum.reduceat(more[order], starts), np.maximum.reduceat(bound[order], starts)
    uids = table.column("uids").combine_chunks()
    lists = uids.take(pa.array(first)).to_pylist()
    for g in np.flatnonzero(np.diff(np.append(starts, len(order))) > 1):
        ids = sorted({u for one in uids.take(pa.array(order[starts[g] : starts[g + 1] if g + 1 < len(starts) else None])).to_pylist() for u in one})
        lists[g], more[g] = ids[: k + 1], more[g] or len(ids) > k + 1
    dense = table.column("dense").combine_chunks().take(pa.array(first))
    raw = _matrix(dense, dim)
    x, stored, asked = _unit(raw), np.flatnonzero(kind & 1), np.flatnonzero(kind & 2)
    out: list[tuple] = []
    radius = np.full(len(first), np.float32(-1.0))
    if len(stored) and len(asked):
        tree, by = build_tree(x[stored], LEAF_ROWS)
        # float32 products err by about 1e-6; the exact check below decides
        top = search(tree, np.ascontiguousarray(x[stored[by]]), x[asked], k + 1, factor, np.maximum(bound[asked], least_cosine) - 1e-5)
        radius[asked] = np.where(top.row[:, -1] >= 0, top.cos[:, -1], -1.0)
        q, j = np.nonzero(top.row >= 0)
        a, b = asked[q], stored[by[top.row[q, j]]]
        u, v = raw[a].astype(np.float64), raw[b].astype(np.float64)
        cosine = (u * v).sum(axis=1) / np.sqrt((u * u).sum(axis=1) * (v * v).sum(axis=1))
        cosine[a == b] = 1.0
        good = (cosine >= least_cosine) & ((a != b) | more[a] | (np.array([len(x) for x in lists])[a] > 1))
        near: dict[int, list[tuple[float, str]]] = {}
        for g, o, c in zip(a[good].tolist(), b[good].tolist(), cosine[good].tolist()):
            near.setdefault(g, []).extend((-c, o_id) for o_id in lists[o])
        for g, own in near.items():
            own.sort()
            if more[g]:
                out += [(None, int(h1[first[g]]), int(h2[first[g]]), o_id, -c) for c, o_id in own[: k + 1]]
            else:
                out += [(me, int(h1[first[g]]), None, o_id, -c) for me in lists[g] for c, o_id in own[: k + len(lists[g])] if me != o_id]
    columns = list(zip(*out)) if out else [()] * 5
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.float64())
    found = pa.table({n: pa.array(list(c), t) for n, c, t in zip(("uid", "h1", "h2", "other", "cosine"), columns, kinds)})
    if not tell_radius:
        return found
    own = np.flatnonzero(kind == 3)  # those that are at home in this task
    queries = pa.table({"h1": pa.array(h1[first[own]]), "h2": pa.array(h2[first[own]]), "uids": pa.array([lists[g] for g in own], pa.list_(pa.string())), "more": pa.array(more[own].astype(bool)), "bound": pa.array(radius[own]), "dense": dense.take(pa.array(own))})
    columns = [x.split()[0] for x in (FOUND + ", uids array<string>, more boolean, bound float, dense array<float>").split(", ")]
    return pa.concat_tables([found, queries], promote_options="default").select(columns)


def nearest_neighbours(
    vectors: DataFrame,
    uid: str,
    dense: str,
    dim: int = 64,
    k: int = 10,
    factor: float = 0.35,
    least_cosine: float = -1.0,
    asks: Callable[[Column], Column] | None = None,
    shard_rows: int = SHARD_ROWS,
    route_factor: float = ROUTE_FACTOR,
) -> DataFrame:
    """(uid, other, cosine): the ``k`` most similar other vectors of every vector.

    ``least_cosine`` asks only for neighbours at least that similar, which also
    bounds the search radius from the start; ``factor`` then relaxes the routing
    too. Without it the shards to visit follow from the home shard's result,
    relaxed by ``route_factor``. ``asks``, a condition on the id, restricts who
    asks, not who is found. Ties go to the smaller id. A vector without usable
    parts neither asks nor is found; repeated rows count once. Empty tables give
    no rows.
    """
    asking = F.lit(True) if asks is None else asks(F.col("uid"))
    rows = usable(vectors, uid, dense, dim).withColumn("asks", asking)
    root = routing_tree(rows, dim, shard_rows)
    bounded = least_cosine > -1.0 or root.near is None
    angle = float(np.arccos(np.clip(least_cosine, -1, 1)))

    def loads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stored, visits = np.zeros((2, len(leaves(root))), dtype=np.int64)
        for b in batches:
            if b.num_rows:
                x, _, _, _, ask = _distinct_copies(b, dim, k)
                home, asked = home_leaf(root, x), np.flatnonzero(ask)
                stored += np.bincount(home, minlength=len(stored))
                if bounded:
                    for leaf, r in visited(root, x[asked], np.full(len(asked), angle), factor):
                        visits[leaf.shard] += len(r)
                else:
                    visits += np.bincount(home[asked], minlength=len(stored))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(stored))), pa.array(stored), pa.array(visits)], names=["shard", "stored", "visits"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, first, lists, many, ask = _distinct_copies(b, dim, k)
            h1, h2 = (b.column(i).to_numpy()[first] for i in (2, 3))
            home = home_leaf(root, x)
            parts = _stored_at(root, home, h1, h2, ask)
            if bounded:
                asked = np.flatnonzero(ask)
                for leaf, r in visited(root, x[asked], np.full(len(asked), angle), factor):
                    parts += _visits_at(leaf, asked[r][home[asked[r]] != leaf.shard], h1)
            yield _routed(parts, lists, many, h1, h2, np.full(len(first), -1.0), b.column(1).take(pa.array(first)))

    columns = rows.select("uid", "dense", "h1", "h2", "asks")
    if root.near is not None:
        balance(root, columns.mapInArrow(loads, "shard long, stored long, visits long"), shard_rows)
    wider = FOUND + ("" if bounded else ", uids array<string>, more boolean, bound float, dense array<float>")
    found = columns.mapInArrow(route, ROUTED).groupBy("task").applyInArrow(lambda t: _search_task(t, dim, k, factor, least_cosine, not bounded), wider)
    if not bounded:
        found = _search_others(found, columns, root, dim, k, factor, route_factor, shard_rows)
    found = cut_lineage(found)  # read twice below: for known ids, and for groups of copies

    # groups of more than k + 1 copies were answered once for all, without an id: their members are told here
    known = found.where("uid IS NOT NULL").select("uid", "other", "cosine")
    place = Window.partitionBy("h1", "h2").orderBy(F.desc("cosine"), "other")
    shared = found.where("uid IS NULL").select("h1", "h2", "other", "cosine").distinct().withColumn("place", F.row_number().over(place)).where(F.col("place") <= k + 1)
    salted = shared.select("h1", "h2", "other", "cosine", F.explode(F.sequence(F.lit(0), F.lit(MEMBER_SALTS - 1))).alias("salt"))
    members = rows.where("asks").select("uid", "h1", "h2", F.pmod(F.xxhash64("uid"), F.lit(MEMBER_SALTS)).cast("int").alias("salt"))
    told = members.join(salted, ["h1", "h2", "salt"]).select("uid", "other", "cosine").where("uid <> other")
    all_found = known.unionByName(told)
    if asks is not None:
        all_found = all_found.where(asks(F.col("uid")))
    best = Window.partitionBy("uid").orderBy(F.desc("cosine"), "other")
    return all_found.distinct().withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).select("uid", "other", "cosine")


def _search_others(home: DataFrame, columns: DataFrame, root: Node, dim: int, k: int, factor: float, route_factor: float, shard_rows: int) -> DataFrame:
    """The results of the home shards with those of the other shards their queries have to visit."""
    home = cut_lineage(home)
    queries = home.where("dense IS NOT NULL").select("h1", "h2", "uids", "more", "bound", "dense")

    def away(b: pa.RecordBatch) -> tuple[np.ndarray, Iterator[tuple[Node, np.ndarray]]]:
        x = _unit(_matrix(b.column(5), dim))
        at_home = home_leaf(root, x)
        return at_home, visited(root, x, np.arccos(np.clip(b.column(4).to_numpy(), -1, 1)), route_factor)

    def loads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        visits = np.zeros(len(leaves(root)), dtype=np.int64)
        for b in batches:
            if b.num_rows:
                at_home, there = away(b)
                for leaf, r in there:
                    visits[leaf.shard] += int((at_home[r] != leaf.shard).sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(visits))), pa.array(visits)], names=["shard", "visits"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                h1, h2, bound = (b.column(i).to_numpy() for i in (0, 1, 4))
                at_home, there = away(b)
                parts = [p for leaf, r in there for p in _visits_at(leaf, r[at_home[r] != leaf.shard], h1)]
                if parts:
                    yield _routed(parts, b.column(2), b.column(3).to_numpy(zero_copy_only=False), h1, h2, bound, b.column(5))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, first, lists, many, ask = _distinct_copies(b, dim, k)
                h1, h2 = (b.column(i).to_numpy()[first] for i in (2, 3))
                yield _routed(_stored_at(root, home_leaf(root, x), h1, h2, np.zeros_like(ask)), lists, many, h1, h2, np.full(len(first), -1.0), b.column(1).take(pa.array(first)))

    for leaf in leaves(root):
        leaf.salts = 1
    counted = {r.shard: r.visits for r in queries.mapInArrow(loads, "shard long, visits long").groupBy("shard").agg(F.sum("visits").alias("visits")).collect()}
    for leaf in leaves(root):
        leaf.salts = max(1, -(-counted.get(leaf.shard, 0) // (VISITORS * shard_rows)))
    both = columns.mapInArrow(store, ROUTED).unionByName(queries.mapInArrow(route, ROUTED))
    others = both.groupBy("task").applyInArrow(lambda t: _search_task(t, dim, k, factor, -1.0, False), FOUND)
    return home.where("dense IS NULL").select("uid", "h1", "h2", "other", "cosine").unionByName(others)


def similar_pairs(vectors: DataFrame, uid: str, dense: str, dim: int = 64, least_cosine: float = 0.95, k: int = 10, factor: float = 0.35) -> DataFrame:
    """(uid_a, uid_b) with uid_a < uid_b whose cosine reaches ``least_cosine``, each among the k nearest of the other."""
    near = nearest_neighbours(vectors, uid, dense, dim, k, factor, least_cosine)
    return near.select(F.least("uid", "other").alias("uid_a"), F.greatest("uid", "other").alias("uid_b")).distinct()
