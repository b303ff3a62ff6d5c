"""Near-duplicate embeddings by dual traversal of cover trees.

Unit vectors with cosine >= c are at Euclidean distance <= t = sqrt(2 - 2c). Vectors of one label are
dealt to cells by their nearest pivot and cells to blocks of at most ``block`` vectors. Each block
becomes a cover tree: levels with halving radii, every node keeping the true distance to its
farthest vector. Cell pairs, then block pairs, then node pairs are dropped when the distance of
their centres less both covering radii exceeds t, and counted whole when the distance plus both
radii stays under t; only what is left meets vector by vector, in double precision.

Equal vectors are one class with a weight, and a traversal returns per vector its link count and a
local component, never its pairs, so a group of n copies or near copies yields n rows.

Defined results: a null label, a null or zero vector, or one with null or non-finite components
links with nothing; vectors of different lengths are never linked; repeated rows are copies and
count as other vectors; a null id takes part in no link; an empty table gives no rows. Only the
three named columns are read, so other columns cannot clash.
"""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.ordering import pinned

from .components import components

LEAF = 24
#: Room for rounding in distance bounds; pairs this close to a bound are compared exactly.
SLACK = 1e-7
NODE = np.dtype([("centre", "i4"), ("radius", "f8"), ("lo", "i4"), ("hi", "i4"), ("child", "i4"), ("children", "i4")])


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (a @ b.T), 0.0))


def cover_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, nodes) of unit vectors: each node is a slice lo:hi of the order, root first.

    The children of a node at level radius r are centres chosen among its vectors so that every
    vector is within r/2 of its centre; the first centre is the node's own, so levels nest.
    """
    order = np.arange(len(points))
    nodes, todo = [], [(0, 0, len(points), 2.0)]
    nodes.append((0, float(distances(points[:1], points).max()), 0, len(points), 0, 0))
    while todo:
        at, lo, hi, reach = todo.pop()
        centre, radius, *_ = nodes[at]
        if hi - lo <= LEAF or radius <= SLACK:
            continue
        reach = min(reach, radius) / 2
        own = order[lo:hi]
        mine = points[own]
        owner = np.full(len(own), -1)
        away = np.full(len(own), np.inf)
        centres, next_ = [], int(np.flatnonzero(own == centre)[0])
        while next_ >= 0:
            gap = distances(mine[next_ : next_ + 1], mine)[0]
            nearer = gap < away
            owner[nearer], away[nearer] = len(centres), gap[nearer]
            away[next_], owner[next_] = 0.0, len(centres)
            centres.append(own[next_])
            far = int(np.argmax(away))
            next_ = far if away[far] > reach else -1
        by = np.argsort(owner, kind="stable")
        order[lo:hi], owner, away = own[by], owner[by], away[by]
        edge = np.searchsorted(owner, np.arange(len(centres) + 1))
        first = len(nodes)
        for k, c in enumerate(centres):
            a, b = int(edge[k]), int(edge[k + 1])
            nodes.append((int(c), float(away[a:b].max()), lo + a, lo + b, 0, 0))
            todo.append((first + k, lo + a, lo + b, reach))
        nodes[at] = (centre, radius, lo, hi, first, len(centres))
    table = np.array(nodes, dtype=NODE)
    place = np.empty(len(points), dtype=np.int32)
    place[order] = np.arange(len(points), dtype=np.int32)
    table["centre"] = place[table["centre"]]
    return order, table


def linked(x, tx, y, ty, cosine: float, same: bool):
    """Dual traversal: (whole, some).

    ``whole``: slices (xlo, xhi, ylo, yhi) in which every pair is a link; ``some``: arrays of
    single links. With ``same`` both trees are one; then a slice pair (a, a) stands for all pairs
    inside a, and every other pair occurs once.
    """
    limit = math.sqrt(2.0 - 2.0 * cosine)
    whole, left, right = [], [], []

    def below(tree, node):
        first, n = int(tree["child"][node]), int(tree["children"][node])
        return np.arange(first, first + n) if n else np.array([node])

    todo = [(np.array([0]), np.array([0]), same)]
    while todo:
        own, other, mirrored = todo.pop()
        a, b = tx[own], ty[other]
        gap = distances(x[a["centre"]], y[b["centre"]])
        spread = a["radius"][:, None] + b["radius"][None, :]
        keep = gap - spread <= limit + SLACK
        if mirrored:
            np.fill_diagonal(gap, 0.0)
            keep = np.triu(keep)
        for i, j in zip(*np.nonzero(keep)):
            p, q = int(own[i]), int(other[j])
            one = mirrored and i == j
            if gap[i, j] + spread[i, j] <= limit - SLACK:
                whole.append((int(a["lo"][i]), int(a["hi"][i]), int(b["lo"][j]), int(b["hi"][j])))
            elif tx["children"][p] or ty["children"][q]:
                todo.append((below(tx, p), below(ty, q), one))
            else:
                hit = x[a["lo"][i] : a["hi"][i]] @ y[b["lo"][j] : b["hi"][j]].T >= cosine
                u, v = np.nonzero(np.triu(hit, 1) if one else hit)
                left.append(u + a["lo"][i])
                right.append(v + b["lo"][j])
    none = np.zeros(0, dtype=np.int64)
    return whole, (np.concatenate(left) if left else none, np.concatenate(right) if right else none)


def _summed(whole, some, wx, wy, same):
    """Per vector of x and of y the weight of its links, and edges (indices; y shifted by len(x))."""
    shift = 0 if same else len(wx)
    nx, ny = np.zeros(len(wx) + 1), np.zeros(len(wy) + 1)
    p, q = some
    np.add.at(nx, p, wy[q])
    np.add.at(ny, q, wx[p])
    edges = [np.stack([p, q + shift])]
    dx, dy = np.zeros(len(wx) + 1), np.zeros(len(wy) + 1)
    for a, b, c, d in whole:
        if same and (a, b) == (c, d):
            dx[a] += wx[a:b].sum()
            dx[b] -= wx[a:b].sum()
            nx[a:b] -= wx[a:b]
        else:
            dx[a] += wy[c:d].sum()
            dx[b] -= wy[c:d].sum()
            dy[c] += wx[a:b].sum()
            dy[d] -= wx[a:b].sum()
        ends = np.concatenate([np.arange(a, b), np.arange(c, d) + shift])
        edges.append(np.stack([np.full(len(ends), a), ends]))
    nx, ny = nx[:-1] + np.cumsum(dx)[:-1], ny[:-1] + np.cumsum(dy)[:-1]
    return (nx + ny, None, edges) if same else (nx, ny, edges)


def _local_components(n: int, edges, ids: np.ndarray) -> np.ndarray:
    """Smallest id of each index's component."""
    p, q = np.concatenate(edges, axis=1)
    label = ids.copy()
    while True:
        old = label.copy()
        low = np.minimum(label[p], label[q])
        np.minimum.at(label, p, low)
        np.minimum.at(label, q, low)
        if (old == label).all():
            return label


def _blocks(cells: DataFrame, kind: str) -> DataFrame:
    """One row per block: its tree, vectors, ids and weights as bytes, its centre and radius."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id", kind="stable")
        raw = np.array(rows["embedding"].tolist(), dtype=kind)
        points = unit(raw.astype(np.float64))
        order, nodes = cover_tree(points)
        return pd.DataFrame(
            {
                "block": [rows["block"].iloc[0]], "pool": [rows["pool"].iloc[0]], "cell": [rows["cell"].iloc[0]],
                "dim": [raw.shape[1]], "centre": [points[order[nodes["centre"][0]]].tolist()],
                "radius": [float(nodes["radius"][0])],
                "ids": [rows["id"].to_numpy(np.int64)[order].tobytes()],
                "weights": [rows["copies"].to_numpy(np.int64)[order].tobytes()],
                "vectors": [raw[order].tobytes()], "nodes": [nodes.tobytes()],
            }
        )

    return cells.groupBy("block").applyInPandas(
        build,
        "block long, pool string, cell int, dim int, centre array<double>, radius double, "
        "ids binary, weights binary, vectors binary, nodes binary",
    )


def _unpacked(row, side, kind):
    ids = np.frombuffer(getattr(row, f"ids_{side}"), np.int64)
    vectors = np.frombuffer(getattr(row, f"vectors_{side}"), kind).reshape(len(ids), -1)
    weights = np.frombuffer(getattr(row, f"weights_{side}"), np.int64).astype(np.float64)
    return ids, unit(vectors.astype(np.float64)), weights, np.frombuffer(getattr(row, f"nodes_{side}"), NODE)


def _distance(a, b):
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(2.0 - 2.0 * dot, F.lit(0.0)))


def prepared(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """(vec_id, key, pool, embedding): key names equal vectors of a label; null if it cannot link."""
    e = F.col(embedding)
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    large = F.aggregate(e, F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x.cast("double"))))
    usable = (
        F.col(label).isNotNull() & F.col(vec_id).isNotNull() & e.isNotNull()
        & ~F.coalesce(bad, F.lit(True)) & (F.coalesce(large, F.lit(0.0)) > 0)
    )
    pool = F.concat(F.col(label).cast("string"), F.lit(" "), F.size(e).cast("string"))
    key = F.md5(F.concat_ws(",", pool, e.cast("array<string>")).cast("binary"))
    return vectors.select(
        F.col(vec_id).alias("vec_id"),
        F.when(usable, key).alias("key"), F.when(usable, pool).alias("pool"), e.alias("embedding"),
    )


def block_pairs(classes: DataFrame, cosine: float, block: int, per_pivot: int, most_pivots: int, kind: str):
    """Pairs of blocks that the covering bounds leave, with both payloads."""
    total = classes.count()
    wanted = max(1, min(most_pivots, total // per_pivot))
    # Pivots are a fixed choice of at most ``most_pivots`` vectors, whatever the table's size.
    chosen = classes.orderBy(F.xxhash64("id"), "id").limit(wanted).select("id", "embedding").collect()
    pivots: dict[int, list] = {}
    for r in chosen:
        pivots.setdefault(len(r.embedding), []).append(np.array(r.embedding, dtype=np.float64))
    units = {dim: unit(np.array(rows)) for dim, rows in pivots.items()}

    @F.pandas_udf("cell int, away double")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        cell, away = np.zeros(len(vectors), dtype=np.int32), np.full(len(vectors), 2.0)
        dims = vectors.map(len).to_numpy() if len(vectors) else np.zeros(0, int)
        for dim in np.unique(dims):
            if dim in units:
                at = np.flatnonzero(dims == dim)
                gaps = distances(unit(np.array(vectors.iloc[at].tolist(), dtype=np.float64)), units[dim])
                cell[at], away[at] = gaps.argmin(axis=1), gaps.min(axis=1)
        return pd.DataFrame({"cell": cell, "away": away})

    near = classes.withColumn("_n", nearest("embedding")).select("*", "_n.cell", "_n.away").drop("_n")
    near = pinned(near)
    cells = pinned(
        near.groupBy("pool", "cell").agg(
            F.count(F.lit(1)).alias("n"), F.max("away").alias("reach")
        )
    )
    pieces = F.ceil(F.col("n") / block).cast("int")
    placed = near.join(cells.select("pool", "cell", pieces.alias("_p")), ["pool", "cell"]).withColumn(
        "block", F.xxhash64("pool", "cell", F.pmod(F.xxhash64("id"), F.col("_p")))
    )
    blocks = pinned(_blocks(placed.select("block", "pool", "cell", "id", "copies", "embedding"), kind))
    heads = blocks.select("block", "pool", "cell", "centre", "radius")
    limit = math.sqrt(2.0 - 2.0 * cosine) + SLACK

    def named(df, side):
        return df.select(*[F.col(c).alias(c if c == "pool" else f"{c}_{side}") for c in df.columns])

    # Bounds first between the cells of a pool (at most most_pivots), then between their blocks.
    spots = [(dim, i, p.tolist()) for dim, ps in units.items() for i, p in enumerate(ps)] or [(0, 0, [0.0])]
    where = F.broadcast(
        classes.sparkSession.createDataFrame(spots, "dim int, cell int, pivot array<double>")
    )
    held = cells.withColumn("dim", F.substring_index("pool", " ", -1).cast("int")).join(
        where, ["dim", "cell"], "left"
    ).select("pool", "cell", "reach", "pivot")
    ring = named(held, "a").join(named(held, "b"), "pool").where(
        F.col("pivot_a").isNull() | F.col("pivot_b").isNull()
        | (_distance(F.col("pivot_a"), F.col("pivot_b")) <= F.col("reach_a") + F.col("reach_b") + limit)
    ).select("pool", "cell_a", "cell_b")
    close = (
        ring.join(named(heads, "a"), ["pool", "cell_a"]).join(named(heads, "b"), ["pool", "cell_b"])
        .where("block_a <= block_b")
        .where(_distance(F.col("centre_a"), F.col("centre_b")) <= F.col("radius_a") + F.col("radius_b") + limit)
        .select("block_a", "block_b")
    )
    load = blocks.select("block", "ids", "weights", "vectors", "nodes")
    return close.join(named(load, "a"), "block_a").join(named(load, "b"), "block_b")


def near_embeddings(
    vectors: DataFrame,
    cosine: float = 0.93,
    block: int = 1024,
    per_pivot: int = 20000,
    most_pivots: int = 256,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    rows, classes, kind = _classes(vectors, vec_id, embedding, label)
    met = block_pairs(classes, cosine, block, per_pivot, most_pivots, kind)

    def traverse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                same = row.block_a == row.block_b
                ix, x, wx, tx = _unpacked(row, "a", kind)
                iy, y, wy, ty = (ix, x, wx, tx) if same else _unpacked(row, "b", kind)
                whole, some = linked(x, tx, y, ty, cosine, same)
                nx, ny, edges = _summed(whole, some, wx, wy, same)
                ids, n = (ix, nx) if same else (np.concatenate([ix, iy]), np.concatenate([nx, ny]))
                roots = _local_components(len(ids), edges, ids)
                hit = np.flatnonzero((n > 0.5) | (roots != ids))
                yield pd.DataFrame({"id": ids[hit], "n": n[hit].round().astype(np.int64), "root": roots[hit]})

    found = pinned(met.mapInPandas(traverse, "id long, n long, root long"))
    label_of = components(found.select(F.col("root").alias("a"), F.col("id").alias("b")))
    counts = found.groupBy("id").agg(F.sum("n").alias("_links"))
    per_class = (
        classes.select("key", "id", "copies").join(counts, "id", "left").join(label_of, "id", "left")
        .select(
            "key",
            (F.coalesce("_links", F.lit(0)) + F.col("copies") - 1).alias("_links"),
            F.coalesce("component", "id").alias("_component"),
        )
    )
    return rows.join(per_class, "key", "left").select(
        "vec_id", F.coalesce("_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("_component", "vec_id").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _classes(vectors, vec_id, embedding, label):
    ready = prepared(vectors, vec_id, embedding, label)
    kind = "<f4" if dict(vectors.dtypes)[embedding] == "array<float>" else "<f8"
    classes = pinned(
        ready.where(F.col("key").isNotNull()).groupBy("key").agg(
            F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"),
            F.first("pool").alias("pool"), F.first("embedding").alias("embedding"),
        )
    )
    return pinned(ready.select("vec_id", "key")), classes, kind


def threshold_pairs(vectors: DataFrame, cosine: float = 0.93, block: int = 1024, **names) -> DataFrame:
    """The exact links (a, b, a < b) between classes of equal vectors; classes by their smallest id."""
    _, classes, kind = _classes(
        vectors, names.get("vec_id", "vec_id"), names.get("embedding", "embedding"), names.get("label", "label")
    )
    met = block_pairs(classes, cosine, block, 20000, 256, kind)

    def traverse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                same = row.block_a == row.block_b
                ix, x, _, tx = _unpacked(row, "a", kind)
                iy, y, _, ty = (ix, x, None, tx) if same else _unpacked(row, "b", kind)
                whole, (p, q) = linked(x, tx, y, ty, cosine, same)
                yield pd.DataFrame({"a": np.minimum(ix[p], iy[q]), "b": np.maximum(ix[p], iy[q])})
                for a, b, c, d in whole:
                    one = same and (a, b) == (c, d)
                    for i in range(a, b):
                        other = iy[i + 1 : d] if one else iy[c:d]
                        mine = np.full(len(other), ix[i])
                        yield pd.DataFrame({"a": np.minimum(mine, other), "b": np.maximum(mine, other)})

    return met.mapInPandas(traverse, "a long, b long")
