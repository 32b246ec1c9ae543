"""Exact top-k by inner product: a ball tree per shard, searched branch and bound.

Vectors are dealt by a hash into shards of bounded size, each packed as one row
with its ball tree (centre and radius of every node, leaves of contiguous
rows). Queries are packed into bounded blocks. A first pass searches for every block the shard
whose root has the highest bound; its kth scores are lower bounds that all later searches start
from, and a block that visits several shards, by falling bound of their roots, carries its kth scores from shard
to shard. A node's bound is q.c + |q| r. From the root on, every query opens its node of the
highest bound next: an inner node gives its two children, a leaf its rows; once that bound is under the kth
score, all that is left is pruned unopened.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from . import common

#: Vectors in a shard, queries in a block (both about) and vectors in a leaf.
SHARD_ROWS, BLOCK_ROWS, LEAF_ROWS = 4096, 4096, 64
#: Shards, at most, that a block visits in one task, sharing its kth scores.
SHARDS_A_GROUP = 8


def ball_tree(x: np.ndarray, leaf: int = LEAF_ROWS) -> dict[str, np.ndarray]:
    """Row order, node spans in it, parent of each node, which are leaves, centres and radii; the root is node 0.

    A node is halved along the line from a point far from its centre to the
    point farthest from that one.
    """
    order, spans, parent, is_leaf, centres, radii = np.arange(len(x)), [(0, len(x))], [0], [], [], []
    at = 0
    while at < len(spans):
        lo, hi = spans[at]
        part = x[order[lo:hi]]
        centre = part.mean(axis=0)
        away = ((part - centre) ** 2).sum(axis=1)
        centres.append(centre)
        radii.append(np.sqrt(away.max()))
        split = hi - lo > leaf and radii[-1] > 0
        is_leaf.append(not split)
        if split:
            a = part[away.argmax()]
            b = part[((part - a) ** 2).sum(axis=1).argmax()]
            order[lo:hi] = order[lo:hi][np.argsort(part @ (b - a), kind="stable")]
            mid = (lo + hi) // 2
            spans += [(lo, mid), (mid, hi)]
            parent += [at, at]
        at += 1
    return {"order": order, "spans": np.array(spans), "parent": np.array(parent), "leaf": np.array(is_leaf), "centres": np.array(centres), "radii": np.array(radii)}


def _best(score: np.ndarray, place: np.ndarray, more: np.ndarray, more_place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Best k of each row of both by score down, then place up."""
    s, i = np.concatenate([score, more], axis=1), np.concatenate([place, np.broadcast_to(more_place, more.shape)], axis=1)
    if s.shape[1] > 4 * k:  # narrow first; ties with the kth stay
        cut = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        wide = int((s >= cut[:, None]).sum(axis=1).max())
        if wide < s.shape[1]:
            at = np.argpartition(-s, wide - 1, axis=1)[:, :wide]
            s, i = np.take_along_axis(s, at, 1), np.take_along_axis(i, at, 1)
    at = np.lexsort((i, -s), axis=1)[:, :k]
    return np.take_along_axis(s, at, 1), np.take_along_axis(i, at, 1)


def search(tree: dict[str, np.ndarray], x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, floor: np.ndarray, top: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Fold a shard (rows in tree order) into ``top``, the scores (-inf: none) and ids so far; nothing below ``floor`` is needed."""
    score, best = top
    norm = np.sqrt((q * q).sum(axis=1))
    slack = 1e-9 * (1 + norm * np.sqrt((x * x).sum(axis=1).max()))
    reach = lambda rows, node: q[rows] @ tree["centres"][node] + norm[rows] * tree["radii"][node] + slack[rows]
    children: dict[int, list[int]] = {}
    for node in range(1, len(tree["parent"])):
        children.setdefault(int(tree["parent"][node]), []).append(node)
    # bounds of opened nodes' children that are not opened themselves
    front = np.full((len(q), len(tree["parent"])), -np.inf)
    live = np.arange(len(q))
    front[:, 0] = reach(live, 0)
    while True:
        at = front[live].argmax(axis=1)
        fine = front[live, at] >= np.maximum(score[live, -1], floor[live])
        live, at = live[fine], at[fine]
        if not len(live):
            return score, best
        bound = front[live, at]
        front[live, at] = -np.inf
        by = np.argsort(at, kind="stable")
        for part in np.split(by, np.flatnonzero(np.diff(at[by])) + 1):  # queries that open the same node share one product
            rows, node = live[part], int(at[part[0]])
            if not tree["leaf"][node]:
                for child in children[node]:
                    front[rows, child] = np.minimum(reach(rows, child), bound[part])
                continue
            lo, hi = tree["spans"][node]
            got = q[rows] @ x[lo:hi].T
            got[q_ids[rows][:, None] == ids[None, lo:hi]] = -np.inf
            score[rows], best[rows] = _best(score[rows], best[rows], got, ids[None, lo:hi], k)


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    x = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        x[i, : len(v)] = v
    return x


def _bytes(a: np.ndarray) -> bytes:
    """As float32 where that is exact."""
    small = a.astype(np.float32)
    return b"f" + small.tobytes() if np.array_equal(small, a) else b"d" + a.tobytes()


def _array(b: bytes, width: int) -> np.ndarray:
    return np.frombuffer(b[1:], b[:1].decode()).astype(float).reshape(-1, width)


_TREE = "_order binary, _spans binary, _parent binary, _leaf binary, _centres binary, _radii binary"


def _unpacked(s: dict, width: int) -> tuple[dict, np.ndarray, np.ndarray]:
    tree = {"spans": np.frombuffer(s["_spans"], np.int64).reshape(-1, 2), "parent": np.frombuffer(s["_parent"], np.int64), "leaf": np.frombuffer(s["_leaf"], bool), "centres": _array(s["_centres"], width), "radii": np.frombuffer(s["_radii"])}
    return tree, _array(s["_x"], width), np.frombuffer(s["_ids"], np.int64)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Each query's k highest inner products over ``vectors``: query_id, rank (from 1), vec_id, score (double).

    Exact; ties go to the smaller id; rows with the query's own id are not its
    candidates. Ids are whole numbers; null and other ids, and vectors that are null, empty or hold null or
    non-finite components, take no part on either side. A shorter vector counts
    as padded by zeros. Repeated candidate rows count each; a repeated query row
    is answered once. Rows of one id with different vectors are candidates of their own; as queries they
    are answered together. Other columns are ignored. An empty side gives no rows.
    """
    spark = vectors.sparkSession
    common.tune(spark)

    def sound(df: DataFrame) -> DataFrame:
        v = F.col(vec_col)
        fine = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
        return df.select(F.col(id_col).try_cast("long").alias("_id"), v.cast("array<double>").alias("_v")).where(F.col("_id").isNotNull() & fine)

    # of a row that repeats more than k copies cannot be among any k: so no row can fill a shard
    copies = F.explode(F.sequence(F.lit(1), F.least("count", F.lit(k)).cast("int")))
    rows, asked = sound(vectors).groupBy("_id", "_v").count().select("_id", "_v", copies.alias("_copy")), sound(queries).distinct()
    n, width = sound(vectors).agg(F.count("*"), F.max(F.size("_v"))).first()
    m, wide = sound(queries).agg(F.count("*"), F.max(F.size("_v"))).first()
    width = max(width or 1, wide or 1)
    n_shards, n_blocks = max(1, -(-n // SHARD_ROWS)), max(1, -(-m // BLOCK_ROWS))
    n_groups = min(n_shards, max(-(-n_shards // SHARDS_A_GROUP), -(-2 * spark.sparkContext.defaultParallelism // n_blocks)))

    def shard(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(pdf["_v"], width)
        t = ball_tree(x)
        order = t["order"]
        return pd.DataFrame([[key[0], pdf["_id"].to_numpy(np.int64)[order].tobytes(), _bytes(x[order]), t["spans"].astype(np.int64).tobytes(), t["parent"].astype(np.int64).tobytes(), t["leaf"].tobytes(), _bytes(t["centres"]), t["radii"].tobytes(), t["centres"][0].tolist(), float(t["radii"][0])]])

    def block(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[key[0], pdf["_id"].to_numpy(np.int64).tobytes(), _bytes(q := _matrix(pdf["_v"], width)), q.mean(axis=0).tolist()]])

    place = lambda parts: F.pmod(F.xxhash64("_id", "_v"), F.lit(parts)).cast("int")
    shards = rows.groupBy(place(n_shards).alias("_shard")).applyInPandas(shard, "_shard int, _ids binary, _x binary, _spans binary, _parent binary, _leaf binary, _centres binary, _radii binary, _root array<double>, _reach double")
    shards = common.materialize(shards, "ball-trees")
    blocks = common.materialize(asked.groupBy(place(n_blocks).alias("_block")).applyInPandas(block, "_block int, _qids binary, _q binary, _mid array<double>"), "query-blocks")
    # a stated query set, in blocks, against all rows
    every_block = lambda df: df.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

    def fold(b: dict, parts: pd.DataFrame, floor: np.ndarray | None) -> tuple:
        q_ids, q = np.frombuffer(b["_qids"], np.int64), _array(b["_q"], width)
        top = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
        floor = np.full(len(q), -np.inf) if floor is None else floor
        mid = q.mean(axis=0)
        roots = [float(mid @ np.array(c)) + float(np.sqrt(mid @ mid)) * r for c, r in zip(parts["_root"], parts["_reach"])]
        for s in parts.iloc[np.argsort(-np.array(roots), kind="stable")].to_dict("records"):
            tree, x, ids = _unpacked(s, width)
            top = search(tree, x, ids, q, q_ids, floor, top, k)
        return q_ids, *top

    def seed(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame({"_block": [], "_qids": [], "_q": [], "_kth": []})
        b = left.iloc[0].to_dict()
        kth = fold(b, right, None)[1][:, -1]
        return pd.DataFrame([[b["_block"], b["_qids"], b["_q"], kth.tobytes()]])

    # for each block the shard whose root has the highest bound for the mean of its queries
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda n, x: n + x)
    roots = every_block(shards.select("_shard", "_root", "_reach")).join(blocks.select("_block", "_mid"), "_block")
    bound = dot("_mid", "_root") + F.sqrt(dot("_mid", "_mid")) * F.col("_reach")
    nearest = roots.groupBy("_block").agg(F.max(F.struct(bound.alias("bound"), F.col("_shard"))).alias("n")).select("_block", F.col("n._shard").alias("_shard"))
    first = shards.join(nearest, "_shard")
    seeded = blocks.drop("_mid").groupBy("_block").cogroup(first.groupBy("_block")).applyInPandas(seed, "_block int, _qids binary, _q binary, _kth binary")
    seeded = seeded.withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
    grouped = every_block(shards.withColumn("_group", (F.col("_shard") % n_groups).cast("int")))

    def answer(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        b = left.iloc[0].to_dict()
        q_ids, score, best = fold(b, right, np.frombuffer(b["_kth"]))
        there = np.isfinite(score)
        return pd.DataFrame({"query_id": np.repeat(q_ids, there.sum(axis=1)), "vec_id": best[there], "score": score[there]})

    got = seeded.groupBy("_block", "_group").cogroup(grouped.groupBy("_block", "_group")).applyInPandas(answer, "query_id long, vec_id long, score double")
    ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return got.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
