"""Near-duplicate embeddings by NN-descent.

1. Equal vectors form one class, which is one node; the rest works on nodes.
2. Start: random-hyperplane trees put each node into one leaf per tree,
   and one more deals the nodes at random, so that lists reach beyond leaves; a
   leaf gives each of its nodes its nearest ``k`` neighbours there, and a spanning
   forest of its links.  A leaf above ``max_leaf`` is cut into blocks that meet in
   pairs, so that every pair of a leaf is compared.  The number of trees grows
   with the depth, so that a pair at the threshold shares a leaf with a chance of
   ``start_recall`` at any size; the rest is left to the rounds.
3. NN-descent: a node's list and the nodes that list it (the ``reverse``
   nearest) meet at the node; all pairs of them are compared, and a pair that
   is better than the worst of a list, or a link, goes into the lists.  A list
   whose entries are all links is saturated: it is twice as long in the next
   round.
4. Pairs near the threshold are tested in double precision; the links connect
   nodes to groups.  Within a group each list is enlarged to the whole group:
   its members meet in blocks, and every pair is tested, so that all links of a
   group count, however many there are.
5. Audit: nodes without links, with up to ``k`` and with more are sampled apart
   and compared with all others.  If the mean share of links found, per node,
   is under ``min_recall`` among the nodes with few links or with many, another
   round follows; once a round gains less than ``MIN_GAIN`` of the links, with as
   many new trees as at the start.  After ``max_rounds`` all blocks of nodes are
   compared with each other.

Lists are compared on vectors of one byte per dimension (cosine error under
0.01 at 64 dimensions); every link is tested exactly.

Defined results: a vector that is null, empty, zero or has null or non-finite
components has no links and is its own group; vectors of different lengths
have no links; a null id counts as larger than all others; repeated rows are
vectors of their own and link with each other; an empty table gives an empty
result; other columns (labels too) are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import ship, table
from .graph import components

THRESHOLD = 0.9
K = 8
REVERSE = 16
TREES = 2
LEAF = 512
MAX_LEAF = 2048
ROUNDS = 2
MAX_ROUNDS = 8
MIN_GAIN = 0.01
START_RECALL = 0.95
BLOCK = 1024
AUDITED = 512
MIN_RECALL = 0.99
MARGIN = 0.01
SEED = 11
PAIRS = "a long, b long, cos float"


def coded(vectors: np.ndarray) -> np.ndarray:
    """One byte per dimension, scaled by the largest component."""
    return np.rint(vectors / np.abs(vectors).max(axis=1, keepdims=True) * 127).astype(np.int8)


def units(vectors: np.ndarray, kind) -> np.ndarray:
    v = vectors.astype(kind)
    return v / np.linalg.norm(v, axis=-1, keepdims=True)


def doubles(vectors) -> np.ndarray:
    """Unit vectors in doubles, of lists of one length."""
    v = np.array(vectors.tolist(), np.float64)
    return units(v / np.abs(v).max(axis=1, keepdims=True), np.float64)


def stacked(codes) -> np.ndarray:
    return units(np.frombuffer(b"".join(codes), np.int8).reshape(len(codes), -1), np.float32)


def numbered(embeddings: DataFrame) -> DataFrame:
    """``row, vec_id, embedding, valid, k1, k2``; equal vectors have equal keys
    (two different ones with a probability of 2**-96)."""
    valid = F.expr("coalesce(size(embedding) > 0 and forall(embedding, x -> x is not null and abs(x) < double('infinity'))"
                   " and exists(embedding, x -> x <> 0), false)")
    # -0 and 0 are the same component
    clean = F.transform("embedding", lambda x: F.when(x == 0, F.lit(0)).otherwise(x).cast("double"))
    rows = embeddings.select(F.monotonically_increasing_id().alias("row"), "vec_id", "embedding", valid.alias("valid"),
                             F.xxhash64(clean).alias("k1"), F.hash(clean).alias("k2"))
    return table(rows, "vectors")


def nodes_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``k1, k2, node, copies, least`` per class, and ``node, copies, code,
    embedding`` with the vector of each."""
    classes = table(rows.where("valid").groupBy("k1", "k2").agg(
        F.min("row").alias("node"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least")), "vector-classes")

    def encode(batches):
        for pdf in batches:
            yield pdf.assign(code=[coded(np.asarray(v, np.float64)[None])[0].tobytes() for v in pdf["embedding"]])

    # floats are kept as they are: half the size, and exact in doubles
    kind = "array<float>" if rows.schema["embedding"].dataType.elementType == FloatType() else "array<double>"
    joined = rows.select(F.col("row").alias("node"), "embedding").join(classes.select("node", "copies"), "node").select(
        "node", "copies", F.col("embedding").cast(kind).alias("embedding"))
    return classes, table(joined.mapInPandas(encode, f"node long, copies long, embedding {kind}, code binary"), "nodes")


def depth_of(n: int, leaf: int) -> int:
    return min(40, max(0, int(np.ceil(np.log2(max(1, n / leaf))))))


def trees_for(depth: int, threshold: float, recall: float) -> int:
    """Trees in which a pair at the threshold shares a leaf at least once, with
    a chance of ``recall``."""
    together = (1 - np.arccos(threshold) / np.pi) ** depth
    return 1 if together >= recall else int(np.ceil(np.log(1 - recall) / np.log(1 - together)))


def leaf_lists(nodes: DataFrame, n: int, *, threshold: float, k: int, trees: int, leaf: int, max_leaf: int, draw: int = 0) -> DataFrame:
    """Neighbours of each node in its leaves, and in one of as many random groups:
    ``a, b, cos`` in both directions.  Each ``draw`` has planes and groups of its own."""
    depth = depth_of(n, leaf)

    def place(batches):
        for pdf in batches:
            sizes = pdf["code"].str.len().to_numpy()
            out = []
            for dim in np.unique(sizes):
                own = pdf[sizes == dim]
                planes = np.random.default_rng([SEED, int(dim), draw]).standard_normal((int(dim), trees * depth)).astype(np.float32)
                side = (stacked(own["code"].tolist()) @ planes > 0).reshape(len(own), trees, depth).astype(np.int64)
                where = (side << np.arange(depth)).sum(axis=2)
                out += [own[["node"]].assign(tree=t, place=where[:, t], dim=int(dim)) for t in range(trees)]
            yield pd.concat(out)[["node", "tree", "place", "dim"]] if out else pdf[["node"]].head(0).assign(tree=0, place=0, dim=0)

    # places only: a table with the vectors would be as many copies as there are trees
    leaves = nodes.select("node", "code").mapInPandas(place, "node long, tree int, place long, dim int")
    mixed = nodes.select("node", F.lit(trees).alias("tree"), F.pmod(F.xxhash64("node", F.lit(draw)), F.lit(1 << depth)).alias("place"),
                         F.length("code").alias("dim"))
    placed = table(leaves.unionByName(mixed) if depth else leaves, "leaves")
    leaf_of = ["dim", "tree", "place"]
    big = table(placed.groupBy(*leaf_of).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_leaf).select(
        *leaf_of, F.ceil(F.col("n") / F.lit(max(1, max_leaf // 2))).alias("blocks")), "big-leaves")
    cut = (placed.join(big, leaf_of, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
           .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks"))))
    # every block of a leaf meets every other; own block with own block comes with each of them
    other = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("long"))).otherwise(
        F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda x: x != F.col("own"))))
    met = cut.select("node", *leaf_of, "own", other.alias("other")).select(
        "node", *leaf_of, F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")).join(
        nodes.select("node", "code", "embedding"), "node")

    def nearest(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, v = pdf["node"].to_numpy(), stacked(pdf["code"].tolist())
        if len(ids) < 2:
            return pd.DataFrame({"a": [], "b": [], "cos": []})
        sims = v @ v.T
        np.fill_diagonal(sims, -2)
        few = min(k, len(ids) - 1)
        best = np.argpartition(-sims, few - 1, axis=1)[:, :few]
        a, b = np.repeat(np.arange(len(ids)), few), best.ravel()
        # a pair that only its code puts above the threshold must not stand for a link
        exact_v = doubles(pdf["embedding"])
        links = exact_v @ exact_v.T >= threshold
        np.fill_diagonal(links, False)
        forest = spanning(links)
        a, b = np.concatenate((a, forest[:, 0], forest[:, 1])), np.concatenate((b, forest[:, 1], forest[:, 0]))
        return pd.DataFrame({"a": ids[a], "b": ids[b], "cos": sims[a, b]})

    return met.groupBy(*leaf_of, "low", "high").applyInPandas(nearest, PAIRS)


def spanning(near: np.ndarray) -> np.ndarray:
    """Edges (pairs of row numbers) of a spanning forest of a link matrix."""
    left, out = near.any(axis=1), []
    while left.any():
        front = np.array([np.flatnonzero(left)[0]])
        left[front] = False
        while len(front):
            met = near[front] & left
            new = np.flatnonzero(met.any(axis=0))
            out.append(np.column_stack((front[met[:, new].argmax(axis=0)], new)))
            left[new] = False
            front = new
    return np.concatenate(out) if out else np.zeros((0, 2), int)


def best_of(pairs: DataFrame, lengths: DataFrame | None, k: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The lists (``a, b, cos``) that ``pairs`` give, each as long as
    ``lengths`` says, and the lengths of the next round."""
    rank = Window.partitionBy("a").orderBy(F.desc("cos"), "b")
    known = pairs.groupBy("a", "b").agg(F.max("cos").alias("cos"))
    longest = F.lit(k) if lengths is None else F.coalesce("length", F.lit(k))
    known = known if lengths is None else known.join(lengths, "a", "left")
    lists = table(known.withColumn("length", longest).withColumn("rank", F.row_number().over(rank)).where("rank <= length")
                  .select("a", "b", "cos", "length"), "neighbour-lists")
    full = lists.groupBy("a", "length").agg(F.count_if(F.col("cos") >= threshold - MARGIN).alias("linked")).where("linked >= length")
    return lists.select("a", "b", "cos"), table(full.select("a", (F.col("length") * 2).alias("length")), "saturated-lists")


def descend(lists: DataFrame, nodes: DataFrame, *, threshold: float, reverse: int) -> DataFrame:
    """One round: better pairs among the neighbours of each node."""
    back = lists.select(F.col("b").alias("w"), F.col("a").alias("x"), "cos").withColumn(
        "rank", F.row_number().over(Window.partitionBy("w").orderBy(F.desc("cos"), "x"))).where(F.col("rank") <= reverse)
    worst = lists.groupBy("a").agg(F.min("cos").alias("worst"))
    codes = table(nodes.select(F.col("node").alias("x"), "code").join(worst.withColumnRenamed("a", "x"), "x"), "codes")
    meet = table(lists.select(F.col("a").alias("w"), F.col("b").alias("x")).union(back.select("w", "x")).distinct(), "meetings")
    bucket = F.pmod(F.xxhash64("w"), F.lit(max(8, meet.count() // 50_000)))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("w", kind="stable")
        w, x, worst = pdf["w"].to_numpy(), pdf["x"].to_numpy(), pdf["worst"].to_numpy(np.float32)
        size = pdf["code"].str.len().to_numpy()
        out = []
        ends = np.concatenate((np.flatnonzero((w[1:] != w[:-1]) | (size[1:] != size[:-1])) + 1, [len(w)]))
        codes, start = pdf["code"].tolist(), 0
        for end in ends.tolist():
            if end - start > 1:
                v = stacked(codes[start:end])
                sims = v @ v.T
                np.fill_diagonal(sims, -2)
                i, j = np.nonzero((sims > worst[start:end, None]) | (sims >= threshold - MARGIN))
                out.append(np.column_stack((x[start + i], x[start + j], sims[i, j].astype(np.float64).view(np.int64))))
            start = end
        if not out:
            return pd.DataFrame({"a": [], "b": [], "cos": []})
        every = np.unique(np.concatenate(out), axis=0)
        return pd.DataFrame({"a": every[:, 0], "b": every[:, 1], "cos": np.ascontiguousarray(every[:, 2]).view(np.float64)})

    return meet.join(codes, "x").withColumn("bucket", bucket).groupBy("bucket").applyInPandas(compare, PAIRS)


def candidates(pairs: DataFrame, threshold: float) -> DataFrame:
    """``a, b``, the smaller first: pairs that may be links."""
    return pairs.where(F.col("cos") >= threshold - MARGIN).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def refined(lists: DataFrame, longer: DataFrame, near: DataFrame, nodes: DataFrame, *, threshold: float, k: int, reverse: int,
            name: str) -> tuple[DataFrame, DataFrame, DataFrame, float]:
    """One round: the lists and lengths after it, all candidates found so far, and
    the round's share of them."""
    pairs = table(descend(lists, nodes, threshold=threshold, reverse=reverse), f"better-pairs-{name}")
    found = table(near.union(candidates(pairs, threshold)).distinct(), f"candidates-{name}")
    before, after = near.count(), found.count()
    return *best_of(lists.unionByName(pairs), longer, k, threshold), found, (after - before) / max(1, after)


def exact(near: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """``a, b``: the candidate pairs whose cosine, in doubles, is a link's."""
    of = lambda c: nodes.select(F.col("node").alias(c), F.col("embedding").alias(f"v{c}"))

    def test(batches):
        for pdf in batches:
            keep = [cosine(x, y) >= threshold for x, y in zip(pdf["va"], pdf["vb"], strict=True)]
            yield pdf.loc[keep, ["a", "b"]]

    return near.join(of("a"), "a").join(of("b"), "b").mapInPandas(test, "a long, b long")


def cosine(x, y) -> float:
    x, y = np.asarray(x, np.float64), np.asarray(y, np.float64)
    x, y = x / np.abs(x).max(), y / np.abs(y).max()
    return float(x @ y / np.sqrt((x @ x) * (y @ y)))


def group_links(nodes: DataFrame, groups: DataFrame, threshold: float, block: int) -> DataFrame:
    """``node, linked``: how many vectors of other nodes each node of a group
    (``node, root``) links to.  Blocks of a group meet in pairs; small groups
    travel in bundles."""
    members = table(nodes.join(groups, "node").select("node", "root", "copies", "embedding"), "group-members")
    sizes = members.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).alias("blocks"))
    dealt = members.join(table(sizes, "group-sizes"), "root").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    bundles = max(8, members.count() // 2000)
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    met = dealt.select("node", "root", "copies", "embedding", "own", "blocks", other.alias("other")).withColumn(
        "task", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(bundles))).otherwise(
            F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other"))))

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, lo, hi), own in pdf.assign(lo=np.minimum(pdf["own"], pdf["other"]), hi=np.maximum(pdf["own"], pdf["other"])).groupby(
                ["root", "lo", "hi"], sort=False):
            v = doubles(own["embedding"])
            a, b = ((own["own"] == lo).to_numpy(), (own["own"] == hi).to_numpy())
            near = v[a] @ v[b].T >= threshold
            if lo == hi:
                np.fill_diagonal(near, False)
            copies, ids = own["copies"].to_numpy(), own["node"].to_numpy()
            out.append((ids[a], near @ copies[b]))
            if lo != hi:
                out.append((ids[b], near.T @ copies[a]))
        return pd.DataFrame({"node": np.concatenate([x for x, _ in out]), "linked": np.concatenate([y for _, y in out])})

    return met.groupBy("task").applyInPandas(count, "node long, linked long").groupBy("node").agg(F.sum("linked").alias("linked"))


def every_link(nodes: DataFrame, threshold: float, block: int) -> DataFrame:
    """``a, b``: links that connect what all links connect, by comparing every
    pair of blocks of nodes."""
    kind = nodes.withColumn("dim", F.length("code"))
    sizes = table(kind.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).alias("blocks")), "dimension-blocks")
    dealt = kind.join(F.broadcast(sizes), "dim").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    met = dealt.select("node", "embedding", "dim", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))

    def connect(pdf: pd.DataFrame) -> pd.DataFrame:
        v, ids = doubles(pdf["embedding"]), pdf["node"].to_numpy()
        near = v @ v.T >= threshold
        np.fill_diagonal(near, False)
        forest = spanning(near)
        return pd.DataFrame({"a": ids[forest[:, 0]], "b": ids[forest[:, 1]]})

    pair = met.select("node", "embedding", "dim", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    return table(pair.groupBy("dim", "low", "high").applyInPandas(connect, "a long, b long"), "every-link")


def audit(nodes: DataFrame, linked: DataFrame, threshold: float, k: int, sample: int) -> float:
    """The smaller of two means over nodes, of the share of a node's links that
    were found: of the nodes with up to ``k`` links, and of those with more.
    ``sample`` nodes (by hash) are asked of those without a link found, with up
    to ``k`` and with more; each stands for as many as were not asked."""
    found = nodes.join(linked, "node", "left").withColumn("linked", F.coalesce("linked", F.lit(0)))
    found = table(found.select("node", "embedding", "linked", F.when(F.col("linked") == 0, 0).when(F.col("linked") <= k, 1).otherwise(2)
                               .alias("part")), "audited")
    size = {r["part"]: r["count"] for r in found.groupBy("part").count().collect()}
    asked = [r for p in size for r in found.where(F.col("part") == p).orderBy(F.xxhash64("node"), "node").limit(sample).collect()]
    by_size: dict = {}
    for r in asked:
        by_size.setdefault(len(r.embedding), []).append(r)
    queries = {n: (np.array([r.node for r in own]), doubles(pd.Series([r.embedding for r in own]))) for n, own in by_size.items()}

    def count(batches):
        total: dict = {}
        for pdf in batches:
            for n, (ids, q) in queries.items():
                own = pdf[pdf["embedding"].str.len() == n]
                if len(own):
                    near = doubles(own["embedding"]) @ q.T >= threshold
                    near &= own["node"].to_numpy()[:, None] != ids[None]
                    total[n] = total.get(n, 0) + own["copies"].to_numpy() @ near
        for n, links in total.items():
            yield pd.DataFrame({"node": queries[n][0], "n": links})

    there = nodes.select("node", "copies", "embedding").mapInPandas(count, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))
    true = {r.node: r.n for r in there.collect()}
    means = []
    for few in (True, False):
        own = [(size[r.part] / min(sample, size[r.part]), r.linked / true[r.node]) for r in asked
               if true.get(r.node) and (true[r.node] <= k) == few]
        if own:
            means.append(sum(w * min(1.0, share) for w, share in own) / sum(w for w, _ in own))
    return min(means, default=1.0)


def near_duplicates(embeddings: DataFrame, *, threshold: float = THRESHOLD, k: int = K, reverse: int = REVERSE, trees: int = TREES,
                    leaf: int = LEAF, max_leaf: int = MAX_LEAF, rounds: int = ROUNDS, max_rounds: int = MAX_ROUNDS,
                    block: int = BLOCK, audited: int = AUDITED, min_recall: float = MIN_RECALL,
                    start_recall: float = START_RECALL) -> DataFrame:
    """One row per vector of ``vec_id, embedding``: ``vec_id, n_links,
    component_id, kept, recall`` (the audited one)."""
    ship(embeddings.sparkSession)
    rows = numbered(embeddings)
    classes, nodes = nodes_of(rows)
    n = nodes.count()
    trees = max(trees, trees_for(depth_of(n, leaf), threshold, start_recall))
    start = lambda draw: table(leaf_lists(
        nodes, n, threshold=threshold, k=k, trees=trees, leaf=leaf, max_leaf=max_leaf, draw=draw), f"leaf-pairs-{draw}")
    pairs = start(0)
    near = table(candidates(pairs, threshold).distinct(), "candidates")
    lists, longer = best_of(pairs, None, k, threshold)
    done, gain = 0, 0.0
    while True:
        while done < rounds:
            lists, longer, near, gain = refined(lists, longer, near, nodes, threshold=threshold, k=k, reverse=reverse, name=str(done))
            done += 1
        groups = components(exact(near, nodes, threshold))
        linked = table(group_links(nodes, groups, threshold, block), "linked")
        recall = audit(nodes, linked, threshold, k, audited)
        if recall >= min_recall:
            break
        if done >= max_rounds:
            groups = components(every_link(nodes, threshold, block))
            linked = table(group_links(nodes, groups, threshold, block), "linked")
            recall = audit(nodes, linked, threshold, k, audited)
            break
        rounds = done + 1
        if gain < MIN_GAIN:
            pairs = start(rounds)
            near = table(near.union(candidates(pairs, threshold)).distinct(), f"candidates-trees-{rounds}")
            lists, longer = best_of(lists.unionByName(pairs), longer, k, threshold)
    found = classes.join(groups, "node", "left").join(linked, "node", "left").select(
        "k1", "k2", "copies", "least", F.coalesce("root", "node").alias("root"), F.coalesce("linked", F.lit(0)).alias("linked"))
    found = table(found, "linked-classes")
    least = table(found.groupBy("root").agg(F.min("least").alias("component_id")), "component-ids")
    found = table(found.join(least, "root").select("k1", "k2", F.lit(True).alias("valid"), (F.col("copies") - 1 + F.col("linked")).alias("n_links"),
                                                   "component_id"), "vector-results")
    out = rows.select("vec_id", "valid", "k1", "k2").join(found, ["k1", "k2", "valid"], "left")
    component = F.when(F.col("valid"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"), F.lit(recall).alias("recall"))


ORACLE = """
with recursive vectors as (
  select vec_id, cast(embedding as double[]) v from embeddings),
links as (
  select a.vec_id x, b.vec_id y from vectors a join vectors b on a.vec_id <> b.vec_id and list_cosine_similarity(a.v, b.v) >= 0.9),
reach as (
  select vec_id x, vec_id y from vectors union select r.x, l.y from reach r join links l on r.y = l.x)
select vec_id, coalesce(n_links, 0) n_links, component_id, vec_id = component_id kept
from (select x vec_id, min(y) component_id from reach group by x)
left join (select x vec_id, count(*) n_links from links group by x) using (vec_id)
"""
