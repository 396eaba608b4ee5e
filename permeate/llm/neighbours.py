"""Most similar vectors for every vector (problem 4).

Method: a forest of random-projection trees, searched through one priority queue shared by all trees, then exact
reranking of the leaf candidates. The trees are fitted on a bounded sample; every vector is indexed and every
vector is a query.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from permeate.session import cut, spread


@dataclass
class Forest:
    """Trees in arrays: normal and offset of each inner node, children (negative: leaf -1 - number)."""

    normals: np.ndarray
    offsets: np.ndarray
    children: np.ndarray
    roots: np.ndarray
    n_leaves: int

    def descend(self, x: np.ndarray, row: np.ndarray, node: np.ndarray, bound: np.ndarray, waiting: list) -> np.ndarray:
        """Leaf reached from ``node`` by each of ``x[row]``; the sides not taken go to ``waiting`` with their bound.

        The bound of a side is the largest distance to a plane on the way to it: the order of the shared queue.
        """
        leaf = np.where(node < 0, -1 - node, -1)
        at = np.flatnonzero(node >= 0)
        node, bound = node.copy(), bound.copy()
        while at.size:
            here = node[at]
            margin = np.einsum("ij,ij->i", x[row[at]], self.normals[here]) - self.offsets[here]
            side = (margin > 0).astype(np.int64)
            waiting.append((row[at], self.children[here, 1 - side], np.maximum(bound[at], np.abs(margin))))
            node[at] = self.children[here, side]
            done = node[at] < 0
            leaf[at[done]] = -1 - node[at[done]]
            at = at[~done]
        return leaf

    def probe(self, x: np.ndarray, extra: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(row, leaf, own)``: the own leaf in every tree, then the next ``extra`` leaves of the shared queue."""
        n, t = len(x), len(self.roots)
        rows = np.repeat(np.arange(n), t)
        waiting: list = []
        leaf = self.descend(x, rows, np.tile(self.roots, n), np.zeros(n * t, dtype=np.float32), waiting)
        out = [(rows, leaf, np.ones(n * t, dtype=bool))]
        for _ in range(extra):
            if not waiting:
                break
            r, node, bound = (np.concatenate(c) for c in zip(*waiting))
            order = np.lexsort((node, bound, r))
            r, node, bound = r[order], node[order], bound[order]
            first = np.ones(len(r), dtype=bool)
            first[1:] = r[1:] != r[:-1]
            # an own queue never needs more entries than there are pops left
            place = np.arange(len(r)) - np.repeat(np.flatnonzero(first), np.diff(np.append(np.flatnonzero(first), len(r))))
            keep = ~first & (place <= extra)
            waiting = [(r[keep], node[keep], bound[keep])]
            leaf = self.descend(x, r[first], node[first], bound[first], waiting)
            out.append((r[first], leaf, np.zeros(int(first.sum()), dtype=bool)))
        row, leaf, own = (np.concatenate(c) for c in zip(*out))
        return row, leaf, own


def fit_forest(sample: np.ndarray, trees: int, leaves: int, seed: int = 7) -> Forest:
    """Trees of up to ``leaves`` leaves each: a node is cut at the median of its sample between two drawn points."""
    rng = np.random.default_rng(seed)
    normals, offsets, children, roots = [], [], [], []
    n_leaves = 0

    def grow(rows: np.ndarray, want: int) -> int:
        nonlocal n_leaves
        if want < 2 or len(rows) < 4:
            n_leaves += 1
            return -n_leaves
        for _ in range(5):
            a, b = rng.choice(rows, 2, replace=False)
            normal = sample[a] - sample[b]
            length = float(np.linalg.norm(normal))
            if length > 1e-6:
                normal = normal / length
                break
        else:
            normal = rng.standard_normal(sample.shape[1]).astype(np.float32)
            normal /= np.linalg.norm(normal)
        reach = sample[rows] @ normal
        middle = float(np.median(reach))
        right = reach > middle
        if right.all() or not right.any():
            n_leaves += 1
            return -n_leaves
        me = len(normals)
        normals.append(normal)
        offsets.append(middle)
        children.append([0, 0])
        children[me][0] = grow(rows[~right], want // 2)
        children[me][1] = grow(rows[right], want - want // 2)
        return me

    for _ in range(trees):
        roots.append(grow(np.arange(len(sample)), leaves))
    d = sample.shape[1]
    return Forest(
        np.array(normals, dtype=np.float32).reshape(-1, d),
        np.array(offsets, dtype=np.float32),
        np.array(children, dtype=np.int64).reshape(-1, 2),
        np.array(roots, dtype=np.int64),
        n_leaves,
    )


def unit_vectors(vectors: DataFrame, dimension: int) -> DataFrame:
    """``(vec_id, v)``: unit vectors as the bytes of float32 numbers; null, wrongly sized and all-zero ones, and
    those with a null, NaN or infinite number, take no part."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array(batch["embedding"].tolist(), dtype=np.float64).reshape(len(batch), dimension)
            with np.errstate(invalid="ignore"):
                length = np.sqrt((x * x).sum(axis=1))
            fine = np.isfinite(length) & (length > 0)
            unit = (x[fine] / length[fine, None]).astype(np.float32)
            yield pd.DataFrame({"vec_id": batch["vec_id"].to_numpy()[fine], "v": [r.tobytes() for r in unit]})

    sized = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.size("embedding") == dimension)
    return spread(sized).mapInPandas(work, "vec_id long, v binary")


def _matrix(column: pd.Series, dimension: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.float32).reshape(-1, dimension)


# ---------------------------------------------------------------- packed rows

# Rows of one leaf travel packed: ids as int64, vectors as int8 codes with their scale and error as float32.
_PACKED = "leaf string, stage int, n int, ids binary, codes binary, scales binary"


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """int8 codes of unit vectors and ``(scale, error)`` rows; ``error`` is the length of what the codes lose."""
    scale = np.maximum(np.abs(x).max(axis=1), 1e-12) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(x - codes * scale[:, None], axis=1)
    return codes, np.column_stack([scale, error]).astype(np.float32)


@dataclass
class Pack:
    """Some rows of one leaf."""

    ids: np.ndarray
    codes: np.ndarray
    scales: np.ndarray

    @staticmethod
    def read(ids: bytes, codes: bytes, scales: bytes) -> Pack:
        i = np.frombuffer(ids, dtype=np.int64)
        return Pack(i, np.frombuffer(codes, dtype=np.int8).reshape(len(i), -1), np.frombuffer(scales, dtype=np.float32).reshape(-1, 2))

    @staticmethod
    def join(packs: list[Pack]) -> Pack:
        return packs[0] if len(packs) == 1 else Pack(*(np.concatenate([getattr(p, c) for p in packs]) for c in ("ids", "codes", "scales")))

    def take(self, rows: np.ndarray) -> Pack:
        return Pack(self.ids[rows], self.codes[rows], self.scales[rows])

    def vectors(self) -> np.ndarray:
        return self.codes.astype(np.float32) * self.scales[:, :1]

    def row(self) -> tuple[int, bytes, bytes, bytes]:
        return len(self.ids), self.ids.tobytes(), self.codes.tobytes(), self.scales.tobytes()


def _packed(pack: Pack, row: np.ndarray, leaf: np.ndarray, own: np.ndarray, name) -> Iterator[tuple]:
    """Packed rows per leaf: stage 0 for members (which ask as well), stage 1 for queries from other leaves."""
    order = np.lexsort((~own, leaf))
    row, leaf, own = row[order], leaf[order], own[order]
    cuts = np.flatnonzero((leaf[1:] != leaf[:-1]) | (own[1:] != own[:-1])) + 1
    for part in np.split(np.arange(len(row)), cuts):
        if len(part):
            yield name(leaf[part[0]]), int(not own[part[0]]), *pack.take(row[part]).row()


_COLUMNS = ["leaf", "stage", "n", "ids", "codes", "scales"]


def _split_crowded(routed: DataFrame, sizes: DataFrame, leaf_rows: int, leaf_sample: int, extra: int, seed: int) -> DataFrame:
    """The rows of over-full leaves sent to the leaves of a tree of their own.

    Each over-full leaf is fitted on about ``leaf_sample`` of its members (bounded); its rows then meet its tree by leaf and
    salt in sorted streams, the tree first, so no task holds the leaf. Members go to one new leaf, queries also to the
    ``extra`` next ones.
    """
    crowded = routed.join(sizes, "leaf")

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                pack = Pack.read(r.ids, r.codes, r.scales)
                rng = np.random.default_rng((seed, int(pack.ids[0]) & 0x7FFFFFFF))
                keep = np.flatnonzero(rng.random(r.n) < leaf_sample / r.members)
                if len(keep):
                    rows.append((r.leaf, r.members, pack.vectors()[keep].tobytes(), pack.codes.shape[1]))
            yield pd.DataFrame(rows, columns=["leaf", "members", "x", "d"])

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(group["x"]), dtype=np.float32).reshape(-1, int(group["d"].iloc[0]))[: 2 * leaf_sample]
        tree = fit_forest(x, 1, max(2, int(round(group["members"].iloc[0] / leaf_rows))), seed)
        return pd.DataFrame({"leaf": [group["leaf"].iloc[0]], "tree": [pickle.dumps(tree)]})

    trees = crowded.where("stage = 0").mapInPandas(pick, "leaf string, members long, x binary, d int").groupBy("leaf").applyInPandas(fit, "leaf string, tree binary")
    salts = F.least(F.ceil(F.col("members") / (16 * leaf_sample)), F.lit(1024)).cast("int")
    nothing = [F.lit(None).cast("binary").alias(c) for c in ("ids", "codes", "scales")]
    first = trees.join(sizes, "leaf").select("leaf", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(-1).alias("stage"), F.lit(0).alias("n"), *nothing, "tree")
    rest = crowded.select("leaf", F.pmod(F.xxhash64("ids"), salts).cast("int").alias("salt"), "stage", "n", "ids", "codes", "scales", F.lit(None).cast("binary").alias("tree"))

    def descend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = None
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                if r.stage < 0:
                    tree = pickle.loads(r.tree)
                    continue
                pack = Pack.read(r.ids, r.codes, r.scales)
                row, leaf, own = tree.probe(pack.vectors(), extra)
                rows += _packed(pack, row, leaf, own & (r.stage == 0), lambda k, at=r.leaf: f"{at}.{k}")
            yield pd.DataFrame(rows, columns=_COLUMNS)

    streams = first.unionByName(rest).repartition("leaf", "salt").sortWithinPartitions("leaf", "salt", "stage")
    return streams.mapInPandas(descend, _PACKED)


def _candidates(routed: DataFrame, sizes: DataFrame, least: float, k: int, most_in_block: int) -> DataFrame:
    """``(a, b)``: pairs that may reach ``least`` and be among the ``k`` best of one side, from the codes alone.

    The codes give each similarity within a known error, so nothing that could count is left out. Members of a leaf are
    loaded in blocks of about ``most_in_block``; queries stream past them, whatever their number.
    """

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                n = int(-(-r.members // most_in_block))
                if n == 1:
                    rows.append((r.leaf, 0, r.stage, r.n, r.ids, r.codes, r.scales))
                    continue
                pack = Pack.read(r.ids, r.codes, r.scales)
                block = pack.ids % n
                for b in range(n):
                    for stage, part in ((0, block == b), (1, block != b)) if r.stage == 0 else ((1, block >= 0),):
                        if part.any():
                            rows.append((r.leaf, b, stage, *pack.take(np.flatnonzero(part)).row()))
            yield pd.DataFrame(rows, columns=["leaf", "block", *_COLUMNS[1:]])

    def compare(asking: Pack, inside: Pack) -> list[np.ndarray]:
        x, xe = inside.vectors(), inside.scales[:, 1]
        found = []
        for at in range(0, len(asking.ids), 1024):
            part = asking.take(np.arange(at, min(at + 1024, len(asking.ids))))
            near = part.vectors() @ x.T
            slack = part.scales[:, 1:] + (1 + part.scales[:, 1:]) * xe + 1e-5
            may = near + slack >= least
            if near.shape[1] > k and np.count_nonzero(may) > 8 * k * len(near):
                # a low threshold: what cannot beat the k best of its row goes before it is listed
                low = np.where(part.ids[:, None] == inside.ids[None], -np.inf, near - slack)
                may &= near + slack >= np.partition(low, -k, axis=1)[:, -k][:, None]
            i, j = np.nonzero(may)
            other = part.ids[i] != inside.ids[j]
            i, j = i[other], j[other]
            if not len(i):
                continue
            low, high = near[i, j] - slack[i, j], near[i, j] + slack[i, j]
            # no more than those that may be among the k best of this block can be among the k best of all
            order = np.lexsort((-low, i))
            place = np.arange(len(i)) - np.searchsorted(i[order], i[order])
            bar = np.full(len(part.ids), -2.0, dtype=np.float32)
            kth = order[place == k - 1]
            bar[i[kth]] = low[kth]
            keep = high >= bar[i]
            found.append(np.column_stack([part.ids[i[keep]], inside.ids[j[keep]]]))
        return found

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, members, inside = None, [], None
        for batch in batches:
            found: list[np.ndarray] = []
            for r in batch.itertuples(index=False):
                if (r.leaf, r.block) != here:
                    if members and inside is None:
                        whole = Pack.join(members)
                        found += compare(whole, whole)
                    here, members, inside = (r.leaf, r.block), [], None
                pack = Pack.read(r.ids, r.codes, r.scales)
                if r.stage == 0:
                    members.append(pack)
                    continue
                if inside is None and members:
                    inside = Pack.join(members)
                    found += compare(inside, inside)
                if inside is not None:
                    found += compare(pack, inside)
            yield _pairs(found)
        if members and inside is None:
            whole = Pack.join(members)
            yield _pairs(compare(whole, whole))

    if sizes.where(F.col("members") > most_in_block).isEmpty():  # the usual case: every leaf is one block
        dealt = routed.withColumn("block", F.lit(0))
    else:
        dealt = routed.join(sizes, "leaf").mapInPandas(deal, "leaf string, block int, stage int, n int, ids binary, codes binary, scales binary")
    streams = dealt.repartition("leaf", "block").sortWithinPartitions("leaf", "block", "stage")
    return streams.mapInPandas(meet, "a long, b long").distinct()


def _pairs(found: list[np.ndarray]) -> pd.DataFrame:
    both = np.concatenate(found) if found else np.zeros((0, 2), dtype=np.int64)
    both = np.unique(np.sort(both, axis=1), axis=0) if len(both) else both
    return pd.DataFrame({"a": both[:, 0], "b": both[:, 1]})


def nearest(
    vectors: DataFrame,
    k: int = 10,
    least: float = 0.9,
    dimension: int = 64,
    trees: int = 4,
    extra: int = 5,
    leaf_rows: int = 256,
    sample_rows: int = 20_000,
    most_in_block: int = 4096,
    crowded_rows: int = 4096,
    leaf_sample: int = 4096,
    seed: int = 7,
) -> DataFrame:
    """``(vec_id, other_id, similarity)``: for every vector up to ``k`` most similar others of at least ``least``.

    ``vectors`` has vec_id and embedding. The forest is fitted on at most ``sample_rows`` vectors (those with the
    smallest hashes) so that a leaf holds about ``leaf_rows`` of all rows; leaves that still hold more than
    ``crowded_rows`` are fitted anew, each on about ``leaf_sample`` of its own members, as often as needed, so leaves grow
    in number with the rows. These samples are the only bounded steps. Every vector goes to its own leaf in each tree,
    and as a query also to the ``extra`` next leaves of the queue shared by the trees. Leaves compare int8 codes first; pairs
    that the error of the codes does not rule out are then ranked by the exact vectors. Exact copies of a vector stand
    for each other in the index (one row each) and are joined back in the end, so that a hot vector never fills a leaf;
    leaves of more than ``most_in_block`` members are compared in blocks of members, without loss.

    Similarities are computed in double precision from the unit vectors, so a pair at the threshold counts. Ties at
    place k go to the smaller vec_id. Copies of one vector are each other's nearest, with similarity 1. An empty
    table gives an empty result.
    """
    spark = vectors.sparkSession
    units = unit_vectors(vectors, dimension)
    # equal vectors meet by their value; the partial aggregate folds copies before the shuffle
    reps = cut(units.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n_copies")))
    n_rows = reps.count()
    if n_rows < 1:
        return spark.createDataFrame([], "vec_id long, other_id long, similarity double")
    picked = reps.select("v", F.xxhash64("rep").alias("h"), "rep").orderBy("h", "rep").limit(sample_rows).select("v").toPandas()
    leaves = max(1, min(int(round(n_rows / leaf_rows)), len(picked) // 4))
    shared = spark.sparkContext.broadcast(fit_forest(_matrix(picked["v"], dimension), trees, leaves, seed))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest = shared.value
        for batch in batches:
            x = _matrix(batch["v"], dimension)
            pack = Pack(batch["rep"].to_numpy(), *quantised(x))
            steps = []
            for a in range(0, len(batch), 2000):
                row, leaf, own = forest.probe(x[a : a + 2000], extra)
                steps.append((row + a, leaf, own))
            if steps:
                yield pd.DataFrame(list(_packed(pack, *(np.concatenate(c) for c in zip(*steps)), str)), columns=_COLUMNS)

    routed = cut(spread(reps.select("rep", "v")).mapInPandas(route, _PACKED))
    done, sizes = [], None
    while True:
        sizes = routed.where("stage = 0").groupBy("leaf").agg(F.sum("n").alias("members"))
        if sizes.where(F.col("members") > crowded_rows).isEmpty():
            break
        over = sizes.where(F.col("members") > crowded_rows)
        largest = sizes.agg(F.max("members")).first()[0]
        split = cut(_split_crowded(routed, over, leaf_rows, leaf_sample, 2, seed))
        done.append(routed.join(over.select("leaf"), "leaf", "left_anti"))
        routed, before = split, largest
        if split.where("stage = 0").groupBy("leaf").agg(F.sum("n").alias("m")).agg(F.max("m")).first()[0] > 0.9 * before:
            break  # vectors that no plane parts: compared in blocks
    for part in done:
        routed = routed.unionByName(part)
    sizes = routed.where("stage = 0").groupBy("leaf").agg(F.sum("n").alias("members"))
    pairs = _candidates(routed, sizes, least, k, most_in_block)

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, y = (_matrix(batch[c], dimension).astype(np.float64) for c in ("va", "vb"))
            exact = np.einsum("ij,ij->i", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
            hold = exact >= least - 1e-9
            yield pd.DataFrame({"a": batch["a"].to_numpy()[hold], "b": batch["b"].to_numpy()[hold], "similarity": exact[hold]})

    by_id = reps.select("rep", "v")
    with_a = pairs.join(by_id.select(F.col("rep").alias("a"), F.col("v").alias("va")), "a")
    ranked = with_a.join(by_id.select(F.col("rep").alias("b"), F.col("v").alias("vb")), "b").mapInPandas(rank, "a long, b long, similarity double")
    near = ranked.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other")))).alias("p"), "similarity")
    near = near.select("p.id", "p.other", "similarity")
    best = near.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "other"))).where(F.col("place") <= k)
    # copies: every copy asks like its representative, and every copy of a neighbour is one
    several = reps.where("n_copies > 1")
    if several.isEmpty():
        return best.select(F.col("id").alias("vec_id"), F.col("other").alias("other_id"), "similarity")
    digest = F.md5("v").alias("digest")  # of 256 bytes only the digest travels
    joined = units.select("vec_id", digest).join(several.select("rep", digest), "digest").select("rep", "vec_id")
    copies = cut(joined).unionByName(reps.where("n_copies = 1").select("rep", F.col("rep").alias("vec_id")))
    links = best.select("id", "other", "similarity").unionByName(several.select(F.col("rep").alias("id"), F.col("rep").alias("other"), F.lit(1.0).alias("similarity")))
    # of each neighbour's copies the k + 1 smallest ids suffice for k places besides the asking vector itself
    few = copies.withColumn("c", F.row_number().over(Window.partitionBy("rep").orderBy("vec_id"))).where(F.col("c") <= k + 1)
    full = (
        links.join(few.select(F.col("rep").alias("other"), F.col("vec_id").alias("other_id")), "other")
        .join(copies.select(F.col("rep").alias("id"), "vec_id"), "id")
        .where("vec_id <> other_id")
        .select("vec_id", "other_id", "similarity")
    )
    return full.withColumn("place", F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("similarity"), "other_id"))).where(F.col("place") <= k).select("vec_id", "other_id", "similarity")


def similar_pairs(neighbours: DataFrame) -> DataFrame:
    """``(vec_id_a, vec_id_b)``: distinct pairs, smaller id first, of which one has the other among its nearest."""
    a, b = F.least("vec_id", "other_id"), F.greatest("vec_id", "other_id")
    return neighbours.select(a.alias("vec_id_a"), b.alias("vec_id_b")).distinct()


def recall(vectors: DataFrame, neighbours: DataFrame, every: int = 20, least: float = 0.9, k: int = 10, dimension: int = 64, block_rows: int = 32_768) -> DataFrame:
    """``(n_queries, n_true, n_found, recall)`` against brute force for the vectors whose id is divisible by ``every``.

    The queries meet all vectors in blocks: the query set is dealt into blocks of at most ``block_rows`` rows, each
    task of the vectors compares its batches with one broadcast block after the other.
    """
    spark = vectors.sparkSession
    units = unit_vectors(vectors, dimension)
    asked = units.where(F.col("vec_id") % every == 0)
    n_blocks = max(1, -(-asked.count() // block_rows))
    found = None
    for b in range(n_blocks):
        block = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == b).toPandas()
        if not len(block):
            continue
        shared = spark.sparkContext.broadcast((block["vec_id"].to_numpy(), _matrix(block["v"], dimension).astype(np.float64)))

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, q = shared.value
            q = q / np.linalg.norm(q, axis=1, keepdims=True)
            for batch in batches:
                x = _matrix(batch["v"], dimension).astype(np.float64)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                for a in range(0, len(q), 1024):
                    near = q[a : a + 1024] @ x.T
                    there = batch["vec_id"].to_numpy()
                    near[ids[a : a + 1024, None] == there[None]] = -np.inf
                    # what is not among the k best of a batch (with ties) is not among the k best of all
                    bar = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] > k else np.full(len(near), -np.inf)
                    i, j = np.nonzero((near >= least - 1e-9) & (near >= bar[:, None]))
                    yield pd.DataFrame({"vec_id": ids[a + i], "other_id": there[j], "similarity": near[i, j]})

        part = units.mapInPandas(scan, "vec_id long, other_id long, similarity double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "n_queries long, n_true long, n_found long, recall double")
    place = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("similarity"), "other_id"))
    true = found.withColumn("place", place).where(F.col("place") <= k).select("vec_id", "other_id")
    got = true.join(neighbours.select("vec_id", "other_id", F.lit(1).alias("hit")), ["vec_id", "other_id"], "left")
    return got.agg(F.countDistinct("vec_id").alias("n_queries"), F.count("*").alias("n_true"), F.count("hit").alias("n_found"), (F.count("hit") / F.count("*")).alias("recall"))
