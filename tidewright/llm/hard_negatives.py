"""Hard-negative mining by vantage-point trees over norm-augmented vectors.

Every vector gets one more component, so that all have the norm ``m`` of the
longest; an anchor gets a zero there. Then
``distance(anchor, row)**2 = |anchor|**2 + m**2 - 2 * score``: higher scores are
nearer, and a window of scores is an annulus around the anchor.

1. The top of one tree is fitted on a bounded sample (``SAMPLE`` rows, chosen by
   hash); every row is routed down it to a cell, and all rows give the exact
   bounds of each cell's distances to the vantage points above it. Cells are cut
   by hash in blocks of about ``BLOCK`` rows, whatever they hold, so one crowded
   place is many blocks.
2. A task makes the tree of its block down to leaves of ``LEAF`` rows and answers
   a bounded group of anchors: subtrees are taken nearest first, none outside the
   annulus, and the search ends when the next subtree lies beyond the k-th row
   found. Scores are exact integers.
3. An anchor first searches the cell it would itself be in. What it finds there
   narrows the annulus for all other cells, and only those that the annulus meets
   are searched. No row is lost: bounds hold for every row, and blocks give their
   own first k.

Positives and negatives are two such searches: the first among rows of the same
label, the second among all others with one window a positive.

Defined cases: rows with a null id, label or vector, or any null or non-finite
component, take no part; shorter vectors (also empty ones) end in zeros; rows
that repeat a vec_id are rows of their own, and only the anchor's own row is not
its positive; ties go by smaller vec_id; an anchor without positives, or a
positive of a negative score (whose window is empty), gives no row; scores that
could pass 55 bits raise ValueError; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.workspace import Scratch, hold, written

POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
#: Rows that the top of the tree is fitted on, and the most levels it has.
SAMPLE, LEVELS = 4096, 8
#: Rows of a block, rows of a leaf, anchors that a task answers.
BLOCK, LEAF, ANCHORS = 4096, 512, 4096
FAR, MOST = 1 << 62, 1 << 55
_WINDOWS = "array<struct<w:int,lo:bigint,hi:bigint>>"


def scaled(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label and vec (integers, ``floor(scale * x)``) of the rows that take part."""
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = embeddings.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    vec = F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), vec.alias("vec"))


def matrix(vectors: pa.Array, size: int) -> np.ndarray:
    """Rows of integers as doubles; short vectors end in zeros."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
    if (lengths == size).all():
        return flat.reshape(-1, size)
    out = np.zeros((len(lengths), size))
    starts = np.cumsum(lengths) - lengths
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(starts, lengths)] = flat
    return out


def inner(a: np.ndarray, b: np.ndarray, wide: bool) -> np.ndarray:
    """Exact inner products; ``wide`` where doubles could round them."""
    return a.astype(np.int64) @ b.astype(np.int64).T if wide else a @ b.T


class Space:
    """The norm-augmented space: its sphere's squared radius, the vectors' size, how scores are summed."""

    def __init__(self, squared: float, size: int, wide: bool) -> None:
        self.squared, self.size, self.wide = squared, size, wide
        self.slack = 1e-6 * (1 + squared**0.5)

    def extra(self, vectors: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.squared - (vectors * vectors).sum(axis=1), 0))

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances of rows to rows."""
        both = a @ b.T + np.outer(self.extra(a), self.extra(b))
        return np.sqrt(np.maximum(2 * (self.squared - both), 0))

    def reach(self, anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Distances of anchors to rows."""
        own = (anchors * anchors).sum(axis=1)[:, None]
        return np.sqrt(np.maximum(own + self.squared - 2 * (anchors @ rows.T), 0))

    def radius(self, anchor_squared: float, score: float) -> float:
        """Distance of a row with ``score`` from an anchor."""
        return max(anchor_squared + self.squared - 2 * score, 0) ** 0.5


class Top:
    """The upper levels of the tree: a vantage point and a radius for each inner node of a full binary tree."""

    def __init__(self, sample: np.ndarray, space: Space, levels: int, seed: int = 7) -> None:
        self.space, self.levels = space, levels
        rng = np.random.default_rng(seed)
        inner_nodes = (1 << levels) - 1
        self.points, self.radii = np.zeros((inner_nodes, space.size)), np.zeros(inner_nodes)
        own = {0: np.arange(len(sample))}
        for node in range(inner_nodes):
            rows = own.pop(node)
            if len(rows):
                self.points[node] = sample[rows[rng.integers(len(rows))]]
            apart = space.between(sample[rows], self.points[node : node + 1])[:, 0]
            self.radii[node] = np.median(apart) if len(rows) else 0.0
            own[2 * node + 1], own[2 * node + 2] = rows[apart <= self.radii[node]], rows[apart > self.radii[node]]
        cells = np.arange(1 << levels)
        #: The inner nodes above each cell, from the root down.
        self.above = np.array([[(1 << k) - 1 + (c >> (levels - k)) for k in range(levels)] for c in cells], int).reshape(len(cells), levels)

    def route(self, distances: np.ndarray) -> np.ndarray:
        """Cells of rows with these distances to all vantage points."""
        node = np.zeros(len(distances), int)
        for _ in range(self.levels):
            node = 2 * node + 1 + (distances[np.arange(len(distances)), node] > self.radii[node])
        return node - ((1 << self.levels) - 1)

    def bounds(self, distances: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and most distance of each anchor (a row) to each cell (a column)."""
        least, most = np.zeros((len(distances), len(self.above))), np.full((len(distances), len(self.above)), np.inf)
        for k in range(self.levels):
            at = distances[:, self.above[:, k]]
            least = np.maximum(least, np.maximum(at - high[:, k], low[:, k] - at))
            most = np.minimum(most, at + high[:, k])
        return least, most


class Tree:
    """The tree of one block, with leaves of ``leaf`` rows."""

    def __init__(self, vectors: np.ndarray, space: Space, leaf: int = LEAF, seed: int = 3) -> None:
        self.space = space
        rng = np.random.default_rng(seed)
        self.order = np.arange(len(vectors))
        points: list[int] = []
        #: (start, end) of leaves; (point, (child, least, most), (child, least, most)) of inner nodes.
        self.nodes: list[tuple] = []

        def grow(start: int, end: int) -> int:
            place = len(self.nodes)
            self.nodes.append((start, end))
            if end - start > leaf:
                rows = self.order[start:end]
                point = int(rows[rng.integers(len(rows))])
                apart = space.between(vectors[rows], vectors[point : point + 1])[:, 0]
                half = len(rows) // 2
                cut = np.argpartition(apart, half)
                self.order[start:end], apart = rows[cut], apart[cut]
                points.append(point)
                number = len(points) - 1
                near = (grow(start, start + half), apart[:half].min(), apart[:half].max())
                far = (grow(start + half, end), apart[half:].min(), apart[half:].max())
                self.nodes[place] = (number, near, far)
            return place

        grow(0, len(vectors))
        self.points = vectors[points] if points else np.zeros((0, space.size))
        self.vectors = vectors[self.order]


class Asked:
    """The windows of one anchor and the first k rows of each, as they are found."""

    def __init__(self, windows: list[dict], k: int) -> None:
        self.k = k
        self.names = [x["w"] for x in windows]
        self.low, self.high = [x["lo"] for x in windows], [x["hi"] for x in windows]
        self.found = [(np.zeros(0), np.zeros(0, np.int64))] * len(windows)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        for n, (low, high) in enumerate(zip(self.low, self.high)):
            fits = np.flatnonzero((scores >= low) & (scores <= high))
            if len(fits):
                s, i = np.concatenate([self.found[n][0], scores[fits]]), np.concatenate([self.found[n][1], ids[fits]])
                first = np.lexsort((i, -s))[: self.k]
                self.found[n] = s[first], i[first]
                if len(first) == self.k:
                    self.low[n] = max(low, int(s[first[-1]]))


def nearest(tree: Tree, anchor: np.ndarray, reach: np.ndarray, asked: Asked, allowed: np.ndarray, ids: np.ndarray) -> None:
    """Incremental nearest-first traversal inside the annulus of ``asked``."""
    space, own = tree.space, float(anchor @ anchor)
    inside = space.radius(own, max(asked.high)) - space.slack
    heap = [(0.0, np.inf, 0)]
    while heap:
        least, most, place = heapq.heappop(heap)
        if least > space.radius(own, min(asked.low)) + space.slack:
            return
        node = tree.nodes[place]
        if len(node) == 2:
            start, end = node
            scores = inner(tree.vectors[start:end], anchor[None, :], space.wide)[:, 0]
            held = np.flatnonzero(allowed[start:end] & (scores >= min(asked.low)) & (scores <= max(asked.high)))
            if len(held):
                asked.add(scores[held], ids[start:end][held])
            continue
        at = reach[node[0]]
        for child, low, high in node[1:]:
            near, far = max(least, at - high, low - at), min(most, at + high)
            if far >= inside and near <= space.radius(own, min(asked.low)) + space.slack:
                heapq.heappush(heap, (near, far, child))


class Index:
    """All rows in blocks of cells, and the top of the tree."""

    def __init__(self, vectors: DataFrame, levels: int | None = None, block: int = BLOCK) -> None:
        spark = vectors.sparkSession
        rows = written(vectors.withColumn("row", F.monotonically_increasing_id()), "negatives-rows")
        squares = F.aggregate("vec", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
        n, size, most, longest = rows.agg(F.count("*"), F.max(F.size("vec")), F.max(F.greatest(*[F.abs(f("vec").cast("double")) for f in (F.array_max, F.array_min)])), F.max(squares)).first()
        size, most = size or 0, int(most or 0)
        if max(size, 1) * most * most >= MOST:
            raise ValueError("vectors are too large for scores of 55 bits")
        self.space = Space(float(longest or 0), max(size, 1), max(size, 1) * most * most >= 1 << 53)
        if levels is None:
            levels = min(max(int(np.ceil(np.log2(max(n, 1) / block))), 0), LEVELS)
        sample = rows.orderBy(F.xxhash64("vec_id", "row"), "row").limit(SAMPLE).select("vec").toArrow()
        self.top = Top(matrix(sample.column(0), self.space.size), self.space, levels)
        top = spark.sparkContext.broadcast(self.top)  # 255 vectors at most

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hold("negatives")
            for batch in batches:
                apart = top.value.space.between(matrix(batch.column("vec"), top.value.space.size), top.value.points)
                cells = top.value.route(apart)
                own = apart[np.arange(len(cells))[:, None], top.value.above[cells]].reshape(-1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(cells) + 1) * levels, pa.int32()), pa.array(own, pa.float64()))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.int32()), lists], names=[*batch.schema.names, "cell", "apart"])

        routed = written(rows.mapInArrow(route, "vec_id long, label long, vec array<long>, row long, cell int, apart array<double>"), "negatives-routed")
        ends = [f(F.get("apart", F.lit(k))).alias(f"{name}{k}") for name, f in (("low", F.min), ("high", F.max)) for k in range(levels)]
        self.low, self.high = np.full((1 << levels, levels), np.inf), np.full((1 << levels, levels), -np.inf)
        self.blocks = np.zeros(1 << levels, int)
        for r in routed.groupBy("cell").agg(F.count("*").alias("n"), *ends).collect():  # one row a cell
            self.blocks[r["cell"]] = -(-r["n"] // block)
            self.low[r["cell"]], self.high[r["cell"]] = ([r[f"{x}{k}"] for k in range(levels)] for x in ("low", "high"))
        first = np.concatenate([[0], np.cumsum(self.blocks)])
        places = spark.createDataFrame([(c, int(first[c]), int(self.blocks[c])) for c in range(1 << levels)], "cell int, first int, blocks int")
        number = F.col("first") + F.pmod(F.xxhash64("row"), F.greatest("blocks", F.lit(1))).cast("int")
        self.rows = routed.join(F.broadcast(places), "cell").select("row", "vec_id", "label", "vec", number.alias("block"))

    def homes(self, queries: DataFrame) -> DataFrame:
        """``queries`` with ``first``: the cell an anchor searches first, its own one or else the nearest that its annulus meets."""
        return self._met(queries, "first int", lambda top, reach, meets, least, _: {"first": _first(top, reach, meets, least)})

    def visits(self, queries: DataFrame, now: bool, groups: int) -> DataFrame:
        """``queries`` with a row for each block to search: those of the first cell ``now``, or those of all others that meet the annulus."""
        sizes, ends = self.blocks, np.cumsum(self.blocks)

        def chosen(top: Top, reach: np.ndarray, meets: np.ndarray, least: np.ndarray, batch: pa.RecordBatch) -> dict[str, np.ndarray]:
            own = np.arange(meets.shape[1]) == batch.column("first").to_numpy()[:, None]
            query, cell = np.nonzero(meets & (own if now else ~own))
            count = sizes[cell]
            query, cell = np.repeat(query, count), np.repeat(cell, count)
            block = ends[cell] - sizes[cell] + np.arange(len(cell)) - np.repeat(np.cumsum(count) - count, count)
            return {"query": query, "block": block, "part": batch.column("anchor").to_numpy()[query] % groups}

        return self._met(queries, "block int, part int", chosen)

    def _met(self, queries: DataFrame, added: str, choose) -> DataFrame:
        """``queries`` and columns that ``choose`` makes of their distances to vantage points and cells; ``query`` among them picks rows."""
        shared = queries.sparkSession.sparkContext.broadcast((self.top, self.low, self.high, self.blocks))  # bounded by LEVELS
        names = [x.split()[0] for x in added.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hold("negatives")
            top, low, high, blocks = shared.value
            space = top.space
            for whole in batches:
                for at in range(0, whole.num_rows, 256):
                    batch = whole.slice(at, 256)
                    vectors = matrix(batch.column("vec"), space.size)
                    reach = space.reach(vectors, top.points)
                    least, most = top.bounds(reach, low, high)
                    own, windows = (vectors * vectors).sum(axis=1), batch.column("windows").to_pylist()
                    inside = np.array([space.radius(o, max(x["hi"] for x in w)) for o, w in zip(own, windows)]) - space.slack
                    outside = np.array([space.radius(o, min(x["lo"] for x in w)) for o, w in zip(own, windows)]) + space.slack
                    meets = (blocks > 0) & (least <= outside[:, None]) & (most >= inside[:, None])
                    made = choose(top, reach, meets, least, batch)
                    taken = batch if "query" not in made else batch.take(pa.array(made["query"]))
                    yield pa.RecordBatch.from_arrays([*taken.columns, *[pa.array(made[x].astype(np.int32)) for x in names]], names=[*batch.schema.names, *names])

        own = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema)
        return queries.mapInArrow(run, f"{own}, {added}")

    def search(self, queries: DataFrame, k: int, same: bool, anchors: int) -> DataFrame:
        """anchor, w, vec_id, score, rank: the first ``k`` rows of every window (lo <= score <= hi) of ``queries``.

        ``queries``: anchor (its row), label, vec, windows. Rows of the anchor's
        label are searched if ``same``, else all others.
        """
        space, groups = self.space, -(-max(anchors, 1) // ANCHORS)
        rows = self.rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

        def answer(held: pa.Table, asked: pa.Table) -> pa.Table:
            hold("negatives")
            out: list[tuple] = []
            if held.num_rows and asked.num_rows:
                tree = Tree(matrix(held.column("vec"), space.size), space)
                row, ids, label = (held.column(x).to_numpy()[tree.order] for x in ("row", "vec_id", "label"))
                vectors = matrix(asked.column("vec"), space.size)
                reach = space.reach(vectors, tree.points)
                for n, (anchor, own, windows) in enumerate(zip(*(asked.column(x).to_pylist() for x in ("anchor", "label", "windows")))):
                    state = Asked(windows, k)
                    allowed = ((label == own) & (row != anchor)) if same else label != own
                    nearest(tree, vectors[n], reach[n], state, allowed, ids)
                    for w, (scores, found) in zip(state.names, state.found):
                        out += [(anchor, w, i, int(s)) for s, i in zip(scores.tolist(), found.tolist())]
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
            return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, types)], names=["anchor", "w", "vec_id", "score"])

        order = Window.partitionBy("anchor", "w").orderBy(F.desc("score"), "vec_id")

        def ranked(found: DataFrame) -> DataFrame:
            return found.select("anchor", "w", "vec_id", "score", F.row_number().over(order).alias("rank")).filter(F.col("rank") <= k)

        def visited(asked: DataFrame, now: bool) -> DataFrame:
            blocks = self.visits(asked, now, groups).groupBy("block", "part")
            return rows.groupBy("block", "part").cogroup(blocks).applyInArrow(answer, "anchor long, w int, vec_id long, score long")

        asked = written(self.homes(queries), "negatives-asked")
        near = written(ranked(visited(asked, True)), "negatives-near")
        # Where the first cell has k rows of a window, its k-th score is the window's new lower end.
        ends = near.groupBy("anchor", "w").agg(F.min("score").alias("score"), F.count("*").alias("n")).filter(F.col("n") == k)
        ends = ends.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("ends"))
        raised = F.transform("windows", lambda x: F.struct(x["w"].alias("w"), F.coalesce(F.try_element_at("ends", x["w"]), x["lo"]).alias("lo"), x["hi"].alias("hi")))
        narrowed = asked.join(ends, "anchor", "left").withColumn("windows", F.when(F.col("ends").isNull(), F.col("windows")).otherwise(raised).cast(_WINDOWS)).drop("ends")
        far = written(visited(narrowed, False), "negatives-far")
        return ranked(near.drop("rank").unionByName(far))


def _first(top: Top, reach: np.ndarray, meets: np.ndarray, least: np.ndarray) -> np.ndarray:
    home = top.route(reach)
    return np.where(meets[np.arange(len(home)), home], home, np.where(meets, least, np.inf).argmin(axis=1))


def mine(vectors: DataFrame, is_anchor: F.Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, **options) -> DataFrame:
    """Hard negatives of the anchors among ``vectors`` (vec_id, label, vec).

    For each anchor and each of its first ``positives`` rows of the same label: the
    first ``negatives`` rows of other labels with ``low`` to ``high`` percent of
    the positive's score. anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score.
    """
    with Scratch(vectors.sparkSession) as scratch:
        index = Index(vectors, **options)
        anchors = index.rows.filter(is_anchor)
        count = anchors.count()
        everything = F.array(F.struct(F.lit(0).alias("w"), F.lit(-FAR).alias("lo"), F.lit(FAR).alias("hi"))).cast(_WINDOWS)
        queries = written(anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"), "label", "vec", everything.alias("windows")), "negatives-anchors")
        found = index.search(queries.select("anchor", "label", "vec", "windows"), positives, True, count)
        found = written(found.select("anchor", F.col("rank").alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")
        # Exact integers: the least and the most score within the percents.
        lo, hi = (F.expr(f"{sign}({x} - pmod({x}, 100L)) div 100L") for sign, x in (("-1L * ", f"(-1L * {low} * positive_score)"), ("", f"({high} * positive_score)")))
        windows = found.select("anchor", F.struct("w", lo.alias("lo"), hi.alias("hi")).alias("x")).filter("x.lo <= x.hi")
        windows = windows.groupBy("anchor").agg(F.collect_list("x").alias("windows"))  # ``positives`` at most
        asked = written(queries.drop("windows").join(windows, "anchor").select("anchor", "label", "vec", F.col("windows").cast(_WINDOWS).alias("windows")), "negatives-windows")
        chosen = written(index.search(asked, negatives, False, count), "negatives-found")
        scratch.keep(queries, found, chosen)
    named = chosen.select("anchor", "w", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(found, ["anchor", "w"])
    return named.join(queries.select("anchor", "anchor_id"), "anchor").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
