"""Gradient boosting of regression trees over histograms, all folds in the same jobs.

A row's features are cut into bins once. Rows of the same bins always end in the same node, so a model is trained on kinds:
the distinct bins of its training rows, with how many rows have them and the sum of their targets. A job then grows one level of one
tree of every fold's model: tasks sum residuals and rows by (node, feature, bin) of their own kinds, the sums meet by (model, feature),
where each node's best cut is chosen, and only those cuts reach the driver. A finished tree is added to the kinds' predictions once. So a tree costs as many jobs as it has levels, whatever the number of
folds, and what is shuffled and collected is bounded by settings and not by rows.

Sums are exact: targets and predictions are rounded to a unit small enough for the target and large enough that no sum leaves 64 bits,
and added as integers. Trees therefore don't depend on how rows are dealt, nor on tasks that are run again after a loss.

Categories enter by ordered target statistics (``ordered_statistics``): a row is told the mean target of the rows of its
category before it in a seeded order, never its own. A model k is trained on rows whose fold isn't k, and predicts the rows
of fold k; rows without a target train nothing.

Trees are symmetric (one cut for all nodes of a level), or grown best node first up to ``leaves`` leaves.
"""

from __future__ import annotations

import heapq
import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.operators.ranking import quantiles, running_total
from plinth.storage import checkpoint, compact, release, spread

#: Most bits of a rounded target, and the lower bits of a sum that are added apart from the others: as doubles both are added without loss.
_MOST_BITS, _LOW_BITS = 38, 20
#: Kinds a task of a level's job has, about.
_TASK_ROWS = 50_000


@dataclass(frozen=True)
class Settings:
    """``leaves``: most leaves of a tree grown best first (None: no bound but depth); ``least``: rows a leaf must have (symmetric trees: 1)."""

    rounds: int = 300
    rate: float = 0.05
    depth: int | None = 6
    l2: float = 0.0
    least: int = 1
    bins: int = 128
    leaves: int | None = None
    symmetric: bool = False
    staged: int = 20  # trees after which kinds' predictions are written


@dataclass
class Tree:
    """Nodes by number: feature (-1: leaf), the largest bin that goes left, the left child (the right one follows), value."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int, gain: float, values: tuple[float, float]) -> int:
        self.feature[node], self.cut[node], self.left[node], self.gain[node] = feature, cut, len(self.feature), gain
        for v in values:
            for column, x in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.value, v), (self.gain, 0.0)):
                column.append(x)
        return self.left[node]

    def arrays(self) -> tuple[np.ndarray, ...]:
        return np.array(self.feature), np.array(self.cut), np.array(self.left), np.array(self.value)


def _land(tree: tuple[np.ndarray, ...], bins: np.ndarray) -> np.ndarray:
    """The node at which each row of ``bins`` (rows, features) ends."""
    feature, cut, left, _ = tree
    at, rows = np.zeros(len(bins), dtype=np.int64), np.arange(len(bins))
    while True:
        f = feature[at]
        inner = f >= 0
        if not inner.any():
            return at
        right = bins[rows, np.maximum(f, 0)] > cut[at]
        at = np.where(inner, left[at] + right, at)


def ordered_statistics(df: DataFrame, column: str, target: str, models: int, key: str, fold: str = "fold", seed: int = 42, weight: float = 1.0) -> DataFrame:
    """Replace a text column by an array: for each model, the category's mean target over the model's training rows before this one.

    The order is that of a seeded hash of ``key``; a row that model k predicts is told the mean over all training rows of k.
    Each mean is drawn to the mean of the model's training rows as by ``weight`` rows; of a new category it is that. Nulls are a
    category of their own. Sums come from one running total over all categories, less what stands before the category,
    so that a category of any size is dealt over many tasks.
    """
    unit = _unit(df, target)
    y = F.round(F.col(target) / unit)
    rows = df.withColumns({column: F.coalesce(F.col(column).cast("string"), F.lit("missing")), "__h": F.xxhash64(F.lit(seed), key)})
    trains = [F.col(target).isNotNull() & (F.col(fold) != k) for k in range(models)]
    parts = {f"__{n}{k}": F.when(t, v) for k, t in enumerate(trains) for n, v in (("s", y), ("n", F.lit(1)))}
    order = ["__h", key, target]
    held = running_total(checkpoint(rows), [F.col(column), *(F.col(c) for c in order)], parts)
    starts = held.groupBy(F.col(column).alias("__level")).agg(
        *(F.min_by(n, F.struct(*order)).alias(f"{n}_start") for n in parts), *(F.sum(v).cast("long").alias(f"{n}_all") for n, v in parts.items())
    )
    starts = checkpoint(starts)
    total = starts.agg(*(F.sum(f"{n}_all").alias(n) for n in parts)).first()

    def mean(k: int):
        prior = (total[f"__s{k}"] or 0) * unit / (total[f"__n{k}"] or 1)
        told = [F.when(trains[k], F.col(f"__{n}{k}") - F.col(f"__{n}{k}_start")).otherwise(F.coalesce(f"__{n}{k}_all", F.lit(0))) for n in "sn"]
        return F.coalesce(F.try_divide(told[0] * unit + weight * prior, told[1] + weight), F.lit(prior))

    met = held.join(starts, F.col(column) == F.col("__level"))
    return met.withColumn(column, F.array(*(mean(k) for k in range(models)))).select(*df.columns)


def ordered_codes(df: DataFrame, column: str, target: str, models: int, fold: str = "fold") -> DataFrame:
    """Replace a text column by an array: for each model, the place of its level among the sorted ones; -1 for a level that the model
    isn't trained on, and the most frequent level's (ties: the smallest) for nulls."""
    trained = [F.count_if(F.col(target).isNotNull() & (F.col(fold) != k)).alias(f"__n{k}") for k in range(models)]
    levels = checkpoint(df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("__level")).agg(*trained))
    levels = checkpoint(running_total(levels, [F.col("__level")], {"__code": F.lit(1)}))
    modes = levels.agg(*(F.max_by("__code", F.struct(f"__n{k}", -F.col("__code"))).alias(f"m{k}") for k in range(models))).first()
    code = [F.when(F.col(column).isNull(), F.lit(float(modes[f"m{k}"] or 0))).when(F.col(f"__n{k}") > 0, F.col("__code").cast("double")).otherwise(-1.0) for k in range(models)]
    return df.join(levels, F.col(column).cast("string") == F.col("__level"), "left").withColumn(column, F.array(*code)).select(*df.columns)


def _unit(df: DataFrame, target: str) -> float:
    """A power of two: targets of ``df`` as whole numbers of it have sums within 64 bits."""
    seen = df.agg(F.max(F.abs(target)).alias("y"), F.count(target).alias("n")).first()
    bits = min(_MOST_BITS, 61 - int(seen["n"]).bit_length())
    return 2.0 ** (int(np.frexp(seen["y"] or 1.0)[1]) + 1 - bits)  # a residual is at most about twice the target


def _borders(df: DataFrame, numbers: list[str], text: list[str], target: str, models: int, bins: int, fill: bool) -> list[list[tuple[np.ndarray, float]]]:
    """By model and feature: the values that part bins, and what a missing value is (its training rows' median, or nan: below all)."""
    qs = [0.5, *(i / (bins - 1) for i in range(1, bins - 1))]
    out = []
    for k in range(models):
        trains = F.col(target).isNotNull() & (F.col("fold") != k)
        columns = {f"f{i}": F.when(trains & ~F.isnan(v), v) for i, v in enumerate([*(F.col(c).cast("double") for c in numbers), *(F.col(c)[k] for c in text)])}
        row = quantiles(df, {n: (v, qs) for n, v in columns.items()}, 50_000).first()
        of_model = []
        for n in columns:
            found = [float(v) for v in row[n] or [] if v is not None]
            of_model.append((np.unique(found[1:]), (found[0] if found else 0.0) if fill else np.nan))
        out.append(of_model)
    return out


def _binned(df: DataFrame, numbers: list[str], text: list[str], target: str, keep: list[str], borders: list) -> DataFrame:
    """keep, fold, target, and a byte a model and feature: 0 for missing values, else one more than the borders below the value."""
    models, width = len(borders), len(numbers) + len(text)
    schema = df.select(*keep, "fold", F.col(target).cast("double").alias("y")).schema.add("bins", "binary")
    names = [f.name for f in schema.fields[:-1]]
    rows = df.select(*keep, F.col("fold").cast("int").alias("fold"), F.col(target).cast("double").alias("y"), *(F.col(c).cast("double").alias(f"__f{i}") for i, c in enumerate(numbers)), *(F.col(c).alias(f"__t{i}") for i, c in enumerate(text)))

    def cut(batches):
        for batch in batches:
            n = batch.num_rows
            out = np.zeros((n, models, width), dtype=np.uint8)
            plain = [batch.column(f"__f{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(len(numbers))]
            coded = [np.asarray(batch.column(f"__t{i}").flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(n, models) for i in range(len(text))]
            for k in range(models):
                for f, (at, missing) in enumerate(borders[k]):
                    v = plain[f] if f < len(plain) else coded[f - len(plain)][:, k]
                    v = np.where(np.isnan(v), missing, v)
                    out[:, k, f] = np.where(np.isnan(v), 0, 1 + np.searchsorted(at, v, side="left"))
            blob = pa.array([r.tobytes() for r in out], type=pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), blob], [*names, "bins"])

    return rows.mapInArrow(cut, schema)


def _kinds(table: DataFrame, models: int, width: int, unit: float) -> DataFrame:
    """(k, b, n, s, said): each model's distinct training bins, how many rows have them, the sum of their targets in units, and what is predicted so far."""
    of_model = F.array(*(F.when(F.col("fold") != k, F.substring("bins", k * width + 1, width)) for k in range(models)))
    rows = table.where("y IS NOT NULL").select(F.round(F.col("y") / unit).cast("long").alias("y"), F.posexplode(of_model).alias("k", "b")).where("b IS NOT NULL")
    return spread(rows, "k", "b").groupBy("k", "b").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s")).withColumn("said", F.lit(0.0))


def _parts(batch: pa.RecordBatch, width: int):
    """(model, columns n, s and said by name, bins by kind and feature, where its kinds stand) of a batch, by model."""
    k = batch.column("k").to_numpy(zero_copy_only=False)
    bins = np.frombuffer(b"".join(batch.column("b").to_pylist()), dtype=np.uint8).reshape(len(k), width)
    held = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("n", "s", "said")}
    for model in np.unique(k).tolist():
        at = np.flatnonzero(k == model)
        yield model, {c: v[at] for c, v in held.items()}, bins[at], at


def _with_trees(said: np.ndarray, trees: list, bins: np.ndarray) -> np.ndarray:
    """One model's predictions after further trees."""
    for tree in trees:
        said = said + tree[3][_land(tree, bins)]
    return said


def _gains(g: np.ndarray, n: np.ndarray, l2: float, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By node and cut (after each bin but the last): the gain, and the left side's sum and rows. ``g``, ``n``: (nodes, bins), whole numbers."""
    left_g, left_n = np.cumsum(g, 1), np.cumsum(n, 1)
    all_g, all_n = left_g[:, -1:], left_n[:, -1:]
    left_g, left_n = left_g[:, :-1], left_n[:, :-1]

    def score(s, rows):
        return s.astype(float) ** 2 / np.maximum(rows + l2, 1e-300)

    gain = score(left_g, left_n) + score(all_g - left_g, all_n - left_n) - score(all_g, all_n)
    return np.where((left_n >= least) & (all_n - left_n >= least), gain, -np.inf), left_g, left_n


def _blocks(kinds: DataFrame, width: int) -> RDD:
    """The kinds as pickled arrays, a batch and model each: what a level's job reads again and again needs no planning and no conversion.

    Kept in memory and on disk; what is lost is made again from the checkpointed kinds.
    """

    def pack(batches):
        for batch in batches:
            blocks = [pickle.dumps((k, bins, held["n"], held["s"], held["said"])) for k, held, bins, _ in _parts(batch, width)]
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.binary())], ["block"])

    packed = kinds.sortWithinPartitions("k").mapInArrow(pack, "block binary")
    return packed.rdd.map(lambda r: bytes(r[0])).persist(StorageLevel.MEMORY_AND_DISK)


def _advanced(blocks: RDD, made: list) -> RDD:
    """The blocks after one more tree of each model."""

    def add(block):
        k, bins, n, s, said = pickle.loads(block)
        return pickle.dumps((k, bins, n, s, _with_trees(said, [made[k]], bins)))

    return blocks.map(add).persist(StorageLevel.MEMORY_AND_DISK)


def _level(blocks: RDD, growing: list, fronts: list[list[int]], base: list[float], unit: float, width: int, s: Settings) -> list[dict]:
    """One job: for every model and feature, the best cut of each node of its front (symmetric trees: of all nodes alike)."""
    models, bins = len(fronts), s.bins + 1
    slots = []
    for tree, front in zip(growing, fronts, strict=True):
        place = np.full(len(tree[0]), -1)
        place[front] = np.arange(len(front))
        slots.append(place)

    def sums(packed):
        held = [np.zeros((2, width * len(front) * bins), dtype=np.int64) for front in fronts]
        offsets = np.arange(width) * bins
        for block in packed:
            k, own, n, s_y, said = pickle.loads(block)
            if not fronts[k]:
                continue
            slot = slots[k][_land(growing[k], own)]
            if (slot < 0).any():
                own, n, s_y, said, slot = (v[slot >= 0] for v in (own, n, s_y, said, slot))
            g = s_y - n * np.rint((base[k] + said) / unit).astype(np.int64)
            at = (slot[:, None] * width * bins + offsets + own).ravel()
            high = g >> _LOW_BITS
            for to, values, shift in ((0, g - (high << _LOW_BITS), 0), (0, high, _LOW_BITS), (1, n, 0)):
                held[k][to] += np.bincount(at, np.repeat(values, width), held[k].shape[1]).astype(np.int64) << shift
        for k, both in enumerate(held):
            if fronts[k] and both[1].any():
                both = both.reshape(2, len(fronts[k]), width, bins)
                for f in range(width):
                    yield (k, f), np.ascontiguousarray(both[:, :, f])

    def choose(summed):
        (k, f), (g, n) = summed
        gain, left_g, left_n = _gains(g, n, s.l2, 0 if s.symmetric else s.least)
        if s.symmetric:  # one cut for the level: the largest sum over its nodes, the first of equals
            gain = gain.sum(0, keepdims=True)
        best = gain.argmax(1)
        rows, at = np.arange(len(g)), np.broadcast_to(best, (len(g),))
        told = {"gain": gain[np.arange(len(gain)), best], "cut": best, "left_g": left_g[rows, at], "left_n": left_n[rows, at], "all_g": g.sum(1), "all_n": n.sum(1)}
        return {"model": k, "feature": f, **{c: v.tolist() for c, v in told.items()}}

    found = blocks.mapPartitions(sums)
    if blocks.getNumPartitions() > 1:
        found = found.reduceByKey(np.add, min(blocks.getNumPartitions(), models * width))
    return found.map(choose).collect()  # a row a model and feature


def _opened(tree: Tree, most: int | None) -> set[int]:
    """The nodes whose cuts are kept when the largest gain goes first and ``most`` leaves are the bound."""
    queue, kept = [(-tree.gain[0], 0)] if tree.feature[0] >= 0 else [], set()
    while queue and (most is None or len(kept) + 1 < most):
        _, node = heapq.heappop(queue)
        kept.add(node)
        for child in (tree.left[node], tree.left[node] + 1):
            if tree.feature[child] >= 0:
                heapq.heappush(queue, (-tree.gain[child], child))
    return kept


def _pruned(tree: Tree, most: int | None) -> Tree:
    """The tree with only the cuts that ``_opened`` keeps."""
    kept, out = _opened(tree, most), Tree(value=[tree.value[0]])
    todo = [(0, 0)]
    while todo:
        node, to = todo.pop()
        if node in kept:
            child = tree.left[node]
            made = out.split(to, tree.feature[node], tree.cut[node], tree.gain[node], (tree.value[child], tree.value[child + 1]))
            todo += [(child, made), (child + 1, made + 1)]
    return out


def _grow(tree: Tree, front: list[int], rows: list, s: Settings, unit: float) -> list[int]:
    """Split the nodes of ``front`` as the level's ``rows`` say; the nodes to look at next."""
    if not rows:
        return []
    at_root = front == [0]

    def value(g: int, n: int) -> float:
        return s.rate * g * unit / (n + s.l2) if n else 0.0

    if at_root:
        tree.value[0] = value(rows[0]["all_g"][0], rows[0]["all_n"][0])
    after = []
    for i, node in enumerate(front):
        best = min(rows, key=lambda r: (-r["gain"][0 if s.symmetric else i], r["feature"]))
        gain, cut = (best[c][0 if s.symmetric else i] for c in ("gain", "cut"))
        if not gain > 0:
            continue
        g, n, all_g, all_n = (best[c][i] for c in ("left_g", "left_n", "all_g", "all_n"))
        values = (value(g, n), value(all_g - g, all_n - n))
        left = tree.split(node, best["feature"], cut, gain / len(front) if s.symmetric else gain, values)
        after += [c for c, side in ((left, n), (left + 1, all_n - n)) if side >= (1 if s.symmetric else 2 * s.least)]
    if s.leaves is not None:  # children of cuts that are not among the first now never will be
        kept = _opened(tree, s.leaves)
        parents = {c: node for node in kept for c in (tree.left[node], tree.left[node] + 1)}
        after = [c for c in after if c in parents]
    return after


def boost(df: DataFrame, numbers: list[str], text: list[str], target: str, models: int, settings: Settings, key: str, encode: str = "statistics", fill: bool = False) -> tuple[DataFrame, list[list[Tree]]]:
    """(key, fold, target, prediction) of the rows of folds 0 to models - 1, and every model's trees.

    ``df`` has a ``fold``; rows of other folds (-1) train every model and get no prediction. ``encode``: text as ordered
    ``statistics`` or ``codes``. ``fill``: missing numbers are the median of the model's training rows, else below all
    others. Without rows that train it a model predicts 0.
    """
    s, width = settings, len(numbers) + len(text)
    rows = checkpoint(df.where("fold IS NOT NULL").select(key, "fold", target, *numbers, *text))
    unit = _unit(rows, target)
    steps = [rows]
    for c in text:
        coded = ordered_statistics(rows, c, target, models, key) if encode == "statistics" else ordered_codes(rows, c, target, models)
        rows = checkpoint(coded)
        steps.append(rows)
    borders = _borders(rows, numbers, text, target, models, s.bins, fill)
    trains = [F.when(F.col("y").isNotNull() & (F.col("fold") != k), F.round(F.col("y") / unit).cast("long")) for k in range(models)]
    start = _binned(rows, numbers, text, target, [key], borders)
    table = checkpoint(start, **{f"s{k}": F.sum(t) for k, t in enumerate(trains)}, **{f"n{k}": F.count(t) for k, t in enumerate(trains)})
    release(*steps)
    seen = table.__dict__["measured"]
    base = [(seen[f"s{k}"] or 0) * unit / (seen[f"n{k}"] or 1) for k in range(models)]

    def stage(held: DataFrame, pending: list) -> DataFrame:
        columns = held.columns

        def add(batches):
            for batch in batches:
                said = np.empty(batch.num_rows)
                for k, part, bins, at in _parts(batch, width):
                    said[at] = _with_trees(part["said"], pending[k], bins)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns[:-1]), pa.array(said)], columns)

        return checkpoint(held.mapInArrow(add, held.schema))

    kinds = compact(checkpoint(_kinds(table, models, width, unit)), rows=_TASK_ROWS, least=1)
    trees: list[list[Tree]] = [[] for _ in range(models)]
    pending: list[list] = [[] for _ in range(models)]
    blocks, before = _blocks(kinds, width), None
    depth = s.depth if s.depth is not None else 10**9
    for made in range(1, s.rounds + 1):
        growing = [Tree() for _ in range(models)]
        fronts = [[0] for _ in range(models)]
        level = 0
        while level < depth and any(fronts):
            found = _level(blocks, [t.arrays() for t in growing], fronts, base, unit, width, s)
            fronts = [_grow(growing[k], fronts[k], [r for r in found if r["model"] == k], s, unit) if fronts[k] else [] for k in range(models)]
            if before is not None:  # the job has made the blocks that follow
                before.unpersist()
                before = None
            level += 1
        for k in range(models):
            tree = growing[k] if s.leaves is None else _pruned(growing[k], s.leaves)
            trees[k].append(tree)
            pending[k].append(tree.arrays())
        if made == s.rounds:
            blocks.unpersist()
        elif made % s.staged:
            before, blocks = blocks, _advanced(blocks, [p[-1] for p in pending])
        else:
            after = stage(kinds, pending)
            blocks.unpersist()
            release(kinds)
            kinds, pending = after, [[] for _ in range(models)]
            blocks = _blocks(kinds, width)
    release(kinds)
    return _predictions(table, [[t.arrays() for t in of_model] for of_model in trees], base, width, key, target), trees


def _predictions(table: DataFrame, trees: list[list], base: list[float], width: int, key: str, target: str) -> DataFrame:
    """(key, fold, target, prediction): each row by the model that wasn't trained on its fold."""

    def told(batches):
        for batch in batches:
            fold = batch.column("fold").to_numpy(zero_copy_only=False)
            bins = np.frombuffer(b"".join(batch.column("b").to_pylist()), dtype=np.uint8).reshape(len(fold), width)
            value = np.zeros(len(fold))
            for k in np.unique(fold).tolist():
                at = np.flatnonzero(fold == k)
                value[at] = _with_trees(np.zeros(len(at)), trees[k], bins[at]) + base[k]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (key, "fold", "y")), pa.array(value)], [key, "fold", target, "prediction"])

    schema = table.select(key, "fold", F.col("y").alias(target), F.lit(0.0).alias("prediction")).schema
    asked = table.where(F.col("fold").between(0, len(trees) - 1)).withColumn("b", F.expr(f"substring(bins, fold * {width} + 1, {width})"))
    return spread(asked.select(key, "fold", "y", "b")).mapInArrow(told, schema)


def importances(trees: list[Tree], names: list[str]) -> dict[str, float]:
    """Each feature's share of all gain."""
    gain = dict.fromkeys(names, 0.0)
    for tree in trees:
        for f, g in zip(tree.feature, tree.gain, strict=True):
            if f >= 0:
                gain[names[f]] += g
    whole = sum(gain.values())
    return {n: g / whole if whole else 0.0 for n, g in gain.items()}
