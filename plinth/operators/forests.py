"""Random forests of regression trees, all folds and all trees in the same jobs.

As in ``boosting``, features are cut into bins once and a model is trained on kinds: its training rows of equal bins and target, with their
number. A tree's bootstrap draws each row a Poisson number of times with mean 1, so a kind of n rows is drawn Poisson(n) times.
Text is one-hot: a cut asks for one level; levels that a model isn't trained on are a feature of their own that never cuts.

Nodes of more than ``within`` drawn kinds are cut a level of all trees at a time: tasks sum their own kinds by (tree, node, feature, bin), the sums
of a tree meet, and only its cuts reach the driver. What then is small enough goes, a node of a tree each, to tasks that grow
the rest of the tree from it and tell what it predicts. So no task holds more than ``within`` drawn kinds at once, and trees reach nobody whole.

Draws and the features that a node asks come from hashes of the kind, tree and node, and sums are of whole numbers, so predictions don't
depend on how rows are dealt nor on ``within``.
"""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.operators.boosting import _borders, _unit, ordered_codes
from plinth.storage import checkpoint, release, spread


@dataclass(frozen=True)
class Settings:
    """``least``: rows that a leaf must have drawn."""

    trees: int = 300
    depth: int = 15
    least: int = 5
    bins: int = 128
    seed: int = 42
    within: int = 200_000


@dataclass(frozen=True)
class Features:
    """One model's features: numbers first, then of each text column its trained levels (sorted codes) and one for unknown ones."""

    numbers: int
    levels: tuple[tuple[int, ...], ...]

    @property
    def count(self) -> int:
        return self.numbers + sum(len(v) + 1 for v in self.levels)

    def start(self, column: int) -> int:
        """The number of a text column's first feature."""
        return self.numbers + sum(len(v) + 1 for v in self.levels[: column - self.numbers])


def _mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64 of unsigned 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _stream(*numbers: int) -> np.uint64:
    """One number from several."""
    out = np.zeros(1, dtype=np.uint64)
    for n in numbers:
        out = _mixed(out ^ np.array([n], dtype=np.uint64))
    return out[0]


@lru_cache(maxsize=10_000)
def _poisson(mean: int) -> tuple[int, np.ndarray]:
    """The least count looked at, and the cumulative chances from it on in whole numbers of 2 ** -40."""
    reach = 12 * math.isqrt(mean) + 24
    low = max(0, mean - reach)
    chances = [math.exp(c * math.log(mean) - mean - math.lgamma(c + 1.0)) for c in range(low, mean + reach)]
    steps = np.rint(np.cumsum(chances) * 2.0**40).astype(np.int64)
    steps[-1] = 1 << 40
    return low, np.minimum(steps, 1 << 40)


class Draws:
    """How often a tree draws each kind of some, of ``n`` rows: Poisson(n), by the kind's hash."""

    def __init__(self, n: np.ndarray, hashes: np.ndarray) -> None:
        means, group = np.unique(n, return_inverse=True)
        tables = [_poisson(v) if v else (0, np.array([1 << 40])) for v in means.tolist()]
        self.hashes, self.group = hashes.view(np.uint64), group.astype(np.int64) << 40
        self.table = np.concatenate([v + (g << 40) for g, (_, v) in enumerate(tables)]) if tables else np.zeros(0, dtype=np.int64)
        starts = np.cumsum([0, *(len(v) for _, v in tables)])[:-1]
        self.shift = np.array([low - start for (low, _), start in zip(tables, starts.tolist(), strict=True)], dtype=np.int64)[group]

    def of(self, seed: int, model: int, tree: int) -> np.ndarray:
        u = (_mixed(self.hashes ^ _stream(seed, model, tree)) >> np.uint64(24)).astype(np.int64)
        return np.searchsorted(self.table, self.group + u, side="right") + self.shift


def asked(paths: np.ndarray, count: int, seed: int, model: int, tree: int) -> np.ndarray:
    """(nodes, features): whether a node, named by its path from the root, asks a feature; as many as the root of their number, rounded up."""
    most = math.isqrt(count - 1) + 1 if count > 1 else count
    with np.errstate(over="ignore"):
        keys = _mixed(_mixed(paths.astype(np.uint64) ^ _stream(seed, model, tree, 1))[:, None] + np.arange(count, dtype=np.uint64))
    out = np.zeros(keys.shape, dtype=bool)
    np.put_along_axis(out, np.argsort(keys, axis=1, kind="stable")[:, :most], True, axis=1)
    return out


def _cells(keys: np.ndarray, w: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in their order, with sums."""
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[starts], *(np.add.reduceat(v[order], starts) if len(keys) else v for v in (w, s))


#: A cell's key: its node's place times this, plus the bin.
_BINS = 1 << 32


def _sums(bins: np.ndarray, slot: np.ndarray, w: np.ndarray, s: np.ndarray, asks: np.ndarray, features: Features) -> list[tuple]:
    """By column: cells (node's place, bin) of rows whose node asks the column, with drawn rows and their sum of targets."""
    out = []
    for c in range(bins.shape[1]):
        if c < features.numbers:
            on = asks[:, c]
        else:
            at = features.start(c)
            on = asks[:, at : at + len(features.levels[c - features.numbers])].any(1)
        rows = np.flatnonzero(on[slot])
        out.append(_cells(slot[rows] * _BINS + bins[rows, c], w[rows], s[rows]))
    return out


def _best(sums: list[tuple], all_w: np.ndarray, all_s: np.ndarray, asks: np.ndarray, features: Features, least: int) -> tuple[np.ndarray, ...]:
    """By node: the column that cuts best (-1: none), the bin, and drawn rows and sum of the right side. Of equals the first column and bin."""
    m = len(all_w)
    base = all_s.astype(float) ** 2 / all_w
    top, column, cut = base * 1e-12, np.full(m, -1), np.zeros(m, dtype=np.int64)
    right_w, right_s = np.zeros(m, dtype=np.int64), np.zeros(m, dtype=np.int64)
    for c, (keys, w, s) in enumerate(sums):
        if not len(keys):
            continue
        node, value = keys // _BINS, keys % _BINS
        starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        if c < features.numbers:  # right of the cell
            run_w, run_s = np.cumsum(w), np.cumsum(s)
            part = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(keys)]))
            before_w, before_s = (run[starts] - v[starts] for run, v in ((run_w, w), (run_s, s)))
            r_w, r_s, allowed = all_w[node] - (run_w - before_w[part]), all_s[node] - (run_s - before_s[part]), True
        else:  # the level itself
            levels = np.array(features.levels[c - features.numbers], dtype=np.int64)
            r_w, r_s, allowed = w, s, asks[node, features.start(c) + np.searchsorted(levels, value)]
        l_w, l_s = all_w[node] - r_w, all_s[node] - r_s
        fit = allowed & (r_w >= least) & (l_w >= least)
        gain = np.where(fit, l_s.astype(float) ** 2 / np.maximum(l_w, 1) + r_s.astype(float) ** 2 / np.maximum(r_w, 1) - base[node], -np.inf)
        most = np.maximum.reduceat(gain, starts)
        first = np.flatnonzero(gain == np.repeat(most, np.diff(np.r_[starts, len(keys)])))
        first = first[np.r_[True, node[first][1:] != node[first][:-1]]]
        better = first[gain[first] > top[node[first]]]
        at = node[better]
        top[at], column[at], cut[at], right_w[at], right_s[at] = gain[better], c, value[better], r_w[better], r_s[better]
    return column, cut, right_w, right_s


def _right(bins: np.ndarray, rows: np.ndarray, column: np.ndarray, cut: np.ndarray, numbers: int) -> np.ndarray:
    """Whether rows go right at cuts of their own."""
    v = bins[rows, np.maximum(column, 0)]
    return np.where(column < numbers, v > cut, v == cut)


def _land(tree: tuple[np.ndarray, ...], bins: np.ndarray, numbers: int) -> np.ndarray:
    """The node at which each row ends."""
    column, cut, left = tree[:3]
    at, rows = np.zeros(len(bins), dtype=np.int64), np.arange(len(bins))
    while len(rows):
        rows = rows[column[at[rows]] >= 0]
        node = at[rows]
        at[rows] = left[node] + _right(bins, rows, column[node], cut[node], numbers)
    return at


def _grown(bins: np.ndarray, w: np.ndarray, s: np.ndarray, path: int, depth: int, features: Features, s_: Settings, model: int, tree: int) -> tuple[np.ndarray, ...]:
    """(column, cut, left, mean) by node of the part of a tree below the node of a path. ``s``: sums of the drawn rows' targets."""
    parts, made = [], 1
    slot, paths = np.zeros(len(w), dtype=np.int64), np.array([path], dtype=np.int64)
    all_w, all_s = np.array([w.sum()]), np.array([s.sum()])
    while len(paths):
        m = len(paths)
        column, cut, right_w, right_s = np.full(m, -1), np.zeros(m, dtype=np.int64), np.zeros(m, dtype=np.int64), np.zeros(m, dtype=np.int64)
        open_ = np.flatnonzero(all_w >= 2 * s_.least) if depth < s_.depth else np.zeros(0, dtype=np.int64)
        if len(open_):
            place = np.full(m, -1)
            place[open_] = np.arange(len(open_))
            rows = np.flatnonzero(place[slot] >= 0)
            bins, w, s, slot = bins[rows], w[rows], s[rows], slot[rows]
            asks = asked(paths[open_], features.count, s_.seed, model, tree)
            found = _best(_sums(bins, place[slot], w, s, asks, features), all_w[open_], all_s[open_], asks, features, s_.least)
            column[open_], cut[open_], right_w[open_], right_s[open_] = found
        cuts = np.flatnonzero(column >= 0)
        left = np.zeros(m, dtype=np.int64)
        left[cuts] = made + 2 * np.arange(len(cuts))
        made += 2 * len(cuts)
        parts.append((column, cut, left, all_s / np.maximum(all_w, 1)))
        if not len(cuts):
            break
        rows = np.flatnonzero(column[slot] >= 0)
        bins, w, s, slot = bins[rows], w[rows], s[rows], slot[rows]
        place = np.zeros(m, dtype=np.int64)
        place[cuts] = 2 * np.arange(len(cuts))
        slot = place[slot] + _right(bins, np.arange(len(rows)), column[slot], cut[slot], features.numbers)
        paths = np.ravel(np.column_stack([2 * paths[cuts], 2 * paths[cuts] + 1]))
        all_w = np.ravel(np.column_stack([all_w[cuts] - right_w[cuts], right_w[cuts]]))
        all_s = np.ravel(np.column_stack([all_s[cuts] - right_s[cuts], right_s[cuts]]))
        depth += 1
    return tuple(np.concatenate(v) for v in zip(*parts, strict=True))


class _Top:
    """The top of a tree, as far as it is cut in jobs of all trees: nodes by number, and which of them are still to be cut there."""

    def __init__(self) -> None:
        self.column, self.cut, self.left, self.path, self.w, self.s = [-1], [0], [0], [1], [0], [0]
        self.front = [0]
        self.closed: set[int] = set()  # looked at here: cut, or a leaf

    def arrays(self) -> tuple[np.ndarray, ...]:
        return np.array(self.column), np.array(self.cut), np.array(self.left)

    def split(self, node: int, column: int, cut: int, sides: list[tuple[int, int]]) -> list[int]:
        self.column[node], self.cut[node], self.left[node] = column, cut, len(self.column)
        for side, (w, s) in enumerate(sides):
            for values, v in ((self.column, -1), (self.cut, 0), (self.left, 0), (self.path, 2 * self.path[node] + side), (self.w, w), (self.s, s)):
                values.append(v)
        return [self.left[node], self.left[node] + 1]


def _parts(batch: pa.RecordBatch, width: int):
    """(model, bins, n, y, h, i) of a batch's kinds, by model."""
    k = batch.column("k").to_numpy(zero_copy_only=False)
    bins = np.frombuffer(b"".join(batch.column("b").to_pylist()), dtype="<i4").reshape(len(k), width)
    held = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("n", "y", "h", "i")]
    for model in np.unique(k).tolist():
        at = np.flatnonzero(k == model)
        yield model, bins[at], *(v[at] for v in held)


def _counted(kinds: DataFrame, tops: list[list[_Top]], s: Settings, width: int, numbers: int) -> dict:
    """One job: how many drawn kinds the fronts' nodes have, by (model, tree, node)."""
    sent = [[(t.arrays(), t.front) for t in of_model] for of_model in tops]

    def count(batches):
        for batch in batches:
            out = []
            for k, bins, n, _, h, _ in _parts(batch, width):
                draws = Draws(n, h)
                for t, (tree, front) in enumerate(sent[k]):
                    if front:
                        held = np.bincount(_land(tree, bins, numbers)[draws.of(s.seed, k, t) > 0], minlength=len(tree[0]))
                        out += [(k, t, node, int(held[node])) for node in front if held[node]]
            yield pa.RecordBatch.from_pylist([dict(zip("ktvc", r, strict=True)) for r in out], pa.schema([(c, pa.int64()) for c in "ktvc"]))

    found = kinds.where("n > 0").mapInArrow(count, "k long, t long, v long, c long").groupBy("k", "t", "v").agg(F.sum("c").alias("c")).where(F.col("c") > s.within)
    return {(r["k"], r["t"], r["v"]): r["c"] for r in found.collect()}  # a row a node too large for a task


def _level(kinds: DataFrame, tops: list[list[_Top]], features: list[Features], s: Settings, width: int) -> None:
    """One job: cut the nodes of every tree's front."""
    sent = [[(t.arrays(), t.front, [t.path[v] for v in t.front]) for t in of_model] for of_model in tops]

    def asks(k, t):
        return asked(np.array(sent[k][t][2]), features[k].count, s.seed, k, t)

    def sums(batches):
        for batch in batches:
            out = {"k": [], "t": [], "sums": []}
            for k, bins, n, y, h, _ in _parts(batch, width):
                draws = Draws(n, h)
                for t, (tree, front, _) in enumerate(sent[k]):
                    if front:
                        w = draws.of(s.seed, k, t)
                        place = np.full(len(tree[0]), -1)
                        place[front] = np.arange(len(front))
                        slot = place[_land(tree, bins, features[k].numbers)]
                        rows = np.flatnonzero((w > 0) & (slot >= 0))
                        w, slot = w[rows], slot[rows]
                        whole = _cells(slot, w, w * y[rows])
                        out["k"].append(k)
                        out["t"].append(t)
                        out["sums"].append(pickle.dumps((whole, _sums(bins[rows], slot, w, w * y[rows], asks(k, t), features[k]))))
            yield pa.RecordBatch.from_pydict(out, pa.schema([("k", pa.int64()), ("t", pa.int64()), ("sums", pa.binary())]))

    def choose(key, table):
        k, t = (v.as_py() for v in key)
        met = None
        for blob in table.column("sums").to_pylist():
            whole, columns = pickle.loads(blob)
            met = [whole, *columns] if met is None else [_cells(*(np.concatenate(v) for v in zip(a, b, strict=True))) for a, b in zip(met, [whole, *columns], strict=True)]
        all_w, all_s = met[0][1:]
        column, cut, right_w, right_s = _best(met[1:], all_w, all_s, asks(k, t), features[k], s.least)
        return pa.table({"k": [k], "t": [t], "found": [pickle.dumps((all_w, all_s, column, cut, right_w, right_s))]})

    told = spread(kinds.where("n > 0").mapInArrow(sums, "k long, t long, sums binary"), "k", "t").groupBy("k", "t").applyInArrow(choose, "k long, t long, found binary")
    for r in told.collect():  # a row a tree that has a large node
        top, after = tops[r["k"]][r["t"]], []
        for node, all_w, all_s, column, cut, right_w, right_s in zip(top.front, *(v.tolist() for v in pickle.loads(bytes(r["found"]))), strict=True):
            top.w[node], top.s[node] = all_w, all_s
            top.closed.add(node)
            if column >= 0:
                after += top.split(node, column, cut, [(all_w - right_w, all_s - right_s), (right_w, right_s)])
        top.front = after


def _tops(kinds: DataFrame, features: list[Features], s: Settings, width: int, models: int) -> list[list[_Top]]:
    """Every tree's top, below which no node that can still be cut has more than ``within`` drawn kinds."""
    tops = [[_Top() for _ in range(s.trees)] for _ in range(models)]
    most = {r["k"]: r["c"] for r in kinds.where("n > 0").groupBy("k").agg(F.count(F.lit(1)).alias("c")).collect()}  # a row a model
    if max(most.values(), default=0) <= s.within:
        return tops
    for _ in range(s.depth):
        large = _counted(kinds, tops, s, width, features[0].numbers)
        for k, of_model in enumerate(tops):
            for t, top in enumerate(of_model):
                top.front = [v for v in top.front if (k, t, v) in large]
        if not large:
            break
        _level(kinds, tops, features, s, width)
    for of_model in tops:
        for top in of_model:
            top.closed.update(top.front)  # large nodes at the greatest depth
    return tops


def _told(kinds: DataFrame, tops: list[list[_Top]], features: list[Features], s: Settings, width: int) -> DataFrame:
    """(i, v): what each tree predicts of each asked kind, in units."""
    sent = [[(t.arrays(), t.path, {v: t.s[v] / t.w[v] for v, c in enumerate(t.column) if c < 0 and v in t.closed}) for t in of_model] for of_model in tops]

    def deal(batches):
        for batch in batches:
            for k, bins, n, y, h, i in _parts(batch, width):
                out = {"k": [], "t": [], "v": [], "part": []}
                small, draws, asks = bins.astype(np.min_scalar_type(int(bins.max(initial=0)))), Draws(n, h), n == 0
                for t, (tree, _, leaves) in enumerate(sent[k]):
                    w, at = draws.of(s.seed, k, t), _land(tree, bins, features[k].numbers)
                    for v in np.unique(at).tolist():
                        here = at == v
                        rows, ask = np.flatnonzero(here & (w > 0) & (v not in leaves)), np.flatnonzero(here & asks)
                        if len(rows) or len(ask):
                            out["k"].append(k)
                            out["t"].append(t)
                            out["v"].append(v)
                            out["part"].append(pickle.dumps((small[rows], w[rows], y[rows], small[ask], i[ask])))
                yield pa.RecordBatch.from_pydict(out, pa.schema([(c, pa.int64()) for c in "ktv"] + [("part", pa.binary())]))

    def grow(key, table):
        k, t, v = (x.as_py() for x in key)
        bins, w, y, ask, i = (np.concatenate(x) for x in zip(*(pickle.loads(blob) for blob in table.column("part").to_pylist()), strict=True))
        _, path, leaves = sent[k][t]
        if v in leaves:
            value = np.full(len(i), leaves[v])
        else:
            grown = _grown(bins.astype(np.int64), w, w * y, path[v], path[v].bit_length() - 1, features[k], s, k, t)
            value = grown[3][_land(grown, ask.astype(np.int64), features[k].numbers)]
        return pa.table({"i": i, "v": np.rint(value).astype(np.int64)})

    dealt = spread(kinds.sortWithinPartitions("k").mapInArrow(deal, "k long, t long, v long, part binary"), "k", "t", "v")
    return dealt.groupBy("k", "t", "v").applyInArrow(grow, "i long, v long")


def _binned(df: DataFrame, numbers: list[str], text: list[str], target: str, keep: list[str], borders: list) -> DataFrame:
    """keep, fold, target, and four bytes a model and feature: of numbers how many borders are below the value, of text one more than the level's code, 0 for unknown ones."""
    models, width = len(borders), len(numbers) + len(text)
    schema = df.select(*keep, "fold", F.col(target).cast("double").alias("y")).schema.add("bins", "binary")
    names = [f.name for f in schema.fields[:-1]]
    rows = df.select(*keep, F.col("fold").cast("int").alias("fold"), F.col(target).cast("double").alias("y"), *(F.col(c).cast("double").alias(f"__f{i}") for i, c in enumerate(numbers)), *(F.col(c).alias(f"__t{i}") for i, c in enumerate(text)))

    def cut(batches):
        for batch in batches:
            n = batch.num_rows
            out = np.zeros((n, models, width), dtype="<i4")
            plain = [batch.column(f"__f{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(len(numbers))]
            for f, v in enumerate(plain):
                for k in range(models):
                    at, missing = borders[k][f]
                    out[:, k, f] = np.searchsorted(at, np.where(np.isnan(v), missing, v), side="left")
            for f in range(len(text)):
                codes = np.asarray(batch.column(f"__t{f}").flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(n, models)
                out[:, :, len(numbers) + f] = np.maximum(codes, -1) + 1
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array([r.tobytes() for r in out], type=pa.binary())], [*names, "bins"])

    return rows.mapInArrow(cut, schema)


def _kinds(table: DataFrame, models: int, width: int, unit: float) -> DataFrame:
    """(k, b, y, n, h, i): each model's distinct training bins and targets, and with n = 0 the distinct bins that it is asked."""
    size = 4 * width
    of_model = F.array(*(F.when(F.col("fold") != k, F.substring("bins", k * size + 1, size)) for k in range(models)))
    rows = table.where("y IS NOT NULL").select(F.round(F.col("y") / unit).cast("long").alias("y"), F.posexplode(of_model).alias("k", "b")).where("b IS NOT NULL")
    trained = spread(rows, "k", "b", "y").groupBy("k", "b", "y").agg(F.count(F.lit(1)).alias("n"))
    asks = _asked_bins(table, models, width).select(F.col("fold").alias("k"), "b").distinct().select("k", "b", F.lit(0).cast("long").alias("y"), F.lit(0).cast("long").alias("n"))
    return trained.select("k", "b", "y", "n").unionByName(spread(asks, "k", "b")).withColumns({"h": F.xxhash64("b", "y"), "i": F.monotonically_increasing_id()})


def _asked_bins(table: DataFrame, models: int, width: int) -> DataFrame:
    return table.where(F.col("fold").between(0, models - 1)).withColumn("b", F.expr(f"substring(bins, fold * {4 * width} + 1, {4 * width})"))


def forest(df: DataFrame, numbers: list[str], text: list[str], target: str, models: int, settings: Settings, key: str) -> DataFrame:
    """(key, fold, target, prediction) of the rows of folds 0 to models - 1, each by the model that isn't trained on its fold.

    ``df`` has a ``fold``; rows of other folds (-1) train every model and get no prediction. Missing numbers are the median, missing
    text the most frequent level of the model's training rows. A model without rows that train it predicts 0.
    """
    s, width = settings, len(numbers) + len(text)
    rows = checkpoint(df.where("fold IS NOT NULL").select(key, "fold", target, *numbers, *text))
    unit = _unit(rows, target)
    steps = [rows]
    for c in text:
        rows = checkpoint(ordered_codes(rows, c, target, models))
        steps.append(rows)
    borders = _borders(rows, numbers, [], target, models, s.bins, True)
    features = [Features(len(numbers), ())] * models
    if text:
        trains = [F.col(target).isNotNull() & (F.col("fold") != k) for k in range(models)]
        seen = rows.agg(*(F.collect_set(F.when(trains[k], F.col(c)[k])).alias(f"l{k}_{i}") for k in range(models) for i, c in enumerate(text))).first()
        features = [Features(len(numbers), tuple(tuple(sorted(int(v) + 1 for v in seen[f"l{k}_{i}"])) for i in range(len(text)))) for k in range(models)]
    table = checkpoint(_binned(rows, numbers, text, target, [key], borders))
    release(*steps)
    kinds = checkpoint(_kinds(table, models, width, unit))
    told = _told(kinds, _tops(kinds, features, s, width, models), features, s, width).groupBy("i").agg((F.sum("v") * F.lit(unit) / F.lit(s.trees)).alias("prediction"))
    by_kind = checkpoint(kinds.where("n = 0").select("i", "k", "b").join(told, "i").select(F.col("k").alias("fold"), "b", "prediction"))
    release(kinds)
    return _asked_bins(table, models, width).join(by_kind, ["fold", "b"]).select(key, "fold", F.col("y").alias(target), "prediction")
