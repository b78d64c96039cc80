"""Trees grown from histograms of binned rows, whole models in one stage.

The rows are binned once and packed into blocks of a few bytes a row. One barrier stage
holds them in its tasks and grows all trees: for each level a task adds up its rows per
node and bin, the first task sums these tables, chooses the cuts and hands them back.
Tables and cuts are small files in the shared folder, so a level costs a few milliseconds
beside the work on the rows, where a job for each level costs a tenth of a second or more.

Cuts are chosen as by Spark's learner: categories ordered by their mean, the first best cut on ties.
"""

from __future__ import annotations

import os
import pickle
import re
import tempfile
import time
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import BarrierTaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulcast.session import shared_dir

BLOCK_ROWS = 131_072
PART_ROWS = 50_000
# features whose bins together stay below this share one table, which is summed to theirs
GROUP_BINS = 4_096
# from so many bytes on, what a task holds of a column is a file that memory maps
MAPPED_BYTES = 64 << 20
PACKED = "rows long, codes binary, target binary, part binary"


@dataclass(frozen=True)
class Growth:
    """What one model is grown with; ``held`` names the part of the rows that is left out and only scored."""

    trees: int
    depth: int
    step: float
    min_rows: int
    subsample: float
    per_node: int
    loss: str
    seed: int
    patience: int | None = None
    forest: bool = False


@dataclass(frozen=True)
class Feature:
    """A column of bin numbers: cuts of a number, or the count of its categories."""

    column: str
    cuts: np.ndarray | None
    categories: int = 0

    @property
    def bins(self) -> int:
        return self.categories if self.cuts is None else len(self.cuts) + 1


@dataclass
class Tree:
    """Nodes by number, the root at 0; ``cuts`` has (feature, bins that go left, left, right) of inner nodes."""

    values: list[float] = field(default_factory=list)
    gains: dict[int, float] = field(default_factory=dict)
    cuts: dict[int, tuple[int, np.ndarray, int, int]] = field(default_factory=dict)


def grouped(features: Sequence[Feature]) -> list[list[int]]:
    """Features that share a table of bins, the widest first."""
    groups: list[tuple[int, list[int]]] = []
    for i in sorted(range(len(features)), key=lambda i: -features[i].bins):
        at = next((k for k, (size, _) in enumerate(groups) if size * features[i].bins <= GROUP_BINS), None)
        if at is None:
            groups.append((features[i].bins, [i]))
        else:
            groups[at] = groups[at][0] * features[i].bins, [*groups[at][1], i]
    return [sorted(members) for _, members in groups]


def _code_type(features: Sequence[Feature], groups: list[list[int]]) -> type:
    return np.uint16 if max(np.prod([features[i].bins for i in g]) for g in groups) <= 1 << 16 else np.uint32


def packed(df: DataFrame, features: Sequence[Feature], groups: list[list[int]], target: str, part: Column) -> DataFrame:
    """Blocks of rows: codes of the groups one after another, targets, and parts."""
    kind = _code_type(features, groups)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def block() -> pa.RecordBatch:
            codes = np.concatenate([w[0] for w in waiting], axis=1)
            y, p = (np.concatenate([w[i] for w in waiting]) for i in (1, 2))
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array([len(y)], pa.int64()), *[
                pa.array([a.tobytes()], pa.binary()) for a in (codes, y, p)]], ["rows", "codes", "target", "part"])

        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            binned = [np.searchsorted(f.cuts, v) if f.cuts is not None else v.astype(np.int64)
                      for f, v in zip(features, columns)]
            codes = np.empty((len(groups), len(batch)), dtype=kind)
            for g, members in enumerate(groups):
                code = 0
                for i in members:
                    code = code * features[i].bins + binned[i]
                codes[g] = code
            waiting.append((codes, columns[-2].astype(np.float64), columns[-1].astype(np.int8)))
            if sum(len(w[1]) for w in waiting) >= BLOCK_ROWS:
                yield block()
        if waiting and sum(len(w[1]) for w in waiting):
            yield block()

    return df.select(*[F.col(f.column).cast("double").alias(f"x{i}") for i, f in enumerate(features)],
                     F.col(target).cast("double").alias("y"), part.cast("int").alias("part")).mapInArrow(pack, PACKED)


def grow(df: DataFrame, features: Sequence[Feature], target: str, rows: int, growths: Sequence[Growth],
         part: Column | None = None) -> list[tuple[list[Tree], list[float]]]:
    """The trees of every model and, with rows of part 1, the error on them after each tree.

    Rows of part 0 grow the trees. ``rows`` says how many there are about, for the number of tasks.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    slots = max(1, context.defaultParallelism // int(spark.conf.get("spark.task.cpus", "1")))
    tasks = max(1, min(slots, -(-rows // PART_ROWS)))
    folder = f"{shared_dir(spark)}/growing-{uuid.uuid4().hex}"
    groups = grouped(features)
    blocks = packed(df, features, groups, target, F.lit(0) if part is None else part).repartition(tasks)
    layout, wanted, scored = list(features), list(growths), part is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = BarrierTaskContext.get()
        # a stage that starts again must not read the files of the attempt before it
        attempt = task.allGather(uuid.uuid4().hex)[0] if tasks > 1 else uuid.uuid4().hex
        talk = _Exchange(f"{folder}/{attempt}", task.partitionId(), tasks)
        held = _Rows(batches, layout, groups)
        for i, growth in enumerate(wanted):
            grown = _Grower(held, layout, growth, scored, talk).run()
            if talk.rank == 0:
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([pickle.dumps(grown)], pa.binary())], ["i", "model"])
        talk.close()

    found = {r["i"]: pickle.loads(r["model"]) for r in blocks.mapInArrow(run, "i long, model binary", True).collect()}
    return [found[i] for i in range(len(wanted))]


class Scorer:
    """Weighted sum of grown trees over batches of rows."""

    def __init__(self, trees: Sequence[Tree], weights: Sequence[float], features: Sequence[Feature]):
        self.features, self.roots, self.depths = list(features), [], []
        values, column, base, times, table, at = [], [], [], [], [], 0
        for tree, weight in zip(trees, weights):
            first, deep = len(values), {0: 0}
            self.roots.append(first)
            for node, value in enumerate(tree.values):
                values.append(value * weight)
                feature, lefts, left, right = tree.cuts.get(node, (0, None, node, node))
                # a leaf leads to itself
                leads = np.array([node]) if lefts is None else np.where(lefts, left, right)
                column.append(feature)
                times.append(lefts is not None)
                base.append(at)
                table.append(leads + first)
                at += len(leads)
                deep |= {c: deep[node] + 1 for c in (left, right)} if lefts is not None else {}
            self.depths.append(max(deep.values()))
        self.values, self.column = np.array(values, dtype=float), np.array(column, dtype=np.intp)
        self.base, self.times = np.array(base, dtype=np.intp), np.array(times, dtype=np.intp)
        self.table = np.concatenate(table).astype(np.int32)

    def __call__(self, columns: Sequence[np.ndarray]) -> np.ndarray:
        binned = np.column_stack([np.searchsorted(f.cuts, v) if f.cuts is not None else v.astype(np.intp)
                                  for f, v in zip(self.features, columns)])
        width, total = binned.shape[1], np.zeros(len(binned))
        binned, start = binned.ravel(), np.arange(len(binned)) * width
        for root, depth in zip(self.roots, self.depths):
            node = np.full(len(total), root, dtype=np.intp)
            for _ in range(depth):
                node = self.table[self.base[node] + self.times[node] * binned[start + self.column[node]]].astype(np.intp)
            total += self.values[node]
        return total

    def column_of(self, df: DataFrame) -> Column:
        """The sum as a column of a frame that has the binned columns."""
        context, columns = df.sparkSession.sparkContext, [f.column for f in self.features]
        shared = context.broadcast(self)

        @F.pandas_udf("double")
        def score(cells: pd.DataFrame) -> pd.Series:
            return pd.Series(shared.value([cells[c].to_numpy(dtype=float) for c in columns]))

        return score(F.struct(*[F.col(c).cast("double").alias(c) for c in columns]))


class _Exchange:
    """Sums and answers between the tasks of a stage that all run, through files in the shared folder."""

    def __init__(self, uri: str, rank: int, tasks: int):
        self.rank, self.tasks, self.step = rank, tasks, 0
        if tasks > 1:
            self.fs, self.folder = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri if ":" in uri else f"file://{uri}"))
            self.fs.create_dir(self.folder, recursive=True)

    def _put(self, name: str, data: bytes) -> None:
        with self.fs.open_output_stream(f"{self.folder}/.{name}") as f:
            f.write(data)
        self.fs.move(f"{self.folder}/.{name}", f"{self.folder}/{name}")

    def _get(self, name: str) -> bytes:
        path, wait = f"{self.folder}/{name}", 0.0003
        while self.fs.get_file_info(path).type == fs.FileType.NotFound:
            time.sleep(wait)
            wait = min(wait * 1.3, 0.02)
        with self.fs.open_input_stream(path) as f:
            return f.read()

    def decide(self, part: np.ndarray, choose) -> object:
        """The first task's ``choose(sum of all parts)``, on every task."""
        if self.tasks == 1:
            return choose(part)
        self.step += 1
        if self.rank:
            self._put(f"{self.step}-{self.rank}", part.tobytes())
            return pickle.loads(self._get(f"{self.step}-all"))
        total = part.copy()
        for other in range(1, self.tasks):
            total += np.frombuffer(self._get(f"{self.step}-{other}"), dtype=part.dtype).reshape(part.shape)
            self.fs.delete_file(f"{self.folder}/{self.step}-{other}")
        answer = choose(total)
        self._put(f"{self.step}-all", pickle.dumps(answer, protocol=5))
        if self.step > 1:
            self.fs.delete_file(f"{self.folder}/{self.step - 1}-all")
        return answer

    def close(self) -> None:
        """The last answer stays until every task has it."""
        if self.tasks > 1:
            self.decide(np.zeros(1), lambda _: None)
            if self.rank:
                self._put(f"end-{self.rank}", b"")
            else:
                for other in range(1, self.tasks):
                    self._get(f"end-{other}")
                self.fs.delete_dir(self.folder)


def _space(rows: int, kind: type) -> np.ndarray:
    """Zeros, in memory or, if they are many, in a file without a name that goes with the process."""
    if rows * np.dtype(kind).itemsize < MAPPED_BYTES:
        return np.zeros(rows, dtype=kind)
    with tempfile.TemporaryFile() as f:
        os.ftruncate(f.fileno(), rows * np.dtype(kind).itemsize)
        return np.memmap(f, dtype=kind, mode="r+", shape=(rows,))


class _Rows:
    """The rows of a task by column: a code per group of features, target and part."""

    def __init__(self, batches: Iterator[pa.RecordBatch], features: Sequence[Feature], groups: list[list[int]]):
        self.groups = groups
        kinds = [np.dtype(k) for k in (*[_code_type(features, self.groups)] * len(self.groups), np.float64, np.int8)]
        files, self.count = [tempfile.TemporaryFile() for _ in kinds], 0
        for batch in batches:
            for row in range(len(batch)):
                n, at = batch.column(0)[row].as_py(), 0
                data = memoryview(b"".join(memoryview(batch.column(c)[row].as_buffer()) for c in (1, 2, 3)))
                for f, kind in zip(files, kinds):
                    f.write(data[at:at + n * kind.itemsize])
                    at += n * kind.itemsize
                self.count += n
        columns = []
        for f, kind in zip(files, kinds):
            f.flush()
            f.seek(0)
            columns.append(np.memmap(f, dtype=kind, mode="r") if self.count * kind.itemsize >= MAPPED_BYTES
                           else np.fromfile(f, dtype=kind))
            f.close()
        *self.codes, self.target, self.part = columns


def _pieces(chosen: np.ndarray) -> Iterator[np.ndarray]:
    for at in range(0, len(chosen), BLOCK_ROWS):
        yield chosen[at:at + BLOCK_ROWS].astype(np.intp)


class _Grower:
    """Grows the trees of one model, each task over its own rows; the first task chooses the cuts.

    A task keeps the rows of each node as a list. Of two children only the smaller is
    added up; the table of the other is what remains of their parent's.
    """

    def __init__(self, rows: _Rows, features: Sequence[Feature], growth: Growth, scored: bool, talk: _Exchange):
        self.rows, self.features, self.growth, self.scored, self.talk = rows, features, growth, scored, talk
        self.sizes = [int(np.prod([features[i].bins for i in g])) for g in rows.groups]
        self.offsets = np.concatenate([[0], np.cumsum([f.bins for f in features])]).astype(int)
        # group of a feature, and the step of its bins in the codes of the group
        self.where = {i: (g, int(np.prod([features[j].bins for j in members if j > i])))
                      for g, members in enumerate(rows.groups) for i in members}
        self.so_far = _space(0 if growth.forest else rows.count, np.float64)
        self.gradient = _space(0 if growth.forest else rows.count, np.float64)
        self.times = _space(rows.count if growth.forest else 0, np.uint8)
        self.kept: dict[int, tuple[float, np.ndarray]] = {}
        self.trees: list[Tree] = []
        self.errors: list[float] = []

    def run(self) -> tuple[list[Tree], list[float]]:
        for m in range(self.growth.trees):
            wanted, lists = self._wanted(m), {0: self._drawn(m)}
            tree, nodes, derived, error = Tree(), [0], {}, self._error(m)
            for level in range(self.growth.depth):
                tables = self._tables(wanted, [lists[n][0] for n in nodes if n not in derived], error)
                answer = self.talk.decide(tables, lambda total: self._choose(total, m, level, tree, nodes, derived))
                if answer is None:
                    return self.trees, self.errors
                values, gains, fresh, nodes, derived, error = *answer, np.zeros(2)
                tree = Tree([*tree.values, *values], tree.gains | gains, tree.cuts | fresh)
                for node, cut in fresh.items():
                    self._part(lists, node, *cut)
                if not nodes:
                    break
            self.trees.append(tree)
            self._finish(m, tree, lists)
        if self.scored:
            self.talk.decide(self._error(self.growth.trees), self._ends)
        return self.trees, self.errors

    def _drawn(self, m: int) -> tuple[np.ndarray, np.ndarray]:
        """The rows that grow this tree, and the others."""
        rng, n = np.random.default_rng([self.growth.seed + m, self.talk.rank]), self.rows.count
        taking = np.ones(n, dtype=bool) if not self.scored else np.asarray(self.rows.part == 0)
        for at in range(0, n if self.growth.forest or self.growth.subsample < 1 else 0, BLOCK_ROWS):
            span = slice(at, min(n, at + BLOCK_ROWS))
            if self.growth.forest:
                self.times[span] = np.minimum(rng.poisson(self.growth.subsample, span.stop - at), 255)
                taking[span] &= self.times[span] > 0
            else:
                taking[span] &= rng.random(span.stop - at) < self.growth.subsample
        rest = np.zeros(0, np.int64) if self.growth.forest else np.nonzero(~taking)[0]
        return tuple(x.astype(np.int32 if n < 1 << 31 else np.int64) for x in (np.nonzero(taking)[0], rest))

    def _wanted(self, m: int) -> np.ndarray:
        """What a tree is fitted to: the target, then the negative gradient of the loss."""
        if m == 0 or self.growth.forest:
            return self.rows.target
        for at in range(0, self.rows.count, BLOCK_ROWS):
            gap = self.rows.target[at:at + BLOCK_ROWS] - self.so_far[at:at + BLOCK_ROWS]
            self.gradient[at:at + BLOCK_ROWS] = 2.0 * gap if self.growth.loss == "squared" else np.where(gap < 0, -1.0, 1.0)
        return self.gradient

    def _error(self, done: int) -> np.ndarray:
        """Sum of the losses of held rows after ``done`` trees, and their number."""
        total, count = 0.0, 0
        for at in range(0, self.rows.count if self.scored and done else 0, BLOCK_ROWS):
            span = slice(at, at + BLOCK_ROWS)
            gap = (self.rows.target[span] - self.so_far[span])[self.rows.part[span] == 1]
            total += float((gap * gap if self.growth.loss == "squared" else np.abs(gap)).sum())
            count += len(gap)
        return np.array([total, count])

    def _ends(self, error: np.ndarray) -> bool:
        """Note the error after a tree; whether patience is over."""
        self.errors.append(float(error[0] / error[1]) if error[1] else float("nan"))
        patience = self.growth.patience
        return patience is not None and len(self.errors) - best_round(self.errors, patience) >= patience

    def _part(self, lists: dict, node: int, feature: int, lefts: np.ndarray, left: int, right: int) -> None:
        """Deal the rows of a node to its children."""
        g, step = self.where[feature]
        goes = lefts[np.arange(self.sizes[g]) // step % self.features[feature].bins]
        sides = []
        for chosen in lists.pop(node):
            parts = [chosen[:0]], [chosen[:0]]
            for at in range(0, len(chosen), BLOCK_ROWS):
                some = chosen[at:at + BLOCK_ROWS]
                there = goes[self.rows.codes[g][some]]
                parts[0].append(some[there])
                parts[1].append(some[~there])
            sides.append([np.concatenate(p) for p in parts])
        lists[left], lists[right] = ((inside, outside) for inside, outside in zip(*sides))

    def _tables(self, wanted: np.ndarray, lists: list[np.ndarray], error: np.ndarray) -> np.ndarray:
        """The held rows' error so far, then for each list of rows the sum of squares and counts and sums by bin."""
        out = [error]
        for chosen in lists:
            counts, sums = ([np.zeros(size) for size in self.sizes] for _ in range(2))
            squares = 0.0
            for some in _pieces(chosen):
                target, times = wanted[some], None
                if self.growth.forest:
                    times = self.times[some].astype(np.float64)
                    squares += float((target * target * times).sum())
                    target = target * times
                else:
                    squares += float(target @ target)
                for g, size in enumerate(self.sizes):
                    code = self.rows.codes[g][some].astype(np.intp)
                    counts[g] += np.bincount(code, times, size)
                    sums[g] += np.bincount(code, target, size)
            table = np.empty((2, self.offsets[-1]))
            for g, members in enumerate(self.rows.groups):
                shape = [self.features[i].bins for i in members]
                for which, cube in ((0, counts[g].reshape(shape)), (1, sums[g].reshape(shape))):
                    for axis, i in enumerate(members):
                        others = tuple(a for a in range(len(members)) if a != axis)
                        table[which, self.offsets[i]:self.offsets[i + 1]] = cube.sum(axis=others)
            out += [np.array([squares]), table.ravel()]
        return np.concatenate(out)

    def _choose(self, total: np.ndarray, m: int, level: int, tree: Tree, nodes: list[int], derived: dict) -> tuple | None:
        """New values, gains and cuts, the nodes to cut next and which of them follow from (parent, sibling);
        None when patience is over."""
        if self.scored and m and not level and self._ends(total[:2]):
            return None
        g, slots = self.growth, len(nodes)
        width = 1 + 2 * self.offsets[-1]
        built = {n: total[2 + k * width:2 + (k + 1) * width] for k, n in enumerate(n for n in nodes if n not in derived)}
        known = {n: (float(part[0]), part[1:].reshape(2, -1)) for n, part in built.items()}
        for n, (parent, sibling) in derived.items():
            rest = self.kept[parent][1] - known[sibling][1]
            # what rounding leaves of bins without rows
            rest[1][rest[0] == 0] = 0.0
            known[n] = self.kept[parent][0] - known[sibling][0], rest
        self.kept = known
        squares, tables = np.array([known[n][0] for n in nodes]), np.stack([known[n][1] for n in nodes])
        first = tables[:, :, self.offsets[0]:self.offsets[1]].sum(axis=2)
        if not level and not first[0, 0]:
            raise ValueError("there are no rows to grow a tree from")
        allowed = None
        if g.per_node < len(self.features):
            rng = np.random.default_rng([g.seed + m, level])
            allowed = rng.random((slots, len(self.features))).argsort(1).argsort(1) < g.per_node
        best, chosen = np.full(slots, -np.inf), [None] * slots
        rows = np.arange(slots)
        for i, f in enumerate(self.features):
            if f.bins < 2:
                continue
            n, s = (tables[:, w, self.offsets[i]:self.offsets[i + 1]] for w in (0, 1))
            order = None
            if f.cuts is None:
                # categories by their mean, those without rows at the end
                order = np.argsort(np.where(n > 0, s / np.where(n > 0, n, 1), np.inf), axis=1, kind="stable")
                n, s = np.take_along_axis(n, order, 1), np.take_along_axis(s, order, 1)
            n, s = n.cumsum(1), s.cumsum(1)
            low, high = n[:, :-1], n[:, -1:] - n[:, :-1]
            fits = (low >= g.min_rows) & (high >= g.min_rows) & (low > 0) & (high > 0)
            gain = np.where(fits, s[:, :-1] ** 2 / np.where(fits, low, 1) + (s[:, -1:] - s[:, :-1]) ** 2
                            / np.where(fits, high, 1) - s[:, -1:] ** 2 / np.maximum(n[:, -1:], 1), -np.inf)
            at = gain.argmax(1)
            top = gain[rows, at]
            if allowed is not None:
                top = np.where(allowed[:, i], top, -np.inf)
            for k in np.nonzero(top > best)[0]:
                lefts = np.zeros(f.bins, dtype=bool)
                lefts[np.arange(at[k] + 1) if order is None else order[k, :at[k] + 1]] = True
                best[k] = top[k]
                chosen[k] = (i, lefts, (n[k, at[k]], s[k, at[k]]), (high[k, at[k]], s[k, -1] - s[k, at[k]]))
        values, gains, fresh, following, remains = [], {}, {}, [], {}
        if not level:
            values.append(float(first[0, 1] / first[0, 0]))
        for k, node in enumerate(nodes):
            # a gain below the rounding of the sums is none
            if not best[k] > 1e-14 * squares[k]:
                continue
            i, lefts, (low, low_sum), (high, high_sum) = chosen[k]
            left = len(tree.values) + len(values)
            fresh[node], gains[node] = (i, lefts, left, left + 1), float(best[k] / (low + high))
            values += [float(low_sum / low), float(high_sum / high)]
            small, large = (left, left + 1) if low <= high else (left + 1, left)
            if level + 1 < g.depth and max(low, high) >= 2 * g.min_rows:
                following += [small, large]
                remains[large] = node, small
        return values, gains, fresh, following, remains

    def _finish(self, m: int, tree: Tree, lists: dict) -> None:
        """Add the tree to what the rows are predicted so far."""
        if not self.growth.forest:
            for node, both in lists.items():
                value = tree.values[node] * (self.growth.step if m else 1.0)
                for chosen in both:
                    self.so_far[chosen] += value


def best_round(errors: Sequence[float], patience: int | None = None) -> int:
    """1-based round with the lowest error before patience runs out; the earliest on ties."""
    best = 0
    for i, e in enumerate(errors):
        if e < errors[best]:
            best = i
        elif patience is not None and i - best >= patience:
            break
    return best + 1
