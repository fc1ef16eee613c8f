"""Random forest over whole-number labels, grown tree by tree.

MLlib grows all trees at once and adds up statistics of every open node over all
partitions, which moves far more than the rows for trees of thousands of nodes. Here
rows become one small code per group of features, every task gets the codes of all rows
and the bootstrap counts of its own trees, and grows these alone. Thresholds, bootstrap
counts, gains, ties and pruning follow MLlib, so the forest is the one that
`RandomForestRegressor` gives with the same settings and parts, node by node; sums of whole numbers are
exact, whatever their order. Rows that one task cannot hold, and labels that are not
whole numbers, are left to `RandomForestRegressor` itself.
"""

from __future__ import annotations

import contextlib

import numpy as np
import pyarrow as pa
from pyspark.ml.base import Estimator
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.session import shared_folder

# What the codes and counts of all rows may take in a task.
TASK_MB = 512
GROUP_TREES = 17
LABELS = 1 << 16
CELLS = 128
CHUNK = 1 << 18
EPSILON = 2.0**-52

NODE_SCHEMA = (
    "tree int, id int, prediction double, impurity double, n double, total double, squares double, gain double,"
    "left int, right int, feature int, threshold double"
)


# --- thresholds and codes -----------------------------------------------------------


def _thresholds(sample: np.ndarray, rows: int, fraction: float, bins: int) -> list[float]:
    """MLlib's thresholds of a feature: midpoints of all sampled values, or of those that
    cut the sample into even parts. Zeros are counted as what the sample lacks."""
    values, counts = np.unique(sample[sample != 0.0], return_counts=True)
    if not len(values):
        return []
    expected, known = fraction * rows, int(counts.sum())
    weights = dict(zip(values.tolist(), counts.astype(float).tolist(), strict=True))
    if expected - known > EPSILON * known * 100:
        weights[0.0] = expected - known
    pairs = sorted(weights.items())
    if len(pairs) - 1 <= bins - 1:
        return [(a[0] + b[0]) / 2.0 for a, b in zip(pairs, pairs[1:])]
    stride = expected / bins
    out, current, target = [], pairs[0][1], stride
    for (low, _), (value, weight) in zip(pairs, pairs[1:]):
        before, current = current, current + weight
        if abs(before - target) < abs(current - target):
            out.append((low + value) / 2.0)
            target += stride
    return out


def _find_thresholds(rows: DataFrame, names: list[str], n: int, bins: int, seed: int) -> list[list[float]]:
    spark = rows.sparkSession
    wanted = max(bins * bins, 10_000)
    fraction = wanted / n if wanted < n else 1.0
    draw = spark._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
    features = rows.select(*names)
    sampled = spark._jsparkSession.createDataFrame(features._jdf.toJavaRDD().sample(False, fraction, draw), features._jdf.schema())
    found = DataFrame(sampled, spark).toPandas()
    return [_thresholds(found[c].to_numpy(float), n, fraction, bins) for c in names]


def _bundles(sizes: list[int]) -> list[list[int]]:
    """Features whose bins together make at most `CELLS` cells share a code."""
    out: list[tuple[int, list[int]]] = []
    for f in sorted((f for f, size in enumerate(sizes) if size > 1), key=lambda f: -sizes[f]):
        for k, (cells, members) in enumerate(out):
            if cells * sizes[f] <= CELLS:
                out[k] = (cells * sizes[f], [*members, f])
                break
        else:
            out.append((sizes[f], [f]))
    return [members for _, members in out]


class _Plan:
    """What the tasks know: names, thresholds, bundles, labels and settings."""

    def __init__(self, names, thresholds, labels, starts, settings, group_trees):
        self.names, self.thresholds, self.labels, self.starts, self.settings = names, thresholds, labels, starts, settings
        self.sizes = [len(t) + 1 for t in thresholds]
        self.bundles = _bundles(self.sizes)
        self.rows, self.group_trees = starts[-1], group_trees
        self.stride = max([CELLS, *self.sizes])
        self.code = np.uint8 if max(self.stride, len(labels)) <= 256 else np.uint16

    def trees(self, group: int) -> range:
        return range(group * self.group_trees, min((group + 1) * self.group_trees, self.settings.trees))


def _blocks(kind: int, batch: pa.RecordBatch, start: int, payloads: list[tuple[int, bytes]]) -> pa.RecordBatch:
    n, part = len(payloads), batch.column("part")[0].as_py()
    return pa.RecordBatch.from_arrays(
        [pa.array([g for g, _ in payloads], pa.int32()), pa.array([kind] * n, pa.int32()), pa.array([part] * n, pa.int32()),
         pa.array([start] * n, pa.int64()), pa.array([b for _, b in payloads], pa.binary())],
        names=["group", "kind", "part", "start", "data"],
    )


# A task of a union has other numbers than its part.
PART = "spark_partition_id() AS part"
BLOCK_SCHEMA = "group int, kind int, part int, start long, data binary"


def _coded(plan: _Plan):
    """Rows to blocks of codes, a line for each bundle and one for the labels."""

    def run(batches):
        start = 0
        for batch in batches:
            columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in (*plan.names, "label")}
            lines = np.empty((len(plan.bundles) + 1, batch.num_rows), plan.code)
            for line, members in zip(lines, plan.bundles):
                code = np.zeros(batch.num_rows, np.int64)
                for f in members:
                    code = code * plan.sizes[f] + np.searchsorted(plan.thresholds[f], columns[plan.names[f]], side="left")
                line[:] = code
            lines[-1] = np.searchsorted(plan.labels, columns["label"])
            yield _blocks(0, batch, start, [(0, lines.tobytes())])
            start += batch.num_rows

    return run


def _counted(plan: _Plan, groups: int):
    """Bootstrap counts of rows to blocks of a group of trees each, a line for each tree."""

    def run(batches):
        start, width = 0, 4 * plan.settings.trees
        for batch in batches:
            data = b"".join(batch.column("counts").to_pylist())
            counts = np.frombuffer(data, "<i4").reshape(-1, plan.settings.trees)
            assert len(data) == width * batch.num_rows and counts.max(initial=0) < 256
            lines = np.ascontiguousarray(counts.astype(np.uint8).T)
            yield _blocks(1, batch, start, [(g, lines[plan.trees(g).start : plan.trees(g).stop].tobytes()) for g in range(groups)])
            start += batch.num_rows

    return run


def _bootstrap(rows: DataFrame, trees: int, seed: int) -> DataFrame:
    """How often each tree draws each row, in the order of the rows: MLlib's own numbers.
    They depend only on the part and the place of a row. Kryo writes them last, four bytes each."""
    spark = rows.sparkSession
    jvm = spark._jvm
    bagged = jvm.org.apache.spark.ml.tree.impl.BaggedPoint
    places = getattr(rows.selectExpr("1L AS one")._jdf, "as")(jvm.org.apache.spark.sql.Encoders.LONG()).rdd()
    weight = getattr(bagged, "convertToBaggedRDD$default$5")()
    drawn = bagged.convertToBaggedRDD(places, 1.0, trees, True, weight, seed)
    kind = jvm.java.lang.Class.forName("org.apache.spark.ml.tree.impl.BaggedPoint")
    objects = DataFrame(spark._jsparkSession.createDataset(drawn, jvm.org.apache.spark.sql.Encoders.kryo(kind)).toDF(), spark)
    return objects.selectExpr(PART, f"substring(value, {-4 * trees}, {4 * trees}) AS counts")


# --- growing ------------------------------------------------------------------------


def _impurity(n, total, squares):
    return (squares - (total * total) / n) / n


class _Grower:
    def __init__(self, plan: _Plan):
        self.plan, s = plan, plan.stride
        ends = np.cumsum([0, *plan.sizes])
        self.cells = [slice(a, b) for a, b in zip(ends, ends[1:])]
        self.width = int(ends[-1])
        self.home = np.zeros(len(plan.sizes), np.int64)
        self.bin_of = np.zeros((len(plan.sizes), s), np.int64)
        for k, members in enumerate(plan.bundles):
            shape = [plan.sizes[f] for f in members]
            places = np.unravel_index(np.arange(int(np.prod(shape))), shape)
            for f, bins in zip(members, places):
                self.home[f], self.bin_of[f, : len(bins)] = k, bins

    def histograms(self, lines, labels, times, node, slots, n_slots: int, high: float) -> np.ndarray:
        """(slot, cell, count and sum and sum of squares) of the rows whose node has a slot.
        Counts and sums are added up as one number, sums ``high`` times, where both fit in it."""
        plan = self.plan
        tables = np.zeros((len(plan.bundles), 2 if high else 3, n_slots * plan.stride))
        for a in range(0, len(node), CHUNK):
            at = slots[node[a : a + CHUNK]]
            held = np.flatnonzero(at >= 0)
            base = at[held].astype(np.int64) * plan.stride
            count = times[a : a + CHUNK][held].astype(float)
            label = plan.labels[labels[a : a + CHUNK][held]]
            total = count * label
            weights = (count + total * high, total * label) if high else (count, total, total * label)
            for k in range(len(plan.bundles)):
                place = base + lines[k, a : a + CHUNK][held]
                for i, weight in enumerate(weights):
                    tables[k, i] += np.bincount(place, weight, n_slots * plan.stride)
        out = np.zeros((n_slots, self.width, 3))
        for k, members in enumerate(plan.bundles):
            shape = [plan.sizes[f] for f in members]
            joint = tables[k].reshape(-1, n_slots, plan.stride)[:, :, : int(np.prod(shape))].reshape(-1, n_slots, *shape)
            for i, f in enumerate(members):
                count, *sums, squares = joint.sum(axis=tuple(2 + j for j in range(len(shape)) if j != i))
                if high:
                    sums = [np.floor(count / high)]
                    count = count - sums[0] * high
                out[:, self.cells[f]] = np.stack([count, *sums, squares], axis=2)
        return out

    def best(self, hist: np.ndarray, impurity: np.ndarray) -> dict[str, np.ndarray]:
        """The best split of every node: largest gain, then first feature, then first threshold."""
        nodes, least = len(hist), self.plan.settings.min_leaf
        top = {"gain": np.full(nodes, -np.finfo(float).max), "feature": np.full(nodes, -1), "bin": np.zeros(nodes, int), "left": np.zeros((nodes, 3)), "right": np.zeros((nodes, 3))}
        each = np.arange(nodes)
        for f, cells in enumerate(self.cells):
            if self.plan.sizes[f] == 1:
                continue
            sums = np.cumsum(hist[:, cells], axis=1)
            left, whole = sums[:, :-1], sums[:, -1:]
            right = whole - left
            count = left[..., 0] + right[..., 0]
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = impurity[:, None] - left[..., 0] / count * _impurity(*np.moveaxis(left, 2, 0)) - right[..., 0] / count * _impurity(*np.moveaxis(right, 2, 0))
            bad = (left[..., 0] < least) | (right[..., 0] < least) | ~(gain >= 0.0)
            gain[bad] = -np.finfo(float).max
            at = gain.argmax(axis=1)
            better = gain[each, at] > top["gain"]
            rows, cols = each[better], at[better]
            top["gain"][rows], top["feature"][rows], top["bin"][rows] = gain[rows, cols], f, cols
            top["left"][rows], top["right"][rows] = left[rows, cols], right[rows, cols]
        return top

    def tree(self, lines: np.ndarray, labels: np.ndarray, drawn: np.ndarray) -> dict[str, np.ndarray]:
        """One tree as arrays of nodes, level by level; a child of -1 is none."""
        plan, s = self.plan, self.plan.stride
        held = np.flatnonzero(drawn)
        lines = np.ascontiguousarray(lines[:, held])
        labels, times = labels[held], drawn[held]
        node = np.zeros(len(held), np.uint16)
        del held
        per_label = np.bincount(labels, times, len(plan.labels))
        high = 2.0 ** int(per_label.sum()).bit_length()
        if (per_label * plan.labels).sum() * high >= 2.0**53:
            high = 0.0
        size = 1
        hist = self.histograms(lines, labels, times, node, np.zeros(1, np.int64), 1, high)
        first = next((f for f, n in enumerate(plan.sizes) if n > 1))
        stats = hist[:, self.cells[first]].sum(axis=1)
        grown = {"stats": [stats], "gain": [], "feature": [], "bin": [], "left": [], "valid": [np.ones(1, bool)]}
        open_at, at = np.zeros(1, np.int64), 0  # places of this level's open nodes among all nodes
        all_nodes = 1
        for level in range(plan.settings.max_depth):
            impurity = _impurity(*stats.T)
            top = self.best(hist, impurity)
            splits = top["gain"] > 0
            # Children of split nodes, in order; open ones get the next level's numbers.
            order = np.cumsum(splits) - 1
            n = int(splits.sum())
            children = np.empty((2 * n, 3))
            children[0::2], children[1::2] = top["left"][splits], top["right"][splits]
            last = level + 1 == plan.settings.max_depth
            is_open = np.zeros(2 * n, bool) if last else np.abs(_impurity(*children.T)) >= EPSILON
            grown["level"] = grown.get("level", [])
            grown["level"].append({
                "place": open_at, "gain": top["gain"], "feature": np.where(splits, top["feature"], -1), "bin": top["bin"],
                "left": np.where(splits, all_nodes + 2 * order, -1), "valid": top["gain"] >= 0,
            })
            grown["stats"].append(children)
            next_at = all_nodes + np.flatnonzero(is_open)
            all_nodes += 2 * n
            if not is_open.any():
                break
            # Rows go to their child's number; rows of nodes that are done go to the last one.
            number = np.where(is_open, np.cumsum(is_open) - 1, is_open.sum())
            done = int(is_open.sum())
            go = np.full((size + 1, 2), done, np.uint16)
            where = np.flatnonzero(splits)
            go[where, 0], go[where, 1] = number[0::2], number[1::2]
            home, right = np.zeros(size + 1, np.int64), np.zeros((size + 1, s), np.int64)
            home[where] = self.home[top["feature"][where]]
            right[where] = self.bin_of[top["feature"][where]] > top["bin"][where][:, None]
            go, right = go.ravel(), right.ravel()
            for a in range(0, len(node), CHUNK):
                own = node[a : a + CHUNK].astype(np.int64)
                code = lines[:, a : a + CHUNK][home[own], np.arange(len(own))]
                node[a : a + CHUNK] = go[own * 2 + right[own * s + code]]
            # Of two open sisters the smaller is counted, the other is what the parent has besides.
            pairs = is_open.reshape(-1, 2)
            fewer = children[:, 0].reshape(-1, 2).argmin(axis=1)
            counted = pairs.copy()
            counted[np.arange(n), 1 - fewer] &= ~pairs.all(axis=1)
            flat = counted.ravel()
            slots = np.full(done + 1, -1, np.int64)
            slots[number[flat]] = np.arange(flat.sum())
            parts = self.histograms(lines, labels, times, node, slots, int(flat.sum()), high)
            new = np.empty((done, self.width, 3))
            new[number[flat]] = parts
            both = np.flatnonzero(pairs.all(axis=1))
            if len(both):
                small, large = number[2 * both + fewer[both]], number[2 * both + 1 - fewer[both]]
                new[large] = hist[where[both]] - new[small]
            hist, stats, open_at, size = new, children[is_open], next_at, done
        return self.numbered(np.concatenate(grown["stats"]), grown["level"])

    def numbered(self, stats: np.ndarray, levels: list[dict]) -> dict[str, np.ndarray]:
        """Nodes in the order and with the numbers of MLlib's files; sister leaves of equal
        prediction become one leaf, from below."""
        n = len(stats)
        gain, feature, cut = np.full(n, -1.0), np.full(n, -1), np.zeros(n, int)
        left, valid = np.full(n, -1), np.ones(n, bool)
        for x in levels:
            at = x["place"]
            gain[at], feature[at], cut[at], left[at], valid[at] = x["gain"], x["feature"], x["bin"], x["left"], x["valid"]
        prediction = stats[:, 1] / stats[:, 0]
        impurity = np.where(valid, _impurity(*stats.T), -1.0)
        size = np.ones(n, int)
        for x in reversed(levels):
            at = x["place"][x["left"] >= 0]
            a = left[at]
            same = (size[a] == 1) & (size[a + 1] == 1) & (prediction[a] == prediction[a + 1])
            prediction[at[same]] = prediction[a[same]]
            left[at[same]] = -1
            size[at[~same]] = 1 + size[a[~same]] + size[a[~same] + 1]
        ids = np.full(n, -1)
        ids[0] = 0
        for x in levels:
            at = x["place"]
            at = at[(left[at] >= 0) & (ids[at] >= 0)]
            ids[left[at]], ids[left[at] + 1] = ids[at] + 1, ids[at] + 1 + size[left[at]]
        kept = np.flatnonzero(ids >= 0)
        kept = kept[np.argsort(ids[kept])]
        inner = left[kept] >= 0
        thresholds = [self.plan.thresholds[f][b] if i else 0.0 for f, b, i in zip(feature[kept], cut[kept], inner)]
        low = np.where(inner, left[kept], 0)
        return {
            "id": ids[kept], "prediction": prediction[kept], "impurity": impurity[kept], "n": stats[kept, 0], "total": stats[kept, 1],
            "squares": stats[kept, 2], "gain": np.where(inner, gain[kept], -1.0), "left": np.where(inner, ids[low], -1),
            "right": np.where(inner, ids[low + inner], -1), "feature": np.where(inner, feature[kept], -1), "threshold": np.array(thresholds),
        }


def _grown(plan: _Plan):
    """Blocks of a group of trees to the nodes of its trees."""

    def run(batches):
        lines = drawn = trees = None
        for batch in batches:
            for group, kind, part, start, data in zip(*(c.to_pylist() for c in batch.columns[:4]), batch.column(4)):
                if lines is None:
                    trees = plan.trees(group)
                    lines = np.empty((len(plan.bundles) + 1, plan.rows), plan.code)
                    drawn = np.empty((len(trees), plan.rows), np.uint8)
                to = drawn if kind else lines
                block = np.frombuffer(data.as_buffer(), to.dtype).reshape(len(to), -1)
                begin = plan.starts[part] + start
                to[:, begin : begin + block.shape[1]] = block
        if lines is None:
            return
        grower = _Grower(plan)
        for t, counts in zip(trees, drawn):
            nodes = grower.tree(lines[:-1], lines[-1], counts)
            columns = [pa.array(np.full(len(nodes["id"]), t), pa.int32())]
            for name in ("id", "prediction", "impurity", "n", "total", "squares", "gain", "left", "right", "feature", "threshold"):
                columns.append(pa.array(nodes[name], pa.int32() if name in ("id", "left", "right", "feature") else pa.float64()))
            yield pa.RecordBatch.from_arrays(columns, names=["tree", "id", "prediction", "impurity", "n", "total", "squares", "gain", "left", "right", "feature", "threshold"])

    return run


# --- the estimator ------------------------------------------------------------------


@contextlib.contextmanager
def _small_batches(spark):
    """Blocks are long rows: by the usual number of rows, a batch would hold all of a task's."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "4m")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Forest(Estimator):
    """`RandomForestRegressor` with all features at every node, grown as above where the
    rows allow. ``names`` are the columns behind its vector."""

    def __init__(self, regressor: RandomForestRegressor, settings, names: list[str]):
        super().__init__()
        self.regressor, self.settings, self.names = regressor, settings, names

    def _fit(self, dataset: DataFrame) -> RandomForestRegressionModel:
        rows = dataset.select(*[F.col(c).cast("double").alias(c) for c in (*self.names, "label")]).persist()
        try:
            plan, groups = self._plan(rows)
            if plan is not None:
                return self._model(dataset, self._nodes(rows, plan, groups))
        finally:
            rows.unpersist()
        return self.regressor.fit(dataset)

    def _plan(self, dataset: DataFrame):
        s, spark = self.settings, dataset.sparkSession
        parts = {r[0]: r[1] for r in dataset.groupBy(F.spark_partition_id()).count().collect()}
        n = sum(parts.values())
        found = dataset.select("label").distinct().limit(LABELS + 1).collect()
        labels = sorted(r[0] for r in found)
        cores = spark.sparkContext.defaultParallelism
        per_group = -(-s.trees // (cores * -(-s.trees // (cores * GROUP_TREES))))
        whole = len(labels) <= LABELS and all(v >= 0 and v == int(v) for v in labels)
        exact = whole and (2 * n + 100) * max(labels, default=0) ** 2 < 2**53
        if n < 2 or not exact or s.max_depth > 15 or n * (len(self.names) + 1 + per_group) > TASK_MB << 20:
            return None, 0
        bins = min(s.max_bins, n)
        thresholds = _find_thresholds(dataset, self.names, n, bins, s.seed)
        if not any(thresholds):
            return None, 0
        starts = [0]
        for p in range(max(parts) + 1):
            starts.append(starts[-1] + parts.get(p, 0))
        return _Plan(self.names, thresholds, np.array(labels), starts, s, per_group), -(-s.trees // per_group)

    def _nodes(self, dataset: DataFrame, plan: _Plan, groups: int) -> DataFrame:
        codes = dataset.selectExpr(PART, *self.names, "label").mapInArrow(_coded(plan), BLOCK_SCHEMA)
        codes = codes.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        counts = _bootstrap(dataset, self.settings.trees, self.settings.seed).mapInArrow(_counted(plan, groups), BLOCK_SCHEMA)
        return codes.select(counts.columns).unionByName(counts).repartitionById(groups, F.col("group")).mapInArrow(_grown(plan), NODE_SCHEMA)

    def _model(self, dataset: DataFrame, nodes: DataFrame) -> RandomForestRegressionModel:
        """The nodes in the files of a model with these settings, read back."""
        folder = shared_folder(dataset.sparkSession, "forest")
        self.regressor.fit(dataset.limit(1)).write().save(folder)
        split = F.struct(
            F.col("feature").alias("featureIndex"), F.when(F.col("feature") >= 0, F.array("threshold")).otherwise(F.array().cast("array<double>")).alias("leftCategoriesOrThreshold"),
            F.lit(-1).alias("numCategories"),
        )
        data = F.struct(
            "id", "prediction", "impurity", F.array("n", "total", "squares").alias("impurityStats"), F.col("n").cast("long").alias("rawCount"), "gain",
            F.col("left").alias("leftChild"), F.col("right").alias("rightChild"), split.alias("split"),
        )
        with _small_batches(dataset.sparkSession):
            nodes.select(F.col("tree").alias("treeID"), data.alias("nodeData")).write.mode("overwrite").parquet(f"{folder}/data")
        return RandomForestRegressionModel.load(folder)
