"""Random forests and boosted trees for all (ticker, fold) models at once, one level of every open tree in a job.

Training rows become bin numbers once per fold and lie in blocks of some hundred. A level routes the blocks to the open nodes,
adds up one histogram over (ticker, fold, tree, node, feature, bin), takes the best split of a node by an aggregate and writes the
nodes as rows. A model of any size spans as many tasks as it has blocks; what is exchanged are histogram cells, not rows. Draws
are hashes of what they are for, and sums are sums of whole numbers, so that a lost task gives the same trees again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .walkforward import WalkOptions, fold_table, prediction_rows

#: Rows in a block, trees that meet a block together, bins of a feature, and the levels that node numbers have room for.
BLOCK_ROWS, TREE_CHUNK, MOST_BINS, DEEPEST = 256, 16, 256, 60
#: Gradients and curvatures are whole multiples of 1 / FINE.
FINE = float(1 << 30)
SEED = 42
#: Shrinkage of leaf values, least curvature of a child and least gain (the usual defaults of second-order boosting).
RIDGE, LEAST_CURVATURE, LEAST_GAIN = 1.0, 1.0, 1e-6

MODEL, NODE = ["ticker", "fold"], ["ticker", "fold", "tree", "node"]
_CELLS = "ticker string, fold bigint, tree int, node bigint, feature int, bin int, rows bigint, n bigint, s bigint"


def uniform(*parts) -> np.ndarray:
    """Numbers in [0, 1), a hash of whole numbers that broadcast against each other."""
    h = np.uint64(SEED)
    with np.errstate(over="ignore"):
        for part in parts:
            h = h + np.asarray(part, np.int64).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(31))
    return (h >> np.uint64(11)).astype(float) * 2.0**-53


_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 19)]))


def copies(tree: int, seq: np.ndarray) -> np.ndarray:
    """How often a bootstrap draw of this tree has each bar: Poisson with mean one."""
    return np.searchsorted(_POISSON, uniform(0, tree, seq), side="right")


def drawn(tree: int, nodes: np.ndarray, width: int, take: int) -> np.ndarray:
    """The features, ascending, that each node may split on."""
    order = np.argsort(uniform(1, tree, np.asarray(nodes)[:, None], np.arange(width)), axis=1, kind="stable")
    return np.sort(order[:, :take], axis=1)


@dataclass(frozen=True)
class Growth:
    """How trees grow. ``boosted`` is a tree of second-order boosting, otherwise one of a forest by Gini impurity."""

    width: int
    take: int
    max_depth: int
    min_samples_split: int = 2
    boosted: bool = False
    subsample: float = 1.0
    bootstrap: bool = True

    def weights(self, tree: int, seq, y, margin):
        """(rows drawn, whole weight, whole weighted target) of training rows."""
        if not self.boosted:
            n = copies(tree, seq) if self.bootstrap else np.ones(len(seq), np.int64)
            return n > 0, n, n * y
        p = 1.0 / (1.0 + np.exp(-margin))
        return uniform(2, tree, seq) < self.subsample, np.rint(p * (1 - p) * FINE), np.rint((p - y) * FINE)

    def features(self, tree: int, nodes) -> np.ndarray:
        """Forests draw features for a node, boosting for a tree."""
        return drawn(tree, np.zeros(len(nodes), np.int64) if self.boosted else nodes, self.width, self.take)


def route(bins: np.ndarray, nodes: np.ndarray, features: np.ndarray, cuts: np.ndarray, depth: int = DEEPEST) -> np.ndarray:
    """The node each row ends in; ``nodes`` ascend and hold the splits, a row goes left up to the cut."""
    at, rows = np.ones(len(bins), np.int64), np.arange(len(bins))
    if not len(nodes):
        return at
    for _ in range(depth):
        i = np.minimum(np.searchsorted(nodes, at), len(nodes) - 1)
        moves = nodes[i] == at
        if not moves.any():
            break
        at = np.where(moves, 2 * at + (bins[rows, features[i]] > cuts[i]), at)
    return at


def _by_tree(structs, *names) -> dict[int, list[np.ndarray]]:
    """Arrays of the named fields by tree, nodes ascending."""
    cells = structs.values
    if cells is None or not len(cells):
        return {}
    trees, columns = np.asarray(cells.field("tree")), [np.asarray(cells.field(c)) for c in names]
    order = np.lexsort((columns[0], trees))
    found, starts = np.unique(trees[order], return_index=True)
    parts = np.split(order, starts[1:])
    return {int(t): [c[p] for c in columns] for t, p in zip(found, parts, strict=True)}


def _cells(growth: Growth):
    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = [[] for _ in range(9)]
            for r in range(batch.num_rows):
                get = lambda c: batch.column(c)[r]  # noqa: B023, E731
                bins = np.frombuffer(get("bins").as_py(), np.uint8).reshape(-1, growth.width)
                seq, y, margin = (np.asarray(get(c).values) for c in ("seq", "y", "margin"))
                done = _by_tree(get("splits"), "node", "feature", "bin")
                for tree, (nodes,) in _by_tree(get("open"), "node").items():
                    at = route(bins, *done.get(tree, [np.zeros(0, np.int64)] * 3))
                    mine, n, s = growth.weights(tree, seq, y, margin)
                    where = np.minimum(np.searchsorted(nodes, at), len(nodes) - 1)
                    rows = np.flatnonzero(mine & (nodes[where] == at))
                    if not len(rows):
                        continue
                    features = growth.features(tree, nodes)
                    take = features.shape[1]
                    slot = where[rows, None] * take + np.arange(take)
                    keys, place = np.unique(slot * MOST_BINS + bins[rows[:, None], features[where[rows]]], return_inverse=True)
                    place = place.ravel()
                    add = lambda v: np.bincount(place, np.repeat(v[rows], take)).astype(np.int64)  # noqa: B023, E731
                    slot, cell = keys // MOST_BINS, keys % MOST_BINS
                    head = (get("ticker").as_py(), get("fold").as_py(), tree)
                    for column, v in zip(out, [*[[h] * len(keys) for h in head], nodes[slot // take], features.ravel()[slot], cell,
                                               np.bincount(place), add(n), add(s)], strict=True):
                        column.extend(v)
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], [c.split()[0] for c in _CELLS.split(", ")])

    return run


def _best(cells: DataFrame, growth: Growth) -> DataFrame:
    """Per open node: totals and ``split`` (feature, bin, what goes left), NULL where none is possible. Of equal splits that of the
    least feature and bin is taken."""
    hist = cells.groupBy(*NODE, "feature", "bin").agg(*[F.sum(c).alias(c) for c in ("rows", "n", "s")])
    whole = Window.partitionBy(*NODE, "feature")
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    # dealt by node once: the window and the choice of the best need no exchange of their own
    scan = hist.repartition(*NODE).withColumns({
        **{f"l_{c}": F.sum(c).over(upto) for c in ("rows", "n", "s")}, **{f"t_{c}": F.sum(c).over(whole) for c in ("rows", "n", "s")}})
    scale = FINE if growth.boosted else 1.0
    ln, ls, tn, ts = (F.col(c) / F.lit(scale) for c in ("l_n", "l_s", "t_n", "t_s"))
    rn, rs = (F.col("t_n") - F.col("l_n")) / F.lit(scale), (F.col("t_s") - F.col("l_s")) / F.lit(scale)
    # the root is asked here, all other nodes before they are opened
    fits = (F.col("l_rows") < F.col("t_rows")) & (F.col("t_rows") >= growth.min_samples_split)
    if growth.boosted:
        score = ls * ls / (ln + RIDGE) + rs * rs / (rn + RIDGE) - ts * ts / (tn + RIDGE)
        fits = fits & (ln >= LEAST_CURVATURE) & (rn >= LEAST_CURVATURE) & (score > LEAST_GAIN)
    else:
        fits = fits & (ts > 0) & (ts < tn)
        score = (ls * ls + (ln - ls) * (ln - ls)) / ln + (rs * rs + (rn - rs) * (rn - rs)) / rn
    order = F.when(fits, F.struct(score.alias("score"), -F.col("feature"), -F.col("bin")))
    return scan.groupBy(*NODE).agg(
        *[F.max(f"t_{c}").alias(c) for c in ("rows", "n", "s")],
        F.max_by(F.when(fits, F.struct("feature", "bin", "l_rows", "l_n", "l_s")), order).alias("split"))


def grow(train: DataFrame, trees: DataFrame, growth: Growth) -> DataFrame:
    """All nodes of ``trees`` (ticker, fold, tree): node, rows, n, s and feature and bin of its split, NULL in a leaf.

    ``train`` has ticker, fold, seq, y, bins and margin, a block per row. The root is node 1, the children of node i are 2i and
    2i + 1. A tree whose draw of rows is empty has no nodes.
    """
    open_ = trees.select(*MODEL, "tree", F.lit(1).cast("bigint").alias("node"))
    part = F.floor(F.col("tree") / TREE_CHUNK).alias("part")
    no_splits = F.expr("cast(array() as array<struct<tree: int, node: bigint, feature: int, bin: int>>)")
    levels, shut = [], []
    for depth in range(growth.max_depth):
        state = open_.groupBy(*MODEL, part).agg(F.collect_list(F.struct("tree", "node")).alias("open"))
        past = [lv.where("split is not null").select(*NODE, "split.feature", "split.bin") for lv in levels]
        if past:
            splits = reduce(DataFrame.unionByName, past).groupBy(*MODEL, part).agg(F.collect_list(F.struct("tree", "node", "feature", "bin")).alias("splits"))
            state = state.join(splits, [*MODEL, "part"])
        else:
            state = state.withColumn("splits", no_splits)
        met = train.join(state, MODEL).select(*MODEL, "seq", "y", "bins", "margin", "open", "splits")
        level = cut_lineage(_best(met.mapInArrow(_cells(growth), _CELLS), growth))
        levels.append(level)
        side = lambda at, r, n, s: F.struct((2 * F.col("node") + at).alias("node"), r.alias("rows"), n.alias("n"), s.alias("s"))
        left = [F.col(f"split.l_{c}") for c in ("rows", "n", "s")]
        right = [F.col(c) - F.col(f"split.l_{c}") for c in ("rows", "n", "s")]
        born = level.where("split is not null").select(*MODEL, "tree", F.explode(F.array(side(0, *left), side(1, *right))).alias("c")).select(*MODEL, "tree", "c.*")
        goes_on = F.col("rows") >= growth.min_samples_split
        if not growth.boosted:
            goes_on = goes_on & (F.col("s") > 0) & (F.col("s") < F.col("n"))
        if depth + 1 == growth.max_depth:
            goes_on = F.lit(False)
        shut.append(born.where(~goes_on))
        open_ = born.where(goes_on).select(*NODE)
        if not open_.head(1):
            break
    columns = (*NODE, "rows", "n", "s")
    grown = [lv.select(*columns, "split.feature", "split.bin") for lv in levels]
    none = F.lit(None).cast("int")
    return cut_lineage(reduce(DataFrame.unionByName, [*grown, *[b.select(*columns, none.alias("feature"), none.alias("bin")) for b in shut]]))


# --- training sets ----------------------------------------------------------------------------------------------------

def served_folds(data: DataFrame, opts: WalkOptions) -> DataFrame:
    """The folds that get a model: every one that can be fitted, or a ticker's first."""
    folds = fold_table(data, opts).where("fitted").select("ticker", "fold", F.col("cut").cast("int").alias("cut"), "train_rows", "positives")
    if opts.retrain:
        return folds
    return folds.groupBy("ticker").agg(*[F.min_by(c, "fold").alias(c) for c in ("cut", "train_rows", "positives")], F.min("fold").alias("fold"))


def fold_edges(usable: DataFrame, folds: DataFrame, width: int, bins: int = MOST_BINS) -> DataFrame:
    """Per (ticker, fold): for each feature the midpoints between neighbouring quantiles of its training rows; with no more distinct
    values than bins these are all midpoints."""
    share = [k / bins for k in range(1, bins + 1)]
    found = usable.join(folds.select("ticker", "fold", "cut"), "ticker").where("_seq <= cut").groupBy(*MODEL).agg(
        *[F.percentile_approx(F.get("x", F.lit(i)), share, 10_000).alias(f"q{i}") for i in range(width)])
    middle = "transform(slice(v, 2, size(v)), (e, i) -> (v[i] + e) / 2)"
    return found.select(*MODEL, F.array(*[F.expr(f"transform(array(array_sort(array_distinct(q{i}))), v -> {middle})[0]") for i in range(width)]).alias("edges"))


def _binned(width: int):
    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = [[] for _ in range(7)]
            for r in range(batch.num_rows):
                rows, edges = batch.column("rows")[r].values, batch.column("edges")[r].values
                seq, y, x = np.asarray(rows.field("_seq")), np.asarray(rows.field("label")), np.asarray(rows.field("x").flatten())
                mine = seq <= batch.column("cut")[r].as_py()
                x = x.reshape(len(seq), width)[mine]
                bins = np.column_stack([np.searchsorted(np.asarray(edges[i].values), x[:, i]) for i in range(width)]).astype(np.uint8)
                head = [batch.column(c)[r].as_py() for c in ("ticker", "fold", "block")]
                margin = np.full(len(x), batch.column("base")[r].as_py())
                for column, v in zip(out, [*head, seq[mine], y[mine], bins.tobytes(), margin], strict=True):
                    column.append(v)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)],
                                             ["ticker", "fold", "block", "seq", "y", "bins", "margin"])

    return run


def training_blocks(data: DataFrame, opts: WalkOptions, width: int, bins: int = MOST_BINS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(training blocks with bin numbers, edges, folds), each written once."""
    if not 2 <= bins <= MOST_BINS:
        raise ValueError(f"bins must be between 2 and {MOST_BINS}")
    usable = data.where("x is not null and label is not null").select("ticker", F.col("_seq").cast("int").alias("_seq"), F.col("label").cast("int").alias("label"), "x")
    folds = cut_lineage(served_folds(data, opts))
    edges = cut_lineage(fold_edges(usable, folds, width, bins))
    blocks = usable.groupBy("ticker", F.floor(F.col("_seq") / BLOCK_ROWS).alias("block")).agg(
        F.min("_seq").alias("_from"), F.collect_list(F.struct("_seq", "label", "x")).alias("rows"))
    odds = F.log(F.col("positives") / (F.col("train_rows") - F.col("positives")))
    models = folds.select("ticker", "fold", "cut", odds.alias("base")).join(edges, MODEL)
    met = blocks.join(models, "ticker").where("_from <= cut")
    train = met.select("ticker", "fold", "block", "rows", "cut", "edges", "base").mapInArrow(
        _binned(width), "ticker string, fold bigint, block bigint, seq array<int>, y array<int>, bins binary, margin array<double>")
    return cut_lineage(train), edges, folds


def _with_thresholds(nodes: DataFrame, edges: DataFrame, folds: DataFrame, value) -> DataFrame:
    """Nodes as a model keeps them; a hot model's nodes are few, so the join is on (ticker, fold) alone."""
    threshold = F.when(F.col("feature").isNotNull(), F.get(F.get("edges", F.col("feature")), F.col("bin")))
    return nodes.join(edges, MODEL).join(folds.select(*MODEL, "cut"), MODEL).select(
        "ticker", "fold", "cut", "tree", "node", "rows", value.alias("value"), "feature", threshold.alias("threshold"))


# --- models -----------------------------------------------------------------------------------------------------------

def fit_forest(data: DataFrame, opts: WalkOptions, n_estimators: int = 100, max_depth: int | None = 5, min_samples_split: int = 2,
               max_features: str | None = "sqrt", width: int = 55, bins: int = MOST_BINS) -> DataFrame:
    """Nodes of a random forest for every (ticker, fold): cut, tree, node, rows, value (share of rises), feature, threshold.

    Every tree sees a bootstrap draw (Poisson weights) and draws ``max_features`` anew at every node; a node is split by Gini
    impurity while it is mixed and has ``min_samples_split`` different rows. ``max_depth=None`` grows until nothing can be split
    (60 levels at most). A node none of whose drawn features differs between its rows is a leaf; a tree whose draw is empty is
    missing. All trees of all models take one job per level. An empty table gives no rows.
    """
    if n_estimators < 1 or min_samples_split < 2 or max_features not in ("sqrt", "log2", None) or (max_depth is not None and not 1 <= max_depth <= DEEPEST):
        raise ValueError("n_estimators from 1, min_samples_split from 2, max_depth from 1 or None, max_features sqrt, log2 or None")
    take = {"sqrt": int(np.sqrt(width)), "log2": int(np.log2(width)), None: width}[max_features]
    growth = Growth(width, max(1, take), max_depth or DEEPEST, min_samples_split)
    train, edges, folds = training_blocks(data, opts, width, bins)
    trees = folds.select(*MODEL, F.explode(F.sequence(F.lit(0), F.lit(n_estimators - 1))).alias("tree"))
    return _with_thresholds(grow(train, trees, growth), edges, folds, F.col("s") / F.col("n"))


def _moved(eta: float):
    """Margins after one more tree."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            margins = []
            for r in range(batch.num_rows):
                seq, margin = np.asarray(batch.column("seq")[r].values), np.asarray(batch.column("margin")[r].values)
                bins = np.frombuffer(batch.column("bins")[r].as_py(), np.uint8).reshape(len(seq), -1)
                for nodes, features, cuts, values in _by_tree(batch.column("nodes")[r], "node", "feature", "bin", "value").values():
                    inner = features >= 0
                    at = route(bins, nodes[inner], features[inner], cuts[inner])
                    margin = margin + eta * values[np.searchsorted(nodes, at)]
                margins.append(margin)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("ticker", "fold", "block")] + [pa.array(margins, pa.list_(pa.float64()))],
                                             ["ticker", "fold", "block", "margin"])

    return run


def fit_boosted(data: DataFrame, opts: WalkOptions, n_estimators: int = 100, max_depth: int = 3, learning_rate: float = 0.1, subsample: float = 1.0,
                colsample_bytree: float = 1.0, width: int = 55, bins: int = MOST_BINS) -> DataFrame:
    """Nodes of gradient-boosted trees for every (ticker, fold), as :func:`fit_forest` gives them; values are steps of the log odds.

    Second-order boosting on the logistic loss: gain and leaf values from sums of gradients and curvatures with a ridge of one,
    children hold a curvature of one at least. A tree draws its share of rows and of features (one at least). The log odds of
    the training labels are tree -1. Margins of training rows are kept between trees as a column of their blocks; a level of
    the current tree of all models is one job, and a tree is written before the next.
    """
    if n_estimators < 1 or not 1 <= max_depth <= DEEPEST or not learning_rate > 0 or not 0 < subsample <= 1 or not 0 < colsample_bytree <= 1:
        raise ValueError("n_estimators and max_depth from 1, learning_rate positive, subsample and colsample_bytree in (0, 1]")
    growth = Growth(width, max(1, int(colsample_bytree * width)), max_depth, 2, True, subsample)
    train, edges, folds = training_blocks(data, opts, width, bins)
    fixed, margins = train.drop("margin"), train.select(*MODEL, "block", "margin")
    value = -(F.col("s") / FINE) / (F.col("n") / FINE + RIDGE)
    grown = []
    for t in range(n_estimators):
        here = fixed.join(margins, [*MODEL, "block"])
        nodes = grow(here, folds.select(*MODEL, F.lit(t).alias("tree")), growth)
        grown.append(nodes)
        if t + 1 < n_estimators:
            flat = F.struct("tree", "node", F.coalesce("feature", F.lit(-1)).alias("feature"), F.coalesce("bin", F.lit(-1)).alias("bin"), value.alias("value"))
            # a tree whose draw is empty moves nothing
            tree = nodes.groupBy(*MODEL).agg(F.collect_list(flat).alias("nodes"))
            none = F.expr("cast(array() as array<struct<tree: int, node: bigint, feature: int, bin: int, value: double>>)")
            met = here.join(tree, MODEL, "left").withColumn("nodes", F.coalesce("nodes", none))
            margins = cut_lineage(met.select(*MODEL, "block", "seq", "bins", "margin", "nodes").mapInArrow(
                _moved(learning_rate), "ticker string, fold bigint, block bigint, margin array<double>"))
    nodes = _with_thresholds(reduce(DataFrame.unionByName, grown), edges, folds, F.lit(learning_rate) * value)
    odds = F.log(F.col("positives") / (F.col("train_rows") - F.col("positives")))
    start = folds.select("ticker", "fold", "cut", F.lit(-1).alias("tree"), F.lit(1).cast("bigint").alias("node"), F.col("train_rows").cast("bigint").alias("rows"),
                         odds.alias("value"), F.lit(None).cast("int").alias("feature"), F.lit(None).cast("double").alias("threshold"))
    return start.unionByName(nodes)


def _scores(batches) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        parts = []
        for r in range(batch.num_rows):
            rows = batch.column("rows")[r].values
            x = np.asarray(rows.field("x").flatten()).reshape(len(rows), -1)
            total, trees = np.zeros(len(x)), 0
            for nodes, features, cuts, values in _by_tree(batch.column("nodes")[r], "node", "feature", "threshold", "value").values():
                inner = features >= 0
                at = route(x, nodes[inner], features[inner], cuts[inner])
                total += values[np.searchsorted(nodes, at)]
                trees += 1
            same = lambda v, kind: pa.array([v] * len(x), kind)  # noqa: B023, E731
            parts.append(pa.RecordBatch.from_arrays([
                same(batch.column("ticker")[r].as_py(), pa.string()), rows.field("date"), rows.field("fold"), pa.array(total), same(trees, pa.int64())],
                ["ticker", "date", "fold", "total", "trees"]))
        yield from parts


def tree_scores(data: DataFrame, opts: WalkOptions, nodes: DataFrame) -> DataFrame:
    """``ticker, date, fold, total, trees``: sum of leaf values over the trees of the model that serves a row."""
    rows = prediction_rows(data, opts).select("ticker", "date", "_seq", "x", F.col("fold").cast("bigint").alias("fold"), F.col("cut").cast("int").alias("cut"))
    rows = rows.groupBy("ticker", "cut", F.floor(F.col("_seq") / BLOCK_ROWS).alias("block")).agg(F.collect_list(F.struct("date", "fold", "x")).alias("rows"))
    flat = F.struct("tree", "node", F.coalesce("feature", F.lit(-1)).alias("feature"), F.coalesce("threshold", F.lit(0.0)).alias("threshold"), "value")
    models = nodes.groupBy("ticker", "cut", F.floor(F.col("tree") / TREE_CHUNK).alias("part")).agg(F.collect_list(flat).alias("nodes"))
    parts = rows.join(models, ["ticker", "cut"]).select("ticker", "rows", "nodes").mapInArrow(
        _scores, "ticker string, date date, fold bigint, total double, trees bigint")
    return parts.groupBy("ticker", "date", "fold").agg(F.sum("total").alias("total"), F.sum("trees").alias("trees"))


def random_forest(data: DataFrame, opts: WalkOptions, width: int = 55, **params) -> DataFrame:
    """Predictions of a random forest per ticker and fold: a rise where the mean share of the trees is above one half."""
    scores = tree_scores(data, opts, fit_forest(data, opts, width=width, **params))
    score = F.round(F.col("total") / F.col("trees"), 12)
    return scores.select("ticker", "date", "fold", score.alias("score"), F.when(score > 0.5, 1).otherwise(0).alias("pred"))


def boosted_trees(data: DataFrame, opts: WalkOptions, width: int = 55, **params) -> DataFrame:
    """Predictions of gradient-boosted trees per ticker and fold: a rise where the log odds are positive."""
    scores = tree_scores(data, opts, fit_boosted(data, opts, width=width, **params))
    score = F.round("total", 12)
    return scores.select("ticker", "date", "fold", score.alias("score"), F.when(score > 0, 1).otherwise(0).alias("pred"))
