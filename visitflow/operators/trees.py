"""Classification trees grown whole, each within one task, from all rows.

MLlib grows a tree level by level over the cluster: the driver holds every node, each level of a deep tree is a row of jobs,
and thresholds come from a sample of the rows as soon as there are more than ``SAMPLED_FROM``. Here the rows to learn from
are one sorted table in the shared folder. A task reads the codes of their values (a byte or two for each value), grows the
trees of a grove one after another and adds up their votes. Every distinct value is a possible threshold. As in MLlib, rows
are drawn with Poisson weights, a node tries the square root of the features, categories are split by their share of the
second class, and a node is a leaf when it is pure, gains nothing or lies ``depth`` below the root.

A task holds the codes of all rows and the tree that grows; nothing of it reaches the driver but the importances and the
number of nodes of each tree. Trees depend on the rows and the seed alone, not on how rows are dealt out.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitflow.operators.forests import GROVE, Forest
from visitflow.sources.scratch import new_folder

SAMPLED_FROM = 10_000  # rows, beyond which MLlib's thresholds come from a sample
CHUNK = 65_536  # rows to predict whose votes travel together
BATCH = 262_144  # rows of deep nodes that are split together, so that they stay in the processor's cache

NODE = ("treeID int, nodeData struct<id:int,prediction:double,impurity:double,impurityStats:array<double>,rawCount:bigint,"
        "gain:double,leftChild:int,rightChild:int,"
        "split:struct<featureIndex:int,leftCategoriesOrThreshold:array<double>,numCategories:int>>")

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the package


@dataclass
class Tree:
    """Nodes in arrays: the split feature (-1: leaf), the left child (the right one is next to it), row counts.

    A row goes left when its code is at most ``code``, or, of a category, when its bit is set in ``masks[code]``.
    """

    feature: np.ndarray
    code: np.ndarray
    left: np.ndarray
    total: np.ndarray
    ones: np.ndarray
    masks: np.ndarray
    importance: np.ndarray


def _at(array: np.ndarray, index: np.ndarray) -> np.ndarray:
    """``array[index]`` for indices within it, without a look at their range."""
    return array.take(index, mode="clip")


def _groups(
    points: np.ndarray, base: np.ndarray, tried: np.ndarray, node: np.ndarray, low: np.ndarray, wide: int, bits: int
):
    """Node, value, rows and rows of the second class, for every value in a node of the feature that it tries, sorted by both.

    ``base`` is where a row's codes begin. ``low`` has a row's class above its weight, which takes ``bits`` bits; a value takes
    ``wide`` bits.
    """
    cells, weight = len(tried) << wide, low.dtype.type((1 << bits) - 1)
    if cells <= len(node):
        both, step = np.zeros(2 * cells, np.int64), max(BATCH, 2 * cells)
        for begin in range(0, len(node), step):  # in steps, so that what is held beside the rows stays small
            at, some = node[begin:begin + step], low[begin:begin + step]
            key = (at << wide | _at(points, base[begin:begin + step] + _at(tried, at))) << 1 | some >> bits
            both += np.bincount(key, some & weight, 2 * cells).astype(np.int64)
        both = both.reshape(-1, 2)
        total = both.sum(axis=1)
        cell = np.flatnonzero(total)
        return cell >> wide, cell & ((1 << wide) - 1), total[cell], both[cell, 1]
    kind = np.uint32 if cells << (bits + 1) <= 2**32 else np.int64
    key = (node.astype(kind) << kind(wide) | _at(points, base + _at(tried, node))) << kind(bits + 1) | low
    key.sort()
    n, cell = (key & kind(weight)).astype(np.int64), key >> kind(bits + 1)
    last = np.flatnonzero(np.concatenate((cell[1:] != cell[:-1], [True])))
    n += n * (key >> kind(bits) & kind(1)) << 32  # rows of the second class in the upper half
    both, cell = np.diff(np.cumsum(n)[last], prepend=0), cell[last].astype(np.int64)
    return cell >> wide, cell & ((1 << wide) - 1), both & 0xFFFFFFFF, both >> 32


def _first(sorted_values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])))


def grow(
    points: np.ndarray, values: Sequence[np.ndarray], arity: Sequence[int], label: np.ndarray, rows: np.ndarray,
    weights: np.ndarray, rng: np.random.Generator, depth: int, tried: int,
) -> Tree:
    """A tree of the rows, each counted ``weights`` times.

    ``points`` has a row of codes for each row; ``arity`` is 0 for numbers, whose codes follow ``values``.
    """
    features, words, is_nominal = points.shape[1], max(1, -(-max(arity) // 64)), np.asarray(arity) > 0
    wide = (max(n or len(v) for n, v in zip(arity, values, strict=True)) - 1).bit_length()
    drawn = np.flatnonzero(weights)
    rows, n = rows[drawn], weights[drawn]
    one, bits = label[rows], int(n.max(initial=1)).bit_length()
    low = (one << bits | n).astype(np.min_scalar_type((2 << bits) - 1))
    most = max(1, 2 * len(rows) - 1)
    feature, code, left = np.full(most, -1, np.int16), np.zeros(most, np.int32), np.zeros(most, np.int32)
    total, ones = np.zeros(most, np.int64), np.zeros(most, np.int64)
    total[0], ones[0] = n.sum(dtype=np.int64), n[one > 0].sum(dtype=np.int64)
    importance, masks, kept, count = np.zeros(features), [np.zeros((0, words), np.uint64)], 0, 1
    stack = []
    if 0 < ones[0] < total[0] and depth > 0:
        stack.append((points.reshape(-1), rows.astype(np.intp) * features, low, np.zeros(len(rows), np.int32),
                      np.zeros(1, np.int64), 0))
    while stack:
        points, base, low, node, ids, level = stack.pop()
        k, numbers = len(ids), np.arange(len(ids))
        tries = np.argsort(rng.random((k, features)), axis=1)[:, :tried]
        gained, by, cut = np.zeros(k), np.full(k, -1, np.intp), np.zeros(k, np.int32)
        n_left, ones_left, chosen = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros((k, words), np.uint64)
        for j in tries.T:
            j = np.ascontiguousarray(j)
            at, value, t, o = _groups(points, base, j, node, low, wide, bits)
            nominal = is_nominal[j]
            some = np.flatnonzero(nominal[at])  # values of categories, to be ordered by their share of the second class
            order = some[np.argsort(at[some] + o[some] / t[some] * 0.999999, kind="stable")]
            value[some], t[some], o[some] = value[order], t[order], o[order]
            first = _first(at)
            upto, ones_upto = np.cumsum(t), np.cumsum(o)
            upto -= (upto[first] - t[first])[at]
            ones_upto -= (ones_upto[first] - o[first])[at]
            whole = total[ids][at]
            # The decrease of Gini impurity times rows; whole numbers tell whether there is one at all.
            apart = (ones_upto * whole - ones[ids][at] * upto).astype(np.float64)
            size = upto.astype(np.float64) * (whole - upto) * whole
            gain = 2 * apart * apart / np.where(size > 0, size, 1.0)
            best = np.maximum.reduceat(gain, first)
            hit = np.flatnonzero(gain == best[at])
            hit = hit[_first(at[hit])]  # the first of equals
            better = best > gained
            to, hits = numbers[better], hit[better]
            gained[to], by[to], n_left[to], ones_left[to] = best[better], j[to], upto[hits], ones_upto[hits]
            for f in np.flatnonzero(~is_nominal):
                own = to[j[to] == f]
                under, over = value[hit[own]], value[np.minimum(hit[own] + 1, len(value) - 1)]
                middle = np.searchsorted(values[f], values[f][under] / 2 + values[f][over] / 2, "right") - 1
                cut[own] = np.clip(middle, under, over - 1)
            if len(some):
                own, goes, seen = better & nominal, some <= hit[at[some]], value[some]
                begins = _first(at[some])
                for word in range(words):
                    bit = np.where(goes & (seen >> 6 == word), np.uint64(1) << (seen & 63).astype(np.uint64), np.uint64(0))
                    chosen[own, word] = np.bitwise_or.reduceat(bit, begins)[better[nominal]]
        split = by >= 0
        parents = np.flatnonzero(split)
        if not len(parents):
            continue
        importance += np.bincount(by[parents], gained[parents], features)
        nominal = parents[is_nominal[by[parents]]]
        cut[nominal] = kept + np.arange(len(nominal))
        masks.append(chosen[nominal])
        kept += len(nominal)
        above, lefts = ids[parents], count + 2 * np.arange(len(parents))
        feature[above], code[above], left[above] = by[parents], cut[parents], lefts
        total[lefts], ones[lefts] = n_left[parents], ones_left[parents]
        total[lefts + 1], ones[lefts + 1] = total[above] - n_left[parents], ones[above] - ones_left[parents]
        children = np.arange(count, count + 2 * len(parents))
        count += len(children)
        if level + 1 == depth:
            continue
        grows = (ones[children] > 0) & (ones[children] < total[children])
        rank = np.zeros(k, np.int32)
        rank[parents] = np.arange(len(parents))
        if len(parents) < k:
            stays = np.flatnonzero(_at(split, node))
            base, low, node = _at(base, stays), _at(low, stays), _at(node, stays)
        used = _at(by, node)
        value = _at(points, base + used)
        right = value > _at(cut, node)
        mine = np.flatnonzero(_at(is_nominal, used))
        seen = value[mine]
        held = chosen[node[mine], seen >> 6] >> (seen & 63).astype(np.uint64)
        right[mine] = (held & np.uint64(1)) == 0
        child = 2 * _at(rank, node) + right
        stays = np.flatnonzero(_at(grows, child))
        new = np.zeros(len(children), np.int32)
        new[grows] = np.arange(np.count_nonzero(grows))
        base, low, node, ids = _at(base, stays), _at(low, stays), _at(new, _at(child, stays)), children[grows]
        if len(base) <= BATCH:
            if len(base):
                stack.append((points, base, low, node, ids, level + 1))
            continue
        order = np.argsort(node, kind="stable")
        base, low, node = base[order], low[order], node[order]
        ends = np.cumsum(np.bincount(node, minlength=len(ids)))
        first = 0
        while first < len(ids):
            begin = ends[first - 1] if first else 0
            end = max(first + 1, int(np.searchsorted(ends, begin + BATCH, "right")))
            part = slice(begin, ends[end - 1])
            own, held = base[part].copy(), points
            if len(own) <= BATCH:  # from here on, these nodes have their codes side by side
                held = points.reshape(-1, features)[own // features].reshape(-1)
                own = np.arange(0, len(held), features)
            stack.append((held, own, low[part].copy(), node[part] - first, ids[first:end], level + 1))
            first = end
    return Tree(feature[:count].copy(), code[:count].copy(), left[:count].copy(), total[:count].copy(), ones[:count].copy(),
                np.concatenate(masks), importance)


def leaves(tree: Tree, arity: Sequence[int], points: np.ndarray) -> np.ndarray:
    """The leaf of each row of codes."""
    node, live, nominal = np.zeros(len(points), np.int32), np.arange(len(points)), np.asarray(arity) > 0
    flat, wide = points.reshape(-1), points.shape[1]
    while len(live):
        at = node[live]
        by = tree.feature[at]
        inner = by >= 0
        live, at, by = live[inner], at[inner], by[inner].astype(np.int64)
        value, cut = flat[live * wide + by], tree.code[at]
        right = value > cut
        mine = np.flatnonzero(nominal[by])
        if len(mine):
            own = value[mine]
            bits = tree.masks[cut[mine], own >> 6] >> (own & 63).astype(np.uint64)
            right[mine] = (bits & np.uint64(1)) == 0
        node[live] = tree.left[at] + right
    return node


def _read(folder: str, columns: Sequence[str]) -> pa.Table:
    """Columns of a table in the shared folder, rows in the order in which they were sorted."""
    import pyarrow.parquet as pq

    system, path = pa.fs.FileSystem.from_uri(folder)
    found = system.get_file_info(pa.fs.FileSelector(path))
    files = sorted(f.path for f in found if f.path.endswith(".parquet"))
    return pa.concat_tables([pq.read_table(f, columns=list(columns), filesystem=system) for f in files])


def _coded(column: pa.ChunkedArray, arity: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes in as few bytes as they need, and the values that they stand for; categories are codes already."""
    values = np.arange(arity, dtype=np.float64) if arity else np.sort(pc.unique(column).to_numpy())
    kind = next(t for t in (np.uint8, np.uint16, np.int32) if len(values) <= np.iinfo(t).max + 1)
    codes, low = np.empty(len(column), kind), 0
    for chunk in column.chunks:
        own = chunk.to_numpy()
        codes[low:low + len(own)] = own if arity else np.searchsorted(values, own)
        low += len(own)
    return codes, values


def _packed(tree: Tree, values: Sequence[np.ndarray], arity: Sequence[int]) -> bytes:
    """The tree with real thresholds, compressed."""
    threshold, mask = np.full(len(tree.feature), np.nan), np.zeros((len(tree.feature), tree.masks.shape[1]), np.uint64)
    for j, own in enumerate(values):
        mine = np.flatnonzero(tree.feature == j)
        if arity[j]:
            mask[mine] = tree.masks[tree.code[mine]]
        else:
            threshold[mine] = own[tree.code[mine]] / 2 + own[tree.code[mine] + 1] / 2
    columns = {"feature": tree.feature, "threshold": threshold, "left": tree.left, "total": tree.total, "ones": tree.ones}
    batch = pa.RecordBatch.from_pydict(columns | {f"mask_{w}": mask[:, w] for w in range(mask.shape[1])})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _nodes(number: int, packed: bytes, arity: Sequence[int]) -> pa.RecordBatch:
    """The rows in which MLlib saves a tree."""
    t = pa.ipc.open_stream(packed).read_all()
    feature, threshold, left, total, ones = (
        t.column(c).to_numpy() for c in ("feature", "threshold", "left", "total", "ones"))
    masks = [t.column(c).to_numpy() for c in t.column_names if c.startswith("mask_")]
    size, inner = len(feature), feature >= 0
    shares = np.stack([total - ones, ones], axis=1).astype(np.float64)
    impurity = 1 - ((shares / total[:, None]) ** 2).sum(axis=1)
    child = np.where(inner, left, 0)
    weighted = (total[child] * impurity[child] + total[child + inner] * impurity[child + inner]) / total
    categories = np.where(inner, np.where(np.asarray(arity)[feature] > 0, np.asarray(arity)[feature], -1), -1)
    held = np.zeros((size, max(1, *arity)), bool)  # column 0 doubles as the place of a threshold
    for c in range(max(arity)):
        held[:, c] = (categories > 0) & ((masks[c >> 6] >> np.uint64(c & 63)) & np.uint64(1) > 0)
    number_split = inner & (categories < 0)
    held[number_split, 0] = True
    at, what = np.nonzero(held)
    offsets = np.concatenate(([0], np.cumsum(held.sum(axis=1)))).astype(np.int32)
    said = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.where(number_split[at], threshold[at], what)))
    split = pa.StructArray.from_arrays(
        [pa.array(feature.astype(np.int32)), said, pa.array(categories.astype(np.int32))],
        ["featureIndex", "leftCategoriesOrThreshold", "numCategories"])
    data = pa.StructArray.from_arrays([
        pa.array(np.arange(size, dtype=np.int32)), pa.array((2 * ones > total).astype(np.float64)), pa.array(impurity),
        pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * size + 1, 2, dtype=np.int32)), pa.array(shares.reshape(-1))),
        pa.array(total), pa.array(np.where(inner, impurity - weighted, -1.0)),
        pa.array(np.where(inner, left, -1).astype(np.int32)), pa.array(np.where(inner, left + 1, -1).astype(np.int32)), split,
    ], ["id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", "split"])
    return pa.RecordBatch.from_arrays([pa.array(np.full(size, number, np.int32)), data], ["treeID", "nodeData"])


@dataclass
class Plot:
    """A forest to grow: SQL conditions of the rows to learn from and of those to predict. Without ``keep``, only votes are left."""

    learn: str
    predict: str
    name: int = 0
    keep: bool = True


@dataclass
class Wood(Forest):
    """A forest whose trees lie packed in a table; ``groves`` are conditions on it."""

    estimator: Estimator | None = None
    arity: list[int] = field(default_factory=list)
    seed: int = 0

    def models(self) -> Iterator[Model]:
        """The groves as models of MLlib, one after another, each written for it first."""
        arity = self.arity

        def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for number, packed in zip(batch["place"].to_pylist(), batch["packed"].to_pylist(), strict=True):
                    yield _nodes(number, packed, arity)

        grove = max(self.trees)
        rows = [(float(c), Vectors.dense([float(c)] * len(arity))) for c in (0, 1)]
        few = self.spark.createDataFrame(rows, ["label", "features"])
        for g, own in enumerate(self.groves):
            path = new_folder(self.spark, "grove")
            options = {self.estimator.numTrees: self.trees[g], self.estimator.seed: self.seed + g}
            self.estimator.copy(options).fit(few).write().save(path)
            packed = self.spark.read.parquet(self.folder).where(own).select(
                (F.col("tree") - g * grove).alias("place"), "packed")
            packed.mapInArrow(nodes, NODE).write.mode("overwrite").parquet(f"{path}/data")
            yield RandomForestClassificationModel.load(path)


def _growing(
    folder: str, plots: Sequence[Plot], carried: Sequence[str], arity: Sequence[int], trees: int, grove: int, seed: int,
    depth: int, tried: int,
):
    """For numbers of jobs (grove by grove, in each all forests): the votes of a grove in chunks, and its trees."""
    features, schema = [f"f{j}" for j in range(len(arity))], None

    def work(job: int) -> Iterator[dict]:
        g, i = divmod(job, len(plots))
        codes, values = zip(*(_coded(_read(folder, [c]).column(0), a) for c, a in zip(features, arity, strict=True)), strict=True)
        label = _read(folder, ["label"]).column(0).to_numpy().astype(np.uint8)
        role = _read(folder, [f"role_{i}"]).column(0).to_numpy()
        rows, asked = np.flatnonzero(role & 1).astype(np.int32), np.flatnonzero(role & 2)
        points = np.stack(codes, axis=1)
        wanted = points[asked]
        del codes
        shares = np.zeros((len(asked), 2))
        for number in range(g * grove, min((g + 1) * grove, trees)):
            rng = np.random.default_rng((seed % 2**63, number))
            tree = grow(points, values, arity, label, rows, rng.poisson(1.0, len(rows)).astype(np.uint8), rng, depth, tried)
            for low in range(0, len(asked), CHUNK):
                leaf = leaves(tree, arity, wanted[low:low + CHUNK])
                one = tree.ones[leaf] / tree.total[leaf]
                shares[low:low + CHUNK, 1] += one
                shares[low:low + CHUNK, 0] += 1 - one
            packed = _packed(tree, values, arity) if plots[i].keep else None
            yield {"forest": plots[i].name, "part": g, "tree": number, "nodes": len(tree.feature),
                   "importance": tree.importance.tolist(), "packed": packed}
        beside = _read(folder, carried).take(pa.array(asked)) if g == 0 else None
        for chunk, low in enumerate(range(0, len(asked), CHUNK)):
            rest = None if beside is None else _bytes(beside.slice(low, CHUNK))
            yield {"forest": plots[i].name, "part": g, "chunk": chunk, "votes": shares[low:low + CHUNK].tobytes(), "beside": rest}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for job in batch["id"].to_pylist():
                for row in work(job):
                    yield pa.RecordBatch.from_pylist([row], schema)

    schema = pa.schema([
        ("forest", pa.int32()), ("part", pa.int32()), ("tree", pa.int32()), ("nodes", pa.int64()),
        ("importance", pa.list_(pa.float64())), ("packed", pa.binary()), ("chunk", pa.int32()), ("votes", pa.binary()),
        ("beside", pa.binary())])
    return run


_GROWN = ("forest int, part int, tree int, nodes bigint, importance array<double>, packed binary, chunk int, votes binary, "
          "beside binary")


def _bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _summed(key: tuple, rows: pa.Table) -> pa.Table:
    """The votes of a chunk, added grove by grove, beside what was carried of its rows."""
    parts = rows.select(["part", "votes", "beside"]).sort_by("part").to_pylist()
    votes = sum(np.frombuffer(p["votes"]) for p in parts)
    table = pa.ipc.open_stream(parts[0]["beside"]).read_all()
    offsets = pa.array(np.arange(0, len(votes) + 1, 2, dtype=np.int32))
    forest = pa.array(np.full(table.num_rows, key[0].as_py(), np.int32))
    return table.append_column("votes", pa.ListArray.from_arrays(offsets, pa.array(votes))).append_column("forest", forest)


def grown(
    estimator: Estimator, data: DataFrame, plots: Sequence[Plot], carried: Sequence[str], arity: Sequence[int], trees: int,
    seed: int, grove: int = GROVE,
) -> tuple[list[Wood], DataFrame]:
    """One forest for each plot, and the votes: the carried columns, ``votes`` (summed over all trees) and ``forest``.

    ``data`` holds ``label`` (0 or 1), ``features`` and the carried columns; ``arity`` the categories of each feature, or 0.
    """
    spark = data.sparkSession
    arity, depth = list(arity), estimator.getMaxDepth()
    folder = new_folder(spark, "forest")
    value = vector_to_array("features")
    columns = [(value[j].cast("int") if a else value[j] + F.lit(0.0)).alias(f"f{j}") for j, a in enumerate(arity)]
    roles = [(F.when(F.expr(p.learn), 1).otherwise(0) + F.when(F.expr(p.predict), 2).otherwise(0)).cast("byte").alias(f"role_{i}")
             for i, p in enumerate(plots)]
    table = data.select(*dict.fromkeys([*carried, "label"]), *columns, *roles)
    # Ordered by all that tells rows apart: equal rows give equal trees, however they were dealt out.
    table.orderBy(*table.columns).write.parquet(f"{folder}/rows")
    parts = -(-trees // grove)
    jobs = parts * len(plots)
    work = _growing(f"{folder}/rows", list(plots), list(carried), arity, trees, grove, seed, depth,
                    int(np.ceil(np.sqrt(len(arity)))))
    spark.range(0, jobs, 1, jobs).mapInArrow(work, _GROWN).write.parquet(f"{folder}/grown")
    found = spark.read.schema(_GROWN).parquet(f"{folder}/grown")
    forests = {p.name: Wood(spark, f"{folder}/grown", estimator=estimator, arity=arity, seed=seed) for p in plots}
    for r in found.where("tree IS NOT NULL").select("forest", "tree", "nodes", "importance").orderBy("forest", "tree").collect():
        own, importance = forests[r["forest"]], np.array(r["importance"])
        total = importance.sum()
        importance = importance / total if total else importance
        own.nodes += r["nodes"]
        own.importances = importance if own.importances is None else own.importances + importance
    for p in plots:
        forests[p.name].trees = [min(grove, trees - low) for low in range(0, trees, grove)]
        forests[p.name].groves = [f"forest = {p.name} AND part = {g} AND tree IS NOT NULL" for g in range(parts)] if p.keep else []
    kept = ", ".join(f"`{c}` {data.schema[c].dataType.simpleString()}" for c in carried)
    votes = found.where("chunk IS NOT NULL").select("forest", "chunk", "part", "votes", "beside")
    said = votes.groupBy("forest", "chunk").applyInArrow(_summed, f"{kept}, votes array<double>, forest int")
    return [forests[p.name] for p in plots], said
