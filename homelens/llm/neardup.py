"""Near-duplicate vectors by PCA-ordered tiles.

Equal vectors become one with a weight. Unit vectors are turned into the principal axes, so that leading
dimensions hold most of a product. Leading axes are cut where few vectors lie within reach of the cut, the
distance of linked ones: a vector is a member of its own cell and a guest of each cell of smaller number that
its reach meets, so every near pair meets with a member on one side, and only once. Axes without such places
(vectors spread alike in all directions) are not cut; then all vectors share a cell, and the work stays
quadratic. A cell of over ``GROUP`` vectors is dealt to pairs of its parts.

In a task vectors are sorted along the first axis into tiles. Products of tiles whose boxes come near enough
are accumulated over blocks of dimensions, leading ones first; what is left of each product is bounded by the
norms of the suffixes, and after every block the pairs whose bound cannot reach the threshold are dropped.
Tasks hold vectors in single precision and settle all pairs but those nearer to the threshold than its error;
these are finished by the cosine of the given vectors in double precision. A task returns link counts of its
vectors and a spanning forest of its links, never the settled pairs.

Defined results: null, zero and non-finite vectors (or components) link with nothing; shorter vectors
count as padded with zeros; repeated rows and equal vectors link with each other; an empty table gives no
rows; other columns, labels too, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from homelens.llm import storage
from homelens.llm.components import connected_components

GROUP = 16384
TILE = 256
BLOCKS = (16, 24, 32, 48, 64, 96, 128, 192, 256, 384, 512, 768, 1024)
EDGE = 2e-6  # more than single precision loses
AXES = 4
GUESTS = 0.2


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    lengths = np.array(column.value_lengths().fill_null(0).to_pylist(), np.int64)
    row = np.repeat(np.arange(len(column)), lengths)
    place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row, place] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """(node, e array<double>, copies) of usable vectors: node is the smallest vec_id of equal ones."""
    doubles = F.col("embedding").cast("array<double>")
    fine = F.coalesce(F.forall(doubles, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)), F.lit(False)) & F.coalesce(F.exists(doubles, lambda x: x != 0), F.lit(False))
    usable = vectors.select(F.col("vec_id").cast("long"), F.transform(doubles, lambda x: x + F.lit(0.0)).alias("e"), fine.alias("fine")).filter("fine")
    return usable.groupBy("e").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))


def principal_axes(nodes: DataFrame, width: int) -> np.ndarray:
    """Principal axes of the unit vectors, strongest first; each task returns one sum of ``width`` squared numbers."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = _matrix(batch.column("e"), width)
            x /= np.linalg.norm(x / np.abs(x).max(1, keepdims=True), axis=1, keepdims=True) * np.abs(x).max(1, keepdims=True)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(list(total))], names=["i", "row"])

    summed = nodes.select("e").mapInArrow(gather, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"))
    spread = np.zeros((width, width))
    for i, j, x in summed.collect():  # width squared numbers, whatever the number of vectors
        spread[i, j] = x
    return np.linalg.eigh(spread)[1][:, ::-1]


class _Tile:
    """Unit vectors of one tile with the norms of their suffixes."""

    def __init__(self, unit: np.ndarray) -> None:
        self.unit = unit
        self.low, self.high = unit.min(0), unit.max(0)
        ends = [0, *(b for b in BLOCKS if b < unit.shape[1]), unit.shape[1]]
        self.parts = list(zip(ends[:-1], ends[1:], strict=True))
        squares = np.stack([(unit[:, a:b] ** 2).sum(1) for a, b in self.parts], 1)
        self.rest = np.sqrt(np.maximum(0, squares.sum(1, keepdims=True) - np.cumsum(squares, 1)))


def _linked(x: _Tile, y: _Tile, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of x, rows of y, whether it is sure) of the pairs that may reach the threshold, block after block with the suffix bound."""
    a, b = x.parts[0]
    product = x.unit[:, a:b] @ y.unit[:, a:b].T
    i, j = np.nonzero(product + x.rest[:, :1] * y.rest[None, :, 0] >= threshold - EDGE)
    sums = product[i, j]
    for k, (a, b) in enumerate(x.parts[1:], 1):
        if not len(i):
            break
        if len(i) > len(x.unit) * len(y.unit) // 4:  # most pairs are alive: one product of the block
            sums = sums + (x.unit[:, a:b] @ y.unit[:, a:b].T)[i, j]
        else:
            sums = sums + np.einsum("ij,ij->i", x.unit[i, a:b], y.unit[j, a:b])
        alive = sums + x.rest[i, k] * y.rest[j, k] >= threshold - EDGE
        i, j, sums = i[alive], j[alive], sums[alive]
    return i, j, sums >= threshold + EDGE


def _join_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels of components after the links (i, j): smallest labels spread along links until none changes."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j = i[apart], j[apart]
        low, high = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
        target = np.arange(len(label))
        np.minimum.at(target, high, low)
        while (target[target] != target).any():
            target = target[target]
        label = target[label]


def _axis_cuts(turned: DataFrame, far: float, axes: int) -> list[list[float]]:
    """Cuts of each leading axis, over ``far`` apart, each with at most ``GUESTS`` of the vectors within ``far`` of it."""
    shares = [k / 128 for k in range(1, 128)]
    found = turned.agg(*[F.percentile_approx(F.col("lead")[k], shares, 1000).alias(f"c{k}") for k in range(axes)]).first()
    cuts = []
    for k in range(axes):
        some: list[float] = []
        points = np.array(found[k])
        for c, share in zip(points, shares, strict=True):
            near = np.interp(c + far, points, shares, right=1.0) - np.interp(c - far, points, shares, left=0.0)
            if near <= GUESTS * min(1.0, 4 * share * (1 - share)) and (not some or c - some[-1] > far):
                some.append(float(c))
        cuts.append(some)
    return cuts


def linked_vectors(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of (vec_id, embedding)."""
    nodes = storage.materialize(distinct_vectors(vectors), "vectors")
    size = nodes.agg(F.max(F.size("e")), F.count("*")).first()
    width, total = size[0] or 1, size[1]
    axes = principal_axes(nodes, width)
    far = float(np.sqrt(max(0.0, 2 * (1 - threshold)))) + 1e-5  # linked unit vectors are this near
    leading = min(AXES, width)

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("e"), width)
            x = x / np.abs(x).max(1, keepdims=True)
            unit = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ axes
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("copies"), pa.array(list(unit[:, :leading])), pa.array([r.tobytes() for r in unit.astype("<f4")], pa.binary())], names=["node", "copies", "lead", "unit"])

    turned = storage.materialize(nodes.mapInArrow(turn, "node long, copies long, lead array<double>, unit binary"), "turned")
    cuts = _axis_cuts(turned, far, leading) if total else [[]]

    def numbers(reach: float) -> list:
        """Cell number on each axis of the point ``reach`` further on."""
        return [sum([(F.col("lead")[k] + F.lit(reach) > F.lit(c)).cast("int") for c in some], F.lit(0)) for k, some in enumerate(cuts)]

    label = lambda x: F.lpad(x.cast("string"), 3, "0")

    def reached(names: Column, low: Column, high: Column) -> Column:
        """Each name with each number of the next axis."""
        return F.flatten(F.transform(names, lambda p: F.transform(F.sequence(low, high), lambda c: F.concat_ws(".", p, label(c)))))

    first, *others = zip(numbers(-far), numbers(far), strict=True)
    own, cells = F.concat_ws(".", *map(label, numbers(0.0))), F.transform(F.sequence(*first), label)
    for low, high in others:
        cells = reached(cells, low, high)
    placed = turned.select("node", "copies", "unit", own.alias("own"), F.explode(F.filter(cells, lambda c: c <= own)).alias("cell"))
    sizes = storage.materialize(placed.groupBy("cell").agg(F.count("*").alias("n")).select("cell", F.ceil(F.col("n") / GROUP).cast("int").alias("parts")), "vector-cells")
    dealt = placed.join(sizes, "cell").withColumn("t", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("a", F.least("t", "o")).withColumn("b", F.greatest("t", "o"))

    def compare(table: pa.Table) -> pa.Table:
        member = np.array(table.column("cell").to_pylist()) == np.array(table.column("own").to_pylist())
        part, node, copies = (table.column(c).to_numpy() for c in ("t", "node", "copies"))
        cross = table.column("a")[0].as_py() != table.column("b")[0].as_py()
        unit = np.frombuffer(b"".join(table.column("unit").to_pylist()), "<f4").reshape(-1, width)
        order = np.argsort(unit[:, 0], kind="stable")
        tiles = [order[k : k + TILE] for k in range(0, len(order), TILE)]
        made = [_Tile(unit[t].astype(np.float64)) for t in tiles]
        low, high = np.stack([m.low for m in made]), np.stack([m.high for m in made])
        count, label, open_i, open_j = np.zeros(len(node), np.int64), np.arange(len(node)), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for p in range(len(made)):
            gap = np.maximum(0, np.maximum(low[p:] - high[p], low[p] - high[p:]))
            for q in p + np.flatnonzero((gap**2).sum(1) <= far * far):
                i, j, sure = _linked(made[p], made[q], threshold)
                i, j = tiles[p][i], tiles[q][j]
                keep = (member[i] | member[j]) & ((i < j) | (p != q)) & ((part[i] != part[j]) | (not cross))
                if p == q:  # each pair of a tile is seen both ways; i < j keeps one
                    keep &= i != j
                open_i.append(i[keep & ~sure])
                open_j.append(j[keep & ~sure])
                i, j = i[keep & sure], j[keep & sure]
                count += np.bincount(i, copies[j], minlength=len(node)).astype(np.int64) + np.bincount(j, copies[i], minlength=len(node)).astype(np.int64)
                label = _join_labels(label, i, j)
        hit, i, j = np.flatnonzero(count), np.concatenate(open_i), np.concatenate(open_j)
        return pa.table({"node": pa.array(np.append(node[hit], node[i]), pa.int64()), "links": pa.array(np.append(count[hit], np.full(len(i), -1)), pa.int64()), "root": pa.array(np.append(node[label[hit]], node[j]), pa.int64())})

    found = dealt.select("cell", "own", "a", "b", "t", "node", "copies", "unit").groupBy("cell", "a", "b").applyInArrow(compare, "node long, links long, root long")
    found = storage.materialize(found, "vector-links")
    side = lambda name: nodes.select(F.col("node").alias(name), F.col("e").alias(f"{name}_e"), F.col("copies").alias(f"{name}_n"))
    close = found.filter("links < 0").select(F.col("node").alias("x"), F.col("root").alias("y")).join(side("x"), "x").join(side("y"), "y")
    dot = lambda u, v: f"aggregate(zip_with({u}, {v}, (p, q) -> coalesce(p, 0D) * coalesce(q, 0D)), 0D, (s, z) -> s + z)"
    scaled = close.select("x", "y", "x_n", "y_n", *[F.expr(f"transform({c}, z -> z / array_max(transform({c}, w -> abs(w))))").alias(c) for c in ("x_e", "y_e")])
    exact = scaled.filter(F.expr(f"{dot('x_e', 'y_e')} / (sqrt({dot('x_e', 'x_e')}) * sqrt({dot('y_e', 'y_e')})) >= {threshold!r}"))
    more = exact.select(F.explode(F.array(*[F.struct(F.col(a).alias("node"), F.col(f"{b}_n").alias("links"), F.least("x", "y").alias("root")) for a, b in (("x", "y"), ("y", "x"))])).alias("l")).select("l.*")
    links = storage.materialize(found.filter("links >= 0").unionByName(more), "vector-sure")
    counted = links.groupBy("node").agg(F.sum("links").alias("others"))
    parts = connected_components(links.select("node", "root")).withColumnRenamed("component", "component_id")
    known = nodes.select("e", "node", "copies").join(counted, "node", "left").join(parts, "node", "left")
    known = storage.materialize(known.select("e", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "node").alias("component_id")), "vector-classes")
    rows = vectors.select(F.col("vec_id").cast("long"), F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0)).alias("e"))
    joined = rows.join(known, "e", "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op6_pca_tiles(spark, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at a cosine of 0.95."""
    return linked_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
