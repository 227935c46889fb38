"""Near-duplicate embeddings by PCA-ordered tiled comparison with suffix-norm bounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretoken.llm.common import Scratch
from foretoken.llm.components import connected_components

THRESHOLD = 0.9
# Vectors of one group, fewer if they have over 512 dimensions; two groups meet in one place.
GROUP, GROUP_ENTRIES = 8192, 1 << 22
# Vectors of one tile inside a group.
TILE = 512
# Leading coordinates whose signs order vectors, so that tiles hold neighbours.
CODE_BITS = 12
# Slack of the bounds; what they let through is verified on the vectors as given.
SLACK = 1e-9
# Entries of all rotations together that are sent to the tasks (32 MB); others keep their axes.
ROTATION_ENTRIES = 1 << 22


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Every vector times a power of two that brings its largest component near 1, without rounding."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=1, keepdims=True))
    return np.ldexp(vectors, -exponent)


def _stats(batches):
    """Per dimension and batch: count, sum and products of the unit vectors."""
    for batch in batches:
        by_size: dict[int, list] = {}
        for vector in batch.column(0).to_pylist():
            by_size.setdefault(len(vector), []).append(vector)
        for size, vectors in by_size.items():
            x = _scaled(np.array(vectors, np.float64))
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([size], pa.int32()),
                    pa.array([len(x)], pa.int64()),
                    pa.array([(x.T @ x).ravel()], pa.list_(pa.float64())),
                ],
                ["dim", "n", "products"],
            )


def _add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    products = np.sum([p.values.to_numpy() for p in table.column("products")], axis=0)
    return pa.table(
        [
            pa.array([key[0].as_py()], pa.int32()),
            pa.array([sum(table.column("n").to_pylist())], pa.int64()),
            pa.array([products], pa.list_(pa.float64())),
        ],
        names=["dim", "n", "products"],
    )


def rotations(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each dimension the principal axes of its unit vectors, strongest first.

    A rotation changes no product; it puts into the leading coordinates what tells vectors apart.
    """
    schema = "dim int, n bigint, products array<double>"
    sums = (
        vectors.select("vector").mapInArrow(_stats, schema)
        .groupBy("dim").applyInArrow(_add, schema)
    )
    # Most frequent dimensions first, as long as the axes stay within the bound.
    axes, entries = {}, 0
    for row in sums.orderBy(F.desc("n"), "dim").limit(64).toLocalIterator():
        entries += row.dim**2
        if entries <= ROTATION_ENTRIES:
            _, found = np.linalg.eigh(np.array(row.products).reshape(row.dim, row.dim))
            axes[row.dim] = np.ascontiguousarray(found[:, ::-1])
    return axes


class _Tiles:
    """Rotated unit vectors, sorted by code, with what bounds their products."""

    def __init__(self, ids, counts, vectors, codes, axes, lead):
        order = np.argsort(codes, kind="stable")
        self.ids, self.counts = ids[order], counts[order]
        self.raw = _scaled(vectors[order])
        self.norms = np.sqrt(np.einsum("ij,ij->i", self.raw, self.raw))
        unit = self.raw / self.norms[:, None]
        self.unit = unit @ axes if axes is not None else unit
        self.cuts = [*range(0, len(ids), TILE), len(ids)]
        squares = self.unit**2
        # Norm of the coordinates from each of the steps on.
        self.suffix = {k: np.sqrt(squares[:, k:].sum(axis=1)) for k in lead}
        first = lead[0]
        self.low = [self.unit[a:b, :first].min(axis=0) for a, b in self.spans()]
        self.high = [self.unit[a:b, :first].max(axis=0) for a, b in self.spans()]

    def spans(self):
        return list(zip(self.cuts[:-1], self.cuts[1:]))


def _steps(dim: int) -> list[int]:
    """Leading dimensions that are summed before each look at the bound."""
    steps = [k for k in (max(1, dim // 4), max(1, dim // 2)) if k < dim]
    return list(dict.fromkeys(steps)) or [dim]


def tile_links(left: _Tiles, right: _Tiles, same: bool, threshold: float):
    """Pairs of rows with cosine >= threshold, tile by tile; ``same``: one table against itself."""
    dim = left.unit.shape[1]
    steps = _steps(dim)
    least = threshold - SLACK
    for i, (a, b) in enumerate(left.spans()):
        for j, (c, d) in enumerate(right.spans()):
            if same and j < i:
                continue
            # Unit vectors of cosine t lie sqrt(2 - 2t) apart; so do, at least, the boxes.
            gap = np.maximum(0, np.maximum(left.low[i] - right.high[j], right.low[j] - left.high[i]))
            if gap @ gap > 2 - 2 * least + SLACK:
                continue
            done = steps[0]
            part = left.unit[a:b, :done] @ right.unit[c:d, :done].T
            bound = np.outer(left.suffix[done][a:b], right.suffix[done][c:d])
            bound += part
            rows, cols = np.nonzero(bound >= least)
            if same and i == j:
                rows, cols = rows[rows < cols], cols[rows < cols]
            part = part[rows, cols]
            for k in [*steps[1:], dim]:
                if not len(rows):
                    break
                part = part + np.einsum(
                    "ij,ij->i", left.unit[a + rows, done:k], right.unit[c + cols, done:k]
                )
                rest = left.suffix[k][a + rows] * right.suffix[k][c + cols] if k < dim else 0.0
                keep = part + rest >= least
                rows, cols, part, done = rows[keep], cols[keep], part[keep], k
            if not len(rows):
                continue
            rows, cols = a + rows, c + cols
            exact = np.einsum("ij,ij->i", left.raw[rows], right.raw[cols])
            keep = exact / (left.norms[rows] * right.norms[cols]) >= threshold
            if keep.any():
                yield rows[keep], cols[keep]


def _spanning(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the classes of linked nodes in place: every label ends as the smallest of its class."""
    while True:
        one, two = labels[a], labels[b]
        if (one == two).all():
            return
        low = np.minimum(one, two)
        np.minimum.at(labels, one, low)
        np.minimum.at(labels, two, low)
        while True:
            jumped = labels[labels]
            if (jumped == labels).all():
                break
            labels[:] = jumped


LINK_SCHEMA = "a bigint, b bigint, n bigint"


def _compare(axes: dict[int, np.ndarray], threshold: float):
    def compare(table: pa.Table) -> pa.Table:
        sides = table.column("side").to_numpy()
        dim = table.column("dim")[0].as_py()
        vectors = table.column("vector").combine_chunks().flatten().to_numpy().reshape(-1, dim)
        ids, counts = table.column("id").to_numpy(), table.column("count").to_numpy()
        codes = table.column("code").to_numpy()
        made = []
        for side in (0, 1):
            at = np.flatnonzero(sides == side)
            if len(at):
                made.append(_Tiles(ids[at], counts[at], vectors[at], codes[at], axes.get(dim), _steps(dim)))
        same = table.column("one")[0].as_py() == table.column("two")[0].as_py()
        if len(made) < 2 and not same:
            return pa.table({n: pa.array([], pa.int64()) for n in ("a", "b", "n")})
        left, right = made[0], made[-1]
        n_left = len(left.ids)
        size = n_left if same else n_left + len(right.ids)
        labels, degree = np.arange(size), np.zeros(size, np.int64)
        for rows, cols in tile_links(left, right, same, threshold):
            moved = cols if same else cols + n_left
            np.add.at(degree, rows, right.counts[cols])
            np.add.at(degree, moved, left.counts[rows])
            _spanning(labels, rows, moved)
        all_ids = left.ids if same else np.concatenate([left.ids, right.ids])
        linked = np.flatnonzero(degree)
        return pa.table(
            {"a": all_ids[linked], "b": all_ids[labels[linked]], "n": degree[linked]}
        )

    return compare


def embedding_components(
    embeddings: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``(key, n_links, component_id, kept)`` for every row of ``embeddings``.

    Two rows link if the cosine of their vectors, in double precision, is at least ``threshold``
    (above 0). Null, empty and zero vectors and those with a null or non-finite component link with
    nothing, nor do vectors of different dimensions with each other. Equal vectors are compared
    once. A component is named by its smallest key; null keys are passed over. Repeated rows count
    as rows. Other columns are not read.

    Distinct vectors fall into groups of bounded size, neighbours together, and each two groups
    meet in one cell. A cell returns for each vector the number of its links there and one link
    that leads to the smallest vector it reaches there, never all pairs.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie in (0, 1]")
    spark = embeddings.sparkSession
    scratch = Scratch(spark)
    given = F.col(vector)
    finite = F.forall(
        given, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    )
    usable = given.isNotNull() & finite & F.exists(given, lambda x: x != 0)
    rows = scratch.store(
        embeddings.select(
            F.col(key).cast("bigint").alias("key"),
            F.when(usable, given).alias("vector"),
        ),
        "vectors",
    )
    classes = scratch.store(
        rows.where("vector is not null").groupBy("vector")
        .agg(F.min("key").alias("least"), F.count("*").alias("count"))
        .withColumn("id", F.monotonically_increasing_id()),
        "classes",
    )
    axes = rotations(classes)
    schema = "id bigint, count bigint, vector array<double>, dim int, code int"

    def coded(batches):
        for batch in batches:
            codes, dims = [], []
            for v in batch.column(2).to_pylist():
                x = np.array(v, np.float64)
                turned = x @ axes[len(v)] if len(v) in axes else x
                signs = turned[1 : 1 + CODE_BITS] > 0
                codes.append(int(signs @ (1 << np.arange(len(signs))[::-1])) if len(signs) else 0)
                dims.append(len(v))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    batch.column(2).cast(pa.list_(pa.float64())),
                    pa.array(dims, pa.int32()),
                    pa.array(codes, pa.int32()),
                ],
                ["id", "count", "vector", "dim", "code"],
            )

    marked = scratch.store(classes.select("id", "count", "vector").mapInArrow(coded, schema), "coded")
    # Codes in order fill groups of about GROUP vectors; a code with more is cut by a hash.
    # At most 2 ** CODE_BITS rows for each dimension.
    ranges, n_groups, filled = [], {}, {}
    sizes = marked.groupBy("dim", "code").count().orderBy("dim", "code")
    for dim, code, count in sizes.toLocalIterator():
        group, used = n_groups.get(dim, 1) - 1, filled.get(dim, 0)
        size = max(TILE, min(GROUP, GROUP_ENTRIES // dim))
        if used and used + count > size:
            group, used = group + 1, 0
        cuts = -(-count // size)
        ranges.append((dim, code, group, cuts))
        n_groups[dim], filled[dim] = group + cuts, used + count if cuts == 1 else size
    table = spark.createDataFrame(ranges, "in_dim int, in_code int, first int, cuts int")
    totals = spark.createDataFrame(list(n_groups.items()), "of_dim int, groups int")
    grouped = (
        marked.join(F.broadcast(table), (F.col("dim") == F.col("in_dim")) & (F.col("code") == F.col("in_code")))
        .join(F.broadcast(totals), F.col("dim") == F.col("of_dim"))
        .withColumn("group", F.col("first") + F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int"))
    )
    other = F.explode(F.sequence(F.lit(0), F.col("groups") - 1))
    cells = grouped.withColumn("other", other).select(
        "dim", "id", "count", "vector", "code",
        F.least("group", "other").alias("one"),
        F.greatest("group", "other").alias("two"),
        F.when(F.col("group") <= F.col("other"), 0).otherwise(1).alias("side"),
    )
    found = scratch.store(
        cells.groupBy("dim", "one", "two").applyInArrow(_compare(axes, threshold), LINK_SCHEMA), "links"
    )
    parts = connected_components(found.select("a", "b"), scratch)
    degrees = found.groupBy("a").agg(F.sum("n").alias("near"))
    named = (
        classes.select("vector", "id", "least", "count")
        .join(degrees, F.col("id") == F.col("a"), "left")
        .join(parts, F.col("id") == F.col("node"), "left")
        .withColumn("root", F.coalesce("component", "id"))
    )
    named = scratch.store(named.select("vector", "least", "count", "near", "root"), "named")
    roots = named.groupBy("root").agg(F.min("least").alias("component_id"))
    each = named.join(roots, "root").select(
        F.col("vector").alias("_vector"),
        (F.coalesce("near", F.lit(0)) + F.col("count") - 1).alias("_links"),
        F.col("component_id").alias("_component"),
    )
    alone = F.col("vector").isNull()
    return rows.join(each, F.col("vector") == F.col("_vector"), "left").select(
        F.col("key").alias(key),
        F.when(alone, F.lit(0)).otherwise(F.col("_links")).cast("bigint").alias("n_links"),
        F.when(alone, F.col("key")).otherwise(F.col("_component")).alias("component_id"),
        F.when(alone, F.lit(True))
        .otherwise(F.col("key").eqNullSafe(F.col("_component")))
        .alias("kept"),
    )
