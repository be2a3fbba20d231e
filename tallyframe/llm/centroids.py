"""Ball k-means over whole-number vectors, exact to the last unit.

A cluster is a ball: its centroid and the distance of its farthest member. Only centroids nearer than twice
the radius are neighbours of the ball, for a centroid at d(c, c') > 2 d(x, c) is farther from x than c is.
Members nearer to c than half the way to the nearest neighbour are the stable core and are compared with no
other centroid; the rest lie in annuli, bounded by half the distances to the neighbours in order, and are
compared with the neighbours whose annulus they have reached only. All distances are squared whole numbers,
so that these bounds, ties included, hold exactly.

Vectors lie in blocks, rows of some thousand vectors with their clusters. A round is one pass over the blocks:
it moves members and writes the blocks together with sums and counts of each block, which are added up by
Spark and are read alone, as columns, to find the next centroids. The driver holds k centroids only.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, table

K, ROUNDS, DIMENSIONS, SCALE, SEED = 40, 5, 64, 256, 2
#: Vectors of a block.
BLOCK = 4096
#: Largest component; sums of 64 squared differences of these stay below 2**63.
LARGEST = 1 << 27
#: Up to this component, sums of squares are exact as doubles too, and those are faster to multiply.
_EXACT = 1 << 22

_BLOCKS = "ids binary, known binary, vectors binary, width int, clusters binary, distances binary, sums array<long>, counts array<long>, inertia array<long>"


def whole_vectors(embeddings: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, q) of the rows whose vector has exactly so many components, none null or not finite: q is floor(scale * x).

    Raises where a component is beyond 2**27, as squared distances would not fit a long.
    """
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    fits = F.forall(x, lambda v: F.abs(v * scale) <= LARGEST)
    kept = embeddings.where(F.size("embedding") == dimensions).where(finite)
    whole = F.when(fits, F.transform(x, lambda v: F.floor(v * scale))).otherwise(F.raise_error(F.lit("a component is beyond 2**27")).cast("array<bigint>"))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("q"))


def first_centroids(vectors: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The vectors with the k smallest hashes of seed and id, in that order; of equal ids the smallest vector is first, null ids never."""
    ranked = vectors.where("vec_id is not null").orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256), "q")
    rows = ranked.select("q").limit(k).collect()
    return np.array([r.q for r in rows], np.int64) if rows else np.empty((0, 0), np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x to rows of c, exact."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= _EXACT:
        a, b = x.astype(np.float64), c.astype(np.float64)
        # all terms are whole numbers below 2**53
        return ((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], axis=1) if len(c) else np.empty((len(x), 0), np.int64)


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest row of c, squared distance) for each row of x; ties go to the smaller number."""
    d = squared(x, c)
    at = d.argmin(1)
    return at, d[np.arange(len(x)), at]


def reassigned(x: np.ndarray, was: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As nearest, for rows that were of the clusters `was`: each ball is compared with its neighbours by annuli."""
    now, best = was.copy(), np.empty(len(x), np.int64)
    between = squared(c, c)
    for i in np.unique(was):
        members = np.flatnonzero(was == i)
        ball = x[members]
        own = squared(ball, c[i : i + 1])[:, 0]
        best[members] = own
        # at 4 d(x, c)^2 < d(c, c')^2 the centroid c' is farther than c
        reach = 4 * own
        order = np.argsort(between[i], kind="stable")
        order = order[(order != i) & (between[i][order] <= reach.max())]
        for j in order:
            annulus = np.flatnonzero(reach >= between[i, j])
            there = squared(ball[annulus], c[j : j + 1])[:, 0]
            m = members[annulus]
            closer = (there < best[m]) | ((there == best[m]) & (j < now[m]))
            now[m[closer]], best[m[closer]] = j, there[closer]
    return now, best


def _packed(x: np.ndarray) -> tuple[bytes, int]:
    """x in the narrowest whole numbers that hold it, and their bytes."""
    most = int(np.abs(x).max(initial=0))
    width = next(w for w in (1, 2, 4) if most < 1 << (8 * w - 1))
    return x.astype(f"<i{width}").tobytes(), width


def _block(ids, known, vectors: np.ndarray, clusters: np.ndarray, distances: np.ndarray, k: int) -> list:
    """A block as a row of _BLOCKS, with its sums by cluster."""
    sums = np.zeros((k, vectors.shape[1]), np.int64)
    np.add.at(sums, clusters, vectors)
    inertia = np.zeros(k, np.int64)
    np.add.at(inertia, clusters, distances)
    packed, width = _packed(vectors)
    return [ids, known, packed, width, clusters.astype("<i4").tobytes(), distances.astype("<i8").tobytes(), sums.ravel(), np.bincount(clusters, minlength=k), inertia]


def _rows(rows: list[list]) -> pa.RecordBatch:
    types = [pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), *[pa.list_(pa.int64())] * 3]
    names = [x.split()[0] for x in _BLOCKS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def _first(centroids: np.ndarray):
    """Gathers vectors into blocks and compares each with all centroids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(ids: list, parts: list) -> pa.RecordBatch:
            id_column, x = pa.concat_arrays(ids), np.concatenate(parts)
            known = np.asarray(id_column.is_valid().to_numpy(zero_copy_only=False), np.uint8)
            at, d = nearest(x, centroids)
            return _rows([_block(id_column.fill_null(0).to_numpy().astype("<i8").tobytes(), known.tobytes(), x, at, d, len(centroids))])

        ids, parts, held = [], [], 0
        for b in batches:
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            for lo in range(0, b.num_rows, BLOCK):
                ids.append(b.column(0).slice(lo, BLOCK))
                parts.append(flat[lo : lo + BLOCK])
                held += len(parts[-1])
                if held >= BLOCK:
                    yield made(ids, parts)
                    ids, parts, held = [], [], 0
        if held:
            yield made(ids, parts)

    return run


def _unpacked(b: pa.RecordBatch, dimensions: int) -> Iterator[tuple]:
    for ids, known, vectors, width, clusters, distances in zip(*(c.to_pylist() for c in b.columns[:6])):
        x = np.frombuffer(vectors, f"<i{width}").reshape(-1, dimensions).astype(np.int64)
        yield ids, known, x, np.frombuffer(clusters, "<i4").astype(np.int64), distances


def _move(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, known, x, was, _ in _unpacked(b, centroids.shape[1]):
                yield _rows([_block(ids, known, x, *reassigned(x, was, centroids), len(centroids))])

    return run


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for ids, known, clusters, distances in zip(*(c.to_pylist() for c in b.columns)):
            missing = np.frombuffer(known, np.uint8) == 0
            columns = [pa.array(np.frombuffer(ids, "<i8"), mask=missing), pa.array(np.frombuffer(clusters, "<i4")), pa.array(np.frombuffer(distances, "<i8"))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance"])


def _added(blocks: DataFrame, column: str) -> list[int]:
    """The sums over all blocks of each place of an array column; they have no bound, so that they are added as decimals."""
    parts = blocks.select(F.posexplode(column).alias("place", "x")).groupBy("place").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    return [int(r.x) for r in parts.orderBy("place").collect()]


def centroids_of(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floored means of the clusters; empty clusters keep their centroid."""
    sums, counts = _added(blocks, "sums"), _added(blocks, "counts")
    out, width = centroids.copy(), centroids.shape[1]
    for i, n in enumerate(counts):
        if n:
            out[i] = [s // n for s in sums[i * width : (i + 1) * width]]
    return out


def ball_kmeans(vectors: DataFrame, first: np.ndarray, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """The blocks of vectors (vec_id, q) after so many rounds and a last assignment, and the final centroids.

    A round's blocks are a table in the shared folder; the one before it is removed when it has been read.
    """
    spark = vectors.sparkSession
    home = f"{shared_dir(spark)}/balls-{uuid.uuid4().hex}"
    files = spark._jvm.org.apache.hadoop.fs.Path(home).getFileSystem(spark._jsc.hadoopConfiguration())
    blocks, centroids = vectors.mapInArrow(_first(first), _BLOCKS), first
    for i in range(rounds + 1):
        blocks.write.parquet(f"{home}/{i}")
        if i:
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{home}/{i - 1}"), True)
        blocks = spark.read.schema(_BLOCKS).parquet(f"{home}/{i}")
        if i < rounds:
            centroids = centroids_of(blocks, centroids)
            blocks = blocks.mapInArrow(_move(centroids), _BLOCKS)
    return blocks, centroids


def cluster(embeddings: DataFrame, k: int = K, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each vector that whole_vectors keeps.

    Repeated rows are vectors of their own, and rows without an id are clustered too but are no first
    centroids. Fewer vectors than k give so many clusters; none with an id, or an empty table, give an empty table.
    Other columns count for nothing.
    """
    spark, vectors = embeddings.sparkSession, whole_vectors(embeddings, dimensions, scale)
    first = first_centroids(vectors, k, seed)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(first):
        return spark.createDataFrame([], schema)
    blocks, centroids = ball_kmeans(vectors, first, rounds)
    inertia = _added(blocks, "inertia")
    rows = [(i, inertia[i], sum(inertia), ",".join(map(str, c))) for i, c in enumerate(centroids.tolist())]
    named = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, components string")
    named = named.select("cluster", "cluster_inertia", "inertia", F.sha2("components", 256).alias("centroid_sha256"))
    found = blocks.select("ids", "known", "clusters", "distances").mapInArrow(_vectors, "vec_id long, cluster int, distance long")
    return found.join(F.broadcast(named), "cluster").select(*[x.split()[0] for x in schema.split(", ")])


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """The same rounds in SQL, every vector compared with every centroid."""
    steps = [f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS})""",
    f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), q) - 1 AS cluster, q AS c FROM v WHERE vec_id IS NOT NULL ORDER BY cluster LIMIT {K})"""]
    for i in range(ROUNDS + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT r, vec_id, q, cluster, d FROM (SELECT r, vec_id, q, cluster, CAST(list_sum(list_transform(list_zip(q, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, c{i})
QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, cluster) = 1)""")
        if i < ROUNDS:
            steps.append(f"""s{i} AS (SELECT cluster, k, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(range(1, {DIMENSIONS + 1})) AS k, unnest(q) AS x FROM a{i}) GROUP BY cluster, k)""")
            steps.append(f"""c{i + 1} AS MATERIALIZED (SELECT c{i}.cluster, coalesce(m.c, c{i}.c) AS c FROM c{i} LEFT JOIN (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY k) AS c FROM s{i} GROUP BY cluster) m ON m.cluster = c{i}.cluster)""")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, CAST(a{ROUNDS}.cluster AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a{ROUNDS}.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{ROUNDS} JOIN c{ROUNDS} ON c{ROUNDS}.cluster = a{ROUNDS}.cluster"""


OP12_SQL = _sql()
