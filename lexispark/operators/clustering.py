"""Clusters of records or vectors, for routing by cluster."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assign(features: DataFrame, method: str, k: int, seed: int = 42, scale: bool = True) -> DataFrame:
    """id, cluster by kmeans, cosine_kmeans, bisecting or gmm. features: one id column and a vector column `features`; scaling is fit on the same rows."""
    from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
    from pyspark.ml.feature import StandardScaler

    key = next(c for c in features.columns if c != "features")
    if scale:
        features = StandardScaler(inputCol="features", outputCol="scaled", withMean=True).fit(features).transform(features).select(key, F.col("scaled").alias("features"))
    model = {
        "kmeans": lambda: KMeans(k=k, seed=seed),
        "cosine_kmeans": lambda: KMeans(k=k, seed=seed, distanceMeasure="cosine"),
        "bisecting": lambda: BisectingKMeans(k=k, seed=seed),
        "gmm": lambda: GaussianMixture(k=k, seed=seed),
    }[method]()
    return model.fit(features).transform(features).select(key, F.col("prediction").alias("cluster"))


#: Training rows on which the methods without a distributed form are fit, chosen by a hash of their id.
FIT_ROWS = 2_000


def scaling(train: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population standard deviation of each dimension over all training rows (features array<double>); a constant dimension has 1."""
    rows = train.select(F.posexplode("features").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).orderBy("i").collect()
    sd = np.array([r["s"] for r in rows])
    return np.array([r["m"] for r in rows]), np.where(sd > 0, sd, 1.0)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * x @ y.T, 0.0)


def ward(x: np.ndarray, k: int) -> np.ndarray:
    """Labels of k clusters by agglomeration that least raises the squared error, along chains of nearest neighbours."""
    n = len(x)
    center, size, alive = x.copy(), np.ones(n), np.ones(n, bool)
    merges: list[tuple[float, int, int]] = []
    chain: list[int] = []

    def cost(i: int) -> np.ndarray:
        c = ((center - center[i]) ** 2).sum(1) * size * size[i] / (size + size[i])
        c[~alive] = np.inf
        c[i] = np.inf
        return c

    while alive.sum() > 1:
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        c = cost(chain[-1])
        j = int(c.argmin())
        if len(chain) > 1 and c[chain[-2]] <= c[j]:
            j = chain[-2]
        if len(chain) > 1 and j == chain[-2]:
            b, a = sorted((chain.pop(), chain.pop()), reverse=True)
            merges.append((float(c[j]), a, b))
            center[a] = (center[a] * size[a] + center[b] * size[b]) / (size[a] + size[b])
            size[a] += size[b]
            alive[b] = False
        else:
            chain.append(j)
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for _, a, b in sorted(merges)[: max(0, n - k)]:
        root[find(b)] = find(a)
    return np.unique([find(i) for i in range(n)], return_inverse=True)[1]


def lloyd(x: np.ndarray, k: int, seed: int, rounds: int = 100) -> np.ndarray:
    """Labels by k-means from far-apart starts."""
    rng = np.random.default_rng(seed)
    c = x[[rng.integers(len(x))]]
    while len(c) < k:
        c = np.vstack((c, x[_distances(x, c).min(1).argmax()]))
    lab = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        new = _distances(x, c).argmin(1)
        if (new == lab).all() and _:
            break
        lab = new
        c = np.array([x[lab == i].mean(0) if (lab == i).any() else c[i] for i in range(k)])
    return lab


def spectral(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Labels by k-means on the first eigenvectors of the normalized graph of nearest neighbours."""
    m = min(len(x) - 1, 30, max(5, len(x) // 15))
    near = np.argsort(_distances(x, x), axis=1, kind="stable")[:, : m + 1]
    w = np.zeros((len(x), len(x)))
    np.put_along_axis(w, near, 1.0, 1)
    w = (w + w.T) / 2
    d = 1 / np.sqrt(w.sum(1))
    vec = np.linalg.eigh(d[:, None] * w * d[None])[1][:, -k:]
    return lloyd(vec / np.maximum(np.linalg.norm(vec, axis=1, keepdims=True), 1e-12), k, seed)


def dbscan(x: np.ndarray, k: int) -> np.ndarray:
    """Labels by density, -1 for noise: k neighbours within a radius taken from the percentile 20 + k (10 to 95) of the k-th distances."""
    d = np.sqrt(_distances(x, x))
    k = max(2, min(k, len(x)))
    core = np.sort(d, axis=1)[:, k - 1]
    eps = float(np.percentile(core, min(95, max(10, 20 + k)))) or float(np.median(core)) + 1e-9
    close = d <= eps
    dense = close.sum(1) >= k
    lab = np.full(len(x), -1)
    for i in np.flatnonzero(dense):
        if lab[i] >= 0:
            continue
        lab[i] = new = lab.max() + 1
        todo = [int(i)]
        while todo:
            for j in np.flatnonzero(close[todo.pop()] & (lab < 0)):
                lab[j] = new
                if dense[j]:
                    todo.append(int(j))
    return lab


def fit_assign(rows: DataFrame, train: DataFrame, method: str, k: int, seed: int = 42, fit_rows: int = FIT_ROWS) -> DataFrame:
    """id, cluster of all rows by ward, spectral or dbscan (k: clusters, for dbscan neighbours; -1 is noise).

    rows, train: an id and features array<double>. Scaled by all training rows, fit on at most `fit_rows` of them (these methods compare all rows with each other), then every
    row is assigned: by ward to the nearest centroid, else to the cluster of the nearest fitted row. Without training rows the result is empty.
    """
    key = next(c for c in rows.columns if c != "features")
    fit = train.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(fit_rows).collect()
    if not fit:
        return rows.select(key, F.lit(0).alias("cluster")).limit(0)
    mean, sd = scaling(train)
    x = (np.array([r["features"] for r in fit]) - mean) / sd
    lab = {"ward": lambda: ward(x, k), "spectral": lambda: spectral(x, k, seed), "dbscan": lambda: dbscan(x, k)}[method]()
    points, of = (np.array([x[lab == c].mean(0) for c in range(lab.max() + 1)]), np.arange(lab.max() + 1)) if method == "ward" else (x, lab)
    shared = rows.sparkSession.sparkContext.broadcast((points, of, mean, sd))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, of, mean, sd = shared.value
        for b in batches:
            if len(b):
                y = (np.array(b.column(1).to_pylist(), np.float64) - mean) / sd
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(of[_distances(y, points).argmin(1)].astype(np.int32))], names=[key, "cluster"])

    return rows.select(key, "features").mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, cluster int")


def nearest(vectors: DataFrame, train: DataFrame, most: int = 10_000) -> DataFrame:
    """vec_id, cluster, squared distance of the nearest centroid of the training labels (label, embedding); ties go to the lower label. At most `most` labels."""
    long = train.where("label is not null").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    cents = long.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s.m).alias("centroid"))
    if cents.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} labels")
    all_ = cents.agg(F.collect_list(F.struct("label", "centroid")).alias("all"))  # one row
    dist = lambda c: F.aggregate(F.zip_with("embedding", c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda x, y: x + y)
    j = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).join(F.broadcast(all_))
    best = F.array_min(F.transform("all", lambda s: F.struct(F.round(dist(s.centroid), 9).alias("d"), s.label.alias("label"))))
    return j.select("vec_id", best.alias("b")).select("vec_id", F.col("b.label").alias("cluster"), F.col("b.d").alias("distance"))
