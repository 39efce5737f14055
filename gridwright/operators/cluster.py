"""Clusters of feature vectors: scaling, components, k-means, and measures of how good they are."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwright.operators.pairs import dot


def standardise(df: DataFrame, features: str, width: int, out: str = "scaled") -> DataFrame:
    """Add ``out``: each figure less its mean, over its deviation (of the population; 1 where that is 0). One aggregation."""
    at = F.col(features)
    figures = df.agg(*[F.avg(at[k]).alias(f"m{k}") for k in range(width)], *[F.stddev_pop(at[k]).alias(f"s{k}") for k in range(width)])
    means, spreads = F.array(*[F.col(f"m{k}") for k in range(width)]), F.array(*[F.when(F.col(f"s{k}") > 0, F.col(f"s{k}")).otherwise(1.0) for k in range(width)])
    joined = df.crossJoin(F.broadcast(figures.select(means.alias("_m"), spreads.alias("_s"))))  # one row
    scaled = F.transform(features, lambda v, i: (v - F.col("_m")[i]) / F.col("_s")[i])
    return joined.withColumn(out, scaled).drop("_m", "_s")


def components(df: DataFrame, features: str, k: int, out: str = "emb") -> DataFrame:
    """Add ``out``: the first ``k`` principal components of centred figures; the largest loading of each is positive."""
    vectors = df.withColumn("_v", array_to_vector(features))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(vectors)
    loadings = model.pc.toArray()  # figures x k
    signs = [1.0 if abs(loadings[:, c].max()) >= abs(loadings[:, c].min()) else -1.0 for c in range(k)]
    got = model.transform(vectors).withColumn("_e", vector_to_array("_p"))
    return got.withColumn(out, F.transform("_e", lambda v, i: v * F.array(*map(F.lit, signs))[i])).drop("_v", "_p", "_e")


def kmeans(df: DataFrame, key: str, features: str, k: int, seed: int = 0, out: str = "cluster") -> tuple[DataFrame, list[list[float]]]:
    """``(rows with out, centres)``; clusters are numbered by their smallest key, so equal partitions get equal numbers."""
    vectors = df.withColumn("_v", array_to_vector(features))
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="_c").fit(vectors)
    got = model.transform(vectors).drop("_v")
    first = {r["_c"]: r["first"] for r in got.groupBy("_c").agg(F.min(key).alias("first")).collect()}  # k rows
    order = sorted(first, key=first.get)
    names = F.array(*[F.lit(order.index(c) if c in first else -1) for c in range(max(first) + 1)])
    centres = model.clusterCenters()
    return got.withColumn(out, names[F.col("_c")].cast("int")).drop("_c"), [centres[c].tolist() for c in order]


def square_distance(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def centroids(df: DataFrame, cluster: str, features: str, width: int) -> DataFrame:
    """``cluster, n, centre``"""
    at = F.col(features)
    return df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(at[k]) for k in range(width)]).alias("centre"))


def validity(df: DataFrame, cluster: str, features: str, width: int) -> DataFrame:
    """``clusters, inertia, calinski_harabasz, davies_bouldin`` from centroids; no pairs of rows, only of clusters."""
    centres = centroids(df, cluster, features, width)
    rows = df.join(F.broadcast(centres), cluster).withColumn("_d2", square_distance(features, "centre"))  # one row a cluster
    spread = rows.groupBy(cluster).agg(F.avg(F.sqrt("_d2")).alias("scatter"), F.sum("_d2").alias("within"))
    whole = df.agg(F.array(*[F.avg(F.col(features)[k]) for k in range(width)]).alias("mean"), F.count(F.lit(1)).alias("all"))
    facts = centres.join(spread, cluster).crossJoin(F.broadcast(whole))  # one row
    sums = facts.agg(F.count(F.lit(1)).alias("k"), F.sum("within").alias("w"), F.sum(F.col("n") * square_distance("centre", "mean")).alias("b"), F.first("all").alias("all"))
    a, b = facts.select(F.col(cluster).alias("_i"), F.col("scatter").alias("_si"), F.col("centre").alias("_ci")), facts.select(F.col(cluster).alias("_j"), F.col("scatter").alias("_sj"), F.col("centre").alias("_cj"))
    ratio = (F.col("_si") + F.col("_sj")) / F.sqrt(square_distance("_ci", "_cj"))
    worst = a.join(b, F.col("_i") != F.col("_j")).groupBy("_i").agg(F.max(ratio).alias("r")).agg(F.avg("r").alias("davies_bouldin"))
    ch = (F.col("b") / (F.col("k") - 1)) / (F.col("w") / (F.col("all") - F.col("k")))
    return sums.crossJoin(worst).select(F.col("k").alias("clusters"), F.col("w").alias("inertia"), F.when((F.col("k") > 1) & (F.col("w") > 0), ch).alias("calinski_harabasz"), "davies_bouldin")


def silhouette(df: DataFrame, cluster: str, features: str, width: int) -> DataFrame:
    """``cluster, silhouette``: the mean silhouette by squared distance, worked out from the sums of each cluster.

    The mean squared distance of a point to a cluster follows from the cluster's size, sum and sum of squares, so no pairs
    of rows are formed.
    """
    at = F.col(features)
    sums = df.groupBy(F.col(cluster).alias("_c")).agg(F.count(F.lit(1)).alias("_n"), F.array(*[F.sum(at[k]) for k in range(width)]).alias("_sum"), F.sum(dot(features, features)).alias("_sq"))
    rows = df.select(cluster, features).withColumn("_id", F.monotonically_increasing_id())
    met = rows.join(F.broadcast(sums))  # one row a cluster: k copies of each point
    total = dot(features, features) * F.col("_n") - dot(features, "_sum") * 2 + F.col("_sq")
    own = F.col(cluster) == F.col("_c")
    mean = total / F.when(own, F.greatest(F.col("_n") - 1, F.lit(1))).otherwise(F.col("_n"))
    one = met.groupBy("_id", cluster).agg(F.max(F.when(own, mean)).alias("a"), F.min(F.when(~own, mean)).alias("b"), F.max(F.when(own, F.col("_n"))).alias("size"))
    s = F.when((F.col("size") > 1) & (F.greatest("a", "b") > 0), (F.col("b") - F.col("a")) / F.greatest("a", "b")).otherwise(0.0)
    return one.groupBy(cluster).agg(F.avg(s).alias("silhouette"), F.count(F.lit(1)).alias("n"))


def trustworthiness(ranks: DataFrame, k: int, n: int) -> DataFrame:
    """``trustworthiness, continuity, mean`` from ``rank_high, rank_low`` of each ordered pair (1 is nearest)."""
    scale = 2.0 / (n * k * (2 * n - 3 * k - 1))
    lost = F.sum(F.when((F.col("rank_low") <= k) & (F.col("rank_high") > k), F.col("rank_high") - k).otherwise(0))
    torn = F.sum(F.when((F.col("rank_high") <= k) & (F.col("rank_low") > k), F.col("rank_low") - k).otherwise(0))
    return ranks.agg((1 - lost * scale).alias("trustworthiness"), (1 - torn * scale).alias("continuity")).withColumn("mean_value", (F.col("trustworthiness") + F.col("continuity")) / 2)
