"""Models on pyspark.ml: cross-validated predictions, factors, clusters, components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, VectorAssembler, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.quality import domains, ranking_quality
from millrace.operators.products import greatest_products
from millrace.operators.retrieval import nearest
from millrace.session import cut, materialised, swept

#: Rows of whole numbers that a table sent to all executors may have.
BROADCAST = 2_000_000


def cross_validated(df: DataFrame, key: str, features: Sequence[str], label: str, fold: str, folds: int, model: str = "linear") -> DataFrame:
    """key, fold, y, p: each row's probability from a model of the other folds. model: linear, or trees."""
    data = VectorAssembler(inputCols=list(features), outputCol="__x", handleInvalid="skip").transform(df).select(key, F.col(fold).alias("fold"), F.col(label).cast("double").alias("y"), "__x")
    data = cut(data)
    est = LogisticRegression(featuresCol="__x", labelCol="y", regParam=1e-4) if model == "linear" else GBTClassifier(featuresCol="__x", labelCol="y", maxIter=10, seed=0)
    out = None
    for k in range(folds):
        scored = est.fit(data.where(F.col("fold") != k)).transform(data.where(F.col("fold") == k))
        part = scored.select(key, "fold", "y", vector_to_array("probability")[1].alias("p"))
        out = part if out is None else out.unionAll(part)
    return out


def platt(df: DataFrame, y: str, p: str) -> DataFrame:
    """df with calibrated: a logistic curve of the score."""
    data = df.withColumn("__x", array_to_vector(F.array(F.col(p).cast("double"))))
    model = LogisticRegression(featuresCol="__x", labelCol=y).fit(data)
    return model.transform(data).withColumn("calibrated", vector_to_array("probability")[1]).drop("__x", "rawPrediction", "probability", "prediction")


def isotonic(df: DataFrame, y: str, p: str) -> DataFrame:
    model = IsotonicRegression(featuresCol=p, labelCol=y).fit(df)
    return model.transform(df).withColumnRenamed("prediction", "calibrated")


def clusters(df: DataFrame, key: str, vector: str, k: int, seed: int = 0) -> DataFrame:
    data = cut(df.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("__x")))
    model = KMeans(featuresCol="__x", k=k, seed=seed, maxIter=10).fit(data)
    return model.transform(data).select(key, F.col("prediction").alias("cluster"))


def components(df: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """key, pc: the first k principal components, of vectors less their mean."""
    data = df.select(key, F.col(vector).cast("array<double>").alias("v"))
    size = data.select(F.size("v")).first()[0]
    mean = data.agg(F.array(*[F.avg(F.col("v")[i]) for i in range(size)])).first()[0]
    centred = cut(data.select(key, array_to_vector(F.zip_with("v", F.array(*[F.lit(m) for m in mean]), lambda a, b: a - b)).alias("__x")))
    model = PCA(k=k, inputCol="__x", outputCol="__pc").fit(centred)
    return model.transform(centred).select(key, vector_to_array("__pc").alias("pc"))


def factor_candidates(log: DataFrame, queries: DataFrame, k: int, rank: int = 16, seed: int = 0) -> DataFrame:
    """query_id, item_id, score of implicit-feedback factors; ids of any type, numbered here. Unknown users have none.
    Of equal scores the item of greater norm is first, then that of the lesser number."""
    pairs = materialised(log.groupBy("user_id", "item_id").agg(F.count(F.lit(1)).cast("float").alias("r")), "pairs")
    numbers = {c: cut(pairs.select(c).where(F.col(c).isNotNull()).distinct().withColumn("__n", F.row_number().over(Window.partitionBy(F.pmod(F.xxhash64(c), F.lit(1024))).orderBy(c))).withColumn("__b", F.pmod(F.xxhash64(c), F.lit(1024)))) for c in ("user_id", "item_id")}
    for c, t in numbers.items():
        per = t.groupBy("__b").agg(F.max("__n").alias("m"))
        ahead = per.select("__b", F.coalesce(F.sum("m").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("a"))  # 1024 rows
        numbers[c] = materialised(t.join(F.broadcast(ahead), "__b").select(c, (F.col("a") + F.col("__n")).cast("int").alias(c[0])), "numbers")
        if dict(pairs.dtypes)[c] in ("int", "bigint") and numbers[c].count() <= BROADCAST:
            numbers[c] = F.broadcast(numbers[c])
    del t, per, ahead  # their files go with them
    counts = pairs.join(numbers["user_id"], "user_id").join(numbers["item_id"], "item_id").select("u", "i", "r")
    # a checkpoint each round: else the factors sent in all rounds stay on disk
    als = ALS(userCol="u", itemCol="i", ratingCol="r", implicitPrefs=True, rank=rank, maxIter=5, seed=seed, coldStartStrategy="drop", checkpointInterval=1)
    with swept(log.sparkSession):
        model = als.fit(counts)
    own = queries.select("user_id", "query_id").join(numbers["user_id"], "user_id").select("u", "query_id")
    users = model.userFactors.select(F.col("id").alias("query"), F.col("features").alias("vector")).join(own.select(F.col("u").alias("query")).distinct(), "query")
    found = greatest_products(model.itemFactors.select(F.col("id").alias("doc"), F.col("features").alias("vector")), users, k)
    recs = found.select(F.col("query").alias("u"), F.col("doc").alias("i"), F.col("score").cast("float").alias("score")).join(own, "u")
    return recs.join(numbers["item_id"], "i").select("query_id", "item_id", "score")


def item_vectors(log: DataFrame, scope: str, size: int = 32, window: int = 5, piece: int = 1000, seed: int = 0) -> DataFrame:
    """item_id (as text), vector: skip-gram vectors of items from the sequences of each scope, which are cut in pieces of
    `piece` events, so that no row holds a whole long one."""
    w = Window.partitionBy(scope).orderBy("ts", "line", "item_id")
    known = log.where(F.col(scope).isNotNull() & F.col("item_id").isNotNull()).withColumn("__k", F.row_number().over(w) - 1)
    lists = known.groupBy(scope, F.floor(F.col("__k") / piece).alias("__p")).agg(F.sort_array(F.collect_list(F.struct("__k", F.col("item_id").cast("string").alias("i")))).alias("x"))
    sentences = cut(lists.select(F.transform("x", lambda s: s["i"]).alias("words")))
    model = Word2Vec(vectorSize=size, windowSize=window, minCount=1, maxIter=1, numPartitions=sentences.rdd.getNumPartitions(), seed=seed, inputCol="words", outputCol="__o").fit(sentences)
    return model.getVectors().select(F.col("word").alias("item_id"), vector_to_array("vector").alias("vector"))


def vector_candidates(hist: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """query_id, item_id (as text), score: the k items of greatest cosine with the mean vector of a query's history."""
    vectors = cut(vectors)
    met = hist.select("query_id", F.col("item_id").cast("string").alias("item_id")).join(vectors, "item_id")
    parts = met.select("query_id", F.posexplode("vector").alias("i", "x")).groupBy("query_id", "i").agg(F.avg("x").alias("x"))
    mean = parts.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vector"))
    found = nearest(vectors.select(F.col("item_id").alias("doc"), "vector"), cut(mean.select(F.col("query_id").alias("query"), "vector")), k)
    return found.select(F.col("query").alias("query_id"), F.col("doc").alias("item_id"), "score")


def adversarial_auc(train: DataFrame, test: DataFrame, key: str, features: Sequence[str], folds: int = 3, model: str = "trees") -> float:
    """Out-of-fold auc of a classifier that tells test rows from train rows: 0.5 where they are alike."""
    both = domains(train.select(key, *features), test.select(key, *features))
    both = both.withColumn("fold", F.pmod(F.xxhash64(key, "domain"), F.lit(folds)).cast("int"))
    scored = cross_validated(both, key, features, "domain", "fold", folds, model)
    return ranking_quality(scored, "y", "p").first().auc
