"""Train, validation and test splits that keep related records together."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.session import cut, named_folder

BUCKETS = 1024
HOT_ROWS = 200_000
HOT_KEYS = 4096


def attached(rows: DataFrame, key: str, values: DataFrame, of: str, n_rows: int) -> DataFrame:
    """rows (n_rows of them) inner-joined with the one row of `values` whose column `of` equals their key. A key of
    more than HOT_ROWS rows and more than 1/HOT_KEYS of all is hot: there are at most HOT_KEYS of these, so their
    values are broadcast and their rows stay where they are; all others meet by an exchange. Where all rows are no
    more than HOT_ROWS no key can be hot, and nothing is counted."""
    joined = lambda r, v: r.join(v, F.col(key) == F.col(of)).drop(of)
    if n_rows <= HOT_ROWS:
        return joined(rows, values)
    least = max(HOT_ROWS, n_rows // HOT_KEYS)
    hot = cut(rows.groupBy(F.col(key).alias(of)).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > least).select(of))
    if hot.isEmpty():
        return joined(rows, values)
    few = F.broadcast(values.join(F.broadcast(hot), of, "left_semi"))
    rest = rows.join(F.broadcast(hot), F.col(key) == F.col(of), "left_anti")
    return joined(rows, few).unionByName(joined(rest, values))


def _contracted(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ends, forest) of the distinct links a < b of numbered vertices: ends has each linked vertex `v` and the
    `root` of its part, forest the links that were picked, both materialised.

    Boruvka: the weight of a link is (lesser end, greater end), so all differ. In each round every part picks its
    least link; a link that both its ends picked has the lesser end as the root of a tree of picked links, and the
    trees are contracted by pointer jumping. Of parallel links between two parts only the least stays.
    """
    forest, ends = None, None
    n = edges.count()
    edges = edges.select("a", "b", F.struct(F.col("a").alias("u"), F.col("b").alias("v")).alias("e"))
    while n:
        picks = edges.select(F.explode(F.array(F.struct("a", "b", "e"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "e"))).alias("x")).select("x.*")
        picks = picks.groupBy("a").agg(F.min(F.struct("e", "b")).alias("m")).select("a", F.col("m.b").alias("p"), F.col("m.e").alias("e"))
        # by picked link: one row, or two of the ends that picked each other, of which the lesser is the root
        both = picks.groupBy("e").agg(F.min(F.struct("a", "p")).alias("x"), F.max(F.struct("a", "p")).alias("y"))
        two = F.col("x.a") != F.col("y.a")
        child = F.when(two, F.col("y.a")).otherwise(F.col("x.a"))
        parent = F.when(two, F.col("x.a")).otherwise(F.col("x.p"))
        up = cut(both.select(child.alias("a"), parent.alias("p"), two.alias("root"), "e"))
        taken = up.select("e.u", "e.v")
        forest = taken if forest is None else forest.unionAll(taken)
        # roots point to themselves
        tree = cut(up.select(F.explode(F.when(F.col("root"), F.array(F.struct("a", "p"), F.struct(F.col("p").alias("a"), "p"))).otherwise(F.array(F.struct("a", "p")))).alias("x")).select("x.*"))
        size = tree.count()
        while True:
            above = tree.select(F.col("a").alias("__a"), F.col("p").alias("pp"))
            new = cut(attached(tree, "p", above, "__a", size).select("a", F.col("pp").alias("p"), (F.col("p") != F.col("pp")).alias("moved")))
            tree = new.select("a", "p")
            if new.where("moved").isEmpty():
                break
        of = tree.select(F.col("a").alias("__a"), F.col("p").alias("top"))
        if ends is None:
            ends = tree.select(F.col("a").alias("v"), F.col("p").alias("root"))
        else:
            # a part without a link outside keeps its root
            whole = of.unionAll(gone.select(F.col("root").alias("__a"), F.col("root").alias("top")))
            ends = cut(attached(ends, "root", whole, "__a", n_ends).select("v", F.col("top").alias("root")))
        n_ends = ends.count()
        moved = attached(attached(edges, "a", of, "__a", n).withColumnRenamed("top", "pa"), "b", of, "__a", n).withColumnRenamed("top", "pb")
        between = moved.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"), "e")
        edges = cut(between.groupBy("a", "b").agg(F.min("e").alias("e")))
        n = edges.count()
        if n:
            live = edges.select(F.explode(F.array("a", "b")).alias("root")).distinct()
            gone = cut(ends.select("root").distinct().join(live, "root", "left_anti"))
    return ends, forest


def spanning_forest(links: DataFrame, a: str, b: str, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(labels, forest) of the undirected graph of links: labels has `vertex` and its `root`, one for each
    connected part; forest has the links `u`, `v` of a spanning forest. Both are written under `path` (a new folder
    of the shared one where none is given), from where read_forest takes them; new links are added by uniting the
    forest with them, as it stands for all links before.

    Links with a null end and links of a vertex to itself give no link (the latter's vertex has no label unless
    it is linked elsewhere); repeated links count once; an empty table gives empty results. Ends of any one
    sortable type; a root is the least of its part's vertices.

    Method: Boruvka over numbered vertices, see _contracted. Parts at least halve in a round. Every step is an
    aggregation or an equi-join with its hot keys apart; nothing but counts comes to the driver.
    """
    spark = links.sparkSession
    ends = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.col(a).alias("a"), F.col(b).alias("b"))
    ends = cut(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    names = cut(ends.select(F.explode(F.array("a", "b")).alias("vertex")).distinct().select("vertex", F.monotonically_increasing_id().alias("v")))
    n = ends.count()
    edges = attached(attached(ends, "a", names.select(F.col("vertex").alias("__v"), F.col("v").alias("va")), "__v", n), "b", names.select(F.col("vertex").alias("__v"), F.col("v").alias("vb")), "__v", n)
    edges = cut(edges.select(F.least("va", "vb").alias("a"), F.greatest("va", "vb").alias("b")))
    labels, forest = _contracted(edges)
    path = path or named_folder(spark, "forest")
    if labels is None:
        labels, forest = names.selectExpr("v", "v AS root").limit(0), names.selectExpr("v AS u", "v").limit(0)
    own = cut(attached(labels, "v", names.select(F.col("v").alias("__v"), "vertex"), "__v", labels.count()))
    least = own.groupBy(F.col("root").alias("__r")).agg(F.min("vertex").alias("least"))
    named = attached(own, "root", least, "__r", own.count()).select("vertex", F.col("least").alias("root"), F.col("v").alias("number"))
    named.write.parquet(f"{path}/labels")
    forest.write.parquet(f"{path}/links")
    return read_forest(spark, path)


def read_forest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(labels, forest) that spanning_forest wrote under the path. Links lie there by the numbers of their ends, and
    take their names from the labels when they are read."""
    labels, links = spark.read.parquet(f"{path}/labels"), spark.read.parquet(f"{path}/links")
    for end in "uv":
        links = links.withColumnRenamed(end, "number").join(labels.select("number", F.col("vertex").alias(f"{end}_")), "number").drop("number")
    return labels.drop("number"), links.select(F.col("u_").alias("u"), F.col("v_").alias("v"))


def tied_records(links: DataFrame, record: str, key: str, path: str | None = None, alone: bool = True) -> DataFrame:
    """`record`, `root`: the connected part of every record that has a key, where an equal key ties records; the
    root is the least record of the part. Keys of different kinds must differ as texts. Null records and keys tie
    nothing; alone=False leaves out records tied to no other. The labels and the spanning forest (pairs of records)
    stay under `path`, see spanning_forest.

    A key is no vertex: each of its records is linked with the least one, so that a key of any size adds a star of
    one link a record.
    """
    own = cut(links.select(F.col(record).alias("record"), F.col(key).alias("key")).where("record IS NOT NULL AND key IS NOT NULL").distinct())
    n = own.count()
    least = own.groupBy(F.col("key").alias("__k")).agg(F.min("record").alias("lead"), F.max("record").alias("last"))
    least = cut(least.where("lead < last").select("__k", "lead"))
    pairs = attached(own, "key", least, "__k", n).where("record <> lead").select("lead", "record")
    labels, _ = spanning_forest(pairs, "lead", "record", path)
    tied = labels.withColumnRenamed("vertex", "record")
    if alone:
        single = own.select("record").distinct().join(labels.select(F.col("vertex").alias("record")), "record", "left_anti")
        tied = tied.unionAll(single.select("record", F.col("record").alias("root")))
    return tied.select(F.col("record").alias(record), "root")


def deal_splits(groups: DataFrame, root: str, size: str, shares: Mapping[str, float], seed: int = 0) -> DataFrame:
    """`root`, `split` of every group, so that the splits' sums of `size` come near the shares.

    Groups are stratified by size band (powers of two) and dealt systematically: in a band, in the order of a
    seeded hash, by a stride through quotas for each split. Bands get their quotas from the largest down, each
    making up for what the splits lack so far, so that the many small groups even out the few large ones. A
    null root or size is left out; roots must be distinct; a group is never divided, so that one group of more
    than a split's share makes the shares unreachable.
    """
    total = sum(shares.values())
    g = groups.select(F.col(root).alias("root"), F.col(size).cast("long").alias("size")).where("root IS NOT NULL AND size > 0")
    g = g.withColumns({"band": F.floor(F.log2("size")).cast("int"), "h": F.xxhash64("root", F.lit(seed))})
    g = g.withColumn("bucket", F.pmod("h", F.lit(BUCKETS)).cast("int"))
    per = cut(g.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s")))  # 64 x BUCKETS rows at most
    bands = per.groupBy("band").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy(F.col("band").desc()).collect()
    lack = {k: x / total * sum(r.s for r in bands) for k, x in shares.items()}
    plan = []
    for r in bands:
        want = {k: max(0.0, x) for k, x in lack.items()}
        exact = {k: r.n * x / (sum(want.values()) or 1) for k, x in want.items()}
        quota = {k: math.floor(x) for k, x in exact.items()}
        for k in sorted(exact, key=lambda k: quota[k] - exact[k])[: r.n - sum(quota.values())]:
            quota[k] += 1
        lack = {k: x - quota[k] * r.s / r.n for k, x in lack.items()}
        stride = next(x for x in range(max(1, round(r.n * 0.618)), r.n + 2) if math.gcd(x, r.n) == 1)
        end, ends = 0, []
        for k in shares:
            end += quota[k]
            ends.append((k, end))
        plan.append((r.band, r.n, stride, ends))
    spark = groups.sparkSession
    plan_df = spark.createDataFrame(plan, "band int, n_band long, stride long, ends array<struct<split: string, upto: long>>")
    w = Window.partitionBy("band").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = per.select("band", "bucket", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("ahead"))
    place = F.col("ahead") + F.row_number().over(Window.partitionBy("band", "bucket").orderBy("h", "root")) - 1
    dealt = g.join(F.broadcast(ahead), ["band", "bucket"]).withColumn("place", place).join(F.broadcast(plan_df), "band")
    at = (F.col("place").cast("decimal(20,0)") * F.col("stride") % F.col("n_band")).cast("long")
    split = dealt.withColumn("at", at).withColumn("split", F.expr("filter(ends, e -> at < e.upto)[0].split"))
    return split.select(F.col("root").alias(root), "split")
