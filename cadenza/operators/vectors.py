"""Vectors as arrays: similarity, centroids, pairs, verdicts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructField, StructType

from cadenza.functions.kernels import as_matrix
from cadenza.operators import joins, rules
from cadenza.operators.components import HELD, Forest, components
from cadenza.operators.streamed import in_order
from cadenza.operators.tables import written


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))


def unit(v: Column) -> Column:
    """v over its length; as it is where that is nearly zero. The length is bound once, not taken anew for each element."""
    held = F.transform(F.array(F.struct(v.alias("v"), norm(v).alias("n"))), lambda s: F.transform(s["v"], lambda x: F.when(s["n"] > 1e-8, x / s["n"]).otherwise(x.cast("double"))))
    return F.get(held, F.lit(0))


def variance_ratio(a: Column, b: Column) -> Column:
    """Mean of smaller over larger, element by element."""
    ratios = F.zip_with(a, b, lambda x, y: F.least(x, y).cast("double") / (F.greatest(x, y).cast("double") + F.lit(1e-8)))
    return F.aggregate(ratios, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def centroids(df: DataFrame, keys: list[str], vector: str, out: str = "centroid") -> DataFrame:
    """The mean vector of each key: partial sums by position, then one array."""
    mean = df.select(*keys, F.posexplode(vector).alias("_i", "_x")).groupBy(*keys, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    return mean.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias(out))


#: Vectors of a side of a block: two of them are in a task's memory at once. A vector is copied once for each block of its key.
BLOCK = 4000
#: Products that a task makes, and passes on the pairs of, at once.
PRODUCTS = 500_000
#: Centres up to this are sent to every task, their size is checked; more meet the points in blocks.
MAX_SENT_CENTRES = 10_000


def _unit_rows(vectors: list | np.ndarray) -> np.ndarray:
    x = np.array(vectors, float)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.where(n > 1e-8, x / np.maximum(n, 1e-300), x)


def similar_pairs(df: DataFrame, key: str, id_col: str, vector: str, least: float) -> DataFrame:
    """key, a, b (a < b), similarity of the pairs of one key whose cosine is at least ``least``.

    A key's vectors are dealt into blocks of about BLOCK by a hash of the id; each two blocks of a key are
    one matrix product. A large key is many groups of bounded size, not one. ids are unique in a key. A null
    key is a key, a null id is before all others; keys and ids may be of any type that has an order; rows
    without a vector are in no pair.
    """
    held = df.where(F.col(vector).isNotNull())
    # floats stay floats until they are in a task: half the bytes
    kind = "array<float>" if df.schema[vector].dataType == ArrayType(FloatType(), df.schema[vector].dataType.containsNull) else "array<double>"
    sizes = held.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_blocks"))
    dealt = joins.null_safe(held.select(key, id_col, F.col(vector).cast(kind).alias("_v")), sizes, [key]).withColumn("_own", F.pmod(F.xxhash64(id_col), F.col("_blocks")))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))
    copies = dealt.select(key, id_col, "_v", "_own", every.alias("_met"))
    copies = copies.select(key, id_col, "_v", "_own", F.least("_own", "_met").alias("_x"), F.greatest("_own", "_met").alias("_y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(list(batches)).combine_chunks()
        names, ids, vectors = (group[c].combine_chunks() for c in (key, id_col, "_v"))
        own, x, y, values = group["_own"].to_numpy(), group["_x"][0].as_py(), group["_y"][0].as_py(), ids.to_pylist()
        one, two = np.flatnonzero(own == x), np.flatnonzero(own == y)
        place = np.empty(len(values), np.int64)
        place[sorted(range(len(values)), key=lambda n: (values[n] is not None, values[n] or 0 if values[n] is None else values[n]))] = np.arange(len(values))
        left, right = (_unit_rows(as_matrix(vectors.take(pa.array(side)))) for side in (one, two))
        step = max(1, PRODUCTS // max(1, len(two)))
        for start in range(0, len(one) if len(two) else 0, step):
            products = left[start : start + step] @ right.T
            i, j = np.nonzero(products >= least)
            keep = i + start < j if x == y else np.ones(len(i), bool)
            i, j = i[keep], j[keep]
            similarity, i, j = products[i, j], one[i + start], two[j]
            first, second = pa.array(np.where(place[i] < place[j], i, j)), pa.array(np.where(place[i] < place[j], j, i))
            yield pa.RecordBatch.from_arrays([names.take(first), ids.take(first), ids.take(second), pa.array(similarity)], names=[key, "a", "b", "similarity"])

    fields = [StructField(n, df.schema[c].dataType, True) for n, c in ((key, key), ("a", id_col), ("b", id_col))]
    return copies.groupBy(key, "_x", "_y").applyInArrow(run, StructType([*fields, StructField("similarity", DoubleType())]))


def nearest(points: DataFrame, centres: DataFrame, point_id: str, vector: str, centre_id: str, centre: str, least: float) -> DataFrame:
    """point_id, the most similar centre and its similarity, where that is at least ``least``; ties go to the smaller id.

    Centres are counted first: a few are sent to every task, more meet the points block by block. Points and
    centres without a vector meet nothing; ids pass through untouched, ties between null and other ids go to null.
    """
    points, centres = points.where(F.col(vector).isNotNull()), centres.where(F.col(centre).isNotNull())
    if centres.count() <= MAX_SENT_CENTRES:
        sent = centres.select(centre_id, F.col(centre).cast("array<double>").alias(centre)).orderBy(centre_id).toArrow()
        names, matrix = sent[centre_id].combine_chunks(), _unit_rows(sent[centre].to_pylist()) if len(sent) else np.zeros((0, 1))

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows and len(names):
                    products = _unit_rows(batch.column(1).to_pylist()) @ matrix.T
                    at = products.argmax(1)
                    yield pa.RecordBatch.from_arrays([batch.column(0), names.take(pa.array(at)), pa.array(products[np.arange(len(at)), at])], names=[point_id, centre_id, "similarity"])

        fields = [StructField(point_id, points.schema[point_id].dataType), StructField(centre_id, centres.schema[centre_id].dataType), StructField("similarity", DoubleType())]
        met = points.select(point_id, F.col(vector).cast("array<double>")).mapInArrow(best, StructType(fields))
        return met.where(F.col("similarity") >= least)
    slices, blocks = (F.lit(max(1, -(-df.count() // BLOCK))).cast("long") for df in (points, centres))
    one = points.select(F.col(point_id).alias("p"), F.col(vector).alias("v"), F.pmod(F.xxhash64(point_id), slices).alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("y"))
    two = centres.select(F.col(centre_id).alias("c"), F.col(centre).alias("w"), F.pmod(F.xxhash64(centre_id), blocks).alias("y"), F.explode(F.sequence(F.lit(0).cast("long"), slices - 1)).alias("x"))

    def product(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("c")
        if not len(a) or not len(b):
            return pd.DataFrame({"p": [], "c": [], "s": []})
        products = _unit_rows(list(a["v"])) @ _unit_rows(list(b["w"])).T
        at = products.argmax(1)
        return pd.DataFrame({"p": a["p"].to_numpy(), "c": b["c"].to_numpy()[at], "s": products[np.arange(len(at)), at]})

    met = one.groupBy("x", "y").cogroup(two.groupBy("x", "y")).applyInPandas(product, f"p {points.schema[point_id].dataType.simpleString()}, c {centres.schema[centre_id].dataType.simpleString()}, s double")
    found = met.groupBy("p").agg(F.max("s").alias("similarity"), F.min(F.struct((-F.col("s")).alias("n"), "c")).alias("m"))
    return found.select(F.col("p").alias(point_id), F.col("m.c").alias(centre_id), "similarity").where(F.col("similarity") >= least)


def verified(tests: DataFrame, enrolled: DataFrame, name: str, f0: str = "f0_vec", variance: str = "var_vec") -> DataFrame:
    """name, similarity, sim_f0, sim_var, confidence, verdict, note of each test against the enrolled voice (two-stream verifier).

    enrolled: chunks of one voice. Its pitch centroid is the mean of chunks with a pitch, each of length 1;
    its variances are the mean of chunks that have one over 1 (all ones if there are none). Without a
    chunk with a pitch this fails: nobody is enrolled.
    """
    pitch = centroids(enrolled.where(norm(F.col(f0)) > 1e-8).select(F.lit(1).alias("k"), unit(F.col(f0)).alias("v")), ["k"], "v", "c").select(unit(F.col("c")).alias("pitch"))
    spread = centroids(enrolled.where(F.exists(variance, lambda x: x > 1.0)).select(F.lit(1).alias("k"), F.col(variance).alias("v")), ["k"], "v", "c").select(F.col("c").alias("spread"))
    held, other = pitch.first(), spread.first()  # one row each
    if held is None:
        raise ValueError("nobody is enrolled: no chunk has a pitch")
    voice = F.lit([float(x) for x in held["pitch"]])
    varied = F.lit([float(x) for x in other["spread"]] if other else [1.0] * 10)
    scored = tests.select(name, dot(voice, unit(F.col(f0))).alias("_f0"), variance_ratio(varied, F.col(variance)).alias("_var"))
    fused = 0.65 * F.greatest(F.lit(0.0), F.col("_f0")) + 0.35 * F.col("_var")
    scored = scored.withColumn("_fused", fused)
    return scored.select(
        name, F.bround("_fused", 4).alias("similarity"), F.bround("_f0", 4).alias("sim_f0"), F.bround("_var", 4).alias("sim_var"), rules.verdict_confidence(F.col("_fused")).alias("confidence"), verdict(F.col("_fused")).alias("verdict"), rules.verdict_note(F.col("_fused"), F.col("_f0"), F.col("_var")).alias("note")
    )


def verdict(score: Column) -> Column:
    """MATCH, LIKELY, UNCERTAIN or MISMATCH by the bands of a fused score."""
    return F.when(score >= 0.72, "MATCH").when(score >= 0.55, "LIKELY").when(score >= 0.35, "UNCERTAIN").otherwise("MISMATCH")


def track_online(df: DataFrame, keys: list[str], order: list[str], vector: str, threshold: float) -> DataFrame:
    """keys, order, cluster: each vector joins the most similar cluster or starts one; a cluster's centre is its running mean, renormalised.

    A key's vectors are streamed in order: only the centres are in memory. A row without a vector joins none
    and has a null cluster; null keys are keys, whatever their types.
    """

    def fresh() -> Callable:
        centres: list[np.ndarray] = []
        counts: list[int] = []

        def push(given: list | None) -> tuple:
            if given is None:
                return (None,)
            v = np.asarray(given, float)
            v = v / max(np.linalg.norm(v), 1e-8)
            similar = np.array(centres) @ v if centres else np.zeros(0)
            best = int(similar.argmax()) if len(similar) else -1
            if best >= 0 and similar[best] >= threshold:
                mean = (centres[best] * counts[best] + v) / (counts[best] + 1)
                centres[best], counts[best] = mean / max(np.linalg.norm(mean), 1e-8), counts[best] + 1
            else:
                centres.append(v)
                counts.append(1)
                best = len(centres) - 1
            return (best,)

        return push

    return in_order(df, keys, order, [vector], {"cluster": "long"}, fresh)


def pair_regime(mfcc: Column, f0_a: Column, f0_b: Column, flat_a: Column, flat_b: Column) -> tuple[Column, Column]:
    """(similarity, threshold) of two segments: whispered, high-pitched or ordinary."""
    near_f0 = F.when((f0_a > 0) & (f0_b > 0), 1 - F.least(F.abs(f0_a - f0_b) / 340, F.lit(1.0))).otherwise(mfcc)
    low_flat = F.least(flat_a, flat_b)
    flat = 1 - F.least(F.abs(flat_a - flat_b), F.lit(1.0))
    whisper = (low_flat > 0.125) & (low_flat < 0.30)
    high = (f0_a > 155) & (f0_b > 155) & (mfcc > 0.92)
    similarity = F.when(whisper, 0.5 * mfcc + 0.3 * near_f0 + 0.2 * flat).when(high, 0.82 * mfcc + 0.18 * near_f0).otherwise(0.6 * mfcc + 0.4 * near_f0)
    return similarity, F.when(whisper, F.lit(0.81)).otherwise(F.lit(0.92))


#: Pairs of clusters that a task's heap holds at once: some 150 MB.
HEAP = 200_000


def agglomerate(pairs: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """key, node, cluster: merges the two clusters whose best pair exceeds its threshold most, until none does; numbers are in order of the clusters' first nodes.

    pairs: key, a, b, similarity, threshold (a < b); nodes: key, node. A cluster pair's best one has the largest
    similarity, of equal ones the smallest threshold. Nodes in no pair are clusters; null keys are keys; pairs
    without a similarity or threshold count as none.

    Where all pairs of a key that reach their thresholds are more similar than all that don't (so it is with one
    threshold), no pair hides another one and clusters are connected components: pairs are read once, and a task
    passes on one edge for each of its nodes. Only the other keys' pairs are written, and merged by _merges.
    """
    kinds = {"_k": nodes.schema[key].dataType, "a": nodes.schema["node"].dataType, "b": nodes.schema["node"].dataType}
    whole = pairs.where("similarity is not null and threshold is not null and not isnan(similarity) and not isnan(threshold)").withColumnRenamed(key, "_k")
    whole = whole.select(*[F.col(c).cast(kind).alias(c) for c, kind in kinds.items()], F.col("similarity").cast("double").alias("similarity"), F.col("threshold").cast("double").alias("threshold"))
    key_of = lambda k: F.xxhash64(F.coalesce(F.col(k).cast("string"), F.lit("")), F.col(k).isNull())
    name = lambda k, node: F.xxhash64(F.coalesce(F.col(k).cast("string"), F.lit("")), F.col(k).isNull(), F.col(node))
    numbered = whole.select("*", key_of("_k").alias("_key"), name("_k", "a").alias("_a"), name("_k", "b").alias("_b"))

    seen = written(_forests(numbered))
    mixed = seen.where("a is null").groupBy("_key").agg(F.min("low").alias("_low"), F.max("high").alias("_high")).where("_low <= _high").select("_key")
    edges = seen.where("a is not null").select("_key", "a", "b")
    if mixed.isEmpty():
        joined = edges.select("a", "b")
    else:
        mixed = written(mixed)
        joined = edges.join(mixed, "_key", "left_anti").select("a", "b").unionByName(_merges(written(numbered.join(mixed, "_key", "left_semi"))))
    roots = components(joined).select(F.col("node").alias("_node"), "root")
    placed = nodes.select(key, "node", name(key, "node").alias("_node")).join(roots, "_node", "left").withColumn("root", F.coalesce("root", "_node"))
    placed = written(placed)
    firsts = placed.groupBy(key, "root").agg(F.min("node").alias("_first"))
    numbers = firsts.select(key, "root", (F.row_number().over(Window.partitionBy(key).orderBy("_first")) - 1).cast("long").alias("cluster"))
    return joins.null_safe(placed, numbers, [key, "root"]).select(key, "node", "cluster")


def _forests(numbered: DataFrame) -> DataFrame:
    """Of what a task reads: _key, a, b of edges that connect what its pairs at their thresholds do, and for each key the least similarity of these (low) and the largest of the others (high), without a and b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, forests, bounds = ["_key", "a", "b", "low", "high"], {}, {}

        def passed() -> Iterator[pa.RecordBatch]:
            for k, forest in forests.items():
                a, b = forest.passed()
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(a), pa.int64()), a, b, *[pa.nulls(len(a), pa.float64())] * 2], names=names)
            forests.clear()

        for batch in batches:
            keys, a, b, s, t = (batch.column(c).to_numpy() for c in range(5))
            good = s >= t
            for k in np.unique(keys).tolist():
                own = keys == k
                low, high = bounds.get(k, (np.inf, -np.inf))
                bounds[k] = s[own & good].min(initial=low), s[own & ~good].max(initial=high)
                forests.setdefault(k, Forest()).add(a[own & good], b[own & good])
            if sum(len(forest.up) for forest in forests.values()) > HELD:
                yield from passed()
        yield from passed()
        none = pa.nulls(len(bounds), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(list(bounds), pa.int64()), none, none, *[pa.array([v[n] for v in bounds.values()], pa.float64()) for n in (0, 1)]], names=names)

    return numbered.select("_key", "_a", "_b", "similarity", "threshold").mapInArrow(run, "_key long, a long, b long, low double, high double")


def _merges(numbered: DataFrame) -> DataFrame:
    """a, b: which nodes' clusters are merged, of pairs (a, b, their numbers _a and _b, similarity, threshold).

    No merge joins what pairs at their thresholds don't connect: pairs within such a component are its own. Where
    none hides another the component is a cluster; one of at most HEAP pairs is a task's, which merges by a heap.
    In a larger one, a merged cluster is never nearer to a third one than the nearer of its two parts, so two clusters that are each
    other's nearest, and have no second one as near, merge whatever the others do; all such pairs merge in a round, and
    so does each component's next pair. Rounds go on until what is left is small; no task holds more.
    """
    roots = components(numbered.where("similarity >= threshold").select(F.col("_a").alias("a"), F.col("_b").alias("b")))
    root_of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    met = numbered.join(root_of("_a"), "_a", "left").join(root_of("_b"), "_b", "left").withColumn("_root", F.coalesce("_a_root", "_a"))
    met = met.where(F.col("_root") == F.coalesce("_b_root", "_b")).select("_root", F.struct(F.col("a").alias("node"), F.col("_a").alias("number")).alias("x"), F.struct(F.col("b").alias("node"), F.col("_b").alias("number")).alias("y"), "similarity", "threshold")
    best = lambda df: df.groupBy("_root", "x", "y").agg(F.max(F.struct("similarity", (-F.col("threshold")).alias("t"))).alias("_s")).select("_root", "x", "y", F.col("_s.similarity").alias("similarity"), (-F.col("_s.t")).alias("threshold"))
    pair = lambda x, y: (F.col(f"{x}.number").alias("a"), F.col(f"{y}.number").alias("b"))
    now, found = written(best(met)), []
    while True:
        good = F.col("similarity") >= F.col("threshold")
        sizes = written(now.groupBy("_root").agg(F.count(F.lit(1)).alias("_n"), F.min(F.when(good, F.col("similarity"))).alias("_low"), F.max(F.when(~good, F.col("similarity"))).alias("_high")).where("_low is not null").withColumn("_plain", F.expr("_high is null or _low > _high")))
        now = now.join(sizes, "_root")
        found.append(now.where(good & F.col("_plain")).select(*pair("x", "y")))
        found.append(now.where(~F.col("_plain") & (F.col("_n") <= HEAP)).select("_root", "x", "y", "similarity", "threshold").groupBy("_root").applyInPandas(_heap, "a long, b long"))
        large = now.where(~F.col("_plain") & (F.col("_n") > HEAP)).select("_root", "x", "y", "similarity", "threshold")
        if sizes.where(~F.col("_plain") & (F.col("_n") > HEAP)).isEmpty():
            break
        near = large.where(good).withColumn("m", F.col("threshold") - F.col("similarity"))
        ends = near.select("_root", "x", "y", "m", F.explode(F.array("x", "y")).alias("own"))
        tops = ends.groupBy("_root", "own", "m").agg(F.min(F.struct("x", "y")).alias("p"), F.count(F.lit(1)).alias("n")).groupBy("_root", "own").agg(F.min(F.struct("m", "p", "n")).alias("top"))
        mutual = tops.where("top.n = 1").groupBy("_root", "top.p").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("_root", "p.x", "p.y")
        following = near.groupBy("_root").agg(F.min(F.struct("m", "x", "y")).alias("p")).select("_root", "p.x", "p.y")
        merged = written(mutual.unionByName(following).distinct())
        found.append(merged.select(*pair("x", "y")))
        into = lambda c: merged.select("_root", F.col("y").alias(c), F.col("x").alias(f"{c}_into"))
        moved = large.join(into("x"), ["_root", "x"], "left").join(into("y"), ["_root", "y"], "left")
        moved = moved.select("_root", F.coalesce("x_into", "x").alias("one"), F.coalesce("y_into", "y").alias("two"), "similarity", "threshold").where("one <> two")
        now = written(best(moved.select("_root", F.least("one", "two").alias("x"), F.greatest("one", "two").alias("y"), "similarity", "threshold")))
    every = found[0]
    for df in found[1:]:
        every = every.unionByName(df)
    return every


def _heap(pairs_pdf: pd.DataFrame) -> pd.DataFrame:
    """a, b: numbers of nodes whose clusters are merged, of pairs x, y (node, number) of one component; a merge costs time in proportion to the smaller row of neighbours."""
    ends = [[(p["node"], p["number"]) for p in pairs_pdf[c]] for c in ("x", "y")]
    order = sorted({*ends[0], *ends[1]})
    number = {n: i for i, n in enumerate(order)}
    near: list[dict[int, tuple[float, float]]] = [{} for _ in order]
    for a, b, s, t in zip(*ends, pairs_pdf["similarity"], pairs_pdf["threshold"]):
        i, j = number[a], number[b]
        near[i][j] = near[j][i] = (s, t)
    heap = [(t - s, i, j, s) for i, row in enumerate(near) for j, (s, t) in row.items() if i < j and s >= t]
    heapify(heap)
    gone, merged = [False] * len(order), []
    while heap:
        d, i, j, s = heappop(heap)
        held = near[i].get(j)
        if gone[i] or gone[j] or held is None or held[0] != s or held[1] - held[0] != d:
            continue  # one of them is no more, or they have a better pair by now
        gone[j] = True
        merged.append((order[i][1], order[j][1]))
        del near[i][j]
        for other, (s, t) in near[j].items():
            if other == i:
                continue
            del near[other][j]
            if other not in near[i] or (s, -t) > (near[i][other][0], -near[i][other][1]):
                near[i][other] = near[other][i] = (s, t)
            s, t = near[i][other]
            if s >= t:
                heappush(heap, (t - s, min(i, other), max(i, other), s))
        near[j] = {}
    return pd.DataFrame(merged, columns=["a", "b"]).astype("int64")
