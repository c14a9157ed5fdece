"""Mixing sources to target weights: Efraimidis-Spirakis sampling within each source.

Complete epochs take every document of a source; what is left of its target is filled in the order of exponential keys
-ln(u) / quality, up to the cut nearest to the target: u comes from a hash of the document and the seed, quality is the probability that
the n-gram classifier trained on the labelled rows gives the text. The order within a source is
never sorted as a whole: sizes are summed over nested ranges of the keys, and only the range that holds the cut is sorted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.llm import linear
from fathomline.llm.quality_rules import SAMPLE, fitted
from fathomline.llm.storage import staged
from fathomline.llm.text import lean, slices, words

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2.0
#: Ranges that a range of keys is cut into, twice.
RANGES = 4096
SEED = 17
#: Least quality weight, so that no document is out of reach.
LEAST_QUALITY = 0.05
#: Tables with a row for each source are broadcast up to so many rows.
FEW_SOURCES = 100_000


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> list[tuple[str | None, int, float]]:
    """(source, size, target): the budget dealt by weight; what exceeds `most` times a source is dealt anew to the others."""
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    cap = {s: most * n for s, n in order}
    left, open_, out = share * sum(n for _, n in order), dict.fromkeys(weight), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > cap[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            out[s] = cap[s]
            del open_[s]
        left -= sum(cap[s] for s in over)
    return [(s, n, out[s]) for s, n in order]


def sized(docs: DataFrame, labels: DataFrame, also: tuple[str, ...], seed: int) -> DataFrame:
    """doc_id, source, `also`, size (words), quality (probability of the classifier) and h (a hash for the key) of every row."""
    model = fitted(docs, labels, SAMPLE)

    @lean
    def measure(batches):
        for batch in batches:
            sizes, scores = [np.zeros(0, np.int64)], [np.zeros(0)]
            for _, _, data, at in slices(batch.column("text")):
                sizes.append(words(data, at).counts)
                scores.append(model.probability(linear.score(model.weights, model.bias, data, at)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "source", *also, "h")), pa.array(np.concatenate(sizes)), pa.array(np.maximum(np.concatenate(scores), LEAST_QUALITY))], ["doc_id", "source", *also, "h", "size", "quality"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", *also, F.xxhash64(F.col("doc_id"), "text", F.lit(seed)).alias("h"), "text")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.drop("text").schema)
    return given.mapInArrow(measure, f"{kinds}, size long, quality double")


def mix(docs: DataFrame, labels: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, `also`, size, source_size, target, quality and taken of every row of `docs` (doc_id, source, text, `also`).

    Null text has size 0 and is never taken; a null source is a source of its own, the last; a null id is one like any other. One row for each source goes to the
    driver: a mix names a weight for each, so they are few. Rows equal in id and text have the same key, are dealt with one by one, and are taken in order of doc_id and
    size. Texts of any length are read whole. Without labels of both classes all qualities are alike. An empty table gives no rows. Other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    u = (F.pmod("h", F.lit(1 << 52)) + 0.5) / float(1 << 52)
    keyed = sized(docs, labels, also, seed).withColumn("w", F.pow(u, 1 / F.col("quality"))).drop("h")
    unit = 1 - F.col("w")  # rises with the key -ln(u) / quality, and lies in [0, 1)
    fine = F.least(F.floor(F.greatest(unit, F.lit(0.0)) * RANGES * RANGES), F.lit(RANGES * RANGES - 1)).cast("long")
    rows = staged(keyed.withColumns({"range": F.floor(fine / RANGES), "part": fine % RANGES}), "sized")
    found = [(r.source, r.n) for r in rows.groupBy("source").agg(F.sum("size").alias("n")).collect()]
    plan = []
    for s, n, t in targets(found, weights, share, most):
        epochs = int(t // n) if n else 0
        plan.append((s, n, t, epochs, t - epochs * n))
    few = F.broadcast if len(plan) <= FEW_SOURCES else lambda table: table
    plan = spark.createDataFrame(plan, "s string, source_size long, target double, epochs long, rest double")

    def cut(level: DataFrame, by: str) -> DataFrame:
        """Of each source, the range that the cut lies in and the words before it; no row where all ranges lie before the cut."""
        sums = level.groupBy("source", by).agg(F.sum("size").alias("n"), F.first("rest").alias("rest"), F.first("base").alias("base"))
        run = F.sum("n").over(Window.partitionBy("source").orderBy(by))
        at = sums.select("source", by, "n", "rest", (F.col("base") + run).alias("to"))
        return at.where("to >= rest").groupBy("source").agg(F.min_by(F.struct(F.col(by).alias("at"), (F.col("to") - F.col("n")).alias("base")), by).alias("c")).select(F.col("source").alias("s"), "c.at", "c.base")

    own = lambda table, how="inner": (few(table), F.col("source").eqNullSafe(F.col("s")), how)
    planned = rows.join(*own(plan)).drop("s")
    # each of these has one row for each source, as `plan`
    outer = cut(planned.withColumn("base", F.lit(0).cast("long")), "range").select("s", F.col("at").alias("cut_range"), F.col("base").alias("range_base"))
    outer = spark.createDataFrame(outer.collect(), outer.schema)
    inside = planned.join(*own(outer)).drop("s").where("range = cut_range")
    inner = cut(inside.withColumn("base", F.col("range_base")), "part").select("s", F.col("at").alias("cut_part"), F.col("base").alias("part_base"))
    inner = spark.createDataFrame(inner.collect(), inner.schema)
    placed = planned.join(*own(outer, "left")).drop("s").join(*own(inner, "left")).drop("s")
    before = F.col("cut_range").isNull() | (F.col("range") < F.col("cut_range")) | ((F.col("range") == F.col("cut_range")) & F.coalesce(F.col("part") < F.col("cut_part"), F.lit(True)))
    here = (F.col("range") == F.col("cut_range")) & F.coalesce(F.col("part") == F.col("cut_part"), F.lit(False))
    columns = ["doc_id", "source", *also, "size", "source_size", "target", "quality"]
    sure = placed.where(~here).select(*columns, (F.col("size") * (F.col("epochs") + before.cast("long"))).alias("taken"))
    order = Window.partitionBy("source").orderBy(F.desc("w"), "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    to = F.col("part_base") + F.sum("size").over(order)
    # the document that the cut falls into is taken if that comes nearer to the target
    last = placed.where(here).withColumn("to", to).withColumn("more", (F.col("to") - F.col("size") / 2 <= F.col("rest")).cast("long"))
    return sure.unionByName(last.select(*columns, (F.col("size") * (F.col("epochs") + F.col("more"))).alias("taken")))


def mixed_documents(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of `docs`, all columns, as often as the mix takes them; rows equal in all columns as often as they are taken together. Rows without words are never taken; an empty table gives no rows."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(F.struct(*columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source"), F.col("text"), F.xxhash64(F.lit(1), *columns).alias("key_a"), F.xxhash64(F.lit(2), *columns).alias("key_b"))
    taken = mix(keyed.drop("row"), labels, also=("key_a", "key_b"), **how).where("taken > 0").groupBy("key_a", "key_b").agg(F.sum(F.col("taken") / F.col("size")).cast("int").alias("times"))
    distinct = keyed.select("key_a", "key_b", "row").dropDuplicates(["key_a", "key_b"])
    repeated = distinct.join(taken, ["key_a", "key_b"])
    return repeated.select("row", F.explode(F.sequence(F.lit(1), "times")).alias("time")).select("row.*")
