"""Document fingerprints: bottom-k sketches of word shingle hashes, in DataFrame functions only.

A sketch is the k least distinct hashes of a text's WIDTH-word shingles, with their number when there are fewer. Sketches of
parts merge into the sketch of the whole; they estimate resemblance, containment and the number of distinct shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.llm.storage import staged

K, WIDTH = 64, 5
SPACE = r"[\x20\x09-\x0D]+"


def shingle_hashes(text: Column, width: int = WIDTH) -> Column:
    """Distinct hashes of `width` consecutive words; of a shorter text, one of all its words; of no words, none."""
    hashed = F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != ""), lambda w: F.xxhash64(w))

    def runs(h: Column) -> Column:
        # the places past the last word add nothing to a hash, so a short text has the hash of all its words
        every = F.transform(h, lambda w, i: F.xxhash64(w, *(F.get(h, i + j) for j in range(1, width))))
        return F.slice(every, F.lit(1), F.greatest(F.size(h) - width + 1, F.lit(1)))

    # one-element arrays bind a value to a name: each step is computed once for a text, not once for each word
    return F.array_distinct(F.element_at(F.transform(F.array(hashed), runs), 1))


def sketch(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(hashes), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both parts together."""
    return sketch(F.array_union(a, b), k)


def merge_all(sketches: Column, k: int = K) -> Column:
    """Aggregate: the sketch of a group's parts together."""
    return sketch(F.array_distinct(F.flatten(F.collect_list(sketches))), k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated intersection / union: the share of the union's k least hashes that both have. Two empty ones are alike."""

    def share(both: Column) -> Column:
        return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(both, F.array_intersect(a, b))) / F.size(both))

    return F.element_at(F.transform(F.array(merge(a, b, k)), share), 1)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else (k - 1) / the k-th hash's place in [0, 1)."""
    place = F.element_at(a, -1) / F.lit(2.0**64) + 0.5
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / place)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has."""
    union = distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * union / distinct_shingles(a, k)))


def written(a: Column) -> Column:
    return F.concat_ws("", F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")))


def successors(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, n, r, succ_r): each distinct row's rank by descending doc_id and the next one's.

    Ids alone are sorted, over a range partitioning; ranks are a partition's offset plus the place in it, so no task sees all.
    """
    ids = docs.select("doc_id", "mark", "n").distinct()
    ordered = ids.repartitionByRange(F.desc_nulls_last("doc_id")).sortWithinPartitions(F.desc_nulls_last("doc_id"), "mark")
    placed = staged(ordered.withColumn("at", F.monotonically_increasing_id()), "order")
    part = F.shiftright("at", 33)
    counts = sorted((r.p, r.c) for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("c")).collect())
    rows, total = [], 0
    for p, c in counts:
        rows.append((p, total))
        total += c
    offsets = docs.sparkSession.createDataFrame(rows, "p long, base long")  # a row for each partition
    ranked = placed.join(F.broadcast(offsets), part == F.col("p"))
    rank = F.col("base") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return ranked.select("doc_id", "mark", "n", rank.alias("r")).withColumn("succ_r", (F.col("r") + 1) % F.lit(max(total, 1)))


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of every text and of its edited text, which ends in the start of the next document's (by descending doc_id).

    Null texts count as empty; null ids come last. Rows equal in id and text hold one place in the order, and each
    returns that place's values; next_id is the next document's id. A table of one document is its own next. An empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumns({"mark": F.xxhash64("text"), "n": F.length("text").cast("long")})
    order = staged(successors(marked), "ranks").withColumn("id", F.coalesce("doc_id", F.lit(-(1 << 63))))
    # what a document needs to know: of whom it is the next, and with how many characters
    asked = order.select(F.col("succ_r").alias("r"), F.col("id").alias("asker"), F.col("mark").alias("asker_mark"), F.floor(F.col("n") / 3).alias("wanted"))
    links = order.join(asked, "r").select("id", "mark", "asker", "asker_mark", "wanted")
    rows = marked.withColumn("sketch", sketch(shingle_hashes(F.col("text")), k)).withColumn("id", F.coalesce("doc_id", F.lit(-(1 << 63))))
    # both uses below need the same columns, and go on by the same keys: the texts are shuffled once
    linked = rows.join(links, ["id", "mark"])
    heads = linked.select(F.col("asker").alias("id"), F.col("asker_mark").alias("mark"), F.expr("left(text, cast(least(wanted, n) as int))").alias("head"), F.col("sketch").alias("next_sketch"), F.col("doc_id").alias("next_id"))
    heads = heads.groupBy("id", "mark").agg(F.first("head").alias("head"), F.first("next_sketch").alias("next_sketch"), F.first("next_id").alias("next_id"))
    both = linked.select("doc_id", "text", "n", "sketch", "id", "mark").join(heads, ["id", "mark"])
    edited = both.withColumn("edited", F.concat(F.expr("left(text, cast(n - floor(n / 3) as int))"), "head")).withColumn("edited_sketch", sketch(shingle_hashes(F.col("edited")), k))
    return edited.select("doc_id", F.col("n").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), written(F.col("sketch")).alias("fingerprint"), written(F.col("edited_sketch")).alias("edited_fingerprint"), resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"), resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"), "next_id")
