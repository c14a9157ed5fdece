"""MinHash near-duplicates: b-bit signatures, band candidates, exact confirmation on the full shingle sets.

Documents with the same set are one class. Of each class's first document, a signature of PERMUTATIONS minima gives band
keys; of the minima themselves only the low BITS are kept, packed. Candidates share a band key; those whose estimated
similarity (bit counts, corrected for chance matches) lies far below the threshold are dropped, the rest are confirmed on the sets.

Within a band bucket no pairs are listed wholesale: documents that are already linked through others need no comparison.
In each of PIVOTS rounds all members of a bucket that are not yet joined with its pivot are compared with it. The first pivot of a bucket is the
member whose own buckets are the fullest: what copies were made from, which all of a group's buckets then share. Later ones are drawn.
The members of buckets that then still hold several parts meet by an exact prefix filter: with all shingles in one order, the rarest among these sets
first, two sets that are similar enough share one of their first few, so near where both begin that enough can follow. Sets below the threshold, which differ by
shingles that few others have, hardly ever meet there, however many share a bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm.storage import discard, staged
from fathomline.llm.text import U, lean, mix, shingles, slices, words

#: 40 bands of 5 rows: two sets of similarity 0.8 share no band with probability (1 - 0.8^5)^40 = 1.3e-7.
BANDS, ROWS = 40, 5
PERMUTATIONS, BITS = BANDS * ROWS, 2
#: Estimates this far below the threshold are dropped: over six standard deviations of the estimate at 0.8.
SLACK = 0.25
PIVOTS = 2
#: Links that one task joins at once; of more, rounds of large and small stars are made, to the same end. Every round's shuffles take threads of the driver.
TASK_LINKS = 200_000
#: Permutations are of 32-bit numbers, which processors multiply several at once.
_rng = np.random.Generator(np.random.PCG64(5))
MULTIPLY = _rng.integers(1, 1 << 30, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
ADD = _rng.integers(1, 1 << 31, PERMUTATIONS, dtype=np.uint32)
SETS = "doc_id long, n_shingles long, set_hash binary"


def shingle_sets(data: np.ndarray, at: np.ndarray, width: int) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, sorted; with fewer words than `width`, the whole sequence is the one shingle."""
    w = words(data, at, lower=True)
    h, doc = shingles(w, width)
    ends = np.searchsorted(doc, np.arange(len(at)))
    out = []
    for i in range(len(at) - 1):
        own = np.unique(h[ends[i] : ends[i + 1]])
        if not len(own) and w.counts[i]:
            total = U(int(w.counts[i]))
            for x in w.hash[w.first[i] : w.first[i + 1]]:
                total = mix(np.array([total], U) * U(0x9FB21C651E98DF25) + x)[0]
            own = np.array([total], U)
        out.append(own)
    return out


def set_hash(own: np.ndarray) -> bytes:
    """128 bits of the set: two sums of mixed members."""
    return np.array([mix(own).sum(dtype=U), mix(own ^ U(0xA5A5A5A5A5A5A5A5)).sum(dtype=U) + U(len(own))], U).tobytes()


def minima(own: np.ndarray) -> np.ndarray:
    """The set's least value under each permutation, in blocks of members."""
    least = np.full(PERMUTATIONS, np.iinfo(np.uint32).max, np.uint32)
    low = own.astype(np.uint32)
    room = np.empty((min(len(own), 256), PERMUTATIONS), np.uint32)
    for i in range(0, len(own), 256):
        part = low[i : i + 256, None]
        v = np.multiply(part, MULTIPLY, out=room[: len(part)])
        v += ADD
        np.minimum(least, v.min(0), out=least)
    return least.astype(U)


def packed(least: np.ndarray) -> np.ndarray:
    """The low BITS of each minimum, packed into 64-bit numbers (zeros at the end)."""
    low = (mix(least) & U((1 << BITS) - 1)).astype(np.uint8)
    packed_bytes = np.packbits(((low[:, None] >> np.arange(BITS, dtype=np.uint8)) & 1).reshape(-1))
    return np.pad(packed_bytes, (0, -len(packed_bytes) % 8)).view(np.int64)


def band_keys(least: np.ndarray) -> np.ndarray:
    key = np.arange(BANDS, dtype=U)
    for r in range(ROWS):
        key = mix(key * U(0x9E3779B97F4A7C15) + least.reshape(BANDS, ROWS)[:, r])
    return key.view(np.int64)


#: The first bit of each minimum's pair, in all of a 64-bit number.
FIRST_BITS = 0x5555555555555555


def corrected(unequal):
    """Similarity from the number of minima whose low bits differ, corrected for those that agree in them by chance."""
    chance = 0.5**BITS
    return (1 - unequal / PERMUTATIONS - chance) / (1 - chance)


def estimate(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two packed signatures, by bit counts."""
    x = (a ^ b).view(U)
    return corrected(int(np.bitwise_count((x | x >> U(1)) & U(FIRST_BITS)).sum()))


def estimate_column(a: Column, b: Column) -> Column:
    """estimate() of two columns of packed signatures."""
    unequal = F.lit(0)
    for i in range(-(-PERMUTATIONS * BITS // 64)):
        x = a[i].bitwiseXOR(b[i])
        unequal += F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(FIRST_BITS)))
    return corrected(unequal)


def near_duplicates(docs: DataFrame, width: int = 4, percent: int = 80, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of `docs` (doc_id, text).

    Links: 100 * intersection >= percent * union of the shingle sets. Null or empty texts have an empty set and are their own
    component. Repeated rows are nodes of their own, linked by their equal sets. A null doc_id takes part like any other; it comes first, so its component has a null id. An empty table gives no rows.
    With `also`, these columns of `docs` too, and label, which tells apart components whose ids are equal (null: no words).
    """
    @lean
    def sign(batches):
        for batch in batches:
            for first, end, data, at in slices(batch.column("text")):
                sets = shingle_sets(data, at, width)
                least = [minima(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, end - first).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_hash(s) if len(s) else None for s in sets], pa.binary()), pa.array([None if m is None else packed(m).tolist() for m in least], pa.list_(pa.int64())), pa.array([None if m is None else band_keys(m).tolist() for m in least], pa.list_(pa.int64())), *(batch.column(c).slice(first, end - first) for c in ("text_hash", *also))], ["doc_id", "n_shingles", "set_hash", "signature", "bands", "text_hash", *also])

    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"), *also)
    signed = staged(hashed.mapInArrow(sign, ", ".join([f"{SETS}, signature array<long>, bands array<long>, text_hash long", *(f"{c} {docs.schema[c].dataType.simpleString()}" for c in also)])), "signed")
    ids = F.coalesce("doc_id", F.lit(-(1 << 63)))
    classes = signed.where("n_shingles > 0").groupBy("set_hash").agg(F.min(ids).alias("node"), F.min_by(F.struct("signature", "bands", "text_hash"), ids).alias("s"), F.max("n_shingles").alias("n"))
    nodes = staged(classes.select("node", "set_hash", "n", "s.signature", "s.bands", "s.text_hash"), "nodes")
    # a node is one set
    banded = nodes.select("set_hash", F.posexplode("bands").alias("band", "key"))
    full = banded.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    members = staged(banded.join(full, "key").select("key", "set_hash", "c"), "members")
    links = confirmed_components(docs, nodes, members, width, percent)
    labelled = signed.select("doc_id", "n_shingles", "set_hash", *also).join(links, "set_hash", "left")
    by_label = labelled.where("label IS NOT NULL").groupBy("label").agg(F.min(ids).alias("low"))
    named = labelled.join(by_label, "label", "left")
    component = F.when(F.col("n_shingles") == 0, ids).otherwise(F.col("low"))
    component = F.when(component == -(1 << 63), F.lit(None).cast("long")).otherwise(component)
    return named.select("doc_id", "n_shingles", component.alias("component_id"), *also, *(["label"] if also else [])).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def confirmed_components(docs: DataFrame, nodes: DataFrame, members: DataFrame, width: int, percent: int) -> DataFrame:
    """(set_hash, label) of all nodes that share a bucket, label being one of the component's set hashes; others have their own."""
    labels = nodes.select("set_hash", F.col("set_hash").alias("label"))
    if not members.take(1):
        return labels
    candidates = staged(members.groupBy("set_hash").agg(F.sum("c").alias("weight")), "candidates")
    sets = staged(candidate_sets(docs, nodes.select("set_hash", "text_hash").join(candidates, "set_hash", "left_semi").select("text_hash"), width), "sets")
    info = staged(nodes.select("set_hash", "n", "signature").join(candidates.select("set_hash"), "set_hash", "left_semi"), "info")
    current, tried = candidates.select("set_hash", F.col("set_hash").alias("label"), "weight"), None
    for round_ in range(PIVOTS + 1):
        marked = members.select("key", "set_hash").join(current, "set_hash")
        drawn = F.xxhash64("set_hash", F.lit(round_))
        turn = F.struct(F.col("weight") if not round_ else F.lit(0).cast("long"), drawn.alias("h"))
        parts = marked.groupBy("key", "label").agg(F.max_by("set_hash", turn).alias("top"), F.max(turn).alias("turn"))
        buckets = parts.groupBy("key").agg(F.count("*").alias("parts"), F.max_by(F.struct("label", "top"), F.col("turn")).alias("top")).where("parts > 1")
        buckets = staged(buckets.select("key", F.col("top.label").alias("pivot_label"), F.col("top.top").alias("pivot")), "buckets")
        if not buckets.take(1):
            discard(buckets)
            break
        open_ = marked.join(buckets, "key")
        if round_ < PIVOTS:
            pairs = open_.where("label != pivot_label").select(F.least("set_hash", "pivot").alias("a"), F.greatest("set_hash", "pivot").alias("b")).distinct()
        else:
            pairs = prefix_pairs(open_.select("set_hash", "label").distinct(), sets, percent)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = staged(pairs, "pairs")
        discard(buckets)
        good = staged(confirm(pairs, info, sets, percent), "links")
        known = current.where("label != set_hash").select(F.col("set_hash").alias("a"), F.col("label").alias("b"))
        current = components(candidates, known.unionByName(good))
        discard(good)
        tried = pairs if tried is None else tried.unionByName(pairs)
    for table in (sets, info, members):
        discard(table)
    return labels.join(current.select("set_hash", F.col("label").alias("found")), "set_hash", "left").select("set_hash", F.coalesce("found", "label").alias("label"))


def prefix_pairs(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of `open_` (set_hash, label) of different labels, among them all that are similar enough.

    Of n shingles, rarest first, a set similar enough shares one of the first n - ceil(percent * n / 100) + 1. At the first
    shingle that both share, no more can be shared than is left of either. Shingles of one set alone come first and meet nobody.
    """

    def each(batches):
        for batch in batches:
            for name, label, own in zip(batch.column("set_hash"), batch.column("label"), batch.column("members"), strict=True):
                h, values, n = np.frombuffer(name.as_buffer(), ">i8"), np.frombuffer(own.as_buffer(), np.int64), len(own.as_buffer()) // 8
                part = np.frombuffer(label.as_buffer(), ">i8")[1]
                yield pa.RecordBatch.from_arrays([pa.array(values), *(pa.array(np.full(n, v, np.int64)) for v in (h[0], h[1], part, n))], ["shingle", "high", "low", "part", "n"])

    rows = staged(sets.join(open_, "set_hash").select("set_hash", "label", "members").mapInArrow(each, "shingle long, high long, low long, part long, n long"), "shingles")
    # shingles of two parts at least; a part is known by the second half of its label, which holds the number of shingles too
    shared = rows.groupBy("shingle").agg(F.count("*").alias("c"), F.min("part").alias("least"), F.max("part").alias("most")).where("c > 1").select("shingle", "c", (F.col("least") != F.col("most")).alias("open"))
    own = rows.join(shared, "shingle").groupBy("high", "low").agg(F.first("n").alias("n"), F.first("part").alias("part"), F.sort_array(F.collect_list(F.struct("c", "shingle", "open"))).alias("some"))
    alone = F.col("n") - F.size("some")
    longest = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    prefix = own.select("high", "low", "part", "n", alone.alias("alone"), F.posexplode(F.slice("some", F.lit(1), F.greatest(longest - alone, F.lit(0)).cast("int"))).alias("i", "s")).where("s.open")
    prefix = staged(prefix.select("s.shingle", "high", "low", "part", "n", (F.col("n") - F.col("alone") - F.col("i")).alias("rest")), "prefixes")
    discard(rows)
    one, other = (prefix.select("shingle", *(F.col(c).alias(f"{c}_{s}") for c in ("high", "low", "part", "n", "rest"))) for s in "ab")
    enough = F.least("rest_a", "rest_b") * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent
    apart = (F.col("part_a") != F.col("part_b")) & (F.struct("high_a", "low_a") < F.struct("high_b", "low_b"))
    names = (F.unhex(F.concat(*(F.lpad(F.hex(f"{c}_{s}"), 16, "0") for c in ("high", "low")))) for s in "ab")
    one_, other_ = names
    met = one.join(other, "shingle").where(apart & enough).select("high_a", "low_a", "high_b", "low_b").distinct()
    pairs = staged(met.select(one_.alias("p"), other_.alias("q")).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")), "met")
    discard(prefix)
    return pairs


def candidate_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(set_hash, members) of the texts of these hashes, made anew rather than kept for all texts. Texts are shuffled rather than sets, which are larger."""

    @lean
    def build(batches):
        for batch in batches:
            for _, _, data, at in slices(batch.column("text")):
                sets = [s for s in shingle_sets(data, at, width) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([set_hash(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["set_hash", "members"])

    texts = docs.select("text", F.xxhash64("text").alias("text_hash")).join(wanted, "text_hash", "left_semi").select("text")
    return texts.mapInArrow(build, "set_hash binary, members binary").dropDuplicates(["set_hash"])


def confirm(pairs: DataFrame, info: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough: sizes and estimates first, then the full sets."""
    side = lambda s: info.select(F.col("set_hash").alias(s), F.col("n").alias(f"n{s}"), F.col("signature").alias(f"g{s}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").where(f"least(na, nb) * 100 >= greatest(na, nb) * {percent}")

    close = sized.where(estimate_column(F.col("ga"), F.col("gb")) >= percent / 100 - SLACK).select("a", "b")
    both = close.join(sets.select(F.col("set_hash").alias("a"), F.col("members").alias("x")), "a").join(sets.select(F.col("set_hash").alias("b"), F.col("members").alias("y")), "b")

    @lean
    def exact(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), U) for v in (x, y))
                same = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * same >= percent * (len(p) + len(q) - same))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(exact, "a binary, b binary")


@lean
def joined_links(batches):
    """(u, v) of all links (u, v) of one task: each node that is not the least of its component, and that one."""
    above: dict[bytes, bytes] = {}

    def least(x: bytes) -> bytes:
        while (y := above.get(x, x)) != x:
            above[x] = x = above.get(y, y)
        return x

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            a, b = least(u), least(v)
            if a != b:
                above[max(a, b)] = min(a, b)
    nodes = list(above)
    for i in range(0, len(nodes), 8192):
        own = nodes[i : i + 8192]
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array([least(x) for x in own], pa.binary())], ["u", "v"])


def components(vertices: DataFrame, links: DataFrame) -> DataFrame:
    """(set_hash, label): the least set hash reachable. Up to TASK_LINKS links are joined by one task; of more, large-star and small-star rounds until no edge changes."""
    edges = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before, few = None, edges.count() <= TASK_LINKS
    if few:
        edges, old = staged(edges.coalesce(1).mapInArrow(joined_links, "u binary, v binary"), "edges"), edges
        discard(old)
    while not few:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(floor, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        edges, old = staged(small, "edges"), edges
        discard(old)
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    return vertices.join(edges.groupBy("u").agg(F.min("v").alias("label")).withColumnRenamed("u", "set_hash"), "set_hash", "left").select("set_hash", F.coalesce("label", "set_hash").alias("label"), "weight")
