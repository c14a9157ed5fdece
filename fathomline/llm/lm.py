"""Language-model scoring: a log-bilinear model over word classes, trained by noise-contrastive estimation in numpy.

Classes: the HEAD most frequent words, the end of a text, and SUFFIXES classes of all other words by a hash of their last three
bytes. The score of class w after classes u1 (the token before), u2, ... is (R_1[u1] + R_2[u2] + ...) . Q[w] + b[w], with CONTEXT
tokens of context. Training starts from the class pair counts of all training tokens with one token of context and the noise taken in
expectation; ROUNDS passes over all training tokens follow, in which each task descends on its own tokens against noise that it
draws, and the tasks' parameters are averaged by their tokens. Scores are normalised by batched matrix products. Inside a suffix class a word has its add-one share. So
P(token | previous) = P(class | previous classes) * P(word | class), which sums to one, one unseen word counted in each suffix class.

Word counts are exact and cover the corpus. Words of at least 1/FREQUENT of all tokens, so at most FREQUENT of them, are
told to every task; the others are looked up where their counts are, in packed blocks, one row for each block of texts and word bucket.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.storage import staged
from fathomline.llm.text import LOWER, U, lean, mix, segment_sums, slices, words

HEAD, SUFFIXES = 767, 256
CLASSES = HEAD + 1 + SUFFIXES
END = HEAD
FREQUENT = 10_000
CONTEXT = 2
DIMENSIONS, NOISE, STEPS, RATE = 24, 10, 120, 0.05
#: Passes over the training tokens, tokens and noise tokens of a step, the step's rate in the first pass.
ROUNDS, STEP_TOKENS, DRAWN, PASS_RATE = 2, 2048, 64, 0.03
#: Tasks whose sums one task adds up; pieces that class pairs and parameters are cut into for that.
FAN, STRIPS, PIECES = 256, 256, 16
HELD_OUT, MODULUS = 2, 7
COUNTS = "p int, hashes binary, counts binary, suffixes binary, n long, v long"
LOOKUPS = "block long, p int, a binary, b binary, c binary, d binary"
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def is_held_out(doc_ids: list) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % MODULUS == HELD_OUT for i in doc_ids], bool)


def tokens(data: np.ndarray, at: np.ndarray):
    """Words of lower-cased texts and the suffix class (0 up) of each."""
    w = words(data, at, lower=True)
    low = LOWER[data].astype(U)
    key = np.zeros(len(w.end), U)
    for j in range(1, 4):
        key = key * U(257) + np.where(w.end - j >= w.start, low[np.maximum(w.end - j, 0)] if len(low) else U(0), U(0))
    return w, (mix(key) % U(SUFFIXES)).astype(np.uint8)


def summed(hashes: np.ndarray, counts: np.ndarray, suffixes: np.ndarray):
    key, first, back = np.unique(hashes, return_index=True, return_inverse=True)
    return key, np.bincount(back, counts, len(key)).astype(np.int64), suffixes[first]


def count_words(docs: DataFrame, buckets: int) -> DataFrame:
    """Exact counts of the training words, a row for each bucket of words; summed in each task before the shuffle."""

    def count(batches):
        kept = None
        for batch in batches:
            train = ~is_held_out(batch.column("doc_id").to_pylist())
            for first, end, data, at in slices(batch.column("text")):
                w, suffix = tokens(data, at)
                use = train[first:end][w.doc] if len(w.doc) else np.zeros(0, bool)
                new = summed(w.hash[use], np.ones(int(use.sum()), np.int64), suffix[use])
                kept = [new] if kept is None else [*kept, new]
                if len(kept) > 16:
                    kept = [summed(*map(np.concatenate, zip(*kept, strict=True)))]
        if kept:
            h, c, s = summed(*map(np.concatenate, zip(*kept, strict=True)))
            p = (mix(h) % U(buckets)).astype(np.int64)
            order = np.argsort(p, kind="stable")
            ends = np.searchsorted(p[order], np.arange(buckets + 1))
            for b in range(buckets):
                own = order[ends[b] : ends[b + 1]]
                if len(own):
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([h[own].tobytes()], pa.binary()), pa.array([c[own].tobytes()], pa.binary()), pa.array([s[own].tobytes()], pa.binary())], ["p", "hashes", "counts", "suffixes"])

    def add(key, rows):
        h, c, s = summed(*(np.frombuffer(b"".join(rows[n]), t) for n, t in (("hashes", U), ("counts", np.int64), ("suffixes", np.uint8))))
        return pd.DataFrame({"p": [key[0]], "hashes": [h.tobytes()], "counts": [c.tobytes()], "suffixes": [s.tobytes()], "n": [int(c.sum())], "v": [len(h)]})

    parts = docs.select("doc_id", "text").mapInArrow(count, "p int, hashes binary, counts binary, suffixes binary")
    return staged(parts.groupBy("p").applyInPandas(add, COUNTS), "counts")


def frequent_words(counts: DataFrame, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of the words that come at least `least` times; at most FREQUENT."""

    def pick(batches):
        for batch in batches:
            for r in batch.to_pylist():
                h, c = np.frombuffer(r["hashes"], U), np.frombuffer(r["counts"], np.int64)
                own = c >= least
                yield pa.RecordBatch.from_arrays([pa.array(h[own].view(np.int64)), pa.array(c[own])], ["h", "c"])

    rows = counts.select("hashes", "counts").mapInArrow(pick, "h long, c long").collect()
    h, c = np.array([r.h for r in rows], np.int64).view(U), np.array([r.c for r in rows], np.int64)
    order = np.argsort(h)
    return h[order], c[order]


def suffix_totals(counts: DataFrame, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each suffix class: its tokens, and its words."""

    def total(batches):
        for batch in batches:
            for r in batch.to_pylist():
                h, c, s = (np.frombuffer(r[n], t) for n, t in (("hashes", U), ("counts", np.int64), ("suffixes", np.uint8)))
                own = ~np.isin(h, head)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(SUFFIXES)), pa.array(np.bincount(s[own], c[own], SUFFIXES).astype(np.int64)), pa.array(np.bincount(s[own], minlength=SUFFIXES))], ["k", "n", "v"])

    out = np.zeros((2, SUFFIXES), np.int64)
    for r in counts.mapInArrow(total, "k long, n long, v long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        out[:, r.k] = r.n, r.v
    return out[0], out[1]


def classes(w, suffix: np.ndarray, frequent: np.ndarray, class_of: np.ndarray):
    """Class of each word, and its place among the frequent ones (-1: none)."""
    spot = np.searchsorted(frequent, w.hash)
    known = np.zeros(len(spot), bool)
    inside = spot < len(frequent)
    known[inside] = frequent[spot[inside]] == w.hash[inside]
    place = np.where(known, spot, -1)
    own = class_of[place] if len(class_of) else np.full(len(place), -1)
    return np.where(known & (own >= 0), own, HEAD + 1 + suffix.astype(np.int64)), place


def chained(w, kind: np.ndarray):
    """Class of every token, ends included, the class before each, and where each text's tokens start."""
    at = w.first + np.arange(len(w.counts) + 1)
    current = np.insert(kind, w.first[1:], END) if len(w.counts) else np.zeros(0, np.int64)
    before = np.concatenate([[END], current[:-1]]) if len(current) else current
    return current, before, at


def contexts(before: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Classes one, two, ... CONTEXT tokens before each token; before a text's first token stands the end class."""
    found = [before]
    for _ in range(CONTEXT - 1):
        last = np.concatenate([[END], found[-1]])[: len(before)].astype(np.int64)
        last[at[:-1]] = END
        found.append(last)
    return found


def training_tokens(batches, frequent, class_of):
    """Class of every training token and its context, slice by slice."""
    for batch in batches:
        train = ~is_held_out(batch.column("doc_id").to_pylist())
        for first, end, data, at in slices(batch.column("text"), 1 << 20):
            w, suffix = tokens(data, at)
            current, before, starts = chained(w, classes(w, suffix, frequent, class_of)[0])
            use = np.repeat(train[first:end], np.diff(starts))
            yield current[use], [c[use] for c in contexts(before, starts)]


def folded(parts: DataFrame, add, schema: str) -> list:
    """Rows (s, node, ...) of all tasks added up by `add`, FAN tasks at a time and then those sums: one row for each s."""
    near = parts.withColumn("node", F.floor(F.col("node") / FAN).cast("int")).groupBy("s", "node").applyInPandas(add, schema)
    return near.withColumn("node", F.lit(0)).groupBy("s", "node").applyInPandas(add, schema).collect()


def pair_counts(docs: DataFrame, frequent, class_of) -> np.ndarray:
    """How often each class follows each, over all training tokens: CLASSES x CLASSES, whatever the corpus."""
    schema = "s int, node int, keys binary, n binary"

    @lean
    def count(batches):
        total = np.zeros(CLASSES * CLASSES, np.int64)
        for current, before in training_tokens(batches, frequent, class_of):
            key, n = np.unique(before[0] * CLASSES + current, return_counts=True)
            total[key] += n
        node, size = TaskContext.get().partitionId(), len(total) // STRIPS
        for s in range(STRIPS):
            key = np.flatnonzero(total[s * size : (s + 1) * size]) + s * size
            if len(key):
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([node], pa.int32()), pa.array([key.astype(np.int32).tobytes()], pa.binary()), pa.array([total[key].tobytes()], pa.binary())], ["s", "node", "keys", "n"])

    def add(key, rows):
        k, n = np.frombuffer(b"".join(rows["keys"]), np.int32), np.frombuffer(b"".join(rows["n"]), np.int64)
        k, back = np.unique(k, return_inverse=True)
        return pd.DataFrame({"s": [key[0]], "node": [key[1]], "keys": [k.tobytes()], "n": [np.bincount(back, n, len(k)).astype(np.int64).tobytes()]})

    out = np.zeros(CLASSES * CLASSES, np.int64)
    for r in folded(docs.select("doc_id", "text").mapInArrow(count, schema), add, schema):
        out[np.frombuffer(r["keys"], np.int32)] = np.frombuffer(r["n"], np.int64)
    return out.reshape(CLASSES, CLASSES)


def noise_of(pairs: np.ndarray) -> np.ndarray:
    return (pairs.sum(0) + 1.0) / (max(int(pairs.sum()), 1) + CLASSES)


def start(pairs: np.ndarray) -> list[np.ndarray]:
    """Parameters [R, Q, b] with one token of context: NCE with NOISE noise tokens a token, in expectation."""
    rng = np.random.Generator(np.random.PCG64(3))
    noise = noise_of(pairs)
    data = (pairs / max(int(pairs.sum()), 1)).astype(np.float32)
    against = (NOISE * data.sum(1)[:, None] * noise).astype(np.float32)
    shift = np.log(NOISE * noise).astype(np.float32)
    params = [rng.normal(0, 0.1, (CLASSES, DIMENSIONS)).astype(np.float32), rng.normal(0, 0.1, (CLASSES, DIMENSIONS)).astype(np.float32), np.log(noise).astype(np.float32)]
    first, second = ([np.zeros_like(p) for p in params] for _ in range(2))
    for step in range(1, STEPS + 1):
        r, q, b = params
        p = 1 / (1 + np.exp(-np.clip(r @ q.T + b - shift, -30, 30)))
        g = data * (p - 1) + against * p
        for i, d in enumerate((g @ q, g.T @ r, g.sum(0))):
            first[i] = 0.9 * first[i] + 0.1 * d
            second[i] = 0.99 * second[i] + 0.01 * d * d
            params[i] = params[i] - RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-9)
    r, q, b = params
    return [np.concatenate([r[None], np.zeros((CONTEXT - 1, *r.shape), np.float32)]), q, b]


def gradients(params, current: np.ndarray, before: list[np.ndarray], drawn: np.ndarray, shift: np.ndarray) -> list[np.ndarray]:
    """Mean gradients of the NCE loss: each token against NOISE noise tokens, estimated from those drawn for all of them."""
    r, q, b = params
    columns = np.arange(q.shape[1])

    def places(index):
        return (index[:, None] * len(columns) + columns).ravel()

    def by_class(index, values):
        return np.bincount(index, values.ravel(), q.size).reshape(q.shape)

    v = r[0][before[0]]
    for k in range(1, len(before)):
        v += r[k][before[k]]
    target, against = q[current], q[drawn]
    own = np.einsum("ij,ij->i", v, target) + b[current] - shift[current]
    h = v @ against.T
    h += b[drawn] - shift[drawn]
    with np.errstate(over="ignore"):  # an infinite odds is a share of zero
        g = -1 / (1 + np.exp(own))
        np.exp(np.negative(h, out=h), out=h)
    h += 1
    np.divide(h.dtype.type(NOISE / len(drawn)), h, out=h)
    target *= g[:, None]
    target += h @ against
    dq = by_class(places(current), g[:, None] * v) + by_class(places(drawn), h.T @ v)
    db = np.bincount(current, g, CLASSES) + np.bincount(drawn, h.sum(0), CLASSES)
    return [(d / len(current)).astype(q.dtype) for d in (np.stack([by_class(places(c), target) for c in before]), dq, db)]


def descend(params, squares, current, before, noise: np.ndarray, rng, rate: float) -> None:
    """Adagrad steps in place over these tokens, STEP_TOKENS at a time; noise is drawn anew for each step."""
    shift, ends = np.log(NOISE * noise).astype(np.float32), np.cumsum(noise) / noise.sum()
    for i in range(0, len(current), STEP_TOKENS):
        drawn = np.minimum(np.searchsorted(ends, rng.random(DRAWN), "right"), CLASSES - 1)
        for p, a, d in zip(params, squares, gradients(params, current[i : i + STEP_TOKENS], [c[i : i + STEP_TOKENS] for c in before], drawn, shift), strict=True):
            a += d * d
            p -= rate * d / np.sqrt(a)


def trained(docs: DataFrame, frequent, class_of, pairs: np.ndarray) -> list[np.ndarray]:
    """Parameters after ROUNDS passes over all training tokens. A task run again draws the same noise."""
    noise, params = noise_of(pairs), start(pairs)
    schema = "s int, node int, n long, sums binary"

    def one_pass(turn: int, given):
        @lean
        def learn(batches):
            node, seen = TaskContext.get().partitionId(), 0
            rng = np.random.Generator(np.random.PCG64([turn, node]))
            own, squares = [p.copy() for p in given], [np.full_like(p, 1e-8) for p in given]
            for current, before in training_tokens(batches, frequent, class_of):
                descend(own, squares, current, before, noise, rng, PASS_RATE / (1 + turn))
                seen += len(current)
            if seen:
                flat = np.concatenate([p.ravel() for p in own]).astype(np.float64) * seen
                for s, piece in enumerate(np.array_split(flat, PIECES)):
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([node], pa.int32()), pa.array([seen], pa.int64()), pa.array([piece.tobytes()], pa.binary())], ["s", "node", "n", "sums"])

        return docs.select("doc_id", "text").mapInArrow(learn, schema)

    def add(key, rows):
        total = sum(np.frombuffer(r) for r in rows.sort_values(["n", "sums"])["sums"])
        return pd.DataFrame({"s": [key[0]], "node": [key[1]], "n": [rows["n"].sum()], "sums": [total.tobytes()]})

    for turn in range(ROUNDS):
        rows = sorted(folded(one_pass(turn, params), add, schema))
        if rows:
            flat = np.concatenate([np.frombuffer(r["sums"]) / r["n"] for r in rows]).astype(np.float32)
            ends = np.cumsum([p.size for p in params])
            params = [f.reshape(p.shape) for f, p in zip(np.split(flat, ends[:-1]), params, strict=True)]
    return params


def log_probabilities(params, current: np.ndarray, before: list[np.ndarray], step: int = 128) -> np.ndarray:
    """Normalised natural log probability of each class after its context; each distinct context is normalised once."""
    r, q, b = params
    key = before[0]
    for c in before[1:]:
        key = key * CLASSES + c
    _, first, back = np.unique(key, return_index=True, return_inverse=True)
    v = sum(r[k][c[first]] for k, c in enumerate(before))
    total = np.zeros(len(first), np.float32)
    for i in range(0, len(first), step):
        s = v[i : i + step] @ q.T + b
        top = s.max(1)
        s -= top[:, None]
        np.exp(s, out=s)
        total[i : i + step] = top + np.log(s.sum(1))
    out = np.zeros(len(current))
    for i in range(0, len(current), 1 << 16):
        c, u = current[i : i + (1 << 16)], back[i : i + (1 << 16)]
        out[i : i + (1 << 16)] = np.einsum("ij,ij->i", v[u], q[c]) + b[c] - total[u]
    return out


def score_texts(docs: DataFrame) -> DataFrame:
    """Base and model log10 probability of every text; those of id crc32 % 7 = 2 are not learnt from.

    Null texts count as empty (one token, the end); a null id as the empty text's crc. Repeated rows count and are
    scored each. With no training texts every word is unknown. An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = count_words(docs, buckets)
    row = counts.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()

    def texts(batches):
        n = sum(int((~is_held_out(b.column("doc_id").to_pylist())).sum()) for b in batches)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    ends = docs.select("doc_id").mapInArrow(texts, "n long").agg(F.sum("n")).first()[0] or 0
    total, distinct = (row.n or 0) + ends, (row.v or 0) + (ends > 0)
    frequent, how_often = frequent_words(counts, max(1.0, total / FREQUENT))
    top = np.argsort(-how_often, kind="stable")[:HEAD]
    class_of = np.full(len(frequent), -1)
    class_of[top] = np.arange(len(top))
    in_suffix, of_suffix = suffix_totals(counts, frequent[top])
    shares = np.log10(in_suffix + of_suffix + 1.0)
    given = spark.sparkContext.broadcast((trained(docs, frequent, class_of, pair_counts(docs, frequent, class_of)), frequent, how_often, class_of, shares))
    ln10, low = np.log(10.0), np.log10(total + distinct + 1.0)

    def local(batches):
        params, frequent, how_often, class_of, shares = given.value
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for first, end, data, at in slices(batch.column("text"), 1 << 22):
                w, suffix = tokens(data, at)
                kind, place = classes(w, suffix, frequent, class_of)
                current, before, starts = chained(w, kind)
                score = segment_sums(log_probabilities(params, current, contexts(before, starts)), starts) / ln10
                log_count = np.where(place >= 0, np.log10(how_often[place] + 1.0), 0.0) if len(frequent) else np.zeros(len(place))
                inner = kind > END
                score += segment_sums(np.where(inner, log_count - shares[np.where(inner, kind - END - 1, 0)], 0.0), w.first)
                base = segment_sums(log_count, w.first) + np.log10(ends + 1.0)
                known = segment_sums((place >= 0).astype(np.int64), w.first) + (ends > 0)
                out = [(block, -1, np.array([0 if i is None else i for i in ids[first:end]], np.int64).tobytes(), np.array([i is None for i in ids[first:end]], np.uint8).tobytes(), np.stack([w.counts + 1, known], 1).astype(np.int64).tobytes(), np.stack([base, score], 1).tobytes())]
                rare = place < 0
                h, doc = w.hash[rare], w.doc[rare].astype(np.uint32)
                p = (mix(h) % U(buckets)).astype(np.int64)
                order = np.lexsort((doc, h, p))
                h, doc, p = h[order], doc[order], p[order]
                cut = np.searchsorted(p, np.arange(buckets + 1))
                for b in range(buckets):
                    if cut[b] < cut[b + 1]:
                        hb, db = h[cut[b] : cut[b + 1]], doc[cut[b] : cut[b + 1]]
                        new = np.flatnonzero(np.concatenate([[True], hb[1:] != hb[:-1]]))
                        out.append((block, b, hb[new].tobytes(), np.diff(np.append(new, len(hb))).astype(np.uint32).tobytes(), db.tobytes(), b""))
                for r in out:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0]], pa.int64()), pa.array([r[1]], pa.int32()), *(pa.array([x], pa.binary()) for x in r[2:])], ["block", "p", "a", "b", "c", "d"])
                block += 1

    found = staged(docs.mapInArrow(local, LOOKUPS), "lookups")

    def answer(asked, counted):
        known, n = np.zeros(0, U), np.zeros(0, np.int64)
        if len(counted):
            known, n = np.frombuffer(counted["hashes"][0], U), np.frombuffer(counted["counts"][0], np.int64)
        rows = []
        for r in asked.itertuples():
            h, times, doc = np.frombuffer(r.a, U), np.frombuffer(r.b, np.uint32), np.frombuffer(r.c, np.uint32)
            spot = np.searchsorted(known, h)
            c = np.zeros(len(h), np.int64)
            inside = spot < len(known)
            c[inside] = np.where(known[spot[inside]] == h[inside], n[spot[inside]], 0)
            each = np.repeat(c, times)
            hit = each > 0  # unknown words add log10(1)
            docs_, back = np.unique(doc[hit], return_inverse=True)
            rows.append((r.block, docs_.tobytes(), np.bincount(back, np.log10(each[hit] + 1.0), len(docs_)).tobytes(), np.bincount(back, minlength=len(docs_)).astype(np.int64).tobytes()))
        return pd.DataFrame(rows, columns=["block", "docs", "sums", "known"])

    asked = found.where("p >= 0").select("block", "p", "a", "b", "c")
    answers = asked.groupBy("p").cogroup(counts.groupBy("p")).applyInPandas(answer, "block long, docs binary, sums binary, known binary")

    def finish(own, parts):
        if not len(own):
            return pd.DataFrame({c.split()[0]: [] for c in RESULT.split(", ")})
        r = own.iloc[0]
        ids, null = np.frombuffer(r["a"], np.int64), np.frombuffer(r["b"], np.uint8).astype(bool)
        sizes, sums = np.frombuffer(r["c"], np.int64).reshape(-1, 2).copy(), np.frombuffer(r["d"]).reshape(-1, 2).copy()
        for part in parts.sort_values("docs").itertuples():
            at = np.frombuffer(part.docs, np.uint32)
            sums[at] += np.frombuffer(part.sums)[:, None]
            sizes[at, 1] += np.frombuffer(part.known, np.int64)
        return pd.DataFrame({"doc_id": pd.array(ids, "Int64").copy() if not null.any() else pd.array(np.where(null, None, ids), "Int64"), "held_out": is_held_out([None if e else int(i) for i, e in zip(ids, null, strict=True)]), "n_tokens": sizes[:, 0], "n_known": sizes[:, 1], "train_tokens": total, "base_score": sums[:, 0] - sizes[:, 0] * low, "score": sums[:, 1]})

    return found.where("p < 0").groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(finish, RESULT)
