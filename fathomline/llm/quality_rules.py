"""Quality rules: base counts of every text, and a hashed word and character n-gram classifier against a fixed threshold."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm import linear
from fathomline.llm.text import code_points, lean, segment_sums, shingles, slices, span_hashes, words

#: Labelled rows that the classifier is fitted on, of each class at most, and bytes of each one's text.
SAMPLE, LONGEST = 1500, 1 << 14
THRESHOLD = 0.5
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"


def repeated(key: np.ndarray) -> np.ndarray:
    """True where the value is found twice or more."""
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    out = np.zeros(len(key), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def earlier(key: np.ndarray) -> np.ndarray:
    """True where an equal value comes before."""
    order = np.argsort(key, kind="stable")
    out = np.zeros(len(key), bool)
    out[order[1:][key[order][1:] == key[order][:-1]]] = True
    return out


def base_counts(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    n = len(at) - 1
    w = words(data, at)
    points = np.concatenate([[0], np.cumsum(code_points(data))])
    chars = segment_sums(points[w.end] - points[w.start] if len(w.start) else np.zeros(0, np.int64), w.first)
    # windows of three words, told apart by text
    h, doc = shingles(w, 3)
    again = repeated(h ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    starts = np.flatnonzero(w.doc[: max(len(w.hash) - 2, 0)] == w.doc[2:])[again] if len(h) else np.zeros(0, np.int64)
    covered = np.zeros(len(w.hash), bool)
    for j in range(3):
        covered[starts + j] = True
    # lines: cut at each line break and at each text's start
    breaks = np.flatnonzero(data == 10)
    begin = np.sort(np.concatenate([at[:-1], breaks + 1]))
    stop = np.sort(np.concatenate([at[1:], breaks]))
    line_doc = np.sort(np.concatenate([np.arange(n), np.searchsorted(at, breaks, "right") - 1]))
    with_word = np.searchsorted(w.start, begin) < np.searchsorted(w.start, stop)
    begin, stop, line_doc = begin[with_word], stop[with_word], line_doc[with_word]
    dup = earlier(span_hashes(data, begin, stop) ^ (line_doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) if len(begin) else np.zeros(0, bool)
    return {
        "n_words": w.counts,
        "word_chars": chars,
        "n_symbols": segment_sums(SYMBOL[data].astype(np.int64), at),
        "n_dup_lines": np.bincount(line_doc[dup], minlength=n),
        "n_repeat_words": segment_sums(covered.astype(np.int64), w.first),
    }


def sample_rows(docs: DataFrame, labels: DataFrame, label: str, most: int, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, `also` and y of up to `most` labelled documents of each class, by a hash of their id, one row for each id; texts over LONGEST bytes are not among them."""
    known = labels.select("doc_id", F.col(label).alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))
    order = F.xxhash64("doc_id", F.lit(7))
    chosen = [known.where(F.col("y") == y).orderBy(order, "doc_id").limit(most) for y in (0, 1)]
    return examples_of(docs, chosen[0].unionByName(chosen[1]), also)  # at most 2 * most


def examples_of(docs: DataFrame, chosen: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """Texts and `also` of the few documents in `chosen` (doc_id, ...), one row for each id, with the columns of `chosen`."""
    found = docs.where(F.octet_length("text") <= LONGEST).select(F.col("doc_id").cast("long").alias("doc_id"), F.struct("text", *also).alias("row")).join(F.broadcast(chosen), "doc_id")
    names = [c for c in chosen.columns if c != "doc_id"]
    one = found.groupBy("doc_id").agg(F.min("row").alias("row"), *(F.first(c).alias(c) for c in names))
    return one.select("doc_id", "row.*", *names)


def one_task(rows: DataFrame, work):
    """What `work` makes of the list of rows' batches, in one task of an executor; None where there are no rows. Only for bounded tables."""

    @lean
    def run(batches):
        got = [b for b in batches if b.num_rows]
        if got:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(work(got))], pa.binary())], ["result"])

    found = rows.repartition(1).mapInArrow(run, "result binary").collect()
    return pickle.loads(found[0].result) if found else None


def train(batches) -> linear.Logistic:
    """Fitted on four fifths of the examples (doc_id, text, y), calibrated on the rest."""
    examples = []
    for batch in batches:
        ids, y = batch.column("doc_id").to_pylist(), batch.column("y").to_pylist()
        for first, end, data, at in slices(batch.column("text")):
            examples += zip(ids[first:end], y[first:end], linear.features(data, at), strict=True)
    examples.sort(key=lambda e: e[0])
    held = linear.spread(np.array([e[0] for e in examples])) < 0.2
    y, rows = np.array([e[1] for e in examples]), [e[2] for e in examples]
    model = linear.fit([r for r, h in zip(rows, held, strict=True) if not h], y[~held], linear.KINDS << linear.BITS)
    return linear.calibrate(model, model.raw([r for r, h in zip(rows, held, strict=True) if h]), y[held])


def fitted(docs: DataFrame, labels: DataFrame, most: int) -> linear.Logistic:
    """The classifier of labelled `quality`; without labels of both classes one that scores everything a half."""
    return one_task(sample_rows(docs, labels, "quality", most), train) or linear.Logistic(np.zeros(linear.KINDS << linear.BITS, np.float32), 0.0)


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most: int = SAMPLE) -> DataFrame:
    """Counts, calibrated score and verdict of every document.

    Null text has no words and fails the base rules; a text of any length is judged whole. Without labels of both classes every score is a
    half, and what passes the base rules is kept. Repeated rows are judged each, a null id like any other; an empty table gives no rows; other columns, whatever their names, are not read.
    """
    model = fitted(docs, labels, most)
    weights, bias, slope, shift = model.weights, model.bias, model.slope, model.shift

    @lean
    def judge(batches):
        own = linear.Logistic(weights, bias, slope, shift)
        for batch in batches:
            for first, end, data, at in slices(batch.column("text")):
                counts = base_counts(data, at)
                failed = (counts["n_words"] < 50) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])
                score = own.probability(linear.score(weights, bias, data, at))
                columns = [batch.column("doc_id").slice(first, end - first).cast(pa.int64()), *(pa.array(v.astype(np.int64)) for v in counts.values()), pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *counts, "base_failed", "score", "kept"])

    return docs.select("doc_id", "text").mapInArrow(judge, RESULT)
