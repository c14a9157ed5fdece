"""Quality classifier by co-training: a view of the text's content and a view of the page's metadata (language, source, size).

Either view is fitted on a bounded sample of labelled rows. In each round both score all unlabelled documents, and what one
is most confident about is taught to the other. In the end both are calibrated on held-out labelled rows, and their log odds are combined
by weights fitted on other held-out rows. Fitting is one task of an executor; the driver gets the weights alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm import linear
from fathomline.llm.quality_rules import LONGEST, examples_of, one_task, sample_rows
from fathomline.llm.storage import discard, staged
from fathomline.llm.text import lean, mix, slices, span_hashes

#: Labelled rows of each class that the classifiers are fitted on, at most.
LABELLED = 1000
#: Rounds of exchange; least confidence of a pseudo-label; pseudo-labels of each view and class in a round.
ROUNDS, CONFIDENT, NEW = 2, 0.95, 100
#: Training steps of the first fit, and of each later one.
FIRST_STEPS, NEXT_STEPS = 150, 40
THRESHOLD = 0.5
META = ("lang", "source", "n_chars")
META_BITS, CATEGORIES = 10, 4
RESULT = "doc_id long, content_probability double, metadata_probability double, score double, kept boolean"


def metadata(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """CATEGORIES hashed categories (language, source, both, binary order of the size) and the log size of each row; null counts as a value of its own, a null size as 0."""
    size = np.maximum(np.asarray(batch.column("n_chars").cast(pa.int64()).fill_null(0)), 0)
    lang, source = (batch.column(c).cast(pa.string()).fill_null("\x00").to_pylist() for c in ("lang", "source"))
    kinds = np.zeros((batch.num_rows, CATEGORIES), np.int64)
    order = np.log2(size + 1.0).astype(int).tolist()
    for k, names in enumerate((lang, source, [f"{a}\x01{b}" for a, b in zip(lang, source, strict=True)], [f"{a}\x01{n}" for a, n in zip(lang, order, strict=True)])):
        raw = [s.encode() for s in names]
        ends = np.cumsum([len(r) for r in raw]).astype(np.int64)
        h = span_hashes(np.frombuffer(b"".join(raw) or b"\0", np.uint8), ends - np.array([len(r) for r in raw], np.int64), ends)
        kinds[:, k] = (mix(h + np.uint64(k)) >> np.uint64(64 - META_BITS)).astype(np.int64)
    return kinds, np.log1p(size) / 10


def metadata_rows(kinds: np.ndarray, size: np.ndarray):
    index = np.concatenate([kinds, np.full((len(kinds), 1), 1 << META_BITS)], 1)
    return list(zip(index, np.concatenate([np.full(kinds.shape, 0.2), size[:, None]], 1), strict=True))


@dataclass
class Views:
    """Both views' models, and (bias, weight of content, weight of metadata) of their calibrated log odds."""

    content: linear.Logistic
    meta: linear.Logistic
    top: tuple[float, float, float] = (0.0, 1.0, 1.0)

    def raw(self, batch: pa.RecordBatch):
        """(first row, end row, raw scores of the content, of the metadata) of runs of rows."""
        kinds, size = metadata(batch)
        meta = self.meta.weights[kinds].sum(1) * 0.2 + size * self.meta.weights[1 << META_BITS] + self.meta.bias
        for first, end, data, at in slices(batch.column("text")):
            yield first, end, linear.score(self.content.weights, self.content.bias, data, at), meta[first:end]

    def odds(self, content: np.ndarray, meta: np.ndarray) -> np.ndarray:
        a, b = (np.clip(m.slope * r + m.shift, -8, 8) for m, r in ((self.content, content), (self.meta, meta)))
        return self.top[0] + self.top[1] * a + self.top[2] * b


NOTHING = Views(linear.Logistic(np.zeros(linear.KINDS << linear.BITS, np.float32), 0.0), linear.Logistic(np.zeros((1 << META_BITS) + 1, np.float32), 0.0))


def fit_views(batches, views: Views | None, last: bool) -> Views:
    """Both views fitted on their examples (doc_id, text, META, y, c, m), from `views` on; calibrated and combined if this is the last fit.

    y: the label, -1 of unlabelled documents; c, m: what the content and the metadata view are taught. An eighth of the labelled
    rows is held out for the calibration, another for the combination.
    """
    rows = []
    for batch in batches:
        kinds, size = metadata(batch)
        given = list(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "y", "c", "m")), strict=True))
        for first, end, data, at in slices(batch.column("text")):
            rows += zip(given[first:end], linear.features(data, at), metadata_rows(kinds[first:end], size[first:end]), strict=True)
    rows.sort(key=lambda r: r[0])
    ids, y, *taught = (np.array(c) for c in zip(*(r[0] for r in rows), strict=True))
    place = np.where(y >= 0, linear.spread(ids), 1.0)
    models = []
    for v, start in ((0, views and views.content), (1, views and views.meta)):
        own = np.flatnonzero((taught[v] >= 0) & (place >= 0.25))
        models.append(linear.fit([rows[i][1 + v] for i in own], taught[v][own], len((NOTHING.content, NOTHING.meta)[v].weights), rounds=NEXT_STEPS if views else FIRST_STEPS, start=start))
    out = Views(*models)
    if last:
        for v, model in enumerate(models):
            own = np.flatnonzero(place < 0.125)
            linear.calibrate(model, model.raw([rows[i][1 + v] for i in own]), y[own])
        own = np.flatnonzero((place >= 0.125) & (place < 0.25))
        odds = [np.clip(m.slope * m.raw([rows[i][1 + v] for i in own]) + m.shift, -8, 8) for v, m in enumerate(models)]
        top = linear.fit([(np.array([0, 1]), np.array(o)) for o in zip(*odds, strict=True)], y[own], 2, rounds=400)
        if top.weights.any():
            out.top = (float(top.bias), float(max(top.weights[0], 0.05)), float(max(top.weights[1], 0.0)))
    return out


def most_confident(docs: DataFrame, labels: DataFrame, views: Views, new: int = NEW) -> DataFrame:
    """doc_id, c, m: of all unlabelled documents, up to `new` of each view and class that it is the surest of (from CONFIDENT on); c is what the content view is taught by the other, m the reverse; -1: nothing.

    Texts over LONGEST bytes are not among them, as nothing is fitted on those.
    """
    edge = np.log(CONFIDENT / (1 - CONFIDENT))

    @lean
    def sure(batches):
        for batch in batches:
            for first, end, *raw in views.raw(batch):
                for v, r in enumerate(raw):
                    own = np.flatnonzero(np.abs(r) >= edge)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, end - first).cast(pa.int64()).take(pa.array(own)), pa.array(np.full(len(own), v, np.int32)), pa.array((r[own] > 0).astype(np.int32)), pa.array(np.abs(r[own]))], ["doc_id", "view", "y", "margin"])

    found = docs.select("doc_id", "text", *META).where(F.octet_length("text") <= LONGEST).mapInArrow(sure, "doc_id long, view int, y int, margin double").where("doc_id IS NOT NULL")
    found = staged(found.join(labels.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_anti").groupBy("doc_id", "view", "y").agg(F.max("margin").alias("margin")), "confident")
    lists = [found.where((F.col("view") == v) & (F.col("y") == y)).orderBy(F.desc("margin"), "doc_id").limit(new) for v in (0, 1) for y in (0, 1)]
    rows = [r for one in lists for r in one.collect()]  # at most 4 * new
    discard(found)
    taught: dict[int, list[int]] = {}
    for r in sorted(rows, key=lambda r: (r.margin, r.doc_id)):
        taught.setdefault(r.doc_id, [-1, -1])[1 - r.view] = r.y
    return docs.sparkSession.createDataFrame([(i, *t) for i, t in sorted(taught.items())], "doc_id long, c int, m int")


def co_train(docs: DataFrame, labels: DataFrame) -> Views:
    """Both calibrated views and their combination; without labels of both classes all scores are a half."""
    given = sample_rows(docs, labels, "quality", LABELLED, META).withColumns({"y": F.col("y").cast("int"), "c": F.col("y").cast("int"), "m": F.col("y").cast("int")})
    examples = staged(given, "examples")
    if examples.select("y").distinct().count() < 2:
        return NOTHING
    views = None
    for r in range(ROUNDS + 1):
        views = one_task(examples, lambda batches: fit_views(batches, views, r == ROUNDS))  # noqa: B023
        if r == ROUNDS:
            break
        pseudo = most_confident(docs, labels, views)
        if pseudo.take(1):
            new = examples_of(docs, pseudo, META).withColumn("y", F.lit(-1))
            # a document taught before keeps what it was taught, unless it is taught anew
            before, examples = examples, staged(examples.join(F.broadcast(pseudo.select("doc_id")), "doc_id", "left_anti").unionByName(new), "examples")
            discard(before)
    discard(examples)
    return views


def quality_classifier(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Both views' calibrated probabilities of good quality, the combined score and the verdict, for every document.

    Null text or metadata count as empty; texts of any length are scored whole; without labels of both classes everything scores a half and is kept.
    Repeated rows are scored each, a null id like any other; an empty table gives no rows. Columns other than doc_id, text and META, whatever their names, are not read.
    """
    views = co_train(docs, labels)

    @lean
    def judge(batches):
        for batch in batches:
            for first, end, content, meta in views.raw(batch):
                score = 1 / (1 + np.exp(-views.odds(content, meta)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, end - first).cast(pa.int64()), pa.array(views.content.probability(content)), pa.array(views.meta.probability(meta)), pa.array(score), pa.array(score >= threshold)], ["doc_id", "content_probability", "metadata_probability", "score", "kept"])

    return docs.select("doc_id", "text", *META).mapInArrow(judge, RESULT)


def kept_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that the classifier keeps, all columns; verdicts travel with the rows, not by a join. Odd rows are treated as by quality_classifier."""
    views, edge = co_train(docs, labels), np.log(threshold / (1 - threshold))

    @lean
    def keep(batches):
        for batch in batches:
            for first, end, content, meta in views.raw(batch):
                yield batch.slice(first, end - first).filter(pa.array(views.odds(content, meta) >= edge))

    return docs.mapInArrow(keep, docs.schema)
