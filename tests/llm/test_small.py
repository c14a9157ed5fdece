"""Each operator on small tables, against brute force, and on nulls, empty texts, ties, repeats, empty tables and clashing names."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from fathomline.llm import cotraining, encoder, fingerprints, linear, lm, minhash, mixing, packing, quality_rules, substring, token_files, url_filter

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RNG = np.random.Generator(np.random.PCG64(8))
VOCAB = ["".join(RNG.choice(list("abcdeéñß"), RNG.integers(2, 7))) for _ in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size long, rank long, part int, seed long"


def prose(n):
    return " ".join(RNG.choice(VOCAB, n))


BASE = prose(120)
LONG = prose(9000)
NEAR = BASE.split()
NEAR[60] = "changed"
TEXTS = [BASE, BASE, " ".join(NEAR), None, "", " \n\t", "one", "one two", "two one", LONG, prose(30) + "\nsame line\nsame line\n" + prose(40), "### $$$ " * 40, "naïve café\u00a0 \u3000 x 'll don't\u2003\n\n  end ", prose(70), prose(60) + " " + " ".join(BASE.split()[:70])]
ROWS = [(i, t, None if i % 5 == 4 else "en", [None, "b", "a"][i % 3], len(t or ""), True, 7, 1, 2, 3) for i, t in enumerate(TEXTS)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i != 11), 0) for i in (0, 1, 2, 9, 10, 11, 13, 14)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")


def words(t):
    return WORD.findall(t or "")


def token_ids(end):
    t = Tokenizer.from_file(VOCABULARY)
    return [t.encode(x or "", add_special_tokens=False).ids + [end] for x in TEXTS]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(docs, none):
    start, want = 0, []
    for i, ids in enumerate(token_ids(0)):
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, token_files.token_files(docs, VOCABULARY).collect())) == want
    assert token_files.token_files(none, VOCABULARY).count() == 0


@pytest.mark.parametrize("n", [1, 511, 512, 513, 3000])
def test_pfor_round_trip(n):
    ids = RNG.integers(0, 300, n).astype(np.uint32)
    ids[:: max(1, n // 7)] = 2**32 - 1
    blocks = token_files.pack(ids)
    starts = np.cumsum([0, *map(len, blocks)])[:-1]
    assert (token_files.unpack(b"".join(blocks), starts) == ids).all()


def test_added_tokens():
    texts = ["the end <|endoftext|> of", "a<|endoftext|>b", "<|endoftext|>", "x  <|endoftext|>\n <|endoftext|><|endoftext|> y", "a <|endoftext", "|> b", ""]
    t = Tokenizer.from_file(VOCABULARY)
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    ids, counts = encoder.Encoder(VOCABULARY)(np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)]))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want and 50256 in want[0]


def test_encoder_equals_the_tokenizer():
    parts = ["a", "Word", "two words", " ", "  ", "\n", "\n\n", "\r\n", "\t", "\v\f", "\u00a0", "\u2003", "\u3000", "\u2028", "\u0085", "é", "ß", "日本", "\u0301", "'s", "'", "don't", "12", "٣", ".", "!?", "<", "|>", "<|endoftext|>", "😀", "\x00", "\x1c", "\ufeff"]
    texts = ["".join(RNG.choice(parts, RNG.integers(0, 12))) for _ in range(10_000)] + ["First paragraph.\n\nSecond paragraph."]
    want = [e.ids for e in Tokenizer.from_file(VOCABULARY).encode_batch(texts, add_special_tokens=False)]
    own = encoder.Encoder(VOCABULARY)
    for first in range(0, len(texts), 1000):
        some = [t.encode() for t in texts[first : first + 1000]]
        ids, counts = own(np.frombuffer(b"".join(some), np.uint8), np.cumsum([0, *map(len, some)]))
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want[first : first + 1000]


def test_new_pieces_go_together():
    texts = [b" wor" + str(i).encode() for i in range(300)] + [b"<", b">", b"<|endof", b"text|>", b"a<|endoftext|>b", b" x>", "\u00e9\u2003".encode(), b"\n"]
    enc = encoder.Encoder(VOCABULARY)
    tokenizer, sent = enc.tokenizer, []
    alone = {t: tokenizer.encode(t.decode(), add_special_tokens=False).ids for t in texts}

    class Counting:
        def encode_batch_fast(self, parts, **more):
            sent.extend(parts)
            return tokenizer.encode_batch_fast(parts, **more)

    enc.tokenizer = Counting()
    for round_ in (texts, texts[::-1], texts[300:], texts[:1]):
        enc.forget()
        hashes = np.arange(len(round_), dtype=np.uint64)
        enc.learn(hashes, round_)
        got = [enc.ids[enc.begin[e] : enc.begin[e] + enc.size[e]].tolist() for e in enc.entry]
        assert got == [alone[t] for t in round_]
    assert len(sent) < 60


def test_packing(docs, none):
    rows, by = packing.best_fit_packing(docs, VOCABULARY).collect(), defaultdict(list)
    seq = defaultdict(list)
    ids = token_ids(2)
    for r in rows:
        by[r.doc_id].append(r)
        seq[r.sequence_id].append((r.offset, r.length))
        assert crc(ids[r.doc_id][r.start : r.start + r.length]) == r.ids_crc32
    for spans in seq.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(spans), sorted(spans)[1:], strict=False)) and min(spans)[0] == 0 and sum(n for _, n in spans) <= 1024
    assert all(sum(r.length for r in by[i]) == len(x) for i, x in enumerate(ids)) and len(by) == len(ids)
    assert packing.best_fit_packing(none, VOCABULARY).count() == 0


def test_packing_plan():
    for _ in range(20):
        counts = Counter(RNG.integers(1, 1025, 400).tolist())
        sequences = defaultdict(int)
        for size, lo, hi, first, each, _ in packing.plan(counts):
            for r in range(hi - lo):
                sequences[first + r // each] += size
        assert sum(sequences.values()) == sum(s * n for s, n in counts.items()) and max(sequences.values()) <= 1024
        assert len(sequences) <= 1.06 * sum(s * n for s, n in counts.items()) / 1024 + 3


def test_quality_rules(docs, labels, none):
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs, labels).collect()}
    for i, t in enumerate(TEXTS):
        w = words(t)
        c, covered, seen, dup = Counter(zip(w, w[1:], w[2:])), set(), set(), 0
        for k, x in enumerate(zip(w, w[1:], w[2:], strict=False)):
            covered |= {k, k + 1, k + 2} if c[x] > 1 else set()
        for line in (t or "").split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert quality_rules.quality_rules(none, labels).count() == 0
    assert quality_rules.quality_rules(docs, labels.limit(0)).count() == len(TEXTS)


def test_classifier_learns():
    good = [f"{prose(40)}".encode() for _ in range(60)]
    bad = [f"{prose(20)} ### $$$ ".encode() * 2 for _ in range(60)]
    data = np.frombuffer(b"".join(good + bad), np.uint8)
    at = np.cumsum([0, *map(len, good + bad)])
    y = np.array([1] * 60 + [0] * 60)
    rows = linear.features(data, at)
    model = linear.fit(rows[::2], y[::2], linear.KINDS << linear.BITS)
    assert np.allclose(model.raw(rows), linear.score(model.weights, model.bias, data, at), atol=1e-3)
    assert ((model.raw(rows)[1::2] > 0) == y[1::2]).mean() > 0.95


def test_quality_classifier(docs, labels, none):
    got = cotraining.quality_classifier(docs, labels).collect()
    assert len(got) == len(TEXTS) and all(0 <= r.score <= 1 for r in got)
    kept = cotraining.kept_documents(docs, labels)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(r.doc_id for r in got if r.kept)
    assert cotraining.quality_classifier(none, labels).count() == 0
    assert cotraining.quality_classifier(docs, labels.limit(0)).where("kept").count() == len(TEXTS)


def test_one_class_of_labels(docs, labels):
    bad = labels.withColumn("quality", labels.quality * 0)
    assert cotraining.quality_classifier(docs, bad).where("kept AND score = 0.5").count() == len(TEXTS)
    assert {r.kept for r in quality_rules.quality_rules(docs, bad).collect() if not r.base_failed} == {True}


def test_most_confident(spark):
    size = linear.KINDS << linear.BITS
    views = cotraining.Views(linear.Logistic(RNG.normal(0, 60, size).astype(np.float32), 0.5), linear.Logistic(RNG.normal(0, 20, (1 << cotraining.META_BITS) + 1).astype(np.float32), -0.5))
    rows = [(i, prose(int(RNG.integers(1, 80))), "ende"[2 * (i % 2) :][:2], f"s{i % 7}", 10 * i) for i in range(120)]
    docs = spark.createDataFrame([*rows, *rows[:5], (None, "x", "en", "s1", 1)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 120, 3)], "doc_id long, quality int, toxic int")
    want, lists = {}, defaultdict(list)
    for i, *row in rows:
        if i % 3:
            batch = pa.RecordBatch.from_pylist([dict(zip(("text", "lang", "source", "n_chars"), row, strict=True))])
            _, _, content, meta = next(views.raw(batch))
            for v, r in ((0, content[0]), (1, meta[0])):
                if abs(r) >= np.log(19):
                    lists[v, int(r > 0)].append((abs(r), i))
    for (v, y), own in lists.items():
        for m, i in sorted(own, key=lambda r: (-r[0], r[1]))[:8]:
            want.setdefault(i, {})[1 - v] = max(want.get(i, {}).get(1 - v, (0, 0)), (m, y))
    got = {r.doc_id: (r.c, r.m) for r in cotraining.most_confident(docs, labels, views, 8).collect()}
    assert got == {i: tuple(t.get(v, (0, -1))[1] for v in (0, 1)) for i, t in want.items()} and len(got) > 16


def test_views_are_calibrated_apart():
    n, own = 2400, np.random.Generator(np.random.PCG64(1))
    text = [("good " if i % 2 else "bad ") * 5 + " ".join(own.choice(VOCAB, 6)) for i in range(n)]
    y = [(i % 2) ^ int(own.random() < 0.2) for i in range(n)]
    batch = pa.RecordBatch.from_pylist([{"doc_id": i, "text": t, "lang": "en", "source": "s", "n_chars": len(t), "y": v, "c": v, "m": v} for i, (t, v) in enumerate(zip(text, y, strict=True))])
    views = cotraining.fit_views([batch], None, True)
    p = np.concatenate([1 / (1 + np.exp(-views.odds(c, m))) for _, _, c, m in views.raw(batch)])
    for own in (p > 0.5, p < 0.5):
        assert abs(p[own].mean() - np.array(y)[own].mean()) < 0.15
    assert ((p > 0.5) == np.arange(n) % 2).mean() > 0.9


def test_near_duplicates(docs, none):
    sets = []
    for t in TEXTS:
        w = words((t or "").translate(LOWER))
        sets.append(set(zip(w, w[1:], w[2:], w[3:])) if len(w) > 3 else {tuple(w)} if w else set())
    part = list(range(len(sets)))
    for _ in sets:
        for a in range(len(sets)):
            for b in range(a):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    part[a] = part[b] = min(part[a], part[b])
    got = sorted(map(tuple, minhash.near_duplicates(docs).collect()))
    assert got == [(i, len(s), part[i], part[i] == i) for i, s in enumerate(sets)]
    assert minhash.near_duplicates(none).count() == 0


def test_copies_below_the_threshold(spark):
    base = prose(150).split()
    texts = []
    for k in range(160):
        w = list(base)
        for i in RNG.choice(150, 2 + k % 16, replace=False):
            w[i] = VOCAB[int(RNG.integers(0, 12))]
        texts.append(" ".join(w))
    sets = [set(zip(w, w[1:], w[2:], w[3:])) for w in map(str.split, texts)]
    part = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if part[a] != part[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((part[a], part[b]))
                part = [low if p == high else p for p in part]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()} == dict(enumerate(part)) and 10 < len(set(part)) < 150


def test_prefix_filter(spark):
    from pyspark.sql import functions as F

    own = [np.unique(RNG.choice(60, int(RNG.integers(8, 14)))).astype(np.uint64) for _ in range(400)]
    own += [np.delete(s, int(RNG.integers(len(s)))) for s in own[:100]]
    own = list({minhash.set_hash(s): s for s in own}.values())
    names = [minhash.set_hash(s) for s in own]
    sets = spark.createDataFrame([(h, s.tobytes()) for h, s in zip(names, own, strict=True)], "set_hash binary, members binary")
    got = {(bytes(r.a), bytes(r.b)) for r in minhash.prefix_pairs(sets.select("set_hash", F.col("set_hash").alias("label")), sets, 80).collect()}
    want = set()
    for i, a in enumerate(own):
        for j in range(i):
            both = len(np.intersect1d(a, own[j]))
            if 100 * both >= 80 * (len(a) + len(own[j]) - both):
                want.add((min(names[i], names[j]), max(names[i], names[j])))
    assert want <= got and len(want) > 30 and len(got) < 0.2 * len(own) ** 2 / 2


@pytest.mark.parametrize("most", [10**6, 0])
def test_components(spark, monkeypatch, most):
    monkeypatch.setattr(minhash, "TASK_LINKS", most)
    own = np.random.Generator(np.random.PCG64(3))
    name = {i: own.bytes(16) for i in range(120)}
    links = [(int(a), int(b)) for a, b in own.integers(0, 100, (70, 2)) if a != b] + [(i, i + 1) for i in range(100, 112)]
    part = {i: {i} for i in name}
    for a, b in links:
        whole = part[a] | part[b]
        for i in whole:
            part[i] = whole
    vertices = spark.createDataFrame([(n, 1) for n in name.values()], "set_hash binary, weight long")
    before = len(list(spark.sparkContext.statusTracker().getJobIdsForGroup(None)))
    got = {bytes(r.set_hash): bytes(r.label) for r in minhash.components(vertices, spark.createDataFrame([(name[a], name[b]) for a, b in links], "a binary, b binary")).collect()}
    assert got == {name[i]: min(name[j] for j in part[i]) for i in name}
    assert not most or len(list(spark.sparkContext.statusTracker().getJobIdsForGroup(None))) - before < 12
    assert minhash.components(vertices, spark.createDataFrame([], "a binary, b binary")).where("label = set_hash").count() == len(name)


def test_estimate():
    a = np.unique(RNG.integers(0, 1 << 62, 1000).astype(np.uint64))
    b = np.concatenate([a[:800], RNG.integers(0, 1 << 62, 200).astype(np.uint64)])
    guess = minhash.estimate(minhash.packed(minhash.minima(a)), minhash.packed(minhash.minima(b)))
    assert abs(guess - 800 / 1200) < 0.15


def test_estimate_column(spark):
    sets = [np.unique(RNG.integers(0, 1 << 40, 300).astype(np.uint64)) for _ in range(3)]
    sets.append(np.concatenate([sets[0][:250], sets[1][:50]]))
    packed = [minhash.packed(minhash.minima(s)) for s in sets]
    rows = spark.createDataFrame([(a.tolist(), b.tolist(), minhash.estimate(a, b)) for a in packed for b in packed], "a array<long>, b array<long>, guess double")
    for r in rows.select("guess", minhash.estimate_column(rows.a, rows.b).alias("got")).collect():
        assert abs(r.guess - r.got) < 1e-9


def test_repeated_passages(docs, none):
    got = {(r.first_doc_id, r.doc_id): r for r in substring.repeated_passages(docs).collect()}
    assert got[0, 1].n_words == 120 and got[0, 1].identity == 1
    assert got[0, 2].n_words == 120 and got[0, 2].identity == pytest.approx(119 / 120)
    assert (got[0, 14].start_word, got[0, 14].end_word) == (60, 130)
    assert not {9, 13} & {d for _, d in got}
    cut = {r.doc_id: r for r in substring.without_repeats(docs).collect()}
    assert 1 not in cut and 2 not in cut and words(cut[14].text) == words(TEXTS[14])[:60] and cut[14].n_chars == len(cut[14].text)
    assert cut[3].text is None and cut[9].text == LONG
    assert substring.repeated_passages(none).count() == 0 and substring.without_repeats(none).count() == 0


def test_chains():
    x = np.array([0, 5, 10, 15, 300, 12])
    y = np.array([100, 105, 110, 115, 20, 40])
    found = substring.chains(x, y)
    assert [0, 1, 2, 3] in [c.tolist() for c in found] and sorted(i for c in found for i in c) == list(range(6))


def test_fifth_of_words_changed(spark):
    rows = []
    for k in range(60):
        w, step = prose(60 + k).split(), (5, 6, 7, 8)[k % 4]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(f"x{i}" if i % step == 4 else v for i, v in enumerate(w)))]
    got = {(r.first_doc_id, r.doc_id) for r in substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(2 * k, 2 * k + 1) for k in range(60)} <= got


def test_parts_in_earlier_documents(spark):
    rows = []
    for k in range(40):
        w = [f"{v}{k}" for v in prose(60).split()]
        w[25:35] = [f"{v}x" if i % 4 == 3 else v for i, v in enumerate(w[25:35])]
        fuzzy = [f"{v}y" if 27 <= i < 33 else v for i, v in enumerate(w)]
        rows += [(4 * k, " ".join(w[:30])), (4 * k + 1, " ".join(w[30:])), (4 * k + 2, " ".join(w)), (4 * k + 3, " ".join(fuzzy))]
    got = {(r.first_doc_id, r.doc_id) for r in substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(4 * k + 2, 4 * k + 3) for k in range(40)} <= got


def test_ties():
    rows = sorted({(s, 10 * s + int(RNG.integers(0, 4)), int(RNG.integers(0, 30))) for s, n in ((1, 9), (2, 1), (3, 6)) for _ in range(n)})
    want = set()
    for i, r in enumerate(rows):
        earlier = [q for q in rows[:i] if q[0] == r[0]]
        if earlier:
            want |= {(q, r) for q in (earlier[0], earlier[-1], *[q for q in earlier if q[1] < r[1]][-1:])}
    there, here = substring.ties(*(np.array(c) for c in zip(*rows, strict=True)))
    got = [(rows[i], rows[j]) for i, j in zip(there, here, strict=True)]
    assert len(got) == len(set(got)) and set(got) == want


def test_planes():
    values = np.array([-5, 0, 1, 2**40 - 1, 2**63 - 1])
    assert (substring.from_planes(substring.planes(values, 8), 8) == values).all()
    assert substring.from_planes(substring.planes(values, 5), 5).tolist() == [2**40 - 5, 0, 1, 2**40 - 1, 2**40 - 1]


def test_best_chain():
    for _ in range(40):
        n = int(RNG.integers(2, 60))
        x, y, more = RNG.integers(0, 500, n), RNG.integers(0, 500, n), RNG.integers(0, 9, n)
        if RNG.random() < 0.7:
            y = x + RNG.integers(-30, 30, n)
            y -= min(0, y.min())
        order, best = sorted(range(n), key=lambda i: (x[i], y[i])), {}
        for i in order:
            best[i] = substring.K + more[i]
            for j in order:
                dx, dy = x[i] - x[j] - more[j], y[i] - y[j] - more[j]
                if j in best and j != i and 0 < dx <= substring.MAX_GAP and 0 < dy <= substring.MAX_GAP:
                    best[i] = max(best[i], substring.K + more[i] + best[j] - substring.GAP * (dx + dy))
        found = substring.chains(x, y, more)
        top = found[0]
        score = sum(substring.K + more[i] for i in top) - substring.GAP * sum(x[j] - x[i] - more[i] + y[j] - y[i] - more[i] for i, j in zip(top, top[1:], strict=False))
        assert score == pytest.approx(max(best.values())) and sorted(i for c in found for i in c) == list(range(n))


def test_two_passages_of_a_pair(spark):
    one, two = prose(600), prose(300)
    rows = [(1, f"{one} {prose(1000)} {two}"), (2, f"{prose(40)} {one} {prose(1000)} {two} {prose(10)}")]
    got = sorted((r.start_word, r.end_word, r.first_start, r.first_end) for r in substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(40, 640, 0, 600), (1640, 1940, 1600, 1900)]


def test_exact_passages_by_brute_force(spark):
    parts = [[f"{v}{k}" for v in prose(int(RNG.integers(30, 90))).split()] for k in range(12)]
    texts = [sum((parts[int(k)] + prose(5).split() for k in RNG.integers(0, 12, int(RNG.integers(1, 5)))), []) for _ in range(40)]
    want, found = set(), set()
    for j, b in enumerate(texts):
        for i in range(j):
            for s in range(len(b) - 49):
                if any(texts[i][t : t + 50] == b[s : s + 50] for t in range(len(texts[i]) - 49) if texts[i][t] == b[s]):
                    want |= {(j, k) for k in range(s, s + 50)}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in substring.repeated_passages(docs).collect():
        a, b = texts[r.first_doc_id][r.first_start : r.first_end], texts[r.doc_id][r.start_word : r.end_word]
        assert (r.first_doc_id, r.first_start) < (r.doc_id, r.start_word) and len(b) >= 50 and r.identity >= 0.8 and len(set(a) & set(b)) > 0.5 * len(set(b))
        found |= {(r.doc_id, k) for k in range(r.start_word, r.end_word)}
    assert want and len(want - found) <= 0.001 * len(want)


@pytest.mark.parametrize("changed", [0, 5, 10, 15, 20])
def test_recall_by_share_of_changed_words(spark, changed):
    rows = []
    for k in range(100):
        w = prose(60 + k).split()
        other = list(w)
        for i in RNG.choice(len(w), changed * len(w) // 100, replace=False):
            other[i] = f"x{i}"
        rows += [(2 * k, f"{prose(30)} {' '.join(w)} {prose(30)}"), (2 * k + 1, f"{prose(20)} {' '.join(other)} {prose(50)}")]
    got = {(r.first_doc_id, r.doc_id) for r in substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum((2 * k, 2 * k + 1) in got for k in range(100)) >= 90


def test_odd_rows_of_passages(spark):
    t = prose(80)
    rows = [(None, t, 1, "a"), (None, t, 1, "a"), (5, t, 2, "b"), (5, t + " more", 2, "c"), (5, t, 2, "d"), (7, None, 3, "e"), (None, None, 3, "f"), (9, "", 4, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id long, spans string")
    got = [(r.first_doc_id, r.doc_id) for r in substring.repeated_passages(docs).collect()]
    assert 2 <= len(got) <= 3 and set(sum(got, ())) <= {None, 5}
    left = substring.without_repeats(docs).collect()
    assert sorted(r.spans for r in left if not r.text) == ["e", "f", "g"] and {tuple(r.asDict()) for r in left} == {("doc_id", "text", "id", "spans")}
    assert sum(t in (r.text or "") for r in left) in (1, 2)


def test_passage_whose_seeds_are_tied_elsewhere(spark):
    """A passage of document 50 is all of document 100; its runs of words are also in documents before and between, which take all ties."""
    w = [f"w{i}" for i in range(60)]
    rows = [(50, " ".join(w)), (100, " ".join(w))]
    for k in range(19):
        for d in (10 + k, 60 + k):
            rows.append((d, " ".join([*(f"x{d}-{i}" for i in range(20)), *w[3 * k : 3 * k + 6], *(f"y{d}-{i}" for i in range(20))])))
    got = substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert [(r.doc_id, r.start_word, r.end_word, r.first_doc_id, r.first_start, r.first_end) for r in got] == [(100, 0, 60, 50, 0, 60)]


def test_open_passages_of_brute_force(spark):
    """Documents of many common lines, dealt at random: all passages of which every fifth word at most is changed are covered, whatever else shares their seeds."""
    r = random.Random(11)
    lines = [[f"l{k}-{i}" for i in range(9)] for k in range(30)]
    rows, planted = [], []
    for d in range(120):
        rows.append((d, [x for _ in range(4) for x in (*r.choice(lines), *(f"u{d}-{r.random()}" for _ in range(12)))]))
    for n in range(12):
        passage = [x for k in r.sample(range(30), 7) for x in lines[k]]
        copy = [f"c{n}-{i}" if i % 9 == 4 else x for i, x in enumerate(passage)]
        for d, own in ((200 + 7 * n, passage), (1000 + n, copy)):
            rows.append((d, [*(f"p{d}-{i}" for i in range(15)), *own, *(f"q{d}-{i}" for i in range(15))]))
        planted.append(1000 + n)
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string").coalesce(1)
    found = {}
    for p in substring.repeated_passages(docs).collect():
        found.setdefault(p.doc_id, set()).update(range(p.start_word, p.end_word))
    assert [d for d in planted if not set(range(20, 70)) <= found.get(d, set())] == []


def test_ties_of_two_runs():
    """Two documents with the same two runs of six seeds are tied once for each first seed, not by all pairs of seeds; one where the runs are too far apart for a passage is not tied."""
    at = np.concatenate([np.arange(6), 60 + np.arange(6)])
    key = np.concatenate([1000 + np.arange(6), 2000 + np.arange(6)]) * 977_777_777
    places = [at, np.concatenate([at[:6], at[6:] + 2]), np.concatenate([at[:6], at[6:] + 120])]
    seeds = [np.concatenate(c).astype(np.int64) for c in ([key] * 3, [np.full(12, d) for d in (1, 2, 3)], [p * 4 + 3 for p in places])]
    dealt = sorted((r for b in substring.own_blocks(*seeds, 1) for r in b.to_pylist()), key=lambda r: r["bucket"])
    keys = pa.Table.from_batches(list(substring.key_blocks([pa.RecordBatch.from_pylist(dealt)], 1)))
    found = pa.Table.from_batches(list(substring.open_ties([pa.RecordBatch.from_pylist(keys.to_pylist())], 1))).to_pylist()
    got = [tuple(v) for r in found for v in zip(*(substring.from_planes(r[c], w).tolist() for c, w in zip("abcd", substring.TIE_WIDTHS, strict=True)), strict=True)]
    assert sorted(got) == sorted((1, 2, x, y) for i in range(6) for x, y in ((i, i), (60, 62)))


@pytest.mark.parametrize("n", [0, 1, 40, 160])
def test_equal_words_by_table(n):
    r = np.random.default_rng(n)
    for _ in range(50):
        a, b = (r.integers(0, 12, max(n + d, 0)).astype("<u2") for d in (0, 3))
        row = [0] * (len(b) + 1)
        for v in a:
            row = list(itertools.accumulate([0, *(max(row[k + 1], row[k] + (w == v)) for k, w in enumerate(b))], max))
        assert substring.between(a, b) == row[-1]


def test_stray_copy_before_a_passage(spark):
    w = prose(60)
    rows = [(0, w), (1, f"{prose(50)} {' '.join(w.split()[:8])} {prose(22)} {w} {prose(20)}")]
    got = [(r.start_word, r.end_word) for r in substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert any(a <= 80 and b >= 140 for a, b in got)


def test_far_chain_displaces_no_near_one():
    x = np.concatenate([np.arange(0, 800, 8), 1000 + np.arange(0, 96, 24)])
    y = np.concatenate([np.arange(0, 800, 8), 1000 + np.arange(0, 96, 24) + np.arange(4)])
    assert list(range(100, 104)) in [c.tolist() for c in substring.chains(x, y)]


def test_fingerprints(docs, none):
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs).collect()}
    order = sorted(range(len(TEXTS)), reverse=True)
    for k, i in enumerate(order):
        t, n = TEXTS[i] or "", TEXTS[order[(k + 1) % len(order)]] or ""
        cut = len(t) // 3
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - cut] + n[:cut]).encode()).hexdigest() and got[i].n_chars == len(t)
    assert got[0].fingerprint == got[1].fingerprint != got[2].fingerprint and got[1].near_next == 1
    assert got[2].near_next > 0.8 > 0.2 > got[9].near_next
    assert fingerprints.fingerprints(none).count() == 0


def test_sketches_merge(spark):
    from pyspark.sql import functions as F

    a, b = prose(500), prose(500)
    hashes = lambda t: fingerprints.shingle_hashes(F.lit(t))
    row = spark.range(1).select(fingerprints.merge(fingerprints.sketch(hashes(a)), fingerprints.sketch(hashes(b))).alias("m"), fingerprints.sketch(F.array_union(hashes(a), hashes(b))).alias("w"), fingerprints.distinct_shingles(fingerprints.sketch(hashes(a))).alias("n"), fingerprints.containment(fingerprints.sketch(hashes(a)), fingerprints.sketch(hashes(a + " " + b))).alias("c")).first()
    assert row.m == row.w and 300 < row.n < 800 and row.c > 0.7


def test_language_model(docs, none):
    tokens = [words((t or "").translate(LOWER)) + ["\n"] for t in TEXTS]
    train = [i for i in range(len(TEXTS)) if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for i in train for w in tokens[i])
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in lm.score_texts(docs).collect()}
    for i, t in enumerate(tokens):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i not in train, len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in t)) and r.score < 0
    assert lm.score_texts(none).count() == 0


def test_class_probabilities_sum_to_one():
    pairs = np.zeros((lm.CLASSES, lm.CLASSES), np.int64)
    pairs[0, 1], pairs[1, 0] = 500, 300
    params = lm.start(pairs)
    every = np.arange(lm.CLASSES)
    for u, w in ((0, 1), (5, 1)):
        p = np.exp(lm.log_probabilities(params, every, [np.full(lm.CLASSES, u), np.full(lm.CLASSES, 9)]))
        assert p.sum() == pytest.approx(1, abs=1e-3) and (u or p[w] > 0.9)


def test_log_probabilities_by_brute_force():
    rng = np.random.default_rng(1)
    r, q, b = params = [rng.normal(0, 0.5, s).astype(np.float32) for s in ((lm.CONTEXT, lm.CLASSES, lm.DIMENSIONS), (lm.CLASSES, lm.DIMENSIONS), (lm.CLASSES,))]
    current, before = rng.integers(0, lm.CLASSES, 300), [rng.integers(0, 4, 300), rng.integers(0, 4, 300)]
    got = lm.log_probabilities(params, current, before, step=7)
    for i in range(300):
        s = [float(b[w] + (r[0][before[0][i]] + r[1][before[1][i]]) @ q[w]) for w in range(lm.CLASSES)]
        assert got[i] == pytest.approx(s[current[i]] - np.log(np.exp(s).sum()), abs=1e-3)
    assert len(lm.log_probabilities(params, current[:0], [c[:0] for c in before])) == 0


def test_contexts():
    before, at = np.array([lm.END, 4, 5, lm.END, lm.END, 7]), np.array([0, 3, 4, 6])
    assert [c.tolist() for c in lm.contexts(before, at)] == [before.tolist(), [lm.END, lm.END, 4, lm.END, lm.END, lm.END]]


def test_gradients_by_differences():
    rng = np.random.default_rng(2)
    params = [rng.normal(0, 0.3, s) for s in ((lm.CONTEXT, lm.CLASSES, lm.DIMENSIONS), (lm.CLASSES, lm.DIMENSIONS), (lm.CLASSES,))]
    current, before, drawn = rng.integers(0, 6, 40), [rng.integers(0, 6, 40), rng.integers(0, 6, 40)], np.array([0, 1, 1, 5])
    shift = rng.normal(0, 1, lm.CLASSES)

    def loss():
        r, q, b = params
        v = r[0][before[0]] + r[1][before[1]]
        own, other = (v * q[current]).sum(1) + b[current] - shift[current], v @ q[drawn].T + b[drawn] - shift[drawn]
        return np.mean(np.log1p(np.exp(-own)) + lm.NOISE / len(drawn) * np.log1p(np.exp(other)).sum(1))

    for p, d in zip(params, lm.gradients(params, current, before, drawn, shift), strict=True):
        for at in ([0, 3, 2], [1, 5, 7], [0, 1, 1]) if p.ndim == 3 else ([1, 3], [5, 0]) if p.ndim == 2 else ([1], [4]):
            at, was = tuple(at), p[tuple(at)]
            p[at] = was + 1e-5
            more = loss()
            p[at] = was - 1e-5
            less = loss()
            p[at] = was
            assert d[at] == pytest.approx((more - less) / 2e-5, abs=1e-4)


def test_model_learns_from_two_tokens():
    """Class 2 or 3 after class 1 depends on the class before it, 4 or 5, which one token of context cannot tell."""
    rng = np.random.default_rng(3)
    which = rng.integers(0, 2, 100_000)
    current = np.stack([4 + which, np.ones_like(which), 2 + which], 1).ravel()
    one = np.concatenate([[lm.END], current[:-1]])
    two = np.concatenate([[lm.END], one[:-1]])
    pairs = np.zeros((lm.CLASSES, lm.CLASSES), np.int64)
    np.add.at(pairs, (one, current), 1)
    params = lm.start(pairs)
    ask = lambda: np.exp(lm.log_probabilities(params, np.array([2, 3, 2, 3]), [np.ones(4, int), np.array([4, 4, 5, 5])]))
    assert ask() == pytest.approx(0.5, abs=0.05)
    lm.descend(params, [np.full_like(p, 1e-8) for p in params], current, [one, two], lm.noise_of(pairs), np.random.default_rng(4), lm.PASS_RATE)
    right, wrong, wrong_too, right_too = ask()
    assert min(right, right_too) > 0.9 and max(wrong, wrong_too) < 0.1


def test_parts_are_folded(spark):
    """Pair counts are the same from one task and from many."""
    texts = spark.createDataFrame([(i, "a b a c") for i in range(20)], "doc_id long, text string").cache()
    none, no_class = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    counts = [lm.pair_counts(texts.repartition(n, "doc_id"), none, no_class) for n in (1, 7)]
    learnt = sum(zlib.crc32(str(i).encode()) % 7 != 2 for i in range(20))
    assert (counts[0] == counts[1]).all() and counts[0].sum() == 5 * learnt


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://A.COM/en/x?q", "https://xcom/en/", "http://www.example.com/en/72#a", "http://example.net/de/9", "http://example.net/de/8", "http://com/en/", "ftp://a..org/es/", "http://a.org", "x://a.org/ES/"]
    got = [tuple(r) for r in url_filter.url_filter(spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")).orderBy("page_id").collect()]
    assert [g[3] for g in got] == [None, None, None, "com/en/", None, "example.com/en/7", "net/de/", "example.net/de/8", "com/en/", "org/es/", None, None]
    assert [g[4] == "block" for g in got] == [i in (3, 6, 8, 9) for i in range(12)] and got[3][1:3] == ("a.com", "/en/x")
    assert url_filter.url_filter(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_cascade_is_exact(spark):
    from pyspark.sql import functions as F

    universe = spark.range(20000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where("hash(key) % 40 = 0")
    levels = url_filter.build_cascade(listed, universe)
    found = universe.where(url_filter.is_listed(levels, F.col("key")))
    assert len(levels) > 1 and found.exceptAll(listed).count() == 0 == listed.exceptAll(found).count()


def test_verdicts_come_from_the_cascades(spark, monkeypatch):
    from pyspark.sql import functions as F

    pages = spark.createDataFrame([(i, f"http://{h}.{t}/{p}/{k}") for i, (h, t, p, k) in enumerate((h, t, p, k) for h in ("a", "example", "b.example") for t in ("com", "net", "org") for p in ("en", "de", "es") for k in range(10))], "page_id long, url string")
    rules = [("block", f"{h}.com", f"/{p}/{k}") for h in ("a", "example") for p in ("en", "de") for k in range(10) if k % 3] + [("allow", "b.example.com", "/en/1"), ("block", "org", "")]
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.url_filter(pages, rules).collect()}
    for r in pages.collect():
        host, path = r.url[7:].split("/", 1)
        fit = [(len(h) + len(p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and f"/{path}".startswith(p)]
        assert got[r.page_id] == (max(fit)[2:] if fit else (None, "allow"))
    assert url_filter.url_filter(pages, []).where("rule IS NULL AND verdict = 'allow'").count() == 270
    monkeypatch.setattr(url_filter, "is_listed", lambda levels, key: F.lit(False))
    assert url_filter.url_filter(pages, rules).where("rule IS NOT NULL OR verdict = 'block'").count() == 0


def test_mix(spark, docs, none, labels):
    rows = [(i, prose(int(RNG.integers(1, 60))), [None, "b", "a", "c"][min(3, i % 7)]) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(table, labels).collect()
    by, largest = defaultdict(list), 60
    for r in got:
        by[r.source].append(r)
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 2 * r.size
    for own in by.values():
        assert abs(sum(r.taken for r in own) - own[0].target) <= largest and own[0].source_size == sum(r.size for r in own)
    assert sum(own[0].target for own in by.values()) == pytest.approx(1.5 * sum(r.size for r in got))
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(table.repartition(7), labels).collect()))
    assert len(mixing.mix(docs, labels).collect()) == len(TEXTS) and mixing.mix(none, labels).count() == 0
    assert sum(len(words(r.text)) for r in mixing.mixed_documents(table, labels).collect()) == sum(r.taken for r in got)


def test_mix_by_brute_force(spark):
    from pyspark.sql import functions as F

    rows = [(i // 2 if i < 20 else i, (f"{prose(int(RNG.integers(1, 40)))} " + "### $$$ " * 9 * (i % 3 == 0)) if i % 9 else None, "ab"[i % 2] if i % 11 else None) for i in range(300)]
    table = spark.createDataFrame([*rows, rows[30], (None, rows[31][1], "a")], "doc_id long, text string, source string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(20, 300, 2)], "doc_id long, quality int, toxic int")
    got = mixing.mix(table, labels).collect()
    hashes = {(r.doc_id, r.text): r.h for r in table.select("doc_id", "text", F.xxhash64("doc_id", "text", F.lit(mixing.SEED)).alias("h")).collect()}
    sizes, want = defaultdict(list), []
    scored = {(r.doc_id, r.text): r for r in mixing.sized(table.withColumn("copy", F.col("text")), labels, ("copy",), mixing.SEED).withColumnRenamed("copy", "text").collect()}
    for r in table.collect():
        q = scored[r.doc_id, r.text]
        u = (hashes[r.doc_id, r.text] % (1 << 52) + 0.5) / (1 << 52)
        sizes[r.source].append((-(u ** (1 / q.quality)), -1 if r.doc_id is None else r.doc_id, len(words(r.text))))
    for s, n, t in mixing.targets([(s, sum(x[2] for x in own)) for s, own in sizes.items()]):
        epochs, run = (int(t // n) if n else 0), 0
        for _, i, size in sorted(sizes[s]):
            run += size
            want.append((s or "", i, size, size * (epochs + (run - size / 2 <= t - epochs * n))))
    assert sorted((r.source or "", -1 if r.doc_id is None else r.doc_id, r.size, r.taken) for r in got) == sorted(want)
    assert min(r.quality for r in got) >= 0.05 and len(got) == 302
    by = {r.doc_id: r.quality for r in got if r.doc_id and r.doc_id >= 20 and r.size}
    assert np.mean([q for i, q in by.items() if i % 3]) > 0.2 + np.mean([q for i, q in by.items() if i % 3 == 0])


def test_mixed_rows(spark, labels):
    rows = [(1, "a b", "s", 1, 2), (1, "a b", "s", 1, 2), (1, "c d e", "s", 1, 2), (None, "f", "s", 1, 2), (2, None, "t", 1, 2), (3, "g " * 50, "t", 1, 2)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, times int, time int")
    got = Counter(map(tuple, mixing.mixed_documents(table, labels).collect()))
    taken = Counter()
    for r in mixing.mix(table, labels).collect():
        taken[r.doc_id, r.size] += r.taken
    assert all(sum(n * len(words(r[1])) for r, n in got.items() if (r[0], len(words(r[1]))) == key) == t for key, t in taken.items()) and set(got) <= set(rows)


def test_targets():
    assert [t for *_, t in mixing.targets([("b", 100), ("a", 10), (None, 90)])] == [20.0, pytest.approx(186.6666, abs=1e-3), pytest.approx(93.3333, abs=1e-3)]
    assert mixing.targets([]) == [] and mixing.targets([("a", 0)]) == [("a", 0, 0.0)]
