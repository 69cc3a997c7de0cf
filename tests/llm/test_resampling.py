import math
import random
import re
from collections import Counter

import numpy as np

from pitchline.llm import resampling
from tests.llm.helpers import documents, edge_documents, labels

VOCABULARY = [f"w{i}" for i in range(300)]


def corpus(spark, n=1500):
    random.seed(3)
    docs, marks = [], []
    for i in range(n):
        text = [random.choice(VOCABULARY) for _ in range(80)]
        bad = i % 5 == 0
        if bad:
            for k in range(0, 80, 7):
                text[k] = random.choice(["spam", "junk"])
        elif i % 11 == 0:
            text = [text[0]] * 80
            bad = True
        docs.append((i, " ".join(text)))
        if i % 2:
            marks.append((i, int(not bad), 0))
    return documents(spark, docs), labels(spark, marks), {i for i in range(n) if i % 5 == 0 or i % 11 == 0}


def test_rejects_what_the_target_lacks(spark):
    docs, marks, bad = corpus(spark)
    got = resampling.resample(docs, marks).collect()
    kept = {r.doc_id for r in got if r.kept}
    assert len(got) == 1500
    assert len(kept - bad) >= 0.97 * (1500 - len(bad))
    assert len(bad - kept) >= 0.9 * len(bad)
    again = resampling.resample(docs.repartition(7), marks).collect()
    assert {(r.doc_id, r.gumbel_key, r.kept) for r in again} == {(r.doc_id, r.gumbel_key, r.kept) for r in got}


def test_counts_cover_all_documents(spark):
    docs = documents(spark, [(i, "alpha beta alpha") for i in range(50)])
    got = resampling.bucket_counts(docs.repartition(5), np.arange(20), 18).toPandas()
    assert set(got["raw"]) == {50} and set(got["target"]) == {20}
    assert len(got) == 4                                # alpha, beta, "alpha beta", "beta alpha"; copies share a fold


def test_edges(spark):
    docs = edge_documents(spark)
    none = labels(spark, [])
    got = resampling.resample(docs, none).collect()
    assert len(got) == 12 and all(r.kept and r.log_weight == 0 for r in got)
    some = labels(spark, [(3, 1, 0), (3, 1, 0), (4, 1, None), (None, 1, 0), (5, 0, 1)])
    assert resampling.resample(docs, some).count() == 12
    assert resampling.resample(docs.filter("false"), some).count() == 0
    kept = resampling.drop_rejected(docs, some)
    assert kept.columns == docs.columns and kept.filter("doc_id is null").count() == 2


def test_cut_off_is_exact_for_keys_of_any_size(spark):
    random.seed(8)
    for scale in (0.1, 30.0, 5000.0, 1e7):
        keys = [random.gauss(-scale, scale) for _ in range(997)] + [-3 * scale] * 30
        frame = spark.createDataFrame([(k,) for k in keys], "gumbel_key double")
        for keep in (0.5, 0.97, 0.99, 1.0):
            assert resampling._line(frame, keep) == sorted(keys, reverse=True)[math.ceil(keep * len(keys)) - 1]


def test_long_texts_are_rejected_too(spark, monkeypatch):
    docs = documents(spark, [(i, "x") for i in range(1000)])
    scored = spark.createDataFrame([(i, -float(i), -1000.0 - i, i % 2 == 0) for i in range(1000)],
                                   "doc_id long, log_weight double, gumbel_key double, is_target boolean")
    monkeypatch.setattr(resampling, "weights", lambda *a: scored)
    got = resampling.resample(docs, labels(spark, [])).collect()
    assert {r.doc_id for r in got if r.kept} == set(range(989))


M64 = (1 << 64) - 1


def brute_mix(h):
    h ^= h >> 33
    h = h * 0xFF51AFD7ED558CCD & M64
    h ^= h >> 33
    h = h * 0xC4CEB9FE1A85EC53 & M64
    return h ^ h >> 33


def brute_range(values):
    """Hash of a run of whole numbers by its definition, without running sums."""
    total = sum(v * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, v in enumerate(values))
    return brute_mix((total + len(values) * 0x632BE59BD9B4E019) & M64)


def brute_ngrams(text, bits):
    tokens = re.findall(rb"[0-9A-Za-z_\x80-\xff]+|[^0-9A-Za-z_\x80-\xff\x20\x09-\x0D]+", (text or "").encode())
    h = [brute_range([b + 1 + 32 * (65 <= b <= 90) for b in t]) for t in tokens]
    word = [bool(re.match(rb"[0-9A-Za-z_\x80-\xff]", t)) for t in tokens]
    grams = h + [brute_mix((a * 0x9E3779B97F4A7C15 + b) & M64) for a, b in zip(h, h[1:])]
    for step in (1, 2):
        said = [i >= step and h[i] == h[i - step] and word[i] for i in range(len(h))]
        grams += [brute_mix(step) for i in range(3 * step, len(h)) if said[i] and said[i - step] and said[i - 2 * step]]
    runs = [brute_range(h[i:i + 4]) for i in range(len(h) - 3)] or h
    return [g >> 64 - bits for g in grams], brute_mix(min(runs)) % 2 if runs else 0


def brute(docs, marks, s, keep=0.99):
    """Counts, weights, keys and the kept rows of a table, all in plain Python."""
    good = {i for i, q, t in marks if q == 1 and t == 0}
    grams = {i: brute_ngrams(t, s.bits) for i, t in docs}
    counts = {f: (Counter(), Counter()) for f in (0, 1)}
    for i, (g, f) in grams.items():
        counts[f][1].update(set(g))
        if i in good:
            counts[f][0].update(set(g))
    model = {}
    for f in (0, 1):
        t, r = counts[1 - f]
        share = sum(t.values()) / sum(r.values())
        ratio = {b: math.log((t[b] + s.prior) / (r[b] * share + s.prior)) for b in range(1 << s.bits)}
        half, run = sum(r.values()) / 2, 0
        for b in sorted(ratio, key=lambda b: (ratio[b], b)):
            run += r[b]
            if run >= half:
                middle = ratio[b]
                break
        model[f] = {}
        for b, x in ratio.items():
            at = r[b] * share * math.exp(middle)
            clear = abs(t[b] - at) > s.z * math.sqrt(at + 1) and abs(x - middle) > s.slack
            model[f][b] = x - middle if clear else 0.0
    rows = {}
    for i, (g, f) in grams.items():
        u = ((brute_mix((brute_mix(i + 1) + s.seed) & M64) >> 12) + 0.5) / 2 ** 52
        weight = sum(model[f][b] for b in g)
        rows[i] = (weight, weight - math.log(-math.log(u)))
    targets = sorted((rows[i][1] for i in rows if i in good), reverse=True)
    line = targets[math.ceil(keep * len(targets)) - 1]
    return {i: (w, k, k >= line) for i, (w, k) in rows.items()}, counts


def test_weights_keys_and_rows_kept_against_brute_force(spark):
    settings = resampling.Settings(bits=10, z=1.0, slack=0.2)
    docs, marks, _ = corpus(spark, 400)
    odd = [(1000, None), (1001, ""), (1002, "Spam spam SPAM spam junk, junk ! a b a b a b a b"), (1003, "\u00e9t\u00e9 one"), (1004, "x " * 3000)]
    docs = docs.unionByName(documents(spark, odd))
    rows, labelled = [(r.doc_id, r.text) for r in docs.collect()], [tuple(r) for r in marks.collect()]
    want, counts = brute(rows, labelled, settings)
    got = {r.doc_id: r for r in resampling.resample(docs, marks, settings=settings).collect()}
    assert set(got) == set(want)
    for i, (weight, key, kept) in want.items():
        assert abs(got[i].log_weight - weight) < 1e-4 * max(1, abs(weight)) and abs(got[i].gumbel_key - key) < 1e-4 * max(1, abs(key))
        assert got[i].kept == kept
    assert 0 < sum(not kept for *_, kept in want.values()) < len(want)
    sent = resampling.bucket_counts(docs, np.sort([i for i, q, t in labelled if q == 1 and t == 0]), 10).collect()
    assert {r["at"]: (r["target"], r["raw"]) for r in sent} == {
        f * 1024 + b: (counts[f][0][b], n) for f in (0, 1) for b, n in counts[f][1].items()}
