import hashlib
import random
from collections import Counter

import numpy as np

from pitchline.llm import substring_dedup as S
from pitchline.llm.fm_index import FMIndex, repeated, windows_of
from tests.llm.helpers import documents, edge_documents, rows, words


def brute(docs, window=35):
    texts = [(d, words(t)) for d, t in docs]
    seen = Counter(tuple(w[i:i + window]) for _, w in texts for i in range(len(w) - window + 1))
    out = []
    for d, w in texts:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def compare(spark, docs, **parameters):
    got = S.drop_repeated_substrings(documents(spark, docs).repartition(5), **parameters).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted((tuple(r)[:4] for r in got), key=key) == sorted(brute(docs, parameters.get("window", 35)), key=key)


def test_backward_search_counts_occurrences():
    random.seed(6)
    pieces = [[random.randrange(5) for _ in range(random.randrange(1, 40))] for _ in range(60)]
    weights = [random.randrange(1, 4) for _ in pieces]
    flat, lengths = np.array([w for p in pieces for w in p], np.uint64), np.array([len(p) for p in pieces])
    index = FMIndex(flat, lengths, np.array(weights), 40)
    for _ in range(200):
        query = [random.randrange(5) for _ in range(random.randrange(1, 6))]
        low, high = np.array([0]), np.array([index.size])
        for c in reversed(query):
            low, high = index.step(np.array([int(np.flatnonzero(index.alphabet == c)[0]) + 1]), low, high)
        want = sum(w * sum(p[i:i + len(query)] == query for i in range(len(p) - len(query) + 1)) for p, w in zip(pieces, weights))
        assert (index.occurrences(low, high)[0] if high[0] > low[0] else 0) == want


def test_reported_runs_are_all_repeated_windows():
    random.seed(7)
    for alphabet in (2, 3, 50):
        pieces = [[random.randrange(alphabet) for _ in range(random.randrange(1, 30))] for _ in range(40)]
        pieces += [p[2:] + [1, 0, 1] for p in pieces[::3]]
        weights = [random.choice([1, 1, 1, 2]) for _ in pieces]
        window = 6
        seen = Counter()
        for p, w in zip(pieces, weights):
            for i in range(len(p) - window + 1):
                seen[tuple(p[i:i + window])] += w
        want = {(k, i) for k, p in enumerate(pieces) for i in range(len(p) - window + 1) if seen[tuple(p[i:i + window])] > 1}
        which, low, high = repeated(np.array([c for p in pieces for c in p], np.uint64), np.array([len(p) for p in pieces]), np.array(weights), window)
        got = set(zip(np.repeat(which, high - low + 1).tolist(), windows_of(low, high).tolist()))
        assert got == want


def test_query_against_brute_force(spark):
    compare(spark, [(r[0], r[1]) for r in rows(spark)])


def planted():
    random.seed(8)
    word = lambda: f"w{random.randrange(400)}"
    passage = [word() for _ in range(60)]
    docs = []
    for i in range(60):
        w = [word() for _ in range(random.randrange(0, 120))]
        if i % 2:
            a, b = random.randrange(0, 25), random.randrange(35, 60)
            at = random.randrange(0, len(w) + 1)
            w = w[:at] + passage[a:b] + w[at:]
        if i % 7 == 0:
            w += ["z"] * 50
        docs.append((i, " ".join(w)))
    return docs


def test_shared_passages_with_small_shards_and_hot_keys(spark, monkeypatch):
    compare(spark, planted())
    compare(spark, planted(), hot=5)
    compare(spark, planted(), window=12, anchor=4)
    monkeypatch.setattr(S, "SHARD_WORDS", 100)
    compare(spark, planted())


def test_edges(spark):
    docs = edge_documents(spark)
    got = S.drop_repeated_substrings(docs, window=6, anchor=3)
    assert got.count() == 12
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted((tuple(r)[:4] for r in got.collect()), key=key) == sorted(brute(plain, 6), key=key)
    assert S.drop_repeated_substrings(docs.filter("false")).count() == 0
