import random
import re
from collections import Counter, defaultdict

from pitchline.llm import phrases as P
from tests.llm.helpers import SF_DIR, documents, edge_documents


def brute_counts(rows, longest=4):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    return counts, totals


def brute(rows, least=30, best=2000):
    counts, totals = brute_counts(rows)
    out = []
    for lang, f in counts.items():
        candidates = {p: n for p, n in f.items() if len(p) > 1 and n >= least}
        inside = Counter()
        for p, n in candidates.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    inside[p[i:i + size]] = max(inside[p[i:i + size]], n)
        scored = []
        for p, a in candidates.items():
            if p in inside and 100 * inside[p] >= 80 * a:
                continue
            score, _, l, r = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(scored)[:best], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


def test_query_against_brute_force(spark):
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    got = P._query(spark, SF_DIR)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute(rows)
    assert len(want) >= 50 and sorted(tuple(r) for r in got.collect()) == want


def test_failures_of_the_border_are_expanded(spark, monkeypatch):
    """Phrases that a sample of one document can't propose: every count must come from further passes."""
    passes, plain = [], P.counts
    monkeypatch.setattr(P, "counts", lambda *a: passes.append(a[-1]) or plain(*a))
    rng = random.Random(4)
    rows = [(i, "alpha beta gamma delta, " * rng.randrange(3) + " ".join(rng.choices("abcdefgh", k=30)) + ".\tALPHA  beta", "en", "s")
            for i in range(60)]
    rows += [(100 + i, "un deux trois quatre cinq", None, "s") for i in range(30)]
    docs = documents(spark, rows)
    for share in (0.0, 0.02, 1.0):
        passes.clear()
        got = P.frequent(docs, share=share)
        f, totals = brute_counts([(r[2], r[1]) for r in rows])
        want = {(lang, len(p), " ".join(p), n) for lang, c in f.items() for p, n in c.items() if n >= 30}
        want |= {(lang, 0, "", n) for lang, n in totals.items()}
        assert {tuple(r) for r in got.collect()} == want
        assert len(passes) == 2 if share == 1.0 else len(passes) >= 4
    assert sorted(tuple(r) for r in P.collocations(got).collect()) == brute([(r[2], r[1]) for r in rows])


def test_limit_nesting_ties_and_odd_rows(spark):
    rows = [(i, "x y z w. x y! b a\nb a, A\tB c\x0bd " + "é ü ö " * 2, "en", "s") for i in range(31)] + [(None, None), (None, ""), (7, " . ,")]
    docs = documents(spark, rows)
    want = brute([((r + ("en",))[2], r[1]) for r in rows])
    assert sorted(tuple(r) for r in P.collocations(P.frequent(docs)).collect()) == want
    best = P.collocations(P.frequent(docs), best=2).collect()
    assert sorted(tuple(r) for r in best) == [r for r in want if r[1] <= 2]
    edge = edge_documents(spark)
    assert sorted(tuple(r) for r in P.collocations(P.frequent(edge)).collect()) == brute([(r.lang, r.text) for r in edge.collect()])
    assert P.collocations(P.frequent(edge.filter("false"))).count() == 0


def test_scores_beyond_64_bits(spark):
    big = 2 ** 62
    found = spark.createDataFrame([("en", 0, "", big), ("en", 1, "a", big), ("en", 1, "b", big - 1), ("en", 2, "a b", big - 5)],
                                  "lang string, words int, phrase string, n long")
    assert [tuple(r) for r in P.collocations(found).collect()] == [
        ("en", 1, "a b", big - 5, big, big - 1, big, 2_000_000 * (big - 5) // (2 * big - 1))]


def test_few_bits_only_cost_counts(spark, monkeypatch):
    monkeypatch.setattr(P, "LEAST_BITS", 1 << 16)
    monkeypatch.setattr(P, "MOST_BITS", 1 << 16)
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.4)) % 3000}" for _ in range(400))) for i in range(100)]
    got = P.frequent(documents(spark, rows), least=5)
    f, totals = brute_counts([("en", r[1]) for r in rows])
    want = {("en", len(p), " ".join(p), n) for p, n in f["en"].items() if n >= 5} | {("en", 0, "", totals["en"])}
    assert {tuple(r) for r in got.collect()} == want
