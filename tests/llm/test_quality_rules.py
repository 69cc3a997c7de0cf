import math

from pyspark.sql import functions as F

from pitchline.llm import quality_rules as Q
from tests.llm.helpers import documents, edge_documents, labels, words


def brute(text):
    w = words(text)
    seen = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i:i + 3]), []).append(i)
    covered = {i + k for places in seen.values() if len(places) > 1 for i in places for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(c in Q.SYMBOLS for c in text or ""), len(lines) - len(set(lines)), len(covered), len(lines))


def test_statistics_against_brute_force(spark):
    texts = ["a b c a b c d", "a a a a a", "x\ny\nx\n\n \n y", "é# $ü\x0b|", "", None, "p q", "1 2 3 9 1 2 3 9 2 3 1"]
    docs = documents(spark, list(enumerate(texts)))
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_lines) for r in Q.statistics(docs).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_allowed_rejections_are_exact_binomial_tests(spark):
    cases = [(n, rate, delta) for n in (10, 200, 1500) for rate in (0.004, 0.05) for delta in (0.05, 0.001)]

    def want(n, rate, delta):
        below, k = 0.0, -1
        for j in range(n + 1):
            below += math.comb(n, j) * rate ** j * (1 - rate) ** (n - j)
            if below > delta:
                break
            k = j
        return k

    frame = spark.createDataFrame(cases, "n long, rate double, delta double")
    got = {(r.n, r.rate, r.delta): r.k for r in frame.withColumn("k", Q.allowed_rejections(F.col("n"), F.col("rate"), F.col("delta"))).collect()}
    assert got == {c: want(*c) for c in cases}


def test_false_rejections_stay_below_the_risk(spark):
    good = " ".join(f"{w}{i}" for i, w in enumerate(["alpha", "beta", "gamma"] * 30))
    docs = [(i, good + (" ##" if i % 400 == 0 else "")) for i in range(4000)] + [(10_000 + i, good + " #$%" * 40) for i in range(200)]
    marks = [(i, 1, 0) for i in range(0, 4000, 2)]
    got = Q.assess(documents(spark, docs), labels(spark, marks)).collect()
    assert all(not r.kept for r in got if r.doc_id >= 10_000)
    assert sum(not r.kept for r in got if r.doc_id < 10_000) <= 0.02 * 4000


def test_edges(spark):
    docs = edge_documents(spark)
    got = Q.assess(docs, labels(spark, [(3, 1, 0), (3, 0, 0), (None, 1, 1), (4, None, None)])).collect()
    assert len(got) == 12
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by_id[1].n_words == 0 and by_id[1].base_failed and not by_id[1].kept
    assert by_id[7].n_dup_lines == 2999 and by_id[7].n_repeat_words == 3000
    assert Q.assess(docs.filter("false"), labels(spark, [])).count() == 0
    assert Q.assess(docs, labels(spark, [])).filter("not base_failed and not kept").count() == 0
