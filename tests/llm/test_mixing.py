from pyspark.sql import functions as F

from pitchline.llm import mixing as M
from tests.llm.helpers import documents, edge_documents

LEVELS = ("domain", "lang", "source")


def leaves(spark, rows):
    return spark.createDataFrame(rows, "domain string, lang string, source string, supply long")


def plan(spark, rows, budget, weights, epochs=1):
    return {(r.domain, r.lang, r.source): r.budget for r in M.budgets(leaves(spark, rows), budget, LEVELS, weights, epochs).collect()}


def test_shortage_goes_to_siblings_before_ancestors(spark):
    rows = [("a", "en", "s1", 100), ("a", "en", "s2", 1000), ("a", "de", "s3", 1000), ("b", "en", "s4", 5000)]
    got = plan(spark, rows, 2000, {})
    # a and b get 1000 each; en and de of a 500 each; s1 has only 100, its sibling s2 takes the other 400
    assert got == {("a", "en", "s1"): 100, ("a", "en", "s2"): 400, ("a", "de", "s3"): 500, ("b", "en", "s4"): 1000}
    rows[1] = ("a", "en", "s2", 200)
    # en of a lacks 200: de of a takes them, b nothing
    assert plan(spark, rows, 2000, {}) == {("a", "en", "s1"): 100, ("a", "en", "s2"): 200, ("a", "de", "s3"): 700, ("b", "en", "s4"): 1000}
    rows[2] = ("a", "de", "s3", 300)
    # a as a whole lacks 400: b takes them
    assert plan(spark, rows, 2000, {})[("b", "en", "s4")] == 1400


def test_weights_epochs_and_scarcity(spark):
    rows = [("a", "en", "s1", 1000), ("b", "en", "s2", 1000), ("c", "en", "s3", 1000)]
    assert plan(spark, rows, 900, {"domain": {"a": 6, "b": 3, "c": 0}}) == {("a", "en", "s1"): 600, ("b", "en", "s2"): 300}
    assert plan(spark, rows, 10 ** 6, {}, 3) == {("a", "en", "s1"): 3000, ("b", "en", "s2"): 3000, ("c", "en", "s3"): 3000}


def brute(docs, seed, whole, rest):
    import hashlib
    order = sorted(docs, key=lambda d: hashlib.md5(f"{seed}/{whole}/{d[0]}".encode()).hexdigest())
    total, more = 0, set()
    for d, n in order:
        total += n
        if total > rest:
            break
        more.add(d)
    return {d: whole + (d in more) for d, _ in docs}


def test_prefix_of_the_seeded_epoch(spark):
    docs = [(i, "w " * (i % 17 + 1)) for i in range(300)]
    sizes = [(i, i % 17 + 1) for i, _ in docs]
    supply = sum(n for _, n in sizes)
    for budget in (supply // 3, supply + 57, 2 * supply):
        frame = documents(spark, docs).withColumn("domain", F.lit("d"))
        got = M.mix(frame, budget=budget, weights={}, max_epochs=2).groupBy("doc_id").count().collect()
        want = brute(sizes, 11, budget // supply, budget % supply)
        assert {r.doc_id: r["count"] for r in got} == {d: n for d, n in want.items() if n}


def test_edges(spark):
    docs = edge_documents(spark)
    got = M.mix(docs, share=(1, 1), max_epochs=1)
    assert got.filter("n_tokens > 0").count() == docs.filter("text rlike '[^ \\\\s]'").count()
    assert M.mix(docs.filter("false")).count() == 0
    assert M.mix(docs.filter("text is null")).count() == 0
    kept = M.keep_mixed(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id is null").count() == 0
