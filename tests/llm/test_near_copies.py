import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from tests.llm.helpers import SF_DIR, Union, documents, edge_documents, rows, words


def brute(docs, size=5, least=0.8):
    def shingles(text):
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        return {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()

    sets, union = [(i, shingles(t)) for i, t in docs], Union()
    for n, (a, x) in enumerate(sets):
        union.find(a)
        for b, y in sets[:n]:
            if len(x & y) >= least * len(x | y):
                union.join(a, b)
    return {union.find(i) for i, _ in docs}


def copies(n_bases, n_copies, changes):
    random.seed(11)
    docs = []
    for _ in range(n_bases):
        base = [f"w{random.randrange(5000)}" for _ in range(200)]
        for k in range(n_copies):
            text = list(base)
            for at in random.sample(range(200), changes(k)):
                text[at] = f"x{random.randrange(10 ** 6)}"
            docs.append((len(docs), " ".join(text)))
    return docs


def test_one_replaced_word_is_a_near_copy(spark):
    docs = copies(20, 2, lambda k: k)
    kept = {r.doc_id for r in C.near_dedup(spark, documents(spark, docs), SF_DIR).collect()}
    assert kept == set(range(0, 40, 2))


def test_stage_against_brute_force_jaccard(spark):
    docs = copies(12, 14, lambda k: k % 10)
    kept = {r.doc_id for r in C.near_dedup(spark, documents(spark, docs), SF_DIR).collect()}
    assert kept == brute(docs)
    whole = [(r[0], r[1]) for r in rows(spark)]
    kept = {r.doc_id for r in C.near_dedup(spark, documents(spark, whole), SF_DIR).collect()}
    assert kept == brute(sorted(whole))


def test_edges(spark):
    docs = edge_documents(spark)
    kept = C.near_dedup(spark, docs, SF_DIR)
    assert sorted(kept.columns) == sorted(docs.columns)
    assert sorted(r.doc_id for r in kept.filter("doc_id is not null").collect()) == [0, 3, 4, 4, 6, 7]
    assert kept.filter("doc_id is null").count() == 2
    assert C.near_dedup(spark, docs.filter("false"), SF_DIR).count() == 0


def test_crowded_bands_of_copies_that_are_unlike_each_other(spark):
    """Over a hundred copies of a text, each at 0.81 to it and 0.66 to one another: of what brute force joins nine tenths at least are joined."""
    docs = copies(2, 120, lambda k: 4 if k else 0)
    want = brute(docs)
    kept = {r.doc_id for r in C.near_dedup(spark, documents(spark, docs), SF_DIR).collect()}
    assert want <= kept and len(docs) - len(kept) >= 0.9 * (len(docs) - len(want))


def test_simhash_links_are_looked_at(spark, monkeypatch):
    """Operator 8's links are held against the similarity whatever the bands propose; one of equal fingerprints stands for all."""
    from pitchline.llm import near_copies as N
    from pitchline.llm.simhash import fingerprint

    apart = lambda a, b: (fingerprint(a.encode()) ^ fingerprint(b.encode()) & (2**64 - 1)).bit_count()
    base = " ".join(f"w{i * 7919 % 1009}" for i in range(400))
    near = next(t for i in range(2000) if 0 < apart(base, t := f"{base} x{i}") <= 2)
    far = " ".join(f"v{i * 31 % 997}" for i in range(400))
    rows = [(5, base), (2, near), (9, base), (None, base), (7, far), (8, ""), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    none = spark.createDataFrame([], "a long, b long"), spark.createDataFrame([], "key long, k long, c long")
    monkeypatch.setattr(N, "_pairs", lambda members, turn: none)
    got = {(r.doc_id, r.component_id) for r in N.near_copies(docs).collect()}
    assert got == {(5, 2), (2, 2), (9, 2), (None, 2), (7, 7), (8, 4), (4, 4)}


def test_a_pair_is_looked_at_once_and_only_across_groups(spark, monkeypatch):
    """Copies of two texts, crowded enough for all turns: what a turn proposes was neither joined nor proposed before. Its tables don't stay."""
    from pitchline.llm import near_copies as N

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    proposed, stored, before = [], N.materialize, spark.conf.get(key, "false")

    def kept(df, name="table", **more):
        table = stored(df, name, **more)
        if name == "likely":
            proposed.append({(r.a, r.b) for r in table.collect()})
        if name in ("met", "shingles", "linked"):
            tables.append(table)
        if name == "linked":
            links.append({(r.a, r.b) for r in table.collect()})
        return table

    tables, links = [], []
    monkeypatch.setattr(N, "materialize", kept)
    docs = copies(2, 60, lambda k: 3 + k % 3 if k else 0)
    N.near_copies(documents(spark, docs)).count()
    assert len(proposed) > 2 and any(proposed[1:])
    union, seen = Union(), set()
    for pairs, linked in zip(proposed, links, strict=True):
        assert not pairs & seen and all(union.find(a) != union.find(b) for a, b in pairs)
        seen |= pairs
        for a, b in linked:
            union.join(a, b)
    folder = spark._jvm.org.apache.hadoop.fs.Path
    left = [f for t in tables for f in t.inputFiles() if folder(f).getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder(f))]
    assert not left and spark.conf.get(key, "false") == before


def test_pairs_below_the_similarity_are_ruled_out_by_signatures(spark, monkeypatch):
    """Copies at 0.59 to one another and 0.77 to their text share bands: after the first turn no more pairs than copies get a look."""
    from pitchline.llm import near_copies as N

    turns, stored = [], N.materialize

    def kept(df, name="table", **more):
        table = stored(df, name, **more)
        if name == "likely":
            turns.append(table.count())
        return table

    monkeypatch.setattr(N, "materialize", kept)
    docs = copies(1, 80, lambda k: 5 if k else 0)
    got = {r.doc_id for r in N.drop_near_copies(documents(spark, docs)).collect()}
    assert got == brute(docs)
    assert len(turns) > 1 and sum(turns[1:]) <= 80, turns


def test_small_bands_are_settled_across_batches(spark):
    """Bands of several sizes, in Arrow batches of any length: the pairs found are those of brute force over marks."""
    import random

    from pitchline.llm import near_copies as N

    random.seed(3)
    texts = {k: [random.randrange(100) for _ in range(N.LONG)] for k in range(8)}
    near = {k: texts[k % 4][:-200 * (k // 4)] + texts[k][N.LONG - 200 * (k // 4):] if k >= 4 else texts[k] for k in range(8)}
    sets = spark.createDataFrame([(k, 100 if k != 5 else 50, near[k]) for k in range(8)], "k long, n long, marks array<tinyint>")
    bands = [(key, [random.randrange(8) for _ in range(1 + key % 7)]) for key in range(300)]
    rows = [(key, k, 0 if k in (2, 6) else k, len(set(ks))) for key, ks in bands for k in set(ks)]
    met = spark.createDataFrame(rows, "key long, k long, c long, m long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = {(r.a, r.b) for r in N._within(met, sets, 1, 0.8).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(512))
    assert got == {(0, 4), (3, 7)}


@pytest.mark.parametrize("block", [4 << 20, 60_000])
def test_no_pair_of_a_crowded_band_is_left_out(spark, monkeypatch, block):
    """Pairs at 0.81 in a band of over a hundred texts unlike each other, one of them with many copies: brute force over the band finds no more."""
    from pitchline.llm import near_copies as N

    for name, value in (("BANDS", 1), ("ROWS", 1), ("BLOCK", block)):
        monkeypatch.setattr(N, name, value, raising=False)
    random.seed(5)

    def changed(text, n):
        text = list(text)
        for at in random.sample(range(200), n):
            text[at] = f"x{random.randrange(10 ** 6)}"
        return text

    base, texts = [f"w{random.randrange(5000)}" for _ in range(200)], []
    for k in range(120):
        texts.append(changed(base, 10))
        texts += [changed(texts[-1], 4)] + [changed(texts[-1], 1) for _ in range(40 if not k else 0)]
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rows = documents(spark, docs).select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), "text")
    bands = {}
    for r in N.signatures(rows, 5).select("doc_id", "bands").collect():
        bands.setdefault(r.bands[0], []).append(docs[r.doc_id])
    assert max(map(len, bands.values())) > 100
    kept = {r.doc_id for r in C.near_dedup(spark, documents(spark, docs), SF_DIR).collect()}
    assert kept == set().union(*(brute(sorted(some)) for some in bands.values()))
