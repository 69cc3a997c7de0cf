import random

import xxhash

from pitchline.llm import simhash
from pitchline.llm.components import components
from pitchline.session import materialize
from tests.llm.helpers import Union, documents, edge_documents, rows, words


def brute_fingerprint(text):
    w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in words(text)]
    shingles = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fingerprints):
    union = Union()
    for i, (a, x) in enumerate(fingerprints):
        union.find(a)
        for b, y in fingerprints[:i]:
            if (x ^ y).bit_count() <= 2:
                union.join(a, b)
    return {a: union.find(a) for a, _ in fingerprints}


def test_query_against_brute_force(spark):
    docs = [(r[0], r[1]) for r in rows(spark)]
    prints = [(i, brute_fingerprint(t)) for i, t in docs]
    want = brute_components(prints)
    got = simhash.near_duplicates(documents(spark, docs)).collect()
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{p:016x}" for i, p in prints}
    assert {r.doc_id: r.component_id for r in got} == want


def test_links_connect_all_within_two_bits(spark):
    random.seed(1)
    values = set()
    for _ in range(12):
        base = random.getrandbits(64)
        for _ in range(40):
            values.add(base ^ sum(1 << random.randrange(64) for _ in range(random.randrange(4))) & (1 << 64) - 1)
    signed = {v: v - (1 << 64) if v >> 63 else v for v in values}
    frame = spark.createDataFrame([(s,) for s in signed.values()], "fp long")
    got = [(r.a, r.b) for r in simhash.links(frame).collect()]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for a, b in got)
    union = Union()
    for v in signed.values():
        union.find(v)
    for a, b in got:
        union.join(a, b)
    want = brute_components([(s, v) for v, s in signed.items()])
    groups = lambda find: sorted(sorted(v for v in signed.values() if find(v) == r) for r in {find(v) for v in signed.values()})
    assert groups(union.find) == groups(want.get)


def test_crowded_segments_lose_no_link(spark, monkeypatch):
    """Thousands of fingerprints that share a half, some within two bits of others: every link is found, at every depth."""
    random.seed(3)
    half, values = random.getrandbits(32) << 32, set()
    for _ in range(30):
        base = half | random.getrandbits(32)
        values |= {base ^ sum(1 << b for b in random.sample(range(64), random.randrange(4))) for _ in range(12)}
    values |= {half ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)}
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    frame = spark.createDataFrame([(s,) for s in signed], "fp long")
    want = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1:] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    for crowded in (1, 8, 10 ** 6):
        monkeypatch.setattr(simhash, "CROWDED", crowded)
        got = [(r.a, r.b) for r in simhash.links(frame).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    for bits in (0, 1, 3):
        want = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1:] if ((a ^ b) & (1 << 64) - 1).bit_count() <= bits}
        assert {(r.a, r.b) for r in simhash.links(frame, bits).collect()} == want


def test_rows_without_an_id_stay_apart(spark):
    """Two nameless rows, each a copy of another document, join nothing but their own."""
    one, two = "alpha beta gamma delta epsilon zeta", "uno dos tres cuatro cinco seis siete"
    lone = "nine ten eleven twelve thirteen"
    docs = documents(spark, [(5, one), (9, two), (None, one), (None, two), (None, lone), (None, lone + " more of it")])
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == [(5, 5), (9, 9), (None, 5), (None, 9), (None, None), (None, None)]
    close = [p - (1 << 64) if p >> 63 else p for p in (brute_fingerprint(one), brute_fingerprint(two))]
    frame = spark.createDataFrame([(5, close[0]), (9, close[1]), (None, close[0] ^ 1), (None, close[1] ^ 1)], "doc_id long, fp long")
    original, simhash.fingerprints = simhash.fingerprints, lambda *a: frame
    try:
        got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    finally:
        simhash.fingerprints = original
    assert got == [(5, 5), (9, 9), (None, 5), (None, 9)]


def test_components_of_paths_and_random_graphs(spark):
    random.seed(2)
    edges = [(i, i + 1) for i in range(300)] + [(1000 + random.randrange(80), 1000 + random.randrange(80)) for _ in range(60)]
    edges += [(5000, 5000 + i) for i in range(200)] + [(None, 3), (7, 7)]
    union = Union()
    for a, b in edges:
        if a is not None:
            union.join(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: union.find(x) for x in union.up if union.find(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edges(spark):
    got = simhash.near_duplicates(edge_documents(spark)).collect()
    assert len(got) == 12
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by_id[0].fingerprint == "0" * 16 and by_id[1].component_id == 0 and by_id[2].component_id == 0
    assert by_id[5].component_id == 4 and by_id[8].component_id == 4
    assert sorted((r.component_id for r in got if r.doc_id is None)) == [0, 4]
    kept = simhash.drop_near_duplicates(edge_documents(spark))
    assert sorted(kept.columns) == sorted(edge_documents(spark).columns)
    assert sorted(r.doc_id for r in kept.filter("doc_id is not null").collect()) == [0, 3, 4, 4, 6, 7]
    assert simhash.near_duplicates(edge_documents(spark).filter("false")).count() == 0


def test_lookups_are_never_broadcast(spark):
    """A fingerprint has 66 lookups, which the planner counts as one: however small they seem, no side of their join is the driver's."""
    values = spark.range(3000).selectExpr("xxhash64(id) AS fp")
    found = simhash.links(materialize(values, "values"))
    assert found.count() == 0
    found.collect()
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
