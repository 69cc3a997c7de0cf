import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from pitchline.llm import decontaminate as D
from pitchline.llm.text import LOWER, slices
from tests.llm.helpers import documents, edge_documents


def brute_scores(items, passage):
    """BM25 of every item over its own full score, the passage's distinct words being the query."""
    n, mean = len(items), sum(map(len, items)) / len(items)
    df = Counter(w for i in items for w in set(i))

    def weight(item, w):
        tf = item.count(w)
        return math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf * (D.K1 + 1) / (tf + D.K1 * (1 - D.B + D.B * len(item) / mean))

    return [sum(weight(i, w) for w in set(i) & set(passage)) / sum(weight(i, w) for w in set(i)) for i in items]


def test_wand_finds_all_above_the_threshold():
    random.seed(4)
    vocabulary = [f"v{int(random.paretovariate(0.7))}" for _ in range(400)]
    items = [[random.choice(vocabulary) for _ in range(random.randrange(3, 30))] for _ in range(300)]
    texts = [" ".join(i) for i in items]
    index = D.build_index(np.arange(300), texts, D.statistics(texts), 5, 0.8)
    for threshold in (0.4, 1.0, 1.2):
        for _ in range(60):
            passage = [random.choice(vocabulary) for _ in range(40)] + random.choice(items)
            _, _, data, bounds = next(slices(pa.array([" ".join(passage)])))
            terms = np.unique(index.lookup(D._letters(data, bounds).hashes(LOWER)))
            got = dict(D.retrieve(index, terms[terms >= 0], threshold))
            want = {i: s / index.share[i] for i, s in enumerate(brute_scores(items, passage)) if s / index.share[i] >= threshold - 1e-9}
            assert set(got) == set(want)
            assert all(abs(got[i] - want[i]) < 1e-9 for i in got)


def brute_pairs(docs, items, size=5, overlap=0.8, part=0.5):
    """Every run of twice an item's words of every document, without an index."""
    cut = lambda t: re.findall(r"[0-9A-Za-z_\u0080-\U0010ffff]+", t or "")
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    found = {}
    for item_id, text in items:
        w = cut(low(text or ""))
        if not w or item_id is None:
            continue
        n, places = min(size, len(w)), range(max(1, len(w) - size + 1))
        question = len(cut(text[:D._answer_start(text)]))
        wanted = {}
        for i in places:
            wanted.setdefault(tuple(w[i:i + n]), i + n <= question)
        for doc_id, body in docs:
            d = cut(low(body or ""))
            hits = [(i, g) for i in range(len(d) - n + 1) if (g := tuple(d[i:i + n])) in wanted]
            runs = [[g for j, g in hits if i - (2 * len(w) - n + 1) < j <= i] for i, _ in hits]
            best = max((set(r) for r in runs), key=len, default=set())
            shares = [(len(of), sum(g in best for g in of) / len(of)) for of in ([g for g, q in wanted.items() if q], [g for g, q in wanted.items() if not q]) if of]
            if len(best) >= overlap * len(wanted) - 1e-9 and all(x >= part for n, x in shares if n >= size):
                found[doc_id, item_id] = len(best) / len(wanted)
    return found


def pairs_of(frame):
    return {(r.doc_id, r.item_id): r.overlap for r in frame.collect()}


def test_pairs_against_brute_force(spark):
    """Items with words left out, put in, replaced or moved apart, common and rare words mixed; nothing is lost in retrieval."""
    rng = random.Random(6)
    draw = lambda: f"c{rng.randrange(40)}" if rng.random() < 0.6 else f"r{rng.randrange(10 ** 6)}"
    items = [(i, " ".join(draw() for _ in range(rng.choice((3, 8, 20, 34, 60, 90)))) + rng.choice(("", ". " + " ".join(draw() for _ in range(5)))))
             for i in range(60)]
    docs = []
    for k in range(240):
        w = rng.choice(items)[1].split()
        for _ in range(rng.randrange(1 + len(w) // 6)):
            at = rng.randrange(len(w))
            w[at:at + 1] = rng.choice(([], [w[at], "new"], ["other"], [w[at]] + ["gap"] * rng.randrange(40)))
        docs.append((k, " ".join([draw() for _ in range(rng.randrange(300))] + w + [draw() for _ in range(100)])))
    frame = spark.createDataFrame(items, "item_id long, text string")
    want = brute_pairs(docs, items)
    got = pairs_of(D.contaminated(documents(spark, docs), frame))
    assert len(want) > 100 and set(got) == set(want) and all(abs(got[p] - want[p]) < 1e-12 for p in got)


def test_rare_last_words_and_foreign_long_items(spark):
    """Eight tenths of the shingles are enough whatever the lost words weigh; a long item doesn't widen another's passages."""
    rng = random.Random(2)
    items = [(i, " ".join([f"c{rng.randrange(30)}" for _ in range(28)] + [f"r{i}x{k}" for k in range(6)])) for i in range(400)]
    shown = items[0][1].split()[:28]
    scattered = items[1][1].split()
    apart = " ".join(" ".join(scattered[i:i + 5]) + " " + " ".join(f"z{rng.randrange(999)}" for _ in range(400)) for i in range(30))
    docs = [(1, " ".join(f"z{k}" for k in range(70)) + " " + " ".join(shown) + " end"), (2, apart)]
    long_item = (999, " ".join(f"l{rng.randrange(5000)}" for _ in range(20_000)))
    for more in ([], [long_item]):
        frame = spark.createDataFrame(items + more, "item_id long, text string")
        assert pairs_of(D.contaminated(documents(spark, docs), frame)) == {(1, 0): 0.8}
    assert brute_pairs(docs, items[:3]) == {(1, 0): 0.8}


def item(seed, n):
    random.seed(seed)
    return " ".join(f"q{random.randrange(3000)}" for _ in range(n))


def test_the_answer_decides(spark):
    asked = " ".join(f"asked{i}" for i in range(60)) + ". "
    items = spark.createDataFrame([(1, asked + "It is forty two by all known accounts")], "item_id long, text string")
    docs = documents(spark, [(1, asked + "it is forty two by all known accounts!"), (2, asked + "nobody here could tell me what it was"),
                             (3, asked + "it is forty two by all unknown accounts")])
    assert set(pairs_of(D.contaminated(docs, items))) == {(1, 1), (3, 1)}
    assert set(pairs_of(D.contaminated(docs, items, part=0.0))) == {(1, 1), (2, 1), (3, 1)}
    assert set(pairs_of(D.contaminated(docs, items, part=1.0))) == {(1, 1)}


def test_planted_items_are_found_and_clean_documents_left_alone(spark):
    items = [(i, item(i, 12 + i) + ". " + item(100 + i, 6)) for i in range(30)]
    clean = [(i, item(1000 + i, 700)) for i in range(40)]
    planted = [(100 + i, " ".join(item(2000 + i, k) for k in (i * 13, 90)) + " " + t.upper() + "!! " + item(3000 + i, 200)) for i, t in items]
    broken = [(200 + i, " ".join(w for k, w in enumerate(t.split()) if k % 4) + " " + item(4000 + i, 50)) for i, t in items]
    got = D.contaminated(documents(spark, clean + planted + broken), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(100 + i, i) for i, _ in items}
    assert all(r.overlap == r.question_overlap == r.answer_overlap == 1.0 for r in got)


def test_blocks_of_items_give_the_same_pairs(spark, monkeypatch):
    items = spark.createDataFrame([(i, item(i, 20)) for i in range(60)], "item_id long, text string")
    docs = documents(spark, [(i, item(500 + i, 100) + " " + item(i, 20)) for i in range(60)])
    whole = {tuple(r) for r in D.contaminated(docs, items).collect()}
    monkeypatch.setattr(D, "INDEX_BYTES", 1000)
    again = {tuple(r) for r in D.contaminated(docs, items).collect()}
    rounded = lambda found: {(d, i, round(score, 9), *rest) for d, i, score, *rest in found}
    assert rounded(again) == rounded(whole) and {r[:2] for r in whole} == {(i, i) for i in range(60)}


def test_edges(spark):
    docs = edge_documents(spark)
    same = "one two three four five six seven eight nine ten eleven twelve"
    items = spark.createDataFrame([(1, same), (2, same), (3, ""), (4, None), (None, same), (5, "zebra"), (6, "!!!")], "item_id long, text string")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.item_id) for r in D.contaminated(docs, items).collect())
    assert got == sorted((d, i) for d in (4, 4, 5, -1, 8) for i in (1, 2))
    assert sorted(r.doc_id for r in D.drop_contaminated(docs, items).filter("doc_id is not null").collect()) == [0, 1, 2, 3, 6, 7]
    assert D.contaminated(docs.filter("false"), items).count() == 0
    assert D.contaminated(docs, items.filter("false")).count() == 0
