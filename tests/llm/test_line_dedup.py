import random

from pitchline.llm import line_dedup as L
from tests.llm.helpers import documents, edge_documents, words


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i:] == b[i + 1:] or a[i + 1:] == b[i + 1:]


def brute(docs, least=L.MIN_CHARS):
    lines = [(d, n, x) for d, t in docs for n, x in enumerate((t or "").split("\n")) if words(x)]
    lines.sort(key=lambda x: x[:2])
    gone = set()
    for k, (d, n, x) in enumerate(lines):
        if any(y == x or min(len(x), len(y)) >= least and within_one(x, y) for _, _, y in lines[:k]):
            gone.add((d, n))
    return {d: "\n".join(x for n, x in enumerate((t or "").split("\n")) if (d, n) not in gone) for d, t in docs}


def test_random_edits_against_brute_force(spark):
    random.seed(5)
    bases = ["".join(random.choice("abcé ") for _ in range(random.randrange(8, 45))) for _ in range(25)]

    def edit(x):
        for _ in range(random.choice([0, 1, 1, 2])):
            i, c = random.randrange(len(x) + 1), random.choice("abcé ")
            x = random.choice([x[:i] + c + x[i:], x[:i] + x[i + 1:], x[:i] + c + x[i + 1:]]) or "a"
        return x

    docs = [(i, "\n".join(edit(random.choice(bases)) for _ in range(6))) for i in range(80)]
    got = {r.doc_id: r.text for r in L.drop_repeated_lines(documents(spark, docs)).collect()}
    assert got == brute(docs)


def test_every_single_edit_is_found(spark):
    base = "The quick brown fox"
    edits = [base[:i] + "x" + base[i:] for i in range(len(base) + 1)] + [base[:i] + base[i + 1:] for i in range(len(base))] \
        + [base[:i] + "x" + base[i + 1:] for i in range(len(base))]
    docs = [(0, base)] + [(i + 1, e) for i, e in enumerate(edits)]
    got = {r.doc_id: r.text for r in L.drop_repeated_lines(documents(spark, docs)).collect()}
    assert got == {i: base if i == 0 else "" for i, _ in docs}


def test_edges(spark):
    docs = edge_documents(spark)
    got = L.drop_repeated_lines(docs)
    found = {r.doc_id: r for r in got.filter("doc_id is not null").collect()}
    assert got.count() == 12
    assert found[1].text == "" and found[2].text == " \t\n " and found[2].n_lines == 0
    assert found[7].text == "a\n" and found[7].n_removed == 2999
    assert found[4].n_removed == 0 and found[5].text == "" and found[8].n_removed == 1
    assert {c for c in got.columns} == {*docs.columns, "n_removed"}
    assert L.drop_repeated_lines(docs.filter("false")).count() == 0


def test_rows_without_an_id_and_texts_under_one_id_are_cleared_row_by_row(spark):
    docs = [(1, "a line that is repeated\nfirst of one"), (None, "a line that is repeated\nown text of a row"),
            (None, "unique text of a nameless row\nown text of a row"), (None, "same in both"), (None, "same in both"),
            (7, "an earlier text under seven\nshared line of two texts"), (7, "another unique text\nshared line of two texts"),
            (8, "a line that is repeated"), (8, "what only eight says"), (9, "candidate of one place"), (9, "partner of one place x"),
            (10, "candidate of one place!"), (11, "partner of one place y")]
    got = sorted((r.doc_id or 99, r.text) for r in L.drop_repeated_lines(documents(spark, docs)).collect())
    of = lambda i: sorted(t for d, t in got if d == i)
    lines = [x for _, t in got for x in t.split("\n") if x]
    assert of(1) == ["a line that is repeated\nfirst of one"]
    assert of(8) == ["", "what only eight says"] and of(10) == [""] and of(11) == [""]
    assert {"unique text of a nameless row", "an earlier text under seven", "another unique text"} <= set(lines)
    assert len(lines) == len(set(lines)) and lines.count("own text of a row") == lines.count("same in both") == 1
    assert lines.count("shared line of two texts") == 1 and lines.count("a line that is repeated") == 1
