import difflib
import random
import re
import textwrap

import pytest

from pitchline.llm import licenses as L
from tests.llm.helpers import documents, edge_documents

CLEAN = "Some words of a plain text that says nothing about terms of use, over and over in its own way. "


def test_each_template_is_found_where_it_stands(spark):
    docs = [(i, CLEAN * (i % 4) + "\n" + CLEAN + t + " " + CLEAN) for i, t in enumerate(L.TEMPLATES.values())]
    got = L.scan(documents(spark, docs)).collect()
    names = list(L.TEMPLATES)
    found = {(r.doc_id, r.license) for r in got if r.exact}
    assert {(i, n) for i, n in enumerate(names)} <= found
    assert all(r.block_no == 1 for r in got)


def wrapped(text, sign):
    return "\n".join(f"{sign} {line}" for line in textwrap.wrap(text, 70))


@pytest.mark.parametrize("sign", ["", "#", "//", " *", "--", ">"])
def test_each_template_is_found_wrapped_and_behind_comment_signs(spark, sign):
    docs = [(i, CLEAN + "\n\n" + wrapped(t, sign) + "\n" + CLEAN) for i, t in enumerate(L.TEMPLATES.values())]
    got = {r.doc_id: r for r in L.scan(documents(spark, docs)).collect()}
    assert [got[i].license for i in range(len(docs))] == list(L.TEMPLATES)
    for i, t in enumerate(L.TEMPLATES.values()):
        assert got[i].exact and got[i].block_no == 2 and got[i].last_line == 1 + len(textwrap.wrap(t, 70))


def test_notices_against_every_stretch_of_words(spark):
    """With every stretch of as many words as a template has compared, no license is found that the scan misses, and none less."""
    rng, names = random.Random(5), [n for n, t in L.TEMPLATES.items() if len(t) < 250]
    scanner, docs, want = L.Scanner(L.TEMPLATES), [], {}
    for i in range(60):
        words = [w for n in rng.sample(names, rng.randrange(3)) for w in [*CLEAN.split() * rng.randrange(1, 4), *L.TEMPLATES[n].split(), *CLEAN.split()]]
        for _ in range(rng.randrange(4)):
            plain = [k for k, w in enumerate(words) if not re.search(L.MARKERS, w)]
            if plain:
                words[rng.choice(plain)] = rng.choice(["changed", "license", "x"])
        docs.append((i, " ".join(words)))
        have = L._tokens(docs[-1][1])
        for n in names:
            size = len(scanner.words[n])
            best = max((sum(m.size for m in difflib.SequenceMatcher(None, scanner.words[n], have[k:k + size], autojunk=False).get_matching_blocks())
                        for k in range(max(1, len(have) - size + 1))), default=0)
            if best >= 0.8 * size:
                want.setdefault(i, set()).add(n)
    got = {}
    for r in L.scan(documents(spark, docs)).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    inside = {"Apache-2.0": {"Apache-2.0-header"}}      # the short notice is the beginning of the long one
    for i in range(60):
        found, known = got.get(i, set()), want.get(i, set())
        assert all(n in found or inside.get(n, set()) & found for n in known), (i, found, known, docs[i])
        assert found <= known, (i, found, known, docs[i])


def test_very_long_lines_with_many_markers(spark):
    text = "license and copyright of " * 5000 + L.TEMPLATES["MIT"] + " license" * 2000
    got = L.scan(documents(spark, [(0, text)])).collect()
    assert [(r.license, r.exact) for r in got] == [("MIT", True)]


def test_similar_templates_are_all_compared(spark):
    """The right one of many near templates is found though others save as much."""
    base = "This work is released under the terms of public license number {} of the people of {} and may be copied freely by all"
    own = {f"L{i:02d}": base.format(i, f"land{i}") for i in range(12)}
    got = L.scan(documents(spark, [(i, CLEAN + t) for i, t in enumerate(own.values())]), own).collect()
    assert {(r.doc_id, r.license) for r in got if r.exact} == set(enumerate(own))


def test_differences_are_told(spark):
    docs = [(0, "Licensed under the Apache License, Version 1.1."), (1, "RELEASED!! UNDER!! THE!! MIT!! LICENSE.!!"),
            (2, "This driver has a license to drive and a copyright of its own"), (3, CLEAN)]
    got = {r.doc_id: r for r in L.scan(documents(spark, docs)).collect()}
    assert set(got) == {0, 1}
    assert got[0].license == "Apache-2.0" and not got[0].exact and got[0].differences == ["-2.0", "+1.1"]
    assert got[1].license == "MIT" and got[1].exact and got[1].differences == []


def test_edges(spark):
    docs = edge_documents(spark)
    assert L.scan(docs).count() == 0 and L.scan(docs.filter("false")).count() == 0
    line = L.TEMPLATES["MIT"]
    more = documents(spark, [(None, line), (1, line + "\n" + line), (2, (CLEAN * 300 + line) * 3)])
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.block_no, r.license) for r in L.scan(more).collect())
    assert got == [(-1, 0, "MIT"), (1, 0, "MIT"), (1, 1, "MIT"), (2, 0, "MIT")]
    with pytest.raises(ValueError):
        L.scan(docs, {"own": "no such word"})
