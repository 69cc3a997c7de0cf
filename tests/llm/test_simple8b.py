import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pitchline.llm import simple8b as S
from tests.llm.helpers import documents, edge_documents, rows

WIDE = st.one_of(st.just(0), st.integers(0, 3), st.integers(0, 70_000), st.integers(0, 2 ** 64 - 1))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(WIDE, st.integers(1, 300)), max_size=40))
def test_round_trip(runs):
    values = np.array([v for v, n in runs for _ in range(n)], np.uint64)
    data = S.to_bytes(np.arange(1), np.ones(1), np.array([len(values)]), values)
    reader = S.Reader(data)
    assert np.array_equal(reader.ids(), values)
    for low, high in ((0, 1), (len(values) // 3, len(values) // 2), (max(0, len(values) - 5), len(values))):
        assert np.array_equal(reader.ids(low, min(high, len(values))), values[low:high])


def test_words_hold_as_many_values_as_fit():
    words, offsets, escapes = S.pack(np.zeros(2048, np.uint64))
    assert len(words) == 2 * (4 + 1 + 0) or len(words) < 14
    words, _, _ = S.pack(np.full(1024, 50_000, np.uint64))
    assert len(words) == 342 and not len(escapes)       # three values of 20 bits a word
    with pytest.raises(ValueError):
        S.Reader(b"x" * 100)


def brute(docs):
    tokenizer = Tokenizer.from_file(S.tokenizer_path())
    start, out = 0, []
    for doc_id, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_against_the_library(spark):
    docs = sorted((r[0], r[1]) for r in rows(spark))
    got = sorted(tuple(r) for r in S.encoded(documents(spark, docs).repartition(5)).collect())
    assert got == brute(docs)


def test_texts_with_odd_blanks_and_special_tokens(spark):
    texts = ["", " ", "  a", "a  b   c ", "a  b  c　 d", "x \n y\n\n z", "it's we'll I'd", "<|endoftext|> a<|endoftext|>",
             "1 23 456\t7", "🙂 🙂🙂", "a " * 5000, "\r\n \x0b \x0c end ", "é ü  ß"]
    docs = list(enumerate(texts))
    assert sorted(tuple(r) for r in S.encoded(documents(spark, docs)).collect()) == brute(docs)


def test_edges(spark):
    got = S.encoded(edge_documents(spark)).collect()
    assert len(got) == 12 and sum(r.doc_id is None for r in got) == 2
    assert sorted((r.start, r.n_tokens) for r in got)[0][0] == 0
    ordered = sorted(got, key=lambda r: r.start)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(ordered, ordered[1:]))
    assert [r.doc_id for r in ordered] == [None, None, 0, 1, 2, 3, 4, 4, 5, 6, 7, 8]
    assert S.encoded(edge_documents(spark).filter("false")).count() == 0


def test_small_files_and_memory_of_parts(spark, tmp_path, monkeypatch):
    docs = sorted((r[0], r[1]) for r in rows(spark))[:60]
    files = S.write(documents(spark, docs), f"file://{tmp_path}/out", S.tokenizer_path(), file_ids=500)
    assert files.count() > 5 and all(bytes(r.content[:4]) == S.MAGIC for r in files.collect())
    assert sorted(tuple(r) for r in S.read(spark, f"file://{tmp_path}/out").collect()) == brute(docs)


def test_runs_of_unicode_blanks_are_one_piece():
    rng = np.random.default_rng(4)
    parts = [" ", " ", "\u00a0", "\u3000", "\u2003", "\u1680", "\u0085", "a", "\u00e9", "\u3042", "\u201c", "\n"]
    texts = ["a" + " \u00a0" * 3 + " x"] + ["".join(rng.choice(parts, 30)) for _ in range(400)]
    raw = [t.encode() for t in texts]
    ids, sizes = S.Encoder(S.tokenizer_path()).encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    library = Tokenizer.from_file(S.tokenizer_path())
    assert list(ids[:sizes[0]]) == [64, 11504, 5624, 2124]
    assert [list(x) for x in np.split(ids, np.cumsum(sizes)[:-1])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_parts_are_known_by_their_bytes():
    """Words of equal length that any polynomial hash modulo a power of two confuses: the Thue-Morse word and its complement."""
    word = "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
    texts = [word, word.translate(str.maketrans("ab", "ba")), "x<|endoftext|>", "a <|endoftext|>b", "foo's it'll 12ab34 c.d\n\ne  f \n g  ",
             "end  ", "x ", "next"]
    raw = [t.encode() for t in texts]
    ids, sizes = S.encoder(S.tokenizer_path()).encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    library = Tokenizer.from_file(S.tokenizer_path())
    assert [list(x) for x in np.split(ids, np.cumsum(sizes)[:-1])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="aB1'. s\n\t\u00a0\u00e9<|>", max_size=25), min_size=1, max_size=4))
def test_cuts_against_the_library(texts):
    raw = [t.encode() for t in texts]
    ids, sizes = S.encoder(S.tokenizer_path()).encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    library = S.encoder(S.tokenizer_path()).tokenizer
    assert [list(x) for x in np.split(ids, np.cumsum(sizes)[:-1])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_new_parts_go_to_the_library_many_at_a_time():
    """Words after a space are encoded in runs; the ids are those of whole texts, also with blanks, controls and added tokens between."""
    import numpy as np

    from pitchline.llm import simple8b as S

    own, calls = S.Encoder(S.tokenizer_path()), []
    library = own._library
    own.ids_of = own._library = lambda parts: calls.extend(parts) or library(parts)
    texts = [" ".join("wé" + "".join(chr(97 + int(d)) for d in str(i * 7919)) for i in range(3000)), "a  b\n c \t d   e  f . , 'll 's  ", " ", "", "x <|endoftext|> y z",
             " Ġx Ġ y\x1fz \x00 q", "".join(f" .{i} ,x!" for i in range(50))]
    raw = [t.encode() for t in texts]
    ids, sizes = own.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    want = [e.ids for e in own.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert sizes.tolist() == [*map(len, want)] and ids.tolist() == [i for w in want for i in w]
    assert len(calls) < 500
