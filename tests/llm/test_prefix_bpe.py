import base64
import hashlib
import random

import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from pitchline.llm import prefix_bpe as B
from tests.llm.helpers import SF_DIR, edge_documents


def library(name):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(name), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


ONE, MANY = library("byte_bpe_50k.tiktoken"), library("byte_bpe_multi_50k.tiktoken")
OWN = B.encoder(*B.public_vocabulary())


def brute(rows):
    out = []
    for i, text in rows:
        ids = ONE.encode_ordinary(text or "")
        out.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                    hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_query_against_the_library(spark):
    got = B._query(spark, SF_DIR)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_odd_documents_and_empty_tables(spark):
    docs = edge_documents(spark)
    got = B.decode(B.encode(docs)).collect()
    want = sorted(((r.doc_id, ONE.encode_ordinary(r.text or ""), (r.text or "").encode()) for r in docs.collect()), key=str)
    assert sorted(((r.doc_id, list(r.ids), bytes(r.bytes)) for r in got), key=str) == want
    assert B.decode(B.encode(docs.filter("false"))).count() == 0


TEXTS = ["", " ", "a  b", "aaaaaaaaaaaa", "'s 'll don't", "<|endoftext|>", "a   b　 c", "x" * 3000, "ab" * 999, " " * 500 + "z",
         "\r\n\r\n\t\tfoo(); // bar", "日本語のテキスト", "🙂🙃" * 30, "1234567890" * 9, "\x00\x1f\x7f", "a\x1c\x1d b \x1e\x1e c\x85\x85 d", "é́ñ", "=" * 700, "\n" * 300]


def test_texts_of_all_kinds():
    multi = B.Encoder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    rng = random.Random(5)
    noise = ["".join(chr(rng.choice((rng.randrange(32, 127), rng.randrange(160, 0x3000), 0x20, 0x1F600 + rng.randrange(60))))
                     for _ in range(rng.randrange(400))) for _ in range(150)]
    for text in TEXTS + noise:
        assert OWN.ids(text) == ONE.encode_ordinary(text)
        assert multi.ids(text) == MANY.encode_ordinary(text)
        assert OWN.decode(OWN.ids(text)) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab the 'sé1.\n", max_size=60))
def test_small_alphabet(text):
    assert OWN.ids(text) == ONE.encode_ordinary(text)


def test_other_patterns_and_a_small_memory(monkeypatch):
    pattern = r"\S+|\s"
    ranks = {v: k for k, v in OWN.vocabulary.bytes_of.items()}
    theirs = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    mine = B.Encoder(B.public_vocabulary()[0], pattern)
    monkeypatch.setattr(B.Encoder, "LIMIT", 3)
    for text in TEXTS + ["one two\x1cthree\x1f four's 5six seven-eight\n\nnine"] * 2:
        assert mine.ids(text) == theirs.encode_ordinary(text)
        assert OWN.ids(text) == ONE.encode_ordinary(text)
    assert len(mine.number) < 50


def test_every_token_in_front_of_others():
    v, rng = OWN.vocabulary, random.Random(3)
    tokens = rng.sample(sorted(v.bytes_of), 3000)
    for a, b in zip(tokens, tokens[1:]):
        if v.made(a) and v.made(b):
            assert v.apart(a, b) == (ONE._core_bpe.encode_single_piece(v.bytes_of[a] + v.bytes_of[b]) == [a, b]
                                     if v.bytes_of[a] + v.bytes_of[b] not in v.ranks else False)


def test_appends_and_edits():
    v, rng = OWN.vocabulary, random.Random(11)
    words = [b"the", b"ing", b"tion", b"a", b"er", b"zz", b"re", b"qu", b"\xc3\xa9"]
    held = B.Prefixes(v)
    for _ in range(60):
        held.append(rng.choice(words))
        assert held.ids() == B.Prefixes(v, held.data).ids()
    for _ in range(80):
        low = rng.randrange(len(held.data))
        high = min(len(held.data), low + rng.randrange(6))
        held.replace(low, high, rng.choice(words) * rng.randrange(3))
        assert held.last == B.Prefixes(v, held.data).last
    long = B.Prefixes(v, b"the" * 2000)
    assert long.replace(10, 11, b"x") < 600 and long.last == B.Prefixes(v, long.data).last
    if long.data not in v.ranks:
        assert long.ids() == ONE._core_bpe.encode_single_piece(long.data)
