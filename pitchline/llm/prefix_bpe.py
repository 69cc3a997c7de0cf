"""Operator 12: byte-level BPE by dynamic programming over prefixes: each prefix of a piece has one valid last token."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchline.llm.common import small_batches, table
from pitchline.llm.parts import Parts
from pitchline.llm.registry import register
from pitchline.llm.text import list_column, slices

NEVER = float("inf")
#: The pattern whose pieces begin where ``Parts`` cuts. Its blanks are those of Unicode, which take no control separators in.
USUAL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def compiled(pattern: str) -> regex.Pattern:
    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


class Vocabulary:
    """Ranks of byte strings. A token's rank is its id and the order in which its last merge is done."""

    PAIRS = 1_000_000                                   # answers remembered; beyond it the memory starts anew

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks, self.bytes_of = ranks, {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self._split: dict[int, tuple[int, int] | None] = {}
        self._meet: dict[int, bool] = {}
        #: Tokens that merging makes, and -1 for what is only the end of one: a match to the left of a place goes on through these.
        self.ends = {token[i:]: -1 for token in ranks for i in range(1, len(token))}
        self.ends.update((token, rank) for token, rank in ranks.items() if self.made(rank))

    def _merged(self, data: bytes) -> list[bytes]:
        """Plain merging, lowest rank first and leftmost among equals, but for the merge that would leave one part."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 2:
            rank, at = min((self.ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == NEVER:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None if merging its bytes never makes it. Not for single bytes."""
        if token not in self._split:
            parts = self._merged(self.bytes_of[token])
            self._split[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self._split[token]

    def made(self, token: int) -> bool:
        return len(self.bytes_of[token]) == 1 or self.halves(token) is not None

    def apart(self, a: int, b: int) -> bool:
        """Whether merging the bytes of ``a`` and ``b`` gives just these two.

        Both grow by their own merges until a merge across the seam comes first. So the tokens at the seam are taken back to their
        halves, last made first; at each pair the merge across it must come after the merge that takes up one of them.
        """
        taken_a = taken_b = NEVER
        made = lambda token: -1 if len(self.bytes_of[token]) == 1 else token
        while True:
            across = self.ranks.get(self.bytes_of[a] + self.bytes_of[b], NEVER)
            if across < taken_a and across <= taken_b and across != NEVER:
                return False
            if made(a) > made(b):
                taken_a, a = a, self.halves(a)[1]
            elif made(b) >= 0:                          # of two equal tokens the left one is made first
                taken_b, b = b, self.halves(b)[0]
            else:
                return True

    def extend(self, data: bytes, last: list[int], stop: int) -> None:
        """Add to ``last``, the last tokens of the prefixes known so far, those of the prefixes up to ``stop`` bytes."""
        ends, meet = self.ends.get, self._meet
        if len(meet) > self.PAIRS:
            meet.clear()
        for end in range(len(last) + 1, stop + 1):
            for begin in range(end - 1, -1, -1):
                token = ends(data[begin:end])
                if token is None:
                    raise ValueError("the vocabulary lacks a byte or a prefix has no last token")
                if token >= 0:
                    if not begin:
                        break
                    before = last[begin - 1]
                    pair = before << 32 | token
                    fits = meet.get(pair)
                    if fits is None:
                        fits = meet[pair] = self.apart(before, token)
                    if fits:
                        break
            last.append(token)


class Prefixes:
    """A byte string and, for each of its prefixes, the last token of that prefix's encoding."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, data: bytes) -> None:
        """Exact: the prefixes known so far stay as they are."""
        self.data += data
        self.vocabulary.extend(self.data, self.last, len(self.data))

    def become(self, data: bytes) -> None:
        """Another byte string; the answers for the prefixes that both have stay."""
        same = len(commonprefix((self.data, data)))
        del self.last[same:]
        self.data = data
        self.vocabulary.extend(data, self.last, len(data))

    def replace(self, low: int, high: int, data: bytes) -> int:
        """Put ``data`` in place of the bytes from ``low`` to ``high``; returns how many prefixes were looked at.

        Behind the edit the old answers hold again once they agreed for as many prefixes in a row as the longest token has bytes:
        a prefix's last token depends on no more than that many bytes and answers before it.
        """
        old, moved = self.last, len(data) - (high - low)
        self.data = self.data[:low] + data + self.data[high:]
        self.last, same = old[:low], 0
        for end in range(low + 1, len(self.data) + 1):
            self.vocabulary.extend(self.data, self.last, end)
            same = same + 1 if end > low + len(data) and self.last[-1] == old[end - 1 - moved] else 0
            if same >= self.vocabulary.longest:
                self.last += old[end - moved:]
                return end - low
        return len(self.data) - low

    def ids(self) -> list[int]:
        """Read from the end: a prefix's last token, then that of the prefix before it."""
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end - 1])
            end -= len(self.vocabulary.bytes_of[out[-1]])
        return out[::-1]


class Encoder(Parts):
    """Each match of the pattern by itself, as ranks say."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.vocabulary, self.pattern = Vocabulary(ranks), compiled(pattern)
        super().__init__(self._pieces, pattern == USUAL)

    def _pieces(self, parts: list[bytes]) -> list[list[int]]:
        split = [self.pattern.findall(part.decode()) for part in parts]
        found, held = {}, Prefixes(self.vocabulary)
        for piece in sorted(set(chain.from_iterable(split))):   # in order, a piece goes on from the prefixes that it shares with the one before
            data = piece.encode()
            known = self.vocabulary.ranks.get(data)             # a whole piece that is a token needs no merges
            if known is None:
                held.become(data)
            found[piece] = held.ids() if known is None else [known]
        return [list(chain.from_iterable(map(found.__getitem__, pieces))) for pieces in split]

    def ids(self, text: str) -> list[int]:
        raw = text.encode()
        return self.encode(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0].tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, ids))


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """The worker's encoder; it lives as long as the worker."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(path, pattern)
    return _encoders[path, pattern]


def public_vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    import public_tokenizers

    return str(public_tokenizers.path(name)), public_tokenizers.PATTERN


def encode(docs: DataFrame, vocabulary: tuple[str, str] | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Columns ``doc_id`` and ``ids`` (array of ints) per row of ``docs``, by the rank file and pattern of ``vocabulary``.

    Each match of the pattern is encoded by itself, special tokens are ordinary text. A null text is empty and has no ids. Rows with a
    null or repeated id are kept as they are; other columns are ignored; an empty table gives an empty one. There is no shuffle. Time
    is linear in a piece's length, also in a text without a blank; a worker remembers a bounded number of short pieces.
    """
    path, pattern = vocabulary or public_vocabulary()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            for low, high, data, bounds in slices(batch.column(1)):
                ids, sizes = own.encode(data, bounds)
                yield pa.RecordBatch.from_arrays([batch.column(0)[low:high], list_column(ids.view(np.int32), sizes, pa.int32())], ["doc_id", "ids"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """``tokens(doc_id, ids)`` with ``bytes`` (binary: ids may end inside a character). No ids or null ids give no bytes."""
    path, pattern = vocabulary or public_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            texts = [own.decode(ids.as_py() or []) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], ["doc_id", "ids", "bytes"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, bytes binary")


@register("op12_prefix_bpe")
def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decode(encode(table(spark, sf_dir, "documents"))).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"))
