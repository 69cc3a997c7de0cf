"""Small tables for the tests of the training-data operators."""

from __future__ import annotations

import re

SF_DIR = "/root/testdata/sf0.001"
CLASHING = "key string, k1 int, fp string, low int, high int, rest int, run string, n int, stratum string, domain string, " \
           "n_found int, n_lines int, component_id int, kept string, start int, budget int, n_tokens string"


def documents(spark, rows):
    """Documents from (doc_id, text) or (doc_id, text, lang, source), with more columns whose names the operators use inside."""
    full = [(*r, "en", "src1")[:4] if len(r) == 2 else r for r in rows]
    extra = (None,) * (CLASHING.count(",") + 1)
    return spark.createDataFrame([(*r, len(r[1] or ""), *extra) for r in full],
                                 "doc_id long, text string, lang string, source string, n_chars long, " + CLASHING)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def edge_documents(spark):
    long_text = " ".join(f"word{i % 977}" for i in range(30_000))
    same = "one two three four five six seven eight nine ten eleven twelve"
    return documents(spark, [(0, ""), (1, None), (2, " \t\n "), (3, long_text), (4, same), (4, same), (5, same), (None, same),
                             (None, None), (6, "é" * 5000), (7, "a\n" * 3000), (8, same, None, None)])


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def rows(spark, name="documents"):
    return [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/{name}.parquet").collect()]


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
