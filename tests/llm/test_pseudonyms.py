import datetime
import itertools
import re

from pyspark.sql import functions as F

from pitchline.llm import pseudonyms as P
from tests.llm.helpers import documents, edge_documents, rows

TEXTS = ["Call +1 (555) 123-4567 or +1 (555) 123-4567.", "Pay 4111 1111 1111 1111 now, or 4111-1111-1111-1111", "not a card 4111111111111112",
         "host 10.0.0.1, bad 300.1.1.1 and 1.2.3.4.5", "born 1987-02-28, 28/02/1987 and 28.02.1987; never 1987-02-30",
         "mail Jane.Doe99@mail7.example.com and JANE.DOE99@mail7.example.com", 'key = "9bf1ab24639e3e49cf46b2d7c90f3602a3d0b907"',
         "x" * 50_000 + "@", "1" * 5000, "none"]


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def test_permutation_of_a_whole_domain(spark):
    for bases in ((10, 10, 10), (3, 26, 5), (17, 41)):
        frame = spark.createDataFrame([(list(v),) for v in itertools.product(*map(range, bases))], "v array<int>")
        moved = P.permute(F.col("v"), F.array(*map(F.lit, bases)), "t", "k")
        out = frame.select("v", moved.alias("m")).withColumn("back", P.permute(F.col("m"), F.array(*map(F.lit, bases)), "t", "k", reverse=True)).collect()
        assert len({tuple(r.m) for r in out}) == len(out)
        assert all(list(r.v) == list(r.back) for r in out)
        assert sum(r.v != r.m for r in out) > 0.8 * len(out)


def test_formats_links_and_way_back(spark):
    docs = documents(spark, list(enumerate(TEXTS)))
    hidden = P.pseudonymise(docs, "secret")
    got = {r.doc_id: r.text for r in hidden.collect()}
    phones = re.findall(r"\+1 \(\d{3}\) \d{3}-\d{4}", got[0])
    assert len(phones) == 2 and phones[0] == phones[1] != "+1 (555) 123-4567"
    cards = [re.sub(r"\D", "", c) for c in re.findall(r"\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}", got[1])]
    assert len(cards) == 2 and cards[0] == cards[1] != "4111111111111111" and luhn(cards[0])
    assert got[2] == TEXTS[2]
    address = re.search(r"host (\S+),", got[3])[1]
    assert address != "10.0.0.1" and all(0 <= int(x) <= 255 for x in address.split(".")) and "300.1.1.1 and 1.2.3.4.5" in got[3]
    iso, slash, dot = re.search(r"born (\S+), (\S+) and (\S+);", got[4]).groups()
    day = datetime.date.fromisoformat(iso)
    assert day != datetime.date(1987, 2, 28) and 1900 <= day.year <= 2099 and "never 1987-02-30" in got[4]
    assert slash == day.strftime("%d/%m/%Y") and dot == day.strftime("%d.%m.%Y")
    low, high = re.findall(r"\S+@mail7.example.com", got[5])
    assert low.lower() == high.lower() and low != "Jane.Doe99@mail7.example.com" and re.fullmatch(r"[A-Z][a-z]{3}\.[A-Z][a-z]{2}\d\d@.*", low)
    assert re.fullmatch(r'key = "[0-9a-f]{40}"', got[6]) and got[6] != TEXTS[6]
    assert all(got[i] == TEXTS[i] for i in (7, 8, 9))
    back = {r.doc_id: r.text for r in P.pseudonymise(hidden, "secret", reverse=True).collect()}
    assert back == dict(enumerate(TEXTS))


PLANTED = {
    "phone": ["555-123-4567", "(555) 123-4567", "555.123.4567", "+49 30 1234567", "+1 555-123-4567", "+4930123456", "+44 (20) 7946-0958", "+1 (555) 123-4567"],
    "date": ["12/25/2024", "2024/12/25", "1.5.2024", "31.1.1999", "29.2.2000", "02/29/2000", "2/28", "01/31/1950", "9.12.2001", "10.9.1901"],
    "card": ["4111 1111 1111 1111 12/27", "4111 1111 1111 1111 123", "4111-1111-1111-1111-12", "4111111111111111", "378282246310005"],
    "iban": ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "DE88 3704 0044 0532 0130 00", "FR1420041010050500013M02606"],
    "ssn": ["123-45-6789", "899-99-9999", "667-01-0001", "000-12-3456", "666-12-3456", "900-12-3456", "123-00-4567", "123-45-0000"]}
STAY = {"29.2.2000", "02/29/2000", "2/28", "DE88 3704 0044 0532 0130 00", "000-12-3456", "666-12-3456", "900-12-3456", "123-00-4567", "123-45-0000"}


def iban(text):
    text = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def test_usual_formats_are_hidden_checked_and_come_back(spark):
    values = [(kind, v) for kind, vs in PLANTED.items() for v in vs]
    docs = documents(spark, [(i, f"see {v}, or {v}; end") for i, (_, v) in enumerate(values)])
    hidden = P.pseudonymise(docs, "secret")
    got = {r.doc_id: r.text for r in hidden.collect()}
    for i, (kind, v) in enumerate(values):
        first, second = re.fullmatch(r"see (.*), or (.*); end", got[i]).groups()
        assert first == second and (first == v) == (v in STAY), (v, first)
        assert re.sub("[A-Z]", "A", re.sub("[0-9]", "0", first)) == re.sub("[A-Z]", "A", re.sub("[0-9]", "0", v))
        if kind == "card":
            assert luhn(re.sub(r"\D", "", first)[:16 if v[0] == "4" else 15]) and first[19:] == v[19:]
        if kind == "iban" and v not in STAY:
            assert iban(first) and first[:2] == v[:2]
        if kind == "ssn" and v not in STAY:
            assert re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", first)
        if kind == "date" and v not in STAY:
            parts = [int(x) for x in re.split("[/.]", first)]
            order = (0, 1, 2) if v[:4].isdigit() else (2, 0, 1) if "/" in v else (2, 1, 0)
            datetime.date(*(parts[k] for k in order))
    back = {r.doc_id: r.text for r in P.pseudonymise(hidden, "secret", reverse=True).collect()}
    assert back == {r.doc_id: r.text for r in docs.collect()}
    digits = lambda i: re.sub(r"\D", "", re.match(r"see (.*), or", got[i])[1])
    at = {v: i for i, (_, v) in enumerate(values)}
    assert len({digits(at[v])[-10:] for v in ("555-123-4567", "(555) 123-4567", "555.123.4567", "+1 555-123-4567", "+1 (555) 123-4567")}) == 1


def test_every_short_and_american_date_has_a_way_back(spark):
    days = [datetime.date(1999, 12, 28) + datetime.timedelta(n) for n in range(0, 800, 3)]
    texts = [f"{d.day}.{d.month}.{d.year}" for d in days] + [f"{d.month:02d}/{d.day:02d}/{d.year}" for d in days]
    docs = documents(spark, list(enumerate(texts)))
    hidden = P.pseudonymise(docs, "k")
    got = [r.text for r in hidden.orderBy("doc_id").collect()]
    assert len(set(got)) == len(set(texts)) and sum(a != b for a, b in zip(got, texts)) > 0.9 * len(texts)
    assert [r.text for r in P.pseudonymise(hidden, "k", reverse=True).orderBy("doc_id").collect()] == texts


def test_whole_table_has_a_way_back(spark):
    docs = documents(spark, [(r[0], r[1]) for r in rows(spark)])
    hidden = P.pseudonymise(docs, "another key")
    changed = hidden.join(docs.select("doc_id", F.col("text").alias("old")), "doc_id").filter("text <> old and n_found > 0").count()
    assert changed > 0
    assert P.pseudonymise(hidden, "another key", reverse=True).select("doc_id", "text").exceptAll(docs.select("doc_id", "text")).count() == 0


def test_edges(spark):
    docs = edge_documents(spark)
    got = P.pseudonymise(docs, "k")
    assert got.count() == 12 and got.filter("n_found > 0").count() == 0 and got.filter("text is null").count() == 2
    assert set(got.columns) == set(docs.columns)
    assert P.pseudonymise(docs.filter("false"), "k").count() == 0
