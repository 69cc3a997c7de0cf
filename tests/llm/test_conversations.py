import hashlib
import itertools
import random
import re
import zlib

from pitchline.llm import conversations as C
from tests.llm.helpers import SF_DIR

LEGAL = re.compile(r"(s?(ua)+)?")
BLANK = " \t\n\x0b\x0c\r"


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        body = text.strip(BLANK)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """Cost, audit and rows by cost-to-go over (row, last initial), then a breadth-first walk that keeps the ASCII-least letter."""
    n = len(rows)
    last = ["", "s", "u", "a"]
    allowed = {"": "su", "s": "u", "u": "a", "a": "u"}
    inf = 10 ** 9
    go = [{q: inf for q in last} for _ in range(n + 1)]
    def edits(i, q):
        for new in "ua":
            if new in allowed[q]:
                yield "I", 3, i, new, ({"u": "user", "a": "assistant"}[new], "")
        if i < n:
            yield "D", 4, i + 1, q, None
            if found[i] not in ("blank", "duplicate"):
                extra = 3 * (found[i] == "truncated")
                initial = rows[i][2][:1]
                if initial in allowed[q] and initial:
                    yield "K", extra, i + 1, initial, (rows[i][2], rows[i][3])
                for new in "ua":
                    if new in allowed[q]:
                        yield "R", 3 + extra, i + 1, new, ({"u": "user", "a": "assistant"}[new], rows[i][3])
    go[n][""] = go[n]["a"] = 0
    for i in range(n, -1, -1):
        for _ in range(4):
            for q in last:
                for _, cost, j, new, _ in edits(i, q):
                    go[i][q] = min(go[i][q], cost + go[j][new])
    layer, audit = {(0, ""): ()}, ""
    total = go[0][""]
    while True:
        if any(i == n and go[n][q] == 0 for i, q in layer):
            kept = next(out for (i, q), out in layer.items() if i == n and go[n][q] == 0)
            return total, audit, kept
        options = {}
        for (i, q), out in layer.items():
            for letter, cost, j, new, row in edits(i, q):
                if cost + go[j][new] == go[i][q]:
                    options.setdefault(letter, {})[j, new] = out + ((row,) if row else ())
        least = min(options)
        audit, layer = audit + least, options[least]


def brute(rows):
    out = []
    convs = {r[0] for r in rows}
    hurt = brute_damage(rows)
    for conv in convs:
        mine = in_order([r for r in hurt if r[0] == conv])
        found = faults(mine)
        cost, audit, kept = cheapest(mine, found)
        turns = {r[1] for r in mine if r[1] is not None}
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, found.count("blank"), found.count("duplicate"),
                    found.count("truncated"), illegal, cost, audit,
                    hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()))
        assert LEGAL.fullmatch("".join(r[0] for r, _ in kept))
    return sorted(out, key=str)


def run(spark, rows, tmp_path, name="t"):
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.mode("overwrite") \
        .parquet(f"{tmp_path}/{name}/conversations.parquet")
    return sorted((tuple(r) for r in C._query(spark, f"{tmp_path}/{name}").collect()), key=str)


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = C._query(spark, SF_DIR)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_random_conversations_ties_and_nulls(spark, tmp_path):
    rng = random.Random(7)
    texts = ["Yes.", "no", "", " \t", None, "Well! ", "é?", "a.b", "Long. " * 40]
    rows = [(rng.choice([None, *range(25)]), rng.choice([None, *range(9)]), rng.choice(["system", "user", "assistant", "tool", None, "", "ua"]),
             rng.choice(texts)) for _ in range(400)]
    assert run(spark, rows, tmp_path) == brute(rows)
    assert run(spark, [], tmp_path, "none") == []
    only = [(5, t, "user", "x") for t in range(200) if zlib.crc32(f"5:{t}".encode()) % 20 == 0]
    assert run(spark, only, tmp_path, "gone") == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_one_long_conversation_over_many_chunks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "CHUNK", 7)
    rng = random.Random(9)
    rows = [(1, t // 2, rng.choice(["user", "assistant", "system"]), rng.choice(["ok.", "same", f"text {t}.", ""])) for t in range(600)]
    rows += [(2, 3, "user", "again.")] * 50 + [(3, None, "user", "x.")]
    assert run(spark, rows, tmp_path) == brute(rows)


def test_every_short_sequence_against_brute_force():
    role = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}
    for n in range(5):
        for symbols in itertools.product("xsuaoUA", repeat=n):
            rows = [(0, i, role.get(c.lower(), "user"), "t") for i, c in enumerate(symbols)]
            found = ["duplicate" if c == "x" else "truncated" if c.isupper() else None for c in symbols]
            whole = "".join(symbols)
            edits, state = C.trace(whole, 0, C.START)
            audit = edits + C.closing(state)
            assert audit == cheapest(rows, found)[1]


def test_blocks_agree_with_single_steps():
    t, rng = C.tables(), random.Random(1)
    assert len(t.vectors) < 200
    for _ in range(300):
        symbols = "".join(rng.choices(C.SYMBOLS, k=rng.randrange(40)))
        vector = rng.randrange(len(t.vectors))
        slow = vector
        for c in reversed(symbols):
            slow = t.step[slow][C.SYMBOLS.index(c)]
        assert C.before(symbols, vector) == slow
