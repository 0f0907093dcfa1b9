import hashlib
import itertools
import random
import re
import zlib
from functools import cache

from pyspark.sql import functions as F

from tickloom.llm.queries import QUERIES
from tickloom.llm.repair import damage, repair_conversations

SCHEMA = "conv_id long, turn long, role string, text string"
SPACES = " \t\n\x0b\f\r"


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        end = text.rstrip(SPACES)
        out.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def told(rows, audit):
    """What an audit makes of the rows, or None where its roles aren't right."""
    out, left = [], list(rows)

    def due():
        return "user" if not out or out[-1][0][:1] in ("s", "a") else "assistant"

    for edit in audit:
        if edit == "I":
            out.append((due(), ""))
        else:
            _, role, text = left.pop(0)
            if edit != "D":
                out.append((due() if edit == "R" else role, text))
    return out if re.fullmatch("(s?(ua)+)?", "".join(r[:1] if r[:1] in ("s", "u", "a") else "x" for r, _ in out)) and not left else None


def all_audits(rows, most=4):
    """Cost and audit of every way with up to ``most`` inserts, each tried."""
    bad = faults(rows)
    for edits in itertools.product("DKR", repeat=len(rows)):
        if any(f in ("blank", "duplicate") and e != "D" for f, e in zip(bad, edits, strict=True)):
            continue
        cost = sum({"D": 2, "K": 0, "R": 1}[e] + 5 * (f == "truncated" and e != "D") for f, e in zip(bad, edits, strict=True))
        for n in range(most + 1):
            for places in itertools.combinations_with_replacement(range(len(rows) + 1), n):
                audit = "".join("I" * places.count(i) + (edits[i] if i < len(edits) else "") for i in range(len(rows) + 1))
                if told(rows, audit) is not None:
                    yield cost + 5 * n, audit


def cheapest(rows):
    """The same by recursion over rows and places, whole audits compared as strings."""
    bad = faults(rows)

    @cache
    def best(i, at, inserts):
        """With at most so many inserts ahead of row i."""
        ways = []
        if i == len(rows) and at in ("", "a"):
            ways.append((0, ""))
        follows = "a" if at == "u" else "u"
        if inserts:
            c, a = best(i, follows, inserts - 1)
            ways.append((c + 5, "I" + a))
        steps = [("D", 2, at)] if i < len(rows) else []
        if i < len(rows) and bad[i] not in ("blank", "duplicate"):
            more, initial = 5 * (bad[i] == "truncated"), rows[i][1][:1]
            steps.append(("R", 1 + more, follows))
            if initial == follows or initial == "s" and at == "":
                steps.append(("K", more, initial))
        for edit, cost, to in steps:
            c, a = best(i + 1, to, 3)
            ways.append((cost + c, edit + a))
        return min(ways, default=(10**9, ""))

    return best(0, "", 3)


def expected(rows):
    bad, initials = faults(rows), [r[:1] for _, r, _ in rows]
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit = cheapest(rows)
    text = "\n".join(f"{r}:{t}" for r, t in told(rows, audit))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    return gaps, bad.count("blank"), bad.count("duplicate"), bad.count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def results(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def conversations(seed, n, longest, roles=("user", "assistant", "system", "umpire", "tool", "")):
    rng = random.Random(seed)
    for conv in range(n):
        yield conv, [(t, rng.choices(roles, [5, 5, 2, 1, 1, 1])[0], rng.choice(["Yes.", "No!", "cut", " ", "What? ", "a.\n"])) for t in sorted(rng.sample(range(longest * 2), rng.randint(1, longest)))]


def test_recursion_equals_all_audits():
    for _, rows in conversations(1, 60, 4):
        assert min(all_audits(rows)) == cheapest(rows), rows


def test_equals_brute_force(spark):
    every = dict(conversations(2, 150, 9))
    flat = [(c, *row) for c, rows in every.items() for row in rows]
    random.Random(3).shuffle(flat)
    want = {c: expected(rows) for c, rows in every.items()}
    turns = spark.createDataFrame(flat, SCHEMA)
    assert results(repair_conversations(turns)) == want
    assert results(repair_conversations(turns, block_rows=2)) == want


def test_one_long_conversation_in_many_batches_and_blocks(spark):
    rng = random.Random(5)
    rows = [(t, rng.choice(["user", "assistant"]), rng.choice(["Yes.", f"No {t}.", f"cut {t}", ""])) for t in range(200)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "30")
    try:
        got = results(repair_conversations(spark.createDataFrame([(1, *r) for r in rows], SCHEMA), block_rows=16))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {1: expected(rows)}


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, None, "user", "Hi."), (1, 3, "assistant", "Yes."), (1, 3, "assistant", "Yes."), (2, 0, "user", None), (None, 5, "user", "Q?"), (None, 6, "assistant", "A."), (4, 7, "system", "Only."), (5, 1, "user", "é的?" * 50_000), (5, 2, "assistant", "Ok.")]
    turns = spark.createDataFrame(rows, SCHEMA).withColumn("present", F.lit(1)).withColumn("edits", F.lit("x")).withColumn("a.b", F.lit(2))
    got = results(repair_conversations(turns))
    assert got[1] == expected([(None, " ", " "), (None, "user", "Hi."), (3, "assistant", "Yes."), (3, "assistant", "Yes.")])
    assert got[2] == expected([(0, "user", " ")]) and got[2][6] == "D"
    assert got[None] == expected([(5, "user", "Q?"), (6, "assistant", "A.")]) and got[None][6] == "KK"
    assert got[4] == expected([(7, "system", "Only.")])
    assert got[5][6] == "KK"
    assert repair_conversations(turns.limit(0)).collect() == []
    none = repair_conversations(turns.select("conv_id", "turn", "role", "text", F.lit(False).alias("here")), present="here")
    assert set(results(none).values()) == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_op12_by_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    every = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        every.setdefault(r.conv_id, []).append(r)
    want = {}
    for conv, given in every.items():
        rows = []
        for r in sorted(given, key=lambda r: r.turn):
            kind, text, role = zlib.crc32(f"{conv}:{r.turn}".encode()) % 20, r.text or " ", r.role or " "
            if kind:
                text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
                rows += [(r.turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        want[conv] = expected(rows)
    assert results(QUERIES["op12_conversation_repair"](spark, sf)) == want
    assert damage(spark.createDataFrame([], SCHEMA)).collect() == []
