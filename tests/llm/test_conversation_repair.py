"""Repair of conversations: every edit sequence tried on small ones, segments against one piece, edges."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from rankloom.llm.conversation_repair import repair

WHITE = " \t\n\x0b\x0c\r"
NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
SCHEMA = "conv_id long, turn long, role string, text string"


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        last = text.rstrip(WHITE)[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
        seen.add((role, text))
    return out


def all_repairs(rows, most):
    """(cost, audit, lines) of each sequence of edits with up to ``most`` inserts, by trying them all."""
    marks = faults(rows)
    for edits in itertools.product("KRD", repeat=len(rows)):
        if any(m in ("blank", "duplicate") and e != "D" for m, e in zip(marks, edits)):
            continue
        base = sum({"K": 0, "R": 2, "D": 3}[e] + (m == "truncated" and e != "D") for m, e in zip(marks, edits))
        for inserts in itertools.product(range(most + 1), repeat=len(rows) + 1):
            if sum(inserts) > most:
                continue
            steps = [x for i in range(len(rows) + 1) for x in [*["I"] * inserts[i], *([(edits[i], rows[i])] if i < len(rows) else [])]]
            free = [x for x in steps if x == "I" or x[0] == "R"]
            for roles in itertools.product(("user", "assistant"), repeat=len(free)):
                named, lines = iter(roles), []
                for x in steps:
                    if x == "I":
                        lines.append((next(named), ""))
                    elif x[0] == "R":
                        lines.append((next(named), x[1][2]))
                    elif x[0] == "K":
                        lines.append(x[1][1:])
                if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in lines)):
                    yield base + 2 * sum(inserts), "".join(x if x == "I" else x[0] for x in steps), "\n".join(f"{r}:{t}" for r, t in lines)


def naive(rows, most=3):
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    marks, turns = faults(rows), [t for t, _, _ in rows if t is not None]
    cost, audit, text = min(all_repairs(rows, most))
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *[marks.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def conversation(rng, n):
    texts = ["Yes.", "No", "", " \n", "Well? ", "Hm!", "a.b", "é。", None]
    return [(rng.choice([None, *range(9)]), rng.choice(["user", "user", "assistant", "assistant", "system", "tool", "", None]), rng.choice(texts)) for _ in range(n)]


def result(frame, **options):
    return {r["conv_id"]: tuple(r[k] for k in NAMES) for r in repair(frame, **options).collect()}


def test_repairs_equal_all_edit_sequences(spark):
    rng = random.Random(11)
    convs = {i: conversation(rng, rng.choice([1, 2, 3, 3, 4])) for i in range(60)}
    convs[None] = conversation(rng, 3)
    rows = [(c, *r) for c, own in convs.items() for r in own]
    got = result(spark.createDataFrame(rows, SCHEMA))
    assert got == {c: naive(own, 3 if len(own) < 4 else 2) for c, own in convs.items()}


def test_segments_equal_one_piece(spark):
    rng = random.Random(12)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), f"{rng.choice(['x', 'y'])} {rng.randrange(40)}{rng.choice(['.', '', '?'])}") for c, n in ((1, 150), (2, 7), (3, 31), (4, 64), (None, 90)) for t in range(n)]
    frame = spark.createDataFrame(rows, SCHEMA)
    whole = result(frame)
    assert len(whole) == 5 and max(len(r[6]) for r in whole.values()) >= 150
    for batch, segment in ((10, 8), (1, 1), (40, 31)):
        assert result(frame, batch_rows=batch, segment_rows=segment) == whole


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [] if kind == 0 else [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def test_damage_and_conversations_that_lose_all_rows(spark):
    rng = random.Random(13)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["One. Two!", "Three?", None])) for c in [None, *range(150)] for t in rng.sample([None, *range(6)], rng.choice([1, 1, 3]))]
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    got = result(spark.createDataFrame(rows, SCHEMA), fault=F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20)
    want = {c: naive(damaged([r for r in rows if r[0] == c]), 2) for c in {r[0] for r in rows}}
    assert got == want
    gone = [c for c in want if not damaged([r for r in rows if r[0] == c])]
    assert gone and all(got[c] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in gone)


@pytest.mark.parametrize("kind", ["string", "int"])
def test_other_ids_extra_columns_and_empty_tables(spark, kind):
    frame = spark.createDataFrame([(7, 1, "user", "Hi.", True, 5), (7, 2, "assistant", "Ho.", True, 6)], SCHEMA + ", ghost boolean, cost long").withColumn("conv_id", F.col("conv_id").cast(kind))
    (row,) = repair(frame).collect()
    assert str(row["conv_id"]) == "7" and (row["cost"], row["audit"]) == (0, "KK")
    assert row["repaired_sha256"] == hashlib.sha256(b"user:Hi.\nassistant:Ho.").hexdigest()
    assert repair(frame.limit(0)).collect() == []
    assert dict(repair(frame.limit(0)).dtypes)["conv_id"] == kind


def test_one_exchange_serves_windows_and_batches(spark):
    frame = spark.createDataFrame([(1, 1, "user", "Hi.")], SCHEMA)
    plan = repair(frame, F.col("turn") % 20)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange ") == 1 and plan.count("Sort [") == 2


def test_very_long_texts(spark):
    rows = [(1, 0, "user", "a " * 400_000 + "."), (1, 1, "assistant", " " * 500_000), (1, 2, "assistant", "b" * 300_000)]
    (row,) = repair(spark.createDataFrame(rows, SCHEMA)).collect()
    assert (row["blank"], row["truncated"], row["cost"], row["audit"]) == (1, 1, 4, "KDK")
