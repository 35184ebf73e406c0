"""Repair of conversations against all edits of short ones, on giant ones, and on odd rows."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from chronoweave.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string, gone boolean, kind int, fault int, conv string"


def table(spark, rows):
    """With columns named like those that the operator makes, half of them null."""
    return spark.createDataFrame([(c, t, r, x, False, None, 7, None) for c, t, r, x in rows], SCHEMA)


def own(text):
    return text.strip(" \t\n\x0b\f\r")


def plain(rows):
    """(faults, cost, audit, lines) by trying every edit of every row and up to two insertions at each place."""
    seen, faults = set(), []
    for role, text in rows:
        faults.append("blank" if not own(text) else "duplicate" if (role, text) in seen else "truncated" if own(text)[-1] not in ".!?" else "")
        seen.add((role, text))
    best = None
    for edits in itertools.product(*("D" if f in ("blank", "duplicate") else "DKua" for f in faults)):
        for inserts in itertools.product(("", "u", "a", "ua", "au"), repeat=len(rows) + 1):
            cost = 5 * sum(map(len, inserts)) + sum({"D": 2, "K": 0}.get(e, 1) + (5 if e != "D" and f == "truncated" else 0) for e, f in zip(edits, faults))
            if best and cost > best[0]:
                continue
            lines, audit = [], ""
            for (role, text), e, before in zip([*rows, ("", "")], [*edits, ""], inserts):
                for i in before:
                    lines.append(("user:" if i == "u" else "assistant:", i))
                    audit += "I"
                if e:
                    audit += e if e in "DK" else "R"
                if e and e != "D":
                    name = {"K": role, "u": "user", "a": "assistant"}[e]
                    lines.append((f"{name}:{text}", name[:1]))
            if re.fullmatch("(s?(ua)+)?", "".join(i or "-" for _, i in lines)) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, [x for x, _ in lines]
    return faults, *best


@pytest.fixture(scope="module")
def short():
    rng = random.Random(3)
    texts = ["Yes.", "No?", "cut", " \n", "A longer one. ", "and", "!"]
    return {c: [(rng.choice(["user", "user", "assistant", "assistant", "system", "tool"]), rng.choice(texts)) for _ in range(rng.randint(1, 3))] for c in range(120)}


def test_against_all_edits(spark, short):
    rows = [(c, 3 * t, r, x) for c, conv in short.items() for t, (r, x) in enumerate(conv)]
    got = {r.conv_id: r for r in conversations.audits(table(spark, rows).repartition(5)).collect()}
    lines = {}
    for r in conversations.repaired(table(spark, rows)).orderBy("conv_id", "place").collect():
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert set(got) == set(short)
    for c, conv in short.items():
        faults, cost, audit, want = plain(conv)
        r = got[c]
        assert (r.cost, r.audit, r.repaired_sha256) == (cost, audit, hashlib.sha256("\n".join(want).encode()).hexdigest()), conv
        assert (r.blank, r.duplicate, r.truncated) == tuple(faults.count(f) for f in ("blank", "duplicate", "truncated"))
        assert r.gaps == 2 * (len(conv) - 1)
        assert r.illegal == sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(conv))
        assert lines.get(c, []) == want


@pytest.mark.parametrize("roles", [("user", "assistant"), ("tool",), ("user", "user", "assistant", "system")])
def test_giant_conversation_settles_or_spills(spark, roles):
    """The same whatever waits in memory; rows of another role leave two paths open to the end."""
    n = 5001
    rows = [(1, t, roles[t % len(roles)], f"turn {t}{'.' if t % 7 else ''}") for t in range(n)]
    few = conversations.audits(table(spark, rows), settle=64, spill=1000).collect()
    assert few == conversations.audits(table(spark, rows), settle=100_000).collect()
    assert len(few[0].audit.replace("I", "")) == n
    turns = conversations.repaired(table(spark, rows), settle=64, spill=1000).orderBy("place").collect()
    assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in turns).encode()).hexdigest() == few[0].repaired_sha256


def test_odd_rows(spark):
    rows = [
        (None, None, None, None), (None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."),
        (2**62 + 1, None, "user", "A."), (2**62 + 1, None, "assistant", "B."),
        (2**62, 5, "user", "Same."), (2**62, 5, "user", "Same."), (2**62, 9, "assistant", "x" * 400_000 + "."), (7, 1, "", "?"), (8, 1, "user", ""),
    ]
    got = {r.conv_id: r for r in conversations.audits(table(spark, rows)).collect()}
    assert len(got) == 5
    assert (got[None].blank, got[None].illegal, got[None].audit, got[None].gaps) == (1, 1, "DKK", 0)
    assert (got[2**62 + 1].gaps, got[2**62 + 1].audit, got[2**62 + 1].cost) == (0, "RR", 2)  # assistant stands before user by name
    assert (got[2**62].duplicate, got[2**62].gaps, got[2**62].audit) == (1, 3, "KDK")
    assert (got[7].audit, got[7].cost, got[8].audit, got[8].blank) == ("D", 2, "D", 1)
    assert got[8].repaired_sha256 == hashlib.sha256(b"").hexdigest()
    empty = table(spark, []).limit(0)
    assert conversations.audits(conversations.damaged(empty)).count() == 0 and conversations.repaired(empty).count() == 0


def test_damage_keeps_every_conversation(spark):
    """A conversation whose rows are all dropped still has its row, of zeros."""
    rows = [(c, 0, "user", "Hello there.") for c in range(200)] + [(None, None, None, None)]
    damaged = conversations.damaged(table(spark, rows))
    gone = {r.conv_id for r in damaged.where("gone").collect()}
    assert gone and len(gone) < 200
    got = {r.conv_id: r for r in conversations.audits(damaged).collect()}
    assert len(got) == 201
    for c in gone:
        assert tuple(got[c])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    by_code = table(spark, rows).where("conv_id is not null").select("conv_id", (F.crc32(F.concat_ws(":", "conv_id", "turn")) % 20).alias("d"))
    twice = {r.conv_id for r in by_code.where("d = 3").collect()}
    assert {c for c, r in got.items() if r.duplicate} == twice and twice
