import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from scriptorium.llm import conversation_repair as cr

LEGAL = re.compile(r"(s?(ua)+)?")
COST = {"K": 0, "R": 1, "D": 2, "I": 5}


def all_edits(signature, inserts):
    """Every (cost, audit) that gives a legal sequence with at most so many inserts."""
    found = []
    rows = []
    for c in signature:
        if c in cr.BLANK + cr.DUPLICATE:
            rows.append([("D", None, 2)])
        else:
            more = 5 if c in cr.TRUNCATED else 0
            rows.append([("D", None, 2), ("K", c.lower(), more), ("R", "u", 1 + more), ("R", "a", 1 + more)])
    for picked in itertools.product(*rows):
        for places in itertools.chain.from_iterable(itertools.combinations_with_replacement(range(len(rows) + 1), n) for n in range(inserts + 1)):
            for roles in itertools.product("ua", repeat=len(places)):
                sequence, audit, cost = "", "", 5 * len(places)
                waiting = list(zip(places, roles, strict=True))
                for k in range(len(rows) + 1):
                    for p, role in waiting:
                        if p == k:
                            sequence, audit = sequence + role, audit + "I"
                    if k < len(rows):
                        edit, role, c = picked[k]
                        sequence, audit, cost = sequence + (role or ""), audit + edit, cost + c
                if LEGAL.fullmatch(sequence):
                    found.append((cost, audit))
    return min(found)


@pytest.mark.parametrize("length", range(5))
def test_solve_equals_all_edits(length):
    letters = "suaxSUAX15"
    cases = list(itertools.product(letters, repeat=length))
    for case in random.Random(length).sample(cases, min(len(cases), 120)):
        signature = "".join(case)
        assert cr.solve(signature) == all_edits(signature, 2), signature


def test_a_long_signature_needs_no_deep_recursion():
    cost, audit = cr.solve("s" + "ua" * 50_000 + "u")
    assert cost == 2 and audit.count("D") == 1 and len(audit) == 100_002


def brute(rows):
    """The report of rows (conv, turn, role, text), one conversation after another."""
    out = {}
    for conv in {r[0] for r in rows}:
        kept = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if h == 0:
                continue
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            kept += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
        seen, signature, faults = set(), "", [0, 0, 0]
        for _, role, text in kept:
            shown = re.findall(r"[^\x20\x09-\x0D]", text)
            kind = cr.BLANK if not shown else cr.DUPLICATE if (role, text) in seen else cr.TRUNCATED if shown[-1] not in ".!?" else cr.SOUND
            seen.add((role, text))
            for k, name in enumerate((cr.BLANK, cr.DUPLICATE, cr.TRUNCATED)):
                faults[k] += kind == name
            signature += kind["sua".index(role[0]) if role[:1] and role[0] in "sua" else 3]
        initials = [r[1][:1] for r in kept]
        cost, audit = cr.solve(signature)
        lines, k, emitted = [], 0, ""
        for edit in audit:
            role, text = ("", "") if edit == "I" else kept[k][1:]
            if edit == "K":
                lines.append(f"{role}:{text}")
                emitted += role[0]
            elif edit != "D":
                emitted += "a" if emitted.endswith("u") else "u"
                lines.append(("user:" if emitted[-1] == "u" else "assistant:") + text)
            k += edit != "I"
        assert LEGAL.fullmatch(emitted)
        turns = {r[0] for r in kept} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        bad = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        out[conv] = (gaps, *faults, bad, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines)
    return out


SCHEMA = "conv_id long, turn long, role string, text string"


def sample_rows():
    rng = random.Random(5)
    texts = ["Yes.", "No!", "Why?", "It stops here", "", " \n\t", None, "Ünï. ", "ends with a dot .\n", "a:b\nc."]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "agent", None, "", "tool", "x"]), rng.choice(texts)) for c in [None, *range(40)] for t in [None, *range(rng.randrange(9))]]
    rows += [(50, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(400)] + [(51, t, "user", "Same.") for t in range(90)]
    rows += [(52, 3, "user", "Twice."), (52, 3, "user", "Twice."), (52, 9, "assistant", "x" * 40_000 + ".")]
    rows += [(60 + c, t, ("user", "assistant")[t % 2], f"Hot {t}.") for c in range(60) for t in range(2)]
    return rows


def test_report_equals_brute_force(spark):
    rows = sample_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7).withColumns({c: F.lit("x") for c in ("conv", "digest", "audit", "piece", "_row")})
    report = cr.repair_report(cr.damage(docs), docs.select(F.col("conv_id").alias("conv")))
    want = brute(rows)
    assert {r.conv: tuple(r)[1:] for r in report.collect()} == {c: w[:-1] for c, w in want.items()}
    hurt = cr.damage(docs)
    lines = {}
    for r in sorted(cr.repaired(hurt, cr.audits(hurt)).collect(), key=lambda r: r.place):
        lines.setdefault(r.conv, []).append(f"{r.role}:{r.text}")
    assert lines == {c: w[-1] for c, w in want.items() if w[-1]}


def test_no_conversations(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert cr.repair_report(cr.damage(none), none.select(F.col("conv_id").alias("conv"))).count() == 0


def test_one_solution_a_signature(spark):
    rows = spark.createDataFrame([(c, t, ("user", "assistant")[t % 2], f"Text {c}.") for c in range(300) for t in range(2)], "conv long, turn long, role string, text string")
    signed = cr.signatures(rows)
    assert signed.count() == 300
    assert [(r.signature, r.conversations, r.audit) for r in cr.solutions(signed).collect()] == [("ua", 300, "KK")]
