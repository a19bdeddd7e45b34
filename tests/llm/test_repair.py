"""Conversation repair against trying every edit, over segments of every size, and its odd cases."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from tracklens.llm import repair

ROWS = "conv_id bigint, turn bigint, role string, text string"
WHITE = re.compile(r"[^\x20\x09-\x0D]")
GRAMMAR = re.compile(r"(s?(ua)+)?")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def faults(turns):
    seen, out = set(), []
    for role, text in turns:
        shown = WHITE.findall(text)
        out.append("b" if not shown else "d" if (role, text) in seen else "t" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain(turns):
    """(cost, audit, repaired) of the best edits, by trying all; at most two insertions at each place are ever worth while."""
    bad = faults(turns)
    choices = [["D"] if f in ("b", "d") else ["D", "K", "Ru", "Ra"] for f in bad]
    fills = ["", "u", "a", "ua", "au"]
    best = None
    for edits in product(*choices):
        for inserted in product(fills, repeat=len(turns) + 1):
            roles, audit, cost, lines = "", "", 0, []
            for k, fill in enumerate(inserted):
                for r in fill:
                    roles, audit, cost = roles + r, audit + "I", cost + 2
                    lines.append({"u": "user", "a": "assistant"}[r] + ":")
                if k == len(turns):
                    break
                audit += edits[k][0]
                if edits[k] == "D":
                    cost += 3
                    continue
                role = turns[k][0] if edits[k] == "K" else {"u": "user", "a": "assistant"}[edits[k][1]]
                cost += (2 if edits[k] != "K" else 0) + (bad[k] == "t")
                roles += role[:1]
                lines.append(f"{role}:{turns[k][1]}")
            if GRAMMAR.fullmatch(roles) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, "\n".join(lines))
    return best


def whole(spark, rows, **kw):
    return {r["conv_id"]: r for r in repair.digests(repair.repair(spark.createDataFrame(rows, ROWS), **kw)).collect()}


def test_against_trying_every_edit(spark):
    rng = random.Random(3)
    texts = ["a.", "b!", "c", " ", "d?\n", "a."]
    conversations = {c: [(rng.choice(["system", "user", "assistant", "tool", " "]) if rng.random() < 0.3 else rng.choice(["user", "assistant"]), rng.choice(texts) if rng.random() < 0.7 else f"x{k}.") for k in range(rng.randint(1, 3))] for c in range(120)}
    rows = [(c, k, *t) for c, turns in conversations.items() for k, t in enumerate(turns)]
    want = {c: plain(t) for c, t in conversations.items()}
    for most in (1, 2, 1024):
        got = whole(spark, rows, most=most)
        assert {c: (r["cost"], r["audit"], r["repaired_sha256"]) for c, r in got.items()} == {c: (cost, audit, sha(text)) for c, (cost, audit, text) in want.items()}


def test_long_conversation_over_many_partitions(spark):
    """A hot conversation is searched in segments, with the result of one search over all."""
    rng = random.Random(4)
    turns = [(rng.choice(["user", "assistant"]), rng.choice(["yes.", "no", "", f"t{k}."])) for k in range(3000)] + [("system", "end.")]
    rows = [(7, k // 2 * 3, *t) for k, t in enumerate(turns)] + [(8, 1, "user", "a.")]
    ordered = sorted(rows[:-1], key=lambda r: r[1:])
    bad = faults([r[2:] for r in ordered])
    cost, audit = min(p for k, p in enumerate(repair.search(zip([r[2][:1] for r in ordered], bad, strict=True), 0)) if p and k in (0, 3))
    for most in (50, 1024):
        r = whole(spark, rows, most=most)[7]
        assert (r["cost"], r["audit"], r["blank"], r["duplicate"], r["truncated"]) == (cost, audit, bad.count("b"), bad.count("d"), bad.count("t"))
        assert r["gaps"] == 4501 - 1501 and r["illegal"] == sum(a[2][0] + b[2][0] not in repair.LEGAL for a, b in zip(ordered, ordered[1:], strict=False))
        assert r["repaired_sha256"] == sha("\n".join(f"{t['role']}:{t['text']}" for t in repair.edited([{"role": r[2], "text": r[3]} for r in ordered], audit, 0)))


def test_damage_and_report(spark):
    turns = [(c, t, "assistant", "Hi. Ok!") for c in range(40) for t in range(2)]
    got = sorted((r["conv_id"], r["turn"], r["role"], r["text"]) for r in repair.damage(spark.createDataFrame(turns, ROWS)).collect())
    want = []
    for c, t, role, text in turns:
        kind = zlib.crc32(f"{c}:{t}".encode()) % 20
        if kind:
            want += [(c, t, "user" if kind == 4 else role, "" if kind == 1 else "Hi Ok" if kind == 2 else text)] * (2 if kind == 3 else 1)
    assert got == sorted(want)
    dropped = next(c for c in range(9999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = {r["conv_id"]: r for r in repair.report(spark.createDataFrame([(dropped, 0, "user", "a."), (None, None, None, None), (None, 4, "user", "b.")], ROWS)).collect()}
    assert tuple(rows[dropped])[1:] == (0, 0, 0, 0, 0, 0, "", sha(""))
    assert set(rows) == {dropped, None} and rows[None]["blank"] == 1 and rows[None]["gaps"] == 0


def test_ties_nulls_long_texts_and_other_columns(spark):
    rows = [(1, None, None, "x"), (1, None, "user", None), (1, 2, "user", "a."), (1, 2, "user", "a."), (2, 1, "user", "y" * 2_000_000), (2, 2, "assistant", "z.")]
    got = {r["conv_id"]: r for r in repair.digests(repair.repair(spark.createDataFrame([(*r, 1) for r in rows], ROWS + ", blank int"))).collect()}
    assert (got[1]["blank"], got[1]["duplicate"], got[1]["truncated"], got[1]["gaps"]) == (1, 1, 1, 0)
    assert (got[2]["cost"], got[2]["audit"]) == (1, "KK")
    empty = spark.createDataFrame([], ROWS)
    assert repair.report(empty).count() == 0


@pytest.mark.parametrize("roles, want", [("", (0, "")), ("s", (3, "D")), ("sua", (0, "KKK")), ("au", (4, "IKKI")), ("uu", (2, "KR")), ("aa", (2, "RK")), ("usa", (3, "KDK"))])
def test_small_searches(roles, want):
    ends = repair.search([(r, "") for r in roles], 0)
    assert min(p for k, p in enumerate(ends) if p and k in (0, 3)) == want
