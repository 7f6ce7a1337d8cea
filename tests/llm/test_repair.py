"""Repair of conversations against a plain dynamic program over single messages."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from tidepanel.llm import queries, repair

BLANKS = "\t\n\x0b\x0c\r "


def judged(messages):
    faults, seen = [], set()
    for role, text in messages:
        core = text.rstrip(BLANKS)
        if not core:
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        else:
            seen.add((role, text))
            faults.append("" if core[-1] in ".!?" else "truncated")
    return faults


def brute(messages):
    """(faults, cost, audit, repaired messages): the best (cost, letters) into each state, message by message."""
    fits = {"": "su", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}

    def better(best, state, path):
        if state not in best or path[:2] < best[state][:2]:
            best[state] = path

    def insert(best):
        for _ in range(4):
            for state, (cost, letters, out) in list(best.items()):
                new = "a" if state == "u" else "u"
                better(best, new, (cost + 5, letters + "I", [*out, (names[new], "")]))
        return best

    faults, best = judged(messages), {"": (0, "", [])}
    for (role, text), fault in zip(messages, faults):
        after = {}
        for state, (cost, letters, out) in insert(best).items():
            better(after, state, (cost + 2, letters + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            cost += 5 * (fault == "truncated")
            if role[:1] and role[:1] in fits[state]:
                better(after, role[:1], (cost, letters + "K", [*out, (role, text)]))
            new = "a" if state == "u" else "u"
            better(after, new, (cost + 1, letters + "R", [*out, (names[new], text)]))
        best = after
    insert(best)
    return (faults, *min(best[s] for s in ("", "a") if s in best))


def random_messages(rng, most):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", " ", "unknown"]
    texts = ["a.", "b.", "c!", "d", "e", "", " \n", "f?  "]
    return [(rng.choice(roles), rng.choice([*texts, f"g{rng.random()}.", f"h{rng.random()}"])) for _ in range(rng.randint(0, most))]


def test_whole_conversations():
    rng = random.Random(3)
    for _ in range(3000):
        messages = random_messages(rng, 9)
        faults, cost, letters, out = brute(messages)
        found = repair.solve(list(range(len(messages))), messages)
        assert (found["cost"], found["audit"], found["repaired"]) == (cost, letters, repair.as_text(out))
        assert [found[k] for k in ("blank", "duplicate", "truncated")] == [faults.count(k) for k in ("blank", "duplicate", "truncated")]


def test_long_runs_take_powers():
    messages = [("user", f"{i}.") for i in range(5000)] + [("assistant", "x.")] * 3 + [("tool", f"{i}") for i in range(777)]
    _, cost, letters, out = brute(messages)
    found = repair.solve([None] * len(messages), messages)
    assert (found["cost"], found["audit"], found["repaired"], found["gaps"]) == (cost, letters, repair.as_text(out), 0)
    run = (("u", repair.SOUND), 5000)
    assert repair.apply(repair.matrix_of([run]), repair.AT_END) == repair.before_run(*run, repair.AT_END)


def damaged(rows):
    """Messages (turn, role, text) of each conversation after the planted faults, in order."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        name = lambda v: " " if v is None else str(v)
        role, text = name(role), name(text)
        kind = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out[conv] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def expected(rows):
    out = {}
    for conv, own in damaged(rows).items():
        own.sort(key=lambda m: (m[0] is not None, m[0] or 0))
        messages, turns = [m[1:] for m in own], [m[0] for m in own if m[0] is not None]
        faults, cost, letters, done = brute(messages)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(messages, messages[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        counts = [faults.count(k) for k in ("blank", "duplicate", "truncated")]
        out[conv] = (gaps, *counts, illegal, cost, letters, hashlib.sha256(repair.as_text(done).encode()).hexdigest())
    return out


def as_dict(found):
    rows = found.collect()
    out = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert as_dict(queries.op12_conversation_repair(spark, sf)) == expected(rows)


@pytest.mark.parametrize("block", [2, 7, 20_000])
def test_blocks(spark, block):
    """A conversation with most rows and others, in blocks of any size, gives what each gives alone."""
    rng = random.Random(block)
    rows = []
    for conv in range(12):
        for turn, (role, text) in enumerate(random_messages(rng, 12)):
            rows.append((conv, turn, role, text))
    rows += [(99, turn, role, text) for turn, (role, text) in enumerate((random_messages(rng, 9) * 60)[:300])]
    rows += [(7, None, "user", "without turn."), (None, 1, "user", "no id."), (None, 2, "assistant", None), (None, 3, None, "no role.")]
    rng.shuffle(rows)
    frame = spark.createDataFrame([(*r, "x", True) for r in rows], "conv_id long, turn long, role string, text string, block string, _order boolean")
    found = repair.digests(repair.repair(spark, repair.damage(frame), repair.RepairOptions(block=block)))
    assert as_dict(found) == expected(rows)


def test_real_outputs(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "And"), (1, 2, "user", "Why?"), (1, 3, "assistant", "So.")]
    found = repair.repair(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    pieces = sorted(found, key=lambda r: r.piece)
    assert "".join(r.audit for r in pieces) == "DDKK" and "\n".join(r.repaired for r in pieces if r.turns_left) == "user:Why?\nassistant:So."
    assert {(r.cost, r.truncated, r.illegal) for r in pieces} == {(4, 1, 1)}


def test_ties_take_the_least_letters():
    assert repair.solve([1], [("assistant", "x.")])["audit"] == "D"  # not IK
    assert repair.solve([1, 2], [("user", "x."), ("user", "y.")])["audit"] == "KR"
    assert repair.solve([1, 2, 3], [("user", "x."), ("user", "y."), ("assistant", "z.")])["audit"] == "DKK"  # not KDK


def test_repeated_rows_and_nothing_left(spark):
    frame = spark.createDataFrame([(1, 5, "user", "x.")] * 40 + [(2, t, "user", None) for t in range(3)], "conv_id long, turn long, role string, text string")
    found = as_dict(repair.digests(repair.repair(spark, frame, repair.RepairOptions(block=8))))
    assert found[1][:6] == (0, 0, 39, 0, 39, 2 * 40) and found[1][6] == "D" * 40
    assert found[2] == (0, 3, 0, 0, 2, 6, "DDD", hashlib.sha256(b"").hexdigest())
    gone = frame.withColumn("gone", frame["conv_id"] == 1)
    assert as_dict(repair.digests(repair.repair(spark, gone)))[1] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert as_dict(repair.digests(repair.repair(spark, frame.limit(0)))) == {}
