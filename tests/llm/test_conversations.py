"""Repair of conversations against a plain search over all edits."""

import functools
import hashlib
import random
import re
import zlib

import pytest

from signalpact.llm import conversations as conv
from signalpact.llm.text import table

BLANK = re.compile(r"[\x20\x09-\x0D]*")


def damaged(rows):
    out = []
    for turn, role, text in rows:
        out.append([turn, " " if role is None else role, " " if text is None else text])
    return out


def expected(conv_id, rows):
    """One report by plain loops: rows are (turn, role, text)."""
    after = []
    for turn, role, text in damaged(rows):
        by = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if by == 1 else re.sub("[.!?]", "", text) if by == 2 else text
        role = "user" if by == 4 else role
        after += [(turn, role, text)] * (0 if by == 0 else 2 if by == 3 else 1)
    after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, seen = [], set()
    for _, role, text in after:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(after, after[1:])]
    turns = {t for t, _, _ in after if t is not None}

    @functools.cache
    def best(i, state, inserted):
        """(cost, audit, repaired) from row i on, after an output of role ``state``."""
        found = [(0, "", ())] if i == len(after) and state in "_a" else []
        speaker = "assistant" if state == "u" else "user"
        if inserted < 2:
            c, audit, out = best(i, speaker[0], inserted + 1)
            found.append((c + 3, "I" + audit, ((speaker, ""), *out)))
        if i < len(after):
            _, role, text = after[i]
            c, audit, out = best(i + 1, state, 0)
            found.append((c + 4, "D" + audit, out))
            if faults[i] not in ("blank", "duplicate"):
                extra = 3 * (faults[i] == "truncated")
                if state + role[:1] in ("_s", "_u", "su", "ua", "au"):
                    c, audit, out = best(i + 1, role[:1], 0)
                    found.append((c + extra, "K" + audit, ((role, text), *out)))
                c, audit, out = best(i + 1, speaker[0], 0)
                found.append((c + extra + 3, "R" + audit, ((speaker, text), *out)))
        return min(found) if found else (1 << 30, "", ())

    cost, audit, out = best(0, "_", 0)
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def rows_of(n, seed):
    rng = random.Random(seed)
    out = []
    for c in [None, *range(n)]:
        for _ in range(rng.choice([1, 2, 3, 5, 8, 30])):
            out.append((c, rng.choice([None, *range(12)]) if rng.random() < .9 else rng.randint(-9, 1 << 40),
                        rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "u", None, "Assistant"]),
                        rng.choice(["Yes.", "No!", "cut", " \n", "", None, "tail. \n", "ünï?", f"word {rng.randint(0, 9)}.", "x" * 50 + "."])))
    return out


def check(spark, rows, docs=None):
    docs = docs or spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = conv.report(docs, conv.repair(conv.damage(docs))).collect()
    by_id = {}
    for c, *row in rows:
        by_id.setdefault(c, []).append(tuple(row))
    want = {c: expected(c, r) for c, r in by_id.items()}
    assert len(got) == len(want)
    assert {r.conv_id: tuple(r)[1:] for r in got} == want


@pytest.mark.parametrize("entries,fan", [(4096, 1024), (3, 2), (1, 4)])
def test_repair_equals_plain_search(spark, entries, fan, monkeypatch):
    monkeypatch.setattr(conv, "ENTRIES", entries)
    monkeypatch.setattr(conv, "FAN", fan)
    check(spark, rows_of(60 if entries > 3 else 25, entries))


def test_repair_of_a_long_conversation_and_copies(spark, monkeypatch):
    monkeypatch.setattr(conv, "ENTRIES", 16)
    rng = random.Random(5)
    long = [(1, t, rng.choice(["user", "assistant"]), rng.choice([f"text {t}.", "again.", "cut"])) for t in range(150)]
    check(spark, [*long, *[(2, 3, "user", "same.")] * 40, *[(2, None, "assistant", "same.")] * 30])


def test_repair_edge_cases(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conv.report(empty, conv.repair(conv.damage(empty))).count() == 0
    clashing = spark.createDataFrame([("b", 1, "user", "Hi.", 1, "x"), (None, None, None, None, 2, "y")],
                                     "conv_id string, turn int, role string, text string, copies int, same string")
    check(spark, [("b", 1, "user", "Hi."), (None, None, None, None)], clashing)


def test_repair_of_the_table(spark):
    frame = table(spark, "/root/testdata/sf0.01", "conversations")
    check(spark, [tuple(r) for r in frame.collect()], frame)
