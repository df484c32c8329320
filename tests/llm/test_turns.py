"""Repairs of conversations against plain searches."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from tessella.llm import turns
from tessella.llm.turns import Repairer, damage, digests, repair

SCHEMA = "conv_id long, turn long, role string, text string, part int, fault string, copies int"


def search(signs):
    """Least (cost, audit) by a plain table from the end over (turn, state), audits as strings."""
    best = {}

    def better(a, b):
        return a if b is None or a is not None and a < b else b

    for i in range(len(signs), -1, -1):
        now = {}
        for q in (0, 1, 2, 3, 2, 0, 1):  # an insertion leads to a state that is done, twice round is enough
            ways = []
            if i == len(signs):
                if q in (0, 3):
                    ways.append((0, ""))
            else:
                sign = signs[i]
                role, extra = sign.lower(), int(sign != sign.lower())
                c, a = best[i + 1][q]
                ways.append((c + 3, "D" + a))
                if sign != "d":
                    to = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}.get((q, role))
                    if to is not None:
                        c, a = best[i + 1][to]
                        ways.append((c + extra, "K" + a))
                    c, a = best[i + 1][3 if q == 2 else 2]
                    ways.append((c + 2 + extra, "R" + a))
            to = 3 if q == 2 else 2
            for z in (2, 3):
                if z in now and z == to:
                    ways.append((now[z][0] + 2, "I" + now[z][1]))
            for w in ways:
                now[q] = better(w, now.get(q))
        best[i] = now
    return best[0][0]


def by_hand(rows):
    """The contract, row by row: rows (conv, turn, role, text)."""
    kept = defaultdict(list)
    space = lambda v: " " if v is None else str(v)
    for conv, turn, role, text in rows:
        kept[conv]
        pick = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        if pick == 0:
            continue
        text = "" if pick == 1 else re.sub("[.!?]", "", text) if pick == 2 else text
        role = "user" if pick == 4 else role
        kept[conv] += [(turn, role, text)] * (2 if pick == 3 else 1)
    out = {}
    for conv, rs in kept.items():
        rs.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1][:32], r[2][:32]))
        seen, faults = set(), []
        for _, role, text in rs:
            rest = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            faults.append("b" if not rest else "d" if (role, text) in seen else "t" if rest[-1] not in ".!?" else "")
            seen.add((role, text))
        first = [r[1][:1] for r in rs]
        numbers = [r[0] for r in rs if r[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
        signs = "".join(turns._sign(a, f) for a, f in zip(first, faults))
        cost, audit = search(signs)
        lines, state, i = [], 0, 0
        for edit in audit:
            given = "assistant" if state == 2 else "user"
            if edit == "I":
                lines.append(given + ":")
                state = 3 if state == 2 else 2
                continue
            if edit == "K":
                lines.append(f"{rs[i][1]}:{rs[i][2]}")
                state = {"s": 1, "u": 2, "a": 3}[first[i]]
            elif edit == "R":
                lines.append(f"{given}:{rs[i][2]}")
                state = 3 if state == 2 else 2
            i += 1
        count = faults.count
        out[conv] = (gaps, count("b"), count("d"), count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


@pytest.mark.parametrize("block", [64, 3])
def test_layers_against_a_search(block, monkeypatch):
    monkeypatch.setattr(turns, "BLOCK", block)
    rnd = random.Random(block)
    r = Repairer()
    for _ in range(4000):
        signs = "".join(rnd.choice("ssuuuaaaxdSUAX") for _ in range(rnd.choice([0, 1, 2, 3, 5, 9, 14])))
        assert r.whole(signs) == search(signs), signs


def test_parts_join_to_the_whole():
    """A conversation cut anywhere has the cost and the audit of the uncut one."""
    rnd = random.Random(2)
    r = Repairer()
    for _ in range(400):
        signs = "".join(rnd.choice("suuaaxdSUA") for _ in range(rnd.randint(0, 16)))
        cuts = sorted(rnd.randint(0, len(signs)) for _ in range(3))
        parts = [r.part(signs[a:b]) for a, b in zip([0, *cuts], [*cuts, len(signs)])]
        cost, states = turns.joined(parts, {q: 2 * k for q, k in enumerate(turns.TO_ACCEPT)}, 0)
        audit = "".join(p[a, b][1] for p, a, b in zip(parts, states, states[1:])) + "I" * turns.TO_ACCEPT[states[-1]]
        assert (cost, audit) == search(signs)


def rows_for(rnd, odd):
    texts = ["Yes.", "no", "Why? ", " \n", "", "a. ", "Go!", "é…", "x" * 4000 + ".", None]
    roles = ["user", "assistant", "system", "tool", "", None, "ursa"]
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rnd.randint(1, 9)):
            role = rnd.choice(roles) if odd else ["user", "assistant"][turn % 2]
            n = rnd.choice([turn, turn, turn + 2, None]) if odd else turn
            rows.append((conv, n, role, rnd.choice(texts)))
    # rows that are the same but for their turns, and some that are wholly the same
    rows += [(7, t, "user", "the same.") for t in range(200)] + [(7, 3, "user", "the same.")] * 100
    rows += [(8, t, rnd.choice(roles[:3]), f"text {rnd.randint(0, 90)}.") for t in range(700)]
    rnd.shuffle(rows)
    return rows


def result(df):
    out = {}
    for r in df.collect():
        assert r.conv_id not in out
        out[r.conv_id] = tuple(r)[1:]
    return out


@pytest.mark.parametrize("odd,parts", [(False, 8), (True, 8), (True, 40)])
def test_conversations(spark, odd, parts):
    rows = rows_for(random.Random(odd), odd)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame([(*r, 5, "z", 9) for r in rows], SCHEMA)
        assert result(digests(repair(damage(df)))) == by_hand(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_all_dropped_and_empty(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hi.", 1, "", 1)], SCHEMA)
    assert result(digests(repair(damage(df)))) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert digests(repair(damage(df.limit(0)))).count() == 0
