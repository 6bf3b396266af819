"""Conversation repair against a plain search over all edits."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import cache

import pytest

from tidewatch.llm import conversations

SHAPE = "conv_id long, turn long, role string, text string, cost string, place long, audit string"
WHITE = re.compile(r"[^\x20\x09-\x0D]")
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
FULL = {"u": "user", "a": "assistant"}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        one = lambda x: " " if x is None else str(x)
        how = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        role, text = one(role), one(text)
        if how:
            row = (conv, turn, "user" if how == 4 else role, "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text)
            out += [row] * (2 if how == 3 else 1)
    return out


def cheapest(turns):
    """(cost, audit) over (initial, fault) by trying every edit."""

    @cache
    def best(i, last, inserts):
        ways = []
        if i == len(turns):
            if last in ("", "a"):
                ways.append((0, ""))
        else:
            initial, fault = turns[i]
            cost, rest = best(i + 1, last, 3)
            ways.append((cost + 3, "D" + rest))
            if fault in ("", "truncated"):
                more = int(fault == "truncated")
                if initial == NEXT[last] or (initial == "s" and last == ""):
                    cost, rest = best(i + 1, initial, 3)
                    ways.append((cost + more, "K" + rest))
                cost, rest = best(i + 1, NEXT[last], 3)
                ways.append((cost + 2 + more, "R" + rest))
        if inserts:
            cost, rest = best(i, NEXT[last], inserts - 1)
            ways.append((cost + 2, "I" + rest))
        return min(ways, default=(10**9, ""))

    return best(0, "", 3)


def plain(rows, hurt=True):
    by = defaultdict(list)
    for r in damage(rows) if hurt else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]:
        by[r[0]].append(r[1:])
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(by[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in turns:
            end = WHITE.findall(text)
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else "" if end[-1] in ".!?" else "truncated")
            seen.add((role, text))
        initials = [r[:1] for _, r, _ in turns]
        cost, audit = cheapest(tuple(zip(initials, faults, strict=True)))
        lines, last, i = [], "", 0
        for letter in audit:
            if letter != "D":
                last = initials[i] if letter == "K" else NEXT[last]
                lines.append(f"{turns[i][1] if letter == 'K' else FULL[last]}:{'' if letter == 'I' else turns[i][2]}")
            i += letter != "I"
        assert re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x in lines))
        numbers = [t for t, *_ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def held(df):
    rows = df.collect()
    got = {r[0]: tuple(r)[1:] for r in rows}
    assert len(got) == len(rows)
    return got


def test_repair_equals_plain_search(spark, small):
    df = spark.read.parquet(f"{small}/conversations.parquet")
    assert held(conversations.query(spark, small)) == plain([(r.conv_id, r.turn, r.role, r.text) for r in df.collect()])


def odd_rows(seed):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "admin", "éa", "User"]
    texts = ["Fine.", "Fine.", "Cut", "", None, " \t\x0b", "What?! ", "Same words.", "Long. " * 50, "odd\x1c", "ends here。"]
    rows = [(rng.choice([None, *range(30)]), rng.choice([None, *range(8), 10**12]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"Words {k}.") for k in range(260)]
    return rows + rows[:20]


@pytest.mark.parametrize("shift", [10, 2, 0])
def test_odd_rows_in_blocks_of_any_size(spark, shift):
    """Blocks of one and of four turns send nearly all conversations through the chain of blocks."""
    rows = odd_rows(shift)
    df = spark.createDataFrame([(*r, "mine", 5, "mine") for r in rows], SHAPE)
    assert held(conversations.repair(conversations.damaged(df), shift)) == plain(rows)
    assert held(conversations.repair(conversations.as_they_are(df), shift)) == plain(rows, hurt=False)


def test_one_long_conversation(spark):
    rng = random.Random(5)
    rows = [(7, k, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice([f"Turn {k}.", f"Turn {k}.", "again and again.", f"cut {k}", ""])) for k in range(600)] + [(k, 0, "user", "Hello.") for k in range(100, 130)]
    df = spark.createDataFrame([(*r, "", 0, "") for r in rows], SHAPE).repartition(5)
    assert held(conversations.repair(conversations.damaged(df), 4)) == plain(rows)


def test_nothing_left(spark):
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hello.", "", 0, "")], SHAPE)
    assert held(conversations.repair(conversations.damaged(df))) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert conversations.repair(conversations.damaged(df.where("false"))).collect() == []


@pytest.mark.parametrize("seed", range(20))
def test_bucket_queue_alone(seed):
    rng = random.Random(seed)
    turns = [(rng.choice(["s", "u", "a", "x", ""]), rng.choice([0, 0, 1, 2, 3])) for _ in range(rng.randrange(12))]
    dist = conversations.distances(turns, conversations.OPEN, True)
    want = cheapest(tuple((i, ("", "blank", "duplicate", "truncated")[f]) for i, f in turns))
    assert (dist[0][0], conversations.walk_arcs(turns, dist, 0, True)[0]) == want
