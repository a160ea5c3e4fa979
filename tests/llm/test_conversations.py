"""Conversation repair against brute force."""

import hashlib
import random
import re
import zlib
from functools import lru_cache
from itertools import product

import pytest

from candlewick.llm import conversations
from candlewick.llm.conversations import DROP, START, TERMINAL, before

SPACE = " \t\n\x0b\x0c\r"


def exhaustive(symbols):
    """Cheapest (cost, audit) of a few rows by trying every edit and up to three insertions at each place."""
    inserts = ["".join(p) for n in range(4) for p in product("ua", repeat=n)]
    best = None
    for rows in product(*[["D"] if s == DROP else ["D", "K", "Ru", "Ra"] for s in symbols]):
        roles = [{"D": "", "K": s.lower(), "Ru": "u", "Ra": "a"}[e] for e, s in zip(rows, symbols)]
        cost = sum({"D": 3, "K": 0}.get(e, 2) + (s.isupper() and e != "D") for e, s in zip(rows, symbols))
        for places in product(inserts, repeat=len(rows) + 1):
            made = "".join(i + r for i, r in zip(places, [*roles, ""]))
            if re.fullmatch("(s?(ua)+)?", made):
                audit = "".join("I" * len(i) + e[:1] for i, e in zip(places, [*rows, ""]))
                option = (cost + 2 * sum(map(len, places)), audit)
                best = option if best is None else min(best, option)
    return best


@pytest.mark.parametrize("n", range(3))
def test_nodes_equal_every_edit_tried(n):
    for symbols in product("suaoSUAO" + DROP, repeat=n):
        node = TERMINAL
        for s in reversed(symbols):
            node = before(s, node)
        assert node[START] == exhaustive(symbols), symbols


def naive(rows):
    """Every contract column of one table of (conv_id, turn, role, text), conversation by conversation."""
    kept, out = {}, {}
    for conv, turn, role, text in rows:
        word = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{word(conv)}:{word(turn)}".encode()) % 20
        role, text = word(role), word(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        kept.setdefault(conv, []).extend([(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    for conv, own in kept.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
        turns, seen, faults = {t for t, _, _ in own if t is not None}, set(), []
        for _, role, text in own:
            end = text.rstrip(SPACE)
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[:1] for _, r, _ in own]

        @lru_cache(None)
        def best(i, state, inserted=0):
            """(cost, audit, repaired rows) from row i on; state: the last role's initial, or ''."""
            options = []
            role = "a" if state == "u" else "u"
            if inserted < 3:
                c, a, t = best(i, role, inserted + 1)
                options.append((c + 2, "I" + a, ({"u": "user:", "a": "assistant:"}[role], *t)))
            if i == len(own):
                return min([*options, (0 if state in ("", "a") else 10**6, "", ())])
            _, name, text = own[i]
            c, a, t = best(i + 1, state)
            options.append((c + 3, "D" + a, t))
            if faults[i] not in ("blank", "duplicate"):
                extra = faults[i] == "truncated"
                c, a, t = best(i + 1, role)
                options.append((c + 2 + extra, "R" + a, ({"u": "user:", "a": "assistant:"}[role] + text, *t)))
                if initials[i] == role or initials[i] == "s" and state == "":
                    c, a, t = best(i + 1, initials[i])
                    options.append((c + extra, "K" + a, (f"{name}:{text}", *t)))
            return min(options, key=lambda o: o[:2])

        cost, audit, repaired = best(0, "")
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv] = (conv, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest())
    return sorted(out.values(), key=str)


def found(df):
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted(map(tuple, df.collect()), key=str)


SCHEMA = "conv_id long, turn long, role string, text string, k long, cell string"


@pytest.mark.parametrize("size", [conversations.CHUNK, 3])
def test_given_table(spark, sf, size):
    rows = spark.read.parquet(f"{sf}/conversations.parquet")
    assert found(conversations.repair(rows, size)) == naive([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in rows.collect()])


@pytest.mark.parametrize("size", [conversations.CHUNK, 1, 4])
def test_random_conversations(spark, size):
    rng = random.Random(size)
    texts = ["Yes.", "No", "", " \t", None, "Wait! what", "Fine?\n", "…", "naïve 💡."]
    rows = [(rng.choice([None, 1, 2, 3, 4, 5]), rng.choice([None, *range(9)]), rng.choice(["user", "assistant", "system", "tool", "User", "", None]), rng.choice(texts)) for _ in range(60)]
    rows += [(6, t, "user", "Same.") for t in range(15)] + [(7, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(40)] + [(8, 3, "user", "Twice.")] * 5
    df = spark.createDataFrame([(*r, 7, "clash") for r in rows], SCHEMA).repartition(5)
    assert found(conversations.repair(df, size)) == naive(rows)


def test_dropped_and_empty(spark):
    gone = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(1, gone, "user", "Hi.", 0, "")], SCHEMA)
    assert found(conversations.repair(df)) == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert found(conversations.repair(df.limit(0))) == []


def test_a_long_conversation_and_a_shared_signature(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"{'x' * (t % 7)} {t}.") for t in range(900)]
    rows += [(c, t, ("user", "assistant")[t % 2], f"Common {t}.") for c in range(2, 302) for t in range(4)]
    df = spark.createDataFrame([(*r, 0, "") for r in rows], SCHEMA).repartition(7)
    whole = found(conversations.repair(df))
    assert whole == found(conversations.repair(df, 37)) and len(whole) == 301
    assert [r for r in whole if r[0] != 1] == naive(rows[900:])
