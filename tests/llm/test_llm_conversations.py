"""Conversation repair against an exhaustive search over one conversation at a time."""

import hashlib
import random
import zlib
from collections import Counter
from functools import lru_cache

import pytest

from tallyward.llm.conversation_grammar import CLOSING, EMPTY, LETTERS, Grammar, choose_end, re_pair
from tallyward.llm.conversation_repair import damage_conversations, repair_conversations, repaired_turns
from tallyward.llm.storage import table

BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
SCHEMA = "conv_id long, turn long, role string, text string"


def step(state, initial):
    """States: nothing, system, user, assistant given out last."""
    return {("-", "s"): "s", ("-", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}.get((state, initial))


def search(rows):
    """The least (cost, audit, repaired turns) of rows (role, text, fault), by trying every edit at every place."""

    @lru_cache(None)
    def best(at, state, inserted):
        options = []
        if at == len(rows) and state in "-a":
            options.append((0, "", ()))
        turn = "a" if state == "u" else "u"
        name = "assistant" if state == "u" else "user"
        if inserted < 3:
            cost, audit, out = best(at, step(state, turn), inserted + 1)
            options.append((cost + 3, "I" + audit, ((name, ""), *out)))
        if at < len(rows):
            role, text, fault = rows[at]
            cost, audit, out = best(at + 1, state, 0)
            options.append((cost + 4, "D" + audit, out))
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault == "truncated" else 0
                if step(state, role[:1]):
                    cost, audit, out = best(at + 1, step(state, role[:1]), 0)
                    options.append((cost + extra, "K" + audit, ((role, text), *out)))
                cost, audit, out = best(at + 1, step(state, turn), 0)
                options.append((cost + extra + 3, "R" + audit, ((name, text), *out)))
        return min(options) if options else (10**9, "", ())

    return best(0, "-", 0)


def damaged(rows):
    for conv, turn, role, text in rows:
        names = [" " if v is None else str(v) for v in (conv, turn, role, text)]
        fault = zlib.crc32(f"{names[0]}:{names[1]}".encode()) % 20
        role, text = names[2], names[3]
        if fault == 1:
            text = ""
        if fault == 2:
            text = "".join(c for c in text if c not in ".!?")
        if fault == 4:
            role = "user"
        for _ in range({0: 0, 3: 2}.get(fault, 1)):
            yield conv, turn, role, text


def expected(rows, damage=True):
    by_conv = {conv: [] for conv, *_ in rows}
    for row in damaged(rows) if damage else rows:
        by_conv[row[0]].append(row[1:])
    results, turns_out = {}, {}
    for conv, turns in by_conv.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in turns:
            bare = text.strip(BLANKS)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        known = [t for t, *_ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit, out = search(tuple((r, t, f) for (_, r, t), f in zip(turns, faults)))
        count = Counter(faults)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
        results[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, digest)
        turns_out[conv] = list(out)
    return results, turns_out


def collected(frame):
    rows = [tuple(r) for r in frame.collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1:] for r in rows}


ODD = [
    (None, None, None, None), (None, None, None, None), (None, 1, "user", "Hello."), (None, 1, "assistant", "Hello."),
    (1, None, "user", "a."), (1, None, "user", "a."), (1, 5, "user", "a."), (1, 9, "assistant", "b"), (1, 9, "assistant", "B!"),
    (2, 0, "system", "s."), (2, 1, "tool", "x."), (2, 2, "assistant", "y. \n"), (2, 2, "", "z."), (2, 3, "User", "z?"),
    (3, 0, "assistant", " "), (4, 3, "system", "only."), (5, 0, "user", " \t\x0b"), (6, 7, "user", "q" * 300_000),
    (6, 8, "assistant", "r!" * 200_000), (-7, 10, "system", "s"), (-7, 11, "system", "s")]


def random_rows(seed, conversations, most):
    rng = random.Random(seed)
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randint(1, most)):
            if rng.random() < .9:
                rows.append((conv, turn, rng.choice(["user", "assistant", "assistant", "user", "system", "tool"]),
                             rng.choice(["", "a.", "b", "c!", " ", "d? ", "e", "f.", "g."])))
    return rows


def test_rules_and_paths_are_the_cheapest_and_first():
    rng = random.Random(1)
    grammar, symbols = Grammar(), list(LETTERS)
    for _ in range(5):
        symbols += grammar.add([(rng.choice(symbols), rng.choice(symbols)) for _ in range(20)])

    def expand(symbol):
        return symbol if symbol in LETTERS else "".join(map(expand, grammar.sides[symbol]))

    roles = dict(s="system", u="user", a="assistant", o="tool", x="tool")
    texts = ["".join(rng.choice(symbols) for _ in range(rng.randint(1, 5))) for _ in range(600)]
    found = grammar.solve(texts)
    for n, text in enumerate(texts):
        rows = tuple((roles[c.lower()], "t", "blank" if c == "x" else "truncated" if c.isupper() else "") for c in "".join(map(expand, text)))
        end, cost = choose_end(found.cost[n, EMPTY].tolist(), found.rank[n, EMPTY].tolist())
        assert (cost, grammar.path(text, EMPTY, end) + CLOSING[end]) == search(rows)[:2]


def test_re_pair_expands_to_its_sequences(spark):
    texts = sorted({"".join(random.Random(n).choices("uaux", k=n % 40 + 1)) for n in range(300)})
    grammar, packed = re_pair(spark.createDataFrame([(t,) for t in texts], "sequence string"), "sequence")

    def expand(symbol):
        return symbol if symbol in LETTERS else "".join(map(expand, grammar.sides[symbol]))

    rows = packed.collect()
    assert sorted(r.sequence for r in rows) == texts and all("".join(map(expand, r.packed)) == r.sequence for r in rows)
    assert sum(len(r.packed) for r in rows) < sum(map(len, texts)) / 2


@pytest.mark.parametrize("stretch", [1024, 3])
def test_repair_against_search(spark, stretch):
    rows = ODD + random_rows(2, 300, 14)
    frame = spark.createDataFrame(rows, SCHEMA)
    assert collected(repair_conversations(damage_conversations(frame), stretch)) == expected(rows)[0]


@pytest.mark.parametrize("stretch", [1024, 4])
def test_repaired_turns_and_clashing_columns(spark, stretch):
    rows = random_rows(3, 60, 25)
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", audit string, part int")
    found = {}
    for r in sorted(repaired_turns(frame, stretch).collect(), key=lambda r: (r.conv_id, r.position)):
        found.setdefault(r.conv_id, []).append((r.position, r.role, r.text))
    results, turns = expected(rows, damage=False)
    assert found == {c: [(n, *t) for n, t in enumerate(out)] for c, out in turns.items() if out}
    assert collected(repair_conversations(frame, stretch)) == results


def test_whole_table_and_empty_one(spark, sf_dir):
    conversations = table(spark, sf_dir, "conversations")
    rows = [tuple(r) for r in conversations.select("conv_id", "turn", "role", "text").collect()]
    assert collected(repair_conversations(damage_conversations(conversations))) == expected(rows)[0]
    assert repair_conversations(damage_conversations(conversations.limit(0))).count() == 0


def test_one_conversation_with_most_rows_is_spread(spark):
    """Each stretch has its own task; equal rows are counted before any shuffle."""
    rows = [(1, n, "user" if n % 2 else "assistant", f"t{n % 50}.") for n in range(400)] + [(1, 7, "user", "again.")] * 200 + random_rows(5, 20, 5)
    frame = spark.createDataFrame(rows, SCHEMA)
    assert collected(repair_conversations(damage_conversations(frame), 16))[1][:5] == expected_counts(rows, 1)


def expected_counts(rows, conv):
    turns = sorted((r[1:] for r in damaged(rows) if r[0] == conv), key=lambda r: (r[0], r[1], hashlib.md5(r[2].encode()).digest()))
    seen, count = set(), Counter()
    for _, role, text in turns:
        bare = text.strip(BLANKS)
        count["blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""] += 1
        seen.add((role, text))
    known = {t for t, *_ in turns}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    return max(known) - min(known) + 1 - len(known), count["blank"], count["duplicate"], count["truncated"], illegal
