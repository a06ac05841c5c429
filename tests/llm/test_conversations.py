"""Repairs against a plain search over all edits, and against a shortest-path reading of the definition."""

import hashlib
import itertools
import random
import re
import zlib

from tidemark.llm import conversations
from tidemark.llm.conversations import (INSERTS, Rope, audit_conversations, better, blocks_of, damage, digests, disjoint, evaluate,
                                        read_rows, repair_report, repair_rows)
from tidemark.llm.queries import op13_conversations

SPACES = " \t\n\x0b\x0c\r"
SHAPE = re.compile(r"(s?(ua)+)?\Z")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        tail = text.rstrip(SPACES)
        out.append("blank" if not tail else "duplicate" if (role, text) in seen else "truncated" if tail[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, repaired rows) by extending every partial repair, the best per place and state kept."""
    def follow(state, initial):
        return {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}[state].get(initial)

    best = {"": (0, "", ())}
    for (role, text), fault in zip([*rows, (None, None)], [*faults(rows), None]):
        for _ in range(3):  # inserts ahead of this row
            for state, (cost, audit, made) in list(best.items()):
                for new in ("user", "assistant"):
                    if (after := follow(state, new[0])) is not None:
                        entry = (cost + 5, audit + "I", (*made, (new, "")))
                        best[after] = min(best.get(after, entry), entry)
        if role is None:
            break
        fresh = {}
        for state, (cost, audit, made) in best.items():
            options = [(state, 2, "D", ())]
            if fault in ("", "truncated"):
                more = 5 if fault else 0
                if role and (after := follow(state, role[0])) is not None:
                    options.append((after, more, "K", ((role, text),)))
                options += [(after, 1 + more, "R", ((new, text),)) for new in ("user", "assistant")
                            if (after := follow(state, new[0])) is not None]
            for after, price, edit, kept in options:
                entry = (cost + price, audit + edit, made + kept)
                fresh[after] = min(fresh.get(after, entry), entry)
        best = fresh
    return min(best[s] for s in ("", "a") if s in best)


def brute(rows, damage_first=True):
    out = []
    after = damaged(rows) if damage_first else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    for conv in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, r, hashlib.md5(x.encode()).hexdigest(), x) for c, t, r, x in after if c == conv))
        turns = [t for has, t, *_ in own if has]
        plain = [(r, x) for _, _, r, _, x in own]
        kinds = faults(plain)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(plain, plain[1:]))
        cost, audit, made = cheapest(plain)
        assert SHAPE.match("".join(r[0] for r, _ in made))
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[kinds.count(k) for k in ("blank", "duplicate", "truncated")],
                    illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in made).encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(op13_conversations(spark, sf)) == brute(rows)


def every_repair(plain):
    """All edit strings with up to two inserts at a place: nothing but the costs is shared with the code."""
    kinds, best = faults(plain), None
    for edits in itertools.product("DKR", repeat=len(plain)):
        if any(k in ("blank", "duplicate") and e != "D" for k, e in zip(kinds, edits)):
            continue
        price = sum({"K": 0, "R": 1, "D": 2}[e] + (5 if k == "truncated" and e != "D" else 0) for k, e in zip(kinds, edits))
        for inserts in itertools.product(range(3), repeat=len(plain) + 1):
            if best is not None and price + 5 * sum(inserts) > best[0]:
                continue
            slots = [s for k in range(len(plain) + 1) for s in ["I"] * inserts[k] + ([k] if k < len(plain) else [])]
            slots = [s for s in slots if s == "I" or edits[s] != "D"]
            for guess in itertools.product("ua", repeat=sum(s == "I" or edits[s] == "R" for s in slots)):
                chosen = iter(guess)
                if SHAPE.match("".join(next(chosen) if s == "I" or edits[s] == "R" else plain[s][0][:1] or "-" for s in slots)):
                    audit = "".join("I" * inserts[k] + (edits[k] if k < len(plain) else "") for k in range(len(plain) + 1))
                    best = min(best or (price + 5 * sum(inserts), audit), (price + 5 * sum(inserts), audit))
    return best


def test_the_search_itself_is_cheapest():
    rng = random.Random(3)
    for _ in range(40):
        plain = [(rng.choice(["system", "user", "assistant", "tool", "usher", ""]), rng.choice(["a.", "b!", "cut", " ", "c?"])) for _ in range(rng.randrange(0, 4))]
        assert cheapest(plain)[:2] == every_repair(plain), plain


ODD = [(1, None, "user", "Hi."), (1, None, None, None), (1, 3, "assistant", "ok."), (1, 3, "assistant", "ok."), (2, 0, "system", " \t\n"),
       (None, 5, "user", "q?"), (None, 6, "assistant", "a "), (None, 9, "assistant", "a.\n"), (3, 1, "", "no role."), (3, 2, "tool", "x"),
       (4, 0, "user", "same."), (4, 5, "user", "same."), (4, 7, "user", "same."), (5, 0, "User", "case."), (6, 1, "user", "long " * 200_000 + "."),
       (6, 2, "assistant", "yes!"), (7, 2, "system", "only."), (8, 1, "s", "ends 。"), (9, -4, "assistant", "first."), (9, 10, "user", "last?")]


def test_edges_and_clashing_columns(spark):
    df = spark.createDataFrame([(*r, "x", 1) for r in ODD], "conv_id long, turn long, role string, text string, Text string, cn int")
    for first in (True, False):
        assert rows_of(repair_report(df, damaged=first)) == brute(ODD, first)
    assert repair_report(df.limit(0)).count() == 0


def random_rows(rng, count, longest):
    for conv in range(count):
        turn = 0
        for _ in range(rng.randrange(1, longest)):
            turn += rng.choice([0, 1, 1, 1, 3])
            yield (conv, rng.choice([turn, turn, turn, turn, None]), rng.choice(["system", "user", "user", "assistant", "assistant", "tool"]),
                   rng.choice(["fine.", "more!", "cut", "", "again?", f"text {turn}."]))


def test_random_conversations_cut_into_many_chunks(spark):
    rows = list(random_rows(random.Random(11), 150, 30))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = brute(rows)
    assert rows_of(repair_report(df)) == want
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        assert rows_of(repair_report(df)) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_one_conversation_with_nearly_all_rows(spark):
    rng = random.Random(2)
    rows = [(1, k, rng.choice(["user", "assistant"]), rng.choice([f"t{k}.", "same.", "cut"])) for k in range(4000)] + [(2, 0, "user", "q?")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert rows_of(repair_report(df, damaged=False)) == brute(rows, False)


def test_rules_give_what_rows_give(spark, monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ABEFIJMD") for _ in range(rng.randrange(1, 60))) for _ in range(300)] + ["EIEI" * 40] * 3
    short, rules = conversations.compress(spark.createDataFrame([(t,) for t in texts], "seq string"))
    blocks, plain = blocks_of(rules), blocks_of([])
    assert len(rules) > 100
    got = {r.seq: r.short for r in short.collect()}
    assert set(got) == set(texts) and sum(map(len, got.values())) < 0.6 * sum(map(len, set(texts)))

    def spelled(s):
        return "".join(c if ord(c) < 0x100 else spelled("".join(rules[ord(c) - 0x100])) for c in s)

    for seq in set(texts[:60]):
        assert spelled(got[seq]) == seq
        a, b = evaluate(got[seq], blocks), evaluate(seq, plain)
        flat = lambda m: [[None if e is None else (e[0], str(e[1])) for e in row] for row in m]
        assert (a.first, a.last, a.counts, flat(a.matrix)) == (b.first, b.last, b.counts, flat(b.matrix))


def test_small_parts():
    rope = Rope("")
    for k in range(500):
        rope = rope + Rope("DK" if k % 2 else "I")
    assert str(rope) == "IDK" * 250 and rope.size == 750
    assert str(better((3, Rope("K")), (3, Rope("DI")))[1]) == "DI"
    assert INSERTS[0][3][0] == 10 and str(INSERTS[0][3][1]) == "II" and INSERTS[2][0] is None
    assert disjoint(["ab", "bc", "aa", "db", "cc"], {}, 9) == ["ab", "db", "cc"]
    assert disjoint(["aa", "ab", "xy"], {"x": 1024}, 9) == ["aa"]


def test_repaired_rows(spark):
    df = spark.createDataFrame([(1, 0, "user", "q?"), (1, 1, "tool", "a."), (1, 2, "user", "q?"), (2, 0, "assistant", "x.")],
                               "conv_id long, turn long, role string, text string")
    rows = read_rows(df)
    audits = audit_conversations(rows)
    made = [(r.c, r.place, r.role, r.text, r.edit) for r in repair_rows(rows, audits).orderBy("c", "place").collect()]
    assert made == [("1", 0, "user", "q?", "K"), ("1", 1, "assistant", "a.", "R")]  # 2: deleting is cheaper than a lone answer's partner
    assert {r.c: r.sha256 for r in digests(repair_rows(rows, audits)).collect()} == {"1": hashlib.sha256(b"user:q?\nassistant:a.").hexdigest()}
    assert damage(rows).columns == ["conv_id", "turn", "role", "text"]
