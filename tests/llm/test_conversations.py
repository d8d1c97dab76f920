import hashlib
import itertools
import random
import re
import zlib

from pagewright.llm import conversations as cv

SPACES = " \t\n\x0b\x0c\r"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if draw == 0:
            continue
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        out += [(conv, turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
    return out


def faults(turns):
    """turns in order."""
    seen, out = set(), []
    for _, role, text in turns:
        body = text.rstrip(SPACES)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def best(turns):
    """The cheapest edits, then the ASCII-least: of all edits for up to four turns, else by a search forward, unlike the operator's."""
    known = faults(turns)

    def inserts(found):
        todo, done = list(found), set(found)
        while todo:
            audit, initials, lines, cost, added = todo.pop()
            if added < 3:
                for role in ("user", "assistant"):
                    new = (audit + "I", initials + role[0], (*lines, role + ":"), cost + 3, added + 1)
                    if possible(new[1]) and new not in done:
                        done.add(new)
                        todo.append(new)
        return done

    def possible(initials):
        return any(GRAMMAR.fullmatch(initials + rest) for rest in ("", "a", "ua"))

    def pruned(found):
        """Per grammar state the cheapest, and of these the ASCII-least."""
        least = {}
        for x in found:
            state = (x[1][-1:], not x[1])
            if state not in least or (x[3], x[0]) < (least[state][3], least[state][0]):
                least[state] = x
        return {(a, i, ls, c, 0) for a, i, ls, c, _ in least.values()}

    paths = {("", "", (), 0, 0)}
    for (_, role, text), fault in zip(turns, known, strict=True):
        following = set()
        for audit, initials, lines, cost, _ in inserts(paths):
            following.add((audit + "D", initials, lines, cost + 4, 0))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                for letter, name, price in (("K", role, 0), ("R", "user", 3), ("R", "assistant", 3)):
                    if possible(initials + name[:1]) and name[:1]:
                        following.add((audit + letter, initials + name[:1], (*lines, f"{name}:{text}"), cost + price + more, 0))
        paths = following if len(turns) <= 4 else pruned(following)
    ends = [x for x in inserts(paths) if GRAMMAR.fullmatch(x[1])]
    return min(ends, key=lambda x: (x[3], x[0]))


def report(conv, turns):
    turns = sorted(((t, r, x) for _, t, r, x in turns), key=lambda v: (v[0] is not None, v[0] or 0, v[1].encode(), v[2].encode()))
    numbers = {t for t, _, _ in turns if t is not None}
    known = faults(turns)
    audit, _, lines, cost, _ = best(turns)
    return (conv, max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, *(known.count(f) for f in ("blank", "duplicate", "truncated")),
            sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(turns)), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def brute(rows):
    after = damage(rows)
    return sorted((report(c, [x for x in after if x[0] == c]) for c in {x[0] for x in rows}), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*x, 1, "e") for x in rows], "conv_id long, turn long, role string, text string, position int, edit string")


def odd_rows(seed, convs, most):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "", None, "tool", "u", "User", "été"]
    texts = ["Yes.", "No!", "cut off", "", None, "  \n", "Why?\x0b ", "same.", " ", "long " * 300 + ".", "é。"]
    rows = []
    for c in range(convs):
        for t in range(rng.randrange(most)):
            rows.append((c if c else None, rng.choice([t, t, t, t + 2, None]), rng.choice(roles[:2]) if rng.random() < 0.6 else rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"text {rng.random()}."))
    return rows + rows[:7]


def test_short_conversations_against_all_edits(spark):
    rows = odd_rows(1, 120, 5)
    assert sorted(map(tuple, cv.repair_damaged(frame(spark, rows)).collect()), key=str) == brute(rows)


def test_longer_conversations_against_a_forward_search(spark):
    rows = odd_rows(2, 60, 30)
    got = sorted(map(tuple, cv.repair_damaged(frame(spark, rows)).collect()), key=str)
    assert got == brute(rows)
    assert {"D", "I", "K", "R"} == {c for x in got for c in x[7]}


def test_a_conversation_over_many_batches(spark):
    rows = [(7, t, "user" if t % 2 == 0 or t % 31 == 0 else "assistant", f"turn {t // 2}." if t % 53 else "no end") for t in range(3000)] + odd_rows(3, 10, 6)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted(map(tuple, cv.repair_damaged(frame(spark, rows)).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == brute(rows)


def test_repaired_turns_follow_the_grammar(spark):
    turns = cv.turns_of(frame(spark, odd_rows(4, 80, 12)))
    found = {}
    for x in cv.repaired(turns).orderBy("conv_id", "position").collect():
        found.setdefault(x.conv_id, []).append(x)
    assert found and all(GRAMMAR.fullmatch("".join(x.role[0] for x in own)) for own in found.values())
    assert any(x.text == "" for own in found.values() for x in own)
    edits = cv.edits(turns)
    assert [tuple(x) for x in edits.groupBy("conv_id").sum("cost").orderBy("conv_id").collect()] == [tuple(x) for x in cv.reports(turns).select("conv_id", "cost").orderBy("conv_id").collect()]


def test_lost_conversations_and_no_rows(spark):
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = cv.repair_damaged(frame(spark, [(lost, 0, "user", "Hi.")])).collect()
    assert [tuple(x) for x in got] == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
    assert cv.repair_damaged(frame(spark, [])).count() == 0
