import itertools
import random

import pytest

from sigspark.llm import chat as C


def legal(roles):
    if roles and roles[0] == "system":
        roles = roles[1:]
        if not roles:
            return False
    return len(roles) % 2 == 0 and all(r == ("user", "assistant")[i % 2] for i, r in enumerate(roles))


def cheapest(codes):
    """Every choice of labels and merges; empty turns by breadth-first search over legal chats."""
    best = None
    for labels in itertools.product((1, 2, 3), repeat=len(codes)):
        base = sum(0 if c == x else C.LABEL if c == 0 else C.RELABEL for c, x in zip(codes, labels))
        for merges in itertools.product((False, True), repeat=max(0, len(codes) - 1)):
            if any(m and labels[i] != labels[i + 1] for i, m in enumerate(merges)):
                continue
            seq = [labels[0]] + [x for x, m in zip(labels[1:], merges) if not m] if codes else []
            n = inserted([C.ROLES[x - 1] for x in seq])
            if n is not None:
                cost = base + C.MERGE * sum(merges) + C.EMPTY * n
                best = cost if best is None else min(best, cost)
    return best


def inserted(roles):
    if "system" in roles[1:]:
        return None
    n, out = 0, []
    for r in roles:
        if r != "system" and out and out[-1] == r or r == "assistant" and (not out or out[-1] == "system"):
            out.append("assistant" if r == "user" else "user")
            n += 1
        out.append(r)
    while not legal(out):
        out.append("assistant" if out[-1] == "user" else "user")
        n += 1
    return n


def chats(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def cost_of(got, conv):
    return sum(r.cost for r in got if r.conv_id == conv)


def rendered(got, conv):
    return "".join(r.piece for r in sorted((r for r in got if r.conv_id == conv), key=lambda r: (r.block, r.place)))


def roles_of(text):
    return [x.split("|>")[0] for x in text.split("<|")[1:] if not x.startswith("end|>")]


@pytest.mark.parametrize("block", [512, 2])
def test_costs_are_least_and_chats_legal(spark, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK", block)
    rng = random.Random(4)
    names = ["user", "assistant", "system", "Human", "gpt", "narrator", None]
    rows, codes = [], {}
    for conv in range(60):
        roles = [rng.choice(names) for _ in range(rng.randint(1, 5))]
        codes[conv] = [C.role_code(r) for r in roles]
        rows += [(conv, t, r, f"text {conv} {t}") for t, r in enumerate(roles)]
    rng.shuffle(rows)
    got = C.format_chats(chats(spark, rows)).collect()
    assert len(got) == len(rows)
    for conv, c in codes.items():
        assert cost_of(got, conv) == cheapest(c), c
        text = rendered(got, conv)
        assert legal(roles_of(text)) and text.endswith("<|end|>\n")
        assert all(f"text {conv} {t}" in text for t in range(len(c)))


def test_good_chat_is_left_alone(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a")]
    got = C.format_chats(chats(spark, rows)).collect()
    assert rendered(got, 1) == "<|system|>\ns<|end|>\n<|user|>\nu<|end|>\n<|assistant|>\na<|end|>\n" and cost_of(got, 1) == 0


def test_odd_rows(spark):
    rows = [(None, None, None, None), (1, 0, "user", "x" * 50_000), (1, 0, "user", "x" * 50_000), (2, None, "user", ""), (2, 700, "assistant", "a"), (2, 1400, "assistant", "b")]
    df = chats(spark, rows).selectExpr("*", "'k' as block", "1 as rows")
    got = C.format_chats(df).collect()
    assert len(got) == len(rows) and all(legal(roles_of(rendered(got, c))) for c in (None, 1, 2))
    assert C.format_chats(df.limit(0)).count() == 0


def test_low_turn_numbers_of_one_conversation_are_cut(spark, monkeypatch):
    """Turn numbers 0 to 7 only: rows without conv_id, rows of one id and equal rows fill no block beyond its size."""
    monkeypatch.setattr(C, "BLOCK", 16)
    monkeypatch.setattr(C, "PART_ROWS", 64)
    rng = random.Random(9)
    names = ["user", "assistant", "system", "gpt", None]
    rows = [(conv, rng.randrange(8), rng.choice(names), f"text {i}") for i in range(900) for conv in (None, 0)]
    rows += [(5, rng.choice([None, 3]), "user", "the same") for _ in range(500)] + [(6, t, names[t % 2], "x") for t in range(8)]
    rng.shuffle(rows)
    df = chats(spark, rows).repartition(6)
    assert max(sum(r["times"] for r in b.rows) for b in C.blocks(df).collect()) <= C.FULL * C.BLOCK
    got = C.format_chats(df).collect()
    assert sorted((str(r.conv_id), str(r.turn), str(r.role)) for r in got) == sorted((str(c), str(t), str(r)) for c, t, r, _ in rows)
    h = {(r.role, r.text): r.h for r in df.selectExpr("role", "text", "xxhash64(role, text) as h").distinct().collect()}
    for conv in (None, 0, 5, 6):
        mine = sorted(((-1 if t is None else t, h[r, x], r, x) for c, t, r, x in rows if c == conv), key=lambda r: r[:2])
        out = sorted((r for r in got if r.conv_id == conv), key=lambda r: (r.block, r.place))
        assert [(-1 if r.turn is None else r.turn, r.role) for r in out] == [(t, r) for t, _, r, _ in mine]
        assert all(x in r.piece for r, (*_, x) in zip(out, mine))
        assert legal(roles_of(rendered(got, conv)))
        assert cost_of(got, conv) == least([C.role_code(r) for _, _, r, _ in mine])


def least(codes):
    best = {C.START: 0}
    for c in codes:
        best = {b: min(v + int(C.TURNS[c][0][a, b]) for a, v in best.items()) for b in range(4)}
    return min(v + int(C.END[s]) for s, v in best.items())
