import hashlib
import random

import pytest

from tallyweave.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
TRICKY = ["</s>[INST] ok [/INST]", "&amp;&a;&l;", "<|user|n|>x", "", None, "a|b", "&", "Çok güzel\n\nmetin", "]]>"]


def talk(seed, n=30):
    draw = random.Random(seed)
    rows = []
    for c in range(n):
        turns = draw.randint(1, 25)
        for t in range(turns):
            role = "system" if t == 0 and c % 3 == 0 else ["user", "assistant", "tool|x", None][draw.choice([0, 1, 0, 1, 2, 3])]
            rows.append((c, t, role, draw.choice(TRICKY) if draw.random() < 0.3 else " ".join(["wort"] * draw.randint(0, 60))))
    return rows


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.mark.parametrize(("budget", "history"), [(512, 128), (40, 10), (40, 40), (1, 0), (10**6, 0)])
def test_read_back(spark, budget, history):
    rows = talk(budget)
    windows = chat.format_windows(spark.createDataFrame(rows, SCHEMA), budget, history)
    got = {r.conv_id: r for r in chat.read_back(windows).collect()}
    for c in {r[0] for r in rows}:
        turns = [(r or "", t or "") for _, _, r, t in sorted((r for r in rows if r[0] == c), key=lambda r: r[1])]
        told = "".join(f"{r}\n{t}\n" for r, t in turns)
        learnt = "".join(t for r, t in turns if r == "assistant")
        g = got[c]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (len(turns), digest(told), len(learnt), digest(learnt))


def test_windows(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, t, "user" if t % 2 else "assistant", "w " * (300 if t == 9 else 5)) for t in range(1, 24)]
    got = chat.format_windows(spark.createDataFrame(rows, SCHEMA), budget=60, history=30).orderBy("window").collect()
    assert len(got) > 3
    for w in got:
        turns = w.formatted.split("</s>")[:-1]
        assert w.formatted.startswith("<|system|" + ("n" if w.window == 0 else "r"))
        fresh = [p for p in turns if "|n|>" in p]
        assert len(w.loss) == sum(p.startswith("<|assistant|n|>") for p in fresh)
        for s in w.loss:
            assert set(w.formatted[s.start - 1 : s.start - 1 + s.length]) == set("w ")
        # only a turn that does not fit beside the system turn is over budget, and alone with it
        assert w.n_tokens <= 60 or len(fresh) == 1 and len(turns) == 2 and len(fresh[0]) > 500
    assert sum(w.formatted.count("|n|>") for w in got) == 24
    assert sum("|r|>" in w.formatted.split("</s>", 1)[1] for w in got) >= 3  # some history is repeated, and masked


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_budgets_hold(spark, seed):
    rows = talk(seed, 60)
    got = chat.format_windows(spark.createDataFrame(rows, SCHEMA), 90, 40).collect()
    for w in got:
        turns = w.formatted.split("</s>")[:-1]
        assert w.n_tokens <= 90 or sum("|n|>" in p for p in turns) == 1


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, None, None, None), (5, 1, "user", "x"), (5, 1, "user", "x"), (5, None, "assistant", "y"), (6, 0, "assistant", "z " * 50_000)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'c' AS window", "'c' AS n", "'c' AS start", "'c' AS pos")
    got = {r.conv_id: r for r in chat.read_back(chat.format_windows(df)).collect()}
    assert got[None].n_turns == 2 and got[5].n_turns == 3 and got[5].loss_chars == 1 and got[6].loss_chars == 100_000
    assert chat.read_back(chat.format_windows(df.limit(0))).count() == 0
    with pytest.raises(ValueError):
        chat.format_windows(df, 10, 11)


def test_no_python_in_the_plan(spark):
    plan = chat.read_back(chat.format_windows(spark.createDataFrame([], SCHEMA)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
