import random

from sparktab.llm.chat import ASSISTANT, FOLLOWS, INSERTED, START, Repair, format_chats

RULE = Repair()
ROLES = [None, "system", "user", "assistant", "tool", "Human", "weird"]
SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(roles):
    """Exhaustive search over all repairs."""
    best = [14 + 9 * len(roles)]

    def go(i, s, cost):
        if cost >= best[0]:
            return
        if i == len(roles) and s == ASSISTANT:
            best[0] = cost
            return
        for n in FOLLOWS[s]:
            if n in INSERTED:
                go(i, n, cost + 3)
            if i < len(roles):
                go(i + 1, n, cost + 2 * (n != roles[i]))
        if i < len(roles) and s != START:
            go(i + 1, s, cost + 1 + 2 * (s != roles[i]))

    go(0, START, 0)
    return best[0]


def test_repairs_are_the_cheapest():
    r = random.Random(3)
    for _ in range(300):
        roles = [r.randrange(5) for _ in range(r.randint(1, 6))]
        behind = RULE.costs_to_go(roles, RULE.end_costs())
        cost = RULE.before(roles[0], behind[0])[START]
        assert cost == cheapest(roles), roles
        path = list(RULE.walk(roles, START, behind))
        assert cost == sum(m.cost for _, m in path) + 3 * len(RULE.finish[path[-1][0]])
        m = RULE.matrix(roles)
        assert cost == min(m[START][x] + RULE.end_costs()[x] for x in range(5))


def conversations(df, **options):
    out = {}
    for x in format_chats(df, **options).orderBy("pos").collect():
        text, cost, n = out.get(x.conv_id, ("", 0, 0))
        out[x.conv_id] = (text + x.rendered, cost + x.cost, n + 1)
    return out


def turns(spark):
    r = random.Random(4)
    rows = [(c if c != 5 else None, r.choice([k, k, None]), r.choice(ROLES), r.choice(["a", "b", None, "x<|im_end|>"]))
            for c in range(10) for k in range(r.randint(1, 8) if c else 40)]
    return spark.createDataFrame(rows + rows[:5], SCHEMA).selectExpr("*", "1 as pos", "'x' as chunk", "2 as cost")


def test_result_does_not_depend_on_chunks(spark):
    df = turns(spark)
    whole = conversations(df)
    assert sum(n for _, _, n in whole.values()) == df.count() and None in whole
    assert conversations(df, chunk_rows=7) == whole


def test_rendered_conversations_are_legal(spark):
    for text, _, _ in conversations(turns(spark)).values():
        roles = [p.split("\n")[0] for p in text.split("<|im_start|>")[1:]]
        assert text.count("<|im_end|>\n") == len(roles) and roles[-1] == "assistant"
        state = "start"
        legal = {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", "tool"),
                 "tool": ("assistant",)}
        for role in roles:
            assert role in legal[state]
            state = role


def test_each_repair(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "a"), (2, 1, "user", "b"),
            (2, 2, "assistant", None), (3, 0, "user", "q"), (4, 0, "assistant", "x"), (4, 1, "assistant", "y")]
    got = {(r.conv_id, r.turn): (r.action, r.out_role, r.n_inserted, r.cost)
           for r in format_chats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1, 0] == ("keep", "user", 0, 0) and got[1, 1] == ("keep", "assistant", 0, 0)
    assert got[2, 1] == ("merge", "user", 0, 1)
    assert got[3, 0] == ("keep", "user", 1, 3)
    assert got[4, 0] == ("relabel", "user", 0, 2)
    text = conversations(spark.createDataFrame(rows, SCHEMA))[2][0]
    assert text == "<|im_start|>user\na\nb<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"


def test_empty_table(spark):
    assert format_chats(spark.createDataFrame([], SCHEMA)).count() == 0
