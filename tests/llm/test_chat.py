import random
import re

from pyspark.sql import functions as F

from centwise.llm import chat

NAMES = ["user", "assistant", "system", "Human ", "gpt", "tool", None]


def least_cost(roles):
    """Breadth over every sequence of choices, written without the operator's moves."""
    legal = {None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    name = {chat.SYSTEM: "system", chat.USER: "user", chat.ASSISTANT: "assistant", None: None}
    at = {None: 0}
    for r in map(name.get, roles):
        new = {}
        pay = lambda q: 1 if r is None else 0 if q == r else 3  # noqa: E731, B023
        for last, c in at.items():
            tries = [(q, c + pay(q)) for q in legal[last]]
            if last:
                tries.append((last, c + 1 + pay(last)))
            for b in legal[last]:
                if b != "system":
                    tries += [(q, c + 2 + pay(q)) for q in legal[b]]
            for q, t in tries:
                new[q] = min(t, new.get(q, 10**9))
        at = new
    return min(at.values())


def conversations(rng):
    out = []
    for conv in range(60):
        n = rng.choice([1, 2, 3, 5, 8, 40])
        out += [(conv, t, rng.choice(NAMES), rng.choice(["hi", "", None, "<|im_end|>", "a\nb"]) ) for t in range(n)]
    out += [(None, 0, "assistant", "null conversation"), (7, None, "user", "no turn"), (8, 1, "user", "x"), (8, 1, "user", "x")]
    out += [(1000, t, rng.choice(NAMES), f"t{t}") for t in range(400)]
    return out


def test_repairs_are_legal_and_cheapest(spark):
    turns = conversations(random.Random(4))
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").withColumn("part", F.lit("clash")).withColumn("n", F.lit(1))
    for segment in (512, 3):
        convs = {}
        for r in sorted(chat.format_chats(df, segment).collect(), key=lambda r: r.part):
            convs.setdefault(r.conv_id, []).append(r)
        assert set(convs) == {c for c, *_ in turns}
        for conv, parts in convs.items():
            assert [p.part for p in parts] == list(range(len(parts)))
            own = sorted((t for t in turns if t[0] == conv), key=lambda t: [(x is not None, x) for x in t[1:]])
            assert sum(p.n_turns for p in parts) == len(own) == sum(p.n_kept + p.n_merged + p.n_inserted + p.n_relabelled for p in parts)
            assert sum(p.cost for p in parts) == least_cost([chat.role_of(t[2]) for t in own])
            whole = "".join(p.rendered for p in parts)
            said = re.findall(r"<\|im_start\|>(\w+)\n(.*?)<\|im_end\|>\n", whole, re.S)
            assert "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in said) == whole
            assert re.fullmatch(r"S?(UA)*U?", "".join(r[0].upper() for r, _ in said))
            words = "".join((t[3] or "").replace("<|", "<\u200b|") for t in own)
            assert "".join(t for _, t in said).replace("\n\n", "") == words.replace("\n\n", "")


def test_a_clean_conversation_stays(spark):
    df = spark.createDataFrame([(1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"), (2, 0, "user", "a"),
                                (2, 1, "user", "b"), (3, 0, "assistant", "z")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.format_chats(df).collect()}
    assert got[1].cost == 0 and got[1].rendered == ("<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>user\nhi<|im_end|>\n"
                                                    "<|im_start|>assistant\nhello<|im_end|>\n")
    assert got[2].n_merged == 1 and got[2].rendered == "<|im_start|>user\na\n\nb<|im_end|>\n"
    assert got[3].n_inserted == 1 and got[3].rendered == "<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\nz<|im_end|>\n"
    assert chat.format_chats(df.limit(0)).collect() == []


def test_rows_do_not_depend_on_partitions(spark):
    """One row a conversation of up to SEGMENT turns, parts of longer ones cut by the turn's number alone."""
    rng = random.Random(9)
    turns = conversations(rng) + [(2000, t, rng.choice(NAMES), f"long {t}") for t in range(chat.SEGMENT)]
    turns += [(2001, t, rng.choice(NAMES), f"longer {t}") for t in range(chat.SEGMENT + 1)]
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
    old, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (4, 12, 40):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.append(sorted(map(tuple, chat.format_chats(df.repartition(n)).collect()), key=str))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert seen[0] == seen[1] == seen[2]
    parts = {}
    for r in seen[0]:
        parts[r[0]] = parts.get(r[0], 0) + 1
    assert {c: n for c, n in parts.items() if n > 1} == {2001: 2} and parts[2000] == 1
