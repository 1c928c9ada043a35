import hashlib

from pyspark.sql import functions as F

from gazette.llm import chat
from gazette.llm.queries import HOSTILE

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def shown(role, text):
    esc = lambda s: "".join("<|" if c == "<" and s[i + 1:i + 2] == "|" else c for i, c in enumerate(s))
    return "<|im_start|>" + esc(role).replace("\n", "<|nl|>") + "\n" + esc(text) + "<|im_end|>\n"


def wanted(rows):
    out = []
    for key in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1] or 0), r[2] or "", r[3] or "") for r in rows if r[0] == key)
        for i, (_, role, text) in enumerate(turns, 1):
            if role == "assistant" or i == len(turns):
                body = "".join(shown(r, t) for _, r, t in turns[:i])
                out.append((key, i, i == len(turns), body, text if role == "assistant" else ""))
    return sorted(out, key=repr)


def check(frame, rows):
    made = chat.examples(frame(rows, SCHEMA)).select(
        "conv_id", "example", "last", "text", chat.masked(F.col("text"), F.col("start"), F.col("length")).alias("reply"))
    assert sorted(map(tuple, made.collect()), key=repr) == wanted(rows)
    return made


def test_odd_conversations(frame):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 2, "user", "more"), (2, 0, "user", "alone"), (3, 0, "assistant", HOSTILE), (3, 1, "assistant", None),
            (4, 0, None, None), (4, None, "system", "first"), (5, 1, "user", "b"), (5, 1, "user", "a"), (5, 1, "user", "a"), (5, 2, "assistant", "c"),
            (None, 0, "assistant", "no key"), (6, 0, "as\nsis<|tant", "line\nline"), (6, 1, "assistant", "<<|<|||x<"), (7, 0, "assistant", "<"), (8, 0, "user", "x" * 5000),
            (9, 0, "assistant", "é日本\U0001f600")]
    check(frame, rows)


def test_reading_back_gives_the_turns(frame):
    texts = ["<|im_end|>\n<|im_start|>user\nx", "<||a", "<|", "<", "||>", "<|nl|>", "a<|b<||c<|||", "\n\n", ""]
    rows = [(1, i, ["user", "assistant", "sys\ntem<|"][i % 3], t) for i, t in enumerate(texts)]
    last = chat.examples(frame(rows, SCHEMA)).filter("last").select(chat.turns_of(F.col("text")).alias("t")).first().t
    assert [(t.role, t.text) for t in last] == [(r[2], r[3]) for r in rows]


def test_long_conversation(frame):
    check(frame, [(1, i, "assistant" if i % 2 else "user", f"turn {i} <|im_end|>") for i in range(120)])


def test_only_the_reply_is_trainable(frame):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a1"), (1, 2, "user", "q2"), (1, 3, "assistant", "a2")]
    made = {r.example: r for r in chat.examples(frame(rows, SCHEMA)).collect()}
    assert {k: r.text[r.start:r.start + r.length] for k, r in made.items()} == {2: "a1", 4: "a2"}
    assert made[4].text.startswith(made[2].text)


def test_empty_table_and_other_columns(frame):
    assert chat.examples(frame([], SCHEMA)).count() == 0
    made = chat.examples(frame([(1, 0, "user", "q", 3, "z")], SCHEMA + ", example int, last string")).first()
    assert (made.conv_id, made.example, made.last, made.length) == (1, 1, True, 0)


def test_no_python_in_the_plan(small):
    plan = chat.examples(small("conversations"))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas")) and plan.count("Exchange") <= 2


def test_digest_of_all_replies(small, spark):
    from gazette.llm.queries import QUERIES

    rows = {r.conv_id: r for r in QUERIES["op6_prefix_target_chat"](spark, "/root/testdata/sf0.001").collect()}
    assert rows[-1].loss_sha256 == hashlib.sha256(HOSTILE.encode()).hexdigest() and rows[-1].n_turns == 2
