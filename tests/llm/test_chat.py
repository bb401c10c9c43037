import hashlib
import random

from tallyforge.llm import chat


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for c, turns in convs.items():
        turns = [t[2:] for t in sorted(turns)]
        said = "".join(t for r, t in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(said),
                  hashlib.sha256(said.encode()).hexdigest())
    return out


def rows():
    rng = random.Random(8)
    bits = ["\\", "###", "</turn>", ": ", "<", "/turn>", "#", "\n", " ", "é😀", "ok", "### user: ", " </turn>\n"]
    text = lambda: "".join(rng.choice(bits) for _ in range(rng.randrange(9)))
    out = [(c, t, rng.choice(["user", "assistant", "system", "a: b\\", "### x"]), text()) for c in range(60) for t in range(rng.randrange(1, 9))]
    out += [(100, 0, "user", "x"), (101, 0, None, None), (101, None, "assistant", None), (101, 0, "user", "tie"), (102, 1, "assistant", "y" * 200_000),
            (103, 0, "user", "same"), (103, 0, "user", "same"), (None, 0, "assistant", "no id"), (-7, 0, "user", r"\### Assistant: </turn> ok")]
    return out


def frame(spark):
    return spark.createDataFrame(rows(), "conv_id long, turn long, role string, text string").selectExpr("*", "text as formatted", "1 as example")


def test_read_back(spark):
    got = chat.read_back(chat.expand(frame(spark))).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == brute(rows())
    assert len(got) == len(brute(rows()))


def test_examples(spark):
    ordered = {}
    for c, turn, role, text in sorted(rows(), key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        ordered.setdefault(c, []).append((role or "", text or ""))
    examples = {}
    for r in chat.expand(frame(spark)).collect():
        examples.setdefault(r.conv_id, []).append(r)
    for c, turns in ordered.items():
        found = sorted(examples[c], key=lambda r: r.example)
        replies = [k for k, (role, _) in enumerate(turns) if role == "assistant"]
        for k, e in zip(replies, found):
            assert chat.parse(e.formatted) == turns[: k + 1]
            assert chat.unescape(e.formatted[e.loss_start : e.loss_end]) == turns[k][1]
        rest = found[len(replies) :]
        assert len(rest) == (turns[-1][0] != "assistant")
        assert all(chat.parse(e.formatted) == turns and e.loss_start == e.loss_end for e in rest)


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.expand(df)).count() == 0
