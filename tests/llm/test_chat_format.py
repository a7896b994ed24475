import itertools
import random
import re

import numpy as np

from tests.llm.conftest import prose
from tracefold.llm import chat_format as C

SCHEMA = "conv_id BIGINT, turn BIGINT, role STRING, text STRING, turns STRING, transcript STRING"


def turns(seed):
    r = random.Random(seed)
    out = [("system", prose(seed, 8).capitalize() + ".")] if r.random() < 0.4 else []
    for i in range(r.randrange(1, 4)):
        out.append(("user", prose(seed * 31 + i, r.randrange(3, 15)).capitalize() + "?"))
        out.append(("assistant", "\n\n".join(prose(seed * 37 + i * 5 + j, 25).capitalize() + "." for j in range(r.randrange(1, 3)))))
    return out


def table(spark, talks):
    return spark.createDataFrame([(i, n, role, text, "x", "y") for i, t in talks.items() for n, (role, text) in enumerate(t)], SCHEMA)


def fitted(n=150):
    return C.fit([(C.features(C.lines_of(x)), s) for x, s in (C.write_out(turns(i), i) for i in range(n))])


def test_roles_of_held_out_transcripts(spark):
    talks = {i: turns(i) for i in range(1000, 1150)}
    raw = C.raw_transcripts(table(spark, talks))
    got = {r.conv_id: r for r in C.format_chats(raw, fitted()).collect()}
    assert np.mean([got[i].roles == [r for r, _ in t] for i, t in talks.items()]) >= 0.9
    for i, t in talks.items():
        if got[i].roles == [r for r, _ in t]:
            assert got[i].chat.count("<|end|>") == len(t) == got[i].n_turns
    whole = np.mean([got[i].chat == "".join(f"<|{r}|>\n{x}\n<|end|>\n" for r, x in t) for i, t in talks.items()])
    assert whole >= 0.85  # the rendering gives the turns back


def test_viterbi_same_as_trying_all_paths():
    m = fitted(40)
    rng = np.random.default_rng(0)
    seen = [np.stack([rng.integers(0, s, n) for s in C.SIZES], axis=1) if n else np.zeros((0, len(C.SIZES)), np.int64) for n in (5, 1, 3, 0, 4)]
    paths, score = C.viterbi(seen, m)
    for x, path, s in zip(seen, paths, score):
        if not len(x):
            assert len(path) == 0 and s == 0
            continue

        def value(p):
            out = m.start[p[0]] + sum(m.move[a, b] for a, b in zip(p, p[1:]))
            return out + sum(t[z, f] for z, row in zip(p, x) for t, f in zip(m.shows, row))

        best = max(map(value, itertools.product(range(C.N_STATES), repeat=len(x))))
        assert abs(best - s) < 1e-9 and abs(value(path.tolist()) - best) < 1e-9


def test_markers():
    for line, want in (("User: hi", ("name", "user", "hi")), ("[AI] yes", ("square", "ai", "yes")), ("### Instructions", ("head", "instructions", "")), ("Q: why", ("letter", "q", "why")), ("A) red", ("paren", "a", "red")), ("**model** so", ("star", "model", "so")), ("<bot>     x", ("angle", "bot", "    x")), ("tool: 4", ("name", "tool", "4")), ("a user: no", None), ("Answering: no", None), ("note: no", None), ("", None)):
        assert C.split_marker(line) == want


CONTENT = ("Which is it?\nA) red\nB) blue\nS) green", "A) red", "Q: what is this?\nA: a quiz\n\n\nS: and an end", "    def f(x):\n        return x\n\n    f(1)", "# Heading\n- item\n  - inner: a\n1) one\n[note] <b> **bold** x", "Note: see below.\nTotal: 4\n\t tabbed")


def test_no_text_is_lost_and_explicit_markers_win():
    # Whether a paragraph without a marker is a new turn is for training to say, and in its talks users have one paragraph.
    talk = [("system", "Be brief."), *((r, re.sub("\n\n+", "\n", x) if r == "user" else x) for x in CONTENT for r in ("user", "assistant")), ("tool", "4"), ("assistant", "It is 4.")]
    for model in (fitted(), C.fit([])):
        for key in (0, 1, 2, 3, 5, 8, 13, 21, 34):  # all styles but single letters, in which text like that is ambiguous
            text, _ = C.write_out(talk, key, bare_share=0.0, tight_share=0.0)
            if text.startswith("S: "):
                continue
            ((_, roles, chat, _),) = C.parse([text], model)
            assert roles == [r for r, _ in talk]
            assert chat == "".join(f"<|{r}|>\n{x}\n<|end|>\n" for r, x in talk)


def test_styles_that_are_not_in_training():
    for style in ("Human: |Bot: ", "Customer: |Agent: ", "[you] |[gpt] ", "<user> |<assistant> ", "## Question\n|## Model\n", "(client) |(chatbot) ", "**Human:** |**AI:** ", "Q) |A) "):
        marks = style.split("|")
        talk = [(("user", "assistant")[i % 2], f"{prose(i, 9).capitalize()}.\n{prose(50 + i, 20)}") for i in range(6)]
        ((_, roles, chat, _),) = C.parse(["\n\n".join(marks[i % 2] + x for i, (_, x) in enumerate(talk))], fitted())
        assert roles == [r for r, _ in talk] and chat == "".join(f"<|{r}|>\n{x}\n<|end|>\n" for r, x in talk)


def test_every_character_but_turn_markers_is_kept():
    r = random.Random(3)
    for _ in range(60):  # also where roles are anybody's guess
        lines = [r.choice(["User: ", "A) ", "", "  ", "[AI] ", "tool: ", "B: ", "x "]) + r.choice(["word", "", "two words.", "\tq?"]) for _ in range(r.randrange(1, 12))]
        ((_, roles, chat, _),) = C.parse(["\n".join(lines)], fitted(40))
        body = "".join(c for c in chat if not c.isspace())
        for role in roles:
            body = body.replace(f"<|{role}|>", "", 1)
        body = body.replace("<|end|>", "")
        rest = iter("".join(lines).replace(" ", "").replace("\t", ""))
        assert all(c in rest for c in body)  # in order
        assert len(body) >= sum(len((C.split_marker(x) or ("", "", x))[2].replace(" ", "").replace("\t", "")) for x in lines)


def test_odd_inputs(spark):
    rows = [(1, 0, "user", None), (1, None, None, "first"), (2, 0, "user", ""), (None, 0, "user", "who"), (3, 0, "user", "same"), (3, 0, "user", "same"), (4, 0, "oracle", "unknown role"), (5, 0, "user", "User: " * 20_000), (6, 0, None, None)]
    talks = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    for model in (C.train(talks, 1000), C.fit([])):
        got = {r.conv_id: r for r in C.format_chats(C.raw_transcripts(talks), model).collect()}
        assert set(got) == {1, 2, None, 3, 4, 5, 6}
        assert got[6].n_turns == 0 and got[6].chat == "" and got[6].n_lines == 0
        assert got[4].roles == ["oracle"] or "oracle" in got[4].chat
        assert got[None].n_lines >= 1 and "who" in got[None].chat and got[3].chat.count("same") == 2
    none = spark.createDataFrame([], SCHEMA)
    assert C.format_chats(C.raw_transcripts(none), C.train(none, 1000)).count() == 0
    nulls = spark.createDataFrame([(1, None)], "conv_id BIGINT, transcript STRING")
    assert C.format_chats(nulls, C.fit([])).first().n_turns == 0


def test_markers_alone_decide_without_examples():
    ((_, roles, chat, _),) = C.parse(["System: be brief\n\nUser: why\n\nAssistant: so"], C.fit([]))
    assert roles == ["system", "user", "assistant"] and chat.startswith("<|system|>\nbe brief\n<|end|>\n<|user|>\nwhy")


def test_very_long_transcripts():
    talk = [x for i in range(3000) for x in (("user", f"Question {i}?"), ("assistant", f"Answer {i}."))]
    text, _ = C.write_out(talk, 3)
    ((n, roles, _, _),) = C.parse([text], fitted(60))
    assert n >= 6000 and np.mean([a == b for a, (b, _) in zip(roles, talk)]) > 0.4
