from collections import defaultdict

import pytest

from waymesh.llm import chat

TURNS = [
    (1, 0, "system", "be brief"), (1, 1, "anna", "hello"), (1, 2, "ben", "hi <|end|> there"), (1, 3, "cleo", "hey"), (1, 4, "anna", None),
    (2, 0, "user", "a"), (2, 0, "user", "a"), (2, None, "assistant", "first"), (2, 1, None, "who"),
    (3, 0, "system", "only context"), (None, 0, "user", "nameless"), (4, 0, "user", "x" * 20000), (4, 1, "assistant", ""),
    *[(5, k, ("user", "assistant")[k % 2], f"turn {k} é😀") for k in range(50)],
]


def plain(part_turns):
    """Renderings and masks by a loop over the turns."""
    convs = defaultdict(list)
    for conv, turn, role, text in TURNS:
        convs[conv].append((-1 if turn is None else turn, (role or "unknown").replace("<|", "< |"), (text or "").replace("<|", "< |")))
    out = {}
    for conv, turns in convs.items():
        turns.sort()
        for who in {r for _, r, _ in turns} - {"system"}:
            for at in range(0, len(turns), part_turns):
                text, spans = "", []
                for _, role, said in turns[at:at + part_turns]:
                    text += "<|assistant|>\n" if role == who else "<|system|>\n" if role == "system" else f"<|user name={role}|>\n"
                    begin = len(text)
                    text += said + "<|end|>"
                    if role == who:
                        spans.append(f"{begin}:{len(text)}")
                    text += "\n"
                out[conv, who, at // part_turns] = (len(turns[at:at + part_turns]), text, ",".join(spans))
    return out


@pytest.mark.parametrize("part_turns", [512, 7])
def test_every_perspective(spark, part_turns):
    turns = spark.createDataFrame([(*t, 1, "x") for t in TURNS], "conv_id long, turn long, role string, text string, pos int, perspective string")
    got = chat.perspectives(turns, part_turns=part_turns).collect()
    assert {(g.conv_id, g.perspective, g.part): (g.n_turns, g.rendered, g.mask) for g in got} == plain(part_turns)
    assert len(got) == len(plain(part_turns))


def test_empty_table(spark):
    assert chat.perspectives(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
