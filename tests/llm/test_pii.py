import random
import re
from collections import Counter

import pytest

from tests.llm.texts import documents, frame
from waymesh.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    """The base by the patterns as they are written."""
    found = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            found.append((m.start(), m.end(), kind))
    return sorted(found, key=lambda s: (s[0], list(PATTERNS).index(s[2])))


@pytest.fixture(scope="module")
def model():
    return pii.trained()


def test_base_is_what_the_patterns_find():
    rng = random.Random(5)
    for _ in range(20_000):
        text = "".join(rng.choice("a1.@+-() 4 5é\n") for _ in range(rng.randrange(40)))
        assert pii.base_spans(text) == plain(text), text


def test_base_of_long_runs_is_linear():
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "a." * 100_000 + "@", "+1 " * 50_000):
        pii.base_spans(text)


def test_model_on_snippets_it_has_not_seen(model):
    hits = found = wanted = 0
    for text, spans in pii._training_snippets(150, 77):
        got = set(model.spans(text))
        hits, found, wanted = hits + len(got & set(spans)), found + len(got), wanted + len(spans)
    assert hits / found > 0.93 and hits / wanted > 0.93


def test_probabilities_and_best_segmentation_agree(model):
    text = "call +1 (345) 555-6789 now"
    tokens, segments = model._segments(text)
    share, moves = model._expected(len(tokens), segments)
    for k in range(len(tokens)):  # every token lies in exactly one segment
        assert abs(sum(share[s].sum() for s, (i, j, _, _) in enumerate(segments) if i <= k < j) - 1) < 1e-6
    assert abs(moves.sum() - share.sum()) < 1e-6
    assert model.spans(text) == [(5, 22, "phone")]


def test_spans_are_added_and_base_ones_stay(model):
    text = "card after phone: +1 (269) 555-3296 4524132264652876 and kate [at] mail.example.org, 10.1.2.3"
    base, spans = pii.all_spans(text, model)
    assert base == plain(text) == [(85, 93, "ip")]
    assert set(base) < set(spans) and (18, 35, "phone") in spans and (36, 52, "card") in spans
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


ADDRESSES = [
    "maximilian.featherstonehaugh [at] example dot org", "christopher.montgomery at university-hospital dot org",
    "maximilian.featherstonehaugh [AT] example.org", "ann.lee (AT) example.org", "ann.lee at example Dot org", "ann.lee at mail.example.com",
]


@pytest.mark.parametrize("address", ADDRESSES)
def test_a_stretch_holds_a_spelled_address_whole(address):
    words = "these are words without any sign that calls for a look " * 4
    for text in (address, words + address + " " + words, words + "(" + address + ") " + words):
        at = text.index(address)
        assert any(b <= at and at + len(address) <= e for b, e in pii.stretches(text))


def test_stretches_lie_apart_and_reach_as_far_as_an_entity():
    rng = random.Random(7)
    for _ in range(300):
        text = "".join(rng.choice(["a", "b" * 30, " ", "-", "7" if rng.random() < 0.2 else "c"]) for _ in range(120))
        parts = list(pii.stretches(text))
        assert all(a[1] <= b[0] for a, b in zip(parts, parts[1:]))
        for m in re.finditer("7", text):
            b, e = max(0, m.end() - pii.MAX_CHARS), min(len(text), m.start() + pii.MAX_CHARS)
            assert any(x <= b and e <= y for x, y in parts), text


def test_long_spelled_addresses_are_found_whole(model):
    words = "these are words without any sign that calls for a look "
    for address in ADDRESSES:
        text = words + "write to " + address + " " + words
        at = text.index(address)
        assert (at, at + len(address), "email") in pii.all_spans(text, model)[1], address


def test_query_rows(spark, model):
    rows = documents()
    rows[0] = (rows[0][0], "write to ann.lee@mail.example.com from 10.20.30.40, +49 30 1234567", *rows[0][2:])
    got = pii.find_personal_data(frame(spark, rows)).collect()

    def listed(spans):
        return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)

    want = Counter((r[0], listed(plain(r[1] or "")), listed(pii.all_spans(r[1] or "", model)[1])) for r in rows)
    assert Counter((g.doc_id, g.base, g.spans) for g in got) == want
    one = next(g for g in got if g.doc_id == rows[0][0])
    assert (one.n_email, one.n_ip, one.n_card, one.n_phone) == (1, 1, 0, 1)
    assert pii.find_personal_data(frame(spark, [])).count() == 0
