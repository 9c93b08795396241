"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds spans.

The model scores whole candidate segments (Sarawagi and Cohen, 2004): features see the span as a
unit — its shape, number of digits, Luhn sum, octets, length, and what stands at either side —
and a dynamic program over segments of bounded length chooses boundaries and kinds of a stretch
of text jointly. It is trained by likelihood (forward and backward sums over all segmentations) on
snippets drawn by rule with a fixed seed, a bounded number. A stretch begins and ends around
characters that personal data needs (digits, ``@``, a spelled "at" or "dot"); elsewhere no
entity can stand, so nothing is scored there. Every whole text is searched.

Spans of the fixed patterns stay as they are. The model adds those of its spans that overlap none of them.

Rows are independent: no shuffle, and a lost executor repeats its partitions. Defined results: a null
text is empty and has no spans. Equal texts get equal spans. Other columns play no part. An empty
table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymesh.llm.common import text_of
from waymesh.runtime import ship

#: Kinds in the order in which spans of equal start are listed.
KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, str]

# fixed values: the patterns of the base. A run before "@" is taken from behind and a
# number may not begin inside one: the same matches, without trying each character of a run.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    """Whether the check sum of a card number holds."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in text.split("."))


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, leftmost and without overlap per kind; failing matches are dropped."""
    found: list[Span] = []
    last = 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):
            begin = m.start()
            while begin > last and text[begin - 1] in _LOCAL:
                begin -= 1
            if begin < m.start():
                found.append((begin, m.end(), "email"))
                last = m.end()
    if _DIGIT.search(text):
        found += [(*m.span(), "ip") for m in _IP.finditer(text) if _octets(m.group())]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append((*m.span(), "card"))
        if "+" in text:
            found += [
                (*m.span(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m.group())) <= 15
            ]
    return sorted(found, key=_order)


def _order(span: Span) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[2]), span[1]


# ---- the model -------------------------------------------------------------------------------

#: Longest entity, in tokens and in characters.
MAX_TOKENS, MAX_CHARS = 20, 64
_TYPES = ("other", *KINDS)
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\s+|.", re.DOTALL)
# a spelled "at" in brackets or before a host with a point; "dot" as a token of its own
_TRIGGER = re.compile(
    r"[0-9@]+|[\[(]at[\])]|(?<![^\W\d_])(?:dot(?![^\W\d_])|at(?![^\W\d_])(?=[\w +()\[\]%-]{1,62}\.[^\W_]))", re.IGNORECASE
)
_WORD = re.compile(r"[^\W\d_]+")
#: First token, token after the last, whether it is an entity, numbers of its features.
Segment = tuple[int, int, bool, np.ndarray]


def _kind(token: str) -> str:
    c = token[0]
    return "digits" if "0" <= c <= "9" else "letters" if c.isalpha() else "space" if c.isspace() else "sign"


def _shape(span: str) -> str:
    """Runs of letters as ``a``, of digits as ``9``, spelled signs by name; the rest as it is."""
    out: list[str] = []
    for m in _TOKEN.finditer(span):
        t = m.group()
        kind = "9" if t[0].isdigit() else t.lower() if t.lower() in ("at", "dot") else "a" if t[0].isalpha() else " " if t[0].isspace() else t
        out.append(kind)
    shape = "".join(out)
    return re.sub(r"a([._%+-]?[a9])*@[a9-]+(\.[a9-]+)+", "<mail>", re.sub(r"(a9|9a)+[a9]*", "m", shape)) if "@" in shape else shape


def _side(text: str, at: int) -> str:
    if not 0 <= at < len(text):
        return "edge"
    c = text[at]
    return "space" if c.isspace() else "word" if c.isalnum() else c if c in "@.-_+/=:\"'$#%," else "sign"


def _span_features(text: str, begin: int, end: int) -> list[str]:
    span = text[begin:end]
    digits = "".join(_DIGIT.findall(span))
    n = len(digits)
    shape = _shape(span)
    left = _WORD.findall(text[max(0, begin - 16):begin])
    groups = "-".join(str(len(g)) for g in re.findall("[0-9]+", span)[:6])
    return [
        f"shape={shape[:28]}", f"digits={min(n, 20)}", f"groups={groups}", f"before={_side(text, begin - 1)}", f"after={_side(text, end)}",
        f"luhn={12 <= n <= 19 and luhn(digits)}", f"ip={shape == '9.9.9.9' and _octets(span)}", f"at={span.count('@')}",
        f"length={min((end - begin) // 6, 8)}", f"word={left[-1].lower() if left else ''}",
        f"letters={any(c.isalpha() for c in span)}", f"blanks={min(span.count(' '), 6)}", "bias",
    ]


class SemiMarkov:
    """Weights of features per type, and of neighbouring types."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.weights = np.zeros((0, len(_TYPES)))
        self.follow = np.zeros((len(_TYPES), len(_TYPES)))

    def _segments(self, text: str, grow: bool = False) -> tuple[list[tuple[int, int]], list[Segment]]:
        """Tokens, and candidate segments: every token as no entity, and every span that could be one."""
        tokens = [m.span() for m in _TOKEN.finditer(text)]
        found: list[Segment] = []

        def numbers(names: list[str]) -> np.ndarray:
            if grow:
                return np.array([self.number.setdefault(f, len(self.number)) for f in names], dtype=np.int64)
            return np.array([k for f in names if (k := self.number.get(f)) is not None], dtype=np.int64)

        for i, (begin, _) in enumerate(tokens):
            t = text[begin:tokens[i][1]]
            kind = _kind(t)
            names = [f"token={kind}", f"size={min(len(t), 20)}" if kind == "digits" else f"is={t}" if kind == "sign" else "any"]
            found.append((i, i + 1, False, numbers(names)))
            if kind == "space" or kind == "sign" and t not in "+(" or _side(text, begin - 1) == "word":
                continue
            digits, letters, joint, dotted = 0, False, False, False
            word, gap, apart = "", False, False  # the last word, whether a blank stands behind it, or stood between two
            for j in range(i, min(len(tokens), i + MAX_TOKENS)):
                stop = tokens[j][1]
                u = text[tokens[j][0]:stop]
                kind = _kind(u)
                if stop - begin > MAX_CHARS or kind == "space" and u != " ":
                    break
                if dotted and gap and kind in ("digits", "letters") and "dot" not in (word, u.lower()):
                    break  # behind its first dot a host has blanks around a spelled dot only
                if not joint and (u == "@" or u.lower() == "at"):
                    if apart:
                        break  # a name before the sign has no blanks
                else:
                    apart = apart or gap and kind in ("digits", "letters")
                gap = kind == "space" or gap and kind == "sign"
                word = u.lower() if kind in ("digits", "letters") else word
                if kind == "digits":
                    digits += len(u)
                elif kind == "letters":
                    dotted = dotted or joint and u.lower() == "dot"
                    letters, joint = True, joint or u.lower() == "at"
                elif u == "@":
                    joint = True
                elif u == ".":
                    dotted = dotted or joint
                elif u not in " +()-[]_%":
                    break
                if not joint and digits > 19:
                    break
                # an entity ends with a letter or digit that no other follows
                whole = kind in ("digits", "letters") and _side(text, stop) != "word"
                if whole and (joint and dotted and u.lower() != "dot" or not letters and digits >= 4):
                    found.append((i, j + 1, True, numbers(_span_features(text, begin, stop))))
        return tokens, found

    def _scores(self, segments: list[Segment]) -> np.ndarray:
        """Scores of the types per segment; a segment is an entity of some kind or is ``other``."""
        out = np.array([self.weights[f].sum(axis=0) for _, _, _, f in segments]).reshape(-1, len(_TYPES))
        entity = np.array([e for _, _, e, _ in segments], dtype=bool)
        out[entity, 0] = -1e9
        out[~entity, 1:] = -1e9
        return out

    def spans(self, text: str) -> list[Span]:
        """The best segmentation's entities: Viterbi over segments."""
        tokens, segments = self._segments(text)
        n, scores = len(tokens), self._scores(segments)
        best = np.full((n + 1, len(_TYPES)), -np.inf)
        best[0, 0] = 0.0
        back: dict[tuple[int, int], tuple[int, int]] = {}
        for k in sorted(range(len(segments)), key=lambda k: (segments[k][0], segments[k][1])):
            i, j = segments[k][:2]
            came = best[i][:, None] + self.follow
            prev = came.argmax(axis=0)
            total = came[prev, np.arange(len(_TYPES))] + scores[k]
            for t in np.nonzero(total > best[j])[0]:
                best[j, t] = total[t]
                back[j, int(t)] = (i, int(prev[t]))
        out: list[Span] = []
        at, t = n, int(best[n].argmax())
        while at:
            i, before = back[at, t]
            if t:
                out.append((tokens[i][0], tokens[at - 1][1], _TYPES[t]))
            at, t = i, before
        return out[::-1]

    def fit(self, examples: list[tuple[str, list[Span]]], epochs: int = 6, rate: float = 0.3, penalty: float = 1e-4) -> SemiMarkov:
        """Gradient ascent on the likelihood of the segmentations, example by example, with scaled steps."""
        known = [(text, spans, *self._segments(text, grow=True)) for text, spans in examples]
        k = len(_TYPES)
        self.weights = np.zeros((len(self.number), k))
        past_w, past_f = np.full_like(self.weights, 1e-2), np.full_like(self.follow, 1e-2)
        for _ in range(epochs):
            for text, spans, tokens, segments in known:
                share, moves = self._expected(len(tokens), segments)
                want, real = _gold(spans, tokens, segments, k)
                dw: dict[int, np.ndarray] = {}
                for s, (_, _, _, f) in enumerate(segments):
                    d = want[s] - share[s]
                    if np.abs(d).max() > 1e-4:
                        for x in f:
                            dw[x] = dw.get(x, 0) + d
                for x, d in dw.items():
                    d = d - penalty * self.weights[x]
                    past_w[x] += d * d
                    self.weights[x] += rate * d / np.sqrt(past_w[x])
                d = real - moves
                past_f += d * d
                self.follow += rate * d / np.sqrt(past_f)
        return self

    def _expected(self, n: int, segments: list[Segment]) -> tuple[np.ndarray, np.ndarray]:
        """Expected use of every (segment, type) and of every pair of neighbouring types."""
        k, scores = len(_TYPES), self._scores(segments)
        order = sorted(range(len(segments)), key=lambda s: (segments[s][0], segments[s][1]))
        ahead, behind = np.full((n + 1, k), -1e12), np.full((n + 1, k), -1e12)
        ahead[0, 0], behind[n] = 0.0, 0.0
        reach = {}
        for s in order:
            i, j = segments[s][:2]
            came = ahead[i][:, None] + self.follow
            top = came.max(axis=0)
            reach[s] = top + np.log(np.exp(came - top).sum(axis=0)) + scores[s]
            ahead[j] = np.logaddexp(ahead[j], reach[s])
        for s in reversed(order):
            i, j = segments[s][:2]
            go = self.follow + (scores[s] + behind[j])[None, :]
            top = go.max(axis=1)
            behind[i] = np.logaddexp(behind[i], top + np.log(np.exp(go - top[:, None]).sum(axis=1)))
        whole = behind[0, 0]
        share, moves = np.zeros((len(segments), k)), np.zeros((k, k))
        for s in order:
            i, j = segments[s][:2]
            share[s] = np.exp(np.minimum(reach[s] + behind[j] - whole, 0))
            moves += np.exp(np.minimum(ahead[i][:, None] + self.follow + (scores[s] + behind[j])[None, :] - whole, 0))
        return share, moves


def _gold(spans: list[Span], tokens: list[tuple[int, int]], segments, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The labelled segmentation in the same form as the expectation."""
    at = {(tokens[i][0], tokens[j - 1][1], entity): s for s, (i, j, entity, _) in enumerate(segments)}
    want, moves, before = np.zeros((len(segments), k)), np.zeros((k, k)), 0
    marked = {b: (b, e, t) for b, e, t in spans if (b, e, True) in at}
    i = 0
    while i < len(tokens):
        span = marked.get(tokens[i][0])
        begin, end, kind = span if span else (*tokens[i], "other")
        t = _TYPES.index(kind)
        want[at[begin, end, t > 0], t] = 1
        moves[before, t] += 1
        before = t
        while i < len(tokens) and tokens[i][0] < end:
            i += 1
    return want, moves


# ---- training snippets -------------------------------------------------------------------------

# fixed values: what stands around entities, and things that look alike but are none
_CUES = {
    "email": ["mail", "email", "write to", "contact"], "phone": ["call", "phone", "tel", "mobile"],
    "ip": ["host", "server", "ip", "from"], "card": ["card", "visa", "paid with", "number"],
}
_LOOKALIKES = [
    "2024-01-31", "31/12/2023", "12:45:30", "$1,234.50", "1.2.3", "10.4.300.2", "3.14159", "password={h}", 'token = "{h}{h}"', "p. 45-67",
    "978-3-16-148410-0", "1999-2004", "#4711", "@{w}", "{w}@{w}", "{d}", "{d}{d}{d}", "v2.10.4", "{bad}", "50% of 120", "dot", "the dot at {w}", "{w} at {w}", "{w} at {w} {w}", "{w} at the {w}. {w}", "{w} AT {w}", "dot {w} at {w} {w}",
    "120 x 340 x 55", "{w}{d}", "{d} at {w}", "1,000,000", "10-20-30", "2024 1 15", "{w}.{w}", "at {d}:30", "{d}-{d}", "+{d}", "({d})",
]


def _training_snippets(count: int, seed: int) -> list[tuple[str, list[Span]]]:
    """``count`` snippets of made-up words with labelled entities and lookalikes, the same for a seed."""
    draw = np.random.default_rng(seed)
    pick = lambda options: options[int(draw.integers(len(options)))]
    digits = lambda n: "".join(str(int(x)) for x in draw.integers(0, 10, n))
    word = lambda: "".join(pick(["ka", "re", "tion", "le", "en", "ou", "sch", "to", "mi", "ar"]) for _ in range(int(draw.integers(1, 4))))
    hexes = lambda: "".join(pick("0123456789abcdef") for _ in range(18))

    def card(good: bool = True) -> str:
        body = pick("45") + digits(int(pick([14, 14, 14, 13, 15])))
        for last in "0123456789":
            if luhn(body + last) == good:
                body += last
                break
        sep = pick(["", "", " ", "-", "."])
        return sep.join(body[k:k + 4] for k in range(0, len(body), 4))

    def entity(kind: str) -> str:
        if kind == "email":
            name = word() + pick(["", ".", "_"]) + pick([word(), digits(2)])
            host = [word() + pick(["", digits(1)]), pick(["example", word()]), pick(["com", "org", "net", "de"])][int(draw.integers(2)):]
            at, dot = pick([("@", ".")] * 3 + [(" at ", " dot "), ("[at]", "."), (" (at) ", "."), (" [at] ", " dot "), (" AT ", " DOT ")])
            return name + at + dot.join(host)
        if kind == "ip":
            return ".".join(str(int(x)) for x in draw.integers(0, 256, 4))
        if kind == "card":
            return card()
        a, b, c = str(int(draw.integers(2, 10))) + digits(2), digits(3), digits(4)
        return pick([f"+1 ({a}) {b}-{c}", f"+1 {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{a[:2]} {b} {c}{a}", f"1-{a}-{b}-{c}", f"({a}) {b} {c}"])

    out = []
    for _ in range(count):
        text, spans = " ".join(word() for _ in range(int(draw.integers(1, 4)))) + " ", []
        for _ in range(int(draw.integers(1, 3))):
            if draw.random() < 0.55:
                kind = pick(KINDS)
                if draw.random() < 0.4:
                    text += pick(_CUES[kind]) + pick([": ", " "])
                begin = len(text)
                text += entity(kind)
                spans.append((begin, len(text), kind))
                if draw.random() < 0.25:  # one right after the other
                    kind, begin = pick(KINDS[1:]), len(text) + 1
                    text += " " + entity(kind)
                    spans.append((begin, len(text), kind))
            else:
                text += pick(_LOOKALIKES).format(h=hexes(), w=word(), d=digits(int(draw.integers(1, 7))), bad=card(False))
            text += pick([" ", ", ", ". "]) + word() + " "
        out.append((text + word(), spans))
    return out


@lru_cache(maxsize=4)
def trained(count: int = 600, seed: int = 3) -> SemiMarkov:
    """The model from ``count`` snippets; trained once per process."""
    return SemiMarkov().fit(_training_snippets(count, seed))


def stretches(text: str) -> Iterator[tuple[int, int]]:
    """Parts of a text in which an entity could stand: as far around its triggers as one reaches, widened to blanks, apart from each other."""
    begin = end = -1
    done = 0
    for m in _TRIGGER.finditer(text):
        if end >= 0 and m.start() - end <= 2 * MAX_CHARS:
            end = m.end()
            continue
        if end >= 0:
            yield (part := _widened(text, begin, end, done, m.start() - MAX_CHARS))
            done = part[1]
        begin, end = m.span()
    if end >= 0:
        yield _widened(text, begin, end, done, len(text))


def _widened(text: str, begin: int, end: int, low: int, high: int) -> tuple[int, int]:
    """``MAX_CHARS`` more to either side, and outwards to a blank, between ``low`` and ``high``."""
    begin, end = max(low, begin - MAX_CHARS), min(high, end + MAX_CHARS)
    while begin > low and not text[begin - 1].isspace():
        begin -= 1
    while end < high and not text[end].isspace():
        end += 1
    return begin, end


def all_spans(text: str, model: SemiMarkov) -> tuple[list[Span], list[Span]]:
    """The base spans, and all spans: those and what the model adds."""
    base = base_spans(text)
    taken = sorted((b, e) for b, e, _ in base)
    added: list[Span] = []
    k = 0
    for begin, end in stretches(text):
        for b, e, kind in model.spans(text[begin:end]):
            b, e = b + begin, e + begin
            while k < len(taken) and taken[k][1] <= b - MAX_CHARS * 4:
                k += 1
            if not any(x < e and b < y for x, y in _near(taken, k, e)):
                added.append((b, e, kind))
    return base, sorted(base + added, key=_order)


def _near(taken: list[tuple[int, int]], k: int, end: int) -> Iterator[tuple[int, int]]:
    while k < len(taken) and taken[k][0] < end:
        yield taken[k]
        k += 1


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{b}:{e}" for b, e, kind in spans)


def find_personal_data(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, n_email, n_ip, n_card, n_phone`` (base), ``base, spans`` per row; ``kind:start:end``, comma-joined."""
    ship(docs.sparkSession)
    model = trained()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [all_spans(t, model) for t in batch["body"]]
            yield pd.DataFrame({
                "id": batch["id"], **{f"n_{k}": [sum(s[2] == k for s in base) for base, _ in found] for k in KINDS},
                "base": [_joined(base) for base, _ in found], "spans": [_joined(spans) for _, spans in found],
            })

    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(f"`{id}`").alias("id"), text_of(text).alias("body"))
    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    return rows.mapInPandas(work, f"id {kind}, {counts}, base string, spans string").withColumnRenamed("id", id)
