"""Personal data and credentials: fixed patterns, and a linear-chain CRF that adds what they miss.

The CRF reads word-shape features of pieces (runs of letters, digits and inner punctuation, or single other
characters) and is trained here from the small labelled table below. It scores every word that holds a digit, '@' or
'=', every word with a long run of ASCII letters, and every word that names a credential or closely follows one that
does. The table has no span in other words: they are outside and cut a text into short runs of pieces, and Viterbi
decodes all runs of an Arrow batch together in numpy. Pattern spans always stay; a CRF span that touches one is dropped,
and so is one with more digits than its kind can have.

Offsets count code points, ends are exclusive. Defined cases: null and empty texts have no spans; a text that is one
long run is decoded whole; equal texts have equal spans; equal scores take the first label; columns are never read by
name inside the operator, so further columns cannot clash.
"""

from __future__ import annotations

import random
import re
import string
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "secret")
SPANS = "array<struct<kind: string, start: int, end: int, base: boolean>>"
_ARROW_SPANS = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])
)

Span = tuple[str, int, int]

# --- fixed patterns ---------------------------------------------------------------------------

_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def _emails(text: str) -> list[Span]:
    """Left-most matches of local@domain. Each '@' is looked at once, so long runs stay linear."""
    out, taken, at = [], 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        start = at
        if domain:
            while start > taken and text[start - 1] in _LOCAL:
                start -= 1
        if start < at:
            taken = domain.end()
            out.append(("email", start, taken))
        at = text.find("@", max(at + 1, taken))
    return out


def luhn(digits: str) -> bool:
    values = [ord(c) - 48 for c in reversed(digits)]
    return (sum(values[::2]) + sum(2 * v - 9 * (v > 4) for v in values[1::2])) % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and int(part) <= 255)


def pattern_spans(text: str) -> list[Span]:
    """Spans of the four fixed patterns, by start and then kind."""
    out = _emails(text)
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_octet, m.groups()))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NOT_DIGIT.sub("", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out.append(("phone", m.start(), m.end()))
    return sorted(out, key=_order)


def _order(span: Span) -> tuple[int, int]:
    return span[1], KINDS.index(span[0])


# --- pieces and features ----------------------------------------------------------------------

_MARK = re.compile(r"[0-9@=]")
_SPACE = re.compile(r"\s")
_PIECE = re.compile(r"[\w@./+-]+|[^\w\s]")
_BEFORE = re.compile(r"(\w+)\W*\Z")
_TRIM = ".-/+"
_HEX = re.compile(r"[0-9a-f]+\Z")
# Words before a value that name a credential.
CUES = frozenset("token password passwd pwd secret key apikey api_key auth bearer credential".split())
# Words after a cue that are scored as well: a value may follow "is" and a sign.
AFTER_CUE = 3
_CUE_PARTS = [c for c in sorted(CUES) if not any(d != c and d in c for d in CUES)]
_CUE = re.compile(rf"(?<![a-z0-9])(?:{'|'.join(sorted(CUES, key=len, reverse=True))})(?![a-z0-9_])", re.I | re.A)
# Letters as long as the shortest secret without a cue; inner signs are those of base64.
_LONG = re.compile(r"(?<![\w+/-])[A-Za-z][A-Za-z+/_-]{13}")
_VISIBLE = re.compile(r"\S")
_HUMP = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_CONSONANTS = re.compile(r"[^aeiouyAEIOUY\W\d_]+")


@dataclass(frozen=True)
class Run:
    """Consecutive scored words of one text: pieces as (start, end), and their features."""

    pieces: list[tuple[int, int]]
    features: list[list[str]]


def _shape(piece: str) -> str:
    kinds = ["9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in piece[:64]]
    runs = [k for i, k in enumerate(kinds) if i == 0 or k != kinds[i - 1]]
    return "".join(runs) if len(runs) <= 8 else "long"


def _bucket(n: int) -> int:
    return n if n < 5 else 5 + min(n // 4, 10)


def _describe(piece: str) -> list[str]:
    core = piece.strip(_TRIM)
    digits = _NOT_DIGIT.sub("", core)
    alternations = len(re.findall(r"[A-Za-z][0-9]|[0-9][A-Za-z]", core))
    marks = [
        f"shape={_shape(core)}",
        f"length={_bucket(len(core))}",
        f"digits={_bucket(len(digits))}",
        f"turns={min(alternations, 4)}",
    ]
    marks += ["at"] * ("@" in core)
    marks += [f"dots={min(core.count('.'), 4)}"] * ("." in core)
    if len(core) >= 12 and digits:
        marks += ["hex"] * bool(_HEX.match(core))
        marks += ["upper"] * bool(re.fullmatch(r"[A-Z0-9]+", core))
        marks += ["mixed"] * bool(re.fullmatch(r"[\w-]*[a-z][\w-]*", core) and re.search(r"[A-Z]", core))
    if 14 <= len(digits) <= 19 and len(digits) == len(core):
        marks.append(f"luhn={luhn(digits)}")
    if len(core) >= 8 and not digits and core.isascii() and re.fullmatch(r"[A-Za-z][A-Za-z+/_-]+", core):
        marks += _letters(core)
    parts = core.split(".")
    if len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts):
        marks.append(f"octets={all(map(_octet, parts))}")
    return marks if len(piece) > 1 or digits else [f"char={piece}"]


def _letters(core: str) -> list[str]:
    """What tells random letters from words: case, how short its humps are, how it is pronounced."""
    case = "lower" if core.islower() else "upper" if core.isupper() else "title" if core[1:].islower() else "cases"
    humps = [len(m.group()) for m in _HUMP.finditer(core)]
    hard = max((len(m.group()) for m in _CONSONANTS.finditer(core)), default=0)
    short = sum(n <= 2 for n in humps)
    marks = [f"{case}", f"{case}&length={_bucket(len(core))}", f"{case}&hard={min(hard, 7)}"]
    if case == "cases":
        marks += [f"short={min(short, 5)}", f"humps={10 * len(humps) // len(core)}"]
    return [f"letters={m}" for m in marks]


def _word_end(text: str, at: int) -> int:
    space = _SPACE.search(text, at)
    return space.start() if space else len(text)


def _cue_words(text: str) -> list[int]:
    """Places in the words that hold a cue and in the next words after them; no word is read more than a few times."""
    lower = text.lower()
    if not any(c in lower for c in _CUE_PARTS):
        return []
    out, end = set(), 0
    while cue := _CUE.search(text, end):
        out.add(cue.start())
        end = at = _word_end(text, cue.end())
        for _ in range(AFTER_CUE):
            if not (word := _VISIBLE.search(text, at)):
                break
            out.add(word.start())
            at = _word_end(text, word.start())
    return sorted(out)


def _marked_words(text: str) -> Iterator[tuple[int, int]]:
    """Words that can hold a span, each found from one place in it: linear in the text."""
    end = 0
    places = sorted([*_cue_words(text), *(m.start() for m in _LONG.finditer(text))], reverse=True)
    mark = _MARK.search(text)
    while mark or places:
        at = min(([mark.start()] if mark else []) + places[-1:])
        start = at
        while start > end and not text[start - 1].isspace():
            start -= 1
        end = _word_end(text, at)
        yield start, end
        if mark and mark.start() < end:
            mark = _MARK.search(text, end)
        while places and places[-1] < end:
            places.pop()


def _is_cue(piece: str) -> bool:
    lower = piece.lower()
    return lower in CUES or re.split(r"[-_./+]", lower)[-1] in CUES


def runs_of(text: str) -> list[Run]:
    """Runs of consecutive scored words with the features of their pieces."""
    out: list[Run] = []
    pieces: list[tuple[int, int]] = []
    last = -1
    for start, end in _marked_words(text):
        if pieces and text[last:start].strip():
            out.append(_featured(text, pieces))
            pieces = []
        pieces += [m.span() for m in _PIECE.finditer(text, start, end)]
        last = end
    if pieces:
        out.append(_featured(text, pieces))
    return out


def _featured(text: str, pieces: list[tuple[int, int]]) -> Run:
    first = pieces[0][0]
    before = _BEFORE.search(text, max(0, first - 40), first)
    # What stands before the run, then the run itself.
    words = ["cue" if before and _is_cue(before.group(1)) else "word"]
    own = [text[a:b] for a, b in pieces]
    described = [_describe(p) for p in own]
    cues = [_is_cue(p) for p in own]
    features = []
    for i, marks in enumerate(described):
        last = own[i - 1].lower() if i else words[0]
        near = "cue" if last == "cue" or (i and cues[i - 1]) else last if len(last) == 1 else ("start" if i == 0 else "other")
        cue = any(cues[max(0, i - 4) : i]) or (i <= 3 and words[0] == "cue")
        after = own[i + 1] if i + 1 < len(own) else "end"
        row = [*marks, f"before={near}", f"after={after if len(after) == 1 else 'piece'}", f"cue={cue}"]
        row += [f"cue={cue}&{m}" for m in marks if m.startswith(("hex", "upper", "mixed", "length", "shape=long", "letters"))]
        # Words between the cue and the value.
        back = next((j for j in range(i - 1, max(-1, i - 5), -1) if cues[j]), None)
        gap = "none" if back is None else min(2, sum(len(p) > 1 for p in own[back + 1 : i]))
        row += [f"gap={gap}&before={near}&{m}" for m in marks if m.startswith("letters")]
        features.append(row)
    return Run(pieces, features)


# --- the labelled table -----------------------------------------------------------------------


def labelled_table(rows: int = 2000, seed: int = 11) -> list[tuple[str, list[Span]]]:
    """Short texts with known spans, made from a few forms per kind and look-alikes that are none."""
    rng = random.Random(seed)
    lower, digits, hexes = string.ascii_lowercase, string.digits, "0123456789abcdef"
    base62 = string.ascii_letters + digits

    def some(alphabet: str, n: int) -> str:
        return "".join(rng.choice(alphabet) for _ in range(n))

    def word() -> str:
        return some(lower, rng.randint(2, 9))

    def card() -> str:
        body = some(digits, rng.choice((13, 14, 15, 15, 15, 18)))
        return next(body + d for d in digits if luhn(body + d))

    def not_card() -> str:
        number = some(digits, rng.randint(14, 19))
        return number if not luhn(number) else not_card()

    def dotted(top: int) -> str:
        return ".".join(str(rng.randint(0, top)) for _ in range(4))

    def phrase(least: int, most: int) -> str:
        """Pronounceable letters, as of words or joined words."""
        size, out = rng.randint(least, most), ""
        while len(out) < size:
            out += rng.choice(("", *"bcdfghjklmnprstvw", "st", "tr", "ch", "pl")) + rng.choice("aeiou") + rng.choice("  nrstl").strip()
        return out[:size]

    def humps() -> str:
        parts = [phrase(3, 9).title() for _ in range(rng.randint(2, 5))]
        return "".join([rng.choice((parts[0], parts[0].lower())), *parts[1:]])

    def jagged() -> str:
        size = rng.randint(16, 40)
        pick = rng.choice(("any", "turns"))
        out = some(string.ascii_letters, size) if pick == "any" else some(lower, size)
        return out if pick == "any" else "".join(c.upper() if i % 2 == 0 else c for i, c in enumerate(out))

    n = lambda a, b: str(rng.randint(a, b))
    forms = {
        "email": [lambda: f"{word()}.{n(1, 99)}@{word()}{n(1, 9)}.{word()}.com", lambda: f"{word()}@{word()}.org"],
        "ip": [lambda: dotted(255)],
        "card": [card, lambda: " ".join(re.findall("....", next(c for c in iter(card, "") if len(c) == 16)))],
        "phone": [
            lambda: f"+1 ({n(200, 999)}) {n(200, 999)}-{n(1000, 9999)}",
            lambda: f"({n(200, 999)}) {n(200, 999)}-{n(1000, 9999)}",
            lambda: f"+{n(20, 99)} {n(10, 99)} {n(1000000, 9999999)}",
        ],
        "secret": [
            lambda: some(hexes, rng.choice((32, 40, 64))),
            lambda: "AKIA" + some(string.ascii_uppercase + digits, 16),
            lambda: some(hexes, rng.randint(14, 24)),
            lambda: some(base62, rng.randint(20, 44)),
        ],
    }
    # Secrets of letters only: joined words need a cue, and a sign or quotes to be told from prose.
    joined = ["password: %s", "secret: %s", "token: %s", 'token = "%s"', "password=%s", "pwd = %s"]
    joined += ['"password": "%s"', "passwd : %s", "client_secret: %s", "credential: %s", "key=%s", "auth: '%s'"]
    random_letters = ["%s", "%s", "token %s", "key %s", "bearer %s", "the secret is %s", *joined]
    prose = "key token secret password auth bearer Key Token".split()
    framed = {
        "secret": [
            'token = "%s"', "password=%s", "secret: %s", 'api_key="%s"', "%s", "key %s", "pwd = %s", "auth=%s", "%s",
        ]
    }
    others = [
        lambda: n(1900, 2030), lambda: f"{n(1, 9)}.{n(0, 9)}", lambda: f"version {n(1, 9)}.", lambda: not_card(),
        lambda: f"${n(1, 9)},{n(100, 999)}.{n(10, 99)}", lambda: f"{n(0, 23)}:{n(10, 59)}", lambda: f"@{word()}",
        lambda: f"{n(2000, 2030)}-{n(10, 12)}-{n(10, 28)}", lambda: f"{word()}={n(0, 99)}", lambda: f"{word()} = {word()}",
        lambda: f"http://{word()}.com/{word()}?id={n(1, 999)}", lambda: f"{n(1, 99)}%", lambda: f"{word()}{n(1, 9)}",
        lambda: f"{n(1, 999)},{n(100, 999)}", lambda: f"{n(256, 999)}.{n(256, 999)}.{n(1, 9)}.{n(1, 9)}",
        lambda: f"{n(1, 99)}) {word()}", lambda: f"{word()}=={word()}", lambda: f"{n(1, 9)}.{n(1, 9)}.{n(1, 20)}",
        lambda: f"Version {n(1, 9)}.0, {word()}", lambda: f"{word().upper()}-{n(1, 9)}.0.", lambda: n(0, 99999999),
        lambda: humps(), lambda: humps(), lambda: phrase(14, 22), lambda: phrase(14, 18).upper(), lambda: phrase(14, 18).title(),
        lambda: f"{phrase(4, 9)}-{phrase(2, 4)}-{phrase(4, 9)}", lambda: f"{phrase(4, 9)}/{phrase(4, 9)}/{phrase(3, 9)}",
        lambda: f"https://{phrase(5, 12)}.com/{phrase(4, 9)}/{phrase(4, 9)}/{phrase(3, 9)}", lambda: f"www.{phrase(14, 20)}.org",
        lambda: f"({phrase(3, 9)}.{phrase(2, 3)}/{phrase(4, 9)}/{phrase(4, 9)}_{phrase(3, 9)})", lambda: f"http://{phrase(14, 20)}.net",
        lambda: f"{rng.choice(prose)} {phrase(4, 10)}: {phrase(4, 19)}", lambda: f"{phrase(14, 18)}/{phrase(3, 9)}.{word()}",
        lambda: f"{phrase(4, 9)}_{phrase(4, 9)}_{phrase(3, 9)}", lambda: f"{rng.choice(prose)} {phrase(2, 17)} {phrase(2, 14)}",
        lambda: f"{rng.choice(prose)}: {phrase(2, 11)} {word()}", lambda: f"{rng.choice(prose)} {humps()}",
        lambda: f"the {rng.choice(prose)} is {phrase(2, 15)}, {word()}", lambda: f"{rng.choice(prose)} {word()}: {phrase(2, 11)}",
        lambda: f"{rng.choice(prose)} of {phrase(2, 15)} {word()} {word()}", lambda: f"{rng.choice(prose)}. {phrase(2, 14).title()} {word()}",
        lambda: f"===== {word()} =====", lambda: f"{word()} @ {n(1, 99)}", lambda: f"{n(1, 99)}x{n(1, 99)}",
    ]
    ends = ["", "", "", ".", ",", "***", "%%%", ")", ";"]

    def listed() -> tuple[str, list[Span]]:
        """Many look-alikes in a row, of one form or of several, with or without a span among them."""
        form, size, gap = rng.choice((None, rng.choice(others))), rng.randint(2, 8), rng.choice((" ", " ", ", "))
        values = [("none", (form or rng.choice(others))()) for _ in range(size)]
        if rng.random() < 0.6:
            kind = rng.choice(KINDS)
            values[rng.randrange(size)] = (kind, rng.choice(forms[kind])())
        text, spans = "", []
        for kind, value in values:
            if kind != "none":
                spans.append((kind, len(text), len(text) + len(value)))
            text += value + gap
        return text + word(), spans

    table = []
    for _ in range(rows):
        kind = rng.choice([*KINDS, "secret", "none", "none", "none", "none"])
        lead = " ".join(word() for _ in range(rng.randint(0, 3)))
        if kind == "none":
            frame, value = "%s", rng.choice(others)()
        else:
            frame, value = rng.choice(framed.get(kind, ["%s", "%s", "(%s)", "<%s>"])), rng.choice(forms[kind])()
            if kind == "secret" and rng.random() < 0.4:
                letters = rng.choice(("jagged", "joined"))
                frame = rng.choice(random_letters if letters == "jagged" else joined)
                value = jagged() if letters == "jagged" else phrase(16, 30)
        text = f"{lead} " if lead else ""
        start = len(text) + frame.index("%s")
        text += frame.replace("%s", value) + rng.choice(ends) + " " + word()
        table.append((text, [] if kind == "none" else [(kind, start, start + len(value))]))
    return table + [listed() for _ in range(rows // 8)]


# --- the model --------------------------------------------------------------------------------

LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
_FORBIDDEN = -1e4


@dataclass(frozen=True)
class Crf:
    index: dict[str, int]  # feature -> row of weights; the last row of weights is zero
    weights: np.ndarray  # (features + 1, labels)
    moves: np.ndarray  # (labels, labels)
    first: np.ndarray  # (labels,)


def _constraints() -> tuple[np.ndarray, np.ndarray]:
    """I-k follows only B-k or I-k, and never comes first."""
    moves, first = np.zeros((len(LABELS),) * 2), np.zeros(len(LABELS))
    for j, label in enumerate(LABELS):
        if label.startswith("I-"):
            first[j] = _FORBIDDEN
            for i, last in enumerate(LABELS):
                if last[2:] != label[2:]:
                    moves[i, j] = _FORBIDDEN
    return moves, first


def _rows(run: Run, index: dict[str, int], width: int) -> np.ndarray:
    rows = np.full((len(run.pieces), width), len(index))
    for i, marks in enumerate(run.features):
        known = [index[m] for m in marks if m in index][:width]
        rows[i, : len(known)] = known
    return rows


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _tags(run: Run, spans: list[Span]) -> list[int]:
    tags, last = [], None
    for start, end in run.pieces:
        span = next((s for s in spans if s[1] < end and start < s[2]), None)
        tags.append(LABELS.index(f"{'I' if span == last else 'B'}-{span[0]}") if span else 0)
        last = span
    return tags


def train(table: list[tuple[str, list[Span]]], steps: int = 80, rate: float = 0.1, decay: float = 1e-3) -> Crf:
    """Maximise the conditional log-likelihood: forward-backward over runs of equal length, Adam steps."""
    examples = [(run, _tags(run, spans)) for text, spans in table for run in runs_of(text)]
    index: dict[str, int] = {}
    for run, _ in examples:
        for marks in run.features:
            for mark in marks:
                index.setdefault(mark, len(index))
    width = max(len(m) for run, _ in examples for m in run.features)
    batches = []
    for n in sorted({len(run.pieces) for run, _ in examples}):
        own = [(run, tags) for run, tags in examples if len(run.pieces) == n]
        batches.append((np.stack([_rows(r, index, width) for r, _ in own]), np.array([t for _, t in own])))
    hard_moves, hard_first = _constraints()
    size = len(LABELS)
    params = [np.zeros((len(index) + 1, size)), np.zeros((size, size)), np.zeros(size)]
    mean, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        grads = [-decay * len(examples) * p / 10 for p in params]
        moves, first = params[1] + hard_moves, params[2] + hard_first
        for rows, tags in batches:
            count, n, _ = rows.shape
            scores = params[0][rows].sum(axis=2)
            forward, backward = np.empty((n, count, size)), np.zeros((n, count, size))
            forward[0] = first + scores[:, 0]
            for t in range(1, n):
                forward[t] = _logsumexp(forward[t - 1][:, :, None] + moves, 1) + scores[:, t]
            for t in range(n - 2, -1, -1):
                backward[t] = _logsumexp(moves + (scores[:, t + 1] + backward[t + 1])[:, None, :], 2)
            total = _logsumexp(forward[-1], 1)
            miss = -np.exp(np.swapaxes(forward + backward, 0, 1) - total[:, None, None])
            miss[np.arange(count)[:, None], np.arange(n), tags] += 1
            np.add.at(grads[0], rows.reshape(-1), np.repeat(miss.reshape(-1, size), rows.shape[2], axis=0))
            grads[2] += miss[:, 0].sum(axis=0)
            for t in range(1, n):
                pair = forward[t - 1][:, :, None] + moves + (scores[:, t] + backward[t])[:, None, :]
                grads[1] -= np.exp(pair - total[:, None, None]).sum(axis=0)
                np.add.at(grads[1], (tags[:, t - 1], tags[:, t]), 1)
        grads[0][-1] = 0
        for p, g, m, s in zip(params, grads, mean, square, strict=True):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            p += rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return Crf(index, params[0], params[1] + hard_moves, params[2] + hard_first)


@lru_cache(maxsize=1)
def default_model() -> Crf:
    """The model of the labelled table; the same on every machine."""
    return train(labelled_table())


def viterbi(scores: np.ndarray, model: Crf) -> np.ndarray:
    """Best labels of runs of one length: scores (runs, pieces, labels) to (runs, pieces)."""
    count, n, _ = scores.shape
    best = model.first + scores[:, 0]
    came = np.empty((n, count, len(LABELS)), np.int8)
    for t in range(1, n):
        paths = best[:, :, None] + model.moves
        came[t] = paths.argmax(axis=1)
        best = paths.max(axis=1) + scores[:, t]
    labels = np.empty((count, n), np.int64)
    labels[:, -1] = best.argmax(axis=1)
    for t in range(n - 1, 0, -1):
        labels[:, t - 1] = came[t][np.arange(count), labels[:, t]]
    return labels


def _scores(run: Run, model: Crf) -> np.ndarray:
    """(pieces, labels): weights of all features of each piece, added up one feature at a time."""
    rows = _rows(run, model.index, max(map(len, run.features)))
    scores = np.zeros((len(run.pieces), len(LABELS)))
    for feature in rows.T:
        scores += model.weights[feature]
    return scores


def crf_spans(texts: list[str], model: Crf) -> list[list[Span]]:
    """Spans the CRF finds in each text; runs of one length are decoded together."""
    by_length: dict[int, list[tuple[int, Run]]] = {}
    for i, text in enumerate(texts):
        for run in runs_of(text):
            by_length.setdefault(len(run.pieces), []).append((i, run))
    out: list[list[Span]] = [[] for _ in texts]
    for own in by_length.values():
        scores = np.stack([_scores(run, model) for _, run in own])
        for (i, run), labels in zip(own, viterbi(scores, model).tolist(), strict=True):
            out[i] += _labelled_spans(texts[i], run, labels)
    return out


# Digits that a value of a kind can have at most; more are a list of numbers.
MOST_DIGITS = {"ip": 12, "card": 19, "phone": 15}


def _labelled_spans(text: str, run: Run, labels: list[int]) -> list[Span]:
    spans: list[Span] = []
    for (start, end), label in zip(run.pieces, labels, strict=True):
        name = LABELS[label]
        if name.startswith("I-") and spans and spans[-1][0] == name[2:]:
            spans[-1] = (name[2:], spans[-1][1], end)
        elif name != "O":
            spans.append((name[2:], start, end))
    trimmed = []
    for kind, start, end in spans:
        while end > start and text[end - 1] in _TRIM:
            end -= 1
        if end > start and sum(map(str.isdigit, text[start:end])) <= MOST_DIGITS.get(kind, end):
            trimmed.append((kind, start, end))
    return trimmed


def all_spans(texts: list[str], model: Crf) -> list[list[tuple[str, int, int, bool]]]:
    """Pattern spans and the CRF spans that touch none of them, by start and then kind."""
    out = []
    for text, added in zip(texts, crf_spans(texts, model), strict=True):
        base = pattern_spans(text)
        # Base spans are sorted by start; the furthest end up to each tells whether one reaches into a place.
        starts, ends = [b[1] for b in base], list(accumulate((b[2] for b in base), max))
        free = [s for s in added if not (n := bisect_left(starts, s[2])) or ends[n - 1] <= s[1]]
        both = [(*s, True) for s in base] + [(*s, False) for s in free]
        out.append(sorted(both, key=lambda s: _order(s[:3])))
    return out


def redact_text(text: str, spans: list[tuple[str, int, int, bool]]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    for kind, start, end, _ in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


# --- columns ----------------------------------------------------------------------------------


def find(text: Column, model: Crf | None = None) -> Column:
    """Spans of a text column; ``base`` marks those of the fixed patterns."""
    model = model or default_model()

    @F.arrow_udf(SPANS)
    def spans_of(texts: pa.Array) -> pa.Array:
        found = all_spans([t or "" for t in texts.to_pylist()], model)
        rows = [[{"kind": k, "start": a, "end": b, "base": own} for k, a, b, own in spans] for spans in found]
        return pa.array(rows, _ARROW_SPANS)

    return spans_of(text)


def redact(text: Column, model: Crf | None = None) -> Column:
    """The text column without personal data; null stays null."""
    model = model or default_model()

    @F.arrow_udf("string")
    def redacted(texts: pa.Array) -> pa.Array:
        rows = texts.to_pylist()
        found = all_spans([t or "" for t in rows], model)
        return pa.array([None if t is None else redact_text(t, s) for t, s in zip(rows, found, strict=True)], pa.string())

    return redacted(text)
