"""Personal data: exact patterns, and more spans from a semi-Markov conditional random field."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import by_row, hash_sample, unused, with_text_verdict

#: Kinds in the order in which spans are listed; the last is found by the model only.
KINDS = ("email", "ip", "card", "phone", "secret")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    """Whether a card number's check digit holds."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Each @ with the run of local characters before it, down to the last match, and a dotted domain behind it."""
    out, at, done = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append(("email", start, found.end()))
            done = found.end()
        else:
            done = at + 1
        at = text.find("@", done)
    return out


def addresses(text: str) -> list[Span]:
    """Four numbers out of each run of dotted ones, from its left, kept if none is above 255."""
    out = []
    for run in DOTTED.finditer(text):
        s = run.group()
        if s.count(".") < 3:
            continue
        at, parts = run.start(), s.split(".")
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append(("ip", at, end))
            at = end + 1
    return out


def cards(text: str) -> list[Span]:
    out = []
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    return out


def phones(text: str) -> list[Span]:
    out = []
    for m in PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m.group())) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def base_spans(text: str | None) -> list[Span]:
    """(kind, start, end) by kind as listed, then start; code points, ends exclusive; none for null."""
    text = text or ""
    out = emails(text) if "@" in text else []
    if DIGIT.search(text):
        out += addresses(text) + cards(text) + (phones(text) if "+" in text else [])
    return out


DIGIT = re.compile("[0-9]")
UNIT = re.compile(r"\S+")
#: A name that gives a secret at a unit's end, so that the next unit is its value.
_GIVES = r"(?i:\b(?:password|passwd|pwd|token|secret|api_?key)[\"']?\s*[:=])"
#: A unit that may hold personal data, wherever in it: a digit, an @, a sign that gives a value, or the name of a secret.
OF_NOTE = re.compile(r"[0-9@=]|" + _GIVES)
GIVES = re.compile(_GIVES + r"[\"']?$")
#: Words that announce a value, by what they announce (lower case, without punctuation).
CUES = {"email": "email", "e-mail": "email", "mail": "email", "ip": "ip", "host": "ip", "server": "ip", "card": "card", "visa": "card", "tel": "phone", "phone": "phone", "call": "phone", "mobile": "phone", "fax": "phone", "password": "secret", "passwd": "secret", "pwd": "secret", "token": "secret", "secret": "secret", "key": "secret", "api_key": "secret", "apikey": "secret"}
#: Silver examples of secrets for learning: values that name themselves.
SEEDS = re.compile(r"(?:\b(?:password|passwd|pwd|token|secret|api_?key)\b\s*[=:]\s*[\"']?)(?P<value>[A-Za-z0-9_+/-]{8,})|(?P<key>\bAKIA[0-9A-Z]{16}\b)|(?P<pem>\b(?:ghp_|sk-|xox[bap]-)[A-Za-z0-9-]{16,})")
#: Units in the longest span, and kinds with "none" first.
LONGEST, STATES = 4, ("none", *KINDS)
EDGE = ".,;:!?\"'<>[]{}"


def windows(text: str) -> Iterator[list[tuple[int, int]]]:
    """Units (start, end) around those of note, two before and one behind; windows that touch are one.

    The unit behind a name that gives a secret is of note. A window is as long
    as its run, so no span lies across two; every unit of note is in one.
    """
    at, size = 0, len(text)
    note = OF_NOTE.search(text)
    while note:
        a = b = note.start()
        while a > at and not text[a - 1].isspace():
            a -= 1
        end = UNIT.match(text, a).end()
        units = [(a, end)]
        for _ in range(2):
            b = a
            while b > at and text[b - 1].isspace():
                b -= 1
            c = b
            while c > at and not text[c - 1].isspace():
                c -= 1
            if c == b:
                break
            units.insert(0, (c, b))
            a = c
        at, quiet = end, 0
        while quiet < 1 and at < size:
            m = UNIT.search(text, at)
            if not m:
                at = size
                break
            given = GIVES.search(text, units[-2:][0][0], units[-1][1])
            quiet = 0 if given or OF_NOTE.search(text, m.start(), m.end()) else quiet + 1
            units.append(m.span())
            at = m.end()
        yield units
        note = OF_NOTE.search(text, at)


def trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and text[a] in EDGE:
        a += 1
    while b > a and text[b - 1] in EDGE:
        b -= 1
    return a, b


def valued(text: str, a: int, b: int) -> tuple[int, int]:
    """The value of ``name=value`` or ``name = "value"``, or all of it."""
    cut = max(text.rfind("=", a, b), text.rfind(":", a, b) if "//" not in text[a:b] else -1)
    return trimmed(text, cut + 1 if a <= cut < b - 1 else a, b) if cut >= 0 else trimmed(text, a, b)


def _shape(s: str) -> str:
    s = re.sub(r"[0-9]+", lambda m: f"9{min(4, len(m.group()))}", s)
    s = re.sub(r"[a-z]+", "a", s)
    return re.sub(r"[^\W\d_a-z]+", "A", s)[:16]


def features(text: str, units: list[tuple[int, int]], i: int, j: int) -> list[str]:
    """What the model sees of the whole span of units i to j (inclusive) and of the words before it."""
    a, b = trimmed(text, units[i][0], units[j][1])
    s = text[a:b]
    digits = sum(c.isdigit() for c in s)
    letters = sum(c.isalpha() for c in s)
    counts = Counter(s).values()
    chaos = -sum(c / len(s) * math.log2(c / len(s)) for c in counts) if s else 0
    out = [f"units{j - i}", f"size{min(6, len(s) // 5)}", f"digits{min(20, digits)}", f"mix{(digits > 0) + 2 * (letters > 0)}", f"chaos{int(chaos * 2)}", f"shape:{_shape(s)}", f"at{s.count('@')}", f"dots{min(4, s.count('.'))}", f"plus{s[:1] == '+'}", f"eq{'=' in s}", f"upper{s.isupper()}", f"inner{bool(re.search(r'[=:]$', s))}"]
    if s and DIGIT.search(s):
        out.append(f"share{round(4 * digits / len(s))}")
        runs = [len(x) for x in re.findall(r"[0-9]+", s)]
        out.append(f"runs{min(5, len(runs))}:{min(9, max(runs))}")
    v = text[slice(*valued(text, a, b))]
    out.append(f"value{min(5, len(v) // 8)}{bool(DIGIT.search(v)) and any(c.isalpha() for c in v)}{bool(re.fullmatch('[0-9a-f]+', v))}{v.isalnum()}")
    plain = re.sub(r"[\x20().-]", "", s)
    if plain.isdigit() and 13 <= len(plain) <= 19:
        out.append(f"luhn{luhn(plain)}")
    if s.count(".") == 3 and re.fullmatch(r"[0-9.]+", s):
        out.append(f"octets{all(x and len(x) < 4 and int(x) < 256 for x in s.split('.'))}")
    for k in (1, 2):
        if i - k >= 0:
            word = text[slice(*trimmed(text, *units[i - k]))].lower()
            if word in CUES:
                out.append(f"cue{k}:{CUES[word]}")
    head = re.match(r"[A-Za-z_-]+(?=[=:])", s)
    if head:
        out.append(f"head:{CUES.get(head.group().lower(), 'other')}")
    return out


@dataclass
class SemiMarkov:
    """Weights of span features for each state; a missing feature weighs nothing."""

    weights: dict[str, np.ndarray]

    def ending(self, text: str, units: list[tuple[int, int]], j: int, noted: list[bool]) -> list[np.ndarray | None]:
        """Scores by state of the spans that end at unit j, by how many more units they have; None where there is none.

        What is no entity goes unit by unit, and an entity ends at a unit of
        note; it has several units if others of note are among them, or a cue.
        """
        out: list[np.ndarray | None] = []
        for k in range(min(LONGEST, j + 1)):
            if k and not (noted[j] and (any(noted[j - k : j]) or text[units[j - k][0] : units[j - k][1]].lower().strip(EDGE) in CUES)):
                out.append(None)
                continue
            total = np.zeros(len(STATES))
            for f in features(text, units, j - k, j):
                w = self.weights.get(f)
                if w is not None:
                    total += w
            if k:
                total[0] = -1e9
            elif not noted[j]:
                total[1:] = -1e9
            out.append(total)
        return out

    def decode(self, text: str) -> list[Span]:
        """The best boundaries and kinds together, by dynamic programming over each window; per unit only the best way to it is held."""
        out = []
        for units in windows(text):
            noted, n = of_note(text, units), len(units)
            best, back = [0.0] + [-1e18] * n, [(0, 0)] * (n + 1)
            for j in range(n):
                for k, s in enumerate(self.ending(text, units, j, noted)):
                    if s is not None:
                        y = int(s.argmax())
                        if (v := best[j - k] + float(s[y])) > best[j + 1]:
                            best[j + 1], back[j + 1] = v, (k, y)
            at = n
            while at:
                k, y = back[at]
                if y:
                    a, b = units[at - 1 - k][0], units[at - 1][1]
                    a, b = valued(text, a, b) if STATES[y] == "secret" else trimmed(text, a, b)
                    if a < b:
                        out.append((STATES[y], a, b))
                at -= k + 1
        return out


def of_note(text: str, units: list[tuple[int, int]]) -> list[bool]:
    """Which units are of note by themselves, or by a name before them that gives a secret."""
    return [bool(OF_NOTE.search(text, a, b)) or i > 0 and bool(GIVES.search(text, units[max(0, i - 2)][0], units[i - 1][1])) for i, (a, b) in enumerate(units)]


def _silver(text: str) -> list[Span]:
    found = [s for s in base_spans(text)]
    for m in SEEDS.finditer(text):
        name = m.lastgroup
        found.append(("secret", m.start(name), m.end(name)))
    return found


def _labels(text: str, units: list[tuple[int, int]], spans: list[Span]) -> list[tuple[int, int, int]]:
    """The units as segments (last, more units, state) that the spans lay out; a span claims the units it touches."""
    owner: dict[int, Span] = {}
    for s in spans:
        for u, (a, b) in enumerate(units):
            if a < s[2] and s[1] < b and u not in owner:
                owner[u] = s
    out, u = [], 0
    while u < len(units):
        s, v = owner.get(u), u
        while s and v + 1 < len(units) and owner.get(v + 1) == s and v + 1 - u < LONGEST:
            v += 1
        out.append((v, v - u, STATES.index(s[0]) if s else 0))
        u = v + 1
    return out


def fit(docs: DataFrame, train_windows: int = 1200, sample_rows: int = 6000, text_windows: int = 64, longest_window: int = 2000, rounds: int = 6) -> SemiMarkov:
    """A model learned from windows of about ``sample_rows`` rows of (doc_id, text), chosen by a hash of the doc_id.

    Spans of the exact patterns, and secrets that name themselves, are the
    examples; all other units of the windows are what is none. A text gives
    ``text_windows`` windows at most, evenly spread over all of it, and none of
    over ``longest_window`` code points (in scoring, windows have no bound); at most ``train_windows``, in the
    order of a hash, reach the driver. The
    likelihood of whole segmentations is climbed by stochastic gradients.
    """
    def cut(x: dict) -> dict:
        kept = []
        for text in x["text"]:
            if not text:
                continue
            spans = _silver(text)
            own = list(windows(text))
            for units in own[:: max(1, -(-len(own) // text_windows))]:
                a, b = units[0][0], units[-1][1]
                if b - a > longest_window:
                    continue
                inside = [f"{k}:{max(0, s - a)}:{min(b, e) - a}" for k, s, e in spans if s < b and e > a]
                kept.append((text[a:b], ",".join(inside)))
        return {"text": [k[0] for k in kept], "spans": [k[1] for k in kept]}

    some = hash_sample(docs.select("doc_id", "text"), F.col("doc_id"), docs.count(), sample_rows)
    got = by_row(some, ["text"], "text string, spans string", cut).distinct().orderBy(F.xxhash64("text"), "text", "spans").limit(train_windows).collect()
    model, sums = SemiMarkov({}), {}
    rng = np.random.default_rng(5)
    for t in range(rounds):
        for g in rng.permutation(len(got)):
            text = got[g][0]
            spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in got[g][1].split(",") if x)]
            units = [m.span() for m in UNIT.finditer(text)]
            if units:
                _climb(model, sums, text, units, spans)
    return model


def expected(model: SemiMarkov, text: str, units: list[tuple[int, int]]) -> tuple[float, dict[tuple[int, int], np.ndarray]]:
    """(log of the sum over all segmentations, chance of each span (last unit, more units) by state), by sums forward and back."""
    noted, n = of_note(text, units), len(units)
    s = [model.ending(text, units, j, noted) for j in range(n)]
    ahead, behind, log = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf), np.logaddexp.reduce
    ahead[0] = behind[n] = 0
    for j in range(n):
        ahead[j + 1] = log(np.concatenate([ahead[j - k] + x for k, x in enumerate(s[j]) if x is not None]))
    for i in range(n - 1, -1, -1):
        behind[i] = log(np.concatenate([behind[j + 1] + s[j][j - i] for j in range(i, min(n, i + LONGEST)) if s[j][j - i] is not None]))
    spans = {(j, k): np.exp(np.clip(ahead[j - k] + x + behind[j + 1] - ahead[n], -700, 0)) for j in range(n) for k, x in enumerate(s[j]) if x is not None}
    return float(ahead[n]), spans


def _climb(model: SemiMarkov, sums: dict, text: str, units: list, spans: list) -> None:
    """One gradient step: features of the known segments less those expected under the model."""
    noted = of_note(text, units)
    known = _labels(text, units, spans)
    for j, k, y in known:
        x = model.ending(text, units, j, noted)[k]
        if x is None or x[y] < -1e8:
            return  # a layout that decoding never makes
    truth = {(j, k): y for j, k, y in known}
    for (j, k), chance in expected(model, text, units)[1].items():
        g = -chance
        if (j, k) in truth:
            g[truth[j, k]] += 1
        if np.abs(g).max() < 1e-3:
            continue
        for f in features(text, units, j - k, j):
            w = model.weights.setdefault(f, np.zeros(len(STATES)))
            q = sums.setdefault(f, np.full(len(STATES), 1e-2))
            q += g * g
            w += 0.3 * (g - 1e-3 * w) / np.sqrt(q)


def spans_of(text: str | None, model: SemiMarkov) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans): the model's spans that touch no base span are added; by kind, then start."""
    text = text or ""
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    starts, reach = np.array([a for a, _ in taken]), np.maximum.accumulate(np.array([b for _, b in taken], np.int64))
    more = []
    for k, a, b in model.decode(text) if OF_NOTE.search(text) else []:
        at = int(np.searchsorted(starts, b))
        if not at or reach[at - 1] <= a:
            more.append((k, a, b))
    return base, sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_private(docs: DataFrame, model: SemiMarkov) -> DataFrame:
    """(doc_id, base, spans) for each row of (doc_id, text): arrays of kind, start and end in code points.

    Null and empty texts have none. Other columns are not looked at.
    """
    kind, shared = dict(docs.dtypes)["doc_id"], docs.sparkSession.sparkContext.broadcast(model)
    one = "array<struct<kind:string,start:int,end:int>>"

    def f(x: dict) -> dict:
        got = [spans_of(t, shared.value) for t in x["text"]]
        named = [[[{"kind": k, "start": a, "end": b} for k, a, b in part] for part in g] for g in got]
        return {"doc_id": x["doc_id"], "base": [g[0] for g in named], "spans": [g[1] for g in named]}

    return by_row(docs, ["doc_id", "text"], f"doc_id {kind}, base {one}, spans {one}", f)


def redacted(text: str | None, spans: list[Span]) -> str | None:
    """The text with ``[kind]`` for each span; spans that overlap are one, named by the first."""
    if text is None or not spans:
        return text
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{k}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: SemiMarkov) -> DataFrame:
    """``docs`` with personal data in ``text`` named instead of shown, and ``n_chars`` (if there) counted anew."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    order = docs.columns
    from_old = unused("clean_text_", order)
    out = with_text_verdict(docs, f"{from_old} string", lambda texts: {from_old: [redacted(t, spans_of(t, shared.value)[1]) for t in texts]})
    out = out.withColumn("text", F.col(from_old)).drop(from_old)
    if "n_chars" in order:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(dict(docs.dtypes)["n_chars"])))
    return out.select(*order)


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(listed(spans).encode()).hexdigest()
