"""Personal data: exact base patterns, plus candidates that boosted trees accept.

The base finds e-mail addresses, IPv4 addresses, payment cards and international phone numbers by fixed patterns and checks; its
spans always stay. Generators of high recall then propose further, overlapping spans: phone numbers without a
plus sign, addresses with a written "at", cards with other separators, IPv6 and defanged IPv4 addresses, and values of secrets (a kind of its own).
Each candidate becomes a row of format features (digits, groups, separators, check digits, shapes of dates, IBANs and versions, valid
addresses) and context features (neighbouring characters, cue words before it). Gradient-boosted trees, trained here on invented examples
with a fixed seed, give a score. The examples are written by forms of their own (notations of several countries, and numbers that are nobody's), not by
the generators' patterns; what a generator proposes in them is right where it is the planted span.

On examples of another seed the scores are calibrated by kind: a monotone fit of how often a score is right (pooled adjacent
violators). The threshold of a kind is the lowest score at which the accepted candidates' calibrated probabilities still average ``PRECISION``. Of
accepted candidates that overlap each other the one with the higher score stays; those that touch a base span are left out.

Offsets are code points, the end is exclusive. Defined cases: a null text is empty and has no spans; texts without digits, "@", a
written "at" or a word for secrets are left at once; rows are independent, so ties and repeated rows don't matter; an empty table gives an empty result;
columns beyond the key and the text are ignored, so their names can't clash.
"""

from __future__ import annotations

import random
import re
from bisect import bisect, bisect_left
from collections.abc import Iterator
from functools import lru_cache
from ipaddress import ip_address

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phylospark.llm._shared import slices, small_batches

KINDS = ("email", "ip", "card", "phone")
ALL = (*KINDS, "secret")
RANK = {k: i for i, k in enumerate(ALL)}
PRECISION, SEED = 0.97, 20240229

# The base patterns.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # no start inside a run of digits: the same matches in linear time
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"

DIGIT = re.compile("[0-9]")
BRACKETED_AT = re.compile(r"[\[({](?:at|AT|@)[\])}]")
SPACED_AT = re.compile(r"\x20(?:at|AT|@)\x20[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]|\x20(?:dot|DOT)\x20)")
SECRET_WORDS = ("token", "secret", "passw", "pwd", "key", "bearer")

#: What a text must hold for a generator to be tried.
has_digit, bracketed, spaced = DIGIT.search, BRACKETED_AT.search, SPACED_AT.search


def colons(text: str) -> bool:
    return text.count(":") > 1


def defanged(text: str) -> bool:
    return "[.]" in text or "(.)" in text or "dot]" in text or "dot)" in text


def names_secret(text: str) -> bool:
    low = text.lower()
    return any(w in low for w in SECRET_WORDS)


#: Generators of candidates: kind, pattern (a group named x is the span, else the whole match is), and what a text must hold for it to be
#: tried. They propose far more than is right.
WAYS = (
    ("phone", re.compile(r"(?<![0-9A-Za-z+])(?:\([0-9]{1,5}\)|[0-9]{1,5})(?:[\x20./-]{1,3}\(?[0-9]{2,9}\)?){1,5}(?![0-9A-Za-z])"), has_digit),
    ("phone", re.compile(r"(?<![0-9A-Za-z+])(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20./-])[0-9]{2,4}(?:[\x20./-][0-9]{2,4}){1,3}(?![0-9A-Za-z])"), has_digit),
    ("phone", re.compile(r"(?<![0-9A-Za-z.+])[0-9]{9,14}(?![0-9A-Za-z])"), has_digit),
    ("card", re.compile(r"(?<![0-9A-Za-z])[0-9]{4}(?:[\x20._/-]{1,2}[0-9]{4}){2,3}(?:[\x20._/-]{1,2}[0-9]{1,4})?(?![0-9A-Za-z])"), has_digit),
    ("card", re.compile(r"(?<![0-9A-Za-z])[0-9]{4}[\x20._/-]{1,2}[0-9]{6}[\x20._/-]{1,2}[0-9]{5}(?![0-9A-Za-z])"), has_digit),
    ("card", re.compile(r"(?<![0-9A-Za-z])[0-9]{13,19}(?![0-9A-Za-z])"), has_digit),
    ("ip", re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])"), colons),
    ("ip", re.compile(r"(?<![0-9A-Za-z])[0-9]{1,3}(?:\x20?(?:\[\.\]|\(\.\)|[\[(]dot[\])])\x20?[0-9]{1,3}){3}(?![0-9A-Za-z])"), defanged),
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+\x20?[\[({](?:at|AT|@)[\])}]\x20?[A-Za-z0-9-]+(?:(?:\.|\x20?[\[({](?:dot|DOT|\.)[\])}]\x20?)[A-Za-z0-9-]+)+"), bracketed),
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+\x20(?:at|AT|@)\x20[A-Za-z0-9-]+(?:(?:\.|\x20(?:dot|DOT)\x20)[A-Za-z0-9-]+)+"), spaced),
    ("secret", re.compile(r"(?i)(?:token|secret|passw(?:or)?d|pwd|key|bearer)[\w-]{0,16}[\x20\t]?[=:\x20][\x20\t]?[\"']?(?P<x>[^\s\"',;]{6,200})"), names_secret),
    ("secret", re.compile(r"(?<![0-9A-Za-z])(?P<x>[0-9A-Fa-f]{32,64}|[A-Za-z]{2,5}[_-][0-9A-Za-z]{20,80})(?![0-9A-Za-z])"), has_digit),
)
NEEDS = {needs for *_, needs in WAYS}
CUES = {
    "email": re.compile(r"mail|contact|correo|write to", re.I),
    "ip": re.compile(r"\bip\b|host|server|adresse? ip|login from", re.I),
    "card": re.compile(r"card|visa|karte|carte|tarjeta|iban|paid", re.I),
    "phone": re.compile(r"\btel|phone|call|fax|mobil|anruf|appel|llam|dial|ring", re.I),
    "secret": re.compile(r"(token|secret|passw(or)?d|pwd|key|bearer)[\w-]{0,16}\s*[=:]?\s*[\"']?$", re.I),
}
AGAINST = re.compile(r"version|\bv\b|isbn|order|page|date|room|chapter|\bid\b|figure|section|serial|iban|account|years?|about|between|score|batch|reference|invoice|tracking", re.I)
IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}\x20?(?:[0-9A-Z]{4}\x20?)*$")
SEPARATED = re.compile(r"[^0-9]+")
DATE = re.compile(r"(?:(?:19|20)[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)?[0-9]{2})")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def small(part: str) -> bool:
    """At most 255, however many zeros lead."""
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[Span]:
    """Each "@" in turn: its local part reaches back to the last match or other character, its domain must follow."""
    done, last, at = 0, 0, text.find("@")
    while at >= 0:
        floor = max(done, last)
        start = floor + len(text[floor:at].rstrip(LOCAL))
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end(), "email"
            done = m.end()
        last = at + 1
        at = text.find("@", max(done, last))


def base_spans(text: str) -> list[Span]:
    """Spans by the fixed patterns, by start and then kind."""
    found = list(emails(text)) if "@" in text else []
    if DIGIT.search(text):
        found += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(map(small, m[0].split(".")))]
        found += [(m.start(), m.end(), "card") for m in CARD.finditer(text) if 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            found += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]
    return sorted(found, key=lambda x: (x[0], RANK[x[2]], x[1]))


def candidates(text: str) -> list[Span]:
    """Proposed spans; they may overlap."""
    found, held = set(), {needs: needs(text) for needs in NEEDS}
    for kind, pattern, needs in WAYS:
        if not held[needs]:
            continue
        part = "x" if "x" in pattern.groupindex else 0
        for m in pattern.finditer(text):
            a, b = m.span(part)
            if kind != "phone" or 7 <= len(digits_of(text[a:b])) <= 15:
                found.add((a, b, kind))
    return sorted(found)


def is_address(text: str) -> bool:
    try:
        return bool(ip_address(text))
    except ValueError:
        return False


def entropy(text: str) -> float:
    """Bits a character by the text's own counts."""
    share = np.unique(list(text), return_counts=True)[1] / max(1, len(text))
    return float(-(share * np.log2(share)).sum())


def features(text: str, span: Span) -> list[float]:
    a, b, kind = span
    s, d = text[a:b], digits_of(text[a:b])
    groups = [len(g) for g in re.findall("[0-9]+", s)] or [0]
    before, after = text[max(0, a - 40) : a], text[b : b + 12]
    left, right = text[a - 1 : a] if a else "", text[b : b + 1]
    letters = sum(c.isalpha() for c in s)
    marks = SEPARATED.findall(s)
    last = re.split(r"[^A-Za-z0-9-]+", s)[-1] if kind == "email" else ""
    return [
        *(float(kind == k) for k in ALL), len(s), len(d), len(groups), max(groups), min(groups), groups[0], groups[-1], letters, float(luhn(d) if d else 0), float(s[:1] == "("), float("@" in s or "[" in s or "{" in s or "(" in s),
        s.count("-"), s.count("."), s.count(" "), s.count(":"), s.count("/"), len(set(marks)), max(map(len, marks), default=0), float(bool(DATE.fullmatch(s))), float(bool(DATE.match(s))), len(set(d)), float(d[:2] in ("19", "20")), float(d[:2] == "00"),
        float(d[:1] == "0"), float(d[:1] in "3456" and bool(d)), float(is_address(s)) if kind == "ip" else 0.0, float("::" in s), float(" dot " in s.lower()), len(last), float(last.islower() and last.isalpha()), entropy(s) if kind == "secret" else 0.0,
        float(bool(CUES[kind].search(before))), float(bool(AGAINST.search(before))), float(bool(IBAN.search(before))), float(left in ("", " ", "\n", "(", ":", '"')), float(right in ("", " ", "\n", ",", ".", ")", ";", '"', "!", "?")), float(left in tuple("$€#=.")), float(right in tuple("%€$=")),
        float(bool(re.match(r"[.,:][0-9]", after))), float(bool(re.search(r"[0-9][\x20./-]{1,2}$", before))), float(bool(re.match(r"[\x20./-]{1,2}[0-9]", after))),
    ]


class Trees:
    """Gradient-boosted regression trees of logistic loss; every split tests one feature against a cut of its values."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.25, ridge: float = 1.0):
        self.rate, self.trees = rate, []
        self.start = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 34)[1:-1])) for c in x.T]
        margin = np.full(len(y), self.start)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-margin))
            tree = self.grow(x, p - y, p * (1 - p), np.arange(len(y)), cuts, depth, ridge)
            self.trees.append(tree)
            margin += rate * self.values(tree, x)

    def grow(self, x, g, h, rows, cuts, depth, ridge):
        """A leaf's value, or (feature, cut, tree at or below the cut, tree above it)."""
        total_g, total_h = g[rows].sum(), h[rows].sum()
        leaf = -total_g / (total_h + ridge)
        best = (1e-6, None, None)
        for f, values in enumerate(cuts) if depth and len(rows) > 8 else ():
            above = np.searchsorted(values, x[rows, f])  # cuts below the value
            sum_g = np.cumsum(np.bincount(above, g[rows], len(values) + 1))[:-1]
            sum_h = np.cumsum(np.bincount(above, h[rows], len(values) + 1))[:-1]
            if len(values):
                gain = sum_g**2 / (sum_h + ridge) + (total_g - sum_g) ** 2 / (total_h - sum_h + ridge) - total_g**2 / (total_h + ridge)
                if gain.max() > best[0]:
                    best = (gain.max(), f, float(values[gain.argmax()]))
        if best[1] is None:
            return leaf
        low = x[rows, best[1]] <= best[2]
        if low.all() or not low.any():
            return leaf
        return best[1], best[2], self.grow(x, g, h, rows[low], cuts, depth - 1, ridge), self.grow(x, g, h, rows[~low], cuts, depth - 1, ridge)

    def values(self, tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        f, cut, low, high = tree
        return np.where(x[:, f] <= cut, self.values(low, x), self.values(high, x))

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.start)
        for tree in self.trees:
            margin += self.rate * self.values(tree, x)
        return 1 / (1 + np.exp(-margin))


#: Forms of examples: # is a digit, @ one of 1 to 9, w a word, h one to four hexadecimal digits, x one of them, k a letter or digit; others stand for
#: themselves. A form may have a cue of its own after a bar; none means any of the kind's. What is beside a ^ isn't personal.
PERSONAL = {
    "phone": (
        "(@##) @##-####", "(@##) @## ####", "(@##)@##-####", "@##-@##-####", "@##.@##.####", "@## @## ####", "0@# #######", "0@## #######", "0@## ########", "0@##/#######", "0@#/#######", "0@##-#######", "0@## ### ## ##", "0@ ## ## ## ##", "0@.##.##.##.##",
        "0@# #### ####", "0@### ######", "(0@#) #######", "(0@##) ### ####", "0049 ## #######", "00## # ## ## ## ##", "00## ### ### ###", "9## ### ###|tel.", "9## ## ## ##|call", "6## ### ###|mobile", "0@########", "0@#########", "@#########|phone", "@###########|call", "0@## ## ## ## #", "@##-####|call",
    ),
    "email": ("w.## [at] w.com", "w(at)w(dot)org", "w_w (at) w.net", "w{at}w.de", "w at w dot com", "w.w at w dot co dot uk", "w## AT w DOT org", "w @ w.com", "w at w.com|mail", "w at w.net|contact", "w [at] w [dot] edu"),
    "ip": ("h:h:h:h:h:h:h:h", "2001:db8::h", "fe80::h:h:h:h", "2001:h:h::h", "h:h:h:h::h", "::1|host", "fd##:h::h:h", "@#[.]@##[.]@[.]@#", "@##[.]@#[.]@##[.]@", "@#(.)@##(.)#(.)@#", "@# [dot] @## [dot] @ [dot] @#"),
    "card": ("C.C.C.C", "C_C_C_C", "C/C/C/C", "C  C  C  C", "CCCC CCCC", "C--C--C--C", "M ^CCCC CCCC", "CCCC CCCC^ M"),
    "secret": ('"' + "x" * 40 + '"|token =', "x" * 32 + "|api_key:", "kkkkkkkkkk##kk|password =", "kkkk##kkkkkk|password:", "kk_" + "k" * 32 + "|", "k" * 24 + "|secret=", "k" * 40 + "|bearer", '"' + "x" * 64 + '"|token ='),
}
NOBODYS = (
    "20##-0@-1#", "1#.0@.20##", "20##/0@/1#", "@/1#/20##", "978-#-###-#####-#|isbn", "97########### |isbn", "##-##-####", "##########|order", "#########|id", "############# |serial", "###############", "1#:2#:3#", "1#:2#:3#:##", "0@:1#:2#", "@# ### ###", "@ ### ###",
    "@## ### ###|about", "@ ### ### ###|about", "##.###.###", "#### #### ####|reference", "###/###/###|batch", "## ## ## ##|score", "@@ - @@", "19## - 20##|between", "1998 1999 2000", "@####-####|code", "xx:xx:xx:xx:xx:xx", "xx-xx-xx-xx-xx-xx", "B#### #### #### #### ##|IBAN", "B## #### #### #### ####|iban",
    "N.N.N.N", "N-N-N-N", "N N N N", "M", "M M", "@.##.#|version", "@#.@.##.####|version", "###-###|pages", "look at w.com", "live at w.de", "talk at w dot w", "meet at w", "16:9:4", "w::w", "###.## ###.##", "# ## ### ####", "## ## ##", "@### @###|years", "w-w-w-w-w|key", "wwww|token", "wwwwww|password", "key to the w", "a key wwwww", "@## ##-##|room",
    "#-####-####-#|isbn", "@#### @####|about", "@#.### @#.###|between", "@###-@##-@#|invoice", "###########|tracking",
)
CUED = {"email": ("mail", "contact", "write to", ""), "ip": ("host", "IP", "from", ""), "card": ("card", "visa", "paid with", ""), "phone": ("tel.", "call", "phone:", "fax", "", ""), "secret": ("",)}
UNCUED = ("version", "order", "page", "id", "serial", "date", "", "", "", "")


def generated(seed: int, n: int) -> list[tuple[str, Span, int]]:
    """Examples (text, candidate span, 1 if personal) from the forms above, among invented words."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("ba", "ter", "on", "li", "ver", "ing", "mo", "que", "sch", "do", "an", "el")) for _ in range(r.randint(1, 4)))

    def number(size: int, valid: bool) -> str:
        body = r.choice("3456") + "".join(r.choice("0123456789") for _ in range(size - 2))
        check = next(c for c in "0123456789" if luhn(body + c))
        return body + (check if valid else str((int(check) + r.randint(1, 9)) % 10))

    def fill(form: str) -> str:
        cards = iter((c := number(16, True)) and [c[i : i + 4] for i in (0, 4, 8, 12)] * 2)
        other = iter((o := number(16, False)) and [o[i : i + 4] for i in (0, 4, 8, 12)])
        one = {
            "#": lambda: r.choice("0123456789"), "@": lambda: r.choice("123456789"), "w": word, "h": lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.randint(1, 4))), "x": lambda: r.choice("0123456789abcdef"),
            "k": lambda: r.choice("abcdefghijkmnopqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ0123456789"), "C": lambda: next(cards), "N": lambda: next(other), "M": lambda: number(r.choice((13, 14, 15, 16, 16, 16, 18)), False), "B": lambda: r.choice(("DE", "FR", "ES", "GB", "NL")),
        }
        plain = re.compile(r"(CCCC CCCC|2001|db8|fe80|fd|com|org|net|de|uk|co|edu|at|dot|AT|DOT|look|live|talk|meet|key to the|a key)")
        parts = plain.split(form)
        return "".join(number(16, True) if p == "CCCC CCCC" else p if i % 2 else "".join(one[c]() if c in one else c for c in p) for i, p in enumerate(parts))

    out = []
    while len(out) < n:
        personal = r.random() < 0.5
        kind = r.choice(ALL) if personal else ""
        form, _, cue = r.choice(PERSONAL[kind] if personal else NOBODYS).partition("|")
        cue = cue or r.choice(CUED[kind] if personal else UNCUED)
        head, _, tail = form.rpartition("^") if form.startswith("M") else ("", "", form)
        whole, _, behind = tail.partition("^")
        whole, head, behind = fill(whole), fill(head), fill(behind)
        made = head + whole + behind
        lead = " ".join(word() for _ in range(r.randint(0, 6)))
        start = " ".join(x for x in (lead, cue) if x)
        start += " " if start else ""
        whole = whole.strip('"')
        at = len(start) + made.index(whole, len(head))
        text = start + made + r.choice(["", ".", ",", " ", "!"]) + " " + " ".join(word() for _ in range(r.randint(0, 3)))
        out += [(text, c, int(personal and c == (at, at + len(whole), kind))) for c in candidates(text)]
    return out[:n]


def calibrated(scores: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores in falling order, and for each how often candidates like it are right: the monotone fit by pooled adjacent violators."""
    order = np.argsort(-scores, kind="stable")
    pools: list[list[float]] = []  # sum, number
    for y in right[order]:
        pools.append([float(y), 1.0])
        while len(pools) > 1 and pools[-1][0] * pools[-2][1] > pools[-2][0] * pools[-1][1]:
            total, count = pools.pop()
            pools[-1][0] += total
            pools[-1][1] += count
    return scores[order], np.concatenate([np.full(int(n), t / n) for t, n in pools]) if pools else np.empty(0)


@lru_cache(maxsize=2)
def model(seed: int = SEED, n: int = 8000) -> tuple[Trees, dict[str, float]]:
    """Trees fitted on generated examples, and the threshold of each kind from examples of another seed."""
    train, held = generated(seed, n), generated(seed + 1, n)
    trees = Trees(np.array([features(t, c) for t, c, _ in train], float), np.array([y for *_, y in train], float))
    p, y = trees.score(np.array([features(t, c) for t, c, _ in held], float)), np.array([y for *_, y in held])
    kinds = np.array([c[2] for _, c, _ in held])
    cut = {}
    for kind in ALL:
        scores, chance = calibrated(p[kinds == kind], y[kinds == kind])
        good = np.flatnonzero(np.cumsum(chance) >= PRECISION * np.arange(1, len(chance) + 1))
        good = good[chance[good] >= 0.5]
        cut[kind] = float(scores[good[-1]]) if len(good) else 2.0
    return trees, cut


def added_spans(text: str, base: list[Span], trees: Trees, cut: dict[str, float]) -> list[Span]:
    """Accepted candidates that touch neither a base span nor a better one."""
    return all_added([text], [base], trees, cut)[0]


def all_added(texts: list[str], bases: list[list[Span]], trees: Trees, cut: dict[str, float]) -> list[list[Span]]:
    """The same for many texts; the candidates of all are scored at once."""
    found = [free_of(base, candidates(text)) for text, base in zip(texts, bases, strict=True)]
    rows = [features(text, c) for text, own in zip(texts, found, strict=True) for c in own]
    scores = iter(trees.score(np.array(rows, float)).tolist() if rows else ())
    out = []
    for own in found:
        taken: list[Span] = []
        for _, c in sorted(((-p, c) for c in own if (p := next(scores)) >= cut[c[2]]), key=lambda x: (x[0], x[1])):
            i = bisect(taken, c)
            if (i == 0 or taken[i - 1][1] <= c[0]) and (i == len(taken) or c[1] <= taken[i][0]):
                taken.insert(i, c)
        out.append(taken)
    return out


def free_of(base: list[Span], found: list[Span]) -> list[Span]:
    """Candidates that touch no base span."""
    if not base:
        return found
    starts, reach = [a for a, *_ in base], np.maximum.accumulate([b for _, b, _ in base])
    return [c for c in found if (i := bisect_left(starts, c[1])) == 0 or reach[i - 1] <= c[0]]


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda x: (x[0], RANK[x[2]], x[1])))


def find_personal(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, base, spans): lists of (start, end, kind); spans holds base and what the trees add."""
    rows = small_batches(df).select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    trees, cut = model()
    one = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])
    as_rows = lambda spans: [{"start": a, "end": b, "kind": k} for a, b, k in spans]

    def find(batches):
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            own = [base_spans(t) for t in texts]
            base = [as_rows(x) for x in own]
            spans = [as_rows(sorted([*x, *more], key=lambda x: (x[0], RANK[x[2]], x[1]))) for x, more in zip(own, all_added(texts, own, trees, cut), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(base, pa.list_(one)), pa.array(spans, pa.list_(one))], ["key", "base", "spans"])

    kind, spans = rows.schema["key"].dataType.simpleString(), "array<struct<start: bigint, end: bigint, kind: string>>"
    return rows.mapInArrow(find, f"key {kind}, base {spans}, spans {spans}").withColumnRenamed("key", key)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    out, done = [], 0
    for a, b, kind in sorted(spans):
        if a >= done:
            out += [text[done:a], f"[{kind}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def op8_pii(spark, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document; beyond them those of secrets, and the number of all."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = find_personal(docs, "doc_id", "text")
    named = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda secret: F.filter("spans", lambda s: (s["kind"] == "secret") == F.lit(secret))
    counted = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = named(F.col("base"))
    return found.select("doc_id", *map(counted, KINDS), F.sha2(base, 256).alias("base_sha256"), named(of(False)).alias("spans"), named(of(True)).alias("secrets"), F.size("spans").cast("long").alias("n_spans"))
