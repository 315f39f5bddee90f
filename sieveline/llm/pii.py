"""Operator 3: personal data by candidate generators and gradient boosting.

Base patterns (email, ip, card, phone) are found exactly: leftmost
non-overlapping per kind, then checked (octets, Luhn, digit counts); failing
matches are dropped. Broad generators propose further, overlapping spans: keyed
secrets, long mixed tokens, digit groups and national trunk numbers, spelled-out
emails, IPv6 addresses, account numbers (IBAN), national identity numbers.
Boosted trees score each from its format, check digits and context; a kind's
threshold, the least at which examples that the trees have not seen reach
``PRECISION``, decides, and the best of overlapping spans stays. Base spans are
never dropped or shortened by that.

The trees are trained here, on seeded examples (``EXAMPLES`` of them, a quarter
kept for the thresholds). Both classes are drawn from the same formats: a digit
group may be a telephone or an order number, a hexadecimal string a key or a
digest, and the context tells them apart only where there is one, so no format
decides by itself and the thresholds differ from kind to kind. Nothing is learnt
from the corpus: a text's spans depend on it alone.

Defined cases: a null or empty text has no spans and the hash of nothing; no
cap on text length or spans; repeated rows get one row each; an empty table
gives an empty table; further columns are ignored by ``find`` and kept by ``redact``.
"""

from __future__ import annotations

import bisect
import hashlib
import ipaddress
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_text, docs_table, slices

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "iban", "national_id")
EXAMPLES, SEED, PRECISION = 12_000, 11, 0.95
TREES, DEPTH, RATE = 80, 4, 0.2

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Greedy digits never leave a match inside a run, so a match starts where a run does.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Each ``@`` decides at most one match: the run of local characters before it, as far as the last match leaves it."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            last = m.end()
            at = text.find("@", last)
        else:
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """By kind as listed, then start."""
    out = [("email", s, e) for s, e in emails(text)]
    ok = lambda p: len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(ok, m.group().split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _NOT_DIGIT.sub("", m.group())) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return out


_KEYED = re.compile(r"""(?i)(?<![A-Za-z0-9])(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|credential)s?["']?\s{0,3}[:=]\s{0,3}["']?([^\s"']{6,})""")
_KEYWORDS = ("token", "secret", "passw", "pwd", "key", "credential")
_LONG = re.compile(r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*+[0-9])[A-Za-z0-9_+/=-]{20,}")
_DIGITS = re.compile(r"(?<![0-9A-Za-z.+-])\(?[0-9]{2,4}\)?(?:[ .-][0-9]{2,4}){2,4}(?![0-9A-Za-z])")
_TRUNK = re.compile(r"(?<![0-9A-Za-z.+-])(?:\(0[0-9]{1,5}\) ?[0-9]{3,9}|0[0-9]{1,5}[ /-][0-9]{3,9}|00?[1-9][0-9]{7,12})(?![0-9A-Za-z])")
_SPELLED = re.compile(r"(?i)(?<![\w.])[a-z0-9._-]{2,64} ?[\[({] ?at ?[\])}] ?[a-z0-9-]{1,64}(?: ?(?:\.|[\[({] ?dot ?[\])}]) ?[a-z]{2,24}){1,4}")
_SAID = re.compile(r"(?i)(?<![\w.])[a-z0-9._-]{2,64} (?:at|arroba|chez) [a-z0-9-]{1,64}(?: (?:dot|punkt|punto|point) [a-z]{2,24}){1,4}(?!\w)")
_IPV6 = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ -]?[A-Z0-9]){11,30}")
_NATIONAL = re.compile(r"(?<![0-9A-Za-z.-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[12] ?[0-9]{2} ?[0-9]{2} ?[0-9]{2} ?[0-9]{3} ?[0-9]{3}(?: ?[0-9]{2})?|(?:[0-9]{8}|[XYZ]-?[0-9]{7})-?[A-Z])(?![0-9A-Za-z-])")
_IBAN_LENGTH = {"DE": 22, "GB": 22, "FR": 27, "ES": 24, "IT": 27, "NL": 18, "BE": 16, "AT": 20, "CH": 21, "PT": 25, "PL": 28, "SE": 24, "DK": 18, "NO": 15, "FI": 18, "IE": 22, "LU": 20}


def proposals(text: str) -> list[tuple[str, int, int]]:
    """Overlapping candidates of all generators; prefilters only skip texts where a generator can't match."""
    low = text.lower()
    out = []
    if any(k in low for k in _KEYWORDS):
        out += [("secret", *m.span(1)) for m in _KEYED.finditer(text)]
    out += [("secret", *m.span()) for m in _LONG.finditer(text)]
    out += [("phone", *m.span()) for m in _DIGITS.finditer(text)]
    out += [("phone", *m.span()) for m in _TRUNK.finditer(text)]
    if any(x in low for x in ("at)", "at]", "at}", "at )", "at ]", "at }")):
        out += [("email", *m.span()) for m in _SPELLED.finditer(text)]
    if any(x in low for x in (" dot ", " punkt ", " punto ", " point ")):
        out += [("email", *m.span()) for m in _SAID.finditer(text)]
    if text.count(":") > 1:
        out += [("ip", *m.span()) for m in _IPV6.finditer(text)]
    for m in _IBAN.finditer(text):
        out.append(("iban", m.start(), _iban_end(text, *m.span())))
    out += [("national_id", *m.span()) for m in _NATIONAL.finditer(text)]
    return out


def _iban_end(text: str, start: int, end: int) -> int:
    """Where the country's length ends, if it is known and reached: what follows in capitals isn't part of it."""
    left = _IBAN_LENGTH.get(text[start : start + 2], 99)
    for k in range(start, end):
        left -= text[k].isalnum()
        if not left:
            return k + 1
    return end


_CUES = {
    "secret": re.compile(r"(?i)token|secret|passw|pwd|key|credential|bearer|auth"),
    "phone": re.compile(r"(?i)phone|tel|call|mobile|fax|ruf|appel|llam|contact|handy"),
    "email": re.compile(r"(?i)mail|contact|write|schreib|écri|escrib"),
    "ip": re.compile(r"(?i)\bip|address|host|server|client|login|from"),
    "iban": re.compile(r"(?i)iban|account|konto|compte|cuenta|bank|transfer"),
    "national_id": re.compile(r"(?i)ssn|social|security|sozial|insee|sécu|\bdni|\bnie\b|nif|identity|ausweis|passport"),
}
_COUNTER_CUES = re.compile(r"(?i)(?:order|invoice|version|isbn|serial|part|model|page|art|commit|digest|sha\d*|md5|etag|build|rev|ref|mac|at|from|price|total|qty|\bno|\bnr|\bv)[.:# ]*$")
_TLD = re.compile(r"(?i)[.\W ](?:com|org|net|edu|gov|info|io|de|fr|es|it|uk|eu)$")
_DATE = re.compile(r"(?:19|20)\d\d[-./ ]|\d\d[-./ ]\d\d[-./ ](?:19|20)\d\d")


def _mod97(s: str) -> bool:
    c = re.sub(r"[ -]", "", s)
    return len(c) > 4 and c.isalnum() and c.isascii() and int("".join(str(int(x, 36)) for x in c[4:] + c[:4])) % 97 == 1


def _checked(kind: str, s: str) -> bool:
    """Whether check digits or the grammar of the kind hold."""
    if kind == "iban":
        return _mod97(s)
    if kind == "ip":
        try:
            return ipaddress.ip_address(s) is not None and any(c.isalnum() for c in s)
        except ValueError:
            return False
    if kind == "national_id":
        c = re.sub(r"[ -]", "", s)
        if c[-1:].isalpha():
            return "TRWAGMYFPDXBNJZSQVHLCKE"[int(c[:-1].replace("X", "0").replace("Y", "1").replace("Z", "2")) % 23] == c[-1]
        if len(c) == 9:
            return c[:3] not in ("000", "666") and c[0] != "9" and c[3:5] != "00" and c[5:] != "0000"
        return len(c) == 15 and 97 - int(c[:13]) % 97 == int(c[13:])
    return False


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format of the span and context of up to 24 characters on either side."""
    s, before, after = text[start:end], text[max(0, start - 24) : start], text[end : end + 24]
    n = len(s)
    digits = sum(c.isdigit() for c in s)
    letters = sum(c.isalpha() for c in s)
    counts: dict[str, int] = {}
    for c in s:
        counts[c] = counts.get(c, 0) + 1
    entropy = -sum(v / n * math.log2(v / n) for v in counts.values())
    groups = [g for g in _NOT_DIGIT.split(s) if g]
    flips = sum(a.isdigit() != b.isdigit() for a, b in zip(s, s[1:]))
    return [
        float(KINDS.index(kind)),
        n,
        digits / n,
        letters / n,
        entropy,
        flips / n,
        float(bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", s))),
        float(any(c.isupper() for c in s) and any(c.islower() for c in s)),
        float(digits),
        float(len(groups)),
        float(len(groups[0])) if groups else 0.0,
        float(len(groups[-1])) if groups else 0.0,
        float("(" in s),
        float(s.count("-")),
        float(s.count(".")),
        float(s.count("/")),
        float(s.count(" ")),
        float(s.count(":")),
        float(s[:1] == "0"),
        float(bool(_CUES[kind].search(before))) if kind in _CUES else 0.0,
        float(bool(re.search(r"[:=]\s*[\"']?$", before))),
        float(before[-1:] in ("$", "€", "£", "#")),
        float(after[:1] in ("%", "€", "$")),
        float(bool(_DATE.match(s))),
        float(bool(_COUNTER_CUES.search(before))),
        float(_checked(kind, s)),
        float(bool(_TLD.search(s))),
    ]


def _examples(seed: int, count: int) -> tuple[list[list[float]], list[int], list[str]]:
    """Features, class and kind of examples. Each kind draws a class, then a format that either class can have, then a context that fits, misleads or is missing."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("an", "er", "th", "sch", "ci", "en", "la", "ou", "ti", "on")) for _ in range(r.randint(1, 4)))
    pick = lambda s, n: "".join(r.choice(s) for _ in range(n))
    num = lambda n: pick("0123456789", n)
    upper, hexa = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
    alnum = upper + upper.lower() + "0123456789"

    def secret(good: bool) -> str:
        if good or r.random() < 0.35:
            size = r.choice((8, 10, 12, 16, 20, 24, 32, 40, 40, 48, 64))
            chunk = r.choice((size, size, size, 4, 8))  # some repeat themselves
            s = (pick(r.choice((hexa, hexa, hexa.upper(), alnum, alnum + "_-")), chunk) * 16)[:size]
            return s if any(c.isdigit() for c in s) else s[:-1] + "7"
        return r.choice(
            (
                lambda: "-".join(word() for _ in range(8)) + "-" + num(2),
                lambda: word() * 5 + num(1) + word() * 2,
                lambda: num(r.randint(20, 30)),
                lambda: "/".join(word() for _ in range(6)) + "/" + num(4),
                lambda: "=" * r.randint(10, 30) + num(1) + "=" * 10,
                lambda: f"{num(4)}-{num(2)}-{num(2)}-{word()}-{word()}-{word()}",
                lambda: r.choice(("1", "0")) * r.randint(20, 40),
                lambda: f"{pick(hexa, 8)}-{pick(hexa, 4)}-{pick(hexa, 4)}-{pick(hexa, 4)}-{pick(hexa, 12)}",
                lambda: r.choice((word() + word(), "required", "unknown", "optional", "see-below")),
            )
        )()

    def phone(good: bool) -> str:
        formats = [f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"{num(2)} {num(3)} {num(4)}", f"0{num(2)} {num(7)}", f"0{num(3)}/{num(6)}", f"0{num(9)}"]
        formats += [f"({num(3)}) {num(3)}-{num(4)}", f"0{num(1)} {num(2)} {num(2)} {num(2)} {num(2)}"] * 2 if good else [f"20{num(2)}-{num(2)}-{num(2)}", f"{num(2)}.{num(2)}.20{num(2)}", f"{num(3)} {num(3)} {num(3)}", f"{num(2)}.{num(2)}.{num(2)}.{num(2)}", f"{num(3)}-{num(2)}-{num(4)}"]
        return r.choice(formats)

    def email(good: bool) -> str:
        at, dot = r.choice((("[at]", "[dot]"), ("(at)", "."), ("at", "dot"), ("(at)", "(dot)"), ("arroba", "punto")))
        if not good:
            at, dot = r.choice((("(at)", "."), ("at", "dot"), ("chez", "point"), ("(at)", ".")))
        return f"{word()}{r.choice(('', num(2)))} {at} {word()} {dot} {r.choice(('com', 'org', 'net', 'de')) if good or r.random() < 0.05 else word()}".replace(" . ", r.choice((".", ". ")))

    def ip(good: bool) -> str:
        h = lambda: pick(hexa, r.randint(1, 4))
        if good:
            return r.choice((":".join(pick(hexa, 4) for _ in range(8)), f"2001:db8:{h()}::{h()}", f"fe80::{h()}:{h()}:{h()}:{h()}", f"{h()}::{h()}"))
        return r.choice((f"{num(2)}:{num(2)}:{num(2)}", ":".join(pick(hexa, 2) for _ in range(6)), "::", f"{num(1)}:{num(2)}:{num(2)}:{num(3)}", f"{h()}::{h()}"))

    def iban(good: bool) -> str:
        land = r.choice(list(_IBAN_LENGTH))
        body = num(_IBAN_LENGTH[land] - 4)
        check = 98 - int("".join(str(int(c, 36)) for c in body + land + "00")) % 97
        if not good and r.random() < 0.9:
            land, check = r.choice((land, pick(upper, 2))), int(num(2))
            body = r.choice((body, pick(upper + "0123456789", r.randint(11, 20))))
        s = f"{land}{check:02d}{body}"
        return s if r.random() < 0.5 else " ".join(s[k : k + 4] for k in range(0, len(s), 4))

    def national_id(good: bool) -> str:
        kind = r.random()
        if kind < 0.5:
            return f"{num(3)}-{num(2)}-{num(4)}"
        if kind < 0.8:
            n = num(8)
            return n + r.choice(("", "-")) + ("TRWAGMYFPDXBNJZSQVHLCKE"[int(n) % 23] if good else r.choice(upper))
        n = r.choice("12") + num(12)
        s = n + (f"{97 - int(n) % 97:02d}" if good else num(2))
        return s if r.random() < 0.5 else f"{s[0]} {s[1:3]} {s[3:5]} {s[5:7]} {s[7:10]} {s[10:13]} {s[13:]}"

    #: generator, share of true ones, contexts that speak for it
    kinds = {
        "secret": (secret, 0.5, ('token = "', "secret: ", "api_key=", "password = '", "Bearer ", "access-key: ")),
        "phone": (phone, 0.4, ("Tel: ", "phone ", "call ", "Mobile: ", "fax: ")),
        "email": (email, 0.6, ("mail: ", "write to ", "contact ")),
        "ip": (ip, 0.5, ("IP ", "host ", "client address ", "login from ")),
        "iban": (iban, 0.6, ("IBAN ", "account ", "Konto ", "transfer to ")),
        "national_id": (national_id, 0.5, ("SSN ", "social security ", "DNI ", "INSEE ", "identity no ")),
    }
    against = ("order ", "invoice ", "$", "No. ", "version ", "isbn ", "part ", "serial ", "commit ", "sha1: ", "ref ")
    x, y, out = [], [], []
    for _ in range(count):
        kind = r.choice(list(kinds))
        make, share, cues = kinds[kind]
        good = r.random() < share
        said = r.random()
        # Six in ten contexts tell the truth, a few mislead, the others say nothing.
        pre = r.choice(cues) if said < (0.6 if good else 0.04) else r.choice(against) if said < (0.62 if good else 0.64) else ""
        left = " ".join(word() for _ in range(r.randint(0, 5))) + " " + pre
        s = make(good)
        text = left + s + r.choice((" ", ". ", '" ', ", ")) + word()
        x.append(features(text, kind, len(left), len(left) + len(s)))
        y.append(int(good))
        out.append(kind)
    return x, y, out


class Boosted:
    """Logistic gradient boosting of small regression trees over quantile cuts."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.03, 0.97, 24))) for f in range(x.shape[1])]
        p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.start, self.trees = math.log(p / (1 - p)), []
        score = np.full(len(y), self.start)
        for _ in range(TREES):
            q = 1 / (1 + np.exp(-score))
            tree = self._grow(x, y - q, q * (1 - q), np.arange(len(y)), DEPTH)
            self.trees.append(tree)
            score += RATE * self._apply(tree, x)

    def _grow(self, x, g, h, rows, depth):
        total, weight = g[rows].sum(), h[rows].sum()
        leaf = float(total / (weight + 1.0))
        if depth == 0 or len(rows) < 20:
            return leaf
        best = (1e-6, 0, 0.0)
        for f, cuts in enumerate(self.cuts):
            b = np.searchsorted(cuts, x[rows, f], side="left")
            gs, hs = (np.cumsum(np.bincount(b, v[rows], len(cuts) + 1))[:-1] for v in (g, h))
            gain = gs**2 / (hs + 1) + (total - gs) ** 2 / (weight - hs + 1) - total**2 / (weight + 1)
            if len(gain) and gain.max() > best[0]:
                k = int(gain.argmax())
                best = (float(gain[k]), f, float(cuts[k]))
        if best[0] <= 1e-6:
            return leaf
        left = x[rows, best[1]] <= best[2]
        if left.all() or not left.any():
            return leaf
        return (best[1], best[2], self._grow(x, g, h, rows[left], depth - 1), self._grow(x, g, h, rows[~left], depth - 1))

    def _apply(self, tree, x):
        if isinstance(tree, float):
            return np.full(len(x), tree)
        left = x[:, tree[0]] <= tree[1]
        return np.where(left, self._apply(tree[2], x), self._apply(tree[3], x))

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for tree in self.trees:
            total += RATE * self._apply(tree, x)
        return 1 / (1 + np.exp(-total))

    def score(self, row: list[float]) -> float:
        total = self.start
        for t in self.trees:
            while not isinstance(t, float):
                t = t[2] if row[t[0]] <= t[1] else t[3]
            total += RATE * t
        return 1 / (1 + math.exp(-total))


def calibrated(p: np.ndarray, y: np.ndarray, kinds: list[str]) -> dict[str, float]:
    """A kind's lowest threshold at which unseen examples reach ``PRECISION``, half-way to the next score below; none reaches it: no span.

    It doesn't go below where most of the next 20 examples are false, however good those above are.
    """
    out = {}
    for kind in KINDS:
        at = np.flatnonzero(np.array(kinds) == kind)
        out[kind] = 2.0
        order = at[np.argsort(-p[at], kind="stable")]
        reached = np.cumsum(y[order]) / np.arange(1, len(order) + 1) >= PRECISION
        true = np.concatenate([[0], np.cumsum(y[order])])
        worse = np.flatnonzero(true[20:] - true[:-20] < 10) if len(order) >= 20 else ()
        good = np.flatnonzero(reached[: worse[0]] if len(worse) else reached)
        if len(good):
            last = int(good[-1])
            out[kind] = float(p[order[last : last + 2]].mean())
    return out


@lru_cache(maxsize=1)
def model() -> tuple[Boosted, dict[str, float]]:
    """Trained once a process from the seed: the same everywhere."""
    x, y, kinds = _examples(SEED, EXAMPLES)
    x, y, cut = np.array(x), np.array(y, float), EXAMPLES * 3 // 4
    fit = Boosted(x[:cut], y[:cut])
    return fit, calibrated(fit.scores(x[cut:]), y[cut:], kinds[cut:])


def measured(seed: int = SEED + 1, count: int = EXAMPLES) -> dict[str, tuple[float, float]]:
    """Precision and sensitivity of each kind on fresh examples."""
    fit, thresholds = model()
    x, y, kinds = _examples(seed, count)
    p, y, kind_of, out = fit.scores(np.array(x)), np.array(y, bool), np.array(kinds), {}
    for kind in dict.fromkeys(kinds):
        found, true = p[kind_of == kind] >= thresholds[kind], y[kind_of == kind]
        out[kind] = float((found & true).sum() / max(1, found.sum())), float((found & true).sum() / true.sum())
    return out


def spans(text: str | None, fit: Boosted, thresholds: dict[str, float]) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), each by kind as listed, then start."""
    text = text or ""
    base = base_spans(text)
    cand = proposals(text)
    if not cand:
        return base, base
    scored = []
    for kind, s, e in dict.fromkeys(cand):
        p = fit.score(features(text, kind, s, e))
        if p >= thresholds[kind]:
            scored.append((-p, s, e, kind))
    taken: list[list[int]] = []  # disjoint, by start: base spans merged, then what was accepted
    for s, e in sorted((s, e) for _, s, e in base):
        if taken and s < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], e)
        else:
            taken.append([s, e])
    extra = []
    for _, s, e, kind in sorted(scored):
        k = bisect.bisect_left(taken, [e])
        if k and taken[k - 1][1] > s:
            continue
        taken.insert(k, [s, e])
        extra.append((kind, s, e))
    rank = {k: i for i, k in enumerate(KINDS)}
    return base, sorted(base + extra, key=lambda x: (rank[x[0]], x[1], x[2]))


def _join(found) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added), one row per document."""
    shared = docs.sparkSession.sparkContext.broadcast(model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, thresholds = shared.value
        for b in slices(batches):
            rows = []
            for t in b.column(1):
                base, full = spans(t.as_py(), fit, thresholds)
                rows.append((*(sum(x[0] == k for x in base) for k in BASE), hashlib.sha256(_join(base).encode()).hexdigest(), _join(full), len(full) - len(base)))
            cols = list(zip(*rows)) if rows else [()] * 7
            types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(cols, types)]], ["doc_id", *[f"n_{k}" for k in BASE], "base_sha256", "spans", "n_added"])

    return doc_text(docs).mapInArrow(run, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint")


def masked(text: str | None, found: list[tuple[str, int, int]]) -> str | None:
    """The text with each span, overlapping ones merged, replaced by its kind in brackets."""
    if not found or text is None:
        return text
    out, at = [], 0
    for kind, s, e in sorted(found, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """The same rows and columns with personal data in ``text`` replaced; an ``n_chars`` column follows the new text."""
    shared = docs.sparkSession.sparkContext.broadcast(model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, thresholds = shared.value
        for b in slices(batches):
            k = b.schema.get_field_index("text")
            texts = [masked(t, spans(t, fit, thresholds)[1]) for t in b.column(k).to_pylist()]
            cols = list(b.columns)
            cols[k] = pa.array(texts, b.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def query(spark, sf_dir):
    return find(docs_table(spark, sf_dir))
