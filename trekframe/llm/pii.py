"""Personal data by candidate gradient boosting.

High-recall generators propose spans, which may overlap: what the base rules
match, and e-mail addresses spelled out, phone numbers without a plus sign,
account numbers (IBAN), social security numbers, IPv6 addresses, postal
addresses, card numbers that fail the checksum or stand in other groups, and
secrets (keys, tokens and passwords: what is assigned to such a name, long runs
of random letters and digits, and forms that start with a known mark). The base
rules' matches always stay. The other candidates get features of their format
(length, digits, groups, separators, checksums, entropy) and of their context
(what stands beside them, telling words before), boosted regression trees give a
score, and the score's threshold for each kind is calibrated on held-out
examples: the lowest score from which the share of personal data, counted with
one miss more than was seen, is at least ``PRECISION``, halfway to the next lower
one (but no lower than ``LEAST``). Accepted candidates are taken by score, without overlaps among each
other; one that overlaps a base match stays only if it holds the whole match.

No table labels personal data, so the trees are fitted to examples generated
here (``EXAMPLES`` of them, seeded: reruns agree): positives and look-alikes
(dates, versions, order numbers, prices, times, hashes, identifiers) in neutral
and telling contexts. The fit takes place once, on the driver, and is a few
kilobytes.

Whole texts are scanned in the map task that reads them, nothing is shuffled.

Defined cases: null text counts as empty and has no spans; very long texts are
scanned whole, in linear time; repeated rows get equal results; an empty table
gives an empty result; extra columns are unread.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trekframe.llm.common import map_arrow

BASE = ("email", "ip", "card", "phone")
ADDED = ("email_words", "iban", "ipv6", "phone_local", "ssn", "secret", "street", "card_like")
EXAMPLES, ROUNDS, DEPTH, RATE = 9_000, 40, 5, 0.3
PRECISION, LEAST = 0.98, 0.2

# ---- base rules

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match that starts inside a run of digits would also start at the run's beginning.
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _emails(text: str):
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def _ips(text: str):
    for m in _IP.finditer(text):
        parts = m[0].split(".")
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts):
            yield m.span()


def _cards(text: str):
    for m in _CARD.finditer(text):
        if 13 <= len(m[0]) and len(digits := m[0].replace(" ", "").replace("-", "")) in range(13, 20) and luhn(digits):
            yield m.span()


def _phones(text: str):
    for m in _PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, kinds in the order of BASE, then by start."""
    return [(kind, a, b) for kind, f in zip(BASE, (_emails, _ips, _cards, _phones)) for a, b in f(text)]


# ---- candidates of the other kinds

# A generator is a kind, its pattern, a cheap test that every match passes, and words of which texts with a match hold one.
# Secrets have no greatest length: their patterns start where the test matches, and possessive runs keep them linear.
_NAMES = "token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?key|auth(?:orization)?|bearer|credential"
_MARKS = re.compile(r"(?:AKIA|ASIA|gh[pousr]_|sk[-_]|pk[-_]|xox[abp]-|eyJ|AIza|glpat-)")
_GENERATORS = (
    ("iban", re.compile(r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,4})?\b"), re.compile(r"\b[A-Z]{2}[0-9]{2}[\x20A-Z0-9]")),
    ("ipv6", re.compile(r"(?<![\w:])(?=[0-9A-Fa-f:]{2,39}(?![\w:]))(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])"), re.compile(r"[0-9A-Fa-f]{0,4}:[0-9A-Fa-f]{0,4}:")),
    ("phone_local", re.compile(r"(?<![\w+])(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20./-])[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?!\w)"), re.compile(r"[0-9][)\x20./-]\x20?[0-9]{3}")),
    ("ssn", re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"), re.compile(r"[0-9]-[0-9]{2}-[0-9]")),
    ("secret", re.compile(rf"(?<![A-Za-z])(?:{_NAMES})[A-Za-z_]{{0,12}}[\"']?\x20?(?:[:=]|=>|\x20is\x20)\x20?[\"']?(?P<span>[^\s\"'<>,;]{{6,}}+)", re.I), re.compile(rf"(?<![A-Za-z])(?:{_NAMES})", re.I), ("token", "secret", "passw", "pwd", "key", "auth", "bearer", "credential")),
    ("secret", re.compile(r"[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=-])"), re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20}")),
    ("street", re.compile(r"(?<![\w.,])[0-9]{1,5}[A-Za-z]?\x20(?:[A-Z][\w'.-]{1,30}\x20){1,4}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Ct|Square|Place|Way)\b"), re.compile(r"[0-9][A-Za-z]?\x20[A-Z]")),
    ("street", re.compile(r"(?<![\w])(?:[A-ZÄÖÜ][\w.-]{1,30}(?:straße|strasse|str\.|weg|platz|gasse|allee)|(?:[Rr]ue|[Aa]venue|[Cc]alle|[Pp]laza|[Vv]ia)\x20(?:(?:de|la|du|des|del|di)\x20){0,2}[A-ZÀ-Ü][\w'-]{1,30}),?\x20[0-9]{1,4}[a-z]?\b"), re.compile(r"\x20[0-9]{1,4}[a-z]?\b")),
    ("card_like", re.compile(r"(?<![\w.+-])(?:[0-9]{4}(?P<gap>[\x20.-]?)[0-9]{4}(?P=gap)[0-9]{4}(?P=gap)[0-9]{4}|3[0-9]{3}[\x20.-]?[0-9]{6}[\x20.-]?[0-9]{5})(?!\w)"), re.compile(r"[0-9]{4}[\x20.-]?[0-9]{4}[\x20.-]?[0-9]")),
)
_AT = re.compile(r"\x20?[\[({]\x20?at\x20?[\])}]\x20?(?=[A-Za-z0-9-])", re.I)
_DOMAIN_WORDS = re.compile(r"[A-Za-z0-9-]++(?:(?:\x20?[\[({]\x20?dot\x20?[\])}]\x20?|\.)[A-Za-z0-9-]++)+", re.I)


def _email_words(text: str):
    """Addresses with "at" and perhaps "dot" spelled out, from the start of their local part."""
    end = 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start() and (domain := _DOMAIN_WORDS.match(text, m.end())):
            yield start, domain.end()
            end = domain.end()


_REACH = 200
_HINTS = tuple(re.compile(x, re.I) for x in (r"\b(phone|tel|telephone|call|mobile|cell|fax|text me|whatsapp)\b", r"\b(ssn|social security|social)\b", r"\b(iban|account|bank|transfer)\b", r"\b(mail|e-mail|email|contact|write|reach)\b", r"\b(ip|ipv6|host|address|server)\b", r"\b(order|invoice|isbn|version|release|ref|item|page|year|date|between|from|score|serial|model|part)\b", rf"(?:{_NAMES})", r"\b(commit|sha1|sha256|md5|checksum|digest|hash|uuid|id|etag|revision|sequence|tracking)\b", r"\b(lives?|live at|address|resid|deliver|ship to|home|wohnt|habite|vive)\b", r"\b(card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta)\b"))


_ANY_HINT, _NO_HINTS = re.compile("|".join(h.pattern for h in _HINTS), re.I), [0.0] * len(_HINTS)


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Spans that the generators propose; they may overlap. Each looks only around where its cheap test matches."""
    found = [("email_words", a, b) for a, b in _email_words(text)]
    lower = text.lower()
    for kind, pattern, test, *words in _GENERATORS:
        if words and not any(w in lower for w in words[0]):
            continue
        part = "span" if "span" in pattern.groupindex else 0
        end = 0
        for m in test.finditer(text):
            if m.start() < end:
                continue
            if kind == "secret":
                hits = iter([hit] if (hit := pattern.match(text, m.start())) else [])
            else:
                hits = pattern.finditer(text, max(end, m.start() - _REACH), min(len(text), m.end() + _REACH))
            for hit in hits:
                if hit.end() > m.start():
                    if kind != "ipv6" or _is_ipv6(hit[0]):
                        found.append((kind, *hit.span(part)))
                    end = hit.end()
                    break
    return found


def _entropy(s: str) -> float:
    """Bits a character."""
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def _is_ipv6(s: str) -> bool:
    """Eight groups, or fewer with one gap."""
    groups = s.split(":")
    if s.count("::") > 1 or ":::" in s or not all(len(g) <= 4 for g in groups):
        return False
    return len(groups) == 8 and all(groups) or "::" in s and sum(map(bool, groups)) <= 7


_UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
_NAME_LIKE = re.compile(r"[$@]?[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*[\[(]?.*")
_DIGIT_RUNS, _LETTER_RUNS, _MARKS_OF = re.compile(r"[0-9]+"), re.compile(r"[A-Za-z]+"), re.compile(r"[^0-9A-Za-z]")
_GIVEN = re.compile(r"[:=]\s?[\"']?$|\bis\s$")
_MIXED = re.compile(r"[A-Za-z][0-9]|[0-9][A-Za-z]|[a-z][A-Z]")


def _iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    s, before = text[start:end], text[max(0, start - 40) : start]
    digits = "".join(c for c in s if "0" <= c <= "9")
    groups, letters = _DIGIT_RUNS.findall(s), _LETTER_RUNS.findall(s)
    return [
        *[float(kind == k) for k in ADDED],
        float(len(s)),
        float(len(digits)),
        float(len(groups)),
        float(len(groups[0]) if groups else 0),
        float(len(groups[-1]) if groups else 0),
        float(len(set(_MARKS_OF.findall(s)))),
        float(s[0] == "("),
        float("." in s),
        float("/" in s),
        float(kind == "iban" and _iban_ok(s)),
        float(kind == "ssn" and digits[:3] not in ("000", "666") and digits[:1] != "9" and digits[3:5] != "00" and digits[5:] != "0000"),
        float(len(set(digits))),
        float(1900 <= int(digits[:4] or 0) <= 2099),
        *([float(bool(h.search(before))) for h in _HINTS] if _ANY_HINT.search(before) else _NO_HINTS),
        float(text[end : end + 1] in ("%", "$", "€", ":")),
        float(before[-1:] in ("#", "$", "€", ":")),
        _entropy(s),
        len(digits) / len(s),
        float(sum("A" <= c <= "Z" for c in s)) / len(s),
        float(not s.strip("0123456789abcdefABCDEF")),
        float(bool(_MARKS.match(s))),
        float(bool(_GIVEN.search(before))),
        float(before[-1:] in ("'", '"')),
        float(sum(not c.isalnum() for c in s)) / len(s),
        float(kind == "card_like" and luhn(digits)),
        float(len(letters)),
        float(max(map(len, letters), default=0)),
        float(kind == "ipv6" and _is_ipv6(s)),
        float(bool(_UUID.fullmatch(s))),
        float(bool(_NAME_LIKE.fullmatch(s)) and ("." in s or "(" in s or "[" in s or "{" in s)),
        len(_MIXED.findall(s)) / len(s),
        float(s.count("/")),
        float(before[-1:] == "/" or before[-3:] == "://"),
    ]


# ---- boosted trees


def _fit_tree(codes: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, out: np.ndarray):
    """A leaf's value, or (feature, threshold, left, right): the split with the largest gain in the second-order loss. out gets each row's value."""
    gain, split, total = 1e-6, None, g[rows].sum() ** 2 / (h[rows].sum() + 1)
    if depth and len(rows) >= 20:
        for f, cuts in enumerate(edges):
            gl, hl, n = (np.cumsum(np.bincount(codes[rows, f], w, len(cuts) + 1))[:-1] for w in (g[rows], h[rows], None))
            new = gl**2 / (hl + 1) + (g[rows].sum() - gl) ** 2 / (h[rows].sum() - hl + 1) - total
            new[(n < 5) | (n > len(rows) - 5)] = 0
            if len(new) and new.max() > gain:
                gain, split = new.max(), (f, int(new.argmax()))
    if split is None:
        value = float(-g[rows].sum() / (h[rows].sum() + 1))
        out[rows] = value
        return value
    f, k = split
    left = codes[rows, f] <= k
    return f, float(edges[f][k]), _fit_tree(codes, edges, g, h, rows[left], depth - 1, out), _fit_tree(codes, edges, g, h, rows[~left], depth - 1, out)


def _tree_values(tree, x: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
    """Adds each row's leaf to out."""
    if not isinstance(tree, tuple):
        out[rows] += RATE * tree
    elif len(rows):
        left = x[rows, tree[0]] <= tree[1]
        _tree_values(tree[2], x, rows[left], out)
        _tree_values(tree[3], x, rows[~left], out)


def score(trees: list, rows: list[list[float]]) -> np.ndarray:
    """Probability of each candidate, given its features, to be personal data."""
    x, raw = np.array(rows, float).reshape(len(rows), -1), np.zeros(len(rows))
    for tree in trees:
        _tree_values(tree, x, np.arange(len(rows)), raw)
    return 1 / (1 + np.exp(-raw))


def boost(x: np.ndarray, y: np.ndarray) -> list:
    """Trees fitted to the logistic loss, over at most 32 cuts a feature."""
    edges = [v[:-1] if len(v := np.unique(c)) <= 32 else np.unique(np.quantile(c, np.linspace(0.03, 0.97, 32))) for c in x.T]
    codes = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
    trees, raw = [], np.zeros(len(y))
    for _ in range(ROUNDS):
        p, values = 1 / (1 + np.exp(-raw)), np.zeros(len(y))
        trees.append(_fit_tree(codes, edges, p - y, p * (1 - p), np.arange(len(y)), DEPTH, values))
        raw += RATE * values
    return trees


def _iban(rng: random.Random, right: bool = True) -> str:
    """An account number of one of some countries, with its check digits or wrong ones."""
    country, letters, digits = rng.choice((("DE", 0, 18), ("GB", 4, 14), ("FR", 0, 23), ("NL", 4, 10), ("ES", 0, 20), ("IT", 1, 22), ("CH", 0, 17), ("AT", 0, 16)))
    body = "".join(rng.choice("ABCDEFGHKLMNRSTW") for _ in range(letters)) + "".join(str(rng.randint(0, 9)) for _ in range(digits))
    check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
    s = f"{country}{check if right else (check + rng.randint(1, 95)) % 97:02d}{body}"
    return " ".join(s[i : i + 4] for i in range(0, len(s), 4)) if rng.random() < 0.5 else s


def _example(rng: random.Random) -> tuple[str, str, bool]:
    """(text before, entity, whether it is personal data)."""
    d = lambda n: "".join(str(rng.randint(0, 9)) for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randint(2, 9)))
    neutral = " ".join(word() for _ in range(rng.randint(2, 6))) + " "
    say = lambda *x: neutral + rng.choice(x) + " "
    a, b = rng.randint(200, 899), f"{rng.randint(1, 99):02d}"
    hexes = lambda n: ":".join(f"{rng.randint(0, 65535):x}" for _ in range(n))
    run = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    hex_run = lambda n: run("0123456789abcdef", n) if rng.random() < 0.7 else run("0123456789ABCDEF", n)
    mixed = lambda n: run("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", n)
    name = rng.choice(("token", "secret", "password", "api_key", "API-KEY", "access_key", "TOKEN", "client_secret", "auth_token", "Password", "pwd"))
    given = name + rng.choice((" = ", "=", ": ", ":", " is ", " => ")) + rng.choice(("", '"', "'"))
    title = lambda: word().capitalize()
    around = lambda x: rng.choice((f" [{x}] ", f" ({x}) ", f"[{x}]", f" {{{x}}} "))
    spelled = lambda local, last: f"{local}{around('at')}{word()}{rng.choice((around('dot'), '.'))}{last}"
    road = lambda: rng.choice((f"{rng.randint(1, 9999)} {title()} {rng.choice(('Street', 'St', 'Avenue', 'Road', 'Lane', 'Drive', 'Blvd', 'Court'))}", f"{rng.randint(1, 999)} {title()} {title()} {rng.choice(('Street', 'Ave', 'Rd', 'Way'))}", f"{title()}{rng.choice(('straße', 'weg', 'platz', 'allee'))} {rng.randint(1, 300)}", f"{rng.choice(('rue de', 'avenue', 'calle', 'via'))} {title()}, {rng.randint(1, 300)}"))
    fours = lambda gap: gap.join((str(rng.randint(3, 6)) + d(3), d(4), d(4), d(4)))
    return rng.choice(
        (
            lambda: (say("phone", "call me at", "tel:", "mobile", "fax"), rng.choice((f"({a}) {d(3)}-{d(4)}", f"{a}-{d(3)}-{d(4)}", f"{a}.{d(3)}.{d(4)}", f"{a} {d(3)} {d(4)}")), True),
            lambda: (neutral, f"({a}) {d(3)}-{d(4)}", True),
            lambda: (say("ssn", "social security number", "SSN:"), f"{rng.randint(1, 665):03d}-{b}-{rng.randint(1, 9999):04d}", True),
            lambda: (say("IBAN", "account", "bank transfer to"), _iban(rng), True),
            lambda: (neutral, _iban(rng), True),
            lambda: (say("mail", "contact", "write to") if rng.random() < 0.5 else neutral, spelled(rng.choice((word(), f"{word()}.{word()}", f"{word()}_{word()}", f"{word()}{d(2)}")), rng.choice(("com", "org", "net", "de", "co.uk"))), True),
            lambda: (neutral, rng.choice((spelled(word(), d(2)), f"{word()} (at) {d(1)}.{d(2)}", f"{d(2)}.{d(2)} [at] {d(1)}.{d(1)}")), False),
            lambda: (say("host", "server address", "from IPv6"), rng.choice((hexes(8), f"fe80::{hexes(rng.randint(2, 4))}", f"{hexes(2)}::{hexes(rng.randint(1, 3))}")), True),
            lambda: (neutral, rng.choice((hexes(8), f"fe80::{hexes(4)}", f"2001:{hexes(2)}::{hexes(rng.randint(1, 3))}")), True),
            lambda: (rng.choice((neutral, say("mac", "device", "interface", "host"))), ":".join(f"{rng.randint(0, 255):02x}" for _ in range(rng.choice((6, 6, 8)))), False),
            lambda: (neutral, rng.choice((f"{rng.randint(1, 9)}:{d(1)}:{d(1)}", "::".join((word()[:3], word()[:4])), f"{hexes(rng.randint(3, 6))}", f"{rng.randint(1, 99)}::{rng.randint(1, 99)}::{rng.randint(1, 9)}")), False),
            lambda: (say("ssn", "IBAN", "account") if rng.random() < 0.5 else neutral, _iban(rng, right=False), False),
            lambda: (neutral + rng.choice((given, "", "id ", "request ", "session: ")), "-".join(map(hex_run, (8, 4, 4, 4, 12))), False),
            lambda: (neutral + rng.choice(("https://", "see ", "in ", "/")), rng.choice((f"{word()}.{rng.choice(('org', 'com'))}/{word()}s/{rng.randint(1990, 2030)}/" + "-".join(word() for _ in range(rng.randint(3, 7))), f"{word()}/{word()}/{word()}/{word()}-{word()}", f"{word()}s/{rng.randint(1990, 2030)}/{rng.randint(1, 12):02d}/{'-'.join(word() for _ in range(5))}")), False),
            lambda: (neutral + given, rng.choice((f"process.env.{word().upper()}", f"os.environ['{word().upper()}']", f"get_{word()}()", f"config.{word()}.{word()}", f"{word()}.{word()}_{word()}", f"${{{word().upper()}}}", f"{word()}_{word()}", f"{title()}{title()}Provider", f"settings.{word().upper()}_{word().upper()}")), False),
            lambda: (say("order", "invoice", "ref", "item", "part", "serial"), rng.choice((f"{a}-{d(3)}-{d(4)}", f"{a} {d(3)} {d(4)}", f"{a}-{b}-{d(4)}", f"({a}) {d(3)}-{d(4)}")), False),
            lambda: (neutral, rng.choice((f"{rng.randint(1900, 2099)}-{d(3)}-{d(4)}", f"{d(2)} {d(3)} {d(3)}", f"{d(3)} {d(3)} {d(3)}", f"{d(2)}.{d(3)}.{d(3)}", f"{d(4)} {d(4)}", f"{d(4)}-{d(4)}", f"{d(3)}/{d(3)}-{d(4)}")), False),
            lambda: (neutral, f"{rng.choice(('000', '666', '9' + d(2)))}-{b}-{d(4)}", False),
            lambda: (neutral, f"{a}-{b}-{d(4)}", False),
            lambda: (neutral, "".join(rng.choice("ABCDEFGHK") for _ in range(2)) + d(2) + "".join(rng.choice("ABCDEFGHKLM0123456789") for _ in range(rng.choice((12, 16, 18)))), False),
            lambda: (neutral, f"{rng.randint(0, 23)}:{b}:{rng.randint(10, 59)}", False),
            lambda: (say("version", "score", "between"), f"{rng.randint(0, 23)}:{rng.randint(10, 59)}:{rng.randint(10, 59)}", False),
            lambda: (neutral + given, rng.choice((hex_run(rng.choice((24, 32, 40, 64))), mixed(rng.randint(20, 64)), mixed(rng.randint(64, 900)), hex_run(rng.choice((128, 256, 900))))), True),
            lambda: (neutral + given, rng.choice((hex_run(rng.choice((32, 40))), mixed(rng.randint(10, 24)), mixed(rng.randint(5, 9)) + rng.choice("!#%&*") + d(rng.randint(2, 4)))), True),
            lambda: (neutral, rng.choice(("AKIA" + run("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), "ghp_" + mixed(36), "sk-" + mixed(40), "xoxb-" + d(11) + "-" + mixed(24), "AIza" + mixed(35), mixed(rng.randint(32, 900)), "eyJ" + mixed(60))), True),
            lambda: (say("commit", "sha256", "checksum", "digest", "md5", "revision", "etag", "hash"), hex_run(rng.choice((32, 40, 64))), False),
            lambda: (neutral, rng.choice((hex_run(rng.choice((32, 40, 64))), "-".join(map(hex_run, (8, 4, 4, 4, 12))), "_".join(word() for _ in range(5)), "-".join(word() for _ in range(6)), "/".join(word() for _ in range(6)), "-" * 30, "".join(word() for _ in range(5)))), False),
            lambda: (neutral + rng.choice(("the token is ", "token: ", "password: ", "secret = ", "auth: ", "author: ", "authority is ")), rng.choice((word(), title(), f"{word()}ing", "required", "optional", "invalid", "missing", "expired", "null", "changed")), False),
            lambda: (say("lives at", "address:", "home address", "deliver to", "ship to"), road(), True),
            lambda: (neutral, road(), True),
            lambda: (neutral, rng.choice((f"{rng.randint(1, 99)} {title()} {title()} walked", f"{rng.randint(1900, 2030)} {title()} Drive", f"{title()} Street", f"{rng.randint(2, 40)} {word()} Way", f"{title()}weg")), False),
            lambda: (say("card", "visa", "credit card"), fours(rng.choice((" ", "-", "", "."))), True),
            lambda: (neutral, fours(rng.choice((" ", "-", "."))), True),
            lambda: (say("order", "serial", "tracking", "invoice", "id"), fours(""), False),
            lambda: (neutral, rng.choice((d(16), ".".join((d(4), d(4))), f"{d(4)} {d(4)} {d(2)}", d(20), d(18))), False),
        )
    )()


@lru_cache(maxsize=1)
def fitted() -> tuple[list, dict[str, float]]:
    """Trees, and the threshold of each kind."""
    rng = random.Random(20)
    rows, ys, kinds = [], [], []
    for _ in range(EXAMPLES):
        before, entity, personal = _example(rng)
        text = f"{before}{entity}{rng.choice(('', '.', ' and then', ', so'))}"
        for kind, a, b in candidates(text):
            if b > len(before):
                whole = a <= len(before) + 1 and b >= len(before) + len(entity) - 1
                rows.append(features(text, kind, a, b))
                ys.append(float(personal and whole))
                kinds.append(kind)
    x, y, kinds = np.array(rows), np.array(ys), np.array(kinds)
    held = np.arange(len(y)) % 4 == 0
    trees = boost(x[~held], y[~held])
    p = score(trees, x)
    limits = {}
    for kind in ADDED:
        mine = held & (kinds == kind)
        ok = [t for t in np.unique(p[mine]) if y[sure := mine & (p >= t)].sum() >= PRECISION * (sure.sum() + 1)]
        below = p[mine & (p < min(ok))].max(initial=0.0) if ok else 0.0
        limits[kind] = max(LEAST, float(min(ok) + below) / 2) if ok else 2.0
    return trees, limits


def find_spans(text: str, trees: list, limits: dict[str, float]) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans): kinds in the order of BASE and ADDED, then by start."""
    base, proposed = base_spans(text), candidates(text)
    if not proposed:
        return base, base
    scores = score(trees, [features(text, k, a, b) for k, a, b in proposed]).tolist()
    low, high = [], []  # of the stretches of base matches, apart from each other
    for a, b in sorted((a, b) for _, a, b in base):
        if low and a < high[-1]:
            high[-1] = max(high[-1], b)
        else:
            low.append(a)
            high.append(b)

    def stands(a: int, b: int) -> bool:
        """No base match reaches over an end of the span, or is all of it."""
        first, last = bisect_right(high, a), bisect_left(low, b) - 1
        return first > last or a <= low[first] and high[last] <= b and (low[first], high[last]) != (a, b)

    starts, ends, added = [], [], []
    for s, k, a, b in sorted(((s, *x) for s, x in zip(scores, proposed)), key=lambda x: (-x[0], x[2], x[1])):
        at = bisect_right(starts, a)
        if s >= limits[k] and (not at or ends[at - 1] <= a) and (at == len(starts) or b <= starts[at]) and stands(a, b):
            starts.insert(at, a)
            ends.insert(at, b)
            added.append((k, a, b))
    return base, base + sorted(added, key=lambda x: (ADDED.index(x[0]), x[1]))


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans ("kind:start:end", comma-joined, all kinds), n_added and n_spans."""
    trees, limits = fitted()
    joined = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column(1):
                base, spans = find_spans(text.as_py() or "", trees, limits)
                out.append((*[sum(k == kind for k, _, _ in base) for kind in BASE], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base), len(spans)))
            columns = list(zip(*out)) or [[]] * 8
            types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types)]], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "n_spans"])

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return map_arrow(rows, run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long")


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first that starts."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
            at = b
    return "".join([*out, text[at:]])
