"""Personal data: candidate gradient boosting.

High-recall generators propose spans that may overlap: the base forms (email, ip, card, phone by their stated rules) and
looser ones (spelled-out addresses, phone numbers without a plus or inside longer runs of digits, cards with other
separators or lengths, defanged and version 6 addresses, bank accounts, identity numbers, birth dates). Base spans are kept
as they are. A looser candidate that meets no base span is described by its format and its context, scored by boosted
trees, and taken if its score reaches the threshold of its kind; of overlapping ones the likelier is taken.

The trees are fitted on a bounded sample: SAMPLE_TEXTS windows of SAMPLE_CHARS characters from hash-chosen places of the
texts, into which made-up values and look-alikes (orders, versions, amounts, dates, hashes) are put, so that labels are
known and contexts are those of the corpus. A third of the windows is held out: there, scores are calibrated by isotonic
regression and the threshold of a kind is the least score whose calibrated precision is PRECISION or more; a kind
without such a score adds nothing. Everything else reads whole texts of all documents; scans are linear in the text.

Defined results: null and empty texts have no spans; rows that share a doc_id are judged one by one; spans of one kind never
overlap among themselves, base spans of different kinds may; equal scores go to the earlier, then longer span; an empty
table gives no rows (and the trees are fitted without contexts); other columns, whatever their names, are ignored; texts
of any length are scanned whole, without a window.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, text_chunks

SAMPLE_TEXTS, SAMPLE_CHARS, PRECISION = 3000, 400, 0.95
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "identity", "birth")

# ---------------------------------------------------------------- base forms

_domain = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_local_end = re.compile(r"[A-Za-z0-9._%+-]")
_ip = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_card = re.compile(r"[0-9](?:[ -]?[0-9])++")
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_digits = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(_digits.findall(s))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Spans of `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`, from each @ outwards, since a scan from the left would be quadratic."""
    last = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and _local_end.match(text, start - 1):
            start -= 1
        if start < at and (m := _domain.match(text, at + 1)):
            yield start, m.end()
            last = m.end()
        else:
            last = max(last, at + 1)  # a later local part can't reach over this @
        at = text.find("@", max(at + 1, last))


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind index, start, end), by kind and start."""
    out = [(0, a, b) for a, b in emails(text)]
    out += [(1, *m.span()) for m in _ip.finditer(text) if all(map(small, m[0].split(".")))]
    for m in _card.finditer(text):
        if m.end() - m.start() <= 38 and 16 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in _phone.finditer(text) if 8 <= len(digits_of(m[0])) <= 15]
    return out


# ---------------------------------------------------------------- candidates

_at = re.compile(r"[\[({<] ?[aA][tT] ?[\])}>]|(?<=[ ])[aA][tT](?=[ ])|[@＠]")
_local = re.compile(r"[A-Za-z0-9._%+-]{1,64}$")
_dotted = re.compile(r" {0,2}([A-Za-z0-9-]{1,63}(?: {0,2}(?:\.|[\[({<] ?(?:[dD][oO][tT]|\.) ?[\])}>]|(?<= )(?:[dD][oO][tT]|punto|punkt|point)(?= )) {0,2}[A-Za-z0-9-]{1,63}){1,5})")
_chain = re.compile(r"(?<![\w.,$€£#-])[+(]?[0-9]++(?:[ ().\-/ ]{1,3}[0-9]++)*+")
_group = re.compile(r"[+(]?[0-9]+")
_account = re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?:[ -]?[A-Z0-9]){11,30}(?!\w)")
_identity = re.compile(r"(?<![\w-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![\w-])")
_six = re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![\w:])")
_fanged = re.compile(r"(?<![\w.])[0-9]{1,3}(?:(?: ?[\[(](?:\.|dot)[\])] ?| dot )[0-9]{1,3}){3}(?![\w.])")
_date = re.compile(r"(?<![\w./-])(?:[0-9]{1,2}([./-])[0-9]{1,2}\1(?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2})(?![\w/-])")
MOST_GROUPS = 15


def candidates(text: str) -> Iterator[tuple[int, int, int, int]]:
    """(kind index, generator, start, end) of looser forms; they may overlap."""
    for m in _at.finditer(text):
        left = text[max(0, m.start() - 67) : m.start()].rstrip(" ")
        own, right = _local.search(left), _dotted.match(text, m.end())
        if own and right:
            yield 0, 0, max(0, m.start() - 67) + own.start(), right.end()
    for m in _chain.finditer(text):
        groups = list(_group.finditer(text, m.start(), m.end()))
        for i, g in enumerate(groups):
            if i and (g[0][0] not in "+(" or len(g[0]) < 3 or text[g.start() - 1] != " "):
                continue
            n = 0
            for h in groups[i : i + MOST_GROUPS]:
                n += len(h[0]) - (h[0][0] in "+(")
                if n > 19:
                    break
                if text[h.end() : h.end() + 1].isalnum():
                    continue
                if 7 <= n <= 15:
                    yield 3, 1, g.start(), h.end()
                if 12 <= n:
                    yield 2, 2, g.start(), h.end()
    yield from ((4, 3, *m.span()) for m in _account.finditer(text))
    yield from ((5, 4, *m.span()) for m in _identity.finditer(text))
    yield from ((1, 5, *m.span()) for m in _six.finditer(text))
    yield from ((1, 6, *m.span()) for m in _fanged.finditer(text))
    yield from ((6, 7, *m.span()) for m in _date.finditer(text))


# ---------------------------------------------------------------- features

N_GENERATORS = 8
#: Words near a span, in the languages that the corpora commonly have; the last group speaks against personal data.
CUES = (
    "mail email e-mail correo courriel write contact kontakt contacto schreiben".split(),
    "phone tel telephone call mobile cell fax ring whatsapp sms telefon handy anrufen mobil rufnummer téléphone portable appelez teléfono móvil llame celular".split(),
    "card visa mastercard amex credit debit karte kreditkarte carte tarjeta cvv".split(),
    "iban bic bank account konto compte cuenta transfer überweisung virement".split(),
    "ip host server address ping client peer addr adresse dirección login".split(),
    "ssn social security tax national passport id ausweis steuernummer identité pasaporte dni".split(),
    "born birth dob birthday birthdate geboren geburtsdatum né née naissance nacido nacimiento".split(),
    "order version invoice ref item part isbn serial build page price total figure id# no. sku ticket commit hash amount release rechnung facture pedido".split(),
)
_cue = {w: i for i, words in enumerate(CUES) for w in words}
_word = re.compile(r"[^\W\d_](?:[\w-]*\w)?|no\.")
NEAR, AFTER = 40, 24
SEPARATORS = " .-/()[]:@"


def neighbour(c: str) -> int:
    return 0 if not c or c == "\n" else 1 if c == " " else 2 if c.isalnum() else 3 if c in "\"'" else 4 if c in "=:#" else 5


def mod97(s: str) -> bool:
    s = "".join(c for c in s if c.isalnum())
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def features(text: str, kind: int, generator: int, start: int, end: int) -> list[float]:
    """Format and context of a candidate; the span's own letters and digits are no features beyond their shape."""
    s = text[start:end]
    d = digits_of(s)
    groups = [len(g) for g in re.findall(r"[0-9]+", s)] or [0]
    last = re.split(r"[^A-Za-z0-9]+", s)[-1]
    out = [float(generator == g) for g in range(N_GENERATORS)]
    out += [len(s), len(d), sum(c.isalpha() for c in s), sum(c.isupper() for c in s), len(groups), groups[0], groups[-1], max(groups), len(set(d))]
    out += [float(s.count(c)) for c in SEPARATORS]
    out += [float(s[0] == "+"), float(d[:1] == "0"), float(len(d) >= 12 and luhn(d)), float(generator == 3 and mod97(s))]
    out += [float(last.isalpha() and last.islower()), len(last), float(bool(re.search(r"(?i)\bdot\b|punto|punkt|point", s))), float(bool(re.search(r"(?i)[\[({<] ?at ?[\])}>]", s)))]
    out += [float(" ." in s or ". " in s), float("@" in s)]
    out += [float(max(map(int, re.findall(r"[0-9]+", s[:40])), default=0) <= 255)]
    before, after = text[max(0, start - NEAR) : start], text[end : end + AFTER]
    near = [len(CUES) * [0.0], len(CUES) * [0.0]]
    for k, part in enumerate((before, after)):
        for m in _word.finditer(part.lower()):
            if (c := _cue.get(m[0])) is not None:
                near[k][c] = max(near[k][c], 1 / (1 + (len(part) - m.end() if k == 0 else m.start())) + 0.1)
    out += near[0] + near[1]
    out += [neighbour(text[start - 1 : start] if start else ""), neighbour(text[end : end + 1])]
    out += [sum(c.isdigit() for c in before), sum(c.isdigit() for c in after), float(before.rstrip(" ")[-1:] in (":", "="))]
    return out


# ---------------------------------------------------------------- boosted trees


@dataclass
class Trees:
    """Trees of depth `depth` over binned features; a sample goes right where its bin is above the node's cut."""

    edges: list[np.ndarray]
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    start: float
    depth: int

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros((0, len(self.edges)), np.int64)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        out, rows = np.full(len(b), self.start), np.arange(len(b))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(b), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
            out += leaf[node - (2**self.depth - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 32, ridge: float = 1.0) -> Trees:
    """Gradient boosting of log loss with histograms of gradients and second derivatives."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    p0 = min(max(y.mean(), 1e-3), 1 - 1e-3)
    out = Trees(edges, *(np.zeros((rounds, 2**depth - 1), np.int64) for _ in range(2)), np.zeros((rounds, 2**depth)), float(np.log(p0 / (1 - p0))), depth)
    b, margin, n_f = out.bins(x), np.full(len(y), out.start), x.shape[1]
    offset = np.arange(n_f) * bins
    for r in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            base, n = 2**level - 1, 2**level
            key = ((node - base)[:, None] * n_f * bins + offset + b).ravel()
            gs, hs = (np.bincount(key, np.repeat(w, n_f), n * n_f * bins).reshape(n, n_f, bins).cumsum(axis=2) for w in (g, h))
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
            gain[(hs < 1) | (ht - hs < 1)] = 0
            best = gain.reshape(n, -1).argmax(axis=1)
            f, c = best // bins, best % bins
            c = np.where(gain.reshape(n, -1)[np.arange(n), best] > 1e-9, c, bins)
            out.feature[r, base : base + n], out.cut[r, base : base + n] = f, c
            at = node - base
            node = 2 * node + 1 + (b[np.arange(len(y)), f[at]] > c[at])
        at = node - (2**depth - 1)
        gs, hs = (np.bincount(at, w, 2**depth) for w in (g, h))
        out.leaf[r] = rate * gs / (hs + ridge)
        margin += out.leaf[r][at]
    return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least score, calibrated probability) of each step of the monotone fit."""
    o = np.argsort(score, kind="stable")
    steps: list[list[float]] = []
    for s, v in zip(score[o], y[o]):
        steps.append([s, v, 1.0])
        while len(steps) > 1 and steps[-2][1] * steps[-1][2] >= steps[-1][1] * steps[-2][2]:
            _, v2, n2 = steps.pop()
            steps[-1][1] += v2
            steps[-1][2] += n2
    return np.array([s for s, _, _ in steps]), np.array([v / n for _, v, n in steps])


@dataclass
class Model:
    trees: Trees
    steps: list[tuple[np.ndarray, np.ndarray]]  # calibration by kind
    thresholds: np.ndarray  # least calibrated probability by kind

    def probability(self, kinds: np.ndarray, margin: np.ndarray) -> np.ndarray:
        out = np.zeros(len(margin))
        for k, (at, p) in enumerate(self.steps):
            own = kinds == k
            if own.any() and len(at):
                step = np.searchsorted(at, margin[own], "right") - 1
                out[own] = np.where(step >= 0, p[np.maximum(step, 0)], 0.0)
        return out


# ---------------------------------------------------------------- training examples


class Maker:
    """Made-up values (with their kind) and look-alikes (kind -1)."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def num(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def name(self) -> str:
        return "".join(self.r.choice(["ka", "lo", "mi", "ren", "tor", "sa", "bel", "jo", "an", "du"]) for _ in range(self.r.randint(2, 4)))

    def checked(self, n: int) -> str:
        s = self.num(n - 1)
        return next(s + c for c in "0123456789" if luhn(s + c))

    def grouped(self, s: str, sizes: list[int], sep: str) -> str:
        parts = []
        for n in sizes:
            parts.append(s[:n])
            s = s[n:]
        return sep.join([*parts, s] if s else parts)

    def account(self, good: bool) -> str:
        body = self.num(self.r.choice([14, 16, 18, 20]))
        land = self.r.choice(["DE", "FR", "ES", "GB", "NL", "IT", "AT"])
        check = 98 - int(body + "".join(str(int(c, 36)) for c in land) + "00") % 97 if good else self.r.randint(2, 98)
        s = f"{land}{check:02d}{body}"
        return self.grouped(s, [4] * (len(s) // 4), " ") if self.r.random() < 0.5 else s

    def value(self) -> tuple[int, str]:
        r, kind = self.r, self.r.randrange(len(KINDS))
        if kind == 0:
            at = r.choice([" at ", " AT ", " [at] ", "[at]", " (at) ", "(at)", " {at} ", " <at> ", " @ ", "＠"])
            dot = r.choice([" dot ", " [dot] ", "[dot]", "(dot)", " DOT "]) if at.strip().lower() == "at" or r.random() < 0.5 else r.choice([".", " . "]) if "@" in at else "."
            host = [self.name(), r.choice(["example", "mail", "post"])][: r.randint(1, 2)] + [r.choice(["com", "org", "net", "de", "fr", "es", "io"])]
            return kind, r.choice([self.name(), self.name() + "." + self.name(), self.name() + self.num(2)]) + at + dot.join(host)
        if kind == 1:
            if r.random() < 0.5:
                return kind, r.choice(["[.]", "(.)", "[dot]", " dot "]).join(str(r.randint(1, 255)) for _ in range(4))
            return kind, ":".join(f"{r.randrange(65536):x}" for _ in range(8)) if r.random() < 0.6 else f"{r.randrange(8192, 65536):x}:{r.randrange(65536):x}::{r.randrange(1, 65536):x}"
        if kind == 2:
            n = r.choice([13, 14, 15, 15, 16, 16])
            s = r.choice("3456") + self.num(n - 2)
            s = next(s + c for c in "0123456789" if luhn(s + c))
            if n == 16:
                return kind, self.grouped(s, [4, 4, 4], r.choice([".", " ", "/"]))
            return kind, self.grouped(s, [4, 6], r.choice([" ", "-", "."])) if n == 15 and r.random() < 0.6 else s
        if kind == 3:
            a, b, c = str(r.randint(200, 999)), self.num(3), self.num(4)
            return kind, r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"0{a} {b}{c}", f"0{r.randint(1, 9)} {a[:2]} {b[:2]} {c[:2]} {c[2:]}", f"00{r.randint(1, 99)} {a} {b} {c}", f"1-{a}-{b}-{c}", f"0{a}/{b}{c}"])
        if kind == 4:
            return kind, self.account(True)
        if kind == 5:
            return kind, f"{r.randint(100, 899)}-{r.randint(10, 99)}-{self.num(4)}"
        y, m, d = r.randint(1930, 2012), r.randint(1, 12), r.randint(1, 28)
        return kind, r.choice([f"{y}-{m:02d}-{d:02d}", f"{d:02d}/{m:02d}/{y}", f"{d}.{m}.{y}"])

    def decoy(self) -> str:
        r = self.r
        return r.choice([
            lambda: self.num(r.randint(7, 16)), lambda: f"{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 99)}", lambda: f"{self.num(4)}-{self.num(4)}-{self.num(4)}",
            lambda: f"{r.randint(1, 99)} {self.num(3)} {self.num(3)} {self.num(3)}", lambda: f"{r.randint(1990, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", lambda: f"{r.randint(1, 28)}/{r.randint(1, 12)}/{r.randint(1990, 2030)}",
            lambda: f"{r.randint(1, 99)}.{self.num(3)}.{self.num(3)}.{self.num(3)}", lambda: f"{r.randint(10, 23)}:{r.randint(10, 59)}:{r.randint(10, 59)}", lambda: self.account(False),
            lambda: f"{self.name()} at {self.name()}. {self.name().title()}", lambda: f"{self.name()} at {self.name()}.{self.name()}", lambda: f"{self.name()} @ {self.name()}. {self.name().title()}",
            lambda: " ".join(self.num(r.randint(1, 4)) for _ in range(r.randint(4, 8))), lambda: f"{self.num(3)}-{self.num(2)}-{self.num(4)}", lambda: f"978-{self.num(1)}-{self.num(4)}-{self.num(4)}-{self.num(1)}",
            lambda: self.num(16), lambda: f"{r.randint(1990, 2030)}-{r.randint(1990, 2030)}", lambda: f"({self.num(4)}) {self.num(4)}", lambda: f"{self.num(5)}/{self.num(2)}/{self.num(4)}",
        ])()

    def cue(self, kind: int) -> str:
        own = {0: 0, 1: 4, 2: 2, 3: 1, 4: 3, 5: 5, 6: 6, -1: 7}[kind]
        return self.r.choice(CUES[own]) + self.r.choice([": ", " ", " = ", ", "])


def examples(contexts: list[str], seed: int = 20240917, n_windows: int = SAMPLE_TEXTS, each: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features, label, kind, held out) of the candidates that made-up values and look-alikes give in n_windows
    windows; few contexts serve several times, and are held out as a whole."""
    make = Maker(seed)
    x, y, kinds, held = [], [], [], []
    for n, text in ((i % len(contexts), contexts[i % len(contexts)]) for i in range(n_windows)):
        for _ in range(each):
            kind, value = make.value() if make.r.random() < 0.5 else (-1, make.decoy())
            said = make.r.random()
            # dates and plain numbers are personal only where something says so
            bare = kind in (5, 6) or kind == 2 and value.isdigit()
            cue = make.cue(kind) if said < 0.6 or bare else make.cue(make.r.randrange(-1, len(KINDS))) if kind == -1 and said < 0.8 else ""
            if kind == -1 and cue and not cue.startswith(tuple(CUES[7])) and make.r.random() < 0.7:
                cue = ""
            at = make.r.randint(0, len(text))
            at = text.rfind(" ", 0, at) + 1
            whole = text[:at] + cue + value + make.r.choice([" ", ", ", ". ", "\n"]) + text[at:]
            start, end = at + len(cue), at + len(cue) + len(value)
            base = base_spans(whole)
            for k, g, a, b in candidates(whole):
                if b <= start or a >= end or any(a < z and s < b for _, s, z in base):
                    continue
                x.append(features(whole, k, g, a, b))
                y.append(k == kind and a == start and b == end)
                kinds.append(k)
                held.append(n % 3 == 0)
    return np.array(x, float), np.array(y, float), np.array(kinds), np.array(held, bool)


def fit_model(contexts: list[str], precision: float = PRECISION) -> Model:
    x, y, kinds, held = examples(contexts or [" ", "", "\n"])
    trees = boost(x[~held], y[~held])
    margin, steps, thresholds = trees.margin(x[held]), [], np.full(len(KINDS), np.inf)
    for k in range(len(KINDS)):
        own = kinds[held] == k
        at, p = isotonic(margin[own], y[held][own])
        steps.append((at, p))
        # the least probability from which on the accepted ones reach the precision
        for t in np.unique(p):
            chosen = p[np.searchsorted(at, margin[own], "right") - 1] >= t if len(at) else np.zeros(0, bool)
            if t > 0.5 and chosen.sum() >= 20 and y[held][own][chosen].mean() >= precision:
                thresholds[k] = t
                break
    return Model(trees, steps, thresholds)


def contexts_of(docs: DataFrame, n: int = SAMPLE_TEXTS, chars: int = SAMPLE_CHARS) -> list[str]:
    """n windows of texts, by the order of a hash of doc_id and length, each from a hash-chosen place.

    Only some 4 n texts of lowest hash enter the order, so that what tasks send does not grow with their number."""
    h = F.xxhash64(F.lit("pii"), F.col("doc_id").cast("string"), F.length("text"))
    total = docs.where("text is not null").count()
    share = F.pmod(h, F.lit(1 << 20)) < -(-(4 * n << 20) // max(total, 1))
    place = F.pmod(h, F.greatest(F.length("text") - chars, F.lit(1)).cast("long")).cast("int") + 1
    rows = docs.where(F.col("text").isNotNull() & share).select(h.alias("h"), F.substring(F.col("text"), place, F.lit(chars)).alias("w"))
    return [r.w for r in rows.orderBy("h", "w").limit(n).collect()]


def fit(docs: DataFrame, n: int = SAMPLE_TEXTS, chars: int = SAMPLE_CHARS, precision: float = PRECISION) -> Model:
    """The model from a bounded sample of docs(doc_id, text)."""
    return fit_model(contexts_of(docs, n, chars), precision)


# ---------------------------------------------------------------- detection

FOUND = "array<struct<kind:string, o:int, s:int, e:int, base:boolean, p:double>>"


def disjoint(spans: list[tuple[float, int, int, int]], taken: list[tuple[int, int]]) -> list[tuple[float, int, int, int]]:
    """Of spans (p, kind, start, end) those that meet no taken one, likelier first."""
    out, used = [], sorted(taken)
    for p, k, a, b in sorted(spans, key=lambda s: (-s[0], s[2], -s[3])):
        i = bisect_left(used, (b, -1))
        if i and used[i - 1][1] > a:
            continue
        insort(used, (a, b))
        out.append((p, k, a, b))
    return out


def merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The union of spans (kind, start, end) as disjoint ones."""
    out: list[list[int]] = []
    for _, a, b in sorted(spans, key=lambda s: s[1:]):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def detect(texts: list[str], model: Model) -> list[list[tuple]]:
    """Spans (kind, kind index, start, end, base, p) of each text, by kind and start."""
    base, proposed, rows = [], [], []
    for n, text in enumerate(texts):
        spans = base_spans(text)
        base.append(spans)
        covered = merged(spans)
        i = 0
        for k, g, a, b in sorted(candidates(text), key=lambda c: c[2]):
            while i < len(covered) and covered[i][1] <= a:
                i += 1
            if i < len(covered) and covered[i][0] < b or not np.isfinite(model.thresholds[k]):
                continue
            proposed.append((n, k, a, b))
            rows.append(features(text, k, g, a, b))
    chosen: list[list] = [[] for _ in texts]
    if rows:
        kinds = np.array([k for _, k, _, _ in proposed])
        p = model.probability(kinds, model.trees.margin(np.array(rows, float)))
        for (n, k, a, b), v in zip(proposed, p):
            if v >= model.thresholds[k]:
                chosen[n].append((float(v), k, a, b))
    out = []
    for spans, more in zip(base, chosen):
        found = [(KINDS[k], k, a, b, True, 1.0) for k, a, b in spans]
        found += [(KINDS[k], k, a, b, False, v) for v, k, a, b in disjoint(more, merged(spans))]
        out.append(sorted(found, key=lambda s: (s[1], s[2])))
    return out


def find_private(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, found: all spans (kind, its order o, start s and end e in code points, base, calibrated probability) by kind and start."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("o", pa.int32()), ("s", pa.int32()), ("e", pa.int32()), ("base", pa.bool_()), ("p", pa.float64())]))

    def run(batches):
        for part, col in text_chunks(batches, "text"):
            found = [[dict(zip(("kind", "o", "s", "e", "base", "p"), s)) for s in spans] for spans in detect(col.to_pylist(), model)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, kind)], ["doc_id", "found"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, f"doc_id long, found {FOUND}")


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """docs with each span of its text replaced by its kind in brackets; all other columns unchanged."""

    def run(batches):
        for part, col in text_chunks(batches, "text"):
            texts = col.to_pylist()
            out = []
            for text, spans, null in zip(texts, detect(texts, model), part.column(at).is_null().to_pylist()):
                at_end, pieces = 0, []
                for a, b in merged([(0, s[2], s[3]) for s in spans]):
                    first = next(s[0] for s in spans if a <= s[2] < b)
                    pieces += [text[at_end:a], f"[{first}]"]
                    at_end = b
                out.append(None if null else "".join([*pieces, text[at_end:]]))
            cols = part.columns
            cols[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(cols, part.schema.names)

    at = docs.columns.index("text")
    return map_arrow(docs, run, docs.schema)
