"""Personal data: patterns, and weak supervision for what patterns alone can't decide.

Base spans are matches of strict patterns that pass their checks; they always stay. Looser patterns
and gazetteers give further candidates: masked e-mail addresses, defanged or version-6 addresses, card
numbers whose check digit is wrong, telephone numbers without a plus; secrets, by known prefixes, by
assignment to a word such as ``token``, or as long mixed runs; persons, by titles, given names and
introductions; postal addresses, by street words of four languages. Labelers, namely patterns, validity
checks, gazetteers and context words, vote on every candidate, base spans included. The votes of all
documents are counted by pattern; expectation-maximisation estimates each labeler's reliability for
each kind from those counts, and a logistic classifier over votes and the shape of a span is trained
on the posteriors, weighted by counts. It decides on the candidates that aren't base spans.

Counts have at most some thousands of rows, whatever the corpus, so training sees all documents and
takes the same time at any size. Documents are scanned twice and never shuffled.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The first four have base patterns.
KINDS = ("email", "ip", "card", "phone", "secret", "person", "address")
BASE = KINDS[:4]
SECRET, PERSON, ADDRESS = 4, 5, 6
#: Probability from which on a candidate becomes a span.
ACCEPT = 0.9

# The base patterns, in forms that take time in proportion to the text. A digit run that
# fails at its first digit fails at the others, hence the look-behind and the possessive repeats.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Looser patterns.
_AT = re.compile(r"[ ]?(?:\(at\)|\[at\]|\{at\}|<at>| at )[ ]?", re.I)
_AT_DOMAIN = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?:[ ]?(?:\(dot\)|\[dot\]|\{dot\}| dot )[ ]?|\.)[A-Za-z0-9-]{1,63})+", re.I)
_FANGED = re.compile(r"(?<![0-9])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\[dot\])[0-9]{1,3}){3}(?![0-9])")
_IP6 = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
_NO_PLUS = re.compile(r"(?<![0-9+.(-])(?:00[1-9][0-9]{8,12}|\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4})(?![0-9])")

# Gazetteers and context words of the four languages.
_TLDS = frozenset("com org net edu gov mil int info biz io co me ai app dev de fr es uk us eu it nl ch at be pt pl ru cn jp in br mx ar ca au".split())
_IIN = re.compile(r"4|5[1-5]|2[2-7]|3[0-8]|6[0-9]")
_CALLING = re.compile(r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2}")
_CONTEXT = {
    "email": re.compile(r"\b(?:e-?mail|mail|contact|write to|reach|correo|courriel|kontakt)\b", re.I),
    "ip": re.compile(r"\b(?:ip|host|server|address|ping|subnet|login from|adresse|dirección)\b", re.I),
    "card": re.compile(r"\b(?:card|credit|debit|visa|mastercard|amex|pan|karte|carte|tarjeta)\b", re.I),
    "phone": re.compile(r"\b(?:phone|tel|telephone|call|mobile|cell|fax|whatsapp|telefon|téléphone|teléfono|anruf)\b", re.I),
}
_CONTEXT |= {
    "secret": re.compile(r"(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth|bearer|contraseña|passwort|mot de passe)", re.I),
    "person": re.compile(r"\b(?:my name is|name:|signed|sincerely|regards|author|contact|ich heiße|mein name ist|je m.appelle|me llamo|mi nombre es|nom|nombre)\b", re.I),
    "address": re.compile(r"\b(?:address|lives? at|living at|resides|ship to|deliver to|adresse|anschrift|wohnt|wohnhaft|domicilio|dirección|habite|demeurant)\b", re.I),
}
# Secrets. Words that one is assigned to, before a sign; prefixes that issuers give.
_ASSIGNED = re.compile(r"(?:token|secret|passw(?:or)?d|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth[_-]?key|credentials?|contraseña|passwort)[\"']?[ \t]*$", re.I)
_VALUE = re.compile(r"[=:>]?[ \t]*[\"'`]?([^\s\"'`,;<>(){}\[\]]{8,})")
_PREFIXED = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|sk-[A-Za-z0-9_-]{20,}+|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)")
_PREFIXES = ("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "sk-", "AIza", "eyJ")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{32,}+")
# Titles, common given names, words that introduce a person.
_TITLES = frozenset("Mr Mrs Ms Miss Dr Prof Herr Frau Señor Señora Sr Sra Don Doña Monsieur Madame Mme Mlle".split())
_GIVEN = frozenset(
    "Alice Andrea Andreas Anna Anne Antonio Barbara Benjamin Bernard Carlos Carmen Catherine Charles Charlotte Christian Christine Claire "
    "Claudia Daniel David Diego Dorothy Elena Elizabeth Emily Emma Fernando Francisco Franz Frédéric Friedrich Gabriel George Hannah Hans "
    "Heinrich Helen Henri Henry Isabel Jacques James Javier Jean Jennifer Jessica Johann Johannes John Jorge José Joseph Juan Julia Julie "
    "Jürgen Karen Karl Katharina Klaus Laura Lucía Luis Manuel Margaret María Maria Marie Mark Martin Mary Matthew Michael Michel Miguel "
    "Nathalie Nicolas Olivier Pablo Patricia Paul Pedro Peter Philippe Pierre Rafael Richard Robert Rosa Sabine Sarah Sebastian Sofía Sophie "
    "Stefan Stephen Susan Susanne Sylvie Teresa Thomas Ursula Wolfgang".split()
)
_NAME = r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ'’-]+"
_PERSON = re.compile(rf"\b(?:(?P<title>{'|'.join(sorted(_TITLES))})\b\.?[ ](?P<a>{_NAME}(?:[ ]{_NAME}){{0,2}})|(?P<b>(?:{'|'.join(sorted(_GIVEN))})(?:[ ]{_NAME}){{1,2}})|(?:[Mm]y name is|[Ii]ch heiße|[Mm]ein Name ist|[Jj]e m.appelle|[Mm]e llamo|[Mm]i nombre es)[ ](?P<c>{_NAME}(?:[ ]{_NAME}){{0,2}}))")
_INTRODUCE = frozenset("name heiße Name appelle m'appelle m’appelle llamo nombre".split())
# Street words of the four languages.
_STREETS = frozenset("Street St Avenue Ave Road Rd Lane Ln Drive Boulevard Blvd Court Square rue avenue boulevard place chemin impasse Calle Avenida Plaza Paseo".split())
_ADDRESS = re.compile(
    rf"\b[0-9]{{1,5}}[ ](?:{_NAME}[ ]){{1,3}}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Court|Square)\b"
    rf"|\b{_NAME[:-1]}*(?:straße|strasse|weg|platz|allee|gasse)[ ][0-9]{{1,4}}[a-z]?\b"
    rf"|\b[0-9]{{1,4}},?[ ](?:rue|avenue|boulevard|place|chemin|impasse)[ ](?:(?:de|du|des|la|le)[ ]|de l['’]|l['’])*{_NAME}"
    rf"|\b(?:Calle|Avenida|Plaza|Paseo)[ ](?:(?:de|del|la|las|los)[ ])*{_NAME},?[ ][0-9]{{1,4}}\b"
)
_POSTAL = re.compile(r"[ ,\n-]*(?:[A-Z]{1,2}[ -]?)?[0-9]{4,5}\b")
_GERMAN_STREET = re.compile(r"(?:straße|strasse|weg|platz|allee|gasse)[ ][0-9]")
#: Words whose presence makes a text worth a search for persons or addresses.
_TRIGGERS = _TITLES | {f"{t}." for t in _TITLES} | _GIVEN | _INTRODUCE | _STREETS | {f"{t}{c}" for t in _STREETS for c in ".,;"}
#: Length from which on a run of letters and digits may be a secret.
LONG_RUN = 32
_AGAINST = re.compile(r"\b(?:version|release|isbn|order|invoice|serial|hash|checksum|sku|item|figure|section|doi)\b", re.I)
WIDTH = 40
LABELERS = ("pattern", "valid", "gazetteer", "context", "edges")


def _digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _small_parts(text: str) -> bool:
    return all(len(p) <= 3 and int(p) <= 255 or len(p.lstrip("0") or "0") <= 3 and int(p.lstrip("0") or "0") <= 255 for p in re.findall(r"[0-9]+", text))


def _addresses(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping e-mail addresses, found from their @."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at + 1) if at >= end else None
        if m:
            begin = at
            while begin > end and text[begin - 1] in _LOCAL:
                begin -= 1
            if begin < at:
                out.append((begin, m.end()))
                end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base spans by kind, then start."""
    out = [(0, a, b) for a, b in _addresses(text)] if "@" in text else []
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if _small_parts(m[0])]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def _loose_spans(text: str) -> list[tuple[int, int, int]]:
    out, end = [], 0
    for m in _AT.finditer(text):
        begin = m.start()
        while begin > end and text[begin - 1] in _LOCAL:
            begin -= 1
        end = m.end()  # so no character is looked at twice
        domain = _AT_DOMAIN.match(text, m.end())
        if begin < m.start() and domain:
            out.append((0, begin, domain.end()))
    if "[" in text or "(" in text:
        out += [(1, m.start(), m.end()) for m in _FANGED.finditer(text)]
    if ":" in text:
        out += [(1, m.start(), m.end()) for m in _IP6.finditer(text)]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(_digits(m[0])) <= 19:
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in _NO_PLUS.finditer(text)]
    return out


def _is_mixed(value: str) -> bool:
    return any(c.isdigit() for c in value) and any(c.isalpha() for c in value)


def _secrets(text: str, words: list[str]) -> list[tuple[int, int, int]]:
    out = []
    for sign in "=:":
        at = text.find(sign)
        while at >= 0:
            if _ASSIGNED.search(text, max(0, at - 24), at) and (m := _VALUE.match(text, at + 1)) and _is_mixed(m[1]):
                out.append((SECRET, m.start(1), m.end(1)))
            at = text.find(sign, at + 1)
    if any(p in text for p in _PREFIXES):
        out += [(SECRET, m.start(), m.end()) for m in _PREFIXED.finditer(text)]
    at = 0
    for w in words:
        if len(w) >= LONG_RUN:
            at = text.find(w, at)
            out += [(SECRET, m.start(), m.end()) for m in _RUN.finditer(text, at, at + len(w)) if _is_mixed(m[0])]
            at += len(w)
    return out


def _people(text: str) -> list[tuple[int, int, int]]:
    out = []
    for m in _PERSON.finditer(text):
        group = "a" if m["a"] else "b" if m["b"] else "c"
        out.append((PERSON, m.start(group), m.end(group)))
    return out + [(ADDRESS, m.start(), m.end()) for m in _ADDRESS.finditer(text)]


def candidates(text: str) -> list[tuple[tuple[int, int, int], bool]]:
    """((kind, start, end), whether a base span). A looser candidate overlaps no span before it."""
    base = base_spans(text)
    out = [(s, True) for s in base]
    loose = _loose_spans(text) if re.search(r"[0-9]{3}|\bat\b|[:(\[{]", text, re.I) else []
    words = text.split()
    loose += _secrets(text, words)
    if not _TRIGGERS.isdisjoint(words) or _GERMAN_STREET.search(text):
        loose += _people(text)
    if not loose:
        return out
    # What is taken, as disjoint ranges in order, so that neighbours tell all overlaps.
    begins, ends = [], []
    for a, b in sorted((a, b) for _, a, b in base):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            begins.append(a)
            ends.append(b)
    for s in sorted(set(loose), key=lambda x: (x[1], -x[2], x[0])):
        at = bisect_left(begins, s[2])
        if at == 0 or ends[at - 1] <= s[1]:
            out.append((s, False))
            begins.insert(at, s[1])
            ends.insert(at, s[2])
    return out


def _entropy(text: str) -> float:
    """Bits per character, of the text's own frequencies."""
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())


def features(text: str, span: tuple[int, int, int], base: bool) -> tuple[int, ...]:
    """Kind, the votes (0 against, 1 none, 2 for) of the labelers, and two classes of the span's shape."""
    kind, a, b = span
    s, digits = text[a:b], _digits(text[a:b])
    before = text[max(0, a - WIDTH) : a]
    if kind == 0:
        label = re.split(r"[.\s]|dot", s.lower())[-1].strip("])}")
        valid, known = 2 if len(s) <= 254 and ".." not in s else 0, 2 if label in _TLDS else 0
    elif kind == 1:
        valid = 2 if base or _IP6.fullmatch(s) or _small_parts(s) else 0
        known = 1 if digits.startswith(("0", "127", "255")) else 2
    elif kind == 2:
        valid, known = 2 if luhn(digits) else 0, 2 if _IIN.match(digits) else 0
    elif kind == 3:
        valid = 2 if 9 <= len(digits) <= 15 else 0
        known = 2 if base and _CALLING.match(digits) else 1
    elif kind == SECRET:
        valid = 2 if len(s) >= 16 and _entropy(s) >= 3 else 1
        known = 2 if _ASSIGNED.search(before.rstrip("\"'` \t").rstrip("=:> \t")) else 0
    elif kind == PERSON:
        valid = 2 if 2 <= len(s.split()) <= 3 else 1
        known = 2 if s.split()[0] in _GIVEN else 1
    else:
        valid, known = 2 if _POSTAL.match(text, b) else 1, 2
    context = 2 if _CONTEXT[KINDS[kind]].search(before) else 0 if _AGAINST.search(before) else 1
    edges = 2 if (a == 0 or not text[a - 1].isalnum()) and (b == len(text) or not text[b].isalnum()) else 0
    if kind == SECRET:
        pattern = 2 if _PREFIXED.fullmatch(s) else 1 if known else 0
    elif kind == PERSON:
        title = before.rstrip(" ").rstrip(".").rsplit(" ", 1)[-1].rsplit("\n", 1)[-1]
        pattern = 2 if title in _TITLES else 1
    else:
        pattern = 2 if base or kind == ADDRESS else 0
    size = 0 if b - a < 12 else 1 if b - a < 20 else 2 if b - a < 40 else 3
    share = min(2, 3 * len(digits) // (b - a))
    return kind, pattern, valid, known, context, edges, size, share


class Model:
    """Reliabilities of the labelers and the classifier, from counts of feature patterns."""

    def __init__(self, counts: dict[tuple[int, ...], int], rounds: int = 50, steps: int = 400):
        self.patterns = sorted(counts)
        self.reliability: dict[str, dict[str, float]] = {}
        n = len(LABELERS)
        posterior = {}
        for kind in range(len(KINDS)):
            own = [p for p in self.patterns if p[0] == kind]
            if not own:
                continue
            votes = np.array([p[1 : n + 1] for p in own])
            weight = np.array([counts[p] for p in own], float)
            # Starting point: labelers are right nine times in ten when they vote. One pseudo-count
            # of that belief per vote keeps rare kinds from running away.
            table = np.zeros((2, n, 3))
            table[1], table[0] = (0.06, 0.34, 0.6), (0.6, 0.34, 0.06)
            prior, start = 0.5, table.copy()
            for _ in range(rounds):
                logs = [np.log(table[y][np.arange(n), votes]).sum(axis=1) for y in (0, 1)]
                odds = np.log(prior) + logs[1] - np.log(1 - prior) - logs[0]
                p = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
                prior = float(np.clip((weight @ p + 1) / (weight.sum() + 2), 0.01, 0.99))
                for y, q in ((1, p), (0, 1 - p)):
                    for v in range(3):
                        table[y][:, v] = ((weight * q) @ (votes == v) + 10 * start[y][:, v]) / ((weight @ q) + 10)
            posterior |= dict(zip(own, p.tolist(), strict=True))
            # How often a labeler that votes is right.
            right = prior * table[1][:, 2] + (1 - prior) * table[0][:, 0]
            voted = 1 - prior * table[1][:, 1] - (1 - prior) * table[0][:, 1]
            self.reliability[KINDS[kind]] = dict(zip(LABELERS, (right / voted).tolist(), strict=True))
        self.weights = np.zeros(len(self._row((0,) * 8)))
        if not self.patterns:
            return
        x = np.array([self._row(p) for p in self.patterns])
        y = np.array([posterior[p] for p in self.patterns])
        w = np.sqrt([counts[p] for p in self.patterns])  # frequent patterns count more, rare ones still count
        w = w / w.sum()
        for _ in range(steps):
            p = 1 / (1 + np.exp(-x @ self.weights))
            hessian = (x * (w * np.maximum(p * (1 - p), 1e-3))[:, None]).T @ x + 1e-3 * np.eye(x.shape[1])
            step = np.linalg.solve(hessian, x.T @ (w * (y - p)) - 1e-3 * self.weights)
            self.weights += np.clip(step, -1, 1)
            if np.abs(step).max() < 1e-9:
                break

    @staticmethod
    def _row(p: tuple[int, ...]) -> np.ndarray:
        out = [1.0] + [float(p[0] == k) for k in range(len(KINDS))]
        # A labeler's vote counts by kind, besides what it counts for all.
        out += [float(v - 1) for v in p[1 : len(LABELERS) + 1]]
        out += [float(v - 1) if p[0] == k else 0.0 for k in range(len(KINDS)) for v in p[1 : len(LABELERS) + 1]]
        return np.array(out + [float(p[-2] == k) for k in range(4)] + [float(p[-1] == k) for k in range(3)])

    def probability(self, p: tuple[int, ...]) -> float:
        return float(1 / (1 + np.exp(-self._row(p) @ self.weights)))

    def spans(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """(base spans, all spans), each by kind, then start."""
        found = candidates(text)
        base = [s for s, is_base in found if is_base]
        more = [s for s, is_base in found if not is_base and self.probability(features(text, s, False)) >= ACCEPT]
        return base, sorted(base + more)


_SHAPE = ("kind", *LABELERS, "size", "share")


def train(docs: DataFrame, text: str = "text") -> Model:
    """The model from the vote patterns of all candidates of all documents."""
    def count(batches):
        for batch in batches:
            found: Counter[tuple[int, ...]] = Counter()
            for t in batch.column(0).to_pylist():
                if t:
                    found.update(features(t, s, base) for s, base in candidates(t))
            rows = list(found.items())
            yield pa.RecordBatch.from_pydict({c: pa.array([p[k] for p, _ in rows], pa.int32()) for k, c in enumerate(_SHAPE)} | {"n": pa.array([n for _, n in rows], pa.int64())})

    votes = docs.select(text).mapInArrow(count, ", ".join(f"`{c}` int" for c in _SHAPE) + ", n long")
    # At most 7 * 3^5 * 4 * 3 patterns, whatever the corpus.
    counts = {tuple(r[c] for c in _SHAPE): r["n"] for r in votes.groupBy(*_SHAPE).agg(F.sum("n").alias("n")).collect()}
    return Model(counts)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For every document: key, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_spans.

    The first four counts and the digest are of the base spans, ``spans`` names all spans, ``n_spans`` is their
    number and ``n_secret`` that of secrets among them; places are code points, ends exclusive. A null text is empty, repeated rows give equal rows, other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, text))

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {f"n_{k}": [] for k in BASE} | {"base_sha256": [], "spans": [], "n_secret": [], "n_spans": []}
            for t in batch.column(1).to_pylist():
                base, every = model.value.spans(t or "")
                n = Counter(k for k, _, _ in base)
                for k, name in enumerate(BASE):
                    out[f"n_{name}"].append(n[k])
                out["n_secret"].append(sum(k == SECRET for k, _, _ in every))
                out["n_spans"].append(len(every))
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out["spans"].append(joined(every))
            kinds = {c: pa.string() if c in ("base_sha256", "spans") else pa.int64() for c in out}
            yield pa.RecordBatch.from_pydict({key: batch.column(0)} | {c: pa.array(v, kinds[c]) for c, v in out.items()})

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_secret long, n_spans long")


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the name of its first kind."""
    out, end = [], 0
    for a, b, k in sorted((a, b, k) for k, a, b in spans):
        if a >= end:
            out += [text[end:a], f"<{KINDS[k].upper()}>"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def mask_pii(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """The documents with all spans masked; ``n_chars``, where there is one, is counted anew.

    All other columns stay as they are; null texts stay null.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, text))

    def run(batches):
        for batch in batches:
            texts = [None if t is None else masked(t, model.value.spans(t)[1]) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            out = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            out[text] = pa.array(texts, pa.string())
            if n_chars in out:
                out[n_chars] = pa.array([None if t is None else len(t) for t in texts], batch.schema.field(n_chars).type)
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return docs.mapInArrow(run, docs.schema)
