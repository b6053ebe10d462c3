"""Personal data by candidate gradient boosting.

High-recall generators propose spans, which may overlap: the four base patterns, looser forms of the same
kinds (obfuscated addresses, local phone numbers, bracketed IP addresses, failing numbers), and kinds without a base pattern: secrets (what a
word like token is given, long runs of letters and digits), account numbers, national ids, postal addresses. Boosted trees score each candidate
by its format and context. They are fitted on a bounded sample of documents, in which base matches are positive, as are the same matches
rewritten into looser forms where they stand, and candidates that fail the base checks and damaged matches are negative; and on written
forms of the other kinds (``pii_forms``). A threshold for each form is set on held-out candidates so that a stated precision holds there.
Base matches are always selected; others when they pass their threshold, the best first, where they overlap nothing selected.

Cases: null and empty texts have no spans; repeated rows are searched one by one; texts of any length are read whole in
linear time; an empty table gives an empty result (and, with no documents to fit, the trees of the written forms); other columns are
ignored by ``pii_spans`` and passed through by ``redact``.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pii_forms import examples, iban_ok, id_ok

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "iban", "national_id", "address")

# The base patterns. The digit before an IP address is excluded by a look-behind, which changes no
# match (it would only begin inside a run of digits) but keeps long runs linear.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# Texts that may hold base matches or such as fail their checks, for Spark's rlike
_HOLDS = {
    "email": r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]+\.[A-Za-z0-9-]",
    "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]",
    "card": r"[0-9](?:[ -]?[0-9]){12}",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}

# Looser forms: (form, kind, pattern)
_AT = re.compile(r"[\[({] ?(?:at|AT|At) ?[\])}]")
_AT_DOMAIN = re.compile(r" ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[({] ?(?:dot|DOT|Dot) ?[\])}]) ?[A-Za-z0-9-]{1,63})+")
_LOOSE_PHONE = re.compile(r"(?<![0-9A-Za-z+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])")
_LONG_PHONE = re.compile(r"(?<![0-9A-Za-z+.])00[ -]?[1-9][0-9 ()-]{7,16}[0-9](?![0-9A-Za-z])")
_LOOSE_IP = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)| \. )[0-9]{1,3}){3}(?![0-9.])")
# Kinds without a base pattern
_RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}")
_SECRET_WORD = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|secret[_-]?key|auth|credentials?)[\"']?\s{0,2}$")
#: How such a value begins, and how it goes on: of any length, but read on only where a word for a secret stands before it.
_ASSIGNED = re.compile(r"[=:]\s{0,2}[\"']?([^\s\"'<>]{8,200})")
_ON = re.compile(r"[^\s\"'<>]*")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_CHECKED = re.compile(r"(?<![0-9A-Za-z-])(?:[0-9]{8}-?[A-Z]|[12] ?[0-9]{2} ?[01][0-9] ?[0-9]{2} ?[0-9]{3} ?[0-9]{3} ?[0-9]{2})(?![0-9A-Za-z-])")
_ADDRESS = re.compile(
    r"(?<![0-9A-Za-z])[0-9]{1,5} (?:[A-Z][a-z\u00e0-\u00ff]+ ){1,3}(?:Street|Avenue|Road|Lane|Drive|Boulevard|Court|Way|Place)\b"
    r"|\b[A-Z\u00c4\u00d6\u00dc][a-z\u00e4\u00f6\u00fc\u00df]{1,30}(?:stra\u00dfe|strasse|weg|platz|allee|gasse) [0-9]{1,4}[a-z]?\b"
    r"|\b(?:rue|avenue|calle|avenida|plaza) (?:d[eu] |de la |des |del )?[A-Z][A-Za-z\u00c0-\u00ff]+,? [0-9]{1,5}\b"
)
FORMS = ("base", "at_words", "local_phone", "long_phone", "split_ip", "failing", "assigned", "long_run", "iban", "ssn", "checked_id", "address")


@dataclass(frozen=True)
class PiiOptions:
    """The trees are fitted on ``sample_docs`` documents at most, of ``sample_chars`` characters at most, drawn by a hash from
    those that give training rows; documents of a rare kind are drawn with a greater share. written: examples of each line of ``pii_forms``."""

    sample_docs: int = 4000
    sample_chars: int = 20_000
    written: int = 30
    rounds: int = 60
    depth: int = 3
    rate: float = 0.3
    precision: float = 0.99


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _local_start(text: str, at: int, least: int) -> int:
    start = at
    while start > least and text[start - 1] in _LOCAL:
        start -= 1
    return start


def candidates(text: str) -> list[tuple[int, str, int, str]]:
    """Proposed spans (start, kind, end, form)."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start, domain = _local_start(text, at, done), _DOMAIN.match(text, at)
        if start < at and domain:
            done = domain.end()
            out.append((start, "email", done, "base"))
        at = text.find("@", max(at + 1, done))
    if "at" in text or "AT" in text or "At" in text:
        for m in _AT.finditer(text):
            before = m.start() - (m.start() > 0 and text[m.start() - 1] == " ")
            start, domain = _local_start(text, before, max(0, before - 64)), _AT_DOMAIN.match(text, m.end())
            if start < before and domain:
                out.append((start, "email", domain.end(), "at_words"))
    at = 0
    # what a word for a secret is given
    while m := _ASSIGNED.search(text, at):
        if _SECRET_WORD.search(text, max(0, m.start() - 24), m.start()):
            at = _ON.match(text, m.end()).end()
            end = m.start(1) + len(text[m.start(1) : at].rstrip(".,;)]}"))
            out.append((m.start(1), "secret", end, "assigned"))
        else:
            at = m.start() + 1
    if not _DIGIT.search(text):
        return out
    assigned = {c[0] for c in out if c[3] == "assigned"}
    for m in _RUN.finditer(text):
        if m.start() not in assigned and _DIGIT.search(m.group()) and any(c.isalpha() for c in m.group()):
            out.append((m.start(), "secret", m.end(), "long_run"))
    for kind, form, pattern in (("iban", "iban", _IBAN), ("national_id", "ssn", _SSN), ("national_id", "checked_id", _CHECKED), ("address", "address", _ADDRESS)):
        out += [(m.start(), kind, m.end(), form) for m in pattern.finditer(text)]
    for m in _IP.finditer(text):
        good = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))
        out.append((m.start(), "ip", m.end(), "base" if good else "failing"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            d = _digits(m.group())
            if len(d) >= 13:
                out.append((m.start(), "card", m.end(), "base" if 14 <= len(d) <= 19 and luhn(d) else "failing"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            out.append((m.start(), "phone", m.end(), "base" if 10 <= len(_digits(m.group())) <= 15 else "failing"))
    out += [(m.start(), "phone", m.end(), "local_phone") for m in _LOOSE_PHONE.finditer(text)]
    out += [(m.start(), "phone", m.end(), "long_phone") for m in _LONG_PHONE.finditer(text)]
    out += [(m.start(), "ip", m.end(), "split_ip") for m in _LOOSE_IP.finditer(text)]
    return out


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    """What the trees see of a candidate: its format and the text around it."""
    span, left, right = text[start:end], text[max(0, start - 24) : start], text[end : end + 24]
    d = _digits(span)
    parts = [int(p) for p in re.findall(r"[0-9]{1,6}", span)]
    near = left[-1:] + right[:1]
    word = left.rstrip().rpartition(" ")[2]
    return [
        float(KINDS.index(kind)),
        float(len(span)),
        float(len(d)),
        float(luhn(d)) if d else 0.0,
        float(max(parts, default=-1)),
        float(len(parts)),
        float(sum(not c.isalnum() for c in span)),
        float(span.count(".")),
        float(span.count("(") + span.count("[") + span.count("{")),
        float(span[:1] == "+"),
        float(sum(c.isalpha() for c in span)),
        float(len(set(d))),
        float(len(last) if (last := re.split(r"[^A-Za-z0-9]", span.rstrip("])} "))[-1]).isalpha() else 0),
        float(any(c.isalnum() for c in near)),
        float(any(c in "=\"'/#$%&_" for c in near)),
        float(left[-1:].isspace() or not left),
        float(right[:1].isspace() or right[:1] in ".,;!?" or not right),
        float(len(word)),
        float(sum(c.isdigit() for c in left)),
        float(sum(c.isdigit() for c in right)),
        float(bool(re.search(r"(?i)version|licen|token|hash|key|id\b|isbn|no\.", left))),
        float(bool(re.search(r"(?i)mail|contact|write|phone|tel|call|mobil|fax|addr|host|card|visa", left))),
        _entropy(span),
        float(sum(c in "0123456789abcdef" for c in span)) / max(1, len(span)),
        float(sum(c.isupper() for c in span)),
        float(span.count("_") + span.count("-") + span.count("/")),
        float(iban_ok(span)) if kind == "iban" else float(id_ok(span)),
        float(bool(re.search(r"(?i)token|secret|passw|pwd|key|auth|bearer|credential", left))),
        float(bool(re.search(r"(?i)commit|sha|md5|checksum|hash|digest|order|part|model|page|version|figure|kapitel|ref|code|invoice|catalog", left))),
        float(bool(re.search(r"(?i)ssn|social|s\u00e9curit|dni|n\u00e9e? |iban|account|konto|compte|cuenta|pay|lives|wohnt|habit|vive|send|adress", left))),
        float(any(c in "()*{}" for c in span)),
    ]


def _entropy(text: str) -> float:
    """Bits for each character, by the text's own frequencies."""
    n = len(text)
    return -sum(k / n * math.log2(k / n) for k in Counter(text).values()) if n else 0.0


# ---- boosted trees


class BoostedTrees:
    """Logistic gradient boosting of small regression trees over binned features."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32):
        self.rounds, self.depth, self.rate, self.bins = rounds, depth, rate, bins
        self.trees: list[list[tuple]] = []
        self.bias = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        p = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.bias = float(np.log(p / (1 - p)))
        score = np.full(len(y), self.bias)
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1], method="lower")) for c in x.T]
        binned = np.stack([np.searchsorted(cuts[f], x[:, f], "left") for f in range(x.shape[1])], 1)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-score))
            tree: list[tuple] = []
            self._grow(tree, binned, cuts, y - q, q * (1 - q) + 1e-9, np.arange(len(y)), self.depth)
            self.trees.append(tree)
            score += self._one(tree, x)
        return self

    def _grow(self, tree, binned, cuts, gradient, weight, rows, depth) -> int:
        """Appends the node of some rows: (feature, cut, left, right) or (-1, value, 0, 0)."""
        me, g, h = len(tree), gradient[rows].sum(), weight[rows].sum()
        tree.append((-1, float(self.rate * g / (h + 1.0)), 0, 0))
        if depth == 0 or len(rows) < 20:
            return me
        best = (1e-6, -1, 0)
        for f in range(binned.shape[1]):
            n = len(cuts[f]) + 1
            gl = np.cumsum(np.bincount(binned[rows, f], gradient[rows], n))[:-1]
            hl = np.cumsum(np.bincount(binned[rows, f], weight[rows], n))[:-1]
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            if len(gain) and gain.max() > best[0]:
                best = (float(gain.max()), f, int(gain.argmax()))
        if best[1] >= 0:
            left = binned[rows, best[1]] <= best[2]
            if 0 < left.sum() < len(rows):
                a = self._grow(tree, binned, cuts, gradient, weight, rows[left], depth - 1)
                b = self._grow(tree, binned, cuts, gradient, weight, rows[~left], depth - 1)
                tree[me] = (best[1], float(cuts[best[1]][best[2]]), a, b)
        return me

    @staticmethod
    def _one(tree: list[tuple], x: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(x)), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            f, value, a, b = tree[node]
            if f < 0:
                out[rows] = value
            elif len(rows):
                left = x[rows, f] <= value
                todo += [(a, rows[left]), (b, rows[~left])]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities before calibration."""
        total = np.full(len(x), self.bias)
        for tree in self.trees:
            total += self._one(tree, x)
        return 1 / (1 + np.exp(-total))


def _loosened(span: str, kind: str, turn: int) -> tuple[str, str] | None:
    """A base match in a looser form of its kind, and the form's name."""
    if kind == "email":
        local, _, domain = span.partition("@")
        at, dot = ((" (at) ", "."), (" [at] ", " [dot] "), ("(at)", "(dot)"))[turn % 3]
        return local[-30:] + at + domain.replace(".", dot), "at_words"
    d = _digits(span)
    if kind == "phone" and len(d) >= 10:
        n = d[-10:]
        if turn % 3 == 2:
            return f"00{d[0]} {d[1:4]} {d[4:]}", "long_phone"
        return (f"({n[:3]}) {n[3:6]}-{n[6:]}" if turn % 3 else f"{n[:3]}-{n[3:6]}-{n[6:]}"), "local_phone"
    if kind == "ip":
        return span.replace(".", ("[.]", "(.)")[turn % 2]), "split_ip"
    return None


def _damaged(left: str, loose: tuple[str, str], right: str) -> list[tuple[str, str, str]]:
    """Places where a loose form stands in something else, or lacks what makes it one: (before, form, after)."""
    body, form = loose
    if form == "at_words":
        local = re.split(r" ?[\[(]at", body)[0]
        return [(left, f"{local} (at) {n}", right) for n in ("3.50", "10.15", "a.b", "7 . 30")]
    return [(left + '"id=', body, '"' + right), (left, body, "/7" + right), (left + "4" * 9 + " ", body, " " + "8" * 9 + right), (left + "hash #", body, right)]


def training_rows(texts: list[str], each: int = 30) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Features, labels, forms and whether a row sets thresholds: base matches and loosened ones are positive; failing and damaged ones
    negative. Kinds without a base pattern come from written forms, ``each`` of a line, as far as the generators propose them."""
    x, y, forms, held = [], [], [], []
    turn_of = np.random.default_rng(0)

    def add(text, start, end, kind, form, label, later=None):
        x.append(features(text, start, end, kind))
        y.append(label)
        forms.append(form)
        held.append(turn_of.random() < 0.5 if later is None else later)

    for text, start, end, kind, form, label, later in examples(each):
        for s, k, e, f in candidates(text):
            if f == form and k == kind and s < end and e > start:
                add(text, s, e, k, f, int(label and s == start and e == end), later)

    for text in texts:
        for turn, (start, kind, end, form) in enumerate(candidates(text)):
            span, left, right = text[start:end], text[max(0, start - 60) : start], text[end : end + 60]
            if form == "failing":
                add(text, start, end, kind, form, 0)
            elif form == "base":
                add(text, start, end, kind, form, 1)
                if loose := _loosened(span, kind, turn):
                    text_b = left + loose[0] + right
                    for s, k, e, f in candidates(text_b):
                        if f == loose[1] and k == kind and s <= len(left) + 1 and e >= len(left) + len(loose[0]) - 1:
                            add(text_b, s, e, k, f, 1)
                    # the same form where it is part of something else
                    for before, body, after in _damaged(left, loose, right):
                        text_c = before + body + after
                        for s, k, e, f in candidates(text_c):
                            if f == loose[1] and s >= len(before) - 12:
                                add(text_c, s, e, k, f, 0)
    width = len(features("", 0, 0, "ip"))
    return np.array(x, float).reshape(-1, width), np.array(y, float), forms, np.array(held, bool)


@dataclass
class PiiModel:
    """Trees and, for each form, the least probability that is selected."""

    trees: BoostedTrees | None
    thresholds: dict[str, float]

    def select(self, text: str | None) -> list[tuple[int, str, int, str]]:
        """Selected spans (start, kind, end, form), by start, then kind as listed."""
        found = candidates(text or "")
        chosen = [c for c in found if c[3] == "base"]
        rest = [c for c in found if c[3] in self.thresholds] if self.trees else []
        if rest:
            p = self.trees.score(np.array([features(text, s, e, k) for s, k, e, _ in rest], float))
            for _, c in sorted((-q, c) for q, c in zip(p, rest, strict=True) if q >= self.thresholds[c[3]]):
                if all(c[2] <= s or e <= c[0] for s, _, e, _ in chosen):
                    chosen.append(c)
        return sorted(chosen, key=lambda c: (c[0], KINDS.index(c[1]), c[2]))


def fit_model(texts: list[str], options: PiiOptions) -> PiiModel:
    """Trees fitted on half of the candidates; thresholds that reach the precision on the other half.

    Forms without enough held-out candidates of both labels, and failing base matches, are never selected."""
    x, y, forms, held = training_rows(texts, options.written)
    if len(y) < 40 or len(set(y[~held])) < 2:
        return PiiModel(None, {})
    trees = BoostedTrees(options.rounds, options.depth, options.rate).fit(x[~held], y[~held])
    p, thresholds = trees.score(x), {}
    for form in FORMS:
        if form in ("base", "failing"):
            continue
        mine = held & np.array([f == form for f in forms])
        if y[mine].sum() >= 10:
            order = np.argsort(-p[mine], kind="stable")
            good = np.cumsum(y[mine][order]) >= options.precision * np.arange(1, len(order) + 1)
            last = np.flatnonzero(good & np.append(p[mine][order][1:] < p[mine][order][:-1], True))
            if len(last):
                thresholds[form] = max(0.5, float(p[mine][order][last[-1]]))
    return PiiModel(trees, thresholds)


# ---- on Spark


def train(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", options: PiiOptions | None = None) -> PiiModel:
    """Fits on a bounded sample of documents (see PiiOptions)."""
    options = options or PiiOptions()
    rows = docs.select(docs[id_column].cast("string").alias("id"), docs[text_column].cast("string").alias("text")).filter(F.length("text") <= options.sample_chars)
    holds = {kind: F.col("text").rlike(pattern) for kind, pattern in _HOLDS.items()}
    rows = rows.withColumns(holds).filter(" OR ".join(BASE_KINDS))
    total, *by_kind = rows.agg(F.count("*"), *(F.count_if(k) for k in BASE_KINDS)).first()
    # a document's share: the sample's in all; an eighth of the sample's in those of its kind, if more
    shares = [F.lit(options.sample_docs / max(1, total)), *(F.when(F.col(k), F.lit(options.sample_docs / 8 / max(1, n))).otherwise(0.0) for k, n in zip(BASE_KINDS, by_kind, strict=True))]
    place = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 31)) / F.lit(float(1 << 31)) / F.greatest(*shares)
    rows = rows.select(place.alias("place"), "id", "text")
    drawn = rows.filter("place < 1.25") if total > options.sample_docs else rows
    return fit_model([r.text for r in drawn.orderBy("place", "id", "text").limit(options.sample_docs).collect()], options)


def render(spans: list[tuple]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e, *_ in spans)


def pii_spans(docs: DataFrame, model: PiiModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each document: counts of base matches by kind, their digest, and all selected spans."""
    rows = docs.select(docs[id_column].alias("id"), docs[text_column].cast("string").alias("text"))
    counts = [f"n_{k}" for k in BASE_KINDS]
    fields = [*((c, T.LongType()) for c in counts), ("base_sha256", T.StringType()), ("spans", T.StringType()), ("n_added", T.LongType())]
    schema = T.StructType([T.StructField(id_column, rows.schema["id"].dataType), *(T.StructField(n, t) for n, t in fields)])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        select = shared.value.select
        for batch in batches:
            columns: list[list] = [[] for _ in fields]
            for text in batch.column(1):
                spans = select(text.as_py())
                base = [s for s in spans if s[3] == "base"]
                for column, kind in zip(columns, BASE_KINDS, strict=False):
                    column.append(sum(s[1] == kind for s in base))
                columns[-3].append(hashlib.sha256(render(base).encode()).hexdigest())
                columns[-2].append(render(spans))
                columns[-1].append(len(spans) - len(base))
            kinds = [pa.string() if isinstance(t, T.StringType) else pa.int64() for _, t in fields]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, kinds)], names=schema.names)

    return rows.mapInArrow(search, schema)


def redacted(text: str, spans: list[tuple]) -> str:
    """The text with each run of overlapping spans replaced by the kind of its first."""
    out, at = [], 0
    for start, kind, end, *_ in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: PiiModel, text_column: str = "text", length_column: str | None = "n_chars") -> DataFrame:
    """The documents with personal data replaced; the length column, where there is one, follows the new text."""
    place = docs.columns.index(text_column)
    size = docs.columns.index(length_column) if length_column in docs.columns else None
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        select = shared.value.select
        for batch in batches:
            texts = batch.column(place).to_pylist()
            new = [t if not t or not (s := select(t)) else redacted(t, s) for t in texts]
            columns = list(batch.columns)
            columns[place] = pa.array(new, columns[place].type)
            if size is not None:
                lengths = [n if a == b else len(b) for n, a, b in zip(columns[size].to_pylist(), texts, new, strict=True)]
                columns[size] = pa.array(lengths, columns[size].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(clean, docs.schema)
