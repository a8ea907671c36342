"""Personal data in documents, by weak supervision.

``candidates`` reads each text once and lists candidate spans with the votes of some labelers: the
strict shape of the kind, a check of its value (digits, ranges, checksum), a gazetteer, words before
the span, and its neighbours. A vote is for, against or abstaining. All candidates of the corpus are
counted by kind and votes (Spark aggregates; the table is bounded by the number of vote patterns).
From these counts expectation-maximisation estimates, per kind, how often candidates are personal
data and how reliable each labeler is; its posteriors train the final span classifier, a logistic
regression over votes, kind and length. Spans of the four base patterns are always kept.

The other kinds have candidates that are often something else, so that the model decides: secrets
(values assigned to a word such as password, private keys, and any long run of mixed letters and
digits: checksums, paths and names of files look alike), names (after a title or a phrase, or a given
name before a capitalised word), account numbers, streets, social security and national phone numbers.

Nulls and odd rows: a null or empty text has no span; repeated rows are read each by themselves; a
null doc_id is passed through; empty tables give empty results and a model that accepts nothing.
Other columns are not read, or passed through by ``redact``.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseweave.llm import words as W
from caseweave.storage import keep

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "ssn", "national_phone", "name", "iban", "secret", "street")
LABELERS = ("shape", "value", "gazetteer", "before", "beside")
LENGTHS = (12, 18)  # spans are told apart by length below, between and above
ROUNDS = 50
ACCEPT = 0.5

EMAIL_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # starting amid digits would find nothing else
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NUMBERS = re.compile(r"[0-9(][0-9() .-]{7,}[0-9]")
SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
NATIONAL = re.compile(r"(?<![0-9])\(?[2-9][0-9]{2}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Señor", "Señora", "Monsieur", "Madame")
CAPITALISED = r"[A-ZÀ-ÖØ-Þ][\w'-]+"
NAME = re.compile(rf"\b(?:{'|'.join(TITLES)})\.? {CAPITALISED}(?: {CAPITALISED})?")
PHRASES = ("name is ", "Name: ", "signed by ", "Ich heiße ", "m'appelle ", "me llamo ")
NAMED = re.compile(rf"(?:{'|'.join(PHRASES)})({CAPITALISED}(?: {CAPITALISED})?)")
TWO_CAPITALISED = re.compile(rf"{CAPITALISED}(?= {CAPITALISED})")
SURNAME = re.compile(rf" {CAPITALISED}")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
RUN = re.compile(r"(?<![A-Za-z0-9_+/=.-])[A-Za-z0-9_+/.-]{16,}=*")
ASSIGNED = re.compile(r"(?i)(?:password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer)[\"']?\s{0,3}[:=]\s{0,3}[\"']?([^\s\"'<>]{6,})")
PRIVATE_KEY = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s:,-]*?-----END [A-Z ]*PRIVATE KEY-----")
STREET = re.compile(r"\b[0-9]{1,5} (?:[A-Z][\w'-]+ ){1,3}(?:Street|Avenue|Road|Boulevard|Lane|Drive|Court|Square)\b|\b[A-ZÄÖÜ][a-zäöüß-]*(?:straße|strasse|allee|platz) [0-9]{1,4}\b")
STREETS = (" Street", " Avenue", " Road", " Boulevard", " Lane", " Drive", " Court", " Square", "straße ", "strasse ", "allee ", "platz ")

# Words and codes that the gazetteer and the context labelers look up.
TOP_DOMAINS = frozenset("com org net edu gov mil int info biz io ai co uk de fr es it nl eu us ca au jp cn in br ch at be se no dk pl ru".split())
CARD_PREFIXES = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "22", "23", "24", "25", "26", "27")
CUES = {
    "email": ("email", "e-mail", "mail", "contact", "write", "correo", "courriel"),
    "ip": ("ip", "address", "host", "server", "from", "adresse"),
    "card": ("card", "visa", "mastercard", "credit", "amex", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "teléfono", "téléphone"),
    "ssn": ("ssn", "social", "security"),
    "national_phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "teléfono", "téléphone"),
    "name": ("name", "signed", "from", "by", "dear", "liebe", "cher", "estimado"),
    "iban": ("iban", "account", "konto", "compte", "cuenta", "bank", "transfer"),
    "secret": ("password", "passwd", "pwd", "passphrase", "secret", "token", "key", "credential", "auth", "bearer", "login"),
    "street": ("address", "street", "live", "lives", "home", "adresse", "wohn", "dirección", "anschrift"),
}
AGAINST = ("version", "isbn", "order", "invoice", "section", "figure", "page", "release")
CHECKSUMS = ("sha", "md5", "commit", "checksum", "digest", "hash", "revision", "uuid", "etag")
SECRET_PREFIXES = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "sk-", "sk_live_", "pk_live_", "xoxb-", "xoxp-", "eyJ", "ya29.", "-----BEGIN")
GIVEN_NAMES = frozenset(
    "Alice Anna Antonio Barbara Carlos Carmen Charles Christopher Claire David Elena Elizabeth Emily Emma Franz François George Hans Heinrich "
    "Isabel Jacques James Jane Javier Jean Jennifer Jessica John Jorge José Joseph Juan Julia Karen Karl Klaus Laura Linda Louis Luis Manuel Maria "
    "Marie Mary Michael Michel Miguel Nathalie Patricia Paul Pedro Peter Philippe Pierre Richard Robert Sarah Sophie Susan Thomas William Wolfgang".split()
)


class Span(NamedTuple):
    kind: str
    start: int  # in characters, end exclusive
    end: int
    base: bool
    pattern: int  # kind, votes and length, see _pattern


def luhn(digits: str) -> bool:
    total = 0
    for place, d in enumerate(reversed(digits)):
        n = int(d) * (1 + place % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the pattern, found from their @: what stands before it does not matter to the rest."""
    over, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > over and text[start - 1] in LOCAL:
            start -= 1
        match = EMAIL_DOMAIN.match(text, at) if start < at else None
        if match:
            over = match.end()
            yield start, over
        at = text.find("@", max(at + 1, over))


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _part(digits: str) -> int:
    """The value of a part of an address, however many zeros it begins with; 256 if it is larger than 255."""
    digits = digits.lstrip("0")
    return min(256, int(digits or "0")) if len(digits) <= 3 else 256


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base patterns by kind, then place; leftmost, without overlap within a kind."""
    found = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(_part(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return found


def _more_spans(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Candidates of the other kinds that touch no base span."""
    found = []
    for region in NUMBERS.finditer(text):
        if region.end() - region.start() < 10:
            continue
        for kind, pattern in (("ssn", SSN), ("national_phone", NATIONAL)):
            found += [(kind, *m.span()) for m in pattern.finditer(text, region.start(), region.end())]
    found += [("name", s, e) for s, e in _names(text)]
    found += [("iban", *m.span()) for m in IBAN.finditer(text)]
    found += [("secret", s, e) for s, e in _secrets(text)]
    if any(word in text for word in STREETS):
        found += [("street", *m.span()) for m in STREET.finditer(text)]
    found.sort(key=lambda x: (KINDS.index(x[0]), x[1]))
    ibans = [x for x in found if x[0] == "iban"]
    free, free_of_both = _apart_from(taken), _apart_from(taken + ibans)
    return [x for x in found if (free_of_both if x[0] == "secret" else free)(x)]


def _apart_from(taken: list[tuple[str, int, int]]) -> Callable[[tuple[str, int, int]], bool]:
    """Tells whether a span touches none of the taken ones, by bisection over their merged ranges."""
    starts: list[int] = []
    ends: list[int] = []
    for _, s, e in sorted(taken, key=lambda x: x[1]):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)

    def apart(span: tuple[str, int, int]) -> bool:
        at = bisect_right(ends, span[1])
        return at == len(ends) or span[2] <= starts[at]

    return apart


def _leftmost(spans: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Spans in order of start, the longest first; those that overlap an earlier one are dropped."""
    over = 0
    for s, e in sorted(set(spans), key=lambda x: (x[0], -x[1])):
        if s >= over:
            over = e
            yield s, e


def _names(text: str) -> Iterator[tuple[int, int]]:
    found = [m.span() for m in NAME.finditer(text)] if any(f"{t} " in text or f"{t}. " in text for t in TITLES) else []
    if any(phrase in text for phrase in PHRASES):
        found += [m.span(1) for m in NAMED.finditer(text)]
    for m in TWO_CAPITALISED.finditer(text):
        if m.group() in GIVEN_NAMES:
            found.append((m.start(), SURNAME.match(text, m.end()).end()))
    return _leftmost(found)


def _secrets(text: str) -> Iterator[tuple[int, int]]:
    """Values that a word such as password is set to, private keys, and long runs of letters and digits."""
    found = [m.span() for m in PRIVATE_KEY.finditer(text)] if "PRIVATE KEY-----" in text else []
    if "=" in text or ":" in text:
        found += [m.span(1) for m in ASSIGNED.finditer(text)]
    for m in RUN.finditer(text):
        run = m.group().rstrip(".-/")
        if any("0" <= c <= "9" for c in run) and any(c.isalpha() for c in run) and len(run) >= 16:
            found.append((m.start(), m.start() + len(run)))
    return _leftmost(found)


def _bits(span: str) -> float:
    """Entropy of the characters of a span, in bits per character."""
    return -sum(n / len(span) * math.log2(n / len(span)) for n in Counter(span).values())


def _mod_97(iban: str) -> bool:
    rest = 0
    for c in iban[4:] + iban[:4]:
        rest = (rest * (100 if c.isalpha() else 10) + int(c, 36)) % 97
    return rest == 1


def _votes(text: str, kind: str, start: int, end: int) -> tuple[int, ...]:
    span, digits = text[start:end], _digits(text[start:end])
    shape = value = gazetteer = 0
    if kind == "email":
        shape = 1 if span[0].isalnum() and ".." not in span else -1
        value = 1 if len(span) <= 254 and span.index("@") <= 64 else -1
        gazetteer = 1 if span.rpartition(".")[2].lower() in TOP_DOMAINS else 0
    elif kind == "ip":
        parts = [_part(p) for p in span.split(".")]
        shape = 1 if all(str(n) == p for n, p in zip(parts, span.split("."), strict=True)) else -1
        value = 1 if 0 < parts[0] < 240 else -1
        gazetteer = -1 if parts[0] in (0, 127) else 0
    elif kind == "card":
        shape = 1 if re.fullmatch(r"[0-9]{13,19}|([0-9]{4}[ -]){3}[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}", span) else -1
        value = 1 if luhn(digits) else -1
        gazetteer = 1 if digits.startswith(CARD_PREFIXES) else -1
    elif kind in ("phone", "national_phone"):
        shape = 1 if re.fullmatch(r"(\+[0-9]{1,3}[ .-]?)?\(?[0-9]{2,4}\)?([ .-]?[0-9]{2,4}){2,4}", span) else 0
        value = 1 if 9 <= len(digits) <= 15 else -1
        gazetteer = -1 if len(set(digits)) < 3 else 0
    elif kind == "ssn":
        shape, value = 1, 1 if digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000" else -1
    elif kind == "name":
        first = span.split(" ")[0].rstrip(".")
        shape = 1 if len(span.split(" ")) > 1 else -1
        value = 1 if first in TITLES else 0
        gazetteer = 1 if not GIVEN_NAMES.isdisjoint(span.split(" ")) else 0
    elif kind == "iban":
        shape = 1 if 15 <= len(span.replace(" ", "")) <= 34 else -1
        value = 1 if _mod_97(span.replace(" ", "")) else -1
    elif kind == "secret":
        known = span.startswith(SECRET_PREFIXES)
        words = max(map(len, re.findall("[A-Za-z]+", span)), default=0)
        shape = 1 if known or re.fullmatch(r"[0-9A-Fa-f]{24,}|[A-Za-z0-9+/_-]{20,}=*", span) and words < 10 else -1
        value = 1 if _bits(span) >= min(3.5, 0.7 * math.log2(len(span))) else -1
        gazetteer = 1 if known else -1 if any(word in text[max(0, start - 16) : start].lower() for word in CHECKSUMS) else 0
    else:
        shape = 1
        gazetteer = 1 if len(span.split(" ")) > 2 else 0
    near = text[max(0, start - 40) : start].lower()
    before = 1 if any(cue in near for cue in CUES[kind]) else -1 if any(cue in near for cue in AGAINST) else 0
    left, right = text[start - 1 : start], text[end : end + 1]
    if kind == "secret":  # a secret is named and stands in quotes or behind a sign; without these a run is more likely a name or a checksum
        return shape, value, gazetteer, before or -1, 1 if left in tuple("\"'=:`") or right in tuple("\"'`") else -1
    beside = -1 if left.isalnum() or right.isalnum() or left in tuple("/=#_") or right in tuple("/=#_") else 1
    return shape, value, gazetteer, before, beside


def _pattern(kind: str, votes: tuple[int, ...], length: int) -> int:
    code = KINDS.index(kind)
    for vote in votes:
        code = code * 3 + vote + 1
    return code * 3 + sum(length > most for most in LENGTHS)


def _unpack(pattern: int) -> tuple[int, list[int], int]:
    pattern, size = divmod(pattern, 3)
    votes: list[int] = []
    for _ in LABELERS:
        pattern, vote = divmod(pattern, 3)
        votes.insert(0, vote - 1)
    return pattern, votes, size


def spans_of(text: str | None) -> list[Span]:
    if not text:
        return []
    base = base_spans(text)
    every = [(*x, True) for x in base] + [(*x, False) for x in _more_spans(text, base)]
    return [Span(kind, s, e, is_base, _pattern(kind, _votes(text, kind, s, e), e - s)) for kind, s, e, is_base in every]


SPANS = "array<struct<kind: string, start: int, end: int, base: boolean, pattern: int>>"


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("pattern", pa.int32())]))
    for batch in W.pieces(batches):
        lists = [[s._asdict() for s in spans_of(text)] for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lists, kind)], names=["doc_id", "spans"])


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): the candidate spans of every text by kind, then place."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_found, f"doc_id long, spans {SPANS}")


class Model(NamedTuple):
    reliability: dict[str, dict[str, tuple[float, float]]]  # kind, labeler: right on personal data, right on the rest
    share: dict[str, float]  # of candidates of a kind that are personal data
    probability: dict[int, float]  # by pattern, from the span classifier

    @property
    def accepted(self) -> set[int]:
        return {p for p, value in self.probability.items() if value >= ACCEPT}


def estimate(counts: dict[int, int]) -> tuple[dict, dict, dict[int, float]]:
    """Expectation-maximisation over counted vote patterns: reliabilities, shares, posteriors."""
    reliability: dict = {}
    share: dict = {}
    posterior: dict[int, float] = {}
    for k, kind in enumerate(KINDS):
        own = sorted(p for p in counts if _unpack(p)[0] == k)
        if not own:
            continue
        votes, n = np.array([_unpack(p)[1] for p in own]), np.array([counts[p] for p in own], float)
        right = np.full((2, len(LABELERS)), 0.8)  # on personal data, on the rest
        prior = 0.5
        for _ in range(ROUNDS):
            yes = np.log(prior) + np.where(votes == 1, np.log(right[0]), np.where(votes == -1, np.log(1 - right[0]), 0)).sum(1)
            no = np.log(1 - prior) + np.where(votes == -1, np.log(right[1]), np.where(votes == 1, np.log(1 - right[1]), 0)).sum(1)
            p = 1 / (1 + np.exp(np.clip(no - yes, -500, 500)))
            # four made-up right votes and one wrong one keep a labeler better than chance where data are few
            for side, weight, vote in ((0, n * p, 1), (1, n * (1 - p), -1)):
                right[side] = (4 + (weight[:, None] * (votes == vote)).sum(0)) / (5 + (weight[:, None] * (votes != 0)).sum(0))
            prior = float((1 + (n * p).sum()) / (2 + n.sum()))
        reliability[kind] = {name: (float(right[0, j]), float(right[1, j])) for j, name in enumerate(LABELERS)}
        share[kind] = prior
        posterior |= dict(zip(own, p.tolist(), strict=True))
    return reliability, share, posterior


def _features(pattern: int) -> np.ndarray:
    kind, votes, size = _unpack(pattern)
    x = np.zeros(1 + len(KINDS) + 2 * len(LABELERS) + 3)
    x[0] = x[1 + kind] = x[-1 - size] = 1
    for j, vote in enumerate(votes):
        if vote:
            x[1 + len(KINDS) + 2 * j + (vote < 0)] = 1
    return x


def train(counts: dict[int, int], posterior: dict[int, float], penalty: float = 1.0) -> dict[int, float]:
    """The span classifier: logistic regression on the posteriors, weighted by counts (Newton steps)."""
    if not counts:
        return {}
    own = sorted(counts)
    x, y, n = np.array([_features(p) for p in own]), np.array([posterior[p] for p in own]), np.array([counts[p] for p in own], float)
    weights = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (n * (y - p)) - penalty * weights
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(weights))
        step = np.linalg.solve(curve, slope)
        weights += step / max(1.0, float(np.abs(step).max()) / 4)
    return dict(zip(own, (1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))).tolist(), strict=True))


def fit(found: DataFrame) -> Model:
    """The model of a corpus from its candidates. What reaches the driver is a count per pattern, at
    most 3 per length and vote pattern of a kind, however large the corpus is."""
    by_pattern = found.select(F.explode("spans.pattern").alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n"))
    counts = {row.pattern: row.n for row in by_pattern.collect()}
    reliability, share, posterior = estimate(counts)
    return Model(reliability, share, train(counts, posterior))


def report(docs: DataFrame) -> DataFrame:
    """One row per document: counts and digest of the base spans, and all spans that are kept."""
    found = keep(candidates(docs), "spans")
    accepted = F.array(*(F.lit(p) for p in sorted(fit(found).accepted))).cast("array<int>")
    text = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("spans", lambda s: s["base"])
    final = F.filter("spans", lambda s: s["base"] | F.array_contains(accepted, s["pattern"]))

    def of_kind(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id", *(of_kind(kind).alias(f"n_{kind}") for kind in BASE_KINDS),
        F.sha2(F.array_join(F.transform(base, text), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform(final, text), ",").alias("spans"),
    )


def mask(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in brackets; spans that touch become one."""
    out, over = [], 0
    for span in sorted(spans, key=lambda s: (s.start, -s.end)):
        if span.start >= over:
            out += [text[over : span.start], f"[{span.kind.upper()}]"]
        over = max(over, span.end)
    return "".join([*out, text[over:]])


def _redacted(accepted: set[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def redacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches):
            place = batch.schema.get_field_index("text")
            texts = batch.column(place).to_pylist()
            clean = [t and mask(t, [s for s in spans_of(t) if s.base or s.pattern in accepted]) for t in texts]
            columns = [*batch.columns]
            columns[place] = pa.array(clean, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return redacted


def redact(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The documents with personal data masked in ``text``; all columns stay, ``n_chars`` is counted anew.

    Without a model one is fitted to these documents.
    """
    model = model or fit(keep(candidates(docs), "spans"))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema])
    masked = docs.mapInArrow(_redacted(model.accepted), schema)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked
