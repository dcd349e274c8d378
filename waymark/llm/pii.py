"""PII: regular expressions propose spans, checksums confirm them, words nearby adjust the score.

Kinds and what confirms them. Base kinds, which always stay: email; ip (four parts of at most 255); card (13 to 19 digits,
Luhn); phone (international, 9 to 15 digits). Added kinds, kept from MIN_SCORE on: iban (country code, length, mod-97),
ssn (three groups, no group of zeros), tel (national number: needs a word such as tel or call beside it), secret (a long mixed value
after a word such as token or password). A score starts at the kind's prior and gains CONTEXT for a context word among the
WINDOW characters before the span or the AFTER characters behind it, told at the bounds of words. Each kind's matches are leftmost and don't overlap one another.

Whole texts are scanned in their task, in time linear in their length: searches are anchored at a character that a match must
hold ("@", "+") or can't begin within a run. Offsets count code points, ends are exclusive.

Defined results: null or empty text: no spans. Repeated rows: one result each. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from waymark.llm.common import table

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "tel", "secret")
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.4, "tel": 0.2, "secret": 0.3}
CONTEXT, WINDOW, AFTER, MIN_SCORE = 0.4, 40, 20, 0.6
#: Whole words, or with a star beginnings of words.
WORDS = {
    "email": "mail* email* e-mail* contact* write reach schreib* correo* courriel*",
    "ip": "ip ipv4 host* server* address* addr*",
    "card": "card* visa mastercard amex credit* karte* kreditkarte* carte* tarjeta*",
    "phone": "phone* tel telephone* telefon* telef* call* mobile* cell fax anruf* ruf rufen llam* appel*",
    "iban": "iban account* konto* compte* cuenta*",
    "ssn": "ssn social security",
    "tel": "phone* tel telephone* telefon* telef* call* mobile* fax whatsapp",
    "secret": "token* secret* password* passwd api_key* apikey* key keys",
}
_NEAR = {k: re.compile("|".join(rf"(?<![^\W_]){re.escape(w.rstrip('*'))}" + ("" if w.endswith("*") else r"(?![^\W_])") for w in v.split())) for k, v in WORDS.items()}

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Each begins with a character class, which the search skips to quickly, and looks behind it from there.
_IP = re.compile(r"[0-9](?<![0-9].)[0-9]*+(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"[A-Z](?<![A-Za-z0-9].)[A-Z][0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"[0-9](?<![0-9-].)[0-9]{2}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_TEL = re.compile(r"[(0-9](?<![0-9+.-].)(?:(?<=\()[0-9]{2,5}\)|(?<=[0-9])[0-9]{1,4})[ /-][0-9]{3,4}[ -]?[0-9]{3,4}(?![0-9.-])")
_SECRET = re.compile(r"\b(?:token|secret|password|passwd|api_?key|access_?key)\b[\"']?\s{0,3}[=:]\s{0,3}[\"']?([A-Za-z0-9_\-/+=.]{12,512})", re.I)
_SPACED = re.compile(r"[ -]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if i % 2:
            x = 2 * x - 9 if x > 4 else 2 * x
        total += x
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The check of ISO 13616: letters as 10 to 35, the first four characters last."""
    x = iban.replace(" ", "")
    return 15 <= len(x) <= 34 and int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def emails(t: str):
    done, at = 0, t.find("@")
    while at >= 0:
        start = at
        while start > done and t[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(t, at) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = t.find("@", max(at + 1, done))


def phones(t: str):
    at = t.find("+")
    while at >= 0:
        m = _PHONE.match(t, at)
        if m:
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                yield at, m.end()
            at = t.find("+", m.end())
        else:
            at = t.find("+", at + 1)


def base_spans(t: str) -> dict[str, list[tuple[int, int]]]:
    """The base kinds' confirmed spans."""
    out = {"email": list(emails(t)), "ip": [], "card": [], "phone": list(phones(t))}
    if "." in t:
        out["ip"] = [m.span() for m in _IP.finditer(t) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(t):
        if 13 <= m.end() - m.start():
            d = _SPACED.sub("", m[0])
            if 13 <= len(d) <= 19 and luhn(d):
                out["card"].append(m.span())
    return out


def score(kind: str, t: str, start: int, end: int) -> float:
    """The prior, and more for a context word on either side; a word that the window cuts doesn't count."""
    low, high = max(0, start - WINDOW), min(len(t), end + AFTER)
    before, after = t[low:start].lower(), t[end:high].lower()
    if low and t[low - 1].isalnum():
        before = re.sub(r"^[^\W_]+", "", before)
    if high < len(t) and t[high].isalnum():
        after = re.sub(r"[^\W_]+$", "", after)
    return min(1.0, PRIOR[kind] + CONTEXT * bool(_NEAR[kind].search(before) or _NEAR[kind].search(after)))


def added_spans(t: str) -> dict[str, list[tuple[int, int]]]:
    """The added kinds' spans whose score, with the words before them, is high enough."""
    found = {k: [] for k in ADDED}
    found["iban"] = [m.span() for m in _IBAN.finditer(t) if mod97(m[0])]
    found["ssn"] = [m.span() for m in _SSN.finditer(t) if m[0][:3] not in ("000", "666") and m[0] < "900" and m[0][4:6] != "00" and m[0][7:] != "0000"]
    found["tel"] = [m.span() for m in _TEL.finditer(t) if 7 <= sum(c.isdigit() for c in m[0]) <= 13]
    found["secret"] = [m.span(1) for m in _SECRET.finditer(t) if any(c.isdigit() for c in m[1]) and any(c.isalpha() for c in m[1])]
    return {k: [s for s in v if score(k, t, *s) >= MIN_SCORE] for k, v in found.items()}


def spans(t: str) -> dict[str, list[tuple[int, int]]]:
    return base_spans(t) | added_spans(t)


def joined(found: dict[str, list[tuple[int, int]]], kinds) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in found[k])


def redacted(t: str) -> str:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first stands."""
    out, at = [], 0
    for a, b, k in sorted((a, b, k) for k, v in spans(t).items() for a, b in v):
        if a >= at:
            out += [t[at:a], f"[{k.upper()}]"]
            at = b
    return "".join([*out, t[at:]])


_RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, scores array<double>"


def _found(batches):
    names = [x.split()[0] for x in _RESULT.split(", ")]
    for batch in batches:
        ids = batch.column(batch.schema.names.index("doc_id"))
        rows = []
        for x in batch.column(batch.schema.names.index("text")):
            t = x.as_py() or ""
            base = base_spans(t)
            both = base | added_spans(t)
            scores = [score(k, t, *s) for k in (*BASE, *ADDED) for s in both[k]]
            rows.append((*(len(base[k]) for k in BASE), hashlib.sha256(joined(base, BASE).encode()).hexdigest(), joined(both, (*BASE, *ADDED)), sum(len(both[k]) for k in ADDED), scores))
        kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64(), pa.list_(pa.float64())]
        cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([ids, *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))], names)


def detect(docs: DataFrame) -> DataFrame:
    """Counts and spans of every row of docs(doc_id, text)."""
    return docs.select("doc_id", "text").mapInArrow(_found, _RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"))
