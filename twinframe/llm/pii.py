"""Personal data: regular expressions propose spans, checksums confirm them, nearby context words adjust the score.

The four base kinds (email, ip, card, phone) are always kept once their checks hold. The method adds kinds that a pattern alone
cannot settle: ``iban`` (mod-97 confirms), ``secret`` (long hexadecimal strings, which only a context word such as *token* or
*password* lifts over the threshold) and ``ssn`` (grouped digits whose number ranges hold, likewise).
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_columns

KINDS = ("email", "ip", "card", "phone", "iban", "secret", "ssn")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_HEX = re.compile(r"(?<![A-Za-z0-9])[0-9A-Fa-f]{32,}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_DIGIT = re.compile(r"[0-9]")
#: What a kind scores by itself, and words that within CONTEXT characters before or after add or take 0.4.
START = {"iban": 0.8, "secret": 0.3, "ssn": 0.3}
NEAR = {
    "iban": ("iban", "account", "bank", "bic", "swift", "transfer", "payee", "konto", "cuenta", "compte"),
    "secret": ("token", "tokens", "secret", "secrets", "password", "passwd", "pwd", "key", "keys", "apikey", "credential", "credentials", "auth", "bearer", "authorization", "private", "access"),
    "ssn": ("ssn", "social", "security", "taxpayer", "tin", "itin"),
}
FAR = {
    "iban": ("example", "invalid", "sample", "placeholder"),
    "secret": ("checksum", "sha", "sha1", "sha256", "sha512", "md5", "commit", "digest", "hash", "fingerprint", "revision", "etag"),
    "ssn": ("part", "serial", "order", "sku", "model", "catalog", "invoice", "isbn", "phone", "fax"),
}
CONTEXT, THRESHOLD = 40, 0.6


def luhn(digits: str) -> bool:
    """The check of payment card numbers."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The check of account numbers: letters count 10 to 35 and the first four characters move to the end."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str) -> list[tuple[int, int]]:
    """As a leftmost search of local part, @ and dotted domain, but each character is looked at a bounded number of times."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and not _NOT_LOCAL.match(text, start - 1, start):
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            out.append((start, end := found.end()))
        floor = max(at + 1, found.end() if found else 0)
        if not found:
            end = max(end, at + 1)  # what comes before this @ can't be part of a later local part
        at = text.find("@", floor)
    return out


def _ibans(text: str) -> list[tuple[int, int]]:
    """Account numbers whose check holds: at each start the longest run of whole tokens, of 15 to 34 characters, that passes."""
    out, at = [], 0
    while m := _IBAN.search(text, at):
        start, end = m.span()
        while end - start >= 15 and not (len(run := text[start:end].replace(" ", "")) >= 15 and mod97(run)):
            end = text.rfind(" ", start, end)
        if found := end - start >= 15:
            out.append((start, end))
        at = end if found else start + 1
    return out


def _score(text: str, kind: str, start: int, end: int) -> float:
    near = text[max(0, start - CONTEXT) : start].lower() + " " + text[end : end + CONTEXT].lower()
    words = set(re.findall(r"[a-z0-9]+", near))
    return START[kind] + 0.4 * any(w in words for w in NEAR[kind]) - 0.4 * any(w in words for w in FAR[kind])


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) in code points, by kind as in KINDS, then start."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
        out += [("iban", a, b) for a, b in _ibans(text) if _score(text, "iban", a, b) >= THRESHOLD]
        out += [("secret", m.start(), m.end()) for m in _HEX.finditer(text) if _score(text, "secret", *m.span()) >= THRESHOLD]
        out += [("ssn", m.start(), m.end()) for m in _SSN.finditer(text) if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000" and _score(text, "ssn", *m.span()) >= THRESHOLD]
    return out


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each span replaced by its kind in angle brackets; overlapping spans count as one, named by the first."""
    out, end = [], 0
    last = -1
    for start, stop, kind in sorted((a, b, KINDS.index(k)) for k, a, b in spans):
        if start < last:
            last = max(last, stop)
            end = last
            continue
        out += [text[end:start], f"<{KINDS[kind].upper()}>"]
        end = last = stop
    return "".join([*out, text[end:]])


def with_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add n_email, n_ip, n_card, n_phone, base_sha256 and spans (``kind:start:end``, comma-joined). Null and empty texts have none."""

    def run(texts: pa.Array) -> list[list]:
        rows: list[list] = [[], [], [], [], [], []]
        for text in texts.to_pylist():
            found = find_spans(text or "")
            named = [f"{k}:{a}:{b}" for k, a, b in found]
            base = [x for x, s in zip(named, found) if s[0] in KINDS[:4]]
            for i, kind in enumerate(KINDS[:4]):
                rows[i].append(sum(s[0] == kind for s in found))
            rows[4].append(hashlib.sha256(",".join(base).encode()).hexdigest())
            rows[5].append(",".join(named))
        return rows

    fields = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS[:4]] + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
    return append_columns(docs, [text_col], T.StructType(fields), run)


def mask_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span in ``text_col`` masked; null texts stay null, other columns stay as they are."""

    def run(texts: pa.Array) -> list:
        return [[t if t is None or not (s := find_spans(t)) else mask(t, s) for t in texts.to_pylist()]]

    return append_columns(docs, [text_col], T.StructType([docs.schema[text_col]]), run).select(docs.columns)


