"""Personal data in texts: patterns propose spans, checksums confirm them, context words adjust a score.

Base kinds (fixed patterns): email, ip, card, phone. Added kinds: iban (confirmed by mod-97), ssn (needs a context word) and
secret (a long unbroken string of letters and digits, confirmed by the entropy of its characters, which needs a context word). Offsets count code points, the end is exclusive. A base span that passes its validator is
always kept; context only moves its score. An added span is kept from ``THRESHOLD`` on.

Defined cases: null and empty texts have no spans; repeated rows are treated alike; an empty table gives an empty
result; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitweave.llm.common import map_arrow

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "secret")
THRESHOLD = 0.7
#: Characters to either side in which a context word counts.
NEAR = 48

#: Fixed patterns.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: Matches of [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+) are the successive fours of these runs' parts; so long digit runs are read once.
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9])")
#: Bits of entropy to a character that a secret has at least; words of a language have less in so few different characters.
ENTROPY = 3.0
#: Characters of each country's IBAN.
IBAN_LENGTHS = {
    x[:2]: int(x[2:])
    for x in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 "
        "GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 "
        "PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
    ).split()
}
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Words near a span that make its kind likelier.
CONTEXT = {
    "email": ("mail", "e-mail", "contact", "write to"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "mastercard", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "transfer"),
    "ssn": ("ssn", "social security"),
    "secret": ("token", "secret", "password", "passwd", "api key", "apikey", "api_key", "access key", "access_key", "private key", "credential", "bearer"),
}
#: Score of a span of each kind before context.
PRIOR = {"email": 0.85, "ip": 0.75, "card": 0.85, "phone": 0.75, "iban": 0.8, "ssn": 0.4, "secret": 0.4}


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost matches of local@domain: each holds the '@' that parts them, so it is enough to try these."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def _fours(text: str) -> Iterator[tuple[int, list[str]]]:
    for m in DOTTED.finditer(text):
        if "." in m[0]:
            parts, at = m[0].split("."), m.start()
            for k in range(0, len(parts) - 3, 4):
                yield at, parts[k : k + 4]
                at += sum(map(len, parts[k : k + 4])) + 4


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """From each start, the whole words of the country's length, or of a country not listed the most words, that mod-97 confirms."""
    at = 0
    while m := IBAN.search(text, at):
        at = m.start() + 1
        for end in sorted((m.start() + k for k in range(15, len(m[0]) + 1) if m.start() + k == m.end() or text[m.start() + k] == " "), reverse=True):
            s = text[m.start() : end].replace(" ", "")
            if len(s) >= 15 and len(s) == IBAN_LENGTHS.get(s[:2], len(s)) and mod97(s):
                yield m.start(), end
                at = end
                break


def is_random(s: str) -> bool:
    """Letters and digits, with characters as various as those of a random key."""
    if not (any(c.isdigit() for c in s) and any(c.isalpha() for c in s)):
        return False
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values()) >= ENTROPY


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _proposed(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """Kind, start, end, and whether the kind's validator confirms it."""
    if "@" in text:
        for a, b in _emails(text):
            yield "email", a, b, True
    for a, parts in _fours(text):
        yield "ip", a, a + sum(map(len, parts)) + 3, all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            d = _digits(m[0])
            yield "card", m.start(), m.end(), 16 <= len(d) <= 19 and luhn(d)
    if "+" in text:
        for m in PHONE.finditer(text):
            yield "phone", m.start(), m.end(), 8 <= len(_digits(m[0])) <= 15
    for a, b in _ibans(text):
        yield "iban", a, b, True
    for m in SSN.finditer(text):
        a, b, c = m[0].split("-")
        yield "ssn", m.start(), m.end(), a not in ("000", "666") and a < "900" and b != "00" and c != "0000"
    for m in SECRET.finditer(text):
        yield "secret", m.start(), m.end(), is_random(m[0])


def find(text: str | None) -> list[tuple[str, int, int, float]]:
    """Confirmed spans (kind, start, end, score), by kind as in KINDS, then by start."""
    out = []
    for kind, a, b, valid in _proposed(text or ""):
        if not valid:
            continue
        near = f"{text[max(0, a - NEAR):a]} {text[b:b + NEAR]}".lower()
        score = min(1.0, PRIOR[kind] + (0.15 if PRIOR[kind] >= THRESHOLD else 0.35) * any(w in near for w in CONTEXT[kind]))
        if kind in BASE or score >= THRESHOLD:
            out.append((kind, a, b, score))
    return sorted(out, key=lambda x: (KINDS.index(x[0]), x[1]))


def detect(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id and spans, an array of (kind, start, end, score). One pass, no shuffle."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [[dict(zip(("kind", "start", "end", "score"), s)) for s in find(t)] for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["id", "spans"])

    ids = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(id_col, text_col), run, f"id {ids}, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>")



def joined(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """kind:start:end of the spans of ``kinds``, comma-joined."""
    each = F.transform(F.filter(spans, lambda s: s["kind"].isin(*kinds)), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    return F.array_join(each, ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
