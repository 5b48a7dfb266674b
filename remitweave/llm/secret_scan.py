"""Secrets in texts: fixed patterns, and literals that a lexer finds assigned to sensitive names.

Base kinds (fixed patterns): assign, access, hex; they always stay. The kind *literal* is added: the text is read as source or configuration, as far as it is either.

* Lexing: names (dotted, dashed), quoted strings with escapes (one line, or triple quotes), numbers, operators, comments' marks skipped.
* Pairs: a name, quoted key or subscript key, then ``=``, ``:=``, ``:``, ``=>`` or ``==`` (a typed declaration's ``: type =`` too), then a value: strings and names
  joined by ``+`` or standing side by side, a call whose arguments are such values (its first is taken as a name looked up if others follow), or a bare word;
  an element's text, ``<name>text</name>``.
* Constants: a name's value is remembered with the literals that it was built from, so that a literal reaches every later target
  it is assigned to, through names, joins and ``${name}`` or ``{name}`` inside strings. Names are told apart by case; the last value counts.
* Scores: the target name's words (camelCase and separators parted) give a sensitivity, the literal's length, kinds of characters and entropy a
  strength; placeholders, references to variables and plain words are weak. A literal is reported once, with the target of its best score, from ``THRESHOLD`` on, if it isn't within a base span.

Offsets count code points, the end is exclusive. Defined cases: null and empty texts have no spans; repeated rows are treated alike; an
unclosed quote is no string; very long texts are read once, in time linear in their length; an empty table gives an empty result; columns other than
the id and the text are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitweave.llm.common import map_arrow

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "literal")
THRESHOLD = 0.6
#: Characters of the weakest literal; characters of a value built from others that are looked at for its strength (its literals are whole).
LEAST, LONGEST = 6, 256

#: Fixed patterns. Runs that are too short for ``access`` and ``hex`` hold no longer one, so a least length is the same as dropping them.
ASSIGN = re.compile(r"""(?ai:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_VALUE = 12

#: One alternative each: triple-quoted and quoted strings (a quote right after a letter is an apostrophe), comment marks, an element's start, names, numbers, operators, line ends.
LEX = re.compile(
    r'''(?P<triple>"""(?:[^"\\]|\\.|"(?!""))*"""|\'\'\'(?:[^'\\]|\\.|'(?!''))*\'\'\')'''
    r'''|(?<![A-Za-z0-9_])(?P<quoted>"(?:[^"\\\n]|\\[^\n])*"|'(?:[^'\\\n]|\\[^\n])*'|`(?:[^`\\\n]|\\[^\n])*`)'''
    r"""|<(?P<element>[A-Za-z_][A-Za-z0-9_.-]*)>"""
    r"""|(?P<name>[A-Za-z_$][A-Za-z0-9_$]*(?:[.-][A-Za-z0-9_$]+)*)"""
    r"""|(?P<number>[0-9][A-Za-z0-9_.]*)"""
    r"""|(?P<op>:=|=>|===?|!==?|\+=|[=:+])"""
    r"""|(?P<mark>[\[\](){},;?|.<>]|\n)""",
    re.S,
)
#: A bare value: to the end of the word, as configuration files have it.
BARE = re.compile(r"[^\s\"'`,;(){}\[\]<>]+")
#: An element's text and the name that closes it.
INNER = re.compile(r"\s*([^<>\s](?:[^<>\n]*[^<>\s])?)\s*</([A-Za-z_][A-Za-z0-9_.-]*)>")
#: Prefixes of strings (bytes, raw, formatted) are names that touch the quote.
PREFIXES = frozenset("b r f u br rb fr rf".split())
TARGETS = frozenset(("=", ":=", ":", "=>", "==", "===", "+="))
PLUGGED = re.compile(r"\$?\{\s*([A-Za-z_][A-Za-z0-9_.]*)\s*\}|\$([A-Za-z_][A-Za-z0-9_]*)")
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")

#: Words of a name, or two that follow one another, that make it sensitive; words that say it is about a secret, not one.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.95, "secret": 0.95, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9,
    "authtoken": 1.0, "privatekey": 1.0, "secretkey": 1.0, "accesskey": 1.0, "api key": 1.0, "access key": 1.0, "private key": 1.0, "secret key": 1.0,
    "signing key": 1.0, "encryption key": 1.0, "account key": 0.9, "master key": 0.9, "session key": 0.9, "auth": 0.7, "authorization": 0.8, "bearer": 0.8, "passcode": 0.9,
    "pass": 0.7, "connection string": 0.7, "dsn": 0.6, "key": 0.45, "salt": 0.5, "webhook": 0.4, "signature": 0.4, "cookie": 0.5, "pin": 0.5,
}
ABOUT = frozenset("length len size count name names path file filename dir url uri endpoint id type field label hint policy expiry expires ttl min max public limit regex pattern header prefix column version".split())
#: Any of these stands in each sensitive name: a text without them is not lexed.
STEMS = re.compile(r"(?ai:pass|pwd|secret|token|key|cred|auth|bearer|connection.?string|dsn|salt|webhook|signature|cookie|pin)")
PLACEHOLDERS = re.compile(r"(?i)change.?me|example|placeholder|your[_ -]|dummy|redacted|todo|xxx|\*\*\*|\.\.\.|^<.*>$|^(?:none|null|nil|true|false|undefined|empty|test|string|str|int|bool|required|optional|password|secret|token)$")


class Value(NamedTuple):
    """A literal (``start`` >= 0), or what is built from earlier values, by their places in the reader's list."""

    text: str
    start: int
    end: int
    made_of: tuple[int, ...]


class Token(NamedTuple):
    kind: str
    text: str
    start: int
    end: int


def words(name: str) -> list[str]:
    return [w.lower() for w in WORDS.findall(name)]


def sensitivity(name: str) -> float:
    """0 to 1: how likely a literal under that name is a secret."""
    parts = words(name)
    pairs = [f"{a} {b}" for a, b in zip(parts, parts[1:])]
    best = max((SENSITIVE.get(x, 0.0) for x in (*parts, *pairs)), default=0.0)
    return best * (0.3 if parts and parts[-1] in ABOUT else 1.0)


def strength(text: str) -> float:
    """0 to 1: how much a literal looks like a secret."""
    if len(text) < LEAST or PLACEHOLDERS.search(text) or PLUGGED.fullmatch(text):
        return 0.0
    bits = -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())
    kinds = sum(any(f(c) for c in text) for f in (str.islower, str.isupper, str.isdigit)) + any(not c.isalnum() and not c.isspace() for c in text)
    spaces = sum(c.isspace() for c in text) / len(text)
    found = 0.25 * min(1.0, len(text) / 16) + 0.4 * min(1.0, bits / 3.5) + 0.35 * min(1.0, (kinds - 1) / 2)
    return max(0.0, found - 2 * spaces)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= LEAST_VALUE]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def lexed(text: str) -> list[Token]:
    out = []
    for m in LEX.finditer(text):
        kind, a, b = m.lastgroup, m.start(), m.end()
        if kind in ("triple", "quoted"):
            n = 3 if kind == "triple" else 1
            out.append(Token("string", text[a + n : b - n], a + n, b - n))
        else:
            out.append(Token(kind, m[kind], a, b))
    return out


class Reader:
    """Walks over a text's tokens once, and yields targets with their values, as places in ``values``, in which each stands after what it is made of."""

    def __init__(self, text: str) -> None:
        self.text, self.tokens = text, lexed(text)
        self.values: list[Value] = []
        self.known: dict[str, int] = {}

    def at(self, i: int) -> Token:
        return self.tokens[i] if i < len(self.tokens) else Token("end", "", len(self.text), len(self.text))

    def literal(self, start: int, end: int) -> int:
        self.values.append(Value(self.text[start:end], start, end, ()))
        return len(self.values) - 1

    def built(self, parts: list[int], between: str = "") -> int:
        if len(parts) == 1:
            return parts[0]
        self.values.append(Value(between.join(self.values[p].text for p in parts)[:LONGEST], -1, -1, tuple(parts)))
        return len(self.values) - 1

    def string(self, t: Token) -> int:
        """A string, with the constants that it names."""
        own = self.literal(t.start, t.end)
        named = [self.known[m[1] or m[2]] for m in PLUGGED.finditer(t.text) if (m[1] or m[2]) in self.known]
        return self.built([own, *dict.fromkeys(named)]) if named else own

    def term(self, i: int) -> tuple[int | None, int]:
        t = self.at(i)
        if t.kind == "name" and t.text.lower() in PREFIXES and self.at(i + 1).kind == "string" and self.at(i + 1).start - t.end in (1, 3):
            i, t = i + 1, self.at(i + 1)
        if t.kind == "string":
            return self.string(t), i + 1
        if t.kind == "name" and self.at(i + 1).text == "(":
            return self.call(i + 2)
        if t.kind == "name" and t.text in self.known:
            return self.known[t.text], i + 1
        return None, i

    def call(self, i: int) -> tuple[int | None, int]:
        """The literals among a call's plain arguments; the first one, if others follow, names what is looked up."""
        found: list[int] = []
        first = True
        while self.at(i).kind != "end" and self.at(i).text not in (")", "\n", "(", ";"):
            t = self.at(i)
            if t.kind == "string":
                if not (first and self.at(i + 1).text == ","):
                    found.append(self.literal(t.start, t.end))
                first = False
            elif t.kind == "name" and t.text in self.known:
                found.append(self.known[t.text])
            i += 1
        return (self.built(found, " ") if found else None), i + (self.at(i).text == ")")

    def value(self, i: int, bare: bool) -> tuple[int | None, int]:
        while self.at(i).kind == "mark" and self.at(i).text == "(":
            i += 1
        out, i = self.term(i)
        if out is None:
            t = self.at(i)
            if bare and t.kind in ("name", "number"):
                m = BARE.match(self.text, t.start)
                while self.at(i).kind != "end" and self.at(i).start < m.end():
                    i += 1
                return self.literal(m.start(), m.end()), i
            return None, i
        parts = [out]
        while True:
            j = i
            while self.at(j).kind in ("op", "mark") and self.at(j).text in ("+", "\n", ".") and j - i < 3:
                j += 1
            joined = any(self.at(x).text in ("+", ".") for x in range(i, j))
            if not joined and (j > i or self.at(j).kind != "string"):
                break
            more, j = self.term(j)
            if more is None:
                break
            parts.append(more)
            i = j
        return self.built(parts), i

    def pairs(self) -> Iterator[tuple[str, int]]:
        i = 0
        while i < len(self.tokens):
            t, after = self.at(i), self.at(i + 1)
            if t.kind == "element":
                inner = INNER.match(self.text, t.end)
                if inner and inner[2] == t.text:
                    yield t.text, self.literal(inner.start(1), inner.end(1))
                i += 1
                continue
            if t.kind in ("name", "string") and after.text == "]" and self.at(i + 2).kind == "op":
                after, i = self.at(i + 2), i + 1
            if t.kind not in ("name", "string") or after.kind != "op" or after.text not in TARGETS:
                i += 1
                continue
            j = i + 2
            if after.text == ":" and self.at(j).kind == "name":  # a declaration: name: type = value
                k = j + 1
                while k - j < 16 and (self.at(k).text in ("[", "]", "|", "<", ">", "?") or self.at(k).kind == "name" and self.at(k - 1).text in ("[", "|", "<", ",")):
                    k += 1
                if self.at(k).text == "=":
                    after, j = self.at(k), k + 1
            found, end = self.value(j, bare=t.kind == "name" and after.text in ("=", ":", ":="))
            if found is None:
                i += 1
                continue
            yield t.text, found
            if t.kind == "name" and after.text not in ("==", "==="):
                self.known[t.text] = self.built([self.known[t.text], found]) if after.text == "+=" and t.text in self.known else found
            # a bare word, or a call's arguments, may hold further pairs
            i = end if self.at(end - 1).kind == "string" and end > j else i + 1


def literals(text: str) -> list[tuple[int, int, float, str]]:
    """Start, end, best score and its target of literals assigned to sensitive names, directly or through others."""
    if not STEMS.search(text):
        return []
    reader = Reader(text)
    #: The most sensitive target that reaches each value, and the best score of a value built from it.
    reached: dict[int, tuple[float, str]] = {}
    inherited: dict[int, tuple[float, str]] = {}
    for name, v in reader.pairs():
        if s := sensitivity(name):
            reached[v] = max(reached.get(v, (0.0, "")), (s, name))
    out: dict[tuple[int, int], tuple[float, str]] = {}
    for v in range(len(reader.values) - 1, -1, -1):
        if v not in reached:
            continue
        value, (s, name) = reader.values[v], reached[v]
        firm = strength(value.text)
        own = (s * (0.25 + 0.75 * firm) if firm else 0.0, name)
        if value.start >= 0:
            best = max(own, inherited.get(v, (0.0, ""))) if firm or len(value.text) < LEAST else own
            if best[0] >= THRESHOLD:
                at = value.start, value.end
                out[at] = max(out.get(at, (0.0, "")), best)
            continue
        passed = max(own, inherited.get(v, (0.0, "")))
        for part in value.made_of:
            reached[part] = max(reached.get(part, (0.0, "")), (s, name))
            inherited[part] = max(inherited.get(part, (0.0, "")), passed)
    return [(a, b, s, name) for (a, b), (s, name) in out.items()]


def find(text: str | None) -> list[tuple[str, int, int, float, str]]:
    """Spans (kind, start, end, score, target), by start, then kind as in KINDS."""
    text = text or ""
    base = base_spans(text)
    out = [(kind, a, b, 1.0, "") for kind, a, b in base]
    ends = sorted((a, b) for _, a, b in base)
    at, reach = 0, 0
    for a, b, s, name in sorted(literals(text)):
        while at < len(ends) and ends[at][0] <= a:
            reach = max(reach, ends[at][1])
            at += 1
        if b > reach:
            out.append(("literal", a, b, s, name[:200]))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


SPAN = "struct<kind:string,start:bigint,end:bigint,score:double,target:string>"


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id and spans, an array of (kind, start, end, score, target). One pass, no shuffle."""
    names = ("kind", "start", "end", "score", "target")
    kind = pa.list_(pa.struct(list(zip(names, (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.string()), strict=True))))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [[dict(zip(names, s, strict=True)) for s in find(t)] for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["id", "spans"])

    ids = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(id_col, text_col), run, f"id {ids}, spans array<{SPAN}>")


def joined(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """kind:start:end of the spans of ``kinds``, comma-joined."""
    each = F.transform(F.filter(spans, lambda s: s["kind"].isin(*kinds)), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    return F.array_join(each, ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
