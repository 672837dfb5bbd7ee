"""Secret scans by assignment-aware lexing (operator 2).

A text that may hold an assignment is lexed as source code or configuration:
``name = literal``, ``name: literal``, ``"name": "literal"``, ``name := literal``,
``name => literal`` and ``<name>literal</name>`` give name-literal pairs. So do subscripts (``cfg["name"] = literal``), annotations
(``name: str = literal``), triple-quoted, raw and template strings, texts in parentheses, arrays, arguments of calls
(a name that an environment is asked for is none) and YAML blocks, whose lines are literals. Constants are
propagated: ``k = "x1"; password = k`` pairs ``password`` with the literal where it
stands, also over several names, through templates, and over ``+`` of known parts, however many. A literal, or the joined
value that it is a part of, is scored by how sensitive its target names are (their words, split at ``_``, ``-``, ``.``, and
humps) and by how much it looks like a secret.

Three plain patterns for assignments, access keys and long hexadecimal runs are
always reported; lexing adds spans of kind ``literal``. Texts are scanned whole, each
where it lies: there is no shuffle. Cheap tests of the whole text come before any pattern.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import prepare

KINDS = ("assign", "access", "hex", "literal")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_ASSIGN_HINTS = ("password", "passwd", "secret", "token", "api_key", "apikey")
#: What stands between the words of a name, as bytes: a name's words are found in a text without these.
_BETWEEN = b"_$.-" + bytes(range(128, 256))
_HEX_BYTES = bytes(120 if chr(b) in "0123456789abcdef" else 32 for b in range(256))

#: Words of target names and how sensitive each makes a name.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9,
    "key": 0.6, "auth": 0.6, "authorization": 0.7, "bearer": 0.7, "private": 0.6, "signature": 0.5, "salt": 0.5, "pin": 0.4, "dsn": 0.5, "conn": 0.3,
}
#: Words that make a name harmless, and literals that stand for a secret.
HARMLESS = ("public", "primary", "foreign", "sort", "type", "name", "file", "path", "url", "count", "length", "max", "min", "limit", "field", "hint", "policy")
PLACEHOLDERS = ("changeme", "example", "placeholder", "password", "secret", "token", "none", "null", "true", "false", "undefined", "your", "xxx", "todo", "test")
THRESHOLD = 0.5

_LEXED_HINTS = tuple(word.encode() for word in sorted(SENSITIVE))
_PAIR = re.compile(
    r"""(?:(?P<open><)|(?P<q>["'])|(?<![\w$.-])(?:(?![A-Za-z_$])[\w$.-])*+)(?P<name>[A-Za-z_$][\w$.-]*+)(?:(?(open)>|(?(q)(?P=q))))"""
    r"""(?P<op>(?(open)|[\x20\t]*(?::=|=>|==?|:)[\x20\t]*))(?P<rhs>(?:"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|[^\s,;#"'(){}\[\]<>]+)(?:[\x20\t]*\+[\x20\t]*(?:"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|[\w$.]+))*)"""
)
_PART = re.compile(r""""((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|([^\s+"']+(?:\+[^\s+"']+)*)""")
_HUMP = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_IDENTIFIER = re.compile(r"[A-Za-z_$][\w$.]*\Z")


# What the tokens above can't say: targets whose literal is behind brackets, an annotation, or another kind of string.
_STRING = re.compile(
    r"""(?P<kind>[rRbBuUfF]{0,2})(?:\"{3}(?P<t>(?:[^\\]|\\.)*?)\"{3}|'{3}(?P<u>(?:[^\\]|\\.)*?)'{3}|"(?P<d>(?:[^"\\\n]|\\.)*)"|'(?P<s>(?:[^'\\\n]|\\.)*)'|`(?P<b>(?:[^`\\]|\\.)*)`)""",
    re.DOTALL,
)
_TARGET = re.compile(
    r"""(?:\[[\x20\t]*(?P<sq>["'])(?P<sub>[A-Za-z_$][\w$.-]*+)(?P=sq)[\x20\t]*\]|(?P<q>["'])(?P<quoted>[A-Za-z_$][\w$.-]*+)(?P=q)|(?<![\w$.-])(?P<plain>[A-Za-z_$][\w$.-]*+))"""
    r"""[\x20\t]*(?:(?P<type>:[\x20\t]*[A-Za-z_][\w.]*+(?:\[[\w.,|\x20]*\]|<[\w.,|\x20]*>)?(?:[\x20\t]*\|[\x20\t]*[A-Za-z_][\w.]*+)*[\x20\t]*)=(?![=>])|(?P<op>:=|=>|=(?!=)|:))[\x20\t]*"""
)
_CALL = re.compile(r"(?:new[\x20\t]+|await[\x20\t]+)?[A-Za-z_$][\w$.]*+!?[\x20\t]*\(")
_BLOCK = re.compile(r"[|>][+-]?[0-9]?[\x20\t]*(?:#[^\n]*)?\r?\n")
_INNER = re.compile(r"(?P<blank>[\s\\]+)|(?P<comment>#[^\n]*|//[^\n]*)|(?P<open>[(\[])|(?P<close>[)\]])|(?P<comma>,)|(?P<plus>\+)|(?P<pair>[A-Za-z_$][\w$.-]*+[\x20\t]*(?:=(?!=)|:(?!:))|[{}])|(?P<name>[A-Za-z_$][\w$.]*+)|(?P<other>.)", re.DOTALL)
_HOLE = re.compile(r"\$?\{([^{}]*)\}")
_ASKED = re.compile(r"[A-Z][A-Z0-9_]*\Z")


def _parts_of(m: re.Match) -> list[tuple]:
    """Parts of a string: (begin, end) where it stands, or a name that a template puts in."""
    which = next(k for k in "tudsb" if m[k] is not None)
    a, b = m.span(which)
    if "f" not in m["kind"].lower() and which != "b":
        return [(a, b)]
    out, at = [], a
    for hole in _HOLE.finditer(m.string, a, b):
        out += [(at, hole.start())] * (hole.start() > at) + [(hole[1].strip(),)]
        at = hole.end()
    return [*out, *[(at, b)] * (b > at)]


def _bracketed(text: str, at: int, call: bool) -> list[list[tuple]]:
    """Groups of parts inside the bracket that ends before ``at``: what commas separate; strings beside each other, or with ``+`` between, are one group.

    Reading ends with the bracket, or where a pair or a mapping of its own begins.
    """
    groups: list[list[tuple]] = [[]]
    depth = 1
    while depth and at < len(text):
        m = _STRING.match(text, at)
        if m:
            groups[-1] += _parts_of(m)
            at = m.end()
            continue
        m = _INNER.match(text, at)
        at = m.end()
        if m["pair"]:
            break
        depth += bool(m["open"]) - bool(m["close"])
        if m["comma"] or m["open"] or m["close"]:
            groups.append([])
        elif m["name"]:
            groups[-1].append((m["name"],))
    groups = [g for g in groups if g]
    if call:
        groups = [g for i, g in enumerate(groups) if not (len(g[0]) == 2 and (_ASKED.match(text[slice(*g[0])]) or i == 0 and len(groups) > 1))]
    return groups


def _block_lines(text: str, start: int, at: int) -> list[list[tuple]]:
    """Lines of a YAML block that are indented more than the line on which its name stands."""
    begin = text.rfind("\n", 0, start) + 1
    own = len(text[begin:start]) - len(text[begin:start].lstrip(" -"))
    groups = []
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        line = text[at:end]
        inner = line.strip()
        if inner and len(line) - len(line.lstrip(" ")) <= own:
            break
        if inner:
            a = at + line.index(inner)
            groups.append([(a, a + len(inner))])
        at = end + 1
    return groups


def structured(text: str) -> Iterator[tuple[int, str, list[list[tuple]]]]:
    """(start, name, groups of parts) of targets beyond ``name op literal``."""
    for m in _TARGET.finditer(text):
        which = next(k for k in ("sub", "quoted", "plain") if m[k] is not None)
        name, start, at = m[which], m.start(which), m.end()
        if m["op"] == ":" and _BLOCK.match(text, at):
            yield start, name, _block_lines(text, m.start(), _BLOCK.match(text, at).end())
            continue
        string = _STRING.match(text, at)
        beyond = m["sub"] or m["type"]
        if string and (beyond or string["kind"] or string["d"] is None and string["s"] is None):
            groups = [_parts_of(string)]
            at = string.end()
            while (plus := re.compile(r"[\x20\t]*\+[\x20\t]*").match(text, at)) and (string := _STRING.match(text, plus.end())):
                groups[0] += _parts_of(string)
                at = string.end()
            yield start, name, groups
        elif not string and text[at : at + 1] in ("(", "["):
            yield start, name, _bracketed(text, at + 1, call=False)
        elif not string and (call := _CALL.match(text, at)):
            yield start, name, _bracketed(text, call.end(), call=True)
        elif not string and beyond and (bare := re.compile(r"""[^\s,;#"'(){}\[\]<>+]+""").match(text, at)):
            yield start, name, [[(bare[0],)] if _IDENTIFIER.match(bare[0]) else [bare.span()]]


def name_score(name: str) -> float:
    """How sensitive a target name is, from 0 to 1; a plural counts as its singular."""
    parts = [p.lower() for p in _HUMP.findall(name)]
    parts = [p[:-1] if p[-1:] == "s" and p not in SENSITIVE and p[:-1] in SENSITIVE else p for p in parts]
    joined = ["".join(p) for p in zip(parts, parts[1:], strict=False)]
    score = max([SENSITIVE.get(p, 0.0) for p in [*parts, *joined]], default=0.0)
    return score * (0.4 if any(p in HARMLESS for p in parts) else 1.0)


def literal_score(value: str) -> float:
    """How much a literal looks like a secret, from 0 to 1."""
    return _looks(Value((), value[:_PREFIX], Counter(value), len(value)))


#: Code points that a value keeps of its beginning: more than any placeholder has.
_PREFIX = 32


@dataclass
class Value:
    """What is known of a literal, or of the joined value of other values' numbers ``parts``; ``span`` is where a literal stands."""

    parts: tuple[int, ...]
    begin: str
    chars: Counter
    size: int
    span: tuple[int, int] | None = None


def _looks(value: Value) -> float:
    n, low = value.size, value.begin.lower()
    if n < 6 or any(c.isspace() for c in value.chars):
        return 0.0
    whole = n <= _PREFIX
    if whole and low in PLACEHOLDERS or low.startswith(("${", "{{", "<", "%", "your", "xxx", "http:", "https:", "/", "./")) or len(set("".join(value.chars).lower())) < 4:
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in value.chars.values())
    classes = sum(any(f(c) for c in value.chars) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    return min(1.0, entropy / 4.5 * 0.7 + classes * 0.15 + min(n, 32) / 320)


def _join(parts: list[int], values: list[Value]) -> int:
    """The number of the joined value; its size counts every repeat, its text is never made."""
    if len(parts) == 1:
        return parts[0]
    begin, chars, size = "", Counter(), 0
    for p in parts:
        begin = (begin + values[p].begin)[:_PREFIX] if len(begin) == size else begin
        chars.update(values[p].chars)
        size += values[p].size
    values.append(Value(tuple(parts), begin, chars, size))
    return len(values) - 1


def lex(text: str) -> list[tuple[int, int, str, float]]:
    """(start, end, target name, score) of literals with sensitive targets.

    A literal counts by itself and as a part of joined values, whichever scores more.
    """
    values: list[Value] = []
    known: dict[str, int | None] = {}
    target: dict[int, tuple[float, int, str]] = {}  # by value: its most sensitive name's score, the first such, that name
    joined: dict[int, tuple[float, int, str]] = {}  # by value: the best score of a joined value it is part of
    def add(a: int, b: int) -> int:
        value = text[a:b]
        values.append(Value((), value[:_PREFIX], Counter(value), len(value), (a, b)))
        return len(values) - 1

    def assign(name: str, start: int, found: list[int]) -> None:
        at = known[name] = _join(found, values) if found else None
        score = name_score(name)
        if score and at is not None:
            target[at] = max(target.get(at, (0.0, 0, "")), (score, -start, name))

    more = list(structured(text))
    beyond = {start for start, _, _ in more}
    events = [(m.start("name"), m) for m in _PAIR.finditer(text) if (m["open"] or m["op"].strip() != "==") and m.start("name") not in beyond]
    for start, event in sorted([*events, *[(start, (name, groups)) for start, name, groups in more]], key=lambda e: e[0]):
        if isinstance(event, tuple):
            name, groups = event
            for group in groups or [[]]:
                found = []
                for part in group:
                    if len(part) == 2:
                        found.append(add(*part))
                    elif known.get(part[0]) is not None:
                        found.append(known[part[0]])
                assign(name, start, found)
            if len(groups) > 1:  # of several values none is the name's
                known[name] = None
            continue
        m = event
        found = []
        base = m.start("rhs")
        bare = 0
        for p in _PART.finditer(m["rhs"]):
            k = next(i for i in (1, 2, 3) if p[i] is not None)
            value = p[k]
            if k == 3 and value in known:
                found += [known[value]] if known[value] is not None else []
            elif k < 3 or not _IDENTIFIER.match(value) or not bare and any(c.isdigit() for c in value):
                found.append(add(base + p.start(k), base + p.end(k)))
            bare += k == 3
        assign(m["name"], m.start(), found)
    for at, (score, place, name) in target.items():
        joined[at] = (score * _looks(values[at]), place, name)
    out = []
    for at in range(len(values) - 1, -1, -1):  # parts come before what is joined of them
        value = values[at]
        for best in (target, joined):
            if at in best:
                for p in value.parts:
                    best[p] = max(best.get(p, (0.0, 0, "")), best[at])
        if value.span and at in target:
            score, place, name = target[at]
            total, _, name = max((score * _looks(value), place, name), joined[at])
            if total >= THRESHOLD:
                out.append((*value.span, name, total))
    return sorted(out)


def scan(text: str) -> list[tuple[str, int, int, str, float]]:
    """(kind, start, end, target, score) of a text's secrets, in code points.

    Ordered by start, then by the order of KINDS.
    """
    out: list[tuple[str, int, int, str, float]] = []
    low = text.lower()
    if any(h in low for h in _ASSIGN_HINTS):
        out += [("assign", m.start(), m.end(), m[1], 1.0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), "", 1.0) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    raw = text.encode("utf-8", "surrogatepass")
    if b"x" * 24 in raw.translate(_HEX_BYTES):
        out += [("hex", m.start(), m.end(), "", 0.5) for m in _HEX.finditer(text)]
    if "=" in text or ":" in text or ">" in text:
        names = raw.translate(None, _BETWEEN).lower()
        if any(h in names for h in _LEXED_HINTS):
            out += [("literal", a, b, name, score) for a, b, name, score in lex(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPANS = "array<struct<kind:string,start:int,end:int,target:string,score:double>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("target", pa.string()), ("score", pa.float64())]))


def find_secrets(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, redact: bool = False) -> DataFrame:
    """Spans of secrets in whole texts.

    Returns the columns ``keep`` (by default ``doc_id``) and ``secrets``, an array
    of (kind, start, end, target, score) by start, then kind; with ``redact`` also
    ``redacted``, the text with every span replaced by ``[REDACTED]`` (overlapping
    spans by one). Columns of ``keep`` with these names give way. A null text
    counts as empty: no spans, and it stays null when redacted. Repeated rows stay
    repeated; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    own = ["secrets", *["redacted"] * redact]
    keep = [c for c in (keep if keep is not None else ["doc_id"]) if c not in own]
    names = list(dict.fromkeys([*keep, text_col]))
    source = docs.select(*names)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name in keep]
    schema = ", ".join([*fields, f"secrets {SPANS}", *["redacted string"] * redact])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(names.index(text_col)).to_pylist()
            spans = [scan(t) if t else [] for t in texts]
            columns = [batch.column(names.index(c)) for c in keep]
            columns.append(pa.array([[dict(zip(("kind", "start", "end", "target", "score"), s, strict=True)) for s in x] for x in spans], _SPAN_TYPE))
            if redact:
                columns.append(pa.array([hide(t, s) if s else t for t, s in zip(texts, spans, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *own])

    return source.mapInArrow(work, schema)


def hide(text: str, spans: list[tuple]) -> str:
    """The text with each span, or run of overlapping spans, replaced."""
    out, done = [], 0
    for _, a, b, *_ in spans:
        if a >= done:
            out += [text[done:a], "[REDACTED]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def joined(secrets: Column, kinds: tuple[str, ...]) -> Column:
    """``kind:start:end`` of the spans of these kinds, comma-joined."""
    some = F.filter(secrets, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(secrets: Column, kind: str) -> Column:
    return F.size(F.filter(secrets, lambda s: s["kind"] == kind)).cast("long")
