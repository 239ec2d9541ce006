"""Secret scans by assignment-aware lexing.

Source and configuration are lexed into names, operators and literals; `name = literal`, `name: literal`,
`"name": "literal"`, `NAME=value`, `name -> literal`, `<name>literal</name>`, `<key>name</key><string>literal</string>`
and tags with `name="name" value="literal"` give name-literal pairs. Literals are quoted (also triple, raw, formatted
and in backticks), bare, or YAML block scalars; what triple quotes and blocks hold is lexed as well. Constants are
propagated: `a = b`, `$b` and `${b}` give a the literal of b, and so do `+`, f-strings, `${}`, `%` and `.format` for
each of their parts. Literals in a list (brackets, or YAML items) belong to the list's name, and `f("name", "literal")`
is a pair, too. A bare value that goes on as a call or an index, or is of words joined by dots or underscores, is an
expression: it has no literal but its call's arguments and a default behind `or`, `||`, `??` or `?:`. Arguments and items that are words joined by marks are names or paths. A pair is scored by its name's sensitive words and its literal's shape; all literals of one
scored high are secrets. Fixed patterns are found beside that.

Spans count characters; `assign`, `access` and `hex` are the fixed patterns, `literal` is the lexer's.
Results for odd input: null and empty texts hold nothing; rows that share an id are scanned apart; other columns
are left alone; an empty table gives no rows. Time is in proportion to the text: joined values carry counts of their
characters, not copies of them; a block is read up to its first line with a space, which no secret has; lists and
arguments up to the first name with a value of its own.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from torquil.llm import common as C

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_HINT = re.compile(r"password|passwd|secret|token|api_?key", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # a run of 16+ is what the greedy leftmost match of a longer or equal run is
KINDS = ("assign", "access", "hex", "literal")

#: A quoted literal; what repeats never gives back, here and below, so time is in proportion to the text.
_STRING = r"""(?P<prefix>[rRbBuUfF]{1,2}+(?=["']))?(?P<text>\"""(?:[^"\\]++|\\[\s\S]|"(?!""))*+\"""|\'\'\'(?:[^'\\]++|\\[\s\S]|'(?!''))*+\'\'\'|"(?:[^"\\\n]++|\\.)++"|'(?:[^'\\\n]++|\\.)++'|`(?:[^`\\\n]++|\\.)++`)"""
#: Name, operator and literal or another name, each of any length. A bare name is tried where its run of characters
#: starts and nowhere else in it. A quoted literal with an operator behind it is the next pair's name.
_NAMED = (
    r"""(?P<name>[A-Za-z_$](?:[A-Za-z0-9_.$]|-(?!>))*+)(?(q)(?P=q))\]?[\x20\t]*+(?::[\x20\t]*+[A-Za-z_][A-Za-z0-9_\[\]]*+[\x20\t]*+=|:=|=>|->|[:=])(?![=>])[\x20\t]*+"""
    rf"""(?:(?:new|await)[\x20\t]++)?(?:[(\x20\t]*+(?:\\?\r?\n[\x20\t]*+)?{_STRING}(?![\x20\t]*+[:=])|(?P<block>[|>][-+0-9]*+[\x20\t]*+\r?\n)|(?P<list>\[)|(?P<items>\r?\n)(?=[\x20\t]*+-\x20)|(?P<ref>\$(?:\{{[A-Za-z_]\w*+\}}|[A-Za-z_]\w*+))(?![\x20\t]*+[:=])|(?P<bare>[A-Za-z0-9+/_.=@!#%^&*~-]++))"""
)
_PAIR = re.compile(r"""(?:(?P<q>["'])|(?<![A-Za-z0-9_.$-])[0-9.-]*+)""" + _NAMED, re.A)
#: A name right after a bare literal, which $ alone can start.
_NEXT = re.compile(r"(?P<q>(?!))?(?=\$)" + _NAMED, re.A)
_PLUS = re.compile(rf"""[\s\\]*+\+[\s\\]*+(?:{_STRING}|(?P<ref>\$?[A-Za-z_][\w.]*+))""", re.A)
_FORMAT = re.compile(r"\.format\(([^()\n]*+)\)|[\x20\t]*+%[\x20\t]*+\(?([\w.,\x20]++)", re.A)
#: What brackets hold up to a name with a value of its own, other than a default's.
_ARGUMENT = re.compile(rf"""\s*+(?:(?:default|fallback)\s*+=\s*+)?(?:{_STRING}(?!\s*+[:=])|(?P<word>[\w.$]++)(?!\s*+[:=])|(?P<mark>[(),\[\]]))""", re.A)
_MEMBER = re.compile(r"\??\.[A-Za-z_]\w*+", re.A)
_DEFAULT = re.compile(rf"[\x20\t]*+(?:\bor\b|\|\||\?\?|\?:)[\x20\t]*+{_STRING}", re.A)
_ITEM = re.compile(rf"""[\x20\t]*+-\x20++(?:{_STRING}|(?P<bare>[A-Za-z0-9+/_.=@!#%^&*~-]++))[\x20\t]*+(?:\#[^\n]*+)?(?:\r?\n|\Z)""", re.A)
_CALLED = re.compile(rf"""\(\s*+(?P<q>["'])(?P<name>[A-Za-z_][\w.-]*+)(?P=q)\s*+,\s*+{_STRING}(?!\s*+[:=])""", re.A)
#: A bare value that names something, and a quoted one that may (a key, a path).
_NAMING = re.compile(r"[A-Za-z_]+\d{0,2}(?:\.[A-Za-z_]+\d{0,2})+|[A-Za-z]+(?:_[A-Za-z]+)+", re.A)
_KEYLIKE = re.compile(r"[_./:@-]*[A-Za-z]+\d{0,2}(?:[_./:@-]+[A-Za-z]+\d{0,2})*[_./:@-]*", re.A)
_CALLEE = re.compile(r"[A-Za-z_$][\w.$]*+", re.A)
_OPENED = re.compile(r"[:=>][|>][-+0-9]*+$", re.A)
_HOLE, _FIELD, _SLOT = re.compile(r"\$\{([^{}\n]*+)\}", re.A), re.compile(r"\{([^{}\n]*+)\}", re.A), re.compile(r"%[sdr]|\{\w*\}", re.A)
_ELEMENT = re.compile(r"<key>\s*+(?P<key>[\w.:-]++)\s*+</key>\s*+<string>(?P<string>[^<]++)</string>|<(?P<name>[A-Za-z_][\w.:-]*+)(?:\s[^<>]*+)?>(?P<text>[^<>]++)</(?P=name)\s*+>", re.A)
_TAG = re.compile(r"<[A-Za-z][^<>]*+>")
_ATTRIBUTE = re.compile(r"""(?<![\w.:-])([\w.:-]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)')""", re.A)
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_WEIGHTS = {"password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "secret": 3, "token": 2, "apikey": 3, "key": 1, "api": 1, "auth": 1, "access": 1, "private": 1, "credential": 2, "credentials": 2, "bearer": 2, "signing": 1, "salt": 1}
_FAKE = re.compile(r"example|placeholder|changeme|your|dummy|sample|redacted|xxxx|\*\*\*\*|<|\$\{|%\(|null|none|true|false", re.I)
#: In literals over LONG characters the words of placeholders also turn up by chance, so there they count only as whole words.
_FAKE_WORD, LONG = re.compile(rf"(?<![A-Za-z0-9])(?:{_FAKE.pattern})(?![A-Za-z0-9])", re.I), 400
SCORE = 4.5
#: A literal's shape gives 3 at most, so a name of less weight gives no secret.
LEAST = 2


class Value:
    """A literal with its span, or some values joined. What a score needs is kept as sums, so joins copy no text."""

    __slots__ = ("text", "span", "parts", "secret", "_sums")

    def __init__(self, text: str = "", span: tuple[int, int] | None = None, parts: tuple[Value, ...] = ()):
        self.text, self.span, self.parts, self.secret, self._sums = text, span, parts, False, None
        if parts:
            self.sums()

    def sums(self) -> tuple[Counter, bool, bool]:
        """(counts of characters, has a placeholder's word, has one as a whole word)."""
        if self._sums is None:
            counts, fake, word = Counter(self.text), bool(_FAKE.search(self.text)), bool(_FAKE_WORD.search(self.text))
            for c, f, w in (p.sums() for p in self.parts):
                counts.update(c)
                fake, word = fake or f, word or w
            self._sums = counts, fake, word
        return self._sums

    def mark(self) -> list[tuple[int, int]]:
        """Spans of the literals in it that no earlier call gave."""
        found, todo = [], [self]
        while todo:
            v = todo.pop()
            if not v.secret:
                v.secret = True
                found += [v.span] * (v.span is not None and v.span[0] < v.span[1])
                todo += v.parts
        return found


def entropy(counts: Counter) -> float:
    """Bits a character."""
    n = counts.total()
    return -sum(p * math.log2(p) for p in (c / n for c in counts.values()) if p)


def name_weight(name: str) -> int:
    """How sensitive the words of an identifier are, in singular or plural."""
    parts = [p.lower() for p in _PART.findall(name)]
    return sum(_WEIGHTS.get(p) or _WEIGHTS.get(p.removesuffix("s"), 0) for p in dict.fromkeys(parts))


def score(name: str, value: Value) -> float:
    """Name's weight, with up to 3 for a long literal of mixed characters; placeholders and plain words lose 3."""
    counts, fake, word = value.sums()
    n = counts.total()
    if n < 8:
        return 0.0
    some = "".join(counts)
    kinds = sum(bool(re.search(p, some)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    shape = min(1.5, max(0.0, entropy(counts) - 2.0)) + 0.5 * (kinds - 1) + 0.5 * (n >= 16)
    return min(4, name_weight(name)) + min(3.0, shape) - 3.0 * bool((fake if n <= LONG else word) or some.isalpha() or " " in counts)


def _unfolded(text: str) -> str:
    """A literal of many lines without its line breaks and what indents them."""
    return "".join(line.strip() for line in text.splitlines())


def _block(text: str, name_at: int, start: int) -> Value:
    """The block scalar whose lines begin at start: those indented deeper than its name's line. Empty if a line has a space inside or opens a block."""
    line = text.rfind("\n", 0, name_at) + 1
    depth = len(text[line:name_at]) - len(text[line:name_at].lstrip(" -"))
    end = start
    while end < len(text):
        stop = text.find("\n", end) + 1 or len(text)
        bare = text[end:stop].lstrip(" ")
        if bare.strip() and stop - end - len(bare) <= depth:
            break
        if len(bare.split()) > 1 or _OPENED.search(bare.strip()):
            return Value()
        end = stop
    body = text[start:end]
    first = start + len(body) - len(body.lstrip())
    return Value(_unfolded(body), (first, max(first, start + len(body.rstrip()))))


def _quoted(m: re.Match, known: dict[str, Value]) -> Value:
    """A quoted literal, with the constants that it is formatted from."""
    width = 3 if m["text"][:3] in ('"""', "'''") else 1
    start, body = m.start("text") + width, m["text"][width:-width]
    if "{" in body:
        holes = [*(_FIELD if "f" in (m["prefix"] or "").lower() else _HOLE).finditer(body)]
        if holes:
            parts, at = [], 0
            for h in holes:
                parts.append(Value(body[at : h.start()], (start + at, start + h.start())))
                parts += [known[h[1]]] if h[1] in known else []
                at = h.end()
            return Value(parts=(*parts, Value(body[at:], (start + at, start + len(body)))))
    return Value(_unfolded(body) if width == 3 else body, (start, start + len(body)))


def _joined(text: str, values: list[Value], end: int, known: dict[str, Value]) -> tuple[Value, int]:
    """The values with what + adds to them, and where that ends. Adjoining plain literals are one."""
    while more := _PLUS.match(text, end):
        end = more.end()
        if more["ref"]:
            values += [v for v in [known.get(more["ref"].lstrip("$"))] if v]
            continue
        v = _quoted(more, known)
        last = values[-1] if values else None
        if last and not last.parts and not v.parts and last.span[1] == more.start() - 1:
            values[-1] = Value(last.text + v.text, (last.span[0], v.span[1]))
        else:
            values.append(v)
    return (values[0] if len(values) == 1 else Value(parts=tuple(values))), end


def _listed(text: str, at: int, known: dict[str, Value]) -> tuple[list[Value], int]:
    """The literals in the brackets that open at `at`, but names and paths, and where what was read of them ends."""
    values, depth = [], 0
    while m := _ARGUMENT.match(text, at):
        at = m.end()
        if m["text"]:
            values.append(_quoted(m, known))
            if not values[-1].parts and _KEYLIKE.fullmatch(values[-1].text):
                values.pop()
        elif m["mark"]:
            depth += (m["mark"] in "([") - (m["mark"] in ")]")
            if not depth:
                break
    return values, at


def _expression(text: str, at: int, known: dict[str, Value]) -> tuple[list[Value], int]:
    """The literals of an expression that goes on at `at`: arguments of its calls, and its default."""
    values = []
    while True:
        if text.startswith(("(", "["), at):
            call = text[at] == "("
            found, at = _listed(text, at, known)
            values += found if call else []
        elif m := _MEMBER.match(text, at):
            at = m.end()
        elif m := _DEFAULT.match(text, at):
            values.append(_quoted(m, known))
            at = m.end()
        else:
            return values, at


def pairs(text: str) -> list[tuple[str, Value]]:
    """Name-literal pairs in order, with constants propagated: a name given other names has their literals."""
    out, known, at = [], {}, 0
    while m := at and _NEXT.match(text, at) or _PAIR.search(text, at):
        name, at, several = m["name"], m.end(), None
        if m["list"]:
            several, at = _listed(text, at - 1, known)
        elif m["items"]:
            several = []
            while item := _ITEM.match(text, at):
                value, at = _quoted(item, known) if item["text"] else Value(item["bare"], item.span("bare")), item.end()
                several += [value] if value.parts or not _KEYLIKE.fullmatch(value.text) else []
        elif m["text"]:
            values = [_quoted(m, known)]
            if (f := _FORMAT.match(text, at)) and (names := [n for n in re.split(r"[,\s]+", f[1] or f[2] or "") if n in known]):
                values, at = [Value(_SLOT.sub("", values[0].text), values[0].span), *(known[n] for n in names)], f.end()
            value, end = _joined(text, values, at, known)
            at = end if end > at or m["text"][:3] not in ('"""', "'''") else m.start("text") + 3
        elif m["block"]:
            if name_weight(name) < LEAST:
                continue
            value = _block(text, m.start("name"), at)
        elif m["ref"]:
            values = [v for v in [known.get(m["ref"].strip("${}"))] if v]
            value, at = _joined(text, values, at, known)
        else:
            bare = m["bare"].rstrip(".,")
            names = bare.split("+")
            if all(n in known for n in names):
                value, at = _joined(text, [known[n] for n in names], at, known)
            elif bare.isidentifier() and _PLUS.match(text, at):  # a name whose literal isn't in the text
                value, at = _joined(text, [], at, known)
            elif _NAMING.fullmatch(bare) or text.startswith(("(", "["), at) and _CALLEE.fullmatch(bare):
                several, at = _expression(text, at, known)
            else:
                value = Value(bare, (m.start("bare"), m.start("bare") + len(bare)))
        if several is not None:
            value = Value(parts=tuple(several))
        known[name.lstrip("$")] = value
        out += [(name, v) for v in ([value] if several is None else several or [Value()])]
    for m in _CALLED.finditer(text) if "(" in text else ():
        value = _quoted(m, known)
        if value.parts or not _KEYLIKE.fullmatch(value.text):
            out.append((m["name"], value))
    return out


def _trimmed(text: str, start: int) -> Value:
    """A literal from start without the whitespace around it."""
    start += len(text) - len(text.lstrip())
    return Value(_unfolded(text), (start, start + len(text.strip())))


def marked_up(text: str) -> list[tuple[str, Value]]:
    """Name-literal pairs of elements and of tags that hold a name and a value."""
    out = []
    for m in _ELEMENT.finditer(text):
        group = "string" if m["key"] else "text"
        out.append((m["key"] or m["name"], _trimmed(m[group], m.start(group))))
    for tag in _TAG.finditer(text) if "value" in text else ():
        held = {a[1].lower(): (a[2] or a[3] or "", tag.start() + a.start(2 if a[2] is not None else 3)) for a in _ATTRIBUTE.finditer(tag[0])}
        if "value" in held:
            out += [(held[k][0], _trimmed(*held["value"])) for k in ("key", "name", "id") if k in held]
    return out


def spans(text: str) -> list[tuple[int, int, str]]:
    """(start, index of the kind, end) of all secrets, in order."""
    found = []
    if _ASSIGN_HINT.search(text):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    named = pairs(text) if "=" in text or ":" in text or "->" in text or "(" in text else []
    named += marked_up(text) if "</" in text or "/>" in text or "value" in text and "<" in text else []
    literals = set()
    for name, value in named:
        if name_weight(name) >= LEAST and not value.secret and score(name, value) >= SCORE:
            literals.update(value.mark())
    return sorted(found + [(a, 3, b) for a, b in literals])


def shown(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def masked(text: str, found: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with each run of spans replaced by the mark."""
    out, at = [], 0
    for a, _, b in found:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _scan(batch: pa.RecordBatch):
    rows = []
    for text in batch.column("text").to_pylist():
        found = spans(text or "")
        base = [f for f in found if f[1] < 3]
        n = Counter(k for _, k, _ in base)
        rows.append((n[0], n[1], n[2], hashlib.sha256(shown(base).encode()).hexdigest(), shown(found)))
    types = [pa.int64()] * 3 + [pa.string()] * 2
    yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def _mask(batch: pa.RecordBatch, column: str):
    texts = [t if t is None else masked(t, spans(t)) for t in batch.column(column).to_pylist()]
    yield batch.set_column(batch.schema.get_field_index(column), column, pa.array(texts, pa.string()))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of each row of docs (doc_id, text)."""
    C.tune(docs.sparkSession)
    plain = C.with_text(docs, "doc_id").withColumn("doc_id", F.col("doc_id").cast("long"))
    return C.mapped(plain, _scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def mask(docs: DataFrame) -> DataFrame:
    """docs with its secrets replaced in the text; nothing else changes."""
    C.tune(docs.sparkSession)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # whatever the names hold
    return C.mapped(plain, _mask, plain.schema, column=f"c{docs.columns.index('text')}").toDF(*docs.columns)


def op3_secrets(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
