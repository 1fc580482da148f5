"""Secret scans by assignment-aware lexing.

Source and configuration syntax is parsed into (target name, operands) pairs: ``name = "x"``, ``"name": "x"``,
``cfg["name"] = other + "y"``, ``NAME=x``, ``name: type = "x"``, ``<name>x</name>``, and blocks of indented lines below
``name: |``, line by line. A call's literals are those of its target: ``name = cfg.get("x")``; the call itself is code. Names bound to literals are propagated to the targets that use them, before
or after the binding, and a literal is scored by the most sensitive target it reaches times how much it looks like a
secret. Three fixed patterns (assign, access, hex) are reported beside these spans, whatever the score.

Offsets count code points, ends are exclusive. Null texts are empty and have no span; very long ones are read whole.
Spans that start together go by kind as listed; a literal that reaches several targets has its best score. Rows that
repeat get the same answer each; an empty table gives none. ``scan`` reads no other columns, whatever their names;
``redact`` passes them on untouched, and masks no code: what a call is made of stays.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, text_of

# The kinds in the order in which they are listed, and the base patterns.
KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # runs are maximal, so the length can stand in the pattern
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_VALUE = 6

# How sensitive a target's name is by its parts, and parts that say the value is none.
SENSITIVE = {"password": 1.0, "pass": 0.9, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "passcode": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.6, "authorization": 0.8, "privatekey": 1.0, "accesskey": 1.0, "secretkey": 1.0}
PAIRED = {("api", "key"): 1.0, ("access", "key"): 1.0, ("private", "key"): 1.0, ("secret", "key"): 1.0, ("signing", "key"): 0.9, ("encryption", "key"): 0.9, ("client", "secret"): 1.0}
HARMLESS = {"count", "limit", "length", "max", "min", "type", "name", "url", "uri", "path", "file", "field", "label", "hint", "expiry", "expires", "ttl", "policy", "regex", "pattern", "placeholder"}
PLACEHOLDER = re.compile(r"(?i)example|placeholder|changeme|your[_-]|dummy|redacted|^(?:null|none|true|false|undefined)$|^[x*.\-]+$|^\$\{|^\{\{|^<")
THRESHOLD = 0.5

# What any target or base pattern must contain; texts without it hold no span.
ANY = r"(?i)pass|pwd|secret|token|key|credential|auth|akia|[0-9a-f]{24}"
PAIR = re.compile(
    r"""(?<![\w$.\-])(?:(?P<name>[A-Za-z_$][\w$.\-]*+(?:\[["']?[\w.\-]++["']?\])*+)|(?P<q>["'])(?P<quoted>[\w.\-\x20]++)(?P=q))[\x20\t]*+(?:\??:[\x20\t]*+(?P<type>(?:[A-Za-z_&*][\w.:&*]*+(?:\[[^\]\n=]*+\]|<[^>\n=]*+>)?+[?!]?+(?:[\x20\t]*+\|[\x20\t]*+)?+)++)[\x20\t]*+=(?![=>])|:=|=>|[:=](?!=))[\x20\t]*+"""
)
ELEMENT = re.compile(r"<(?P<name>[A-Za-z_][\w.:\-]*+)(?:[\x20\t][^<>\n]*+)?>(?P<value>[^<>\n]++)</(?P=name)>")
BLOCK = re.compile(r"(?m)^(?P<indent>[\x20\t]*+)(?:-[\x20\t]+)?(?P<name>[\w.\-]++)[\x20\t]*+:[\x20\t]*+[|>][+\-\d]*+[\x20\t]*+\n(?P<lines>(?:(?P=indent)[\x20\t]++[^\n]*+(?:\n|\Z)|[\x20\t]*+\n)++)")
OPERAND = re.compile(r"""(?P<f>\x22\x22\x22|\x27\x27\x27)(?P<long>(?s:.*?))(?P=f)|"(?P<d>(?:\\.|[^"\\\n])*+)"|'(?P<s>(?:\\.|[^'\\\n])*+)'|`(?P<b>[^`\n]*+)`|(?P<ref>[A-Za-z_$][\w$.]*+)(?![\w+/=-])|(?P<bare>[^\s"'`;,(){}\[\]]++)""")
ARGUMENT = re.compile(r""""(?P<d>(?:\\.|[^"\\\n])*+)"|'(?P<s>(?:\\.|[^'\\\n])*+)'|[()]|[^"'()\n]++""")
LOOKED_UP = re.compile(r"[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+")
PLUS = re.compile(r"[\x20\t]*+[+.][\x20\t]*+(?=[\"'`A-Za-z_$])")
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def sensitivity(name: str) -> float:
    """From 0 to 1, by the parts of a target's name; the last parts decide what it holds."""
    parts = [p.lower() for p in PARTS.findall(name)]
    if not parts or parts[-1] in HARMLESS:
        return 0.0
    best = max((SENSITIVE.get(p, 0.0) for p in parts), default=0.0)
    return max([best, *(PAIRED.get(two, 0.0) for two in zip(parts, parts[1:]))])


def secrecy(value: str) -> float:
    """From 0 to 1: length and entropy of the literal; white space and placeholders are no secrets."""
    if len(value) < MIN_VALUE or PLACEHOLDER.search(value) or any(c.isspace() for c in value):
        return 0.0
    n = len(value)
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(value).values())
    return min(1.0, entropy / 3) * min(1.0, 0.4 + n / 20)


class Binding:
    """The literals of one assignment, and the bindings that it uses: shared, so that ``a = b + b`` doesn't grow."""

    __slots__ = ("own", "parents", "weight")

    def __init__(self):
        self.own: list[tuple[int, int]] = []
        self.parents: list[Binding] = []
        self.weight = 0.0


def bindings(text: str) -> list[tuple[str, Binding, list[tuple[str, tuple[int, int] | None]]]]:
    """(name, its binding, operands that are names with their place if they may be bare words) of each assignment."""
    out = []
    for m in PAIR.finditer(text):
        found, refs, at = Binding(), [], m.end()
        while o := OPERAND.match(text, at):
            kind, plus = o.lastgroup, PLUS.match(text, o.end())
            if kind != "ref":
                found.own += lines_of(text, *o.span(kind)) if kind == "long" else [o.span(kind)]
            elif text[o.end() : o.end() + 1] == "(":
                found.own += arguments(text, o.end() + 1)
            else:
                refs.append((o["ref"], o.span("ref") if m["name"] is None or not plus else None))
            if not plus:
                break
            at = plus.end()
        out.append((m["name"] or m["quoted"], found, refs))
    for m in ELEMENT.finditer(text):
        found = Binding()
        found.own.append(m.span("value"))
        out.append((m["name"], found, []))
    for m in BLOCK.finditer(text):
        found = Binding()
        found.own += lines_of(text, *m.span("lines"))
        out.append((m["name"], found, []))
    return out


def lines_of(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """What stands on each line of a part of a text, without white space around it."""
    return [m.span() for m in re.compile(r"\S(?:[^\n]*\S)?").finditer(text, start, end)]


def arguments(text: str, at: int) -> list[tuple[int, int]]:
    """Quoted literals between a call's parenthesis, after which ``at`` stands, and its end on the same line. Names in capitals
    are what is looked up, in the environment mostly, not what is found."""
    out, depth = [], 1
    while depth and (m := ARGUMENT.match(text, at)):
        depth += (m[0] == "(") - (m[0] == ")")
        out += [m.span(m.lastgroup)] if m.lastgroup and not LOOKED_UP.fullmatch(m[m.lastgroup]) else []
        at = m.end()
    return out


def literals(text: str) -> list[tuple[int, int, float]]:
    """(start, end, score) of the literals that reach a target, the best score of each.

    A name stands for what was bound to it last, or else for what is bound to it first further down; a name that
    nothing is bound to is a bare word of a configuration file.
    """
    assigned = bindings(text)
    later: dict[str, Binding] = {}
    for name, found, refs in reversed(assigned):
        if found.own or refs:
            later[name] = found
    bound: dict[str, Binding] = {}
    for name, found, refs in assigned:
        for ref, place in refs:
            if parent := bound.get(ref) or later.get(ref):
                found.parents.append(parent)
            elif place:
                found.own.append(place)
        if found.own or found.parents:
            bound[name] = found
    scores: dict[tuple[int, int], float] = {}
    for name, found, _ in assigned:
        weight, reached = sensitivity(name), [found]
        while weight and reached:
            node = reached.pop()
            if node.weight >= weight:
                continue  # its literals have that score already, and so have those of its parents
            node.weight = weight
            for span in node.own:
                score = weight * secrecy(text[slice(*span)])
                scores[span] = max(score, scores.get(span, 0.0))
            reached += node.parents
    return sorted((a, b, s) for (a, b), s in scores.items())


def spans(text: str, threshold: float = THRESHOLD) -> list[tuple[int, int, int, int]]:
    """(start, kind's place in KINDS, end, where the secret value starts), by start, then kind."""
    out = [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    out += [(m.start(), k, m.end(), m.start()) for k, p in ((1, ACCESS), (2, HEX)) for m in p.finditer(text)]
    out += [(a, 3, b, a) for a, b, s in literals(text) if s >= threshold]
    return sorted(out)


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end) of each row of ``docs`` (doc_id, text)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            some = pc.match_substring_regex(texts, ANY).to_pylist()
            found = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b, _ in spans(texts[i].as_py())] if some[i] else [] for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, SPANS)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(each, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each secret value replaced by ``mark``; n_chars follows the text where there is such a column."""
    schema = docs.schema

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            some = pc.match_substring_regex(column, ANY).to_pylist()
            texts = [redacted(column[i].as_py(), mark) if some[i] else column[i].as_py() for i in range(len(column))]
            arrays = {f.name: batch.column(k) for k, f in enumerate(batch.schema)}
            arrays["text"] = pa.array(texts, batch.schema.field("text").type)
            yield pa.RecordBatch.from_arrays(list(arrays.values()), list(arrays))

    out = docs.mapInArrow(lean(each), schema)
    return out.withColumn("n_chars", F.length(text_of()).cast(schema["n_chars"].dataType)) if "n_chars" in out.columns else out


def redacted(text: str, mark: str) -> str:
    parts, at = [], 0
    types = {m.start("type") for m in PAIR.finditer(text) if m["type"]}
    code = lambda kind, end, value: kind == 0 and (text[end : end + 1] == "(" or value in types)
    for start, end in sorted((value, end) for _, kind, end, value in spans(text) if not code(kind, end, value)):
        if end > at:
            if start >= at:
                parts += [text[at:start], mark]
            at = end
    return "".join([*parts, text[at:]])


def joined(spans_: Column) -> Column:
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
