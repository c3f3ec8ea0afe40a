r"""Secret scanning by assignment-aware lexing.

Texts are read as a stream of source and configuration tokens: quoted strings
(triple, double, single, back-quoted, with escapes), names, numbers, operators
and comments. An assignment is a name followed by ``=``, ``:``, ``:=``, ``=>``
or ``+=`` (a type annotation may stand between) and a value: literals and names
joined by ``+`` or ``.`` or put next to each other. In configuration style the
value may be bare (``KEY=abc``). Names that were given a constant earlier in
the text are replaced by it, as are ``${name}`` and ``{name}`` inside literals,
so a secret is found under the sensitive name however many constants it went
through. A pair scores by how sensitive the target's name is and how random the
literal looks.

Time is linear in the text. A constant that is used through its name counts for
at most ``RESOLVED`` characters (``…`` stands for the rest), for constants can
double at every line; literals as written are read entire, whatever their length.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec as tv
from .shared import text_batches

THRESHOLD, RESOLVED = 0.5, 4096
#: Characters of results that are sent on at a time.
_FLUSH = 1 << 22
#: A literal of letters alone under a name of at least this sensitivity counts so much: the name decides.
STRONG, PLAIN = 0.9, 0.56
REDACTED = "<SECRET>"
_REDACTIONS = re.compile("(?:<SECRET>)+(?:<[SECRT]*…)?|^…$")

TOKEN = re.compile(
    r"""
    (?P<nl>\n)
  | (?P<ws>[^\S\n]+)
  | (?P<str>(?:(?<!\w)[fFrRbBuU]{1,2}(?=["']))?(?:\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|'''(?:[^\\]|\\[\s\S])*?'''|"(?:[^"\\\n]|\\.)*"|(?<![^\W_])'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\[\s\S])*?`))
  | (?P<op>:=|=>|\+=|==|!=|<=|>=|->|::|[=:+,;()\[\]{}.])
  | (?P<name>[^\W\d][\w]*(?:-[^\W\d_][\w]*)*)
  | (?P<other>[^\s\w"'`=:+,;()\[\]{}.]|\d[\w.]*|.)
    """,
    re.X,
)
BARE = re.compile(r"[^\s,;\"'`(){}\[\]<>]+")
ASSIGN = {"=", ":", ":=", "=>", "+="}
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
#: How sensitive a target is, by the words in its name.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "pass": 0.7, "secret": 1.0, "secrets": 0.9, "token": 0.95, "tokens": 0.8, "apikey": 1.0, "credential": 0.9, "credentials": 0.9,
    "auth": 0.6, "authorization": 0.8, "bearer": 0.9, "privatekey": 1.0, "accesskey": 1.0, "secretkey": 1.0, "authtoken": 1.0, "accesstoken": 1.0, "clientsecret": 1.0, "signature": 0.5, "salt": 0.5, "cookie": 0.5, "session": 0.4, "cert": 0.4, "dsn": 0.5,
}
KEY_OF = {"api", "access", "private", "secret", "auth", "encryption", "signing", "master", "account", "storage", "service", "ssh", "deploy", "client", "app", "consumer", "license", "webhook"}
TAME = {"id", "name", "type", "count", "length", "len", "size", "limit", "max", "min", "url", "uri", "path", "file", "field", "label", "expires", "expiry", "ttl", "policy", "hint", "header", "prefix", "index", "public", "example", "placeholder", "format", "pattern", "regex"}
PLACEHOLDER = re.compile(r"(?i)^(?:<.*>|\$?\{.*\}|%.*%|\*+|x+|\.+|(?:your|my|the|some|an?)[-_ ].*|change[-_ ]?me.*|example.*|placeholder.*|dummy.*|todo.*|none|null|nil|true|false|undefined|redacted|secret|password|test(?:ing)?|foo|bar|string|str|bytes|int)$")
#: Bare words after a sensitive name that are types or remarks.
REMARKS = {"boolean", "bool", "number", "object", "text", "char", "varchar", "bytea", "optional", "required", "enabled", "disabled", "hidden", "any", "unknown", "default", "empty", "missing", "invalid", "self", "this", "void", "pass", "return", "input", "option"}
KNOWN = re.compile(r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,}|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\..*|-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*)$")


def sensitivity(name: str) -> float:
    """0 to 1: how much a target of this name suggests a secret."""
    parts = [w.lower() for w in WORDS.findall(name)]
    if not parts:
        return 0.0
    score = max(SENSITIVE.get(w, 0.0) for w in parts)
    score = max([score, *(SENSITIVE.get(a + b, 0.0) for a, b in zip(parts, parts[1:]))])
    if "key" in parts and (KEY_OF & set(parts)):
        score = max(score, 0.95)
    elif parts == ["key"]:
        score = max(score, 0.5)
    if parts[-1] in TAME:
        score *= 0.3
    return score


def randomness(value: str) -> float:
    """0 to 1: how much a literal looks like key material rather than a word or a phrase."""
    value = _REDACTIONS.sub("", value)
    n = len(value)
    if n < 4 or PLACEHOLDER.match(value):
        return 0.0
    if KNOWN.match(value):
        return 1.0
    if value.count(" ") > 2:
        return 0.1
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    kinds = sum(any(f(ch) for ch in value) for f in (str.islower, str.isupper, str.isdigit)) + any(not ch.isalnum() for ch in value)
    if value.isalpha() and (value.islower() or value.istitle()):
        return 0.35 if n < 20 else 0.5
    return min(1.0, 0.3 + entropy / 8 + 0.05 * kinds + min(n, 32) / 160)


class Source:
    """A text, and how often each word of it occurs, counted once and only where that is asked."""

    def __init__(self, text: str):
        self.text, self._words = text, None

    def times(self, word: str) -> int:
        if self._words is None:
            self._words = Counter(re.findall(r"\w+", self.text))
        return self._words[word]

    def alone(self, begin: int, end: int) -> bool:
        """Whether a bare value is all of its line but a name, and stands nowhere else in the text, as a variable would."""
        text = self.text
        lo, hi = text.rfind("\n", 0, begin) + 1, text.find("\n", end)
        value = text[begin:end]
        if value.lower() in REMARKS or text[end : hi if hi >= 0 else len(text)].strip():
            return False
        return re.fullmatch(r"\s*(?:export\s+|set\s+|-\s+)?[\w.-]+\s*[=:]\s*", text[lo:begin]) is not None and self.times(value) == 1


class Assignment(NamedTuple):
    name: str
    value: str  # as resolved
    begin: int
    end: int  # of the value as written
    via: bool  # a name was followed to get it
    written: bool  # a literal stands in it
    uses: tuple[int, ...]  # the assignments whose constants it used


def unquote(raw: str) -> str:
    raw = raw.lstrip("fFrRbBuU")
    q = 3 if raw[:3] in ('"""', "'''") else 1
    return re.sub(r"\\(.)", r"\1", raw[q:-q])


def assignments(source: Source | str) -> list[Assignment]:
    """The assignments of a text in order."""
    source = Source(source) if isinstance(source, str) else source
    text = source.text
    toks = [(m.lastgroup, m.group(), m.start(), m.end()) for m in TOKEN.finditer(text)]
    known: dict[str, int] = {}  # a name's last assignment
    out: list[Assignment] = []
    n, i = len(toks), 0

    def skip(j: int, kinds=("ws",)) -> int:
        while j < n and toks[j][0] in kinds:
            j += 1
        return j

    def constant(name: str) -> str:
        value = out[known[name]].value
        return value if len(value) <= RESOLVED else value[:RESOLVED] + "…"

    def fill(s: str, uses: list[int]) -> str:
        """``s`` with the constants that it names, as many as fit into RESOLVED characters."""
        room = RESOLVED

        def put(m: re.Match) -> str:
            nonlocal room
            if m[1] not in known or room < 0:
                return m[0]
            value = constant(m[1])
            room -= len(value)
            uses.append(known[m[1]])
            return value

        return re.sub(r"\$?\{(\w+)\}", put, s) if known and "{" in s else s

    while i < n:
        kind, tok, b, e = toks[i]
        if kind == "name" or (kind == "str" and "\n" not in tok):
            j = skip(i + 1)
            # obj["name"] = and obj.name = assign to the last name.
            while j < n and toks[j][1] == "]":
                j = skip(j + 1)
            if j < n and toks[j][1] == ":" and kind == "name":  # name: Type = value
                k = skip(j + 1)
                if k < n and toks[k][0] == "name":
                    k2 = skip(k + 1)
                    while k2 < n and toks[k2][1] in ("[", "]", "|", "?", ".") or k2 < n and toks[k2][0] == "name":
                        k2 = skip(k2 + 1)
                    if k2 < n and toks[k2][1] == "=":
                        j = k2
            if j < n and toks[j][1] in ASSIGN:
                name = tok if kind == "name" else unquote(tok)
                op = toks[j][1]
                j = skip(j + 1)
                parts, uses, begin, end, written, room = [], [], None, None, False, RESOLVED
                opened = 0
                while j < n:
                    k, t, vb, ve = toks[j]
                    if t == "(" and begin is None:
                        opened += 1
                        j = skip(j + 1, ("ws", "nl"))
                        continue
                    if k == "str":
                        parts.append(fill(unquote(t), uses))
                        vb += len(t) - len(t.lstrip("fFrRbBuU"))
                        begin, end, written = vb if begin is None else begin, ve, True
                    elif k == "name" and t in known and not (op == ":" and begin is None and j + 1 < n and toks[j + 1][1] in ASSIGN):
                        part = constant(t)
                        parts.append(part if room >= 0 else "…")
                        room -= len(part)
                        uses.append(known[t])
                        begin, end = vb if begin is None else begin, ve
                    else:
                        break
                    j2 = skip(j + 1, ("ws", "nl") if opened else ("ws",))
                    if j2 < n and toks[j2][1] in ("+", "."):
                        j = skip(j2 + 1, ("ws", "nl"))
                    elif j2 < n and toks[j2][0] == "str" and k == "str":
                        j = j2
                    else:
                        j = j2
                        break
                if begin is None and j < n and not opened and kind == "name" and op in ("=", ":") and toks[j][0] != "nl":
                    m = BARE.match(text, toks[j][2])
                    spaced = toks[j][2] > toks[i + 1][3] if i + 1 < n else False
                    # A bare value is configuration style: NAME=value, a value with a digit, or a line of a sensitive name and a word.
                    if m and (not spaced or any(ch.isdigit() for ch in m[0]) or m[0].isalpha() and sensitivity(name) >= STRONG and source.alone(m.start(), m.end())) and len(m[0]) >= 4:
                        v = m[0].rstrip(".:")
                        parts, begin, end, written = [v], m.start(), m.start() + len(v), True
                        while j < n and toks[j][2] < m.end():
                            j += 1
                if begin is not None:
                    via = bool(uses)
                    if op == "+=" and name in known:
                        parts.insert(0, constant(name))
                        uses.append(known[name])
                    out.append(Assignment(name, "".join(parts), begin, end, via, written, tuple(dict.fromkeys(uses))))
                    known[name] = len(out) - 1
                    i = max(j, i + 1)
                    continue
        i += 1
    return out


def _scored(source: Source, threshold: float) -> tuple[list[Assignment], list[tuple[int, float]]]:
    """All assignments, and (number, score) of those that score ``threshold`` or more."""
    all_, out = assignments(source), []
    for k, x in enumerate(all_):
        score = sensitivity(x.name)
        if score:
            worth = randomness(x.value)
            if score >= STRONG and worth and x.value.isalpha() and x.value.lower() not in SENSITIVE and (x.via or source.text[x.begin] in "\"'`" or source.alone(x.begin, x.end)):
                worth = max(worth, PLAIN)
            score *= worth
        if KNOWN.match(x.value):
            score = max(score, 0.9)
        if score >= threshold:
            out.append((k, round(score, 4)))
    return all_, out


def find_secrets(text: str, threshold: float = THRESHOLD) -> list[tuple[str, str, float, int, int, bool]]:
    """(name, literal, score, begin, end, through a name) of each assignment that scores ``threshold`` or more."""
    all_, found = _scored(Source(text), threshold)
    return [(all_[k].name, all_[k].value, score, all_[k].begin, all_[k].end, all_[k].via) for k, score in found]


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, name, literal, score, begin, end, resolved: one row for each secret of each row of ``docs``.

    begin and end are character positions of the value as written; resolved
    tells that a named constant was followed. Texts that have neither ``=`` nor
    ``:`` hold no assignment and never leave the JVM. Null and empty texts have
    no secret, an empty table gives no row, a null doc_id stays null, repeated
    rows repeat their results, and repeated assignments each count, those of
    equal score too. Texts of any length are read entire; a literal that was put
    together from named constants is cut as ``RESOLVED`` says, but reported all
    the same. Other columns are ignored, whatever their names.
    """

    names = ["doc_id", "name", "literal", "score", "begin", "end", "resolved"]

    def batch(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        k, name, value, score, begin, end, via = zip(*rows)
        return pa.record_batch([ids.take(pa.array(k)), pa.array(name), pa.array(value), pa.array(score), pa.array(begin, pa.int32()), pa.array(end, pa.int32()), pa.array(via)], names)

    def run(batches):
        for b in tv.batches(batches):
            ids, texts = tv.column(b, 0), tv.column(b, 1)
            rows, size = [], 0
            for k, t in enumerate(texts.to_pylist()):
                for s in find_secrets(t):
                    rows.append((k, *s))
                    size += len(s[1])
                    if size > _FLUSH:
                        yield batch(ids, rows)
                        rows, size = [], 0
            if rows:
                yield batch(ids, rows)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").rlike("[=:]"))
    return rows.mapInArrow(run, "doc_id long, name string, literal string, score double, begin int, end int, resolved boolean")


def redact_text(text: str) -> str:
    """``text`` with the values of its secrets replaced; so are other places where the same literal stands.

    Where a secret was put together from named constants, the literals are cut where they are defined.
    """
    all_, found = _scored(Source(text), THRESHOLD)
    if not found:
        return text
    cut, todo = set(), [k for k, _ in found]
    while todo:
        k = todo.pop()
        if k not in cut:
            cut.add(k)
            todo += all_[k].uses
    out, at = [], 0
    for k in sorted(cut):
        x = all_[k]
        if x.written and x.begin >= at:
            q = text[x.begin] if text[x.begin] in "\"'`" else text[x.end - 1] if text[x.end - 1] in "\"'`" else '"' if x.uses else ""
            out += [text[at : x.begin], q, REDACTED, q]
            at = x.end
    text = "".join([*out, text[at:]])
    words = ahocorasick.Automaton()
    for k, _ in found:
        if len(all_[k].value) >= 8 and all_[k].value != REDACTED:
            words.add_word(all_[k].value, len(all_[k].value))
    if not len(words):
        return text
    words.make_automaton()
    out, at = [], 0
    for last, size in words.iter_long(text):
        out += [text[at : last + 1 - size], REDACTED]
        at = last + 1
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with the secrets in text replaced by ``<SECRET>`` and n_chars, where there is one, brought up to date.

    All rows and columns stay, whatever their names; rows without an assignment
    pass unchanged, nulls and empty texts included; repeated rows change alike;
    texts of any length are read entire.
    """
    at = docs.columns.index("text")

    def run(batches):
        for b in tv.batches(batches):
            texts = tv.column(b, at)
            new = [t if t is None or not ("=" in t or ":" in t) else redact_text(t) for t in texts.to_pylist()]
            yield b.set_column(at, b.schema.field(at), pa.array(new, texts.type))

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        changed = F.col("text").contains(REDACTED)
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    text_batches(spark)
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
