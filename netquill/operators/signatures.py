"""Signatures of files: one pass over each file for all strings of all rules, and no shuffle."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquill.functions.text import file_type

COLUMNS = ("rule", "string_id", "kind", "pattern", "at_offset", "min_hits", "max_size")
#: Strings of a set of rules, which every Python worker holds; people write them, so more than this is a mistake.
MAX_STRINGS = 200_000
#: Shorter strings occur too often to be worth an automaton's hits: each is looked for by itself.
SHORT = 3
FIRED = "array<struct<rule: string, hits: bigint, strings: array<string>>>"
_FIRED = pa.list_(pa.struct([("rule", pa.string()), ("hits", pa.int64()), ("strings", pa.list_(pa.string()))]))


def hex_tokens(pattern: str) -> list[int | None]:
    """Bytes of a hex string; ``..`` and ``??`` are any byte."""
    text = "".join(pattern.split())
    if len(text) % 2:
        raise ValueError(f"hex string of half bytes: {pattern}")
    return [None if pair in ("..", "??") else int(pair, 16) for pair in map("".join, zip(text[::2], text[1::2]))]


class Signature:
    """A string of a rule: ``atom`` occurs wherever the string does, and is all of it unless there is a ``check``."""

    def __init__(self, rule: str, string_id: str, kind: str, pattern: str, at: int | None, min_hits: int, max_size: int | None):
        self.rule, self.string_id, self.at, self.min_hits, self.max_size = rule, string_id, at, min_hits, max_size
        self.folded, self.check, self.atom = kind == "nocase", None, b""
        if kind == "regex":
            self.check = re.compile(pattern.encode())
        elif kind == "hex":
            tokens = hex_tokens(pattern)
            runs = re.split(b"\0", bytes(t is not None for t in tokens))
            longest, start = max(runs, key=len), 0
            while any(tokens[i] is None for i in range(start, start + len(longest))):
                start += 1
            self.atom = bytes(tokens[start : start + len(longest)])
            if None in tokens:
                self.check = re.compile(b"".join(b"." if t is None else re.escape(bytes([t])) for t in tokens), re.DOTALL)
        else:
            self.atom = pattern.encode().lower() if self.folded else pattern.encode()

    def there(self, body: bytes, lower: bytes) -> bool:
        """Whether the string is in the body, by itself."""
        if self.check:
            return bool(self.check.search(body) if self.at is None else self.check.match(body, self.at))
        text = lower if self.folded else body
        return self.atom in text if self.at is None else text.startswith(self.atom, self.at)


class SignatureSet:
    def __init__(self, rows: list[tuple]):
        self.all = [Signature(*r) for r in rows if r[3] is not None]
        self.exact, self.folded, self.single, self.regexes = {}, {}, [], []
        for s in self.all:
            if s.at is not None or (s.atom and len(s.atom) < SHORT):
                self.single.append(s)
            elif s.check and not s.atom:
                self.regexes.append(s)
            elif not s.atom:
                self.single.append(s)
            else:
                (self.folded if s.folded else self.exact).setdefault(s.atom, []).append(s)
        self.exact, self.folded = _automaton(self.exact), _automaton(self.folded)

    def fired(self, body: bytes | None) -> list[dict]:
        """The rules with enough strings in ``body``."""
        if body is None:
            return []
        lower, found = body.lower(), {}

        def hit(s: Signature) -> None:
            found.setdefault((s.rule, s.min_hits), set()).add(s.string_id)

        fits = lambda s: s.max_size is None or len(body) <= s.max_size
        for automaton, text in ((self.exact, body), (self.folded, lower)):
            met = {id(x): x for _, x in automaton.iter(text.decode("latin-1"))} if automaton else {}
            for s in (s for some in met.values() for s in some):
                if fits(s) and (not s.check or s.check.search(body)):
                    hit(s)
        for s in self.single:
            if fits(s) and s.there(body, lower):
                hit(s)
        open_ = {}
        for s in filter(fits, self.regexes):
            open_.setdefault((s.rule, s.min_hits), []).append(s)
        for key, some in open_.items():
            held = found.get(key, set())
            if len(held | {s.string_id for s in some}) >= key[1]:  # else the rule can't fire whatever they find
                for s in some:
                    if s.string_id not in held and s.there(body, lower):
                        hit(s)
        enough = [(rule, ids) for (rule, least), ids in found.items() if len(ids) >= least]
        return [{"rule": rule, "hits": len(ids), "strings": sorted(ids)} for rule, ids in sorted(enough)]


def _automaton(words: dict[bytes, list[Signature]]) -> ahocorasick.Automaton | None:
    if not words:
        return None
    made = ahocorasick.Automaton()
    for word, some in words.items():
        made.add_word(word.decode("latin-1"), some)
    made.make_automaton()
    return made


def scan_signatures(files: DataFrame, signatures: DataFrame, content: str = "content", file_id: str = "path") -> DataFrame:
    """Files that hold enough of a rule's strings, a row for each file and rule.

    ``signatures``: ``rule, string_id, kind`` (text, nocase, hex, regex), ``pattern, at_offset`` (null: anywhere), ``min_hits``
    of the rule, ``max_size`` of the file (null: any). Strings are bytes (UTF-8); nocase folds A-Z; a hex string may hold ``..``
    for any byte. Text, nocase and hex strings of all rules are found together by an automaton, regexes are tried only where
    a rule can still fire. A null content or pattern matches nothing; a file that comes twice is judged twice.
    """
    rows = [tuple(r) for r in signatures.select(*COLUMNS).limit(MAX_STRINGS + 1).collect()]
    if len(rows) > MAX_STRINGS:
        raise ValueError(f"more than {MAX_STRINGS} strings in the rules")
    SignatureSet(rows)  # patterns that can't be read are refused here

    @F.arrow_udf(FIRED)
    def scan(bodies: Iterator[pa.Array]) -> Iterator[pa.Array]:
        rules = SignatureSet(rows)
        for part in bodies:
            yield pa.array([rules.fired(x.as_py()) for x in part], _FIRED)

    body = F.col(content).cast("binary")
    judged = files.select(F.col(file_id), body.alias("_body")).withColumn("_fired", scan.asNondeterministic()("_body"))  # so it runs once a file
    hits = judged.select(file_id, "_body", F.explode("_fired").alias("_f"))
    return hits.select(file_id, "_f.rule", "_f.hits", "_f.strings", F.sha2("_body", 256).alias("sha256"), file_type(F.col("_body")).alias("file_type")).withColumns(
        {"severity": F.lit("CRITICAL"), "confidence": F.lit(90.0)}
    )
