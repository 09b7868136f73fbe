"""URL filtering by a weighted vocabulary and host rules.

One Aho-Corasick automaton finds all terms in the lower-cased url at once. A hit counts where it is bounded: the characters
before and after it are no letters of a-z and no digits. A strict term rejects by itself, soft terms by the weight of the
distinct ones that occur. A host rule (host suffix and path prefix) goes before the vocabulary; the longest host wins, then
the longest path.

Cases: a null url or one without ``://`` has empty host and path; the vocabulary still looks at the whole url, a null one is
allowed; rows are returned one for one, with repeated and null ids; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from netquill.llm.common import documents_of

STRICT = ("adult", "casino", "hentai", "porn", "porno", "xxx", "escort", "warez", "malware", "phishing")
#: Soft terms and their weights; a url goes when the distinct soft terms in it weigh ``SOFT_LIMIT`` or more.
SOFT = {
    "spam": 1, "farm": 1, "cheap": 1, "pills": 1, "free": 1, "bets": 1, "bet": 1, "betting": 1, "win": 1, "ads": 1, "track": 1, "tracker": 1,
    "viagra": 1, "poker": 1, "slots": 1, "loan": 1, "loans": 1, "sex": 1, "dating": 1, "torrent": 1, "crack": 1, "keygen": 1, "replica": 1, "clickbait": 1,
}
SOFT_LIMIT = 2
#: (kind, host suffix, path prefix)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
_PARTS = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def split_url(url: str | None) -> tuple[str, str]:
    m = _PARTS.search(url or "")
    return (m[1].translate(_LOWER), m[2]) if m else ("", "")


def rule_of(host: str, path: str, rules: dict[str, list[tuple[str, str]]]) -> tuple[str, str] | None:
    """(kind, rule text) of the longest rule that fits. ``rules``: by host suffix, longest path prefix first."""
    at = 0
    while host:
        for prefix, kind in rules.get(host[at:], ()):
            if path.startswith(prefix):
                return kind, host[at:] + prefix
        at = host.find(".", at) + 1
        if not at:
            return None
    return None


def bounded_hits(automaton, text: str) -> dict[str, int]:
    """Counts of the terms that stand alone in the text."""
    found: dict[str, int] = {}
    for end, term in automaton.iter(text):
        start = end - len(term)
        if (start < 0 or text[start] not in _WORD) and (end + 1 == len(text) or text[end + 1] not in _WORD):
            found[term] = found.get(term, 0) + 1
    return found


def judge_urls(pages: DataFrame, strict=STRICT, soft=SOFT, soft_limit: int = SOFT_LIMIT, rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, strict_hits, soft_hits`` for each page."""
    by_host: dict[str, list[tuple[str, str]]] = {}
    for kind, host, prefix in sorted(rules, key=lambda r: -len(r[2])):
        by_host.setdefault(host, []).append((prefix, kind))
    strict, soft = frozenset(strict), dict(soft)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for term in strict | soft.keys():
            automaton.add_word(term, term)
        automaton.make_automaton()
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                hits = bounded_hits(automaton, (url or "").translate(_LOWER))
                hard = sum(n for t, n in hits.items() if t in strict)
                mild = sum(soft[t] for t in hits if t in soft)
                rule = rule_of(host, path, by_host)
                verdict = rule[0] if rule else "block" if hard or mild >= soft_limit else "allow"
                for column, value in zip(out, (host, path, rule and rule[1], verdict, hard, mild)):
                    column.append(value)
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32())
            names = ["page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_hits"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(out, kinds))], names=names)

    return documents_of(pages, "page_id", "url").mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, strict_hits int, soft_hits int")
