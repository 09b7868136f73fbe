"""Lexical expressions over names, urls and payloads: entropy, consonant runs, domains, generated-domain score, file types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: suffixes under which a two-letter top-level domain registers names
SECOND_LEVEL = ("co", "com", "org", "net", "gov", "edu", "ac", "or", "ne", "go")
# fixed values: leading bytes of file types, in the order they are tried
MAGIC = (
    ("4D5A", "pe_executable"), ("7F454C46", "elf_executable"), ("255044462D", "pdf"), ("504B0304", "zip_or_office_ooxml"),
    ("D0CF11E0A1B11AE1", "ole_legacy_office"), ("1F8B", "gzip"), ("526172211A07", "rar"), ("2321", "script_shebang"),
)


def chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def entropy(s: Column) -> Column:
    """Shannon entropy in bits of a string's characters; 0 for null and empty."""
    n = F.length(s)
    share = lambda c: (n - F.length(F.replace(s, c, F.lit("")))) / n
    terms = F.transform(F.array_distinct(chars(s)), lambda c: share(c) * F.log2(share(c)))
    return F.coalesce(-F.aggregate(terms, F.lit(0.0), lambda a, b: a + b), F.lit(0.0))


def consonant_run(s: Column) -> Column:
    """Length of the longest run of ASCII letters that are no (lower-case) vowels."""
    runs = F.transform(F.regexp_extract_all(s, F.lit("([A-Zb-df-hj-np-tv-z]+)"), F.lit(1)), lambda x: F.length(x))
    return F.coalesce(F.array_max(runs), F.lit(0))


_CLASSES = {"digit": "[^0-9]", "vowel": "[^aeiou]", "letter": "[^A-Za-z]", "alnum": "[^A-Za-z0-9]"}


def count_of(s: Column, kind: str) -> Column:
    """How many characters of a class (digit, vowel, letter, alnum) a string has."""
    return F.length(F.regexp_replace(s, _CLASSES[kind], ""))


def char_ratio(s: Column, kind: str, of: str | None = None) -> Column:
    """Share of a class among all characters, or among those of the class ``of``; 0 where there are none."""
    total = count_of(s, of) if of else F.length(s)
    return F.when(total > 0, count_of(s, kind) / total).otherwise(0.0)


def labels(name: Column) -> Column:
    """Labels of a domain name but the last, lower-cased; a bare token is its own label."""
    parts = F.filter(F.split(F.rtrim(F.lower(F.trim(name)), F.lit(".")), r"\."), lambda x: x != "")
    return F.when(F.size(parts) > 1, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def registrable_domain(name: Column) -> Column:
    """The name's last two labels, or three under a second-level suffix of a country."""
    parts = F.filter(F.split(F.rtrim(F.lower(F.trim(name)), F.lit(".")), r"\."), lambda x: x != "")
    n = F.size(parts)
    country = (n > 2) & (F.length(F.try_element_at(parts, F.lit(-1))) == 2) & F.try_element_at(parts, F.lit(-2)).isin(*SECOND_LEVEL)
    take = F.least(n, F.when(country, 3).otherwise(2))
    return F.when(n > 0, F.array_join(F.slice(parts, n - take + 1, take), ".")).otherwise("")


def _unit(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def label_score(label: Column) -> Column:
    """How much a label looks generated, from 0 to 1: high entropy, few vowels, long consonant runs, digits, length."""
    vowels = F.when(count_of(label, "letter") > 0, count_of(label, "vowel") / count_of(label, "letter")).otherwise(0.0)
    digits = count_of(label, "digit") / F.length(label)
    score = (
        0.40 * _unit((entropy(label) - 3.0) / 1.5)
        + 0.30 * _unit((0.30 - vowels) / 0.30)
        + 0.20 * _unit((consonant_run(label) - 3) / F.lit(4.0))
        + 0.10 * _unit(digits / 0.40)
        + F.when(F.length(label) >= 18, 0.05).otherwise(0.0)
    )
    return F.when(F.length(label) > 0, _unit(score)).otherwise(0.0)


def dga_score(name: Column) -> Column:
    """The greatest score of a name's labels."""
    return F.coalesce(F.array_max(F.transform(labels(name), label_score)), F.lit(0.0))


def file_type(content: Column) -> Column:
    """The type that the first bytes tell, else ``unknown``."""
    head, out = F.hex(F.substring(content, 1, 8)), F.lit("unknown")
    for magic, name in reversed(MAGIC):
        out = F.when(head.startswith(magic), name).otherwise(out)
    return out


def technique_id(message: Column) -> Column:
    """The first ATT&CK technique id of a message; null if it has none."""
    found = F.regexp_extract(message, r"\b(T\d{4}(?:\.\d{3})?)\b", 1)
    return F.when(found != "", found)


def first_evidence(json: Column, *keys: str) -> Column:
    """The first non-empty value of the keys in a JSON object."""
    return F.coalesce(*[F.nullif(F.get_json_object(json, f"$.{k}"), F.lit("")) for k in keys])


def is_pki_fetch(uri: Column) -> Column:
    """Certificate downloads: a known suffix, or one long path segment that decodes to nested DER sequences."""
    path = F.substring_index(uri, "?", 1)
    suffix = F.lower(path).rlike(r"\.(crl|crt|cer|cab|stl|ctl|der|p7c|p7b)$")
    segment = F.translate(F.url_decode(F.when(~path.rlike("%(?![0-9A-Fa-f]{2})"), F.replace(F.ltrim(path, F.lit("/")), F.lit("+"), F.lit("%2B")))), "-_", "+/")
    padded = F.concat(segment, F.repeat(F.lit("="), F.pmod(-F.length(segment), F.lit(4))))
    der = F.hex(F.try_to_binary(padded, F.lit("base64")))
    second = F.conv(F.substring(der, 3, 2), 16, 10).cast("int")
    inner = 2 + F.when(second.isin(0x81, 0x82), second - 0x80).otherwise(0)
    nested = (F.length(der) > 20) & der.startswith("30") & (second <= 0x82) & (F.substr(der, 2 * inner + 1, F.lit(2)) == "30")
    long_ = (F.length(F.ltrim(path, F.lit("/"))) >= 40) & ~F.ltrim(path, F.lit("/")).contains("/")
    return F.coalesce(suffix | (long_ & F.coalesce(nested, F.lit(False))), F.lit(False))
