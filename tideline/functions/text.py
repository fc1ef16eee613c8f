"""Keys, slugs and text clean-up."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable
from functools import reduce
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """True when ``text`` holds any of ``words`` as a substring (H6)."""
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def found_in(text: Column, words: Iterable[str], whole_word: bool = False) -> Column:
    """The members of ``words`` that occur in ``text``, in list order."""
    if whole_word:
        probes = [text.rlike(r"(?<![a-z0-9])\Q" + w + r"\E(?![a-z0-9])") for w in words]
    else:
        probes = [text.contains(w) for w in words]
    return F.array_compact(F.array(*[F.when(p, F.lit(w)) for p, w in zip(probes, words)]))


def cut(text: Column, length: int | None) -> Column:
    """The first ``length`` characters; all of them without a length."""
    return text if length is None else F.substring(text, 1, length)


def first_of(values: Column, n: int | None) -> Column:
    """The first ``n`` items of an array; all of them without a number."""
    return values if n is None else F.slice(values, 1, n)


def nonblank(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def company_slug(name: Column) -> Column:
    """P1"""
    return F.trim(F.translate(F.lower(name), " .,", "--"), F.lit("-"))


def job_slug(title: Column, length: int | None = None) -> Column:
    """The whole slug, which is the key of a job; cut only for display."""
    dashed = F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-")
    return cut(F.trim(dashed, F.lit("-")), length)


def fingerprint(*parts: Column) -> Column:
    """First 16 hex digits of SHA-256 over the colon-joined parts."""
    joined = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.substring(F.sha2(joined, 256), 1, 16)


def signal_key(name: Column, kind: Column, url: Column, at: Column) -> Column:
    """P2"""
    return fingerprint(name, kind, url, F.to_date(at))


def role_key(url: Column) -> Column:
    """P3"""
    return fingerprint(url)


def job_fingerprint(title: Column, location: Column, url: Column) -> Column:
    """P12"""
    joined = F.concat_ws(":", *[F.coalesce(p, F.lit("")) for p in (title, location, url)])
    return F.substring(F.md5(joined), 1, 8)


def page_hash(html: Column) -> Column:
    """P12"""
    return F.substring(F.md5(html), 1, 16)


NAME_SLOTS = 4096
# Stand for a character that can be in no other reference, so they can go before the rest.
PLAIN_REFERENCES = {"&quot;": '"', "&lt;": "<", "&gt;": ">", "&apos;": "'", "&#39;": "'"}


def _reference(name: Column) -> Column:
    """What a character reference, without ``&`` and ``;``, stands for; null if nothing."""
    number = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 100), 16, 10)).otherwise(F.substring(name, 2, 100))
    code = number.try_cast("bigint")
    valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    letter = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code)), 8, "0")), "UTF-32")
    # A map is searched from its first key on, so the names are dealt to small maps by hash.
    slots: list[dict[str, str]] = [{} for _ in range(NAME_SLOTS)]
    for known, value in html5.items():
        if known.endswith(";"):
            slots[zlib.crc32(known[:-1].encode()) % NAME_SLOTS][known[:-1]] = value
    names = F.from_json(F.lit(json.dumps(slots)), "array<map<string,string>>")
    slot = F.get(names, (F.crc32(name.cast("binary")) % NAME_SLOTS).cast("int"))
    return F.when(name.startswith("#"), F.coalesce(letter, F.lit("\ufffd"))).otherwise(F.try_element_at(slot, name))


def unescape(text: Column) -> Column:
    """Decode all named and numeric character references, each once; what is none
    stays as it is."""

    def decoded(piece: Column, at: Column) -> Column:
        # The name is worked out once: in the lambda it is a value, not its expression.
        found = F.array(F.regexp_extract(piece, "^(#[xX][0-9a-fA-F]+|#[0-9]+|[A-Za-z][A-Za-z0-9]*);", 1))
        whole = F.transform(found, lambda name: F.concat(F.when(name != "", _reference(name)), F.substr(piece, F.length(name) + 2)))
        return F.when(at == 0, piece).otherwise(F.coalesce(F.get(whole, 0), F.concat(F.lit("&"), piece)))

    def opened(t: Column) -> Column:
        return F.when(t.contains("&"), F.array_join(F.transform(F.split(t, "&"), decoded), "")).otherwise(t)

    def plain(t: Column) -> Column:
        less = reduce(lambda left, r: F.replace(left, F.lit(r[0]), F.lit(r[1])), PLAIN_REFERENCES.items(), t)
        return F.when(t.contains("&"), F.get(F.transform(F.array(less), opened), 0)).otherwise(t)

    # ``text`` may be a costly expression: it is worked out once, too.
    return F.get(F.transform(F.array(text), plain), 0)


def squeeze(text: Column) -> Column:
    """Runs of white space to one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\s ]+", " "))


def tidy(text: Column) -> Column:
    """Decode references, drop tags, squeeze."""
    return squeeze(F.regexp_replace(unescape(F.coalesce(text, F.lit(""))), "<[^>]+>", " "))


def board_token(text: Column, patterns: Iterable[str], lower: bool) -> Column:
    """First group of the first pattern that fits; null when none does."""
    tries = [F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), p, 1), F.lit("")) for p in patterns]
    token = F.trim(F.coalesce(*tries))
    return F.lower(token) if lower else token


def url_host(url: Column) -> Column:
    """Host of an absolute URL, null otherwise; never fails on bad input."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def source_host(url: Column) -> Column:
    """Host without a leading www., jobs. or news. label."""
    bare = F.regexp_replace(url_host(url), r"^www\.", "")
    return F.regexp_replace(F.regexp_replace(bare, r"^jobs\.", ""), r"^news\.", "")


def site_origin(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+)", 1), F.lit(""))


def absolute_url(base: Column, href: Column) -> Column:
    """Resolve ``href`` against ``base``: absolute, scheme-relative, rooted,
    query/fragment-only and sibling references."""
    origin = F.coalesce(site_origin(base), F.lit(""))
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*:)//", 1)
    path = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.when(path == origin, F.concat(origin, F.lit("/"))).otherwise(F.regexp_replace(path, r"[^/]*$", ""))
    href = F.coalesce(href, F.lit(""))
    return (
        F.when(href == "", base)
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("?"), F.concat(path, href))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, r"#.*$", ""), href))
        .otherwise(F.concat(folder, href))
    )


def distinct_ignoring_case(values: Column) -> Column:
    """P25: trimmed, blanks dropped, first spelling of each word kept in order."""
    trimmed = F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != "")
    keys = F.transform(trimmed, lambda v: F.lower(v))
    return F.filter(trimmed, lambda v, i: F.array_position(keys, F.lower(v)) == i + 1)


def stage_key(text: Column) -> Column:
    """P25: 'Series A' -> 'series_a'."""
    return F.replace(F.lower(F.trim(text)), F.lit(" "), F.lit("_"))


def stage_words(key: Column) -> Column:
    """P25: 'series_a' -> 'series a'."""
    return F.lower(F.trim(F.replace(key, F.lit("_"), F.lit(" "))))
