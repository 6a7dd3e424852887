"""Masking, hashing and naming expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.functions.base import pick, strip


def mask_secret(value: Column) -> Column:
    """First and last four characters, stars between; short values are all stars."""
    n = F.length(value)
    masked = F.concat(F.left(value, F.lit(4)), F.repeat(F.lit("*"), n - 8), F.right(value, F.lit(4)))
    return F.when(n <= 8, F.repeat(F.lit("*"), n)).otherwise(masked)


def mask_webhook(url: Column) -> Column:
    """Hide the token parts of a `/services/...` hook; other URLs keep 12 characters."""
    shape = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)(.*)$"
    host, path, rest = (F.regexp_extract(url, shape, i) for i in (1, 2, 3))
    parts = F.split(F.btrim(path, F.lit("/")), "/")
    hide = lambda p: F.when(
        F.length(p) > 4, F.concat(F.left(p, F.lit(3)), F.lit("...****"))
    ).otherwise(F.repeat(F.lit("*"), F.length(p)))
    tokens = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), hide)
    hook = (F.size(parts) >= 3) & (F.get(parts, F.lit(0)) == "services")
    plain = F.when(F.length(url) > 15, F.concat(F.left(url, F.lit(12)), F.lit("...********"))).otherwise(
        F.repeat(F.lit("*"), F.length(url))
    )
    return (
        F.when(F.coalesce(url, F.lit("")) == "", "")
        .when(hook, F.concat(host, F.lit("/services/"), F.array_join(tokens, "/"), rest))
        .otherwise(plain)
    )


def mask_db_url(url: Column) -> Column:
    """Hide the password of a connection URI."""
    return F.regexp_replace(
        F.coalesce(url, F.lit("")),
        r"^([A-Za-z][A-Za-z0-9+.-]*://[^:/?#]*):[^/?#]+@([^/?#@]*)",
        "$1:********@$2",
    )


def git_secret_id(pattern_name: Column, short_hash: Column, path: Column) -> Column:
    """Stable id of a secret found in history."""
    slug = F.btrim(F.upper(F.regexp_replace(pattern_name, "[^a-zA-Z0-9]", "-")), F.lit("-"))
    return F.concat_ws("-", F.lit("GIT-SECRET"), slug, short_hash, F.left(F.sha2(path, 256), F.lit(6)))


def dep_key(ecosystem: Column, name: Column, version: Column) -> Column:
    """Key of one look-up: 16 hex digits over ecosystem, name and version."""
    return F.left(F.sha2(F.concat_ws(":", ecosystem, name, version), 256), F.lit(16))


def coordinate(ecosystem: Column, name: Column, version: Column, group_id: Column) -> Column:
    maven = F.concat_ws(":", F.coalesce(group_id, F.lit("unknown")), name, version)
    return F.when(ecosystem == "maven", maven).otherwise(F.concat_ws("@", name, version))


def purl(ecosystem: Column, name: Column, version: Column) -> Column:
    return F.concat(F.lit("pkg:"), ecosystem, F.lit("/"), name, F.lit("@"), version)


def clean_npm_version(spec: Column) -> Column:
    """Version without the leading range signs."""
    return strip(F.regexp_replace(spec, r"^[~^>=<|!\s]+", ""))


def truncate_evidence(text: Column, limit: int = 200) -> Column:
    return F.left(text, F.lit(limit))


def shannon_entropy(text: Column) -> Column:
    """Bits per character."""
    n = F.length(text).cast("double")
    chars = F.array_distinct(F.split(text, ""))
    share = lambda ch: (n - F.length(F.replace(text, ch, F.lit("")))) / n
    shares = F.transform(F.filter(chars, lambda ch: ch != ""), share)
    bits = F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))
    return F.when(n > 0, bits).otherwise(0.0)


# Words of versions that come before the release, at it, and after it.
PRE_WORDS = {"a": "alpha", "b": "beta", "c": "rc", "pre": "rc", "preview": "rc", "cr": "rc", "dev": ""}
RELEASE_WORDS = ["final", "ga", "release"]
POST_WORDS = ["post", "rev", "r", "sp"]


DIGITS = 24


def _numbers(dotted: Column) -> Column:
    """Parts as digits of one width, which compare as the numbers do."""
    bare = F.regexp_replace(dotted, r"(\.0+)+$", "")
    return F.transform(F.split(bare, r"\."), lambda p: F.lpad(p, DIGITS, "0"))


def _version(numbers: Column, phase: Column, rest: Column) -> Column:
    """One text that orders as the three do one after the other: `!` comes before digits and letters."""
    return F.concat(F.array_join(numbers, ""), F.lit("!"), phase.cast("string"), F.lit("!"), F.array_join(rest, "!"))


def version_key(version: Column) -> Column:
    """Versions as a text that orders them: numbers (up to 24 digits) part by part, then the words behind them.

    Trailing zero parts are dropped, so that 1.0 and 1.0.0 are equal. Pre-releases (1.0-beta.2, 1.0rc1, 1.0.dev3)
    come before their release, post-releases after it; what follows a `+` does not count. Others give null.
    """
    number = rf"[0-9]{{1,{DIGITS}}}"
    text = F.lower(F.regexp_replace(version, r"^[vV=]+|\+.*$", ""))
    shape = rf"^({number}(?:\.{number})*)(?:[-._]?([a-z][-._a-z0-9]*)|-([0-9][-._a-z0-9]*))?$"
    tail = F.concat(F.regexp_extract(text, shape, 2), F.regexp_extract(text, shape, 3))
    words = F.regexp_extract_all(tail, F.lit("[a-z]+|[0-9]+"), F.lit(0))
    first = F.get(words, F.lit(0))
    phase = F.when((tail == "") | first.isin(RELEASE_WORDS), 1).when(first.isin(POST_WORDS), 2).otherwise(0)
    rest = F.transform(
        words,
        lambda w: F.when(w.rlike("^[a-z]"), F.concat(F.lit("w"), pick(w, PRE_WORDS, w))).otherwise(F.concat(F.lit("n"), F.lpad(w, DIGITS, "0"))),
    )
    none = F.array().cast("array<string>")
    full = _version(_numbers(F.regexp_extract(text, shape, 1)), phase, F.when(phase != 1, rest).otherwise(none))
    plain = _version(_numbers(version), F.lit(1), none)
    return F.when(version.rlike(rf"^{number}(\.{number})*$"), plain).when(text.rlike(shape), full)


def package_key(ecosystem: Column, name: Column, group: Column) -> Column:
    """A name as its ecosystem compares it: PyPI ignores case and kinds of dashes, Maven names group and artifact."""
    pypi = F.lower(F.regexp_replace(name, "[-_.]+", "-"))
    maven = F.when(F.coalesce(group, F.lit("")) == "", name).otherwise(F.concat(group, F.lit(":"), name))
    return F.when(ecosystem == "pypi", pypi).when((ecosystem == "maven") & ~F.contains(name, F.lit(":")), maven).otherwise(name)
