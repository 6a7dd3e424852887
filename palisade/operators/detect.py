"""Rules, secrets and baselines against the texts of files.

All three are expressions over one text that give an array of matches, so a corpus is read once
for all of them and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions import config_type, glob_match, has_excluded_dir, is_config_file, mask_secret, shannon_entropy
from palisade.functions.base import any_of
from palisade.operators.common import DETECTORS, finding, java_pattern, literal_table, source_lines, usable_rows
from palisade.operators.literals import matches_in_text, required_texts
from palisade.operators.scoring import BANKING_WORDS, holds_any
from palisade.schemas import SECRET_PATTERN
from palisade.session import cut_lineage

# Marks a match start while lines are counted; if a text holds the character, it is swapped first.
MARK, STAND_IN = "\uf8ff", "\uf8fe"
CONTEXT_RADIUS = 2
SECRET_REMEDIATION = "Rotate the credential and load it from a secret store."
MATCH = "struct<entry:int,match_no:bigint,line_number:int,evidence:string,detail:string>"
# What a match is about: one entry per rule, pattern or check.
ENTRY = """detector string, rule_id string, title string, description string, severity string,
       category string, remediation string, references array<string>, tags array<string>,
       kind string, check_type string"""


def _match(entry: int, line: Column, evidence: Column, match_no=None, detail=None) -> Column:
    return F.struct(
        F.lit(entry).alias("entry"),
        (F.lit(0) if match_no is None else match_no).cast("bigint").alias("match_no"),
        line.cast("int").alias("line_number"),
        evidence.alias("evidence"),
        (F.lit(None) if detail is None else detail).cast("string").alias("detail"),
    )


def _none() -> Column:
    return F.array().cast(f"array<{MATCH}>")


def _where(condition: Column, matches: Column) -> Column:
    return F.when(condition, matches).otherwise(_none())


def config_file(files: DataFrame) -> Column:
    """True for files that the rule scan reads: configuration files outside the skipped folders."""
    column = "relative_path" if "relative_path" in files.columns else "path"
    return is_config_file(F.col("path")) & ~has_excluded_dir(F.col(column), "config")


def config_files(files: DataFrame) -> DataFrame:
    return files.filter(config_file(files))


def match_lines(content: Column, pattern: str) -> Column:
    """Line number of every match, in match order.

    A mark goes in front of each match; the lines are then counted by their marks. Linear in the
    text, for any number of matches.
    """
    marked = F.regexp_replace(
        F.replace(content, F.lit(MARK), F.lit(STAND_IN)), F.lit(pattern), F.lit(MARK + "$0")
    )
    per_line = F.transform(
        F.split(marked, "\n"),
        lambda line, i: F.array_repeat(i + 1, F.length(line) - F.length(F.replace(line, F.lit(MARK), F.lit("")))),
    )
    return F.flatten(per_line)


def _whole(text: Column) -> Column:
    """Hash of a match that is longer than its evidence, so that matches with one start stay apart."""
    return F.when(F.length(text) > 200, F.sha2(text.cast("binary"), 256))


def rule_matches(rule, entry: int) -> Column:
    """All matches of one rule in a text. The cheap test comes first."""
    content, pattern = F.col("content"), java_pattern(rule["pattern"])
    texts = F.regexp_extract_all(content, F.lit(pattern), F.lit(0))
    rows = F.transform(
        F.arrays_zip(texts.alias("text"), match_lines(content, pattern).alias("line")),
        lambda m, i: _match(entry, m["line"], F.left(m["text"], F.lit(200)), i, _whole(m["text"])),
    )
    return _where(glob_match(F.col("path"), rule["file_types"]) & content.rlike(pattern), rows)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def secret_matches(patterns: list, first_entry: int, min_entropy: float | None) -> Column:
    """First match of every pattern in every line, masked.

    A pattern is tried on the lines of a text only if the text holds one of the pattern's required texts or, if it has
    none, matches as a whole; a pattern of which neither is proven is always tried.
    """
    content = F.col("content")

    def may_match(lower: Column, pattern: str) -> Column:
        texts = required_texts(pattern)
        if texts:
            return any_of([lower.contains(x) for x in texts])
        return content.rlike(pattern) if matches_in_text(pattern) else F.lit(True)

    def tried(lower: Column) -> Column:
        return F.array(*[may_match(lower, java_pattern(p["pattern"])) for p in patterns])

    def hits(line: Column, possible: Column) -> Column:
        found = []
        for no, p in enumerate(patterns):
            pattern = java_pattern(p["pattern"])
            value = F.regexp_extract(line["text"], pattern, 0)
            counts = F.get(possible, F.lit(no)) & line["text"].rlike(pattern)
            if min_entropy is not None:
                counts = counts & (shannon_entropy(value) >= min_entropy)
            order = line["n"].cast("bigint") * F.lit(1 << 16) + no
            found.append(F.when(counts, _match(first_entry + no, line["n"], mask_secret(value), order)))
        return F.array_compact(F.array(*found))

    def rows(possible: Column) -> Column:
        lines = F.transform(F.split(content, "\n"), lambda text, i: F.struct(text.alias("text"), (i + 1).alias("n")))
        some = lambda line: any_of([F.get(possible, F.lit(no)) & line["text"].rlike(java_pattern(p["pattern"])) for no, p in enumerate(patterns)])
        return _where(F.exists(possible, lambda x: x), F.flatten(F.transform(F.filter(lines, some), lambda line: hits(line, possible))))

    return _bound(_bound(F.lower(content), tried), rows)


def drift_match(check, entry: int) -> Column:
    """What one check has against a text, or null."""
    content, pattern = F.col("content"), java_pattern(check["pattern"])
    hit = content.rlike(pattern)
    matched = F.regexp_extract(content, pattern, 0)
    start = F.regexp_instr(content, F.lit(pattern))
    line = F.size(F.split(F.left(content, start - 1), "\n"))
    absence = {
        "must_exist": ("Expected pattern not found: ", "Pattern not present in file"),
        "must_match": ("Required pattern not matched: ", "Pattern not matched"),
    }
    presence = {
        "must_not_exist": "Forbidden pattern found: ",
        "must_not_match": "Insecure pattern matched: ",
    }
    of_kind = F.col("_kind") == check["config_type"]
    if check["check_type"] in absence:
        detail, evidence = absence[check["check_type"]]
        missing = _match(entry, F.lit(0), F.lit(evidence), detail=F.lit(detail + check["pattern"]))
        return F.when(of_kind & ~hit, missing)
    if check["check_type"] in presence:
        detail = F.concat(F.lit(presence[check["check_type"]]), matched)
        return F.when(of_kind & hit, _match(entry, line, F.left(matched, F.lit(200)), detail=detail))
    return F.lit(None).cast(MATCH)


def _rule_entry(r) -> dict:
    return {
        "detector": "misconfig", "rule_id": r["rule_id"], "title": r["name"], "description": r["description"],
        "severity": r["severity"], "category": "misconfig", "remediation": r["remediation"],
        "references": r["references"], "tags": r["tags"], "kind": r["category"], "check_type": None,
    }


def _secret_entry(p) -> dict:
    slug = "".join(ch if ch.isascii() and ch.isalnum() else "-" for ch in p["name"]).upper()
    return {
        "detector": "secret", "rule_id": f"SECRET-{slug}", "title": p["name"], "description": p["description"],
        "severity": p["severity"], "category": "secret", "remediation": SECRET_REMEDIATION,
        "references": [], "tags": p["tags"], "kind": p["name"], "check_type": None,
    }


def _check_entry(c) -> dict:
    return {
        "detector": "drift", "rule_id": c["check_id"], "title": c["name"], "description": c["description"],
        "severity": c["severity"], "category": "drift", "remediation": c["remediation"],
        "references": [], "tags": c["tags"], "kind": c["config_type"], "check_type": c["check_type"],
    }


def _context_flags(n_rules: int) -> Column:
    """Matches with `context_keyword`: whether a banking word is within two lines of a rule match.

    Where there are many matches all lines are tested once (`_words`), else only those around a match.
    """
    first = lambda m: F.greatest(m["line_number"] - CONTEXT_RADIUS, F.lit(1))
    around = lambda m, lines: F.slice(
        F.col(lines), first(m), m["line_number"] + CONTEXT_RADIUS - first(m) + 1
    )
    near = lambda m: F.when(
        F.col("_words").isNotNull(), F.exists(around(m, "_words"), lambda hit: hit)
    ).otherwise(F.exists(around(m, "_lines"), _holds_word))
    return F.transform(
        "_found",
        lambda m: m.withField(
            "context_keyword", F.when(m["entry"] < n_rules, near(m)).otherwise(F.lit(False))
        ),
    )


def _holds_word(line: Column) -> Column:
    return holds_any(F.lower(line), BANKING_WORDS)


@dataclass(frozen=True)
class Entries:
    """What matches are about: rules first, then secret patterns, then checks."""

    rows: list[dict]
    n_rules: int
    n_patterns: int


def matched_files(
    files: DataFrame,
    rules: DataFrame | None = None,
    patterns: DataFrame | None = None,
    checks: DataFrame | None = None,
    min_entropy: float | None = None,
    only_config: bool = False,
    routes: dict[str, list[str]] | None = None,
    also: dict[str, Column] | None = None,
) -> tuple[DataFrame, Entries]:
    """scan_id, path, _matches (all matches in the file) and the columns of `also`, from one pass over the files.

    Parameters as for `scan_files`; `findings_of` makes findings of the rows.
    """
    rule_rows = usable_rows(rules) if rules is not None else []
    pattern_rows = usable_rows(patterns) if patterns is not None else []
    check_rows = usable_rows(checks) if checks is not None else []
    entries = (
        [_rule_entry(r) for r in rule_rows]
        + [_secret_entry(p) for p in pattern_rows]
        + [_check_entry(c) for c in check_rows]
    )
    on = lambda name: F.col("scan_type").isin(routes[name]) if routes else F.lit(True)
    parts = []
    if rule_rows:
        wanted = on("misconfig") & config_file(files) if only_config else on("misconfig")
        found = F.flatten(F.array(*[rule_matches(r, no) for no, r in enumerate(rule_rows)]))
        parts.append(_where(wanted, found))
    if pattern_rows:
        parts.append(_where(on("secret"), secret_matches(pattern_rows, len(rule_rows), min_entropy)))
    if check_rows:
        first = len(rule_rows) + len(pattern_rows)
        found = F.array_compact(F.array(*[drift_match(c, first + no) for no, c in enumerate(check_rows)]))
        kinds = sorted({c["config_type"] for c in check_rows})
        parts.append(_where(on("drift") & F.col("_kind").isin(kinds), found))
    parts.append(F.array().cast(f"array<{MATCH}>"))
    also = also or {}
    scanned = files.withColumn("_kind", config_type(F.col("path"))).select(
        "scan_id", "path", "content", F.concat(*parts).alias("_found"), *(c.alias(n) for n, c in also.items())
    )
    lines = F.when(F.exists("_found", lambda m: m["entry"] < len(rule_rows)), F.split("content", "\n"))
    many = F.size("_found") * (2 * CONTEXT_RADIUS + 1) > F.size("_lines")
    rows = (
        scanned.select("scan_id", "path", "_found", lines.alias("_lines"), *also)
        .select("*", F.when(many, F.transform("_lines", _holds_word)).alias("_words"))
        .select("scan_id", "path", _context_flags(len(rule_rows)).alias("_matches"), *also)
    )
    return rows, Entries(entries, len(rule_rows), len(pattern_rows))


def scan_files(
    files: DataFrame,
    rules: DataFrame | None = None,
    patterns: DataFrame | None = None,
    checks: DataFrame | None = None,
    min_entropy: float | None = None,
    only_config: bool = False,
    routes: dict[str, list[str]] | None = None,
    keep_context_text: bool = False,
) -> DataFrame:
    """Findings of the given rules, secret patterns and baseline checks, from one pass over the files.

    Patterns go into the plan as constants, so each is compiled once per task. `only_config` lets
    rules see configuration files only. `routes` (detector to scan types) needs a `scan_type`
    column. `context_keyword` is all that scoring needs of the lines around a match; their text is
    added on request (the matches are then written out, so that the scan is not run twice).
    """
    if rules is None and patterns is None and checks is None:
        raise ValueError("nothing to look for")
    matched, entries = matched_files(files, rules, patterns, checks, min_entropy, only_config, routes)
    return findings_of(matched, entries, files if keep_context_text else None)


def matched_chunks(
    chunks: DataFrame,
    rules: DataFrame | None = None,
    patterns: DataFrame | None = None,
    checks: DataFrame | None = None,
    min_entropy: float | None = None,
    only_config: bool = False,
    routes: dict[str, list[str]] | None = None,
) -> tuple[DataFrame, Entries]:
    """As `matched_files`, for files that come as chunks of lines (`sources.large`), with the files' line numbers.

    A match counts in the chunk in which its first line is an own one. What a check wants must be missing in every
    chunk, and what it forbids counts at its first place in the file. As whole files give them, as long as a match and
    what it looks at lie within the chunk's margins.
    """
    place = {n: F.col(n) for n in ("first_line", "n_lead", "n_lines")}
    matched, entries = matched_files(chunks, rules, patterns, checks, min_entropy, only_config, routes, place)
    matched = cut_lineage(matched)
    n_texts = entries.n_rules + entries.n_patterns
    each = matched.select("scan_id", "path", *place, F.inline("_matches"))
    line = F.col("line_number").cast("bigint") - F.col("n_lead") + F.col("first_line") - 1
    fields = ["entry", "match_no", "line_number", "evidence", "detail", "context_keyword"]
    own = each.filter((F.col("entry") < n_texts) & (F.col("line_number") > F.col("n_lead")) & (F.col("line_number") <= F.col("n_lead") + F.col("n_lines")))
    secret = F.col("entry") >= entries.n_rules
    # rules report match by match, secrets line by line and pattern by pattern
    number = F.when(secret, line * F.lit(1 << 16) + F.col("entry") - entries.n_rules).otherwise(line)
    own = own.withColumns({"match_no": number, "line_number": line.cast("int")})
    n_chunks = matched.groupBy(F.col("scan_id").alias("_scan"), F.col("path").alias("_path")).agg(F.count("*").alias("_chunks"))
    judged = each.filter(F.col("entry") >= n_texts).withColumn("line_number", F.when(F.col("line_number") == 0, 0).otherwise(line).cast("int"))
    first = F.min(F.struct("line_number", "evidence", "detail", "match_no", "context_keyword"))
    drift = judged.groupBy("scan_id", "path", "entry").agg(first.alias("_first"), F.count("*").alias("_n"))
    drift = drift.join(n_chunks, F.col("scan_id").eqNullSafe(F.col("_scan")) & F.col("path").eqNullSafe(F.col("_path")))
    drift = drift.filter((F.col("_first.line_number") > 0) | (F.col("_n") == F.col("_chunks"))).select("scan_id", "path", "entry", "_first.*")
    rows = own.select("scan_id", "path", *fields).unionByName(drift.select("scan_id", "path", *fields))
    return rows.select("scan_id", "path", F.array(F.struct(*fields)).alias("_matches")), entries


def scan_chunks(
    chunks: DataFrame,
    rules: DataFrame | None = None,
    patterns: DataFrame | None = None,
    checks: DataFrame | None = None,
    min_entropy: float | None = None,
    only_config: bool = False,
    routes: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Findings in files of any size, read as chunks."""
    return findings_of(*matched_chunks(chunks, rules, patterns, checks, min_entropy, only_config, routes))


def findings_of(matched: DataFrame, entries: Entries, context_from: DataFrame | None = None) -> DataFrame:
    """Findings of `matched_files`; with the files, the text around the matches of rules."""
    # unfolded as an expression: for a column the optimizer adds a test of its size, which would scan the texts twice
    rows = matched.select("scan_id", "path", F.inline(F.transform("_matches", lambda m: m))).withColumn(
        "_e", F.get(literal_table(entries.rows, ENTRY), F.col("entry"))
    )
    about_rule = [F.lit("rule_category"), F.col("_e.kind")]
    if context_from is not None:
        rows = attach_context(cut_lineage(rows), context_from)
        about_rule += [F.lit("context"), F.col("context")]
    detector = F.col("_e.detector")
    metadata = (
        F.when((detector == "misconfig") & F.col("detail").isNotNull(), F.create_map(*about_rule, F.lit("match_hash"), F.col("detail")))
        .when(detector == "misconfig", F.create_map(*about_rule))
        .when(
            detector == "secret",
            F.create_map(F.lit("pattern_name"), F.col("_e.kind"), F.lit("masked_value"), F.col("evidence")),
        )
        .otherwise(
            F.create_map(
                F.lit("config_type"), F.col("_e.kind"), F.lit("check_type"), F.col("_e.check_type"),
                F.lit("drift_detail"), F.col("detail"),
            )
        )
    )
    # rules report rule by rule, secrets line by line, checks in their order
    position = F.when(detector == "misconfig", F.col("entry").cast("bigint") * F.lit(1 << 32)).when(
        detector == "drift", F.col("entry").cast("bigint")
    ).otherwise(0) + F.col("match_no")
    number = F.when(detector == "misconfig", DETECTORS["misconfig"]).when(
        detector == "secret", DETECTORS["secret"]
    ).otherwise(DETECTORS["drift"])
    return rows.select(
        finding(
            "misconfig",
            scan_id=F.col("scan_id"),
            file_path=F.col("path"),
            line_number=F.col("line_number"),
            evidence=F.col("evidence"),
            context_keyword=F.col("context_keyword"),
            metadata=metadata,
            position=position,
            detector=number,
            **{
                name: F.col(f"_e.{name}")
                for name in ("rule_id", "title", "description", "severity", "category", "remediation",
                             "references", "tags")
            },
        )
    )


def rule_scan(files: DataFrame, rules: DataFrame, keep_context_text: bool = False) -> DataFrame:
    """Every match of every rule whose globs fit the file."""
    return scan_files(files, rules=rules, keep_context_text=keep_context_text)


def secret_scan(files: DataFrame, patterns: DataFrame, min_entropy: float | None = None) -> DataFrame:
    """First match of every pattern in every line, masked; matches below `min_entropy` are left out."""
    return scan_files(files, patterns=patterns, min_entropy=min_entropy)


def drift_scan(files: DataFrame, checks: DataFrame) -> DataFrame:
    """Deviations of configuration files from the baseline of their type.

    A forbidden match counts once, at its first place; a missing one gets line 0.
    """
    return scan_files(files, checks=checks)


def attach_context(matches: DataFrame, files: DataFrame, radius: int = CONTEXT_RADIUS) -> DataFrame:
    """Add the text of the lines around each match as `context`."""
    lines = source_lines(files, matches, radius).select(
        "scan_id",
        "path",
        "line_number",
        F.array_join(F.transform("lines", lambda x: x["content"]), "\n").alias("context"),
    )
    return matches.join(lines, ["scan_id", "path", "line_number"], "left")


def pattern_hits(lines: DataFrame, patterns: list, text: str = "line") -> DataFrame:
    """First match of every pattern in every line of a table of lines: adds `pattern` and `matched`.

    Lines are first tested against every pattern by itself; few pass.
    """
    hits = [
        F.when(
            F.col(text).rlike(java_pattern(p["pattern"])),
            F.struct(
                F.lit(no).alias("pattern_no"),
                F.regexp_extract(text, java_pattern(p["pattern"]), 0).alias("matched"),
            ),
        )
        for no, p in enumerate(patterns)
    ]
    table = literal_table([p.asDict() for p in patterns], SECRET_PATTERN)
    kept = lines.columns
    return (
        lines.filter(any_of([F.col(text).rlike(java_pattern(p["pattern"])) for p in patterns]))
        .select(*kept, F.explode(F.array_compact(F.array(*hits))).alias("_hit"))
        .select(*kept, F.get(table, F.col("_hit.pattern_no")).alias("pattern"), "_hit.pattern_no", "_hit.matched")
    )
