"""Proposed and applied fixes. Files are a table; a fix gives a new version of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palisade.functions import suffix
from palisade.functions.base import strip, text_before
from palisade.operators.common import source_lines
from palisade.operators.findings import fixable
from palisade.session import cut_lineage

# Suffix groups and texts of the replacements.
CONFIG_SUFFIXES = [".json", ".yml", ".yaml", ".conf", ".ini", ".properties"]
SCRIPT_SUFFIXES = [".js", ".ts", ".jsx", ".tsx"]
SERVER_SUFFIXES = [".conf", ".nginx"]
OWN_DOMAIN = "https://yourdomain.com"
CORS_HEADER = f"    add_header 'Access-Control-Allow-Origin' '{OWN_DOMAIN}';"
DEBUG_OFF = "DEBUG = False  # Fixed: debug mode disabled for production"
USER_LINE = "USER appuser"
MISCONFIG = ["misconfig", "misconfiguration"]
CONTEXT_RADIUS = 7


def _rule_is(rule_id: Column, family: str) -> Column:
    """True for the rule with or without a vendor prefix."""
    return rule_id.rlike(f"^(?:[A-Z0-9]+-)?{family}$")


def _cat(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _assigned(old: Column, forms: list[tuple[str, Column]], plain: Column) -> Column:
    """Text left of the first sign that the line holds (tried in order) plus that form's tail; else `plain`."""
    expr = F.when(F.lit(False), "")
    for sign, tail in forms:
        expr = expr.when(F.contains(old, F.lit(sign)), _cat(text_before(old, sign), tail))
    return expr.otherwise(plain)


def secret_replacement(rule_id: Column, path: Column, old: Column) -> Column:
    """The line with the secret read from the environment, or a placeholder, by kind of file."""
    env = F.upper(F.replace(rule_id, F.lit("-"), F.lit("_")))
    ext = suffix(path)
    from_os = _cat("__import__('os').environ.get('", env, "')")
    from_node = _cat("process.env.", env)
    from_java = _cat('System.getenv("', env, '")')
    slot = _cat("PLACEHOLDER_", env)
    own_name = _cat("=your_", F.lower(strip(text_before(old, "="))), "_here")
    return (
        F.when(ext == ".py", _assigned(old, [("=", _cat("= ", from_os))], from_os))
        .when(ext == ".env", _assigned(old, [("=", own_name)], _cat(rule_id, "=your_secret_here")))
        .when(ext.isin(CONFIG_SUFFIXES), _assigned(old, [(":", _cat(': "', slot, '"')), ("=", _cat("=", slot))], slot))
        .when(
            ext.isin(SCRIPT_SUFFIXES),
            _assigned(old, [("=", _cat("= ", from_node)), (":", _cat(": ", from_node))], from_node),
        )
        .when(ext == ".java", _assigned(old, [("=", _cat("= ", from_java))], from_java))
        .otherwise(_cat(rule_id, "_VALUE=${{ secrets.", F.replace(rule_id, F.lit("-"), F.lit("_")), " }}"))
    )


def cors_replacement(path: Column, old: Column) -> Column:
    """The line with one own origin instead of the wildcard."""
    quoted = F.lit(f"'{OWN_DOMAIN}'")
    header = F.contains(old, F.lit("add_header"))
    swapped = F.replace(F.replace(old, F.lit("'*'"), quoted), F.lit('"*"'), quoted)
    plain = F.lit(f'Access-Control-Allow-Origin = "{OWN_DOMAIN}"')
    tail = F.lit(f' "{OWN_DOMAIN}"')
    return (
        F.when(header, swapped)
        .when(suffix(path).isin(SERVER_SUFFIXES), CORS_HEADER)
        .otherwise(_assigned(old, [(":", _cat(":", tail)), ("=", _cat("=", tail))], plain))
    )


def upgrade_line(package: Column, version: Column, cve_id: Column) -> Column:
    known = F.when(F.coalesce(cve_id, F.lit("")) == "", "known vulnerability").otherwise(cve_id)
    return _cat(package, ">=", version, "  # Fixes ", known)


def replacement_line(category: Column, rule_id: Column, path: Column, old: Column) -> Column:
    """New text of a line for secrets and misconfigurations; null for other categories."""
    return F.when(category == "secret", secret_replacement(rule_id, path, old)).when(
        category.isin(MISCONFIG),
        F.when(_rule_is(rule_id, "INFRA-001"), _cat(old, "\n" + USER_LINE))
        .when(_rule_is(rule_id, "WEB-003"), cors_replacement(path, old))
        .otherwise(DEBUG_OFF),
    )


def _from_metadata(df: DataFrame, key: str) -> Column:
    return F.try_element_at("metadata", F.lit(key)) if "metadata" in df.columns else F.lit(None).cast("string")


def _package(df: DataFrame) -> Column:
    """Package a dependency finding is about: its own column, its metadata, else the evidence up to `==`."""
    guessed = strip(text_before(F.coalesce("evidence", F.lit("")), "=="))
    own = F.col("package") if "package" in df.columns else F.lit(None).cast("string")
    return F.coalesce(own, _from_metadata(df, "package"), guessed)


def _fixed_version(df: DataFrame) -> Column:
    """First version without the fault: a column, or the first that the metadata names; null if none is known."""
    own = F.col("fixed_version") if "fixed_version" in df.columns else F.lit(None).cast("string")
    named = F.get(F.split(_from_metadata(df, "fixed_versions"), ","), F.lit(0))
    return F.coalesce(F.when(own != "", own), F.when(named != "", named))


def upgraded(path: Column, package: Column, version: Column, cve_id: Column, old: Column) -> Column:
    """The line of a manifest with the fixed version, in the form of its kind."""
    quoted = F.concat(F.lit('(?i)("\\Q'), package, F.lit('\\E"\\s*:\\s*")[^"]*"'))
    in_json = F.regexp_replace(old, quoted, F.concat(F.lit("$1^"), version, F.lit('"')))
    return F.when(suffix(path) == ".json", in_json).otherwise(upgrade_line(package, version, cve_id))


def _upgradable(path: Column) -> Column:
    """Manifests whose lines can be rewritten one by one; lock and XML files can't."""
    return ~F.lower(path).rlike(r"(\.lock|lock\.json|\.xml)$")


def finding_context(findings: DataFrame, files: DataFrame, radius: int = CONTEXT_RADIUS) -> DataFrame:
    """finding_id, start_line, end_line, target_line, lines[num, content].

    Without the file the lines are made from the evidence, or a placeholder.
    """
    target = F.when(F.coalesce("line_number", F.lit(0)) == 0, 1).otherwise(F.col("line_number"))
    asked = findings.withColumn("_target", target)
    wanted = asked.select("scan_id", F.col("file_path").alias("path"), F.col("_target").alias("line_number"))
    around = source_lines(files, wanted, radius).select(
        "scan_id", F.col("path").alias("file_path"), F.col("line_number").alias("_target"), "n_lines",
        F.col("lines").alias("_lines"),
    )
    stand_in = F.when(
        F.coalesce("evidence", F.lit("")) == "",
        _cat("// Security finding ", F.col("rule_id"), " in ", F.col("file_path")),
    ).otherwise(F.col("evidence"))
    made = F.transform(
        F.split(F.regexp_replace(stand_in, r"(\r\n|\n|\r)$", ""), "\r\n|\n|\r"),
        lambda text, i: F.struct((F.col("_target") + i).alias("num"), text.alias("content")),
    )
    rows = asked.join(around, ["scan_id", "file_path", "_target"], "left").withColumn(
        "lines", F.when(F.col("n_lines").isNull(), made).otherwise(F.col("_lines"))
    )
    first = F.greatest(F.col("_target") - radius, F.lit(1))
    last = F.least(F.col("_target") + radius, F.col("n_lines"))
    return rows.select(
        "finding_id",
        F.when(F.col("n_lines").isNull(), F.col("_target")).otherwise(first).alias("start_line"),
        F.when(F.col("n_lines").isNull(), F.col("_target") + F.size("lines") - 1).otherwise(last).alias("end_line"),
        F.col("_target").alias("target_line"),
        "lines",
    )


def with_old_line(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Add `old_line`: the source line, or the evidence if there is none."""
    lines = source_lines(
        files, findings.filter("line_number >= 1").withColumnRenamed("file_path", "path"), 0
    ).select(
        "scan_id", F.col("path").alias("file_path"), "line_number",
        F.get("lines", F.lit(0))["content"].alias("_line"),
    )
    return (
        findings.join(lines, ["scan_id", "file_path", "line_number"], "left")
        .withColumn("old_line", F.coalesce("_line", "evidence", F.lit("")))
        .drop("_line")
    )


def suggest_patch(findings: DataFrame, files: DataFrame | None = None, custom: str | None = None) -> DataFrame:
    """finding_id, patch, description. `files` gives the true old lines; without them the evidence serves."""
    if files is not None:
        rows = with_old_line(findings, files)
    else:
        rows = findings.withColumn("old_line", F.coalesce("evidence", F.lit("")))
    path, rule, old = F.col("file_path"), F.col("rule_id"), F.col("old_line")
    evidence = F.coalesce("evidence", F.lit(""))
    category = F.col("category")
    trimmed = lambda c: F.regexp_replace(c, r"\s+$", "")
    line = F.when(F.coalesce("line_number", F.lit(0)) == 0, 1).otherwise(F.col("line_number")).cast("string")
    head = lambda n: _cat("--- a/", path, "\n+++ b/", path, "\n@@ -", line, ",1 +", line, f",{n} @@\n")
    cve = F.coalesce("cve_id", F.lit(""))
    pinned = F.contains(evidence, F.lit("==")) & _fixed_version(findings).isNotNull()
    upgrade = upgrade_line(_package(findings), _fixed_version(findings), F.col("cve_id"))
    infra, cors = _rule_is(rule, "INFRA-001"), _rule_is(rule, "WEB-003")
    misconfig = category.isin(MISCONFIG)
    replaced = _cat(head(1), "-", trimmed(old), "\n+", trimmed(replacement_line(category, rule, path, old)))
    patch = (
        F.when(category == "secret", replaced)
        .when((category == "cve") & pinned, _cat(head(1), "-", evidence, "\n+", upgrade))
        .when(
            category == "cve",
            _cat("# Upgrade dependency to fix ", F.when(cve == "", "vulnerability").otherwise(cve)),
        )
        .when(misconfig & infra, _cat(head(2), "-", evidence, "\n+", evidence, "\n+" + USER_LINE))
        .when(misconfig & cors, replaced)
        .when(misconfig, _cat(head(1), "-", evidence, "\n+" + DEBUG_OFF))
        .otherwise(_cat("# Manual review required for ", rule))
    )
    if custom is not None:
        patch = _cat(head(1), "-", evidence, "\n+" + custom)
    remediation = F.coalesce("remediation", F.lit("")) if "remediation" in findings.columns else F.lit("")
    where = _cat(path, ":", F.coalesce(F.col("line_number").cast("string"), F.lit("None")))
    description = (
        F.when(
            category == "secret",
            _cat(
                "Replace the hardcoded secret at ", where,
                " with an environment variable reference or safe configuration placeholder.",
            ),
        )
        .when(
            category == "cve",
            _cat(
                "Upgrade the vulnerable dependency referenced by ", F.when(cve == "", rule).otherwise(cve),
                ". See remediation: ", remediation,
            ),
        )
        .when(
            misconfig & infra,
            _cat(
                "Avoid running the container as root by adding a USER directive in ", path,
                " after the base image is defined.",
            ),
        )
        .when(misconfig & cors, _cat("Specify exact allowed domains in ", path, " instead of using the wildcard '*'."))
        .when(
            misconfig,
            _cat("Disable debug mode in ", path, ". Running with DEBUG=True in production exposes sensitive data."),
        )
        .otherwise(_cat("No automated fix available for rule ", rule, ". Please review manually."))
    )
    return rows.select("finding_id", patch.alias("patch"), description.alias("description"))


def _package_places(fixes: DataFrame, files: DataFrame) -> DataFrame:
    """Where each package of a dependency fix stands: the given line if it names it, else the first that does.

    Grouped per file over distinct (line, package), so a file meets its packages once.
    """
    asked = (
        fixes.select("scan_id", "path", "given", "package")
        .distinct()
        .groupBy("scan_id", "path")
        .agg(F.collect_list(F.struct("given", "package")).alias("_asked"))
    )
    pieces = F.split("content", "\n")
    start = lambda p: F.instr(F.lower("content"), F.lower(p))
    place = lambda a: F.when(
        F.contains(F.lower(F.get(F.col("_pieces"), a["given"] - 1)), F.lower(a["package"])), a["given"]
    ).when(
        start(a["package"]) > 0, F.size(F.split(F.left(F.col("content"), start(a["package"]) - 1), "\n"))
    )
    return (
        files.join(asked, ["scan_id", "path"])
        .select("scan_id", "path", "content", "_asked", pieces.alias("_pieces"))
        .select(
            "scan_id", "path",
            F.inline(F.transform("_asked", lambda a: a.withField("line_number", place(a)))),
        )
        .filter("line_number is not null")
    )


def _asked_fixes(findings: DataFrame, order: list[str]) -> DataFrame:
    """What fixes need of the findings that can have one."""
    return fixable(findings).select(
        "scan_id", "finding_id", "rule_id", "category", "cve_id",
        F.col("file_path").alias("path"),
        F.coalesce("line_number", F.lit(0)).alias("given"),
        _package(findings).alias("package"),
        _fixed_version(findings).alias("fixed_version"),
        F.struct(*order).alias("_order"),
    )


def planned_fixes(files: DataFrame, findings: DataFrame, order: list[str]) -> DataFrame:
    """Fixes that can be applied: finding columns plus `path`, `line_number` of the line to change."""
    return _placed_fixes(files, _asked_fixes(findings, order))


def _placed_fixes(files: DataFrame, todo: DataFrame) -> DataFrame:
    by_line = todo.filter("category <> 'cve' and given >= 1").withColumn("line_number", F.col("given"))
    by_package = todo.filter("category = 'cve' and package <> '' and fixed_version is not null").filter(_upgradable(F.col("path")))
    places = _package_places(by_package, files)
    return by_line.unionByName(by_package.join(places, ["scan_id", "path", "given", "package"]))


def apply_fixes(files: DataFrame, findings: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """New versions of the files that change, and the ids of the findings applied.

    Line numbers refer to the file as it was. Of several fixes for one line the last by `order`
    stands. What fixes need of the findings is written out, so that findings are made once. The files in question are picked out of the corpus in one pass and written out; the fixes
    of a file, one for a line at most, meet it as one array, and only the lines they name are computed.
    """
    todo = cut_lineage(_asked_fixes(findings, order))
    in_question = todo.select("scan_id", "path").distinct()
    touched = cut_lineage(
        files.select("scan_id", "path", "content").join(in_question, ["scan_id", "path"], "left_semi")
    )
    fixes = _placed_fixes(touched, todo)
    place = ["scan_id", "path", "line_number"]
    last = W.partitionBy(*place).orderBy(F.col("_order").desc())
    per_file = (
        fixes.withColumn("_n", F.row_number().over(last))
        .filter("_n = 1")
        .groupBy("scan_id", "path")
        .agg(
            F.sort_array(
                F.collect_list(F.struct("line_number", "rule_id", "category", "cve_id", "package", "fixed_version"))
            ).alias("_fixes")
        )
    )
    pieces = F.split("content", "\n")
    # a trailing line end does not start another line
    n_lines = F.size(pieces) - F.when(F.element_at(pieces, -1) == "", 1).otherwise(0)
    sized = touched.select("scan_id", "path", "content", n_lines.alias("_n_lines"))
    split_files = (
        sized.join(per_file, ["scan_id", "path"])
        .withColumn("_fixes", F.filter("_fixes", lambda f: f["line_number"] <= F.col("_n_lines")))
        .filter(F.size("_fixes") > 0)
        .select("scan_id", "path", "_fixes", pieces.alias("_p"))
    )

    def with_lines_before(fix: Column, i: Column) -> Column:
        """The fixed line behind those between it and the fix before."""
        done = F.when(i == 0, 0).otherwise(F.get(F.col("_fixes"), i - 1)["line_number"])
        old = F.get(F.col("_p"), fix["line_number"] - 1)
        new = F.when(
            fix["category"] == "cve",
            upgraded(F.col("path"), fix["package"], fix["fixed_version"], fix["cve_id"], old),
        ).otherwise(replacement_line(fix["category"], fix["rule_id"], F.col("path"), old))
        return F.concat(F.slice("_p", done + 1, fix["line_number"] - done - 1), F.array(new))

    end = F.element_at("_fixes", -1)["line_number"]
    text = F.concat(F.flatten(F.transform("_fixes", with_lines_before)), F.slice("_p", end + 1, F.size("_p")))
    changed = split_files.select("scan_id", "path", F.array_join(text, "\n").alias("content"))
    ends = sized.select("scan_id", "path", "_n_lines")
    applied = fixes.join(ends, ["scan_id", "path"]).filter("line_number <= _n_lines")
    return changed, applied.select("finding_id").distinct()


def replace_block(files: DataFrame, edits: DataFrame) -> DataFrame:
    """Lines start_line..end_line replaced by `text`, one edit per file; also takes a fix back."""
    rows = files.select("scan_id", "path", "content").join(edits, ["scan_id", "path"])
    rows = rows.withColumn("_p", F.split("content", "\n"))
    size, start, end, text = F.size("_p"), F.col("start_line"), F.col("end_line"), F.col("text")
    before = F.slice("_p", 1, start - 1)
    after = F.slice("_p", end + 1, F.greatest(size - end, F.lit(0)))
    # a line end of its own is added only where the replaced block had one
    block = F.when(
        text == "",
        F.when((end >= size) & (start > 1), F.array(F.lit(""))).otherwise(F.array().cast("array<string>")),
    ).otherwise(F.split(F.when(end < size, F.regexp_replace(text, r"\n$", "")).otherwise(text), "\n"))
    return rows.select("scan_id", "path", F.array_join(F.concat(before, block, after), "\n").alias("content"))


def replace_evidence(files: DataFrame, edits: DataFrame) -> DataFrame:
    """First occurrence of `evidence` replaced by `text`, one edit per file; files without it stay out."""
    at = F.instr(F.col("content"), F.col("evidence"))
    rows = files.select("scan_id", "path", "content").join(edits, ["scan_id", "path"]).filter(at > 0)
    rest = F.substr(F.col("content"), at + F.length("evidence"))
    return rows.select(
        "scan_id", "path", F.concat(F.left(F.col("content"), at - 1), F.col("text"), rest).alias("content")
    )


def mark_fixed(
    findings: DataFrame, applied: DataFrame, operator: str = "Developer", justification: str | None = None,
    revert: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Findings with is_fixed turned, and the audit rows to append."""
    hit = findings.join(applied.select("finding_id", F.lit(True).alias("_hit")).distinct(), "finding_id", "left")
    flipped = hit.withColumn(
        "is_fixed", F.when(F.col("_hit"), F.lit(not revert)).otherwise(F.col("is_fixed"))
    ).drop("_hit")
    label = "Reverted Auto-Fix: " if revert else "Applied Auto-Fix: "
    reason = justification or ("Reverted change" if revert else "Auto-fix applied via Dashboard")
    where = F.when(
        F.coalesce("line_number", F.lit(0)) == 0, F.col("file_path")
    ).otherwise(_cat(F.col("file_path"), ":L", F.col("line_number").cast("string")))
    audit = hit.filter("_hit").select(
        _cat("fix-", F.col("finding_id")).alias("audit_id"),
        _cat(label, F.col("title")).alias("action"),
        F.lit(operator).alias("operator"),
        where.alias("target"),
        F.lit(reason).alias("justification"),
        F.lit("warning" if revert else "success").alias("status"),
    )
    return flipped.select(*findings.columns), audit
