"""Packages against advisories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palisade.functions import coordinate, cvss_to_severity, cvss_vector_estimate, dep_key, package_key, version_key
from palisade.functions.base import pick
from palisade.functions.severity import ADVISORY_SCORE
from palisade.operators.common import finding

# Severity words of advisories, ecosystem names of the advisory source.
WORDS = {"CRITICAL": "critical", "HIGH": "high", "MODERATE": "medium", "MEDIUM": "medium", "LOW": "low"}
ECOSYSTEMS = {"npm": "npm", "PyPI": "pypi", "Maven": "maven"}
NO_TEXT = "No description available"


def advisory_flatten(advisories: DataFrame) -> DataFrame:
    """One row per advisory with the fields that findings need."""
    empty = F.array().cast("array<string>")
    aliases = F.coalesce("aliases", empty)
    first_cve = F.get(F.filter(aliases, lambda a: a.startswith("CVE-")), F.lit(0))
    no_severity = F.coalesce(F.size("severity"), F.lit(0)) <= 0
    vector = F.get(F.filter("severity", lambda s: s["type"] == "CVSS_V3"), F.lit(0))
    word = pick(F.upper(F.coalesce("database_specific.severity", F.lit("MODERATE"))), WORDS, "medium")
    affected = F.coalesce("affected", F.expr("slice(affected, 1, 0)"))
    events = lambda a: F.flatten(
        F.coalesce(F.transform(a["ranges"], lambda r: r["events"]), F.array())
    )
    fixed = F.flatten(F.transform(affected, lambda a: F.transform(events(a), lambda e: e["fixed"])))
    introduced = lambda a: F.transform(
        F.filter(events(a), lambda e: e["introduced"].isNotNull() & (e["introduced"] != "0")),
        lambda e: F.concat(F.lit(">="), e["introduced"]),
    )
    listed = F.flatten(
        F.transform(
            affected, lambda a: F.concat(introduced(a), F.coalesce(a["versions"], empty))
        )
    )
    links = F.filter(
        F.transform(F.coalesce("references", F.expr("slice(references, 1, 0)")), lambda r: r["url"]),
        lambda u: F.coalesce(u, F.lit("")) != "",
    )
    estimate = F.when(vector.isNotNull(), cvss_vector_estimate(F.coalesce(vector["score"], F.lit(""))))
    return advisories.select(
        F.coalesce(first_cve, "id", F.lit("UNKNOWN")).alias("cve_id"),
        F.coalesce("id", F.lit("UNKNOWN")).alias("osv_id"),
        F.when(no_severity, word)
        .otherwise(F.coalesce(cvss_to_severity(estimate), F.lit("medium")))
        .alias("_severity"),
        F.when(no_severity, pick(word, ADVISORY_SCORE, 5.5))
        .otherwise(F.coalesce(estimate, F.lit(0.0)))
        .alias("cvss_score"),
        vector.isNull().alias("_no_vector"),
        no_severity.alias("_no_severity"),
        F.coalesce("summary", "details", F.lit(NO_TEXT)).alias("summary"),
        F.coalesce(F.array_compact(fixed), empty).alias("fixed_versions"),
        F.coalesce(listed, empty).alias("affected_versions"),
        F.coalesce(links, empty).alias("references"),
        aliases.alias("aliases"),
    ).withColumn(
        "severity", F.when(~F.col("_no_severity") & F.col("_no_vector"), "medium").otherwise(F.col("_severity"))
    ).drop("_severity", "_no_vector", "_no_severity")


def advisory_ranges(advisories: DataFrame) -> DataFrame:
    """Affected ranges and exact versions: osv_id, ecosystem, name, introduced, fixed, last_affected, exact.

    Every `introduced` event runs to the next event that ends it: `fixed` and `limit` are the first version not
    affected, `last_affected` is the last that is. Ranges over commits (type GIT) say nothing about versions.
    """
    each = advisories.select(F.col("id").alias("osv_id"), F.explode("affected").alias("a"))
    none = F.lit(None).cast("string")
    package = [
        "osv_id",
        pick(F.col("a.package.ecosystem"), ECOSYSTEMS, None).alias("_eco"),
        F.col("a.package.ecosystem").alias("_raw_eco"),
        F.col("a.package.name").alias("name"),
    ]
    ends = lambda x: F.coalesce(x["fixed"], x["last_affected"], x["limit"]).isNotNull()
    spans = (
        each.select(*package, F.explode("a.ranges").alias("r"))
        .filter(F.coalesce("r.type", F.lit("ECOSYSTEM")) != "GIT")
        .select("*", F.posexplode("r.events").alias("_i", "e"))
        .filter(F.col("e.introduced").isNotNull())
        .withColumn("_end", F.get(F.filter(F.slice(F.col("r.events"), F.col("_i") + 1, F.size("r.events")), ends), F.lit(0)))
        .select(
            "osv_id", "_eco", "_raw_eco", "name",
            F.col("e.introduced").alias("introduced"),
            F.coalesce("_end.fixed", F.when(F.col("_end.last_affected").isNull(), F.col("_end.limit"))).alias("fixed"),
            F.col("_end.last_affected").alias("last_affected"),
            none.alias("exact"),
        )
    )
    exact = each.select(*package, F.explode("a.versions").alias("exact")).select(
        "osv_id", "_eco", "_raw_eco", "name",
        none.alias("introduced"), none.alias("fixed"), none.alias("last_affected"), "exact",
    )
    return spans.unionByName(exact).select(
        "osv_id",
        F.coalesce("_eco", F.lower("_raw_eco")).alias("ecosystem"),
        "name", "introduced", "fixed", "last_affected", "exact",
    )


def lookup_dedupe(deps: DataFrame) -> DataFrame:
    """One row per distinct look-up: key, ecosystem, name, version."""
    return deps.select(
        dep_key(F.col("ecosystem"), F.col("name"), F.col("version")).alias("key"),
        "ecosystem", "name", "version",
    ).distinct()


def _optional(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def _keyed(deps: DataFrame) -> DataFrame:
    return deps.withColumn("_package", package_key(F.col("ecosystem"), F.col("name"), _optional(deps, "group_id")))


FIRST, LAST = "", "\uffff"  # before and behind all version keys
BEFORE, AT, BEHIND = 0, 1, 2  # an end of a span lies before or behind the versions that are equal to it


def _ends(spans: DataFrame) -> DataFrame:
    """Two rows for each span: ecosystem, _package, _span, _key, _side, _from (whether it is the start). Spans whose ends
    have no order are left out."""
    fixed, last = F.col("fixed").isNotNull(), F.col("last_affected").isNotNull()
    start = F.when(F.col("introduced") == "0", FIRST).otherwise(version_key(F.col("introduced")))
    stop = F.when(fixed, version_key(F.col("fixed"))).when(last, version_key(F.col("last_affected"))).otherwise(LAST)
    side = F.when(~fixed & last, BEHIND).otherwise(BEFORE)
    rows = spans.select("ecosystem", "_package", "osv_id", start.alias("_start"), stop.alias("_stop"), side.alias("_side")).filter(
        "_start is not null and _stop is not null"
    )
    ends = F.explode(F.array(
        F.struct(F.col("_start").alias("_key"), F.lit(BEFORE).alias("_side"), F.lit(True).alias("_from")),
        F.struct(F.col("_stop").alias("_key"), F.col("_side").alias("_side"), F.lit(False).alias("_from")),
    ))
    span = F.struct("osv_id", "_start", "_stop", "_side").alias("_span")
    return rows.distinct().select("ecosystem", "_package", span, ends.alias("_end")).select("ecosystem", "_package", "_span", "_end.*")


def ranged_hits(lookups: DataFrame, spans: DataFrame) -> DataFrame:
    """Versions in spans: ecosystem, _package, version, osv_id.

    Versions of a package are put in order together with the ends of its spans, so that a span is a run of places, and
    the versions at the places of a run are its hits: n versions and m spans are sorted once and give a row for each
    hit, not n x m. A package meets in one task as its distinct versions and spans.
    """
    none = F.lit(None)
    span = "struct<osv_id:string,_start:string,_stop:string,_side:int>"
    known = spans.select("ecosystem", "_package").distinct()
    keyed = lookups.join(known, ["ecosystem", "_package"], "left_semi").withColumn("_key", version_key(F.col("version")))
    versions = keyed.select("ecosystem", "_package", none.cast(span).alias("_span"), "_key", F.lit(AT).alias("_side"), none.cast("boolean").alias("_from"), "version")
    in_order = W.partitionBy("ecosystem", "_package").orderBy("_key", "_side").rowsBetween(W.unboundedPreceding, 0)
    ordered = F.when(F.col("_key").isNotNull(), F.col("version"))  # others come first and count as nothing
    placed = versions.unionByName(_ends(spans), allowMissingColumns=True).withColumn("_seen", F.count(ordered).over(in_order))
    listed = lambda condition, *fields: F.sort_array(F.collect_list(F.when(condition, F.struct(*fields))))
    packages = placed.groupBy("ecosystem", "_package").agg(
        listed(ordered.isNotNull(), "_seen", "version").alias("_versions"), listed(F.col("_from"), "_span", "_seen").alias("_starts"), listed(~F.col("_from"), "_span", "_seen").alias("_stops")
    ).filter("size(_starts) > 0")
    runs = packages.select("ecosystem", "_package", "_versions", F.explode(F.arrays_zip("_starts", "_stops")).alias("_run"))
    first, behind = F.col("_run._starts._seen"), F.col("_run._stops._seen")
    hits = F.slice("_versions", (first + 1).cast("int"), F.greatest(behind - first, F.lit(0)).cast("int"))
    return runs.select("ecosystem", "_package", F.col("_run._starts._span.osv_id").alias("osv_id"), F.explode(hits["version"]).alias("version")).select(*VERSION, "osv_id")


def advisory_hits(deps: DataFrame, ranges: DataFrame) -> DataFrame:
    """Distinct package versions that an advisory affects: ecosystem, _package, version, osv_id, match_kind.

    `_package` is the name as the ecosystem compares it. `match_kind` is exact or range; a version without an order
    can only match an exact list. Look-ups and ranges are asked several times: give tables that are stored (`cut_lineage`), or
    manifests and documents are read again each time.
    """
    lookups = _keyed(deps).select(*VERSION).distinct()
    last = _optional(ranges, "last_affected").alias("last_affected")
    spans = ranges.select(
        "osv_id", "ecosystem", "introduced", "fixed", last, "exact",
        package_key(F.col("ecosystem"), F.col("name"), F.lit(None).cast("string")).alias("_package"),
    )
    listed = spans.filter("exact is not null").select("ecosystem", "_package", F.col("exact").alias("version"), "osv_id")
    exact = lookups.join(listed, VERSION).select(*VERSION, "osv_id", F.lit(True).alias("_exact"))
    ranged = ranged_hits(lookups, spans.filter("introduced is not null"))
    hits = exact.unionByName(ranged.withColumn("_exact", F.lit(False)))
    return hits.groupBy(*VERSION, "osv_id").agg(F.when(F.bool_or("_exact"), "exact").otherwise("range").alias("match_kind"))


VERSION = ["ecosystem", "_package", "version"]


def match_advisories(deps: DataFrame, ranges: DataFrame) -> DataFrame:
    """Dependencies that an advisory affects, with `osv_id` and `match_kind`.

    Distinct versions are matched and the answer is joined back, so a package that a third of all
    projects use is looked up once per version.
    """
    return _keyed(deps).join(advisory_hits(deps, ranges), VERSION).drop("_package")


def cve_findings(deps: DataFrame, ranges: DataFrame, flat: DataFrame) -> DataFrame:
    """Findings of affected dependencies; `ranges` and `flat` come from the same advisories.

    Advisory texts are joined to distinct versions; dependencies fan out once, at the end.
    """
    rows = _keyed(deps).join(advisory_hits(deps, ranges).join(flat, "osv_id"), VERSION)
    name, version, fixed = F.col("name"), F.col("version"), F.col("fixed_versions")
    others = F.when(
        F.size(fixed) > 1,
        F.concat(F.lit(" (other fixed versions: "), F.array_join(F.slice(fixed, 2, 3), ", "), F.lit(")")),
    ).otherwise("")
    remediation = F.when(
        F.size(fixed) > 0,
        F.concat(F.lit("Upgrade "), name, F.lit(" from "), version, F.lit(" to "), F.get(fixed, F.lit(0)), others),
    ).otherwise(
        F.concat(
            F.lit("No fixed version available for "), name, F.lit(". Consider finding an alternative package.")
        )
    )
    where = coordinate(F.col("ecosystem"), name, version, F.col("group_id"))
    return rows.select(
        finding(
            "cve",
            scan_id=F.col("scan_id"),
            rule_id=F.col("cve_id"),
            title=F.concat(F.col("cve_id"), F.lit(": "), name, F.lit("@"), version),
            description=F.col("summary"),
            severity=F.col("severity"),
            category=F.lit("cve"),
            file_path=F.col("path"),
            evidence=F.concat(F.lit("Vulnerable dependency: "), where),
            remediation=remediation,
            references=F.col("references"),
            tags=F.array(F.lit("cve"), F.col("ecosystem")),
            cvss_score=F.col("cvss_score"),
            is_transitive=F.col("is_transitive"),
            metadata=F.create_map(
                F.lit("osv_id"), F.col("osv_id"), F.lit("package"), name, F.lit("version"), version,
                F.lit("ecosystem"), F.col("ecosystem"), F.lit("fixed_versions"), F.array_join(fixed, ","),
                F.lit("is_dev"), F.col("is_dev").cast("string"),
                F.lit("is_transitive"), F.col("is_transitive").cast("string"),
                F.lit("match_kind"), F.col("match_kind"),
            ),
        )
    )
