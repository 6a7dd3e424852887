"""Report documents per scan, as ordered lines.

A scan may hold a large part of all findings, so a document is never put together in one row.
Every exporter gives `scan_id, section, sort_key, line`; the lines of a scan in the order
(section, sort_key) are its document. `write_documents` stores them so that the part files of a
scan, read in name order, are that document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palisade.functions import sarif_level
from palisade.operators.common import crowded_keys, dealt
from palisade.schemas import SEVERITIES

TOOL = {"name": "Palisade", "version": "1.0.0"}
DESCRIPTION = "Security Vulnerability and Configuration Scanner"
SARIF_SCHEMA = "https://docs.oasis-open.org/sarif/sarif/v2.1.0/errata01/os/schemas/sarif-schema-2.1.0.json"
LINE_COLUMNS = ["scan_id", "section", "sort_key", "line"]
KEEP_NULLS = {"ignoreNullFields": "false"}
PREVIEW_PACKAGES = 8
SARIF_COLUMNS = [
    "scan_id", "finding_id", "rule_id", "title", "description", "severity", "category", "file_path", "line_number",
    "evidence", "remediation", "tags", "final_score",
]
SBOM_TOOL = {"vendor": "Palisade", "name": "Palisade Security Engine", "version": "0.1.0"}


def json_of(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]), KEEP_NULLS)


def text_lines(scans: DataFrame, section: int, line: Column) -> DataFrame:
    """The same kind of line once per scan."""
    return scans.select(
        "scan_id", F.lit(section).alias("section"), F.lit("").alias("sort_key"), line.alias("line")
    )


def scan_parts(findings: DataFrame, scans: DataFrame) -> list[tuple[DataFrame, DataFrame, bool]]:
    """(findings, scans, whether the findings are dealt by scan) of scans whose documents are made alike.

    Findings of most scans are moved once, to the task of their scan. Scans that hold a great part of all findings, and
    findings without a scan, are a part of their own, which is counted and joined across tasks; there is none as a rule.
    """
    crowded, nameless = crowded_keys(findings, "scan_id")
    own, none = F.col("scan_id").isin(crowded), F.col("scan_id").isNull()
    if not crowded:
        parts = [(dealt(findings, "scan_id"), scans, True)]
    else:
        parts = [(dealt(findings.filter(~own), "scan_id"), scans.filter(~own | none), True)]
    return parts + [(findings.filter(own | none), scans.filter(own), False)] * (nameless or len(crowded) > 0)


def array_lines(rows: DataFrame, section: int, sort_key: Column, json: Column, in_place: bool = False) -> DataFrame:
    """Array elements, one of each row (scan_id and what the columns `sort_key` and `json` need), a comma before all but
    the first.

    Which key comes first is found from the keys alone, one row per scan. Only elements that share the first key, as a
    rule one per scan, are put in an order of their own. Rows are rendered behind that. `in_place`: rows are `dealt` by
    scan and stay where they are.
    """
    if in_place:
        return _placed(rows, sort_key, json).select(
            "scan_id", F.lit(section).alias("section"), _placed_key(sort_key).alias("sort_key"), _placed_line(json).alias("line")
        )
    # keys that are never null: grouping and join deal the scans alike, so that the first keys are moved once
    scan, none = F.coalesce(F.col("scan_id"), F.lit("")), F.col("scan_id").isNull()
    first = rows.groupBy(scan.alias("_scan"), none.alias("_none")).agg(F.min(sort_key).alias("_first"))
    return _commas(rows.join(first, (scan == F.col("_scan")) & (none == F.col("_none"))), section, sort_key, json)


def _commas(marked: DataFrame, section: int, sort_key: Column, json: Column) -> DataFrame:
    """Array elements of rows that know the first key of their scan (`_first`)."""
    # no key is below the first one; an equality would become a join key, and the rows would be dealt twice
    is_first = F.coalesce(sort_key <= F.col("_first"), F.col("_first").isNull())
    comma = F.concat(F.lit(","), "_json")
    number = F.lit(section).alias("section")
    rest = marked.filter(~is_first).select("scan_id", number, sort_key.alias("sort_key"), json.alias("_json"))
    place = F.row_number().over(W.partitionBy("scan_id").orderBy("_json"))
    heads = marked.filter(is_first).select("scan_id", sort_key.alias("_key"), json.alias("_json")).withColumn("_place", place)
    return rest.select("scan_id", "section", "sort_key", comma.alias("line")).unionByName(
        heads.select("scan_id", number, _placed_key(F.col("_key")).alias("sort_key"), _placed_line(F.col("_json")).alias("line"))
    )


def _placed(rows: DataFrame, sort_key: Column, json: Column) -> DataFrame:
    """Rows that are `dealt` by scan, with `_place` among the elements with the first key of their scan, null for others."""
    scan = W.partitionBy("scan_id")
    is_first = F.coalesce(sort_key <= F.col("_first"), F.col("_first").isNull())
    counted = rows.withColumn("_first", F.min(sort_key).over(scan)).withColumn("_is_first", is_first).withColumn(
        "_firsts", F.count_if("_is_first").over(scan)
    )
    # as a rule there is one; several are put in order by what they say
    tied = counted.withColumn("_tie", F.when(F.col("_is_first") & (F.col("_firsts") > 1), json))
    place = F.row_number().over(scan.orderBy(F.col("_tie").asc_nulls_last()))
    return tied.withColumn(
        "_place", F.when(F.col("_tie").isNotNull(), place).when(F.col("_is_first"), 1)
    ).drop("_first", "_is_first", "_firsts", "_tie")


def _placed_key(sort_key: Column) -> Column:
    """Elements with one key stay together behind the first of them: their keys go on with their place."""
    later = F.concat(sort_key, F.format_string("\u0001%012d", "_place"))
    return F.when(F.col("_place") > 1, later).otherwise(sort_key)


def _placed_line(json: Column) -> Column:
    return F.concat(F.when(F.col("_place") == 1, "").otherwise(","), json)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def write_documents(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder per scan; a large scan has several part files, in order."""
    ordered = lines.repartitionByRange("scan_id", "section", "sort_key").sortWithinPartitions(
        "scan_id", "section", "sort_key"
    )
    ordered.select("scan_id", "line").write.mode(mode).partitionBy("scan_id").text(path)


def write_document_table(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """All documents as one table in the order of their lines: as many files as the writing has tasks, however many scans
    there are. `read_document` opens only the files, and in them the row groups, that hold the scan."""
    ordered = lines.repartitionByRange("scan_id", "section", "sort_key").sortWithinPartitions(
        "scan_id", "section", "sort_key"
    )
    ordered.select(*LINE_COLUMNS).write.mode(mode).parquet(path)


def read_document(spark: SparkSession, path: str, scan_id: str) -> DataFrame:
    """The lines of one scan's document, in order (column `line`). Write them as text for a file of any size."""
    schema = "scan_id string, section int, sort_key string, line string"
    found = spark.read.schema(schema).parquet(path).filter(F.col("scan_id") == scan_id)
    return found.orderBy("section", "sort_key").select("line")


def scan_summary(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """scan_id, total, by_severity (struct of five), by_category (map)."""
    known = F.lower("severity")
    level = F.when(known.isin(SEVERITIES), known).otherwise("info")
    per_category = findings.groupBy("scan_id", "category").agg(
        F.count("*").alias("n"), *[F.count_if(level == s).alias(s) for s in SEVERITIES]
    )
    # what meets per scan is one row per category
    per_scan = per_category.groupBy("scan_id").agg(
        F.sum("n").alias("total"),
        *[F.sum(s).alias(s) for s in SEVERITIES],
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "n")))).alias("by_category"),
    )
    rows = scans.select("scan_id").join(per_scan, "scan_id", "left")
    return rows.fillna(0, ["total", *SEVERITIES]).select(
        "scan_id",
        "total",
        F.struct(*SEVERITIES).alias("by_severity"),
        F.coalesce("by_category", F.create_map().cast("map<string,bigint>")).alias("by_category"),
    )


def to_json_report(findings: DataFrame, scans: DataFrame, tool: dict = TOOL) -> DataFrame:
    """JSON report: tool, metadata, summary, findings."""
    have = lambda name, default: F.col(name) if name in scans.columns else F.lit(default)
    described = scans.join(scan_summary(scans, findings), "scan_id").withColumns(
        {
            "_tool": json_of(
                name=F.lit(tool["name"]), version=F.lit(tool["version"]), description=F.lit(DESCRIPTION)
            ),
            "_meta": json_of(
                timestamp=F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"),
                target=F.col("target"),
                scan_type=F.col("scan_type"),
                duration_seconds=have("duration_seconds", 0),
                files_scanned=have("files_scanned", 0),
                dependencies_scanned=have("dependencies_scanned", 0),
            ),
            "_sum": json_of(
                total=F.col("total"), by_severity=F.col("by_severity"), by_category=F.col("by_category")
            ),
        }
    )
    head = F.concat(
        F.lit('{"schema_version":"1.0.0","tool":'), "_tool", F.lit(',"metadata":'), "_meta",
        F.lit(',"summary":'), "_sum", F.lit(',"findings":['),
    )
    element = F.to_json(F.struct(*[F.col(c) for c in findings.columns if c != "scan_id"]), KEEP_NULLS)
    items = array_lines(findings, 1, F.col("finding_id"), element)
    return _union([text_lines(described, 0, head), items, text_lines(scans, 2, F.lit("]}"))])


def sarif_rules(findings: DataFrame, order: list[str]) -> DataFrame:
    """Rules of each scan with the attributes of their first finding and their index by first sight.

    The first finding per rule is picked before rows meet per scan, so only distinct rules are ranked.
    """
    first = W.partitionBy("scan_id", "rule_id").orderBy(*order)
    by_sight = W.partitionBy("scan_id").orderBy(*order)
    return (
        findings.withColumn("_n", F.row_number().over(first))
        .filter("_n = 1")
        .withColumn("rule_index", F.row_number().over(by_sight) - 1)
        .drop("_n")
    )


def sarif_results(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per finding: rule index, level, uri, start line, fingerprint, whether a fix is given."""
    known = [c for c in ("scan_id", "rule_id", "rule_index", "_first") if c in rules.columns]
    return _result_facts(findings.join(rules.select(*known), ["scan_id", "rule_id"]))


def _result_facts(rows: DataFrame) -> DataFrame:
    line = F.greatest(F.lit(1), F.coalesce("line_number", F.lit(1)))
    return rows.withColumns(
        {
            "level": sarif_level(F.col("severity")),
            "uri": F.replace("file_path", F.lit("\\"), F.lit("/")),
            "start_line": line,
            "fingerprint": F.concat_ws(":", "rule_id", "file_path", line.cast("string")),
            "has_fix": F.coalesce("remediation", F.lit("")) != "",
        }
    )


def _with_rule_index(findings: DataFrame, order: list[str]) -> DataFrame:
    """Findings that are `dealt` by scan, with the index of their rule (as `sarif_rules` counts) and whether they are its
    first. Rules are ranked by the order of their first findings, rules with the same one by rule_id."""
    of_rule = W.partitionBy("scan_id", "rule_id").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    by_sight = W.partitionBy("scan_id").orderBy("_sight", "rule_id")
    seen = findings.withColumns(
        {"_is_sight": F.row_number().over(of_rule) == 1, "_sight": F.first(F.struct(*order)).over(of_rule)}
    )
    return seen.withColumn("rule_index", F.dense_rank().over(by_sight) - 1).drop("_sight")


def to_sarif(findings: DataFrame, scans: DataFrame, order: list[str], tool: dict = TOOL) -> DataFrame:
    """SARIF 2.1.0. `findings` needs description, remediation and, if known, tags and final_score."""
    needed = {*SARIF_COLUMNS, *order}
    parts = scan_parts(findings.select(*[c for c in findings.columns if c in needed]), scans)
    mark = tool["name"].lower() + "/v1"
    items = [_sarif_items(part, order, mark, in_place) for part, _, in_place in parts]
    driver = (
        f'"name":"{tool["name"]}","version":"{tool["version"]}","semanticVersion":"{tool["version"]}"'
    )
    head = F.lit(f'{{"$schema":"{SARIF_SCHEMA}","version":"2.1.0","runs":[{{"tool":{{"driver":{{{driver},"rules":[')
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    tail = F.concat(
        F.lit('],"invocations":[{"executionSuccessful":true,"startTimeUtc":"'), now,
        F.lit('","endTimeUtc":"'), now, F.lit('"}],"columnKind":"utf16CodeUnits"}]}'),
    )
    return _union(
        [text_lines(scans, 0, head), text_lines(scans, 2, F.lit(']}},"results":[')), text_lines(scans, 4, tail), *items]
    )


def _sarif_items(findings: DataFrame, order: list[str], mark: str, in_place: bool) -> DataFrame:
    """Lines of the rules and of the results. Findings that are `dealt` by scan (`in_place`) stay where they are."""
    text = lambda c: F.struct(c.alias("text"))
    tags = F.col("tags") if "tags" in findings.columns else F.array().cast("array<string>")
    points = F.col("final_score") if "final_score" in findings.columns else F.lit(0.0)
    rule = json_of(
        id=F.col("rule_id"),
        name=F.col("title"),
        shortDescription=text(F.col("title")),
        fullDescription=text(F.col("description")),
        help=F.struct(
            F.col("remediation").alias("text"),
            F.concat(F.lit("**Remediation:** "), "remediation").alias("markdown"),
        ),
        defaultConfiguration=F.struct(sarif_level(F.col("severity")).alias("level")),
        properties=F.struct(tags.alias("tags"), F.col("category").alias("category")),
    )
    # rules are numbered from 0 within their scan, so the number says which is first
    rule_cells = [
        F.lit(1).alias("section"), F.format_string("%012d", "rule_index").alias("sort_key"),
        F.concat(F.when(F.col("rule_index") > 0, ",").otherwise(""), rule).alias("line"),
    ]
    location = F.struct(
        F.struct(
            F.struct(F.col("uri"), F.lit("%SRCROOT%").alias("uriBaseId")).alias("artifactLocation"),
            F.struct(F.col("start_line").alias("startLine"), F.lit(1).alias("startColumn")).alias("region"),
        ).alias("physicalLocation")
    )
    fields = dict(
        ruleId=F.col("rule_id"),
        ruleIndex=F.col("rule_index"),
        level=F.col("level"),
        message=text(F.col("description")),
        locations=F.array(location),
        fingerprints=F.struct(F.col("fingerprint").alias(mark)),
        properties=F.struct("severity", "category", "evidence", points.alias("final_score")),
    )
    fix = F.array(F.struct(text(F.col("remediation")).alias("description")))
    result = F.when(F.col("has_fix"), json_of(**fields, fixes=fix)).otherwise(json_of(**fields))
    key = F.col("finding_id")
    if in_place:
        # one pass: a finding gives its own line, and that of its rule if it is the first of it
        has_rule = F.col("rule_id").isNotNull()
        rows = _placed(_result_facts(_with_rule_index(findings, order)), key, F.when(has_rule, result))
        own = F.struct(F.lit(3).alias("section"), _placed_key(key).alias("sort_key"), _placed_line(result).alias("line"))
        lines = F.array(F.when(has_rule, own), F.when(F.col("_is_sight"), F.struct(*rule_cells)))
        return rows.select("scan_id", F.inline(F.array_compact(lines)))
    rules = sarif_rules(findings, order)
    # the first key of a scan comes along with its rules, so a finding is moved once for both
    first = findings.groupBy("scan_id").agg(F.min("finding_id").alias("_first"))
    known = rules.select("scan_id", "rule_id", "rule_index").join(first, "scan_id")
    results = _commas(sarif_results(findings, known), 3, key, result)
    return rules.select("scan_id", *rule_cells).unionByName(results)


def to_cyclonedx(packages: DataFrame, scans: DataFrame) -> DataFrame:
    """CycloneDX 1.5: one component per package row, named after the last part of the target."""
    last = F.substring_index("target", "/", -1)
    head = F.concat(
        F.lit('{"bomFormat":"CycloneDX","specVersion":"1.5","serialNumber":"urn:uuid:'), F.uuid(),
        F.lit('","version":1,"metadata":'),
        json_of(
            timestamp=F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"),
            tools=F.array(F.struct(*[F.lit(v).alias(k) for k, v in SBOM_TOOL.items()])),
            component=F.struct(
                F.lit("application").alias("type"),
                F.when(F.coalesce(last, F.lit("")) == "", "project").otherwise(last).alias("name"),
                F.lit("0.0.0").alias("version"),
            ),
        ),
        F.lit(',"components":['),
    )
    licenses = F.when(
        F.col("license").isNotNull(),
        F.array(F.struct(F.struct(F.col("license").alias("id")).alias("license"))),
    )
    component = F.to_json(
        F.struct(
            F.lit("library").alias("type"), "name", "version", "purl", licenses.alias("licenses")
        )
    )
    # equal packages stay apart by their number, so that each has a sort key of its own
    cells = ["scan_id", "ecosystem", "name", "version", "purl", "license"]
    numbered = packages.groupBy(*cells).agg(F.count("*").alias("_n")).withColumn(
        "_i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n")))
    )
    key = F.concat_ws(
        "|", *[F.coalesce(c, F.lit("")) for c in cells[1:]], F.format_string("%012d", "_i")
    )
    items = array_lines(numbered, 1, key, component)
    return _union([text_lines(scans, 0, head), items, text_lines(scans, 2, F.lit("]}"))])


def export_report_payload(
    scans: DataFrame,
    findings: DataFrame,
    risk: DataFrame,
    summary: DataFrame,
    top: DataFrame,
    scores: DataFrame,
    packages: DataFrame,
    records: DataFrame,
    in_place: bool = False,
) -> DataFrame:
    """The whole report of a scan: metadata, metrics, summary, top findings, alignments, packages, findings, intel.

    Inputs are the results of scan_risk, executive_summary, top_risks, compliance_score (per scan),
    sbom_packages and scan_records. Bounded lists (five findings, three frameworks, eight packages)
    go into the head; findings and records are lines. `in_place`: the findings, and so what is made of
    them by scan, are `dealt` by scan (`scan_parts`).
    """
    levels = SEVERITIES[:4]
    counts = findings.groupBy("scan_id").agg(
        F.count("*").alias("total_findings"), *[F.count_if(F.col("severity") == s).alias(s) for s in levels]
    )
    shown = ["title", "severity", "category", "file_path", "line_number", "evidence", "remediation"]
    if "remediation" not in top.columns:
        top = top.withColumn("remediation", F.lit(""))
    best = top.groupBy("scan_id").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("place", *shown))),
            lambda x: F.struct(*[x[c].alias(c) for c in shown]),
        ).alias("_top")
    )
    aligned = (
        scores.filter(F.col("framework").isin("nist-csf", "soc-2", "owasp-10"))
        .groupBy("scan_id")
        .agg(
            F.map_from_entries(
                F.sort_array(F.collect_list(F.struct("framework", F.struct("score", "passed", "failed"))))
            ).alias("_scores")
        )
    )
    first_packages = W.partitionBy("scan_id").orderBy("name", "version")
    preview = (
        packages.withColumn("_n", F.row_number().over(first_packages))
        .filter(F.col("_n") <= PREVIEW_PACKAGES)
        .groupBy("scan_id")
        .agg(F.sort_array(F.collect_list(F.struct("name", "version", "ecosystem", "purl"))).alias("_packages"))
    )
    rows = (
        scans.join(counts, "scan_id", "left")
        .join(risk, "scan_id", "left")
        .join(summary, "scan_id", "left")
        .join(best, "scan_id", "left")
        .join(aligned, "scan_id", "left")
        .join(preview, "scan_id", "left")
        .fillna(0, ["total_findings", *levels, "risk"])
        .fillna("Low", ["label"])
    )
    time_of = lambda c: F.col(c).cast("string") if c in scans.columns else F.lit(None).cast("string")
    head = F.concat(
        F.lit('{"scan_metadata":'),
        json_of(
            id=F.col("scan_id"), target=F.col("target"), type=F.col("scan_type"), status=F.col("status"),
            started_at=time_of("started_at"), completed_at=time_of("completed_at"),
        ),
        F.lit(',"metrics":'),
        json_of(
            **{c: F.col(c) for c in ["total_findings", *levels]},
            risk_score=F.col("risk"), risk_label=F.col("label"),
        ),
        F.lit(',"summary":'),
        F.regexp_extract(json_of(t=F.coalesce("summary", F.lit(""))), r'(?s)^\{"t":(.*)\}$', 1),
        F.lit(',"top_findings":'),
        F.coalesce(F.to_json("_top", KEEP_NULLS), F.lit("[]")),
        F.lit(',"compliance_alignments":'),
        F.coalesce(F.to_json("_scores"), F.lit("{}")),
        F.lit(',"sbom_preview":'),
        F.coalesce(F.to_json("_packages"), F.lit("[]")),
        F.lit(',"all_findings":['),
    )
    shown_fields = ["title", "severity", "category", "file_path", "line_number", "is_fixed"]
    finding = json_of(id=F.col("finding_id"), **{c: F.col(c) for c in shown_fields})
    listed = array_lines(findings, 1, F.col("finding_id"), finding, in_place)
    known_fields = ["cve_id", "known_exploited", "epss", "percentile", "priority", "summary", "urgency", "sources"]
    # records come dealt by CVE
    records = dealt(records.select("scan_id", *known_fields), "scan_id") if in_place else records
    known = array_lines(records, 3, F.col("cve_id"), json_of(**{c: F.col(c) for c in known_fields}), in_place)
    return _union(
        [
            text_lines(rows, 0, head),
            listed,
            text_lines(scans, 2, F.lit('],"threat_intelligence":[')),
            known,
            text_lines(scans, 4, F.lit("]}")),
        ]
    )
