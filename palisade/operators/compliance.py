"""Findings against the controls of four frameworks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.base import any_of
from palisade.operators.common import literal_table
from palisade.operators.dashboard import half_up

ALIASES = {"rbi": "rbi-csf", "nist": "nist-csf", "soc2": "soc-2", "owasp10": "owasp-10"}
VIOLATING = ["critical", "high", "medium"]
CONTROL = (
    "framework string, control_id string, name string, category string, description string, match_cat string"
)


def _controls(framework: str, rows: list[tuple]) -> list[dict]:
    names = ["control_id", "name", "category", "description", "match_cat"]
    return [{"framework": framework, **dict(zip(names, row))} for row in rows]


# The controls and the finding category that breaks each.
CONTROLS = (
    _controls("rbi-csf", [
        ("RBI-1.1", "Baseline Cyber Security Controls", "Governance", "Enforce baseline cybersecurity practices across banking applications.", "misconfig"),
        ("RBI-2.4", "Network Subnet & Access Isolation", "Network", "Restrict wildcard binding and isolate internal banking network segments.", "misconfig"),
        ("RBI-3.1", "Data Integrity & Encryption Protection", "Data", "Ensure sensitive customer data and credentials are securely encrypted.", "secret"),
        ("RBI-4.2", "Vulnerability Management & CVE Patching", "Operations", "Maintain updated libraries and remediate third-party component vulnerabilities.", "cve"),
        ("RBI-5.6", "User Access Control & Credential Security", "Identity", "Prevent hardcoded API keys and unauthorized credential sharing.", "secret"),
        ("RBI-6.3", "Security Code Auditing & SAST Controls", "Development", "Perform static analysis to catch logic bugs and injection attacks.", "sast"),
        ("RBI-7.1", "Continuous Monitoring & Audit Logging", "Monitoring", "Maintain audit trails and real-time security incident alerting.", "sast"),
    ])
    + _controls("nist-csf", [
        ("ID.AM", "Asset Management", "Identify", "Identify assets to manage security risks.", "misconfig"),
        ("PR.AC", "Access Control", "Protect", "Ensure access to assets is limited to authorized users.", "secret"),
        ("PR.DS", "Data Security", "Protect", "Manage data consistent with the organization's risk strategy.", "cve"),
        ("PR.PT", "Protective Technology", "Protect", "Manage security logs and protection systems.", "sast"),
        ("DE.AE", "Security Monitoring & Detections", "Detect", "Detect anomalies and events to identify threats.", "sast"),
        ("RS.CO", "Incident Response Communication", "Respond", "Manage response activities and coordination.", "drift"),
    ])
    + _controls("soc-2", [
        ("CC6.1", "Logical Access Controls", "Security", "Restrict logical access to authorized endpoints.", "secret"),
        ("CC6.6", "Transmission Integrity Protection", "Security", "Protect data transmission from tampering or leakage.", "secret"),
        ("CC7.1", "Vulnerability & Threat Management", "Security", "Identify and evaluate system vulnerabilities.", "cve"),
        ("CC8.1", "System Operation Controls", "Security", "Monitor system operations to detect anomalies.", "sast"),
        ("CC9.1", "Business Risk Mitigation", "Security", "Manage vendor and operational risks.", "misconfig"),
    ])
    + _controls("owasp-10", [
        ("A01", "Broken Access Control", "Web Security", "Prevent unauthorized privilege escalation and access.", "secret"),
        ("A02", "Cryptographic Failures", "Web Security", "Ensure protection of sensitive data at rest and in transit.", "secret"),
        ("A03", "Injection", "Web Security", "Prevent SQL, OS, or LDAP injection scripts.", "sast"),
        ("A05", "Security Misconfiguration", "Web Security", "Enforce secure defaults and configuration hardening.", "misconfig"),
        ("A06", "Vulnerable and Outdated Components", "Web Security", "Keep dependencies and software packages up to date.", "cve"),
        ("A07", "Identification and Authentication Failures", "Web Security", "Enforce authentication and session management.", "secret"),
        ("A09", "Security Logging and Monitoring Failures", "Web Security", "Record audit trails and monitor threats.", "sast"),
    ])
)
CATEGORIES = sorted({c["match_cat"] for c in CONTROLS})


def framework_key(name: str) -> str:
    key = name.lower().strip()
    key = ALIASES.get(key, key)
    known = sorted({c["framework"] for c in CONTROLS})
    if key not in known:
        raise ValueError(f"unsupported framework {name!r}, use one of {', '.join(known)}")
    return key


def controls_of(framework: str | None = None) -> list[dict]:
    if framework is None:
        return CONTROLS
    key = framework_key(framework)
    return [c for c in CONTROLS if c["framework"] == key]


def violations(findings: DataFrame, scans: DataFrame, scan_id: str | None = None) -> DataFrame:
    """Open findings of medium or above: of one scan, or of all completed scans."""
    open_ones = findings.filter(~F.col("is_fixed") & F.col("severity").isin(VIOLATING))
    if scan_id is not None:
        return open_ones.filter(F.col("scan_id") == scan_id)
    return open_ones.join(scans.filter("status = 'completed'").select("scan_id"), "scan_id", "left_semi")


def _count_columns() -> list[Column]:
    return [F.count_if(F.lower("category") == c).alias(f"_{c}") for c in CATEGORIES]


def _control_rows(counts: DataFrame, framework: str | None, *keys: str) -> DataFrame:
    """Unfold the controls over rows that hold one count per category."""
    n = F.lit(0).cast("bigint")
    for c in CATEGORIES:
        n = F.when(F.col("match_cat") == c, F.coalesce(f"_{c}", F.lit(0))).otherwise(n)
    names = [f"_{c}" for c in CATEGORIES]
    return (
        counts.select(*keys, *names, F.inline(literal_table(controls_of(framework), CONTROL)))
        .withColumn("n_findings", n)
        .withColumn("status", F.when(F.col("n_findings") == 0, "passed").otherwise("failed"))
        .drop(*names, "match_cat")
    )


def compliance_controls(
    findings: DataFrame, scans: DataFrame, framework: str | None = None, scan_id: str | None = None
) -> DataFrame:
    """One row per control: status and number of findings. The findings: `control_findings`.

    Findings are counted per scan and category first, so only counts meet the scans; controls are
    unfolded over the one row that is left.
    """
    open_ones = findings.filter(~F.col("is_fixed") & F.col("severity").isin(VIOLATING))
    if scan_id is not None:
        return _control_rows(open_ones.filter(F.col("scan_id") == scan_id).agg(*_count_columns()), framework)
    per_scan = open_ones.groupBy("scan_id").agg(*_count_columns())
    completed = scans.filter("status = 'completed'").select("scan_id")
    names = [f"_{c}" for c in CATEGORIES]
    counts = per_scan.join(completed, "scan_id", "left_semi").agg(*[F.sum(n).alias(n) for n in names])
    return _control_rows(counts, framework)


def scan_controls(findings: DataFrame, scans: DataFrame, framework: str | None = None) -> DataFrame:
    """One row per scan and control, for all scans, whatever their status."""
    open_ones = findings.filter(~F.col("is_fixed") & F.col("severity").isin(VIOLATING))
    counts = open_ones.groupBy("scan_id").agg(*_count_columns())
    return _control_rows(scans.select("scan_id").join(counts, "scan_id", "left"), framework, "scan_id")


def control_findings(
    findings: DataFrame, scans: DataFrame, framework: str | None = None, scan_id: str | None = None
) -> DataFrame:
    """framework, control_id, scan_id, finding_id: the findings that break each control, as rows."""
    broken = F.filter(
        literal_table(controls_of(framework), CONTROL), lambda c: c["match_cat"] == F.lower("category")
    )
    return violations(findings, scans, scan_id).select(
        "scan_id", "finding_id", F.inline(F.transform(broken, lambda c: F.struct(c["framework"], c["control_id"])))
    ).toDF("scan_id", "finding_id", "framework", "control_id")


def compliance_score(controls: DataFrame) -> DataFrame:
    """Passed, failed and percent per framework (and per scan, if the controls have one)."""
    keys = [k for k in ("scan_id", "framework") if k in controls.columns]
    passed = F.count_if(F.col("status") == "passed")
    total = F.count("*")
    return controls.groupBy(*keys).agg(
        total.alias("total_controls"),
        passed.alias("passed"),
        (total - passed).alias("failed"),
        F.round(passed / total * F.lit(100.0), 1).alias("score"),
    )


def compliance_findings(
    findings: DataFrame, scans: DataFrame, framework: str | None = None, scan_id: str | None = None
) -> DataFrame:
    """The findings that break any control, each once."""
    broken_by = sorted({c["match_cat"] for c in controls_of(framework)})
    return violations(findings, scans, scan_id).filter(F.lower("category").isin(broken_by))


def control_category_coverage(controls: DataFrame) -> DataFrame:
    """Whole percent of passed controls by framework and control category."""
    share = F.count_if(F.col("status") == "passed") / F.count("*")
    return controls.groupBy("framework", "category").agg(half_up(share * F.lit(100.0)).alias("percent"))


# The named controls of the keyword form, ten per framework: (name, category).
NAMED_CONTROLS = {
    "RBI-CSF": [
        ("RBI-1.1: Baseline Cybersecurity Controls", "Governance"),
        ("RBI-2.4: Network Subnet & Access Isolation", "Network"),
        ("RBI-3.1: Data Integrity & Secret Encryption", "Data Security"),
        ("RBI-4.2: Vulnerability & Dependency Management", "Vulnerability Management"),
        ("RBI-5.6: User Access Control & Key Security", "Access Control"),
        ("RBI-6.3: Static Application Security Testing (SAST)", "Code Auditing"),
        ("RBI-7.1: Continuous Monitoring & Audit Logs", "Audit Trails"),
        ("RBI-3.5: Cryptographic Hashing Standards", "Encryption"),
        ("RBI-6.8: Real-Time Incident Response Alerts", "Incident Response"),
        ("RBI-2.8: SSRF Outbound Firewall Controls", "Subnet Protection"),
    ],
    "NIST-CSF": [
        ("Asset Management (ID.AM)", "Identify"),
        ("Risk Assessment (ID.RA)", "Identify"),
        ("Identity Management & Access Control (PR.AC)", "Protect"),
        ("Data Security & Encryption (PR.DS)", "Protect"),
        ("Protective Technology (PR.PT)", "Protect"),
        ("Security Continuous Monitoring (DE.CM)", "Detect"),
        ("Detection Processes (DE.DP)", "Detect"),
        ("Response Planning (RS.RP)", "Respond"),
        ("Mitigation (RS.MI)", "Respond"),
        ("Recovery Planning (RC.RP)", "Recover"),
    ],
    "SOC-2": [
        ("Logical Access Control (CC6.1)", "Security"),
        ("System Boundary Defense (CC6.3)", "Security"),
        ("Vulnerability Patching (CC7.3)", "Security"),
        ("Data Transmission Encryption (CC6.6)", "Confidentiality"),
        ("Data Storage Protection (CC6.7)", "Confidentiality"),
        ("Risk Mitigation (CC9.1)", "Confidentiality"),
        ("System Operations & Monitoring (CC7.1)", "Availability"),
        ("Business Continuity & Backups (A1.2)", "Availability"),
        ("Change Management (CC8.1)", "Processing Integrity"),
        ("Privacy Policy & Consent (P1.1)", "Privacy"),
    ],
    "OWASP-10": [
        ("A01:2021-Broken Access Control", "Broken Access Control"),
        ("A02:2021-Cryptographic Failures", "Cryptographic Failures"),
        ("A03:2021-Injection", "Injection"),
        ("A04:2021-Insecure Design", "Insecure Design"),
        ("A05:2021-Security Misconfiguration", "Security Misconfiguration"),
        ("A06:2021-Vulnerable and Outdated Components", "Vulnerable Components"),
        ("A07:2021-Identification and Authentication Failures", "Auth Failures"),
        ("A08:2021-Software and Data Integrity Failures", "Integrity Failures"),
        ("A09:2021-Security Logging and Monitoring Failures", "Logging Failures"),
        ("A10:2021-Server-Side Request Forgery (SSRF)", "SSRF"),
    ],
}
# Words in a control's name, then words in a finding's category and title that break it.
KEYWORD_FAMILIES = [
    (["password", "access", "user id", "role-based", "auth", "identity"],
     ["secret", "auth"], ["password", "credential", "access"]),
    (["encryption", "data protection", "cryptography", "key management", "data security", "data storage"],
     ["crypto", "secret"], ["hashing", "tls", "ssl", "encrypt", "key"]),
    (["vulnerability", "development", "anti-virus", "asset", "component", "patching", "integrity"],
     ["dep", "cve"], ["vulnerable", "outdated"]),
    (["firewall", "network", "config", "monitoring", "audit", "boundary", "operations",
      "protective technology", "logging"],
     ["misconfig"], ["cors", "port", "bind", "debug", "log"]),
    (["incident", "response", "communication", "recovery", "mitigation"],
     [], ["log", "error", "disclosure", "fix"]),
    (["injection"], ["cve"], ["injection", "sql", "xss"]),
    (["ssrf", "request forgery"], [], ["ssrf", "redirect", "forgery"]),
]
REMEDIED_FAMILY = 4  # findings with a remediation text also break the controls of this family


def _families_of(name: str) -> list[int]:
    return [i for i, (words, _, _) in enumerate(KEYWORD_FAMILIES) if any(w in name.lower() for w in words)]


def _breaks(family: int, has_remediation: bool) -> Column:
    _, category_words, title_words = KEYWORD_FAMILIES[family]
    hits = [F.lower("category").contains(w) for w in category_words]
    hits += [F.lower("title").contains(w) for w in title_words]
    if family == REMEDIED_FAMILY and has_remediation:
        hits.append(F.coalesce("remediation", F.lit("")) != "")
    return F.coalesce(any_of(hits), F.lit(False))


def _named(framework: str | None) -> list[tuple[str, int, str, str, int]]:
    """(framework, number, name, category, how many in the framework)."""
    return [
        (fw, i, name, category, len(rows))
        for fw, rows in NAMED_CONTROLS.items()
        for i, (name, category) in enumerate(rows, 1)
        if framework in (None, fw)
    ]


def keyword_controls(findings: DataFrame, framework: str | None = None) -> DataFrame:
    """Named controls with status by words; the last of a framework is not-applicable if nothing hits it.

    All counts come from one pass; findings and controls are never paired.
    """
    wanted = _named(framework)
    has_remediation = "remediation" in findings.columns
    flags = [f"_f{i}" for i in range(len(KEYWORD_FAMILIES))]
    flagged = findings.select(*[_breaks(i, has_remediation).alias(f) for i, f in enumerate(flags)])
    sets = sorted({tuple(_families_of(name)) for _, _, name, _, _ in wanted})
    label = {s: f"_n{i}" for i, s in enumerate(sets)}
    counts = [
        F.count_if(any_of([F.col(flags[i]) for i in s]) if s else F.lit(False)).alias(label[s]) for s in sets
    ]
    one = flagged.agg(F.count("*").alias("_total"), *counts)
    rows = []
    for fw, number, name, category, size in wanted:
        n = F.col(label[tuple(_families_of(name))])
        status = F.when(n > 0, "failed")
        if number == size:
            status = status.when(F.col("_total") > 0, "not-applicable")
        rows.append(
            F.struct(
                F.lit(fw).alias("framework"),
                F.lit(f"{fw}-{number:03d}").alias("control_id"),
                F.lit(name).alias("name"),
                F.lit(category).alias("category"),
                F.lit(f"Ensure {name.lower()} is properly implemented and maintained.").alias("description"),
                n.alias("n_findings"),
                status.otherwise("passed").alias("status"),
            )
        )
    return one.select(F.inline(F.array(*rows)))


def keyword_control_findings(findings: DataFrame, framework: str | None = None) -> DataFrame:
    """finding_id, control_id: which findings break which named control."""
    has_remediation = "remediation" in findings.columns
    ids = [
        F.when(any_of([_breaks(i, has_remediation) for i in _families_of(name)]), F.lit(f"{fw}-{n:03d}"))
        for fw, n, name, _, _ in _named(framework)
        if _families_of(name)
    ]
    return findings.select("finding_id", F.explode(F.array_compact(F.array(*ids))).alias("control_id"))


def keyword_score(controls: DataFrame) -> DataFrame:
    """Whole percent of passed among the applicable controls, per framework."""
    passed = F.count_if(F.col("status") == "passed")
    failed = F.count_if(F.col("status") == "failed")
    applicable = passed + failed
    return controls.groupBy("framework").agg(
        passed.alias("passed"),
        failed.alias("failed"),
        F.count_if(F.col("status") == "not-applicable").alias("not_applicable"),
        F.when(applicable == 0, F.lit(100).cast("bigint"))
        .otherwise(half_up(F.try_divide(passed, applicable) * F.lit(100.0)))
        .alias("score"),
    )
