"""Column types of the stored tables and of the nested feeds, as DDL."""

from __future__ import annotations

SEVERITIES = ["critical", "high", "medium", "low", "info"]
SCAN_STATUSES = ["pending", "running", "completed", "failed"]

FINDING = """finding_id string, scan_id string, rule_id string, title string, description string,
       severity string, category string, file_path string, line_number int, evidence string,
       remediation string, references array<string>, tags array<string>, cvss_score double,
       metadata map<string,string>"""

RULE = """rule_id string, name string, description string, severity string, category string,
       pattern string, file_types array<string>, remediation string,
       references array<string>, tags array<string>"""

CHECK = """config_type string, check_id string, name string, description string, severity string,
       check_type string, pattern string, remediation string, tags array<string>"""

SECRET_PATTERN = "name string, pattern string, severity string, description string, tags array<string>"

ADVISORY = """id string, summary string, details string, aliases array<string>,
       severity array<struct<type:string,score:string>>,
       database_specific struct<severity:string>,
       affected array<struct<
         package:struct<ecosystem:string,name:string>,
         ranges:array<struct<type:string,
           events:array<struct<introduced:string,fixed:string,last_affected:string,`limit`:string>>>>,
         versions:array<string>>>,
       references array<struct<url:string>>"""

KEV_FEED = "vulnerabilities array<struct<cveID:string,product:string,shortDescription:string>>"

EPSS_FEED = "data array<struct<cve:string,epss:string,percentile:string>>"

PROGRESS = """event_id long, ts timestamp, scan_id string, type string, phase string, percent double,
       findings_count int, finding string, status string, error string"""

SEMGREP_REPORT = """results array<struct<check_id:string, path:string, start:struct<line:int>,
         extra:struct<message:string, severity:string, lines:string,
           metadata:struct<fix:string, `source-url`:string>>>>"""

BANDIT_REPORT = """results array<struct<test_id:string, test_name:string, issue_text:string,
         issue_severity:string, filename:string, line_number:int, code:string,
         more_info:string, issue_cwe:struct<id:long>>>"""
