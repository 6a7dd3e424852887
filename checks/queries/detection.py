"""Rules, secrets, baselines and history over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import Inputs, query
from palisade.operators import analysers, detect, directives, history, log_walk
from palisade.operators.scoring import BANKING_WORDS
from palisade.plans import scan as plan
from palisade.sources import rules as rule_source
from palisade.session import new_path
from palisade.sources.gitlog import latest_commits, read_git_lines, write_git_dumps
from palisade.sources.large import read_chunks

c = F.col
KEYWORDS = "|".join(BANKING_WORDS)

# Rules for what is planted in the given texts. Patterns stay within a line.
DEMO_RULES = [
    {"id": "DEMO-TOKEN", "name": "Token in clear text", "severity": "critical", "category": "secrets",
     "pattern": "token *= *\"[0-9a-f]{40}\"", "tags": ["token"]},
    {"id": "DEMO-CARD", "name": "Long number", "severity": "high", "category": "banking-specific",
     "pattern": r"\b[0-9]{13,19}\b", "file_types": ["*.py", "*.yml", "*.conf", "*.json"]},
    {"id": "DEMO-IP", "name": "Address in text", "severity": "medium", "category": "network",
     "pattern": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"},
    {"id": "DEMO-LICENSE", "name": "License line", "severity": "low", "category": "legal",
     "pattern": "released under the [a-z0-9. -]+ license"},
    {"id": "DEMO-LINE", "name": "Line that starts with En", "severity": "info", "category": "style",
     "pattern": "^en[a-z]*", "file_types": ["/srv/src1*/d*"]},
]
DEMO_CHECKS = [
    {"id": "PAGE-1", "name": "No link", "severity": "medium", "check_type": "must_exist", "pattern": "<link"},
    {"id": "PAGE-2", "name": "Charset", "severity": "low", "check_type": "must_match", "pattern": "<meta charset"},
    {"id": "PAGE-3", "name": "Script", "severity": "high", "check_type": "must_not_match", "pattern": "<script[^>]*>"},
    {"id": "PAGE-4", "name": "Advert", "severity": "low", "check_type": "must_not_exist", "pattern": "class=\"ad\""},
]


def demo_rules(t: Inputs):
    return t.spark.createDataFrame(rule_source.rule_rows(DEMO_RULES), rule_source.schemas.RULE)


def demo_checks(t: Inputs):
    rows = [rule_source._check_row("nginx", "demo", e) for e in DEMO_CHECKS]
    return t.spark.createDataFrame(rows, rule_source.schemas.CHECK)


def _rules_sql() -> str:
    globs = {
        "DEMO-CARD": r"regexp_matches(path, '\.(py|yml|conf|json)$')",
        "DEMO-LINE": "regexp_matches(path, '^/srv/src1.*/d')",
    }
    return " UNION ALL ".join(
        f"SELECT path, scan_id, line_number, '{r['id']}' AS rule_id, unnest(regexp_extract_all(line, '(?i){r['pattern']}')) AS evidence"
        f" FROM lines WHERE {globs.get(r['id'], 'true')}"
        for r in DEMO_RULES
    )


LINES = """lines AS (SELECT scan_id, path, unnest(string_split(content, chr(10))) AS line, unnest(range(1, 1 + len(string_split(content, chr(10))))) AS line_number FROM v_files)"""
MATCHES = f"WITH {LINES}, matches AS ({_rules_sql()})"


@query(MATCHES + "SELECT scan_id, path AS file_path, rule_id, line_number::INT AS line_number, left(evidence, 200) AS evidence FROM matches")
def rule_scan(t: Inputs):
    found = detect.rule_scan(t.busy.v_files, demo_rules(t))
    return found.select("scan_id", "file_path", "rule_id", "line_number", "evidence")


@query(MATCHES + f""", words AS (SELECT path, list(regexp_matches(lower(line), '{KEYWORDS}') ORDER BY line_number) AS hits FROM lines GROUP BY path)
SELECT m.path AS file_path, rule_id, line_number::INT AS line_number, list_contains(list_slice(hits, greatest(line_number - 2, 1), line_number + 2), true) AS context_keyword
FROM matches m JOIN words w ON w.path = m.path""")
def rule_context_words(t: Inputs):
    found = detect.rule_scan(t.busy.v_files, demo_rules(t))
    return found.select("file_path", "rule_id", "line_number", "context_keyword")


@query(MATCHES + """, whole AS (SELECT path, list(line ORDER BY line_number) AS all_lines FROM lines GROUP BY path)
SELECT m.path AS file_path, rule_id, line_number::INT AS line_number, array_to_string(list_slice(all_lines, greatest(line_number - 2, 1), line_number + 2), chr(10)) AS context
FROM matches m JOIN whole w ON w.path = m.path""")
def rule_context_text(t: Inputs):
    found = detect.rule_scan(t.busy.v_files, demo_rules(t), keep_context_text=True)
    return found.select("file_path", "rule_id", "line_number", F.element_at("metadata", "context").alias("context"))


@query(r"""
SELECT scan_id, path FROM v_files WHERE regexp_matches(path, '\.(yml|json|conf)$') AND NOT contains(path, '/node_modules/')""")
def config_files(t: Inputs):
    return detect.config_files(t.v_files).select("scan_id", "path")


SECRETS_SQL = r"""SELECT * FROM (VALUES ('Hex Token', '(?i)token\s*=\s*["''][0-9a-f]{40}["'']'), ('Card Number', '\b[0-9]{13,19}\b'), ('AWS Access Key', '(?i)\bAKIA[0-9A-Z]{16}\b'), ('Private Key Block', '(?i)-----BEGIN [A-Z ]*PRIVATE KEY-----')) AS p(name, pattern)"""


@query(f"""WITH {LINES}, p AS ({SECRETS_SQL}),
hits AS (SELECT scan_id, path, line_number, name, CASE name WHEN 'Hex Token' THEN regexp_extract(line, '(?i)token\\s*=\\s*["''][0-9a-f]{{40}}["'']')
   WHEN 'Card Number' THEN regexp_extract(line, '\\b[0-9]{{13,19}}\\b') WHEN 'AWS Access Key' THEN regexp_extract(line, '(?i)\\bAKIA[0-9A-Z]{{16}}\\b')
   ELSE regexp_extract(line, '(?i)-----BEGIN [A-Z ]*PRIVATE KEY-----') END AS m FROM lines, p)
SELECT scan_id, path AS file_path, line_number::INT AS line_number, name AS title, left(m,4) || repeat('*', length(m) - 8) || right(m,4) AS evidence FROM hits WHERE m <> ''""")
def secret_scan(t: Inputs):
    found = detect.secret_scan(t.busy.v_files, rule_source.builtin_secret_patterns(t.spark))
    return found.select("scan_id", "file_path", "line_number", "title", "evidence")


@query(f"""WITH {LINES}, hits AS (SELECT scan_id, path, line_number, regexp_extract(line, '\\b[0-9]{{13,19}}\\b') AS m FROM lines),
e AS (SELECT scan_id, path, line_number, m, -sum(n / length(m)::DOUBLE * log2(n / length(m)::DOUBLE)) AS bits FROM (
   SELECT scan_id, path, line_number, m, ch, count(*) AS n FROM (SELECT *, unnest(string_split(m, '')) AS ch FROM hits WHERE m <> '') GROUP BY ALL) GROUP BY 1,2,3,4)
SELECT scan_id, path AS file_path, line_number::INT AS line_number, left(m,4) || repeat('*', length(m) - 8) || right(m,4) AS evidence FROM e WHERE bits >= 2.9""")
def secret_scan_entropy(t: Inputs):
    patterns = rule_source.builtin_secret_patterns(t.spark).filter("name = 'Card Number'")
    found = detect.secret_scan(t.busy.v_files, patterns, min_entropy=2.9)
    return found.select("scan_id", "file_path", "line_number", "evidence")


@query(r"""
SELECT path AS file_path, 'PAGE-1' AS rule_id, 0 AS line_number, 'Pattern not present in file' AS evidence, 'Expected pattern not found: <link' AS detail FROM v_page_files WHERE NOT contains(lower(content), '<link')
UNION ALL SELECT path, 'PAGE-2', 0, 'Pattern not matched', 'Required pattern not matched: <meta charset' FROM v_page_files WHERE NOT contains(lower(content), '<meta charset')
UNION ALL SELECT path, 'PAGE-3', len(string_split(regexp_extract(content, '(?is)^(.*?)<script[^>]*>', 1), chr(10)))::INT, left(regexp_extract(content, '(?i)<script[^>]*>'), 200), 'Insecure pattern matched: ' || regexp_extract(content, '(?i)<script[^>]*>')
  FROM v_page_files WHERE regexp_matches(content, '(?i)<script[^>]*>')
UNION ALL SELECT path, 'PAGE-4', len(string_split(regexp_extract(content, '(?is)^(.*?)class="ad"', 1), chr(10)))::INT, regexp_extract(content, '(?i)class="ad"'), 'Forbidden pattern found: ' || regexp_extract(content, '(?i)class="ad"')
  FROM v_page_files WHERE regexp_matches(content, '(?i)class="ad"')""")
def drift_scan(t: Inputs):
    found = detect.drift_scan(t.busy.v_page_files, demo_checks(t))
    return found.select(
        "file_path", "rule_id", "line_number", "evidence", F.element_at("metadata", "drift_detail").alias("detail")
    )


@query("""
SELECT path AS file_path, rule_id FROM v_nginx_files, (VALUES ('DRIFT-NGINX-002'), ('DRIFT-NGINX-003'), ('DRIFT-NGINX-004'), ('DRIFT-NGINX-005')) AS r(rule_id)
WHERE NOT (rule_id = 'DRIFT-NGINX-002' AND id % 2 = 0)
UNION ALL SELECT path, rule_id FROM v_dockerfiles, (VALUES ('DRIFT-DOCKER-001'), ('DRIFT-DOCKER-002'), ('DRIFT-DOCKER-005')) AS r(rule_id)
WHERE NOT (rule_id = 'DRIFT-DOCKER-001' AND id % 2 = 0) AND NOT (rule_id = 'DRIFT-DOCKER-002' AND id % 3 <> 0)""")
def drift_builtin(t: Inputs):
    files = t.v_nginx_files.unionByName(t.v_dockerfiles)
    return detect.drift_scan(files, rule_source.builtin_baselines(t.spark)).select("file_path", "rule_id")


@query("""
SELECT path, 'FROM' AS instruction, 'base:' || CASE WHEN id % 3 = 0 THEN 'latest' ELSE id::VARCHAR END AS arguments, 2 AS line FROM v_dockerfiles
UNION ALL SELECT path, 'RUN', 'apt-get install pkg' || scan_id || ' other', 7 FROM v_dockerfiles
UNION ALL SELECT path, 'USER', 'app', 8 FROM v_dockerfiles WHERE id % 2 = 0
UNION ALL SELECT path, 'HEALTHCHECK', 'CMD true', CASE WHEN id % 2 = 0 THEN 9 ELSE 8 END FROM v_dockerfiles""")
def dockerfile_directives(t: Inputs):
    return directives.dockerfile_directives(t.v_dockerfiles).drop("scan_id")


@query("""
SELECT path, 'user' AS directive, 'www' AS value, 1 AS line, '' AS block FROM v_nginx_files
UNION ALL SELECT path, 'listen', id::VARCHAR, 5, 'http/server' FROM v_nginx_files
UNION ALL SELECT path, 'root', '/x y', 7, 'http/server/location /' FROM v_nginx_files
UNION ALL SELECT path, 'server_tokens', 'off', 10, 'http' FROM v_nginx_files WHERE id % 2 = 0
UNION ALL SELECT path, 'done', '', CASE WHEN id % 2 = 0 THEN 12 ELSE 11 END, '' FROM v_nginx_files""")
def nginx_directives(t: Inputs):
    return directives.nginx_directives(t.v_nginx_files).drop("scan_id")


ADDED = """added AS (SELECT repo, doc_id, short_hash, author, date, path || '/f' || doc_id || '.txt' AS path,
   unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) + 1 + doc_id % 50 AS line_number FROM v_commits
 UNION ALL SELECT repo, doc_id, short_hash, author, date, path || '/f' || doc_id || '.txt', 'tail line', len(string_split(text, chr(10))) + 2 + doc_id % 50 FROM v_commits)"""


def _commits(t: Inputs):
    return t.busy.v_git_records.select("repo", F.struct("doc_id").alias("commit_order"), "record")


@query(f"WITH {ADDED} SELECT repo, short_hash, author, path, line_number::INT AS line_number, line FROM added WHERE NOT starts_with(line, '++')")
def git_log_lines(t: Inputs):
    return history.git_log_lines(_commits(t)).select("repo", "short_hash", "author", "path", "line_number", "line")


def _dumps(t: Inputs):
    """The commits as dumps on disk, read back line by line."""
    path = new_path(t.spark)
    write_git_dumps(t.busy.v_git_records, path, "doc_id")
    return read_git_lines(t.spark, path)


@query(f"""WITH {ADDED} SELECT repo, short_hash, author, path, 1 AS file_no, line_number::INT AS line_number, line FROM added WHERE NOT starts_with(line, '++')""")
def git_dump_lines(t: Inputs):
    return log_walk.added_lines(_dumps(t)).select("repo", "short_hash", "author", "path", "file_no", "line_number", "line")


@query(f"""WITH {ADDED}, h AS (SELECT *, 'Hex Token' AS name, regexp_extract(line, '(?i)token\\s*=\\s*["''][0-9a-f]{{40}}["'']') AS m FROM added UNION ALL SELECT *, 'Card Number', regexp_extract(line, '\\b[0-9]{{13,19}}\\b') FROM added),
k AS (SELECT *, left(m,4) || repeat('*', length(m) - 8) || right(m,4) AS masked, row_number() OVER (PARTITION BY repo, name, path, left(m,4) || repeat('*', length(m) - 8) || right(m,4) ORDER BY doc_id, line_number) AS n
  FROM h JOIN (SELECT repo, doc_id FROM (SELECT repo, doc_id, row_number() OVER (PARTITION BY repo ORDER BY doc_id) AS n FROM v_commits) WHERE n <= 500) USING (repo, doc_id) WHERE m <> '' AND NOT starts_with(line, '++'))
SELECT repo AS scan_id, 'GIT-SECRET-' || upper(replace(name, ' ', '-')) || '-' || short_hash || '-' || left(sha256(path), 6) AS rule_id, path AS file_path, line_number::INT AS line_number,
 'Commit: ' || short_hash || ' | Author: ' || author || ' | Date: ' || date || ' | Secret: ' || masked AS evidence FROM k WHERE n = 1""")
def git_dump_findings(t: Inputs):
    """Dumps to findings: the newest 500 commits of each repository, as the original traverses them."""
    lines = _dumps(t)
    newest = latest_commits(log_walk.commit_headers(lines), 500)
    found = history.history_scan(log_walk.latest_lines(log_walk.added_lines(lines), newest), rule_source.builtin_secret_patterns(t.spark))
    return found.select("scan_id", "rule_id", "file_path", "line_number", "evidence")


@query("""SELECT repo, doc_id FROM (SELECT repo, doc_id, row_number() OVER (PARTITION BY repo ORDER BY doc_id) AS n FROM v_commits) WHERE n <= 30""")
def latest_commits_per_repo(t: Inputs):
    return latest_commits(_commits(t), 30).select("repo", c("commit_order.doc_id").alias("doc_id"))


@query(f"""WITH l AS (SELECT repo, doc_id, short_hash, author, date, path, unnest(string_split(text, chr(10))) AS line, unnest(range(1, 1 + len(string_split(text, chr(10))))) AS line_number FROM v_commits),
h AS (SELECT *, 'Hex Token' AS name, regexp_extract(line, '(?i)token\\s*=\\s*["''][0-9a-f]{{40}}["'']') AS m FROM l UNION ALL SELECT *, 'Card Number', regexp_extract(line, '\\b[0-9]{{13,19}}\\b') FROM l),
k AS (SELECT *, left(m,4) || repeat('*', length(m) - 8) || right(m,4) AS masked, row_number() OVER (PARTITION BY repo, name, path, left(m,4) || repeat('*', length(m) - 8) || right(m,4) ORDER BY doc_id, line_number) AS n FROM h WHERE m <> '')
SELECT repo AS scan_id, 'GIT-SECRET-' || upper(replace(name, ' ', '-')) || '-' || short_hash || '-' || left(sha256(path), 6) AS rule_id, path AS file_path, line_number::INT AS line_number,
 'Commit: ' || short_hash || ' | Author: ' || author || ' | Date: ' || date || ' | Secret: ' || masked AS evidence FROM k WHERE n = 1""")
def history_scan(t: Inputs):
    lines = t.busy.v_commits.select(
        "repo", F.struct("doc_id").alias("commit_order"), "hash", "short_hash", "author", "date", "message", "path",
        F.posexplode(F.split("text", "\n")).alias("_i", "line"),
    ).withColumn("line_number", c("_i") + 1)
    found = history.history_scan(lines, rule_source.builtin_secret_patterns(t.spark))
    return found.select("scan_id", "rule_id", "file_path", "line_number", "evidence")


@query("""
SELECT scan_id, rule_id, title, CASE severity WHEN 'critical' THEN 'high' WHEN 'high' THEN 'medium' ELSE 'low' END AS severity, file_path, line_number, evidence,
  CASE WHEN line_number % 2 = 0 THEN 'use ' || category ELSE 'Review and remediate per Semgrep rule guidance.' END AS remediation,
  CASE WHEN line_number % 2 = 0 THEN '' ELSE 'https://r/' || rule_id END AS links FROM v_findings""")
def semgrep_findings(t: Inputs):
    found = analysers.semgrep_findings(t.busy.v_semgrep_documents)
    return found.select(
        "scan_id", "rule_id", "title", "severity", "file_path", "line_number", "evidence", "remediation",
        F.array_join("references", ",").alias("links"),
    )


@query("""
SELECT scan_id, rule_id, 'about ' || title AS description, CASE severity WHEN 'critical' THEN 'high' WHEN 'high' THEN 'medium' ELSE 'low' END AS severity, line_number,
  'See Bandit docs for ' || rule_id || ': https://b/' || rule_id AS remediation, CASE WHEN line_number % 2 = 0 THEN 'CWE-' || line_number * 10 END AS cwe FROM v_findings""")
def bandit_findings(t: Inputs):
    found = analysers.bandit_findings(t.busy.v_bandit_documents)
    return found.select(
        "scan_id", "rule_id", "description", "severity", "line_number", "remediation",
        F.element_at("metadata", "cwe").alias("cwe"),
    )


@query(MATCHES + f""", types AS (SELECT scan_id, CASE WHEN right(scan_id, 1) IN ('0','1','2') THEN 'full' WHEN right(scan_id, 1) IN ('3','4','5') THEN 'secrets' ELSE 'misconfig' END AS scan_type FROM (SELECT DISTINCT scan_id FROM v_files)),
rules AS (SELECT m.scan_id, 'misconfig' AS category FROM matches m JOIN types t ON t.scan_id = m.scan_id AND scan_type IN ('full','misconfig')
   WHERE regexp_matches(path, '\\.(yml|json|conf)$') AND NOT contains(path, '/node_modules/')),
secrets AS (SELECT l.scan_id, 'secret' AS category FROM lines l JOIN types t ON t.scan_id = l.scan_id AND scan_type IN ('full','secrets'),
   (VALUES ('token\\s*=\\s*["''][0-9a-f]{{40}}["'']'), ('\\b[0-9]{{13,19}}\\b')) AS p(pattern) WHERE regexp_matches(line, '(?i)' || pattern))
SELECT scan_id, category, count(*) AS n FROM (SELECT * FROM rules UNION ALL SELECT * FROM secrets) GROUP BY ALL""")
def all_detectors(t: Inputs):
    files = t.busy.v_files
    last = F.right("scan_id", F.lit(1))
    scans = t.v_files.select("scan_id").distinct().withColumn(
        "scan_type",
        F.when(last.isin("0", "1", "2"), "full").when(last.isin("3", "4", "5"), "secrets").otherwise("misconfig"),
    )
    found = plan.all_detectors(
        files, scans, demo_rules(t), rule_source.builtin_secret_patterns(t.spark), demo_checks(t)
    )
    return found.groupBy("scan_id", "category").agg(F.count("*").alias("n"))


@query(f"""WITH sized AS (SELECT source, doc_id // 500 AS bucket, doc_id, text, len(string_split(text, chr(10))) AS n FROM documents WHERE text IS NOT NULL),
placed AS (SELECT *, sum(n) OVER (PARTITION BY source, bucket ORDER BY doc_id) - n AS above FROM sized),
l AS (SELECT source, bucket, unnest(string_split(text, chr(10))) AS line, above + unnest(range(1, 1 + n)) AS line_number FROM placed),
hits AS (SELECT *, 'misconfig' AS category, 'DEMO-TOKEN' AS rule_id, unnest(regexp_extract_all(line, '(?i){DEMO_RULES[0]["pattern"]}')) AS found FROM l
 UNION ALL SELECT *, 'misconfig', 'DEMO-IP', unnest(regexp_extract_all(line, '(?i){DEMO_RULES[2]["pattern"]}')) FROM l
 UNION ALL SELECT *, 'misconfig', 'DEMO-LICENSE', unnest(regexp_extract_all(line, '(?i){DEMO_RULES[3]["pattern"]}')) FROM l
 UNION ALL SELECT *, 'secret', 'SECRET-HEX-TOKEN', regexp_extract(line, '(?i)token\\s*=\\s*["''][0-9a-f]{{40}}["'']') FROM l
 UNION ALL SELECT *, 'secret', 'SECRET-CARD-NUMBER', regexp_extract(line, '\\b[0-9]{{13,19}}\\b') FROM l)
SELECT source, bucket::INT AS bucket, category, rule_id, line_number::INT AS line_number,
  CASE category WHEN 'secret' THEN left(found, 4) || repeat('*', length(found) - 8) || right(found, 4) ELSE left(found, 200) END AS evidence FROM hits WHERE found <> ''""")
def large_file_scan(t: Inputs):
    """Texts joined into large files, read back as chunks of lines that are far smaller than a file."""
    path = new_path(t.spark)
    bucket = F.floor(c("doc_id") / 500).alias("bucket")
    texts = t.documents.filter("text is not null").select("source", bucket, "doc_id", "text")
    texts.repartition("source", "bucket").sortWithinPartitions("source", "bucket", "doc_id").drop("doc_id").write.partitionBy("source", "bucket").text(path)
    chunks = read_chunks(t.spark, path, above=0, chunk_bytes=50_000, margin=5)
    rules = demo_rules(t).filter("rule_id in ('DEMO-TOKEN', 'DEMO-IP', 'DEMO-LICENSE')")
    found = detect.scan_chunks(chunks, rules, rule_source.builtin_secret_patterns(t.spark))
    of = lambda name: F.regexp_extract("file_path", f"/{name}=([^/]*)/", 1)
    return found.select(of("source").alias("source"), of("bucket").cast("int").alias("bucket"), "category", "rule_id", "line_number", "evidence")


def stored_corpus(t: Inputs):
    """Files to stored findings with the demo rules: scan, score, deduplicate, map."""
    raw = detect.rule_scan(t.busy.v_files, demo_rules(t))
    return plan.stored_findings(raw)


_SEVERITY_SQL = "(VALUES " + ", ".join(
    f"('{r['id']}', '{r['name']}', '{' '.join(r.get('tags', []))}', "
    f"{ {'critical': 9.5, 'high': 7.5, 'medium': 5.0, 'low': 2.5, 'info': 0.5}[r['severity']] }::DOUBLE)"
    for r in DEMO_RULES
) + ") AS r(rule_id, title, tags, base)"


@query(MATCHES + f""", words AS (SELECT path, list(regexp_matches(lower(line), '{KEYWORDS}') ORDER BY line_number) AS hits FROM lines GROUP BY path),
one AS (SELECT DISTINCT scan_id, path, m.rule_id, line_number, left(evidence, 120) AS start, base,
   regexp_matches(lower(path || ' ' || evidence || ' ' || title || ' ' || tags), '{KEYWORDS}') OR list_contains(list_slice(hits, greatest(line_number - 2, 1), line_number + 2), true) AS banking
  FROM matches m JOIN {_SEVERITY_SQL} ON r.rule_id = m.rule_id JOIN words w USING (path)),
s AS (SELECT *, greatest(0, least(10, base + 2 * regexp_matches(path, '/(payments|auth|wallet)/')::INT + 2 * regexp_matches(path, '(?i)(prod|live|release|deploy)')::INT
   + 1.5::DOUBLE * banking::INT - regexp_matches(path, '/tests/')::INT - 0.5::DOUBLE * regexp_matches(path, '/examples/')::INT)) AS f FROM one)
SELECT scan_id, path AS file_path, rule_id, line_number::INT AS line_number, round(f, 1) AS final_score,
 CASE WHEN f >= 9 THEN 'critical' WHEN f >= 7 THEN 'high' WHEN f >= 4 THEN 'medium' WHEN f >= 1 THEN 'low' ELSE 'info' END AS severity FROM s""")
def corpus_findings(t: Inputs):
    return stored_corpus(t).select("scan_id", "file_path", "rule_id", "line_number", "final_score", "severity")
