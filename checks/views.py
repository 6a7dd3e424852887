"""The given tables seen as scans, findings, files and feeds.

The same text runs in Spark and in the SQL engine of the check.
"""

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]

VIEWS = {}

VIEWS["v_scans"] = r"""
SELECT CAST(o_orderkey AS STRING) AS scan_id,
       CASE o_custkey % 3
         WHEN 0 THEN 'https://git.example.org/org' || CAST(o_custkey % 50 AS STRING) || '/repo' || CAST(o_custkey AS STRING) || '.git'
         WHEN 1 THEN 'upload:archive' || CAST(o_custkey AS STRING) || '.zip'
         ELSE '/srv/code/app' || CAST(o_custkey AS STRING) END AS target,
       CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'full' WHEN '2-HIGH' THEN 'secrets'
            WHEN '5-LOW' THEN 'dependencies' ELSE 'misconfig' END AS scan_type,
       o_orderdate + (o_orderkey % 24) * INTERVAL '1' HOUR AS created_at
FROM orders
"""

VIEWS["v_findings"] = r"""
SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS finding_id,
       CAST(l_orderkey AS STRING) AS scan_id,
       CASE WHEN l_suppkey % 5 = 0 THEN 'CVE-' || CAST(2015 + l_partkey % 10 AS STRING) || '-' || lpad(CAST(l_partkey AS STRING), 5, '0')
            ELSE 'RULE-' || lpad(CAST(l_partkey % 17 AS STRING), 3, '0') END AS rule_id,
       CASE WHEN l_suppkey % 5 = 0 THEN 'cve-' || CAST(2015 + l_partkey % 10 AS STRING) || '-' || lpad(CAST(l_partkey AS STRING), 5, '0') || ': package' || CAST(l_partkey AS STRING)
            ELSE 'Rule ' || CAST(l_partkey % 17 AS STRING) END AS title,
       CASE l_suppkey % 5 WHEN 0 THEN 'cve' WHEN 1 THEN 'misconfig' WHEN 2 THEN 'secret' WHEN 3 THEN 'drift' ELSE 'sast' END AS category,
       CASE CAST(l_quantity AS INT) % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'info' END AS severity,
       CASE WHEN l_suppkey % 5 = 0 THEN l_quantity / CAST(5 AS DOUBLE) END AS cvss_score,
       CASE WHEN l_suppkey % 5 = 0 THEN 'CVE-' || CAST(2015 + l_partkey % 10 AS STRING) || '-' || lpad(CAST(l_partkey AS STRING), 5, '0') END AS cve_id,
       CASE CAST(l_partkey % 8 AS INT) WHEN 0 THEN '/srv/app/payments/' WHEN 1 THEN '/srv/app/tests/' WHEN 2 THEN '/srv/app/auth/'
            WHEN 3 THEN '/srv/app/examples/' WHEN 4 THEN '/srv/app/production/' WHEN 5 THEN '/srv/app/src/'
            WHEN 6 THEN '/srv/app/wallet/' ELSE '/srv/app/docs/' END || 'f' || CAST(l_partkey % 100 AS STRING)
         || CASE CAST(l_partkey % 5 AS INT) WHEN 0 THEN '.py' WHEN 1 THEN '.yml' WHEN 2 THEN '.json' WHEN 3 THEN '.conf' ELSE '.java' END AS file_path,
       l_linenumber AS line_number,
       CASE CAST(l_quantity AS INT) % 7 WHEN 0 THEN '' WHEN 1 THEN 'requires login' ELSE 'key = ' || CAST(l_partkey AS STRING) END AS evidence,
       l_returnflag = 'R' AS is_fixed,
       CASE WHEN l_linestatus = 'O' THEN true ELSE false END AS is_transitive,
       l_shipdate AS created_at
FROM lineitem
"""

VIEWS["v_kev"] = r"""
SELECT 'CVE-' || CAST(2015 + p_partkey % 10 AS STRING) || '-' || lpad(CAST(p_partkey AS STRING), 5, '0') AS cve_id,
       p_name AS product,
       CASE WHEN p_size % 2 = 0 THEN 'Exploited: ' || p_name END AS short_description
FROM part WHERE p_size >= 45
"""

VIEWS["v_epss"] = r"""
SELECT 'CVE-' || CAST(2015 + p_partkey % 10 AS STRING) || '-' || lpad(CAST(p_partkey AS STRING), 5, '0') AS cve_id,
       CAST((p_size - 1) / CAST(50 AS DOUBLE) AS DOUBLE) AS epss,
       CAST(p_size / CAST(50 AS DOUBLE) AS DOUBLE) AS percentile
FROM part WHERE p_partkey % 4 <> 3
"""

DOC_PATH = """'/srv/' || source || CASE CAST(doc_id % 8 AS INT) WHEN 0 THEN '/payments/' WHEN 1 THEN '/tests/' WHEN 2 THEN '/auth/'
            WHEN 3 THEN '/examples/' WHEN 4 THEN '/production/' WHEN 5 THEN '/node_modules/' WHEN 6 THEN '/wallet/' ELSE '/docs/' END
         || 'd' || CAST(doc_id AS STRING)
         || CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN '.py' WHEN 1 THEN '.yml' WHEN 2 THEN '.json' WHEN 3 THEN '.conf' ELSE '.md' END"""

VIEWS["v_files"] = f"""
SELECT source AS scan_id, {DOC_PATH} AS path, text AS content, n_chars AS size_bytes
FROM documents
"""

VIEWS["v_page_files"] = r"""
SELECT 'web' AS scan_id, url, '/web/nginx/' || CAST(page_id AS STRING) || '.conf' AS path, html AS content
FROM pages
"""

VIEWS["v_dependencies"] = r"""
SELECT DISTINCT l_partkey AS pkg_no, 'package' || CAST(l_partkey AS STRING) AS name,
       CASE CAST(l_partkey % 3 AS INT) WHEN 0 THEN 'npm' WHEN 1 THEN 'pypi' ELSE 'maven' END AS ecosystem,
       CAST(l_quantity AS INT) AS v_major, l_linenumber AS v_minor,
       CAST(CAST(l_quantity AS INT) AS STRING) || '.' || CAST(l_linenumber AS STRING) AS version
FROM lineitem
"""

VIEWS["v_advisories"] = r"""
SELECT 'OSV-' || CAST(p_partkey AS STRING) AS osv_id,
       'CVE-' || CAST(2015 + p_partkey % 10 AS STRING) || '-' || lpad(CAST(p_partkey AS STRING), 5, '0') AS cve_id,
       'package' || CAST(p_partkey AS STRING) AS name,
       CASE CAST(p_partkey % 3 AS INT) WHEN 0 THEN 'npm' WHEN 1 THEN 'pypi' ELSE 'maven' END AS ecosystem,
       CAST(p_size / 2 AS INT) AS introduced_major, p_size AS fixed_major
FROM part WHERE p_size % 2 = 0
"""

VIEWS["v_manifests"] = r"""
SELECT s_suppkey, '/srv/m' || CAST(s_suppkey AS STRING) || '/package.json' AS path,
       '{"dependencies":{"lib' || CAST(s_suppkey AS STRING) || '":"^' || CAST(s_nationkey AS STRING) || '.1.0"},"devDependencies":{"dev'
         || CAST(s_nationkey AS STRING) || '":">=2.' || CAST(s_suppkey % 10 AS STRING) || '"}}' AS content
FROM supplier
"""

VIEWS["v_progress"] = r"""
SELECT event_id, ts, CAST(user_id AS STRING) AS scan_id,
       CASE event_type WHEN 'signup' THEN 'status_change' WHEN 'view' THEN 'progress' WHEN 'click' THEN 'finding_discovered'
            WHEN 'purchase' THEN 'scan_complete' ELSE 'scan_failed' END AS type,
       CASE WHEN value > 100 THEN CAST(100 AS DOUBLE) ELSE value END AS percent
FROM events
"""

VIEWS["v_audit"] = r"""
SELECT CAST(c_custkey AS STRING) AS audit_id, 'Applied Auto-Fix: Rule ' || CAST(c_custkey % 17 AS STRING) AS action,
       c_name AS operator, CASE WHEN c_acctbal < 0 THEN 'warning' ELSE 'success' END AS status, c_mktsegment AS justification
FROM customer
"""


def _choices(column: str, values: list[str]) -> str:
    """One of the values by the remainder of a column."""
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE CAST({column} % {len(values)} AS INT) {whens} END"


SPELLINGS = ["CRITICAL", " crit ", "high", "H", "moderate", "Med", "medium", "low", "l", "info", "unknown_word"]
FOLDERS = [
    "", "src/", "node_modules/lib/", "config/", "build/out/", ".git/", "a.b/", "nginx/", "env/", "tests/unit/",
]
NAMES = [
    "Dockerfile", "Dockerfile.dev", "docker-compose.yml", "compose.yaml", "my-nginx.conf", "app.PY", ".env",
    "prod.env", "application.yml", "package.json", "package-lock.json", "requirements.txt",
    "requirements-dev.txt", "Pipfile.lock", "pom.xml", "setup.cfg", "logo.PNG", "archive.tar.gz", "Makefile",
    "noext", "x.yaml", "main.ts", "util.java", "a[1].json",
]

VIEWS["v_spellings"] = f"""
SELECT p_partkey AS id, CASE WHEN p_size % 9 <> 0 THEN {_choices('p_partkey', SPELLINGS)} END AS word,
       p_size / CAST(5 AS DOUBLE) AS score
FROM part
"""

VIEWS["v_paths"] = f"""
SELECT c_custkey AS id, '/srv/app' || CAST(c_nationkey AS STRING) AS root,
       {_choices('c_nationkey', FOLDERS)} || {_choices('c_custkey', NAMES)} AS relative_path,
       CASE WHEN c_acctbal > 9000 THEN 16000000 ELSE CAST(c_custkey AS INT) * 100 END AS size_bytes
FROM customer
"""

VIEWS["v_vectors"] = f"""
SELECT p_partkey AS id, 'CVSS:3.1/AV:' || {_choices('p_partkey', ['N', 'A', 'L', 'P'])}
       || '/AC:' || {_choices('p_size', ['L', 'H'])} || '/PR:' || {_choices('p_partkey', ['N', 'L', 'H'])}
       || '/UI:' || {_choices('p_size', ['N', 'R', 'R'])} || '/S:U/C:' || {_choices('p_size', ['H', 'L', 'N'])}
       || '/I:' || {_choices('p_partkey', ['N', 'H', 'L'])} || '/A:' || {_choices('p_size', ['L', 'N', 'H', 'N'])} AS vector
FROM part
"""

VIEWS["v_urls"] = f"""
SELECT c_custkey AS id,
       {_choices('c_custkey', ['https', 'http', 'HTTPS', 'ftp', 'https'])} || '://'
       || {_choices('c_nationkey', ['hooks', 'user:pw@api', 'svc'])} || CAST(c_custkey % 40 AS STRING) || '.example.org'
       || CASE WHEN c_custkey % 7 = 0 THEN ':8443' ELSE '' END
       || CASE c_custkey % 4 WHEN 0 THEN '/services/T' || CAST(c_custkey AS STRING) || '/B12/tok' || CAST(c_custkey * 7919 AS STRING)
                             WHEN 1 THEN '/services/T' WHEN 2 THEN '' ELSE '/hook?x=1' END AS url,
       {_choices('c_nationkey', ['hooks', 'api', 'svc'])} || CAST(c_custkey % 40 AS STRING) || '.example.org' AS host
FROM customer
"""

VIEWS["v_addresses"] = """
SELECT DISTINCT host, CASE c_nationkey
         WHEN 0 THEN '10.' WHEN 1 THEN '127.' WHEN 2 THEN '172.' WHEN 3 THEN '192.168.' WHEN 4 THEN '169.254.'
         WHEN 5 THEN '224.' ELSE CAST(10 + c_custkey % 180 AS STRING) || '.' END
       || CAST(c_custkey % 32 AS STRING) || CASE WHEN c_nationkey IN (3, 4) THEN '.' ELSE '.7.' END
       || CAST(c_custkey % 250 AS STRING) AS ip
FROM customer JOIN (SELECT id, host FROM v_urls) AS u ON u.id = c_custkey WHERE c_custkey % 3 > 0
"""

VIEWS["v_db_urls"] = """
SELECT c_custkey AS id, CASE c_custkey % 4
         WHEN 0 THEN 'postgresql://app:s3cret' || CAST(c_custkey AS STRING) || '@db.example.org:5432/x'
         WHEN 1 THEN 'mysql://app@db.example.org/x' WHEN 2 THEN 'redis://:p@ss@cache/0'
         ELSE 'sqlite:///data/' || c_name || '.db' END AS url
FROM customer
"""

VIEWS["v_targets"] = f"""
SELECT c_custkey AS id, 'https://git.example.org/org' || CAST(c_nationkey AS STRING) || '/repo'
       || CASE WHEN c_custkey % 5 = 0 THEN '.git' ELSE '' END
       || {_choices('c_custkey', ['/tree/', '/-/tree/', '/src/', ''])}
       || CASE WHEN c_custkey % 4 = 3 THEN '' ELSE {_choices('c_custkey', ['main', 'release/1.x', 'feature/login/deep/dir', 'main/src/app/', 'dev', 'release/1.x/docs', 'mainline/x'])} END AS target,
       CASE c_custkey % 11 WHEN 0 THEN 'main' WHEN 1 THEN 'release/1.x' END AS branch
FROM customer
"""

VIEWS["v_branches"] = " UNION ALL ".join(
    f"SELECT 'https://git.example.org/org' || CAST(n_nationkey AS STRING) || '/repo.git' AS repo_url, '{b}' AS branch"
    f" FROM nation WHERE n_nationkey % 3 <> {len(b) % 4}"
    for b in ["main", "release", "release/1.x", "feature/login"]
)

VIEWS["v_doc_findings"] = f"""
SELECT 'F' || CAST(doc_id AS STRING) AS finding_id, source AS scan_id, 'SECRET-001' AS rule_id, 'Token in text' AS title,
       CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN 'secret' WHEN 1 THEN 'misconfig' WHEN 2 THEN 'cve' ELSE 'sast' END AS category,
       'high' AS severity, {DOC_PATH} AS file_path, CAST(doc_id % 23 AS INT) AS line_number,
       CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN '' WHEN 1 THEN 'requires login' WHEN 2 THEN ' requires login '
            ELSE 'seen ' || CAST(doc_id AS STRING) END AS evidence, doc_id % 6 = 0 AS is_fixed,
       CASE WHEN doc_id % 4 = 2 THEN 'CVE-2020-' || lpad(CAST(doc_id AS STRING), 5, '0') END AS cve_id
FROM documents
"""

VIEWS["v_requirement_files"] = """
SELECT s_suppkey AS id, CAST(s_nationkey AS STRING) AS scan_id,
       '/srv/m' || CAST(s_suppkey AS STRING) || CASE s_suppkey % 3 WHEN 0 THEN '/requirements.txt'
         WHEN 1 THEN '/requirements-dev.txt' ELSE '/requirements-test.txt' END AS path,
       '# pinned' || chr(10) || 'Lib' || CAST(s_suppkey AS STRING) || '[extra,more]==1.' || CAST(s_nationkey AS STRING)
         || '  # why' || chr(10) || '-r base.txt' || chr(10) || '--index-url https://x' || chr(10) || chr(10)
         || 'tool_' || CAST(s_nationkey AS STRING) || ' >= 2.' || CAST(s_suppkey % 7 AS STRING) || ', <3 ; python_version > "3"'
         || chr(13) || chr(10) || '  Plain-' || CAST(s_suppkey AS STRING) || '  ' || chr(10) || 'near~=0.' || CAST(s_suppkey % 5 AS STRING) AS content
FROM supplier
"""

VIEWS["v_pipfiles"] = """
SELECT s_suppkey AS id, CAST(s_nationkey AS STRING) AS scan_id, '/srv/m' || CAST(s_suppkey AS STRING) || '/Pipfile.lock' AS path,
       '{"default":{"Lib' || CAST(s_suppkey AS STRING) || '":{"version":"==1.' || CAST(s_nationkey AS STRING)
         || '"},"bare":{}},"develop":{"Dev' || CAST(s_nationkey AS STRING) || '":{"version":"2.0","hashes":["a"]}}}' AS content
FROM supplier
"""

VIEWS["v_lockfiles"] = """
SELECT s_suppkey AS id, CAST(s_nationkey AS STRING) AS scan_id, '/srv/m' || CAST(s_suppkey AS STRING) || '/package-lock.json' AS path,
       CASE WHEN s_suppkey % 2 = 0 THEN '{"lockfileVersion":3,"packages":{"":{"name":"root"},"node_modules/a' || CAST(s_suppkey AS STRING)
         || '":{"version":"1.' || CAST(s_nationkey AS STRING) || '.0","dev":true},"node_modules/a/node_modules/b":{}}}'
       ELSE '{"lockfileVersion":1,"dependencies":{"a' || CAST(s_suppkey AS STRING) || '":{"version":"1.' || CAST(s_nationkey AS STRING)
         || '.0","dev":true,"dependencies":{"b":{"dependencies":{"c":{"version":"3.0.0"}}}}}}}' END AS content
FROM supplier
"""

VIEWS["v_poms"] = """
SELECT s_suppkey AS id, CAST(s_nationkey AS STRING) AS scan_id, '/srv/m' || CAST(s_suppkey AS STRING) || '/pom.xml' AS path,
       '<project xmlns="http://maven.apache.org/POM/4.0.0"><properties><lib.version>1.' || CAST(s_nationkey AS STRING)
       || '</lib.version></properties><dependencies><dependency><groupId>org.g' || CAST(s_nationkey AS STRING)
       || '</groupId><artifactId>lib' || CAST(s_suppkey AS STRING) || '</artifactId><version>' || chr(36) || '{lib.version}</version></dependency>'
       || '<dependency><artifactId>t</artifactId><version>' || chr(36) || '{missing}</version><scope>test</scope></dependency></dependencies>'
       || '<dependencyManagement><dependencies><dependency><groupId>m</groupId><artifactId>bom</artifactId></dependency></dependencies>'
       || '</dependencyManagement></project>' AS content
FROM supplier
"""

VIEWS["v_include_files"] = """
SELECT CAST(s_nationkey AS STRING) AS scan_id, s_suppkey AS id,
       '/srv/p' || CAST(s_nationkey AS STRING) || '/deps/r' || CAST(s_suppkey AS STRING) || '.txt' AS path,
       'a==1' || chr(10) || '-r ../deps/./r' || CAST((s_suppkey * 7) % 100 AS STRING) || '.txt' || chr(10)
       || '--requirement r' || CAST(s_suppkey + 25 AS STRING) || '.txt' AS content
FROM supplier
"""

VIEWS["v_osv_documents"] = """
SELECT p_partkey AS id, '{"id":"OSV-' || CAST(p_partkey AS STRING) || '","aliases":["GHSA-' || CAST(p_size AS STRING)
       || CASE WHEN p_size % 3 = 0 THEN '"' ELSE '","CVE-' || CAST(2015 + p_partkey % 10 AS STRING) || '-' || lpad(CAST(p_partkey AS STRING), 5, '0') || '"' END
       || '],' || CASE p_size % 4 WHEN 0 THEN '"severity":[{"type":"CVSS_V3","score":"CVSS:3.1/AV:N/AC:L/PR:N/UI:N/C:H/I:L/A:N"}],'
                        WHEN 1 THEN '"severity":[{"type":"CVSS_V2","score":"x"}],'
                        WHEN 2 THEN '"database_specific":{"severity":"HIGH"},' ELSE '' END
       || CASE WHEN p_size % 5 = 0 THEN '' WHEN p_size % 5 = 1 THEN '"details":"long ' || p_name || '",' ELSE '"summary":"' || p_name || '",' END
       || '"affected":[{"package":{"ecosystem":"PyPI","name":"package' || CAST(p_partkey AS STRING)
       || '"},"ranges":[{"events":[{"introduced":"' || CAST(p_size % 2 AS STRING) || '"},{"fixed":"' || CAST(p_size AS STRING) || '.1"}]}],"versions":["0.1","0.2"]}],'
       || '"references":[{"url":"https://x/' || CAST(p_partkey AS STRING) || '"},{"type":"WEB"}]}' AS document
FROM part
"""

VIEWS["v_semgrep_documents"] = """
SELECT scan_id, finding_id, '{"results":[{"check_id":"' || rule_id || '","path":"' || file_path || '","start":{"line":' || CAST(line_number AS STRING)
       || '},"extra":{"message":"' || title || '","severity":"' || CASE severity WHEN 'critical' THEN 'ERROR' WHEN 'high' THEN 'warning' ELSE 'INFO' END
       || '","lines":"' || evidence || '","metadata":{' || CASE WHEN line_number % 2 = 0 THEN '"fix":"use ' || category || '"' ELSE '"source-url":"https://r/' || rule_id || '"' END
       || '}}}]}' AS document
FROM v_findings
"""

VIEWS["v_bandit_documents"] = """
SELECT scan_id, finding_id, '{"results":[{"test_id":"' || rule_id || '","test_name":"' || title || '","issue_text":"about ' || title
       || '","issue_severity":"' || CASE severity WHEN 'critical' THEN 'HIGH' WHEN 'high' THEN 'medium' ELSE 'LOW' END || '","filename":"' || file_path
       || '","line_number":' || CAST(line_number AS STRING) || ',"code":"' || evidence || '","more_info":"https://b/' || rule_id || '"'
       || CASE WHEN line_number % 2 = 0 THEN ',"issue_cwe":{"id":' || CAST(line_number * 10 AS STRING) || '}' ELSE '' END || '}]}' AS document
FROM v_findings
"""

VIEWS["v_commits"] = """
SELECT source AS repo, doc_id, lpad(CAST(doc_id AS STRING), 40, '0') AS hash, lpad(CAST(doc_id AS STRING), 7, '0') AS short_hash,
       'dev' || CAST(doc_id % 9 AS STRING) AS author, '2024-01-01' AS date, 'add ' || source AS message, source AS path, text
FROM documents
"""

VIEWS["v_git_records"] = """
SELECT repo, doc_id, hash || '|' || short_hash || '|' || author || '|' || date || '|' || message || ' | more' || chr(10) || chr(10)
       || 'diff --git a/' || path || ' b/' || path || '/f' || CAST(doc_id AS STRING) || '.txt' || chr(10) || 'new file mode 100644' || chr(10)
       || '--- /dev/null' || chr(10) || '+++ b/' || path || chr(10) || '@@ -0,0 +' || CAST(1 + doc_id % 50 AS STRING) || ',9 @@' || chr(10)
       || '+' || replace(text, chr(10), chr(10) || '+') || chr(10) || '-gone' || chr(10) || ' kept' || chr(10) || '+tail line' || chr(10)
       || 'diff --git a/bin b/logo.png' || chr(10) || 'Binary files differ' AS record
FROM v_commits
"""

VIEWS["v_dockerfiles"] = """
SELECT CAST(c_nationkey AS STRING) AS scan_id, c_custkey AS id, '/srv/c' || CAST(c_custkey AS STRING) || '/Dockerfile' AS path,
       '# image' || chr(10) || 'from base:' || CASE WHEN c_custkey % 3 = 0 THEN 'latest' ELSE CAST(c_custkey AS STRING) END || chr(10)
       || 'RUN apt-get install ' || chr(92) || chr(10) || '   # note' || chr(10) || '   pkg' || CAST(c_nationkey AS STRING) || ' ' || chr(92) || chr(10)
       || chr(10) || '   other' || chr(10) || CASE WHEN c_custkey % 2 = 0 THEN '  USER app' || chr(10) ELSE '' END || 'HEALTHCHECK  CMD true' AS content
FROM customer
"""

VIEWS["v_nginx_files"] = """
SELECT CAST(c_nationkey AS STRING) AS scan_id, c_custkey AS id, '/etc/nginx/s' || CAST(c_custkey AS STRING) || '.conf' AS path,
       'user www;' || chr(10) || 'http {' || chr(10) || '  # c' || chr(10) || '  server {' || chr(10) || '    listen ' || CAST(c_custkey AS STRING)
       || ';' || chr(10) || '    location / {' || chr(10) || '      root  /x y;' || chr(10) || '    }' || chr(10) || '  }' || chr(10)
       || CASE WHEN c_custkey % 2 = 0 THEN '  server_tokens off;' || chr(10) ELSE '' END || '}' || chr(10) || 'done;' AS content
FROM customer
"""

VIEWS["v_found_events"] = """
SELECT event_id, ts, scan_id, type, percent,
       CASE WHEN percent < 10 THEN 'critical' WHEN percent < 20 THEN 'high' WHEN percent < 40 THEN 'medium' ELSE 'info' END AS severity
FROM v_progress
"""

VIEWS["v_counted_scans"] = """
SELECT scan_id, status, created_at, CAST(length(target) % 5 AS INT) AS critical_count, CAST(length(target) % 7 AS INT) AS high_count,
       CAST(length(scan_id) AS INT) AS medium_count, CAST(length(scan_type) AS INT) AS low_count
FROM v_scans
"""

# One scan for each source; its number says which type it is.
VIEWS["v_scan_types"] = """
SELECT scan_id, CASE CAST(substr(scan_id, 4) AS INT) % 10 WHEN 0 THEN 'secrets' WHEN 1 THEN 'misconfig' WHEN 2 THEN 'dependencies' WHEN 3 THEN 'drift'
       WHEN 4 THEN 'sast' WHEN 5 THEN 'git-history' WHEN 6 THEN 'everything' ELSE 'full' END AS scan_type
FROM (SELECT DISTINCT source AS scan_id FROM documents) AS s
"""

VIEWS["v_scan_manifests"] = """
SELECT 'src' || CAST(p_partkey % 20 AS STRING) AS scan_id, p_partkey AS id,
       '/srv/src' || CAST(p_partkey % 20 AS STRING) || CASE WHEN p_size % 4 = 0 THEN '/node_modules/m' ELSE '/m' END || CAST(p_partkey AS STRING)
         || CASE WHEN p_size % 5 = 0 THEN '/package.json' ELSE '/requirements.txt' END AS path,
       CASE WHEN p_size % 10 = 0 THEN '{"dependencies":' WHEN p_size % 5 = 0 THEN '{"dependencies":{"package' || CAST(p_partkey AS STRING) || '":"0.1"}}'
            ELSE 'package' || CAST(p_partkey AS STRING) || '==0.1' || chr(10) || 'unaffected==0.1' END AS content
FROM part
"""

VIEWS["v_scan_reports"] = """
SELECT source AS scan_id, doc_id, CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN 'bandit' WHEN 1 THEN 'other' ELSE 'semgrep' END AS tool,
       CASE WHEN doc_id % 12 = 2 THEN '{"results":[{' WHEN doc_id % 12 = 6 THEN '{"errors":[]}'
            ELSE '{"results":[{"check_id":"C' || CAST(doc_id % 7 AS STRING) || '","path":"a' || CAST(doc_id AS STRING) || '.py","start":{"line":'
              || CAST(doc_id % 90 AS STRING) || '},"extra":{"message":"m","severity":"ERROR"}},{"test_id":"B' || CAST(doc_id % 7 AS STRING) || '","filename":"b'
              || CAST(doc_id AS STRING) || '.py","line_number":' || CAST(doc_id % 80 AS STRING) || ',"issue_severity":"HIGH"}]}' END AS document
FROM documents
"""

VIEWS["v_scan_dockerfiles"] = """
SELECT 'src' || CAST(c_custkey % 20 AS STRING) AS scan_id, c_custkey AS id, '/srv/c' || CAST(c_custkey AS STRING) || '/Dockerfile' AS path, content
FROM v_dockerfiles JOIN customer ON c_custkey = id
"""

# One finding per category, so that sums over all findings stay below their limits at any size.
VIEWS["v_few_findings"] = """
SELECT category, CASE CAST(count(*) % 5 AS INT) WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'info' END AS severity
FROM v_findings GROUP BY category
"""

VIEWS["v_dated_audit"] = """
SELECT audit_id, action, operator, status, justification, TIMESTAMP '2024-01-01 00:00:00' + (c_custkey % 5000) * INTERVAL '1' HOUR AS timestamp
FROM v_audit JOIN customer ON CAST(c_custkey AS STRING) = audit_id
"""

# Lines that the shipped rules are about, and some that they are not.
VIEWS["v_rule_lines"] = """
SELECT 'scan' || CAST(s_nationkey AS STRING) AS scan_id, s_suppkey AS id, '/srv/r' || CAST(s_suppkey AS STRING)
         || CASE s_suppkey % 3 WHEN 0 THEN '/settings.yml' WHEN 1 THEN '/Dockerfile' ELSE '/notes.txt' END AS path,
       'FROM base' || CAST(s_suppkey AS STRING) || chr(10) || 'cvv = ' || CAST(100 + s_suppkey % 800 AS STRING) || chr(10) || 'cvvx = 12' || chr(10) || 'session_timeout: ' || CAST(s_suppkey * 40 AS STRING)
         || chr(10) || 'bind_address = 0.0.0.0' || chr(10) || 'Password = "admin"' || chr(10) || 'password = other' || chr(10) || 'api-key: "abcdefgh-' || lpad(CAST(s_suppkey AS STRING), 9, '0') || '"'
         || chr(10) || 'db_pwd = ' || chr(39) || 'p-' || CAST(s_suppkey AS STRING) || 'xx' || chr(39) || chr(10) || 'Access-Control-Allow-Origin: *' || chr(10) || 'DEBUG=on' || chr(10) || 'debug = off' AS content
FROM supplier
"""

VIEWS["v_odd_manifests"] = """
SELECT CAST(s_nationkey AS STRING) AS scan_id, s_suppkey AS id, '/srv/o' || CAST(s_suppkey AS STRING)
         || CASE s_suppkey % 4 WHEN 0 THEN '/package-lock.json' WHEN 1 THEN '/Pipfile.lock' WHEN 2 THEN '/package.json' ELSE '/pom.xml' END AS path,
       CASE s_suppkey % 4
         WHEN 0 THEN '{"lockfileVersion":3,"packages":{"":{},"node_modules/good":{"version":"1.' || CAST(s_suppkey AS STRING) || '"},"node_modules/odd":"text"}}'
         WHEN 1 THEN '{"default":{"good":{"version":"==2.' || CAST(s_suppkey AS STRING) || '"},"odd":"*"},"develop":[1]}'
         WHEN 2 THEN CASE WHEN s_suppkey % 8 = 2 THEN '{"dependencies":' ELSE '["no object"]' END
         ELSE CASE WHEN s_suppkey % 8 = 3 THEN '<project><dependencies>' ELSE '<project/>' END END AS content
FROM supplier
"""
