"""Expressions over file paths and scan targets."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.functions.base import strip

# What counts as a configuration file.
CONFIG_SUFFIXES = [
    ".yml", ".yaml", ".json", ".xml", ".properties", ".ini", ".cfg", ".conf", ".toml", ".env",
]
CONFIG_NAMES = [
    "Dockerfile", "docker-compose.yml", "docker-compose.yaml", ".dockerignore", ".eslintrc",
    ".babelrc", "nginx.conf", "httpd.conf", "my.cnf", "pg_hba.conf", "redis.conf",
    "application.properties", "application.yml", "web.xml", "pom.xml", "build.gradle", "Makefile",
    "Vagrantfile", "Procfile", ".htaccess", "supervisord.conf",
]
# Manifests that discovery looks for, and the parser of each known name.
MANIFEST_NAMES = ["package.json", "requirements.txt", "pom.xml", "Pipfile.lock"]
MANIFEST_KINDS = {
    "package.json": "npm_manifest",
    "package-lock.json": "npm_lock",
    "requirements.txt": "requirements",
    "Pipfile.lock": "pipfile_lock",
    "pom.xml": "maven_pom",
}
# Folders that are skipped, one set per job. The scanner's own cache folder is CACHE_DIR.
CACHE_DIR = ".scan_cache"
EXCLUDED_DIRS = {
    "config": [".git", "node_modules", "__pycache__", ".venv", "venv", ".tox", ".eggs"],
    "manifest": [
        ".git", "node_modules", "__pycache__", ".venv", "venv", "dist", "build",
        "vulnerable-test-target",
    ],
    "upload": [
        "node_modules", ".git", ".venv", "venv", "env", "__pycache__", "dist", "build", ".next",
        ".nuxt", ".cache", CACHE_DIR, ".pytest_cache", ".idea", ".vscode",
    ],
}
UPLOAD_EXCLUDED_SUFFIXES = [
    ".exe", ".dll", ".so", ".dylib", ".bin", ".iso", ".dmg", ".zip", ".tar", ".gz", ".rar", ".7z",
    ".png", ".jpg", ".jpeg", ".gif", ".mp4", ".mp3", ".wav", ".mov", ".avi", ".woff", ".woff2",
    ".ttf", ".eot", ".pyc", ".pyo",
]
UPLOAD_MAX_BYTES = 15 * 1024 * 1024
COMPOSE_NAMES = ["docker-compose.yml", "docker-compose.yaml", "compose.yml", "compose.yaml"]
SPRING_NAMES = ["application.properties", "application.yml", "application.yaml"]


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """Last suffix in lower case; a bare dot file such as `.env` has none."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1))


def has_excluded_dir(relative_path: Column, which: str) -> Column:
    """True if a part of the path (relative to the scan root) is in the named set."""
    parts = F.split(F.replace(relative_path, F.lit("\\"), F.lit("/")), "/")
    return F.arrays_overlap(parts, F.array(*[F.lit(d) for d in EXCLUDED_DIRS[which]]))


def is_uploadable(relative_path: Column, size: Column) -> Column:
    """Not in a skipped folder, not a binary by its extension, not above 15 MiB."""
    slashed = F.replace(relative_path, F.lit("\\"), F.lit("/"))
    ext = F.concat(F.lit("."), F.lower(F.substring_index(base_name(slashed), ".", -1)))
    return (
        ~has_excluded_dir(relative_path, "upload")
        & ~ext.isin(UPLOAD_EXCLUDED_SUFFIXES)
        & (size <= UPLOAD_MAX_BYTES)
    )


def is_config_file(path: Column) -> Column:
    return suffix(path).isin(CONFIG_SUFFIXES) | base_name(path).isin(CONFIG_NAMES)


def is_manifest(path: Column) -> Column:
    return base_name(path).isin(MANIFEST_NAMES)


def manifest_kind(path: Column) -> Column:
    """Name of the operator that reads this manifest, or `unsupported`."""
    name = base_name(path)
    expr = None
    for file_name, kind in MANIFEST_KINDS.items():
        cond = name == file_name
        expr = F.when(cond, kind) if expr is None else expr.when(cond, kind)
    return expr.when(name.startswith("requirements") & name.endswith(".txt"), "requirements").otherwise(
        "unsupported"
    )


def glob_regex(glob: str) -> str:
    """Regular expression of a shell glob in which `*` also crosses `/`."""
    out, i = "", 0
    while i < len(glob):
        ch = glob[i]
        close = glob.find("]", i + 2) if ch == "[" else -1
        if ch == "*":
            out += ".*"
        elif ch == "?":
            out += "."
        elif close > 0:
            body = glob[i + 1 : close]
            negated, body = body.startswith("!"), body.removeprefix("!")
            out += ("[^" if negated else "[") + re.sub(r"([\\\[\]&^])", r"\\\1", body) + "]"
            i = close
        else:
            out += "\\" + ch if not (ch.isalnum() or ch in "_/ ") else ch
        i += 1
    return out


def glob_match(path: Column, globs: list[str]) -> Column:
    """True if a glob fits the base name or the whole path; no globs or `*` fit everything."""
    if not globs or globs == ["*"]:
        return F.lit(True)
    pattern = "(?s)^(?:" + "|".join(glob_regex(g) for g in globs) + ")$"
    return base_name(path).rlike(pattern) | path.rlike(pattern)


def config_type(path: Column) -> Column:
    """Which baseline a file belongs to, or null."""
    name = F.lower(base_name(path))
    return (
        F.when((name == "dockerfile") | name.startswith("dockerfile."), "Dockerfile")
        .when(name.isin(COMPOSE_NAMES), "docker-compose")
        .when(name.contains("nginx") & name.endswith(".conf"), "nginx")
        .when(name.isin(SPRING_NAMES), "spring")
        .when(F.lower(path).contains("nginx"), "nginx")
    )


def clean_path(path: Column, root: Column) -> Column:
    """Path relative to the scan root (a folder; pass the parent if a single file was scanned)."""
    rest = F.regexp_replace(F.substr(path, F.length(root) + 1), r"^[\\/]+", "")
    return (
        F.when(F.coalesce(path, F.lit("")) == "", "")
        .when((path == root) & path.startswith("/"), ".")
        .when(F.startswith(path, root), rest)
        .otherwise(path)
    )


def display_path(path: Column, cache_dir: str = CACHE_DIR) -> Column:
    """Path for people: slashes, without cache, clone and server prefixes."""
    cache = cache_dir.replace(".", "\\.")
    p = F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/"))
    p = F.regexp_replace(p, r"^(?:.*/)?vulnerable-test-target/", "")
    p = F.regexp_replace(p, rf"^{cache}/clones/[^/]+/", "")
    p = F.regexp_replace(p, r"(?i)^/?(?:app|tmp|var|root)/", "")
    return F.regexp_replace(p, r"^\./", "")


def _is_url(raw: Column) -> Column:
    return raw.startswith("http://") | raw.startswith("https://")


def target_badge(target: Column) -> Column:
    """Kind of a scan target."""
    raw = strip(F.coalesce(target, F.lit("")))
    return F.when(_is_url(raw), "GitHub").when(raw.startswith("upload:"), "Archive").otherwise("Local")


def target_label(target: Column) -> Column:
    """Short name of a scan target: last two parts of a URL, archive name, or last folder."""
    raw = strip(F.coalesce(target, F.lit("")))
    bare = F.regexp_replace(raw, r"\.git$", "")
    folder = F.substring_index(F.replace(raw, F.lit("\\"), F.lit("/")), "/", -1)
    return (
        F.when(_is_url(raw), F.substring_index(bare, "/", -2))
        .when(raw.startswith("upload:"), F.substr(raw, F.lit(8)))
        .otherwise(F.when(folder == "", raw).otherwise(folder))
    )
