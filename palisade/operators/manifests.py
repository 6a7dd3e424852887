"""Packages named by manifests: one row per declared package.

All operators take files (scan_id, path, content) and give `DEPENDENCY_COLUMNS`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions import base_name, clean_npm_version, has_excluded_dir, manifest_kind
from palisade.functions.base import strip, text_after, text_before
from palisade.session import cut_lineage

DEPENDENCY_COLUMNS = [
    "scan_id", "path", "name", "version", "ecosystem", "is_dev", "is_transitive", "group_id", "scope", "managed",
]
# Options of requirement lines that name no package, and operators in the order tried.
SKIPPED_OPTIONS = ["-e ", "-i ", "--index-url", "--extra-index-url", "-f ", "--find-links"]
INCLUDE_OPTIONS = ["-r ", "--requirement "]
VERSION_OPERATORS = ["~=", "==", "!=", "<=", ">=", "<", ">"]
NO_VERSION = "0.0.0"
# Levels of a nested lock file that are read in one round.
LEVELS = 32


def _dependency(rows: DataFrame, ecosystem: str, **values: Column) -> DataFrame:
    defaults = {
        "is_dev": F.lit(False),
        "is_transitive": F.lit(False),
        "group_id": F.lit(None).cast("string"),
        "scope": F.lit(None).cast("string"),
        "managed": F.lit(False),
    }
    columns = {**defaults, **values, "ecosystem": F.lit(ecosystem)}
    return rows.select("scan_id", "path", *[columns[c].alias(c) for c in DEPENDENCY_COLUMNS[2:]])


def npm_manifest(files: DataFrame) -> DataFrame:
    """package.json: both dependency sections."""
    doc = F.from_json("content", "dependencies map<string,string>, devDependencies map<string,string>")
    section = lambda name, dev: F.transform(
        F.coalesce(F.map_entries(f"_doc.{name}"), F.array().cast("array<struct<key:string,value:string>>")),
        lambda e: F.struct(e["key"].alias("name"), e["value"].alias("spec"), F.lit(dev).alias("dev")),
    )
    rows = files.select("scan_id", "path", doc.alias("_doc")).select(
        "scan_id",
        "path",
        F.inline(F.concat(section("dependencies", False), section("devDependencies", True))).alias(
            "name", "spec", "dev"
        ),
    )
    return _dependency(
        rows, "npm", name=F.col("name"), version=clean_npm_version(F.col("spec")), is_dev=F.col("dev")
    )


def _object(value: Column, place: str = "$") -> Column:
    """The entries of an object within a VARIANT, null if there is none."""
    return F.try_variant_get(value, place, "map<string,variant>")


def _entries(rows: DataFrame, section: Column) -> DataFrame:
    """scan_id, path, name, info for each entry of a section."""
    return rows.select("scan_id", "path", F.explode(section).alias("name", "info"))


def _is_object(value: Column) -> Column:
    return _object(value).isNotNull()


def lock_entries(files: DataFrame) -> DataFrame:
    """Entries of package-lock.json files: scan_id, path, place, name, info, nested. `info` is what the file holds there,
    an object or not.

    Version 2 and 3 list packages by place. The tree of version 1 may nest to any depth: each round reads some levels
    more, for the files that have them.
    """
    docs = files.select("scan_id", "path", F.try_parse_json("content").alias("_doc"))
    version = F.coalesce(F.try_variant_get("_doc", "$.lockfileVersion", "int"), F.lit(1))
    is_flat = (version >= 2) & _object(F.col("_doc"), "$.packages").isNotNull()
    columns = ["scan_id", "path", "place", "name", "info", "nested"]
    listed = _entries(docs.filter(is_flat), _object(F.col("_doc"), "$.packages")).filter("name <> ''")
    parts = F.split("name", "node_modules/")
    found = listed.withColumns({"place": F.col("name"), "name": F.element_at(parts, -1), "nested": F.size(parts) > 2}).select(columns)
    level = docs.filter(~is_flat).select("scan_id", "path", _below(_object(F.col("_doc"), "$.dependencies")).alias("_level"))
    while True:
        # a fold over the tree of one file reads LEVELS levels; `_level` is what lies below them
        steps = F.aggregate(
            F.sequence(F.lit(1), F.lit(LEVELS)),
            F.struct(F.expr("slice(_level, 1, 0)").alias("seen"), F.col("_level").alias("level")),
            lambda acc, _: F.struct(
                F.concat(acc["seen"], acc["level"]).alias("seen"),
                F.flatten(F.transform(acc["level"], lambda e: _below(_object(e["info"], "$.dependencies"), e["place"]))).alias("level"),
            ),
        )
        walked = cut_lineage(level.filter(F.size("_level") > 0).select("scan_id", "path", steps.alias("_steps")))
        if walked.isEmpty():
            return found
        found = found.unionByName(walked.select("scan_id", "path", F.inline("_steps.seen")).select(columns))
        level = walked.select("scan_id", "path", F.col("_steps.level").alias("_level"))


def _below(entries: Column, place: Column | None = None) -> Column:
    """Entries as an array of place, name, info, nested; those within another one have its place in front."""
    of = lambda e: e["key"] if place is None else F.concat(place, F.lit("/"), e["key"])
    rows = F.transform(
        F.map_entries(entries),
        lambda e: F.struct(of(e).alias("place"), e["key"].alias("name"), e["value"].alias("info"), F.lit(place is not None).alias("nested")),
    )
    return F.coalesce(rows, F.array()).cast("array<struct<place:string,name:string,info:variant,nested:boolean>>")


def npm_lock(files: DataFrame) -> DataFrame:
    """package-lock.json: flat `packages` of version 2 and 3, nested tree of version 1. An entry that is no object is left
    out and listed by `odd_entries`."""
    return _dependency(
        lock_entries(files).filter(_is_object(F.col("info"))),
        "npm",
        name=F.col("name"),
        version=F.coalesce(F.try_variant_get("info", "$.version", "string"), F.lit(NO_VERSION)),
        is_dev=F.coalesce(F.try_variant_get("info", "$.dev", "boolean"), F.lit(False)),
        is_transitive=F.col("nested"),
    )


def _starts_with_any(c: Column, heads: list[str]) -> Column:
    hit = F.lit(False)
    for head in heads:
        hit = hit | c.startswith(head)
    return hit


def _requirement_lines(files: DataFrame) -> DataFrame:
    """Lines that say something: scan_id, path, line_no, line (no comments).

    Lines are cleaned before they are unfolded: what is computed behind would be computed again wherever it is named.
    """
    cleaned = F.transform(F.split("content", "\r\n|\n|\r"), lambda raw: strip(text_before(strip(raw), " #")))
    return (
        files.select("scan_id", "path", F.posexplode(cleaned).alias("_i", "line"))
        .filter((F.col("line") != "") & ~F.col("line").startswith("#"))
        .select("scan_id", "path", (F.col("_i") + 1).alias("line_no"), "line")
    )


def requirements(files: DataFrame) -> DataFrame:
    """Requirement files: one row per line that names a package. Includes: `requirements_includes`."""
    rows = _requirement_lines(files).filter(
        ~_starts_with_any(F.col("line"), INCLUDE_OPTIONS + SKIPPED_OPTIONS)
    )
    bare = strip(text_before(F.col("line"), ";"))
    spec = F.regexp_replace(bare, r"^([a-zA-Z0-9_.-]+)\[.*?\]", "$1")

    def parts(spec: Column) -> Column:
        name, version = F.when(F.lit(False), ""), F.when(F.lit(False), "")
        for op in VERSION_OPERATORS:
            name = name.when(spec.contains(op), text_before(spec, op))
            version = version.when(spec.contains(op), strip(text_before(strip(text_after(spec, op)), ",")))
        return F.struct(F.lower(strip(name.otherwise(spec))).alias("name"), version.otherwise(NO_VERSION).alias("version"))

    # unfolded, so that a line is taken apart once
    rows = rows.select("scan_id", "path", F.inline(F.transform(F.array(spec), parts))).filter("name <> ''")
    file_name = F.lower(base_name(F.col("path")))
    return _dependency(
        rows,
        "pypi",
        name=F.col("name"),
        version=F.col("version"),
        is_dev=file_name.contains("dev") | file_name.contains("test"),
    )


def resolve_path(folder: Column, relative: Column) -> Column:
    """Path of `relative` seen from `folder`, without `.` and `..` parts."""
    joined = F.when(relative.startswith("/"), relative).otherwise(F.concat(folder, F.lit("/"), relative))
    parts = F.filter(F.split(joined, "/"), lambda p: (p != "") & (p != "."))
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(
            p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        ).otherwise(F.concat(acc, F.array(p))),
    )
    return F.concat(F.when(joined.startswith("/"), "/").otherwise(""), F.array_join(kept, "/"))


def include_edges(files: DataFrame) -> DataFrame:
    """Which requirement file names which: scan_id, path, included."""
    folder = F.regexp_replace("path", "/[^/]*$", "")
    rows = _requirement_lines(files).filter(_starts_with_any(F.col("line"), INCLUDE_OPTIONS))
    target = strip(F.regexp_replace("line", r"^\S+\s+", ""))
    return rows.select("scan_id", "path", resolve_path(folder, target).alias("included")).distinct()


def requirements_includes(files: DataFrame, roots: DataFrame) -> DataFrame:
    """Files reached from the root files over includes, each once: scan_id, root, path.

    One join per level of inclusion, on the newly found files only; a circle ends as it finds nothing new.
    """
    edges = include_edges(files).withColumnRenamed("path", "from_path")
    known = files.select("scan_id", F.col("path").alias("included"))
    edges = edges.join(known, ["scan_id", "included"], "left_semi")
    reached = roots.select("scan_id", F.col("path").alias("root"), "path").distinct()
    frontier = reached
    while True:
        nxt = (
            frontier.withColumnRenamed("path", "from_path")
            .join(edges, ["scan_id", "from_path"])
            .select("scan_id", "root", F.col("included").alias("path"))
            .distinct()
            .join(reached, ["scan_id", "root", "path"], "left_anti")
        )
        frontier = cut_lineage(nxt)
        if frontier.isEmpty():
            return reached
        reached = reached.unionByName(frontier)


def included_requirements(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """Requirement files that `manifests` include, directly or over others, which are not among them: scan_id, path,
    content. Each level reads only the files that the level before names."""
    seen, level, found = manifests.select("scan_id", "path"), manifests, None
    while True:
        named = cut_lineage(include_edges(level).select("scan_id", F.col("included").alias("path")).distinct().join(seen, ["scan_id", "path"], "left_anti"))
        if named.isEmpty():  # without includes the files are not read again
            return level.limit(0) if found is None else found
        level = cut_lineage(files.select("scan_id", "path", "content").join(named, ["scan_id", "path"], "left_semi"))
        if level.isEmpty():
            return level if found is None else found
        found = level if found is None else found.unionByName(level)
        seen = seen.unionByName(level.select("scan_id", "path"))


def pipfile_entries(files: DataFrame) -> DataFrame:
    """Entries of Pipfile.lock files: scan_id, path, place, name, info, is_dev."""
    docs = files.select("scan_id", "path", F.try_parse_json("content").alias("_doc"))
    sections = [
        _entries(docs, _object(F.col("_doc"), f"$.{section}")).withColumns({"place": F.concat_ws("/", F.lit(section), "name"), "is_dev": F.lit(dev)})
        for section, dev in (("default", False), ("develop", True))
    ]
    return sections[0].unionByName(sections[1])


def pipfile_lock(files: DataFrame) -> DataFrame:
    """Pipfile.lock: default and develop sections. An entry that is no object is left out and listed by `odd_entries`."""
    version = F.regexp_replace(F.coalesce(F.try_variant_get("info", "$.version", "string"), F.lit(NO_VERSION)), "^=+", "")
    rows = pipfile_entries(files).filter(_is_object(F.col("info")))
    return _dependency(rows, "pypi", name=F.lower("name"), version=version, is_dev=F.col("is_dev"))


_POM_DEPENDENCY = "dependency:array<struct<groupId:string,artifactId:string,version:string,scope:string>>"
_POM = (
    f"properties map<string,string>, dependencies struct<{_POM_DEPENDENCY}>, "
    f"dependencyManagement struct<dependencies:struct<{_POM_DEPENDENCY}>>"
)


def maven_pom(files: DataFrame) -> DataFrame:
    """pom.xml: dependencies and managed dependencies, `${property}` versions resolved."""
    empty = F.array().cast("array<struct<groupId:string,artifactId:string,version:string,scope:string>>")
    section = lambda place, managed: F.transform(
        F.coalesce(F.col(f"_pom.{place}.dependency"), empty),
        lambda d: d.withField("managed", F.lit(managed)),
    )
    rows = (
        files.select("scan_id", "path", F.from_xml("content", _POM).alias("_pom"))
        .select(
            "scan_id",
            "path",
            F.col("_pom.properties").alias("_props"),
            F.concat(section("dependencies", False), section("dependencyManagement.dependencies", True)).alias("_deps"),
        )
        .select("scan_id", "path", "_props", F.inline("_deps"))
        .filter(F.coalesce("artifactId", F.lit("")) != "")
    )
    written = F.when(F.coalesce("version", F.lit("")) == "", NO_VERSION).otherwise(F.col("version"))
    prop = F.regexp_extract(written, r"^\$\{(.+)\}", 1)
    of = lambda key: F.try_element_at(F.col("_props"), key)
    version = (
        F.when(prop == "", written)
        .when(prop == "project.version", F.coalesce(of(F.lit("version")), F.lit(NO_VERSION)))
        .otherwise(F.coalesce(of(prop), written))
    )
    scope = F.when(F.coalesce("scope", F.lit("")) == "", "compile").otherwise(F.col("scope"))
    group = F.when(F.coalesce("groupId", F.lit("")) == "", "unknown").otherwise(F.col("groupId"))
    return _dependency(
        rows,
        "maven",
        name=F.col("artifactId"),
        version=version,
        is_dev=scope.isin("test", "provided"),
        group_id=group,
        scope=scope,
        managed=F.col("managed"),
    )


PARSERS = {
    "npm_manifest": npm_manifest,
    "npm_lock": npm_lock,
    "requirements": requirements,
    "pipfile_lock": pipfile_lock,
    "maven_pom": maven_pom,
}


def manifests_of(files: DataFrame) -> DataFrame:
    """Manifests among the files, outside the skipped folders: scan_id, path, content, _kind."""
    column = "relative_path" if "relative_path" in files.columns else "path"
    kind = manifest_kind(F.col("path")).alias("_kind")
    return files.filter(~has_excluded_dir(F.col(column), "manifest")).select("scan_id", "path", "content", kind).filter("_kind <> 'unsupported'")


def dependencies(files: DataFrame) -> DataFrame:
    """Packages of all manifests among the files, each read by the parser of its kind.

    Manifests are a small part of a corpus: they are written out first, in one pass, and the parsers
    read only them and the requirement files that they include. `manifest_faults` lists what gives no packages.
    """
    return packages_of(cut_lineage(manifests_of(files)), files)


def packages_of(kinds: DataFrame, files: DataFrame) -> DataFrame:
    """Packages of `manifests_of` rows; `files` is read only if requirement files include others."""
    of = {kind: kinds.filter(F.col("_kind") == kind).drop("_kind") for kind in PARSERS}
    of["requirements"] = of["requirements"].unionByName(included_requirements(files, of["requirements"]))
    parts = [parse(of[kind]) for kind, parse in PARSERS.items()]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows


# Sections that a manifest's JSON may have, by kind.
_SECTIONS = {
    "npm_manifest": ["dependencies", "devDependencies"],
    "npm_lock": ["packages", "dependencies"],
    "pipfile_lock": ["default", "develop"],
}


def unreadable_manifests(files: DataFrame) -> DataFrame:
    """Manifests that do not parse: scan_id, path, reason."""
    kind = manifest_kind(F.col("path"))
    broken = F.from_xml("content", "_broken string", {"columnNameOfCorruptRecord": "_broken"})["_broken"].isNotNull()
    reason = (
        F.when(F.col("content").isNull(), "no text")
        .when(kind.isin(list(_SECTIONS)) & F.try_parse_json("content").isNull(), "no JSON")
        .when((kind == "maven_pom") & broken, "no XML")
    )
    return files.filter(kind != "unsupported").select("scan_id", "path", reason.alias("reason")).filter("reason is not null")


def odd_sections(files: DataFrame) -> DataFrame:
    """Manifests whose JSON has another shape than their kind: scan_id, path, place (null: the document)."""
    kind, doc = manifest_kind(F.col("path")), F.try_parse_json("content")

    def odd(place: str) -> Column:
        there = F.try_variant_get(doc, place, "variant")
        return there.isNotNull() & ~F.is_variant_null(there) & _object(there).isNull()

    places = F.array_compact(F.array(*(F.when((kind == k) & odd(f"$.{name}"), name) for k, names in _SECTIONS.items() for name in names)))
    whole = F.when(_object(doc).isNull(), F.array(F.lit(None).cast("string"))).otherwise(places)
    rows = files.filter(kind.isin(list(_SECTIONS)) & doc.isNotNull())
    return rows.select("scan_id", "path", F.explode(whole).alias("place"))


def odd_entries(files: DataFrame) -> DataFrame:
    """Entries of lock files that are no objects and so name no version: scan_id, path, place."""
    kind = manifest_kind(F.col("path"))
    locks, pipfiles = files.filter(kind == "npm_lock"), files.filter(kind == "pipfile_lock")
    rows = lock_entries(locks).select("scan_id", "path", "place", "info").unionByName(pipfile_entries(pipfiles).select("scan_id", "path", "place", "info"))
    return rows.filter(~_is_object(F.col("info"))).drop("info")


def manifest_faults(files: DataFrame) -> DataFrame:
    """What gives no packages: scan_id, path, place (null for the whole file), reason."""
    whole = unreadable_manifests(files).withColumn("place", F.lit(None).cast("string"))
    odd = odd_sections(files).unionByName(odd_entries(files)).withColumn("reason", F.lit("no object"))
    return whole.unionByName(odd).select("scan_id", "path", "place", "reason")
