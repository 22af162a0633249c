"""Units of a source tree: discovery by manifest file, names and declared dependencies out of manifests."""

from __future__ import annotations

import json
import re
import tomllib
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Per language: manifests, extensions, directories not entered (fixed values).
LANGUAGES = {
    "rust": ({"Cargo.toml"}, {"rs"}, {"target"}),
    "typescript": ({"package.json"}, {"ts", "tsx", "svelte"}, {"node_modules", "dist", "build", "target", ".git"}),
    "go": ({"go.mod"}, {"go"}, {"vendor", ".git", "target"}),
    "python": ({"pyproject.toml", "setup.py"}, {"py"}, {"__pycache__", ".venv", "venv", ".git", "target", "node_modules"}),
    "java": ({"pom.xml", "build.gradle", "build.gradle.kts"}, {"java"}, {"target", "build", ".gradle", ".git"}),
}


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """path (below the root), content (text) of all files; contents are read only if used."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/") + "/"
    inside = F.substring_index(F.col("path"), base, -1)
    return f.select(inside.alias("path"), F.decode("content", "utf-8").alias("content"))


def _in_skipped(path, skips: set[str]):
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, sorted(skips))))


def discover_units(files: DataFrame, language: str) -> DataFrame:
    """root, manifest, content: directories that hold a manifest of the language, skipped ones left out."""
    manifests, _, skips = LANGUAGES[language]
    name = F.substring_index("path", "/", -1)
    f = files.filter(name.isin(*manifests) & ~_in_skipped(F.col("path"), skips))
    return f.select(F.regexp_replace("path", "/?[^/]*$", "").alias("root"), name.alias("manifest"), "content")


def collect_files(files: DataFrame, units: DataFrame, language: str) -> DataFrame:
    """root, path: files with an extension of the language under the deepest unit above them."""
    _, extensions, skips = LANGUAGES[language]
    f = files.filter(F.substring_index("path", ".", -1).isin(*extensions) & ~_in_skipped(F.col("path"), skips)).select("path")
    parts = F.split("path", "/")
    above = f.select("path", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("root")))).alias("x")).select("path", "x.*")
    hit = above.join(units.select("root").distinct(), "root")
    return hit.groupBy("path").agg(F.max_by("root", "k").alias("root")).select("root", "path")


def manifest_name(manifest: str, content: str | None, root: str) -> str:
    """The unit's name as its manifest gives it, else its directory's."""
    fallback = PurePosixPath(root).name or "unknown"
    content = content or ""
    if manifest == "go.mod":
        m = re.search(r"^\s*module\s+(\S+)", content, re.M)
        return m[1].rsplit("/", 1)[-1] if m else fallback
    if manifest == "pom.xml":
        try:
            top = ET.fromstring(content)
        except ET.ParseError:
            return fallback
        for child in top:
            if child.tag.rsplit("}", 1)[-1] == "artifactId" and (child.text or "").strip():
                return child.text.strip()
        return fallback
    if manifest.startswith("build.gradle"):
        return fallback
    try:
        data = json.loads(content) if manifest.endswith(".json") else tomllib.loads(content)
    except ValueError:
        return fallback
    for at in (data, data.get("project"), data.get("package")) if isinstance(data, dict) else ():
        if isinstance(at, dict) and isinstance(at.get("name"), str) and at["name"]:
            return at["name"]
    return fallback


def ts_dependencies(content: str) -> list[str]:
    try:
        data = json.loads(content)
    except ValueError:
        return []
    return [k for part in ("dependencies", "devDependencies") if isinstance(data, dict) and isinstance(data.get(part), dict) for k in data[part]]


def go_dependencies(content: str) -> list[str]:
    out = []
    for block, single in re.findall(r"^\s*require\s*(?:\(\s*\n(.*?)^\s*\)|([^\s(]\S*))", content, re.M | re.S):
        lines = block.splitlines() if block else [single]
        out += [x.split()[0] for x in lines if x.strip() and not x.strip().startswith("//")]
    return out


def python_dependencies(content: str) -> list[str]:
    try:
        declared = tomllib.loads(content).get("project", {}).get("dependencies", [])
    except (ValueError, AttributeError):
        return []
    names = (re.split(r"[><=!~;\[\s]", d.strip())[0] for d in declared if isinstance(d, str))
    return [n.replace("-", "_") for n in names if n]


def maven_dependencies(content: str) -> list[str]:
    found = re.findall(r"<dependency\b[^>]*>(.*?)</dependency>", content, re.S)
    return [m[1] for d in found if (m := re.search(r"<artifactId>\s*([^<\s]+)\s*</artifactId>", d))]


def gradle_dependencies(content: str) -> list[str]:
    return re.findall(r"^\s*(?:implementation|api|compile|compileOnly|runtimeOnly|testImplementation|testCompile)\s*\(?\s*[\"'][^:\"']+:([^:\"']+)", content, re.M)


def cargo_dependencies(content: str) -> list[str]:
    try:
        return list(tomllib.loads(content).get("dependencies", {}))
    except ValueError:
        return []


PARSERS = {"package.json": ts_dependencies, "go.mod": go_dependencies, "pyproject.toml": python_dependencies, "pom.xml": maven_dependencies, "build.gradle": gradle_dependencies, "build.gradle.kts": gradle_dependencies, "Cargo.toml": cargo_dependencies}


def read_manifests(units: DataFrame) -> DataFrame:
    """root, manifest, name, dependencies of discovered units."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(r.root, r.manifest, manifest_name(r.manifest, r.content, r.root), PARSERS.get(r.manifest, lambda c: [])(r.content or "")) for r in b.itertuples()]
            yield pd.DataFrame(rows, columns=["root", "manifest", "name", "dependencies"])

    return units.mapInPandas(run, "root string, manifest string, name string, dependencies array<string>")


def workspace_name(names: list[str]) -> str | None:
    """The common prefix of crate names up to its last hyphen, or the whole prefix if most names go on with a hyphen."""
    if len(names) < 2:
        return None
    prefix = names[0]
    for n in names[1:]:
        while not n.startswith(prefix):
            prefix = prefix[:-1]
    if "-" in prefix:
        return prefix[: prefix.rindex("-")] or None
    return prefix if prefix and 2 * sum(n.startswith(prefix + "-") for n in names) > len(names) else None


def hash_files(files: DataFrame) -> DataFrame:
    """path, hash, or a warning for files that cannot be read as text."""
    ok = F.col("content").isNotNull()
    return files.select("path", F.when(ok, F.sha2("content", 256)).alias("hash"), F.when(~ok, F.lit("unreadable")).alias("warning"))
