"""Files nobody wrote by hand for the project: generated, minified, third-party or data.

Notices are found by one multi-pattern automaton (Aho-Corasick) run over the comment lines of the whole file; a notice
counts where it opens the comment, so text that only quotes one does not; phrases that may stand anywhere in a comment, and
lines of authors, count in the comments that head or close the file. Path rules know vendored and generated
directories, lockfiles and the suffixes of generators and minifiers. Files that say nothing of the kind are found by measures of
the text itself: white space for minified code, encoded or tabular content for data, line shapes that repeat with counted
names for generated code, and the share of lines that also stand in one known upstream file for copies without notice.
Every row tells the rule that found it.

Known upstream files go to all tasks as an index while their text is at most SHARED_BYTES; more of them are joined by line: a file that
shares COPIED of its lines with one upstream file shares one of its rarest lines with it, so only those are joined for candidates, and
the candidates' lines are counted exactly.

Defined results: null and empty contents are judged by path alone; a file that does not parse is judged all the same;
repeated rows count once (the latest loaded_at); empty upstream tables find no copies; extra columns are never read.
"""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.tables import raw_files
from graphloom.runtime import salted_join, write_table
from graphloom.tables import latest

#: Openings of comments that tell of a generator (fixed values, compared in lower case).
GENERATED = [
    "code generated by", "code generated from", "@generated", "autogenerated file", "auto-generated file", "auto generated file", "autogenerated by", "auto-generated by",
    "autogenerated from", "auto-generated from", "<auto-generated", "<autogenerated", "automatically created by", "automatically generated by", "automatically generated from", "this file was produced automatically",
    "this file is produced automatically", "this file was automatically generated", "this file is automatically generated", "this file is auto-generated", "this file was auto-generated",
    "this file is autogenerated", "this file was generated", "this file is generated by", "this code was generated", "this code is generated by", "this is a generated file", "generated by the protocol buffer compiler",
    "autogenerated bindings", "auto-generated bindings", "generated by protoc", "generated by swig", "machine generated", "machine-generated", "do not edit: generated", "do not edit - generated", "generated file. do not edit",
    "generated code. do not edit", "warning: this file is generated", "!!! generated", "autogenerated.", "auto-generated.", "autogenerated,", "auto-generated,",
]
#: Phrases that tell of a generator wherever they stand in a comment that heads or closes the file.
ANYWHERE = ["(machine written)", "(machine generated)", "machine-written file", "generated - do not edit", "generated, do not edit", "generated code -- do not modify"]
#: Openings of comments that tell of another project's file.
FOREIGN = ["copied from ", "vendored from ", "taken from https://", "upstream: http", "this is a vendored copy", "imported from https://"]
_AUTHORS = re.compile(r"^(?:[\w.\-]+ v?\d+(?:\.\d+)+\s*\|\s*\(c\)|copyright (?:\(c\) )?(?:\d{4}(?:-\d{4})?,? )?the [\w.\- ]+ (?:contributors|authors|developers)\b)")

VENDORED = {"node_modules", "bower_components", "third_party", "third-party", "thirdparty", "vendor", "_vendor", "vendored", "site-packages", "godeps", "jspm_packages", ".yarn"}
#: Names that hold other projects' files when a directory per library follows.
VENDORED_BY_LIBRARY = {"deps", "external", "extern", "externals", "contrib", "vendors"}
BUILT = {"autogen", "generated", "gen", "__generated__", "gen-src", "codegen-out", ".next", "dist-gen", "pb"}
LOCKFILES = {"package-lock.json", "yarn.lock", "pnpm-lock.yaml", "cargo.lock", "go.sum", "poetry.lock", "pipfile.lock", "uv.lock", "composer.lock"}
_SUFFIX = re.compile(r"(?:[._\-](?:generated|gen|g|autogen|pb|pb2|pb2_grpc|min|bundle|designer|auto)|_pb|\.pb\.gw|[._\-]min)\.(?:rs|ts|tsx|js|jsx|mjs|go|py|pyi)$")
_COMMENT = re.compile(r"^[ \t]*(?:///?!?|/\*+!?|\*+(?!/)|#(?!\[|!\[)+|--|;+|<!--|\"\"\"|''')[ \t]*", re.M)
#: Share of a file's lines that must stand in one upstream file, and the fewest such lines.
COPIED, COPIED_LINES = 0.7, 4
#: Bytes of upstream text that are sent to all tasks at most.
SHARED_BYTES = 32 << 20
#: Mean length from which lines without white space are minified code, in files of any size.
DENSE = 48
#: Literals that make rows of them data where the rows are few.
LITERALS = 64
_SPACE = re.compile(r"\s+")
_NAME_OR_NUMBER = re.compile(r"[A-Za-z_$][\w$]*|\d[\w.]*")
_LITERAL = re.compile(r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`[^`]*`')
_ENCODED = re.compile(r"[A-Za-z0-9+/=_\-]{200,}|(?:\\x[0-9a-fA-F]{2}){50,}|[0-9a-fA-F]{200,}")
_COUNTED = re.compile(r"\b[A-Za-z_][A-Za-z_$]*?_?(\d{1,7})\b")


@lru_cache
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, words in (("generated", GENERATED), ("anywhere", ANYWHERE), ("foreign", FOREIGN)):
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def _edges(lines: list[str]) -> set[int]:
    """Numbers of the lines before the first and after the last line of code."""
    code = [i for i, x in enumerate(lines) if x.strip() and not _COMMENT.match(x) and not x.startswith("#!")]
    return {*range(code[0]), *range(code[-1] + 1, len(lines))} if code else set(range(len(lines)))


def notice(text: str) -> str | None:
    """generated or third_party if a comment of the text says so."""
    lines = text.splitlines()
    near: set[int] | None = None
    auto = automaton()
    for i, line in enumerate(lines):
        m = _COMMENT.match(line)
        if m is None:
            continue
        said = line[m.end() :].lower()
        for end, (kind, n) in auto.iter(said):
            begin = end - n + 1
            if kind == "anywhere":
                near = _edges(lines) if near is None else near
                if i in near:
                    return "generated"
            elif begin == 0:
                return "generated" if kind == "generated" else "third_party"
        if _AUTHORS.match(said):
            near = _edges(lines) if near is None else near
            if i in near:
                return "third_party"
    return None


def by_path(path: str) -> str | None:
    parts = [p for p in path.strip().lower().replace("\\", "/").split("/") if p]
    if not parts:
        return None
    name, dirs = parts[-1], parts[:-1]
    if name in LOCKFILES:
        return "generated"
    if VENDORED & set(dirs):
        return "third_party"
    if any(d in VENDORED_BY_LIBRARY and k + 1 < len(dirs) for k, d in enumerate(dirs)):
        return "third_party"
    if BUILT & set(dirs) or any(a == "target" and b in ("build", "debug", "release") for a, b in zip(dirs, dirs[1:])):
        return "generated"
    m = _SUFFIX.search(name)
    if m:
        return "minified" if "min" in m[0] or "bundle" in m[0] else "generated"
    return None


def by_measure(text: str) -> str | None:
    """minified, data or generated by the shape of the text."""
    bare = text.strip()
    if not bare:
        return None
    lines = [x for x in bare.splitlines() if x.strip()]
    code = [x for x in lines if not _COMMENT.match(x)]
    if not code:
        return None
    size = sum(map(len, code))
    # Data: a document of its own, a table, or encoded bytes, numbers and strings that make up most of the file.
    if bare[0] in "[{" and bare[-1] in "]}":
        try:
            json.loads(bare)
            return "data"
        except ValueError:
            pass
    for sep in (",", ";", "\t"):
        counts = [x.count(sep) for x in code]
        if len(code) >= 3 and counts[0] >= 2 and sum(c == counts[0] for c in counts) >= 0.95 * len(code) and not any(x.rstrip().endswith((sep, "{", "(", "[")) for x in code):
            return "data"
    if sum(len(m[0]) for x in code for m in _ENCODED.finditer(x)) > 0.5 * size:
        return "data"
    literal = [(n, len(x)) for x in code if (n := _literals(x))]
    if sum(k for _, k in literal) > 0.8 * size and (len(literal) >= 8 or sum(n for n, _ in literal) >= LITERALS):
        return "data"
    long = [x for x in code if len(x) > 400]
    if sum(map(len, long)) > 0.6 * size and _squeezed(long):
        return "minified"
    # Generated: nearly every line takes one of few shapes, and names count up through the file.
    if len(code) >= 16:
        shapes = Counter(_NAME_OR_NUMBER.sub("w", _LITERAL.sub("s", x)).strip() for x in code)
        common = sum(n for _, n in shapes.most_common(4))
        numbers = {int(m[1]) for x in code for m in _COUNTED.finditer(x)}
        if common >= 0.9 * len(code) and len(numbers) >= max(5, 0.1 * len(code)) and sum(n - 1 in numbers for n in numbers) >= 0.8 * len(numbers):
            return "generated"
    return "minified" if size > DENSE * len(code) and _squeezed(code) else None


def _squeezed(lines: list[str]) -> bool:
    """Hardly a space outside strings."""
    outside = _LITERAL.sub('""', "\n".join(lines))
    return bool(outside) and sum(c.isspace() for c in outside) < 0.12 * len(outside) and len(_NAME_OR_NUMBER.findall(outside)) > 20


#: Nothing is given back once taken, so a line of any length is read once.
_OPEN = re.compile(r"\s*+[\[\]{}()]*+\s*+")
_ITEM = re.compile(r"(?:-?(?:0x[\da-fA-F]++|\d[\d_.]*+(?:[eE][+-]?\d++)?+)[a-z\d]*+|s)[,:;\])}\s]*+")


def _literals(line: str) -> int:
    """How many literals the line holds if it holds nothing else but separators; else 0."""
    bare = _LITERAL.sub("s", line)
    at, n = _OPEN.match(bare).end(), 0
    while at < len(bare):
        m = _ITEM.match(bare, at)
        if m is None:
            return 0
        at, n = m.end(), n + 1
    return n


def _normal(line: str) -> str:
    return _SPACE.sub("", line)


def upstream_index(contents: list[str]) -> dict[str, list[int]]:
    """Normal line of at least 12 characters: numbers of the upstream files that hold it."""
    out = defaultdict(set)
    for i, text in enumerate(contents):
        for line in text.splitlines():
            if len(n := _normal(line)) >= 12:
                out[n].add(i)
    return {k: sorted(v) for k, v in out.items()}


def copied(text: str, index: dict[str, list[int]]) -> bool:
    """True if COPIED of the lines stand in one upstream file."""
    lines = [n for x in text.splitlines() if len(n := _normal(x)) >= 12]
    if len(lines) < COPIED_LINES:
        return False
    hits = Counter(u for n in lines for u in index.get(n, ()))
    return bool(hits) and max(hits.values()) >= COPIED * len(lines)


RULES = ["path", "notice", "measure", "copy"]


def classify(path: str | None, text: str | None, index: dict[str, list[int]]) -> tuple[str, str] | None:
    """(third_party, generated, minified or data; the rule that tells); None for source written by hand."""
    text = (text or "").removeprefix("\ufeff")
    tests = (lambda: by_path(path or ""), lambda: notice(text), lambda: by_measure(text), lambda: "third_party" if copied(text, index) else None)
    return next(((kind, rule) for rule, test in zip(RULES, tests, strict=True) if (kind := test())), None)


def _lines(files: DataFrame, key: str) -> DataFrame:
    """key, line (64-bit hash), n: how often each normal line of at least 12 characters stands in a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, text in zip(b.column(key).to_pylist(), b.column("content").to_pylist(), strict=True):
                counts = Counter(int.from_bytes(blake2b(n.encode(), digest_size=8).digest(), "little", signed=True) for x in text.splitlines() if len(n := _normal(x)) >= 12)
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(counts), pa.int64()), pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=[key, "line", "n"])

    return files.select(key, "content").mapInArrow(run, f"{key} long, line long, n long")


def copies(files: DataFrame, upstream_files: DataFrame) -> DataFrame:
    """file_id of the files of which COPIED of the lines stand in one upstream file; any number of upstream files.

    files: file_id, content. Only a file's rarest lines, just more than it may lack, look for candidates; a line in very many upstream
    files is therefore joined only for files that have no rarer ones.
    """
    up = write_table(_lines(upstream_files.filter("content is not null").select(F.xxhash64("content").alias("up"), "content").dropDuplicates(["up"]), "up").drop("n"), "upstream-lines")
    own = write_table(_lines(files.filter("content is not null"), "file_id"), "file-lines")
    spread = up.groupBy("line").agg(F.count(F.lit(1)).alias("held"))
    w = Window.partitionBy("file_id")
    ranked = salted_join(own, spread, ["line"], "left", F.col("file_id")).withColumns({"held": F.coalesce("held", F.lit(0)), "total": F.sum("n").over(w)})
    before = F.sum("n").over(w.orderBy("held", "line").rowsBetween(Window.unboundedPreceding, -1))
    rare = ranked.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("total") >= COPIED_LINES).filter(F.col("before") <= (1 - COPIED) * F.col("total"))
    candidates = salted_join(rare.filter("held > 0").select("file_id", "total", "line"), up, ["line"], "inner", F.col("file_id")).select("file_id", "total", "up").distinct()
    hits = candidates.join(own, "file_id").join(up, ["up", "line"], "left_semi").groupBy("file_id", "up", "total").agg(F.sum("n").alias("hits"))
    return hits.filter(F.col("hits") >= COPIED * F.col("total")).select("file_id").distinct()


def classified(source_files: DataFrame, upstream_files: DataFrame, shared_bytes: int = SHARED_BYTES) -> DataFrame:
    """file_id, project_id, path, kind (null: written by hand), rule of every counting file."""
    known = upstream_files.filter(F.col("content").isNotNull()).select("content").distinct()
    fits = (known.agg(F.sum(F.octet_length("content"))).first()[0] or 0) <= shared_bytes
    index = upstream_index(known.toArrow().column("content").to_pylist() if fits else [])
    shared = source_files.sparkSession.sparkContext.broadcast(index)
    columns = ("file_id", "project_id", "path", "loaded_at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in batches:
            found = [classify(p, t, index) or (None, None) for p, t in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), *(pa.array([f[i] for f in found], pa.string()) for i in (0, 1))], names=[*columns, "kind", "rule"])

    judged = latest(raw_files(source_files).mapInArrow(run, "file_id long, project_id string, path string, loaded_at timestamp, kind string, rule string"), ["file_id"]).drop("loaded_at")
    if fits:
        return judged
    judged = write_table(judged, "judged")
    open_files = latest(raw_files(source_files), ["file_id"]).join(judged.filter("kind is null").select("file_id"), "file_id", "left_semi")
    more = copies(open_files, upstream_files).withColumn("copied", F.lit(True))
    judged = judged.join(more, "file_id", "left")
    return judged.select("file_id", "project_id", "path", F.when(F.col("copied"), "third_party").otherwise(F.col("kind")).alias("kind"), F.when(F.col("copied"), "copy").otherwise(F.col("rule")).alias("rule"))


def not_by_hand(source_files: DataFrame, upstream_files: DataFrame) -> DataFrame:
    return classified(source_files, upstream_files).filter("kind is not null").select("file_id")


def rule_counts(source_files: DataFrame, upstream_files: DataFrame) -> DataFrame:
    """rule, kind, n: how many files each rule finds."""
    return classified(source_files, upstream_files).filter("kind is not null").groupBy("rule", "kind").agg(F.count(F.lit(1)).alias("n"))


def hand_written(source_files: DataFrame, upstream_files: DataFrame, units: DataFrame) -> DataFrame:
    """project_id, file_id, path of the files named in units that remain."""
    named = units.select("project_id", F.explode("source_files").alias("path")).filter("path is not null").distinct()
    return classified(source_files, upstream_files).filter("kind is null").join(named, ["project_id", "path"], "left_semi").select("project_id", "file_id", "path")
