"""Scalar functions on names, paths and references: Column in, Column out, all inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions.glob import glob_to_regex

DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"
SEVERITIES = ["info", "warning", "error"]


def kebab(c: Column) -> Column:
    """camelCase, snake_case and Acronyms to kebab-case; digits never split; leading separators go, a trailing one stays."""
    split = F.regexp_replace(c, r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})", "-")
    return F.lower(F.regexp_replace(F.regexp_replace(split, "[_-]+", "-"), "^-+", ""))


def path_error(c: Column) -> Column:
    """The first of missing_leading_slash, empty_segment, trailing_slash, invalid_segment that holds; null if valid."""
    return (
        F.when(~c.startswith("/"), "missing_leading_slash")
        .when(c == "/", "empty_segment")
        .when(c.endswith("/"), "trailing_slash")
        .when(c.contains("//"), "empty_segment")
        .when(~c.rlike(r"\A(/[a-z0-9-]+)+\z"), "invalid_segment")
    )


def parent_path(c: Column) -> Column:
    p = F.regexp_extract(c, "^(.+)/[^/]+$", 1)
    return F.when(p != "", p)


def path_name(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def path_depth(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("/"), F.lit("")))


def ancestor_paths(c: Column) -> Column:
    """All proper prefixes of a path that end at a slash, from the shortest."""
    parts = F.split(c, "/")
    return F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def glob_match(c: Column, pattern: str) -> Column:
    """A glob over paths: * within a segment, ** over any depth; a closing /** also takes the path before it."""
    hit = c.rlike(glob_to_regex(pattern))
    return hit | (c == pattern[:-3]) if pattern.endswith("/**") else hit


def qualified_to_path(c: Column) -> Column:
    return F.concat(F.lit("/"), F.array_join(F.transform(F.split(c, "::"), kebab), "/"))


def uuid5(c: Column, namespace: str = DNS_NAMESPACE) -> Column:
    """Name-based UUID, version 5."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(c, "utf-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def source_ref_file(c: Column) -> Column:
    f = F.regexp_extract(c, r"^(.+):(\d+)$", 1)
    return F.when(f != "", f)


def source_ref_line(c: Column) -> Column:
    line = F.regexp_extract(c, r"^(.+):(\d+)$", 2)
    return F.when(line != "", line.cast("long"))


def parent_module(c: Column) -> Column:
    p = F.regexp_extract(c, "^(.*)::[^:]*$", 1)
    return F.when(p != "", p)


def project_local(c: Column) -> Column:
    return c.contains("::")


def is_getter(name: Column, n_params: Column) -> Column:
    return name.rlike("^(get|is|has)_") & (n_params <= 1)


def valid_project_id(c: Column) -> Column:
    return F.length(c).between(1, 128) & c.rlike(r"\A[a-z][a-z0-9_-]*\z")


def severity_rank(c: Column) -> Column:
    out = F.lit(None).cast("int")
    for i, s in enumerate(SEVERITIES):
        out = F.when(c == s, i).otherwise(out)
    return out


def export_id(c: Column) -> Column:
    return F.translate(F.ltrim(c, F.lit("/")), "/-", "__")


def web_id(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9]", "_")


def label_text(c: Column) -> Column:
    """snake_case to words with a capital each, the rest untouched."""
    return F.array_join(F.transform(F.split(c, "_"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))), " ")


def metric(metadata: Column, key: str) -> Column:
    """A number of the metadata, 0 if there is none."""
    return F.coalesce(F.get_json_object(metadata, f"$.{key}").try_cast("double"), F.lit(0.0))


def is_test_file(path: Column, language: str) -> Column:
    name = F.substring_index(path, "/", -1)
    return {
        "typescript": path.rlike(r"\.(test|spec)\.") | path.contains("__tests__"),
        "go": name.endswith("_test.go"),
        "python": name.rlike(r"^test_.*\.py$|_test\.py$|^conftest\.py$"),
        "java": path.contains("src/test/java"),
    }[language]


def test_function(name: Column) -> Column:
    """Go's prefixes of test functions."""
    return name.rlike("^(Test|Benchmark|Example|Fuzz)")


def workspace_name_of(crate: Column, workspace: str) -> Column:
    """Qualified name of a crate in a workspace: ws-core to ws::core, the workspace's own crate to ws::app."""
    ws = workspace.replace("-", "_")
    under = F.replace(crate, F.lit("-"), F.lit("_"))
    return F.when(crate == workspace, f"{ws}::app").when(crate.startswith(f"{workspace}-"), F.concat(F.lit(f"{ws}::"), F.substring(under, len(workspace) + 2, 1_000_000))).otherwise(under)


def file_module(path: Column, language: str, package: Column) -> Column:
    """Qualified module name of a source file below its package's root."""
    bare = F.regexp_replace(path, r"\.(rs|tsx?|svelte|go|py|java)$", "")
    if language == "python":
        bare = F.regexp_replace(bare, r"(^|/)__init__$", "")
    elif language == "typescript":
        bare = F.regexp_replace(bare, r"(^|/)(index|main)$", "")
    elif language == "go":
        bare = F.when(bare.contains("/"), F.regexp_replace(bare, "/[^/]*$", "")).otherwise("")
    elif language == "rust":
        bare = F.regexp_replace(bare, r"(^|/)(mod|lib|main)$", "")
    elif language == "java":
        bare = F.regexp_replace(bare, "^.*src/(main|test)/java/", "")
    return F.when(bare == "", package).otherwise(F.concat_ws("::", package, F.replace(bare, F.lit("/"), F.lit("::"))))


def relative_module(module: Column, target: Column) -> Column:
    """A Python import of leading dots against the importing module; null above the root."""
    dots = F.length(F.regexp_extract(target, r"^(\.+)", 1))
    rest = F.regexp_replace(target, r"^\.+", "")
    parts = F.split(module, "::")
    up = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - dots, F.lit(0))), "::")
    return F.when(dots >= F.size(parts), None).otherwise(F.when(rest == "", up).otherwise(F.concat_ws("::", up, F.replace(rest, F.lit("."), F.lit("::")))))


def script_import(package: Column, target: Column) -> Column:
    """A relative script import below its package, without the importer's directory and extensions."""
    bare = F.regexp_replace(F.regexp_replace(target, r"^(\.{1,2}/)+", ""), r"\.(tsx?|jsx?|svelte)$", "")
    return F.concat_ws("::", package, F.replace(bare, F.lit("/"), F.lit("::")))


def _first_argument(inner: Column) -> Column:
    """The text up to the first comma or closing bracket at its own level, at any depth of nesting."""
    level, out, done = (F.lit(0), F.lit(""), F.lit(False))
    start = F.struct(level.alias("level"), out.alias("out"), done.alias("done"))

    def step(a: Column, c: Column) -> Column:
        ends = a["done"] | ((a["level"] == 0) & c.isin(",", ">"))
        level = a["level"] + F.when(c == "<", 1).when(c == ">", -1).otherwise(0)
        return F.struct(F.when(ends, a["level"]).otherwise(level).alias("level"), F.when(ends, a["out"]).otherwise(F.concat(a["out"], c)).alias("out"), ends.alias("done"))

    return F.trim(F.aggregate(F.split(inner, ""), start, step, lambda a: a["out"]))


def unwrap_type(c: Column, wrappers: tuple[str, ...] = ("Option", "Result", "Vec", "Box", "Arc", "Rc")) -> Column:
    """The first type argument inside known wrappers, however many; references lose their sign."""
    bare = F.trim(F.regexp_replace(c, r"^&\s*(mut\s+)?('[a-z_]+\s+)?", ""))
    names = "|".join(map(re.escape, wrappers))
    inside = F.regexp_replace(bare, rf"^(?:(?:\w+::)*(?:{names})<\s*)+", "")
    return F.when(inside == bare, bare).otherwise(_first_argument(inside))


#: Types that carry no data of the project (fixed values).
SKIPPED_TYPES = ("String", "str", "bool", "char", "u8", "u16", "u32", "u64", "usize", "i8", "i16", "i32", "i64", "isize", "f32", "f64", "()", "Self", "self")


def is_skipped_type(c: Column) -> Column:
    return c.isin(*SKIPPED_TYPES)


def first_type_argument(c: Column) -> Column:
    """The first argument of a generic type at the outermost level; null if there is none."""
    first = F.when(c.rlike("<.*>$"), _first_argument(F.regexp_replace(c, "^[^<]*<", "")))
    return F.when(first != "", first)


def data_flow_metadata(params: Column, returns: Column) -> Column:
    """JSON of the parameters (array of name, type) and the return type that carry data, unwrapped; null if none does."""
    kept = F.filter(F.transform(params, lambda p: F.struct(p["name"].alias("name"), unwrap_type(p["type"]).alias("type"))), lambda p: ~is_skipped_type(p["type"]))
    back = unwrap_type(returns)
    back = F.when(~is_skipped_type(back), back)
    return F.when((F.size(kept) > 0) | back.isNotNull(), F.to_json(F.struct(F.when(F.size(kept) > 0, kept).alias("param_types"), back.alias("return_type"))))


def scoped_call(call: Column, own_type: Column, module: Column, aliases: Column) -> Column:
    """Target of a call: Self is the type of the impl, a capital first part an alias (map) or a type of the module."""
    head, rest = F.substring_index(call, "::", 1), F.regexp_extract(call, "^[^:]+::(.*)$", 1)
    full = F.coalesce(F.element_at(aliases, head), F.concat_ws("::", module, head))
    return F.when(head == "Self", F.concat_ws("::", own_type, rest)).when(head.rlike("^[A-Z]") & (rest != ""), F.concat_ws("::", full, rest)).otherwise(call)


#: How a view draws nodes and edges (fixed values).
SHAPES = {"trait": "diamond", "struct": "hexagon", "function": "ellipse", "module": "roundrectangle", "enum": "pentagon", "interface": "diamond", "class": "hexagon", "crate": "roundrectangle", "package": "roundrectangle", "workspace": "roundrectangle", "directory": "roundrectangle"}
EDGE_LINES = {"depends": "solid", "calls": "solid", "implements": "dotted", "extends": "solid", "exports": "dashed", "transforms": "solid", "data_flow": "solid"}
EDGE_ARROWS = {"depends": "triangle", "calls": "vee", "implements": "triangle", "extends": "triangle-backcurve", "exports": "triangle", "transforms": "triangle", "data_flow": "vee"}


def looked_up(c: Column, values: dict[str, str]) -> Column:
    """The value of a literal table, null where it has none."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), c)
