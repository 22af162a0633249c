"""Items and relations out of source texts, one file at a time in Arrow batches.

Python is read with the standard parser. The other languages are read in one pass over the text with comments and strings
blanked out: declarations and braces are met in order, a stack of open braces tells the owner of each declaration and
call. Qualified names join the module (from the path) and the owners with '::'; ends of relations get the same form.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.runtime import write_table

ITEM_SCHEMA = "path string, qualified_name string, kind string, sub_kind string, name string, parent string, language string, source_ref string, tags array<string>, metadata string"
RELATION_SCHEMA = "path string, source string, target string, kind string"
OUT_SCHEMA = f"part string, {ITEM_SCHEMA}, source string, target string"


@dataclass
class Parsed:
    items: list[dict] = field(default_factory=list)
    relations: list[dict] = field(default_factory=list)

    def item(self, qn: str, sub_kind: str, parent: str, line: int, tags: list[str] | None = None, kind: str = "unit", signature: tuple[list[tuple[str, str]], str | None] | None = None, **meta: str) -> None:
        """signature: (name, type) of the parameters and the returned type, as written; ``typed`` brings them to qualified names."""
        self.items.append({"qualified_name": qn, "kind": kind, "sub_kind": sub_kind, "name": qn.rsplit("::", 1)[-1], "parent": parent, "line": line, "tags": tags or [], "signature": signature, "meta": meta})

    def relation(self, source: str, target: str, kind: str) -> None:
        self.relations.append({"source": source, "target": target, "kind": kind})


    def typed(self, module: str, imported: dict[str, str] | None = None) -> Parsed:
        """Metadata of the items: types without wrappers, qualified by the file's own declarations and its imports."""
        known = {r["target"].rsplit("::", 1)[-1]: r["target"] for r in self.relations if r["kind"] == "depends" and r["source"] == module}
        known |= {i["name"]: i["qualified_name"] for i in self.items if i["sub_kind"] in ("struct", "enum", "trait", "class", "interface", "type-alias")}
        known |= imported or {}
        for i in self.items:
            if i["sub_kind"] == "impl":
                i["parent"] = known.get(i["parent"], i["parent"])
            params, back = i.pop("signature") or ([], None)
            meta = {k: known.get(v, v) for k, v in i.pop("meta").items()}
            kept = [{"name": n, "type": known.get(t, t)} for n, w in params if (t := plain_type(w))]
            back = plain_type(back) if back else None
            meta |= ({"param_types": kept} if kept else {}) | ({"return_type": known.get(back, back)} if back else {})
            i["metadata"] = json.dumps(meta) if meta else None
        # Calls of the file's own functions and of imported names get the names that items have.
        own = {i["name"]: i["qualified_name"] for i in self.items if i["sub_kind"] == "function" and i["parent"] == module}
        for r in self.relations:
            if r["kind"] == "calls":
                first, dots, rest = r["target"].partition("::")
                r["target"] = (own.get(first) or (imported or {}).get(first, first)) if not dots else f"{(imported or {}).get(first, first)}::{rest}"
        return self


#: Types that hold one of another type (fixed values), and those that carry no data of the project.
_WRAPPERS = {"Option", "Result", "Vec", "Box", "Arc", "Rc", "Promise", "Array", "Optional", "List", "list", "Sequence", "Iterable", "Iterator", "List", "Set", "Collection", "Readonly"}
_NO_TYPES = {"String", "str", "bool", "char", "usize", "isize", "()", "Self", "self", "string", "number", "boolean", "void", "any", "unknown", "undefined", "null", "never", "object", "int", "float", "bytes", "None", "error", "byte", "rune", "Object", "Integer", "Long", "Double", "Boolean", "long", "double", "dict", "set", "tuple"}
_SIGNS = re.compile(r"^(?:&\s*(?:'\w+\s+)?(?:mut\s+)?|mut\s+|dyn\s+|impl\s+|readonly\s+|final\s+|\*|\[\d*\]|\.\.\.|\(\s*(?=[^()]*\)$))")


def plain_type(written: str) -> str | None:
    """The type inside references, lists and wrappers, with '::' between names; None if it carries no data of the project."""
    t = written.strip()
    while t:
        bare = _SIGNS.sub("", t).strip()
        if bare != t:
            t = bare.rstrip(")") if t[0] == "(" else bare
        elif t.endswith("[]"):
            t = t[:-2].rstrip()
        elif (m := re.match(r"((?:\w+(?:::|\.))*)(\w+)\s*[<\[](.*)[>\]]$", t, re.S)) and m[2] in _WRAPPERS:
            t = next(iter(_split(m[3])), "").strip()
        else:
            break
    m = re.match(r"(?:[A-Za-z_$][\w$]*(?:::|\.))*[A-Za-z_$][\w$]*", t)
    name = m[0].replace(".", "::") if m else ""
    return name if name and name not in _NO_TYPES and not re.fullmatch(r"[iuf](?:8|16|32|64|128)|u?int\d+|float\d+", name) else None


def _split(text: str) -> Iterator[str]:
    """Parts between commas that no bracket holds."""
    depth = begin = 0
    for k, c in enumerate(text):
        depth += (c in "(<[{") - (c in ")]}" or (c == ">" and text[k - 1 : k] not in ("-", "=")))
        if c == "," and depth == 0:
            yield text[begin:k]
            begin = k + 1
    if text[begin:].strip():
        yield text[begin:]


_PARAM = {"rust": re.compile(r"\s*(?:mut\s+)?(\w+)\s*:\s*(.+)", re.S), "typescript": re.compile(r"\s*(?:public\s+|private\s+|readonly\s+)*(?:\.\.\.)?([\w$]+)\??\s*:\s*([^=]+)", re.S), "go": re.compile(r"\s*(\w+)\s+(.+)", re.S), "java": re.compile(r"\s*(?:final\s+|@\w+\s+)*([\w.<>\[\], ?]+?)\s+(\w+)\s*$", re.S)}
_BACK = {"rust": re.compile(r"\s*->\s*(.+?)\s*(?:\{|;|\bwhere\b|$)", re.S), "typescript": re.compile(r"\s*:\s*(.+?)\s*(?:\{|=>|;|$)", re.S), "go": re.compile(r"\s*\(?\s*(?:\w+\s+(?=[\w*\[]))?([\w.*\[\]]+)")}


def _signature(language: str, bare: str, at: int) -> tuple[list[tuple[str, str]], str | None] | None:
    """Parameters and returned type of the declaration whose name ends at ``at``."""
    opens = bare.find("(", at - 1)
    if opens < 0 or re.search(r"[{};]", bare[at:opens]):
        return None
    depth, k = 0, opens
    while k < len(bare):
        depth += (bare[k] == "(") - (bare[k] == ")")
        if depth == 0:
            break
        k += 1
    params = []
    waiting: list[str] = []
    for part in _split(bare[opens + 1 : k]):
        m = _PARAM[language].fullmatch(part)
        if m:
            name, type_ = (m[2], m[1]) if language == "java" else (m[1], m[2])
            params += [(w, type_) for w in waiting] + [(name, type_)]  # Go: names before share the type
            waiting = []
        elif language == "go" and re.fullmatch(r"\s*\w+\s*", part):
            waiting.append(part.strip())
    stop = min((x for x in (bare.find(c, k) for c in "{;\n") if x >= 0), default=len(bare))
    if language == "java":  # the type stands before the name
        m = re.search(r"([\w.]+(?:\s*<[^;{}()]*>)?(?:\[\])*)\s+\w+\s*$", bare[max(bare.rfind(c, 0, opens) for c in ";{}\n") + 1 : opens])
    else:
        m = _BACK[language].match(bare[k + 1 : stop])
    return params, m[1] if m else None


def module_of(path: str) -> str:
    """Qualified module name of a file: its path without extension and source directories."""
    p = PurePosixPath(path)
    parts = [x for x in (*p.parts[:-1], p.name.split(".")[0]) if x not in ("src", "/")]
    inner = {"py": ("__init__",), "rs": ("mod", "lib", "main"), "ts": ("index", "main"), "tsx": ("index", "main")}
    if parts and parts[-1] in inner.get(path.rsplit(".", 1)[-1], ()):
        parts = parts[:-1]  # the file that stands for its directory
    return "::".join(parts) or "root"


# --- Python ------------------------------------------------------------------------------------------------------------------


def parse_python(text: str, path: str) -> Parsed:
    out, module = Parsed(), module_of(path)
    name = PurePosixPath(path).name
    test_file = name.startswith("test_") or name.endswith("_test.py") or name == "conftest.py"
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return out

    imported: dict[str, str] = {}

    def visit(body: list[ast.stmt], owner: str, in_class: bool) -> None:
        for node in body:
            if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
                if node.name.startswith("_") and node.name != "__init__":
                    continue
                qn = f"{owner}::{node.name}"
                out.item(qn, "method" if in_class else "function", owner, node.lineno, ["test"] if test_file or node.name.startswith("test_") else [], signature=([(x.arg, ast.unparse(x.annotation)) for x in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs] if x.annotation], ast.unparse(node.returns) if node.returns else None))
                for call in ast.walk(node):
                    if isinstance(call, ast.Call) and (target := _dotted(call.func)):
                        out.relation(qn, target.replace(".", "::"), "calls")
            elif isinstance(node, ast.ClassDef):
                qn = f"{owner}::{node.name}"
                out.item(qn, "class", owner, node.lineno, ["test"] if test_file or node.name.startswith("Test") else [])
                for base in node.bases:
                    if target := _dotted(base):
                        out.relation(qn, target.replace(".", "::"), "extends")
                visit(node.body, qn, True)
            elif isinstance(node, ast.Import):
                for a in node.names:
                    out.relation(module, a.name.replace(".", "::"), "depends")
            elif isinstance(node, ast.ImportFrom):
                base = module.split("::")[: -node.level] if node.level else []
                if node.level and not base and node.module is None:
                    continue
                target = "::".join([*base, *(node.module.split(".") if node.module else [])])
                out.relation(module, target, "depends")
                imported.update({a.asname or a.name: f"{target}::{a.name}" for a in node.names})
            elif isinstance(node, ast.If | ast.Try):
                visit(node.body, owner, in_class)

    visit(tree.body, module, False)
    return out.typed(module, imported)


def _dotted(node: ast.expr) -> str | None:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None


# --- languages with braces -----------------------------------------------------------------------------------------------------

_BLANK = {
    "rust": re.compile(r'//[^\n]*|/\*[\s\S]*?\*/|b?r(#*)"[\s\S]*?"\1|b?"(?:[^"\\]|\\[\s\S])*"|\'(?:[^\'\\\n]|\\[^\n]{1,10})\''),
    "typescript": re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\[\s\S])*`"),
    "go": re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`|'(?:[^'\\\n]|\\[^\n]{1,10})'"),
    "java": re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|\"\"\"[\s\S]*?\"\"\"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\[^\n]{1,6})'"),
}
#: Declarations per language: (pattern with name, sub_kind, may own others).
_DECLARE: dict[str, list[tuple[str, str, bool]]] = {
    "rust": [
        (r"\bmod\s+(\w+)\s*(?=\{)", "module", True), (r"\bstruct\s+(\w+)", "struct", False), (r"\benum\s+(\w+)", "enum", False), (r"\btrait\s+(\w+)", "trait", True),
        (r"\bfn\s+(\w+)", "function", True), (r"\bimpl\b(?:\s*<[^{;]*?>)?\s+(?:[\w:<>', &]+?\s+for\s+)?(?:&\s*)?((?:\w+::)*\w+)[^{;]*(?=\{)", "impl", True),
    ],
    "typescript": [
        (r"\bfunction\s*\*?\s*([\w$]+)", "function", True), (r"\bclass\s+([\w$]+)", "class", True), (r"\binterface\s+([\w$]+)", "interface", False), (r"\benum\s+([\w$]+)", "enum", False),
        (r"\btype\s+([\w$]+)(?:\s*<[^=]*>)?\s*=", "type-alias", False), (r"\bconst\s+([\w$]+)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^)\n]*\)|[\w$]+)\s*(?::[^=\n]+)?=>", "function", True),
    ],
    "go": [
        (r"^func\s+\(\s*\w*\s*\*?(?P<owner>\w+)[^)]*\)\s*(\w+)", "method", True), (r"^func\s+(\w+)", "function", True),
        (r"^\s*(?:type\s+)?(\w+)\s+struct\b", "struct", False), (r"^\s*(?:type\s+)?(\w+)\s+interface\b", "interface", False),
    ],
    "java": [
        (r"@interface\s+(\w+)", "annotation", True), (r"\bclass\s+(\w+)", "class", True), (r"(?<!@)\binterface\s+(\w+)", "interface", True), (r"\benum\s+(\w+)", "enum", True),
        (r"^[ \t]*(?:(?:public|protected|private|static|final|abstract|synchronized|default)\s+)+(?:<[^>]+>\s*)?[\w<>\[\], .?]+\s+(\w+)\s*\((?=[^;{]*[;{])", "method", True),
        (r"^[ \t]*(?:public|protected|private)\s+(\w+)\s*\((?=[^;{]*\{)", "constructor", True),
        (r"^[ \t]*(?:(?:public|protected|private|static|final|volatile|transient)\s+)+[\w<>\[\], .?]+\s+(\w+)\s*(?:=[^;]*)?;", "field", False),
    ],
}
_CALL = re.compile(r"(?<![\w.:])((?:[A-Za-z_$][\w$]*(?:::|\.))*[A-Za-z_$][\w$]*)(?:::<[^()]*>)?!?\s*\(")
_NO_CALL = {"if", "for", "while", "match", "switch", "return", "catch", "fn", "func", "function", "new", "in", "as", "await", "typeof", "super", "constructor", "else", "loop", "move", "import", "Some", "Ok", "Err", "None"}
_SCANNERS = {lang: re.compile("|".join([*(f"(?P<d{i}>{p.replace('?P<owner>', f'?P<owner{i}>')})" for i, (p, _, _) in enumerate(ds)), r"(?P<open>\{)", r"(?P<close>\})", r"(?P<semi>;)"]), re.M) for lang, ds in _DECLARE.items()}


def _parse_braces(text: str, path: str, language: str) -> Parsed:
    out, module = Parsed(), module_of(path)
    bare = _BLANK[language].sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    lines = [0, *(m.end() for m in re.finditer("\n", bare))]

    def line_at(pos: int) -> int:
        import bisect

        return bisect.bisect_right(lines, pos)

    if language == "go":
        p = PurePosixPath(path)
        module = "::".join(x for x in p.parts[:-1] if x not in ("src", "/")) or "root"
    stack: list[tuple[str, str] | None] = []
    waiting: tuple[str, str] | None = None
    spans: list[tuple[int, int, str]] = []
    begun: list[int] = []
    since = 0  # what stands before a declaration begins after the brace, semicolon or declaration before it
    for m in _SCANNERS[language].finditer(bare):
        if m["open"]:
            stack.append(waiting)
            begun.append(m.start())
            waiting, since = None, m.end()
        elif m["close"]:
            since = m.end()
            if stack:
                top, at = stack.pop(), begun.pop()
                if top and top[1] in ("function", "method", "constructor"):
                    spans.append((at, m.start(), top[0]))
        elif m["semi"]:
            waiting, since = None, m.end()
        else:
            i = next(k for k in range(len(_DECLARE[language])) if m[f"d{k}"] is not None)
            _, sub, owns = _DECLARE[language][i]
            name = next(g for g in reversed(m.groups()[: _group_end(language, i)]) if g)
            owner = next((x[0] for x in reversed(stack) if x), module)
            if language == "go" and sub == "method":
                owner = f"{module}::{m[f'owner{i}']}"
            if sub == "impl":
                waiting = (f"{module}::{name.rsplit('::', 1)[-1]}" if "::" not in name else name, "impl")
                head = m[0]
                t = re.search(r"impl\b(?:\s*<[^{;]*?>)?\s+([\w:]+)(?:<[^{;]*?>)?\s+for\s", head)
                if t:
                    out.relation(waiting[0], t[1], "implements")
                    made = re.search(r"\b(From|TryFrom)\s*<\s*([^{;]*?)\s*>\s+for\s", head)
                    if made and (source := plain_type(made[2])):
                        out.item(f"{waiting[0]}::{made[1]}<{source}>", "impl", source, line_at(m.start()), trait=made[1], impl_for=waiting[0].rsplit("::", 1)[-1])
                continue
            inside = next((x for x in reversed(stack) if x), None)
            if inside and inside[1] in ("function", "method", "constructor") and sub in ("function", "type-alias"):
                if owns:
                    waiting = None
                continue
            qn = f"{owner}::{name}"
            is_method = sub == "function" and inside is not None and inside[1] in ("impl", "trait", "class")
            out.item(qn, "method" if is_method and language != "rust" else sub, owner, line_at(m.start()), _tags(language, bare[since : m.start()], name, path), signature=_signature(language, bare, m.end()) if sub in ("function", "method", "constructor") else None)
            if language in ("typescript", "java") and sub in ("class", "interface"):
                opens = bare.find("{", m.end())
                head = bare[m.end() : opens if opens >= 0 else len(bare)]
                for word, rel in (("extends", "extends"), ("implements", "implements")):
                    if h := re.search(rf"\b{word}\s+([\w$., <>]+?)(?=\bimplements\b|$)", head):
                        for t in re.sub(r"<[^<>]*>", "", h[1]).split(","):
                            if t.strip():
                                out.relation(qn, t.strip().replace(".", "::"), rel)
            waiting = (qn, sub) if owns or sub in ("struct", "enum", "interface") else waiting
    for a, b, owner in spans:
        for c in _CALL.finditer(bare, a, b):
            if c[1].split("::")[-1].split(".")[-1] not in _NO_CALL:
                out.relation(owner, c[1].replace(".", "::"), "calls")
    for target in _imports(language, bare, text, module):
        out.relation(module, target, "depends")
    return out.typed(module, _imported(text, module) if language == "typescript" else None)


def _imported(text: str, module: str) -> dict[str, str]:
    """Qualified names of the names that a script imports from files of its package."""
    out = {}
    for names, target in re.findall(r"\bimport\s+(?:type\s+)?(?:[\w$]+\s*,\s*)?\{([^}]*)\}\s*from\s*['\"](\.[^'\"]+)['\"]", text):
        base = "::".join([module.split("::")[0], *re.sub(r"^(\.{1,2}/)+", "", re.sub(r"\.(tsx?|jsx?|svelte)$", "", target)).split("/")])
        for n in names.split(","):
            first, _, last = n.strip().removeprefix("type ").partition(" as ")
            if first:
                out[(last or first).strip()] = f"{base}::{first.strip()}"
    return out


def _group_end(language: str, i: int) -> int:
    """Capture groups up to the end of the i-th declaration."""
    return sum(re.compile(p).groups + 1 for p, _, _ in _DECLARE[language][: i + 1])


def _tags(language: str, before: str, name: str, path: str) -> list[str]:
    """before: the text between the end of what stands before the declaration and its keyword."""
    test = (
        (language == "rust" and re.search(r"#\[(?:\w+::)*test\b[^\]]*\]\s*(?:pub\s+)?(?:async\s+)?$", before))
        or (language == "typescript" and re.search(r"\.(?:test|spec)\.|__tests__", path))
        or (language == "go" and path.endswith("_test.go") and re.match("Test|Benchmark|Example|Fuzz", name))
        or (language == "java" and ("src/test/java" in path or re.search(r"@(?:Test|ParameterizedTest|BeforeEach|AfterEach)\b[^{;]*$", before)))
    )
    out = ["test"] if test else []
    if language == "typescript" and re.search(r"\bexport\s+(?:default\s+)?(?:abstract\s+|async\s+|declare\s+)*$", before):
        out.append("exported")
    return out


def _imports(language: str, bare: str, text: str, module: str) -> Iterator[str]:
    if language == "rust":
        for m in re.finditer(r"\buse\s+([\w:]+)(?:::\{([^}]*)\})?", bare):
            base = m[1].rstrip(":")
            for leaf in m[2].split(",") if m[2] else [""]:
                leaf = leaf.split(" as ")[0].strip()
                yield f"{base}::{leaf}" if leaf and leaf not in ("self", "*") else base
    elif language == "typescript":
        for m in re.finditer(r"\b(?:import|export)\b[^;'\"`]*?from\s*['\"]([^'\"]+)['\"]|\bimport\s*['\"]([^'\"]+)['\"]", text):
            target = m[1] or m[2]
            if target.startswith("."):
                package = module.split("::")[0]
                yield "::".join([package, *re.sub(r"^(\.{1,2}/)+", "", re.sub(r"\.(tsx?|jsx?|svelte)$", "", target)).split("/")])
    elif language == "go":
        for block, single in re.findall(r"\bimport\s*(?:\(([^)]*)\)|(?:[\w.]+\s+)?\"([^\"]+)\")", text):
            for target in re.findall(r"\"([^\"]+)\"", block) if block else [single]:
                yield target.replace("/", "::")
    elif language == "java":
        for m in re.finditer(r"^\s*import\s+(?:static\s+)?([\w.]+)(?:\.\*)?\s*;", bare, re.M):
            yield m[1].replace(".", "::")


def script_blocks(text: str) -> list[tuple[str, int, bool]]:
    """(content, line offset, is module script) of the script blocks of a component file."""
    return [(m[2], text.count("\n", 0, m.start(2)), bool(re.search(r"\bmodule\b|context=[\"']module", m[1]))) for m in re.finditer(r"<script\b([^>]*)>([\s\S]*?)</script>", text)]


def parse_svelte(text: str, path: str) -> Parsed:
    out = Parsed()
    module = module_of(path)
    out.item(module, "component", module.rpartition("::")[0], 1)
    out.typed(module)
    for content, offset, _ in script_blocks(text):
        p = _parse_braces(content, path, "typescript")
        for i in p.items:
            i["line"] += offset
        out.items += p.items
        out.relations += p.relations
    return out


PARSERS: dict[str, Callable[[str, str], Parsed]] = {
    "py": parse_python,
    "svelte": parse_svelte,
    **{ext: (lambda t, p, lang=lang: _parse_braces(t, p, lang)) for ext, lang in (("rs", "rust"), ("ts", "typescript"), ("tsx", "typescript"), ("go", "go"), ("java", "java"))},
}
LANGUAGE_OF = {"py": "python", "svelte": "svelte", "rs": "rust", "ts": "typescript", "tsx": "typescript", "go": "go", "java": "java"}


def parse_files(files: DataFrame, parsers: dict[str, Callable[[str, str], Parsed]] | None = None) -> tuple[DataFrame, DataFrame]:
    """items and relations of files (path, content). Each file is parsed once, in Arrow batches; what is found is written, then split."""
    table = PARSERS if parsers is None else parsers

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in OUT_SCHEMA.split(", ")]
        for b in batches:
            rows = []
            for path, text in zip(b["path"], b["content"], strict=True):
                ext = path.rsplit(".", 1)[-1] if path else ""
                if not text or ext not in table:
                    continue
                p = table[ext](text, path)
                lang = LANGUAGE_OF.get(ext, ext)
                rows += [("item", path, i["qualified_name"], i["kind"], i["sub_kind"], i["name"], i["parent"], lang, f"{path}:{i['line']}", i["tags"], i.get("metadata"), None, None) for i in p.items]
                rows += [("relation", path, None, r["kind"], None, None, None, lang, None, None, None, r["source"], r["target"]) for r in p.relations]
            yield pd.DataFrame(rows, columns=columns)

    both = write_table(files.select("path", "content").mapInPandas(run, OUT_SCHEMA), "parsed")
    items = both.filter("part = 'item'").select("path", "qualified_name", "kind", "sub_kind", "name", "parent", "language", "source_ref", "tags", "metadata")
    relations = both.filter("part = 'relation'").select("path", "source", "target", "kind")
    return items, relations


def metrics(text: str) -> dict[str, int]:
    """Size measures of a source text: lines, lines of code, comment lines, branches."""
    lines = text.splitlines()
    code = [x for x in lines if x.strip()]
    comments = [x for x in code if re.match(r"\s*(//|#|/\*|\*)", x)]
    branches = len(re.findall(r"\b(?:if|for|while|case|catch|except|elif|match)\b|&&|\|\||\?(?!\.)", text))
    return {"sloc": len(lines), "ploc": len(code) - len(comments), "cloc": len(comments), "cyclomatic": branches + 1}


def file_metrics(files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(p, *metrics(t or "").values()) for p, t in zip(b["path"], b["content"], strict=True)], columns=["path", "sloc", "ploc", "cloc", "cyclomatic"])

    return files.select("path", "content").mapInPandas(run, "path string, sloc long, ploc long, cloc long, cyclomatic long")


def counting_files(source_files: DataFrame) -> DataFrame:
    """path, content of the latest delivery per file."""
    f = source_files.filter("file_id is not null and content is not null and path is not null")
    return f.groupBy("file_id").agg(F.max_by(F.struct("path", "content"), "loaded_at").alias("f")).select("f.*")
