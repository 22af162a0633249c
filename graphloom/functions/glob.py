"""Globs over canonical paths, compiled to anchored regular expressions once, on the driver."""

from __future__ import annotations

import re


def glob_to_regex(pattern: str) -> str:
    out, i, depth = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out.append("(?:[^/]+/)*")
            i += 3
            continue
        if pattern.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            inside = pattern[i + 1 : end]
            out.append("[" + ("^" + inside[1:] if inside[0] in "!^" else inside).replace("\\", "\\\\") + "]")
            i = end
        elif c == "{":
            out.append("(?:")
            depth += 1
        elif c == "}" and depth:
            out.append(")")
            depth -= 1
        elif c == "," and depth:
            out.append("|")
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + r"\z"
