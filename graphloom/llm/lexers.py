"""Lexers: source text to token ids of a grammar. A text that cannot be split into tokens gives None."""

from __future__ import annotations

import io
import re
import tokenize

from graphloom.llm.gll import END, NL, Grammar


class LexError(ValueError):
    """The text has a part that is no token, such as an open string or comment."""


_RUST = re.compile(
    r"""(?P<ws>[\s‎‏  ]+|//[^\n]*)
|(?P<open>/\*)
|(?P<raw>(?:br|cr|r)(?P<h>\#*)"[\s\S]*?"(?P=h))
|(?P<str>(?:[bc]?)"(?:[^"\\]|\\[\s\S])*")(?:[A-Za-z_]\w*)?
|(?P<chr>b?'(?:[^'\\\n\r\t]|\\(?:[nrt\\0'"]|x[0-9A-Fa-f]{2}|u\{[0-9A-Fa-f_]{1,8}\}))')
|(?P<life>'(?:r\#)?[^\W\d]\w*)(?!')
|(?P<num>0x[0-9A-Fa-f_]*[0-9A-Fa-f][0-9A-Za-z_]*|0b[01_]*[01][01A-Za-z_]*|0o[0-7_]*[0-7][0-7A-Za-z_]*|\d[\d_]*(?:\.(?![.\w])|\.\d[\d_]*)?(?:[eE][+-]?_*\d[\d_]*)?(?:_*(?:[iu](?:8|16|32|64|128|size)|f32|f64))?)(?!\w)
|(?P<id>(?:r\#)?[^\W\d]\w*)
|(?P<op>\.\.\.|\.\.=|::|->|=>|\.\.|&&|\|\||\+=|-=|\*=|/=|%=|\^=|&=|\|=|==|!=|[-+*/%^!&|=<>@.,;:\#$?~(){}\[\]])""",
    re.X,
)
_NEST = re.compile(r"/\*|\*/")
#: Lines whose tokens are kept at most.
_KEPT = 200_000


def _by_line(text: str, lex, g: Grammar) -> list[int]:
    """Tokens of a text none of whose tokens may cross a line, with those of every line kept; LexError if one does."""
    kept = g.lines
    if len(kept) > _KEPT:
        kept.clear()
    out: list[int] = []
    for line in text.split("\n"):
        found = kept.get(line)
        if found is None:
            found = kept[line] = lex(line, g)
        out += found
    return out


_RAW = re.compile(r'r#*"')


def rust(text: str, g: Grammar) -> list[int]:
    i = 1 if text.startswith("﻿") else 0
    if text.startswith("#!", i) and not re.match(r"#!\s*\[", text[i:]):
        i = (text.find("\n", i) + 1) or len(text)
    text = text[i:]
    if not _RAW.search(text):
        # A string or comment that crosses a line is an error in its first line alone; then the text is read as a whole.
        try:
            return [*_by_line(text, _rust, g), g.ids[END]]
        except LexError:
            pass
    return [*_rust(text, g), g.ids[END]]


def _rust(text: str, g: Grammar) -> list[int]:
    ids, other, out, i, n = g.ids, g.other, [], 0, len(text)
    lit, life, ident, match = ids["LIT"], ids["LIFETIME"], ids["IDENT"], _RUST.match
    while i < n:
        m = match(text, i)
        if m is None:
            raise LexError(i)
        kind, end = m.lastgroup, m.end()
        if kind == "h":
            kind = "raw"
        if kind == "open":
            depth = 1
            while depth:
                c = _NEST.search(text, end)
                if c is None:
                    raise LexError(i)
                depth += 1 if c[0] == "/*" else -1
                end = c.end()
        elif kind == "id":
            w = m["id"]
            out.append(ids.get(w, ident))
        elif kind == "op":
            w = m["op"]
            if w in "<>" and text[end : end + 1] in (w, "="):
                w = "J" + w
            out.append(ids.get(w, other))
        elif kind == "life":
            out.append(life)
        elif kind != "ws":
            out.append(lit)
        i = end
    return out


_GO = re.compile(
    r"""(?P<ws>[ \t\r]+|//[^\n]*)
|(?P<nl>\n)
|(?P<com>/\*[\s\S]*?\*/)
|(?P<str>"(?:[^"\\\n]|\\(?:[abfnrtv\\"]|[0-7]{3}|x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}))*"|`[^`]*`)
|(?P<chr>'(?:[^'\\\n]|\\(?:[abfnrtv\\']|[0-7]{3}|x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}))')
|(?P<num>(?:0[xX][0-9A-Fa-f_]+(?:\.[0-9A-Fa-f_]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*)(?:\.[\d_]*)?(?:[eE][+-]?\d+)?|\.\d[\d_]*(?:[eE][+-]?\d+)?)i?)(?!\w)
|(?P<id>[^\W\d]\w*)
|(?P<op>\.\.\.|&\^=|<<=|>>=|&\^|<<|>>|<-|\+\+|--|:=|&&|\|\||\+=|-=|\*=|/=|%=|\^=|&=|\|=|==|!=|<=|>=|[-+*/%^!&|=<>.,;:~(){}\[\]])""",
    re.X,
)
_GO_ENDS = {"break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"}


def go(text: str, g: Grammar) -> list[int]:
    text = text.removeprefix("﻿")
    if "/*" not in text:
        # A string that crosses a line is an error in its first line alone; then the text is read as a whole.
        try:
            return [*_by_line(text, _go, g), g.ids[END]]
        except LexError:
            pass
    return [*_go(text, g), g.ids[END]]


def _go(text: str, g: Grammar) -> list[int]:
    ids, other, out, i, n = g.ids, g.other, [], 0, len(text)
    semi, number, string, char, ident, match = ids[";"], ids["NUMBER"], ids["STRING"], ids["CHAR"], ids["IDENT"], _GO.match
    ends = False
    while i < n:
        m = match(text, i)
        if m is None:
            raise LexError(i)
        kind, i = m.lastgroup, m.end()
        if kind == "ws":
            continue
        if kind == "nl" or (kind == "com" and "\n" in m["com"]):
            if ends:
                out.append(semi)
            ends = False
        elif kind == "id":
            w = m["id"]
            t = ids.get(w, ident)
            out.append(t)
            ends = t == ident or w in _GO_ENDS
        elif kind == "op":
            w = m["op"]
            out.append(ids.get(w, other))
            ends = w in _GO_ENDS
        elif kind != "com":
            out.append(number if kind == "num" else string if kind == "str" else char)
            ends = True
    if ends:
        out.append(semi)
    return out


_JS = re.compile(
    r"""(?:[^\S\n\r  ]+|﻿)?(?:(?P<nl>[\n\r  ]+)
|(?P<line>//[^\n\r  ]*|<!--[^\n\r]*)
|(?P<com>/\*[\s\S]*?\*/)
|(?P<str>"(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*')
|(?P<num>(?:0[xX][0-9A-Fa-f_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|\d[\d_]*n|(?:\d[\d_]*)(?:\.[\d_]*)?(?:[eE][+-]?\d[\d_]*)?|\.\d[\d_]*(?:[eE][+-]?\d[\d_]*)?))(?![\w$])
|(?P<id>(?:[^\W\d]|\$|\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]+\})(?:[\w$‌‍]|\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]+\})*)
|(?P<priv>\#(?:[^\W\d]|\$)[\w$]*)
|(?P<op>\.\.\.|===|!==|\*\*=|&&=|\|\|=|\?\?=|=>|==|!=|\+\+|--|\*\*|&&|\|\||\?\?|\?\.(?!\d)|\+=|-=|\*=|%=|&=|\|=|\^=|[-+*%&|^!~?:=.,;<>@(){}\[\]])
|(?P<slash>/)
|(?P<tick>`)
|(?P<ws>[^\S\n\r  ]+|﻿))""",
    re.X,
)
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[A-Za-z]*")
_TPL = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
_XNAME = re.compile(r"[^\W\d][\w$]*(?:-[\w]+)*")
_XSPACE = re.compile(r"(?:\s|//[^\n]*|/\*[\s\S]*?\*/)+")
#: Words after which a value begins, so a slash opens a regular expression there.
_BEFORE_VALUE = {"return", "typeof", "case", "do", "else", "in", "of", "instanceof", "new", "delete", "void", "throw", "await", "yield", "default", "extends"}
#: Words that with the next one open a declaration where an expression could begin with the word alone: 'Jasync', 'Jlet'.
_AHEAD = {"async": re.compile(r"(?:[^\S\n\r\u2028\u2029]|/\*[^\n\r]*?\*/)+function(?![\w$])"), "let": re.compile(r"(?:\s|//[^\n]*|/\*[\s\S]*?\*/)*\[")}


def _js(text: str, g: Grammar, elements: bool) -> list[int]:
    ids, other, out, n = g.ids, g.other, [], len(text)
    i = (text.find("\n") + 1 or n) if text.startswith("#!") else 0
    ident, string, number, regex, private = ids["IDENT"], ids["STRING"], ids["NUMBER"], ids["REGEX"], ids["PRIVATE"]
    match, nl, value, prev = _JS.match, 0, True, ""  # value: a value may begin here
    braces: list[tuple[str, bool]] = []  # (what the brace closes, a value may follow)
    inside = ""  # of elements: 'tag', 'children'
    stack: list[str] = []

    def put(t: int) -> None:
        nonlocal nl
        out.append(t | nl)
        nl = 0

    while i < n:
        if inside == "children":
            j = i
            while j < n and text[j] not in "{<":
                if text[j] in ">}":
                    raise LexError(j)
                j += 1
            if j > i:
                put(ids["XTEXT"])
            if j >= n:
                raise LexError(j)
            if text[j] == "{":
                put(ids["{"])
                braces.append(("children", False))
                inside, value, prev, i = "", True, "{", j + 1
            elif text.startswith("</", j):
                put(ids["X</"])
                stack.append("close")
                inside, i = "tag", j + 2
            else:
                put(ids["X<"])
                stack.append("open")
                inside, i = "tag", j + 1
            continue
        if inside == "tag":
            if m := _XSPACE.match(text, i):
                i = m.end()
                continue
            if m := _XNAME.match(text, i):
                put(ids["XNAME"])
                i = m.end()
            elif text.startswith("/>", i):
                put(ids["X/>"])
                stack.pop()
                i += 2
                inside, value, prev = _outside(stack), False, ")"
            elif text[i] == ">":
                put(ids["X>"])
                i += 1
                if stack.pop() == "open":
                    stack.append("children")
                    inside = "children"
                else:
                    if not stack or stack.pop() != "children":
                        raise LexError(i)
                    inside, value, prev = _outside(stack), False, ")"
            elif text[i] in "\"'":
                j = text.find(text[i], i + 1)
                if j < 0:
                    raise LexError(i)
                put(string)
                i = j + 1
            elif text[i] == "{":
                put(ids["{"])
                braces.append(("tag", False))
                inside, value, prev, i = "", True, "{", i + 1
            elif text[i] in "=.:":
                put(ids[text[i]])
                i += 1
            elif text[i] == "<":
                put(ids["X<"])
                stack.append("open")
                i += 1
            else:
                raise LexError(i)
            continue
        m = match(text, i)
        if m is None:
            raise LexError(i)
        kind, end = m.lastgroup, m.end()
        if kind == "id":
            w = m["id"]
            ahead = _AHEAD.get(w) if prev not in (".", "?.") else None
            out.append((ids["J" + w] if ahead and ahead.match(text, end) else ids.get(w, ident)) | nl)
            nl = 0
            value = w in _BEFORE_VALUE and prev != "."
            prev = w
        elif kind == "op":
            w = m["op"]
            if w == "{":
                # A brace that opens a value is closed by one after which no value begins.
                braces.append(("block", not (value and prev in ("(", ",", "=", "[", "?", "return", "&&", "||", "??", "=>", ":", "+", "...", "typeof")) or prev == "=>"))
                put(ids[w])
                value = True
            elif w == "}":
                if not braces:
                    raise LexError(i)
                what, after = braces.pop()
                if what == "tpl":
                    tail = _TPL.match(text, end)
                    end = tail.end()
                    if text.startswith("`", end):
                        put(ids["TPL_TAIL"])
                        value, prev, end = False, "`", end + 1
                    elif text.startswith("${", end):
                        put(ids["TPL_MID"])
                        braces.append(("tpl", False))
                        value, prev, end = True, "{", end + 2
                    else:
                        raise LexError(i)
                    i = end
                    continue
                put(ids[w])
                if what in ("tag", "children"):
                    inside, i = what, end
                    continue
                value = after
            elif w == "<" and elements and value and re.match(r"[A-Za-z_$>]", text[end : end + 1] or "") and not re.match(r"(?:const\s+)?[\w$]+\s*(?:,|extends\b)", text[end : end + 80]):
                put(ids["X<"])
                stack.append("outside")
                stack.append("open")
                inside, i = "tag", end
                continue
            else:
                if w in "<>" and text[end : end + 1] in (w, "="):
                    w = "J" + w
                out.append(ids.get(w, other) | nl)
                nl = 0
                value = w not in (")", "]", "++", "--") and not (w == "!" and not value)
            prev = w
        elif kind in ("ws",):
            pass
        elif kind == "nl" or kind == "line":
            if kind == "nl":
                nl = NL
        elif kind == "com":
            if "\n" in m["com"] or "\r" in m["com"]:
                nl = NL
        elif kind == "slash":
            if value:
                r = _REGEX.match(text, m.start(kind))
                if r is None:
                    raise LexError(i)
                put(regex)
                value, prev, end = False, "/", r.end()
            else:
                if text.startswith("=", end):
                    put(ids["/="])
                    end += 1
                else:
                    put(ids["/"])
                value, prev = True, "/"
        elif kind == "tick":
            body = _TPL.match(text, end)
            end = body.end()
            if text.startswith("`", end):
                put(ids["TPL"])
                value, prev, end = False, "`", end + 1
            elif text.startswith("${", end):
                put(ids["TPL_HEAD"])
                braces.append(("tpl", False))
                value, prev, end = True, "{", end + 2
            else:
                raise LexError(i)
        else:
            put(string if kind == "str" else number if kind == "num" else private)
            value, prev = False, kind
        i = end
    if inside or any(b[0] == "tpl" for b in braces):
        raise LexError(n)
    out.append(ids[END] | nl)
    return out


def _outside(stack: list[str]) -> str:
    """Where an ended element stands: back among children, in a tag, or in code."""
    if stack and stack[-1] == "children":
        return "children"
    if stack and stack[-1] == "outside":
        stack.pop()
        return ""
    return "tag" if stack else ""


def ts(text: str, g: Grammar) -> list[int]:
    return _js(text, g, False)


def tsx(text: str, g: Grammar) -> list[int]:
    return _js(text, g, True)


_PY = {tokenize.NAME: "NAME", tokenize.NUMBER: "NUMBER", tokenize.STRING: "STRING", tokenize.NEWLINE: "NEWLINE", tokenize.INDENT: "INDENT", tokenize.DEDENT: "DEDENT"}
_PY |= {getattr(tokenize, "FSTRING_START", -1): "FSTART", getattr(tokenize, "FSTRING_MIDDLE", -2): "FMID", getattr(tokenize, "FSTRING_END", -3): "FEND"}
_PY_SKIP = {tokenize.COMMENT, tokenize.NL, tokenize.ENDMARKER}
_KEYWORDS = frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())


#: Decimal integers must not begin with a zero unless they are zero.
_OCTAL_LIKE = re.compile(r"0[0-9_]*[1-9][0-9_]*\Z")


def python(text: str, g: Grammar) -> list[int]:
    if "\0" in text:
        raise LexError(text.index("\0"))
    ids, other, out = g.ids, g.other, []
    kinds = {k: ids[v] for k, v in _PY.items()}
    name, op = tokenize.NAME, tokenize.OP
    text = text.replace("\r\n", "\n").replace("\r", "\n")  # every line end ends a line, as in universal newlines
    try:
        for t in tokenize.generate_tokens(io.StringIO(text.removeprefix("﻿")).readline):
            k = t.type
            if k == name:
                if not t.string.isidentifier():
                    raise LexError(t.start)
                out.append(ids.get(t.string, kinds[k]))
            elif k == op:
                out.append(ids.get(t.string, other))
            elif k in _PY_SKIP:
                continue
            elif k == tokenize.NUMBER and _OCTAL_LIKE.match(t.string):
                raise LexError(t.start)
            else:
                out.append(kinds.get(k, other))
    except (tokenize.TokenError, SyntaxError) as e:
        raise LexError(str(e)) from e
    out.append(ids[END])
    return out
