"""Generalised LL recognition, and what each language's grammar takes and rejects."""

import itertools

import pytest

from graphloom.llm import lexers, parsing
from graphloom.llm.gll import END, Grammar

GOOD = {
    "rs": [
        "", "// only a comment", "#!/usr/bin/env x\nfn main() {}", "use a::{b, c::*, self as d};", 'fn f<T: A + \'static, const N: usize>(x: &mut [T; N]) -> Result<Vec<Vec<T>>, E> where T: B { x[1..=2].iter().map(|v| v * 2).collect::<Vec<_>>()?; if let Some(y) = z && y > 1 { return Ok(()) } else { loop { break \'a; } } }',
        'const S: &str = r#"} "quoted" {"#; static C: char = \'{\'; const B: &[u8] = b"\\x00";', "/* outer /* nested { */ still */ struct A<'a> { x: &'a str, pub(crate) y: (u8, i8) } struct T(pub u8, u8); struct U;",
        "enum E { A, B(u8), C { x: u8 } = 3 }\nimpl<T> Tr for E where T: X { type O = T; const K: u8 = 1; fn f(&self, mut a: u8) -> impl Fn(u8) -> u8 + '_ { move |x| x + a } }",
        "macro_rules! m { ($x:expr) => { $x + 1 }; }\nm!{ anything { goes } [here] }\nfn g() { m!(1); vec![1, 2]; let x = match a { 1 | 2 => 3, n if n > 4 => { 5 } _ => 6, }; }",
        "async fn a() { b().await?; } trait T: Send { fn d(&self) where Self: Sized; } unsafe extern \"C\" { fn c(x: *const u8, ...); }", "fn async() {}", "fn f() { let a = b << 2 >> 1; let c = (x as u64) < y; a >>= 1; let P { x, .. } = p; for (i, _) in v.iter().enumerate() {} }",
        "#![allow(x)]\n#[derive(A, B)]\n#[cfg(test)]\nmod t { use super::*; #[test] fn x() { assert_eq!(1, 2); } }",
    ],
    "go": [
        "", "package a", "package a\n\nimport (\n\t\"fmt\"\n\tx \"a/b\"\n)\n\nvar _ = fmt.Sprint\n", "package a\nfunc f(x, y int, z ...string) (a int, err error) {\n\tif v, ok := m[x]; ok && v > 1 {\n\t\treturn v, nil\n\t} else if x == (T{1}).y {\n\t}\n\tfor i := 0; i < 3; i++ {\n\t}\n\tfor range ch {\n\t}\n\tfor k, v := range m {\n\t\t_ = k\n\t}\n\treturn\n}",
        "package a\ntype T struct {\n\tA, B int `json:\"a\"`\n\t*E\n\tpkg.F\n}\ntype I interface {\n\tM(int) string\n\t~int | ~string\n}\ntype G[K comparable, V any] struct{ m map[K]V }\nfunc (g *G[K, V]) Get(k K) V { return g.m[k] }\nvar x = G[string, int]{m: map[string]int{\"a\": 1}}",
        "package a\nfunc f() {\n\tswitch x := y.(type) {\n\tcase int, *T:\n\t\tfallthrough\n\tdefault:\n\t}\n\tselect {\n\tcase v := <-ch:\n\tcase ch <- 1:\n\tdefault:\n\t}\n\tgo func() { defer close(ch) }()\nL:\n\tbreak L\n\tswitch {\n\t}\n\tswitch len(x) {\n\tcase 1:\n\t\treturn 'a'\n\t}\n}",
        "package a\nvar s = []string{\"}\", `raw\n{`}\nvar m = [...]T{{1, 2}, {3: 4}}\nconst (\n\tA = iota\n\tB\n)\nvar f func(int) <-chan int = nil\nvar y = x[1:2:3]\n",
    ],
    "ts": [
        "", "import a, { b as c, type D } from './x';\nimport * as e from \"y\";\nexport * from 'z';\nexport { f, g as default };", "export default class A<T extends B = C> extends D<T> implements E, F { private readonly x?: number = 1; static #p = 2; constructor(private y: string) { super(); } get z(): number { return 1 } async *gen(): AsyncGenerator<T> { yield* x; } [key: string]: any; }",
        "const f = async <T,>(x: T, ...rest: string[]): Promise<T> => { await x; return x as T; };\nlet g = (a, b) => a + b, h = x => ({ y: x });", "type A = { readonly [K in keyof T]?: T[K] } & ('a' | `b${string}`) | ((x: number) => void);\ntype B<T> = T extends (infer U)[] ? U : never;\ninterface I extends J { (x: number): string; new (y: string): I; m?(): void; [k: string]: unknown }",
        "const re = /[{}]\\/\\*/g\nconst t = `a ${b ? `c ${d}` : 'e'} f`\nlet x = a / b / c\nif (a) b()\nelse c()\nfor (const [k, v] of m) { continue }\nfor (let i = 0, n = 3; i < n; i++) {}\nlabel: while (true) break label\nx ??= y?.z?.[0]?.(1)!\n",
        "!function(a){a.b={c:1,d:!1}}(globalThis);if(typeof x!==\"undefined\"&&2>0)void 0;var q=function(n){for(var i=0,o=[];i<n.length;i++)o.push(n[i]^67);return o};", "declare module 'm' { export function f(x: number): asserts x is 3; }\nnamespace N.M { enum E { A = 1, B } }\nabstract class C { abstract m(): void; @dec() p = 1; }\nlet v = <number>w;\nfunction over(x: string): void;\nfunction over(x: any) {}\ntry { } catch { } finally { }\nconst o = { a, 'b': 1, [c]: 2, d() {}, get e() { return 1 }, async f() {}, ...g };\nlet { h, ...i } = o, [j, , k = 2] = l;",
        "let a = b < c, d = e > (f);\nlet m = new Map<string, Array<number>>();\nx = y as unknown as Z;\nlet fn: (this: Window) => void;\nexport type { Q } from 'q';\nimport r = require('r');\nlet big = 10n, n = 1_000.5e3;\nswitch (x) { case 1: case 2: y(); default: }\n",
    ],
    "tsx": ["const a = (p: P) => (\n  <section title=\"x\" data-depth={p.d} {...rest}>\n    {p.rows.map((r) => <b key={r.id}>{r.name}: don't { /* c */ } merge</b>)}\n    <A.B /> <></>\n  </section>\n);\nconst b = x < y;\nconst f = <T,>(x: T) => x;"],
    "py": [
        "", "x = 1", "def f(a, /, b=1, *c, d: int = 2, **e) -> str:\n    return f'{a!r:>{b}} {c=}'\n", "async def g():\n    async with a as b, c:\n        async for x in y:\n            await z\n    return [i async for i in j if k]\n", "class A(B, metaclass=C):\n    '''doc'''\n    x: int = 0\n    @property\n    def y(self): return lambda *a, k=1: a\n",
        "match x:\n    case [1, *rest] | {'a': b, **c}: pass\n    case A(x=1, y=-2) as d if e: pass\n    case _: pass\n", "try:\n    pass\nexcept* (A, B) as e:\n    raise X from e\nelse:\n    pass\nfinally:\n    pass\n", "a = b, *c = d\nx[1:2, ::3], y.z = 1, 2\ndel a, (b, c[0])\nprint(*a, **b, c=1)\ntype X[T] = list[T]\nmatch = case = type = 1\nif (n := 1) > 0: pass\nwith (open(a) as f, open(b) as g,): pass\ns = 'a' \"b\" r'\\c'\nd = {**a, 'b': 1}\ne = {i for i in j}\n",
        "x = 1\r\nif x:\r\n    y = 2\r\n", "global x; nonlocal y\n",
    ],
}
BAD = {
    "rs": ["fn f() {", "fn f(( a: u8) {}", "fn % f() {}", "pub fn 9x() {}", "<<<<<<< ours\nfn f() {}\n=======\nfn g() {}\n>>>>>>> theirs\n", "fn f() { let x = ; }", "/* open", 'const S: &str = "open;', "fn f() {}}", "struct A { x u8 }", "def f(x):\n    return 1\n", '{"rows": []}', "use a::b", "const X: &str = “x”;"],
    "go": ["// only\nvar x = 1", "package a\nfunc f() {", "package a\nfunc f() int { return 1 }}", "package a\n=======\nfunc f() {}", "package a\nfunc f(x []T int {}", "package a\nvar s = \"open\n", "package a\n/* open", "package a\nfunc @@ f() {}", "use crate::x;", "package a\nfor {}", "a,b,c\n1,2,3"],
    "ts": ["function f( {", "export function f(( x: number) {}", "const a = ;", "class A { x: }", "<<<<<<< a\nlet x = 1;\n=======\nlet y = 2;\n>>>>>>> b", "let x = 'open\n", "/* open", "const t = `open ${a", "export function % f() {}", "package main\n", '{"rows": [1, 2], "x": 3}', "function f() { return 1 }}", "let a = 1 let b = 2", "if (a { }", "def f():\n    return 1", "a,b c\n0,x y", "const x = “y”;"],
    "tsx": ["const a = <b>text;", "const a = <b></c", "const a = (<b><i></b>;"],
    "py": ["def f(", "def f()\n    pass\n", "def f():\npass\n", "x = = 1\n", "<<<<<<< a\nx = 1\n=======\ny = 2\n>>>>>>> b\n", "'''open", "f() = 1\n", "try:\n    pass\n", "  x = 1\n", "x = “a”\n", "x = 00123\n", "\0", "package main\n", "x = f'{a'\n", "return = 1\n", "a b\n", "def f((a, b)): pass\n", "import\n", "class A\n"],
}


@pytest.mark.parametrize(("ext", "text"), [(e, t) for e, ts in GOOD.items() for t in ts])
def test_valid(ext, text):
    assert not parsing.rejected(ext, text)


@pytest.mark.parametrize(("ext", "text"), [(e, t) for e, ts in BAD.items() for t in ts])
def test_invalid(ext, text):
    assert parsing.rejected(ext, text)


#: Files with one token lost or out of place, by the kind of place it stands in, and valid files with the same forms.
LOST = {
    "rs": ["fn f(x) {}", "fn f(a: u8, b) {}", "impl A { fn f(&self, x) {} }", "extern \"C\" { fn c(x); }", "fn f(a: u8, &self) {}", "fn f() { let y = mut x; }", "fn f() { g(raw x); }", "fn f() { let y = const x; }", "fn f() { a = raw const x; }", "fn f() { g(-mut x); }"],
    "go": ["package a\nfunc f(a int, b) {}", "package a\nfunc f(a, b int, string) {}", "package a\nfunc f() (n int, error) { return }", "package a\nvar f func(a int, b.C)", "package a\nfunc f() { defer mu.Unlock }", "package a\nfunc f() { go func() {} }", "package a\nfunc f() { defer f() + 1 }", "package a\nfunc f() { go <-f() }"],
    "ts": ["function (x) {}", "async function (x) {}", "function* () {}", "export function (x) {}", "class {}", "export class extends B {}", "abstract class {}", "@dec() class {}", "if (a) { function () {} }", "const {a};", "let [a];", "let\n[a];", "var x = 1, {a};", "for (let {a};;) {}", "export const [a, b];"],
    "tsx": ["function (x) { return <b/>; }", "export class {}", "const {a};"],
}
KEPT = {
    "rs": ["trait T { fn f(u8, &str) -> u8; fn g(&self, u8); fn h(self: Box<Self>, x: u8) {} }", "fn f() { let y = &mut x; let z = &raw const x; let w = &raw mut x.y; let raw = &raw; g(&&mut raw, -*&x, raw); }", "fn f() { let y = const { 1 + 2 }; h(const || 1); }", "impl A { fn f(&'a mut self, #[x] (a, b): (u8, u8), mut c: u8,) {} fn g(mut self: Pin<&mut Self>) {} }", "extern \"C\" { fn c(x: *const u8, ...); }", "type F = fn(u8, x: u8) -> u8;", "fn f() { union(raw, safe) }"],
    "go": ["package a\nfunc f(int, ...string) (int, error)", "package a\nfunc f(a, b int, c ...pkg.T) (n int, err error) { return }", "package a\nfunc f(a, b) (c, d)", "package a\nfunc (T) f() {}\nfunc (t *T[K]) g() {}", "package a\nfunc f() { defer mu.Unlock(); go func(x int) {}(1); defer a[1].b(c...)(d); go T{}.f(); defer x.(T).f(); go f[int](1) }", "package a\ntype I interface { M(a []int, b map[string]int) (func(int, string) error) }"],
    "ts": ["export default function (x) {}", "export default async function () {}", "export default class {}", "export default @dec class {}", "const f = function (x) {}, g = async function () {}, h = class {};", "(function () {})(); (async function () {})();", "@dec() class A {}", "@dec() abstract class A { async function() {} }", "const o = { async function() {}, async: 1, let: [1] };", "async function f() {}\nexport async function g() {}", "let { a } = b, [c] = d; const [e, { f }]: T = g;", "for (const { a } of b) {}\nfor (let [k, v] in m) {}\nfor (let [i, j] = [0, 1]; i < j; i++) {}", "declare const { a }: T;", "var async; async\nfunction f() {}", "o.let[0] = o?.let[1]; o.async\nfunction f() {}", "class A { x; let = [1]; async = 1 }", "try {} catch ({ a }) {}\nconst x: number = 1; let y!: T, z;"],
    "tsx": ["export default function () { return <b />; }", "const { a } = p, f = async function () {};"],
}


@pytest.mark.parametrize(("ext", "text"), [(e, t) for e, ts in LOST.items() for t in ts])
def test_lost_tokens(ext, text):
    assert parsing.rejected(ext, text)


@pytest.mark.parametrize(("ext", "text"), [(e, t) for e, ts in KEPT.items() for t in ts])
def test_valid_beside_lost_tokens(ext, text):
    assert not parsing.rejected(ext, text)


def test_python_agrees_with_the_standard_parser():
    """Single-token deletions and repetitions of valid texts, judged as the standard parser judges them."""
    import ast
    import io
    import tokenize
    import warnings

    warnings.simplefilter("ignore")
    off = []
    for text in GOOD["py"]:
        toks = [t for t in tokenize.generate_tokens(io.StringIO(text).readline) if t.string.strip()]
        lines = text.splitlines(keepends=True)
        for t in toks:
            if t.start[0] != t.end[0]:
                continue
            line = lines[t.start[0] - 1]
            for new in (line[: t.start[1]] + line[t.end[1] :], line[: t.end[1]] + " " + t.string + line[t.end[1] :]):
                changed = "".join([*lines[: t.start[0] - 1], new, *lines[t.start[0] :]])
                try:
                    ast.parse(changed)
                    want = False
                except (SyntaxError, ValueError):
                    want = True
                if parsing.rejected("py", changed) != want:
                    off.append((changed, want))
    # Rules beyond the grammar, such as the order of arguments and of defaults, are all that may differ.
    assert len(off) <= 12, off


AMBIGUOUS = "S: S S | 'a' | ;"
LEFT = "S: S '+' T | T ;\nT: 'x' | '(' S ')' ;"
HIDDEN = "S: A S 'b' | 'x' ;\nA: 'a' | ;"


def _words(g, word):
    return [g.ids[c] for c in word] + [g.ids[END]]


def test_ambiguous_left_and_hidden_recursion():
    g = Grammar(AMBIGUOUS, "S")
    assert all(g.recognise(_words(g, "a" * n)) < 0 for n in (0, 1, 2, 7, 30))
    g = Grammar(LEFT, "S")
    assert g.recognise(_words(g, "x+x+(x+x)+x")) < 0 and g.recognise(_words(g, "x+(x")) >= 0 and g.recognise(_words(g, "+x")) == 0
    g = Grammar(HIDDEN, "S")
    for n, m in itertools.product(range(4), range(4)):
        word = "a" * n + "x" + "b" * m
        assert (g.recognise(_words(g, word)) < 0) == (n <= m), word


def test_against_brute_force():
    """All words up to a length against the derivations of a small grammar with empty rules and repeats."""
    g = Grammar("S: ( A | 'b' )* C? ;\nA: 'a' C ;\nC: 'c' S 'd' | ;", "S")
    rules = {"S": lambda w: any(s_seq(w[:k]) and c(w[k:]) for k in range(len(w) + 1))}

    def c(w):
        return w == "" or (len(w) >= 2 and w[0] == "c" and w[-1] == "d" and rules["S"](w[1:-1]))

    def s_seq(w):
        if w == "":
            return True
        if w[0] == "b" and s_seq(w[1:]):
            return True
        return w[0] == "a" and any(c(w[1:k]) and s_seq(w[k:]) for k in range(1, len(w) + 1))

    for n in range(7):
        for w in map("".join, itertools.product("abcd", repeat=n)):
            assert (g.recognise(_words(g, w)) < 0) == rules["S"](w), w


def test_remembered_stretches_change_nothing():
    """Random words, many of them alike, with and without what is remembered of stretches; the grammar forks within and across them."""
    import random

    rules = "S: X* ;\nX: E ';' | '{' S '}' | 'a' '{' S '}' 'b' ';' | 'a' '{' L '}' ;\nL: E ',' L | E | ;\nE: 'a' | 'b' E | E 'c' | '(' E ')' | 'a' '{' '}' ;"
    plain, leaping = Grammar(rules, "S"), Grammar(rules, "S")
    plain._leap = lambda *_: None
    rng = random.Random(4)
    pieces = ["a;", "ba;", "ac;", "{", "}", "a{", "}b;", "a,", "(a)c;", "a{};", "b", "c", ";", "a{a,a}"]
    good = 0
    for _ in range(4000):
        word = "".join(rng.choice(pieces) for _ in range(rng.randrange(9)))
        want = plain.recognise(_words(plain, word))
        assert leaping.recognise(_words(leaping, word)) == want, word
        good += want < 0
    assert good > 300 and leaping.leaps


@pytest.mark.parametrize(("ext", "whole"), [("rs", lexers._rust), ("go", lexers._go)])
def test_tokens_by_line_equal_tokens_of_the_whole(ext, whole):
    lines = ["x := 1", "let s = 'a';", '"a" + "b"', '"open', "`raw", "// it's \"", "/* c */ a", "/* open", "*/", 'r#"a "b" c', '"#', "b'x'", "}", "'a: loop {", "", "\tf(1) //", 'b"x', "a /= 2"]
    import random

    rng, g = random.Random(7), parsing.dialects(ext)[0]

    def tokens(lex, text):
        try:
            return list(lex(text, g))
        except lexers.LexError:
            return None

    for _ in range(3000):
        text = "\n".join(rng.choice(lines) for _ in range(rng.randrange(7)))
        want = tokens(whole, text)
        assert tokens(parsing.LANGUAGES[ext][0], text) == (None if want is None else [*want, g.ids[END]]), text


def test_long_files_are_read_whole():
    body = "".join(f"pub fn f{i}(x: u64) -> u64 {{ x * {i} }}\n" for i in range(3000))
    assert not parsing.rejected("rs", body) and parsing.rejected("rs", body + "}")
    assert not parsing.rejected("py", "x = " + "(" * 80 + "1" + ")" * 80) and parsing.rejected("go", "package a\nvar x = " + "(" * 5000)


def test_on_tables(spark):
    schema = "file_id long, project_id string, unit_name string, path string, language string, hash string, content string, loaded_at timestamp, bad string, ext string"
    from datetime import datetime

    rows = [(1, "p", "u", "a.rs", None, None, "fn f() {", datetime(2024, 1, 1)), (1, "p", "u", "a.rs", None, None, "fn f() {}", datetime(2024, 1, 2)), (2, "p", "u", "b.py", None, None, "def f(", datetime(2024, 1, 1)), (2, "p", "u", "b.py", None, None, "def f(", datetime(2024, 1, 1)), (3, "p", "u", "c.go", None, None, None, None), (4, None, None, "d.TS", None, None, "let =", None), (5, "p", "u", None, None, None, "x", None), (6, "p", "u", "e.txt", None, None, "((", None), (7, "p", "u", "f.go", None, None, "", None), (None, "p", "u", "g.go", None, None, "x", None)]
    f = spark.createDataFrame([(*r, "z", "z") for r in rows], schema)
    assert sorted(r[0] for r in parsing.unparsable(f).collect()) == [2, 4]
    assert parsing.unparsable(f.limit(0)).count() == 0
    u = spark.createDataFrame([("p", ["a.rs", "b.py", "b.py", None, "nowhere"]), ("p", None)], "project_id string, source_files array<string>")
    assert {tuple(r) for r in parsing.parse_rates(f, u).collect()} == {("p", "rust", 1, 0), ("p", "python", 1, 1)}
