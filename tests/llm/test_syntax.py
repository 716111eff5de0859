import pytest

from codelode.llm.syntax import GRAMMARS, first_error

VALID = {
    "css": ["", "a, b > c ~ d + e:hover::before { color: red; margin: 0 auto }\n@media (min-width: 1px) { .a.b#c[d='e'] *, :not(.f, g) { --x: 1; background: url(a.png) } }\n@import 'x.css';\n", "@keyframes k { 0% { top: 0 } 33.3%, to { top: 1px } }\nh1\n  ,\n  h2  >  p { }\n/* } */\n"],
    "python": ["", "x: int = 1\na.b[c], (d, *e) = f = g()\nx[f(1)] += 2\n(a.b)(c).d = 1\nd['a': 1] = 2\n", "def f(a, *, b=1, **c) -> int:\n  for x in y:\n    if x: break\n    else: continue\n  return lambda: (yield)\nasync def g():\n  async with a as b, c: await d\n  return [x async for x in y if x]\n", "while x: x = lambda a=1: a; break\nmatch x:\n  case {'a': [1, *b]} if b: pass\n  case A(c=1) | None: pass\ntype T[U] = list[U]\n", "class A(B, metaclass=C):\n  x = 1\n  def f(self): return self.x\n  y = property(f)\n@d(1)\nclass E: pass\nprint(f'{x}', 0x1F, 1_0.5e3j, 00, b'a')\n", "if (n := 10) > 5: x = {**a, 'b': 1}; y = [*c]; z = a if b else c\ntry: pass\nexcept* (A, B) as e: raise X from e\nfinally: del a, b[0]\n"],
    "json": ["1", " {\"a\": [1.5e-3, null, \"\\u00e9\"]} ", "[]"],
    "javascript": [
        "a ?? b;\nx = a / b / c; y = /re/g.test(s)\nlet z = (a, b = 1, ...c) => ({ a, [b]: 1, get c() { return 1 }, async *d() {}, class: 2 })\nfor (const k in o) for (const [a, b] of m) if (a) continue; else break\n",
        "import d, { default as e, f as g } from './m.js';\nimport * as n from 'n'\nexport { d as default, g };\nexport * as q from 'q';\nexport default async function () { await x; for await (const y of z) yield_(y) }\nimport('a').then(b => b?.c?.[d]?.(e))\n",
        "class A extends B { static x = 1; static { y() } #p = 2\n get v() { return this.#p } set v(q) { this.#p = q }\n async *z() { yield* w; yield }\n static async s() {} constructor() { super(); super.f() } 'q'() {} [k]() {} 1() {} has(o) { return #p in o } }\n",
        "l: while (1) { switch (a) { case 1: case b ? c : d: break l; default: { } } }\ntry { throw new E(`a${b + `n${c}`}d`) } catch { } finally { }\ndo x++; while (x < 5) y()\nvar f = async x => x, g = async (a, { b = 2 }, [c]) => { return }\nconst t = tag`x${1}`\n;[a, b] = [b, a]\n({ a, b: c = 1 } = d)\nx\n++\ny\n",
        "const r = a ? (b) : c => d\nif (a) /x/.exec(b)\nlet u = {}\n/x/g\nnew X; new X.Y(1).z = 2; new (f())();\nvar async = 1, of = 2, get = 3, from = 4, as = 5; async(of)\nreturn_: ;\n0x1F + 1_000n + .5e-3 + 0b11 + 0o17\n",
        "",
    ],
    "typescript": [
        "interface A<T extends B = C> extends D<T>, E { readonly a?: string; f(x: number): void; [k: string]: unknown; new (x: T): A<T>\n get q(): T }\ntype U = { [K in keyof T as `x${K}`]-?: T[K] } | (() => void) | typeof import('m') | [a: string, b?: number, ...c: T[]]\ntype V<T> = T extends (infer R)[] ? R : T extends abstract new (...a: any) => infer Q ? Q : never\n",
        "export abstract class A<T> implements B, C<T> { private readonly x: Map<string, Array<number>> = new Map<string, Array<number>>();\n constructor(private a: string, public b?: number, ...c: T[]) { super() }\n abstract f(): void;\n static g<T>(this: A<T>, x: T | null = null): x is T { return x! as unknown as T }\n declare y: string; z!: number; override async h() {} @dec() k = 1\n}\n",
        "enum E { A = 1, B = 'x', }\nconst enum F { A }\ndeclare module 'm' { export function f(a: string): void; }\ndeclare global { interface W { a: 1 } }\nnamespace N.M { export const x = 1 }\nimport type { T } from './t'; import { type Q, R } from './q'; export type { T };\nfunction o(a: string): void;\nfunction o(a: any) { }\nlet f = <T,>(x: T): T => x, g = (a: number, b?: string): Promise<void> => { }, h = a ? (b) : (c) => d, i = (x satisfies Y), j = f<string>(1) < 2 && a < b\n",
        "const x = <const T extends object>(a: T) => a;\nlet m: Record<string, (a: number) => void> = {};\nfor (const [k, v] of Object.entries(m) as [string, any][]) { v?.(k!) }\nlet a = b as any, c = d\n  , e: unique symbol, t = async (q: string): Promise<void> => {}\nasserts(x); type(1); declare = 2\nfunction p(x: unknown): asserts x is string { if (a < 1 || b > (2)) return }\n",
    ],
    "go": [
        'package p\n\nimport (\n\t"fmt"\n\tm "math"\n\t. "os"\n)\n\nvar a, b int = 1, 2\nconst (\n\tX = iota\n\tY\n)\ntype T struct {\n\tA, B int `json:"a"`\n\t*Base\n\tio.Reader\n\tList[int]\n\tf func(int) (string, error)\n\tm map[string][]int\n}\n',
        "package p\n\ntype I interface {\n\tF(a int) error\n\tfmt.Stringer\n\t~int | ~string\n}\ntype L[T any, U comparable] struct{ next *L[T, U] }\ntype A [3]int\ntype B []string\ntype N [X]int\nfunc Map[T, U any](xs []T, f func(T) U) []U {\n\tvar out []U\n\tfor _, x := range xs {\n\t\tout = append(out, f(x))\n\t}\n\treturn out\n}\n",
        'package p\n\nfunc (r *T) M(a, b int, c ...string) (n int, err error) {\n\tif v, ok := m[a]; ok && v == 1 {\n\t\treturn v, nil\n\t} else if x := f(T{1, 2}); x != nil {\n\t\tgoto end\n\t}\n\tfor i := 0; i < 10; i++ {\n\t\tcontinue\n\t}\n\tfor {\n\t\tbreak\n\t}\n\tfor range []string{"a"} {\n\t}\nend:\n\tswitch y := x.(type) {\n\tcase int, *string:\n\t\tfallthrough\n\tcase nil:\n\tdefault:\n\t}\n\tselect {\n\tcase v := <-c:\n\t\t_ = v\n\tcase c <- 1:\n\tdefault:\n\t}\n\tgo func() { defer close(c) }()\n\tz := map[string][]T{"a": {{1, 2}}, "b": nil}\n\ts := a[1:2:3]\n\tq := &T{A: 1,\n\t\tB: 2,\n\t}\n\tw := struct{ x int }{1}\n\tfn := func(a int) interface{} { return a }\n\tvar ch chan<- int = make(chan int, 3)\n\tx, y = y, x\n\tx &^= 1 << 2\n\treturn int(n), (<-ch)\n}\n',
        "package p\n\nfunc f() interface{} {\n\treturn []interface{}{1, 'x', '\\n', 0x1F, 1e3, 2i}\n}\nfunc g() struct{} { return struct{}{} }\nvar h = []func(){a, b}\nfunc k() { if f := func() bool { return true }; f() { return } }\n",
    ],
    "java": [
        "package a.b;\n\nimport java.util.*;\nimport static java.lang.Math.max;\n\n@Deprecated\npublic final class A<T extends Comparable<T> & B> extends C<T> implements D, E<Map<String, List<int[]>>> {\n    private static final int[] X = {1, 2, 3,};\n    static { X[0] = 1; }\n    { y = 2; }\n    A(int a, String... b) throws IOException { super(a); this.a = a; }\n    @Override public <U> List<? super U> f(final Map<String, ? extends U> m) { return new ArrayList<>(); }\n    abstract int g();\n    enum K { A(1) { int f() { return 1; } }, B, C; int f() { return 0; } }\n    record P(int x, int y) { P { if (x < 0) throw new E(); } }\n    @interface Ann { int value() default 1; String[] names() default {\"a\"}; }\n    interface I { default void f() {} static int g() { return 1; } }\n    sealed interface S permits P, Q {}\n    non-sealed class Q implements S {}\n}\n",
        'class A {\n    int f(Object o) {\n        for (int i = 0, j = 1; i < 10 && j > 2; i++, j--) { continue; }\n        for (final String s : list) System.out.println(s);\n        outer: while (true) { break outer; }\n        do { x += 1; } while (x < 5);\n        try (var r = open(); Reader q = new Reader(r)) { r.read(); } catch (IOException | RuntimeException e) { throw e; } finally { done(); }\n        int y = switch (k) { case 1, 2 -> 3; case 4 -> { yield 5; } default -> throw new X(); };\n        switch (k) { case 1: f(); break; case A: default: g(); }\n        switch (o) { case String s when s.length() > 3 -> f(); case Point(int a, var b) -> g(); case null, default -> h(); }\n        if (o instanceof String s && !s.isEmpty()) return 1; else return (int) x + (String) o + (a) - b;\n    }\n    Runnable r = () -> {}, s = x -> x + 1;\n    BiFunction<Integer, Integer, Integer> t = (a, b) -> a * b, u = (int a, int b) -> { return a >> b >>> 2; };\n    Object o = new Object() { int z; void f() {} }, p = new int[3][], q = new String[]{"a", "b"}, w = int[]::new, v = String::valueOf, c = int.class, d = A.this.x;\n    String text = """\n      a "quoted" text\n      """;\n    long l = 0xFFL + 1_000 + 1e3f; char ch = \'\\u0041\';\n    int g() { return a < b ? c : d > e ? 1 : 2; }\n    void h() { a[i]++; this.<T>m(); Collections.<String>emptyList(); synchronized (this) { assert x > 0 : "no"; } List<String>[] z = null; x >>= 2; f(a < b, c > d); }\n}\n',
    ],
    "c": [
        '#include <stdio.h>\n#define F(x) { x \\\n  }\ntypedef struct node { int a : 3, b; struct node *next; T *t; } node_t, *node_p;\nenum e { A = 1, B, };\nunion u { int i; float f; };\nstatic const T *g(const U *x, V y, W *, ...);\nextern int (*fp)(int, char **), arr[3][4];\nint a[] = { [0] = 1, 2, [3 ... 5] = 4 }, *p = &a[1];\nstruct s v = { .x = { 1, 2 }, .y = "a" "b" };\nT *h(T *x) { return x; }\nT k(void) { return (T){ 1, 2 }; }\nMODULE("x");\nint old(a, b) int a; char *b; { return a; }\n',
        '#ifdef X\nint f(int a) {\n#else\nint f(void) {\n#endif\n    T *x = (T *)malloc(sizeof(T) * n), **y;\n    const T *z = x;\n    size_t i = 0, j;\n    unsigned long long k = 0xffULL;\n    for (int i = 0; i < 10; i++) { a->b.c[i] += *p++; }\n    for (;;) break;\n    do { x--; } while (x > 0);\n    switch (k) { case 1: case \'a\': f(); break; default: g(); }\n    if (a) b(); else if (c) { d(); } else e = f ? (int)g : -h;\n    goto end;\nend:\n    list_for_each(p, q) { r(p); }\n    va_arg(ap, T *); va_arg(ap, int);\n    printf("%" PRIu64 "\\n", (uint64_t) x);\n    int (*cb)(int a) = 0;\n    T (*cc)(int a) = 0;\n    T *proto(int a);\n    x = a ? b ? c : d : e;\n    return !x && ~y || (z & 1);\n}\n',
        "/*\n<<<<<<< ours\n*/\nchar *s = \"} {\";\nchar c = '{';\n",
    ],
}
BROKEN = {
    "css": ["a { color: red", "a { color red; }", "} a {}", "<<<<<<< HEAD\na { }", "a { color: red; }\n=======\nb { }", "a[b { }", "<html> { x }"],
    "python": ["def f(:\n  pass\n", "return 1\n", "for x in y: pass\nbreak\n", "1 = x\n", "f() = 1\n", "a + b = c\n", "x = 08\n", "class A:\n  return 1\n", "def f():\n  await x\n", "if a:\nb\n", "  a\n", "print 'x'\n", "x = (1,\n", "a, 1 = b\n", "None += 1\n", "f(a) += 1\n", "x = y = 2 = z\n", "while 1:\n  pass\nelse:\n  break\n"],
    "json": ["", "{", "[1,]", "{'a': 1}", "{\"a\": 1} 2", "01", "NaN", "// c\n1"],
    "javascript": ["let x = ;", "function f( {", "a b", "<<<<<<< ours\na\n", "let class = 1", "if (a) { ", "f() = 1", "1 = x", "const x: number = 1", "for (x) y", "x = `a${b", "010", "with (a) b", "@d class A {}", "/* open", "return_ }", "{ \"a\": 1, \"b\": 2 }", "a\n=======\nb", "x = a ? b", "export { a", "import x from y", "() + 1", "throw\nx", "'a\nb'"],
    "typescript": ["interface A { a: ", "let x: = 1", "type T = {", "class A { private }}", "function f(a: string { }", "let a: Map<string = 1", ">>>>>>> theirs", "enum E { A B }"],
    "go": ["package p\n\nfunc f() {\n", "package p\n\nfunc f() {\n\treturn a b\n}\n", 'package p\n\nvar s = "abc\n', "package p\n\nfunc f() {\n<<<<<<< HEAD\n}\n", "package p\n\nfunc f() {\n\tx := \n}\n", "func f() {}\n", "package p\n\nfunc f() }\n", "package p\n\nfunc f() {\n\tg(1, 2\n}\n", "package p\n\nfunc f() {\n\tif x {\n\t}\n\telse {\n\t}\n}\n"],
    "java": ["class A {\n", "class A { int f() { return 1 } }", "class A { int f( { } }", "class A { void f() { int x = ; } }", "class A { String s = \"abc; }", "class A {\n=======\n}", "class A { void f() { g(a b); } }", "class A { void f() { if (x { } } }", "class A { } }"],
    "c": ["int f(void) {\n", "int f(void) { return 1 }\n", "int f(void) { g(a b); }\n", "int f(void) { x = ; }\n", 'char *s = "abc;\n', "int f(void) {\n>>>>>>> theirs\n}\n", "int f(void) { if (x { } }\n", "int f(void) { } }\n", "#if X\nint a;\n", "int f(void) { return a b; }\n"],
}


KNOWN_CONFLICTS = {"json": 0, "css": 0, "python": 1, "go": 37, "java": 27, "c": 12, "script": 365}


@pytest.mark.parametrize("lang,text", [(g, t) for g, ts in VALID.items() for t in ts])
def test_valid(lang, text):
    at = first_error(text, lang)
    assert at == -1, text[max(0, at - 60) : at] + " >>> " + text[at : at + 30]


@pytest.mark.parametrize("lang,text", [(g, t) for g, ts in BROKEN.items() for t in ts])
def test_broken(lang, text):
    assert first_error(text, lang) >= 0


def test_every_language_of_the_files_has_a_grammar():
    from codelode.llm.lang import EXTENSIONS

    assert set(EXTENSIONS.values()) <= GRAMMARS


def test_a_marker_between_statements_ends():
    assert first_error("a;\n>>> b;\n", "javascript") == 3


@pytest.mark.parametrize("text,line", [("a;\nlet b = ;\n", 2), ("f(\n1,\n2", 3)])
def test_the_first_error_has_its_place(text, line):
    assert text.count("\n", 0, first_error(text, "javascript")) + 1 == line


def test_conflicts_of_the_grammars_are_known():
    """Shifts over reductions: open else, ranks of operators put together, and the marks that script.py decides first."""
    from codelode.llm.syntax import table

    assert {g: table(g).conflicts for g in ("json", "css", "python", "go", "java", "c", "script")} == KNOWN_CONFLICTS


@pytest.mark.parametrize("text", VALID["python"] + BROKEN["python"])
def test_python_as_compile_says(text):
    try:
        compile(text, "x", "exec", dont_inherit=True)
        valid = True
    except SyntaxError:
        valid = False
    assert (first_error(text, "python") < 0) == valid


def test_a_long_text_that_is_no_selector_ends():
    words = "\n    ".join(f"some words, that - are no selector ({i}" for i in range(3000))
    assert first_error(words + " ! { }", "css") >= 0
    assert first_error("a " * 20_000 + "! { }", "css") >= 0
    assert first_error(", ".join(f".c{i}  >  d" for i in range(5000)) + " { top: 0 }", "css") == -1
