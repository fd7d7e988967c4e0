"""Small sources in every language, and where their chunks are (the end of a preamble or whole file is exclusive, of a definition inclusive)."""

SOURCES = [
    ("a.rs", "use x;\n\nfn main() {\n    run();\n}\n\n#[cfg(test)]\nmod m {\n    pub(crate) fn one() { let c = '}'; }\n    /* } */\n    async fn two<'a>(x: &'a str) {\n        r#\"}\"#;\n    }\n}\nimpl T for S {\n    fn q(&self) {}\n}\ntrait U { fn z(); }\npub struct P(u8);\nenum E { A, B }\ntype K = u8;\n"),
    ("b.py", "import os\n@dec\ndef a(x,\n      y):\n    \"\"\"\ndef no\n    \"\"\"\n    pass\n\nclass B:\n    def c(self):\n        pass\n\nif x:\n    async def d(): return 1\n"),
    ("broken.py", "def a():\n    return (1\n\ndef b(:\n    pass\nclass C:\n    x = 1\n"),
    ("broken2.py", "x = = 1\ndef f():\n    y = 'open\n    return y\n\ndef g():\n    pass\n"),
    ("c.c", "#include <a.h>\n#define M(x) { x\nstatic int add(int a,\n               int b) {\n    return a + b; // }\n}\nstruct P { int x; };\nint table[] = { 1, 2 };\nint later(int);\nextern \"C\" {\nvoid g(void) { }\n}\n"),
    ("d.cpp", "namespace n {\nclass A : public B {\n    void f() {}\n};\ntemplate <typename T>\nT id(T x) { return x; }\n}\nA::A() : x{1}, y(2) {\n    z();\n}\n"),
    ("E.java", "package p;\n\n@Note(\"}\")\npublic final class E extends F {\n    void m() {}\n}\nrecord R(int a) {\n    int twice() { return 2 * a; }\n}\n"),
    ("f.js", "import x from 'y'\nconst a = /[{]/\nexport default async function f(x) {\n  return `}`\n}\nclass A {\n  m() {}\n}\nconst o = {\n  foo() { return 1 },\n}\n"),
    ("g.ts", "export interface I { a: string }\nfunction f(a: number): { b: string } {\n  return { b: '' }\n}\nabstract class C {}\n"),
    ("h.go", "package h\n\nconst (\n\tX = 1\n)\n\ntype T struct {\n\ta int\n}\n\nfunc (t *T) M(x interface{}) (int, error) {\n\treturn 1, nil\n}\n\nfunc F() interface{} { return `}` }\n"),
    ("none.go", "package none\n\nvar x = 1\n"),
    ("notes.txt", "def a():\n    pass\n"),
    ("empty.py", ""),
]

EXPECTED_CHUNKS = [
    ("a.rs", 0, 2, "use x;"),
    ("a.rs", 2, 4, "fn main() {"),
    ("a.rs", 8, 8, "pub(crate) fn one() { let c = '}'; }"),
    ("a.rs", 10, 12, "async fn two<'a>(x: &'a str) {"),
    ("a.rs", 14, 16, "impl T for S {"),
    ("a.rs", 17, 17, "trait U { fn z(); }"),
    ("a.rs", 18, 18, "pub struct P(u8);"),
    ("a.rs", 19, 19, "enum E { A, B }"),
    ("b.py", 0, 2, "import os"),
    ("b.py", 2, 7, "def a(x,"),
    ("b.py", 9, 11, "class B:"),
    ("b.py", 14, 14, "async def d(): return 1"),
    ("broken.py", 0, 6, "def a():"),
    ("broken2.py", 0, 1, "x = = 1"),
    ("broken2.py", 1, 3, "def f():"),
    ("broken2.py", 5, 6, "def g():"),
    ("c.c", 0, 2, "#include <a.h>"),
    ("c.c", 2, 5, "static int add(int a,"),
    ("c.c", 6, 6, "struct P { int x; }"),
    ("c.c", 10, 10, "void g(void) { }"),
    ("d.cpp", 0, 1, "namespace n {"),
    ("d.cpp", 1, 3, "class A : public B {"),
    ("d.cpp", 5, 5, "T id(T x) { return x; }"),
    ("d.cpp", 7, 9, "A::A() : x{1}, y(2) {"),
    ("E.java", 0, 2, "package p;"),
    ("E.java", 2, 5, '@Note("}")'),
    ("E.java", 7, 7, "int twice() { return 2 * a; }"),
    ("f.js", 0, 2, "import x from 'y'"),
    ("f.js", 2, 4, "async function f(x) {"),
    ("f.js", 5, 7, "class A {"),
    ("f.js", 9, 9, "foo() { return 1 }"),
    ("g.ts", 0, 0, "interface I { a: string }"),
    ("g.ts", 1, 3, "function f(a: number): { b: string } {"),
    ("g.ts", 4, 4, "abstract class C {}"),
    ("h.go", 0, 2, "package h"),
    ("h.go", 2, 4, "const ("),
    ("h.go", 6, 8, "type T struct {"),
    ("h.go", 10, 12, "func (t *T) M(x interface{}) (int, error) {"),
    ("h.go", 14, 14, "func F() interface{} { return `}` }"),
    ("none.go", 0, 3, "package none"),
    ("notes.txt", 0, 2, "def a():"),
    ("empty.py", 0, 0, ""),
]
