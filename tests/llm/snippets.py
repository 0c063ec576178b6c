"""Texts that are and that aren't valid files of each language."""

VALID = {'cpp': ['#include <a>\n'
         '#define X "y"\n'
         'struct A : public B {\n'
         '  const std::string& f(const C& c, int d) const { auto e = std::make_shared<D>(c.g, 1); for (const auto& i : c.h) { LOG(INFO) << "x" << i; } throw '
         'std::runtime_error("z"); }\n'
         '};\n'
         'static const double q[] = { 1.0, -2.5e3 };\n'
         "char m = '}';\n",
         'class A final : public B, private C<D> { public: A() = delete; A(const A&) = default; explicit A(int x) : B(x), c_{1} {} virtual ~A() noexcept '
         'override; int x : 3; [[nodiscard]] int f() const; static constexpr int k = 1; operator bool() const { return true; } A& operator=(A&&) = default; '
         'bool operator==(const A& o) const; private: std::vector<std::pair<int, int>> v_; };',
         'P p{.x = 1, .y = 2};',
         'template <typename T> requires std::integral<T> T f(T a) { return a; }',
         'template <template <typename> class C, typename... Ts> void f(C<Ts>... a) { (g(a), ...); return (0 + ... + a); }',
         'inline namespace v1 { int x; }',
         'auto l = [&, x = 1](int a) noexcept -> int { return a + x; };',
         'auto s = "x"_s;',
         'template <typename T> concept C = requires(T a) { a.f(); { a + a } -> std::same_as<T>; typename T::type; };',
         'namespace a::b { enum class E : int { A = 1, B, }; using X = std::map<int, std::vector<int>>; }',
         '#include <x>\n'
         'int main(int argc, char** argv) { for (auto& [k, v] : m) { std::cout << k << v << std::endl; } if (auto it = m.find(1); it != m.end()) { } if '
         'constexpr (x) { } return 0; }',
         'int (*fp)(int, char) = nullptr; int a[3] = {1, 2, 3}; unsigned long long z = 1ULL << 3;',
         'void f() { a * b; T<int> x(1); x = y < z; foo<bar>(1); delete[] p; auto* q = new int[3]; throw std::runtime_error("x"); try { } catch (const '
         'std::exception& e) { } catch (...) { } switch (x) { case 1: { break; } default: ; } static_cast<int>(x); (void)x; int y = (int)z; sizeof(int); goto '
         'e; e: return; }',
         'std::string A::f(const std::string& s) const { return s.substr(0, n) + R"(x)"; }\n'
         'A::A() : x(1) {}\n'
         'A::~A() {}\n'
         'std::ostream& operator<<(std::ostream& o, const A& a) { return o << a.x; }',
         'extern "C" { void f(void); }\n'
         'static const int k = 3;\n'
         'typedef struct { int x; } S;\n'
         'struct T { T(T&&) noexcept; union { int a; float b; }; };\n'
         'TEST(A, B) { EXPECT_EQ(1, 2); }',
         'co_task f() { co_await g(); co_return 1; }',
         'template <> struct hash<A> { size_t operator()(const A& a) const noexcept { return 1; } };',
         'using F = std::function<void(int, const std::string&)>; auto g(int x) -> decltype(x + 1);',
         'template <int N = 3, class T = void> class X; extern template class Y<int>; friend_ z;',
         'int x = a ? b : c, *p = &x; std::array<int, 3> arr{{1, 2, 3}}; std::unique_ptr<A> u = std::make_unique<A>(1, 2);',
         'void g() { auto h = [this]() mutable { x++; }; std::thread t([&] { h(); }); while (!done) { } do { } while (0); for (;;) { } for (size_t i = 0, n = '
         '3; i < n; ++i) x[i] = {1}; a->b.c(d)[e]; *p++ = -1; ::f(); A::B c; const auto& r = v; int arr[2][3]; }'],
 'go': ['package a\n'
        '\n'
        'import (\n'
        '\t"fmt"\n'
        ')\n'
        '\n'
        'func (m *T) f(a *B, c int) (d error) {\n'
        '\tif x := g(c); x != nil {\n'
        '\t\treturn nil\n'
        '\t}\n'
        '\tm := map[string]int{"a": 1}\n'
        '\tgo func() {\n'
        '\t\tc <- <-d\n'
        '\t}()\n'
        '\tfor i, v := range m.x {\n'
        '\t\tv += i\n'
        '\t}\n'
        '\tswitch x {\n'
        '\tcase 1:\n'
        '\tdefault:\n'
        '\t}\n'
        '\treturn d\n'
        '}\n',
        'package p\ntype N interface { ~int | string }\n',
        'package p\nfunc F[T ~int | string](a T) T { return a }\n',
        'package p\n'
        'func f() {\n'
        '\tfor ; ; {\n'
        '\t}\n'
        '\tfor range 10 {}\n'
        '\tfor i := range x {}\n'
        '\tfor {}\n'
        '\tif x := f(); x > 0 {} else if y {} else {}\n'
        '\tswitch v := x.(type) {\n'
        '\tcase int, string:\n'
        '\tdefault:\n'
        '\t}\n'
        '\tselect {\n'
        '\tcase a := <-c:\n'
        '\tcase c <- 1:\n'
        '\t}\n'
        '}\n',
        'package p\ntype S[T any] struct {\n\t*pkg.A\n\tB[T]\n\tx, y int `json:"x"`\n}\nfunc (s *S[T]) M() (a, b int, err error) { return }\n',
        'package p\nvar m = map[string][]int{"a": {1, 2}, "b": nil}\nvar f = func(a int, b ...string) {}\nconst (\n\tA = iota\n\tB\n)\n',
        'package p\n'
        'func f() {\n'
        'L:\n'
        '\tfor i := 0; i < 3; i++ {\n'
        '\t\tcontinue L\n'
        '\t}\n'
        '\tgo func() {}()\n'
        '\tdefer x.y()\n'
        '\ta[1:2], b = c[:], <-d\n'
        '\tx.(T).y()\n'
        '\treturn\n'
        '}\n',
        'package p\n'
        'import (\n'
        '\t"a"\n'
        '\tb "c"\n'
        '\t. "d"\n'
        ')\n'
        'var x = F[int, []string](1)\n'
        'var y = &T{A: 1, B: []int{1}}\n'
        'var z = [...]int{1, 2}\n'
        'var c chan<- int\n'
        'var d <-chan int\n'
        'func g(func(int) string, map[string]int) {}\n',
        'package p\nvar q = Map[K, V]{}\ntype A = B\ntype F func(a, b int) (c int)\nfunc h() { if (T{1}) == y { } }\n'],
 'java': ['package a.b;\n'
          'import c.D;\n'
          'public final class E<T> extends F implements G {\n'
          '  private static final String[] A = {"x", "y"};\n'
          '  @Override public void f(Map<String, List<Integer>> m, int... z) throws H { for (String s : m.keySet()) { g(x -> x.y, 1); } int[] q = new int[3]; '
          'synchronized (this) { q[0]++; } }\n'
          '}\n',
          'record P(int x, int y) { P { if (x < 0) throw new E(); } static int z = 1; }',
          'class A { int f(Object o) { return switch (o) { case String s when s.length() > 1 -> 1; case Point(int x, var y) -> { yield 2; } case null, default '
          '-> 3; }; } }',
          'class A { void f() { if (o instanceof String s && s.isEmpty()) { } } }',
          'public @interface X { int value() default 1; String[] names() default {}; }',
          'sealed interface S permits A, B {}\nnon-sealed class A implements S {}',
          'class A<T extends B & C> { List<? super T> l = new ArrayList<>(); Map<String, List<int[]>> m; }',
          'class A { int[] a = {1, 2}, b[] = new int[3][]; Runnable r = () -> {}; F f = (x, y) -> x + y; G g = (int x) -> { return x; }; }',
          'class A { void f() throws E { try (var a = b(); c) { } catch (X | Y e) { } finally { } for (int i = 0, j = 1; i < 3; i++, j--) ; for (final var x : '
          'y) { } do { } while (a); l: while (true) break l; } }',
          'enum E { A(1) { void f() {} }, B; E() {} }',
          'class A { Object o = (String) x; int y = (int) -1; F f = String::valueOf; G g = int[]::new; H h = A.<B>c(); Class<?> c = int.class; Object d = '
          '(Runnable & Serializable) () -> {}; }',
          'import static a.b.*;\nclass Z {}',
          'class A { @Override public <T> T f(@N final T... a) { synchronized (this) { } switch (a) { case 1: case 2: b(); break; default: } assert x : "y"; '
          'return null; } }',
          'class A { String s = """\n a "b"\n """; long l = 0xFFL + 1_000; char c = \'\\u0000\'; }',
          'class A { void f() { int a = b < c ? d : e; a >>= 2; a >>>= 3; boolean q = a < b && c > d; List<List<String>> z = null; new A() { int x; }.y(); '
          'outer.new Inner(); A.this.x(); super.f(); a[i++] = -b; } }',
          'interface I { default void f() {} static int g() { return 1; } private void h() {} }',
          'class M { { } static { } M() { this(1); } }'],
 'javascript': ['',
                '// a',
                'let a, b = /[{(]+x\\/y/g;\nconst f = async (x) => ({ y: x.z ?? 1, ...w });\nfor (const i of f) { if (!i) continue; else break; }',
                'a = b\nc = d\n',
                'export default class A extends B { static x = 1; async f(a, { b = 2 }) { return `t${a}`; } get y() { return this.#z; } }',
                '!function(e,t){switch(y){case 1:w();break;default:x=null}}(1,void 0);',
                'function f(y) { return /x/.test(y); }',
                'if (x) /re/.exec(y)',
                'if (a) b()\nelse c()',
                'const u = import.meta.url',
                'const t = `a${`b${c}`}d`',
                'const o = {async, get, set, a, [b]: 1, async f() {}, get x() { return 1 }, ...q}',
                'do x++; while (c) y()',
                'a = b\n++c',
                'const f = async ({a, b = 1}, [c]) => ({a})',
                "class A extends B.C { #p = 1; static x = 2\n y\n static { } get z() { return this.#p } async *g() {} 'q'() {} }",
                'for (const [a, b] of c) d()',
                'for (let i = 0, n = 3; i < n; i++) {}',
                'for await (const x of y) {}',
                'x?.y?.[z]?.(w) ?? v',
                'label: for (;;) { continue label }',
                "import a, { b as c, default as d } from 'x'\nexport * as e from 'y'\nexport default class {}",
                'export const x = 1, y = 2',
                'var a = b / c / d',
                '(function () {})()',
                'x = function* () { yield* a; yield }',
                'new Foo(a).b',
                'tag`x`',
                'a\n/re/g.test(b)',
                'try { } catch { } finally { }',
                'switch (a) { case 1: case 2: b(); break; default: }',
                'return_ = a ? b : c',
                'async function f() { await x }',
                'let {a: {b = 1}, ...c} = d',
                '#!/usr/bin/env node\nx()',
                'export default function () {}',
                'if (a) { } else if (b) { } else { }',
                'x = a => b => c',
                'const s = \'a\' + "b"\nconst t = 1',
                '() => {}',
                'export { a as b }',
                '[a, b] = [b, a]',
                'delete a.b, void 0, typeof c'],
 'json': ['{"a": [1, -2.5e3, "x\\n", null, true]}', '3'],
 'python': ['',
            '# c\n',
            'x = [1,\n  2]\nif x:\n\ty = 1\nelse:\n\ty = 2\n',
            'async def f(a, *b, c=1, **d) -> int:\n    return await g(lambda x: x, *a, k=[i for i in b if i])\n',
            "s = '''\n<<<<<<< a\n'''\n",
            '@d.e(1)\nclass A(B, metaclass=C):\n    x: int = 3\n\n    def f(self): pass\n',
            "with a as b, c: print(f'{b}', end='')\n",
            'try:\n  pass\nexcept (A, B) as e:\n  raise C() from e\nfinally:\n  del x[1:2]\n',
            "match x:\n    case [1, *r] if r:\n        pass\n    case {'a': y, **z} | P(q, k=1) as w:\n        pass\n",
            'type X = int\n',
            'with (open(a) as f, open(b) as g):\n    pass\n',
            'x = f"{d["a"]}"\n',
            'f"{x!r:>{w}} {{}} {y=}"\n',
            'match = 1\nmatch.x = 2\nprint(match)\n',
            'def f[T](a, /, b=1, *, c, d=2, **k) -> int: return a\n',
            'x: int = 3\na = b = c\na, *b = c\n(a.b)[0] = 1\nx[1:2, ::3] += 1\n',
            'async def f():\n    async with a as b: pass\n    return [x async for x in y if x]\n',
            'lambda a, b=1, *c: a\n',
            'try:\n    pass\nexcept* E as e:\n    pass\n',
            'class A(B, metaclass=C): pass\n',
            'if x:\n\ty\nelse:\n\tz',
            'f(*a, b, *c, d=1, **e)\n',
            "print(*a, sep='')\n",
            'x = yield\n',
            '@a.b(c)\ndef f(): ...\n',
            'for i, (a, b) in enumerate(x): pass\n',
            'global_ = 0o17 + 0x_ff + 1_000 + 1e5 + 1j + .5 + 5.\n',
            'del a[0], b.c\n',
            'with a, b as c: pass\n',
            "x = [*a, *b]\ny = {**a, 'b': 1}\nz = {*a}\n",
            'assert (yield)\n',
            'a if b else c\n',
            'r\'\\\'\' rb\'x\' b"y"\n'],
 'typescript': ['export interface A<T> { readonly b: string | null; c?(x: number): void }\n'
                'export async function f(a: B, c: number): Promise<D<E>> { const x = g<H>(a) as I; return x; }',
                'type A = { a: string }[]; enum B { C = 1, D }',
                'class A<T> extends B<T> {}',
                'const x = <any>y',
                'type M = { -readonly [K in keyof T]-?: T[K] }',
                'class A { @Input() x: string; @Output() y = new E<string>(); constructor(private readonly a: B, public c?: D) { super() } }',
                'type I = typeof import("x")',
                'function f<T extends A = B>(a: T, b?: number, ...c: string[]): a is B { return a as unknown as B }',
                'interface A<T> extends B, C<D> { a: string\n'
                ' b?: number; (x: number): string; new (y: T): A; [k: string]: any\n'
                ' readonly z: () => void; m<T>(x: T): void }',
                "type U = | 'a' | 'b' & C",
                'type F = (a: number, b?: string) => void',
                'const m = new Map<string, Array<number>>()',
                "enum E { A = 1, B = 'x', C }",
                "declare module 'x' { export const y: number }",
                "export type { A } from './b'",
                "import type { C } from 'c'",
                "abstract class A { abstract f(): void; protected abstract readonly x: number; get y(): string { return '' } }",
                'let x!: number',
                'type C = A extends infer U ? U : never',
                'const f = <T,>(x: T): T => x',
                'type T = [a: string, b?: number, ...c: D[]]',
                'function assertIsString(val: any): asserts val is string {}',
                'x!.y!.z',
                'const a = b satisfies C',
                'type L = `a${B}c`',
                'export default interface X { a: 1 }',
                'namespace A.B { }',
                'let v = a < b && c > d',
                'type K = keyof typeof x',
                'export abstract class Q {}',
                'const g = async <T>(a: T): Promise<T> => a',
                'function h(this: Window) {}',
                "type G = A['b'][number][]",
                '@Component({a: 1})\nexport class C { }',
                'for (const k in o) if (a<b) c()',
                'let fn: new () => A',
                'declare global { interface Window { a: 1 } }',
                'export const enum Z { A }',
                'type R = Record<string, { a: number }>\nconst z = 1',
                'type Fn = {\n  (a: string): void\n  b: number\n}',
                'public_ = 1\ntype\n= 3']}

INVALID = {'cpp': ['int f() {',
         'import os\nfrom a import b\n',
         'int f() { x = ; }',
         'int x = 1;\n>>>>>>> a\n',
         'co_return x;',
         'int x',
         'class A { int x; }\nint y;',
         'int f() { return 1 }',
         'void f() { if x { } }',
         'int f( { }',
         'namespace a { int x;',
         'template <typename T void f();',
         'x = ;',
         'void f() { a b c d; }',
         'int x int y;',
         '<<<<<<< HEAD\nint x;',
         'def f(): pass',
         'struct A { int x int y; };',
         'return 1;'],
 'go': ['func f() {}\n',
        'package a\npackage b\n',
        'package a\nfunc f() {\n\tx := \n}\n',
        'package a\nfunc f() {\n<<<<<<< HEAD\n}\n',
        'import re\n',
        'package p\nfunc f( {}\n',
        'package p\nx := 1\n',
        'package p\nfunc f() { if x { }\n',
        'package p\nvar x = \n',
        'package p\nfunc f() { a b }\n',
        'package p\ntype T struct { x int y int }\n'],
 'java': ['class A { void f( { } }',
          'class A { int x = 1 }',
          'package a;\nclass A {}\npackage b;\n',
          'import { A } from "b";',
          'class A { int x }',
          'class A { void f() { if (x) } }',
          'class A {',
          'int f() {}',
          'class A { void f() { a b c; } }',
          'class { }',
          'class A { int x = ; }',
          'class A { f() { return 1 } }',
          'package a class B {}'],
 'javascript': ['if (a) {',
                'let x: number = 1;',
                'import os\nfrom a import b\n',
                '# Title\n',
                'a = (1;',
                '=======\n',
                'function (a) {}',
                'x = {',
                'if (a {',
                'const',
                'let x = ;',
                'a b',
                '}',
                '`abc',
                'return return',
                'class A { x y }',
                'for (;;',
                'import from',
                "x = 'a",
                '<<<<<<< HEAD',
                'def f():\n  pass',
                'const x = 1 const y = 2'],
 'json': ['', "{'a': 1}", '{"a": 1,}', '[NaN]', '{"a": 1} x', '{"a": "\t"}', '[01]'],
 'python': ['def f(\n',
            '  x = 1\n',
            'x = 1\n<<<<<<< a\n',
            'package main\n',
            'if x:\ny = 1\n',
            "x = 'abc\n",
            'There is no ribbon for this yet.\n',
            'f(]\n',
            '1 = x\n',
            'f() = 3\n',
            'f(a=1, b)\n',
            'def f(a=1, b): pass\n',
            'x = 08\n',
            'def f(:\n',
            'if x\n    y\n',
            'x = (1\n',
            'a b\n',
            "print 'x'\n",
            '  x\n y\n',
            "f'{a'\n",
            "f'{}'\n",
            '<<<<<<< HEAD\nx\n',
            'return return\n',
            'for 1 in x: pass\n',
            'x +=\n',
            'class A\n    pass\n',
            'else:\n  x\n',
            'def f():\n',
            'match x:\n  pass\n'],
 'typescript': ['interface A { a: string',
                'package a;\n',
                'func f(a int) error {\n}\n',
                'class A<T extends {}',
                'interface A { x: }',
                'type = ;',
                'let x: = 3',
                'const x: string = ',
                'enum { A }',
                'function f(a: ) {}']}
