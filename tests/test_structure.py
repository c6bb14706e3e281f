"""Structure of source texts in each language, resolution across files, and import paths."""

from __future__ import annotations

import pytest
from compare import rows
from pyspark.sql import functions as F

from tessera.operators import files as P
from tessera.operators import structure as S

SCRIPT = r"""// function notThis() {}
import { x } from './x';
export async function load<T extends Base>(id: string, opts = { a: 1 }): Promise<T> {
  const text = "helper(`x`) }"; /* skipped() } */
  const found = await fetchOne(id).then(r => inner(r));
  this.go(); super.stop(); a.b?.c(1); new Thing(found); new ns.Other();
  if (ready(id)) { console.log(`t ${hidden()}`); }
  function nested() { lost(); }
  return found.filter(Boolean).map((r) => lost(r)) / half(2) / 3;
}
export class Store<T> extends base.Model<T> implements Reader<T>, Writer {
  private count = 0;
  static all: string[] = make();
  constructor(private n: number) { super(n); init(n); }
  async get(key: string): Promise<{ a: T }> { return this.find(key) as T; }
  get size(): number { return size(this); }
  handler = () => { hidden(); };
  abstract skip(): void;
}
class Plain { run() { const re = /call\(["'}]/g; re.test(x); } }
export interface Reader<T> extends Any { get(k: string): T; }
export type Id = string | number;
export enum Kind { A = 'a', B = 'b' }
export const LIMIT = 10, OTHER = compute(3);
const arrow = async (a: number): Promise<void> => {
  work(a);
};
const short = x => twice(x)
let later;
describe('x', () => {
  const within = 1;
});
export default function main() { arrow(1); parseInt('3'); arrow(2); }
"""

SCRIPT_SYMBOLS = [
    ("function", "load", True, 3, 10), ("class", "Store", True, 11, 19), ("method", "Store.constructor", True, 14, 14), ("method", "Store.get", True, 15, 15), ("method", "Store.size", True, 16, 16),
    ("class", "Plain", False, 20, 20), ("method", "Plain.run", False, 20, 20), ("interface", "Reader", True, 21, 21), ("type", "Id", True, 22, 22), ("enum", "Kind", True, 23, 23),
    ("const", "LIMIT", True, 24, 24), ("const", "OTHER", True, 24, 24), ("function", "arrow", False, 25, 27), ("function", "short", False, 28, 28), ("const", "within", False, 31, 31), ("function", "main", True, 33, 33),
]
SCRIPT_EDGES = [
    ("CALLS", "load", "fetchOne", 5), ("CALLS", "load", "fetchOne(id).then", 5), ("CALLS", "load", "go", 6), ("CALLS", "load", "stop", 6), ("CALLS", "load", "a.b.c", 6), ("CALLS", "load", "Thing", 6), ("CALLS", "load", "ns.Other", 6),
    ("CALLS", "load", "ready", 7), ("CALLS", "load", "found.filter", 9), ("CALLS", "load", "found.filter(Boolean).map", 9), ("CALLS", "load", "half", 9),
    ("EXTENDS", "Store", "base.Model", 11), ("IMPLEMENTS", "Store", "Reader", 11), ("IMPLEMENTS", "Store", "Writer", 11),
    ("HAS_METHOD", "Store", "Store.constructor", 14), ("CALLS", "Store.constructor", "init", 14), ("HAS_METHOD", "Store", "Store.get", 15), ("CALLS", "Store.get", "find", 15), ("HAS_METHOD", "Store", "Store.size", 16), ("CALLS", "Store.size", "size", 16),
    ("HAS_METHOD", "Plain", "Plain.run", 20), ("CALLS", "Plain.run", "re.test", 20), ("CALLS", "arrow", "work", 26), ("CALLS", "short", "twice", 28), ("CALLS", "main", "arrow", 33), ("CALLS", "main", "arrow", 33),
]

PYTHON = '''import os
class _Base(Root, pkg.Mixin, metaclass=Meta):
    x = make()
    async def go(self, a):
        self.step(a); cls.other(); os.path.join(a)  # no()
        def inner():
            lost()
        return len(run(lambda: kept()))
    if True:
        @wrap
        def more(self): more()

@decorate
def top(): return _Base().go(1)
'''
GO = """package main
type Server struct {
	inner map[string]int
}
type (
	Reader interface { Read() }
	name = string
)
func (s *Server) Serve(w http.ResponseWriter, f func(int) int) (int, error) {
	go s.handle(w) // no()
	f := func() { inside(1) }
	return strconv.Atoi(`x } (`), wrap(err)
}
func helper[T any](x T) T { return x }
func Main() { helper[int](1); Map(helper) }
"""
RUST = """use a::b;
pub struct Point<T> { x: T }
enum Shape { Circle(f64), Square }
pub(crate) trait Draw { fn draw(&self) { hidden(); } }
impl<T: Clone> Draw for Point<T> where T: Copy {
    fn draw(&self) { self.paint(1); println!("no() }"); }
    pub async fn make<'a>(x: &'a str) -> Vec<T> { Vec::<T>::new(); io::read(x)?; 'c'.len() }
}
mod inner { pub fn deep() { parse::<i32>("x"); } }
fn main() { let p = |x| close(x); deep() }
"""
JAVA = """package a.b;
@Entity("x { y")
public class Shop<T extends Item> extends Base<T> implements Seller, java.util.List<String> {
  private int n = count();
  public Shop(int n) { init(n); }
  @Override
  public List<String> sell(Map<String, Integer> m) throws IOException { this.pay(1); m.get("a) {"); return new Order<String>(m); }
  void quiet() { list.forEach(x -> use(x)); super.quiet(); new int[3]; new a.b.Deep(); }
  enum Mode implements Flag { ON, OFF; boolean on() { return check(); } }
  interface Inner extends One, Two { void act(); }
}
"""
OTHERS = {
    "py": (PYTHON, [("class", "_Base", False, 2, 11), ("method", "_Base.go", True, 4, 8), ("method", "_Base.more", True, 11, 11), ("function", "top", True, 14, 14)],
        [("EXTENDS", "_Base", "Root", 2), ("EXTENDS", "_Base", "pkg.Mixin", 2), ("HAS_METHOD", "_Base", "_Base.go", 4), ("CALLS", "_Base.go", "step", 5), ("CALLS", "_Base.go", "other", 5), ("CALLS", "_Base.go", "os.path.join", 5),
         ("CALLS", "_Base.go", "run", 8), ("CALLS", "_Base.go", "kept", 8), ("HAS_METHOD", "_Base", "_Base.more", 11), ("CALLS", "_Base.more", "more", 11), ("CALLS", "top", "_Base().go", 14), ("CALLS", "top", "_Base", 14)]),
    "go": (GO, [("struct", "Server", True, 2, 4), ("interface", "Reader", True, 6, 6), ("type", "name", False, 7, 7), ("method", "Server.Serve", True, 9, 13), ("function", "helper", False, 14, 14), ("function", "Main", True, 15, 15)],
        [("HAS_METHOD", "Server", "Server.Serve", 9), ("CALLS", "Server.Serve", "handle", 10), ("CALLS", "Server.Serve", "inside", 11), ("CALLS", "Server.Serve", "Atoi", 12), ("CALLS", "Server.Serve", "wrap", 12), ("CALLS", "Main", "Map", 15)]),
    "rs": (RUST, [("struct", "Point", True, 2, 2), ("enum", "Shape", False, 3, 3), ("trait", "Draw", True, 4, 4), ("method", "Point.draw", False, 6, 6), ("method", "Point.make", True, 7, 7), ("function", "deep", True, 9, 9), ("function", "main", False, 10, 10)],
        [("IMPLEMENTS", "Point", "Draw", 5), ("HAS_METHOD", "Point", "Point.draw", 6), ("CALLS", "Point.draw", "paint", 6), ("HAS_METHOD", "Point", "Point.make", 7), ("CALLS", "Point.make", "new", 7), ("CALLS", "Point.make", "read", 7), ("CALLS", "Point.make", "len", 7),
         ("CALLS", "deep", "parse", 9), ("CALLS", "main", "close", 10), ("CALLS", "main", "deep", 10)]),
    "java": (JAVA, [("class", "Shop", True, 2, 11), ("method", "Shop.sell", True, 6, 7), ("method", "Shop.quiet", False, 8, 8), ("enum", "Mode", False, 9, 9), ("method", "Mode.on", False, 9, 9), ("interface", "Inner", False, 10, 10), ("method", "Inner.act", False, 10, 10)],
        [("EXTENDS", "Shop", "Base", 3), ("IMPLEMENTS", "Shop", "Seller", 3), ("IMPLEMENTS", "Shop", "List", 3), ("HAS_METHOD", "Shop", "Shop.sell", 6), ("CALLS", "Shop.sell", "pay", 7), ("CALLS", "Shop.sell", "m.get", 7), ("CALLS", "Shop.sell", "Order", 7),
         ("HAS_METHOD", "Shop", "Shop.quiet", 8), ("CALLS", "Shop.quiet", "list.forEach", 8), ("CALLS", "Shop.quiet", "use", 8), ("CALLS", "Shop.quiet", "quiet", 8), ("CALLS", "Shop.quiet", "Deep", 8),
         ("IMPLEMENTS", "Mode", "Flag", 9), ("HAS_METHOD", "Mode", "Mode.on", 9), ("CALLS", "Mode.on", "check", 9), ("EXTENDS", "Inner", "One", 10), ("EXTENDS", "Inner", "Two", 10), ("HAS_METHOD", "Inner", "Inner.act", 10)]),
}


def test_script():
    found = S.parse("src/a.tsx", SCRIPT)
    assert found.symbols == SCRIPT_SYMBOLS
    assert found.edges == SCRIPT_EDGES


@pytest.mark.parametrize("ext", OTHERS)
def test_other_languages(ext):
    text, symbols, edges = OTHERS[ext]
    found = S.parse(f"a.{ext}", text)
    assert found.symbols == symbols
    assert sorted(found.edges) == sorted(edges)


def test_odd_texts(spark):
    broken = ["", None, "}}}} class {", "function f( {", "class A {", "const", "const a", "export", "a => ", "`${", "impl for {", "func (", "type (", "'", "/", "def f(:", "public class", "interface X"]
    for text in broken:
        for ext in [*S.GRAMMARS, "md"]:
            S.parse(f"x.{ext}", text)
    assert S.parse("x.md", SCRIPT) == S.Found() and S.parse("x.ts", None) == S.Found()
    deep = S.parse("x.ts", "function f() {" + "if (a(b)) {" * 20_000 + "}" * 20_001)
    assert deep.symbols == [("function", "f", False, 1, 1)] and len(deep.edges) == 20_000
    less = S.parse("x.ts", "function f(p) { g(p); return " + "a<" * 100_000 + "b }")
    assert less.edges == [("CALLS", "f", "g", 1)]
    files = spark.createDataFrame([("a.ts", None), (None, SCRIPT), ("b.txt", SCRIPT)], "file_path string, content string")
    assert S.structure(files).collect() == []


def test_resolution(spark):
    files = {
        "p/a.ts": "import { g } from './b';\nexport class A { run() { g(); this.own(); B.make(); only(); both(); none(); } own() {} }",
        "p/b.ts": "export function g() {}\nexport function both() {}\nexport class B { make() {} }",
        "p/c.ts": "export function g() {}\nexport function both() {}\nexport function only() { g(); }\nfunction hid() {}",
        "p/d.ts": "export function user() { hid(); A.run(); x.y.make(); }",
    }
    found = S.structure(spark.createDataFrame(list(files.items()), "file_path string, content string")).cache()
    imports = spark.createDataFrame([("p/a.ts", "p/b.ts")], "source_file string, target_file string")
    got = S.resolve_edges(S.edges_of(found), S.symbols_of(found), imports).collect()
    assert sorted((r["source_file"][2], r["source"], r["target_file"][2], r["target"], r["edge_type"], r["confidence"]) for r in got) == [
        ("a", "A", "a", "A.own", "HAS_METHOD", 1.0), ("a", "A", "a", "A.run", "HAS_METHOD", 1.0),
        ("a", "A.run", "a", "A.own", "CALLS", 1.0), ("a", "A.run", "b", "B.make", "CALLS", 0.9), ("a", "A.run", "b", "both", "CALLS", 0.9), ("a", "A.run", "b", "g", "CALLS", 0.9), ("a", "A.run", "c", "only", "CALLS", 0.7),
        ("b", "B", "b", "B.make", "HAS_METHOD", 1.0), ("c", "only", "c", "g", "CALLS", 1.0),
        ("d", "user", "a", "A.run", "CALLS", 0.7), ("d", "user", "b", "B.make", "CALLS", 0.7),
    ]


def test_import_paths(spark):
    have = ["p/q/x.ts", "c.ts", "p/c.ts", "p/q/a.ts", "p/q/a.tsx", "p/q/j.tsx", "p/q/j.ts", "p/q/d/index.tsx", "p/q/raw.json", "w.ts"]
    files = spark.createDataFrame([(f, "") for f in have], "file_path string, content string")
    ask = {"../../c": "c.ts", "./b/../../c": "p/c.ts", "./a": "p/q/a.ts", "./a.ts": "p/q/a.ts", "./j.js": "p/q/j.tsx", "./d": "p/q/d/index.tsx", "./raw.json": "p/q/raw.json", "../../../w": None, "./none": None, ".././/q/./a": "p/q/a.ts", "..": None}
    imports = spark.createDataFrame([("p/q/x.ts", s) for s in ask], "file_path string, specifier string")
    got = {r["specifier"]: r["target_file"] for r in P.resolve_imports(imports, files).collect()}
    assert got == {k: v for k, v in ask.items() if v}


def test_import_statements(spark):
    text = "import a from './a';\nimport {\n  b } from \"../b.js\";\nexport * from './a';\nimport x from 'pkg';\nrequire('./no');\nexport { c } from './c'; import { d } from './d';"
    files = spark.createDataFrame([("x.ts", text), ("y.ts", None)], "file_path string, content string")
    assert sorted(r["specifier"] for r in P.extract_imports(files).collect()) == ["../b.js", "./a", "./c", "./d", "./no"]
    assert rows(["n"], [(P.extract_imports(files.where(F.lit(False))).count(),)]) == [(0,)]
