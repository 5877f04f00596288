"""Projectors: own sources and their declarations in every mode."""

import pytest

from lithos.functions.layout import LINE, concat, group, indent, listing, render, reserve, text, width
from lithos.lang import elm, haskell, python, rust
from lithos.lang.items import Item, Keys, ProjectionError, canonical_text, check
from lithos.operators.projection import project_source

PYTHON = '''
"""Module text."""
import os
from dataclasses import dataclass

LIMIT: int = 3
retries = 5
Name = NewType("Name", str)
type Grid[T] = list[list[T]]


@dataclass
class Shelf(Base, kind="wide"):
    """Doc."""
    slots: dict[str, int] = {}
    count = 0

    def put(self, item, /, *extra: int, at: int = 1, **more) -> None:
        def inner(): ...
        self.x = item

    async def take(self): return 1

    class Label:
        text: str


class Mood(Enum):
    GOOD = 1
    BAD = 2


class TestShelf:
    size: int

    def test_put(self): ...
    def helper(self): ...


def test_alone(fixture): pass


if os.name:
    def hidden(): ...
'''

PYTHON_SIGNATURES = '''LIMIT: int

retries

Name = NewType("Name", str)

type Grid[T] = list[list[T]]

@dataclass
class Shelf(Base, kind="wide"):
    slots: dict[str, int]
    count
    def put(self, item, /, *extra: int, at: int = 1, **more) -> None: ...
    async def take(self): ...
    class Label:
        text: str

class Mood(Enum):
    GOOD
    BAD

class TestShelf:
    size: int
    def test_put(self): ...
    def helper(self): ...

def test_alone(fixture): ...
'''

RUST = """
//! Crate.
use std::fmt;

/// Doc.
#[derive(Debug)]
pub struct Crate<T: Copy> where T: Send, { pub id: u64, #[serde(skip)] items: Vec<(String, T)>, }
pub struct Pair(pub i8, i16);
enum Kind { A, B(u8), C { x: i32, y: i32 }, D = 4 }
type Short = Result<(), Box<dyn std::error::Error + 'static>>;
impl<T: Copy> Crate<T> {
    pub const SIZE: usize = 3;
    pub fn open(&mut self, key: &str) -> Option<&T> where T: Clone { if key < "a" { None } else { None } }
}
impl Empty { }
impl fmt::Display for Kind { fn fmt(&self, f: &mut fmt::Formatter<'_>) -> fmt::Result { Ok(()) } }
pub trait Open: Send { type Key; fn open(&self, key: Self::Key) -> bool { true } }
mod inner { pub static mut N: i32 = 1; #[tokio::test] async fn works() {} }
mod outside;
extern "C" { fn puts(s: *const u8) -> i32; }
macro_rules! m { () => { struct Hidden; } }
#[test]
fn free() { fn local() {} }
"""

RUST_SIGNATURES = """#[derive(Debug)]
pub struct Crate<T: Copy>
where T: Send
{
    pub id: u64,
    #[serde(skip)]
    items: Vec<(String, T)>,
}

pub struct Pair(pub i8, i16);

enum Kind {
    A,
    B(u8),
    C { x: i32, y: i32 },
    D = 4,
}

type Short = Result<(), Box<dyn std::error::Error + 'static>>;

impl<T: Copy> Crate<T> {
    pub const SIZE: usize;
    pub fn open(&mut self, key: &str) -> Option<&T>
    where T: Clone;
}

impl fmt::Display for Kind {
    fn fmt(&self, f: &mut fmt::Formatter<'_>) -> fmt::Result;
}

pub trait Open: Send {
    type Key;
    fn open(&self, key: Self::Key) -> bool;
}

mod inner {
    pub static mut N: i32;
    #[tokio::test]
    async fn works();
}

extern "C" {
    fn puts(s: *const u8) -> i32;
}

#[test]
fn free();
"""

HASKELL = """{-# LANGUAGE Strict #-}
module Shop.Cart (add) where
import Data.Map (Map)

-- a comment
type Price = Int
newtype Total = Total { unTotal :: Price } deriving (Eq)
data Line = Line !Int (Maybe Price) | Free deriving stock (Show)
data Cell a where { Num :: Int -> Cell Int; Nil :: Cell a }
class Monoid m => Store m where
  put :: Int -> m -> m
  put _ = id
  type Key m
instance Store Total where
  put n t = t
type family Elem c where
  Elem [e] = e
infixl 6 <+>
(<+>) :: Price -> Price -> Price
a <+> b = a + b
total xs = sum xs
empty' = 0
deriving instance Show Total
foreign import ccall "exp" c_exp :: Double -> Double
"""

HASKELL_SIGNATURES = """{-# LANGUAGE Strict #-}
module Shop.Cart

type Price = Int

newtype Total = Total
    { unTotal :: Price
    }
    deriving (Eq)

data Line
    = Line !Int (Maybe Price)
    | Free
    deriving stock (Show)

data Cell a where
    Num :: Int -> Cell Int
    Nil :: Cell a

class Monoid m => Store m where
    put :: Int -> m -> m
    type Key m

instance Store Total where
    put n t

type family Elem c where
    Elem [e] = e

(<+>) :: Price -> Price -> Price

total xs

empty'

deriving instance Show Total

foreign import ccall "exp" c_exp :: Double -> Double
"""

ELM = """port module Shop exposing (..)

import Html

{-| Doc -}
type Item msg
    = Plain String
    | Deal { price : Int, tags : List ( String, Int ) } (Maybe msg)

type alias Cart =
    { items : List (Item Never), total : Float }

type alias Step a = a -> Cart -> ( a, Cart )

port save : String -> Cmd msg

infix left 4 (|=) = keep

price : Item msg -> Int
price item =
    case item of
        _ -> 1

name =
    "x -- y"
"""

ELM_SIGNATURES = """port module Shop

type Item msg
    = Plain String
    | Deal { price : Int, tags : List (String, Int) } (Maybe msg)

type alias Cart =
    { items : List (Item Never)
    , total : Float
    }

type alias Step a = a -> Cart -> (a, Cart)

port save : String -> Cmd msg

infix left 4 (|=) = keep

price : Item msg -> Int

name : <missing type annotation>
"""

CASES = [(python, "a/b.py", PYTHON, PYTHON_SIGNATURES), (rust, "a/b.rs", RUST, RUST_SIGNATURES), (haskell, "a/B.hs", HASKELL, HASKELL_SIGNATURES), (elm, "a/B.elm", ELM, ELM_SIGNATURES)]


@pytest.mark.parametrize(("lang", "path", "source", "expected"), CASES)
def test_signatures(lang, path, source, expected):
    items = lang.project(path, source)
    assert canonical_text(items["signatures"]) == expected
    keys = {i.stable_key for i in items["signatures"]}
    for mode, found in items.items():
        check(found)
        assert {i.stable_key for i in found} <= keys, mode
    data = source.encode()
    for i in items["signatures"]:
        assert data[: i.start_byte].count(b"\n") == i.start_line and i.start_byte <= i.end_byte and data[: i.end_byte].count(b"\n") == i.end_line


@pytest.mark.parametrize(("lang", "path", "source", "expected"), CASES)
def test_projecting_a_projection_of_types_changes_nothing_by_spacing(lang, path, source, expected):
    """Blank lines and comments between declarations are not seen."""
    mark = {"py": "# note\n", "rs": "// note\n", "hs": "-- note\n", "elm": "-- note\n"}[path.rsplit(".", 1)[1]]
    spaced = source.replace("\n\n", "\n\n" + mark + "\n\n") + "\n" + mark
    if lang is python:
        spaced = source.replace("\n\n\n", "\n\n\n" + mark + "\n") + "\n" + mark
    a, b = lang.project(path, source), lang.project(path, spaced)
    for mode in a:
        assert [(i.stable_key, i.canonical_text) for i in a[mode]] == [(i.stable_key, i.canonical_text) for i in b[mode]]


def test_modes():
    assert canonical_text(python.project("x.py", PYTHON)["tests"]) == "class TestShelf:\n    def test_put(self): ...\n\ndef test_alone(fixture): ...\n"
    types = canonical_text(python.project("x.py", PYTHON)["types"])
    assert "put" not in types and "slots: dict[str, int]" in types and "LIMIT" not in types and "GOOD" in types
    assert canonical_text(rust.project("x.rs", RUST)["tests"]) == "mod inner {\n    #[tokio::test]\n    async fn works();\n}\n\n#[test]\nfn free();\n"
    assert "fn " not in canonical_text(rust.project("x.rs", RUST)["types"]) and "impl fmt::Display for Kind {}" in canonical_text(rust.project("x.rs", RUST)["types"])
    assert haskell.project("x.hs", HASKELL)["tests"] == elm.project("x.elm", ELM)["tests"] == []


def test_keys_and_parents():
    items = {i.stable_key: i for i in python.project("x.py", PYTHON)["signatures"]}
    assert items["x.py::class::Shelf::method::put"].parent_key == "x.py::class::Shelf" and items["x.py::class::Shelf::class::Label::field::text"].kind == "field"
    assert {"impl Crate<T>", "impl fmt::Display for Kind", "x.rs::mod::inner::fn::works", "x.rs::type::Kind::variant::C"} <= {i.stable_key for i in rust.project("x.rs", RUST)["signatures"]}
    assert {"Shop type Item", "Shop constructor Deal", "Shop type alias Cart", "Shop field total", "Shop"} <= {i.stable_key for i in elm.project("x.elm", ELM)["signatures"]}
    assert {"x.hs::class::Store::method::put", "x.hs::fn::<+>", "x.hs::value::empty'", "x.hs::instance::Store"} <= {i.stable_key for i in haskell.project("x.hs", HASKELL)["signatures"]}
    twice = [i.stable_key for i in python.project("x.py", "def f(): ...\ndef f(): ...\ndef f(): ...\n")["signatures"]]
    assert twice == ["x.py::fn::f", "x.py::fn::f~1", "x.py::fn::f~2"]


@pytest.mark.parametrize(("lang", "source"), [(python, "def f(:\n"), (python, "x = 'a\n"), (rust, "fn f( {"), (rust, "struct S { a: }}"), (haskell, "f = (1"), (elm, "f = [1"), (elm, "type alias A = (")])
def test_broken_sources_are_refused(lang, source):
    with pytest.raises(ProjectionError):
        lang.project("x", source)
    with pytest.raises(ProjectionError):
        project_source("x", b"\xff", "python")


def test_empty_sources_declare_nothing():
    for lang in (python, rust, haskell, elm):
        assert all(not found for found in lang.project("x", "").values())


def test_long_headers_break_at_the_last_list():
    source = "def f(alpha: dict[str, int], beta: list[tuple[str, int]], gamma: set[str], delta: int) -> list[dict[str, tuple[int, int]]]: ...\n"
    assert canonical_text(python.project("x.py", source)["signatures"]) == "def f(\n    alpha: dict[str, int],\n    beta: list[tuple[str, int]],\n    gamma: set[str],\n    delta: int,\n) -> list[dict[str, tuple[int, int]]]: ...\n"


def test_layout():
    words = [text("w" * 20) for _ in range(4)]
    assert render(listing("(", words[:3], ")")) == "(" + ", ".join(["w" * 20] * 3) + ")"
    assert render(listing("(", words, ")")) == "(\n" + "".join(f"    {'w' * 20},\n" for _ in range(4)) + ")"
    assert render(concat("x", reserve(20), group(text("y" * 60), indent(LINE)))) .startswith("x" + "y" * 60)
    assert width("ab") == 2 and width("日本") == 4 and width("é") == 1


def test_structure_checks():
    def item(key, parent=None):
        return Item(key, parent, "type", key, 0, 0, 0, 0, 0, 0, key)

    check([item("a"), item("b", "a")])
    for bad in ([item("a"), item("a")], [item("a", "z")], [item("a", "a")], [item("a", "b"), item("b", "a")]):
        with pytest.raises(ProjectionError):
            check(bad)
    keys = Keys()
    assert [keys.new("k") for _ in range(3)] == ["k", "k~1", "k~2"] and canonical_text([]) == ""


def test_rust_values_and_const_braces():
    """Shifts and comparisons in discriminants are no brackets, and braces of const generics no bodies."""
    source = """
enum E { A = 1 << 2, B { x: u8 }, C(u8), D = f::<u8, 3>() >> 1, F = (1 < 2) as isize, G(Vec<(u8, u8)>) }
struct S<const N: usize = { 3 }> { a: [u8; N], b: HashMap<u8, [u8; { N + 1 }]> }
struct T<const N: usize = { 1 + 2 }>(u8);
impl Foo<{ N }> { pub fn get(&self) -> Bar<{ N }> { 1 } }
impl<const N: usize> Kept for Foo<{ N }> { type X = Vec<Vec<u8>>; }
fn free<T: Fn(u8) -> u8>(a: A<{ 3 }>) -> B<{ 4 }> {}
trait Q<const N: u8 = { 1 }> { fn m(&self); }
"""
    items = {i.stable_key: i.canonical_text for i in rust.project("p", source)["signatures"]}
    assert [k for k in items if "::variant::" in k] == [f"p::type::E::variant::{v}" for v in "ABCDFG"]
    assert items["p::type::E::variant::A"] == "A = 1 << 2" and items["p::type::E::variant::D"] == "D = f::<u8, 3>() >> 1" and items["p::type::E::variant::G"] == "G(Vec<(u8, u8)>)"
    assert [k for k in items if "::field::" in k] == ["p::type::S::field::a", "p::type::S::field::b"]
    assert items["p::type::T"] == "struct T<const N: usize = { 1 + 2 }>(u8);"
    assert items["impl Foo<{ N }>::method::get"] == "pub fn get(&self) -> Bar<{ N }>;"
    assert items["impl Kept for Foo<{ N }>::assoc_type::X"] == "type X = Vec<Vec<u8>>;"
    assert items["p::fn::free"] == "fn free<T: Fn(u8) -> u8>(a: A<{ 3 }>) -> B<{ 4 }>;" and "p::trait::Q::method::m" in items


def test_equal_lines_are_parsed_once_and_as_in_their_file(monkeypatch):
    from lithos.lang import repeated
    from lithos.operators import projection

    good = {
        "python": ["def a(n: int) -> str: return 'x'", "def test_b(): pass", "def a(n: int) -> str: return 'x'", "def c(x, *, y: list[int] = [1, 2], **k): yield '''q'''", "def test_b(): pass", "def a(): ..."],
        "rust": ["pub fn a(n: u8) -> Option<u8> { Some(n << 1) }", "fn b() {}", "pub fn a(n: u8) -> Option<u8> { Some(n << 1) }", "fn c<T: Ord>(x: &[T], y: T) -> Vec<T> where T: Clone { x.to_vec() }", "fn b() {}"],
    }
    odd = {
        "python": ["def f(): (", "def f(): '''", "def f(): x = 1; y: int = 2", "@d", "", "class A: pass", "x = 1", "def é(): pass", "def g(): pass # c", "def h(x,", "    y): pass"],
        "rust": ["fn a() {} fn b() {}", "fn f() {", "#[test]", "/// d", "}", "struct A {}", "fn f() {} }", "mod m { fn f() {} }", "fn x(&self);"],
    }

    def outcome(made):
        try:
            return made()
        except projection.ProjectionError as e:
            return str(e)

    for language, lines in good.items():
        whole, calls = projection.PROJECTORS[language], []
        monkeypatch.setitem(projection.PROJECTORS, language, lambda p, s, whole=whole, calls=calls: calls.append(s) or whole(p, s))
        repeated._alone.cache_clear()
        for end in ("", "\n"):
            assert projection.project_source("d/x", "\n".join(lines * 3) + end, language) == whole("d/x", "\n".join(lines * 3) + end)
        assert sorted(calls) == sorted(set(lines))
        for line in odd[language]:
            for source in (line, "\n".join([lines[0], line, *lines[1:]]), "\n".join([*lines, line])):
                assert outcome(lambda source=source: projection.project_source("d/x", source, language)) == outcome(lambda source=source: whole("d/x", source))


def test_lines_that_differ_in_a_name_are_parsed_once_as_columns():
    from lithos.lang import repeated
    from lithos.operators import projection

    names = ["a", "q", "qq", "zq", "w_word", "_", "__init__", "test_", "test_a", "testa", "match", "type", "union", "default", "where", "self", "r", "b", "f", "x" * 40, "y" * 75, "y" * 79, "z" * 90, "w" * 470]
    rests = {
        "python": ["(n: int) -> str: return 'x'", "(): ...", "[T](x: T, q: int = 1, *, qq: list[int] = [1, 2], **k) -> dict[str, int]: yield '''q'''", "(q, w_word): pass", " (x): pass"],
        "rust": ["(n: u8) -> Option<u8> { Some(n << 1) }", "();", "<T: Ord>(x: &[T], q: T) -> Vec<T> where T: Clone { x.to_vec() }", "(a: A, qq: B) {}", " (x: u8) {}"],
    }
    odd = {
        "python": ["def f(): (", "def f(): '''", "def f(): x = 1; y: int = 2", "@d", "", "class A: pass", "def if(): pass", "def é(): pass", "def g(): pass # c", "def h(x,", "def  two(): pass", "def w" + "w" * 500 + "(): pass"],
        "rust": ["fn a() {} fn b() {}", "fn f() {", "#[test]", "/// d", "", "}", "struct A {}", "fn f() {} }", "fn x(&self);", "fn r#x() {}", "pub  fn two() {}", "fn w" + "w" * 500 + "() {}"],
    }
    columns = ["mode", "ordinal", *projection._COLUMNS, "error"]
    for language, whole in (("python", python.project), ("rust", rust.project)):
        begins = ["def "] if language == "python" else ["fn ", "pub fn "]
        lines = [b + name + rest for name in names for b in begins for rest in rests[language]]
        files = {"one": lines[0], "end": lines[0] + "\n", "all": "\n".join([*lines, *reversed(lines)]), **{f"o{i}": "\n".join([lines[1], x, lines[1]]) for i, x in enumerate(odd[language])}, **{f"f{i}": x for i, x in enumerate(lines)}, "blank": lines[0] + "\n\n"}
        expected = {}
        for path, source in files.items():
            try:
                expected[path] = {(mode, i, *(getattr(item, c) for c in projection._COLUMNS), None) for mode, own in whole(path, source).items() for i, item in enumerate(own)}
            except ProjectionError:
                expected[path] = None
        rest, portions = repeated.by_columns(whole, language, list(files), list(files.values()), ("types", "signatures", "tests"), columns)
        found = {path: set() for path in files}
        for owner, arrays in portions:
            for n, *row in zip(owner.tolist(), *(a.to_pylist() for a in arrays), strict=True):
                found[list(files)[n]].add(tuple(row))
        left = [list(files)[n] for n in rest]
        assert all(not found[path] for path in left)
        assert all(found[path] == expected[path] for path in files if path not in left)
        fine = [p for p, s in files.items() if p[0] == "f" and len(s) <= 500 and expected[p] is not None]
        assert len(fine) > 100 and not set(left) & {"one", "end", *fine}

    calls = []
    text = "\n".join(f"def w_{i:06d}(n: int) -> str: return 'x'" for i in range(5000))
    rest, portions = repeated.by_columns(lambda p, s: calls.append(s) or python.project(p, s), "python", ["p"], [text], ["signatures"], ["name"])
    assert not rest and [x for _, (a,) in portions for x in a.to_pylist()] == [f"w_{i:06d}" for i in range(5000)] and len(calls) == 1


def test_items_of_line_made_and_other_files(spark):
    from lithos.operators import projection

    made = {"a.py": "def a(n: int) -> str: ...\ndef test_b(): pass\ndef a(): ...", "b.rs": "pub fn a() {}\nfn a();", "c.py": "class A:\n    x: int\n", "d.py": "", "e.py": "def a(): ...\n\n\nx = 1\n", "f.rs": "fn f() {}\nmod m { fn f() {} }", "g.elm": "module G exposing (..)\n", "h.py": None}
    language = {"py": "python", "rs": "rust", "elm": "elm"}
    files = spark.createDataFrame([(k, language[k.split(".")[1]], v) for k, v in made.items()], "path string, language string, text string")
    expected = {(k, mode, i, item.stable_key, item.canonical_text) for k, v in made.items() for mode, own in projection.project_source(k, v or "", language[k.split(".")[1]]).items() for i, item in enumerate(own)}
    rows = projection.items(files, ["path"])
    assert rows.columns == ["path", "language", *(c.split(" ")[0] for c in projection.SCHEMA.split(", "))]
    shown = ["path", "mode", "ordinal", "stable_key", "canonical_text"]
    assert sorted(map(tuple, rows.select(shown).collect())) == sorted(expected)
    some = projection.items(files.coalesce(1), ["path"], modes=["signatures", "tests"], columns=shown, dealt=True)
    assert some.columns == ["path", "language", "mode", "ordinal", "stable_key", "canonical_text", "error"]
    assert {tuple(r) for r in some.select(shown).collect()} == {e for e in expected if e[1] != "types"}
    marks = projection.items(files, ["path"], marked=True).where("mode is null")
    assert {r.path for r in marks.collect()} == {"d.py", "h.py"}
    bad = files.unionAll(spark.createDataFrame([("z.py", "python", "def a(): ...\ndef b(:")], files.schema))
    with pytest.raises(Exception, match="not Python"):
        projection.checked(projection.items(bad, ["path"], modes=["signatures"], columns=["ordinal"])).where("error is null").select("path", "ordinal").collect()
