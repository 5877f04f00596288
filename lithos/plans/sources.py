"""Two snapshots of source files derived from a table of documents, so that projections have something to read.

Every document gives one small file of the language ``doc_id % 4``. By ``doc_id % 7``
a file is only new (0), only old (1), has another body and comment (2), another
signature (3), moved as it is (4), or is the same on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithos.functions.blobs import content_id

#: Sources by language: the extension and the text, where {d} is the document's id, {n} a number and {t} a type.
TEMPLATES: dict[str, tuple[str, str]] = {
    "python": ("py", '# note {n}\nclass C{d}:\n    x: {t}\n\n    def m{d}(self, a: {t}) -> str:\n        return "{n}"\n\n\ndef f{d}(a: int, b: str = "x") -> {t}:\n    return {n}\n\n\ndef test_f{d}() -> None:\n    assert {n}\n'),
    "rust": ("rs", "/// Note {n}.\npub struct S{d} {\n    pub a: {t},\n}\n\nimpl S{d} {\n    pub fn get(&self) -> {t} {\n        {n}\n    }\n}\n\n#[test]\nfn t{d}() {\n    assert!({n} > 0);\n}\n"),
    "elm": ("elm", "module M{d} exposing (..)\n\n\nvalue : {t} -> Int\nvalue x =\n    x + {n}\n"),
    "haskell": ("hs", "module M{d} where\n\n-- note {n}\ndata T{d} = A {t} | B\n\nf :: {t} -> Int\nf x = x + {n}\n"),
}
LANGUAGES = ("python", "rust", "elm", "haskell")
#: Types by language: as in the old snapshot, and as in the new one of files whose signature changes.
TYPES = {"python": ("int", "float"), "rust": ("u32", "u64"), "elm": ("Int", "Float"), "haskell": ("Int", "Bool")}


def _pick(values: dict[str, str], language: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), language)


def _files(docs: DataFrame, new: bool) -> DataFrame:
    d, m = F.col("doc_id"), F.col("doc_id") % 7
    language = F.element_at(F.array(*map(F.lit, LANGUAGES)), (d % 4 + 1).cast("int"))
    rows = docs.select(F.col("source").alias("repo"), language.alias("language"), d.cast("string").alias("d"), m.alias("m")).where("m <> 1" if new else "m <> 0")
    text, key = _pick({k: v[1] for k, v in TEMPLATES.items()}, F.col("language")), F.concat(F.lpad("d", 8, "0"), F.lit("."), _pick({k: v[0] for k, v in TEMPLATES.items()}, F.col("language")))
    number = F.when((F.col("m") == 2) & F.lit(new), "2").otherwise("1")
    type_ = F.when((F.col("m") == 3) & F.lit(new), _pick({k: v[1] for k, v in TYPES.items()}, F.col("language"))).otherwise(_pick({k: v[0] for k, v in TYPES.items()}, F.col("language")))
    for mark, value in (("{d}", F.col("d")), ("{n}", number), ("{t}", type_)):
        text = F.replace(text, F.lit(mark), value)
    path = F.concat(F.when((F.col("m") == 4) & F.lit(new), "moved/").otherwise("src/"), key)
    return rows.select("repo", path.alias("path"), "language", text.alias("text"))


def _entries(files: DataFrame) -> DataFrame:
    return files.select("repo", "path", "language", content_id(F.col("text")).alias("blob_id"), F.octet_length("text").cast("long").alias("size"), "text")


def base(docs: DataFrame) -> DataFrame:
    """Entries of the old snapshot: repo, path, language, blob_id, size, text."""
    return _entries(_files(docs, False))


def target(docs: DataFrame) -> DataFrame:
    """Entries of the new snapshot."""
    return _entries(_files(docs, True))


# -- what the projections must be, for SQL --------------------------------------

#: Items of every template in the order of the signatures mode: language, ordinal, key, parent, kind, name, first line with what
#: stands above it, declaration's line, last line, level, ordinal in the types and in the tests mode (null if it is not in them),
#: text in signatures, text in types. {p} is the path.
ITEMS = [
    ("python", 0, "{p}::class::C{d}", None, "type", "C{d}", 0, 1, 5, 0, 0, None, "class C{d}:\n    x: {t}\n    def m{d}(self, a: {t}) -> str: ...", "class C{d}:\n    x: {t}"),
    ("python", 1, "{p}::class::C{d}::field::x", "{p}::class::C{d}", "field", "x", 2, 2, 2, 1, 1, None, "x: {t}", "x: {t}"),
    ("python", 2, "{p}::class::C{d}::method::m{d}", "{p}::class::C{d}", "method", "m{d}", 4, 4, 5, 1, None, None, "def m{d}(self, a: {t}) -> str: ...", None),
    ("python", 3, "{p}::fn::f{d}", None, "function", "f{d}", 8, 8, 9, 0, None, None, 'def f{d}(a: int, b: str = "x") -> {t}: ...', None),
    ("python", 4, "{p}::fn::test_f{d}", None, "function", "test_f{d}", 12, 12, 13, 0, None, 0, "def test_f{d}() -> None: ...", None),
    ("rust", 0, "{p}::type::S{d}", None, "type", "S{d}", 0, 1, 3, 0, 0, None, "pub struct S{d} {\n    pub a: {t},\n}", "pub struct S{d} {\n    pub a: {t},\n}"),
    ("rust", 1, "{p}::type::S{d}::field::a", "{p}::type::S{d}", "field", "a", 2, 2, 2, 1, 1, None, "pub a: {t}", "pub a: {t}"),
    ("rust", 2, "impl S{d}", None, "trait_implementation", "S{d}", 5, 5, 9, 0, None, None, "impl S{d} {\n    pub fn get(&self) -> {t};\n}", None),
    ("rust", 3, "impl S{d}::method::get", "impl S{d}", "method", "get", 6, 6, 8, 1, None, None, "pub fn get(&self) -> {t};", None),
    ("rust", 4, "{p}::fn::t{d}", None, "function", "t{d}", 11, 12, 14, 0, None, 0, "#[test]\nfn t{d}();", None),
    ("elm", 0, "M{d}", None, "module", "M{d}", 0, 0, 0, 0, 0, None, "module M{d}", "module M{d}"),
    ("elm", 1, "M{d} function value", None, "function", "value", 4, 4, 5, 0, None, None, "value : {t} -> Int", None),
    ("haskell", 0, "{p}::module::M{d}", None, "module", "M{d}", 0, 0, 0, 0, 0, None, "module M{d}", "module M{d}"),
    ("haskell", 1, "{p}::type::T{d}", None, "type", "T{d}", 2, 3, 3, 0, 1, None, "data T{d}\n    = A {t}\n    | B", "data T{d}\n    = A {t}\n    | B"),
    ("haskell", 2, "{p}::fn::f", None, "function", "f", 5, 5, 5, 0, None, None, "f :: {t} -> Int", None),
]


def _sql(value: object) -> str:
    return "NULL" if value is None else str(value) if isinstance(value, int) else "'" + str(value).replace("'", "''") + "'"


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in rows)


#: CTEs: sbase and starget with the files' repo, path, language, id, number, type and text; items_base and items_target with
#: what each file declares; all in DuckDB's SQL.
SQL = f"""
tpl AS (SELECT * FROM (VALUES {_values([(k, i, *TEMPLATES[k], *TYPES[k]) for i, k in enumerate(LANGUAGES)])}) v(language, i, ext, tpl, t_old, t_new)),
item AS (SELECT * FROM (VALUES {_values(ITEMS)}) v(language, ordinal, k, parent, kind, name, start_line, declaration_line, end_line, level, in_types, in_tests, signatures, types)),
all_files AS (SELECT source AS repo, tpl.*, doc_id % 7 AS m, doc_id::VARCHAR AS d, lpad(doc_id::VARCHAR, 8, '0') || '.' || ext AS file FROM documents JOIN tpl ON doc_id % 4 = tpl.i),
sbase AS (SELECT repo, 'src/' || file AS path, language, m, d, t_old AS t, replace(replace(replace(tpl, '{{d}}', d), '{{n}}', '1'), '{{t}}', t_old) AS text FROM all_files WHERE m <> 0),
starget AS (SELECT repo, CASE WHEN m = 4 THEN 'moved/' ELSE 'src/' END || file AS path, language, m, d, CASE WHEN m = 3 THEN t_new ELSE t_old END AS t,
    replace(replace(replace(tpl, '{{d}}', d), '{{n}}', CASE WHEN m = 2 THEN '2' ELSE '1' END), '{{t}}', CASE WHEN m = 3 THEN t_new ELSE t_old END) AS text FROM all_files WHERE m <> 1)""" + "".join(
    f""",
items_{side} AS (SELECT repo, path, f.language, m, d, ordinal, {", ".join(f"replace(replace(replace({c}, '{{p}}', path), '{{d}}', d), '{{t}}', t) AS {a}" for c, a in (("k", "stable_key"), ("parent", "parent_key"), ("name", "name"), ("signatures", "signatures"), ("types", "types")))},
    kind, start_line, declaration_line, end_line, level, in_types, in_tests FROM s{side} f JOIN item USING (language))"""
    for side in ("base", "target")
)
