"""The thin queries over the operators, and SQL where it can express them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, lexical, licenses, manifest, merkle, minhash, packing, pii, style_tree, token_files, toxicity
from .shared import new_path, tune


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style_tree.extract(_table(spark, sf_dir, "pages"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.char_model(docs)
    scored = toxicity.score(docs, model, toxicity.train(docs, _table(spark, sf_dir, "labels"), model))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = merkle.fingerprints(_table(spark, sf_dir, "documents"))
    return prints.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    token_files.write(_table(spark, sf_dir, "documents"), path)
    return token_files.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def _chat_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation from its sorted parts, read back as a stream."""
    key, state, out = None, None, []

    def row() -> tuple:
        n, turns, chars, loss, length = state
        return key, n, turns.hexdigest(), chars, loss.hexdigest(), length

    def table() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    for batch in batches:
        for conv, formatted, starts, ends, mask in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "token_starts", "token_ends", "loss_mask")), strict=True):
            if state is None or conv != key:
                if state is not None:
                    out.append(row())
                key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in chat.parse(formatted):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            for text in chat.masked_texts(formatted, starts, ends, mask):
                state[2] += len(text)
                state[3].update(text.encode("utf-8", "surrogatepass"))
            state[4] += len(formatted)
        if len(out) >= 1000:
            yield table()
            out = []
    if state is not None:
        out.append(row())
    if out:
        yield table()


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], turns.schema)
    formatted = chat.format_chat(turns.unionAll(trap))
    dealt = formatted.select("conv_id", "segment", "part", "formatted", "token_starts", "token_ends", "loss_mask").repartition("conv_id").sortWithinPartitions("conv_id", "segment", "part")
    return dealt.mapInArrow(_chat_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), k=3, percent=85)


def op9_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_dataset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    changed = F.when(tampered, manifest.digest_of([*map(F.col, fields[:-1]), manifest.ascii_lower(F.col("text"))]))
    checked = manifest.verify(manifest.manifest(_table(spark, sf_dir, "documents"), fields, changed=changed))
    return checked.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    read_back = bpe.decode(bpe.encode(_table(spark, sf_dir, "documents")))
    return read_back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.build(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_toxicity": op2_toxicity,
    "op3_fingerprints": op3_fingerprints,
    "op4_token_output": op4_token_output,
    "op5_pii": op5_pii,
    "op6_decontamination": op6_decontamination,
    "op7_chat": op7_chat,
    "op8_near_dedup": op8_near_dedup,
    "op9_license": op9_license,
    "op10_packing": op10_packing,
    "op11_dataset_manifest": op11_dataset_manifest,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_lexical_search": op13_lexical_search,
}

# Words of a text for SQL: A-Z lower-cased, runs without blank and the controls 9 to 13.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"


def _shingle_sql(source: str, key: str, k: int) -> str:
    """Distinct shingles by key; of fewer words than k, all as one."""
    return f"""SELECT DISTINCT {key}, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' ')) END) AS s
        FROM (SELECT {key}, {_WORDS} AS w FROM {source})"""


_OP6_SQL = f"""
WITH d AS ({_shingle_sql("documents", "doc_id", decontaminate.WORDS)}),
b AS ({_shingle_sql("benchmark", "item_id", decontaminate.WORDS)}),
n AS (SELECT item_id, count(*) AS item_shingles FROM b GROUP BY item_id),
c AS (SELECT doc_id, item_id, count(*) AS common_shingles FROM d JOIN b USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, item_shingles, common_shingles, common_shingles / item_shingles AS containment
FROM c JOIN n USING (item_id) WHERE common_shingles >= {decontaminate.SHARE} * item_shingles - 1e-9
"""

_OP7_SQL = r"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, len(role) + len(text) + len(regexp_extract_all(role || chr(0) || text, '<\\*/?s>|\[\\*/?INST\]')) + 17 AS size FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    (sum(size) + 3)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

_OP8_SQL = f"""
WITH RECURSIVE s AS ({_shingle_sql("documents", "doc_id", 3)}),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_ FROM s x JOIN s y USING (s) WHERE x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * both_ >= 85 * (p.n + q.n - both_)),
g AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS doc_id, a AS reached FROM g UNION SELECT r.doc_id, g.b FROM r JOIN g ON g.a = r.reached),
m AS (SELECT doc_id, min(reached) AS low FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(low, d.doc_id) AS component_id, coalesce(low, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""

# -- op 11: trees of up to 16**_LEVELS nodes, level by level ----------------------

_LEVELS = 6
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: The unsigned CRC-32 of doc_id's digits: a byte goes in, then eight shifts.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295)"""


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen(({c})::VARCHAR) || ':' || ({c})::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _tree_sql(name: str) -> str:
    """From {name}0 (g, i, d): levels {name}1 and up, and each level's runs {name}r0 and up (g, p, kids, c)."""
    out = ""
    for at in range(_LEVELS):
        out += f""",
{name}r{at} AS MATERIALIZED (SELECT g, i // 16 AS p, list(d ORDER BY i) AS kids, max(c) AS c FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM {name}{at}) GROUP BY g, i // 16),
{name}{at + 1} AS MATERIALIZED (SELECT g, p AS i, CASE WHEN c = 1 THEN kids[1] ELSE sha256(array_to_string(kids, '')) END AS d FROM {name}r{at})"""
    return out


def _path_sql(source: str, name: str) -> str:
    """Rows of ``source`` (g, i, proof, node) with the siblings of all levels behind proof, and node folded up."""
    for at in range(_LEVELS):
        run, slot = f"(i // {16 ** (at + 1)})", f"((i // {16**at}) % 16)::INT"
        source = f"""(SELECT s.* EXCLUDE (proof, node), CASE WHEN c = 1 THEN proof ELSE proof || array_to_string(kids[1:{slot}], '') || array_to_string(kids[{slot} + 2:], '') END AS proof,
            CASE WHEN c = 1 THEN node ELSE sha256(array_to_string(kids[1:{slot}], '') || node || array_to_string(kids[{slot} + 2:], '')) END AS node FROM {source} s JOIN {name}r{at} r ON r.g = s.g AND r.p = {run})"""
    return source


_OP11_SQL = f"""
WITH l AS MATERIALIZED (SELECT doc_id, coalesce('s' || source, '') AS g, {_leaf_sql("text")} AS leaf, CASE WHEN {_CRC} % 5 = 0 THEN {_leaf_sql(_LOWER)} END AS changed FROM documents),
x AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM l),
a0 AS MATERIALIZED (SELECT g, i, leaf AS d FROM x){_tree_sql("a")},
b0 AS MATERIALIZED (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, d, g AS source FROM a{_LEVELS}){_tree_sql("b")},
low AS MATERIALIZED (SELECT doc_id, leaf, g AS source, proof, node FROM {_path_sql("(SELECT *, '' AS proof, coalesce(changed, leaf) AS node FROM x)", "a")}),
high AS (SELECT * FROM {_path_sql("(SELECT low.*, b0.g, b0.i, b0.d AS subroot FROM low JOIN b0 USING (source))", "b")})
SELECT doc_id, leaf, subroot, d AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = d AS verified FROM high, (SELECT d FROM b{_LEVELS})
"""

# -- op 13 ----------------------------------------------------------------------

_TERMS = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
_OP13_SQL = f"""
WITH t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {_TERMS} AS term FROM documents) GROUP BY ALL),
n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM t GROUP BY doc_id),
s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM n),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM t, s GROUP BY term, docs),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, {_TERMS} AS term FROM benchmark) GROUP BY ALL),
f AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * docs) // terms)))))::BIGINT AS score
    FROM q JOIN t USING (term) JOIN w USING (term) JOIN n USING (doc_id), s GROUP BY item_id, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM f WHERE score > 0)
SELECT * FROM r WHERE rank <= 10
"""

ORACLE_SQL: dict[str, str] = {"op6_decontamination": _OP6_SQL, "op7_chat": _OP7_SQL, "op8_near_dedup": _OP8_SQL, "op11_dataset_manifest": _OP11_SQL, "op13_lexical_search": _OP13_SQL}
