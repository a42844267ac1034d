"""Registered queries of the corpus operators: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import (bpe, classifier, exact, jaccard, katz, merkle, packing, repetition, sharding, substring,
                            superminhash, token_output, whitening)
from ledgerlens.llm.common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition coverage and verdict of every document."""
    return repetition.repetition_rules(documents(spark, sf_dir))


@_query
def op3_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's token ids and of their decoding."""
    return bpe.encode_digests(documents(spark, sf_dir))


@_query
def op6_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document under the law ``rows``."""
    placed = sharding.feistel_shards(documents(spark, sf_dir), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


@_query
def op7_shortest_pack_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces with their place in 2048-token sequences."""
    return packing.pack_documents(documents(spark, sf_dir))


@_query
def op9_progressive_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of equal texts of every document, and the row of it that stays."""
    docs = documents(spark, sf_dir)
    groups = exact.progressive_groups(docs)
    digests = exact.row_places(docs).select("row_key", F.unhex(exact.full_hash(F.col("text"))).alias("sha"))
    return groups.join(digests, "row_key").select("doc_id", "keep_id", "group_size", "kept",
                                                  F.lower(F.hex("sha")).alias("text_sha256"))


ORACLE["op9_progressive_dedup"] = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS points,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
g AS (SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
      FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g"""


@_query
def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under 5-word shingle Jaccard of 0.8 or more."""
    return jaccard.jaccard_components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


@_query
def op10_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated passages, with what was removed."""
    out = substring.remove_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "text", F.col("_ll_removed").alias("n_removed_words"),
                      F.col("_ll_spans").alias("removed_spans"))


@_query
def op5_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return classifier.quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_query
def op2_packed_token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token ids in packed binary rows of 2048."""
    return token_output.packed_rows(documents(spark, sf_dir))


@_query
def op4_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Katz backoff score of every document."""
    return katz.katz_scores(documents(spark, sf_dir))


def _op1_sql() -> str:
    """Words with their place; a window's text occurs again in its document (earlier: ``l``); a word is inside when one
    of the windows over it does."""
    sizes = [repetition.BASE_WINDOW, *repetition.WINDOW_LIMITS]
    limit = lambda name, share, whole: f"100 * {name} > {round(100 * share)} * {whole}"
    parts, measures, joins = [], [], []
    for n in sizes:
        gram = " || ' ' || ".join(f"lead(word, {k}) OVER d" for k in range(n))
        parts.append(f"""g{n} AS (SELECT doc_id, i, word, {gram} AS gram FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
f{n} AS (SELECT doc_id, i, word, gram IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, gram) > 1 AS again,
         gram IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, gram ORDER BY i) > 1 AS later FROM g{n}),
c{n} AS (SELECT doc_id, word, bool_or(again) OVER r AS a, bool_or(later) OVER r AS l FROM f{n}
         WINDOW r AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)),
m{n} AS (SELECT doc_id, count(*) FILTER (a) AS repeat_words, sum(length(word)) FILTER (l) AS chars FROM c{n} GROUP BY doc_id)""")
        joins.append(f"LEFT JOIN m{n} USING (doc_id)")
        measures.append(f"coalesce(m{n}.repeat_words, 0) AS n_repeat_words" if n == repetition.BASE_WINDOW
                        else f"CAST(coalesce(m{n}.chars, 0) AS BIGINT) AS dup_chars_{n}")
    bad = [limit("n_dup_lines", repetition.LINE_LIMIT, "n_lines"),
           limit("dup_line_chars", repetition.LINE_CHARS_LIMIT, "word_chars"),
           limit("n_symbols", repetition.SYMBOL_LIMIT, "n_words"),
           *(limit(f"dup_chars_{n}", x, "word_chars") for n, x in repetition.WINDOW_LIMITS.items())]
    space = r"[\x20\x09-\x0D]"
    return rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lists AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM docs),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM lists),
{", ".join(parts)},
lines AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line) > 1 AS again
          FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs)
          WHERE regexp_replace(line, '{space}', '', 'g') <> ''),
ml AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (again) AS n_dup_lines,
              sum(length(regexp_replace(line, '{space}', '', 'g'))) FILTER (again) AS chars FROM lines GROUP BY doc_id),
x AS (SELECT doc_id, len(ws) AS n_words, CAST(coalesce(wc.chars, 0) AS BIGINT) AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
             coalesce(n_lines, 0) AS n_lines, CAST(coalesce(ml.chars, 0) AS BIGINT) AS dup_line_chars, {", ".join(measures)}
      FROM docs JOIN lists USING (doc_id) LEFT JOIN ml USING (doc_id)
      LEFT JOIN (SELECT doc_id, sum(length(word)) AS chars FROM words GROUP BY doc_id) wc USING (doc_id) {" ".join(joins)})
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT ({" OR ".join(bad)}) AS kept FROM x"""


ORACLE["op1_repetition_rules"] = _op1_sql()
def _components_sql(width: int, last: str) -> str:
    """Components of shingle sets with Jaccard of 0.8 or more; ``last``: further columns of the result."""
    gram = " || ' ' || ".join(["word", *(f"lead(word, {k}) OVER d" for k in range(1, width))])
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                     'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM w),
windows AS (SELECT doc_id, {gram} AS shingle FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT DISTINCT doc_id, shingle FROM windows WHERE shingle IS NOT NULL
      UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND {width - 1}),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
          GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id{last}
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)"""


ORACLE["op8_ngram_jaccard_join"] = _components_sql(5, "")
ORACLE["op12_superminhash_dedup"] = _components_sql(2, ", d.doc_id = c.component_id AS kept")


@_query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and folded root of every document, a fifth of them tampered with."""
    return merkle.audit(merkle.manifest(documents(spark, sf_dir)))


@_query
def op12_superminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under 2-word shingle Jaccard of 0.8 or more, and whether it names it."""
    found = superminhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


@_query
def op13_chebyshev_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened leading components of every usable embedding."""
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _merkle_levels(name: str, leaves: str, key: str, steps: int) -> str:
    """``name``0 .. ``name``steps: nodes (key, i, d) of each level, and their runs; a tree of one node stays as it is."""
    parts = [f"{name}0 AS (SELECT {key}, i, d, count(*) OVER (PARTITION BY {key}) AS n FROM {leaves})"]
    for k in range(steps):
        parts.append(f"{name}r{k} AS (SELECT {key}, i // 16 AS i, list(d ORDER BY i) AS run, any_value(n) AS n FROM {name}{k} GROUP BY {key}, i // 16)")
        parts.append(f"{name}{k + 1} AS (SELECT {key}, i, CASE WHEN n > 1 THEN sha256(array_to_string(run, '')) ELSE run[1] END AS d, (n + 15) // 16 AS n FROM {name}r{k})")
    return ",\n".join(parts)


def _merkle_fold(name: str, start: str, key: str, steps: int) -> str:
    """Each row's digest and the siblings passed, carried from its leaf to the tree's root."""
    parts, before = [], start
    for k in range(steps):
        at = f"(b.i // {16 ** k}) % 16"
        parts.append(f"""{name}f{k} AS (SELECT b.* REPLACE (
    CASE WHEN r.n > 1 THEN sha256(array_to_string(run[1:{at}], '') || b.now || array_to_string(run[{at} + 2:], '')) ELSE b.now END AS now,
    CASE WHEN r.n > 1 THEN b.seen || array_to_string(run[1:{at}], '') || array_to_string(run[{at} + 2:], '') ELSE b.seen END AS seen)
  FROM {before} b JOIN {name}r{k} r ON r.{key} = b.{key} AND r.i = b.i // {16 ** (k + 1)})""")
        before = f"{name}f{k}"
    return ",\n".join(parts)


def _op11_sql(steps: int = 5, top: int = 3) -> str:
    """Levels are unrolled: up to 16 ** steps rows a source and 16 ** top sources."""
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: f"sha256({' || '.join(map(field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"
    bits = "list_reduce([xor(crc, byte)] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: xor(c >> 1, 3988292384 * (c & 1)))"
    crc = ("xor(4294967295, list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''),"
           f" lambda s: CAST(ascii(s) AS BIGINT)), lambda crc, byte: {bits}))")
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH t AS (SELECT doc_id, coalesce('+' || source, '') AS s, {leaf('text')} AS leaf,
                  CASE WHEN doc_id IS NOT NULL AND {crc} % 5 = 0 THEN {leaf(low)} ELSE {leaf('text')} END AS now FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS LAST, leaf) - 1 AS i FROM t),
base AS (SELECT s, i, leaf AS d FROM l),
{_merkle_levels('a', 'base', 's', steps)},
subs AS (SELECT s, d AS subroot, 1 AS one, row_number() OVER (ORDER BY encode(s)) - 1 AS i FROM a{steps}),
topnodes AS (SELECT one, i, subroot AS d FROM subs),
{_merkle_levels('b', 'topnodes', 'one', top)},
x AS (SELECT doc_id, s, i, leaf, now, '' AS seen FROM l),
{_merkle_fold('a', 'x', 's', steps)},
y AS (SELECT doc_id, leaf, now, seen, subroot, subs.i AS i, 1 AS one FROM af{steps - 1} JOIN subs USING (s)),
{_merkle_fold('b', 'y', 'one', top)}
SELECT doc_id, leaf, subroot, b{top}.d AS root, sha256(seen) AS proof_sha256, now AS folded_root, now = b{top}.d AS verified
FROM bf{top - 1} CROSS JOIN b{top}"""


ORACLE["op11_merkle_manifest"] = _op11_sql()
