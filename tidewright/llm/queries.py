"""One query per corpus operator, each over its whole table, and the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewright.llm import decontaminate, html_extract, jaccard_join, language_id, packing, quality_rules, secret_scan, sharding, substring_dedup, url_filter
from tidewright.llm.common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality_rules, op2_ngram_jaccard_join, op3_benchmark_decontamination, op4_sharding, op5_html_extraction, op6_url_filters, op7_substring_dedup, op8_language_id, op9_secret_scans, op10_best_fit_packing)
}

#: Words of a text, as DuckDB reads them.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_NUMBERS = ", ".join(f"'{w}'" for w in sorted(decontaminate.NUMBER_WORDS))
_UNITS = ", ".join(f"'{u}'" for u in sorted(decontaminate.UNITS))
_OUTER = decontaminate._OUTER.replace("'", "''")

#: Template tokens of a table's texts: symbol, value and kind, as ``decontaminate`` has them.
_TOKENS = """
{n}_raw AS (SELECT id, unnest(toks) AS tok, unnest(range(len(toks))) AS p FROM (SELECT {id} AS id, regexp_extract_all(text, '\\S+') AS toks FROM {table})),
{n}_core AS (SELECT id, p, trim(tok, '{outer}') AS core, coalesce(lag(tok) OVER (PARTITION BY id ORDER BY p), '.') SIMILAR TO '.*[.!?:]' AS begins FROM {n}_raw),
{n}_glue AS (SELECT *, regexp_extract(core, '^([+-]?\\d[\\d.,]*)(\\p{{L}}+|%|°[cfCF])$', ['a', 'u']) AS g FROM {n}_core WHERE core <> ''),
{n}_part AS (SELECT id, p, begins, unnest(CASE WHEN regexp_full_match(core, '[+-]?[$€£]?\\d[\\d.,:/]*(?:st|nd|rd|th)?') OR lower(core) IN ({numbers}) THEN [{{'v': lower(core), 'k': 1, 'q': 0}}]
    WHEN lower(g.u) IN ({units}) THEN [{{'v': g.a, 'k': 1, 'q': 0}}, {{'v': lower(g.u), 'k': 2, 'q': 1}}]
    WHEN lower(core) IN ({units}) THEN [{{'v': lower(core), 'k': 4, 'q': 0}}]
    WHEN NOT begins AND regexp_full_match(core, '\\p{{Lu}}[^\\p{{Lu}}\\p{{Lt}}]*\\p{{Ll}}[^\\p{{Lu}}\\p{{Lt}}]*') THEN [{{'v': lower(core), 'k': 3, 'q': 0}}]
    ELSE [{{'v': lower(core), 'k': 0, 'q': 0}}] END) AS s FROM {n}_glue),
{n}_kind AS (SELECT id, row_number() OVER w - 1 AS p, s.v AS v, CASE WHEN s.k <> 4 THEN s.k WHEN lag(s.k) OVER w = 1 THEN 2 ELSE 0 END AS k FROM {n}_part WINDOW w AS (PARTITION BY id ORDER BY p, s.q)),
{n} AS (SELECT id, list(CASE WHEN k = 0 THEN v ELSE '<' || k || '>' END ORDER BY p) AS symbols, list(v ORDER BY p) AS vals, list(k ORDER BY p) AS kinds FROM {n}_kind GROUP BY id)"""


def _tokens(name: str, key: str, source: str) -> str:
    return _TOKENS.format(n=name, id=key, table=source, outer=_OUTER, units=_UNITS, numbers=_NUMBERS)


def _template_windows(name: str, widths: str) -> str:
    return f"""{name}_at AS (SELECT id, symbols, vals, kinds, w, unnest(range(1, len(symbols) - w + 2)) AS i FROM {name} JOIN {widths}),
{name}_win AS (SELECT id, i, w, array_to_string(list_slice(symbols, i, i + w - 1), ' ') AS t, list_slice(vals, i, i + w - 1) AS vals, list_slice(kinds, i, i + w - 1) AS kinds FROM {name}_at),
{name}_use AS (SELECT * FROM {name}_win WHERE 2 * len(list_filter(kinds, lambda k: k = 0)) >= w)"""


ORACLE_SQL: dict[str, str] = {
    "op3_benchmark_decontamination": f"""
        WITH {_tokens('d', 'doc_id', 'documents')}, {_tokens('b', 'item_id', 'benchmark')},
        own AS (SELECT id AS item, least(len(symbols), {decontaminate.WIDTH}) AS w FROM b WHERE len(symbols) >= {decontaminate.LEAST_TOKENS}),
        {_template_windows('b', 'own ON own.item = b.id')},
        {_template_windows('d', '(SELECT DISTINCT w FROM own) ON true')},
        hit AS (SELECT d.id AS doc_id, b.id AS item, d.i - b.i AS shift, d.vals AS dv, b.vals AS bv, d.kinds AS kinds FROM d_use d JOIN b_use b ON d.t = b.t AND d.w = b.w),
        slot AS (SELECT doc_id, item, shift, unnest(kinds) AS k, unnest(bv) AS x, unnest(dv) AS y FROM hit),
        odd AS (SELECT doc_id, item, shift FROM slot WHERE k > 0 GROUP BY ALL HAVING count(DISTINCT (k, x, y)) <> count(DISTINCT (k, x)) OR count(DISTINCT (k, x, y)) <> count(DISTINCT (k, y))),
        good AS (SELECT doc_id, item, count(*) AS n FROM hit ANTI JOIN odd USING (doc_id, item, shift) GROUP BY doc_id, item)
        SELECT doc_id, sum(n)::BIGINT AS n_windows, string_agg(item::VARCHAR, ',' ORDER BY item) AS items FROM good GROUP BY doc_id
    """,
    "op2_ngram_jaccard_join": f"""
        WITH RECURSIVE docs AS (SELECT doc_id, {_WORDS} AS words FROM documents),
        starts AS (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, CASE WHEN len(words) > 0 THEN 1 ELSE 0 END) + 1)) AS i FROM docs),
        shingles AS (SELECT DISTINCT doc_id, array_to_string(list_slice(words, i, i + 4), ' ') AS s FROM starts),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
        edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach AS (SELECT doc_id, doc_id AS other FROM docs UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other)
        SELECT doc_id, min(other) AS class_id, coalesce((SELECT count(*) FROM edges WHERE a = doc_id), 0) AS n_links FROM reach GROUP BY doc_id
    """,
    "op7_substring_dedup": f"""
        WITH docs AS (SELECT doc_id, {_WORDS} AS words FROM documents),
        starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM docs),
        windows AS (SELECT doc_id, i, array_to_string(list_slice(words, i, i + 19), ' ') AS w FROM starts),
        ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS r FROM windows),
        covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM ranked WHERE r > 1),
        gone AS (SELECT doc_id, list(j) AS js FROM covered GROUP BY doc_id),
        words AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS j FROM docs),
        kept AS (SELECT w.doc_id, string_agg(w.word, ' ' ORDER BY w.j) AS text
                 FROM words w ANTI JOIN covered c ON w.doc_id = c.doc_id AND w.j = c.j GROUP BY w.doc_id)
        SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(len(g.js), 0)::BIGINT AS n_removed,
               sha256(coalesce(k.text, '')) AS kept_sha256
        FROM docs d LEFT JOIN gone g ON g.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id
    """,
}
