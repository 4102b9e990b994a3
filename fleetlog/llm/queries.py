"""Registered queries of the operators, and their SQL where it can say the same."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetlog.llm import ann, cotrain, fingerprints, mixing, near_dup, packing, quotes, repair, rules, secret_scan, spelling, suffix_dedup, urls
from fleetlog.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
WS = r"\x20\x09-\x0D"


def query(name: str, table: str, sql: str | None = None):
    """Register a query over one whole table."""

    def add(fn: Callable[[DataFrame], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark).read.parquet(os.path.join(sf_dir, f"{table}.parquet")))

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def _secrets_sql() -> str:
    kinds, parts = [], []
    for k, (name, pattern) in enumerate(secret_scan.KINDS):
        p = pattern.replace("'", "''")
        kinds.append(f"g{k} AS (SELECT doc_id, source, unnest(string_split_regex(t, '{p}')[:len(regexp_extract_all(t, '{p}'))]) AS gap, unnest(regexp_extract_all(t, '{p}')) AS hit, generate_subscripts(regexp_extract_all(t, '{p}'), 1) AS nth FROM d)")
        value = f"regexp_extract(hit, '^{p}', 2)" if k == 0 else "hit"
        parts.append(f"SELECT doc_id, source, {k} AS kind, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY nth) AS e, length(hit) AS n, {value} AS v FROM g{k}")
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents), {", ".join(kinds)},
m AS (SELECT doc_id, source, kind, CAST(e - n AS BIGINT) AS s, CAST(e AS BIGINT) AS e, v FROM ({" UNION ALL ".join(parts)})
      WHERE CASE kind WHEN 0 THEN length(v) >= {secret_scan.LEAST_ASSIGNED} WHEN {secret_scan.BASE} THEN regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]') ELSE true END),
o AS (SELECT v, count(DISTINCT coalesce(source, chr(1))) AS owners FROM m GROUP BY v),
x AS (SELECT m.*, CASE WHEN owners >= {secret_scan.EXAMPLE_OWNERS} THEN 'example' WHEN owners = 1 THEN 'live' ELSE 'shared' END AS c FROM m JOIN o USING (v)),
f AS (SELECT * FROM x WHERE kind < {secret_scan.BASE} OR (c = 'live' AND NOT EXISTS (SELECT 1 FROM x b WHERE b.doc_id = x.doc_id AND b.kind < {secret_scan.BASE} AND b.s < x.e AND b.e > x.s))),
a AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (kind = 3) AS n_opaque,
             count(*) FILTER (c = 'live') AS n_live, count(*) FILTER (c = 'example') AS n_example,
             string_agg(CASE WHEN kind < {secret_scan.BASE} THEN ['assign', 'access', 'hex', 'opaque'][kind + 1] || ':' || s || ':' || e END, ',' ORDER BY s, kind) AS base,
             string_agg(['assign', 'access', 'hex', 'opaque'][kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind) AS spans FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_opaque, 0) AS n_opaque, coalesce(n_live, 0) AS n_live,
       coalesce(n_example, 0) AS n_example, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN a USING (doc_id)"""


@query("op1_secret_scan", "documents", _secrets_sql())
def secrets(documents: DataFrame) -> DataFrame:
    """Secrets of all documents with the ownership class of their values."""
    return secret_scan.scan(documents).drop("text_hash", "marks")


@query("op2_bayes_near_dup", "documents")
def near_duplicates(documents: DataFrame) -> DataFrame:
    """Groups of documents with 3-word shingle similarity of 0.85 or more."""
    return near_dup.near_duplicates(documents, words=3, threshold=85).drop("text_hash", "kept_row")


@query("op3_suffix_dedup", "documents")
def repeated_strings(documents: DataFrame) -> DataFrame:
    """All documents without the bytes covered by 400-byte strings that start anywhere else, too."""
    kept = F.make_valid_utf8(F.col("kept").cast("string"))
    return suffix_dedup.dedup(documents).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", kept.alias("kept_text"))


def _due_sql(done: str, schedule) -> str:
    area = [0.0]
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        area.append(area[-1] + (t1 - t0) * (w0 + w1) / 2)
    out = f"{schedule[-1][0]}::DOUBLE"
    for k in reversed(range(len(schedule) - 1)):
        (t0, w0), (t1, w1) = schedule[k], schedule[k + 1]
        y, slope = f"({done} * {area[-1]}::DOUBLE - {area[k]}::DOUBLE)", (w1 - w0) / (t1 - t0)
        out = f"CASE WHEN {done} * {area[-1]}::DOUBLE < {area[k + 1]} THEN {t0}::DOUBLE + 2 * {y} / ({w0}::DOUBLE + sqrt({w0 * w0}::DOUBLE + {2 * slope}::DOUBLE * {y})) ELSE {out} END"
    return out


_MIX_SQL = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^{WS}]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS place, 2.0::DOUBLE * source_size AS most, [3.0, 1.0, 2.0][place + 1]::DOUBLE AS weight FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size::DOUBLE) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY most / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
v AS (SELECT max(level) AS level FROM l WHERE level * weight <= most),
t AS (SELECT source, source_size, place, least(most, v.level * weight) AS target FROM r, v),
o AS (SELECT d.*, t.source_size, t.target, t.place, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(CAST(doc_id AS VARCHAR)), d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, greatest(0, least(size, floor(target) - f)) AS a, greatest(0, least(size, floor(target) - f - source_size)) AS b FROM o)
SELECT doc_id, source, size, source_size, target, CAST(a + b AS BIGINT) AS taken, CAST(CASE WHEN a > 0 THEN 1 ELSE 0 END + CASE WHEN b > 0 THEN 1 ELSE 0 END AS BIGINT) AS n_copies,
       CASE WHEN a > 0 THEN round(CASE place {" ".join(f"WHEN {k} THEN {_due_sql('(f / target)', s)}" for k, s in enumerate(mixing.SCHEDULES))} END, 9) END AS position FROM c"""


@query("op4_curriculum_mix", "documents", _MIX_SQL)
def mixed(documents: DataFrame) -> DataFrame:
    """Words taken of every document and when, in reading order of the first copy."""
    return mixing.mix(documents).drop("text_hash").withColumn("copies", F.size("copies").cast("bigint")).withColumnRenamed("copies", "n_copies").orderBy("position", "doc_id")


def _rules_sql() -> str:
    stop = "|".join(f"[{w[0].upper()}{w[0]}]{w[1:]}" for w in dict.fromkeys(rules.STOP_WORDS))
    tests = []
    for name, measure, least, most in rules.RULES:
        part, _, whole = measure.partition(" / ")
        value = f"({part}::DOUBLE / nullif({whole}, 0))" if whole else part
        bad = [f"{value} < {least}"] * (least is not None) + [f"{value} > {most}"] * (most is not None)
        tests.append(f"CASE WHEN {' OR '.join(bad)} THEN '{name}' END")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^{WS}]+') AS l, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{WS}]')) AS lines FROM d),
g AS (SELECT doc_id, i, l[i] || ' ' || l[i + 1] || ' ' || l[i + 2] AS g FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM w)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g),
p AS (SELECT doc_id, count(DISTINCT k) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM c WHERE n > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(l) AS BIGINT) AS n_words, CAST(length(array_to_string(l, '')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
             CAST(len(list_filter(l, lambda x: regexp_matches(x, '^(?:{stop})[.,;:!?]?$'))) AS BIGINT) AS n_stop_words,
             CAST(len(list_filter(l, lambda x: regexp_matches(x, '\\p{{L}}'))) AS BIGINT) AS n_letter_words,
             CAST(len(list_filter(l, lambda x: regexp_matches(x, '\\p{{Lu}}\\p{{Lu}}'))) AS BIGINT) AS n_capital_words,
             CAST(len(list_filter(lines, lambda x: regexp_matches(x, '^[ \\t]*[-*•]'))) AS BIGINT) AS n_bullet_lines,
             CAST(len(list_filter(lines, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[ \\t\\r]*$'))) AS BIGINT) AS n_cut_lines
      FROM w LEFT JOIN p ON w.doc_id = p.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, concat_ws(',', {", ".join(tests)}) AS failed FROM m)
SELECT *, NOT base_failed AND failed = '' AS kept FROM f"""


@query("op5_quality_rules", "documents", _rules_sql())
def quality(documents: DataFrame) -> DataFrame:
    """Measures and verdict of the threshold table for all documents."""
    return rules.judge(documents).withColumn("failed", F.array_join("failed", ","))


_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op6_url_filter", "pages",
    f"""
WITH r(verdict, host, path) AS (VALUES {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in urls.RULES)}),
p AS (SELECT page_id, coalesce(CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END, '') AS rest FROM pages),
h AS (SELECT page_id, {_LOW.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
b AS (SELECT page_id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
      FROM h JOIN r ON (h.host = r.host OR ends_with(h.host, '.' || r.host)) AND starts_with(h.path, r.path) GROUP BY page_id)
SELECT h.page_id, h.host, h.path, b.rule, coalesce(b.verdict, 'allow') AS verdict FROM h LEFT JOIN b USING (page_id)""",
)
def url_filter(pages: DataFrame) -> DataFrame:
    """Verdict of every page's URL."""
    return urls.judge(pages, urls.rule_table(pages.sparkSession))


_NORMAL = f"trim(regexp_replace(lower({{}}), '[{WS}]+', ' ', 'g'))"


@query(
    "op7_quote_linking", "conversations",
    f"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS id, conv_id, turn, role, string_split(coalesce(text, ''), chr(10)) AS ls FROM conversations),
l AS (SELECT id, conv_id, turn, unnest(ls) AS x, generate_subscripts(ls, 1) AS k FROM m),
v AS (SELECT id, conv_id, turn, k, length(regexp_replace(regexp_extract(x, '^(?:[ \\t]*>)+[ \\t]?'), '[^>]', '', 'g')) AS lv, regexp_replace(x, '^(?:[ \\t]*>)+[ \\t]?', '') AS y FROM l),
i AS (SELECT *, k - row_number() OVER (PARTITION BY id, lv ORDER BY k) AS run FROM v),
q AS (SELECT id, conv_id, turn, lv, min(k) AS k, string_agg(y, chr(10) ORDER BY k) AS passage FROM i GROUP BY id, conv_id, turn, lv, run),
b AS (SELECT id, conv_id, turn, regexp_replace(coalesce(string_agg(CASE WHEN lv = 0 THEN passage END, chr(10) ORDER BY k), ''), '^[{WS}]+|[{WS}]+$', '', 'g') AS body FROM q GROUP BY id, conv_id, turn),
u AS (SELECT conv_id, turn, unnest(list_concat([body], string_split_regex(body, '\\n[{WS}]*\\n'), string_split(body, chr(10)))) AS p FROM b),
o AS (SELECT conv_id, {_NORMAL.format("p")} AS h, min(turn) AS origin FROM u WHERE {_NORMAL.format("p")} <> '' GROUP BY ALL),
a AS (SELECT id, conv_id, turn, {_NORMAL.format("passage")} AS h FROM q WHERE lv > 0 AND {_NORMAL.format("passage")} <> ''),
n AS (SELECT a.id, count(*) AS n_quotes, count(o.origin) AS n_linked, max(o.origin) AS reply FROM a LEFT JOIN o ON a.conv_id = o.conv_id AND a.h = o.h AND o.origin < a.turn GROUP BY a.id),
e AS (SELECT conv_id, turn, max(reply) AS up FROM m JOIN n USING (id) WHERE reply IS NOT NULL GROUP BY conv_id, turn),
t AS (SELECT conv_id, turn, up AS top FROM e UNION ALL SELECT t.conv_id, t.turn, e.up FROM t JOIN e ON t.conv_id = e.conv_id AND t.top = e.turn),
s AS (SELECT conv_id, turn, min(top) AS top FROM t GROUP BY conv_id, turn)
SELECT m.conv_id, coalesce(s.top, m.turn) AS thread_turn, m.turn, m.role, n.reply AS reply_turn, coalesce(n_quotes, 0) AS n_quotes, coalesce(n_linked, 0) AS n_linked,
       body, sha256(body) AS body_sha256, '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || body || chr(10) AS formatted
FROM m JOIN b USING (id) LEFT JOIN n USING (id) LEFT JOIN s ON m.conv_id = s.conv_id AND m.turn = s.turn""",
)
def quote_linking(conversations: DataFrame) -> DataFrame:
    """All conversations in reply order, quotes linked and removed."""
    return quotes.link(conversations)


@query("op8_weighted_fingerprint", "documents")
def weighted_fingerprint(documents: DataFrame) -> DataFrame:
    """Consistent weighted samples of every document and of its edited text."""
    return fingerprints.fingerprint(documents)


def cotrained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents by two views that taught each other."""
    table = lambda name: prepare(spark).read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return cotrain.classify(table("documents"), table("labels")).drop("text_hash")


QUERIES["op9_cotrained_quality"] = cotrained


@query("op10_best_fit_packing", "documents")
def packed(documents: DataFrame) -> DataFrame:
    """All documents in windows of 2048 ids."""
    return packing.pack(documents, public_tokenizers.path("word_bpe_49k.json"))


def _crc_sql(text: str) -> str:
    """Unsigned CRC-32 of a string's UTF-8 bytes in DuckDB, four bits at a time."""
    table = []
    for n in range(16):
        for _ in range(4):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        table.append(n)
    digits = f"list_transform(range(1, length(hex({text})) + 1), lambda i: instr('0123456789ABCDEF', hex({text})[CASE WHEN i % 2 = 1 THEN i + 1 ELSE i - 1 END]) - 1)"
    return f"xor(list_reduce(list_concat([{0xFFFFFFFF}::BIGINT], {digits}), lambda c, d: xor(c >> 4, {table}[(xor(c, d) & 15) + 1])), {0xFFFFFFFF}::BIGINT)"


_SPELLING_SQL = f"""
WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{spelling.UPPER}', '{spelling.LOWER}'), '{spelling.LETTERS}{{7,}}')) AS run FROM documents),
h AS (SELECT doc_id, run, count(*) AS k, {_crc_sql("(doc_id || ':' || run)")} AS h FROM r GROUP BY doc_id, run),
o AS (SELECT k, CASE WHEN h % 31 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word FROM h),
w AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM o WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
g AS (SELECT word, i, word[:i - 1] || word[i + 1:] AS gap FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT a.word, b.word AS near FROM g a JOIN g b ON a.i = b.i AND a.gap = b.gap AND a.word <> b.word
      UNION SELECT g.word, w.word FROM g JOIN w ON g.gap = w.word UNION SELECT w.word, g.word FROM g JOIN w ON g.gap = w.word),
b AS (SELECT p.word, near, w.n, row_number() OVER (PARTITION BY p.word ORDER BY w.n DESC, near) AS place, count(*) OVER (PARTITION BY p.word) AS n_near FROM p JOIN w ON p.near = w.word),
f AS (SELECT w.word, CASE WHEN b.n >= 10 * w.n THEN near END AS form, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.n >= 10 * w.n THEN b.n END AS form_n FROM w LEFT JOIN b ON w.word = b.word AND place = 1),
c AS (SELECT word, word AS root, 0 AS depth FROM f UNION ALL SELECT c.word, f.form, depth + 1 FROM c JOIN f ON c.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, arg_max(root, depth) AS root FROM c GROUP BY word) USING (word)"""


@query("op11_trie_spelling", "documents", _SPELLING_SQL)
def spelling_variants(documents: DataFrame) -> DataFrame:
    """Near words, form and root of every word of at least seven letters in all documents."""
    return spelling.variants(documents)


_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_REPAIR_SQL = f"""
WITH RECURSIVE r AS (SELECT coalesce('c' || conv_id, '') AS k, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc_sql("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS h FROM conversations),
d AS (SELECT k, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE h WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM r WHERE h <> 0),
o AS (SELECT *, row_number() OVER w AS p, count(*) OVER (PARTITION BY k) AS size, row_number() OVER (PARTITION BY k, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again, rtrim(text, {_BLANKS}) AS body, substr(role, 1, 1) AS i
      FROM d WINDOW w AS (PARTITION BY k ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text), copy)),
f AS (SELECT *, CASE WHEN body = '' THEN 'b' WHEN again THEN 'd' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, lag(i) OVER (PARTITION BY k ORDER BY p) || i NOT IN ('su', 'ua', 'au') AS odd FROM o),
e AS (SELECT *, fault IN ('b', 'd') AS goes, CASE fault WHEN 't' THEN 5 ELSE 0 END AS m FROM f),
b AS (SELECT DISTINCT k, size + 1 AS p, [0, 10, 5, 0] AS c FROM e
      UNION ALL SELECT k, p, [least(v[1], 5 + v[3], 10 + v[4]), least(v[2], 5 + v[3], 10 + v[4]), least(v[3], 5 + v[4]), least(v[4], 5 + v[3])] FROM (
        SELECT e.k, e.p, CASE WHEN goes THEN [2 + c[1], 2 + c[2], 2 + c[3], 2 + c[4]] ELSE
          [least(2 + c[1], CASE i WHEN 's' THEN m + c[2] WHEN 'u' THEN m + c[3] ELSE 1000000 END, 1 + m + c[3]), least(2 + c[2], CASE i WHEN 'u' THEN m + c[3] ELSE 1000000 END, 1 + m + c[3]),
           least(2 + c[3], CASE i WHEN 'a' THEN m + c[4] ELSE 1000000 END, 1 + m + c[4]), least(2 + c[4], CASE i WHEN 'u' THEN m + c[3] ELSE 1000000 END, 1 + m + c[3])] END AS v
        FROM b JOIN e ON b.k = e.k AND b.p = e.p + 1)),
q AS (SELECT b.k, b.p, b.c AS here, a.c AS there, e.role, e.text, e.i, e.goes, e.m FROM b LEFT JOIN b a ON a.k = b.k AND a.p = b.p + 1 LEFT JOIN e ON e.k = b.k AND e.p = b.p),
s AS (SELECT k, 1 AS p, 1 AS s, '' AS audit, []::VARCHAR[] AS lines FROM b WHERE p = 1
      UNION ALL SELECT k, CASE l WHEN 'I' THEN p ELSE p + 1 END, CASE l WHEN 'D' THEN s WHEN 'K' THEN CASE i WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END ELSE CASE s WHEN 3 THEN 4 ELSE 3 END END, audit || l,
        CASE l WHEN 'D' THEN lines ELSE list_append(lines, CASE WHEN l = 'K' THEN role || ':' || text ELSE CASE s WHEN 3 THEN 'assistant:' ELSE 'user:' END || CASE l WHEN 'R' THEN text ELSE '' END END) END
      FROM (SELECT s.*, i, role, text, CASE WHEN there IS NOT NULL AND 2 + there[s] = here[s] THEN 'D' WHEN here[s] > 0 AND (there IS NULL OR 5 + here[CASE s WHEN 3 THEN 4 ELSE 3 END] = here[s]) THEN 'I' WHEN there IS NULL THEN NULL
              WHEN CASE WHEN s IN (1, 2, 4) AND i = 'u' THEN m + there[3] WHEN s = 1 AND i = 's' THEN m + there[2] WHEN s = 3 AND i = 'a' THEN m + there[4] END = here[s] THEN 'K' ELSE 'R' END AS l
            FROM s JOIN q ON s.k = q.k AND s.p = q.p) WHERE l IS NOT NULL),
z AS (SELECT k, arg_max(audit, length(audit)) AS audit, arg_max(lines, length(audit)) AS lines FROM s GROUP BY k),
n AS (SELECT k, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (odd) AS illegal FROM f GROUP BY k),
i AS (SELECT DISTINCT conv_id, coalesce('c' || conv_id, '') AS k FROM conversations)
SELECT conv_id, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("gaps", "blank", "duplicate", "truncated", "illegal"))}, CAST(coalesce(b.c[1], 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit,
       sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256 FROM i LEFT JOIN n USING (k) LEFT JOIN z USING (k) LEFT JOIN b ON b.k = i.k AND b.p = 1"""


@query("op12_conversation_repair", "conversations", _REPAIR_SQL)
def repaired(conversations: DataFrame) -> DataFrame:
    """Faults, cheapest repair and its audit of every damaged conversation."""
    return repair.audited(conversations)


@query("op13_learned_neighbours", "embeddings")
def neighbours(embeddings: DataFrame) -> DataFrame:
    """The ten nearest vectors found for every hundredth."""
    return ann.search(embeddings, F.col("vec_id") % 100 == 0)
