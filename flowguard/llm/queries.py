"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.paths import work_folder
from . import (
    digests,
    lines,
    mixing,
    packing,
    prefixes,
    pseudonyms,
    quality,
    secrets,
    simhash,
    structure,
    toxicity,
    warc,
    winnowing,
)
from .texts import written

#: A key for the registered query; a real one is kept apart from code and texts.
DEMONSTRATION_KEY = "demonstration"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(read(spark, sf_dir, "documents"))
    base = F.filter("secrets", lambda s: s["kind"].isin(*[r.kind for r in secrets.BASE]))
    number = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[number(r.kind).alias(f"n_{r.kind}") for r in secrets.BASE],
        F.sha2(secrets.written_spans(base), 256).alias("base_sha256"),
        secrets.written_spans(F.col("secrets")).alias("spans"),
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    forest = quality.fit(docs, read(spark, sf_dir, "labels"))
    return quality.score(docs, forest)


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(read(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(read(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem"
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in two arrivals, the one with the smaller ids first: the second meets a filled index."""
    docs = read(spark, sf_dir, "documents")
    middle = docs.agg(F.percentile_approx("doc_id", 0.5)).first()[0]
    early = F.coalesce(F.col("doc_id") <= F.lit(middle), F.lit(False))
    name = f"digest_index_{uuid.uuid4().hex[:12]}"
    path = work_folder(spark, name)
    parts = [digests.exact_duplicates(docs.where(p), name, path, arrival=a) for a, p in (("early", early), ("late", ~early))]
    digests.close_index(spark, name)
    both = parts[0].unionByName(parts[1])
    # A text's rows of both arrivals; as a table, so that adaptive execution can split a text that many rows share.
    sizes = written(both.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("all_rows")), "text-sizes")
    return both.join(sizes.hint("merge"), "text_sha256").select(
        "doc_id", "keep_id", F.col("all_rows").alias("group_size"), "kept", "text_sha256"
    )


def op10_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymise(read(spark, sf_dir, "documents"), DEMONSTRATION_KEY)


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.prefix_trie(read(spark, sf_dir, "conversations"))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.repaired_conversations(read(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_quality_rules": op2_quality_rules,
    "op3_source_mix": op3_source_mix,
    "op4_packing": op4_packing,
    "op5_line_dedup": op5_line_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_simhash": op7_simhash,
    "op8_warc": op8_warc,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_pseudonyms": op10_pseudonyms,
    "op11_decontamination": op11_decontamination,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_structure_repair": op13_structure_repair,
}

def _crc32(text: str) -> str:
    """DuckDB has no CRC-32: bit by bit over the text's (ASCII) characters."""
    codes = f"[ascii(x) for x in string_split({text}, '')]"
    byte = "list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda c, b: {byte}), 4294967295)"


SQL = {
    "op5_line_dedup": r"""
        WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
        l AS (
            SELECT doc_id, unnest(parts) AS raw, unnest(range(len(parts))) AS line_no, len(parts) AS n_lines FROM docs
        ),
        p AS (
            SELECT *, trim(raw, ' ') AS line, doc_id::HUGEINT * 1000000000 + line_no AS place FROM l
        ),
        d AS (SELECT line, min(place) AS first_place FROM p WHERE line <> '' GROUP BY line),
        m AS (SELECT line, first_place, length(line) + o AS m FROM d, (VALUES (0), (1)) AS t(o) WHERE length(line) >= 20),
        k AS (
            SELECT line, first_place, m, 0 AS side, substr(line, 1, m // 2) AS half FROM m
            UNION ALL
            SELECT line, first_place, m, 1, substr(line, length(line) - (m - m // 2) + 1) FROM m
        ),
        near AS (
            SELECT DISTINCT a.line FROM k a JOIN k b USING (m, side, half)
            WHERE b.first_place < a.first_place AND abs(length(a.line) - length(b.line)) <= 1
              AND list_bool_or([
                  left(a.line, i) = left(b.line, i) AND (
                      substr(a.line, i + 2) = substr(b.line, i + 2) OR substr(a.line, i + 2) = substr(b.line, i + 1)
                      OR substr(a.line, i + 1) = substr(b.line, i + 2))
                  for i in range(least(length(a.line), length(b.line)) + 1)])
        ),
        g AS (
            SELECT p.*, coalesce(place > first_place, false) AS copied,
                   coalesce(place = first_place, false) AND near.line IS NOT NULL AS differs
            FROM p LEFT JOIN d ON p.line = d.line LEFT JOIN near ON d.line = near.line
        )
        SELECT doc_id, any_value(n_lines)::BIGINT AS n_lines, count(*) FILTER (copied OR differs) AS n_repeated,
               count(*) FILTER (differs) AS n_near,
               coalesce(string_agg(raw, chr(10) ORDER BY line_no) FILTER (NOT (copied OR differs)), '') AS text
        FROM g GROUP BY doc_id
    """,
    "op8_warc": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (
            SELECT page_id, html, min(page_id) OVER (PARTITION BY html) AS first_id,
                   [instr('0123456789abcdef', x) - 1 for x in string_split(sha1(html), '')] AS nibbles
            FROM p
        ),
        b AS (
            SELECT *, [(nibbles[i // 4 + 1] // [8, 4, 2, 1][i % 4 + 1]) % 2 for i in range(160)] AS bits FROM d
        )
        SELECT page_id, strlen(html) AS payload_bytes,
               array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   (16 * bits[5 * i + 1] + 8 * bits[5 * i + 2] + 4 * bits[5 * i + 3] + 2 * bits[5 * i + 4]
                    + bits[5 * i + 5] + 1)::BIGINT, 1) for i in range(32)], '') AS payload_digest,
               CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first_id THEN first_id END AS refers_to, NULL::VARCHAR AS problem
        FROM b
    """,
    "op9_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
        )
        SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
        FROM t
    """,
    "op11_decontamination": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents
        ),
        i AS (
            SELECT item_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark
        ),
        p AS (SELECT *, least(len(w), 10) AS m, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0),
        iw AS (SELECT DISTINCT item_id::VARCHAR AS item, m, array_to_string(list_slice(w, p, p + m - 1), ' ') AS g FROM p),
        dp AS (
            SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, (SELECT DISTINCT m FROM iw) WHERE len(w) >= m
        ),
        h AS (
            SELECT r, m, p, g FROM (SELECT r, m, p, array_to_string(list_slice(w, p, p + m - 1), ' ') AS g FROM dp)
            WHERE g IN (SELECT g FROM iw)
        ),
        c AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + m)) AS q FROM h) GROUP BY r),
        t AS (
            SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
            FROM (SELECT DISTINCT r, item FROM h JOIN iw USING (g)) GROUP BY r
        )
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)
    """,
    "op12_prefix_trie": f"""
        WITH t AS (
            SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS n,
                   {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS said
            FROM conversations WHERE conv_id IS NOT NULL
        ),
        l AS (
            SELECT conv_id, list(said ORDER BY n) AS turns, {_crc32("conv_id::VARCHAR")} % 6 AS h FROM t GROUP BY conv_id
        ),
        r AS (
            SELECT l.conv_id, list_concat(coalesce(b.turns[1:l.h], []), l.turns[l.h + 1:]) AS turns
            FROM l LEFT JOIN l b ON b.conv_id = l.conv_id - l.conv_id % 100
        ),
        m AS (SELECT conv_id, len(turns) AS size, d, turns[1:d] AS path FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM r)),
        n AS (
            SELECT d, path, min(conv_id) AS conv_id, count(*) AS n_convs, max(size) = d AS childless,
                   coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = d), '') AS ends,
                   CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * length(path[d].text) END AS saved
            FROM m GROUP BY d, path
        ),
        up AS (SELECT path[1:a] AS path, d, a, childless, saved FROM (SELECT *, unnest(range(d + 1)) AS a FROM n)),
        s AS (
            SELECT path, count(*) FILTER (d = a + 1) AS n_children, count(*) FILTER (childless) AS n_leaves,
                   sum(saved)::BIGINT AS saved_tokens
            FROM up GROUP BY path
        )
        SELECT n.conv_id, n.d::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, s.n_children, s.n_leaves,
               s.saved_tokens, sha256(n.ends) AS ends_sha256
        FROM n JOIN s ON n.path = s.path LEFT JOIN n p ON n.d > 0 AND p.path = n.path[1:n.d - 1]
    """,
    "op13_structure_repair": f"""
        WITH RECURSIVE f AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS damage
            FROM conversations
        ),
        e AS (
            SELECT conv_id, turn, CASE damage WHEN 4 THEN 'user' ELSE role END AS role,
                   CASE damage WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(range(CASE damage WHEN 3 THEN 2 ELSE 1 END)) AS copy
            FROM f WHERE damage <> 0
        ),
        o AS (
            SELECT *, place > min(place) OVER (PARTITION BY conv_id, role, text) AS again,
                   rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS seen
            FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM e)
        ),
        g AS (
            SELECT *, left(role, 1) AS r, lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY place) AS after,
                   CASE WHEN seen = '' THEN 'blank' WHEN again THEN 'duplicate'
                        WHEN right(seen, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
            FROM o
        ),
        -- The cheapest edits of the rows from a place on, before each state: start, after s, after u, after a.
        z AS (
            SELECT conv_id, max(place) + 1 AS place, {{'c': 0, 'e': ''}} AS s0, {{'c': 10, 'e': 'II'}} AS ss,
                   {{'c': 5, 'e': 'I'}} AS su, {{'c': 0, 'e': ''}} AS sa
            FROM g GROUP BY conv_id
            UNION ALL
            SELECT conv_id, place,
                   least(x0, {{'c': xu.c + 5, 'e': 'I' || xu.e}}, {{'c': xa.c + 10, 'e': 'II' || xa.e}}),
                   least(xs, {{'c': xu.c + 5, 'e': 'I' || xu.e}}, {{'c': xa.c + 10, 'e': 'II' || xa.e}}),
                   least(xu, {{'c': xa.c + 5, 'e': 'I' || xa.e}}), least(xa, {{'c': xu.c + 5, 'e': 'I' || xu.e}})
            FROM (
                SELECT z.conv_id, g.place, k,
                       least({{'c': s0.c + 2, 'e': 'D' || s0.e}}, {{'c': su.c + k + 1, 'e': 'R' || su.e}},
                             {{'c': su.c + k + (CASE r WHEN 'u' THEN 0 ELSE 1000000 END), 'e': 'K' || su.e}},
                             {{'c': ss.c + k + (CASE r WHEN 's' THEN 0 ELSE 1000000 END), 'e': 'K' || ss.e}}) AS x0,
                       least({{'c': ss.c + 2, 'e': 'D' || ss.e}}, {{'c': su.c + k + 1, 'e': 'R' || su.e}},
                             {{'c': su.c + k + (CASE r WHEN 'u' THEN 0 ELSE 1000000 END), 'e': 'K' || su.e}}) AS xs,
                       least({{'c': su.c + 2, 'e': 'D' || su.e}}, {{'c': sa.c + k + 1, 'e': 'R' || sa.e}},
                             {{'c': sa.c + k + (CASE r WHEN 'a' THEN 0 ELSE 1000000 END), 'e': 'K' || sa.e}}) AS xu,
                       least({{'c': sa.c + 2, 'e': 'D' || sa.e}}, {{'c': su.c + k + 1, 'e': 'R' || su.e}},
                             {{'c': su.c + k + (CASE r WHEN 'u' THEN 0 ELSE 1000000 END), 'e': 'K' || su.e}}) AS xa
                FROM z JOIN (
                    SELECT *, CASE fault WHEN '' THEN 0 WHEN 'truncated' THEN 5 ELSE 1000000 END AS k FROM g
                ) g ON g.conv_id IS NOT DISTINCT FROM z.conv_id AND g.place = z.place - 1
            )
        ),
        b AS (SELECT conv_id, s0.c AS cost, s0.e AS audit FROM z WHERE place = 1),
        -- The letter of each row; the speaker of a row or an inserted message follows from what was kept before it.
        le AS (SELECT conv_id, audit, unnest(range(1, len(audit) + 1)) AS j FROM b),
        la AS (
            SELECT conv_id, j, audit[j] AS letter,
                   count(*) FILTER (audit[j] <> 'I') OVER (PARTITION BY conv_id ORDER BY j) AS place,
                   count(*) FILTER (audit[j] <> 'D') OVER (PARTITION BY conv_id ORDER BY j) AS number
            FROM le
        ),
        fit AS (
            SELECT la.*, g.role, g.text,
                   bool_or(letter = 'K' AND number = 1 AND g.r = 's') OVER (PARTITION BY la.conv_id) AS system
            FROM la LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM la.conv_id AND g.place = la.place AND letter <> 'I'
            WHERE letter <> 'D'
        ),
        h AS (
            SELECT conv_id, string_agg(CASE letter WHEN 'K' THEN role || ':' || text ELSE
                CASE WHEN (number - system::INT) % 2 = 1 THEN 'user:' ELSE 'assistant:' END || coalesce(text, '') END,
                chr(10) ORDER BY j) AS whole
            FROM fit GROUP BY conv_id
        ),
        a AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                   count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                   count(*) FILTER (fault = 'truncated') AS truncated,
                   count(*) FILTER (after IS NOT NULL AND r || after NOT IN ('su', 'ua', 'au')) AS illegal
            FROM g GROUP BY conv_id
        )
        SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
               coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost,
               coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) i
        LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM i.conv_id
        LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM i.conv_id
    """,
}
