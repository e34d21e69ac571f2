"""The registered queries of the corpus operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language, mixing, neardup, phrases, pii, secrets, spans, substrings, threads, tokens
from .common import documents


def _digest(found: DataFrame, added: str, kinds: tuple[str, ...], n: int) -> DataFrame:
    """The contract's columns of a scan: counts (of the first ``n`` kinds) and hash of the base
    spans, then all spans."""
    base = F.col("base")
    counts = [spans.count(base, k).alias(f"n_{kinds[k]}") for k in range(n)]
    return found.select("doc_id", *counts, F.sha2(spans.written(base, kinds), 256).alias("base_sha256"), spans.written(spans.ordered("base", added), kinds).alias("spans"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.sanitise(documents(spark, sf_dir).select("doc_id", "text"))
    return _digest(found, "terms", pii.KINDS, 4)


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(secrets.scan(documents(spark, sf_dir).select("doc_id", "source", "text")), "live", secrets.KINDS, 3)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.spliced(documents(spark, sf_dir))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads.link_quotes(documents(spark, sf_dir, "conversations"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = language.identify(docs.select("doc_id", "text"), language.train(docs))
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = tokens.token_counts(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_benchmark_decontamination,
        op2_pii,
        op3_secret_scans,
        op4_substring_dedup,
        op5_document_fingerprints,
        op6_chat_formatting,
        op7_language_id,
        op8_token_counts,
        op9_mix_sources,
        op10_simhash_near_dedup,
    )
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_ROWS = "d AS (SELECT row_number() OVER () AS r, *, coalesce(text, '') AS t FROM documents)"


def _matches(name: str, source: str, pattern: str, of: str = "t", keep: str = "") -> str:
    """A CTE of the matches of a pattern in a column: the columns of ``source``, start, stop, v."""
    ends = lambda x, to: f"coalesce(list_sum(list_transform({x}[1:{to}], lambda y: length(y))), 0)"
    split = f"(SELECT *, regexp_extract_all({of}, '{pattern}') AS vs, string_split_regex({of}, '{pattern}') AS gs FROM {source})"
    each = f"(SELECT *, unnest(range(1, len(vs) + 1)) AS i FROM {split} WHERE len(vs) > 0)"
    return f"{name} AS (SELECT * EXCLUDE (vs, gs, i), ({ends('gs', 'i')} + {ends('vs', 'i - 1')})::BIGINT AS start, ({ends('gs', 'i')} + {ends('vs', 'i')})::BIGINT AS stop, vs[i] AS v FROM {each}{keep})"


def _written(counts: str, names: str) -> str:
    """The contract's result of CTEs ``base`` and ``added`` (r, start, kind, stop)."""
    line = f"string_agg({names}[kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind, stop)"
    return f"""b AS (SELECT r, {counts}, {line} AS w FROM base GROUP BY r),
        a AS (SELECT r, {line} AS w FROM (SELECT r, start, kind, stop FROM base UNION ALL SELECT r, start, kind, stop FROM added) GROUP BY r)"""


_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda k: CASE WHEN k % 2 = 0 THEN 2 * {_DIGITS}[length({_DIGITS}) - k + 1]::INT - CASE WHEN {_DIGITS}[length({_DIGITS}) - k + 1]::INT > 4 THEN 9 ELSE 0 END ELSE {_DIGITS}[length({_DIGITS}) - k + 1]::INT END)) % 10 = 0"
_OCTET = "0*(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
_TERM = r"\p{L}{3,}"
_RUNS = "[A-Za-z0-9+/_=-]{24,}"
_KEYS = "({})".format("|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in k) for k in ("password", "passwd", "secret", "token", "api_?key")))
_ASSIGN = _KEYS + r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""

ORACLE_SQL: dict[str, str] = {
    "op2_pii": rf"""
        WITH {_ROWS},
        {_matches("em", "d", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+")},
        {_matches("ips", "d", r"[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+")},
        {_matches("cards", "d", "[0-9](?:[ -]?[0-9])+")},
        {_matches("phones", "d", "[+][0-9][ ().0-9-]+[0-9]")},
        base AS (SELECT r, t, start, 0 AS kind, stop, '0:' || lower(v) AS entity FROM em
            UNION ALL SELECT r, t, start, 1, stop, '1:' || v FROM ips WHERE regexp_full_match(v, '{_OCTET}[.]{_OCTET}[.]{_OCTET}[.]{_OCTET}')
            UNION ALL SELECT r, t, start, 2, stop, '2:' || {_DIGITS} FROM cards WHERE length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN}
            UNION ALL SELECT r, t, start, 3, stop, '3:' || {_DIGITS} FROM phones WHERE length({_DIGITS}) BETWEEN 10 AND 15),
        n AS (SELECT count(*)::DOUBLE AS total FROM d),
        ent AS (SELECT entity, count(DISTINCT r)::DOUBLE AS df_entity FROM base GROUP BY entity),
        held AS (SELECT r, any_value(t) AS t, list({{'start': start, 'stop': stop}}) AS spans FROM base GROUP BY r),
        masked AS (SELECT r, array_to_string(list_transform(range(0, length(t)), lambda k: CASE WHEN len(list_filter(spans, lambda x: x.start <= k AND k < x.stop)) > 0 THEN ' ' ELSE t[k + 1] END), '') AS m FROM held),
        far AS (SELECT DISTINCT b.entity, r, lower(unnest(regexp_extract_all(m, '{_TERM}'))) AS term FROM masked JOIN base b USING (r) JOIN ent USING (entity) WHERE df_entity > 1),
        side AS (SELECT r, entity, t AS whole, greatest(start - 48, 0) AS opens, start AS ends, start AS edge FROM base UNION ALL SELECT r, entity, t, stop, least(stop + 48, length(t)), stop FROM base),
        parts AS (SELECT *, substr(whole, opens + 1, ends - opens) AS part FROM side),
        {_matches("close", "parts", _TERM, "part")},
        near AS (SELECT DISTINCT c.entity, c.r, lower(v) AS term FROM close c JOIN held h USING (r) WHERE (c.start > 0 OR opens = 0 OR opens = edge) AND (c.stop < length(part) OR ends = length(whole) OR ends = edge)
            AND len(list_filter(spans, lambda x: x.start < opens + c.stop AND opens + c.start < x.stop)) = 0),
        joint AS (SELECT entity, r, term, bool_or(close) AS close FROM (SELECT entity, r, term, false AS close FROM far UNION ALL SELECT entity, r, term, true FROM near) GROUP BY ALL),
        pair AS (SELECT entity, term, count(*) FILTER (df_entity = 1 OR NOT lone)::DOUBLE AS df_both, count(*) FILTER (close)::DOUBLE AS df_near
            FROM (SELECT b.*, f.term IS NULL AS lone FROM joint b LEFT JOIN far f USING (entity, r, term)) JOIN ent USING (entity) GROUP BY entity, term),
        words AS (SELECT term, count(*)::DOUBLE AS df_term FROM (SELECT DISTINCT r, unnest(regexp_extract_all(lower(t), '{_TERM}')) AS term FROM d) GROUP BY term),
        rated AS (SELECT entity, term, CASE WHEN ratio >= 0.95 THEN 5 ELSE 4 END AS rate FROM (SELECT entity, term, round(least(1.0, greatest(df_both / 3, df_near / least(df_entity, 3)))
            * (log2(df_both * total / (df_entity * df_term)) / log2(total / df_entity)), 9) AS ratio FROM pair JOIN ent USING (entity) JOIN words USING (term), n WHERE df_entity < total) WHERE ratio >= 0.5),
        found AS (SELECT r, term, max(rate) AS rate FROM (SELECT entity, r, term FROM far UNION ALL SELECT entity, r, term FROM near JOIN ent USING (entity) WHERE df_entity = 1) JOIN rated USING (entity, term) GROUP BY r, term),
        {_matches("spoken", "held", _TERM)},
        added AS (SELECT s.r, s.start, CASE WHEN rate = 5 THEN 5 WHEN regexp_full_match(v, '\p{{Lu}}+') THEN 7 WHEN regexp_matches(v, '^\p{{Lu}}') THEN 6 ELSE 4 END AS kind, s.stop FROM spoken s JOIN found f ON f.r = s.r AND f.term = lower(v)
            WHERE len(list_filter(spans, lambda x: x.start < s.stop AND s.start < x.stop)) = 0),
        {_written(", ".join(f"count(*) FILTER (kind = {k}) AS n_{x}" for k, x in enumerate(pii.KINDS[:4])), str(list(pii.KINDS)))}
        SELECT doc_id, {", ".join(f"coalesce(n_{x}, 0)::BIGINT AS n_{x}" for x in pii.KINDS[:4])}, sha256(coalesce(b.w, '')) AS base_sha256, coalesce(a.w, '') AS spans FROM d LEFT JOIN b USING (r) LEFT JOIN a USING (r)""",
    "op3_secret_scans": f"""
        WITH {_ROWS},
        {_matches("assigns", "d", _ASSIGN)},
        {_matches("keys", "d", "AKIA[A-Z0-9]+")},
        {_matches("hexes", "d", "[0-9a-f]{32,}")},
        {_matches("runs", "d", _RUNS)},
        base AS (SELECT r, source, doc_id, start, 0 AS kind, stop, regexp_extract(v, '{_ASSIGN}', 2) AS value FROM assigns WHERE length(regexp_extract(v, '{_ASSIGN}', 2)) >= 8
            UNION ALL SELECT r, source, doc_id, start, 1, stop, v FROM keys WHERE length(v) >= 16 UNION ALL SELECT r, source, doc_id, start, 2, stop, v FROM hexes),
        cand AS (SELECT DISTINCT * FROM (SELECT r, source, doc_id, stop - length(value) AS start, stop, value FROM base
            UNION ALL SELECT r, source, doc_id, start, stop, v FROM runs WHERE regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[0-9]')
                AND NOT EXISTS (SELECT 1 FROM base x WHERE x.r = runs.r AND x.start < runs.stop AND runs.start < x.stop))),
        owned AS (SELECT value FROM cand GROUP BY value HAVING count(DISTINCT coalesce(source, '')) < 3 AND count(DISTINCT (coalesce(source, ''), coalesce(doc_id::VARCHAR, 'row ' || r))) < 10),
        added AS (SELECT r, start, 3 AS kind, stop FROM cand SEMI JOIN owned USING (value)),
        {_written(", ".join(f"count(*) FILTER (kind = {k}) AS n_{x}" for k, x in enumerate(secrets.KINDS[:3])), str(list(secrets.KINDS)))}
        SELECT doc_id, {", ".join(f"coalesce(n_{x}, 0)::BIGINT AS n_{x}" for x in secrets.KINDS[:3])}, sha256(coalesce(b.w, '')) AS base_sha256, coalesce(a.w, '') AS spans FROM d LEFT JOIN b USING (r) LEFT JOIN a USING (r)""",
    "op4_substring_dedup": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
        s AS (SELECT r, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
        h AS (SELECT s.r, s.i, sha256(array_to_string(d.w[s.i : s.i + 34], ' ')) AS h FROM s JOIN d USING (r)),
        twice AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1),
        gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS i FROM h SEMI JOIN twice USING (h)),
        lost AS (SELECT r, list(i) AS g FROM gone GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(g), 0)::BIGINT AS n_removed,
            sha256(array_to_string(CASE WHEN g IS NULL THEN w
                ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(g, i)), lambda i: w[i]) END, ' ')) AS kept_sha256
        FROM d LEFT JOIN lost USING (r)""",
    "op6_chat_formatting": r"""
        WITH RECURSIVE m AS (SELECT row_number() OVER () AS r, conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
        s AS (SELECT r, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS lines FROM m),
        l AS (SELECT r, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS line FROM s),
        v AS (SELECT r, i, line, length(regexp_replace(regexp_extract(line, '^[ \t]*((?:>[ \t]?)+)', 1), '[^>]', '', 'g')) AS level,
            substr(line, length(regexp_extract(line, '^[ \t]*(?:>[ \t]?)+', 0)) + 1) AS body FROM l),
        n AS (SELECT *, trim(body, ' ' || chr(9)) = '' AS blank, lead(CASE WHEN trim(body, ' ' || chr(9)) <> '' THEN level END IGNORE NULLS) OVER (PARTITION BY r ORDER BY i) AS following FROM v),
        k AS (SELECT * FROM n WHERE NOT (level = 0 AND NOT blank AND coalesce(following, 0) > 0 AND regexp_matches(trim(line),
            '(?i)^(?:(?:on|am|le|el)\b.{0,300}(?:wrote|schrieb|écrit|escribió)\s*:\s*|-{2,}\s*original message\s*-{2,}\s*)$'))),
        o AS (SELECT *, lag(blank, 1, true) OVER w OR lag(level) OVER w <> level AS opens FROM k WINDOW w AS (PARTITION BY r ORDER BY i)),
        g AS (SELECT *, sum(opens::INT) OVER (PARTITION BY r ORDER BY i) AS passage FROM o),
        piece AS (SELECT r, level, string_agg(body, chr(10) ORDER BY i) AS t FROM g WHERE NOT blank GROUP BY r, passage, level UNION ALL SELECT r, level, body FROM g WHERE NOT blank),
        words AS (SELECT r, level, regexp_extract_all(lower(t), '[\p{L}\p{N}]+') AS w FROM piece),
        h AS (SELECT DISTINCT r, level, left(sha256(array_to_string(w, ' ')), 32) AS h FROM words WHERE len(w) > 0),
        origin AS (SELECT conv_id, h, min(turn) AS original FROM h JOIN m USING (r) WHERE level = 0 AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, h),
        link AS (SELECT DISTINCT conv_id, turn, level, h, original FROM h JOIN m USING (r) JOIN origin USING (conv_id, h) WHERE level > 0 AND original < turn),
        parent AS (SELECT conv_id, turn, count(*) AS n_linked, arg_min(original, level * 1000000000000 - original) AS parent FROM link GROUP BY conv_id, turn),
        up AS (SELECT conv_id, turn, parent AS above, 1::BIGINT AS depth FROM parent UNION ALL SELECT u.conv_id, u.turn, p.parent, u.depth + 1 FROM up u JOIN parent p ON p.conv_id = u.conv_id AND p.turn = u.above),
        roots AS (SELECT conv_id, turn, arg_max(above, depth) AS root, max(depth) AS depth FROM up GROUP BY conv_id, turn),
        b AS (SELECT r, regexp_replace(regexp_replace(string_agg(rtrim(line, ' ' || chr(9)), chr(10) ORDER BY i), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS body FROM k WHERE level = 0 GROUP BY r),
        q AS (SELECT r, count(*) AS n FROM h WHERE level > 0 GROUP BY r)
        SELECT m.conv_id, m.turn, role, coalesce(body, '') AS body, '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(body, '') AS message, coalesce(q.n, 0)::BIGINT AS n_quotes,
            coalesce(n_linked, 0)::BIGINT AS n_linked, parent AS parent_turn, coalesce(root, m.turn) AS root_turn, coalesce(depth, 0)::BIGINT AS depth
        FROM m LEFT JOIN b USING (r) LEFT JOIN q USING (r) LEFT JOIN parent p ON p.conv_id = m.conv_id AND p.turn = m.turn LEFT JOIN roots t ON t.conv_id = m.conv_id AND t.turn = m.turn""",
    "op9_mix_sources": f"""
        WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size,
            ('0x' || left(md5(coalesce(doc_id::VARCHAR, '')), 15))::BIGINT AS h FROM documents),
        t AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        k AS (SELECT *, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w FROM t),
        c AS (SELECT *, source_size * 2.0::DOUBLE AS cap, row_number() OVER (ORDER BY source_size * 2.0 / w, source NULLS LAST) AS n FROM k),
        f AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
            - coalesce(sum(cap) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM c),
        g AS (SELECT *, least(cap, w * min_by(rate, n) FILTER (rate * w <= cap) OVER ()) AS target FROM f),
        b AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS fl FROM g),
        r AS (SELECT *, round(target - fl * source_size)::BIGINT AS need FROM b),
        x AS (SELECT d.*, source_size, target, fl, need, sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE UNBOUNDED PRECEDING) AS upto,
            sum(size) OVER (PARTITION BY d.source, h) AS tied FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
        SELECT doc_id, size, source_size, target, (fl * size + CASE WHEN upto <= need THEN size
            WHEN upto - tied < need THEN floor(size * (need - (upto - tied)) / tied) ELSE 0 END)::BIGINT AS taken FROM x""",
}
