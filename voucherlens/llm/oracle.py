"""DuckDB twins of the text queries that SQL can express."""

from __future__ import annotations

from voucherlens.llm.filter_audit import steps
from voucherlens.llm.licenses import NOT_WORD, RULES, SENTENCE_END, SENTENCES, normalised_text, rule_pattern
from voucherlens.llm.queries import URL_RULES
from voucherlens.llm.url_reputation import PUBLIC_SECOND_LEVEL

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _strength(members: str, by: str) -> str:
    """The spread of shares within groups, written as in the empirical-Bayes model."""
    return f"""
        SELECT *, 1 / greatest(least(coalesce(
            (squares - group_n * m * m - (members - 1) * m * (1 - m)) / nullif((scale - (members - 1)) * m * (1 - m), 0), 0), 0.5), 1 / 1001.0) - 1 AS strength
        FROM (SELECT {by}, sum(good) AS group_good, sum(n) AS group_n, sum(good) / sum(n) AS m,
              sum(n * (good / n) * (good / n)) AS squares, count(*) AS members,
              sum(n) - sum(n * n) / sum(n) AS scale FROM {members} GROUP BY {by})"""


def _url_sql() -> str:
    second = "|".join(PUBLIC_SECOND_LEVEL)
    rules = sorted(URL_RULES, key=lambda r: -len(r.target))
    fits = " ".join(
        f"WHEN (host = {_text(r.host)} OR ends_with(host, {_text('.' + r.host)})) "
        f"AND starts_with(path, {_text(r.path)}) THEN {_text(r.target)}"
        for r in rules
    )
    verdicts = " ".join(f"WHEN {_text(r.target)} THEN {_text(r.verdict)}" for r in rules)
    return f"""
    WITH cut AS (
        SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0
               THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    parsed AS (
        SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), {_AZ}) AS host,
               regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
    ruled AS (SELECT *, CASE {fits} END AS rule FROM parsed),
    hosts AS (
        SELECT host, sum(CASE WHEN (CASE rule {verdicts} END) = 'allow' THEN 1.0::DOUBLE ELSE 0 END) AS good,
               count(*)::DOUBLE AS n FROM ruled WHERE rule IS NOT NULL GROUP BY host),
    labels_of AS (
        SELECT *, coalesce(nullif(regexp_extract(host, '([^.]+[.](?:(?:{second})[.][a-z][a-z]|[^.]+))$', 1), ''), host) AS domain,
               CASE WHEN regexp_matches(host, '[.](?:{second})[.][a-z][a-z]$')
               THEN regexp_extract(host, '[.]((?:{second})[.][a-z][a-z])$', 1)
               ELSE regexp_extract(host, '([^.]*)$', 1) END AS suffix FROM hosts),
    d AS ({_strength("labels_of", "domain, suffix")}),
    dm AS (SELECT domain, suffix, group_good AS good, group_n AS n FROM d),
    s AS ({_strength("dm", "suffix")}),
    sm AS (SELECT 0 AS root, group_good AS good, group_n AS n FROM s),
    r AS ({_strength("sm", "root")}),
    s2 AS (SELECT suffix, least(s.strength, s.group_n + r.strength) AS strength, (s.group_good + r.strength * (r.group_good + 1) / (r.group_n + 2)) / (s.group_n + r.strength) AS mean FROM s, r),
    d2 AS (SELECT d.domain, least(d.strength, d.group_n + s2.strength) AS strength, (d.group_good + s2.strength * s2.mean) / (d.group_n + s2.strength) AS mean FROM d JOIN s2 USING (suffix)),
    ab AS (SELECT host, good + d2.strength * d2.mean AS a, n - good + d2.strength * (1 - d2.mean) AS b FROM labels_of JOIN d2 USING (domain)),
    h AS (SELECT host, least(a / (a + b) + 2 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 1.0) AS upper FROM ab)
    SELECT page_id, host, path, rule,
           coalesce(CASE rule {verdicts} END, CASE WHEN coalesce(upper, 1) < 0.5 THEN 'block' ELSE 'allow' END) AS verdict
    FROM ruled LEFT JOIN h USING (host)"""


def _licence_sql() -> str:
    known = ", ".join(f"({_text(normalised_text(s))}, {_text(name)})" for name, s in SENTENCES.items())
    rules = " UNION ALL ".join(
        f"SELECT doc_id, {_text(r.licence)} AS licence FROM joined WHERE regexp_matches(seq, {_text(rule_pattern(r, 2))})"
        for r in RULES
    )
    return f"""
    WITH known(norm, name) AS (VALUES {known}),
    s AS (SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS sentence
          FROM (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), {_text(SENTENCE_END)}) AS p FROM documents)),
    n AS (SELECT doc_id, i, trim(regexp_replace(translate(sentence, {_AZ}), {_text(NOT_WORD)}, ' ', 'g'), ' .-') AS norm FROM s),
    found AS (SELECT doc_id, i, coalesce(name, '') AS name FROM n LEFT JOIN known USING (norm)),
    joined AS (SELECT doc_id, string_agg(name, ';' ORDER BY i) || ';' AS seq,
               count(*) FILTER (WHERE name <> '') AS n_sentences,
               coalesce(string_agg(name, ',' ORDER BY i) FILTER (WHERE name <> ''), '') AS sentences
               FROM found GROUP BY doc_id),
    hits AS (SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences FROM ({rules}) GROUP BY doc_id)
    SELECT doc_id, n_sentences, sentences, coalesce(licences, '') AS licences FROM joined LEFT JOIN hits USING (doc_id)"""


def _decontamination_sql() -> str:
    """Windows as joined words; a document word is hit within 13 words of a window's start."""
    item = lambda table, key: f"""
        SELECT {key}, list_filter(string_split(regexp_replace(translate(coalesce(text, ''), {_AZ}),
            '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM {table}"""  # noqa: E731
    return f"""
    WITH b AS ({item("benchmark", "item_id")}),
    wins AS (SELECT DISTINCT item_id, size, list_slice(w, i, i + size - 1) AS win FROM (
        SELECT item_id, w, least(13, len(w)) AS size, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i
        FROM b WHERE len(w) > 0)),
    d AS ({item("documents", "doc_id")}),
    sizes AS (SELECT DISTINCT size FROM wins),
    dw AS (SELECT doc_id, i, size, list_slice(w, i, i + size - 1) AS win FROM (
        SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
    m AS (SELECT doc_id, i, size, item_id FROM dw JOIN wins USING (size, win)),
    hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS p FROM m) GROUP BY doc_id),
    it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM m GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)"""


def _trie_sql() -> str:
    """Every prefix as a list of turns; subtrees are found by comparing prefixes."""
    # CRC-32 of the decimal id, a byte and then eight shifts at a time.
    crc = """xor(4294967295::BIGINT, list_reduce(
        list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, strlen(c::VARCHAR) + 1),
            lambda i: [ascii((c::VARCHAR)[i])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END))"""
    return f"""
    WITH t AS (SELECT conv_id AS c, turn, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS said
               FROM conversations WHERE conv_id IS NOT NULL),
    own AS (SELECT c, list(said ORDER BY turn NULLS FIRST) AS turns FROM t GROUP BY c),
    cut AS (SELECT c, turns, {crc} % 6 AS h FROM own),
    built AS (SELECT a.c, list_concat(coalesce(b.turns[1:a.h], []), a.turns[a.h + 1:]) AS turns
              FROM cut a LEFT JOIN own b ON b.c = a.c - a.c % 100),
    p AS (SELECT c, d, turns[1:d] AS prefix, d = len(turns) AS ends
          FROM (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS d FROM built)),
    n AS (SELECT prefix, d, min(c) AS conv_id, count(*) AS n_convs,
                 sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
          FROM p GROUP BY prefix, d),
    k AS (SELECT prefix[1:d - 1] AS above, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
    v AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children,
                 CASE WHEN n.d > 0 THEN (n_convs - 1) * length(prefix[-1].text) ELSE 0 END AS saved
          FROM n LEFT JOIN k ON n.prefix = k.above),
    up AS (SELECT prefix[1:g] AS prefix, sum(saved) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves
           FROM (SELECT *, unnest(range(0, d + 1)) AS g FROM v) GROUP BY 1)
    SELECT v.conv_id, v.d AS depth, a.conv_id AS parent_conv_id, v.n_convs, v.n_children, up.n_leaves,
           up.saved_tokens::BIGINT AS saved_tokens, v.ends_sha256
    FROM v JOIN up ON v.prefix = up.prefix LEFT JOIN n a ON v.d > 0 AND a.d = v.d - 1 AND a.prefix = v.prefix[1:v.d - 1]"""


def _audit_sql() -> str:
    """Every document against every step of every order."""
    rows = ", ".join(f"('{order}', {step}, {bit}, {before})" for order, step, bit, before in steps())
    return f"""
    WITH steps(filter_order, step, f, p) AS (VALUES {rows}),
    d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
                 min(doc_id) OVER (PARTITION BY text) AS least FROM d),
    m AS (SELECT part, doc_id,
            CASE WHEN len(words) < 50 THEN 1 ELSE 0 END
            + CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END
            + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 4 ELSE 0 END
            + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
            + CASE WHEN least < doc_id OR (doc_id IS NULL AND least IS NOT NULL) THEN 16 ELSE 0 END AS mask FROM w),
    g AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
                 max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
    j AS (SELECT m.*, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM m LEFT JOIN g USING (doc_id)),
    r AS (SELECT part, filter_order, step, f,
            count(*) FILTER (WHERE mask & (p | f) = 0) AS kept,
            count(*) FILTER (WHERE mask & p = 0 AND mask & f <> 0) AS removed,
            count(*) FILTER (WHERE mask & p <> 0 AND mask & f <> 0) AS redundant,
            count(*) FILTER (WHERE mask = f) AS unique_fails,
            count(*) FILTER (WHERE mask & p = 0 AND mask & f <> 0 AND good = 1) AS good_lost,
            count(*) FILTER (WHERE mask & p = 0 AND mask & f <> 0 AND toxic = 1) AS toxic_lost
          FROM j, steps GROUP BY part, filter_order, step, f)
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
           (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM r"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_url_reputation": _url_sql(),
        "op8_license_scan": _licence_sql(),
        "op10_benchmark_decontamination": _decontamination_sql(),
        "op11_conversation_prefix_trie": _trie_sql(),
        "op13_filter_audit": _audit_sql(),
    }
