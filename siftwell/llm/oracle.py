"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from .license_scan import CONTAINMENT, PHRASES, TEMPLATES

_PLACES = "list_filter(range(0, len(w) - {n} + 1), lambda i: {test})"


def _phrase_places(phrase: str) -> str:
    tokens = phrase.split()
    test = " AND ".join(f"w[i + {k}] = '{t}'" for k, t in enumerate(tokens, 1))
    return _PLACES.format(n=len(tokens), test=test)


def _license_sql() -> str:
    """Every run of as many words as a template has that begins with one of its words, or is the text's last, is compared with it. Other runs hold no more than the next of these."""
    phrases = " UNION ALL ".join(f"SELECT k, '{label}' AS label, unnest({_phrase_places(p)}) AS place FROM d" for p, label in PHRASES)
    templates = ", ".join(f"({i}, '{label}', {len(t.split())}, {len(set(t.split()))})" for i, (t, label) in enumerate(TEMPLATES))
    tokens = ", ".join(f"({i}, '{token}')" for i, (t, _) in enumerate(TEMPLATES) for token in sorted(set(t.split())))
    return rf"""
        WITH d AS (
            SELECT row_number() OVER () AS k, doc_id,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents
        ), p AS ({phrases}),
        base AS (
            SELECT k, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS base
            FROM p GROUP BY k
        ), t(tid, label, words, size) AS (VALUES {templates}), tt(tid, token) AS (VALUES {tokens}),
        m AS (
            SELECT k, tid, token, pos, n FROM (SELECT k, unnest(w) AS token, unnest(range(len(w))) AS pos, len(w) AS n FROM d) JOIN tt USING (token)
        ), enough AS (
            SELECT k, tid, words, size FROM m JOIN t USING (tid) GROUP BY k, tid, words, size HAVING count(DISTINCT token) >= {CONTAINMENT} * size - 1e-9
        ), runs AS (
            SELECT DISTINCT k, tid, words, size, least(pos, greatest(n - words, 0)) AS s FROM m JOIN enough USING (k, tid)
        ), hits AS (
            SELECT k, tid, s, count(DISTINCT token) / any_value(size) AS share FROM runs JOIN m USING (k, tid) WHERE pos >= s AND pos < s + words GROUP BY k, tid, s
        ), found AS (
            SELECT k, list(DISTINCT label) AS found, max(share) AS share FROM hits JOIN t USING (tid) WHERE share >= {CONTAINMENT} - 1e-9 GROUP BY k
        )
        SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
               coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
               coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(found, [])))), ','), '') AS labels,
               round(CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE, 6) AS score
        FROM d LEFT JOIN base USING (k) LEFT JOIN found USING (k)
    """


def _audit_sql() -> str:
    """Every order is spelled out by joins of the letters; what a step does is counted over the documents of each failure mask."""
    letters = "(VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16))"
    names = "abcde"
    joins = " ".join(f"JOIN l {n} ON {' AND '.join(f'{n}.x <> {m}.x' for m in names[:k])}" if k else f"l {n}" for k, n in enumerate(names))
    steps = " UNION ALL ".join(f"SELECT o, {k + 1} AS step, {n} AS bit, {' + '.join(names[:k]) or '0'} AS before FROM orders" for k, n in enumerate(names))
    return rf"""
        WITH known AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS bad FROM labels GROUP BY doc_id),
        d AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                   min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least
            FROM documents
        ), m AS (
            SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
                   (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT
                   + 4 * (100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 5 * length(t))::INT
                   + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > least, false)::INT AS mask
            FROM d LEFT JOIN known USING (doc_id)
        ), cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM m GROUP BY part, mask),
        l(x, b) AS (FROM {letters}),
        orders AS (SELECT {' || '.join(f'{n}.x' for n in names)} AS o, {', '.join(f'{n}.b AS {n}' for n in names)} FROM {joins}),
        steps AS ({steps}),
        told AS (
            SELECT part, o AS filter_order, step, bit,
                   coalesce(sum(n) FILTER (mask & (before + bit) = 0), 0)::BIGINT AS kept,
                   coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS removed,
                   coalesce(sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0), 0)::BIGINT AS redundant,
                   coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
                   coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS good_lost,
                   coalesce(sum(bad) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS toxic_lost
            FROM cells CROSS JOIN steps GROUP BY part, o, step, bit
        )
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM told
    """


LEAF_LEVELS, ROOT_LEVELS = 14, 8  # levels that the SQL of op12 unrolls: enough for 3 ** 14 documents of a source and 3 ** 8 sources


def _merkle_sql() -> str:
    """Levels are unrolled; a group whose tree has fewer repeats its subroot on the levels above, which add nothing to a proof."""

    def encoded(column: str, text: str | None = None) -> str:
        text = text or f"{column}::VARCHAR"
        return f"coalesce(octet_length(encode({text})) || ':' || {text}, '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join([*(encoded(c) for c in ("doc_id", "source", "lang", "n_chars")), encoded("text", text)]) + ")"

    # CRC-32 of an id's decimal digits, bit by bit; only its last bit is asked for.
    crc = "list_reduce(list_prepend(4294967295::UBIGINT, [ascii(c)::UBIGINT FOR c IN string_split(doc_id::VARCHAR, '')]), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda x, y: xor(x // 2, (x % 2) * 3988292384::UBIGINT)))"
    parts = [f"""
        t AS MATERIALIZED (SELECT *, row_number() OVER () AS k FROM documents),
        d AS MATERIALIZED (
            SELECT k, doc_id, source, {leaf('text')} AS leaf, CASE WHEN ({crc}) % 2 = 1 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf('text')} END AS now FROM t
        ),
        s0 AS MATERIALIZED (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, k) - 1 AS i, leaf AS h, k FROM d)"""]

    def tree(name: str, group: str, levels: int) -> None:
        for n in range(levels):
            last = f"count(*) OVER (PARTITION BY {group}) = 1"
            parts.append(f"""{name}x{n} AS MATERIALIZED (SELECT *, {last} AS done FROM {name}{n}),
        {name}{n + 1} AS MATERIALIZED (SELECT {group}, i // 3 AS i, CASE WHEN bool_or(done) THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {name}x{n} GROUP BY {group}, i // 3)""")

    tree("s", "source", LEAF_LEVELS)
    parts.append(f"r0 AS MATERIALIZED (SELECT 1 AS one, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, h, source FROM s{LEAF_LEVELS})")
    tree("r", "one", ROOT_LEVELS)
    # Down again: every node knows what stands before and after it in its run.
    parts.append(f"""p0 AS MATERIALIZED (
            SELECT d.k, d.doc_id, d.leaf, s{LEAF_LEVELS}.h AS subroot, r{ROOT_LEVELS}.h AS root, d.source, s0.i, r0.i AS ri, d.now AS folded, '' AS proof
            FROM d JOIN s0 USING (k) JOIN s{LEAF_LEVELS} ON s{LEAF_LEVELS}.source IS NOT DISTINCT FROM d.source JOIN r0 ON r0.source IS NOT DISTINCT FROM d.source CROSS JOIN r{ROOT_LEVELS})""")
    at = 0
    for name, levels, match, i in (("s", LEAF_LEVELS, "x.source IS NOT DISTINCT FROM p.source AND ", "i"), ("r", ROOT_LEVELS, "", "ri")):
        for n in range(levels):
            parts.append(f"""p{at + 1} AS MATERIALIZED (
            WITH y AS (
                SELECT p.k, coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (x.i < p.{i}), '') AS lo, coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (x.i > p.{i}), '') AS hi, bool_or(x.done) AS done
                FROM p{at} p JOIN {name}x{n} x ON {match}x.i // 3 = p.{i} // 3 GROUP BY p.k
            )
            SELECT p.* REPLACE (p.{i} // 3 AS {i}, CASE WHEN done THEN folded ELSE sha256(lo || folded || hi) END AS folded, proof || lo || hi AS proof) FROM p{at} p JOIN y USING (k))""")
            at += 1
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM p{at}"


ORACLE_SQL: dict[str, str] = {
    "op11_filter_audit": _audit_sql(),
    "op12_merkle_manifest": _merkle_sql(),
    "op10_license_scan": _license_sql(),
    "op9_url_filter": r"""
        WITH r(action, host, path) AS (VALUES
            ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'),
            ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
        ), u AS (
            SELECT row_number() OVER () AS k, page_id,
                   CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
            FROM pages
        ), s AS (
            SELECT k, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
            FROM u
        ), best AS (
            SELECT s.k, arg_max(r.host || r.path, length(r.host) + length(r.path)) AS rule, arg_max(r.action, length(r.host) + length(r.path)) AS action
            FROM s JOIN r ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path)
            GROUP BY s.k
        )
        SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM s LEFT JOIN best USING (k)
    """,
    "op7_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS points,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
            FROM documents
        )
        SELECT doc_id,
               first_value(doc_id) OVER w AS keep_id,
               count(*) OVER (PARTITION BY h) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept,
               h AS text_sha256
        FROM d
        WINDOW w AS (PARTITION BY h ORDER BY points DESC, doc_id)
    """,
}
