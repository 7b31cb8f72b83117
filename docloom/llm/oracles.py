"""SQL of the queries that SQL can express, for a second opinion on small tables."""

from __future__ import annotations

from . import licenses, line_dedup, phrases, quality

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANK = r"[\x20\x09-\x0D]"

WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), g AS (SELECT h, min(page_id) AS first FROM p WHERE strlen(h) >= 100 GROUP BY h HAVING count(*) > 1)
SELECT page_id, CAST(strlen(p.h) AS BIGINT) AS payload_bytes, sha256(p.h) AS payload_digest, CASE WHEN g.first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN g.first <> page_id THEN g.first END AS refers_to
FROM p LEFT JOIN g ON p.h = g.h"""

_ALNUM = rf"regexp_extract_all({_LOWER.format('coalesce(text, chr(32))')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
DECONTAMINATE = f"""WITH i AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, {_ALNUM} AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item, array_to_string(list_slice(w, a, a + 9), ' ') AS win, least(10, len(w)) AS n FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS a FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
dw AS (SELECT doc_id, n, a, array_to_string(list_slice(w, a, a + n - 1), ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS a FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
h AS (SELECT doc_id, a, dw.n, item FROM dw JOIN iw ON dw.win = iw.win AND dw.n = iw.n),
pos AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(a, a + n)) AS x FROM h) GROUP BY 1),
its AS (SELECT doc_id, count(DISTINCT item) AS n_items, sha256(array_to_string(list_sort(list(DISTINCT item)), ',')) AS sha FROM h GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)"""

PHRASES = rf"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p), n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY 1),
g AS (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k),
c AS (SELECT lang, k, list_slice(w, i, i + k - 1) AS p, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= {phrases.MIN_COUNT}),
x AS (SELECT lang, k, p, f, unnest(range(1, k)) AS j FROM c WHERE k > 1),
y AS (SELECT x.lang, x.k, x.p, x.f AS a, j, l.f AS l, r.f AS r, n.n, CAST((1000::HUGEINT * x.f * n.n) // (l.f::HUGEINT * r.f) AS BIGINT) AS score FROM x JOIN n USING (lang)
  JOIN c l ON l.lang = x.lang AND l.p = list_slice(x.p, 1, j) JOIN c r ON r.lang = x.lang AND r.p = list_slice(x.p, j + 1, x.k)),
b AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, j) = 1),
q AS (SELECT lang, list_slice(p, i, i + m - 1) AS p, max(f) AS f FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c WHERE k > 2)) GROUP BY 1, 2),
z AS (SELECT b.*, array_to_string(b.p, ' ') AS phrase FROM b LEFT JOIN q USING (lang, p) WHERE q.f IS NULL OR 100 * q.f < 100 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM z QUALIFY rank <= {phrases.TOP}"""

COPIES = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS s FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY s) AS group_size, row_number() OVER w = 1 AS kept, sha256(s) AS text_sha256 FROM d WINDOW w AS (PARTITION BY s ORDER BY length(t) DESC, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""


def _merkle(levels: int = 8, group_levels: int = 3) -> str:
    """Trees of up to 8^levels documents in up to 8^group_levels groups; unrolled, as each level reads the one below."""
    counted = lambda x: f"coalesce(CAST(strlen({x}) AS VARCHAR) || ':' || {x}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(counted(x) for x in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)) + ")"
    # crc32 (reflected, polynomial 0xEDB88320) of the decimal id, bit by bit
    step = "list_reduce([xor(c, b)] || [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda x, i: xor(x >> 1, (x & 1) * 3988292384::UBIGINT))"
    crc = f"xor(list_reduce([4294967295::UBIGINT] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS UBIGINT)), lambda c, b: {step}), 4294967295::UBIGINT)"
    sql = f"""WITH r AS (SELECT row_number() OVER () AS no, * FROM documents), d AS (SELECT no, doc_id, coalesce('+' || lang, '') AS g, {leaf("text")} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {leaf(_LOWER.format("text"))} ELSE {leaf("text")} END AS changed FROM r),
a0 AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, no) - 1 AS i, count(*) OVER (PARTITION BY g) AS n, leaf AS h, no FROM d)"""

    def climb(t: str, levels: int) -> str:
        out = ""
        for k in range(levels):
            out += f""",
{t}r{k} AS (SELECT g, i // 8 AS i, n, list(h ORDER BY i) AS hs FROM {t}{k} GROUP BY g, i // 8, n), {t}{k + 1} AS (SELECT g, i, (n + 7) // 8 AS n, CASE WHEN n > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h FROM {t}r{k})"""
        return out

    sql += climb("a", levels) + f",\ns AS (SELECT g, h FROM a{levels}), b0 AS (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n, h, g AS lang FROM s)" + climb("b", group_levels)
    steps = [("a", k, "x.g = {t}.g", "x.i") for k in range(levels)] + [("b", k, "true", "z.i") for k in range(group_levels)]
    sql += f",\np0 AS (SELECT d.doc_id, d.leaf, s.h AS subroot, (SELECT h FROM b{group_levels}) AS root, x.g, x.i AS i, z.i AS j, '' AS sib, d.changed AS f FROM d JOIN a0 x ON x.no = d.no JOIN s ON s.g = d.g JOIN b0 z ON z.lang = d.g)"
    for m, (t, k, on, _) in enumerate(steps):
        at = f"(x.{'i' if t == 'a' else 'j'} // {8**k})"
        left, right = f"array_to_string(list_slice(t.hs, 1, {at} % 8), '')", f"array_to_string(list_slice(t.hs, {at} % 8 + 2, 8), '')"
        sql += f",\np{m + 1} AS (SELECT doc_id, leaf, subroot, root, x.g, x.i, x.j, CASE WHEN t.n > 1 THEN sib || {left} || {right} ELSE sib END AS sib, CASE WHEN t.n > 1 THEN sha256({left} || f || {right}) ELSE f END AS f FROM p{m} x JOIN {t}r{k} t ON {on.format(t='t')} AND t.i = {at} // 8)"
    return sql + f"\nSELECT doc_id, leaf, subroot, root, sha256(sib) AS proof_sha256, f AS folded_root, f = root AS verified FROM p{len(steps)}"


MERKLE = _merkle()

JACCARD = rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, a, a + 2), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS a FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 90 * (na.n + nb.n - c)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY 1) USING (doc_id)"""

LINES = rf"""WITH l AS (SELECT doc_id, line, i, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
f AS (SELECT doc_id, i, md5(t) AS h, greatest(1, (len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) + {line_dedup.UNIT_WORDS - 1}) // {line_dedup.UNIT_WORDS}) AS u, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p FROM l WHERE t <> ''),
un AS (SELECT doc_id, p, h, j, row_number() OVER (PARTITION BY doc_id ORDER BY p, j) AS q FROM (SELECT doc_id, p, h, unnest(range(0, u)) AS j FROM f)),
sh AS (SELECT doc_id, p, q, left(md5(string_agg(h || '.' || j, '|') OVER s), 16) AS g, count(*) OVER s AS c FROM un WINDOW s AS (PARTITION BY doc_id ORDER BY q ROWS BETWEEN CURRENT ROW AND {line_dedup.NOISE - 1} FOLLOWING)),
s AS (SELECT doc_id, p, q, g, count(*) OVER (PARTITION BY doc_id) AS m FROM sh WHERE c = {line_dedup.NOISE}),
w AS (SELECT doc_id, q, m, min(g || lpad(CAST(999999999 - q AS VARCHAR), 9, '0')) OVER (PARTITION BY doc_id ORDER BY q ROWS BETWEEN CURRENT ROW AND {line_dedup.WINDOW - 1} FOLLOWING) AS x FROM s),
c AS (SELECT DISTINCT doc_id, 999999999 - CAST(substr(x, 17) AS BIGINT) AS q FROM w WHERE q <= greatest(1, m - {line_dedup.WINDOW - 1})),
o AS (SELECT g, doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS r FROM c JOIN s USING (doc_id, q)),
pr AS (SELECT o.doc_id, o.p, z.doc_id AS d0, o.p - z.p AS d FROM o JOIN o z ON o.g = z.g AND o.r > 1 AND z.r = 1),
e AS (SELECT x.doc_id, d0, d, a.p, a.p - row_number() OVER (PARTITION BY x.doc_id, d0, d ORDER BY a.p) AS island FROM (SELECT DISTINCT doc_id, d0, d FROM pr) x JOIN f a ON a.doc_id = x.doc_id JOIN f b ON b.doc_id = x.d0 AND b.p = a.p - x.d AND b.h = a.h),
k AS (SELECT DISTINCT doc_id, d0, d, island FROM e JOIN pr USING (doc_id, d0, d, p)),
gone AS (SELECT DISTINCT f.doc_id, f.i FROM e JOIN k USING (doc_id, d0, d, island) JOIN f ON f.doc_id = e.doc_id AND f.p = e.p)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(x.t, '') END AS text, d.lang, d.source, d.n_chars, CAST(coalesce(y.n, 0) AS BIGINT) AS n_removed_lines FROM documents d
LEFT JOIN (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.i) AS t FROM l ANTI JOIN gone ON gone.doc_id = l.doc_id AND gone.i = l.i GROUP BY 1) x USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1) y USING (doc_id)"""


def _licenses() -> str:
    patterns = licenses.known()
    quoted = lambda s: s.replace("'", "''").replace("\n", "' || chr(10) || '")
    listed = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    text = "chr(10) || lower(t)"
    for pattern, by in licenses.STEPS:
        text = f"regexp_replace({text}, '{quoted(pattern)}', '{quoted(by)}', 'g')"
    canon = "regexp_replace(x, '\\|', ' ', 'g') || ' '"
    for pattern, by in licenses.CANONICAL:
        canon = f"regexp_replace({canon}, '{quoted(pattern)}', '{quoted(by)}', 'g')"
    every = quoted("|".join(patterns.values()))
    case = " ".join(f"WHEN regexp_matches(x, '^(?:{quoted(p)})$') THEN '{k}'" for k, p in patterns.items())
    bare = f"regexp_replace(regexp_replace(' ' || trim(p) || ' ', '{licenses.LEAD}', ' '), ' lic ', ' ', 'g')"
    longest = "coalesce(" + ", ".join(f"CASE WHEN len(w) >= {n} THEN m[array_to_string(w[1:{n}], ' ')] END" for n in range(licenses.LONGEST, 0, -1)) + ")"
    sql = rf"""WITH names AS (SELECT MAP({listed(licenses.NAMES)}, {listed(licenses.NAMES.values())}) AS m), t AS (SELECT row_number() OVER () AS no, doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT no, doc_id, t, '|' || regexp_replace({text}, '^[ |~]*|[ |~]*$', ' ', 'g') || '|' AS s, regexp_matches(t, '{quoted(licenses.HINT)}') AS hinted FROM t),
se AS (SELECT no, i, x FROM (SELECT no, unnest(string_split(s, '||')) AS x, generate_subscripts(string_split(s, '||'), 1) AS i FROM n WHERE hinted) WHERE regexp_matches(x, '{licenses.SAYS}')),
pa AS (SELECT no, i, string_split({canon}, '@') AS parts FROM se),
cl AS (SELECT no, i, j, parts[j + 1] AS c FROM (SELECT *, unnest(range(1, len(parts))) AS j FROM pa) WHERE NOT regexp_matches(' ' || parts[j], '{licenses.NEGATION}')),
it AS (SELECT no, i, j, unnest(regexp_split_to_array(c, '{licenses.CUT}')) AS p, generate_subscripts(regexp_split_to_array(c, '{licenses.CUT}'), 1) AS k FROM cl),
lo AS (SELECT no, i, j, k, p, {longest} AS f FROM (SELECT *, string_split(trim(regexp_replace({bare}, ' +', ' ', 'g')), ' ') AS w FROM it), names),
rf AS (SELECT no, i, min(j * 1000 + k) AS ord, name FROM (SELECT *, CASE WHEN f[1] = '*' THEN f[2:] || CASE WHEN contains(p, 'orlater') THEN '-or-later' ELSE '-only' END WHEN f[1] <> '?' THEN f WHEN contains(p || ' ', 'lic ') THEN f[2:] END AS name FROM lo WHERE f IS NOT NULL) WHERE name IS NOT NULL GROUP BY no, i, name),
refs AS (SELECT no, list('ref:' || name ORDER BY i, ord) AS r FROM rf GROUP BY no),
q AS (SELECT doc_id, list_concat(CASE WHEN hinted THEN list_transform(regexp_extract_all(s, '{every}', 0), lambda x: CASE {case} END) ELSE [] END, coalesce(r, [])) AS ids, CASE WHEN hinted THEN regexp_extract_all(lower(t), '{quoted(licenses.EXPRESSION)}', 1) ELSE [] END AS named FROM n LEFT JOIN refs USING (no)),
own AS (SELECT doc_id, ids, ' ' || array_to_string(ids, ' ') || ' ' AS seq, list_distinct(list_concat(list_transform(list_filter(ids, lambda x: starts_with(x, 'ref:')), lambda x: x[5:]), CASE WHEN len(ids) > 0 THEN list_filter([{", ".join(f"CASE WHEN regexp_matches(array_to_string(named, ' '), '{licenses.expression_name(x)}') THEN '{x}' END" for x in licenses.ORDER)}], lambda x: x IS NOT NULL) ELSE [] END)) AS own FROM q),
r0 AS (SELECT doc_id, ids, seq, own, own AS got FROM own)"""
    for i, (name, parts, shut) in enumerate(licenses.RULES):
        hit = f"regexp_matches(seq, '{licenses.sequence(parts)}')"
        barred = " AND len(list_distinct(ids)) <= 1" if "*" in shut else "".join(f" AND NOT list_contains(got, '{s}')" for s in shut)
        sql += f",\nr{i + 1} AS (SELECT doc_id, ids, seq, own, CASE WHEN {hit} AND NOT list_contains(got, '{name}'){barred} THEN list_append(got, '{name}') ELSE got END AS got FROM r{i})"
    kept = f"list_filter({listed(licenses.ORDER)}, lambda n: list_contains(got, n) AND NOT (suffix(n, '-only') AND list_contains(own, regexp_replace(n, '-only$', '-or-later')) AND NOT list_contains(own, n)))"
    return sql + f"\nSELECT doc_id, CAST(len(ids) AS BIGINT) AS n_license_sentences, array_to_string(ids, ' ') AS sentence_ids, array_to_string({kept}, ',') AS licenses FROM r{len(licenses.RULES)}"


LICENSES = _licenses()


def _quality() -> str:
    grid = ", ".join(f"('{f}', {i}, {c}::DOUBLE)" for f, g in quality.GRID.items() for i, c in enumerate(g))
    n_features = len(quality.GRID)
    values = " UNION ALL ".join(f"SELECT doc_id, stratum, '{f}' AS feature, {f} AS v FROM f" for f in quality.GRID)
    p = quality.ALPHA / n_features
    return rf"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
win AS (SELECT doc_id, a, array_to_string(list_slice(w, a, a + 2), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS a FROM d WHERE len(w) >= 3)),
rep AS (SELECT doc_id, a FROM (SELECT doc_id, a, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(range(a, a + 3)) AS x FROM rep) GROUP BY 1),
b AS (SELECT d.doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '{_BLANK}+', '', 'g')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, len(ls) AS n_lines, len(regexp_extract_all(text, '[A-Z]')) AS n_upper, coalesce(cov.n, 0) AS n_repeat_words FROM d LEFT JOIN cov USING (doc_id)),
f AS (SELECT *, n_symbols / greatest(1, word_chars)::DOUBLE AS symbol_share, n_dup_lines / greatest(1, n_lines)::DOUBLE AS dup_line_share, n_repeat_words / greatest(1, n_words)::DOUBLE AS repeat_share, n_upper / greatest(1, word_chars)::DOUBLE AS upper_share FROM b),
good AS (SELECT doc_id FROM labels GROUP BY 1 HAVING max(quality) = 1), v AS ({values}), gr(feature, i, c) AS (VALUES {grid}),
t AS (SELECT stratum, feature, i, c, count(*) AS n, count(*) FILTER (WHERE v > c) AS k FROM v JOIN good USING (doc_id) JOIN gr USING (feature) GROUP BY 1, 2, 3, 4),
q AS (SELECT *, k < n * {p!r} AND list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({p!r}) + (n - j) * ln(1 - {p!r})))) <= {quality.DELTA!r} / ((SELECT count(DISTINCT stratum) FROM t) * {n_features}) AS ok FROM t),
z AS (SELECT stratum, feature, min(i) FILTER (WHERE NOT ok) AS bad FROM q GROUP BY 1, 2),
cut AS (SELECT stratum, feature, min(c) AS c FROM q JOIN z USING (stratum, feature) WHERE bad IS NULL OR i < bad GROUP BY 1, 2),
hit AS (SELECT DISTINCT doc_id FROM v JOIN cut USING (stratum, feature) WHERE v.v > cut.c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AS base_failed, NOT (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AND hit.doc_id IS NULL AS kept FROM b LEFT JOIN hit USING (doc_id)"""


QUALITY = _quality()
