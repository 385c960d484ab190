"""DuckDB SQL for the rows of queries.py, where SQL can express them."""

WORD = r"[^\x20\x09-\x0D]+"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def quality(docs: str = "documents") -> str:
    """rules(): the sketches are exact in SQL too, as bins and counts are integers."""
    from .quality import FINDINGS, LEAST, SIZES, SPREAD

    value = "CASE WHEN b < 32 THEN b ELSE CAST(ceil(pow(2, 5 + (b - 32) // 8) * (1 + ((b - 32) % 8 + 1) / 8.0)) - 1 AS BIGINT) END"
    top = "pow(2, length(bin(x)) - 1)"
    fence = f"""SELECT {{k}} metric, max(size) size, min({value}) FILTER (upto * 4 >= size * 3) q3, min({value}) FILTER (upto * 4 >= size * 2) q2, min({value}) FILTER (upto * 4 >= size) q1
        FROM (SELECT *, sum(n) OVER (PARTITION BY {{k}} metric ORDER BY b) upto, sum(n) OVER (PARTITION BY {{k}} metric) size
              FROM (SELECT {{k}} metric, b, count(*) n FROM bins GROUP BY ALL)) GROUP BY {{k}} metric"""
    one = " ".join(f"WHEN '{m}' THEN ceil({f[1]} / greatest(max(q2) FILTER (metric = '{f[0]}') OVER w, 1.0))" for m, f in FINDINGS.items() if f)
    t = lambda f, k: f"SELECT *, q3 + {SPREAD} * greatest(q3 - q1, CASE metric {one} ELSE 1 END) t FROM {f} WINDOW w AS (PARTITION BY {k})"
    return rf"""
    WITH d AS MATERIALIZED (SELECT doc_id, lang, source, regexp_extract_all(coalesce(text, ''), '{WORD}') ws, coalesce(text, '') t FROM {docs}),
    w AS MATERIALIZED (SELECT doc_id, unnest(ws) w, generate_subscripts(ws, 1) i FROM d),
    g AS (SELECT doc_id, i, lead(w, 4) OVER o last, concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o) g FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) c FROM g WHERE last IS NOT NULL) WHERE c > 1),
    rep AS (SELECT doc_id, count(DISTINCT i + k) n FROM twice, range(5) r(k) GROUP BY doc_id),
    l AS (SELECT doc_id, count(*) n, count(DISTINCT x) u FROM (SELECT doc_id, unnest(string_split(t, chr(10))) x FROM d) WHERE regexp_matches(x, '{WORD}') GROUP BY doc_id),
    c AS MATERIALIZED (SELECT d.doc_id, lang, source, CAST(len(ws) AS BIGINT) n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) n_symbols, coalesce(l.n, 0) n_lines, coalesce(l.n - l.u, 0) n_dup_lines, coalesce(rep.n, 0) n_repeat_words
        FROM d LEFT JOIN l USING (doc_id) LEFT JOIN rep USING (doc_id)),
    m AS MATERIALIZED (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words base_failed, 1000 * n_symbols // greatest(word_chars, 1) symbol_permille,
        1000 * n_dup_lines // greatest(n_lines, 1) dup_line_permille, 1000 * n_repeat_words // greatest(n_words, 1) repeat_permille, 100 * word_chars // greatest(n_words, 1) word_len_percent FROM c),
    x AS (UNPIVOT (SELECT lang, source, {", ".join([*FINDINGS, *SIZES])} FROM m WHERE NOT base_failed) ON {", ".join([*FINDINGS, *SIZES])} INTO NAME metric VALUE x),
    bins AS MATERIALIZED (SELECT lang, source, metric, CASE WHEN x < 32 THEN x ELSE CAST(32 + (length(bin(x)) - 6) * 8 + floor((x - {top}) * 8 / {top}) AS BIGINT) END b FROM x),
    q1_ AS ({fence.format(k="lang, source,")}), q2_ AS ({fence.format(k="lang,")}), q3_ AS ({fence.format(k="")}),
    f1 AS ({t("q1_", "lang, source")}), f2 AS ({t("q2_", "lang")}), f3 AS ({t("q3_", "1")}),
    lim AS (SELECT g.lang, g.source, mm.metric, CASE WHEN f1.size >= {LEAST} THEN f1.t WHEN f2.size >= {LEAST} THEN f2.t ELSE f3.t END t
        FROM (SELECT DISTINCT lang, source FROM d) g CROSS JOIN (SELECT unnest({list(FINDINGS)}) metric) mm
        LEFT JOIN f1 ON g.lang IS NOT DISTINCT FROM f1.lang AND g.source IS NOT DISTINCT FROM f1.source AND mm.metric = f1.metric
        LEFT JOIN f2 ON g.lang IS NOT DISTINCT FROM f2.lang AND mm.metric = f2.metric LEFT JOIN f3 ON mm.metric = f3.metric),
    over_ AS (SELECT m.doc_id FROM m JOIN lim ON m.lang IS NOT DISTINCT FROM lim.lang AND m.source IS NOT DISTINCT FROM lim.source
        WHERE CASE lim.metric {" ".join(f"WHEN '{k}' THEN m.{k}" for k in FINDINGS)} END > lim.t)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM over_) kept FROM m"""


def near_duplicates(docs: str = "documents", size: int = 2, percent: int = 80) -> str:
    return rf"""
    WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{WORD}') ws FROM {docs}),
    s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= {size} THEN list_transform(range(1, len(ws) - {size - 2}), lambda i: array_to_string(ws[i:i + {size - 1}], ' '))
        WHEN len(ws) > 0 THEN ['= ' || array_to_string(ws, ' ')] ELSE [] END) g FROM d),
    n AS MATERIALIZED (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
    p AS (SELECT x.doc_id a, y.doc_id b, count(*) c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
    e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
    both_ AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
    r(a, b) AS (SELECT DISTINCT a, a FROM both_ UNION SELECT r.a, both_.b FROM r JOIN both_ ON r.b = both_.a),
    c AS (SELECT a doc_id, min(b) component_id FROM r GROUP BY a)
    SELECT d.doc_id, coalesce(n.n, 0) n_shingles, coalesce(component_id, d.doc_id) component_id, coalesce(component_id, d.doc_id) = d.doc_id kept
    FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""


def substrings(docs: str = "documents", window: int = 50) -> str:
    return rf"""
    WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') ws FROM {docs}),
    g AS MATERIALIZED (SELECT doc_id, i, sha256(array_to_string(ws[i:i + {window - 1}], ' ')) g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {window - 2})) i FROM d WHERE len(ws) >= {window})),
    f AS (SELECT g, min(doc_id) lo FROM g GROUP BY g),
    hit AS MATERIALIZED (SELECT DISTINCT doc_id, i + k i FROM g JOIN f USING (g), range({window}) r(k) WHERE doc_id > lo),
    w AS (SELECT doc_id, unnest(ws) w, generate_subscripts(ws, 1) i FROM d),
    k AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) t, count(*) n FROM w ANTI JOIN hit USING (doc_id, i) GROUP BY doc_id)
    SELECT doc_id, CAST(len(ws) AS BIGINT) n_words, len(ws) - coalesce(n, 0) n_removed, sha256(coalesce(t, '')) kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""


def decontaminate(docs: str = "documents", items: str = "benchmark", window: int = 10) -> str:
    words = f"regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return rf"""
    WITH d AS MATERIALIZED (SELECT doc_id, {words} ws FROM {docs}),
    b AS (SELECT item_id, {words} ws FROM {items}),
    bw AS MATERIALIZED (SELECT DISTINCT item_id, least(len(ws), {window}) m, array_to_string(ws[i:i + least(len(ws), {window}) - 1], ' ') g
        FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(len(ws), {window}) + 2)) i FROM b WHERE len(ws) > 0)),
    occ AS MATERIALIZED (SELECT doc_id, i, x.m, item_id FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) i FROM d, (SELECT DISTINCT m FROM bw) WHERE len(ws) >= m) x
        JOIN bw ON bw.m = x.m AND bw.g = array_to_string(ws[i:i + x.m - 1], ' ')),
    h AS (SELECT doc_id, count(DISTINCT i + k) n FROM (SELECT doc_id, i, unnest(range(m)) k FROM occ) GROUP BY doc_id),
    it AS (SELECT doc_id, count(*) n, string_agg(item_id, ',' ORDER BY item_id) s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) item_id FROM occ) GROUP BY doc_id)
    SELECT doc_id, CAST(len(ws) AS BIGINT) n_words, coalesce(h.n, 0) n_hit, coalesce(it.n, 0) n_items, sha256(coalesce(it.s, '')) items_sha256, coalesce(h.n, 0) > 0 contaminated
    FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)"""


def urls(rules: list[tuple[str, str, str]], pages: str = "pages", labels: str = "labels") -> str:
    from .urls import LIMIT, STRENGTHS, Z

    # of the public suffixes of two labels, those that the tables and tests have
    longer = ("co.uk", "com.au", "co.jp", "com.br")

    low, high = STRENGTHS
    case = " ".join(f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND path LIKE '{p}%' THEN '{h + p}'" for _, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2])))
    verdict = " ".join(f"WHEN '{h + p}' THEN '{v}'" for v, h, p in rules)
    last = lambda k: f"array_to_string(string_split(host, '.')[-{k}:], '.')"
    long = ", ".join(f"'{s}'" for s in longer)

    def level(name: str, above: str) -> str:
        join = f"JOIN {above}_p u ON u.{above} = c.{above}" if above else "CROSS JOIN (SELECT coalesce(sum(bad) / nullif(sum(n), 0), 0) mean FROM h) u"
        keys = {"suffix": "suffix", "domain": "domain, suffix", "host": "host, domain, suffix"}[name]
        return f"""{name}_c AS MATERIALIZED (SELECT c.*, u.mean m FROM (SELECT {keys}, sum(n) n, sum(bad) bad FROM h GROUP BY ALL) c {join}),
        {name}_a AS (SELECT CAST(sum(n) AS DOUBLE) a, CAST(sum(n * n) AS DOUBLE) sq, count(*) k, sum(n * (bad / n - m) * (bad / n - m)) s, sum(n * m * (1 - m)) / sum(n) pq FROM {name}_c WHERE n > 0),
        {name}_r AS (SELECT CASE WHEN pq > 0 AND a - sq / a - k + 1 > 0 THEN (s - pq * (k - 1)) / (pq * (a - sq / a - k + 1)) END r FROM {name}_a),
        {name}_s AS (SELECT coalesce(CASE WHEN r <= 1 / (1 + {high}) THEN {high} WHEN r >= 1 / (1 + {low}) THEN {low} ELSE (1 - r) / r END, {high}) st FROM {name}_r),
        {name}_p AS MATERIALIZED (SELECT *, a / (a + b) mean FROM (SELECT c.*, bad + m * st a, n - bad + (1 - m) * st b FROM {name}_c c CROSS JOIN {name}_s))"""

    return f"""
    WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END rest FROM {pages}),
    p AS (SELECT page_id, {LOWER.format("regexp_extract(rest, '^[^/?#]*')")} host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path FROM r),
    q AS MATERIALIZED (SELECT *, CASE WHEN {last(2)} IN ({long}) THEN {last(2)} ELSE {last(1)} END suffix, CASE WHEN {last(2)} IN ({long}) THEN {last(3)} ELSE {last(2)} END AS domain FROM p),
    o AS (SELECT doc_id, max(CAST(quality = 0 OR toxic = 1 AS INT)) bad FROM {labels} GROUP BY doc_id),
    h AS MATERIALIZED (SELECT host, domain, suffix, CAST(count(bad) AS DOUBLE) n, CAST(coalesce(sum(bad), 0) AS DOUBLE) bad FROM q LEFT JOIN o ON o.doc_id = q.page_id GROUP BY ALL),
    {level("suffix", "")}, {level("domain", "suffix")}, {level("host", "domain")},
    v AS (SELECT q.*, CASE {case} END AS rule, mean - {Z} * sqrt(mean * (1 - mean) / (a + b + 1)) bound FROM q JOIN (SELECT host AS hh, mean, a, b FROM host_p) x ON x.hh = q.host)
    SELECT page_id, host, path, rule, CASE rule {verdict} ELSE CASE WHEN bound > {LIMIT} THEN 'block' ELSE 'allow' END END verdict FROM v"""


def negatives() -> str:
    """Vectors of one length; sums of products below 2**53 are exact."""
    return """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
      FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id) QUALIFY row_number() OVER w <= 5"""


def chat() -> str:
    """Turns as they are formatted, for the lengths; digests from the texts as they are."""
    controls = r"(<)(\\*(?:/?s>|\|(?:image|audio|document)\|>))|(\[)(\\*/?(?:INST|SYS)\])"
    escaped = rf"regexp_replace({{}}, '{controls}', '\1\3\\\2\4', 'g')"
    role = escaped.format(r"replace(replace(role, '\', '\\'), chr(10), '\n')")
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, i, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(i, r)),
t AS (SELECT *, '<s>' || {role} || chr(10) || CASE role WHEN 'user' THEN '[INST] ' WHEN 'assistant' THEN '' ELSE '[SYS] ' END
      || {escaped.format("text")} || CASE role WHEN 'user' THEN ' [/INST]' WHEN 'assistant' THEN '' ELSE ' [/SYS]' END || '</s>' AS formed FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, formed)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, formed) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(formed)) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""
