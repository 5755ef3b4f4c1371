"""DuckDB SQL for the op queries whose rows SQL can express."""

UP, LO = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
W = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP7 = f"""
    WITH lowered_items AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{UP}', '{LO}'), '{W}') AS w FROM benchmark),
    item_windows AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS span
        FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM lowered_items WHERE len(w) > 0)),
    docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UP}', '{LO}'), '{W}') AS w FROM documents),
    places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM item_windows) WHERE len(w) >= n),
    doc_windows AS (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS span FROM places),
    hits AS (SELECT DISTINCT d.doc_id, d.i, d.n, d.span FROM doc_windows d JOIN (SELECT DISTINCT n, span FROM item_windows) x USING (n, span)),
    covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
    named AS (SELECT doc_id, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS items_sha256 FROM hits JOIN item_windows USING (n, span) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM docs d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)"""
OP4 = f"""
    WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UP}', '{LO}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    shingles AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + least(len(w), 3) - 1), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 3) + 2)) AS i FROM docs WHERE len(w) > 0)),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
    links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
    both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach AS (SELECT a AS doc_id, a AS other FROM both_ways UNION SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON r.other = e.a),
    least_ones AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, coalesce(component_id, d.doc_id) = d.doc_id AS kept
    FROM docs d LEFT JOIN sizes USING (doc_id) LEFT JOIN least_ones USING (doc_id)"""

OP9 = """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
    f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
    FROM f"""

SPACES = r"\x20\x09-\x0D"
#: Costs are lists over the states nothing, after system, after user, after assistant; f is the fault.
OP12 = f"""
    WITH RECURSIVE given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
    checked AS (SELECT *, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(range(1, strlen(k) + 1), lambda i: [CAST(ascii(substr(k, CAST(i AS INTEGER), 1)) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
        lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1)))) % 20 AS d FROM given),
    damaged AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS copy FROM checked WHERE d <> 0),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM damaged),
    seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, left(role, 1) AS r0, regexp_extract(text, '([^{SPACES}])[{SPACES}]*$', 1) AS z, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS p0 FROM placed),
    turns AS (SELECT *, CASE WHEN z = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN z NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS f FROM seen),
    ends AS (SELECT every AS conv_id, count(i) AS n FROM (SELECT DISTINCT conv_id AS every FROM conversations) LEFT JOIN turns ON turns.conv_id IS NOT DISTINCT FROM every GROUP BY every),
    costs AS (
        SELECT conv_id, n + 1 AS i, [0, 6, 3, 0] AS c, CAST(NULL AS INTEGER[]) AS r FROM ends
        UNION ALL
        SELECT conv_id, i, CASE WHEN f IN ('b', 'd') THEN a ELSE [least(a[1], least(a[3], a[4] + 3) + 3), least(a[2], least(a[3], a[4] + 3) + 3), least(a[3], a[4] + 3), least(a[4], a[3] + 3)] END, r
        FROM (SELECT t.conv_id, t.i, f, c AS r, CASE WHEN f IN ('b', 'd') THEN list_transform(c, lambda x: x + 4) ELSE [
                least(c[1] + 4, c[3] + 3 + g, CASE r0 WHEN 's' THEN c[2] + g WHEN 'u' THEN c[3] + g END), least(c[2] + 4, c[3] + 3 + g, CASE r0 WHEN 'u' THEN c[3] + g END),
                least(c[3] + 4, c[4] + 3 + g, CASE r0 WHEN 'a' THEN c[4] + g END), least(c[4] + 4, c[3] + 3 + g, CASE r0 WHEN 'u' THEN c[3] + g END)] END AS a
            FROM costs JOIN (SELECT *, CASE WHEN f = 't' THEN 3 ELSE 0 END AS g FROM turns) t ON t.conv_id IS NOT DISTINCT FROM costs.conv_id AND t.i = costs.i - 1)),
    steps AS (SELECT costs.conv_id, costs.i, c, r, coalesce(role, '') AS role, coalesce(r0, '') AS r0, coalesce(text, '') AS text, coalesce(f, '') AS f FROM costs LEFT JOIN turns ON turns.conv_id IS NOT DISTINCT FROM costs.conv_id AND turns.i = costs.i),
    walk AS (
        SELECT conv_id, 1 AS i, 1 AS s, '' AS audit, CAST([] AS VARCHAR[]) AS said FROM ends
        UNION ALL
        SELECT conv_id, CASE WHEN e = 'I' THEN i ELSE i + 1 END, CASE e WHEN 'D' THEN s WHEN 'K' THEN CASE r0 WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END ELSE m END, audit || e,
            CASE e WHEN 'D' THEN said WHEN 'K' THEN list_append(said, role || ':' || text) ELSE list_append(said, CASE m WHEN 3 THEN 'user:' ELSE 'assistant:' END || CASE e WHEN 'R' THEN text ELSE '' END) END
        FROM (SELECT *, CASE WHEN r IS NULL THEN 'I' WHEN c[s] = r[s] + 4 THEN 'D' WHEN c[s] = c[m] + 3 THEN 'I'
                WHEN c[s] = CASE WHEN f = 't' THEN 3 ELSE 0 END + CASE WHEN r0 = 's' AND s = 1 THEN r[2] WHEN r0 = 'u' AND s <> 3 THEN r[3] WHEN r0 = 'a' AND s = 3 THEN r[4] END THEN 'K' ELSE 'R' END AS e
            FROM (SELECT w.conv_id, w.i, s, audit, said, CASE WHEN s = 3 THEN 4 ELSE 3 END AS m, c, r, role, r0, text, f FROM walk w JOIN steps ON steps.conv_id IS NOT DISTINCT FROM w.conv_id AND steps.i = w.i WHERE r IS NOT NULL OR s IN (2, 3)))),
    walked AS (SELECT w.conv_id, audit, sha256(array_to_string(said, chr(10))) AS repaired_sha256 FROM walk w JOIN ends ON ends.conv_id IS NOT DISTINCT FROM w.conv_id WHERE i = n + 1 AND s IN (1, 4)
        QUALIFY row_number() OVER (PARTITION BY w.conv_id ORDER BY length(audit) DESC) = 1),
    counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate, count(*) FILTER (f = 't') AS truncated,
        count(*) FILTER (p0 IS NOT NULL AND p0 || r0 NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY conv_id)
    SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(c[1] AS BIGINT) AS cost, audit, repaired_sha256
    FROM ends e LEFT JOIN counted ON counted.conv_id IS NOT DISTINCT FROM e.conv_id JOIN costs ON costs.conv_id IS NOT DISTINCT FROM e.conv_id AND costs.i = 1 JOIN walked ON walked.conv_id IS NOT DISTINCT FROM e.conv_id"""


def _rounds(n: int) -> str:
    """The assignments and codebooks of op13, one after another; each round's distances are whole numbers in doubles."""
    found = ""
    for k in range(n + 1):
        found += f""",
    near{k} AS (SELECT row_id, p, min(d * 256 + e) AS best FROM (SELECT row_id, p, e, list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS d FROM parts JOIN book{k} USING (p)) GROUP BY row_id, p)"""
        if k < n:
            found += f""",
    mean{k} AS (SELECT p, e, list(m ORDER BY j) AS m FROM (SELECT p, e, j, floor(sum(v) / count(*)) AS m FROM (SELECT p, CAST(best AS BIGINT) % 256 AS e, unnest(x) AS v, generate_subscripts(x, 1) AS j FROM near{k} JOIN parts USING (row_id, p)) GROUP BY p, e, j) GROUP BY p, e),
    book{k + 1} AS (SELECT p, e, coalesce(m, c) AS c FROM book{k} LEFT JOIN mean{k} USING (p, e))"""
    return found


OP13 = f"""
    WITH kept AS (SELECT row_number() OVER () AS row_id, vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    parts AS (SELECT row_id, vec_id, CAST(p AS INTEGER) AS p, list_slice(v, p * (len(v) // 4) + 1, (p + 1) * (len(v) // 4)) AS x FROM kept, (SELECT unnest(range(4)) AS p)),
    book0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 256)){_rounds(4)},
    coded AS (SELECT row_id, string_agg(printf('%02x', CAST(best AS BIGINT) % 256), '' ORDER BY p) AS code, CAST(sum(CAST(best AS BIGINT) // 256) AS BIGINT) AS error FROM near4 GROUP BY row_id),
    told AS (SELECT sha256(string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM (SELECT p, e, unnest(c) AS v, generate_subscripts(c, 1) AS j FROM book4))
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN coded USING (row_id), told"""


def _places(words: str) -> str:
    """Where these words stand one after another in ``w``, from 0."""
    parts = words.split()
    return f"list_filter(range(0, len(w) - {len(parts) - 1}), lambda i: list_slice(w, i + 1, i + {len(parts)}) = {parts})"


LICENSE_BASE = f"""
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UP}', '{LO}'), '{W}') AS w FROM documents),
    p AS (SELECT doc_id, len(w) AS n_words, {_places('under the mit license')} AS m, {_places('apache license version 2')} AS a, {_places('cc by nc')} AS c FROM d)
    SELECT doc_id, n_words, len(m) + len(a) + len(c) AS n_base, list_min(list_concat(m, a, c)) AS first_word, list_max(list_concat(m, a, c)) AS last_word,
        array_to_string(list_filter([CASE WHEN len(a) > 0 THEN 'apache-2' END, CASE WHEN len(c) > 0 THEN 'cc-by-nc' END, CASE WHEN len(m) > 0 THEN 'mit' END], lambda x: x IS NOT NULL), ',') AS base_labels FROM p"""
URL_RULES = f"""
    WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UP}', '{LO}') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages)
    SELECT page_id, host, path, CASE WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1' WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
        WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/' WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/' WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM p"""
EDITED = """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id NULLS FIRST, text) AS i FROM documents),
    n AS (SELECT d.doc_id, d.text, length(d.text) AS n, f.text AS following FROM d JOIN d f ON f.i = CASE WHEN d.i = (SELECT max(i) FROM d) THEN 1 ELSE d.i + 1 END)
    SELECT doc_id, n AS n_chars, sha256(left(text, n - n // 4) || left(following, n // 4)) AS edited_sha256 FROM n"""
