"""DuckDB SQL for the operators that SQL can express, written apart from the Spark code."""

LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOW}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT w.doc_id, count(s) AS n FROM w LEFT JOIN sh USING (doc_id) GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach(v, r) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.b, reach.r FROM reach JOIN e ON e.a = reach.v AND reach.r < e.b)
SELECT n.doc_id, n.n AS n_shingles, m.r AS component_id
FROM n JOIN (SELECT v, min(r) AS r FROM reach GROUP BY 1) m ON m.v = n.doc_id"""

# reach() walks upwards from each id only over larger ids than its own, and so still reaches, from the
# smallest id of a component, every member of it: all of them are larger.

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(w), 13) AS k,
  unnest(list_transform(range(1, len(w) - least(len(w), 13) + 2), lambda p: array_to_string(w[p:p + least(len(w), 13) - 1], ' '))) AS g
  FROM i WHERE len(w) > 0),
p AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS p, w FROM d, (SELECT DISTINCT k FROM g) WHERE len(w) >= k),
o AS (SELECT p.doc_id, p.p, p.k, g.item_id FROM (SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS g FROM p) p JOIN g USING (k, g)),
h AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS spot FROM o) GROUP BY 1),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS items FROM o GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(d.w), false) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""

URLS = """
WITH u AS (SELECT page_id,
  CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE NULL END AS rest FROM pages),
h AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) t(rh, rp, v)),
f AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v
  FROM h JOIN r ON (host = rh OR host LIKE '%.' || rh) AND starts_with(path, rp) GROUP BY 1)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM h LEFT JOIN f USING (page_id)"""

_HEX = "(instr('0123456789abcdef', substr(x, 5 * i + {k}, 1)) - 1)"
_VALUE = " + ".join(f"{_HEX.format(k=k)} * {16 ** (5 - k)}" for k in range(1, 6))
_FOUR = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({_VALUE}) // {32 ** k}) % 32 + 1, 1)" for k in (3, 2, 1, 0))

WARC = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS x FROM p),
m AS (SELECT x, payload_bytes, min(page_id) AS first FROM d GROUP BY 1, 2)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 8), lambda i: {_FOUR}), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d JOIN m USING (x, payload_bytes)"""

_KEYS = "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
_MID = "[\"'']?\\x20*[:=]\\x20*[\"'']?"
_KINDS = (
    ("assign", 0, f"{_KEYS}{_MID}[A-Za-z0-9+/_.=-]+", f"length(regexp_extract(m, '{_KEYS}{_MID}([A-Za-z0-9+/_.=-]+)', 1)) >= 8"),
    ("access", 1, "AKIA[A-Z0-9]+", "length(m) >= 16"),
    ("hex", 2, "[0-9a-f]+", "length(m) >= 32"),
)
_FOUND = " UNION ALL ".join(
    f"""SELECT doc_id, '{kind}' AS kind, {place} AS place, m, b FROM (
  SELECT doc_id, unnest(ms) AS m, unnest(list_transform(range(1, len(ms) + 1),
    lambda i: list_sum(list_transform(ps[1:i], lambda q: length(q))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda q: length(q))), 0)))::BIGINT AS b
  FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS ms, regexp_split_to_array(t, '{pattern}') AS ps FROM d)) WHERE {keep}"""
    for kind, place, pattern, keep in _KINDS
)

SECRETS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({_FOUND}),
s AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS c, count(*) FILTER (kind = 'hex') AS h,
  string_agg(kind || ':' || b || ':' || (b + length(m)), ',' ORDER BY b, place) AS spans FROM f GROUP BY 1)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN s USING (doc_id)"""

#: Unsigned crc32 of a string of ASCII characters; eight shifts a character.
_CRC32 = """xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length({s}) + 1), lambda i: ascii(substr({s}, i, 1))::BIGINT)),
  lambda a, x: list_reduce(list_prepend(xor(a, x), range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)), 4294967295)"""


def _merkle() -> str:
    """Trees level by level: m are nodes, r runs of eight, p the ways up from each leaf."""
    fields = lambda text: " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text))
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = _CRC32.format(s="doc_id::VARCHAR")
    out = [
        f"d AS MATERIALIZED (SELECT doc_id, coalesce('=' || lang, '-') AS t, sha256({fields('text')}) AS h, "
        f"CASE WHEN {crc} % 3 = 0 THEN sha256({fields(low)}) ELSE sha256({fields('text')}) END AS f FROM documents)",
        "m0 AS MATERIALIZED (SELECT doc_id, t, row_number() OVER (PARTITION BY t ORDER BY doc_id) - 1 AS j, h, f FROM d)",
        "p0 AS MATERIALIZED (SELECT doc_id, t, j, h, h AS u, f, '' AS proof FROM m0)",
    ]

    def levels(m: str, r: str, p: str, n: int) -> None:
        for k in range(n):
            out.append(
                f"{r}{k} AS MATERIALIZED (SELECT t, j // 8 AS j, string_agg(h, '' ORDER BY j) AS run, sha256(string_agg(h, '' ORDER BY j)) AS h "
                f"FROM {m}{k} WHERE t IN (SELECT t FROM {m}{k} GROUP BY t HAVING count(*) > 1) GROUP BY t, j // 8)"
            )
            out.append(f"{m}{k + 1} AS MATERIALIZED (SELECT t, j, h FROM {r}{k})")
            left, right = "substr(run, 1, 64 * (p.j % 8))", "substr(run, 64 * (p.j % 8) + 65)"
            fold = lambda x: f"CASE WHEN run IS NULL THEN p.{x} ELSE sha256({left} || p.{x} || {right}) END AS {x}"
            out.append(
                f"{p}{k + 1} AS MATERIALIZED (SELECT p.* EXCLUDE (j, u, f, proof), p.j // 8 AS j, {fold('u')}, {fold('f')}, "
                f"proof || coalesce({left} || {right}, '') AS proof FROM {p}{k} p LEFT JOIN {r}{k} r ON r.t = p.t AND r.j = p.j // 8)"
            )

    levels("m", "r", "p", 9)
    alone = " UNION ALL ".join(f"SELECT t, h FROM m{k} WHERE t IN (SELECT t FROM m{k} GROUP BY t HAVING count(*) = 1)" for k in range(10))
    out.append(f"v AS MATERIALIZED (SELECT t, h, row_number() OVER (ORDER BY t) - 1 AS j FROM ({alone}))")
    out.append("n0 AS MATERIALIZED (SELECT '' AS t, j, h FROM v)")
    out.append("q0 AS MATERIALIZED (SELECT p.doc_id, p.h, '' AS t, v.j, p.u AS subroot, p.u, p.f, p.proof FROM p9 p JOIN v USING (t))")
    levels("n", "s", "q", 3)
    return (
        "WITH " + ",\n".join(out) + "\nSELECT doc_id, h AS leaf, subroot, u AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = u AS verified FROM q3"
    )


ORACLES = {
    "op11_merkle_manifest": _merkle(),
    "op1_ngram_jaccard_join": JACCARD,
    "op2_benchmark_decontamination": DECONTAMINATION,
    "op6_url_filters": URLS,
    "op7_warc": WARC,
    "op8_secret_scans": SECRETS,
}
