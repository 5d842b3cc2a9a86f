"""DuckDB SQL for the queries of this folder that SQL can express."""

from __future__ import annotations

from tidewatch.llm.chat import ChatTemplate
from tidewatch.llm.secrets import BASE_RULES, EXTRA_RULES

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _shingles(table: str, key: str, name: str) -> str:
    """(key, s): distinct five-word shingles of each text."""
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\\x20\\x09-\\x0D]+')"
    return f"""{name}_w AS (SELECT {key}, {words} AS w FROM {table}),
{name} AS (
  SELECT {key}, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END)) AS s FROM {name}_w
)"""


OP1 = f"""
WITH RECURSIVE {_shingles("documents", "doc_id", "sh")},
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON l.a = r.b),
low AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a),
sets AS (SELECT doc_id, list_sort(list(s)) AS l FROM sh GROUP BY doc_id),
sizes AS (SELECT doc_id, count(*) OVER (PARTITION BY l) AS class_size FROM sets)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(low.m, d.doc_id)) AS component_id,
  CAST(coalesce(z.class_size, 1) AS BIGINT) AS class_size, least(d.doc_id, coalesce(low.m, d.doc_id)) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN low USING (doc_id) LEFT JOIN sizes z USING (doc_id)"""

OP10 = f"""
WITH {_shingles("documents", "doc_id", "sh")}, {_shingles("benchmark", "item_id", "it")},
n AS (SELECT item_id, count(*) AS n_item FROM it GROUP BY item_id),
hits AS (SELECT doc_id, item_id, count(*) AS n_common FROM sh JOIN it USING (s) GROUP BY 1, 2)
SELECT doc_id, item_id, n_common, n_item FROM hits JOIN n USING (item_id) WHERE 100 * n_common >= 75 * n_item"""


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _secret_sql() -> str:
    """Positions from the gaps between matches and the matches' lengths."""
    steps, parts = [], []
    rules = BASE_RULES + EXTRA_RULES
    for i, r in enumerate(rules):
        q = _quote(r.regex)
        steps.append(
            f"""m{i} AS (SELECT doc_id, regexp_extract_all(t, {q}) AS hit, list_transform(string_split_regex(t, {q}), lambda x: length(x)) AS gap
  FROM docs WHERE regexp_matches(t, {q})),
s{i} AS (SELECT doc_id, unnest(range(1, len(hit) + 1)) AS k, hit, gap FROM m{i}),
k{i} AS (SELECT doc_id, {i} AS ord, {_quote(r.kind)} AS kind, hit[k] AS h,
  list_sum(gap[1:k]) + coalesce(list_sum(list_transform(hit[1:k-1], lambda x: length(x))), 0) AS a FROM s{i}),
f{i} AS (SELECT doc_id, ord, kind, CAST(a AS BIGINT) AS a, CAST(a + length(h) AS BIGINT) AS b FROM k{i}
  WHERE length({f"regexp_extract(h, {q}, {r.length_group})" if r.length_group else "h"}) >= {r.min_length})"""
        )
        parts.append(f"SELECT * FROM f{i}")
    nl = ",\n"
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{nl.join(steps)},
every AS ({" UNION ALL ".join(parts)}),
named AS (SELECT *, kind || ':' || a || ':' || b AS span FROM every),
sums AS (SELECT doc_id, count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access, count(*) FILTER (ord = 2) AS n_hex,
  string_agg(span, ',' ORDER BY a, ord) FILTER (ord < 3) AS base, string_agg(span, ',' ORDER BY a, ord) AS spans FROM named GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs d LEFT JOIN sums USING (doc_id)"""


def _chat_sql(t: ChatTemplate = ChatTemplate()) -> str:
    def escaped(col: str) -> str:
        out = f"replace({col}, '\\', '\\0;')"
        for i, c in enumerate(t.controls(), 1):
            out = f"replace({out}, {_quote(c)}, '\\{i};')"
        return out

    a, b = t.other_head
    heads = " ".join(f"WHEN role = '{n}' THEN {len(s.head)}" for n, s in t.roles.items())
    loss = ", ".join(_quote(n) for n, s in t.roles.items() if s.loss)
    moves = {(s, r) for s, to in t.moves.items() for r in to}
    ok = " OR ".join(f"(before = '{s}' AND role = '{r}')" for s, r in sorted(moves))
    return f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), ordered AS (
  SELECT *, row_number() OVER w AS k, coalesce(lag(role) OVER w, '{t.start}') AS before, lead(role) OVER w AS next FROM turns
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role IN ({loss})), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role IN ({loss})), '')) AS loss_sha256,
  CAST(sum(CASE {heads} ELSE {len(a) + len(b)} + length({escaped("role")}) END + length({escaped("text")}) + {len(t.tail)}) AS BIGINT) AS formatted_chars,
  bool_and({ok}) AND bool_or(next IS NULL AND role IN ({", ".join(map(_quote, t.accept))})) AS turn_order_ok
FROM ordered GROUP BY conv_id"""


_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

OP11 = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents),
tf AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM d) GROUP BY doc_id, t),
c AS (SELECT count(*) FILTER (len(w) > 0) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d),
m AS (SELECT doc_id, 100 - 50 + ((50 * len(w) * c.n) // c.l) AS m FROM d, c WHERE len(w) > 0),
it AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark),
wt AS (SELECT t, CAST(floor(1000 * ln((2 * c.n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, c GROUP BY t, c.n),
s AS (SELECT item_id, tf.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM it JOIN tf USING (t) JOIN wt USING (t) JOIN m USING (doc_id) GROUP BY item_id, tf.doc_id)
SELECT * FROM (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank,
  doc_id, score FROM s WHERE score > 0) WHERE rank <= 50"""

OP12 = """
WITH c AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS s
  FROM c a JOIN c b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM (SELECT a, b, s, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM s WHERE same) WHERE r <= 5),
n AS (SELECT p.a AS anchor_id, p.b AS positive_id,
    CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) AS INTEGER) AS rank,
    s.b AS negative_id, p.s AS positive_score, s.s AS negative_score
  FROM p JOIN s ON p.a = s.a AND NOT s.same AND 50 * p.s <= 100 * s.s AND 100 * s.s <= 95 * p.s)
SELECT * FROM n WHERE rank <= 3"""


ORACLE = {
    "op1_near_dedup": OP1,
    "op3_secret_scan": _secret_sql(),
    "op9_chat_format": _chat_sql(),
    "op10_decontaminate": OP10,
    "op11_ranked_search": OP11,
    "op12_hard_negatives": OP12,
}
