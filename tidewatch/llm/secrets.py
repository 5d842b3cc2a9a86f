"""Secret scan with a trigram inverted index (built-in functions only).

1. Every rule's regular expression is turned into a Boolean query over
   trigrams that any match must contain (``trigram_query``: an OR of ANDs);
   a rule without mandatory trigrams has no query and scans every text.
2. ``build_index`` writes the postings (trigram, doc_id) of all trigrams the
   rules ask for, over whole lower-cased texts, as a table.
3. ``candidates`` intersects postings: a document is a candidate of a rule
   if it is in every posting list of one of the query's alternatives.
4. ``scan`` verifies candidates with the regular expression itself; the index
   only ever excludes texts that cannot match.

Defined results: a null text is empty; documents with a null or repeated
doc_id each give their own row (the index then unites their postings, which
only adds candidates); an empty table gives an empty result; other columns
are ignored. Spans are code points, end exclusive.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.regexspans import match_lengths, with_starts
from tidewatch.session import materialize

_MAX_SET = 64


@dataclass(frozen=True)
class Rule:
    """``min_length`` is on the group ``length_group`` of a match (0: all).

    ``regex`` is what a match must begin with; where the secret goes on beyond
    it, ``whole`` is the expression of the whole span."""

    kind: str
    regex: str
    min_length: int = 1
    length_group: int = 0
    whole: str = ""


#: Fixed by the contract of the base scan: kinds in their listed order.
BASE_RULES = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        6,
        2,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
)

_KEY_LABEL = r"[A-Z ]{0,40}PRIVATE KEY-----"
#: what parts the lines of a key: white space (also escaped), quotes and quoting marks
_KEY_GAP = r"""(?:[\s"'>|#*]|\\[nrt])"""
#: a base64 line shorter than others, with a line to itself
_KEY_SHORT = rf"""{_KEY_GAP}*?(?:\n|\\n){_KEY_GAP}*+[A-Za-z0-9+/=]++(?=["'\\]|[\x20\t\r]*+(?:\n|$))"""
#: Header, body and END line. Without an END line of its own (a cut key) the
#: base64 lines, and shorter ones between or right after them. Possessive
#: groups: the match neither backtracks nor recurses, however long the key.
_PRIVATE_KEY = (
    rf"-----BEGIN {_KEY_LABEL}(?:"
    rf"""(?:[A-Za-z0-9+/=\s:,\\"'>|#*]|-(?!----(?:BEGIN|END) ))*+-----END {_KEY_LABEL}"""
    rf"|(?:(?:{_KEY_SHORT})?{_KEY_GAP}*+(?:(?:Proc-Type|DEK-Info):\s?[A-Za-z0-9,-]++|[A-Za-z0-9+/=]{{20,}}+))*+"
    rf"(?:{_KEY_SHORT})?)"
)

#: Public token formats.
EXTRA_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"sk_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", whole=_PRIVATE_KEY),
    Rule(
        "url_login",
        r"[a-z][a-z0-9+.-]{1,20}://[^\x00-\x20/:@]{1,64}:[^\x00-\x20/:@]{1,64}@",
        whole=r"[a-z][a-z0-9+.-]{1,20}://[^\x00-\x20/:@]++:[^\x00-\x20@]++@",
    ),
)


# --- Boolean trigram queries -------------------------------------------------


def _literals(node) -> list[str] | None:
    """The strings one regex node can match, if they are few; None otherwise."""
    op, arg = str(node[0]), node[1]
    if op == "LITERAL":
        return [chr(arg).lower()]
    if op == "IN":
        out: set[str] = set()
        for kind, v in arg:
            if str(kind) == "LITERAL":
                out.add(chr(v).lower())
            elif str(kind) == "RANGE" and v[1] - v[0] < 10:
                out |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
            else:
                return None
        return sorted(out) if len(out) <= 5 else None
    if op in ("MAX_REPEAT", "MIN_REPEAT"):
        low, high, sub = arg
        one = _sequence_literals(sub)
        if one is None or int(high) > 5:
            return None
        out = [""] if low == 0 else []
        cur = [""]
        for k in range(1, int(high) + 1):
            cur = [a + b for a in cur for b in one]
            if k >= low:
                out += cur
        return out if len(out) <= _MAX_SET else None
    if op == "SUBPATTERN":
        return _sequence_literals(arg[-1])
    if op == "BRANCH":
        parts = [_sequence_literals(p) for p in arg[1]]
        return None if any(p is None for p in parts) else [s for p in parts for s in p]
    return None


def _sequence_literals(seq) -> list[str] | None:
    cur = [""]
    for node in seq:
        one = _literals(node)
        if one is None or len(cur) * len(one) > _MAX_SET:
            return None
        cur = [a + b for a in cur for b in one]
    return cur


def trigram_query(regex: str) -> list[frozenset[str]]:
    """OR over the list of ANDs of lower-case trigrams; empty: no mandatory
    trigram, the rule has to scan everything.

    A run of regex nodes with few possible strings is expanded; each of its
    strings demands all its trigrams. Runs are joined by AND.
    """
    tree = re._parser.parse(regex)
    runs: list[list[str]] = []
    cur = [""]

    def flush() -> None:
        nonlocal cur
        runs.append(cur)
        cur = [""]

    def walk(seq) -> None:
        nonlocal cur
        for node in seq:
            one = _literals(node)
            if one is None and str(node[0]) == "SUBPATTERN":
                walk(node[1][-1])
            elif one is None or len(cur) * len(one) > _MAX_SET:
                flush()
                if one is not None:
                    cur = one
            else:
                cur = [a + b for a in cur for b in one]

    walk(tree)
    flush()
    query = [frozenset()]
    for run in runs:
        need = [frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run]
        if all(need):
            query = [a | b for a in query for b in dict.fromkeys(need)]
    query = list(dict.fromkeys(query))
    if any(not q for q in query):
        return []
    return [q for q in query if not any(o < q for o in query)]  # a weaker alternative covers the stronger


# --- index -------------------------------------------------------------------


def build_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, doc_id) of the given lower-case trigrams."""
    low = docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("_low"))
    has = F.filter(
        F.array(*[F.when(F.contains(F.col("_low"), F.lit(t)), F.lit(t)) for t in sorted(trigrams)]),
        lambda t: t.isNotNull(),
    )
    return low.select("doc_id", F.explode(has).alias("trigram"))


def candidates(index: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """(doc_id, rules): rules with an alternative whose posting lists all hold
    the document. The query table has one row per rule, alternative and
    trigram: its size is fixed by the rules."""
    spark = index.sparkSession
    rows = [(k, i, t, len(q)) for k, alts in queries.items() for i, q in enumerate(alts) for t in sorted(q)]
    asked = spark.createDataFrame(rows, "rule string, alt int, trigram string, n_tri int")
    hits = (
        index.join(F.broadcast(asked), "trigram")
        .groupBy("doc_id", "rule", "alt", "n_tri")
        .agg(F.count_distinct("trigram").alias("_n"))
        .filter(F.col("_n") == F.col("n_tri"))
    )
    return hits.groupBy("doc_id").agg(F.collect_set("rule").alias("rules"))


# --- verification ------------------------------------------------------------


def _spans(matches: str, rule: Rule) -> Column:
    """Kept spans of a rule from its stored match column."""
    out = with_starts(F.col(matches))

    def keep(x: Column) -> Column:
        part = x["hit"] if rule.length_group == 0 else F.regexp_extract(x["hit"], rule.regex, rule.length_group)
        return F.length(part) >= rule.min_length

    return F.transform(
        F.filter(out, keep),
        lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")),
    )


def scan(
    docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + EXTRA_RULES, keep: tuple[str, ...] = ()
) -> DataFrame:
    """doc_id, the columns ``keep`` and ``spans``: array of (start, ord, kind,
    end) by start, then rule order; every row of ``docs`` gives one row."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.regex))}
    trigrams = sorted({t for alts in queries.values() for q in alts for t in q})
    index = materialize(build_index(docs, trigrams), "trigram-index")
    cand = candidates(index, queries).select(F.col("doc_id").alias("_cid"), F.col("rules").alias("_rules"))
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"), *[F.col(c).alias(f"_k_{c}") for c in keep])
    kept = [f"_k_{c}" for c in keep]
    both = own.join(cand, F.col("doc_id").eqNullSafe(F.col("_cid")), "left").drop("_cid")
    none = F.expr("cast(array() as array<struct<gap:int,hit:string,length:int>>)")
    cols = []
    for r in rules:
        asked = F.coalesce(F.array_contains("_rules", r.kind), F.lit(False)) if r.kind in queries else F.lit(True)
        # a cheap test first: most texts have no match
        quick = F.rlike(F.col("_text"), F.lit(_probe(r)))
        cols.append(F.when(asked & quick, match_lengths(F.col("_text"), _search(r))).otherwise(none).alias(f"_m_{r.kind}"))
    found = both.select("doc_id", *kept, *cols)
    no_span = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    located = found.select(
        "doc_id",
        *kept,
        *[F.when(F.size(f"_m_{r.kind}") > 0, _spans(f"_m_{r.kind}", r)).otherwise(no_span).alias(r.kind) for r in rules],
    )

    def tagged(i: int, kind: str) -> Column:
        return F.transform(
            kind,
            lambda s: F.struct(
                s["start"].alias("start"), F.lit(i).alias("ord"), F.lit(kind).alias("kind"), s["end"].alias("end")
            ),
        )

    every = [tagged(i, r.kind) for i, r in enumerate(rules)]
    return located.select(
        "doc_id", *[F.col(f"_k_{c}").alias(c) for c in keep], F.sort_array(F.concat(*every)).alias("spans")
    )


def _search(rule: Rule) -> str:
    """The expression whose matches are counted. A whole match of one
    character class keeps its length test inside the expression: a shorter
    run fails as a whole, so leftmost matches stay the same."""
    if rule.kind == "hex":
        return "[0-9a-f]{%d,}" % rule.min_length
    return rule.whole or rule.regex


def _probe(rule: Rule) -> str:
    return "[0-9a-f]{%d}" % rule.min_length if rule.kind == "hex" else _search(rule)


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_digest(scanned: DataFrame) -> DataFrame:
    """Base counts and digest beside all spans."""
    base = [r.kind for r in BASE_RULES]

    def n(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scanned.select(
        "doc_id",
        *[n(k) for k in base],
        F.sha2(span_text(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every span, overlapping ones united, replaced by ``mark``.

    ``spans`` must be a stored column sorted by start."""
    kind = "array<struct<start:int,end:int>>"

    def unite(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        own = F.struct(s["start"].alias("start"), s["end"].alias("end"))
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        over = last.isNotNull() & (s["start"] < last["end"])
        return F.when(over, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined))).otherwise(
            F.concat(acc, F.array(own))
        )

    united = F.aggregate(spans, F.expr(f"cast(array() as {kind})"), unite)

    def cut(all_spans: Column) -> Column:
        before = F.transform(
            all_spans,
            lambda s, i: F.concat(
                F.substr(
                    text,
                    F.when(i == 0, F.lit(0)).otherwise(F.get(all_spans, i - 1)["end"]) + 1,
                    s["start"] - F.when(i == 0, F.lit(0)).otherwise(F.get(all_spans, i - 1)["end"]),
                ),
                F.lit(mark),
            ),
        )
        tail = F.substr(text, F.element_at(all_spans, -1)["end"] + 1)
        return F.concat(F.array_join(before, ""), tail)

    return F.when(F.size(spans) == 0, text).otherwise(F.get(F.transform(F.array(united), cut), F.lit(0)))
