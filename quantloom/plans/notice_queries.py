"""Labels of notices over whole texts: the first line as title, the rest as body."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import notices
from ..sources.adapters import load

_HAS = "regexp_matches({}, '{}')".format
_RULES = {
    "event_type": (("enforcement", "enforcement|fine|penalty|sue|charged"), ("etf_decision", "etf|fund approval"), ("legislation", "bill|legislation|law|act"), ("guidance", "guidance|framework|proposal|rule"), ("license", "license|registration|permit")),
    "severity": (("high", "ban|criminal|fraud|shutdown|emergency|systemic"), ("medium", "fine|enforcement|restriction|delay|reject")),
    "jurisdiction": (("US", "sec|cftc|us |united states|american"), ("EU", "eu |europe|mica|esma"), ("CN", "china|pboc|chinese"), ("UK", "uk |fca|britain"), ("JP", "japan|jfsa"), ("KR", "korea|fsc")),
}
_LAST = {"event_type": "general", "severity": "low", "jurisdiction": "global"}
_LABELS = ", ".join(f"CASE {' '.join('WHEN ' + _HAS('t', words) + f' THEN {name!r}' for name, words in rules)} ELSE '{_LAST[x]}' END AS {x}" for x, rules in _RULES.items())
_CODES = "BTC ETH SOL XRP BNB DOGE ADA AVAX LINK DOT".split()
_NAMES = {"BITCOIN": "BTC", "ETHEREUM": "ETH", "SOLANA": "SOL", "RIPPLE": "XRP"}


def register(query) -> None:
    @query(f"""SELECT doc_id, {_LABELS}, array_to_string(list_filter([{', '.join(f"CASE WHEN strpos(u, '{c}') > 0 THEN '{c}' END" for c in _CODES)},
 {', '.join(f"CASE WHEN strpos(u, '{n}') > 0 AND strpos(u, '{c}') = 0 THEN '{c}' END" for n, c in _NAMES.items())}], lambda x: x IS NOT NULL), ',') AS affected_assets
 FROM (SELECT doc_id, lower(string_split(x, chr(10))[1] || ' ' || CASE WHEN strpos(x, chr(10)) > 0 THEN substr(x, strpos(x, chr(10)) + 1) ELSE '' END) AS t, upper(x) AS u FROM (SELECT doc_id, coalesce(text, '') AS x FROM documents))""")
    def regulation_labels(spark, d):
        docs = load(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("x"))
        title, cut = F.substring_index("x", "\n", 1), F.instr("x", "\n")
        body = F.when(cut > 0, F.substring("x", cut + 1, F.length("x"))).otherwise("")
        t = docs.select("doc_id", notices.whole(title, body).alias("whole")).select("doc_id", F.lower("whole").alias("t"), F.upper("whole").alias("u"))
        labels = [F.expr(sql).alias(name) for name, sql in notices.regulation("t").items()]
        return t.select("doc_id", *labels, notices.affected_assets(F.col("u")).alias("affected_assets"))

    @query(rf"""SELECT doc_id, category, CASE category WHEN 'other' THEN 'low' WHEN 'maintenance' THEN 'medium' ELSE 'high' END AS severity, tokens FROM (SELECT doc_id, CASE WHEN {_HAS('lower(t)', 'list|trading|new|launch|add')} THEN 'listing' WHEN {_HAS('lower(t)', 'delist|remov|suspend')} THEN 'delisting'
 WHEN {_HAS('lower(t)', 'maintenance|upgrade|wallet')} THEN 'maintenance' ELSE 'other' END AS category, array_to_string(list_filter(regexp_extract_all(t, '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Z]{{2,10}}') AND w NOT IN ('THE', 'AND', 'FOR', 'NEW', 'ALL', 'NOW', 'USD', 'API', 'APP')), ',') AS tokens
 FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10))[1] AS t FROM documents))""")
    def announcement_labels(spark, d):
        title = F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)
        t = load(spark, d, "documents").select("doc_id", title.alias("title"), F.lower(title).alias("t"))
        labels = [F.expr(sql).alias(name) for name, sql in notices.announcement("t").items()]
        return t.select("doc_id", *labels, F.array_join(notices.tokens(F.col("title")), ",").alias("tokens"))
