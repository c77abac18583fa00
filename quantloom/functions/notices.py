"""Labels of regulators' and exchanges' notices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import first_match

# The words of each label; the first label counts of which a text has a word.
REGULATION = (
    ("enforcement", "enforcement|fine|penalty|sue|charged"),
    ("etf_decision", "etf|fund approval|spot etf"),
    ("legislation", "bill|legislation|law|act"),
    ("guidance", "guidance|framework|proposal|rule"),
    ("license", "license|registration|permit"),
)
SEVERITY = (("high", "ban|criminal|fraud|shutdown|emergency|systemic"), ("medium", "fine|enforcement|restriction|delay|reject"))
JURISDICTIONS = (
    ("US", "sec|cftc|us |united states|american"), ("EU", "eu |europe|mica|esma"), ("CN", "china|pboc|chinese"),
    ("UK", "uk |fca|britain"), ("JP", "japan|jfsa"), ("KR", "korea|fsc"),
)
ANNOUNCEMENTS = (("listing", "list|trading|new|launch|add"), ("delisting", "delist|remov|suspend"), ("maintenance", "maintenance|upgrade|wallet"))
NAMES = {"BITCOIN": "BTC", "ETHEREUM": "ETH", "SOLANA": "SOL", "RIPPLE": "XRP"}
NOT_TOKENS = ("THE", "AND", "FOR", "NEW", "ALL", "NOW", "USD", "API", "APP")
CODES = ("BTC", "ETH", "SOL", "XRP", "BNB", "DOGE", "ADA", "AVAX", "LINK", "DOT")


def whole(title: Column, body: Column) -> Column:
    """Title and body as one text; what is null is empty."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(body, F.lit("")))


def regulation(text: str) -> dict[str, str]:
    """Labels of lower-cased text, as SQL: what kind of event it is, how severe and where."""
    return {
        "event_type": first_match(text, REGULATION, "general"), "severity": first_match(text, SEVERITY, "low"), "jurisdiction": first_match(text, JURISDICTIONS, "global"),
    }


def affected_assets(text: Column, codes: tuple[str, ...] = CODES) -> Column:
    """Codes that upper-cased text has, in their order, and then those whose names it has, each once, joined by commas."""
    by_code = [F.when(F.contains(text, F.lit(c)), F.lit(c)) for c in codes]
    by_name = [F.when(F.contains(text, F.lit(n)), F.lit(c)) for n, c in NAMES.items()]
    return F.array_join(F.array_distinct(F.array_compact(F.array(*by_code, *by_name))), ",")


def announcement(title: str) -> dict[str, str]:
    """Category and severity of a lower-cased title, as SQL."""
    category = first_match(title, ANNOUNCEMENTS, "other")
    return {"category": category, "severity": f"CASE {category} WHEN 'other' THEN 'low' WHEN 'maintenance' THEN 'medium' ELSE 'high' END"}


def tokens(title: Column) -> Column:
    """Words of two to ten capital letters, as they stand, without some that are no names."""
    words = F.regexp_extract_all(title, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.filter(words, lambda w: w.rlike("^[A-Z]{2,10}$") & ~w.isin(*NOT_TOKENS))
