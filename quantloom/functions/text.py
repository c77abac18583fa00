"""Labels of news texts: sentiment, event, scope, assets."""

from __future__ import annotations

import re

# Keywords and patterns of the labels.
BULLISH = "surge|soar|rally|bullish|breakout|all-time high|ath|approval|approved|adopt|adoption|partnership|launch|upgrade|milestone|record|institutional|inflow|accumulate|利好|突破|创新高|暴涨|通过|批准|合作|上线".split("|")
BEARISH = "crash|plunge|dump|bearish|hack|exploit|vulnerability|ban|banned|lawsuit|sec|fraud|bankrupt|insolvency|liquidat|outflow|sell-off|selloff|crackdown|sanction|利空|暴跌|黑客|攻击|禁止|诉讼|破产|清算".split("|")
EVENTS = (
    ("regulatory", "sec|regulat|compliance|ban|legal|lawsuit|sanction|cftc|crackdown|监管|合规|禁令", "long_term"),
    ("hack", "hack|exploit|breach|vulnerability|attack|stolen|drain|黑客|攻击|漏洞|盗", "short_term"),
    ("partnership", "partner|collaborat|integrat|alliance|合作|联盟|集成", "medium_term"),
    ("tokenomics", "burn|unlock|halving|supply|airdrop|staking|vesting|销毁|解锁|减半|空投", "medium_term"),
    ("technical", "upgrade|fork|mainnet|testnet|v2|layer|protocol|升级|主网|分叉", "medium_term"),
    ("macro", "fed|fomc|rate|inflation|gdp|cpi|treasury|yield|利率|通胀|美联储", "long_term"),
)
SCOPES = (("market_wide", "market|crypto market|btc|bitcoin|全市场|加密市场|整体"), ("sector_wide", "defi|nft|layer.?2|l2|meme|ai.?token|板块|赛道"))
ASSETS = {"bitcoin": "BTC", "btc": "BTC", "ethereum": "ETH", "eth": "ETH", "solana": "SOL", "sol": "SOL"}


def alternation(patterns: list[str]) -> str:
    """The patterns in their order, by first character: one look at a place tells whether any can
    begin there, and a second which, where a plain list is tried one by one at every place of a text.
    Patterns with different first characters exclude each other, so the first that matches stays the first."""
    by_first: dict[str, list[str]] = {}
    for x in patterns:
        by_first.setdefault(x[0], []).append(x[1:])
    return f"(?=[{''.join(by_first)}])(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by_first.items()) + ")"


def hits(text: str, words: list[str]) -> str:
    """Matches, leftmost alternative first, of lower-cased text."""
    return f"size(regexp_extract_all({text}, '{alternation(words)}', 0))"


def sentiment(up: str, down: str) -> str:
    return f"CASE WHEN {up} > {down} THEN 'bullish' WHEN {down} > {up} THEN 'bearish' ELSE 'neutral' END"


def confidence(up: str, down: str) -> str:
    return f"CASE WHEN {up} + {down} = 0 THEN 0.5D WHEN {up} = {down} THEN 0.4D ELSE least(0.6D + 0.1D * abs({up} - {down}), 0.95D) END"


def found(text: str, pattern: str) -> str:
    """Whether the text has any of the pattern's alternatives. Plain ones are looked for as they are, which a text's bytes
    can tell; only those with signs of a pattern need the regular expression engine."""
    plain = [x for x in pattern.split("|") if not re.search(r"[.?*+\[\](){}^$\\\\]", x)]
    rest = [x for x in pattern.split("|") if x not in plain]
    tests = [f"contains({text}, '{x}')" for x in plain] + ([f"{text} rlike '{alternation(rest)}'"] if rest else [])
    return "(" + " OR ".join(tests) + ")"


def first_match(text: str, rules, default: str) -> str:
    """The label of the first rule (label, pattern) that the text has."""
    return "CASE " + " ".join(f"WHEN {found(text, p)} THEN '{label}'" for label, p in rules) + f" ELSE '{default}' END"


def duration(event: str) -> str:
    return f"CASE {event} " + " ".join(f"WHEN '{name}' THEN '{lasts}'" for name, _, lasts in EVENTS) + " ELSE 'short_term' END"
