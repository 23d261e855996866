"""Fixed values of the keyword extraction: names, event kinds, themes and moods, as its rules define them."""

TICKERS = {
    "bitcoin": "BTC", "btc": "BTC", "ethereum": "ETH", "ether": "ETH", "eth": "ETH", "solana": "SOL", "sol": "SOL", "binance coin": "BNB", "bnb": "BNB", "ripple": "XRP", "xrp": "XRP",
    "dogecoin": "DOGE", "doge": "DOGE", "litecoin": "LTC", "ltc": "LTC", "chainlink": "LINK", "link": "LINK", "tron": "TRX", "trx": "TRX", "cardano": "ADA", "ada": "ADA",
}
EVENTS = {
    "hack": ["hack", "exploit", "stolen", "breach", "drained"], "delisting": ["delist", "remove", "suspend trading"], "listing": ["list", "lists", "listing", "debut"],
    "regulation": ["sec", "regulat", "lawsuit", "ban", "court", "subpoena", "settle"], "etf": ["etf", "exchange-traded fund", "spot etf"], "partnership": ["partner", "integration", "collaborat"],
    "unlock": ["token unlock", "vesting", "unlock"], "funding": ["raise", "funding round", "series a", "series b", "invest"], "macro": ["fed", "inflation", "cpi", "rate", "macro"],
}
THEMES = {
    "etf": ["etf"], "regulation": ["sec", "regulat", "lawsuit", "ban"], "defi": ["defi", "yield", "tvl", "liquidity pool"], "l2": ["layer 2", "l2", "rollup"],
    "ai": [" ai ", "artificial intelligence", "agent"], "meme": ["meme", "dogecoin", "shib"],
}
GOOD = ["surge", "rally", "approve", "bullish", "gain", "soar"]
BAD = ["hack", "ban", "lawsuit", "crash", "plunge", "bearish", "delist"]
RUMOUR = ["rumor", "reportedly", "sources say", "speculation", "alleged"]
#: Events that count as grave, and those of them that are risks.
SEVERE = ["hack", "delisting", "regulation", "etf"]
RISKS = ["hack", "delisting", "regulation"]
CREDIBILITY = 0.6
