"""Default rule tables. Keyword lists, impact maps and transitions.

Every text operator takes its rules as an argument; these are the defaults. Event word lists
(keywords, positive and negative words per event type) are read from a rule file, see
`sources.readers.read_rules`.
"""

# Narrative keywords.
NARRATIVES = {
    "INFLATION_FEAR": ["inflation", "cpi", "price rise", "price surge", "fed hawkish", "rate hike", "hot inflation",
                       "inflationary", "pce", "sticky inflation", "rising prices", "stagflation"],
    "RATE_CUT_HOPE": ["rate cut", "fed pivot", "dovish", "easing", "lower rates", "fed pause", "rate reduction",
                      "rate relief", "fed cut", "fomc cut", "cutting rates", "rate cycle"],
    "RECESSION_FEAR": ["recession", "slowdown", "contraction", "gdp miss", "unemployment rising", "hard landing",
                       "economic downturn", "job losses", "gdp decline", "negative growth", "economic weakness"],
    "SOFT_LANDING": ["soft landing", "goldilocks", "resilient", "strong jobs", "gdp beat", "robust economy",
                     "economic resilience", "no recession", "healthy economy", "economy on track"],
    "GEOPOLITICAL_RISK": ["war", "conflict", "sanctions", "iran", "russia", "china taiwan", "geopolitical", "military",
                          "strike", "missile", "attack", "escalation", "ceasefire", "troops", "invasion", "tension",
                          "tariff", "trade war"],
    "DOLLAR_STRENGTH": ["dollar rally", "dxy", "strong dollar", "dollar index", "usd strength", "dollar surge",
                        "dollar gains", "king dollar", "dollar bull", "greenback", "dollar rises"],
    "GOLD_DEMAND": ["gold rally", "safe haven", "gold demand", "central bank buying", "gold record", "gold surge",
                    "gold hits", "bullion", "gold all-time", "gold price", "precious metals rise"],
    "OIL_SUPPLY": ["oil supply", "opec", "crude inventory", "oil production", "energy crisis", "wti", "brent", "oil cut",
                   "oil output", "petroleum", "energy supply", "oil stockpiles", "crude stocks"],
    "AI_EUPHORIA": ["ai", "artificial intelligence", "nvidia", "chatgpt", "ai revenue", "ai capex", "machine learning",
                    "generative ai", "ai spending", "ai boom", "data center", "ai infrastructure", "llm"],
    "CHINA_RISK": ["china slowdown", "china property", "china stimulus", "yuan", "pboc", "china growth",
                   "chinese economy", "beijing", "xi jinping", "china gdp", "evergrande", "china debt", "china deflation"],
    "INDIA_GROWTH": ["india gdp", "india growth", "modi", "rbi", "india economy", "nifty rally", "indian market",
                     "india stocks", "sensex", "india inflation", "india rate", "bse", "india manufacturing"],
    "FISCAL_STIMULUS": ["stimulus", "spending bill", "deficit", "fiscal", "government spending", "tax cut", "budget",
                        "infrastructure bill", "debt ceiling", "treasury", "fiscal policy", "spending package",
                        "federal spending"],
}

# Fixed values: +1 bullish, -1 bearish for (NIFTY, SP500, Gold, Silver, Crude); 0 neutral or mixed.
IMPACT_ASSETS = ("NIFTY", "SP500", "Gold", "Silver", "Crude")
NARRATIVE_IMPACT = {
    "INFLATION_FEAR": (-1, -1, 1, 1, 0),
    "RATE_CUT_HOPE": (1, 1, 1, 1, 0),
    "RECESSION_FEAR": (-1, -1, 1, -1, -1),
    "SOFT_LANDING": (1, 1, 0, 1, 1),
    "GEOPOLITICAL_RISK": (-1, -1, 1, 1, 1),
    "DOLLAR_STRENGTH": (-1, 0, -1, -1, -1),
    "GOLD_DEMAND": (0, 0, 1, 1, 0),
    "OIL_SUPPLY": (-1, 0, 0, 0, 1),
    "AI_EUPHORIA": (0, 1, -1, 0, 0),
    "CHINA_RISK": (-1, -1, 1, -1, -1),
    "INDIA_GROWTH": (1, 0, 0, 0, 1),
    "FISCAL_STIMULUS": (1, 1, 0, 0, 1),
}

# Status transitions that raise an alert.
ALERT_TRANSITIONS = [
    ("FADING", "EMERGING", "turned EMERGING"),
    ("FADING", "DOMINANT", "turned DOMINANT"),
    ("NEUTRAL", "DOMINANT", "turned DOMINANT"),
    ("ACTIVE", "DOMINANT", "turned DOMINANT"),
    ("DOMINANT", "FADING", "now FADING"),
    ("DOMINANT", "NEUTRAL", "collapsed to NEUTRAL"),
    ("EMERGING", "FADING", "reversed to FADING"),
]

# Market tags.
MARKET_KEYWORDS = {
    "NIFTY": ["nifty", "sensex", "bse", "nse", "india market", "indian stock", "dalal street", "sebi", "rbi", "rupee",
              "india stocks"],
    "SP500": ["s&p 500", "sp500", "nasdaq", "dow jones", "wall street", "fed", "federal reserve", "us market",
              "us stocks", "powell", "us equities"],
    "Gold": ["gold", "bullion", "precious metal", "xau", "comex gold", "gold price", "gold futures", "gold rally",
             "gold surge", "gold falls"],
    "Silver": ["silver", "xag", "silver price", "silver futures"],
    "Crude": ["oil", "crude", "brent", "wti", "opec", "petroleum", "energy", "oil price", "oil futures", "oil rally",
              "oil falls"],
}

# Bullish and bearish contexts and the score step per market.
CONTEXTS = {
    "Gold": (
        ["tariff", "trade war", "uncertainty", "inflation", "crisis", "geopolitical", "sanctions", "recession", "fear",
         "safe haven", "dollar falls", "dollar weakens", "rate cut", "fed pivot", "war", "conflict", "surge", "rally",
         "record high", "all time high", "haven demand", "risk off", "flight to safety", "debt ceiling",
         "banking crisis", "central bank buying", "gold demand"],
        ["rate hike", "dollar rises", "dollar strengthens", "risk on", "strong dollar", "hawkish", "yields rise",
         "sell off", "profit taking", "dollar index rises", "dxy rises"],
        0.12,
    ),
    "Crude": (
        ["opec cut", "supply cut", "inventory draw", "demand surge", "production cut", "supply disruption",
         "geopolitical tension", "iran", "russia sanctions", "gulf conflict", "hurricane", "pipeline disruption",
         "supply risk", "draw down"],
        ["tariff", "trade war", "recession", "demand concern", "inventory build", "oversupply", "slowdown",
         "opec increase", "demand falls", "economic slowdown", "china slowdown", "demand weakness", "build up",
         "surplus", "increase output", "production increase", "demand drop"],
        0.12,
    ),
    "SP500": (
        ["rate cut", "fed pivot", "earnings beat", "jobs growth", "gdp growth", "soft landing", "trade deal",
         "stimulus", "record high", "rally", "bull market", "strong earnings"],
        ["tariff", "trade war", "recession", "layoffs", "earnings miss", "rate hike", "inflation surge", "sanctions",
         "war", "crisis", "sell off", "correction", "bear market", "job cuts", "default", "debt crisis",
         "banking crisis"],
        0.10,
    ),
    "NIFTY": (
        ["fii inflow", "fdi", "india gdp", "rbi rate cut", "budget boost", "reform", "india growth",
         "rupee strengthens", "earnings beat", "bull run", "record high", "sensex rally"],
        ["fii outflow", "rbi rate hike", "rupee weakens", "inflation india", "monsoon deficit", "fiscal deficit",
         "earnings miss india", "foreign sell", "india slowdown"],
        0.10,
    ),
}

# Asset keywords of the tiered feed.
ASSET_KEYWORDS = {
    "NIFTY": ["nifty", "sensex", "india", "bse", "nse", "indian market", "rupee", "rbi", "sebi", "india growth",
              "mumbai"],
    "SP500": ["s&p", "sp500", "nasdaq", "dow jones", "fed", "federal reserve", "wall street", "us market", "us stocks",
              "nyse", "trump", "tariff", "fomc", "powell", "us economy"],
    "Gold": ["gold", "xau", "precious metal", "bullion", "safe haven", "central bank gold"],
    "Silver": ["silver", "xag", "precious metals"],
    "Crude": ["crude", "oil", "wti", "brent", "opec", "petroleum", "energy", "iran", "saudi", "oil supply", "barrel"],
}

# Macro themes.
THEME_KEYWORDS = {
    "inflation": ["inflation", "cpi", "price pressure", "hawkish", "price rise", "pce", "prices"],
    "rate_cuts": ["rate cut", "dovish", "pivot", "easing", "lower rates", "cut rates", "rate reduction"],
    "recession": ["recession", "contraction", "slowdown", "gdp decline", "layoffs", "unemployment rise"],
    "geopolitical": ["war", "sanctions", "trade war", "tariff", "conflict", "geopolitical", "military", "tension",
                     "crisis"],
    "dollar_strength": ["dollar", "dxy", "usd", "dollar rally", "strong dollar", "dollar index"],
    "oil_supply": ["opec", "oil production", "supply cut", "iran oil", "oil output", "oil supply"],
    "gold_demand": ["gold demand", "gold buying", "safe haven", "gold rally", "bullion demand", "central bank gold"],
    "india_growth": ["india gdp", "rbi policy", "india growth", "india economy", "nifty rally", "india inflation"],
}

# Trust and staleness weights.
TIER_WEIGHTS = {1: 0.9, 2: 0.7, 3: 0.5}
STALENESS = [("<=", 1, 1.0), ("<=", 3, 0.75), ("<=", 7, 0.5)]
