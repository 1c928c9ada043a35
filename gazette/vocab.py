"""Word lists, lookup tables and thresholds whose content decides results."""

# Score thresholds of the urgency label, highest first.
URGENCY_LABELS = [(8.0, "critical"), (6.5, "high"), (4.0, "medium")]
# Update types that carry no substance.
NOISE_TYPES = ["website error", "other"]
# Relevance floors of the record filter and of its looser timeline form.
MIN_RELEVANCE = 5.0
TIMELINE_MIN_RELEVANCE = 3.0
# Heat decay in days and the window it looks back over.
HEAT_DECAY_DAYS = 14.0
HEAT_WINDOW_DAYS = 90
# Fixed value: divisor that scales count times average urgency into pressure.
PRESSURE_DIVISOR = 5.0
# Heat tiers by absolute value and by peer percentile, highest first.
HEAT_TIERS = [(70.0, "critical"), (30.0, "active"), (10.0, "watch")]
PERCENTILE_TIERS = [(75, "critical"), (40, "active"), (15, "watch")]

# Mechanism of each update type; anything else is Context.
MECHANISMS = {
    "enforcement": "Binding Action",
    "final rule": "Binding Action",
    "proposed rule": "Signal",
    "advisory": "Signal",
    "guidance": "Signal",
    "comment request": "Signal",
    "speech": "Context",
    "press release": "Context",
    "bulletin": "Context",
    "trend report": "Context",
    "standard": "Context",
    "insights": "Context",
    "event announcement": "Context",
    "newsletter": "Context",
}

# Weight of each update type in the rank score; anything else weighs 0.
UPDATE_TYPE_WEIGHTS = {
    "enforcement": 10.0,
    "final rule": 10.0,
    "advisory": 8.0,
    "proposed rule": 8.0,
    "comment request": 6.0,
    "guidance": 6.0,
    "bulletin": 4.0,
    "event announcement": 4.0,
    "press release": 2.0,
    "speech": 2.0,
    "trend report": 2.0,
    "newsletter": 2.0,
    "insights": 2.0,
}
# Recency points by largest age in days.
RECENCY_STEPS = [(7, 10.0), (30, 8.0), (60, 5.0), (90, 2.0)]
# Names whose mention earns the recognition points.
RECOGNISED_NAMES = [
    "kalshi", "polymarket", "forecastex", "predictit", "electronx", "railbird", "fanduel", "draftkings",
    "event contract", "prediction market", "sportsbook", "sweepstakes casino", "binary option",
]
# Workflow statuses dealt out in turn.
STATUS_CYCLE = ["new", "in_review", "acknowledged", "new", "drafted"]

# Postal codes of the states and territories.
US_STATES = [
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "HI", "ID", "IL", "IN", "IA", "KS", "KY", "LA", "ME",
    "MD", "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV", "NH", "NJ", "NM", "NY", "NC", "ND", "OH", "OK", "OR", "PA",
    "RI", "SC", "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY", "DC", "PR", "VI", "GU", "AS", "MP",
]

# Bodies whose rules are widely known.
FAMOUS_REGULATORS = [
    "securities and exchange commission", "u.s. securities and exchange commission", "federal trade commission",
    "european commission", "financial conduct authority", "food and drug administration",
    "u.s. food and drug administration", "federal reserve", "commodity futures trading commission",
    "european central bank", "bank of england", "federal communications commission",
    "consumer financial protection bureau", "united states food and drug administration",
    "european banking authority", "european securities and markets authority", "internal revenue service",
]

# Words that mark a contract entity as a regulator.
REGULATOR_WORDS = [
    "commission", "authority", "bureau", "department", "agency", "office", "board", "ministry",
    "administration", "service", "committee", "fed", "treasury", "reserve",
]
# Words that mark a topic name as a regulator in the key coverage check.
REGULATOR_NAME_WORDS = [
    "commission", "authority", "bureau", "department", "agency", "office", "board", "ministry", "regulator",
    "central bank", "reserve", "bank", "administration",
]

# Actionable update types of the candidate test.
ACTIONABLE_TYPES = [
    "enforcement", "advisory", "guidance", "bulletin", "final rule", "proposed rule", "comment request", "standard",
]

# Scenario keywords. A phrase matches as a substring, a single word at word boundaries.
SCENARIO_A_WORDS = [
    "artificial intelligence", "ai", "algorithm", "algorithmic", "automated decision-making",
    "automated profiling", "profiling", "biometric", "biometric data", "facial recognition",
    "emotion recognition", "data protection", "data privacy", "gdpr", "personal data", "content moderation",
    "recommender system", "machine learning", "generative ai", "foundation model", "ai act",
    "algorithmic decision-making",
]
SCENARIO_B_FINANCE = [
    "securities", "investment product", "investment advice", "robo-advice", "consumer credit", "digital asset",
    "cryptocurrency", "crypto", "consumer finance", "retail investor", "asset management", "wealth management",
    "mifid",
]
SCENARIO_B_PROMOTION = ["marketing", "advertising", "promotion", "promotional", "campaign", "solicitation"]
SCENARIO_B_COMBINED = ["financial promotion", "financial promotions", "credit advertising"]
EEA_COUNTRIES = [
    "AT", "BE", "BG", "HR", "CY", "CZ", "DK", "EE", "FI", "FR", "DE", "GR", "HU", "IE", "IT", "LV", "LT", "LU", "MT",
    "NL", "PL", "PT", "RO", "SK", "SI", "ES", "SE", "IS", "LI", "NO",
]
# Domain bucket of each keyword, by scenario, and each scenario's bucket when none matches.
DOMAIN_BUCKETS = {
    "A": {
        "artificial intelligence": "AI-assisted decisioning",
        "ai": "AI-assisted decisioning",
        "algorithm": "AI-assisted decisioning",
        "algorithmic": "AI-assisted decisioning",
        "automated decision-making": "AI-assisted decisioning",
        "machine learning": "AI-assisted decisioning",
        "generative ai": "AI-assisted decisioning",
        "foundation model": "AI-assisted decisioning",
        "ai act": "AI-assisted decisioning",
        "algorithmic decision-making": "AI-assisted decisioning",
        "automated profiling": "automated profiling",
        "profiling": "automated profiling",
        "biometric": "biometric/emotion inference",
        "biometric data": "biometric/emotion inference",
        "facial recognition": "biometric/emotion inference",
        "emotion recognition": "biometric/emotion inference",
        "data protection": "data processing & retention",
        "data privacy": "data processing & retention",
        "gdpr": "data processing & retention",
        "personal data": "data processing & retention",
        "content moderation": "algorithmic content ranking",
        "recommender system": "algorithmic content ranking",
    },
    "B": {
        "securities": "investment product marketing",
        "investment product": "investment product marketing",
        "investment advice": "investment product marketing",
        "retail investor": "investment product marketing",
        "asset management": "investment product marketing",
        "wealth management": "investment product marketing",
        "mifid": "investment product marketing",
        "robo-advice": "robo-advice disclosures",
        "consumer credit": "credit advertising",
        "consumer finance": "credit advertising",
        "credit advertising": "credit advertising",
        "digital asset": "crypto/digital-asset promotion",
        "cryptocurrency": "crypto/digital-asset promotion",
        "crypto": "crypto/digital-asset promotion",
        "marketing": "retail financial promotions",
        "advertising": "retail financial promotions",
        "promotion": "retail financial promotions",
        "promotional": "retail financial promotions",
        "campaign": "retail financial promotions",
        "solicitation": "retail financial promotions",
        "financial promotion": "retail financial promotions",
        "financial promotions": "retail financial promotions",
    },
}
DEFAULT_BUCKETS = {"A": "AI-assisted decisioning", "B": "investment product marketing"}
# Display names of jurisdiction codes.
COUNTRY_NAMES = {
    "AT": "Austria", "BE": "Belgium", "BG": "Bulgaria", "HR": "Croatia", "CY": "Cyprus", "CZ": "Czechia",
    "DK": "Denmark", "EE": "Estonia", "FI": "Finland", "FR": "France", "DE": "Germany", "GR": "Greece",
    "HU": "Hungary", "IE": "Ireland", "IT": "Italy", "LV": "Latvia", "LT": "Lithuania", "LU": "Luxembourg",
    "MT": "Malta", "NL": "Netherlands", "PL": "Poland", "PT": "Portugal", "RO": "Romania", "SK": "Slovakia",
    "SI": "Slovenia", "ES": "Spain", "SE": "Sweden", "IS": "Iceland", "LI": "Liechtenstein", "NO": "Norway",
    "US": "the United States", "CA": "Canada", "CN": "China", "AU": "Australia", "GB": "the United Kingdom",
    "CH": "Switzerland",
}
# Jurisdiction codes that get a stratum of their own; the rest share "other".
TOP_JURISDICTIONS = ["US", "FR", "CA", "CN", "AU", "DE", "GB", "IT", "CH", "NL"]

# The four tiers of the topic classifier and its negative names.
TOPIC_ENTITY_LABELS = [
    "Securities & Market", "Securities and Market", "Derivative", "Futures", "Commodit", "Gaming", "Gambling",
    "Lottery", "Sports Betting", "Sweepstake", "Financial Intelligence", "AML/CFT", "AML / CFT",
]
TOPIC_NAME_PATTERNS = [
    r"\bSecurities\s+(Department|Commission|Division|Bureau|Board|Regulator|Authority)\b",
    r"\bDepartment of Securities\b",
    r"\bDivision of Securities\b",
    r"\bBureau of Securities\b",
    r"\bGaming\s+(Commission|Control|Board|Authority|Regulator|Enforcement)\b",
    r"\bGambling\s+(Commission|Control|Board|Authority)\b",
    r"\bLottery\s+(Commission|Authority|Board)\b",
    r"\bDivision of Gaming\b",
    r"\bDivision of Gambling\b",
    r"\bRacing\s+(Commission|Board)\b",
    r"\bCorporation Commission\b",
    r"\bDepartment of Banking\b",
    r"\bDepartment of Financial",
    r"\bOffice of Financial Regulation\b",
    r"\bSecretary of State\b",
    r"\bAttorney General\b",
]
TOPIC_ACRONYMS = [
    "CFTC", "SEC", "FINRA", "MSRB", "CFPB", "OCC", "NFA", "FinCEN", "FINCEN", "IRS", "FTC", "FRB", "FDIC",
    "NCUA", "PCAOB", "OFAC", "Treasury", "ESMA", "FCA", "PRA", "BaFin", "AMF", "ASIC", "MAS", "SFC", "CySEC",
    "IOSCO", "FMA", "FSC", "ASC", "ANJ", "AGCO", "UKGC", "MGA", "KSA", "DCMS", "BIS", "FATF",
]
TOPIC_PHRASES = [
    "prediction market", "event contract", "binary option", "sportsbook", "sports betting", "sports bet",
    "sports-bet", "fantasy sport", "wager", "wagering", "gambling", "gaming", "lottery", "sweepstake",
    "commodity exchange", "derivative", "broker-dealer", "broker dealer", "money services business",
]
TOPIC_NEGATIVE_PATTERNS = [
    r"\bAlcohol(\s|ic)\b", r"\bTobacco\b", r"\bCannabis\b", r"\bMarijuana\b", r"\bAir Resources\b",
    r"\bEnvironmental\b", r"\bRecycle", r"\bAgricult", r"\bFood and Drug\b", r"\bPublic Health\b",
    r"\bMotor Vehicles\b", r"\bDept of Transportation\b", r"\bElection\b", r"\bWildlife\b", r"\bParks\b",
    r"\bOcean", r"\bAtmospheric\b", r"\bHomeland Security\b", r"\bImmigration\b", r"\bDrug Abuse\b",
    r"\bEnergy\b", r"\bUtilities\b", r"\bRailroad\b",
]

# Tag allow-list, vetoing tags, and the tags of each layer.
RELEVANT_TAGS = [
    "model risk management", "model risk", "artificial intelligence", "machine learning", "ai governance",
    "sr 11-7", "sr 26-2", "cybersecurity", "data security", "data breach", "personal information", "privacy",
    "pii", "glba", "safeguards rule", "23 nycrr 500", "incident reporting", "consumer data protection", "udaap",
    "deceptive practices", "unfair practices", "abusive practices", "consumer restitution",
    "federal trade commission act", "debt collection", "credit reporting", "negative option", "remittance",
    "payment firms", "electronic fund transfer", "reg e", "error resolution", "dispute resolution", "efta",
    "banking", "banking compliance", "financial institution", "prepaid card", "debit card", "money transfer",
    "payment", "fintech", "fair lending", "ecoa", "equal credit opportunity", "discrimination", "chatbot",
    "ai disclosure", "undisclosed ai", "automated system", "unauthorized advice", "investment advice",
    "complaint handling",
]
VETO_TAGS = [
    "made in usa", "country of origin", "manufacturing", "labeling", "merchandise", "textile", "apparel",
    "food safety", "antitrust", "merger", "divestiture", "anticompetitive", "telemarketing", "robocall",
    "do not call", "medical debt", "wildfire", "natural disaster", "maui", "mortgage credit product",
    "virtual currency", "climate change",
]
LAYER_TAGS = {
    1: [
        "cybersecurity", "data security", "data breach", "personal information", "privacy", "pii", "glba",
        "safeguards rule", "23 nycrr 500", "incident reporting", "consumer data protection",
        "model risk management",
    ],
    2: [
        "unauthorized advice", "investment advice", "unlicensed", "fair lending", "ecoa",
        "equal credit opportunity", "consumer complaint", "complaint handling",
    ],
    3: [
        "model risk management", "model risk", "sr 26-2", "sr 11-7", "false claims", "misleading",
        "deceptive practices", "ai governance", "machine learning", "banking compliance",
    ],
    4: [
        "artificial intelligence", "chatbot", "ai disclosure", "undisclosed ai", "automated system",
        "model risk management", "ai governance", "deceptive practices", "udaap", "abusive practices",
        "banking compliance", "consumer data protection", "data security", "privacy", "pii", "cybersecurity",
        "incident reporting",
    ],
    5: [
        "cybersecurity", "data security", "data breach", "glba", "incident reporting",
        "consumer data protection", "model risk management", "unauthorized access", "reg e",
        "electronic fund transfer", "error resolution",
    ],
    6: [
        "udaap", "deceptive practices", "unfair practices", "abusive practices", "consumer restitution",
        "federal trade commission act", "remittance", "payment firms", "compliance", "fair lending", "ecoa",
        "equal credit opportunity", "discrimination", "reg e", "error resolution", "debt collection",
        "credit reporting",
    ],
    7: [
        "privacy", "pii", "consumer rights", "disclosure requirements", "complaint handling",
        "consumer complaint", "reg e", "electronic fund transfer", "efta", "artificial intelligence",
        "chatbot", "ai disclosure",
    ],
}
# Penalty ranges used when a text names no amount.
PENALTY_RANGES = {"FTC": (50_000, 500_000), "SEC": (100_000, 10_000_000)}
DEFAULT_PENALTY_RANGE = (50_000, 1_000_000)
# Blend weights and floors of signal ranking.
SIGNAL_WEIGHT = 0.5
VECTOR_WEIGHT = 0.5
SECOND_SIGNAL_FLOOR = 0.3
LIABILITY_FLOOR = 0.3
EXPOSURE_WEIGHTS = [0.5, 0.3, 0.2]
EXPOSURE_LABELS = [(75, "High"), (50, "Elevated"), (25, "Moderate")]

# Device terms of the cardiac filter.
CARDIAC_TERMS = [
    r"cardiac", r"cardio", r"\bheart\b", r"coronary", r"arrhythmia", r"atrial", r"ventricular",
    r"defibrillator", r"pacemaker", r"\becg\b", r"\bekg\b", r"electrophysiol", r"cardiac.catheter",
    r"coronary.stent", r"heart.valve", r"ablation", r"fibrillation", r"tachycardia", r"bradycardia",
    r"myocardial", r"transcatheter", r"\bicd\b", r"\bcrt\b", r"\bppg\b", r"cardioverter", r"electrogram",
    r"holter", r"physiolog.*monitor", r"ecg.*monitor", r"cardiac.*monitor", r"ambulatory.*ecg",
    r"cardiac.*rhythm",
]
# Severity classes of device reports; anything else is unknown.
SEVERITIES = {
    "death": "death",
    "serious injury": "serious",
    "injury": "serious",
    "death/serious injury risk": "serious",
    "serious (high-risk device class)": "serious",
    "serious": "serious",
    "malfunction": "malfunction",
    "near-miss": "near-miss",
}
# Source type of each update type, and ordered keyword tests for the rest.
SOURCE_TYPES = {
    "guidance": "regulatory", "regulation": "regulatory", "directive": "regulatory",
    "consultation": "regulatory", "recall": "vigilance", "safety_notice": "vigilance",
    "field_safety": "vigilance", "fsca": "vigilance", "adverse_event": "vigilance", "standard": "standards",
    "amendment": "standards", "trade": "trade", "tariff": "trade",
}
SOURCE_TYPE_WORDS = [
    ("vigilance", ["recall", "fsn", "fsca", "field safety", "withdrawal", "correction"]),
    ("vigilance", ["adverse event", "maude", "incident", "mdr report", "vigilance", "ae spike"]),
    ("standards", ["iec", "iso", "standard", "amendment", "harmonised", "harmonized"]),
    ("trade", ["tariff", "hs code", "import duty", "customs", "trade"]),
]
SEVERITY_WORDS = ["recall", "class i recall", "class ii recall", "withdrawal", "urgent"]
CATEGORY_WORDS = [
    ("Recall / Safety Notice", ["recall", "fsca", "fsn"]),
    ("Guidance", ["guidance", "draft guidance"]),
    ("Standard Revision", ["standard", "iec", "iso", "amendment"]),
    ("Trade & Tariff", ["tariff", "hs code", "import", "trade"]),
    ("Regulatory Change", ["regulation", "directive", "mdr", "ivdr"]),
    ("Adverse Event Signal", ["adverse event", "vigilance", "maude", "signal"]),
]
HORIZON_TYPES = {
    "standard": "STANDARD", "amendment": "STANDARD", "guidance": "GUIDANCE", "consultation": "GUIDANCE",
    "trade": "TRADE", "tariff": "TRADE", "recall": "ALERT", "safety_notice": "ALERT",
    "regulation": "REGULATION", "directive": "REGULATION",
}
HORIZON_TYPE_WORDS = [
    ("STANDARD", ["iec", "iso", "standard", "amendment"]),
    ("TRADE", ["tariff", "hs code", "import", "trade"]),
    ("GUIDANCE", ["guidance", "draft guidance"]),
    ("ALERT", ["recall", "fsca", "fsn", "withdrawal"]),
]
FORWARD_WORDS = [
    "draft", "proposal", "proposed", "upcoming", "consultation", "effective", "transition", "deadline",
    "expected", "planned", "future", "will require", "will be required",
]
ACTION_DEFAULTS = {
    "vigilance": "Review for shared failure modes. Assess evaluation impact.",
    "standards": "Conduct gap analysis against current technical file.",
    "trade": "Alert commercial and regulatory affairs teams.",
    "regulatory": "Review for relevance to regulatory strategy.",
}
# Keywords of device topics and the market tags each topic keyword yields, in order.
DEVICE_TOPIC_WORDS = [
    "food and drug administration", "fda", "cdrh", "medicines and healthcare products", "mhra",
    "therapeutic goods administration", "tga", "swissmedic", "central drugs standard control", "cdsco",
    "european medicines agency", "ema", "mdcg", "eu mdr", "ivdr", "eudamed", "notified body",
    "agence nationale de sécurité du médicament", "ansm", "agencia española de medicamentos", "aemps",
    "paul-ehrlich-institut", "bundesinstitut für arzneimittel", "bfarm", "agenzia italiana del farmaco",
    "aifa", "lareb", "rivm", "health canada", "medical device", "medtech", "pharmacovigilance", "vigilance",
]
MARKET_TAGS = [
    ("food and drug administration", ["US"]), ("fda", ["US"]), ("cdrh", ["US"]), ("mhra", ["UK"]),
    ("medicines and healthcare", ["UK"]), ("therapeutic goods", ["AU"]), ("tga", ["AU"]),
    ("swissmedic", ["CH"]), ("cdsco", ["IN"]), ("central drugs standard", ["IN"]),
    ("european medicines agency", ["EU"]), ("ema", ["EU"]), ("mdcg", ["EU"]), ("eu mdr", ["EU"]),
    ("ivdr", ["EU"]), ("eudamed", ["EU"]), ("notified body", ["EU"]), ("ansm", ["EU", "FR"]),
    ("aemps", ["EU", "ES"]), ("paul-ehrlich", ["EU", "DE"]), ("bfarm", ["EU", "DE"]),
    ("aifa", ["EU", "IT"]), ("health canada", ["CA"]),
]
# Words of a clearance notice and the regulator each mention points to, in order.
CLEARANCE_WORDS = [
    "approved for marketing", "510(k)", "de novo", "510k clearance", "ce marked", "ce certificate",
    "conformity assessment completed", "breakthrough device", "first-in-class", "novel device",
    "innovative product", "new device approved", "market authorisation", "premarket approval",
    "pma approved", "artg", "tga approval", "nmpa approval", "cdsco approval", "mhra registration",
]
CLEARANCE_REGULATORS = [
    ("fda", "US"), ("cdrh", "US"), ("510k", "US"), ("mhra", "UK"), ("tga", "AU"), ("artg", "AU"),
    ("nmpa", "CN"), ("cdsco", "IN"), ("swissmedic", "CH"),
]
CLINICAL_REASONS = [
    "Change Design/Components/Specifications/Material",
    "Labeling Change - Indications/instructions/shelf life/tradename",
    "Labeling Change - PAS",
    "Special (Immediate Track)",
    "Postapproval Study Protocol",
    "Postapproval Study Protocol - OSB",
]
MONTHS = [
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october",
    "november", "december",
]
# Words the tokeniser drops.
STOP_WORDS = [
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "is", "are",
    "was", "were", "be", "been", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may",
    "might", "shall", "can", "not", "this", "that", "these", "those", "it", "its", "as", "if", "so", "we", "our",
    "their", "they", "he", "she", "his", "her", "which", "what", "who", "when", "where", "how", "all", "also", "more",
    "new", "other", "any", "each", "no", "than", "then", "into", "out", "up", "about", "after", "before", "between",
    "through", "during", "under", "over", "per",
]

# Citation outcome of each URL status.
URL_OUTCOMES = {
    "resolves": "citation_alternative_real",
    "unverifiable": "citation_unverifiable",
    "not_found": "citation_fabricated",
}
JUDGE_CONFIDENCE_FLOOR = 0.7
FAILURE_STAGES = {"citation_fabricated": "B", "date_wrong": "B", "missed_obligation": "A"}
# The exact keys of a published record and of the objects in it.
PUBLISHED_KEYS = {
    "record": [
        "id", "title", "regulator_name", "jurisdiction", "update_type", "impact_label", "objective", "what_changed",
        "why_it_matters", "key_requirements", "compliance_date", "citation", "impacted_business", "impacted_functions",
        "scenario", "baseline_failures", "human_review", "source", "probed_at", "model_id", "model_cutoff"],
    "baseline_failures": ["mode", "stage", "baseline_response_excerpt", "judge_rationale"],
    "human_review": [
        "reviewer", "reviewed_at", "attestation", "obligation_applies_confirmed", "artifact_capable_of_violation_confirmed",
        "omission_materiality_confirmed"],
    "jurisdiction": ["scope", "country", "bloc", "region_name"],
    "citation": ["name", "url"],
    "impacted_business": ["size", "type", "industry"],
    "source": ["artifact_id", "topic_id", "source_id", "snapshot_date"],
}
# Change grades in display order.
MATERIALITY_ORDER = ["breaking", "substantive", "clarifying", "cosmetic"]
# Token prices in dollars per million, and per web search.
TOKEN_PRICES = {"input": 5.0, "cached": 0.5, "output": 30.0, "search": 0.01}
# Business types that make an event relevant to market operators.
MARKET_BUSINESS_TYPES = [
    "Event Contracts", "Sports Betting", "Derivatives Exchanges", "Prediction Markets", "Sweepstakes",
    "Online Gambling", "Commodity Exchanges", "Cryptocurrency Exchanges",
]
