"""Word lists, thresholds and labels.

Everything in this module is a FIXED VALUE: results are only right when these
lists and numbers are exactly these.  The Spark expressions and the check SQL
both read them from here, so they cannot drift apart.
"""

# --- job titles -------------------------------------------------------------
JOB_TITLES = [
    "CEO", "Chief Executive Officer", "Chairman", "Managing Director", "Director",
    "Commissioner", "Minister", "Governor", "President", "Judge",
    "Permanent Secretary", "Board Member", "Major Investor", "Business Owner",
    "Politician", "Senior Civil Servant", "Military Officer", "Head of Agency",
]
SENIOR_TITLES = ["CEO", "Chief Executive", "Chairman", "Managing Director", "Permanent Secretary"]

# --- risk, sentiment, category ---------------------------------------------
RISK_TIERS = {
    "Critical": ["corruption", "fraud", "embezzlement", "money laundering", "bribery",
                 "indictment", "arrested for fraud", "bankruptcy", "insolvency"],
    "High": ["investigation", "court case", "lawsuit", "conviction", "regulatory action",
             "sanction", "dismissal", "suspended", "tax dispute", "prosecution"],
    "Medium": ["resignation", "layoffs", "office closure", "dispute", "fine",
               "compliance issue", "audit report"],
}
POSITIVE_STEMS = [
    "appoint", "promote", "partner", "acquire", "growth", "record profit",
    "expansion", "launched", "funding", "success", "innovative", "approved",
    "strengthen", "win", "awarded", "achievement", "breakthrough", "gain",
]
NEGATIVE_STEMS = [
    "resign", "retire", "dismiss", "suspend", "fraud", "corruption", "bankruptcy",
    "lawsuit", "sanction", "fine", "dispute", "investigate", "decline", "loss",
    "layoff", "closure", "deficit", "charge", "arrest", "sue", "protest", "fail",
]
CATEGORY_WORDS = {
    "Government": ["ministry", "minister", "agency", "department", "parliament", "psc",
                   "civil service", "commissioner", "governor", "senate",
                   "federal government", "public service commission"],
    "Company": ["corp", "inc", "limited", "ltd", "shares", "stock", "merger", "acquisition",
                "board changes", "ipo", "delisting", "revenue", "fiscal", "quarter", "earnings"],
    "Legal": ["court", "judge", "sue", "lawsuit", "prosecution", "investigation", "sanctions",
              "compliance", "arrest", "indictment", "trial", "conviction"],
}
PERSON_TITLE_WORDS = ["ceo", "chairman", "director", "secretary", "minister"]
GOVERNMENT_LEVEL_WORDS = ["federal", "national", "minister", "president", "governor", "ministry"]
BREAKING_WORDS = ["breaking", "announces", "acquired", "merger", "bankruptcy", "court", "arrest"]
ENGLISH_STOPWORDS = ["the", "be", "to", "of", "and", "in", "that", "have", "it", "for", "not",
                     "on", "with", "he", "as", "you", "do", "at"]
MONTH_WORDS = ["January", "February", "March", "April", "May", "June", "July", "August",
               "September", "October", "November", "December"]
DAY_WORDS = ["today", "yesterday", "tomorrow", "monday", "tuesday", "wednesday", "thursday",
             "friday", "saturday", "sunday"]

# --- feed gates -------------------------------------------------------------
NAVIGATION_TITLES = [
    "home", "homepage", "account login", "login", "log in", "sign in", "sign up",
    "contact us", "contact", "about us", "about", "privacy policy", "terms",
    "terms of use", "terms and conditions", "faq", "faqs", "help", "support",
    "search", "search results", "portal", "dashboard", "downloads", "download",
    "register", "registration", "services", "our services", "news", "latest news",
    "media centre", "media center", "press releases", "gallery", "sitemap",
]
TITLE_SEPARATORS = [" - ", " | ", " – ", " — "]
COUNTRY_URL_MARKERS = [".ng", "punchng", "vanguardngr", "thecable", "premiumtimesng"]
COUNTRY_TEXT_MARKERS = ["nigeria", "abuja", "lagos", "nnpc", "efcc", "cbn", "nimasa", "fgn"]
COUNTRY_WHOLE_WORDS = ["firs"]
VIOLENCE_STEMS = ["bandit", "abduct", "kidnap", "airstrike", "bombing", "terrorist",
                  "boko haram", "insurgency", "killing", "clash", "mourn"]
FRESHNESS_HOURS = 48

# --- off-topic guard --------------------------------------------------------
SPORT_TERMS = [
    "football", "soccer", "basketball", "volleyball", "cricket", "rugby",
    "tennis", "golfer", "boxing", "wrestling", "athletics", "marathon",
    "olympics", "olympic", "afcon", "world cup", "premier league", "la liga",
    "serie a", "bundesliga", "champions league", "europa league",
    "mls", "nfl", "uefa", "fifa", "nff", "npfl",
    "super eagles", "super falcons", "flying eagles",
    "striker", "midfielder", "goalkeeper", "defender", "winger", "footballer",
    "centre-back", "left-back", "right-back", "penalty", "offside",
    "kick-off", "kickoff", "half-time", "full-time", "transfer window",
    "friendly match", "international friendly", "qualifier", "derby",
    "league table", "fixture list",
    "scored", "scores twice", "hat-trick", "substitute",
    "football club", "sports club", "fc",
]
ENTERTAINMENT_TERMS = [
    "nollywood", "bbnaija", "big brother naija", "grammy", "amvca", "afrobeats",
    "movie", "film premiere", "box office", "album", "singer", "songwriter",
    "actress", "actor", "musician", "rapper", "skit maker", "influencer",
    "reality show", "housemate", "housemates", "eviction", "red carpet",
    "star-studded", "celebrity", "wedding", "engagement party", "birthday bash",
    "music video", "concert", "tour dates",
]
OWNERSHIP_STRONG_TERMS = [
    "shareholding", "shareholder", "shareholders", "stake", "equity",
    "beneficial owner", "beneficial ownership", "significant control", "psc",
    "share capital", "issued shares", "voting rights",
    "board of directors", "board seat", "annual return", "filing",
    "cac", "sec", "cbn", "naicom", "frc", "corporate affairs commission",
    "securities and exchange commission",
    "dividend", "ipo", "listing", "delisting", "rights issue",
    "subsidiary", "holding company", "holdco", "parent company",
    "incorporated", "liquidation", "receivership", "insolvency",
    "procurement", "contract award", "tender",
]
OWNERSHIP_WEAK_TERMS = [
    "acquisition", "acquires", "acquired", "merger", "merges", "merged",
    "takeover", "divestment", "divests", "buyout", "controlling interest",
]
RESULT_VERBS = ["beat", "beats", "defeat", "defeats", "defeated", "thrash", "thrashed",
                "draw", "drew", "held", "edge", "edged", "trounced", "hammered"]
PERCENTAGE_PATTERN = r"\b\d{1,3}(?:\.\d+)?\s*(?:%|per\s?cent\b|percent\b)"
SCORELINE_PATTERN = r"\b\d{1,2}\s*[-–]\s*\d{1,2}\b"

OUTLET_MARKERS = [
    "guardian", "premium times", "punch", "vanguard", "daily post", "dailypost",
    "thisday", "this day", "nairametrics", "channels tv", "channels television",
    "leadership newspaper", "the nation", "businessday", "business day", "tribune",
    "sahara reporters", "peoples gazette", "the cable", "thecable", "legit.ng",
    "reuters", "bloomberg", "associated press", "al jazeera", "bbc", "cnn",
]
PAGE_FURNITURE = [
    "archives", "archive", "home", "newsletter", "advertisement", "sponsored",
    "read more", "subscribe", "latest news", "breaking news", "news",
]

# --- search topics ----------------------------------------------------------

SEARCH_TOPICS = {
    "beneficial_ownership": [
        "persons with significant control", "person with significant control",
        "beneficial owner", "beneficial ownership", "ultimate beneficial owner",
        "significant control", "beneficial interest"],
    "corporate_registry": [
        "Corporate Affairs Commission", "CAC Nigeria", "CAMA", "companies register",
        "annual return", "PSC register", "beneficial ownership register", "company filing"],
    "shareholding_change": [
        "majority stake", "controlling interest", "acquires stake", "substantial shareholding",
        "share acquisition", "equity stake", "shareholding", "divestment", "share transfer"],
    "corporate_governance": [
        "corporate governance", "board of directors", "annual general meeting",
        "board appointment", "director resigns", "chairman appointed", "company secretary",
        "code of corporate governance", "board reshuffle"],
    "market_regulators": [
        "Securities and Exchange Commission", "Nigerian Exchange", "NGX",
        "Financial Reporting Council", "CBN", "NAICOM", "PENCOM", "regulatory filing",
        "listing rules"],
    "mergers_acquisitions": [
        "merger", "acquisition", "takeover", "scheme of arrangement", "business combination",
        "corporate restructuring", "delisting"],
    "procurement": ["Tender", "Procurement", "Contract Award", "Bid Opening", "due diligence",
                    "compliance"],
    "investigations": ["Audit", "Fraud", "EFCC investigation", "ICPC investigation", "bribery",
                       "asset forfeiture", "money laundering"],
    "public_sector": ["NNPC", "NIMASA", "NPA", "FAAN", "NITDA", "FIRS", "NERC", "BPE", "NDDC"],
}

# --- ownership register -----------------------------------------------------
SHARE_BANDS = [(75.0, "BAND_75_100"), (50.0, "BAND_50_75"), (25.0, "BAND_25_50"), (5.0, "BAND_5_25")]
BELOW_THRESHOLD = "BELOW_THRESHOLD"
BAND_IDS = [name for _, name in SHARE_BANDS] + [BELOW_THRESHOLD]
SUB_THRESHOLD_FLOOR, SUB_THRESHOLD_CEILING = 3.5, 5.0
VOTING_GAP_POINTS = 20.0
SECRECY_JURISDICTIONS = [
    "mauritius", "cayman", "british virgin", "bvi", "jersey", "guernsey",
    "isle of man", "panama", "seychelles", "bahamas", "bermuda", "belize",
    "liechtenstein", "gibraltar", "delaware", "luxembourg", "cyprus",
    "marshall islands", "samoa", "curacao", "offshore",
]
NOMINEE_MARKERS = ["nominee", "nominees", "trustee", "trust ", "proxy", "custodian"]
DIRECT_HOLDING_LABELS = ["", "direct holding", "direct shareholder", "direct", "n/a"]
FLAG_TITLES = {
    "R1_SUB_THRESHOLD": ("high", "Sub-threshold structuring"),
    "R3_VOTING_MISMATCH": ("high", "Voting rights exceed equity"),
    "R7_SECRECY_VEHICLE": ("high", "Secrecy-jurisdiction vehicle"),
    "R4_NOMINEE": ("medium", "Nominee or trust arrangement"),
    "R9_PEP": ("high", "Politically exposed person"),
    "R8_RAPID_CHANGE": ("medium", "Recent change of control"),
    "R12_CROSS_ENTITY": ("medium", "Cross-entity portfolio"),
    "R6_UNKNOWN_OWNER": ("medium", "Interest not quantified"),
}

# --- scores -----------------------------------------------------------------
RISK_FLOORS = [(75, "Critical"), (50, "High"), (25, "Medium")]
RISK_LEVELS = ["Low", "Medium", "High", "Critical"]
CATEGORIES = ["Company", "Government", "Legal", "Other"]
EVENT_TYPES = [
    "PSC Change", "Ownership Change", "Appointment", "Merger", "Acquisition",
    "Restructuring", "Procurement", "Earnings", "Audit", "Policy", "Corruption", "Other",
]
AGENCY_WORDS = ["commission", "department", "ministry", "federal"]
AGENCY_WORDS_FALLBACK = AGENCY_WORDS + ["board"]

# --- relationship extraction ------------------------------------------------
RELATION_STEMS = ["appoint", "hire", "resign", "retire", "acquire", "buy", "partner",
                  "investigate", "dismiss", "suspend", "sue"]

# --- report sections --------------------------------------------------------
SECTION_WORDS = {
    "appointments": ["appoint", "promote", "sworn in", "names", "board"],
    "company_changes": ["merger", "acquire", "acquisition", "restructur", "expand", "ipo", "bankrupt"],
    "procurement": ["tender", "procurement", "contract award", "bid opening", "project award"],
    "regulation": ["regulation", "policy", "executive order", "circular", "compliance"],
    "financial": ["budget", "revenue", "annual report", "financial statement", "quarterly"],
}
SECTION_CATEGORY = {"appointments": "Government", "company_changes": "Company", "regulation": "Legal"}
CORRUPTION_WORDS = ["fraud", "corruption", "bribery", "diversion", "misappropriation", "efcc", "icpc"]

# --- related articles -------------------------------------------------------
RELATED_STOPWORDS = ["the", "and", "for", "with", "from", "over", "into", "amid", "after",
                     "nigeria", "nigerian", "news", "guardian", "premium", "times", "punch",
                     "vanguard", "dailypost"]

# --- register tables --------------------------------------------------------
REGISTER_COLUMNS = {
    "articles": ["id", "time", "title", "source", "url", "category", "risk_score", "summary",
                 "status", "engine"],
    "companies": ["company", "mention_count", "last_seen", "industry", "risk_level"],
    "people": ["name", "position", "organization", "event", "date"],
    "agencies": ["agency", "event", "article", "date"],
    "procurement": ["agency", "contractor", "amount", "project", "source"],
    "significant_control": [
        "person_name", "company", "nature_of_control", "board_role", "percentage", "direct_pct",
        "indirect_pct", "voting_pct", "share_band", "vehicle", "pep_status", "risk_level",
        "filing_ref", "verification_status", "change_type", "previous_holder", "date", "source"],
    "daily_reports": ["date", "total_articles", "high_risk", "appointments", "procurement",
                      "generated", "archive_file", "content"],
}
PSC_IDENTITY = ["person_name", "company", "nature_of_control", "percentage", "date"]

# Fixed sentences of the flags' details.
DETAIL_PARKED = " holders in this company sit between 3.5% and 5%, just under the CAMA 2020 s.868 disclosure threshold."
DETAIL_GAP = " point gap, meaning control materially exceeds ownership."
DETAIL_SECRECY = ("Control is held through an entity connected to ", ", a jurisdiction commonly used to obscure beneficial ownership.")
DETAIL_NOMINEE = "A nominee, trustee or custodian appears in the control chain, which can stand between the register and the real owner."
DETAIL_PEP = "The holder is recorded as politically exposed, which calls for enhanced due diligence on the source of funds and on any related public contracts."
DETAIL_CHANGE = ("Control increased and transferred from ", ", so the register reflects a recent restructuring.")
DETAIL_PORTFOLIO = ("Holds significant control in ", " tracked companies, so influence is understated by any single row.")
DETAIL_UNKNOWN = "Neither a percentage nor a nature of control was disclosed for this holder."

# Fixed sentences of the daily report: section, heading and what stands where a section is empty.
REPORT_HEADINGS = [
    ("appointments", "## Appointments", "*No new executive or civil service appointments logged in this window.*"),
    ("company_changes", "## Company Changes", "*No major corporate restructuring, acquisitions, or IPOs logged.*"),
    ("procurement", "## Procurement", "*No government tenders or contract awards registered.*"),
    ("regulation", "## Regulation", "*No new CBN, SEC, FCCPC, or NERC regulatory directives logged.*"),
    ("financial", "## Financial Updates", "*No corporate financial statements or audit updates registered.*"),
]
REPORT_NO_ALERTS = "*No high priority critical risk alerts triggered in this window.*"
REPORT_NO_CORRUPTION = "*No corruption or embezzlement risk signals flagged.*"

# Fixed sentences of the brief of a run.
BRIEF_NO_EVENTS = "*   *Routine market intelligence signals monitored across counterparties.*"
BRIEF_NO_RISKS = "*   *No critical risk threshold breaches recorded in this run window.*"
BRIEF_NO_CHANGES = "*   *No new public procurement or executive board changes logged in this window.*"
BRIEF_RISK_SUMMARY = "Elevated risk indicator detected."
BRIEF_EVENT_SUMMARY = "Key corporate update recorded."
