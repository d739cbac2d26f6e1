"""Fixed values shared by the classifiers, lenses, feeds and scores.

These must equal the published ones for results to agree, so they are written
out literally here, in one place.
"""

# Topic gates, tried in this order; the first hit wins.
TOPIC_PATTERNS = (
    (
        "cyber",
        r"\b(cyber|ransomware|phishing|malware|breach|hack(?:er|ing)?|"
        r"vulnerability|cve-\d|ddos|exploit|backdoor|zero-day|"
        r"credentials? (?:leak|stolen)|data (?:leak|exfil)|"
        r"control system|ot security|scada)\b",
    ),
    (
        "maritime",
        r"\b(maritime|naval|piracy|tanker|cargo ship|submarine|cable cut|"
        r"strait of hormuz|baltic sea|south china sea|red sea|shipping lane|"
        r"container ship|bulk carrier|merchant vessel|navy)\b",
    ),
    (
        "military",
        r"\b(military|airstrike|drone strike|artillery|missile|troops|"
        r"infantry|tank brigade|battalion|soldier|combat(?: zone)?|"
        r"frontline|front line|offensive|insurgent|militia)\b",
    ),
    (
        "geopolitical",
        r"\b(sanction|tariff|diplomat(?:ic)?|embassy|consulate|election|"
        r"treaty|cease-?fire|humanitarian corridor|"
        r"foreign minister|state department|eu commission|nato|un security|"
        r"bilateral|multilateral|referendum|imposes|eu imposes|"
        r"imposes new|wto|world trade|opec|g7|g20)\b",
    ),
)
TOPICS = ("cyber", "geopolitical", "maritime", "military")

CRITICAL_PATTERN = (
    r"\b(offensive|invasion|massacre|killed|deadly|catastrophic|"
    r"emergency|outage|crippled|million|critical infrastructure|"
    r"state-?adjacent|attributed|zero-day|mass casualty)\b"
)
# Tone thresholds: critical at or below, escalating at or below, de-escalating at or above.
TONE_CRITICAL, TONE_ESCALATING, TONE_DEESC = -10.0, -5.0, 5.0
SEVERITIES = ("critical", "escalating", "watching", "deesc")

# Reading lenses over title and summary.
VULNERABILITY_LENS = (
    r"\bCVE-\d{4}-\d{4,}\b|\bzero[ -]day\b|\bexploits?\b|\bexploited\b|"
    r"\bvulnerabilit(?:y|ies)\b|\bsecurity flaw\b"
)
POLICY_LENS = (
    r"\bregulat(?:ion|ions|ory)\b|\blegislat(?:ion|ive)\b|\bcybersecurity law\b|"
    r"\bprivacy law\b|\bdata protection act\b|\bsanctions?\b|\bcompliance\b"
)
EMERGING_MS = 48 * 3_600_000
RANGE_DAYS = {"24h": 1, "7d": 7, "30d": 30}

# Place-name context: phrases that make a mention a location, and suffixes that unmake it.
LOCATIVES = "in|at|near|off|across|inside|outside|within|via"
LOCATIVE_PATTERN = rf"(?iU)\b(?:{LOCATIVES})\s+(?:the\s+)?$"
ADDRESS_PATTERN = r"(?iU)^\s+(?:road|street|avenue|drive|lane|boulevard|way|rd|st|ave)\b"
NAME_CONTINUES_PATTERN = r"(?U)^\s++[A-Z][a-z]++(?!\s+[A-Z][a-z]+)"
JOINED_PATTERN = r"(?iU)\b(?:and|or)\b|/|&"
GEO_POLICY = "tiered-locus-v2"
LEDE_MIN_CHARS = 40

# Media references allowed through to readers.
IMAGE_PATH_PATTERN = r"^data/media/[a-f0-9]{16}\.jpe?g$"
VIDEO_LINK_PATTERN = r"^https://www\.youtube\.com/watch\?v=[A-Za-z0-9_-]{6,25}$"
MEDIA_BUDGET_BYTES = 450_000

# Reported outlets by trust tier; unknown names are tier 0.
SOURCE_TIERS = {
    "cisa alerts": 3,
    "us-cert": 3,
    "krebsonsecurity": 2,
    "bleepingcomputer": 2,
    "the hacker news": 2,
    "reuters world": 2,
    "ap top news": 2,
    "gcaptain": 1,
}

# Feed registry: name, address, topic stamped on every item of that feed.
FEEDS = (
    ("KrebsOnSecurity", "https://krebsonsecurity.com/feed/", "cyber"),
    ("BleepingComputer", "https://www.bleepingcomputer.com/feed/", "cyber"),
    ("The Hacker News", "https://thehackernews.com/rss.xml", "cyber"),
    ("SecurityWeek", "https://www.securityweek.com/feed/", "cyber"),
    ("Dark Reading", "https://www.darkreading.com/rss.xml", "cyber"),
    ("BBC World", "https://feeds.bbci.co.uk/news/world/rss.xml", "geopolitical"),
    ("Al Jazeera English", "https://www.aljazeera.com/xml/rss/all.xml", "geopolitical"),
    ("Guardian World", "https://www.theguardian.com/world/rss", "geopolitical"),
    ("France24 EN", "https://www.france24.com/en/rss", "geopolitical"),
    ("DW News World", "https://rss.dw.com/rdf/rss-en-world", "geopolitical"),
    ("NPR World", "https://feeds.npr.org/1004/rss.xml", "geopolitical"),
    ("gCaptain", "https://gcaptain.com/feed/", "maritime"),
    ("The War Zone TWZ", "https://www.twz.com/feed", "military"),
)

# Live projection and page sizes.
LIVE_EVENTS, ARTICLES_PER_CALL = 500, 250
BOARD_PAGE, INDEX_PAGE, OVERVIEW_ROWS, FOOTPRINT_ROWS, PREVIEW_CELLS = 3, 50, 12, 16, 14

# Position reports.
FIX_MAX_AGE_MS, FIX_MAX_AHEAD_MS, FIX_MIN_ALT_M = 60_000, 5_000, -20.0
TRAIL_POINTS, TRAIL_MAX_AGE_MS, TRAIL_MIN_MOVE_DEG = 8, 900_000, 4e-5
# Zoom tiers: camera height (metres, None = any), trails, fixes per trail, aircraft, grid degrees.
ZOOM_TIERS = (
    (2_500_000, 140, 14, 1_400, 1.5),
    (8_000_000, 72, 8, 700, 3.5),
    (None, 28, 4, 320, 7.5),
)
SEISMIC_FEATURES, SEISMIC_MIN_MAG = 260, 1.5
HOSTS_PER_REGION, HOST_REGIONS, HOSTS_TOTAL = 30, 8, 300
MIN_CITY_POPULATION = 30_000
CITY_PICK_DEG, CITY_PICK_KM, CITY_RING_KM, EARTH_KM = 0.35, 45.0, 14.0, 6371.0

# Relation ranking: base points per entity kind, bonuses, threshold.
RELATION_BASE = {"cve": 60, "domain": 50, "ip": 50, "asn": 50, "organization": 35}
RELATION_BONUS = {"category": 10, "week": 10, "region": 5}
RELATION_MIN_SCORE, RELATION_TOP, RELATION_CANDIDATES = 45, 5, 200
RELATION_WINDOW_DAYS = {"cve": 365}
RELATION_DEFAULT_WINDOW_DAYS = 30
GENERIC_ENTITY_SHARE = 0.20

# Words of harm: what is named right behind one of them is affected.
AFFECTED_BEFORE = r"(?i)\b(attacks? on|strikes? on|targeted|targeting|hit|hits|breached|victims? in|against)\s+(the\s+)?$"
