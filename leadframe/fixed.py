"""Fixed values.

FIXED VALUES — these must equal the behaviour we rebuild, so they are stated
plainly here, in their natural order, and used from here only: word lists,
patterns, lookup tables, hosts and formats. Everything else in the package is
our own logic.
"""

# ---------------------------------------------------------------- FIXED VALUES
# Profile URL host patterns; a URL is a profile URL if its lowered
# "scheme://host/path" contains one of them.
PROFILE_URL_PATTERNS = ["linkedin.com/in/", "de.linkedin.com/in/", "www.linkedin.com/in/"]
PROFILE_SITE = "linkedin.com"
PROFILE_CANONICAL_PREFIX = "https://linkedin.com/in/"

# Search query format: site:<host>/in "t1" "t2"
SEARCH_SITE = "linkedin.com/in"

# Required and optional profile fields.
REQUIRED_FIELDS = ["name", "profile_url", "summary"]
OPTIONAL_FIELDS = ["current_position", "company", "location", "follower_count",
                   "connection_count", "email", "website", "phone",
                   "experience_years", "summary_other"]

# Boilerplate sentences removed from snippets (case-insensitive).
BOILERPLATE_PATTERNS = [
    r"View [^\n\.!?]{1,200}?’s profile on LinkedIn[^\.!?\n]*[\.!?]",
    r"View [^\n\.!?]{1,200}?'s profile on LinkedIn[^\.!?\n]*[\.!?]",
    r"View [^\n\.!?]{1,200}? profile on LinkedIn, a professional community of [^\.!?\n]*[\.!?]",
    r"Sehen Sie sich das Profil von [^\n\.!?]{1,200}? auf LinkedIn[^\.!?\n]*[\.!?]",
]

# Bullet characters stripped at line starts.
BULLET_CHARS = r"\-\*•·–—›>\u2022\u2023\u25E6\u2043\u2219"

# Snippet facts: location patterns, then title patterns (first hit wins).
SNIPPET_LOCATION_PATTERNS = [
    r"([A-Z][a-zA-Z\s,-]+(?:Deutschland|Germany|Austria|Switzerland|USA|United States))",
    r"([A-Z][a-zA-Z\s,-]+,\s*[A-Z]{2,})",
    r"([A-Z][a-zA-Z\s]+,\s*[A-Z][a-zA-Z\s]+)",
]
SNIPPET_TITLE_PATTERNS = [
    r"(Senior\s+[A-Z][a-zA-Z\s]+Engineer)",
    r"(Software\s+Engineer)",
    r"(Lead\s+[A-Z][a-zA-Z\s]+)",
    r"([A-Z][a-zA-Z\s]*Engineer)",
    r"([A-Z][a-zA-Z\s]*Developer)",
    r"([A-Z][a-zA-Z\s]*Manager)",
    r"([A-Z][a-zA-Z\s]*Director)",
]

# Title separators, tried in this order.
TITLE_SEPARATORS = ["–", "—", "-", "|"]

# Metatag company patterns (case-insensitive, multiline), all matches in order.
META_COMPANY_PATTERNS = [
    r"Experience:\s*([^·\n•|]+)",
    r"(?:Currently|Currently working|Working)\s+(?:at|for|with)\s+([^·\n•|.,]+)",
    r"(?:Engineer|Developer|Manager|Director|Analyst|Consultant|Scientist)\s+(?:at|@)\s+([^·\n•|.,]+)",
    r"(?:^|\n)([A-Z][A-Za-z\s&.,'-]+?)(?:\s*[·•]|\s*\n|\s*$)",
]
# Metatag location patterns (case-insensitive), first hit wins.
META_LOCATION_PATTERNS = [
    r"Location:\s*([^·\n•|]+)",
    r"Based in\s+([^·\n•|.,]+)",
    r"Located in\s+([^·\n•|.,]+)",
    r"\b((?:New York|London|Berlin|Munich|Hamburg|Stuttgart|Frankfurt|Paris|Tokyo|Singapore|Sydney|Toronto|Chicago"
    r"|Boston|Seattle|San Francisco|Los Angeles|Amsterdam|Zurich|Vienna|Barcelona|Madrid|Rome|Milan|Stockholm"
    r"|Copenhagen|Helsinki|Oslo|Dublin|Edinburgh|Manchester|Birmingham|Leeds|Glasgow|Cardiff|Belfast)[^·\n•|.,]*)",
    r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*,\s*(?:Germany|UK|USA|Canada|France|Italy|Spain|Netherlands|Sweden|Norway"
    r"|Denmark|Switzerland|Austria|Australia|Japan|Singapore))",
]

# Free-text facts.
EMAIL_PATTERN = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
URL_PATTERN = r"https?://[\w.-]+\.[A-Za-z]{2,}(?:/[\w\-./?%&=]*)?"
BARE_DOMAIN_PATTERN = r"\b(?:[a-zA-Z0-9-]+\.)+[A-Za-z]{2,}\b"
WEBSITE_EXCLUDED = ["linkedin.com", "twitter.com", "x.com", "facebook.com",
                    "instagram.com", "youtube.com", "medium.com"]
BARE_WEBSITE_EXCLUDED = WEBSITE_EXCLUDED + ["wikipedia.org"]
PHONE_PATTERN = r"(?:(?:\+|00)\d{1,3}[\s-]?)?(?:\(?\d{2,4}\)?[\s-]?)?\d{3,4}[\s-]?\d{3,4}"
PHONE_MIN_DIGITS = 7
EXPERIENCE_PATTERNS = [
    r"(\d{1,2})\s*\+?\s*years?\s+of\s+experience",
    r"over\s+(\d{1,2})\s+years",
    r"(\d{1,2})\s*\+\s*years",
    r"(\d{1,2})\s*years",
]
SENTENCE_SPLIT = r"(?<=[.!?])\s+|\n+"
PROPER_WORD = r"\b[A-Z][a-z]{2,}\b(?:\s+[A-Z][a-z]{2,})?"
MAX_SALIENT = 5

# Follower / connection counts.
FOLLOWER_PATTERNS = [
    r"(\d+(?:\.\d+)?[KMB]?)\s+followers?",
    r"Ca\.\s+(\d+(?:\.\d+)?[KMB]?)\s+Follower",
]
CONNECTION_PATTERNS = [
    r"(\d+\+?)\s+connections?",
    r"(\d+(?:\.\d+)?[KMB]?)\s+Kontakte",
]
CONNECTIONS_CAP = 500

# Shorthand numbers.
SHORTHAND_PATTERN = r"^([0-9]+(?:\.[0-9]+)?)([KMB]?)$"
SHORTHAND_FACTORS = {"K": 1000, "M": 1000000, "B": 1000000000}

# Degree prefixes, longest first, one is stripped.
DEGREE_PREFIX_PATTERNS = [
    r"prof\.?\s+dr\.?\s+",
    r"dr\.-ing\.?\s+",
    r"dipl\.-ing\.?\s+",
    r"priv\.-doz\.?\s+",
    r"prof\.?\s+",
    r"pd\.?\s+",
    r"dr\.?\s+",
    r"mag\.?\s+",
    r"ing\.?\s+",
    r"mba\s+",
    r"m\.sc\.?\s+",
    r"b\.sc\.?\s+",
]

# Company-name cleaning for domain guesses.
UMLAUT_REPLACEMENTS = [("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")]
NAME_LEGAL_SUFFIXES = ["gmbh", "ltd", "inc", "corp", "ag", "co", "kg", "& co", "se", "llc"]
# Order of the ten guesses: (name form, tld); forms: "raw" = cleaned name,
# "joined" = blanks removed, "dashed" = blanks to "-".
DOMAIN_GUESS_ORDER = [("raw", "com"), ("raw", "de"), ("raw", "io"), ("raw", "ai"), ("raw", "org"),
                      ("joined", "com"), ("dashed", "com"), ("joined", "de"), ("joined", "io"),
                      ("joined", "ai")]

# Model-answer website filter.
ANSWER_URL_PATTERN = r"https?://(?:www\.)?([a-zA-Z0-9-]+\.[a-zA-Z]{2,})"
ANSWER_URL_EXCLUDED = ["wikipedia", "linkedin", "facebook", "twitter", "crunchbase", "xing"]
ANSWER_UNSURE_WORDS = ["unknown", "not sure", "cannot", "don't know", "unclear", "not found", "confident"]

# Homepage pick from search items.
HOMEPAGE_SOCIAL_HOSTS = ["linkedin.com", "twitter.com", "facebook.com", "instagram.com"]
HOMEPAGE_ITEMS = 5

# Page excerpts.
EXCERPT_DROP_TAGS = ["script", "style", "noscript"]
EXCERPT_MAX_CHARS = 4000

# Profile answer schema (strict: only these keys, string or null).
PROFILE_ANSWER_FIELDS = ["current_position", "company", "location", "follower_count",
                         "connection_count", "company_website"]
# Answer cleaning.
ANSWER_NULL_TOKENS = ["null", "none", "n/a", ""]
ANSWER_CLEAN_FIELDS = ["current_position", "company", "location", "follower_count", "connection_count"]

# Company answer schema: (field name, alias, type).
COMPANY_ANSWER_FIELDS = [
    ("company", "Company", "string"),
    ("legal_form", "Legal_Form", "string"),
    ("industries", "Industries", "array<string>"),
    ("locations_germany", "Locations_Germany", "array<string>"),
    ("multinational", "Multinational", "boolean"),
    ("website", "Website", "string"),
    ("size_employees", "Size_Employees", "bigint"),
    ("business_model_key_points", "Business_Model_Key_Points", "array<string>"),
    ("products_and_services", "Products_and_Services", "array<string>"),
    ("recent_news", "Recent_News", "array<string>"),
]
FENCED_JSON_PATTERN = r"```(?:json)?\n([\s\S]*?)\n```"

# Prompt placeholders and the snippet line.
PROMPT_NAME_TOKEN = "{{NAME}}"
PROMPT_TITLE_TOKEN = "{{TITLE}}"
PROMPT_SUMMARY_TOKEN = "{{SUMMARY}}"
PROMPT_SNIPPET_LABEL = "\n\nGoogle Snippet: "
COMPANY_TARGET_FORMAT = "Target company: %s. Domain: %s"
COMPANY_EXCERPT_FORMAT = "\nWebsite URL: %s\nWebsite excerpt (truncated):\n%s\n"

# Sites that are no company's own website.
JOB_HOSTS = ["linkedin", "wikipedia", "facebook", "twitter", "instagram", "xing", "indeed", "stepstone",
             "glassdoor", "monster"]

# Legal forms: phrase -> short form (substring test, in order).
LEGAL_FORM_PHRASES = [
    ("gesellschaft mit beschränkter haftung", "GmbH"),
    ("beschränkter haftung", "GmbH"),
    ("aktiengesellschaft", "AG"),
    ("unternehmergesellschaft", "UG"),
    ("kommanditgesellschaft auf aktien", "KGaA"),
    ("kommanditgesellschaft", "KG"),
    ("offene handelsgesellschaft", "OHG"),
    ("eingetragener kaufmann", "e.K."),
    ("eingetragene kauffrau", "e.K."),
    ("eingetragene kaufmann", "e.K."),
]
# Legal forms: exact short forms.
LEGAL_FORM_SHORTS = [
    ("gmbh", "GmbH"),
    ("ag", "AG"),
    ("se", "SE"),
    ("ug", "UG"),
    ("kgaa", "KGaA"),
    ("kg", "KG"),
    ("ohg", "OHG"),
    ("e.k.", "e.K."),
    ("ek", "e.K."),
    ("gmbh & co. kg", "GmbH & Co. KG"),
    ("ag & co. kg", "AG & Co. KG"),
    ("se & co. kg", "SE & Co. KG"),
]
# Legal forms found in a company name: compound patterns, then simple ones.
LEGAL_FORM_NAME_COMPOUND = [
    (r"\bgmbh\s*&\s*co\.?\s*kg\b", "GmbH & Co. KG"),
    (r"\bag\s*&\s*co\.?\s*kg\b", "AG & Co. KG"),
    (r"\bse\s*&\s*co\.?\s*kg\b", "SE & Co. KG"),
    (r"\bkgaa\b", "KGaA"),
]
LEGAL_FORM_NAME_SIMPLE = [
    (r"\bgmbh\b", "GmbH"),
    (r"\bag\b", "AG"),
    (r"\bse\b", "SE"),
    (r"\bug\b", "UG"),
    (r"\bohg\b", "OHG"),
    (r"\bkg\b", "KG"),
    (r"\be\.k\.\?\b", "e.K."),
]
# Opt-in repair of the last simple pattern, which cannot match "e.k.".
LEGAL_FORM_EK_FIXED = r"\be\.k\.?(?!\w)"

# Company defaults.
UNKNOWN_COMPANY_NAME = "Unknown Company"
DEFAULT_PROVIDER = "unknown"

# Display format of report timestamps.
REPORT_TS_FORMAT = "yyyy-MM-dd HH:mm"

# Outreach defaults.
MESSAGE_STATUS_SCHEDULED = "scheduled"
MESSAGE_STATUS_SENT = "sent"
MESSAGE_STATUS_REPLIED = "replied"
# ------------------------------------------------------------ END FIXED VALUES
