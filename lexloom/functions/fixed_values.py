r"""Word lists, lookup tables, limits and patterns.

Results depend on these exact values, so they are stated here as plain data and nowhere else.
Patterns are written in the Java dialect that Spark uses (``\z`` for end of text).
"""

from __future__ import annotations

# ---- limits and weights -------------------------------------------------------------------------

MAX_UPLOAD_MB = 50
ALLOWED_CONTENT_TYPES = [
    "application/pdf", "image/jpeg", "image/jpg", "image/png", "image/tiff", "image/webp",
]
CONTENT_TYPE_BY_SUFFIX = {
    "pdf": "application/pdf", "jpeg": "image/jpeg", "jpg": "image/jpg", "png": "image/png",
    "tiff": "image/tiff", "tif": "image/tiff", "webp": "image/webp", "txt": "text/plain",
}
CORPUS_SUFFIXES = ["txt", "md", "text"]

CHUNK_SIZE = 600
CHUNK_OVERLAP = 120
RETRIEVAL_TOP_K = 8
RETRIEVAL_MIN_SCORE = 0.35
MULTI_DOCUMENT_TOP_K = 4
DRAFT_MAX_CHUNKS = 10
DIVERSITY_WINDOW = 20
DIVERSITY_PER_WINDOW = 2
KEYWORD_SUPPORT_SCORE = 0.5
KEYWORD_SUPPORT_PER_TERM = 3
PREFERENCES_PER_DRAFT = 5
FEW_SHOT_PAIRS = 2
DEDUP_THRESHOLD = 0.85
DEFAULT_RULE_CONFIDENCE = 0.8
DEFAULT_EFFECTIVENESS = 0.5
EFFECTIVENESS_GAIN = 0.10
EFFECTIVENESS_LOSS = 0.05
EMBEDDING_DIMENSIONS = 768
QUERY_INSTRUCTION = "Represent this sentence for searching relevant passages: "
LOW_WORD_CONFIDENCE = 0.70
REVIEW_THRESHOLD = 0.75
FUZZY_THRESHOLD = 85.0

FIELD_WEIGHTS = {"present": 0.40, "ocr": 0.15, "classifier": 0.10, "format": 0.20, "cross": 0.15}
DOCUMENT_WEIGHTS = {"fields": 0.45, "classifier": 0.20, "ocr": 0.10, "coverage": 0.25}
CONFIDENCE_CAP = 0.99

LATENCY_BUCKETS = [0.5, 1.0, 2.0, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0]
DOCUMENT_CONFIDENCE_BUCKETS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.75, 0.8, 0.9, 0.95, 0.99]
WORD_CONFIDENCE_BUCKETS = [0.3, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99]
CONFIDENCE_HISTOGRAM = [
    ("0-20%", None, 0.2), ("20-40%", 0.2, 0.4), ("40-60%", 0.4, 0.6),
    ("60-80%", 0.6, 0.8), ("80-100%", 0.8, None),
]

# ---- scanned-text repair rules, applied in this order, ignoring case ----------------------------

REPAIR_RULES = [
    (r"\bl\s+N\s+V\s+0\s+l\s+C\s+E\b", "INVOICE"),
    (r"\bI\s+N\s+V\s+O\s+I\s+C\s+E\b", "INVOICE"),
    (r"\bSTAT\s+EMENT\b", "STATEMENT"),
    (r"\bACC\s+OUNT\b", "ACCOUNT"),
    (r"\bPERI\s+OD\b", "PERIOD"),
    (r"\blnv(?=oice|\s*N(?:o|0)\.?\s*[:#])", "Inv"),
    (r"\blnv\b", "INV"),
    (r"\blNV\b", "INV"),
    (r"\bBi11\b", "Bill"),
    (r"\bBi1l\b", "Bill"),
    (r"\bT0tal\b", "Total"),
    (r"\bT0TAL\b", "TOTAL"),
    (r"\bStat\s+ement\b", "Statement"),
    (r"\bStat\b(?=\s+(?:Period|Date|p\w))", "Statement"),
    (r"\bAcc0unt\b", "Account"),
    (r"\bACC0UNT\b", "ACCOUNT"),
    (r"\bP3ri0d\b", "Period"),
    (r"\bP3RIO0D\b", "PERIOD"),
    (r"\bP3riod\b", "Period"),
    (r"\bPeri0d\b", "Period"),
    (r"\b0pening\b", "Opening"),
    (r"\b0PENING\b", "OPENING"),
    (r"\bC1osing\b", "Closing"),
    (r"\bC1OSING\b", "CLOSING"),
    (r"\bAvai1able\b", "Available"),
    (r"\bAVAI1ABLE\b", "AVAILABLE"),
    (r"\bSa1ary\b", "Salary"),
    (r"\bDeb1t\b", "Debit"),
    (r"\bCred1t\b", "Credit"),
    (r"\bSubt0tal\b", "Subtotal"),
    (r"\bFr0m\b", "From"),
    (r"\bFR0M\b", "FROM"),
    (r"\blnv0ice\b", "Invoice"),
    (r"\blNVOICE\b", "INVOICE"),
    (r"\bInv0ice\b", "Invoice"),
    (r"\bINV0ICE\b", "INVOICE"),
    (r"\bN0\b(?=\s*[.:#]?\s*[A-Z0-9])", "No"),
    (r"\bN0\.\b", "No."),
    (r"\bBal\b(?=\s*[:#]?\s*[\d£$€])", "Balance"),
    (r"\bBAL\b(?=\s*[:#]?\s*[\d£$€])", "BALANCE"),
    (r"(?<=[A-Z]{2})0(?=[A-Z\-])", "O"),
    (r"\bl(?=[A-Z]{2,})", "I"),
    (r"(?<=[A-Z])1(?=[A-Z]{2,})", "I"),
    (r"\bINV-(\d)O(\d{2})\b", "INV-$10$2"),
    (r"\bDeb1ts\b", "Debits"),
    (r"\bCred1ts\b", "Credits"),
    (r"\bDEB1TS\b", "DEBITS"),
    (r"\bCRED1TS\b", "CREDITS"),
]
PLACEHOLDER = r"\{[a-z_]+:[^}]+\}"

# ---- document types: keywords and patterns, in vocabulary order ---------------------------------
# Each pattern is paired with literals one of which every match must contain (a cheap pre-check).

KEYWORDS = {
    "contract": [
        "agreement", "whereas", "hereby", "party", "parties", "governing law", "termination",
        "indemnification", "warranty", "confidentiality", "intellectual property", "jurisdiction",
        "effective date", "obligations", "in witness whereof", "witnesseth", "heretofore",
        "notwithstanding", "indemnify", "licensor", "licensee", "arbitration", "consideration",
    ],
    "legal_notice": [
        "notice", "cease and desist", "demand letter", "summons", "subpoena", "response deadline",
        "required actions", "issuing party", "receiving party", "non-compliance",
    ],
    "legal_complaint": [
        "complaint", "civil complaint", "civil action", "class action", "plaintiff", "defendant",
        "jury trial demanded", "demand for jury trial", "prayer for relief", "wherefore",
        "cause of action", "count i", "count ii", "venue", "jurisdiction", "federal question",
        "united states district court", "relief sought", "damages", "injunctive relief",
        "declaratory relief",
    ],
    "case_brief": [
        "plaintiff", "defendant", "court", "holding", "legal issue", "case number", "docket",
        "procedural history", "statute", "precedent", "decision date", "jurisdiction",
    ],
    "affidavit": [
        "affidavit", "affiant", "deponent", "sworn", "notary", "notary public",
        "subscribed and sworn", "declarant", "declaration", "under penalty of perjury",
    ],
}
PATTERNS = {
    "contract": [
        (r"\bthis\s+agreement\b", ["agreement"]),
        (r"\bin\s+witness\s+whereof\b", ["whereof"]),
        (r"\bhereby\s+agrees?\b", ["hereby"]),
        (r"\bgoverning\s+law\b", ["governing"]),
        (r"\bnotwithstanding\b", ["notwithstanding"]),
    ],
    "legal_notice": [
        (r"\bcease\s+and\s+desist\b", ["desist"]),
        (r"\bdemand\s+letter\b", ["demand"]),
        (r"\bsummons\b", ["summons"]),
        (r"\bsubpoena\b", ["subpoena"]),
        (r"\bresponse\s+deadline\b", ["deadline"]),
    ],
    "legal_complaint": [
        (r"\bcomplaint\s+(?:for|and\s+jury\s+demand)\b", ["complaint"]),
        (r"\bunited\s+states\s+district\s+court\b", ["district"]),
        (r"\bcivil\s+action\s+no\.?\b", ["civil"]),
        (r"\bcase\s+(?:no\.?|number)\s*[:#]?\s*[A-Z0-9:\-]+", ["case"]),
        (r"\b(?:jury\s+trial\s+demanded|demand\s+for\s+jury\s+trial)\b", ["jury"]),
        (r"\b(?:prayer\s+for\s+relief|wherefore)\b", ["prayer", "wherefore"]),
        (r"\bcount\s+(?:i|ii|iii|iv|v|vi|vii|viii|ix|x|\d+)\b", ["count"]),
        (r"\bplaintiffs?\b.{0,160}\b(?:v\.?|vs\.?|ve)\b.{0,160}\bdefendants?\b", ["plaintiff"]),
    ],
    "case_brief": [
        (r"\bplaintiff\s+v\.?\s+defendant\b", ["plaintiff"]),
        (r"\bcase\s+(?:no\.?|number)\b", ["case"]),
        (r"\blegal\s+issues?\b", ["legal"]),
        (r"\bholding\b", ["holding"]),
    ],
    "affidavit": [
        (r"\baffidavit\s+of\b", ["affidavit"]),
        (r"\bsubscribed\s+and\s+sworn\b", ["sworn"]),
        (r"\bnotary\s+public\b", ["notary"]),
        (r"\bunder\s+penalty\s+of\s+perjury\b", ["perjury"]),
    ],
}
COMPLAINT_CAPTION = [
    (r"\b(?:united\s+states\s+)?district\s+court\b", "district"),
    (r"\bcivil\s+action\s+no\.?\b", "civil"),
    (r"\bcase\s+no\.?\b", "case"),
]
COMPLAINT_ADVERSARIES = r"\bplaintiffs?\b.{0,160}\b(?:v\.?|vs\.?|ve)\b.{0,160}\bdefendants?\b"
COMPLAINT_WORD = r"\bcomplaint\b"
COMPLAINT_BODY = [
    r"\bcount\s+(?:i|ii|iii|iv|v|vi|vii|viii|ix|x|\d+)\b",
    r"\bprayer\s+for\s+relief\b",
    r"\bjury\s+trial\s+demand(?:ed)?\b",
]

# ---- extraction schemas -------------------------------------------------------------------------
# (name, kind, required, collect every pattern's matches, patterns)

_DATE = r"[A-Za-z]+\s+\d{1,2},?\s+\d{4}|\d{1,2}[\/\-]\d{1,2}[\/\-]\d{2,4}"
_COUNT = r"(?:^|\n)\s*COUNT\s+((?:I|II|III|IV|V|VI|VII|VIII|IX|X|\d+)[^\n]{0,180})"
EXTRACTION_SCHEMAS = {
    "contract": [
        ("effective_date", "string", False, False,
         [r"effective\s+(?:as\s+of\s+)?date\s*[:#]?\s*([A-Za-z0-9,\-\/ ]+)"]),
        ("party_a", "string", True, False,
         [r"(?:between|party\s+a|first\s+party)\s*[:#]?\s*([A-Za-z0-9 &,\.\-]+?)"
          r"(?=\s+and\s+[A-Z]|\s*,\s*a\s+[A-Za-z]|$)"]),
        ("party_b", "string", True, False,
         [r"[\"”]\s*\)\s*,?\s+and\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\s*\(",
          r"(?:party\s+b|second\s+party)\s*[:#]?\s*([A-Za-z0-9 &,\.\-]+)"]),
        ("governing_law", "string", False, False,
         [r"governed\s+by[^.]{0,120}?(?:laws?\s+of\s+(?:the\s+)?(?:state\s+of\s+)?|state\s+of\s+)"
          r"([A-Z][A-Za-z ]+?)(?=[\.,;\n])"]),
        ("termination_date", "string", False, False,
         [rf"[Tt]ermination\s+[Dd]ate\s*[:#]?\s*((?:{_DATE}))"]),
        ("contract_value", "string", False, False,
         [r"(?:contract\s+value|total\s+value|consideration)\s*[:#]?\s*"
          r"([$€£]?\s?[\d,]+(?:\.\d{2})?)"]),
        ("parties", "list", False, True, [r"(?:between|and)\s+([A-Z][A-Za-z0-9 &,\.\-]{3,100})"]),
        ("confidentiality_clause", "string", False, False,
         [r"(confidential(?:ity)?[^\n]{0,400})"]),
        ("indemnification", "string", False, False,
         [r"(indemnif(?:y|ication)[^\n]{0,400})"]),
        ("signatures", "list", False, True,
         [r"By:\s*([^\n]{2,80})", r"Name:\s*([^\n]{2,80})"]),
    ],
    "legal_complaint": [
        ("case_caption", "string", True, False,
         [r"([A-Z][A-Za-z0-9 &,.'\-]+,\s*Plaintiffs?.{0,180}?"
          r"[A-Z][A-Za-z0-9 &,.'\-]+,\s*Defendants?)"]),
        ("case_number", "string", True, False,
         [r"\bCase\s+(\d+:\d{2}-cv-\d{3,6}-[A-Z]+)\b",
          r"(?:civil\s+action|case|docket)\s*(?:no\.?|number|#)\s*[:#]?\s*([A-Z0-9:\-\/\.]+)"]),
        ("court", "string", True, False,
         [r"((?:UNITED\s+STATES\s+)?DISTRICT\s+COURT(?:\s+FOR\s+THE\s+[A-Z ]+)?"
          r"|[A-Z][A-Za-z ,]+ Court)"]),
        ("plaintiffs", "list", True, False,
         [r"([A-Z][A-Z0-9 .,'&-]{3,120}),?\s+Plaintiff,?\s+(?:v\.?|vs\.?|ve)"]),
        ("defendants", "list", True, False, [r"v\.?\s+(.{5,500}?),?\s+Defendants?\b"]),
        ("filing_date", "string", False, False, [rf"(?:filed|dated)\s*[:#]?\s*({_DATE})"]),
        ("claims", "list", True, True,
         [_COUNT,
          r"COMPLAINT\s+FOR\s+(.+?)"
          r"(?:DEMAND\s+FOR\s+JURY\s+TRIAL|JURY\s+TRIAL\s+DEMANDED|PRELIMINARY\s+STATEMENT)"]),
        ("causes_of_action", "list", False, True, [_COUNT]),
        ("jurisdiction", "string", False, False,
         [r"(28\s+U\.S\.C\.?\s+§+\s*1331)", r"(28\s+U\.S\.C\.?\s+§+\s*1343)"]),
        ("venue", "string", False, False, [r"(28\s+U\.S\.C\.?\s+§+\s*1391(?:\([a-z]\))?)"]),
        ("statutes", "list", False, True,
         [r"\b(\d+\s+U\.S\.C\.?\s+§+\s*[\w\-.()]+)", r"\b(\d+\s+C\.F\.R\.?\s+§+\s*[\w\-.()]+)",
          r"\b([A-Z][A-Za-z ]{2,80}\s+Act)\b",
          r"\b(Federal\s+Rule\s+of\s+Civil\s+Procedure\s+\d+)"]),
        ("relief_sought", "list", False, True,
         [r"(?:PRAYER\s+FOR\s+RELIEF|WHEREFORE|RELIEF\s+REQUESTED)\s*(.*?)"
          r"(?=\n\s*(?:JURY\s+DEMAND|DEMAND\s+FOR\s+JURY|DATED|Respectfully submitted|$))"]),
        ("jury_demand", "boolean", False, False,
         [r"\b(?:jury\s+trial\s+demand(?:ed)?|demand\s+for\s+jury\s+trial"
          r"|demands?\s+a\s+jury\s+trial|jury\s+demand)\b"]),
    ],
    "legal_notice": [
        ("notice_type", "string", True, False,
         [r"\b(cease\s+and\s+desist|demand\s+letter|summons|subpoena|termination\s+notice)\b"]),
        ("issuing_party", "string", False, False,
         [r"(?:from|issuing\s+party)\s*[:#\-]?\s*([^\n]{3,100})"]),
        ("receiving_party", "string", False, False,
         [r"(?:to|receiving\s+party)\s*[:#\-]?\s*([^\n]{3,100})"]),
        ("issue_date", "string", False, False, [rf"(?:date|issued)\s*[:#\-]?\s*({_DATE})"]),
        ("response_deadline", "string", False, False,
         [rf"(?:response\s+deadline|respond\s+by)\s*[:#\-]?\s*({_DATE})"]),
        ("jurisdiction", "string", False, False, [r"jurisdiction\s*[:#\-]?\s*([^\n]{3,80})"]),
        ("required_actions", "list", False, True,
         [r"(?:must|required to|shall)\s+([^.;\n]{10,180})"]),
    ],
    "case_brief": [
        ("case_name", "string", True, False,
         [r"\b([A-Z][A-Za-z0-9 .,'&\-]+\s+v\.?\s+[A-Z][A-Za-z0-9 .,'&\-]+)\b"]),
        ("case_number", "string", False, False,
         [r"(?:case|docket)\s*(?:no\.?|number|#)\s*[:#]?\s*([A-Z0-9:\-\/\.]+)"]),
        ("court", "string", False, False,
         [r"((?:UNITED\s+STATES\s+)?[A-Z][A-Za-z ]+\s+Court[^\n]{0,100})"]),
        ("jurisdiction", "string", False, False, [r"jurisdiction\s*[:#\-]?\s*([^\n]{3,80})"]),
        ("legal_issues", "list", False, True,
         [r"(?:issue|question presented)\s*[:#\-]?\s*([^\n?]+\?)"]),
        ("holding", "string", False, False, [r"holding\s*[:#\-]?\s*([^\n]{10,400})"]),
        ("cited_statutes", "list", False, True,
         [r"\b(\d+\s+U\.S\.C\.?\s+§+\s*[\w\-.()]+)", r"\b([A-Z][A-Za-z ]{2,80}\s+Act)\b"]),
    ],
    "affidavit": [
        ("declarant_name", "string", True, False,
         [r"(?:affidavit\s+of|declaration\s+of)\s+([^\n]{3,100})"]),
        ("declarant_role", "string", False, False,
         [r"(?:title|role|capacity)\s*[:#\-]?\s*([^\n]{3,80})"]),
        ("notary_name", "string", False, False, [r"notary\s+public\s*[:#\-]?\s*([^\n]{3,100})"]),
        ("notary_jurisdiction", "string", False, False,
         [r"(?:state|county|jurisdiction)\s+of\s+([A-Z][A-Za-z ,.'\-]+)"]),
        ("execution_date", "string", False, False,
         [rf"(?:executed|sworn|dated)\s*[:#\-]?\s*({_DATE})"]),
        ("statement_summary", "string", False, False,
         [r"(?:states?|declares?)\s+(?:as\s+follows:)?\s*(.{20,500})"]),
    ],
    "unknown": [
        ("inferred_document_type", "string", False, False, []),
        ("summary", "string", False, False, []),
        ("key_parties", "list", False, False, []),
        ("important_dates", "list", False, False, [rf"({_DATE})"]),
    ],
}

ENTITY_NUMBER = r"\b\d{4,18}\b"
ENTITY_AMOUNT = r"[$€£]?\s?\d[\d,]*\.\d{2}"
ENTITY_DATE = (
    r"\b(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?"
    r"|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
    r"\s+\d{1,2},?\s+\d{4}\b"
)

# ---- defined terms ------------------------------------------------------------------------------

MAX_DEFINITION = 360
TERM_IN_QUOTES = r'"([^"\n]{2,80})"'
DEFINITION_END = r"(?=(?:\.\s+[A-Z])|\n\s*\n|;|\z)"
DEFINITION_VERBS = [
    (r"(?:as\s+used\s+herein,\s*)?", r"(?:means|shall\s+mean|refers\s+to|is\s+defined\s+as)"),
    (r"(?:the\s+term\s+)?",
     r"(?:shall\s+have\s+the\s+meaning\s+set\s+forth\s+in|has\s+the\s+meaning\s+given\s+in)"),
]
INLINE_DEFINITION = (
    r"([A-Z][A-Za-z0-9&.,'\-\s]{3,180}?)\s*\(\s*(?:the\s+)?" + TERM_IN_QUOTES + r"\s*\)"
)
ROLE_TERMS = ["Plaintiff", "Defendant", "Affiant"]
ROLE_NAME = r"\s+([A-Z][A-Za-z0-9 .,'&-]{2,120})"
INLINE_STOP_WORDS = ["between", "and", "with", "by", "from", "to", "of", "for", "whereas"]
GENERIC_TERMS = ["section", "page", "date", "agreement"]
TERMS_HEADING = "DEFINED TERMS IN THIS DOCUMENT:"
TERMS_FOOTER = (
    "When referring to a defined term, use the full definition on first use in each section, "
    "then the short form thereafter."
)
CONFLICTS_HEADING = "KNOWN CONFLICTS IN THIS DOCUMENT:"
CONFLICTS_NOTE = (
    "These contradictions were detected automatically. Acknowledge them when relevant "
    "and do not assert either fact as authoritative without noting the discrepancy."
)

# ---- jurisdictions ------------------------------------------------------------------------------

STATE_NAMES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA",
    "colorado": "CO", "connecticut": "CT", "delaware": "DE", "florida": "FL", "georgia": "GA",
    "hawaii": "HI", "idaho": "ID", "illinois": "IL", "indiana": "IN", "iowa": "IA",
    "kansas": "KS", "kentucky": "KY", "louisiana": "LA", "maine": "ME", "maryland": "MD",
    "massachusetts": "MA", "michigan": "MI", "minnesota": "MN", "mississippi": "MS",
    "missouri": "MO", "montana": "MT", "nebraska": "NE", "nevada": "NV", "new hampshire": "NH",
    "new jersey": "NJ", "new mexico": "NM", "new york": "NY", "north carolina": "NC",
    "north dakota": "ND", "ohio": "OH", "oklahoma": "OK", "oregon": "OR", "pennsylvania": "PA",
    "rhode island": "RI", "south carolina": "SC", "south dakota": "SD", "tennessee": "TN",
    "texas": "TX", "utah": "UT", "vermont": "VT", "virginia": "VA", "washington": "WA",
    "west virginia": "WV", "wisconsin": "WI", "wyoming": "WY",
}
STATE_CITATION_PREFIXES = {
    "ala": "AL", "alaska": "AK", "ariz": "AZ", "ark": "AR", "cal": "CA", "colo": "CO",
    "conn": "CT", "del": "DE", "fla": "FL", "ga": "GA", "haw": "HI", "idaho": "ID", "ill": "IL",
    "ind": "IN", "iowa": "IA", "kan": "KS", "ky": "KY", "la": "LA", "me": "ME", "md": "MD",
    "mass": "MA", "mich": "MI", "minn": "MN", "miss": "MS", "mo": "MO", "mont": "MT",
    "neb": "NE", "nev": "NV", "nh": "NH", "nj": "NJ", "nm": "NM", "ny": "NY", "nc": "NC",
    "nd": "ND", "ohio": "OH", "okla": "OK", "or": "OR", "pa": "PA", "ri": "RI", "sc": "SC",
    "sd": "SD", "tenn": "TN", "tex": "TX", "utah": "UT", "vt": "VT", "va": "VA", "wash": "WA",
    "wva": "WV", "wis": "WI", "wisc": "WI", "wyo": "WY",
}
FEDERAL_CITATION = r"\b(?:\d+\s+U\.S\.C\.?|Fed\.\s*R\.|U\.S\.\s*Const\.)"
DISTRICT_CITATION = r"\b([NESW]\.D\.|D\.)\s+([A-Z][a-z]+\.?|[A-Z]{2})\b"
LETTERED_DISTRICTS = ["ED", "ND", "SD", "WD"]
STATE_CODE_TAIL = r"\.?\s+(?:Stat\.|Code|Civ\.|CPLR|Rev\.|Admin\.)"
STATE_BY_NAME = (
    r"\b(?:laws?\s+of\s+(?:the\s+)?state\s+of|state\s+of)\s+([A-Z][A-Za-z ]{2,30})\b"
)
# ---- contradictions -----------------------------------------------------------------------------

GOVERNING_LAW = (
    r"(?:governed\s+by|construed\s+(?:in\s+accordance\s+with|under)"
    r"|subject\s+to\s+(?:the\s+)?laws?\s+of)"
    r"\s+(?:the\s+)?(?:laws?\s+of\s+(?:the\s+(?:state|commonwealth)\s+of\s+)?)?"
    r"([A-Z][A-Za-z ]{2,40})(?=[,.\s]|$)"
)
GOVERNING_LAW_NOISE = [
    "the", "this", "such", "any", "all", "an", "a", "its", "their", "our", "agreement",
    "contract", "jurisdiction", "section", "article", "law", "laws", "applicable law",
    "applicable laws", "general principles",
]
LABELLED_DATE = (
    r"(effective\s+date|execution\s+date|commencement\s+date|agreement\s+date"
    r"|dated\s+(?:as\s+of\s+)?|signed\s+(?:on|as\s+of)\s+)"
    r"[:\s]*([A-Z][a-z]+\s+\d{1,2},?\s+\d{4}|\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}|\d{4}-\d{2}-\d{2})"
)
LABELLED_AMOUNT = (
    r"((?:monthly|annual|yearly|quarterly|total|base|license|service)\s+fee[s]?"
    r"|(?:monthly|annual|yearly|quarterly|total)\s+payment[s]?"
    r"|purchase\s+price|contract\s+value|base\s+salary)"
    r"[^$\d\n]{0,40}\$?([\d,]+(?:\.\d{1,2})?)"
)
QUOTED_MEANING = (
    r'"([^"\n]{2,60})"\s+(?:means?|shall\s+mean|refers?\s+to|is\s+defined\s+as)\s+'
    r"([^.;]{5,180}?)(?=[.;]|$)"
)

# ---- chunk boundaries ---------------------------------------------------------------------------

NUMBERED_HEADER = r"^\s*(?:\d+\.|\([a-z]\)|\([ivx]+\))\s+(.{3,120})$"
NAMED_HEADER = (
    r"^\s*(WHEREAS|NOW,\s+THEREFORE|IN\s+WITNESS\s+WHEREOF|RECITALS|DEFINITIONS"
    r"|TERM\s+AND\s+TERMINATION)\s*$"
)
COURT_PAGE_MARKER = r"(?:[—-]\s*)?\bPage\s+(\d{1,4})\s+Case\b"
PAGE_MARKER = r"\bPage\s+(\d{1,4})(?:\s+of\s+\d{1,4})?\b"
ABBREVIATIONS = [
    "mr.", "mrs.", "ms.", "dr.", "esq.", "inc.", "corp.", "ltd.", "co.", "llc.", "plc.", "no.",
    "nos.", "art.", "sec.", "v.", "vs.",
]

# ---- grounding ----------------------------------------------------------------------------------

GROUNDING_WORD = r"\b[\w'-]+\b"
GROUNDING_CITATION = r"\[(?:Page\s+\d+(?:\s+-\s+[^\]]+)?|Chunk\s+\d+|structured_fields)\]"
GROUNDING_UNSUPPORTED = r"\[UNSUPPORTED"
GROUNDING_SENTENCE_END = r"(?<=[.!?])\s+|(?<=\])\s*\n\s*"
GROUNDING_NOUNS = [
    "agreement", "plaintiff", "defendant", "court", "claim", "claims", "party", "parties",
    "subpoena", "jurisdiction", "venue", "relief", "damages", "account", "accounts", "document",
    "documents",
]

# ---- validation ---------------------------------------------------------------------------------

DATE_FORMATS = [  # tried in this order; day before month
    "d/M/yyyy", "d-M-yyyy", "M/d/yyyy", "yyyy-M-d", "d MMMM yyyy", "MMMM d, yyyy", "MMMM d yyyy",
    "d MMM yyyy", "MMM d, yyyy", "MMM d yyyy", "d/M/yy", "M/d/yy",
]
CURRENCY = r"[$€£¥]?\s*([0-9,]+(?:\.[0-9]{1,2})?)"
LARGEST_AMOUNT = 1_000_000_000
INVOICE_ID = r"^[A-Z0-9][A-Z0-9\-\/\._ ]{1,39}$"
ACCOUNT_DIGITS = r"^[\d\-\*X ]{4,30}$"
IBAN = r"^[A-Z]{2}\d{2}[A-Z0-9]{4,30}$"
PERIOD_SEPARATOR = r"\s+(?:to|-)\s+"
PERIOD_YEAR = r"\b(20\d{2})\b"
FORMAT_INVOICE_ID = r"^[A-Z0-9][A-Z0-9\-\/\._ ]{2,40}$"
FORMAT_CASE_NUMBER = r"^[A-Z0-9][A-Z0-9:\-\/\.]{3,60}$"
_MONTH = (
    r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?"
    r"|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
)
FORMAT_DATE = (
    r"\d{1,2}/\d{1,2}/\d{2,4}|\d{1,2}-\d{1,2}-\d{2,4}"
    rf"|\d{{1,2}}\s+{_MONTH}\s+\d{{4}}|{_MONTH}\s+\d{{1,2}},?\s+\d{{4}}"
)
FORMAT_RULE_BY_FIELD = {
    "invoice_number": "invoice_id", "invoice_date": "date", "due_date": "date",
    "vendor_name": "text", "customer_name": "text", "subtotal": "amount", "tax": "amount",
    "total_amount": "amount", "account_number": "account", "statement_period": "period",
    "opening_balance": "amount", "closing_balance": "amount", "available_balance": "amount",
    "receipt_date": "date", "receipt_number": "invoice_id", "payment_method": "short_text",
    "effective_date": "date", "termination_date": "date", "party_a": "text", "party_b": "text",
    "governing_law": "text", "case_caption": "text", "case_number": "case_number",
    "court": "text", "plaintiffs": "list", "defendants": "list", "claims": "list",
    "causes_of_action": "list", "jurisdiction": "text", "venue": "text", "statutes": "list",
    "relief_sought": "list", "filing_date": "date", "jury_demand": "boolean",
}

# ---- retrieval queries --------------------------------------------------------------------------

KEYWORD_SUPPORT_TERMS = [
    "count ", "prayer for relief", "relief", "jurisdiction", "venue", "subpoena",
    "right to financial privacy", "RFPA", "conspiracy", "void",
]
DRAFT_QUERIES = {
    "internal_memo": [
        "key parties involved and their roles", "critical dates deadlines obligations",
        "financial terms payment amounts", "risks liability indemnification",
        "governing law jurisdiction",
    ],
    "case_fact_summary": [
        "facts of the case parties involved", "legal issues questions presented",
        "court ruling holding decision", "procedural history timeline",
        "cited statutes regulations precedents",
    ],
    "contract_summary": [
        "contracting parties roles and addresses", "effective date term duration renewal",
        "payment terms compensation schedule", "termination clauses notice period",
        "intellectual property ownership", "confidentiality non-disclosure obligations",
        "indemnification liability limitation", "governing law dispute resolution",
    ],
    "notice_summary": [
        "notice type issuing party receiving party", "required actions response deadline",
        "legal basis claimed violations", "consequences of non-compliance",
    ],
    "document_checklist": [
        "required signatures execution dates", "referenced exhibits attachments schedules",
        "conditions precedent requirements", "missing or incomplete fields",
    ],
}
DOCUMENT_TYPE_QUERIES = {
    "legal_complaint": [
        "case caption plaintiffs defendants court case number",
        "jurisdiction venue factual allegations", "causes of action counts claims statutes",
        "subpoena allegations bank records RFPA privacy claim",
        "conspiracy allegations actors agreement overt acts",
        "void subpoena improper service legal basis",
        "prayer for relief damages declaratory injunctive relief",
        "jury demand requested relief",
    ],
}
# draft type -> (document types it is meant for, [(section key, title, required, query)])
DRAFT_TEMPLATES = {
    "affidavit": (["affidavit"], [
        ("overview", "Overview", True, "affidavit declaration declarant affiant role"),
        ("statements", "Statements", True, "states declares sworn facts"),
        ("execution", "Execution", False, "notary subscribed sworn execution date"),
    ]),
    "affidavit_summary": (["affidavit"], [
        ("affidavit_overview", "Affidavit Overview", True,
         "affidavit declaration affiant declarant role execution date"),
        ("sworn_statements", "Sworn Statements", True,
         "states declares sworn statement facts"),
        ("notarization", "Notarization and Execution", False,
         "notary public subscribed sworn county state commission execution date"),
        ("gaps", "Missing or Unclear Items", False, "missing blank unsigned undated unsupported"),
    ]),
    "case_brief": (["case_brief"], [
        ("caption", "Caption", True, "case name court case number parties"),
        ("facts", "Facts", True, "facts background events parties conduct"),
        ("issue", "Issue", True, "issue question presented legal issue"),
        ("holding", "Holding", True, "holding ruling decision judgment"),
        ("reasoning", "Reasoning", False, "reasoning analysis rule statute precedent"),
    ]),
    "case_fact_summary": (["case_brief", "legal_complaint"], [
        ("case_identification", "Case Identification", True,
         "case name case number court parties filing date"),
        ("procedural_posture", "Procedural Posture", False,
         "procedural history posture filing decision appeal motion"),
        ("material_facts", "Material Facts", True,
         "facts background timeline events parties conduct"),
        ("issues_claims", "Issues or Claims", True,
         "legal issues claims causes of action counts questions presented"),
        ("holding_or_requested_relief", "Holding or Requested Relief", False,
         "holding ruling decision prayer for relief damages injunction declaratory relief"),
    ]),
    "contract_summary": (["contract"], [
        ("parties", "Parties", True, "contracting parties roles addresses"),
        ("term", "Term and Dates", False,
         "effective date term duration renewal termination date"),
        ("payment_terms", "Payment Terms", False,
         "payment compensation remuneration schedule amounts consideration"),
        ("termination", "Termination", False, "termination notice period breach cure"),
        ("confidentiality_ip", "Confidentiality and IP", False,
         "confidentiality non disclosure intellectual property ownership assignment"),
        ("liability_disputes", "Liability and Disputes", False,
         "indemnification liability limitation governing law arbitration jurisdiction"),
    ]),
    "document_checklist": (["contract", "legal_complaint", "legal_notice", "unknown"], [
        ("required_items", "Required Items", True,
         "required signatures execution dates exhibits attachments schedules deadlines"),
        ("missing_items", "Missing or Incomplete Items", True,
         "missing incomplete blank unsigned undated unsupported"),
    ]),
    "document_summary": (
        ["unknown", "contract", "legal_notice", "legal_complaint", "case_brief", "affidavit"], [
            ("overview", "Overview", True, "document purpose parties dates obligations facts"),
            ("key_points", "Key Points", True,
             "important obligations claims amounts deadlines relief"),
            ("missing_information", "Missing or Unsupported Information", False,
             "missing incomplete unsupported blank unclear"),
        ]),
    "internal_memo": (
        ["legal_complaint", "contract", "legal_notice", "case_brief", "unknown"], [
            ("memo_header", "MEMORANDUM", True, "case caption parties filing date subject"),
            ("case_overview", "I. Case Overview", True,
             "case caption plaintiffs defendants court case number claims filing date"),
            ("jurisdiction_venue", "II. Jurisdiction and Venue", False,
             "jurisdiction venue 28 U.S.C. 1331 1343 1391"),
            ("factual_background", "III. Factual Background", True,
             "factual allegations timeline accounts subpoena hold actions defendants"),
            ("claims_asserted", "IV. Claims Asserted", True,
             "count cause of action RFPA conspiracy negligence statutory basis factual basis"),
            ("relief_sought", "V. Relief Sought", True,
             "prayer for relief wherefore damages declaratory injunctive litigation hold"),
            ("risks_gaps", "VI. Risks and Gaps", False,
             "unsupported missing limitations tolling defenses procedural issues"),
        ]),
    "legal_notice": (["legal_notice"], [
        ("overview", "Overview", True, "notice type issuing party receiving party issue date"),
        ("basis", "Basis", False, "legal basis violation authority statute"),
        ("actions_deadlines", "Actions and Deadlines", True,
         "required actions response deadline comply within days"),
    ]),
    "notice_summary": (["legal_notice"], [
        ("notice_overview", "Notice Overview", True,
         "notice type issuing party receiving party issue date"),
        ("legal_basis", "Legal Basis", False,
         "legal basis statute violation subpoena summons demand authority"),
        ("required_actions", "Required Actions", True,
         "required actions must shall cease demand produce respond"),
        ("deadlines", "Deadlines", False, "response deadline due date comply within days"),
        ("consequences", "Consequences of Non-Compliance", False,
         "non-compliance consequences penalties action lawsuit default sanctions"),
    ]),
}

# ---- instructions of the sections above, defaults and remarks of templates ----------------------

SECTION_INSTRUCTIONS = {
    "affidavit": {
        "overview": "Identify declarant and purpose.",
        "statements": "Summarize sworn statements.",
        "execution": "Summarize signature and notary details.",
    },
    "affidavit_summary": {
        "affidavit_overview": "Identify the declarant, role, execution date, and purpose of the affidavit.",
        "sworn_statements": "Summarize the main sworn factual statements.",
        "notarization": "Summarize notarization, jurisdiction, signature, and execution details.",
        "gaps": "Identify missing dates, signatures, notary information, or unsupported facts.",
    },
    "case_brief": {
        "caption": "Identify case name, court, docket, and parties.",
        "facts": "Summarize key facts.",
        "issue": "State the legal issue as a question if possible.",
        "holding": "State the court's holding or decision.",
        "reasoning": "Summarize the reasoning and authority cited.",
    },
    "case_fact_summary": {
        "case_identification": "Identify the case name, court, case number, parties, and filing or decision date.",
        "procedural_posture": "Summarize the procedural posture using only source-supported facts.",
        "material_facts": "Summarize material facts chronologically and distinguish allegations from findings.",
        "issues_claims": "List legal issues, claims, or questions presented with cited statutory basis when available.",
        "holding_or_requested_relief": "For case briefs, summarize the holding. For complaints, summarize requested relief.",
    },
    "contract_summary": {
        "parties": "Identify parties and roles.",
        "term": "Summarize effective date, term, renewal, and termination timing.",
        "payment_terms": "Summarize payment obligations and consideration.",
        "termination": "Summarize termination rights and notice periods.",
        "confidentiality_ip": "Summarize confidentiality and intellectual-property provisions.",
        "liability_disputes": "Summarize indemnity, liability, dispute resolution, and governing law.",
    },
    "document_checklist": {
        "required_items": "List required signatures, dates, exhibits, schedules, and deadlines.",
        "missing_items": "Identify missing or incomplete items, using unsupported markers when source material lacks the answer.",
    },
    "document_summary": {
        "overview": "Identify the apparent document type, purpose, parties, and key dates.",
        "key_points": "Summarize the most important source-supported points.",
        "missing_information": "List important fields that are absent, unclear, or unsupported.",
    },
    "internal_memo": {
        "memo_header": "Use TO, FROM, DATE, and SUBJECT metadata. Do not mark TO/FROM unsupported.",
        "case_overview": "Identify court, parties, case number, filing date, and document posture.",
        "jurisdiction_venue": "Summarize jurisdiction and venue statutes and factual venue basis.",
        "factual_background": "Summarize material facts chronologically.",
        "claims_asserted": "Enumerate each count/cause of action by count number or title, include statute or legal basis, and summarize the specific factual basis alleged for each count.",
        "relief_sought": "List requested damages, declarations, injunctions, preservation orders, and other relief.",
        "risks_gaps": "State only source-supported risks or gaps; mark absent information unsupported.",
    },
    "legal_notice": {
        "overview": "Identify notice type, sender, recipient, and date.",
        "basis": "Summarize legal basis or alleged violation.",
        "actions_deadlines": "List required actions and deadlines.",
    },
    "notice_summary": {
        "notice_overview": "Identify the notice type, issuing party, receiving party, and issue date.",
        "legal_basis": "Summarize cited legal authority or alleged violation.",
        "required_actions": "List exactly what the recipient must do.",
        "deadlines": "Identify deadlines and response windows.",
        "consequences": "Summarize stated consequences of non-compliance.",
    },
}
#: A default of None is the date of the draft.
TEMPLATE_DEFAULTS = {"internal_memo": {"to": "Senior Partner", "from": "Legal Document Analyst", "date": None}}
#: (draft type, document type or None for all, instruction)
DRAFT_INSTRUCTIONS = [
    (
        "internal_memo", "legal_complaint",
        "For the Claims Asserted section, enumerate each cause of action by count number or title, "
        "include the statute or legal basis cited in the source when present, and summarize the "
        "specific factual basis alleged for that count.",
    ),
    (
        "internal_memo", None,
        "The memo header should use TO: Senior Partner, FROM: Legal Document Analyst, and the provided DRAFT DATE.",
    ),
]

# ---- line rules: severity, issue, any of these patterns, none of these literals, fix, frameworks, urgency

LINE_RULES = [
    ("CRITICAL", "Possible hardcoded secret or API key added in this change.",
     [r"(?i)\b(api[_-]?key|secret|token|password)\b\s*[:=]\s*['\"][A-Za-z0-9_\-]{16,}",
      r"AIza[0-9A-Za-z_\-]{20,}"],
     ["os.getenv", "secrets."],
     "Move the value into a GitHub secret or environment variable.",
     ["PCI-DSS 6.4.3", "SOC 2 CC6.1", "GDPR Art. 32"], "before-merge"),
    ("CRITICAL", "JWT code appears to allow or reference the `alg=none` bypass pattern.",
     [r"(?is)\A(?=.*alg)(?=.*none)(?=.*(?:jwt|algorithm))"], [],
     "Require a fixed signing algorithm and reject unsigned tokens.",
     ["SOC 2 CC6.1", "GDPR Art. 32"], "before-merge"),
    ("CRITICAL", "String-built SQL with interpolation can allow SQL injection.",
     [r"\b(execute|text)\s*\(\s*f['\"]",
      r"(?i)f['\"].*\b(select|insert|update|delete)\b.*\{"], [],
     "Use SQLAlchemy bind parameters instead of interpolating user data.",
     ["PCI-DSS 6.2.4", "SOC 2 CC6.1", "GDPR Art. 32"], "before-merge"),
    ("WARN", "TLS certificate verification is disabled.", [r"(?i)verify=false"], [],
     "Remove `verify=False` and trust a configured CA bundle if needed.",
     ["SOC 2 CC6.7", "GDPR Art. 32"], "within-sprint"),
    ("WARN", "Potentially sensitive data is written to logs or stdout.",
     [r"(?i)\b(print|logger\.\w+)\s*\(.*\b(ssn|password|token|api_key)\b"], [],
     "Remove sensitive values from logs or log only redacted metadata.",
     ["SOC 2 CC7.2", "GDPR Art. 32"], "within-sprint"),
]
#: Our own: the same secret without quotation marks, as prose has it.
UNQUOTED_SECRET_RULE = (
    "CRITICAL", "Possible secret without quotation marks.",
    [r"(?i)\b(api[_-]?key|secret|token|password)\b\s*[:=]\s*[A-Za-z0-9_\-]{16,}"],
    ["os.getenv", "secrets."],
    "Move the value into a secret store.", ["SOC 2 CC6.1"], "before-merge",
)

# ---- fields of the per-type extractors: patterns, needles and clean-up that must match ----------
# field: (kind, rule), see operators/extract_classes.py for the kinds. Case is ignored.

_NAMED = r"[A-Z][A-Za-z0-9 &,\.\-]+"
_PERSON = r"[A-Z][A-Za-z .,'-]+"
_SECTION = (
    r"(?s)(?:^|\n)\s*(?:[IVX]+\.\s*)?(?:%s)\s*(.*?)"
    r"(?=\n\s*(?:[IVX]+\.\s*)?[A-Z][A-Z ,]{4,80}\n|\n\s*COUNT\s+|\z)"
)
_SENTENCES = r"(?<=[.;])\s+|\(\w\)\s+"
_CAPTION = (
    r"(?s)([A-Z][A-Z0-9 .,'&-]{3,120}),?\s+Plaintiff,?\s+(?:v\.?|vs\.?|ve)\s+"
    r"(.+?),?\s+Defendants?\b"
)
_CAPTION_COURT = r"\A.*\bDISTRICT\s+OF\s+[A-Z]+\s+"
_CLAIMS = {
    "find": [
        (r"(?:^|\n)\s*COUNT\s+((?:I|II|III|IV|V|VI|VII|VIII|IX|X|\d+)[^\n]{0,180})", 1),
        (
            r"(?:^|\n)\s*(?:FIRST|SECOND|THIRD|FOURTH|FIFTH|SIXTH|SEVENTH|EIGHTH|NINTH|TENTH)?\s*"
            r"CAUSE\s+OF\s+ACTION\s*[:#-]?\s*([^\n]{8,180})",
            1,
        ),
    ],
    "trim": " :-",
    "longer_than": 5,
    "also": {
        "search": [
            r"COMPLAINT\s+FOR\s+(.+?)"
            r"(?:DEMAND\s+FOR\s+JURY\s+TRIAL|JURY\s+TRIAL\s+DEMANDED|PRELIMINARY\s+STATEMENT)"
        ],
        "split": r",\s*|\s+AND\s+",
        "part_longer_than": 8,
        "trim": " ,.;",
        "drop": r"\A(?:and|or)\s+",
        "longer_than": 5,
    },
    "distinct": "ignore case",
}
CLASS_FIELDS = {
    "contract": {
        "effective_date": ("first", [r"effective\s+(?:as\s+of\s+)?date\s*[:#]?\s*([A-Za-z0-9,\-\/ ]+)"]),
        "party_a": (
            "first",
            [
                r"(?:between|party\s+a|first\s+party)\s*[:#]?\s*([A-Za-z0-9 &,\.\-]+?)"
                r"(?=\s+and\s+[A-Z]|\s*,\s*a\s+[A-Za-z]|$)"
            ],
        ),
        "party_b": (
            "first",
            [
                r"(?:corporation|company|llc|inc|ltd)[^,\n]{0,20}and\s+([A-Z][A-Za-z ,\.\-]+?)"
                r"(?=\s*[,\(]|\s*$|\n)",
                r"(?:party\s+b|second\s+party)\s*[:#]?\s*([A-Za-z0-9 &,\.\-]+)",
            ],
        ),
        "parties": (
            "people",
            {
                "fields": ["party_a", "party_b"],
                "pattern": r"\b(grantor|grantee|plaintiff|defendant|licensor|licensee)\b\s*[:\-]?\s*" + f"({_NAMED})",
                "trim": " .,",
            },
        ),
        "governing_law": (
            "first",
            [
                r"laws?\s+of\s+(?:the\s+state\s+of\s+)?([A-Z][A-Za-z ]+?)(?=[\.,;\n]|$)",
                r"governing\s+law\s*[:#]?\s*(?:[^\n]{0,80}?laws?\s+of\s+(?:the\s+state\s+of\s+)?)?"
                r"([A-Z][A-Za-z ]+?)(?=[\.,;\n]|$)",
            ],
        ),
        "termination_date": ("first", [rf"termination\s+date\s*[:#]?\s*((?:{_DATE}))"]),
        "contract_value": (
            "first",
            [r"(?:contract\s+value|total\s+value|consideration)\s*[:#]?\s*([$€£]?\s?[\d,]+(?:\.\d{2})?)"],
        ),
        "consideration": (
            "first",
            [
                r"(?:contract\s+value|total\s+value|consideration)\s*[:#]?\s*([$€£]?\s?[\d,]+(?:\.\d{2})?)",
                r"(good\s+and\s+valuable\s+consideration|consideration\s+of\s+[$€£]?\s?[\d,]+(?:\.\d{2})?)",
            ],
        ),
        "payment_terms": (
            "first",
            [
                r"(?s)(payment\s+terms?\s*[:#]?\s*(?:.{0,240}?))"
                r"(?:\n\s*\n|termination|confidentiality|$)"
            ],
        ),
        "notice_period": ("first", [r"(\d{1,3})\s+days?\s+(?:prior\s+)?(?:written\s+)?notice"]),
        "confidentiality_clause": ("clause", (["confidentiality", "confidential"], 100)),
        "ip_ownership": ("snippet", (["intellectual property", "ip ownership", "work product"], 220)),
        "indemnification": ("clause", (["indemnification", "indemnify", "hold harmless"], 220)),
        "dispute_resolution": ("snippet", (["arbitration", "mediation", "dispute resolution", "litigation"], 220)),
        "signatures": (
            "signatures",
            {
                "pattern": r"(?:signature|signed\s+by|by)\s*[:_\- ]+\s*([A-Z][A-Za-z .,'-]{2,80})"
                r"(?:\s+date\s*[:_\- ]+\s*([A-Za-z0-9,/\- ]{4,40}))?",
                "trim": " .,",
            },
        ),
    },
    "legal_complaint": {
        "case_caption": (
            "first",
            [
                r"([A-Z][A-Za-z0-9 &,.'\-]+,\s*Plaintiffs?.{0,120}?[A-Z][A-Za-z0-9 &,.'\-]+,\s*Defendants?)",
                r"\b([A-Z][A-Za-z0-9 &,.'\-]+ v\.? [A-Z][A-Za-z0-9 &,.'\-]+)\b",
            ],
        ),
        "case_number": (
            "first",
            [
                r"\bCase\s+(\d+:\d{2}-cv-\d{3,6}-[A-Z]+)\b",
                r"\b(\d{2}-[A-Z]-\d{3,6})\s+Case\s+No\.?\b",
                r"(?:civil\s+action|case|docket)\s*(?:no\.?|number|#)\s*[:#]?\s*"
                r"((?:\d+:\d{2}-cv-\d{3,6}-[A-Z]+)|(?:\d{2}-[A-Z]-\d{3,6})|[A-Z0-9:\-\/\.]+)",
            ],
        ),
        "court": (
            "titled",
            {
                "pattern": r"\b(UNITED\s+STATES\s+DISTRICT\s+court\S*)\s*:?\s*([A-Z ]+)(?=\s+[A-Z][A-Z .,'-]+,\s+Plaintiff)",
                "group": 2,
                "trim": " ,:",
                "narrow": r"\b((?:EASTERN|WESTERN|NORTHERN|SOUTHERN|MIDDLE|CENTRAL)\s+DISTRICT\s+OF\s+[A-Z]+)\b",
                "title": "UNITED STATES DISTRICT COURT, ",
                "else": [r"((?:UNITED\s+STATES\s+)?DISTRICT\s+COURT[^\\n]{0,120}|[A-Z][A-Za-z ,]+ Court)"],
            },
        ),
        "plaintiffs": (
            "list",
            [
                {"once": _CAPTION, "group": 1, "trim": " ,;.", "drop": _CAPTION_COURT},
                {
                    "find": [(r"([A-Z][A-Za-z0-9 &,.'\-]{2,160}),?\s+(?:plaintiff|plaintiffs)\b", 1)],
                    "trim": " ,;", "but": ["", "and"], "distinct": "ignore case",
                },
            ],
        ),
        "defendants": (
            "list",
            [
                {
                    "once": _CAPTION, "group": 2, "trim": " ,;.", "drop": _CAPTION_COURT,
                    "split": r",\s+(?-i:and)\s+(?=(?-i:[A-Z]))|,\s+(?-i:or),\s+(?-i:in\s+the\s+alternative),\s+",
                    "part_longer_than": 3, "distinct": "ignore case",
                },
                {
                    "find": [(r"([A-Z][A-Za-z0-9 &,.'\-]{2,160}),?\s+(?:defendant|defendants)\b", 1)],
                    "trim": " ,;", "but": ["", "and"], "distinct": "ignore case",
                },
            ],
        ),
        "filing_date": ("first", [rf"(?:filed|dated)\s*[:#]?\s*({_DATE})"]),
        "claims": ("list", [_CLAIMS]),
        "causes_of_action": ("list", [_CLAIMS]),
        "jurisdiction": (
            "bases",
            {
                "bases": [
                    (r"\b28\s+U\.S\.C\.?\s+§+\s*1331\b", "Federal question jurisdiction under 28 U.S.C. § 1331"),
                    (r"\b28\s+U\.S\.C\.?\s+§+\s*1343\b", "Civil rights jurisdiction under 28 U.S.C. § 1343"),
                ],
                "else": {"once": _SECTION % "jurisdiction|jurisdiction and venue", "group": 1, "split": _SENTENCES, "part_longer_than": 20, "trim": " ;"},
            },
        ),
        "venue": (
            "quoted",
            {
                "pattern": r"\b28\s+U\.S\.C\.?\s+§+\s*1391(?:\([a-z]\))?",
                "title": "Venue alleged under ",
                "else": {"once": _SECTION % "venue|jurisdiction and venue", "group": 1, "split": _SENTENCES, "part_longer_than": 20, "trim": " ;"},
            },
        ),
        "statutes": (
            "list",
            [
                {
                    "find": [
                        (r"\b\d+\s+U\.S\.C\.?\s+§+\s*[\w\-.()]+", 0),
                        (r"\b\d+\s+C\.F\.R\.?\s+§+\s*[\w\-.()]+", 0),
                        (r"\b[A-Z][A-Za-z ]{2,80}\s+Act\b", 0),
                        (r"\bFederal\s+Rule\s+of\s+Civil\s+Procedure\s+\d+", 0),
                    ],
                    "cut": r"(?s)(?:\n\s*\n|\n\s*(?-i:[A-Z][A-Z ,]{4,80})\n).*",
                    "trim": " ,.;:", "but": [""], "distinct": "ignore case",
                }
            ],
        ),
        "relief_sought": (
            "list",
            [
                {
                    "once": _SECTION % "prayer for relief|relief requested|request for relief|wherefore", "group": 1,
                    "split": _SENTENCES, "part_longer_than": 20, "trim": " ;",
                },
                {
                    "once": r"(?s)\bWHEREFORE\b,?\s*(?:Plaintiffs?|Petitioners?)?\s*(?:respectfully\s+)?(?:requests?|prays?)\s+(.*?)"
                    r"(?=\n\s*(?:JURY\s+DEMAND|DEMAND\s+FOR\s+JURY|DATED|Respectfully submitted|$))",
                    "group": 1, "split": r";\s+|\(\w\)\s+|\n\s*\d+\.\s+", "part_longer_than": 20, "trim": " ;.",
                },
            ],
        ),
        "jury_demand": (
            "flag",
            r"\b(?:jury\s+trial\s+demand(?:ed)?|demand\s+for\s+jury\s+trial|demands?\s+a\s+jury\s+trial|jury\s+demand)\b",
        ),
    },
    "legal_notice": {
        "notice_type": (
            "word",
            [
                ("cease and desist", "cease_and_desist"), ("demand", "demand"), ("summons", "summons"),
                ("subpoena", "subpoena"), ("termination", "termination"),
            ],
        ),
        "issuing_party": ("first", [rf"(?:from|issuing party)\s*[:#]?\s*({_NAMED})"]),
        "receiving_party": ("first", [rf"(?:to|receiving party)\s*[:#]?\s*({_NAMED})"]),
        "issue_date": ("first", [r"(?:date|issue date)\s*[:#]?\s*([A-Za-z0-9,\-/ ]+)"]),
        "response_deadline": ("first", [r"(?:response deadline|respond by|deadline)\s*[:#]?\s*([A-Za-z0-9,\-/ ]+)"]),
        "jurisdiction": ("first", [r"jurisdiction\s*[:#]?\s*([A-Za-z ,]+)"]),
        "referenced_documents": (
            "list",
            [
                {
                    "find": [
                        (r"\b(?:case|contract|agreement|exhibit|schedule|document)\s+(?:no\.?|number|[A-Z])?\s*[:#]?\s*([A-Z0-9\-\/]{3,})", 1)
                    ],
                    "distinct": "sorted",
                }
            ],
        ),
        "required_actions": ("list", [{"find": [(r"\b(?:must|shall|required to|demand that you)\s+([^.;\n]{8,180})", 1)]}]),
    },
    "case_brief": {
        "case_name": ("first", [rf"(?:case name|caption)\s*[:#]?\s*({_NAMED} v\.? {_NAMED})", rf"\b({_NAMED} v\.? {_NAMED})\b"]),
        "case_number": ("first", [r"(?:case|docket)\s*(?:no\.?|number|#)\s*[:#]?\s*([A-Z0-9\-\/:]+)"]),
        "court": ("first", [r"(?:court)\s*[:#]?\s*([A-Z][A-Za-z ,\.\-]+)"]),
        "jurisdiction": ("first", [r"jurisdiction\s*[:#]?\s*([A-Za-z ,]+)"]),
        "filing_date": ("first", [r"filing\s+date\s*[:#]?\s*([A-Za-z0-9,\-/ ]+)"]),
        "decision_date": ("first", [r"decision\s+date\s*[:#]?\s*([A-Za-z0-9,\-/ ]+)"]),
        "plaintiff": ("first", [rf"plaintiff\s*[:#]?\s*({_NAMED})"]),
        "defendant": ("first", [rf"defendant\s*[:#]?\s*({_NAMED})"]),
        "legal_issues": (
            "list",
            [
                {
                    "once": rf"(?s){heading}\s*[:#]?\s*(.*?)(?:\n\s*\n|holding|facts|analysis|$)", "group": 1,
                    "raw": True, "split": r"\n|;|\?", "part_longer_than": 8, "trim": " -;\n\t",
                }
                for heading in ("legal issues", "issues presented", "questions presented")
            ],
        ),
        "holding": ("first", [r"holding\s*[:#]?\s*([^\\n]{10,500})"]),
        "cited_statutes": (
            "list",
            [
                {
                    "find": [
                        (r"\b\d+\s+U\.S\.C\.?\s+§?\s*[\w\-\.]+", 0),
                        (r"\b[A-Z][A-Za-z ]+\s+Code\s+§?\s*[\w\-\.]+", 0),
                        (r"\bsection\s+\d+[A-Za-z0-9\.\-]*", 0),
                    ],
                    "raw": True, "distinct": "sorted",
                }
            ],
        ),
    },
    "affidavit": {
        "declarant_name": (
            "first",
            [rf"(?:affidavit|declaration)\s+of\s+({_PERSON})", rf"(?:affiant|declarant|deponent)\s*[:#]?\s*({_PERSON})"],
        ),
        "declarant_role": ("first", [r"(?:capacity|role|title)\s*[:#]?\s*([A-Za-z ,.'-]+)"]),
        "notary_name": ("first", [rf"notary\s+(?:public\s+)?(?:name)?\s*[:#]?\s*({_PERSON})"]),
        "notary_jurisdiction": ("first", [r"(?:state|county|jurisdiction)\s+of\s+([A-Z][A-Za-z ,.'-]+)"]),
        "execution_date": ("first", [r"(?:executed|sworn|signed|dated)\s+(?:on\s+)?([A-Za-z0-9,\-/ ]+)"]),
        "statement_summary": ("snippet", (["declare", "sworn"], 350)),
    },
}
