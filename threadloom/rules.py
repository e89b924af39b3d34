"""Rule tables. All values in this file are fixed: results depend on them literally."""

# fixed values: number-plate patterns, case-sensitive
PLATE_PATTERNS = [
    r"\b[A-Z]{2}-\d{2}-[A-Z]{1,2}-\d{4}\b",
    r"\b[A-Z]{2}\d{2}[A-Z]{1,2}\d{4}\b",
    r"\b[A-Z]{2}\s\d{2}\s[A-Z]{1,2}\s\d{4}\b",
    r"\b\d{2}\s?BH\s?\d{4}\s?[A-Z]{1,2}\b",
]

# fixed values: further plate patterns, matched without case
PLATE_PATTERNS_WIDE = PLATE_PATTERNS + [
    r"\b[A-Z]{2}\s?\d{4,6}\b",
    r"\b[A-Z]{3}\s?\d{3}\b",
    r"\b\d{3}\s?[A-Z]{3}\b",
    r"\b[A-Z]{1,2}\s?\d{1,5}\s?[A-Z]{1,2}\b",
]

# fixed values: phone patterns
PHONE_PATTERNS = [
    r"\+91[-\s]?\d{10}\b",
    r"\+91[-\s]?\d{5}[-\s]?\d{5}\b",
    r"\b0\d{2,4}[-\s]?\d{6,8}\b",
    r"\b\d{10}\b",
    r"\b\d{2}-\d{10}\b",
]

# fixed values: further phone patterns
PHONE_PATTERNS_WIDE = PHONE_PATTERNS + [
    r"\b\d{3}-\d{3}-\d{4}\b",
    r"\b\(\d{3}\)\s?\d{3}-\d{4}\b",
    r"\+\d{1,3}\s?\d{1,10}",
]

# fixed values: account patterns, matched without case
ACCOUNT_PATTERNS = [r"\b\d{8,20}\b", r"\b[A-Z]{2}\d{6,12}\b"]

# fixed values: organisation watch-list
WATCH_LIST = [
    "Bhagat Transport Services",
    "Shree Ganesh Hawala Network",
    "Om Sai Finance Corp",
    "Nova Digital Solutions",
    "Malabar Traders",
    "Sunrise Sports Consultancy",
]

# fixed values: trigger words by relationship
TRIGGERS = {
    "ASSOCIATE_OF": [
        "associate", "seen with", "husband", "wife", "spouse", "last seen",
        "known accomplice", "close aide", "partner", "linked to", "affiliated with",
    ],
    "FINANCIAL_TRAIL": [
        "transferred", "withdrew", "hawala", "rs.", "transfer", "paid", "deposited",
        "remitted", "wired", "laundered", "invested", "credited", "debited",
    ],
    "CDR_LINK": [
        "contacted", "called", "cdr", "records show", "phone call", "spoke to",
        "conversation with", "dialed", "rang",
    ],
    "SPOTTED_AT": [
        "seen at", "spotted", "located at", "present at", "visited", "was at", "arrived at",
    ],
    "OWNS_VEHICLE": [
        "registered to", "owns", "drives", "registered", "belongs to", "vehicle of",
    ],
    "USES_DEVICE": ["registered", "holds", "uses", "phone", "number", "sim", "subscriber"],
    "INTERCEPTED_CALL": [
        "called", "ping", "comms", "sms", "contacted", "tower location", "cell tower",
    ],
}

# fixed values: words that are never a person
PERSON_STOP_WORDS = [
    "Smt", "Shri", "Mr", "Mrs", "The", "Call", "ANPR", "Toll", "Hawala",
    "Hawala Operator", "Police", "FIR",
]

# fixed values: words that are never a place
PLACE_NOISE = ["Tower", "State Bank Plaza", "Call", "ANPR", "CDR", "FIR"]

# fixed values: texts that are dates
MONTHS = (
    "january|february|march|april|may|june|july|august|september|october|november|december"
)
DATE_PATTERNS = [
    r"(?i)^\d{1,2}(st|nd|rd|th)\s+(" + MONTHS + r")?$",
    r"(?i)^(" + MONTHS + r")\s+\d{1,2}(st|nd|rd|th)?$",
    r"^\d{1,2}[/-]\d{1,2}[/-]\d{2,4}$",
    r"^\d{4}-\d{2}-\d{2}$",
    r"(?i)^\d{1,2}(st|nd|rd|th)$",
]

# fixed values: call-record header words, delimiters and column aliases
CALL_HEADER_WORDS = [
    "caller", "called", "from", "to", "a_number", "b_number", "number", "timestamp",
    "date", "duration", "time",
]
DELIMITERS = [",", "\t", "|", ";"]
DELIMITERS_HEAD = [",", ";", "\t", "|"]
DELIMITERS_PLAIN = [";", ",", "\t"]
CALL_ALIASES = {
    "caller": ["caller", "from", "a_number", "number", "source", "phone_a"],
    "called": ["called", "to", "b_number", "destination", "phone_b"],
    "timestamp": ["timestamp", "date", "time", "datetime", "call_time"],
    "duration": ["duration", "call_duration", "length", "time_sec"],
}
TRANSFER_ALIASES = {
    "amount": ["amount", "value", "sum", "total", "transaction_value", "credit", "debit"],
    "from_account": [
        "from_account", "from_acc", "source", "sender", "source_account", "account_from",
    ],
    "to_account": [
        "to_account", "to_acc", "destination", "recipient", "target_account", "account_to",
    ],
    "currency": ["currency", "currency_code"],
    "date": ["date", "timestamp", "transaction_date", "posted_date"],
    "description": [
        "description", "narrative", "memo", "details", "transaction_type", "type",
    ],
}

# fixed values: relationship names offered to editors
RELATIONSHIP_CATALOGUE = [
    "ASSOCIATED_WITH", "ASSOCIATE_OF", "CAMERA_LOG", "CDR_LINK", "FINANCIAL_TRAIL",
    "INTERCEPTED_CALL", "OWNS_VEHICLE", "SPOTTED_AT", "USES_DEVICE",
]

# fixed values: score thresholds
WITHIN_CASE_THRESHOLD = 85.0
CROSS_CASE_THRESHOLD = 85.0
