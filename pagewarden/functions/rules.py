"""Rule tables of the text operators and their translation to regular-expression dialects.

Patterns are written with ASCII word boundaries and Unicode white space in mind: ``java`` and ``re2`` give the form
that behaves so in Spark and in DuckDB.
"""

from __future__ import annotations

import re

# ---- Fixed values: rules whose wording and order decide the results ----

KEYWORD_RULES = [
    ("PASSWORD", "CRITICAL", "input metadata", ["password", "passcode", "passwd"]),
    ("OTP", "CRITICAL", "input metadata or pattern", ["otp", "one time password", "verification code", "security code"]),
    ("API_KEY", "CRITICAL", "key/token metadata or pattern", ["api key", "api token", "access key"]),
    ("AUTH_TOKEN", "CRITICAL", "token metadata or pattern", ["auth token", "access token", "refresh token", "bearer", "jwt", "session token"]),
    ("CARD_NUMBER", "CRITICAL", "card metadata or pattern", ["credit card", "debit card", "card number", "card no", "cvv", "cvc"]),
    ("EMAIL", "HIGH", "email metadata or pattern", ["email", "e-mail"]),
    ("PHONE", "HIGH", "phone metadata or pattern", ["phone", "mobile", "telephone", "tel"]),
    ("GOVERNMENT_ID", "HIGH", "identity metadata or pattern", ["aadhaar", "aadhar", "pan number", "passport", "national id", "identity number"]),
    ("BANK_ACCOUNT", "HIGH", "bank metadata or pattern", ["bank account", "account number", "ifsc"]),
    ("EMPLOYEE_ID", "MEDIUM", "employee metadata", ["employee id", "employee number", "staff id", "worker id"]),
    ("PERSON", "HIGH", "name metadata", ["full name", "legal name", "first name", "last name", "person name", "customer name", "account holder", "account holder name", "beneficiary name"]),
    ("ADDRESS", "HIGH", "address metadata", ["address", "street", "city", "postal code", "zip code"]),
]

EMAIL = r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
PHONE = r"(?:\+?91[\s-]?)?[6-9]\d{4}[\s-]?\d{5}\b"
CARD = r"\b(?:\d[ -]*?){13,19}\b"
GOVERNMENT_ID = r"(?<!\d)\d{4}[\s-]?\d{4}[\s-]?\d{4}(?!\d)|\b[A-Z]{5}\d{4}[A-Z]\b"
TOKEN_SHAPE = r"\b(?:Bearer\s+)?[A-Za-z0-9_-]{24,}\.[A-Za-z0-9_.-]{10,}\b"
API_KEY = r"\b(?:sk|pk|api)[_-][A-Za-z0-9_-]{16,}\b"
IFSC = r"\b[A-Z]{4}0[A-Z0-9]{6}\b"
UPI = r"\b[a-z0-9._-]{2,}@[a-z][a-z0-9.-]{1,}\b"
STREET = r"\b\d{1,6}\s+[A-Za-z][A-Za-z .'-]{2,}\s(?:street|st|road|rd|avenue|ave|lane|ln|drive|dr|boulevard|blvd|nagar|colony|sector|block|apartment|flat)\b"
POSTCODE = r"\b(?:zip|postal code|pincode)\s*[:#-]?\s*\d{5,6}\b"
TITLED = r"\b(?:mr|mrs|ms|dr)\.?\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2}\b"

#: Order of classification: category, pattern, ignore case.
CLASSIFY_PATTERNS = [("EMAIL", EMAIL, True), ("PHONE", PHONE, False), ("CARD_NUMBER", CARD, False), ("GOVERNMENT_ID", GOVERNMENT_ID, True), ("AUTH_TOKEN", TOKEN_SHAPE, False), ("API_KEY", API_KEY, True), ("IFSC", IFSC, True), ("UPI_ID", UPI, True), ("ADDRESS", STREET, True), ("ADDRESS", POSTCODE, True), ("PERSON", TITLED, False)]

#: Order of redaction.
REDACT_PATTERNS = [
    ("PASSWORD", r"\b(?:password|passcode|passwd)\s*[:=\-]?\s*[^\s,;]+", True),
    ("OTP", r"\b(?:otp|verification code|security code)\s*[:=\-]?\s*[^\s,;]+", True),
    ("AUTH_TOKEN", r"\b(?:bearer|auth token|access token|refresh token|jwt)\s*[:=\-]?\s*[^\s,;]+", True),
    ("EMPLOYEE_ID", r"\b(?:employee id|employee number|staff id|worker id)\s*[:=\-]?\s*[^\s,;]+", True),
    ("EMAIL", EMAIL, True),
    ("PHONE", PHONE, False),
    ("CARD_NUMBER", CARD, False),
    ("GOVERNMENT_ID", GOVERNMENT_ID, True),
    ("API_KEY", API_KEY, True),
    ("IFSC", IFSC, False),
    ("UPI_ID", UPI, False),
    ("ADDRESS", STREET, True),
    ("ADDRESS", POSTCODE, True),
    ("PERSON", TITLED, False),
]

#: Order of match extraction.
MATCH_PATTERNS = [("EMAIL", EMAIL, True), ("PHONE", PHONE, False), ("GOVERNMENT_ID", GOVERNMENT_ID, True), ("CARD_NUMBER", CARD, False), ("AUTH_TOKEN", TOKEN_SHAPE, False), ("API_KEY", API_KEY, True), ("IFSC", IFSC, False), ("UPI_ID", UPI, False), ("ADDRESS", STREET, True), ("ADDRESS", POSTCODE, True), ("PERSON", TITLED, False)]

#: Replacements of visible text after the redaction rules.
VISIBLE_PATTERNS = [
    ("PERSON", r"\b(?:full|legal|customer|account\s+holder|beneficiary|profile)\s+name\s*[:\-]?\s*[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,3}\b", False),
    ("DATE_OF_BIRTH", r"\b(?:date\s+of\s+birth|dob|birth\s+date)\s*[:\-]?\s*(?:\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4}|\d{1,2}\s+[A-Za-z]+\s+\d{2,4})\b", True),
    ("ADDRESS", r"\b(?:residential|current|home|mailing)?\s*address\s*[:\-]?\s*[^\n]{1,240}", True),
]

#: Labels of structured values, in order.
VALUE_LABELS = [
    ("PERSON", r"\b(?:full\s*name|legal\s*name|customer\s*name|account\s*holder(?:\s*name)?|beneficiary\s*name)\b"),
    ("PHONE", r"\b(?:mobile|phone|telephone|contact)\b"),
    ("ADDRESS", r"\b(?:residential|mailing|home)?\s*address\b"),
    ("DATE_OF_BIRTH", r"\b(?:date\s*of\s*birth|dob|birthdate)\b"),
    ("EMAIL", r"\b(?:email|e-mail)\b"),
    ("BANK_ACCOUNT", r"\b(?:bank\s*account|account\s*(?:no|number))\b"),
    ("IFSC", r"\bifsc(?:\s*code)?\b"),
    ("UPI_ID", r"\bupi(?:\s*id)?\b"),
    ("CARD_NUMBER", r"\b(?:credit|debit)?\s*card(?:\s*(?:no|number))?\b"),
    ("GOVERNMENT_ID", r"\b(?:pan|aadhaar|aadhar|passport)\b"),
    ("API_KEY", r"\b(?:api\s*(?:key|token)|access\s*token)\b"),
]

#: Words of which a text with such a label has at least one, in lower case.
LABEL_WORDS = {"PERSON": ["name", "account"], "PHONE": ["mobile", "phone", "contact"], "ADDRESS": ["address"], "DATE_OF_BIRTH": ["birth", "dob"], "EMAIL": ["mail"], "BANK_ACCOUNT": ["account"], "IFSC": ["ifsc"], "UPI_ID": ["upi"], "CARD_NUMBER": ["card"], "GOVERNMENT_ID": ["pan", "aadha", "passport"], "API_KEY": ["api", "access"]}

#: The older rule-set: label keywords (all that occur count) with severity, in order.
LEGACY_LABELS = [
    ("PASSWORD", "CRITICAL", ["password", "passcode", "passwd"]),
    ("PIN", "CRITICAL", ["pin", "mpin", "transaction pin", "security pin"]),
    ("OTP", "CRITICAL", ["otp", "one time password", "verification code", "authentication code", "security code"]),
    ("CVV", "CRITICAL", ["cvv", "cvc", "card verification value", "card security code"]),
    ("CREDIT_CARD", "CRITICAL", ["credit card", "debit card", "card number", "card no"]),
    ("BANK_ACCOUNT", "HIGH", ["bank account", "account number", "account no", "account id"]),
    ("IFSC", "HIGH", ["ifsc", "ifsc code"]),
    ("EMAIL", "HIGH", ["email", "email address", "e mail"]),
    ("PHONE_NUMBER", "HIGH", ["phone", "phone number", "mobile", "mobile number", "contact number", "telephone"]),
    ("AADHAAR", "HIGH", ["aadhaar", "aadhar", "aadhaar number", "aadhar number"]),
    ("PAN", "HIGH", ["pan", "pan number"]),
    ("PASSPORT", "HIGH", ["passport", "passport number"]),
    ("NATIONAL_ID", "HIGH", ["national id", "identity number", "id number"]),
    ("API_KEY", "CRITICAL", ["api key", "api token", "access key"]),
    ("SECRET_KEY", "CRITICAL", ["secret", "secret key", "private key"]),
    ("AUTH_TOKEN", "CRITICAL", ["auth token", "access token", "refresh token", "bearer token", "session token", "jwt"]),
    ("DATE_OF_BIRTH", "MEDIUM", ["date of birth", "dob"]),
]

LEGACY_PATTERNS = [
    ("EMAIL", EMAIL, True),
    ("PHONE_NUMBER", r"\b(?:\+91[\s-]?)?[6-9]\d{9}\b", False),
    ("AADHAAR", r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}\b", False),
    ("PAN", r"\b[A-Z]{5}[0-9]{4}[A-Z]\b", True),
    ("CREDIT_CARD", r"\b(?:\d{4}[\s-]?){3}\d{4}\b", False),
]

#: The small fallback set, replaced by <REDACTED>.
FALLBACK_PATTERNS = [("EMAIL", EMAIL, True), ("PHONE", r"\b(?:\+91[\s-]?)?[6-9]\d{9}\b", False), ("CARD", r"\b(?:\d{4}[\s-]?){3}\d{4}\b", False), ("PAN", r"\b[A-Z]{5}\d{4}[A-Z]\b", True)]

#: Lines of scanned documents, in order; PERSON also looks at the next line.
LINE_GOVERNMENT = (r"(?:\d[\s-]?){12,16}", r"\b[a-z]{5}\d{4}[a-z]\b")
LINE_BIRTH = (r"\b(?:dob|date of birth|born)\b", r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b")
LINE_ADDRESS = (r"\b(?:address|s\/?o|d\/?o|c\/?o|nagar|colony|street|road|district|village|ward|pincode|pin code)\b", r"\b\d{6}\b")
LINE_PERSON = r"^[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,2}$"

NAME_SHAPE = r"^[A-Za-z][A-Za-z'’-]{1,}(?:\s+[A-Za-z][A-Za-z'’-]{1,}){1,3}$"
INTENT_STOP_WORDS = ["with", "that", "this", "from", "please", "would", "could", "should", "about", "into"]
QUESTION_START = r"^(what|how many|how much|is there|are there|show me|find|list|tell me|describe|count|which|where|when|who|why|does|did|can you see|do you see|any|how)\b"
QUESTION_FULL = r"^(what|how|which|is|are|does|did|can|who|where|when|why)\b[^.!]*\?\s*$"
INTERACTIVE = ["button", "input", "textarea", "select", "link", "contenteditable"]

# ---- End of the fixed values ----

WORD = "[A-Za-z0-9_]"
BOUNDARY = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
SPACES = r"\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def _translated(pattern: str, boundary: str) -> str:
    out, k, inside = [], 0, False
    while k < len(pattern):
        two = pattern[k : k + 2]
        if two == r"\s":
            out.append(SPACES if inside else f"[{SPACES}]")
            k += 2
        elif two == r"\b" and not inside:
            out.append(boundary)
            k += 2
        elif two[0] == "\\":
            out.append(two)
            k += 2
        else:
            inside = inside or two[0] == "["
            inside = inside and two[0] != "]"
            out.append(two[0])
            k += 1
    return "".join(out)


def java(pattern: str, ignore_case: bool = False) -> str:
    """The pattern for Spark: word boundaries by ASCII look-around, cheaper ones before a digit or a letter at the start."""
    head = ""
    if pattern.startswith(r"\b\d"):
        head, pattern = f"(?=[0-9])(?<!{WORD})", pattern[2:]
    elif pattern.startswith((r"\b[A-Z]{", r"\b(?:p", r"\b(?:o", r"\b(?:b", r"\b(?:e", r"\b(?:z", r"\b(?:m", r"\b(?:s")) and "|" not in pattern.split("(?:")[0]:
        head, pattern = f"(?=[A-Za-z])(?<!{WORD})", pattern[2:]
    elif re.match(r"\\b\(\?:[a-z](?:[^()|]|\|[a-z]|\(\?:[^()]*\))*\)(?![?*{])[^|]*$", pattern):
        head, pattern = f"(?=[A-Za-z])(?<!{WORD})", pattern[2:]
    return ("(?i)" if ignore_case else "") + head + _translated(pattern, BOUNDARY)


def one_of(words: list[str]) -> str:
    """A pattern that finds any of the words as they are, which tries their common beginnings once at each place of a text."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[:1], []).append(w[1:])
    parts = [re.escape(h) + ("" if "" in rest else one_of(rest)) for h, rest in heads.items()]
    return parts[0] if len(parts) == 1 else f"(?=[{''.join(map(re.escape, heads))}])(?:{'|'.join(parts)})"


def needs(pattern: str) -> str | None:
    """A character class without which the pattern can't match; None if there is no simple one."""
    if pattern in (EMAIL, UPI):
        return "@"
    if pattern in (PHONE, CARD, GOVERNMENT_ID, IFSC, STREET, POSTCODE, *[p for c, p, _ in LEGACY_PATTERNS if c != "EMAIL"], *[p for c, p, _ in FALLBACK_PATTERNS if c != "EMAIL"]):
        return "[0-9]"
    return "[_-]" if pattern == API_KEY else None


def re2(pattern: str, ignore_case: bool = False) -> str:
    """The pattern for RE2, which has no look-around: the identity number takes a non-digit on both sides."""
    pattern = pattern.replace(r"(?<!\d)\d{4}[\s-]?\d{4}[\s-]?\d{4}(?!\d)", r"(?:^|[^0-9])\d{4}[\s-]?\d{4}[\s-]?\d{4}(?:[^0-9]|$)")
    return ("(?i)" if ignore_case else "") + _translated(pattern, r"\b")
