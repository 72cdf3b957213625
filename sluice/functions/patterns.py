"""Pattern catalogue of the de-identification and its audit, in Java's dialect ((?U): Unicode classes)."""

from __future__ import annotations

# Patterns, placeholders, scores and word lists that results depend on.
INTERNAL_STRICT = r"(?U)\b[A-Z][\w.'-]*(?:\s+[A-Z][\w.'-]*){0,3}\s*/[A-Z]{2,6}/[A-Z]{2,6}(?:@[A-Z]{2,6})?"
INTERNAL_LOOSE = r"(?U)\b[A-Z][\w.'-]*(?:\s+[A-Z][\w.'-]*){0,3}\s*/[A-Z]{2,6}@[A-Z]{2,6}"
EXTENSION = r"(?iU)\b(?:x|ext\.?)\s?\d{3,6}\b"
INTL_PHONE = r"(?U)\+\d{1,3}(?:[\s.\-]?\(?\d{1,4}\)?){2,5}"
NANP_PHONE = r"(?U)\(?\b\d{3}\)?[\s.\-]\d{3}[\s.\-]\d{4}\b"
SOFT_BREAK = r"=\r?\n"
SPLIT_EMAIL = r"(?U)([\w.+-]+@[\w.-]*?)=\s+(?=\w)"
URL_SCHEME = r"(?iU)(?:https?://|ftp://|www\.)[\w./?=&%#:+~@-]+"
URL_BARE = r"(?iU)\b[\w-]+(?:\.[\w-]+)*\.(?:com|org|net|edu|gov|mil|int|io|co|uk|de|fr|ca|au|biz|info|tv|us)\b(?:/[\w./?=&%#:+~@-]*)?"
HTML_TAG = r"<[^<>\n]{1,200}>"
HTML_ISH = r"(?i)<(?:font|br|html|body|table|div|p|span)\b"
DISPLAY_NAME = r'"[^"\n]{1,60}"(?=\s*<)'
ATTACHMENT = r"<<[^<>\n]{1,160}>>"
STREET = r"(?iU)\b\d{1,6}\s+(?:[A-Z][\w.'-]+\s+){0,3}(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Drive|Dr|Lane|Ln|Court|Ct|Circle|Cir|Way|Place|Pl|Parkway|Pkwy|Highway|Hwy|Suite|Ste|Floor)\b\.?"
PO_BOX = r"(?iU)\bP\.?\s?O\.?\s*Box\s+\d+\b"
EMAIL = r"(?U)[\w.+-]+@[\w-]+\.[\w.]+"
SSN = r"(?U)\b\d{3}-\d{2}-\d{4}\b"
CARD = r"(?U)\b(?:\d{4}[-\s]?){3}\d{4}\b"
DISCLAIMER_OPEN = r"(?im)^[ \t>*_-]*(?:(?:this|the)\s+(?:e-?mail|message|transmission|communication|information)\b|confidentiality\s+notice|notice\s*:|\*+\s*confidential)"
DISCLAIMER_CONFIRM = r"(?i)(confidential|intended\s+recipient|privileged|received\s+this\s+in\s+error|unauthorized\s+(?:use|review|disclosure)|delete\s+(?:this|the)\s+(?:e-?mail|message))"
DISCLAIMER_INLINE = r"(?i)(intended\s+recipient|received\s+this\s+(?:e-?mail\s+|message\s+)?in\s+error|unauthorized\s+(?:use|review|disclosure|copying|dissemination)|notify\s+the\s+sender\s+immediately)"

#: label, pattern, whether a hit identifies somebody (else it is residue).
AUDIT = [
    ("email address", EMAIL, True),
    ("enron.com address", r"(?iU)[\w.+-]+@enron\.com", True),
    ("phone number", r"(?U)\(?\b\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}\b", True),
    ("URL", r"(?iU)(?:https?://|www\.)[\w./?=&%#-]+", True),
    ("internal address (strict)", INTERNAL_STRICT, True),
    ("internal address (loose)", INTERNAL_LOOSE, True),
    ("phone extension", EXTENSION, True),
    ("attachment stub", ATTACHMENT, False),
    ("confidentiality wording", r"(?i)confidential", False),
    ("'intended recipient'", r"(?i)intended\s+recipient", False),
    ("'received in error'", r"(?i)received\s+this\s+in\s+error", False),
    ("quoted header block", r"(?im)^\s*(?:From|Sent|To|Cc|Bcc|Subject)\s*:.*\r?\n\s*(?:From|Sent|To|Cc|Bcc|Subject)\s*:", False),
    ("'Original Message' bar", r"(?im)^[\s>]*-{2,}\s*original\s+message\s*-{2,}", False),
    ("'Forwarded by'", r"(?i)forwarded\s+by", False),
    ("street address", STREET, True),
    ("PO box", PO_BOX, True),
    ("SSN-shaped", SSN, True),
    ("card-shaped (Luhn)", CARD, True),
]

PLACEHOLDER = {"PERSON": "<PERSON>", "ENRON_INTERNAL_ADDRESS": "<PERSON>", "EMAIL_ADDRESS": "<EMAIL>", "PHONE_NUMBER": "<PHONE>", "PHONE_EXTENSION": "<PHONE>", "URL_STRICT": "<URL>", "STREET_ADDRESS": "<ADDRESS>", "LOCATION": "<LOCATION>", "DATE_TIME": "<DATE>", "US_SSN": "<ID_NUMBER>", "CREDIT_CARD": "<ID_NUMBER>", "IBAN_CODE": "<ID_NUMBER>", "US_PASSPORT": "<ID_NUMBER>", "US_BANK_NUMBER": "<ID_NUMBER>"}

#: Kinds that are looked for unless others are asked for; LOCATION and DATE_TIME are extra.
KINDS = ("PERSON", "EMAIL_ADDRESS", "PHONE_NUMBER", "URL_STRICT", "US_SSN", "CREDIT_CARD", "IBAN_CODE", "US_PASSPORT", "ENRON_INTERNAL_ADDRESS", "PHONE_EXTENSION", "STREET_ADDRESS")

#: kind, pattern, score.
RECOGNIZERS = [
    ("ENRON_INTERNAL_ADDRESS", INTERNAL_STRICT, 0.75),
    ("PHONE_EXTENSION", EXTENSION, 0.6),
    ("PHONE_NUMBER", INTL_PHONE, 0.6),
    ("PHONE_NUMBER", NANP_PHONE, 0.55),
    ("PERSON", DISPLAY_NAME, 0.7),
    ("URL_STRICT", URL_SCHEME, 0.7),
    ("URL_STRICT", URL_BARE, 0.6),
    ("STREET_ADDRESS", STREET, 0.6),
    ("STREET_ADDRESS", PO_BOX, 0.7),
    ("EMAIL_ADDRESS", EMAIL, 1.0),
    ("US_SSN", SSN, 0.85),
    ("CREDIT_CARD", CARD, 0.9),
]

SIGNOFF = r"(?im)^(?:thanks|thank\s+you|regards|best\s+regards|best|sincerely|cheers|yours|take\s+care)[,!.]*[ \t]*\r?\n+([^\n]{1,40})$"
DASH_NAME = r"(?m)^[ \t]*[-–—]{1,2}[ \t]*([A-Za-z][\w.'-]{1,20})[ \t]*$"
NAMEY = r"^[A-Z][\w.'-]*(?:\s+[A-Z][\w.'-]*){0,2}[.!]?$"
GREETING = r"(?i)\b(?:dear|hi|hello|hey|good\s+(?:morning|afternoon|evening))[ ,]+([A-Z][\w'-]+(?:\s+[A-Z][\w'-]+){0,2})"
POSSESSIVE = r"\b([A-Z][a-z]{2,15})['’]s\b"
STOPLIST = {
    "all", "friends", "family", "team", "everyone", "everybody", "folks", "sir", "madam", "colleagues", "customer", "customers", "guys", "there",
    "gentlemen", "ladies", "group", "sirs", "member", "members", "april", "may", "june", "july", "august", "march", "january", "monday", "tuesday",
    "wednesday", "thursday", "friday", "saturday", "sunday", "bill", "mark", "rich", "grant", "will", "art", "chuck", "frank", "jack", "don", "rob",
    "buck", "sue", "gene", "hope", "faith", "max", "ray", "gay", "enron", "houston", "texas", "here", "this", "that", "what", "who", "where", "when",
    "it", "let", "today", "tomorrow", "yesterday", "tonight", "someone", "anyone", "nobody", "people", "company", "corp", "inc", "board", "committee",
    "council", "management", "government", "state", "city", "school", "office", "university", "department", "market", "bank", "client", "year", "week",
    "month", "day", "night", "morning", "afternoon", "evening", "one", "each", "new", "our", "your", "his", "her", "their", "the", "and", "but", "for",
}

IBAN = r"\b[A-Z]{2}\d{2}(?:[ -]?[A-Z0-9]{4}){2,7}(?:[ -]?[A-Z0-9]{1,3})?\b"
PASSPORT = r"(?i)\bpassport\b[^\n]{0,40}?\b([A-Z]?\d{8,9})\b"
DATES = r"(?i)\b(?:\d{4}-\d{2}-\d{2}|\d{1,2}[/.]\d{1,2}[/.](?:\d{4}|\d{2})|(?:\d{1,2}\s+)?(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+(?:\d{4}|\d{1,2}(?:,?\s+\d{4})?))\b"

#: Every rule of the detection: kind, pattern, score, group, what a match has to satisfy, and texts (lower case) of which one has to occur.
RULES = [
    *[(k, p, s, 0, "luhn" if k == "CREDIT_CARD" else "", needs) for (k, p, s), needs in zip(RECOGNIZERS, (("/",), ("x",), ("+",), (), ('"',), ("://", "www."), (".",), (), ("box",), ("@",), ("-",), ()), strict=True)],
    ("IBAN_CODE", IBAN, 1.0, 0, "iban", ()),
    ("US_PASSPORT", PASSPORT, 0.4, 1, "", ("passport",)),
    ("DATE_TIME", DATES, 0.6, 0, "", ()),
    ("PERSON", SIGNOFF, 0.6, 1, "namey", ("thank", "regards", "best", "sincerely", "cheers", "yours", "care")),
    ("PERSON", DASH_NAME, 0.6, 1, "", ("-", "–", "—")),
    ("PERSON", GREETING, 0.65, 1, "unlisted", ("dear", "hi", "hello", "hey", "good")),
    ("PERSON", POSSESSIVE, 0.55, 1, "unlisted", ("'s", "’s")),
]


def python_dialect(pattern: str) -> str:
    """Python's classes are Unicode anyway."""
    return pattern.replace("(?U)", "", 1).replace("(?iU)", "(?i)", 1)
