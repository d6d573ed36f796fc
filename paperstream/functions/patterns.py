"""Fixed values shared by the column functions and the Arrow stages: patterns, word lists and weights that decide results."""

from __future__ import annotations

# Written forms of amounts and dates. The same text serves Python's and Java's engines.
MONEY = r"(?:\$|USD|RM|MYR)?\s*\(?-?\d[\d,\s<]*(?:[.\-]\d{1,4})?%?\)?"
ISO_DATE = r"\b(?:19|20)\d{2}[-/.]\d{1,2}[-/.]\d{1,2}\b"
US_DATE = r"\b\d{1,2}[-/.]\d{1,2}[-/.](?:\d{2}|\d{4})\b"
MONTH_NAMES = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
MONTH_DATE = (
    r"\b(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
    r"\s+(\d{1,2}),?\s+((?:19|20)\d{2})\b"
)
LOOSE_NUMBER = r"\(?-?\$?\d(?:[\d,\s<]*\d)?(?:[.\-]\d+)?%?\)?"
NUMERIC_TOKEN = r"\(?-?\$?\d[\d,\s]*(?:\.\d+)?%?\)?"
ADDRESS_HINT = (
    r"\b(?:street|st\.?|avenue|ave\.?|road|rd\.?|lane|ln\.?|drive|dr\.?|boulevard|blvd\.?|jalan|lot|suite|ste\.?|unit|po box|city|state|zip|postal)\b"
    r"|\b\d{5}(?:-\d{4})?\b"
)
ADDRESS_STOP = r"\b(?:date|total|tax|invoice|receipt|phone|tel|email)\b"
NUMERIC_KINDS = ("money", "number", "percent")

# How a label's characters may be read, one table for each use.
CONFUSABLE = {"l": "[li1|]", "i": "[li1|]", "o": "[o0qQ]", "s": "[s5]", "v": "[vV]"}
ALIAS_TABLES = {
    "evidence": (r"\s*", CONFUSABLE),
    "ranker": (r"\s*", {**CONFUSABLE, "o": "[o0]"}),
    "truth": (r"\s*", {k: v for k, v in CONFUSABLE.items() if k != "v"}),
    "consensus": (r"\s+", {"l": "[li1|]", "i": "[li1|]", "o": "[o0]", "s": "[s5]"}),
}

# Markers counted by the quality measures.
GATEWAY_MARKERS = ("$", "%", "margin", "risk", "position", "entry", "exit", "stop", "rule")
TOOL_MARKERS = (*GATEWAY_MARKERS, "capital", "loss", "trading", "strategy", "support", "resistance", "volume", "market")
SCORE_MARKERS = ("total", "subtotal", "balance", "assets", "liabilities", "equity", "revenue", "margin", "principal", "interest", "payment", "invoice", "account")
RECEIPT_MARKERS = ("tax invoice", "cash customer", "receipt", "gst", "sst", "cashier", "change due", "sales inclusive", "invoice no")
TEMPLATE_MARKERS = ("financial research document", "financial report", "market analysis", "key indicators", "sales analysis", "profit margins", "net profit", "expenses", "sector performance", "company performance", "abc corp", "xyz inc")

# Ranker weights before training.
RANKER_WEIGHTS = {
    "bias": 0.0, "candidate_confidence": 1.0, "near_requested_label": 0.7, "label_context": 0.2, "line_has_field_name": 0.15, "value_near_field_alias": 1.0,
    "immediate_after_field_alias": 0.75, "labels_between_alias_and_value": -0.5, "has_currency": 0.02, "money_type_without_currency": -1.5,
    "identifier_text_has_digit": 0.9, "identifier_text_without_digit": -1.2, "has_percent": 0.02, "type_percent_match": 0.4, "iso_date_value": 0.25, "line_is_table_like": -0.1,
}

# Receipts.
CORPORATE_SUFFIX = r"(?:SDN\s*(?:BHD|BHO|BND|EHD|GHD)|S/B|S\.B\.|\$B|SB|ENTERPRISE|TRADING|MARKETING|RESTAURANT|MART|STORE|HYPERMARKET)"
RECEIPT_STOP_WORDS = ("TAX", "INVOICE", "RECEIPT", "CASH", "CUSTOMER", "DATE", "TOTAL", "SUBTOTAL", "CHANGE", "AMOUNT", "GST", "SST", "TEL", "PHONE", "FAX", "CO", "NO", "REG")
RECEIPT_TOTAL = r"\b(?:GRAND\s+TOTAL|TOTAL\s+AMOUNT|AMOUNT\s+PAYABLE|NET\s+TOTAL|BALANCE\s+DUE|TOTAL)\b"
RECEIPT_NO_TOTAL = r"\b(?:SUB\s*TOTAL|SUBTOTAL|TOTAL\s+ITEM|ITEM\s+DISCOUNT|QTY|QUANTITY|CHANGE|ROUND\s+AMT)\b"
RECEIPT_STRONG_TOTAL = r"GRAND TOTAL|TOTAL AMOUNT|\bTOTAL\s*[:=]"
RECEIPT_AMOUNT = r"(?:RM|MYR|\$)?\s*([0-9]{1,3}(?:[, ]?[0-9]{3})*|[0-9]+)[.,]([0-9]{2})\b"
RECEIPT_DATE_WORD = r"\b(?:DATE|TARIKH|DTE)\b"
RECEIPT_READ_DATES = (
    r"[0-9OoQDISsl|B]{1,2}\s*[/-]\s*[0-9OoQDISsl|Be]{1,2}\s*[/-]?\s*(?:20)?[0-9OoQDISsl|B]{2,4}",
    r"20[0-9OoQDISsl|B]{2}\s*[/-]\s*[0-9OoQDISsl|B]{1,2}\s*[/-]\s*[0-9OoQDISsl|B]{1,2}",
)
RECEIPT_READ_YEAR = r"20[0-9OoQDISsl|B]{2}"
RECEIPT_BEFORE_REGISTRATION = r"\b(?:DE|THE)?\s*([A-Z][A-Z&' -]{5,60}?)\s+(?:JM|ROC|CO\s*NO|COMPANY\s*REG|REG\s*NO|NO\.?\s*\d|LOT|JALAN|BANDAR|TAMAN)\b"
RECEIPT_BEFORE_SUFFIX = r"([A-Z0-9$&./' -]{2,90}?)\s+"
RECEIPT_COMPANY_FORM = r"\b(?:SDN BHD|SB|ENTERPRISE|TRADING|MARKETING|RESTAURANT|MART|STORE)\b"
RECEIPT_PLACE_IN_NAME = r"\b(?:JALAN|LOT|NO|KM|BANDAR|TAMAN|SELANGOR|JOHOR|KUALA|IPOH)\b"
RECEIPT_ADDRESS_START = r"\b(?:NO\.?|LOT|JALAN|BANDAR|TAMAN|KG|KM)\b"
RECEIPT_ADDRESS_STOP = r"\b(?:TEL|FAX|GST|TAX\s+INVOICE|INVOICE\s+NO|CASHIER|DATE|RECEIPT)\b"
RECEIPT_ADDRESS_MORE = r"\b(?:JALAN|BANDAR|TAMAN|KG|KM|JOHOR|SELANGOR|KUALA|IPOH|BAHRU|KALI|MASAI|PERMAS|JAYA)\b|\b\d{5}\b"
RECEIPT_ADDRESS_SURE = r"\b(?:JALAN|BANDAR|JOHOR|SELANGOR|KUALA|IPOH|BAHRU|PERMAS|JAYA)\b"
RECEIPT_GEO_WORDS = ("JALAN", "BANDAR", "JOHOR", "SELANGOR", "KUALA", "IPOH", "BAHRU", "PERMAS", "JAYA", "LOT", "KG", "KM")
RECEIPT_SPELLINGS = ((r"\bS\s*/\s*B\b", " SB "), (r"\bS\.?\s*B\.?\b", " SB "), (r"\bSDN\s+(?:EHD|BHO|BND|GHD|8HD|BHD)\b", " SDN BHD "), (r"[^A-Z0-9]+", " "))
RECEIPT_DATE_READ = ("OoQDIl|SsBeZz", "0000111558222")
RECEIPT_DAY_FIRST = r"(\d{1,2})\s*[/-]\s*(\d{1,2})\s*[/-]?\s*((?:20)?\d{2,4})"
RECEIPT_YEAR_FIRST = r"(\d{4})\s*[/-]\s*(\d{1,2})\s*[/-]\s*(\d{1,2})"


def alias_regex(alias: str, table: str) -> str:
    """The pattern of a label as OCR may have read it; `table` names one of ALIAS_TABLES."""
    space, letters = ALIAS_TABLES[table]
    return "".join(space if c.isspace() else letters.get(c.lower()) or (c if c.isalnum() or c == "_" or ord(c) > 127 else "\\" + c) for c in alias)


def bounded_alias(alias: str, table: str = "evidence") -> str:
    """alias_regex between characters that are no letters or digits."""
    return rf"(?<![A-Za-z0-9]){alias_regex(alias, table)}(?![A-Za-z0-9])"


# What the measures of quality look for.
TABLE_LABEL_LINE = r"^[A-Z][A-Za-z &/()]{2,35}(?:\s*[:]\s*|\s{2,})\$?-?[\d,]+(?:\.\d+)?(?:\s|$)"
CONFUSED_WORDS = ("tota1", "subtota1", "@", " ee", ",ee")
CONFUSED_FORMS = ((r"\$\d{1,3},\s+\d{3}", 3.0), (r"\b(?:va1ue|lial3ilities|liabilit1es|equlty)\b", 2.0), (r"\$\d[\d,]*\.(?:20|49)\b", 0.75), ("\\$\\S*[Â¢@e]\\S*", 8.0))
CLEAN_FORMS = ((r"\$\d{1,3}(?:,\d{3})*(?:\.\d+)?\b", 8.0), (r"\b\d{4}-\d{2}-\d{2}\b", 5.0), (r"\b\d+(?:\.\d+)?%\b", 5.0))
