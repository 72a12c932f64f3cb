"""Patterns of rule-based extraction; Java syntax with Unicode classes.

The capture rules are fixed values: results depend on them letter by letter.
"""

# jurisdiction after "state of" in any case; its first word and an optional second one start upper-case
GOVERNING_LAW = r"(?U)\b(?i:state of) ([A-Z][a-zA-Z]+(?:\s[A-Z][a-zA-Z]+)?)"
# quoted term after an open bracket, "the" or "this"; 2 to 41 characters from an upper-case one; padded quotes allowed
DEFINED_TERM = r'(?U)(?:\(\s*(?:the|this)?\s*|(?:the|this)\s+)["“]\s*([A-Z][A-Za-z0-9 /\-]{1,40}?)\s*["”]'
# the survey's earlier and stricter forms
SURVEY_GOVERNING_LAW = r"(?U)State of ([A-Z][a-zA-Z]+(?:\s[A-Z][a-zA-Z]+)?)"
SURVEY_DEFINED_TERM = r'(?U)\(?\s*(?:the|this)\s+[“"]([A-Z][A-Za-z0-9 /\-]{1,40})[”"]\s*\)?'
MONEY = r"\$[\d,]+(?:\.\d{2})?"
SLASH_DATE = r"\b\d{1,2}/\d{1,2}/\d{2,4}\b"
# a quoted phrase with up to 50 characters before it
QUOTE_CONTEXT = r'(?U)(.{0,50})["“]([A-Z][A-Za-z0-9 /\-]{1,40})["”]'


def for_python(pattern: str) -> str:
    """The pattern without Java's flag; Python's classes are Unicode already."""
    return pattern.removeprefix("(?U)")
