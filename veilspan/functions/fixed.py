"""Fixed values that results depend on: patterns, word lists, limits. All are stated as they are applied.

The patterns are written in the part of regular expressions that both Java (Spark) and RE2 (DuckDB) read; ``\\z`` is
the end of the text, ``\\p{Nd}`` any decimal digit.
"""

# --- limits of a dialable number (E.164)
MIN_PHONE_DIGITS = 7
MAX_PHONE_DIGITS = 15
LEFT_CONTEXT = 40

# --- strict address shape
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"

# --- first pass: where to look, and what is a number by its shape
PHONE_CANDIDATE = r"\+?\(?\p{Nd}[\p{Nd} \t().\-–—]{4,}\p{Nd}"
PHONE_SHAPES = (
    r"\(\p{Nd}{3}\)[ .\-]?\p{Nd}{3}[ .\-]?\p{Nd}{4}",
    r"\p{Nd}{3}[ .\-]\p{Nd}{3}[ .\-]\p{Nd}{4}",
    r"\p{Nd}{5}[ .\-]\p{Nd}{5}",
    r"\p{Nd}{4}[ .\-]\p{Nd}{3}[ .\-]\p{Nd}{3}",
    r"\p{Nd}{4}[ .\-]\p{Nd}{6}",
    r"0\p{Nd}{2}[ .\-]\p{Nd}{4}[ .\-]\p{Nd}{4}",
    r"[6-9]\p{Nd}{9}",
)

# --- labels flush against a number, at the end of its left context
PHONE_LABEL = (
    r"(?i)(?:^|[^A-Za-z])(?:phone|mobile|mob|cell|cellular|tel|telephone|contact|whatsapp|ph|mo|m|t|c)"
    r"[ \t]*(?:no\.?|num(?:ber)?|#)?[ \t]*[:\-|–—]?[ \t]*\z"
)
ID_LABEL = (
    r"(?i)(?:^|[^A-Za-z])"
    r"(?:id|ids|credential|cert(?:ificate)?|licen[cs]e|roll|reg(?:istration)?|enrol(?:l)?ment|seat|batch|badge"
    r"|pan|gst(?:in)?|tin|aadha?ar|uidai|passport|visa|ssn|invoice|order|ref(?:erence)?|txn|transaction|iso"
    r"|iec|ieee|rfc|ansi|astm|isbn|issn|doi|orcid|patent|pin(?:code)?|zip|postal|postcode|acc(?:ount|t)?|ifsc|swift"
    r"|iban|routing|employee|emp|staff|student|matric|score|rank|marks"
    r"|salary|ctc|package|budget|revenue|ver(?:sion)?|v|build|release|sku|part|model|serial|code)"
    r"[ \t]*(?:no\.?|num(?:ber)?|code|id|#)?[ \t]*[:\-|–—]?[ \t]*\z"
)

# --- second pass
NATIONAL_DIGITS = 10
NATIONAL_PREFIXES = ("0091", "091", "91", "0")
MOBILE_FIRST = "6789"
RESIDUAL_RUN = r"[(+]{0,2}\p{Nd}[\p{Nd} \t()+.\-–—]*\p{Nd}"
RESIDUAL_SHAPES = (
    r"\(\p{Nd}{3}\)[ .\-]?\p{Nd}{3}[ .\-]?\p{Nd}{4}",
    r"\p{Nd}{3}[ .\-]\p{Nd}{3}[ .\-]\p{Nd}{4}",
    r"0\p{Nd}{2}[ .\-]\p{Nd}{4}[ .\-]\p{Nd}{4}",
    r"0\p{Nd}{1,4}[ .\-]\p{Nd}{6,8}",
)
DATE_RUN = r"^\p{Nd}{1,2} ?[.\-–—] ?\p{Nd}{1,2} ?[.\-–—] ?\p{Nd}{2,4}\z"

# --- addresses with injected blanks or spelled-out signs (Java only: look-around)
AT_TOKEN = r"(?i)[ \t]*(?:@|[(\[]\s*at\s*[)\]])[ \t]*"
DOT_TOKEN = r"(?i)[ \t]*(?:\.|[(\[]\s*dot\s*[)\]])[ \t]*"
LOOSE_EMAIL = (
    r"(?i)(?<![A-Za-z0-9._%+\-])"
    r"(?:[A-Za-z0-9._%+\-]+(?:[ \t]+\.[ \t]*[A-Za-z0-9._%+\-]+|[ \t]*\.[ \t]+[A-Za-z0-9._%+\-]+){0,4})"
    r"[ \t]*(?:@|[(\[]\s*at\s*[)\]])[ \t]*"
    r"(?:[A-Za-z0-9\-]+(?:[ \t]*(?:\.|[(\[]\s*dot\s*[)\]])[ \t]*[A-Za-z0-9\-]+){1,5})"
    r"(?![A-Za-z0-9\-])"
)
KNOWN_TLDS = (
    "com net org edu gov mil int in co io ai me us uk ca au nz de fr nl es it se ch"
    " jp cn sg ae sa qa om kw bh my ph id th vn hk tw kr ru br za ng ke"
    " info biz name pro mobi xyz online site tech dev app live cloud email"
).split()
FILE_EXTENSIONS = (
    "png jpg jpeg gif svg webp bmp ico pdf doc docx xls xlsx ppt pptx zip rar tar gz"
    " exe dll html htm js jsx css scss json xml csv txt yml yaml"
).split()
CONTACT_SCHEMES = "mailto tel callto sms fax whatsapp".split()

# --- values that are known to be contact details
PHONE_STRING = r"^[+()\p{Nd} \t.\-–—/]+\z"
PHONE_RUN = r"\+?\p{Nd}(?:[\p{Nd} ().\-]*\p{Nd})?"
LIST_SPLIT = r"\s{2,}|[,;/|\n\r]+|\s+(?=\+)"

# --- labels around a value on a page
LABEL_SEPARATORS = r"\s.:\-–—#|/+()\[\]"
LABEL_WORDS = (
    r"e[-_\s]?mail|email|mail|phone|mobile|mob|cell(?:ular)?|tel(?:ephone)?|contact|cont|whats?[\s-]?app|ph|landline|fax|skype"
    r"|linked[\s-]?in|telegram|alt(?:\.|ernat(?:e|ive))?|second(?:ary)?|primary|personal|official|office|work|home"
    r"|res(?:idence|idential)?|permanent|current|present|candidate|applicant|self|father|mother|husband|wife|spouse|guardian"
    r"|parent|son|daughter|id|ids|i\.?d\.?|address|addr|detail(?:s)?|info(?:rmation)?|no|nos|num(?:ber)?"
)
LABEL_PART = r"(?:" + LABEL_WORDS + r")(?:['’]s)?"
LABEL_RUN = LABEL_PART + r"(?:[\s._'’-]*" + LABEL_PART + r"){0,4}"
CONTACT_LABEL = (
    r"(?i)^[" + LABEL_SEPARATORS + r"]*(?:" + LABEL_RUN + r")[" + LABEL_SEPARATORS + r"]*\z"
    r"|^[" + LABEL_SEPARATORS + r"]+\z"
    r"|^[" + LABEL_SEPARATORS + r"]*e[" + LABEL_SEPARATORS + r"]*\z"
    r"|^\s*[(\[]\s*(?:" + LABEL_WORDS + r"|[mrowhp])\s*[)\]][" + LABEL_SEPARATORS + r"]*\z"
)
LABEL_CONNECTOR = r"(?i)^[" + LABEL_SEPARATORS + r"]*(?:of|the|for|and|to|my|our|&)[" + LABEL_SEPARATORS + r"]*\z"
GLUED_LABEL = r"(?i)^(?:e[-\s]?mail|email|mail|mob(?:ile)?|ph(?:one)?|tel|contact|whats?app|id|no|alt|res)?[\s.:\-–—#|()+]+"
GLUED_TAIL = r"[.,;:|/\\\-–—)\]}>·•~*_]+\z"

# --- page geometry, in points or shares of a page
LABEL_MAX_GAP = 200.0
LABEL_MAX_WORDS = 6
BRIDGE_MAX_GAP = 24.0
MARK_COVERAGE = 0.7
MARK_OVERHANG = 24.0
PAGE_MARK_RATIO = 0.25
LABEL_ABOVE_LINES = 1.4
CORNER_LEFT, CORNER_BOTTOM, CORNER_MAX_AREA, WORD_ON_IMAGE = 0.6, 0.3, 0.2, 0.5
OCR_IMAGE_SHARE, OCR_TEXT_CHARS, OCR_MIN_CONFIDENCE = 0.30, 100, 20
WINDOW_WORDS, WINDOW_SLACK = 6, 4
OPEN_ROWS = 3

# --- jobs
TRANSIENT = (
    "code: 502", "code: 503", "code: 504", "down for maintenance", "retry your request", "upstream request time",
    "server is busy", "temporarily unavailable", "request_limit_exceeded",
)
TRANSIENT_NEVER = ("invalid_login", "invalid_grant")
#: Kinds of failure that no retry mends, whatever they say.
FINAL_KINDS = ("missing_file", "missing_credentials", "unknown_client")
#: Parameters that may carry record ids have one of these in their name, and are none of the others.
ID_PARAMETERS = ("id", "applicant", "record", "profile")
NOT_ID_PARAMETERS = ("uname", "sfurl", "orgurl", "username", "user")
LEASE_SECONDS, JOB_SECONDS, WIDTH = 900, 7 * 24 * 3600, 10
FILE_RANK = ("pdf", "docx", "doc")
MASKED_PREFIX = "masked_"
