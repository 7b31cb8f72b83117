"""Fixed values of the engine, in one place."""

# Thresholds of sniffing, escalation, cleaning and compression.
MARKUP_RATIO = 0.2
MIN_YIELD_CHARS_PER_PAGE = 200
TABLE_ROW_NUMERIC_CLUSTERS = 3
TABLE_DEGRADATION_MIN_ROWS = 2
REMOVAL_SHARE, REMOVAL_TOKENS = 0.25, 200
CHROME_CHARS, COPYRIGHT_CHARS = 300, 200
DUPLICATE_WINDOW = 200
STRUCTURE_MIN_SENTENCES, STRUCTURE_MIN_REQUIREMENTS, STRUCTURE_MAX_GROWTH = 3, 2, 1.25
HEAD_SHARE, HEAD_MAX, TAIL_SHARE, TAIL_MAX = 0.25, 2000, 0.15, 1000
MIN_SECTION_TOKENS, MAX_SHRINK, MIN_TARGET = 24, 0.5, 10
PREVIEW_CHARS = 72
MAX_CHARS, MAX_BYTES = 1_000_000, 25 * 1024 * 1024
RATE_WINDOW, RATE_CALLERS = "60 seconds", 10_000
ENTRY_BYTES, ARCHIVE_BYTES = 50 * 1024 * 1024, 200 * 1024 * 1024

#: prefix of anchors and markers in Markdown comments
MARKER = "docloom"

SUMMARIZABLE = ("paragraph", "list", "blockquote", "figure")
REPEATABLE = ("paragraph", "list", "blockquote")
VERBATIM = ("heading", "table", "code")

MIME = {
    "prompt": "text/plain", "email": "message/rfc822", "html": "text/html", "csv": "text/csv", "json": "application/json",
    "office": "application/vnd.openxmlformats-officedocument", "pdf": "application/pdf", "image": "image/*", "unknown": "application/octet-stream",
}

#: provider, least cacheable prefix, breakpoint style, breakpoints, read factor, write premium
CACHE_PROFILES = [
    ("anthropic", 1024, "explicit", 4, 0.1, 0.25),
    ("openai", 1024, "automatic", 0, 0.5, 0.0),
    ("gemini", 1024, "automatic", 0, 0.25, 0.0),
    ("kimi", 1024, "automatic", 0, 0.1, 0.0),
]
OFFICE_EXTENSIONS = ["docx", "xlsx", "pptx", "doc", "xls", "ppt", "msg", "epub", "odt", "ods", "odp"]
IMAGE_EXTENSIONS = ["png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp", "gif"]
