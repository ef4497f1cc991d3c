"""They decide results and must stay exactly as they are."""

SCHEMA_VERSION = 1
PROJECT_SCHEMA_VERSION = 3
SOURCE_BLOCK_VERSION = "source-block-v4"
SOURCE_QA_VERSION = "source-qa-local-v5"
GLOSSARY_BUILD_VERSION = "glossary-candidates-local-v2"
TERMBASE_IMPORT_VERSION = "termbase-import-v1"
TRANSLATION_RUN_VERSION = "translation-run-v1"
TRANSLATION_REVIEW_VERSION = "translation-review-v2"
POSTPROCESS_VERSION = "column-continuation-v3"

IMAGE_ROOT = "01_input/images"
OUTPUT_ROOT = "05_output"
COMBINED_OUTPUT = "combined_kor.txt"

SOURCE_TYPES = ("pdf", "image")
BLOCK_STATUSES = ("raw", "flagged", "corrected", "approved")
LEGIBILITY = ("clear", "uncertain")
SEVERITIES = ("error", "warning", "info")
SEGMENT_STATUSES = ("translated", "flagged")
LAYOUT_TYPES = ("heading", "paragraph", "list_item", "caption", "label", "page_number", "artifact")
OCR_TYPES = ("title", "heading", "body", "label", "identifier", "footer", "other")
GLOSSARY_STATUSES = ("review", "approved", "keep", "rejected")
GLOSSARY_CATEGORIES = ("term", "proper_noun", "ability", "component", "ui", "phrase")
GLOSSARY_COLUMNS = (
    "status", "source_term", "translation", "category", "note",
    "variants", "occurrences", "locations", "example", "candidate_id",
)
ACTIVE_JOB_STATUSES = ("queued", "running")
TERMINAL_JOB_STATUSES = ("succeeded", "partial", "failed", "interrupted")
IMAGE_SUFFIXES = ("png", "jpg", "jpeg", "webp")

# Word lists of term extraction.
CONNECTORS = ("of", "the", "and", "for", "to", "in", "on", "from", "with", "&")
ARTICLES = ("a", "an", "the")
STOPWORDS = (
    "a", "an", "and", "any", "are", "as", "at", "be", "been", "before", "by", "can", "during", "each", "for", "from",
    "had", "has", "have", "he", "her", "his", "if", "in", "into", "is", "it", "its", "may", "must", "no", "not", "of",
    "on", "or", "our", "she", "that", "the", "their", "them", "then", "there", "these", "they", "this", "those", "to",
    "up", "was", "were", "when", "while", "with", "without", "you", "your", "chapter", "contents", "example",
    "examples", "figure", "display", "feature", "following", "game", "games", "name", "note", "only", "overview",
    "page", "represent", "rulebook", "side", "setup", "table", "unique", "used", "using", "version", "will",
)
HEADING_TYPES = ("title", "heading", "ability", "identifier", "label")
COMPONENT_WORDS = (
    "board", "card", "cards", "counter", "deck", "die", "dice", "icon", "marker",
    "miniature", "pile", "slot", "slots", "tile", "token", "track",
)
UI_TYPES = ("identifier", "label", "ui")

# English number words and their digits.
NUMBER_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6",
    "seven": "7", "eight": "8", "nine": "9", "ten": "10", "eleven": "11", "twelve": "12",
    "thirteen": "13", "fourteen": "14", "fifteen": "15", "sixteen": "16", "seventeen": "17",
    "eighteen": "18", "nineteen": "19", "twenty": "20",
}

# Patterns, in Java syntax.
TOKEN = r"\{([A-Za-z][A-Za-z0-9_]*)\}"
CURLY = r"\{[A-Za-z][A-Za-z0-9_]*\}"
SQUARE = r"\[[^\]\n]+\]"
HTML_TAG = r"</?[^>\n]+>"
NUMBER = r"[0-9]+(?:[.,][0-9]+)*%?"
ICON = r"(?i)\[ICON:\s*[^\]]+\]"
ALNUM_WORD = r"(?<![A-Za-z0-9])[A-Za-z0-9]+(?:[/-][A-Za-z0-9]+)*(?![A-Za-z0-9])"
IDENTIFIER = r"^[A-Za-z0-9]+(?:[._/-][A-Za-z0-9]+)*$"
IMAGE_FILE = r"(?i)\b([A-Za-z][A-Za-z0-9_]*)\.(?:png|jpe?g|webp|gif|bmp)\b"
TERM_WORD = r"[A-Za-z][A-Za-z0-9'’\-]*"
SEGMENT_SPLIT = r"[\n.!?;:,()\[\]{}]+"
QUANTITY_PREFIX = r"(?i)(?<![A-Za-z0-9])[0-9]+\s*[x×](?=\s|\z)"
LIST_ENUMERATOR = r"^\s*[0-9]+[A-Za-z]?\.\s*"
ROMAN = r"^[ivxlcdm]+$"
BLOCK_ID = r"^[a-z0-9][a-z0-9._-]*$"
SHA256_HEX = r"^[a-f0-9]{64}$"
SHA256_PREFIXED = r"^sha256:[a-f0-9]{64}$"
ISSUE_ID = r"^qa-[a-f0-9]{16}$"
ISSUE_CODE = r"^[A-Z][A-Z0-9_]+$"
LANGUAGE_CODE = r"^[A-Za-z]{2,8}(?:-[A-Za-z0-9]{1,8})*$"
HANGUL = "[가-힣]"
LATIN = "[A-Za-z]"
WORD_RUN = r"[\p{L}\p{N}_]+"

REPLACEMENT_CHAR = "�"
ILLEGIBLE = "[ILLEGIBLE]"
MAX_BLOCK_CHARS = 5000
EVIDENCE_CHARS = 240
RECOVERY_PREFIX = "AI 레이아웃 정렬 누락 복구"
RECOVERY_SUFFIX = "원본 이미지에서 위치와 순서를 확인하세요."
HYPHEN_PREFIX = "줄바꿈 하이픈 결합 확인"
EMPTY_MULTISET = "없음"
KEEP_PLACEHOLDER = "{KEEP_%04d}"

# Review file markers. Files written with an upper-case marker prefix ("[[ABC_END id]]") are read too.
SOURCE_REVIEW_HEADER = "[[REVIEW version=2]]"
SOURCE_REVIEW_HEADERS = r"^\[\[(?:[A-Z]+_)?REVIEW version=[12]\]\]$"
TRANSLATION_REVIEW_HEADER = "[[TRANSLATION_REVIEW version=1]]"
TRANSLATION_REVIEW_HEADERS = r"^\[\[(?:[A-Z]+_)?TRANSLATION_REVIEW version=1\]\]$"
REVIEW_SEPARATOR = "======================"
FINAL_SEPARATOR = "----------------------"
BLOCK_MARKER = r"^\[BLOCK ([a-z0-9][a-z0-9._-]*)\]$"
END_MARKER = r"^\[\[(?:[A-Z]+_)?END (.+)\]\]$"

NON_OVERRIDABLE = ("empty_translation",)
MAX_OVERRIDE_REASON = 1000

STAGE_PROGRESS = {
    "not_started": 0, "source_review": 25, "glossary": 40, "glossary_review": 55,
    "ready_to_translate": 70, "translation_partial": 78, "translation_review": 88,
    "translation_qa_failed": 88, "completed": 100,
}

WINDOWS_RESERVED = (
    "CON", "PRN", "AUX", "NUL",
    "COM1", "COM2", "COM3", "COM4", "COM5", "COM6", "COM7", "COM8", "COM9",
    "LPT1", "LPT2", "LPT3", "LPT4", "LPT5", "LPT6", "LPT7", "LPT8", "LPT9",
)
