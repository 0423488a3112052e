"""Labels, limits and templates that decide results.

They must equal what existing corpora and result files use, so that results
compare; each is also a parameter of the operator that uses it.
"""

# --- fixed values: defaults of missing metadata ---
NO_TITLE = "제목 없음"
NO_CATEGORY = "분류없음"
NO_ENTITY = "부서없음"
GENERAL_CATEGORY = "일반"
UNKNOWN_DOCUMENT = "unknown"

# --- fixed values: chunk text layout ---
HEADER_LAYOUT = "[%s - %s] %s"
CHUNK_PREFIX = "문서정보: "
CHUNK_BODY_MARK = "\n\n내용:\n"
PAGE_TAG = r'(?s)(.*?)<page doc_id="(.*?)" num="(.*?)"></page>'
PAGE_PATTERN = r"(\d+(?:-\d+)+)[~∼](\d+)"
FILE_ID_PATTERN = r"(\d+(?:-\d+)+)"

# --- fixed values: source labels ---
MERGED_SOURCE_LAYOUT = "[공지사항-%s] %s"
NODE_SOURCE_LAYOUT = "[공지-%s] %s"
NOTICE_MARK = "[공지사항"
SOURCE_ID_PATTERN = r"\]\s*(\d+)"

# --- fixed values: sentinels and placeholders ---
NO_ANSWER = "정답 없음"
EMPTY_ANSWER = "No answer provided."
EMPTY_CONTEXT = "No context retrieved."
EMPTY_TRUTH = "No ground truth available."
FAILED_ANSWER = "생성 실패"
ERROR_MARKS = ("API Error",)
SOURCES_MARK = "📚"
PAGES_TITLE = "\n\n📍 **TV-RAG Traceability (Notice Vision):**\n"
NO_PAGES_TITLE = "\n\n📍 **TV-RAG (텍스트 전용 폴백):**\n"
NO_PAGES_LINE = "- (이미지 로그 없음 — 본문 기반 응답)"
CONTEXT_RULE = "=" * 40
YEAR_BLOCK_SEPARATOR = "\n\n---\n\n"

# --- fixed values: sizes ---
MIN_CHUNK_LENGTH = 50
MAX_CHUNK_SIZE = 800
RRF_K = 60
RRF_DEPTH = 50
LOW_TEXT_LENGTH = 5
LABEL_CONTEXT_LENGTH = 120
SCORE_TO_ACCEPT = 0.8
MAX_PASSES = 2
MEDIA_CAP = 10
SPARSE_DROP_RATIO = 0.2

# --- fixed values: store limits per column, in UTF-8 bytes ---
NOTICE_LIMITS = {
    "chunk_id": 100, "parent_id": 100, "year": 20, "category": 500,
    "target": 1000, "entity": 500, "chunk_text": 65535,
}
RULE_LIMITS = {"doc_id": 100, "text": 65535, "source": 500}

# --- fixed values: media kinds ---
IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".webp", ".gif", ".bmp")
PDF_EXTENSION = ".pdf"

# --- fixed values: token cost rates (tokens per character, tokens per chunk,
# price per million input and output tokens, currency rate) ---
TOKENS_PER_CHARACTER = 1.5
TOKENS_PER_CHUNK = 50
INPUT_RATE = 0.150
OUTPUT_RATE = 0.600
CURRENCY_RATE = 1350

# --- fixed values: (candidates, kept) of each search use ---
SEARCH_PRESETS = {
    "multi": (10, 10),
    "rules": (10, 3),
    "notice": (50, 10),
    "local": (30, 3),
    "rules_bench": (15, 3),
    "text_node": (50, 3),
    "vision_node": (50, 25),
    "comparison": (30, 7),
    "refill": (50, 5),
}

# --- fixed value: what stands before a question in a training row ---
QUESTION_PREFIX = "질문: "
