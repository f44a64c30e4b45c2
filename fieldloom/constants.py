"""Names, word lists, patterns and formats that results depend on."""

# --- Fixed values: column-header rules, first match wins, needles are bare substrings ---
HEADER_RULES = [
    ("source_table", ["source table", "source_table", "src_table"]),
    ("source_column", ["source column", "source_column", "source field", "source_field", "src_column"]),
    ("target_table", ["target table", "target_table", "tgt_table", "destination table"]),
    ("target_field", ["target column", "target_column", "target field", "target_field", "field", "tgt_column"]),
    ("transformation_rule", ["transformation", "mapping rule", "mapping_rule", "transform", "rule", "mappping"]),
    ("data_type", ["type", "data type", "data_type", "field_type"]),
    ("description", ["description", "desc", "comment"]),
]

# --- Fixed values: words that mark a CSV as a mapping sheet (first five lines) ---
MAPPING_INDICATORS = [
    "source table", "target table", "source column", "target field", "mapping",
    "transformation", "source_table", "target_field", "field", "mappping rules",
]

# --- Fixed values: rule-text classes, first match wins; anything else is moderate ---
COMPLEXITY_RULES = [
    ("simple", ["direct", "copy", "as-is", "no change"]),
    ("moderate", ["lookup", "join", "reference"]),
    ("complex", ["calculate", "compute", "aggregate", "sum", "count"]),
    ("very_complex", ["custom", "function", "procedure", "script"]),
]

# --- Fixed values: header spellings probed for a source column, in order ---
SOURCE_COLUMN_KEYS = [
    "source_column", "Source Column", "source_field", "Source Field",
    "\ufeffSource\xa0Field", "Source\xa0Field", "\ufeffSource Field",
]

# --- Fixed values: page patterns (first match wins within each list) ---
AREA_PATTERNS = [
    r"Functional\s+Area[:\s]+([A-Z][A-Z_]*)",
    r"Area[:\s]+([A-Z][A-Z_]*)",
    r"Domain[:\s]+([A-Z][A-Z_]*)",
]
TABLE_PATTERNS = [
    r"Table[:\s]+([A-Z][A-Z0-9_]*)",
    r"([A-Z][A-Z0-9_]+_DETAIL)",
    r"([A-Z][A-Z0-9_]+_DATA)",
]
FIELD_PATTERNS = [r"([A-Z][A-Z0-9_]{3,})\s+[A-Z]", r"^([A-Z][A-Z0-9_]+)"]

# --- Fixed values: chunk patterns and words ---
CODE_PATTERNS = [r"[A-Z][0-9]+\.[0-9]+", r"[A-Z_]{3,}", r"[A-Z]{2,}_[A-Z_]+"]
CHUNK_AREA_PATTERNS = [r"functional area[:\s]+([A-Z_]+)", r"area[:\s]+([A-Z_]+)", r"domain[:\s]+([A-Z_]+)"]
DICTIONARY_WORDS = ["table", "column", "field", "definition", "description"]
UNIMPORTANT_WORDS = ["Description", "Code", "Table", "Page"]
PAGE_MARKER = r"--- Page (\d+) ---"

# --- Fixed values: sizes and thresholds ---
CHUNK_SIZE, CHUNK_OVERLAP, CHUNK_BREAK = 700, 100, 0.8
CONTENT_SIMILARITY, FIELD_SIMILARITY = 0.7, 0.8
MODEL_CONFIDENCE, MODEL_STRENGTH = 0.6, 0.5
WEAK_EDGE = 0.1
SIMILARITY_BANDS = [(0.9, "Very high similarity"), (0.8, "High similarity"), (0.7, "Moderate similarity")]
LOW_BAND = "Low similarity"
LONG_TEXT = 100

# --- Fixed values: presentation ---
NODE_COLOURS = {"document": "red", "field": "blue", "concept": "green"}
OTHER_COLOUR = "gray"
DEFAULT_NODE_SIZE, NODE_SIZE_SCALE = 10.0, 20.0

# --- Fixed values: staging constants of the claims load ---
CLAIM_TYPE, CLAIM_SOURCE_ID, CLAIM_SLOTS = "A", "CCLF_1", 25
