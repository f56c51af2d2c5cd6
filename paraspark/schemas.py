"""Schemas and fixed values.

Everything under "FIXED VALUES" must equal the behaviour being reproduced
(language codes, markers, word lists, sentinels); it is stated once, here.
"""

from __future__ import annotations

from pyspark.sql.types import (ArrayType, DoubleType, IntegerType, LongType, MapType,
                               StringType, StructField, StructType)

# --------------------------------------------------------------------------
# FIXED VALUES
# --------------------------------------------------------------------------

# Translation directions kept from the chat mixture.
KEPT_DIRECTIONS = ["en_dr", "fr_dr", "dr_fr", "dr_en"]

# Language alias table applied after lower-casing (anything else passes through).
LANGUAGE_ALIAS = {"darija": "dr"}

# Short code -> model language code used in the training export.
MODEL_LANG_CODE = {"dr": "ary_Arab", "fr": "fra_Latn", "en": "eng_Latn"}

# Legal language codes of the translation table.
TABLE_LANGS = ["fr", "en", "dr"]

# Text length bounds of the translation table (characters).
TEXT_MIN_CHARS = 1
TEXT_MAX_CHARS = 500

# Conversation markers inside one message.
USER_MARK = "<|user|>"
ASSISTANT_MARK = "<|assistant|>"

# Instruction prefix: the word, any characters up to the first colon, then
# whitespace. Only the line feed stops the "any characters" part.
PREFIX_WORD = "ترجم"

# The one full instruction prefix removed by the length profile.
FULL_PREFIX = "ترجم من الفرنساوية للدارجة:"

# Target written when a scraped translation is missing.
MISSING_TARGET = "Traduction non disponible"

# Label that is never a valid candidate translation.
SENTINEL_LABEL = "Marocain"

# Error marker prefix of a failed candidate.
ERROR_PREFIX = "Erreur:"

# Interrogative words of the question/statement classifier, in order.
INTERROGATIVES = ["comment", "pourquoi", "quand", "où", "qui", "quel", "quelle", "quels", "quelles",
                  "combien", "est-ce", "what", "why", "when", "where", "who", "which", "how", "can",
                  "could"]

# Labels of the classifier.
QUESTION = "Question"
STATEMENT = "Affirmation"

# Arabic block used by the script detector.
ARABIC_RANGE = (0x0600, 0x06FF)

# Direction preference of the training preprocessing.
TRAIN_SOURCE_LANG = "fra_Latn"
TRAIN_TARGET_LANG = "ary_Arab"

# Fixed encoding length, split fraction and seeds of the training stage.
SEQ_LEN = 128
TEST_FRACTION = 0.1
SPLIT_SEED = 42
EVAL_CAP = 1000
PREVIEW_K = 10
QUESTION_BATCH = 20
CHECKPOINT_KEEP = 3

# Test-row prefix removed by the cleanup query.
TEST_PREFIX = "Test "

# --------------------------------------------------------------------------
# Whitespace: every character for which Python's str.isspace() is true.
# Derived by rule so that the set always equals that definition.
# --------------------------------------------------------------------------

WS_CHARS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def _ranges(codes):
    out, start, prev = [], None, None
    for c in codes:
        if start is None:
            start = prev = c
        elif c == prev + 1:
            prev = c
        else:
            out.append((start, prev))
            start = prev = c
    if start is not None:
        out.append((start, prev))
    return out


# Regex character class (Java and RE2 both read \x{h..h}).
WS_CLASS = "[" + "".join(
    f"\\x{{{a:x}}}" if a == b else f"\\x{{{a:x}}}-\\x{{{b:x}}}"
    for a, b in _ranges([ord(c) for c in WS_CHARS])) + "]"

ARABIC_CLASS = f"[\\x{{{ARABIC_RANGE[0]:x}}}-\\x{{{ARABIC_RANGE[1]:x}}}]"

# --------------------------------------------------------------------------
# Input schemas (never inferred on production paths)
# --------------------------------------------------------------------------

MESSAGE = StructType([StructField("content", StringType()), StructField("role", StringType())])
PAIR = StructType([StructField("texte_cible", StringType()), StructField("traduction", StringType())])

RAW_MIX_SCHEMA = StructType([
    StructField("dataset", StringType()),
    StructField("id", StringType()),
    StructField("messages", ArrayType(MESSAGE)),
    StructField("direction", StringType()),
    StructField("metadata", StringType()),
])

RAW_MIX_CSV_SCHEMA = StructType([
    StructField("dataset", StringType()),
    StructField("id", StringType()),
    StructField("messages", StringType()),
    StructField("direction", StringType()),
    StructField("metadata", StringType()),
])

BLOCKS_SCHEMA = StructType([
    StructField("direction", StringType()),
    StructField("pairs", ArrayType(PAIR)),
])

SCRAPED_ITEM = StructType([
    StructField("source_lang", StringType()),
    StructField("source", StringType()),
    StructField("target_lang", StringType()),
    StructField("target", StringType()),
])
SCRAPED_SCHEMA = StructType([StructField("translations", ArrayType(SCRAPED_ITEM))])

TRANSLATION_SCHEMA = StructType([
    StructField("id", LongType()),
    StructField("source_lang", StringType()),
    StructField("source_text", StringType()),
    StructField("target_lang", StringType()),
    StructField("target_text", StringType()),
])

PAIR_COLUMNS = ["source_lang", "source_text", "target_lang", "target_text"]

TRAINING_SCHEMA = StructType([StructField("translation", MapType(StringType(), StringType()))])

SHEET_SCHEMA = StructType([
    StructField("id", IntegerType()),
    StructField("Questions ou Affirmations", StringType()),
    StructField("langue", StringType()),
])

METRIC_LOG_SCHEMA = StructType([
    StructField("ts_ms", LongType()),
    StructField("value", DoubleType()),
    StructField("step", LongType()),
])

CARD_SCHEMA = (
    "id STRING, author STRING, description STRING, lastModified STRING, gated BOOLEAN, "
    "disabled BOOLEAN, downloads BIGINT, likes BIGINT, tags ARRAY<STRING>, "
    "cardData STRUCT<license: STRING, metrics: ARRAY<STRING>, task_categories: ARRAY<STRING>, "
    "size_categories: ARRAY<STRING>>, files MAP<STRING, MAP<STRING, ARRAY<STRING>>>, "
    "siblings ARRAY<STRUCT<rfilename: STRING>>"
)


# folder name that stands for a blank partition value (this library's own)
BLANK_FOLDER = "__BLANK__"
