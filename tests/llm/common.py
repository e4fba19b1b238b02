from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, n_words string, slice int, part int, text_ int"
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


def docs_of(spark, rows):
    """rows: (doc_id, text[, source]); other columns have names that operators use inside."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "k", "w", 1, 2, 3) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


EDGES = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one two"), (6, "Ünï cödé 漢字 \U0001f600 text"), (7, "same text here and there " * 3), (8, "same text here and there " * 3),
    (8, "same text here and there " * 3), (9, "\x0b\x0c a b c d e f g h i j k l m n o p"), (10, "x" * 5000), (11, "long " * 60000), (12, "nul \x00 byte\r\nline"),
]
