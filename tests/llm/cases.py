"""Texts with everything that operators must take: nulls, empty and long ones, repeats, and columns of clashing names."""

SCHEMA = "doc_id long, text string, id string, row int, k0 int, words string, shard int, score double, lang string, source string, n_chars long"
LONG = "Long words and more of them, 12 times. " * 8000
TEXTS = [
    (3, "The quick brown fox jumps over the lazy dog near the old river bank at noon."),
    (1, "The quick brown fox jumps over the lazy dog near the old river bank at noon."),
    (None, "The quick brown fox jumps over the lazy dog near the old river bank at noon."),
    (None, None),
    (4, None),
    (5, ""),
    (5, ""),
    (6, "été déjà à Noël, straße, 漢字 🙂\u0000\u0085 end"),
    (7, LONG),
    (8, "one two"),
    (9, "x"),
    (9, "another text of the same id"),
    (10, "!!! ... ???"),
]


def table(spark):
    rows = [(i, t, "id", 1, 2, "w", 3, 0.5, "en" if k % 2 else None, "s", len(t or "")) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
