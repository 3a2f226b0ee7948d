"""Small tables with the awkward rows every operator has to take."""

CLASHING = (
    "key string, words string, n int, fingerprint string, class string, rank int, label string, fp string, "
    "_row string, row string, mark string, _lang_id string, lang_pred string, lang_score string, contamination string"
)


def awkward_docs(spark, texts=()):
    """Null and empty texts, a null id, a repeated row, a very long text, and columns with clashing names."""
    rows = [
        (1, None),
        (2, ""),
        (3, " \t\n"),
        (None, "no id but words here and there"),
        (5, "one"),
        (6, "The QUICK brown fox; É à ü, 日本語 12 34 it's"),
        (6, "The QUICK brown fox; É à ü, 日本語 12 34 it's"),
        (7, "lorem ipsum dolor sit amet " * 8000),
        (8, "!!! ... 123"),
        *((100 + i, t) for i, t in enumerate(texts)),
    ]
    extra = ("k", "w", 1, "f", "c", 2, "l", "p", "_", "r", "m", "i", "lp", "ls", "con")
    return spark.createDataFrame([(*r, *extra) for r in rows], f"doc_id long, text string, {CLASHING}")


def no_docs(spark):
    return spark.createDataFrame([], f"doc_id long, text string, lang string, {CLASHING}")


def lower(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})
