"""Small tables with the awkward cases that every operator meets."""

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def awkward(spark):
    """Nulls in every column, empty and blank texts, a long text, ties, repeated rows, clashing extra columns."""
    long = " ".join(f"word{i % 977} and the of" for i in range(30_000))
    rows = [
        (1, "the cat and the dog sat on the mat of a house by the sea", "en", "a", 1),
        (2, "the cat and the dog sat on the mat of a house by the sea", "en", "a", 1),
        (2, "the cat and the dog sat on the mat of a house by the sea", "en", "a", 1),
        (3, "", "en", "b", 0),
        (4, " \t\n ", None, "b", None),
        (5, None, "de", None, None),
        (None, "der hund und die katze sind in dem haus und auf der matte", "de", None, 9),
        (None, None, None, None, None),
        (7, long, "en", "c", len(long)),
        (8, "1234 5678 !!", "fr", "c", 12),
        (9, "Ünïcödé ñandú 漢字 🙂", None, "é", 18),
    ]
    plain = spark.createDataFrame(rows, DOC_SCHEMA)
    # names that the operators use themselves
    clash = ("n_words", "score", "key", "size", "node", "kept", "__cut", "lang_pred", "part", "place", "bucket", "class_id")
    return plain.selectExpr("*", *[f"'x' AS `{c}`" for c in clash])


def empty(spark):
    return awkward(spark).limit(0)
