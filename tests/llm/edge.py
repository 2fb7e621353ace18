"""Small tables with what operators must bear."""

SCHEMA = "doc_id long, text string, lang string, n long, score double, piece int, chunk string, component string, word string"


def row(i, text):
    return (i, text, None, 7, None, 3, "x", None, "w")


def awkward(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns with names that operators use themselves."""
    long = "lorem ipsum dolor sit amet consectetur " * 3000
    rows = [row(1, None), row(2, ""), row(3, "   \n\t "), row(4, "short"), row(5, "short"), row(5, "short"), row(6, long), row(7, "z" * 30000), row(8, "añ é 日本 ß\U0001f600"), row(None, "no id at all")]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
