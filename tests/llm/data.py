"""Small tables with the cases that every operator must stand."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash string, q_lang string, kept boolean, size string"

LONG = "one two three four five six seven " * 3000


def edge_docs(spark):
    prose = " ".join(f"word{i} and thing{i * 7}" for i in range(40))
    texts = ["", None, " \t\n", "a", "A", "Hello World", "hello WORLD", "É é", "É é", prose, prose + " x", prose.upper(), LONG, "\U0001f600 x y", "l\nl\nl\n\nm"]
    rows = [(i, t, [None, "en", "fr"][i % 3], [None, "a", "b", "a"][i % 4], None, "h", None, None, "z") for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, "Hello World", "en", "a", 1, None, "q", True, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
