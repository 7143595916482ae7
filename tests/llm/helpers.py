from pyspark.sql import functions as F

#: Texts that every operator must take: null, empty, blank, one word, repeats, very long.
EDGE = [
    (1, None, "en", "a"),
    (2, "", "en", "a"),
    (3, " \t\n ", None, None),
    (4, "word", "de", "b"),
    (5, "same text of some words here", "en", "a"),
    (5, "same text of some words here", "en", "a"),
    (6, "same text of some words here", "fr", "c"),
    (None, "no id but some words", "en", "a"),
    (7, "lorem ipsum dolor sit amet " * 20_000, "en", "a"),
    (8, "\n\n\n", "es", "a"),
    (9, "éÉß ñ 你好 ſK", "fr", ""),
]
SCHEMA = "doc_id long, text string, lang string, source string"


def edge(spark):
    """The edge texts, with extra columns whose names operators use themselves."""
    df = spark.createDataFrame(EDGE, SCHEMA)
    for name in ("fp", "mark", "size", "row", "w", "gone", "copy", "n_chars"):
        df = df.withColumn(name, F.lit("x"))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


class Groups:
    """Union-find, for brute force."""

    def __init__(self, items):
        self.up = {x: x for x in items}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a
