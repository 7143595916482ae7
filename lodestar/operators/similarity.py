"""Similar topics: a theta join done as one equi-join on what similar texts must share."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Kinds of keys: two tokens that both sets hold, the only token of a right set, the only token of a left set.
_TWO, _RIGHT, _LEFT = range(3)


def _keys(df: DataFrame, key: str, text: str, name: str, each: int, alone: int) -> DataFrame:
    """(name, kind, x, y): every two tokens of a text; every token as `each`, the token of a set of one as `alone` too.

    A set of n tokens gives about n * n / 2 rows (8 words of a title: 36), made one token at a time.
    """
    sets = df.select(F.col(key).alias(name), F.array_sort(T.topic_tokens(F.col(text))).alias("s"))
    tokens = sets.select(name, "s", F.posexplode("s").alias("i", "x"))
    single = lambda kind: F.struct(F.lit(kind).alias("kind"), F.lit("").alias("y"))
    later = F.transform(F.slice("s", F.col("i") + 2, F.size("s")), lambda y: F.struct(F.lit(_TWO).alias("kind"), y.alias("y")))
    singles = F.when(F.size("s") == 1, F.array(single(each), single(alone))).otherwise(F.array(single(each)))
    return tokens.select(name, "x", F.explode(F.concat(singles, later)).alias("k")).select(name, "k.kind", "x", "k.y")


def _both(left: DataFrame, right: DataFrame, left_key: str, left_text: str, right_key: str, right_text: str) -> tuple[DataFrame, DataFrame]:
    return _keys(left, left_key, left_text, "left_id", _RIGHT, _LEFT), _keys(right, right_key, right_text, "right_id", _LEFT, _RIGHT)


def similar_pairs(left: DataFrame, right: DataFrame, left_key: str, left_text: str, right_key: str, right_text: str) -> DataFrame:
    """(left_id, right_id) of all rows with similar texts.

    Two token sets are similar if they share at least two tokens, or all of one that has
    only one. So they are if and only if they share a key of _keys(): no candidate needs to
    be verified, and common words meet only where the result holds the pair.
    """
    a, b = _both(left, right, left_key, left_text, right_key, right_text)
    return a.join(b, ["kind", "x", "y"]).select("left_id", "right_id").distinct()


def _similar_ids(left: DataFrame, right: DataFrame, left_key: str, left_text: str, right_key: str, right_text: str) -> DataFrame:
    """left_id of the rows similar to any on the right: a semi-join on distinct keys, without pairs."""
    a, b = _both(left, right, left_key, left_text, right_key, right_text)
    return a.join(b.select("kind", "x", "y").distinct(), ["kind", "x", "y"], "left_semi").select("left_id").distinct()


def anti_similar(cands: DataFrame, history: DataFrame, key: str, text: str, used_key: str, used_text: str) -> DataFrame:
    """Candidates whose text is similar to no used one."""
    found = _similar_ids(cands, history, key, text, used_key, used_text)
    return cands.join(found, F.col(key) == F.col("left_id"), "left_anti")


def semi_similar(cands: DataFrame, history: DataFrame, key: str, text: str, used_key: str, used_text: str) -> DataFrame:
    """Candidates whose text is similar to some used one."""
    found = _similar_ids(cands, history, key, text, used_key, used_text)
    return cands.join(found, F.col(key) == F.col("left_id"), "left_semi")


def similar_long_pairs(left: DataFrame, right: DataFrame, left_key: str, left_text: str, right_key: str, right_text: str) -> DataFrame:
    """As similar_pairs(), with as many keys as a text has tokens: for texts, where two at a time would be too many.

    Sets of which one has a single token meet on it. Others are similar if they share two
    tokens. All tokens stand in one order, by how many texts have them; of two that both
    sets hold the rarer is in neither the last, so sets meet on all tokens but their
    commonest, and the pairs found are compared. A token that very many texts have is
    hardly ever looked up by a short text, and is left to AQE to split where it is. Tokens
    that the other side lacks link nothing and go before anything is ranked.
    """
    named = lambda df, key, text, name: df.select(F.col(key).alias(name), F.array_distinct(T.topic_tokens(F.col(text))).alias("s")).filter(F.size("s") > 0)
    a, b = named(left, left_key, left_text, "left_id").distinct(), named(right, right_key, right_text, "right_id").distinct()
    tokens = lambda df, name: df.select(name, F.xxhash64("s").alias("of"), F.size("s").alias("n"), F.explode("s").alias("x"))
    each_a, each_b = tokens(a, "left_id"), tokens(b, "right_id")
    held = lambda each, other: each.join(other.select("x").distinct(), "x", "left_semi")
    each_a, each_b = held(each_a, each_b), held(each_b, each_a)
    times = each_a.select("x").union(each_b.select("x")).groupBy("x").agg(F.count("*").alias("times"))

    def prefix(each: DataFrame, name: str) -> DataFrame:
        """Keys: single tokens as such, of the others all but the commonest."""
        commonest = Window.partitionBy(name, "of").orderBy(F.desc("times"), F.desc("x"))
        ranked = each.join(times, "x").withColumn("place", F.row_number().over(commonest))
        return ranked.filter((F.col("n") == 1) | (F.col("place") > 1)).select(name, "n", "x")

    few = lambda each: each.filter("n = 1")
    short = few(each_a).select("left_id", "x").join(each_b.select("right_id", "x"), "x").select("left_id", "right_id")
    short = short.union(each_a.select("left_id", "x").join(few(each_b).select("right_id", "x"), "x").select("left_id", "right_id"))
    long_a, long_b = (prefix(e.filter("n > 1"), name).select(name, "x") for e, name in ((each_a, "left_id"), (each_b, "right_id")))
    met = long_a.join(long_b, "x").select("left_id", "right_id").distinct()
    whole = met.join(a.withColumnRenamed("s", "s_a"), "left_id").join(b.withColumnRenamed("s", "s_b"), "right_id")
    alike = whole.filter(F.size(F.array_intersect("s_a", "s_b")) >= 2).select("left_id", "right_id")
    return short.union(alike).distinct()


#: Folders that the keys of used topics are kept in.
CELLS = 64


def _celled(keys: DataFrame) -> DataFrame:
    return keys.withColumn("cell", F.pmod(F.xxhash64("kind", "x", "y"), F.lit(CELLS)).cast("int"))


def index_topics(topics: DataFrame, path: str, batch: int, topic: str = "topic") -> None:
    """Keep the keys of used topics at path, under the batch's number and in folders by their hash; a batch written again replaces itself."""
    keys = _keys(topics, topic, topic, "right_id", _LEFT, _RIGHT).select("kind", "x", "y").distinct()
    _celled(keys).hint("rebalance", "cell").write.partitionBy("cell").mode("overwrite").parquet(f"{path}/batch={batch}")


def used_keys(cands: DataFrame, path: str, before: int, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(keys of the candidates, keys of the topics used before that batch): of the index only the folders that the candidates' keys fall into.

    The list of folders that the driver gets is bounded by their number.
    """
    own = _celled(_keys(cands, key, text, "left_id", _RIGHT, _LEFT))
    cells = sorted(r["cell"] for r in own.select("cell").distinct().collect())
    kept = cands.sparkSession.read.schema("kind int, x string, y string, batch long, cell int").parquet(path)
    return own, kept.filter((F.col("batch") < before) & F.col("cell").isin(cells))


def anti_indexed(cands: DataFrame, path: str, before: int, key: str, text: str) -> DataFrame:
    """As anti_similar(), against the index of the topics used before a batch."""
    own, used = used_keys(cands, path, before, key, text)
    found = own.join(used.select("kind", "x", "y").distinct(), ["kind", "x", "y"], "left_semi").select("left_id").distinct()
    return cands.join(found, F.col(key) == F.col("left_id"), "left_anti")
