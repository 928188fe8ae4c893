"""Small hostile tables for the training-data operators."""

import random

from pyspark.sql import types as T

#: Names the operators use inside, as extra columns of the input.
EXTRA = (
    "score start stop fp size key words label rank blob n uid part digest root node component_id shard findings q one windows spans "
    "_key _blob _findings _row _n _d _s _t _take _size _copies _share _part _place _first _digest _rows _slice _bits other_columns"
).split()

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        *[T.StructField(name, T.StringType()) for name in EXTRA],
    ]
)

SYLLABLES = "an be ci do er fa go hi ja ko lu mé na or pü qu ra so ti un".split()


def prose(rng: random.Random, words: int) -> str:
    found = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 4))) for _ in range(words)]
    return "\n".join(" ".join(found[i : i + 12]).capitalize() + "." for i in range(0, words, 12))


def rows(seed: int = 5, count: int = 40):
    """Documents with nulls everywhere, empty, one-word and long texts, copies, near copies and repeated rows."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randrange(4, 120)) for _ in range(count)]
    texts += ["", None, "word", " \t\n", "x" * 3000, texts[0], texts[0], texts[1] + " End", texts[2].upper(), prose(rng, 6000), "日本語 テキスト 😀", "a  b\r\nc"]
    out = [(i * 3, t, "en", f"s{i % 4}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    out += [out[3], out[3], (None, texts[4], None, None, None), (None, "nobody", "en", "s1", 6)]
    return out


def documents(spark, data=None, extra: bool = True):
    data = rows() if data is None else data
    schema = SCHEMA if extra else T.StructType(SCHEMA.fields[:5])
    return spark.createDataFrame([(*r, *(EXTRA if extra else [])) for r in data], schema).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
