"""Documents with every awkward case at once: nulls, empty and very long texts, ties, repeats, clashing column names."""

from pyspark.sql import functions as F

NAMES = "score fp rep component_id hub shard slot key size h n chunk first remove n_lines n_card __m ids start length sequence_id offset keep place label bucket payload media clips".split()
LONG = " ".join(f"word{k % 977} of sentence {k}." for k in range(40_000))
ROWS = [
    (1, "Alpha beta gamma. Delta says no! Really?"), (2, None), (3, ""), (None, "x y z"), (5, LONG), (6, "A b C"), (6, "A b C"), (7, "A b C"), (8, "  \n\t "),
    (9, "é 東京 <|endoftext|> don't stop\r\nnow 2024-02-29 4111 1111 1111 1111"), (10, None), (11, "a"), (-4, "Alpha beta gamma. Delta says no! Really?"),
]


def docs(spark, rows=ROWS, clash=True):
    out = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for k, name in enumerate(NAMES if clash else []):
        out = out.withColumn(name, F.lit(None).cast("string") if k % 2 else F.lit(k))
    return out


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")
