"""Small documents with the odd cases: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = "aàé'ſΣİ  \t\n\r   ABcsdtmrelv'''0195²Ⅷ.,!?-_#‍😀日本语\x1c\x85"


def odd_texts(n=120, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def docs(spark, texts, ids=None, lang="en"):
    rows = [(i, t, lang, "src0", len(t) if t is not None else None)
            for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


def clashing(df):
    """Further columns whose names an operator might use itself."""
    from pyspark.sql import functions as F
    for name in ("n_tokens", "key", "ids", "bucket", "block", "kept", "component_id", "length", "rank", "piece",
                 "sequence_id", "rep", "score", "lang_pred", "spans", "n_words"):
        df = df.withColumn(name, F.lit("clash"))
    return df
