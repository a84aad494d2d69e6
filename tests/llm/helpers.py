"""Small inputs that every operator must take."""

from __future__ import annotations

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
EMBEDDINGS = "vec_id long, embedding array<float>, label int"
PAGES = "page_id long, url string, html string"
CONVERSATIONS = "conv_id long, turn long, role string, text string"


def documents(spark, rows, schema=DOCUMENTS):
    """Rows of (doc_id, text[, lang]) as a documents table."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", None, None) for r in rows]
    return spark.createDataFrame(full, schema)


def write(df, folder, name):
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)
