"""Small tables with nulls, empty and very long texts, ties, repeated rows and columns of clashing names."""

from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 997} of{i % 31}" for i in range(60_000))
TEXTS = [
    None, "", " ", "\n\n", "Hello, world! It's a test.\nSecond line", "Hello, world! It's a test.\nSecond line", "a b", "one", "two words",
    "<|endoftext|> inside <|startoftext|>", "tabs\tand  doubled  spaces \n and odd white", "ÉCOLE Straße ĲSSELMEER İstanbul ΣΊΣΥΦΟΣ", "日本語のテキスト です。 שלום नमस्ते",
    "é combining ̸x", "😀😃 emoji 👩‍👩‍👧 zwj", "12345 67.89 1e10 a1b2c3", "don't we'll I'VE they're O'Neil's", "trailing space ", "\u001c control \u0085 next", "x" * 5000, LONG,
    "same line\n" * 50, "the quick brown fox jumps over the lazy dog " * 30,
]


def documents(spark, texts=TEXTS):
    """doc_id is out of order, with gaps; extra columns clash with names that operators use within."""
    rows = [((i * 7919) % 10_007, t, ["en", "de", None][i % 3], f"src{i % 2}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("clash") for c in ("__part", "fp", "n", "start", "class", "component", "count", "key")})


def odd_ids(spark):
    return spark.createDataFrame([(None, "no id"), (5, "twice"), (5, "twice"), (5, "same id, other text"), (-3, "negative id"), (None, None)], "doc_id long, text string")
