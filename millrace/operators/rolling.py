"""Rolling slot counts and trending rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import rankings
from .positions import numbered


def slot_counts(df: DataFrame, word: str, slot: str, slots: int) -> DataFrame:
    """word, slot, n: at the end of each slot (whole numbers), how often a word came in the last slots of them. A word
    that has gone is there once with 0, and only while slots still pass (up to the last slot of all)."""
    if slots < 2:
        raise ValueError("at least 2 slots")
    own = df.groupBy(F.col(word).alias("word"), F.col(slot).cast("long").alias("at")).agg(F.count("*").alias("n"))
    last = own.agg(F.max("at").alias("__last"))  # one row
    each = own.join(F.broadcast(last), F.lit(True)).select("word", "n", F.explode(F.expr(f"sequence(at, least(at + {slots}, __last))")).alias("slot"), "at")
    return each.groupBy("word", "slot").agg(F.sum(F.when(F.col("slot") - F.col("at") < slots, F.col("n")).otherwise(0)).alias("n")).select("word", "slot", "n")


def tuple_counts(df: DataFrame, word: str, seq: str, slots: int) -> DataFrame:
    """word, slot, n: slot_counts() with each row as a slot of its own, numbered by place, so that every arrival gives
    the counts over the last slots rows."""
    return slot_counts(numbered(df.select(seq, word), seq, name="__place"), word, "__place", slots)


def rolling_counts(df: DataFrame, word: str, ts: str, window: str = "10 seconds", slide: str = "1 second", delay: str | None = None) -> DataFrame:
    """word, start, end, n over sliding windows of time; on streams too, then with a watermark of delay."""
    df = df.withColumn(ts, F.col(ts).cast("timestamp"))
    df = df.withWatermark(ts, delay) if delay else df
    return df.groupBy(F.window(ts, window, slide).alias("w"), F.col(word).alias("word")).agg(F.count("*").alias("n")).select("word", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def trending(df: DataFrame, word: str, ts: str, k: int = 10, window: str = "10 seconds", slide: str = "1 second") -> DataFrame:
    """end, words, counts: the k most frequent words of every window."""
    return rankings(rolling_counts(df, word, ts, window, slide), k, ["end"])


def running_counts(df: DataFrame, word: str, seq: str) -> DataFrame:
    """seq, word, n: how often each row's word has come so far."""
    return numbered(df.select(seq, F.col(word).alias("word")), seq, "word", "n")
