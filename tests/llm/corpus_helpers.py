"""Helpers of these tests."""


def prose(rnd, n, vocabulary=400):
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


def more_columns(df):
    """The same rows with further columns of names that operators use themselves."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(7) for c in ("size", "shard", "slot", "key", "k", "word", "score", "path", "blob", "copies", "crc", "bin", "rank", "line", "root", "_gone", "_bad_id", "_bad_key", "_id", "_key", "_one", "_times", "_time", "_nth", "_copies", "_rows", "_doc_id", "_source", "_crc", "_at", "_first", "_counts", "_salt", "_blob", "_path", "_listed", "_s", "_b")})
