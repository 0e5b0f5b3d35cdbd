"""SRC-7: framing of HTTP requests in connections' buffers, by bytes, as string functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "\r\n\r\n"
#: STR-8: a connection's buffer holds so many bytes; one that is full without a whole request is closed.
BUFFER = 8192


def as_bytes(raw: Column) -> Column:
    """Text with one character for each byte of a string or binary column, so that positions are those of bytes."""
    return F.decode(raw.cast("binary"), "ISO-8859-1")


def content_length(headers: Column) -> Column:
    """SC-16: the first Content-Length anywhere, whatever its case; 0 without."""
    return F.coalesce(F.regexp_extract(headers, "(?i)content-length: *([0-9]*)", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


_FRAMES = "array<struct<kind:string,start:int,body_start:int,body_end:int,stop:int>>"


def buffers(connections: DataFrame, raw: str, *keys: str) -> DataFrame:
    """STR-7: keys, `bytes` (the buffer), `frames` (its whole requests in order, with byte positions), `consumed`, `left`
    and `closed`.  The path is never looked at; any POST scores and needs its whole body, any GET is a readiness check, all else is bad
    and closes the connection, what follows unread.  A full buffer without a whole request closes it too."""
    rows = connections.select(*keys, F.coalesce(as_bytes(F.col(raw)), F.lit("")).alias("bytes"))
    text = F.col("bytes")

    def step(s: Column, _: Column) -> Column:
        at = s["at"]
        end = F.call_function("locate", F.lit(END), text, at + 1)  # from 1; 0 if there is none
        head = F.substring(text, at + 1, end + 3 - at)
        post = F.startswith(head, F.lit("POST"))
        body_end = F.when(post, end + 3 + F.least(content_length(head), F.lit(1 << 30)).cast("int")).otherwise(end + 3)
        kind = F.when(post, "score").when(F.startswith(head, F.lit("GET")), "ready").otherwise("bad")
        whole = ~s["done"] & (end > 0) & (body_end <= F.length(text))
        one = F.struct(kind.alias("kind"), at.alias("start"), (end + 3).alias("body_start"), body_end.alias("body_end"), body_end.alias("stop"))
        return F.struct(
            F.when(whole, body_end).otherwise(at).alias("at"), (~whole | (kind == "bad")).alias("done"), F.when(whole, F.concat(s["frames"], F.array(one).cast(_FRAMES))).otherwise(s["frames"]).alias("frames")
        )

    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("done"), F.array().cast(_FRAMES).alias("frames"))
    most = F.sequence(F.lit(0), F.regexp_count("bytes", F.lit(END)))  # no more requests than ends of headers, and one to see the rest
    rows = rows.withColumn("found", F.aggregate(most, start, step))
    bad = F.exists("found.frames", lambda x: x["kind"] == "bad")
    left = F.length("bytes") - F.col("found.at")
    return rows.select(*keys, "bytes", F.col("found.frames").alias("frames"), F.col("found.at").alias("consumed"), left.alias("left"), (bad | (left >= BUFFER)).alias("closed"))


def frame(connections: DataFrame, raw: str, *keys: str) -> DataFrame:
    """Keys, seq (from 0), kind (`score`, `ready` or `bad`), body (of a `score`, as text) and bytes consumed of every whole request in a buffer."""
    each = buffers(connections, raw, *keys).select(*keys, "bytes", F.posexplode("frames").alias("seq", "f"))
    body = F.when(F.col("f.kind") == "score", F.encode(F.substring(F.col("bytes"), F.col("f.body_start") + 1, F.col("f.body_end") - F.col("f.body_start")), "ISO-8859-1").cast("string"))
    return each.select(*keys, "seq", F.col("f.kind").alias("kind"), body.alias("body"), (F.col("f.stop") - F.col("f.start")).alias("consumed"))


def remainder(connections: DataFrame, raw: str, *keys: str) -> DataFrame:
    """Keys, consumed and left (bytes), whether the connection is closed, and `rest`, the binary to which its next bytes are appended."""
    rest = F.encode(F.substring(F.col("bytes"), F.col("consumed") + 1, F.col("left")), "ISO-8859-1")
    return buffers(connections, raw, *keys).select(*keys, "consumed", "left", "closed", F.when(~F.col("closed"), rest).alias("rest"))


def response(kind: Column, body: Column) -> Column:
    """SNK-2, SNK-3: the whole response to a request; `body` is that of a score."""
    json = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: application/json\r\nConnection: keep-alive\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body)
    return F.when(kind == "score", json).when(kind == "ready", F.lit("HTTP/1.1 200 OK\r\nContent-Length: 2\r\nConnection: keep-alive\r\n\r\nOK")).when(kind == "bad", F.lit("HTTP/1.1 400 Bad Request\r\nContent-Length: 0\r\nConnection: close\r\n\r\n"))
