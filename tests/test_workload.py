import xxhash
from pyspark.sql import functions as F

from tidemark.functions import workload as W


def xorshift(state, length):
    out, mask = b"", 2**64 - 1
    state = state or W.ZERO_STATE
    while len(out) < length:
        state ^= state << 13 & mask
        state ^= state >> 7
        state ^= state << 17 & mask
        out += state.to_bytes(8, "little")
    return out[:length]


def test_records_and_validation(spark):
    rows = W.records(spark, 90, 4, 13, 40)
    turn = lambda x, n: (x << n | x >> 64 - n) & 2**64 - 1
    for r in rows.collect():
        assert (r.stream_id, r.seq) == (r.append_order % 4, r.append_order // 4)
        assert bytes(r.metadata) == xorshift(turn(r.stream_id, 17) ^ r.seq ^ W.METADATA_DOMAIN, 13) and bytes(r.payload) == xorshift(turn(r.stream_id, 31) ^ r.seq ^ W.PAYLOAD_DOMAIN, 40)
    assert W.invalid(rows, 13, 40).count() == 0
    bad = rows.withColumn("payload", F.when(F.col("append_order") % 9 == 0, None).otherwise(F.col("payload"))).withColumn("seq", F.when(F.col("append_order") == 1, 99).otherwise(F.col("seq")))
    assert W.invalid(bad, 13, 40).count() == 11


def test_values(spark, tmp_path):
    rows = spark.createDataFrame([(bytearray(b"m"), bytearray(b"pp")), (None, bytearray(b"")), (bytearray(b""), None)], "m binary, p binary")
    got = rows.select(W.encode_value("m", "p").alias("v")).withColumn("d", W.decode_value("v")).collect()
    assert [(bytes(r.d.metadata), bytes(r.d.payload), r.d.error) for r in got] == [(b"m", b"pp", None), (b"", b"", None), (b"", b"", None)]
    long = (9).to_bytes(4, "little") + b"abc"
    bad = [bytearray(bytes(got[0].v)[:-1]), bytearray(b"short"), bytearray(long + xxhash.xxh3_64_intdigest(long).to_bytes(8, "little"))]
    assert [r.d.error for r in spark.createDataFrame([(b,) for b in bad], "v binary").select(W.decode_value("v").alias("d")).collect()] == ["checksum", "truncated", "length"]
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "x").write_bytes(b"123")
    (tmp_path / "a" / "b" / "y").write_bytes(b"4567")
    assert W.file_bytes(spark, str(tmp_path / "a")) == 7
