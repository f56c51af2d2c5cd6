"""The adapters keep whole tables and whole texts: every turn reaches the chat
samples, every document becomes one translation row whose target is the
full text, and the consecutive-user case comes from relabelling, not from
dropping turns."""

from pyspark.sql import functions as F

from paraspark.plans import adapters as A


def test_every_turn_is_kept(spark, sf_small):
    conv = spark.read.parquet(f"{sf_small}/conversations.parquet")
    turns = A.turns(spark, sf_small)
    assert turns.count() == conv.count()
    in_samples = A.raw_mix(spark, sf_small).select(F.sum(F.size("messages"))).first()[0]
    assert in_samples == conv.count()
    # some assistant turns were relabelled, none removed
    relabelled = (conv.join(turns.select("conv_id", "turn", F.col("role").alias("r2")), ["conv_id", "turn"])
                  .filter((F.col("role") == "assistant") & (F.col("r2") == "user")).count())
    assert relabelled > 0


def test_translation_targets_are_whole_texts(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    tr = A.translations(spark, sf_small)
    assert tr.count() == docs.count()
    assert tr.filter(F.length("target_text") != F.length("source_text")).count() == 0
    assert tr.filter(F.upper(F.translate("target_text", A.ASCII_UPPER, A.ASCII_LOWER))
                     != F.upper("source_text")).count() == 0


def test_epoch_millis_ignores_session_time_zone(spark):
    import datetime
    df = spark.createDataFrame([(datetime.datetime(2024, 1, 2, 3, 4, 5, 6000),)], "ts timestamp_ntz")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        got = []
        for tz in ("UTC", "America/New_York", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            got.append(df.select(A.epoch_millis(df, "ts")).first()[0])
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == [1704164645006] * 3
