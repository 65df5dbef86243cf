from shelfwise.streaming.purchases import append_purchases

SCHEMA = "profile_id int, id string, article_idx int, created_at date"


def test_stream_refuses_what_goes_beyond_the_cap(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    (tmp_path / "out" / "counts").mkdir(parents=True)
    rows = spark.sql("select cast(1 + id % 2 as int) profile_id, cast(id as string) id, cast(id as int) article_idx, date'2020-01-01' created_at from range(11)")
    for part in ("id < 6", "id >= 6", "id = 0"):
        rows.filter(part).coalesce(1).write.mode("append").parquet(src)
        q = append_purchases(spark.readStream.schema(SCHEMA).parquet(src), out, str(tmp_path / "cp"), 5)
        q.awaitTermination(60)
        assert q.exception() is None
    got = {(r.profile_id, r.accepted): r["count"] for r in spark.read.parquet(f"{out}/rows").groupBy("profile_id", "accepted").count().collect()}
    # profile 1: 3, then 3 more are refused, then 1; profile 2: 3, then 2
    assert got == {(1, True): 4, (1, False): 3, (2, True): 5}
