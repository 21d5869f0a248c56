import datetime as dt

from commstream.config import Mode, RunConfig
from commstream.plans import engine
from commstream.sources import edges as reading
from commstream.streaming import maintain as stream


def test_file_stream_maintains_once(spark, tmp_path):
    edges = reading.literal(spark, [(0, 1), (2, 3)])
    fast = RunConfig(mode=Mode.THROUGHPUT)
    state = engine.run(edges, spark.range(4).withColumnRenamed("id", "v"), fast).state
    at = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(1, at, 1, 2, 9), (1, at, 1, 2, 9)], stream.DELTA).write.parquet(str(tmp_path / "in"))
    feed = []
    keeper = stream.Maintainer(state, lambda df: feed.extend(df.collect()), fast)
    keeper.start(stream.once(stream.read_deltas(spark, str(tmp_path / "in"))), str(tmp_path / "check")).awaitTermination(120)
    weights = {(r["src"], r["dst"]): r["w"] for r in keeper.state.levels[0].edges.collect()}
    assert weights == {(0, 1): 1, (2, 3): 1, (1, 2): 9}
    assert feed
