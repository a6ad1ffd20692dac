import glob
import random
import time

from laddersmith.llm import suffix_dedup
from laddersmith.session import made, materialize
from pyspark.sql import functions as F


def test_runs_that_stand_alone(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    passage = word(600)
    texts = [word(3000) for _ in range(30)] + [word(500) + passage + word(400), word(700) + passage + word(100)]
    rows = {}

    def counted(df, name):
        out = materialize(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(suffix_dedup, "materialize", counted)
    before = made(spark)
    out = suffix_dedup.repeated_spans(spark.createDataFrame(list(enumerate(texts)), "key long, text string"), 200, 48)
    spans = {r.key: suffix_dedup._merge(*(suffix_dedup.np.array(x) for x in zip(*r.spans, strict=True))) for r in out.collect()}
    assert {k: (s.tolist(), e.tolist()) for k, (s, e) in spans.items()} == {30: ([500], [1100]), 31: ([700], [1300])}
    assert rows["repeat-variants"] < rows["repeat-runs"] / 10  # runs that share no anchor are counted once and go no further
    left = [p for p in made(spark) - before if glob.glob(p.removeprefix("file:").replace("//", "/") + "/*")]
    assert [p.rpartition("/")[2].rpartition("-")[0] for p in left] == ["repeat-spans"]


def test_shuffle_files_go_with_the_write(spark):
    jvm = spark.sparkContext._jvm
    disk = jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f.getName() for f in jvm.scala.jdk.javaapi.CollectionConverters.asJava(disk.getAllFiles()) if f.getName().startswith("shuffle_")}
    before = files()
    out = materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("g")).count(), "groups")
    end = time.time() + 5
    while files() - before and time.time() < end:
        time.sleep(0.1)
    assert not files() - before
    assert out.count() == 7
