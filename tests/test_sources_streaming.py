import datetime as dt
import math

from pyspark.sql import functions as F

from factloom.operators.texts import LoaderConfig
from factloom.sources import io
from factloom.streaming import ingest


def test_facts_csv_round_trip(spark, tmp_path):
    data = [("node", "a", 'quote " and \\ and\nline', "x, y", 0.5, True), ("node", "", None, "é", math.nan, False), ("relation", "b", "f", "e", None, None)]
    facts = spark.createDataFrame(data, "type string, name string, fact string, evidence string, score double, accepted boolean")
    assert io.write_facts_csv(facts.withColumn("more", F.lit(1)), str(tmp_path / "f"))
    back = {r.evidence: r for r in io.read_facts_csv(spark, str(tmp_path / "f")).collect()}
    assert back["x, y"].fact == data[0][2] and back["é"].name is None and math.isnan(back["é"].score) and back["e"].score is None
    assert not io.write_facts_csv(facts.limit(0), str(tmp_path / "none")) and not (tmp_path / "none").exists()
    assert io.read_texts(spark, str(tmp_path / "f"), "csv", "fact").count() == 3


def test_graph_sink_is_an_upsert(spark, tmp_path):
    nodes = spark.createDataFrame([(1, 1, "a", "P", "Ann", None), (2, 2, "a", "P", None, "u"), (2, 3, None, "P", "x", None)], "chunk_id long, pos long, id string, label string, name string, wiki_url string")
    rels = spark.createDataFrame([(1, "a", "R", "b"), (2, "a", "R", "b"), (2, "a", None, "b")], "chunk_id long, src_id string, rtype string, tgt_id string")
    docs = spark.createDataFrame([(1, "t"), (1, "t"), (2, "u")], "chunk_id long, page_content string")
    places = io.write_graph(nodes, rels, docs, str(tmp_path / "g"), properties=["name", "wiki_url"])
    read = {k: spark.read.parquet(p) for k, p in places.items()}
    assert [tuple(r) for r in read["nodes"].select("label", "id", "name", "wiki_url").collect()] == [("P", "a", "Ann", "u")]
    assert read["edges"].count() == 1 and read["docs"].count() == 2 and read["mentions"].count() == 2
    io.write_canonical_map(spark.createDataFrame([("P", "a", "b")], "label string, name string, canonical string"), str(tmp_path / "m"), "json")
    assert spark.read.json(str(tmp_path / "m")).count() == 1


def test_stream_is_cleaned_deduplicated_and_cut(spark, tmp_path):
    at = dt.datetime(2025, 1, 1, tzinfo=dt.timezone.utc)
    data = [(1, "Apple one " * 60, at), (2, "Apple one " * 60, at), (3, None, at), (4, "other", at), (5, "apple two", at)]
    spark.createDataFrame(data, "k long, text string, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, text string, ts timestamp").parquet(str(tmp_path / "in"))
    clean = ingest.clean_stream(stream, "k", "ts", "1 hour", LoaderConfig(keywords=["apple"]))
    seen = []
    query = ingest.upsert_sink(ingest.chunk_stream(clean, "k", 32, 3), str(tmp_path / "c"), lambda df, _: seen.extend(df.collect()))
    query.awaitTermination(120)
    assert len({r.idx for r in seen}) == 2 and len(seen) > 2
    counts = []
    windows = ingest.windowed_counts(stream, "ts", "1 day", "1 hour", "k").writeStream.outputMode("complete").option("checkpointLocation", str(tmp_path / "d"))
    windows.trigger(availableNow=True).foreachBatch(lambda df, _: counts.extend(df.collect())).start().awaitTermination(120)
    assert sum(r.n for r in counts) == 5
