"""A chunk store over files that come, change and stay."""

import os

import pytest

from lectern.sources import store
from lectern.streaming.ingest import new_folder

FILES = "path string, content binary"


def pages(content):
    return content.decode().split("\f")


def lengths():
    return lambda texts: [[float(len(text))] for text in texts]


def written(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names}


@pytest.fixture
def place(spark):
    return new_folder(spark, "test-store")


def run(spark, place, files, **kwargs):
    rows = [(f"raw/{name}", text.encode()) for name, text in files.items()]
    return store.ingest(spark.createDataFrame(rows, FILES), place, pages, lengths, buckets=4, **kwargs)


def held(spark, place):
    return {(r["document_title"], r["page_number"]): (r["content"], r["embedding"]) for r in store.read(spark, place).collect()}


def test_only_changed_files_are_read_and_only_their_buckets_written(spark, place):
    files = {f"Rules {k} Section {'ABCDEF'[k % 6]}.txt": f"Article {k} says a thing.\fSecond page of {k}." for k in range(12)}
    assert run(spark, place, files) == 1
    first = held(spark, place)
    assert len(first) == 24 and all(vector == [float(len(content))] for content, vector in first.values())
    before = written(place)
    assert run(spark, place, files) == 1
    assert written(place) == before

    files["Rules 3 Section D.txt"] = "Article 3 says another thing."
    files["New Section A.txt"] = ""
    assert run(spark, place, files) == 2
    after = held(spark, place)
    assert after[("Rules 3 Section D", 1)][0].endswith("another thing.") and ("Rules 3 Section D", 2) not in after
    assert {k: v for k, v in after.items() if k[0] != "Rules 3 Section D"} == {
        k: v for k, v in first.items() if k[0] != "Rules 3 Section D"
    }
    new = {os.path.dirname(p) for p in written(place) if "version=000000000002" in p and "bucket=" in p}
    assert len(new) <= 2
    assert all(written(place)[p] == t for p, t in before.items())
    told = {r["document_title"]: (r["page_count"], r["chunk_count"], r["read_in"]) for r in store.documents(spark, place).collect()}
    assert told["Rules 3 Section D"] == (1, 1, 2) and told["Rules 4 Section E"] == (2, 2, 1)
    assert told["New Section A"] == (1, 0, 2)
    counts = store.summary(spark, place).first()
    assert (counts["document_count"], counts["page_count"], counts["chunk_count"]) == (13, 24, 23)


def test_a_version_without_manifest_is_not_seen(spark, place):
    files = {"One Section A.txt": "Article 1 stays."}
    run(spark, place, files)
    # A run that ended before its manifest leaves a bucket behind.
    store.read(spark, place).write.parquet(os.path.join(place, "data", "version=000000000002", "bucket=0"))
    assert len(held(spark, place)) == 1
    files["One Section A.txt"] = "Article 1 goes."
    assert run(spark, place, files) == 2
    assert [content for content, _ in held(spark, place).values()] == ["Article 1 goes."]


def test_nothing_and_one_title_twice(spark, place):
    assert run(spark, place, {}) == 0
    assert store.read(spark, place).count() == 0 and store.documents(spark, place).count() == 0
    assert run(spark, place, {"a/Same.txt": "Article 1 first.", "b/Same.txt": "Article 1 second."}) == 1
    assert [content for content, _ in held(spark, place).values()] == ["Article 1 second."]
    assert run(spark, place, {"a/Same.txt": "Article 1 first.", "b/Same.txt": "Article 1 second."}) == 1


def test_the_manifest_is_as_long_as_there_are_buckets_not_files(spark, place):
    files = {f"Rules {k} Section A.txt": f"Article {k} says a thing." for k in range(30)}
    assert run(spark, place, files) == 1
    manifest = os.path.join(place, "manifest", "version=000000000001")
    assert [n.endswith(".parquet") for n in os.listdir(manifest) if n.startswith("part-")] == [True]
    assert spark.read.parquet(manifest).count() <= 4 + 1
    assert store.documents(spark, place).count() == 30


def test_a_manifest_with_its_files_in_it_is_read_on(spark, place):
    files = {f"Rules {k} Section A.txt": f"Article {k} says a thing." for k in range(5)}
    run(spark, place, files)
    version, named = store.manifest(spark, place)
    rows = spark.createDataFrame(named.collect(), store.MANIFEST)
    rows.coalesce(1).write.mode("overwrite").parquet(os.path.join(place, "manifest", f"version={version:012d}"))
    assert run(spark, place, files) == 1
    files["Rules 2 Section A.txt"] = "Article 2 says another thing."
    assert run(spark, place, files) == 2
    told = {r["document_title"]: r["read_in"] for r in store.documents(spark, place).collect()}
    assert told == {f"Rules {k} Section A": 2 if k == 2 else 1 for k in range(5)}
