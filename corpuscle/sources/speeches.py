"""Parliamentary speeches: a generated sample, and a paged web source with an injected fetcher."""

from __future__ import annotations

import hashlib
import json
import os
import random
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corpuscle.operators.corpus import Corpus
from corpuscle.sources.readers import clean_html

FIELDS = ("text", "speaker", "member_id", "party", "date", "debate_title", "house", "speech_id")
SCHEMA = "text string, speaker string, member_id long, party string, date string, debate_title string, house string, speech_id string"
PARTIES = ("Blue", "Red", "Gold", "Green")
TOPICS = {
    "immigration": (["migrants arriving at the border", "asylum seekers and the law", "workers who came to build"], ["control of our borders", "a fair system for newcomers", "small boats crossing"]),
    "economy": (["growth and jobs in every region", "the cost of borrowing", "wages for working people"], ["the deficit must be cut", "investment in industry", "inflation hurts families"]),
    "health": (["nurses and doctors on our wards", "waiting times for patients", "hospital beds"], ["mental health services", "a pandemic and its lessons", "social care reform"]),
    "climate": (["carbon emissions and the planet", "clean energy from wind", "flood defences"], ["net zero by law", "heat pumps in homes", "the climate emergency"]),
}


def generate(spark: SparkSession, seed: int = 20260522) -> Corpus:
    """Made-up speeches, ten a year from 2005 to 2023 and one more in 2016, 2017 and 2019.

    Each has one of four topics; the frames of a topic change around 2015.
    """
    rng, rows = random.Random(seed), []
    for year in range(2005, 2024):
        for _ in range(10 + (year in (2016, 2017, 2019))):
            topic = rng.choice(sorted(TOPICS))
            late = rng.random() < (0.15 if year < 2015 else 0.85)
            frame = rng.choice(TOPICS[topic][late])
            party = rng.choice(PARTIES)
            text = f"I rise to speak about {topic}. We must consider {frame}, and I ask the House to think of {frame} again. This matters to my constituents."
            rows.append((len(rows) + 1, text, topic, "late" if late else "early", party, f"{year}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", year))
    df = spark.createDataFrame(rows, "speech_id long, text string, topic string, frame string, party string, date string, year int")
    return Corpus(df, "text", "speech_id")


def parse(payload: str | dict) -> tuple[list[dict], int]:
    """(rows of FIELDS, number of results) of one page, whichever of their usual names the fields have."""
    got = json.loads(payload) if isinstance(payload, str) else payload
    items = next((got[k] for k in ("Results", "Contributions", "results", "items") if isinstance(got.get(k), list)), [])
    first = lambda x, *names: next((x[n] for n in names if x.get(n) not in (None, "")), None)
    rows = []
    for x in items:
        text = first(x, "ContributionTextFull", "ContributionText", "Text", "text")
        if text is None:
            continue
        member = first(x, "MemberId", "member_id")
        rows.append({
            "text": text, "speaker": first(x, "AttributedTo", "MemberName", "speaker"), "member_id": int(member) if member is not None else None,
            "party": first(x, "Party", "party"), "date": str(first(x, "SittingDate", "date") or "")[:10] or None, "debate_title": first(x, "DebateSection", "DebateTitle", "debate_title"),
            "house": first(x, "House", "house"), "speech_id": str(first(x, "ContributionExtId", "ItemId", "id") or "") or None,
        })
    return rows, int(first(got, "TotalResultCount", "TotalContributions", "total") or len(rows))


class SpeechSource(DataSource):
    """spark.read.format("speeches"): one partition a page; option "fetcher" names module:function(url params) -> JSON."""

    @classmethod
    def name(cls) -> str:
        return "speeches"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        size, most = int(self.options.get("page_size", 50)), int(self.options.get("max_results", 100))
        return [InputPartition((skip, min(size, most - skip))) for skip in range(0, most, size)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        module, _, name = self.options["fetcher"].partition(":")
        fetch = getattr(__import__(module, fromlist=[name]), name)
        skip, take = partition.value
        query = {k: v for k, v in self.options.items() if k not in ("fetcher", "page_size", "max_results", "path")}
        rows, _ = parse(fetch(query | {"skip": skip, "take": take}))
        for r in rows[:take]:
            yield tuple(r[f] for f in FIELDS)


def fetch_speeches(
    spark: SparkSession, search_term: str, start_date: str, end_date: str, fetch: Callable[[dict], str | dict], max_results: int = 100, page_size: int = 50,
    cache_dir: str | None = None, parties: Callable[[int], str | None] | None = None,
) -> Corpus:
    """Pages through a source until max_results; with a cache folder, a query is asked for once."""
    query = {"searchTerm": search_term, "startDate": start_date, "endDate": end_date}
    key = hashlib.sha256(json.dumps([query, max_results, page_size], sort_keys=True).encode()).hexdigest()
    path = os.path.join(cache_dir, key + ".parquet") if cache_dir else None
    if path and os.path.exists(path):
        df = spark.read.parquet(path)
    else:
        rows: list[dict[str, Any]] = []
        while len(rows) < max_results:
            got, total = parse(fetch(query | {"skip": len(rows), "take": min(page_size, max_results - len(rows))}))
            rows += got
            if not got or len(rows) >= total:
                rows = rows[:total]
                break
        df = spark.createDataFrame([tuple(r[f] for f in FIELDS) for r in rows[:max_results]], SCHEMA).withColumn("text", clean_html(F.col("text")))
        if path:
            df.write.mode("overwrite").parquet(path)
            df = spark.read.parquet(path)
    return Corpus(with_party(df, parties) if parties else df, "text", "speech_id")


def with_party(df: DataFrame, lookup: Callable[[int], str | None]) -> DataFrame:
    """Each different member is looked up once; what is known already stays."""
    ids = [r[0] for r in df.filter("party is null and member_id is not null").select("member_id").distinct().collect()]
    if not ids:
        return df
    table = df.sparkSession.createDataFrame([(i, lookup(i)) for i in ids], "member_id long, _party string")
    return df.join(F.broadcast(table), "member_id", "left").withColumn("party", F.coalesce("party", "_party")).drop("_party").select(*df.columns)
