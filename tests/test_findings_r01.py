"""Places where the code once did less than the whole job."""

import html
import json
import re

from corpuscle.plans import queries
from corpuscle.plans.results import Result

SF = "/root/testdata/sf0.001"


def test_clean_html_covers_all_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect()
    assert any("&" in r["html"] for r in pages)
    want = {r["page_id"]: re.sub("[ \t\n\x0b\f\r\xa0]+", " ", html.unescape(re.sub("<[^>]+>", " ", r["html"]))).strip(" ") for r in pages}
    got = queries.QUERIES["clean_html"](spark, SF).collect()
    assert len(got) == len(pages) and {r["page_id"]: r["text"] for r in got} == want


def test_exports_write_all_rows(spark, tmp_path):
    result = Result(spark.range(10_500))
    assert len(json.loads(result.to_json(str(tmp_path / "all.json")))) == 10_500
    assert len(json.loads((tmp_path / "all.json").read_text())) == 10_500
    assert len(json.loads(result.to_json(limit=7))) == 7
    assert result.to_html().count("<tr") == 10_501 and result.to_html(limit=7).count("<tr") == 8
