import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


ARTICLE = {
    "article_id": 1, "batch_no": 0, "source_id": "alpha", "source_name": "Alpha", "category": "ai", "source_priority": 5, "source_tags": ["x"], "title": "T", "url": None,
    "external_id": None, "published_at": None, "updated_at": None, "summary": "", "author": None, "fetched_at": "2025-01-01T00:00:00Z", "content_html": "", "content_text": "", "content_status": "not_requested",
}
SCHEMA = (
    "article_id long, batch_no int, source_id string, source_name string, category string, source_priority int, source_tags array<string>, title string, url string, external_id string, "
    "published_at string, updated_at string, summary string, author string, fetched_at string, content_html string, content_text string, content_status string"
)


@pytest.fixture(scope="session")
def articles(spark):
    """Make an article table from partial rows; ids are given in order where absent."""

    def make(*rows, **common):
        full = [{**ARTICLE, "article_id": i + 1, **common, **r} for i, r in enumerate(rows)]
        names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
        return spark.createDataFrame([tuple(r[n] for n in names) for r in full], SCHEMA)

    return make
