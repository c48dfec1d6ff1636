import pytest

from cliplake.sources.listing import ListingReader, platform_of, register


def test_listing(spark):
    register(spark)
    df = spark.read.format("listing").option("urls", "https://youtube.com/@a https://www.instagram.com/b/").option("limit", 3).load()
    rows = df.collect()
    assert df.rdd.getNumPartitions() == 2 and len(rows) == 6
    assert {r.platform for r in rows} == {"youtube", "instagram"} and all(r.url.startswith("https://www.") and r.title for r in rows)


def test_platform_without_listings():
    assert platform_of("https://www.tiktok.com/@u") == "tiktok" and platform_of("https://example.org") is None
    with pytest.raises(NotImplementedError):
        ListingReader({"urls": "https://www.tiktok.com/@u"}).partitions()
