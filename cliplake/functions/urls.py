"""Platforms, ids and profile pages of URLs; ids of videos."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Platforms by URL, the first match holds (fixed values; substrings of the URL, as the hosts are not anchored).
PLATFORMS = ((r"(youtube\.com|youtu\.be)", "youtube"), (r"instagram\.com", "instagram"), (r"tiktok\.com", "tiktok"), (r"twitter\.com|x\.com", "twitter"))
#: Id patterns of each platform in order (fixed values).
IDS = {
    "youtube": (r"youtu\.be/([a-zA-Z0-9_-]{11})", r"youtube\.com/watch\?.*v=([a-zA-Z0-9_-]{11})", r"youtube\.com/shorts/([a-zA-Z0-9_-]{11})"),
    "instagram": (r"instagram\.com/(?:p|reel|reels)/([a-zA-Z0-9_-]+)",),
    "tiktok": (r"tiktok\.com/@[^/]+/video/(\d+)", r"vm\.tiktok\.com/([a-zA-Z0-9]+)"),
}
PROFILE_INSTAGRAM = r"instagram\.com/([a-zA-Z0-9_.]+)(?:/reels)?/?$"
PROFILE_YOUTUBE = r"youtube\.com/(?:@[^/]+|channel/|c/|user/|[^/]+/shorts)"


def detect_platform(url: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for pattern, name in PLATFORMS:
        out = out.when(url.rlike(pattern), F.lit(name))
    return out


def extract_id(url: Column, platform: Column) -> Column:
    """The platform's id in the URL; for tiktok the first 12 digits of its MD5 where there is none, else NULL."""
    found = lambda p: F.coalesce(*[F.nullif(F.regexp_extract(url, x, 1), F.lit("")) for x in IDS[p]])
    return F.when(platform == "youtube", found("youtube")).when(platform == "instagram", found("instagram")).when(platform == "tiktok", F.coalesce(found("tiktok"), F.substring(F.md5(url), 1, 12)))


def is_profile(url: Column, platform: Column) -> Column:
    single = url.rlike(IDS["instagram"][0])
    return F.coalesce(F.when(platform == "instagram", url.rlike(PROFILE_INSTAGRAM) & ~single).when(platform == "youtube", url.rlike(PROFILE_YOUTUBE)), F.lit(False))


def video_id(platform: Column, platform_id: Column) -> Column:
    """First 16 hex digits of SHA-256 over 'platform:platform_id'; NULL if either is."""
    return F.substring(F.sha2(F.concat(platform, F.lit(":"), platform_id), 256), 1, 16)
