"""Meta data of web pages and caption rows of their transcripts."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import clock

META = T.StructType([T.StructField(n, T.StringType()) for n in ("title", "description", "preview", "lang")])


class _Meta(HTMLParser):
    """Title (og:title, title, first h1), description, preview picture and language of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.meta: dict[str, str] = {}
        self.text: dict[str, str] = {}
        self.lang: str | None = None
        self.inside: str | None = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = dict(attrs)
        if tag == "html":
            self.lang = a.get("lang") or self.lang
        elif tag == "meta" and (name := (a.get("property") or a.get("name") or "").lower()):
            if a.get("content"):
                self.meta.setdefault(name, a["content"].strip())
        elif tag == "link" and (a.get("rel") or "").lower() == "image_src" and a.get("href"):
            self.meta.setdefault("image_src", a["href"])
        elif tag in ("title", "h1") and tag not in self.text:
            self.inside, self.text[tag] = tag, ""

    def handle_endtag(self, tag: str) -> None:
        if tag == self.inside:
            self.inside = None

    def handle_data(self, data: str) -> None:
        if self.inside:
            self.text[self.inside] += data

    def result(self) -> dict[str, str | None]:
        clean = {k: " ".join(v.split()) for k, v in (self.meta | self.text).items()}
        pick = lambda *names: next((clean[n] for n in names if clean.get(n)), None)
        return {"title": pick("og:title", "title", "h1"), "description": pick("og:description", "description"), "preview": pick("og:image", "twitter:image", "image_src"), "lang": self.lang}


@F.pandas_udf(META)
def page_meta(pages: pd.Series) -> pd.DataFrame:
    out = []
    for text in pages:
        p = _Meta()
        p.feed(text or "")
        p.close()
        out.append(p.result())
    return pd.DataFrame(out, columns=[f.name for f in META])


#: Where pictures of a video page are, in the order to try them; # stands for the page's id.
PREVIEWS = (
    "https://img.youtube.com/vi/#/maxresdefault.jpg",
    "https://i.ytimg.com/vi/#/maxresdefault.jpg",
    "https://i.ytimg.com/vi/#/sddefault.jpg",
    "https://i.ytimg.com/vi/#/hqdefault.jpg",
    "https://i.ytimg.com/vi_webp/#/maxresdefault.webp",
)


def preview_candidates(preview, page_id):
    """array of (place, url): the page's own picture, where it has one, then those of its id; the first that can be had is its preview."""
    own = F.when(F.coalesce(preview, F.lit("")) != "", preview)
    each = [F.struct(F.lit(0).alias("place"), own.alias("url"))]
    each += [F.struct(F.lit(k).alias("place"), F.replace(F.lit(u), F.lit("#"), page_id).alias("url")) for k, u in enumerate(PREVIEWS, 1)]
    return F.filter(F.array(*each), lambda c: c.url.isNotNull())


def caption_rows(body):
    """array of (timestamp, text) from caption events in JSON: segments joined, blank ones dropped, equal rows once."""
    schema = "struct<events:array<struct<tStartMs:bigint,segs:array<struct<utf8:string>>>>>"
    events = F.coalesce(F.from_json(body, schema)["events"], F.array().cast("array<struct<tStartMs:bigint,segs:array<struct<utf8:string>>>>"))
    joined = lambda e: F.trim(F.regexp_replace(F.array_join(F.transform(F.coalesce(e.segs, F.array().cast("array<struct<utf8:string>>")), lambda s: F.coalesce(s.utf8, F.lit(""))), ""), r"\s+", " "))
    rows = F.transform(events, lambda e: F.struct(clock(F.coalesce(e.tStartMs, F.lit(0).cast("bigint"))).alias("timestamp"), joined(e).alias("text")))
    return F.array_distinct(F.filter(rows, lambda r: r.text != ""))
