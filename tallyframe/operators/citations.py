"""Outside sources that texts and pages cite: links with titles, bare addresses, attributions, authors with years.

Every mention is a row with its place; mentions of one source are merged by an associative aggregate: the
first place decides what the source is, mentions are counted, and a source that came without a title takes
the first title that a later mention gives. So a source that a third of all rows mention is merged within
each task before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Links, addresses and attributions in prose, a work named by author and year.
MARKDOWN_LINK = r"\[([^\]\n]{1,200})\]\((https?://[^\s)]+)\)"
ADDRESS = r"https?://[^\s<>()\[\]{}\"'）】」』，。；、]+"
ATTRIBUTION = r"(?i)[（(]?\s*(?:資料來源|资料来源|來源|来源|出處|出处|Source)\s*[:：]\s*([^)）\n]{2,80})"
AUTHOR_YEAR = r"(?<![\w'’-])([A-Z][A-Za-z'’-]+(?:\s+(?:and|&)\s+[A-Z][A-Za-z'’-]+)?(?:\s+et\s+al\.?)?)\s*\(((?:19|20)[0-9]{2})[a-z]?(?:[,;]\s*([^()\n]{2,120}))?\)"
YEAR = r"(?:^|[\s,，、（(])((?:19|20)[0-9]{2})(?:[\s,，、）)]|$)"
#: Words before a year in brackets that are nobody's name.
NO_AUTHORS = """
january february march april may june july august september october november december
jan feb mar apr jun jul aug sep sept oct nov dec monday tuesday wednesday thursday
friday saturday sunday table figure fig section appendix chapter version edition
year years fy in the a an since from until before after during by of on at to for
and or as see q1 q2 q3 q4 spring summer autumn fall winter note notes source sources
""".split()  # fmt: skip
#: Addresses of pictures, hosts of assets, punctuation that ends no address or name.
PICTURE = r"(?i)\.(?:jpe?g|png|gif|webp|svg|bmp|ico|tiff?|avif|heic)(?:[?#].*)?$"
ASSET_HOST = r"(?i)^(?:m\.media-|images?[.-]|img[.-]|static[.-]|assets?[.-]|cdn[.-]|media[.-])|(?:\.cdn\.|\.imgix\.|cloudfront\.net$|akamaized\.net$)"
TRAILING = " \t，,、。.；;：:）)】」』"


def trimmed(c: Column) -> Column:
    """A text without white space around it and without punctuation at its end."""
    return F.rtrim(F.ltrim(c, F.lit(TRAILING)), F.lit(TRAILING))


def source_key(url: Column) -> Column:
    """An address as it is compared: in lower case, without scheme, www, a slash at its end or punctuation behind it."""
    bare = F.rtrim(F.rtrim(F.trim(url), F.lit("/")), F.lit(TRAILING))
    return F.regexp_replace(F.regexp_replace(F.lower(bare), "^https?://", ""), r"^www\.", "")


def is_asset(url: Column) -> Column:
    """Whether an address points at a picture, or at a host that serves assets."""
    host = F.regexp_replace(F.regexp_extract(F.regexp_replace(url, "(?i)^https?://", ""), "^[^/]*", 0), r"^.*@|:.*$", "")
    return F.rtrim(F.trim(url), F.lit(TRAILING)).rlike(PICTURE) | host.rlike(ASSET_HOST)


def _mention(kind: str, order: int, key: Column, title: Column, url: Column, publisher: Column, year: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.lit(order).alias("step"), key.alias("key"), F.coalesce(title, F.lit("")).alias("title"), url.alias("url"), publisher.alias("publisher"), year.alias("year"))


def _flat(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def mentions(text: Column) -> Column:
    """(kind, step, key, title, url, publisher, year) of each mention in a text: links, then addresses that no link holds, attributions, authors with years."""
    body, none = F.coalesce(text, F.lit("")), F.lit("")
    each = lambda pattern, n: F.arrays_zip(*[F.regexp_extract_all(body, F.lit(pattern), i).alias(f"g{i}") for i in range(1, n + 1)])
    linked = F.filter(each(MARKDOWN_LINK, 2), lambda m: ~is_asset(m["g2"]))
    links = F.transform(linked, lambda m: _mention("link", 0, source_key(m["g2"]), F.trim(m["g1"]), F.rtrim(m["g2"], F.lit(TRAILING)), none, none))
    bare = F.filter(F.regexp_extract_all(body, F.lit(ADDRESS), 0), lambda u: ~F.exists(linked, lambda m: m["g2"] == u) & ~is_asset(u))
    urls = F.transform(bare, lambda u: _mention("url", 1, source_key(u), none, F.rtrim(u, F.lit(TRAILING)), none, none))

    def attribution(m: Column) -> Column:
        whole = trimmed(_flat(m))
        year = F.regexp_extract(whole, YEAR, 1)
        name = F.when(year == "", whole).otherwise(trimmed(_flat(F.regexp_replace(whole, YEAR, " "))))
        return _mention("attribution", 2, F.concat(F.lower(name), F.lit("|"), year), none, none, name, year)

    said = F.filter(F.transform(F.regexp_extract_all(body, F.lit(ATTRIBUTION), 1), attribution), lambda m: (m["publisher"] != "") & ~m["publisher"].rlike("^https?://"))

    def author(m: Column) -> Column:
        name = _flat(m["g1"])
        return _mention("author_year", 3, F.concat(F.lower(F.regexp_extract(name, r"^\S+", 0)), F.lit("|"), m["g2"]), trimmed(_flat(m["g3"])), none, name, m["g2"])

    works = F.filter(F.transform(each(AUTHOR_YEAR, 3), author), lambda m: ~F.regexp_extract(m["key"], r"^[^|]*", 0).isin(*NO_AUTHORS))
    return F.concat(links, urls, said, works)


def merged(rows: DataFrame) -> DataFrame:
    """(key, kind, title, url, publisher, year, occurrences, place) of mentions (place, kind, title, ..., key): one row for each source.

    place is anything that can be ordered. The first mention gives all but the title, if it has none: then the
    first title decides, and what kind of mention the source is.
    """
    first = F.min_by(F.struct("kind", "title", "url", "publisher", "year"), "place").alias("f")
    titled = F.min_by(F.when(F.col("title") != "", F.struct("kind", "title")), F.when(F.col("title") != "", F.col("place"))).alias("t")
    each = rows.groupBy("key").agg(F.count("*").alias("occurrences"), F.min("place").alias("place"), first, titled)
    known = (F.col("f.title") != "") | F.col("t").isNull()
    return each.select("key", F.when(known, F.col("f.kind")).otherwise(F.col("t.kind")).alias("kind"), F.when(known, F.col("f.title")).otherwise(F.col("t.title")).alias("title"), "f.url", "f.publisher", "f.year", "occurrences", "place")


def cited_sources(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The sources that the texts of docs cite, see merged; texts in the order of their keys. Null texts cite nothing."""
    found = docs.select(F.col(key).alias("doc"), F.posexplode(mentions(F.col(text))).alias("at", "m"))
    return merged(found.select(F.struct("doc", "m.step", "at").alias("place"), "m.*"))


def page_links(pages: DataFrame) -> DataFrame:
    """(place, key, kind, title, url, ...) of each anchor of pages (page_id, url, html); addresses that begin with a slash are the page's own site's."""
    anchor = r"(?is)<a\b[^>]*?href\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"
    html = F.coalesce("html", F.lit(""))
    pairs = F.arrays_zip(F.regexp_extract_all(html, F.lit(anchor), 1).alias("href"), F.regexp_extract_all(html, F.lit(anchor), 2).alias("text"))
    found = pages.select("page_id", "url", F.posexplode(pairs).alias("at", "a"))
    site = F.regexp_extract("url", r"(?i)^https?://[^/?#]+", 0)
    whole = F.when(F.col("a.href").startswith("/"), F.concat(site, F.col("a.href"))).otherwise(F.col("a.href"))
    title, none = _flat(F.regexp_replace(F.col("a.text"), "<[^>]*>", " ")), F.lit("")
    rows = found.select(F.struct("page_id", "at").alias("place"), whole.alias("url"), title.alias("title"), F.when(title == "", "url").otherwise("link").alias("kind"), none.alias("publisher"), none.alias("year"))
    return rows.where(F.col("url").rlike("(?i)^https?://")).where(~is_asset(F.col("url"))).withColumn("key", source_key(F.col("url")))
