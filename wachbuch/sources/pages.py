"""Release pages, their versions, and links to pages and court releases."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wachbuch.functions.dates import date_line, page_order

ENTRY_CLASS = "entry-wrapper-1col"
YEARS = (2024, 2035)


class _Entries(HTMLParser):
    """Collects, per release block, its id, heading and the text lines of its paragraphs."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.entries: list[dict] = []
        self.depth = 0
        self.open: dict | None = None
        self.where: str | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag == "div":
            if self.open is None and ENTRY_CLASS in (a.get("class") or "").split():
                self.open, self.depth = {"id": a.get("id") or "", "title": None, "paragraphs": []}, 0
            if self.open is not None:
                self.depth += 1
        elif self.open is not None and tag == "h2" and self.open["title"] is None:
            self.open["title"], self.where = [], "title"
        elif self.open is not None and tag == "p":
            self.open["paragraphs"].append([])
            self.where = "p"

    def handle_data(self, data: str) -> None:
        if self.open is None or not data.strip():
            return
        if self.where == "title":
            self.open["title"].append(data.strip())
        elif self.where == "p":
            self.open["paragraphs"][-1].append(data.strip())

    def handle_endtag(self, tag: str) -> None:
        if tag in ("h2", "p"):
            self.where = None
        elif tag == "div" and self.open is not None:
            self.depth -= 1
            if self.depth == 0:
                self.close_entry()

    def close_entry(self) -> None:
        if self.open is not None and self.open["title"] is not None:
            self.entries.append(self.open)
        self.open = self.where = None


def entries_of(html: str | None) -> list[dict]:
    """Raw blocks of one page; a page that was cut off gives what it holds. NULL gives none."""
    p = _Entries()
    p.feed(html or "")
    p.close()
    p.close_entry()
    return [{"pm_id": e["id"], "title": "".join(e["title"]), "paragraphs": ["\n".join(x) for x in e["paragraphs"] if x]} for e in p.entries]


def parse(pages: DataFrame) -> DataFrame:
    """Releases of pages ``url, html`` (and ``version``, if there): ``pm_id, source_url, pos, title,
    publish_date, ort_raw, zeit_raw, text``.

    Python only takes the blocks apart; what a paragraph means is decided by expressions: a date line
    counts before the place, place and time stand in the first paragraph that starts with ``Ort:``.
    """
    version = ["version"] if "version" in pages.columns else []

    @F.pandas_udf("array<struct<pm_id: string, title: string, paragraphs: array<string>>>")
    def blocks(html: pd.Series) -> pd.Series:
        return html.map(entries_of)

    d = pages.select("url", *version, F.posexplode(blocks("html")).alias("pos", "e"))
    paras = F.col("e.paragraphs")
    place_at = F.coalesce(F.nullif(F.array_position(F.transform(paras, lambda p: p.startswith("Ort:")), True).cast("int"), F.lit(0)), F.size(paras) + 1)
    d = d.withColumns({"paras": paras, "place_at": place_at})
    # where the first line of a paragraph is the date, the place may follow in the same paragraph
    heads = F.transform("paras", lambda p: date_line(F.element_at(F.split(p, "\n"), 1)))
    first = _first_index(heads)
    d = d.withColumn("date_at", first)
    d = d.withColumn("date_at", F.when((F.col("date_at") > 0) & (F.col("date_at") < F.col("place_at")), F.col("date_at")))
    rest = lambda p: F.regexp_replace(p, r"^[^\n]*\n?", "")
    cleaned = F.transform("paras", lambda p, i: F.when(i + 1 == F.col("date_at"), F.trim(rest(p))).otherwise(p))
    d = d.withColumns({"publish_date": F.get(heads, F.col("date_at") - 1), "paras": cleaned})
    at = F.array_position(F.transform("paras", lambda p: p.startswith("Ort:")), True).cast("int")
    d = d.withColumn("at", at)
    lines = F.split(F.get("paras", F.col("at") - 1), "\n")
    pick = lambda tag: F.trim(F.substr(F.element_at(F.filter(lines, lambda x: x.startswith(tag)), -1), F.lit(len(tag) + 1)))
    has = F.col("at") > 0
    body = F.filter(F.transform("paras", lambda p, i: F.when(i + 1 == F.col("at"), F.lit("")).otherwise(p)), lambda p: F.length(p) > 0)
    return d.select(
        F.col("e.pm_id").alias("pm_id"), F.col("url").alias("source_url"), *version, "pos", F.col("e.title").alias("title"), "publish_date",
        F.when(has, pick("Ort:")).alias("ort_raw"), F.when(has & F.exists(lines, lambda x: x.startswith("Zeit:")), pick("Zeit:")).alias("zeit_raw"), F.array_join(body, "\n").alias("text"),
    )


def _first_index(values: Column) -> Column:
    """1-based place of the first value that isn't NULL; 0 if there is none."""
    return F.array_position(F.transform(values, lambda v: v.isNotNull()), True).cast("int")


def complete(pages: DataFrame) -> DataFrame:
    """Pages fit to be stored: downloaded to the end, and with at least one release block."""
    return pages.where(F.col("html").contains("</html") & F.col("html").contains(ENTRY_CLASS))


def latest(versions: DataFrame) -> DataFrame:
    """The newest stored version of each page."""
    rest = [c for c in versions.columns if c != "url"]
    return versions.groupBy("url").agg(F.max_by(F.struct(*rest), "version").alias("v")).select("url", "v.*")


def catalogue(seeds: DataFrame, discovered: DataFrame, held: DataFrame) -> DataFrame:
    """All known pages once, in order of start day and number."""
    d = seeds.select("url").union(discovered.select("url")).union(held.select("url")).distinct()
    return d.withColumn("o", page_order(F.col("url"))).orderBy("o", "url").select("url")


def discover(overviews: DataFrame, known: DataFrame) -> DataFrame:
    """Pages linked from overview pages or feeds (``html``) of the years in use that aren't known yet."""
    found = overviews.select(F.explode(F.regexp_extract_all("html", F.lit(r"(https?://[^\s\"'<>]*pressemeldungen-ab-\d{8}-\d+)"), F.lit(1))).alias("url")).distinct()
    year = F.regexp_extract("url", r"ab-\d{4}(\d{4})-", 1).cast("int")
    return found.where(year.between(*YEARS)).join(known.select("url"), "url", "left_anti")


def to_refresh(pages: DataFrame, newest_held: str | None, fresh: int = 2) -> DataFrame:
    """The last ``fresh`` pages, and all from the one before the newest held one on."""
    w = Window.partitionBy(F.lit(1))  # one row per page of the archive
    d = pages.withColumn("o", page_order(F.col("url")))
    d = d.withColumns({"up": F.row_number().over(w.orderBy("o", "url")), "down": F.row_number().over(w.orderBy(F.desc("o"), F.desc("url")))})
    d = d.withColumn("held", F.max(F.when(F.col("url") == F.lit(newest_held), F.col("up"))).over(w))
    return d.where((F.col("down") <= fresh) | (F.col("up") >= F.col("held") - 1)).select("url")


def captures(index: DataFrame, most: int = 4) -> DataFrame:
    """Snapshots of a page in an archive index (``url, ts, digest``): the earliest of each digest, newest
    first, at most ``most`` of them: ``url, ts, nth``."""
    d = index.groupBy("url", "digest").agg(F.min("ts").alias("ts"))
    nth = F.row_number().over(Window.partitionBy("url").orderBy(F.desc("ts"), "digest"))
    return d.withColumn("nth", nth).where(F.col("nth") <= most).select("url", "ts", "nth")


def recovered(tried: DataFrame) -> DataFrame:
    """Of the snapshots tried (``url, nth, n_entries, html``) the first that holds a release."""
    return tried.where("n_entries > 0").groupBy("url").agg(F.min_by(F.struct("nth", "html"), "nth").alias("b")).select("url", "b.nth", "b.html")


def court_links(listings: DataFrame, base: str, first_year: int = 24) -> DataFrame:
    """Links to court releases in listing pages, without the monthly calendars; equal addresses once."""
    p = r"(?i)href=\"(/[^\"]*?/PM%20?(\d+)-(\d{2})%20([^\"]+)\.pdf)\""
    d = listings.select(F.posexplode(F.regexp_extract_all("html", F.lit(f"({p})"), F.lit(1))).alias("pos", "m"))
    d = d.select("pos", *[F.regexp_extract("m", p, k).alias(n) for k, n in ((1, "href"), (2, "number"), (3, "yy"), (4, "raw"))])
    d = d.select("pos", F.concat(F.lit(base), "href").alias("pdf_url"), F.col("number").cast("int").alias("pm_number"), (F.col("yy").cast("int") + 2000).alias("pm_year"), F.coalesce(F.try_url_decode("raw"), "raw").alias("title"))
    d = d.where((F.col("pm_year") >= 2000 + first_year) & ~F.lower("title").rlike("termine im|terminübersicht"))
    return d.groupBy("pdf_url").agg(F.min_by(F.struct("pm_number", "pm_year", "title"), "pos").alias("b")).select("pdf_url", "b.*")


def hearings(bulletins: DataFrame) -> DataFrame:
    """Hearings announced in a bulletin text: each runs from its weekday line to the next one."""
    day = r"(?:Montag|Dienstag|Mittwoch|Donnerstag|Freitag),\s*\d{1,2}\.\d{1,2}\.\d{4}"
    whole = rf"(?s)((?:^|\n){day}.+?(?=\n{day}|\z))"
    one = r"(?s)^\n?(\w+),\s*(\d{1,2}\.\d{1,2}\.\d{4}),?\s*(\d{1,2}[.:]\d{2})?\s*(?:Uhr)?,?\s*([^\n]*)\n([^\n]+)\n([^\n]*Js\s*\d+/\d+)\n(.+)$"
    d = bulletins.select(F.explode(F.regexp_extract_all("text", F.lit(whole), F.lit(1))).alias("m")).where(F.col("m").rlike(one))
    g = lambda k: F.trim(F.regexp_extract("m", one, k))
    from wachbuch.functions.rules import category, without_imprint

    d = d.select(g(1).alias("weekday"), g(2).alias("date"), g(3).alias("time"), g(4).alias("room_info"), g(5).alias("offense"), g(6).alias("az"), without_imprint(F.regexp_extract("m", one, 7)).alias("narrative"))
    return d.withColumn("category", category(F.col("offense"), F.col("narrative")))


def home_days(matches: DataFrame, team: str = "Werder") -> DataFrame:
    """Days of home matches (``team1, kickoff``)."""
    return matches.where(F.col("team1").contains(team) & F.col("kickoff").isNotNull()).select(F.to_date("kickoff").alias("day")).distinct()
