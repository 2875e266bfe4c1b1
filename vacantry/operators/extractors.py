"""Market-benchmark extractors: stored page in, amounts out, one per source.

Every extractor is a DataFrame transform over (page columns…, html, title) that adds
amount_min, amount_max, amount_median, confidence; rows without pay get NULLs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantry.functions.money import plain_amount
from vacantry.functions.pages import MONEY, first_hit, hit
from vacantry.functions.staging import computed_once
from vacantry.functions.text import half_up, squeeze
from vacantry.functions.titles import candidate_slugs
from vacantry.operators.joins import spread_join
from vacantry.operators.selection import first_per_key, rank_in
from vacantry import lexicon as lx

# fixed values: (field, label pattern) of the percentile table
PERCENTILE_ROWS = [
    ("p10", r"(?i)^10\s*th percentile"),
    ("p25", r"(?i)^25\s*th percentile"),
    ("median", r"(?i)^median annual salary"),
    ("p75", r"(?i)^75\s*th percentile"),
    ("p90", r"(?i)^90\s*th percentile"),
    ("median_ex_london", r"(?i)excluding london median"),
    ("sample_size", r"(?i)^number of salaries quoted"),
]
PERIOD_ROW = r"(?i)^6 months to"


def _decode(c: Column) -> Column:
    for entity, text in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"),
                         ("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'")):
        c = F.replace(c, F.lit(entity), F.lit(text))
    return c


def _description(html: Column) -> Column:
    content = r"content=[\"']([^\"']+)[\"']"
    return F.coalesce(first_hit(html, [
        rf"(?i)<meta[^>]+name=[\"']description[\"'][^>]+{content}",
        rf"(?i)<meta[^>]+{content}[^>]+name=[\"']description[\"']"]), F.lit(""))


def _amounts(c: Column, least: float) -> Column:
    found = F.transform(F.regexp_extract_all(c, F.lit(MONEY), F.lit(1)), plain_amount)
    return F.transform(F.filter(found, lambda n: n >= least), half_up)


def percentile_table(df: DataFrame, html: str = "html") -> DataFrame:
    """Adds the figures of the first percentile table of a page.

    Rows after the first repeated label belong to the next table and are ignored; an
    unpublished figure ("-") is NULL.
    """
    cell = r"(?s)<t[dh][^>]*>(.*?)</t[dh]>"

    def clean(c):
        c = F.regexp_replace(c, r"<[^>]+>", "")
        c = F.replace(c, F.lit("&#163;"), F.lit("£"))
        return squeeze(F.regexp_replace(c, r"&nbsp;|&#160;", " "))

    raw = F.regexp_extract_all(F.col(html), F.lit(r"(?s)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cells = F.transform(raw, lambda r: F.regexp_extract_all(r, F.lit(cell), F.lit(1)))
    rows = F.transform(F.filter(cells, lambda c: F.size(c) >= 2), lambda c: F.struct(
        clean(F.get(c, F.lit(0))).alias("label"), clean(F.get(c, F.lit(1))).alias("value")))
    known = "|".join(f"(?:{p.replace('(?i)', '')})" for _, p in PERCENTILE_ROWS)
    labels = F.transform("_rows", lambda r: F.lower(r["label"]))
    repeat = F.filter(
        F.transform("_labels", lambda s, i: F.struct(i.alias("i"), s.alias("s"))),
        lambda x: x["s"].rlike("(?i)" + known)
        & (F.array_position(F.col("_labels"), x["s"]) <= x["i"]))
    stop = F.coalesce(F.get(repeat, F.lit(0))["i"], F.size("_rows"))
    staged = df.withColumn("_rows", rows).withColumn("_labels", labels).withColumn("_stop", stop)
    staged = staged.withColumn("_first", F.slice("_rows", F.lit(1), F.col("_stop")))

    def value(pattern, last=False):
        found = F.filter("_first", lambda r: r["label"].rlike(pattern))
        return F.try_element_at(found, F.lit(-1 if last else 1))["value"]

    out = []
    for name, pattern in PERCENTILE_ROWS:
        if name == "sample_size":
            out.append(plain_amount(value(pattern)).cast("bigint").alias(name))
        else:
            money = F.regexp_extract(value(pattern), r"£\s?([\d,]+)", 1)
            out.append(plain_amount(F.when(money != "", money)).alias(name))
    return computed_once(staged.select(*df.columns, *out, value(PERIOD_ROW, last=True).alias("period_label")), df.columns)


def _spread(df: DataFrame, amount: Column, confidence: float) -> DataFrame:
    """Single amount with 15 % either side."""
    staged = df.withColumn("_a", amount)
    width = half_up(F.col("_a") * 0.15)
    return staged.select(
        *df.columns, (F.col("_a") - width).cast("double").alias("amount_min"),
        (F.col("_a") + width).cast("double").alias("amount_max"),
        F.col("_a").cast("double").alias("amount_median"),
        F.when(F.col("_a").isNotNull(), confidence).alias("confidence"))


def average_page(df: DataFrame, html: str = "html") -> DataFrame:
    """Average-pay page: the meta description, else JSON-LD, else near "Average" / "median"."""
    page = F.col(html)

    def money(c):
        return half_up(plain_amount(hit(_decode(c), MONEY)))

    blocks = F.regexp_extract_all(
        page, F.lit(r"(?is)<script[^>]+type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), F.lit(1))
    in_blocks = F.get(F.filter(F.transform(blocks, money), lambda n: n > 0), F.lit(0))
    mark = r"(?:€|£|\$|CHF\s*|AED\s*|C\$|A\$)\s*[0-9][0-9,.]*"
    near = first_hit(page, [rf"(?is)(Average.{{0,500}}?{mark})", rf"(?is)(median.{{0,500}}?{mark})"])
    described = money(_description(page))
    return _spread(df, F.coalesce(F.when(described > 0, described), in_blocks, money(near)), 0.65)


def range_page(df: DataFrame, html: str = "html") -> DataFrame:
    """Pay-range page: two or more amounts of at least 10,000 in title and description,
    else in the embedded data; lowest and highest."""
    page = F.col(html)
    title = F.coalesce(hit(page, r"(?is)<title[^>]*>(.*?)</title>"), F.lit(""))
    head = _amounts(_decode(F.concat_ws(" ", title, _description(page))), 10000)
    data = hit(page, r"(?is)<script[^>]+id=[\"']__NEXT_DATA__[\"'][^>]*>(.*?)</script>")
    staged = df.withColumn("_head", head).withColumn(
        "_n", F.when(F.size("_head") >= 2, F.col("_head")).otherwise(_amounts(_decode(data), 10000)))
    ok = F.size("_n") >= 2
    low, high = F.array_min("_n"), F.array_max("_n")
    return staged.select(
        *df.columns, F.when(ok, low).cast("double").alias("amount_min"),
        F.when(ok, high).cast("double").alias("amount_max"),
        F.when(ok, half_up((low + high) / 2)).cast("double").alias("amount_median"),
        F.when(ok, 0.7).alias("confidence"))


GUIDE_REACH = 5000


def guide_page(df: DataFrame, html: str = "html", title: str = "title", reach: int = GUIDE_REACH) -> DataFrame:
    """Salary guide: distinct amounts near the first mention of a title word.

    The window of ``reach`` characters starts 1200 before the mention; that is the
    rule's meaning of near, not a cut of the page.  The lowest amount and the
    fourth lowest (or the highest) bound the range.
    """
    text = _decode(F.col(html))
    for tag in ("script", "style"):
        text = F.regexp_replace(text, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"<[^>]+>", " "), r"\s+", " ")
    tokens = F.filter(F.split(F.lower(F.coalesce(F.col(title), F.lit(""))), r"\s+"),
                      lambda t: (F.length(t) >= 3) & ~t.isin("senior", "lead", "principal", "head"))
    staged = df.withColumn("_t", text).withColumn("_low", F.lower("_t"))
    at = F.array_min(F.filter(F.transform(tokens, lambda t: F.position(t, F.col("_low"))), lambda p: p > 0))
    start = F.greatest(F.coalesce(at, F.lit(1)) - 1200, F.lit(1))
    raw = F.regexp_extract_all(F.col("_t").substr(start, F.lit(reach)),
                               F.lit(r"([0-9]{2,3}(?:,[0-9]{3})|[0-9]{5,6})"), F.lit(1))
    nums = F.array_sort(F.array_distinct(F.transform(
        F.filter(F.transform(raw, plain_amount), lambda n: n >= 20000), half_up)))
    staged = staged.withColumn("_n", nums)
    ok = F.size("_n") >= 2
    low = F.get("_n", F.lit(0))
    high = F.get("_n", F.least(F.size("_n") - 1, F.lit(3)))
    return staged.select(
        *df.columns, F.when(ok, low).cast("double").alias("amount_min"),
        F.when(ok, high).cast("double").alias("amount_max"),
        F.when(ok, half_up((low + high) / 2)).cast("double").alias("amount_median"),
        F.when(ok, 0.45).alias("confidence"))


def amount_page(df: DataFrame, html: str = "html") -> DataFrame:
    """One distinct amount gets 15 % either side; several give lowest, highest, upper middle."""
    described = _description(F.col(html))
    text = squeeze(F.regexp_replace(
        _decode(F.when(described != "", described).otherwise(F.col(html))), r"<[^>]+>", " "))
    staged = df.withColumn("_n", F.array_sort(F.array_distinct(_amounts(text, 10000))))
    n, first = F.size("_n"), F.get("_n", F.lit(0))
    width = half_up(first * 0.15)
    return staged.select(
        *df.columns,
        F.when(n == 1, first - width).when(n > 1, first).cast("double").alias("amount_min"),
        F.when(n == 1, first + width).when(n > 1, F.array_max("_n")).cast("double").alias("amount_max"),
        F.when(n >= 1, F.get("_n", F.floor(n / 2).cast("int"))).cast("double").alias("amount_median"),
        F.when(n >= 1, 0.5).alias("confidence"))


def percentile_page(df: DataFrame, html: str = "html") -> DataFrame:
    """Percentile table in the common extractor shape: quartiles bound the range."""
    rows = percentile_table(df, html)
    return rows.select(
        *df.columns, F.col("p25").alias("amount_min"), F.col("p75").alias("amount_max"),
        F.col("median").alias("amount_median"), F.lit(None).cast("double").alias("confidence"))


EXTRACTORS: dict[str, Callable[..., DataFrame]] = {
    "itjobswatch": percentile_page,
    "indeed": average_page,
    "levels_fyi": range_page,
    "robert_half": guide_page,
    "salaryexpert": amount_page,
}


FIGURES = ("amount_min", "amount_max", "amount_median", "confidence")


def extract_benchmarks(pages: DataFrame, html: str = "html", source: str = "data_source") -> DataFrame:
    """Applies each source's extractor to its pages; every page keeps its row.

    One pass: an extractor sees the page only where the source is its own, and reads
    nothing elsewhere.  Pages of unknown sources have NULL figures.
    """
    rows = pages
    for i, (name, run) in enumerate(EXTRACTORS.items()):
        rows = run(rows.withColumn(f"_page{i}", F.when(F.col(source) == name, F.col(html))), f"_page{i}")
        rows = rows.withColumn(f"_figures{i}", F.struct(*FIGURES)).drop(f"_page{i}", *FIGURES)
    own = [F.when(F.col(source) == name, F.col(f"_figures{i}")) for i, name in enumerate(EXTRACTORS)]
    found = rows.withColumn("_figures", F.coalesce(*own))
    return found.select(*pages.columns, *[F.col(f"_figures.{c}").alias(c) for c in FIGURES])


def slug_benchmark(titles: DataFrame, figures: DataFrame) -> DataFrame:
    """First look-up slug of each title with a published median.

    ``titles`` has key, title; ``figures`` has slug, median.  Slugs without a median are
    dropped before the join, then the earliest slug of each title wins.  A slug that very
    many titles share is spread over tasks.
    """
    listed = titles.select("key", "title", F.posexplode(candidate_slugs(F.col("title"))).alias("pos", "slug"))
    published = figures.filter(F.col("median").isNotNull()).groupBy("slug").agg(F.max("median").alias("median"))
    return first_per_key(spread_join(listed, published, "slug"), ["key"], F.col("pos"))


def pick_by_country(candidates: DataFrame, country: str = "country_code",
                    source: str = "data_source") -> DataFrame:
    """Benchmark source of each key by country priority; sources a country does not use
    never win.  ``candidates`` has key, country, source and the figures."""
    rank = rank_in(F.col(source), lx.DEFAULT_BENCHMARK_SOURCES)
    unused = F.lit(len(lx.DEFAULT_BENCHMARK_SOURCES))
    for code, order in lx.BENCHMARK_SOURCES.items():
        here = F.upper(F.col(country)) == code
        rank = F.when(here, rank_in(F.col(source), order)).otherwise(rank)
        unused = F.when(here, F.lit(len(order))).otherwise(unused)
    ranked = candidates.withColumn("_rank", rank).filter(
        (F.col("_rank") < unused) & F.col("amount_median").isNotNull())
    return first_per_key(ranked, ["key"], F.col("_rank")).drop("_rank")
