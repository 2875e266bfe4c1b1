"""Stored-page extraction as column expressions; nothing here shuffles."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantry import lexicon as lx
from vacantry.functions.staging import computed_once
from vacantry.functions.text import blank_to_null, decode_entities, html_to_text, once, squeeze, text_lines

JSON_LD = r"(?is)<script[^>]+type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"
MONEY = r"(?i)(?:€|£|\$|CHF\s*|AED\s*|C\$|A\$)\s*([0-9][0-9,.]*)"


def hit(c: Column, pattern: str, group: int = 1) -> Column:
    """Capture group, or NULL when the pattern does not match."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def first_hit(c: Column, patterns: list[str]) -> Column:
    return F.coalesce(*[hit(c, p) for p in patterns])


def page_title(html: Column) -> Column:
    raw = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.trim(decode_entities(F.regexp_replace(raw, r"<[^>]+>", " ")))


def meta(html: Column, name: str) -> Column:
    """Content of a meta tag, attributes in either order, else empty."""
    esc = re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", name)
    named = rf"(?:property|name)=[\"']{esc}[\"']"
    content = r"content=[\"']([^\"']+)[\"']"
    value = first_hit(html, [rf"(?i)<meta[^>]+{named}[^>]+{content}[^>]*>",
                             rf"(?i)<meta[^>]+{content}[^>]+{named}[^>]*>"])
    return F.coalesce(F.trim(decode_entities(value)), F.lit(""))


def json_ld(html: Column) -> Column:
    """Array of parsed JSON-LD blocks, unparseable ones dropped."""
    raw = F.regexp_extract_all(html, F.lit(JSON_LD), F.lit(1))
    parsed = F.transform(raw, lambda b: F.try_parse_json(F.trim(decode_entities(b))))
    return F.filter(parsed, lambda v: v.isNotNull())


def _children(v: Column) -> Column:
    none = F.array().cast("array<variant>")
    return F.coalesce(
        F.try_variant_get(v, "$", "array<variant>"),
        F.map_values(F.try_variant_get(v, "$", "map<string,variant>")),
        none)


JSON_DEPTH = 1000  # the JSON parser takes no deeper text


def _walk(nodes: Column, depth: Column) -> Column:
    """Nodes and their descendants down to ``depth`` levels, parents before children.

    Every round puts the children of the nodes found last behind them, until no node has any.
    """
    def opened(items: Column, is_open: bool) -> Column:
        return F.transform(items, lambda v: F.struct(v.alias("v"), F.lit(is_open).alias("open")))

    def grow(found: Column, _: Column) -> Column:
        more = F.flatten(F.transform(found, lambda n: F.when(
            n["open"], F.concat(opened(F.array(n["v"]), False), opened(_children(n["v"]), True))).otherwise(F.array(n))))
        return F.when(F.exists(found, lambda n: n["open"]), more).otherwise(found)

    rounds = F.sequence(F.lit(1), F.least(F.greatest(depth, F.lit(1)), F.lit(JSON_DEPTH)))
    return F.aggregate(rounds, opened(nodes, True), grow, lambda found: F.transform(found, lambda n: n["v"]))


def type_text(v: Column) -> Column:
    many = F.try_variant_get(v, "$['@type']", "array<string>")
    return F.coalesce(F.array_join(many, " "), F.try_variant_get(v, "$['@type']", "string"))


def find_job_posting(blocks: Column) -> Column:
    """First JSON-LD object typed JobPosting at any depth, searching depth first.

    Only blocks that hold the word at all are walked, in as many rounds as the one with most brackets has, so a
    page costs what its own blocks do.
    """
    written = F.filter(F.transform(blocks, lambda v: F.struct(v.alias("v"), F.to_json(v).alias("json"))),
                       lambda b: b["json"].rlike("(?i)JobPosting"))

    def first(blocks: Column) -> Column:
        depth = F.aggregate(blocks, F.lit(0), lambda most, b: F.greatest(
            most, F.length(F.regexp_replace(b["json"], r"[^\[{]", ""))))
        found = F.filter(_walk(F.transform(blocks, lambda b: b["v"]), depth), lambda v: type_text(v).rlike("(?i)JobPosting"))
        return F.when(F.size(blocks) > 0, F.get(found, F.lit(0)))

    return F.get(F.transform(F.array(written), first), F.lit(0))  # bound once, read three times


def is_result_page(text: Column) -> Column:
    return text.rlike(lx.RESULT_MARKERS) | text.rlike(lx.DETAIL_MARKERS)


def visible_text(c: Column) -> Column:
    """Text a reader sees; input without page tags is returned as it is."""
    out = F.regexp_replace(
        c, r"(?is)<(?:script|style|iframe|noscript)\b[^>]*>.*?</(?:script|style|iframe|noscript)>"
           r"|<(?:iframe|meta|link)\b[^>]*/?\s*>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    out = F.regexp_replace(out, r"(?i)&nbsp;|&#160;", " ")
    out = F.regexp_replace(out, r"(?i)&(?:amp|lt|gt|quot);", " ")
    out = F.regexp_replace(out, r"\s+", " ")
    return F.when(c.rlike(r"(?i)<(?:html|body|script|iframe|style)\b"), out).otherwise(c)


def page_state(title: Column, url: Column, text: Column, is_search: bool = False,
               has_results: Column | None = None) -> Column:
    """Quality label of a stored page.

    A page that serves results is healthy whatever words it contains, unless it is a
    checkpoint; then block wording, the login wall and empty results are tested in turn.
    ``has_results`` is NULL when the caller does not know.
    """
    title, url, text = [F.coalesce(c, F.lit("")) for c in (title, url, text)]
    served = F.lit(None).cast("boolean") if has_results is None else has_results
    checkpoint = url.rlike(r"(?i)linkedin\.com/checkpoint/")
    results = F.coalesce(served, F.lit(False)) | is_result_page(text)
    joined = F.concat_ws("\n", title, url, text)
    login = joined.rlike(r"(?i)authwall|/login|sign in to linkedin|join linkedin") & ~text.rlike(
        r"(?is)\bHome\b.{0,120}\bMy Network\b.{0,120}\bJobs\b")
    unserved = ~F.coalesce(served, F.lit(False))
    says_empty = (
        text.rlike(r"(?i)0 results|no .{0,20}(?:jobs?|positions?|openings?|matches?)|no matching")
        | title.rlike(r"(?i)no .{0,20}(?:jobs?|positions?|openings?|matches?) in"))
    empty = (unserved & says_empty) | (F.coalesce(~served, F.lit(False)) & title.rlike("(?i)jobs"))
    searched = F.lit(is_search) | served.isNotNull()
    block = blocked_state(F.concat_ws("\n", title, text))
    unblocked = (F.when(login, F.lit("login_required")).when(searched & empty, F.lit("empty"))
                 .otherwise(F.lit("healthy")))
    # bound once: the wording is tested on the visible text, which costs several passes over the page
    judged = once(block, lambda b: F.when(b.isNotNull(), b).otherwise(unblocked))
    return F.when(results & ~checkpoint, F.lit("healthy")).otherwise(judged)


def blocked_state(page: Column) -> Column:
    """State that the block wording in a page's visible text tells, NULL without such wording."""
    def state(hay: Column) -> Column:
        first_block = F.lit(None).cast("string")
        for name, pattern in reversed(lx.BLOCK_SIGNATURES):
            first_block = F.when(hay.rlike(pattern), F.lit(name)).otherwise(first_block)
        limited = hay.rlike(r"(?i)too many requests|rate limit|temporarily restricted")
        return once(first_block, lambda b: F.when(b.isNotNull(), F.when(limited, F.lit("rate_limited")).when(
            b == "active_challenge", b).otherwise(F.lit("blocked"))))

    return once(visible_text(page), state)


def job_ids(html: Column) -> Column:
    """Distinct posting ids in a page, in pattern order then page order."""
    text = html
    for entity, plain in (("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&amp;", "&"),
                          ("&#61;", "="), ("&lt;", "<"), ("&gt;", ">")):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in lx.JOB_ID_PATTERNS]
    return F.array_distinct(F.concat(*found))


def posting_fields(html: Column) -> dict[str, Column]:
    """Ten fields by class markers; the first matching pattern of each wins."""
    out = {name: F.trim(first_hit(html, patterns)) for name, patterns in lx.FIELD_PATTERNS.items()}
    out["applicants"] = out["applicants"].try_cast("bigint")
    out["description"] = F.coalesce(
        squeeze(F.regexp_replace(first_hit(html, lx.FIELD_PATTERNS["description"]), r"<[^>]*>", " ")),
        F.lit(""))
    links = F.array(*[hit(html, p) for p in lx.APPLY_LINK_PATTERNS])
    out["application_links"] = F.filter(links, lambda x: x.isNotNull() & (x != "#"))
    return out


# ``lines`` below is a line array held in a column (see ``text_lines``).
def line_after(lines: Column, label: str) -> Column:
    """The line following the first line equal to ``label`` (case ignored)."""
    at = F.array_position(F.transform(lines, F.lower), label.lower())
    return F.when(at > 0, blank_to_null(F.get(lines, at.cast("int"))))


def posted_line(lines: Column) -> Column:
    return F.get(F.filter(lines, lambda s: s.rlike(lx.POSTED_LINE_PATTERN)), F.lit(0))


def applicants_line(lines: Column) -> Column:
    return F.get(F.filter(lines, lambda s: s.rlike("(?i)applicants?") & ~s.rlike("(?i)has hired")),
                 F.lit(0))


def plausible_line(s: Column) -> Column:
    return F.coalesce(
        (s != "") & (F.length(s) < 180) & ~s.rlike(r"^window\.__")
        & ~s.rlike("(?i)^(Apply|Save|Report this job|Sign in|Join now|Clear text)$"), F.lit(False))


def top_card(lines: Column, title: Column, company: Column) -> Column:
    """Struct (company, location): the two lines under the title line."""
    indexed = F.transform(lines, lambda s, i: F.struct(
        s.alias("title"), F.get(lines, i + 1).alias("company"), F.get(lines, i + 2).alias("location")))
    ok = F.filter(indexed, lambda t: (t["title"] == title) & t["location"].isNotNull()
                  & plausible_line(t["company"])
                  & (company.isNull() | (company == "") | (t["company"] == company)))
    card = F.get(ok, F.lit(0))
    return F.struct(card["company"].alias("company"),
                    F.when(plausible_line(card["location"]), card["location"]).alias("location"))


def _from(lines: Column, at: Column, until: Column | None = None) -> Column:
    """Lines after 1-based position ``at`` and before ``until``."""
    stop = F.size(lines) + 1 if until is None else F.coalesce(until, F.size(lines) + 1)
    n = F.greatest(stop - at - 1, F.lit(0))
    return F.slice(lines, (at + 1).cast("int"), n.cast("int"))


def with_job_description(df: DataFrame, text: str, out: str = "job_description") -> DataFrame:
    """Adds the description found in page text, NULL when there is none.

    Lines between the report and seniority lines, else after "About the job", starting
    at the first heading; short results fall back to the marker pairs.  Array results
    used more than once are columns of their own, so each is computed once.
    """
    none = F.array().cast("array<string>")
    lines, marks, body = F.col("_lines"), F.col("_marks"), F.col("_body")

    def first_pos(test):
        return F.get(F.filter(marks, test), F.lit(0))["pos"]

    start, about = F.col("_start"), F.col("_about")
    end = first_pos(lambda m: (m["pos"] > start) & (m["s"] == "Seniority level"))
    about_end = first_pos(lambda m: (m["pos"] > about) & m["s"].rlike(lx.JD_END_PATTERN))
    staged = (
        df.withColumn("_lines", text_lines(F.col(text)))
        .withColumn("_marks", F.transform("_lines", lambda s, i: F.struct(
            (i + 1).alias("pos"), s.alias("s"))))
        .withColumn("_start", F.array_position(lines, "Report this job"))
        .withColumn("_about", first_pos(lambda m: m["s"].rlike("(?i)^About the job$")))
        .withColumn("_end", end)
        .withColumn("_body", F.when(
            (start > 0) & (F.col("_end") > start + 1), _from(lines, start, F.col("_end")))
            .when(about.isNotNull(), _from(lines, about, about_end)).otherwise(none))
    )
    head = F.get(F.filter(F.transform(body, lambda s, i: F.struct((i + 1).alias("pos"), s.alias("s"))),
                          lambda m: m["s"].rlike(lx.JD_START_PATTERN)), F.lit(0))["pos"]
    joined = F.array_join(
        F.slice(body, F.coalesce(head, F.lit(1)).cast("int"), F.size(body) + 1), "\n")
    staged = staged.withColumn("_clean", clean_description(joined))
    found = F.when(F.length("_clean") > 100, F.col("_clean")).otherwise(
        description_by_markers(F.col(text)))
    return computed_once(staged.withColumn(out, F.when(F.length(text) >= 100, found)).drop(
        "_lines", "_marks", "_body", "_start", "_about", "_end", "_clean"), [c for c in df.columns if c != out])


def clean_description(c: Column) -> Column:
    out = F.regexp_replace(c, r"\b(?:Join now|Sign in|Apply|Easy Apply|Save)\b", " ")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return F.regexp_replace(F.regexp_replace(out, r"[ \t]{2,}", " "), r"^\s+|\s+$", "")


def description_by_markers(text: Column) -> Column:
    """First marker pair that encloses more than 100 characters."""
    out = []
    for start, end in lx.JD_MARKERS:
        inner = hit(text, f"(?s){re.escape(start)}(.*?){re.escape(end)}")
        clean = clean_description(inner)
        out.append(F.when(F.length(clean) > 100, clean))
    return F.coalesce(*out)


def page_description(posting: Column, html: Column) -> Column:
    """Description in the posting object, else the text of the page."""
    described = F.try_variant_get(posting, "$.description", "string")
    return F.when(F.length(F.coalesce(described, F.lit(""))) > 0, html_to_text(described)).otherwise(
        html_to_text(html))
