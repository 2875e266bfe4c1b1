"""Posting field normalizers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacantry import lexicon as lx
from vacantry.functions.text import blank_to_null, literal_map, squeeze, title_case

NO_REASON = "No role classification reason recorded."


def source_name(c: Column, default: str = "linkedin") -> Column:
    return F.lower(F.trim(F.coalesce(F.when(c != "", c), F.lit(default))))


def posting_id(*ids: Column, url: Column) -> Column:
    """First id field present, else the number in a ``/jobs/view/`` link, else NULL."""
    from_url = F.regexp_extract(url, r"/jobs/view/(\d+)", 1)
    return blank_to_null(F.trim(F.coalesce(*ids, F.when(from_url != "", from_url))))


def default_url(source: Column, job_id: Column, url: Column) -> Column:
    built = F.when(source == "linkedin",
                   F.concat(F.lit("https://www.linkedin.com/jobs/view/"), job_id))
    return F.coalesce(F.when(url != "", url), built)


def list_of(c: Column) -> Column:
    """Array from JSON array text, one JSON object, or text split on ``;`` and ``,``."""
    text = F.trim(c)
    as_list = F.from_json(text, "array<string>")
    split = F.split(text, "[;,]")
    items = (
        F.when(text.rlike(r"(?s)^\[.*\]$"), F.coalesce(as_list, split))
        .when(text.rlike(r"(?s)^\{.*\}$") & F.try_parse_json(text).isNotNull(), F.array(text))
        .otherwise(split)
    )
    items = F.filter(F.transform(items, lambda s: F.trim(s)), lambda s: s.isNotNull() & (s != ""))
    return F.coalesce(F.array_distinct(items), F.array().cast("array<string>"))


def applicant_count(c: Column) -> Column:
    """First group of digits with separators removed ("Over 1,200" is 1200)."""
    digits = F.regexp_replace(F.regexp_extract(c, r"(\d[\d.,]*)", 1), r"[^\d]", "")
    return F.when(digits != "", digits).try_cast("bigint")


def confidence(c: Column) -> Column:
    """Share in [0,1]; a percentage in (1,100] is divided; anything else is NULL."""
    n = F.when(F.trim(c.cast("string")) != "", c.cast("string")).try_cast("double")
    return F.when(n.between(0, 1), n).when((n > 1) & (n <= 100), n / 100)


def language_name(c: Column) -> Column:
    """Canonical language: alias table, else the word with a capital first letter."""
    text = blank_to_null(F.trim(c))
    capitalised = F.concat(F.upper(F.substring(text, 1, 1)),
                           F.lower(text.substr(F.lit(2), F.length(text))))
    return F.coalesce(literal_map(lx.LANGUAGE_ALIASES)[F.lower(text)], capitalised)


def language_list(c: Column) -> Column:
    named = F.transform(list_of(c), language_name)
    return F.array_distinct(F.filter(named, lambda x: x.isNotNull()))


def language_rows(required: Column, nice: Column) -> Column:
    """Array of (language, importance); a required language is never also nice to have."""
    must = language_list(required)
    may = F.array_except(language_list(nice), must)

    def tag(langs, importance):
        return F.transform(langs, lambda x: F.struct(
            x.alias("language"), F.lit(importance).alias("importance")))

    return F.concat(tag(must, "required"), tag(may, "nice_to_have"))


def work_mode(c: Column) -> Column:
    text = F.lower(F.trim(c))
    return (
        F.when(text.isin("remote", "hybrid"), text)
        .when(text.isin("onsite", "on-site", "on site", "office"), F.lit("onsite"))
    )


def work_mode_rows(modes: Column, single: Column) -> Column:
    """Array of (work_mode, is_primary): unique, exactly one primary, the first.

    ``modes`` is list text and wins over ``single``, which splits on commas, slashes,
    bars and the words "or" and "and".
    """
    parts = F.when(blank_to_null(modes).isNotNull(), list_of(modes)).otherwise(
        F.split(F.coalesce(single, F.lit("")), r"(?i)[,/|]|\bor\b|\band\b"))
    known = F.array_distinct(F.filter(F.transform(parts, work_mode), lambda m: m.isNotNull()))
    return F.transform(known, lambda m, i: F.struct(
        m.alias("work_mode"), (i == 0).alias("is_primary")))


def country_code(c: Column) -> Column:
    text = F.trim(c)
    return F.when(text.rlike("^[A-Za-z]{2}$"), F.upper(text)).otherwise(
        literal_map(lx.COUNTRY_NAMES)[F.lower(text)])


def application_links(c: Column, url: Column) -> Column:
    links = list_of(c)
    fallback = F.when(url.isNotNull(), F.array(url)).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(links) > 0, links).otherwise(fallback)


def inferred_work_modes(title: Column, location: Column, description: Column) -> Column:
    """Work modes named anywhere in the posting, strongest first."""
    text = F.concat_ws("\n", title, location, description)
    return F.array_compact(F.array(
        F.when(text.rlike(r"(?i)remote|work from home|home[- ]based"), F.lit("remote")),
        F.when(text.rlike(r"(?i)hybrid"), F.lit("hybrid")),
        F.when(text.rlike(r"(?i)on[- ]?site|office[- ]based|in office"), F.lit("onsite")),
    ))


def listing_work_modes(location: Column, card_text: Column) -> Column:
    """Work modes on a result card; on-site only counts when nothing else is named."""
    text = F.concat_ws(" ", location, card_text)
    found = F.array_compact(F.array(
        F.when(text.rlike("(?i)remote"), F.lit("remote")),
        F.when(text.rlike("(?i)hybrid"), F.lit("hybrid"))))
    onsite = F.when(text.rlike("(?i)onsite|on-site"), F.array(F.lit("onsite"))).otherwise(found)
    return F.when(F.size(found) > 0, found).otherwise(onsite)


def host_of(url: Column) -> Column:
    """Lower-case host of an http(s) link; NULL for anything else."""
    host = F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.lower(F.when(host != "", host))


def country_of_host(host: Column) -> Column:
    out = F.when(host.isin(lx.US_HOSTS), F.lit("US"))
    for prefix, code in reversed(lx.HOST_PREFIX_COUNTRIES.items()):
        out = F.when(host.startswith(prefix), F.lit(code)).otherwise(out)
    return out


def country_of_location(c: Column) -> Column:
    """Exact place name, else the first listed name contained in the text."""
    out = F.lit(None).cast("string")
    for name, code in reversed(lx.LOCATION_COUNTRIES):
        out = F.when(F.contains(F.lower(c), F.lit(name.lower())), F.lit(code)).otherwise(out)
    return F.coalesce(literal_map(dict(lx.LOCATION_COUNTRIES))[c], out)


def city_of(c: Column) -> Column:
    """Text before a comma, bracket or dash; NULL for countries and remote."""
    text = F.trim(c)
    vague = text.rlike(r"(?i)remote|united kingdom|ireland|switzerland|united states")
    return F.when(~vague, blank_to_null(F.trim(F.split(text, r",|\(|-", 2)[0])))


def company_of_url(url: Column) -> Column:
    """Employer from an applicant-tracking link, in title case, else empty."""
    host = host_of(url)
    path = F.regexp_extract(url, r"^[^:]+://[^/?#]+/+([^/?#]+)", 1)
    first = F.when(path != "", path)
    sub = F.regexp_replace(F.split(host, r"\.", 2)[0], r"(?i)-?wd\d*$", "")
    picked = (
        F.when(host.rlike(r"jobs\.lever\.co$|(^|\.)greenhouse\.io$|jobs\.ashbyhq\.com$|smartrecruiters\.com$"), first)
        .when(host.rlike(r"workdayjobs\.com$"), sub)
    )
    words = F.regexp_replace(F.try_url_decode(picked), r"[-_+]+", " ")
    words = F.regexp_replace(words, r"([a-z])([A-Z])", "$1 $2")
    return F.coalesce(title_case(squeeze(words)), F.lit(""))


def company_of_title(page_title: Column, job_title: Column, size: int | None = None) -> Column:
    """Last segment of a page title without the job title; job-board names give empty.

    The name is whole unless a ``size`` in characters is given.
    """
    pos = F.position(F.lower(job_title), F.lower(page_title))
    n = F.length(job_title)
    cut = F.when(
        (F.coalesce(n, F.lit(0)) > 0) & (pos > 0),
        F.concat(page_title.substr(F.lit(1), pos - 1),
                 page_title.substr(pos + n, F.length(page_title)))).otherwise(page_title)
    parts = F.filter(F.transform(F.split(cut, r"(?i)\s+[-|–—]\s+|\s+at\s+"), lambda s: F.trim(s)),
                     lambda s: s != "")
    last = F.when(F.size(parts) > 0, F.element_at(parts, -1))
    board = last.rlike("(?i)job|career|greenhouse|lever|workday|smartrecruiters|ashby")
    return F.coalesce(F.when(~board, last if size is None else F.substring(last, 1, size)), F.lit(""))


PLACE_PATTERN = (
    r"[A-Z][a-zA-Z.'-]*(?:\s+[A-Z][a-zA-Z.'-]*){0,5},\s*[A-Z][a-zA-Z .'-]+(?:,\s*[A-Z][a-zA-Z .'-]+)*"
)
# fixed values: places recognized without a comma
KNOWN_PLACES = [
    "Remote", "EMEA", "United Kingdom", "England", "Scotland", "Wales", "Northern Ireland",
    "London(?: Area)?", "Greater London", "Knutsford", "Manchester", "Glasgow", "Edinburgh",
    "Birmingham", "Bristol", "Leeds", "Liverpool", "Cambridge", "Oxford", "Reading",
    "Switzerland", "Dublin", "Ireland", "Amsterdam", "Netherlands", "Berlin", "Germany",
    "Paris", "France", "Milan", "Italy",
]


def company_and_location(c: Column) -> Column:
    """Split run-together card text such as "AcmeLondon, England"."""
    text = blank_to_null(F.trim(c))
    # a place that starts at the first character is not a split point
    places = F.filter(F.regexp_extract_all(text, F.lit(f"({PLACE_PATTERN})"), F.lit(1)),
                      lambda m: F.position(m, text) > 1)
    place = F.when(F.size(places) > 0, places[0])
    at = F.position(place, text)
    known = rf"(?i)\b(?:{'|'.join(KNOWN_PLACES)})\b"
    hit = F.regexp_extract(text, f"({known})", 1)
    known_at = F.when(hit != "", F.position(hit, text))

    def before(pos):
        return blank_to_null(F.trim(text.substr(F.lit(1), pos - 1)))

    return F.struct(
        F.when(at > 1, before(at)).when(known_at > 1, before(known_at)).otherwise(text)
        .alias("company"),
        F.when(at > 1, F.trim(place))
        .when(known_at > 1, F.trim(text.substr(known_at, F.length(text)))).alias("location"),
    )


def title_meta(c: Column) -> Column:
    """Struct (title, company, location) from a page title."""
    clean = F.trim(F.regexp_replace(c, r"(?i)\s+\|\s+LinkedIn.*$", ""))
    hiring = r"(?i)^(.+?) hiring (.+?) in (.+)$"
    bars = r"(?i)^(.+?)\s+\|\s+(.+?)\s+\|\s+LinkedIn"
    is_hiring, is_bars = clean.rlike(hiring), c.rlike(bars)

    def part(pattern, source, group):
        return F.trim(F.regexp_extract(source, pattern, group))

    return F.struct(
        F.when(is_hiring, part(hiring, clean, 2)).when(is_bars, part(bars, c, 1))
        .otherwise(F.when(clean != "", clean)).alias("title"),
        F.when(is_hiring, part(hiring, clean, 1)).when(is_bars, part(bars, c, 2)).alias("company"),
        F.when(is_hiring, part(hiring, clean, 3)).alias("location"),
    )


def role_label(c: Column) -> Column:
    """Known label, ignoring case, dashes and underscores; anything else Unclassified."""
    key = F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"[-_\s]+", " ")
    known = {re.sub(r"[-_\s]+", " ", label.lower()): label for label in lx.ROLE_LABELS}
    return F.coalesce(literal_map(known)[key], F.lit(lx.UNCLASSIFIED))


REASON_SCHEMA = (
    "summary string, reason string, message string, evidence array<string>, gaps array<string>"
)


def reason_text(c: Column) -> Column:
    """Readable reason from JSON or plain text."""
    text = F.trim(c)
    obj = F.when(text.rlike(r"(?s)^\{.*\}$"), F.from_json(text, REASON_SCHEMA))

    def listed(name, title):
        items = F.array_join(F.filter(obj[name], lambda s: s != ""), ", ")
        return F.when(items != "", F.concat(F.lit(title + ": "), items, F.lit(".")))

    head = F.coalesce(*[blank_to_null(F.trim(obj[n])) for n in ("summary", "reason", "message")])
    parsed = F.concat_ws(" ", head, listed("evidence", "Evidence"), listed("gaps", "Gaps"))
    is_json = F.when(text != "", F.try_parse_json(text)).isNotNull() & text.startswith("{")
    return F.coalesce(blank_to_null(F.when(is_json, parsed).otherwise(text)), F.lit(NO_REASON))


def role_report(label: Column, reason: Column, description: Column) -> Column:
    """Struct describing how a stored role label should be read in a report."""
    raw = F.trim(F.coalesce(label, F.lit("")))
    canonical = role_label(raw)
    valid = raw.isin(lx.ROLE_LABELS)
    base = reason_text(reason)
    fallback = (
        F.when(raw == "", F.lit("Unclassified because no role label was recorded. "
                                "No role classification reason recorded; reclassification is required."))
        .when(canonical == lx.UNCLASSIFIED, F.concat(
            F.lit('Unclassified because stored role label "'), raw,
            F.lit('" is not recognized by the adjacent-role taxonomy; reclassification is required.')))
        .when(canonical != raw, F.concat(
            F.lit('Legacy role label "'), raw, F.lit('" normalized to "'), canonical,
            F.lit('"; detailed JD reason unavailable, so reclassification is recommended.')))
        .otherwise(F.concat(canonical, F.lit(
            " classification has no detailed JD reason recorded; "
            "verify the full JD before applying.")))
    )
    full = F.length(F.trim(F.coalesce(description, F.lit("")))) > 0
    return F.struct(
        canonical.alias("role_label"),
        F.when(raw != "", raw).alias("raw_label"),
        valid.alias("is_valid"),
        ((raw != "") & ~valid & (canonical != lx.UNCLASSIFIED)).alias("is_canonicalized"),
        F.when(base == NO_REASON, fallback).otherwise(base).alias("reason_text"),
        F.when(full, F.lit("full-JD")).otherwise(F.lit("provisional")).alias("stage"),
    )


def salary_label(c: Column) -> Column:
    """Pay text squeezed; blank or the words "salary guide" become NULL."""
    text = blank_to_null(squeeze(c))
    return F.when(~text.rlike("(?i)^salary guide$"), text)


def link_target(url: Column) -> Column:
    """Destination inside a redirect link (its ``url`` parameter), else the link itself."""
    inner = F.regexp_extract(url, r"[?&]url=([^&#]+)", 1)
    return F.when(inner != "", F.coalesce(F.try_url_decode(inner), url)).otherwise(url)
