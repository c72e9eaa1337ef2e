"""Raw payloads to postings: a feed is a mapping of fields, so a new board is an entry and no code."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.functions.text import any_of, clean_html, parse_salary


@dataclass(frozen=True)
class Feed:
    """``items``: path of the array in the payload (a bare array if empty); fields name paths, the first non-empty wins."""

    items: str
    fields: dict[str, tuple[str, ...]]
    script_id: str = ""
    limit: int = 2000
    defaults: dict[str, str] = field(default_factory=dict)


FEEDS = {
    "flat": Feed("$.jobs", {"external_id": ("$.id",), "title": ("$.title",), "company": ("$.company_name",), "url": ("$.url",), "description": ("$.description",), "salary_min": ("$.salaryMin",)}, limit=8000),
    "salaried": Feed(
        "$.jobs",
        {"external_id": ("$.id",), "title": ("$.jobTitle",), "company": ("$.companyName",), "url": ("$.url",), "location": ("$.jobGeo",), "description": ("$.jobDescription", "$.jobExcerpt"),
         "salary_min": ("$.salaryMin",), "salary_max": ("$.salaryMax",), "currency": ("$.salaryCurrency",)},
        limit=6000, defaults={"company": "Empresa Remota (Jobicy)", "location": "USA / Worldwide", "currency": "USD"},
    ),
    "array": Feed("$", {"external_id": ("$.id", "$.slug"), "title": ("$.position",), "company": ("$.company",), "url": ("$.url",), "location": ("$.location",), "description": ("$.description",)}),
    "nested": Feed("$.data", {"external_id": ("$.id",), "title": ("$.attributes.title",), "url": ("$.links.public_url",), "description": ("$.attributes.description",), "company": ("$.attributes.company.data.id",)}),
    "alternative": Feed("$.itens", {"external_id": ("$.codigo", "$.id"), "title": ("$.titulo", "$.curso"), "company": ("$.empresa",), "location": ("$.cidade",), "description": ("$.descricao",)}),
    "embedded": Feed("$.props.pageProps.initialJobList.data", {"external_id": ("$.id",), "title": ("$.name",), "company": ("$.careerPageName",), "url": ("$.jobUrl",), "location": ("$.city",)}, "__NEXT_DATA__"),
}


def parse_json_feed(bronze: DataFrame, feed: Feed) -> DataFrame:
    """Postings of the payloads of a JSON feed; items without a title, and payloads that are no JSON, give none."""
    payload = F.col("payload")
    if feed.script_id:
        payload = F.regexp_extract(payload, rf'(?s)<script id="{feed.script_id}"[^>]*>(.*?)</script>', 1)
    parsed = bronze.withColumn("_v", F.try_parse_json(payload)).select(
        "source", F.explode(F.try_variant_get(F.col("_v"), feed.items, "array<variant>")).alias("item")
    )

    def value(paths: tuple[str, ...]) -> Column:
        found = [F.nullif(F.trim(F.try_variant_get(F.col("item"), p, "string")), F.lit("")) for p in paths]
        return F.coalesce(*found, F.lit(""))

    names = ["external_id", "title", "company", "location", "url", "description"]
    usual = lambda n: F.lit(feed.defaults.get(n, ""))
    cols = {n: F.coalesce(F.nullif(value(feed.fields[n]), F.lit("")), usual(n)) if n in feed.fields else usual(n) for n in [*names, "currency"]}
    cols["description"] = clean_html(cols["description"], feed.limit)
    for n in ("salary_min", "salary_max"):
        cols[n] = F.nullif(F.try_variant_get(F.col("item"), feed.fields[n][0], "double"), F.lit(0.0)) if n in feed.fields else F.lit(None).cast("double")
    return parsed.select("source", *[c.alias(n) for n, c in cols.items()]).where("title <> ''")


def parse_rss(bronze: DataFrame) -> DataFrame:
    """Postings of RSS payloads; a title `Company: Title` is split at the first colon."""
    schema = "channel struct<item: array<struct<title: string, link: string, description: string, region: string, pubDate: string>>>"
    items = bronze.select("source", F.explode(F.from_xml("payload", schema)["channel"]["item"]).alias("i"))
    parts = F.split("i.title", ": ", 2)
    named = F.size(parts) == 2
    return items.where(F.trim(F.coalesce("i.title", F.lit(""))) != "").select(
        "source",
        F.coalesce("i.link", F.lit("")).alias("url"),
        F.when(named, F.get(parts, 1)).otherwise(F.get(parts, 0)).alias("title"),
        F.when(named, F.get(parts, 0)).otherwise(F.lit("")).alias("company"),
        F.coalesce("i.region", F.lit("")).alias("location"),
        # the weekday is skipped: its pattern letter can't be parsed
        F.try_to_timestamp(F.regexp_replace("i.pubDate", "^[A-Za-z]{3}, *", ""), F.lit("d MMM yyyy HH:mm:ss Z")).alias("published_at"),
    )


def split_last(rows: DataFrame) -> DataFrame:
    """Titles `Title - Company` of postings without a company, split at the last dash."""
    cut = r"^(.*) - (.*)$"
    named = (F.col("company") == "") & F.col("title").rlike(cut)
    return rows.withColumns(
        {
            "company": F.when(named, F.regexp_extract("title", cut, 2)).otherwise(F.col("company")),
            "title": F.when(named, F.regexp_extract("title", cut, 1)).otherwise(F.col("title")),
        }
    )


@dataclass(frozen=True)
class Cards:
    """HTML cards: pattern of the tag that opens one, and of the classes of its link and fields; values where a field is missing.

    ``base`` precedes relative links; ``id_pattern`` finds the id in the address, which else is the id.
    """

    card: str
    base: str
    link: str = ""
    title: str = ""
    company: str = ""
    location: str = ""
    no_company: str = "Empresa Confidencial"
    no_location: str = "Brasil"
    id_pattern: str = ""


CARDS = {
    "listed": Cards("<li[^>]*>", "", "base-card__full-link|job-card-list__title", "base-search-card__title", "base-search-card__subtitle", "job-search-card__location"),
    "coded": Cards('<li[^>]*class="[^"]*vaga[^"]*"[^>]*>', "https://www.vagas.com.br", "link-detalhes-vaga", "", "empr|cargo", "vaga-local", "Confidencial", id_pattern=r"/v(\d+)/"),
    "relative": Cards('<li[^>]*class="[^"]*(?:JobCard|react-job-listing)[^"]*"[^>]*>', "https://www.glassdoor.com.br", "", "", "Employer", "location"),
    "salaried": Cards('<td[^>]*class="[^"]*resultContent[^"]*"[^>]*>', "https://br.indeed.com", "jcs-JobTitle", "", "companyName", "companyLocation", "Empresa Não Informada"),
}


def parse_cards(bronze: DataFrame, cards: Cards) -> DataFrame:
    """Postings of payloads of HTML cards: id, address, title, company, place, mode, salary and time of each card with a link.

    A field is the text of the first element of its class; what a card lacks has the feed's usual value.
    """
    parts = F.split("payload", "(?i)" + cards.card)
    rows = bronze.select("source", F.explode(F.slice(parts, F.lit(2), F.size(parts))).alias("card"))
    tag = rf'(?is)<a[^>]*class="[^"]*(?:{cards.link})[^"]*"[^>]*>' if cards.link else "(?is)<a[^>]*>"
    link = F.regexp_extract("card", f"({tag}.*?</a>)", 1)
    href = F.regexp_extract(link, r'(?is)^<a[^>]*href="([^"]*)"', 1)
    url = F.when(href.rlike("^https?:"), href).otherwise(F.concat(F.lit(cards.base), href))

    def field(classes: str, missing: Column | str) -> Column:
        missing = F.lit(missing) if isinstance(missing, str) else missing
        if not classes:
            return missing
        found = clean_html(F.regexp_extract("card", rf'(?is)<([a-z0-9]+)[^>]*class="[^"]*(?:{classes})[^"]*"[^>]*>(.*?)</\1>', 2))
        return F.when(found != "", found).otherwise(missing)

    plain = clean_html(F.col("card"))
    low, salary = F.lower(plain), parse_salary(plain)
    code = F.regexp_extract(url, cards.id_pattern, 1) if cards.id_pattern else F.lit("")
    when = F.try_to_timestamp(F.nullif(F.regexp_extract("card", r'(?is)<time[^>]*datetime="([^"]*)"', 1), F.lit("")))
    return rows.where(href != "").select(
        "source", url.alias("url"), F.when(code != "", code).otherwise(url).alias("external_id"), field(cards.title, clean_html(link)).alias("title"),
        field(cards.company, cards.no_company).alias("company"), field(cards.location, cards.no_location).alias("location"),
        F.when(any_of(low, ["remoto", "home office"]), "remote").when(any_of(low, ["híbrido", "hibrido"]), "hybrid").otherwise("onsite").alias("work_mode"),
        salary["low"].alias("salary_min"), salary["high"].alias("salary_max"), when.alias("published_at"),
    ).where("title <> ''")


# Terms that pass the gate whatever roles are wanted.
GATE_TERMS = ["python", "django", "backend"]


def relevant(rows: DataFrame, roles: list[str]) -> DataFrame:
    """Rows (title, tags) that a feed lets in: a role term in title or tags, or one of its fixed terms."""
    text = F.lower(F.concat_ws(" ", "title", F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " ")))
    return rows.where(any_of(text, [r.lower() for r in roles if r] + GATE_TERMS))


def parse_html_cards(bronze: DataFrame) -> DataFrame:
    """Links of HTML pages: each anchor with a title and an address; relative ones are made absolute."""
    base = F.regexp_extract("url", r"^(https?://[^/]+)", 1)
    cards = bronze.select("source", base.alias("base"), F.explode(F.regexp_extract_all("payload", F.lit(r"(?is)(<a\s[^>]*href=[^>]*>.*?</a>)"), 1)).alias("card"))
    href = F.regexp_extract("card", r"""(?is)href=["']?([^"'\s>]*)""", 1)
    found = cards.select("source", F.when(href.startswith("/"), F.concat("base", href)).otherwise(href).alias("url"), clean_html(F.col("card"), 200).alias("title"))
    return found.where("title <> ''")


#: Sources that can be enabled, by name, and those that are unless a user names others. A new one is an entry.
REGISTRY: dict[str, Feed | Cards | str] = {**FEEDS, **{f"cards_{k}": v for k, v in CARDS.items()}, "rss": "rss"}
USUAL = ["flat", "salaried", "rss"]


def enabled(names: Column, usual: list[str] | None = None, registry: list[str] | None = None) -> Column:
    """The registered ones of a user's sources, in their order, trimmed and in lower case; the usual ones if the user names none."""
    clean = lambda c: F.filter(F.transform(c, lambda x: F.lower(F.trim(F.coalesce(x, F.lit(""))))), lambda x: x != "")
    array = lambda x: F.array(*map(F.lit, x)).cast("array<string>")
    own = F.coalesce(names, F.array().cast("array<string>"))
    chosen = F.when(F.size(own) > 0, clean(own)).otherwise(clean(array(USUAL if usual is None else usual)))
    return F.filter(chosen, lambda x: F.array_contains(array(sorted(registry or REGISTRY)), x))
